"""Text functions: column in, column out, all built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin-1 letters and their base letters.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïðñòóôõöøùúûüÿ"
PLAIN = "aaaaaaceeeeiiiionoooooouuuuyaaaaaaceeeeiiiionoooooouuuuy"
#: Control characters and Unicode white space.
SPACES = r"[\x00-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
WORD = r"\w{2,50}"
STORED_CHARS = 65535


def normalize_text(text: Column) -> Column:
    """Lower case, base letters for Latin-1 accents, white space and control characters as single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, ACCENTED, PLAIN)), SPACES, " "))


def tokenize(normalized: Column) -> Column:
    """All runs of 2 to 50 ASCII word characters of a normalized text, in order."""
    return F.regexp_extract_all(normalized, F.lit(WORD), F.lit(0))


def token_gaps(normalized: Column) -> Column:
    """What stands before each token, and after the last."""
    return F.split(normalized, WORD, -1)


def remove_control_chars(text: Column) -> Column:
    """Drop what XML 1.0 does not allow."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")


def untag_text(text: Column) -> Column:
    return F.regexp_replace(text, "<.*?>", "")


def any_of(words: list[str]) -> str:
    """A pattern of the words as they are; signs of the pattern language are quoted."""
    return "(" + "|".join(re.escape(w) for w in words) + ")"


def boldify(text: Column, words: list[str]) -> Column:
    """``<b>`` around each occurrence of the words, in any case, inside words too."""
    words = [w for w in words if w]
    return F.regexp_replace(text, "(?i)" + any_of(words), "<b>$1</b>") if words else text


def accent_pattern(word: str) -> str:
    """A regex for the word with every letter's accented variants, either case."""
    out = []
    for char in word:
        if not re.match("[a-zA-Z0-9]", char):
            out.append(re.escape(char))
            continue
        variants = [a for a, p in zip(ACCENTED, PLAIN, strict=True) if p == char.lower()]
        out.append("(?:" + "|".join(dict.fromkeys([char.lower(), char.upper(), *variants])) + ")")
    return "".join(out)


def bold_accents(text: Column, words: list[str]) -> Column:
    for word in words:
        text = F.regexp_replace(text, f"({accent_pattern(word)})", "<b>$1</b>")
    return text


def html_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def contract_spaces(text: Column) -> Column:
    """Control characters and blanks as one blank."""
    return F.regexp_replace(text, r"[\x00-\x20]+", " ")


def content_id(text: Column) -> Column:
    """SHA-1 of the text with any line end as a line feed."""
    return F.sha1(F.regexp_replace(text, "\r\n?", "\n"))


def web_content_id(content: Column) -> Column:
    """SHA-1 of raw bytes."""
    return F.sha1(content)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]+$", 0)


def title_or_fallback(title: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), base_name(path))


def first_chars_title(text: Column) -> Column:
    return F.substring(text, 1, 60)


def abstract200(text: Column) -> Column:
    return F.substring(text, 1, 200)


def stored_text(text: Column) -> Column:
    return F.substring(text, 1, STORED_CHARS)


def index_text(title: Column, text: Column) -> Column:
    return F.concat_ws(" ", title, text)


def readable_size(size: Column) -> Column:
    """Thousands, floored; exact powers fall through to GB, no size to a notice."""
    gb = F.concat(F.floor(size / F.lit(10**9)).cast("string"), F.lit(" GB"))
    kb = F.concat(F.floor(size / F.lit(1000)).cast("string"), F.lit(" kB"))
    mb = F.concat(F.floor(size / F.lit(10**6)).cast("string"), F.lit(" MB"))
    known = F.when(size < 1000, size.cast("string")).when((size > 1000) & (size < 10**6), kb).when((size > 10**6) & (size < 10**9), mb).otherwise(gb)
    return F.when(size.isNull() | (size == 0), F.lit("XXX NO KNOWN SIZE")).otherwise(known)


def size_label(size: Column) -> Column:
    """Powers of 1024, one decimal, ties to even."""
    return F.when(size < 1024, F.format_string("%d bytes", size)).when(size < 1048576, F.format_string("%.1f k", F.bround(size / F.lit(1024.0), 1))).otherwise(F.format_string("%.1f M", F.bround(size / F.lit(1048576.0), 1)))


def hoeffding_deviation(n: Column, confidence: float = 0.9) -> Column:
    return F.sqrt(-F.log(F.lit(confidence / 2)) / (2 * n))
