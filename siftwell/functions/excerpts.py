"""Windows of a text around word positions, as column expressions, and abstracts of hits."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftwell.functions.arrays import let

HALF = 40
#: Positions from here on are not kept by an index of two bytes; their excerpt begins at the text's start.
LAST_POSITION = 65535
MOST_PLACES, AROUND, NEAR, OPENING = 5, 35, 35, 200
DOTS = " <b>...</b>"


def window(text: Column, position: Column, half: int = HALF) -> Column:
    """struct(begin, end): the characters begin to end - 1 around a position, cut at blanks."""
    at = F.when(position >= LAST_POSITION, 0).otherwise(position)
    first = F.greatest(F.lit(0), at - half)
    blank = F.instr(F.substring(text, first + 1, at - first), " ")  # the first blank before the position
    begin = F.when(first == 0, 0).when(blank > 0, first + blank).otherwise(at + 1)
    last = F.least(F.length(text), begin + 2 * half)
    behind = F.substring(text, at + 2, F.greatest(F.lit(0), last - at))
    back = F.instr(F.reverse(behind), " ")  # the last blank behind it
    end = F.when(last >= F.length(text), F.length(text)).when(back > 0, at + 2 + F.length(behind) - back).otherwise(at + 1)
    return F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end"))


def cut(text: Column, begin: Column, end: Column) -> Column:
    return F.substring(text, begin + 1, F.greatest(F.lit(0), end - begin))


def excerpt_at(text: Column, position: Column, half: int = HALF, dots: bool = False) -> Column:
    """The window of 2 * half characters around a position, with ``...`` where text is left out if asked."""

    def shown(w: Column) -> Column:
        body = cut(text, w["begin"], w["end"])
        if not dots:
            return body
        return F.concat(F.when(w["begin"] > 0, "...").otherwise(""), body, F.when(w["end"] < F.length(text), "...").otherwise(""))

    return let(window(text, position, half), shown)


def merge_excerpts(text: Column, positions: Column, half: int = HALF) -> Column:
    """The excerpts of all positions in order, overlapping ones as one, marks escaped, gaps marked."""
    spans = F.array_sort(F.transform(positions, lambda p: window(text, p, half)))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("last"))

    def joined(acc: Column, w: Column) -> Column:
        fresh = F.greatest(w["begin"], acc["last"])
        piece = F.replace(F.replace(cut(text, fresh, w["end"]), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        gap = F.when(w["begin"] > acc["last"], DOTS.strip()).otherwise("")
        return F.when(w["end"] > acc["last"], F.struct(F.concat(acc["out"], gap, piece).alias("out"), w["end"].alias("last"))).otherwise(acc)

    return F.aggregate(spans, start, joined, lambda acc: F.when(acc["out"] != "", F.concat(acc["out"], F.lit(DOTS))))


def window_of(text: str, position: int, half: int = HALF) -> tuple[int, int]:
    """``window`` of one text in a task."""
    at = 0 if position >= LAST_POSITION else position
    first = max(0, at - half)
    blank = text.find(" ", first, at)
    begin = 0 if first == 0 else blank + 1 if blank >= 0 else at + 1
    last = min(len(text), begin + 2 * half)
    back = text.rfind(" ", at + 1, max(at + 1, last + 1))
    return begin, len(text) if last >= len(text) else back + 1 if back >= 0 else at + 1


def excerpt_of(text: str, position: int) -> str:
    begin, end = window_of(text, position)
    return text[begin : max(begin, end)]


def merged_of(text: str, positions: list[int]) -> str | None:
    """``merge_excerpts`` of one text in a task."""
    out, last = "", 0
    for begin, end in sorted(window_of(text, p) for p in positions):
        if end > last:
            piece = text[max(begin, last) : end].replace("<", "&lt;").replace(">", "&gt;")
            out += (DOTS.strip() if begin > last else "") + piece
            last = end
    return out + DOTS if out else None


#: Letters that match an ASCII letter when case is ignored.
LIKE_ASCII = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}


def folded(text: str) -> str:
    """``text`` in one case, letter for letter, as far as ASCII words are looked for in it."""
    if not text.isascii():
        for char, like in LIKE_ASCII.items():
            text = text.replace(char, like)
    return text.lower()


@functools.lru_cache(1 << 16)
def plain(word: str) -> str | None:
    """An ASCII word in one case; none if it is no single word of ASCII letters."""
    return folded(word) if word.isascii() and re.fullmatch(r"\w+", word) else None


def is_letter(char: str) -> bool:
    return char.isalnum() and not char.isdecimal()


class Readable:
    """A text without tags, read into words once for all abstracts of it."""

    def __init__(self, text: str) -> None:
        self.text = re.sub("<.*?>", "", text)
        self.runs: dict[str, list[tuple[int, int, int]]] | None = None
        self.opening: str | None = None

    def runs_of(self, key: str) -> list[tuple[int, int, int]]:
        """(nth, begin, end) of the first places where an ASCII word (in one case) stands alone; places of each spelling are numbered on their own."""
        if self.runs is None:
            self.runs, seen = {}, {}
            for m in re.finditer(r"\w+", self.text):
                run = m[0]
                word = run.lower()
                nth = seen[word] = seen.get(word, 0) + 1
                if nth <= MOST_PLACES:
                    self.runs.setdefault(word if run.isascii() else folded(run), []).append((nth, *m.span()))
        return self.runs.get(key, [])

    def places(self, words: list[str]) -> list[tuple[int, int]]:
        """At most five places of the words in order: each word's first place, then its second, and so on."""
        keys = dict.fromkeys(plain(w) for w in words)
        if None not in keys:
            found = [x for key in keys for x in self.runs_of(key)]
        else:
            found = []
            seen: dict[str, int] = {}
            for m in re.finditer("|".join(rf"(?<!\w){re.escape(w)}(?!\w)" for w in words), self.text, re.I):
                nth = seen[m[0].lower()] = seen.get(m[0].lower(), 0) + 1
                if nth <= MOST_PLACES:
                    found.append((nth, m.start(), m.end()))
        return sorted((begin, end) for _, begin, end in sorted(found)[:MOST_PLACES])

    def abstract(self, words: list[str]) -> str:
        """Snippets of 35 characters around word places, near ones as one, words in bold; without one the text's start."""
        text = self.text
        spans: list[list[int]] = []
        for begin, end in self.places(words):
            if spans and begin - spans[-1][1] < NEAR:
                spans[-1][1] = end
            else:
                spans.append([begin, end])
        if not spans:
            if self.opening is None:
                self.opening = text if len(text) <= OPENING else text[: back_to_word(text, OPENING)] + DOTS
            return self.opening
        out, last = "", 0
        order = sorted(words, key=len, reverse=True)
        sought = [folded(w) for w in order] if all(w.isascii() for w in order) else None
        for begin, end in spans:
            low = max(last, begin - AROUND)
            if low and text[low - 1].isalpha():
                while low < begin and is_letter(text[low]):
                    low += 1
            high = back_to_word(text, min(len(text), end + AROUND))
            out += (DOTS + " " if low > last else "") + marked(text[low:high], order, sought)
            last = high
        return out + (DOTS if last < len(text) else "")


def places(text: str, words: list[str]) -> list[tuple[int, int]]:
    read = Readable("")
    read.text = text
    return read.places(words)


def back_to_word(text: str, at: int) -> int:
    """The nearest place at or before ``at`` that is not inside a word."""
    if at >= len(text) or not text[at].isalpha():
        return at
    end = begin = at - 1 if at and text[at - 1] == "\n" else at  # a last line's end does not count
    while begin and is_letter(text[begin - 1]):
        begin -= 1
    return at - (end - begin)


def in_bold(piece: str, words: list[str]) -> str:
    """``piece`` with every occurrence of a word marked, longer words first."""
    order = sorted(words, key=len, reverse=True)
    return marked(piece, order, [folded(w) for w in order] if all(w.isascii() for w in order) else None)


def marked(piece: str, order: list[str], sought: list[str] | None) -> str:
    """``in_bold`` of words in order of length, ``sought`` in one case if all are ASCII."""
    if sought is None:
        return re.compile("|".join(map(re.escape, order)), re.I).sub(lambda m: f"<b>{m[0]}</b>", piece)
    low = folded(piece)
    out, at = [], 0
    left = [(begin, k) for k, w in enumerate(sought) if (begin := low.find(w)) >= 0]
    while left:
        begin, k = min(left)
        end = begin + len(sought[k])
        out.append(f"{piece[at:begin]}<b>{piece[begin:end]}</b>")
        at = end
        left = [(x, j) for b, j in left if (x := b if b >= at else low.find(sought[j], at)) >= 0]
    return "".join(out) + piece[at:]


def abstract(text: str, words: list[str]) -> str:
    return Readable(text).abstract(words)


@F.pandas_udf(StringType())
def make_abstract(text: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else abstract(t, [] if ws is None else [w for w in ws if w]) for t, ws in zip(text, words, strict=True)], dtype=object)
