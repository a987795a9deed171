"""Decoding of file contents: unpacking and a table of encoding detectors."""

from __future__ import annotations

import bz2
import codecs
import gzip
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from siftwell.functions.arrays import in_slices

#: Byte order marks, longer ones before those they begin with.
MARKS = [(codecs.BOM_UTF32_LE, "UTF-32"), (codecs.BOM_UTF32_BE, "UTF-32"), (codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF16_LE, "UTF-16"), (codecs.BOM_UTF16_BE, "UTF-16")]
META = re.compile(rb"""\bcharset\s*=\s*["']?\s*([-\w.:+]+)""", re.I)
XML_HEAD = re.compile(rb"""\s*<\?xml\b([^>]*)""", re.I)
XML_ENCODING = re.compile(rb"""\bencoding\s*=\s*["']([-\w.:+]+)""", re.I)
LATIN1 = "ISO-8859-1"
UNPACKERS = {".gz": gzip.decompress, ".bz2": bz2.decompress}


def by_mark(content: bytes, is_html: bool) -> str | None:
    return next((name for mark, name in MARKS if content.startswith(mark)), None)


def by_meta(content: bytes, is_html: bool) -> str | None:
    named = META.search(content) if is_html else None
    if not named:
        return None
    name = named[1].decode("ascii", "ignore")
    bare = "".join(c for c in name.lower() if c.isalnum())
    return LATIN1 if bare in ("latin1", "isolatin1", "iso88591") else name


def by_declaration(content: bytes, is_html: bool) -> str | None:
    head = XML_HEAD.match(content)
    if not head:
        return None
    named = XML_ENCODING.search(head[1])
    return named[1].decode("ascii", "ignore").upper() if named else "UTF-8"


def by_trial(content: bytes, is_html: bool) -> str | None:
    try:
        codecs.utf_8_decode(content, "strict", True)
    except UnicodeDecodeError:
        return None
    return "UTF-8"


DETECTORS = [by_mark, by_meta, by_declaration, by_trial]


def guess_encoding(content: bytes, is_html: bool) -> str:
    """The first detector's answer, else Latin-1, which decodes anything."""
    return next((name for detect in DETECTORS if (name := detect(content, is_html))), LATIN1)


def unpacked(content: bytes, path: str) -> bytes:
    """Contents of a packed file by its last extension; others as they are."""
    return next((unpack(content) for end, unpack in UNPACKERS.items() if path.endswith(end)), content)


def decoded(content: bytes, path: str) -> tuple[str | None, str | None, str | None]:
    """(encoding, text, error) of one file."""
    try:
        data = unpacked(content, path)
        name = path.removesuffix(".gz").removesuffix(".bz2")
        encoding = guess_encoding(data, name.endswith((".html", ".htm")))
        return encoding, data.decode(encoding, "ignore").removeprefix("﻿"), None
    except (OSError, EOFError, LookupError, ValueError) as e:
        return None, None, f"{type(e).__name__}: {e}"


@F.arrow_udf(Y.StructType([Y.StructField(n, Y.StringType()) for n in ("encoding", "text", "error")]))
def decode_text(content: pa.Array, path: pa.Array) -> pa.Array:
    """Encoding and text of file contents; a broken file gives an error and no text, null contents give nulls."""
    return in_slices(lambda raw, name: (None, None, None) if raw is None else decoded(raw, name or ""), dict.fromkeys(("encoding", "text", "error"), pa.string()), content, path)
