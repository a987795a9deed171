"""Tokens of normalized texts and their places, found for many texts at once inside Arrow map tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LEAST, MOST = 2, 50
BLOCK_BYTES = 1 << 19
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B)]] = True


@dataclass
class Tokens:
    """Token i is ``words[i]`` of text ``text[i]``, the ``nth`` of its text, at code point ``position[i]``."""

    words: pa.Array
    text: np.ndarray
    nth: np.ndarray
    position: np.ndarray


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, bounds) of runs of texts; a run holds ``BLOCK_BYTES``, or one longer text. Null counts as empty."""
    column = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + BLOCK_BYTES, "right")) - 1)
        yield start, whole[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start]
        start = stop


def tokens(data: np.ndarray, at: np.ndarray) -> Tokens:
    """Runs of ASCII word characters; longer ones are cut every ``MOST``, and pieces below ``LEAST`` dropped."""
    inside = np.concatenate([[False], INSIDE[data], [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True  # no run crosses two texts
    begin = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    size = end - begin
    pieces = size // MOST + (size % MOST >= LEAST)
    run = np.repeat(np.arange(len(begin)), pieces)
    place = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = begin[run] + place * MOST
    length = np.minimum(MOST, end[run] - first)
    text = np.searchsorted(at, first, "right") - 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    bounds = np.concatenate([[0], np.cumsum(length)])
    gathered = data[np.repeat(first - bounds[:-1], length) + np.arange(bounds[-1])]
    words = pa.StringArray.from_buffers(len(length), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(gathered.tobytes()))
    nth = np.arange(len(text)) - np.searchsorted(text, text)
    return Tokens(words, text, nth, points[first] - points[at[text]])


def first_of_each(found: Tokens) -> np.ndarray:
    """Which tokens are the first of their word in their text, in order of texts."""
    if not len(found.text):
        return np.zeros(0, np.int64)
    code = found.words.dictionary_encode()
    keys = found.text * len(code.dictionary) + code.indices.to_numpy()
    return np.unique(keys, return_index=True)[1]
