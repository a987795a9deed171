"""Array kernels over blocks of texts, run inside Arrow map tasks.

A block is a bounded run of rows whose texts lie end to end in one byte array;
a block holds ``BLOCK_BYTES`` of text, or one longer document.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
#: Of the C library, where it has it.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15
#: Words of more bytes are hashed by a cryptographic digest.
LONG_WORD = 64
LANE_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: One odd factor for each place of a run of words.
PLACES = np.random.default_rng(20240301).integers(0, 1 << 63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)

SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False

ITEM_WORDS = np.zeros(256, bool)
ITEM_WORDS[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Block:
    """``data``: all bytes; text i is ``data[at[i]:at[i + 1]]`` and row ``rows`` of the batch."""

    batch: pa.RecordBatch
    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut record batches into blocks; a null text counts as empty. At the end the worker hands back what it no longer uses."""
    batch = column = whole = ends = None
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).fill_null(b"")
        if not len(column):
            continue
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        start = 0
        while start < len(column):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
            yield Block(batch.slice(start, stop - start), whole[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start])
            start = stop
    del batch, column, whole, ends
    hand_back()


def hand_back() -> None:
    """Give freed memory back to the machine: a worker lives on for tasks of other operators, and several share an executor."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, as one number; zeros follow the data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded.data, 0, (1,))


def byte_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[begin:end]``: eight bytes a step, scrambled after each."""
    size = end - begin
    out = mix(size.astype(np.uint64) * np.uint64(BASE) + np.uint64(1))
    view = lanes(data)
    live = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at = begin[live]
    left = size[live]
    while len(live):
        lane = view[at] & LANE_MASKS[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ lane) * np.uint64(BASE))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def equal_spans(data: np.ndarray, begin: np.ndarray, other: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``data[begin:begin + size]`` and ``other[start:start + size]`` hold the same bytes."""
    out = np.ones(len(size), bool)
    one, two = lanes(data), lanes(other)
    live = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    a, b, left = begin[live], start[live], size[live]
    while len(live):
        same = ((one[a] ^ two[b]) & LANE_MASKS[np.minimum(left, 8)]) == 0
        out[live[~same]] = False
        on = same & (left > 8)
        live, a, b, left = live[on], a[on] + 8, b[on] + 8, left[on] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = np.array_equal(data[begin[i] : begin[i] + size[i]], other[start[i] : start[i] + size[i]])
    return out


def run_hashes(values: np.ndarray, begin: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run ``values[begin:begin + size]``: a sum with a random odd factor for each place."""
    values = values if values.dtype == np.uint64 else mix(values.astype(np.uint64) + np.uint64(1))
    out = np.full(len(begin), BASE, np.uint64) + np.asarray(size).astype(np.uint64)
    for k in range(int(np.max(size, initial=0))):
        part = values[np.minimum(begin + k, len(values) - 1)] * PLACES[k % len(PLACES)]
        out += part if np.ndim(size) == 0 else np.where(k < size, part, np.uint64(0))
        if k % len(PLACES) == len(PLACES) - 1:
            out = mix(out)
    return mix(out)


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` values from each place on, joined from runs of 1, 2, 4 .. values."""
    whole, length, at = mix(values.astype(np.uint64) + np.uint64(1)), 1, 0  # whole[i]: the ``length`` values from i on
    out = np.full(max(0, len(values) - size + 1), BASE, np.uint64)
    for k in range(size.bit_length()):
        if size >> k & 1:
            out = out * PLACES[2 * k] + whole[at : at + len(out)]
            at += length
        whole = whole[:-length] * PLACES[2 * k + 1] + whole[length:]
        if k % 4 == 3:
            whole, out = mix(whole), mix(out)
        length *= 2
    return mix(out)


@dataclass
class Words:
    """Words of a block: byte spans, a hash each, and ``at``: text i has words ``at[i]:at[i + 1]``."""

    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    at: np.ndarray


def words(block: Block, inside: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of bytes of the class ``inside``; no word crosses two texts."""
    data = LOWER[block.data] if lower else block.data
    is_in = inside[data]
    first, last = is_in.copy(), is_in.copy()
    if len(data):
        edges = block.at[1:-1][(block.at[1:-1] > 0) & (block.at[1:-1] < len(data))]
        follows = np.zeros(len(data), bool)
        follows[1:] = is_in[:-1]
        follows[edges] = False
        first &= ~follows
        ahead = np.zeros(len(data), bool)
        ahead[:-1] = is_in[1:]
        ahead[edges - 1] = False
        last &= ~ahead
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(begin, end, byte_hashes(data, begin, end), np.searchsorted(begin, block.at))


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words inside a text (fewer words: the whole as one), and the text's number."""
    count = np.diff(found.at)
    runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), runs)
    begin = found.at[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
    return run_hashes(found.hashes, begin, np.minimum(size, count[text])), text


def distinct_by_text(values: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and where each text's run begins (n + 1 bounds)."""
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[new], text[new]
    return values, np.searchsorted(text, np.arange(n + 1))
