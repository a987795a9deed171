"""Byte-level BPE: encode whole texts to token ids with byte offsets, and decode ids to bytes.

Token slices come from ``pretokenize``. Equal slices of a block are found by hash; a slice that is
a token is looked up, one that was met before comes from a bounded cache (each time the bytes are
compared, so equal hashes of different slices cost time and change no id), and the rest are merged
together: rows of part ids in a matrix, each step joining every row's pair of lowest rank.
``offsets`` holds the byte at which each token begins, so decoding can map any id back to its
place. A null text counts as empty; an empty text has no ids; bytes that are no UTF-8 are read as
U+FFFD before anything else.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import kernels as K
from siftwell.llm.pretokenize import token_starts

#: Slices kept by a worker, and the longest that are merged in a matrix.
CACHE = 150_000
SHORT_BYTES = 48
NO_RANK = np.int32(2**31 - 1)
WIDTHS = [0, 4, 6, 8, 10, 12, 16, 24, SHORT_BYTES]


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each token of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long slice: join the adjacent pair of lowest rank, the leftmost of equals, until none is left.

    A heap of pairs over a linked list of parts; a pair is stale once either part has changed.
    """
    n = len(piece)
    end = list(range(1, n + 1))  # part i is piece[i:end[i]]; 0 once it has been joined to its left
    before = list(range(-1, n - 1))

    def pair(i: int) -> tuple[int, int, int] | None:
        j = end[i]
        if j >= n:
            return None
        rank = ranks.get(piece[i : end[j]])
        return None if rank is None else (rank, i, end[j])

    heap = [p for i in range(n) if (p := pair(i))]
    heapq.heapify(heap)
    while heap:
        rank, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop or ranks.get(piece[i:stop]) != rank:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        for k in (before[i], i):
            if k >= 0 and (p := pair(k)):
                heapq.heappush(heap, p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class PairTable:
    """Rank of the token that two tokens join to: an open-addressing table of arrays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.mask = (1 << max(4, (3 * len(keys)).bit_length())) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, NO_RANK, np.int32)
        key, value = np.array(keys, np.int64), np.array(values, np.int32)
        at = self.place(key)
        while len(key):
            free = np.flatnonzero(self.keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = key[put], value[put]
            left = np.ones(len(key), bool)
            left[put] = False
            key, value, at = key[left], value[left], (at[left] + 1) & self.mask

    def place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(K.BASE)) >> np.uint64(32)).astype(np.int64) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = self.place(key)
        out = np.full(len(key), NO_RANK, np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            seen = self.keys[at]
            found = seen == key
            out[open_[found]] = self.values[at[found]]
            on = ~found & (seen != -1)
            open_, key, at = open_[on], key[on], (at[on] + 1) & self.mask
        return out


def gathered(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``flat[s : s + c]`` of each (start, count), end to end."""
    shift = np.repeat(start - (np.cumsum(count) - count), count)
    return flat[shift + np.arange(len(shift))]


class Encoder:
    """A worker's vocabulary and cache."""

    kept: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        self.ranks = read_ranks(path)
        size = max(self.ranks.values()) + 1
        self.lengths = np.zeros(size, np.int32)
        self.pieces: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.lengths[rank], self.pieces[rank] = len(token), token
        self.pairs: PairTable | None = None

    def prepare(self) -> None:
        """What only encoding needs."""
        self.pairs = PairTable(self.ranks)
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.whole = np.frombuffer(b"".join(self.pieces), np.uint8)
        end = np.cumsum(self.lengths, dtype=np.int64)
        hashes = K.byte_hashes(self.whole, end - self.lengths, end)
        order = np.argsort(hashes)
        self.token_hashes, self.token_ids, self.token_at = hashes[order], order.astype(np.int32), (end - self.lengths)[order]
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.start, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.byte_at, self.size, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def merge_all(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slices end to end, and how many each has."""
        size = end - begin
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for low, high in zip(WIDTHS, WIDTHS[1:]):  # noqa: B905
            rows = np.flatnonzero((size > low) & (size <= high))
            if len(rows):
                found += self.merge_rows(data, begin[rows], size[rows], rows)
        for row in np.flatnonzero(size > SHORT_BYTES).tolist():
            found.append((np.array([row]), np.array([merge_long(data[begin[row] : end[row]].tobytes(), self.ranks)], np.int32)))
        count = np.zeros(len(begin), np.int64)
        for rows, ids in found:
            count[rows] = (ids >= 0).sum(1)
        start, flat = np.cumsum(count) - count, np.zeros(int(count.sum()), np.int32)
        for rows, ids in found:
            real = ids >= 0
            flat[(start[rows][:, None] + np.arange(ids.shape[1]))[real]] = ids[real]
        return flat, count

    def merge_rows(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, id matrix padded with -1) in groups, as rows have no pair left to join."""
        column = np.arange(int(size.max()))
        ids = np.where(column < size[:, None], self.byte_id[data[np.minimum(begin[:, None] + column, len(data) - 1)]], -1)
        pair = np.full((len(ids), len(column) - 1), NO_RANK, np.int32)
        real = ids[:, 1:] >= 0
        pair[real] = self.pairs.rank(ids[:, :-1][real], ids[:, 1:][real])
        out = []
        while True:
            best = pair.argmin(1) if pair.shape[1] else np.zeros(len(pair), np.int64)
            value = pair[np.arange(len(pair)), best] if pair.shape[1] else np.full(len(pair), NO_RANK)
            live = value != NO_RANK
            if not live.all():
                out.append((rows[~live], ids[~live]))
                ids, pair, rows, best, value = ids[live], pair[live], rows[live], best[live], value[live]
            if not len(ids):
                return out
            each = np.arange(len(ids))
            ids[each, best] = value  # a token's id is its rank
            column = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, column + (column > best[:, None]), 1)
            column = column[:-1]
            pair = np.take_along_axis(pair, column + (column >= best[:, None]), 1)
            right = np.flatnonzero(best < pair.shape[1])
            follow = ids[right, best[right] + 1]
            pair[right, best[right]] = np.where(follow >= 0, self.pairs.rank(value[right], np.maximum(follow, 0)), NO_RANK)
            left = np.flatnonzero(best > 0)
            pair[left, best[left] - 1] = self.pairs.rank(ids[left, best[left] - 1], value[left])

    def encode(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all slices end to end, and how many each slice has."""
        if self.pairs is None:
            self.prepare()
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        hashes, first, which = np.unique(K.byte_hashes(data, begin, end), return_index=True, return_inverse=True)
        at, size = begin[first], (end - begin)[first]
        token, is_token = self.found(self.token_hashes, hashes, data, at, size, self.whole, self.token_at, self.lengths[self.token_ids])
        place, is_kept = self.found(self.hashes, hashes, data, at, size, self.bytes, self.byte_at, self.size)
        new = np.flatnonzero(~is_token & ~is_kept)
        flat, count_new = self.merge_all(data, at[new], at[new] + size[new])
        old = is_kept & ~is_token
        count, start = np.ones(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        pool = np.concatenate([self.token_ids, self.flat, flat])
        start[is_token] = token[is_token]
        start[old], count[old] = self.start[place[old]] + len(self.token_ids), self.count[place[old]]
        start[new], count[new] = np.cumsum(count_new) - count_new + len(self.token_ids) + len(self.flat), count_new
        start, count = start[which], count[which]
        # slices that share a hash with other bytes are encoded on their own
        odd = np.flatnonzero((end - begin != size[which]) | ~K.equal_spans(data, begin, data, at[which], np.minimum(end - begin, size[which])))
        for i in odd.tolist():
            piece = data[begin[i] : end[i]].tobytes()
            own = np.array([self.ranks[piece]] if piece in self.ranks else merge_long(piece, self.ranks), np.int32)
            start[i], count[i], pool = len(pool), len(own), np.append(pool, own)
        self.keep(hashes[new], flat, count_new, data, at[new], size[new])
        return gathered(pool, start, count), count

    @staticmethod
    def found(known: np.ndarray, hashes: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray, other: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash in ``known`` and whether the bytes there are the slice's own."""
        if not len(known):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        same = (known[place] == hashes) & (length[place] == size)
        hit = np.flatnonzero(same)
        same[hit] = K.equal_spans(data, at[hit], other, start[place[hit]], size[hit])
        return place, same

    def keep(self, hashes: np.ndarray, flat: np.ndarray, count: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        if len(self.hashes) + len(hashes) > CACHE:
            self.forget()
        both = np.concatenate([self.hashes, hashes])
        order = np.argsort(both, kind="stable")
        start = np.concatenate([self.start, np.cumsum(count) - count + len(self.flat)])
        self.hashes, self.start, self.count = both[order], start[order], np.concatenate([self.count, count])[order]
        byte_at = np.concatenate([self.byte_at, np.cumsum(size) - size + len(self.bytes)])
        self.byte_at, self.size = byte_at[order], np.concatenate([self.size, size])[order]
        self.flat = np.concatenate([self.flat, flat])
        self.bytes = np.concatenate([self.bytes, gathered(data, at, size)])


ENCODED = "id long, ids array<int>, offsets array<int>"


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """id, ids, offsets of batches of (id, text), a block of text at a time."""
    own = Encoder.of(path)
    for block in K.blocks(batches):
        # a UTF-8 byte that does not continue a character begins one
        first = np.flatnonzero((block.data & 0xC0) != 0x80)
        points = np.frombuffer(block.data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = first[token_starts(points, np.searchsorted(first, block.at))]
        ids, count = own.encode(block.data, begin, np.append(begin[1:], len(block.data))) if len(begin) else own.encode(block.data, begin, begin)
        ends = np.append(0, np.cumsum(count))[np.searchsorted(begin, block.at)]  # of each text's ids
        size = own.lengths[ids]
        offset = np.cumsum(size) - size - np.repeat(block.at[:-1], np.diff(ends))
        bounds = pa.array(ends.astype(np.int32))
        yield pa.RecordBatch.from_arrays([block.batch.column(0), pa.ListArray.from_arrays(bounds, pa.array(ids)), pa.ListArray.from_arrays(bounds, pa.array(offset.astype(np.int32)))], names=["id", "ids", "offsets"])


def decoded_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The batches with ``decoded``: the bytes that their ids stand for."""
    pieces = Encoder.of(path).pieces
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            column = part.column(part.schema.get_field_index("ids"))
            bounds = column.offsets.to_numpy().tolist()
            ids = column.values.slice(bounds[0], bounds[-1] - bounds[0]).to_numpy().tolist()
            out = [b"".join([pieces[k] for k in ids[a - bounds[0] : b - bounds[0]]]) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"])


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<int>, offsets array<int>: a row for each row of ``docs``."""
    return texts_of(docs, id_col, text_col).mapInArrow(lambda batches: encoded_batches(batches, path), ENCODED).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encoded`` (any columns beside ``ids``) with ``decoded`` binary."""
    return encoded.mapInArrow(lambda batches: decoded_batches(batches, path), ", ".join(f"`{c}` {kind}" for c, kind in encoded.dtypes) + ", decoded binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass: a task holds the ids of one block at a time."""
    both = texts_of(docs, id_col, text_col).mapInArrow(lambda batches: decoded_batches(encoded_batches(batches, path), path), ENCODED + ", decoded binary")
    return both.withColumnRenamed("id", id_col)


def digest(decoded: DataFrame) -> DataFrame:
    """The contract's columns."""
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
