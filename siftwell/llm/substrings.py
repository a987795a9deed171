"""Repeated passages across documents: shared seeds, collinear chains, alignment, exact windows.

Plan
1. Seeds are runs of ``SEED`` words: one in ``RATE`` by its hash alone, so that changed words nearby
   do not matter, and the least of each window of ``WINDOW`` runs, so that every run of
   ``SEED + WINDOW - 1`` shared words shares a seed.
2. A seed's anchor is its first occurrence (smallest doc_id, then position). Every occurrence in
   another document is matched to the anchor, so matches grow with the text, not with its square.
   A sketch of the ``SIDE`` words before and after a seed tells chance matches of a lone seed.
3. The matches of a pair of documents are chained in order: a chain gains words and pays for
   gaps, and a Fenwick tree over anchor positions gives the best predecessor.
4. Words around each chain are fetched in tiles of ``TILE`` words and aligned: along the
   diagonals of the seeds, with a best break point between two diagonals and a drop-off
   extension at the ends; a gap that costs more than the drop-off parts two passages; ends move out
   to ``min_words`` where the identity allows it. Passages of ``min_words`` words and ``identity`` or more are kept.
5. Exact repeats do not rest on anchors: where seeds repeat, every window of ``min_words`` words is
   matched by its hash to the first document that holds all of it (its nth occurrence to the nth
   there), and what step 4 has not covered is returned as well. From ``SEED + WINDOW - 1`` words
   on, every exact repeat of ``min_words`` words lies in a returned passage.

A seed that holds more than its share of a task (a very common line) does not meet in one task: the
seeds that a sample of documents shows to be that heavy, at most ``HEAVY`` for each task, get their
exact anchors from a pass of their own, and their occurrences are matched where they are read. The
sample decides where work is done, never what is found.

Words are runs of non-space characters, A-Z lower-cased; alignment compares 32-bit hashes of them.
The first document of a passage keeps it; repeats inside one document are left alone. Null doc_ids
are neither matched nor changed; null, empty and short texts have no passage. Rows that share a
doc_id but not a text are documents of their own, matched and cut by their own text: the one
of the least text hash stands where its doc_id says, the others after all documents. Equal rows are
one document. Extra columns are ignored by ``repeats`` and kept by ``remove_repeats``.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm import kernels as K
from siftwell.llm.common import flagged, keeping_columns, stored

SEED, WINDOW, RATE, TILE = 4, 12, 4, 64
#: Words sketched on each side of a seed, how many must agree on one side, and the span from which a chain needs no sketch.
SIDE, AGREE, SURE = 16, 10, 16
GAP_COST = 0.1
#: Documents sampled for heavy seeds (and for each task), and heavy seeds for each task.
SAMPLED, PER_TASK, HEAVY = 4000, 20, 4
#: Tiles whose windows are hashed at once (or those of one document).
GROUP = 1024
MATCH, MISMATCH, DROP = 1, 3, 12
#: Places of a diagonal that are compared at once.
AHEAD = 256


def minimisers(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Indices of the least hash in each window of one text's seeds (a shorter text: its least)."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    best = np.arange(n)
    for gap in range(1, WINDOW):  # best[i]: index of the least in i .. i + gap of the same text
        other = np.minimum(np.arange(n) + gap, n - 1)
        better = (text[other] == text) & (hashes[other] < hashes[best])
        best = np.where(better, other, best)
    begins = np.append(True, text[1:] != text[:-1])
    whole = np.zeros(n, bool)
    whole[: max(0, n - WINDOW + 1)] = text[: max(0, n - WINDOW + 1)] == text[WINDOW - 1 :]
    return np.unique(best[whole | begins])


def sketches(found: K.Words, begin: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Two bits of each of the ``SIDE`` words before and after each seed, nearest first; zeros beyond the text."""
    n, texts = len(found.hashes), len(found.at) - 1
    place = np.arange(n) + SIDE * (np.repeat(np.arange(texts), np.diff(found.at)) + 1)  # SIDE zeros part the texts
    codes = np.zeros(n + SIDE * (texts + 1), np.uint64)
    codes[place] = found.hashes >> np.uint64(62)
    ahead, behind, length = codes, codes, 1
    while length < SIDE:  # two runs of ``length`` words side by side
        shift = np.uint64(2 * length)
        ahead = ahead | (np.append(ahead[length:], np.zeros(length, np.uint64)) << shift)
        behind = behind | (np.append(np.zeros(length, np.uint64), behind[:-length]) << shift)
        length *= 2
    at = begin + SIDE * (text + 1)
    return behind[at - 1] | (ahead[at + SEED] << np.uint64(2 * SIDE))


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether at least ``AGREE`` words of one side agree in two sketches."""
    other = a ^ b
    same = ~(other | (other >> np.uint64(1))) & np.uint64(0x5555555555555555)
    half = np.uint64((1 << 2 * SIDE) - 1)
    return np.maximum(np.bitwise_count(same & half), np.bitwise_count(same >> np.uint64(2 * SIDE))) >= AGREE


def apart(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``docs`` with a long ``row id`` that tells texts apart; (doc_id, text) by row id, each once; (row id, doc_id) where the two differ.

    The row id is the doc_id, but for rows whose doc_id has other texts as well: all texts but one of
    such an id get numbers beyond all doc_ids. Only rows of repeated doc_ids are shuffled.
    """
    key = F.col("doc_id").cast("long")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marks = {"mark one": F.xxhash64("text"), "mark two": F.hash("text").cast("long")}
    known = docs.select(key.alias("id"), *(x.alias(c) for c, x in marks.items())).where("id is not null")
    differ = F.lit(False)
    for c in marks:
        differ = differ | (F.min(c) != F.max(c))
    repeated = stored(known.groupBy("id").agg(F.count(F.lit(1)).alias("n"), differ.alias("several")).where("n > 1").select("id", "several"), "repeats-ids")
    whole = [F.col("row id").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if repeated.isEmpty():
        rows = docs.withColumn("row id", key)
        return rows, rows.where("`row id` is not null").select(*whole), None
    rows = flagged(docs, "doc_id", repeated, "id", "maybe repeated")
    once, more = rows.where(~F.col("maybe repeated")).select(*columns, key.alias("row id")), rows.where(F.col("maybe repeated"))
    several = repeated.where("several").select("id")
    others = None
    if several.isEmpty():
        more = more.select(*columns, key.alias("row id"))
    else:
        low, high = docs.agg(F.min(key), F.max(key)).first()
        number = F.monotonically_increasing_id()
        if high < 1 << 61:
            number = number + F.lit(max(high, 0) + 1)
        elif low > -(1 << 61):
            number = F.lit(min(low, 0) - 1) - number
        else:
            raise ValueError("doc_ids leave no room for numbers beyond them")
        place = F.row_number().over(Window.partitionBy("id").orderBy(*marks))
        texts = known.join(several, "id", "left_semi").distinct().withColumn("place", place).where("place > 1")
        others = stored(texts.select(F.col("id").alias("other id"), *(F.col(c).alias(f"other {c}") for c in marks), number.alias("other row")), "repeats-others")
        same = key == F.col("other id")
        for c, x in marks.items():
            same = same & (x == F.col(f"other {c}"))
        more = more.join(others, same, "left").select(*columns, F.coalesce("other row", key).alias("row id"))
        others = others.select(F.col("other row").alias("row id"), F.col("other id").alias("doc_id"))
    each = more.groupBy("row id").agg(F.first("text").alias("text"))
    return once.union(more), once.where("`row id` is not null").select(*whole).union(each.select(*whole)), others


def chosen_seeds(block: K.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash, position and sketch of the chosen seeds of a block."""
    found = K.words(block, K.SPACE_WORDS)
    begin = np.arange(max(0, len(found.begin) - SEED + 1))
    text = np.searchsorted(found.at, begin, "right") - 1
    begin, text = (x[begin + SEED <= found.at[text + 1]] for x in (begin, text))
    hashes = K.run_hashes(found.hashes, begin, SEED)
    chosen = hashes < np.uint64((1 << 64) // RATE)
    chosen[minimisers(hashes, text)] = True
    at = np.flatnonzero(chosen)
    return text[at], hashes[at].view(np.int64), (begin[at] - found.at[text[at]]).astype(np.int32), sketches(found, begin[at], text[at]).view(np.int64)


@dataclass
class Anchors:
    """First occurrences of the heavy seeds, sorted by seed."""

    seed: np.ndarray
    doc: np.ndarray
    pos: np.ndarray
    sketch: np.ndarray

    def find(self, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each seed, and whether it is there."""
        if not len(self.seed):
            return np.zeros(len(seed), np.int64), np.zeros(len(seed), bool)
        at = np.minimum(np.searchsorted(self.seed, seed), len(self.seed) - 1)
        return at, self.seed[at] == seed


def heavy_anchors(texts: DataFrame, parts: int) -> Anchors:
    """Exact anchors of the seeds that hold more than a share of 1 / (``HEAVY`` * parts) of a sample's seeds."""
    n = texts.count()
    share = min(1.0, max(SAMPLED, PER_TASK * parts) / max(1, n))
    some = texts.where(F.pmod(F.xxhash64("doc_id", F.lit("heavy seeds")), F.lit(1 << 30)) < share * float(1 << 30))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in K.blocks(batches):
            seed, count = np.unique(chosen_seeds(block)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(count)], names=["seed", "n"])

    counts = stored(some.mapInArrow(listed, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")), "repeats-sample")
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = counts.where((F.col("n") > total / (HEAVY * parts)) & (F.col("n") > 16)).select("seed").toPandas()  # HEAVY * parts at most
    if heavy.empty:
        return Anchors(*(np.zeros(0, np.int64) for _ in range(4)))
    wanted = np.sort(heavy["seed"].to_numpy(np.int64))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in K.blocks(batches):
            text, seed, pos, sketch = chosen_seeds(block)
            mine = np.flatnonzero(np.isin(seed, wanted))
            doc = block.batch.column(0).to_numpy(zero_copy_only=False)[text[mine]]
            order = np.lexsort((pos[mine], doc, seed[mine]))
            first = order[np.append(True, seed[mine][order][1:] != seed[mine][order][:-1])] if len(order) else order
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seed[mine][first], doc[first], pos[mine][first], sketch[mine][first])], names=["seed", "doc", "pos", "sketch"])

    found = texts.mapInArrow(firsts, "seed long, doc long, pos int, sketch long").groupBy("seed").agg(F.min(F.struct("doc", "pos", "sketch")).alias("a")).select("seed", "a.*").toPandas().sort_values("seed")
    return Anchors(*(found[c].to_numpy(np.int64) for c in ("seed", "doc", "pos", "sketch")))


def seeds(texts: DataFrame, anchors: Broadcast) -> DataFrame:
    """doc_id, seed, pos, sketch, heavy (place among the anchors, -1 for none): the chosen seeds of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in K.blocks(batches):
            text, seed, pos, sketch = chosen_seeds(block)
            at, heavy = anchors.value.find(seed)
            yield pa.RecordBatch.from_arrays([block.batch.column(0).take(pa.array(text)), *map(pa.array, (seed, pos, sketch, np.where(heavy, at, -1).astype(np.int32)))], names=["doc_id", "seed", "pos", "sketch", "heavy"])

    return texts.mapInArrow(run, "doc_id long, seed long, pos int, sketch long, heavy int")


def anchored(found: DataFrame, anchors: Broadcast, parts: int) -> DataFrame:
    """doc_id, anchor_id, pos, anchor_pos, near: every occurrence of the seeds of two or more documents.

    Rows come sorted by seed, so a task holds a batch and one document's occurrences of one seed.
    Heavy seeds are dealt by document and take their anchor from the broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, 0  # rows of the last seed while it has one document, else its anchor (done)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            doc, seed, pos, sketch, heavy = rows
            begin = np.flatnonzero(np.append(True, seed[1:] != seed[:-1]))
            end = np.append(begin[1:], len(seed))
            several = (doc[begin] != doc[end - 1]) | (heavy[begin] >= 0)
            first, shown = np.repeat(begin, end - begin), np.repeat(several, end - begin)
            shown[:done] = False
            here = np.flatnonzero(shown)
            at, own = first[here], np.flatnonzero(heavy[here] >= 0)
            anchor, place, near = doc[at], pos[at], sketch[at]
            given = heavy[here][own]
            anchor[own], place[own], near[own] = anchors.value.doc[given], anchors.value.pos[given], anchors.value.sketch[given]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, (doc[here], anchor, pos[here], place, alike(sketch[here].view(np.uint64), near.view(np.uint64))))],
                names=["doc_id", "anchor_id", "pos", "anchor_pos", "near"],
            )
            last, done = begin[-1], int(several[-1])
            held = [x[last : last + 1] if done else x[last:] for x in rows]

    dealt = F.when(F.col("heavy") >= 0, F.xxhash64("doc_id")).otherwise(F.col("seed"))
    found = found.repartition(parts, dealt).sortWithinPartitions("seed", "doc_id", "pos")
    return found.mapInArrow(run, "doc_id long, anchor_id long, pos int, anchor_pos int, near boolean")


def chain(pos: list[int], anchor: list[int]) -> list[list[int]]:
    """Collinear chains of matches sorted by ``pos``: lists of indices, each match in at most one."""
    n = len(pos)
    score, parent = [0.0] * n, [-1] * n
    rising = all(map(operator.lt, pos, pos[1:])) and all(map(operator.lt, anchor, anchor[1:]))
    for j in range(n if rising else 0):  # a match adds words to the best chain before it, so that ends in the match before
        score[j] = SEED
        if j:
            step, astep = pos[j] - pos[j - 1], anchor[j] - anchor[j - 1]
            best = score[j - 1] + GAP_COST * (pos[j - 1] + anchor[j - 1])
            joined = best - GAP_COST * (pos[j] + anchor[j]) + min(SEED, step, astep) + GAP_COST * 2 * min(SEED, step)
            if joined > SEED:
                score[j], parent[j] = joined, j - 1
    ranks = {} if rising else {a: k + 1 for k, a in enumerate(sorted(set(anchor)))}
    size = len(ranks)
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)  # prefix maxima over anchor ranks
    i = n if rising else 0
    while i < n:
        j = i
        while j < n and pos[j] == pos[i]:
            best, at, k = float("-inf"), -1, ranks[anchor[j]] - 1
            while k > 0:
                if tree[k][0] > best:
                    best, at = tree[k]
                k &= k - 1
            here = GAP_COST * (pos[j] + anchor[j])
            score[j] = SEED
            if at >= 0:
                gain = min(SEED, pos[j] - pos[at], anchor[j] - anchor[at])
                joined = best - here + gain + GAP_COST * 2 * min(SEED, pos[j] - pos[at])
                if joined > SEED:
                    score[j], parent[j] = joined, at
            j += 1
        for m in range(i, j):  # matches of one position do not chain with each other
            value, k = score[m] + GAP_COST * (pos[m] + anchor[m]), ranks[anchor[m]]
            while k <= size:
                if value > tree[k][0]:
                    tree[k] = (value, m)
                k += k & -k
        i = j
    used = [False] * n
    out = []
    for end in sorted(range(n), key=lambda m: -score[m]):
        path, m = [], end
        while m >= 0 and not used[m]:
            used[m] = True
            path.append(m)
            m = parent[m]
        if path:
            out.append(path[::-1])
    return out


def chains(matches: DataFrame, min_words: int) -> DataFrame:
    """doc_id, anchor_id, pos array, anchor_pos array: chains that may reach ``min_words``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def groups() -> Iterator[pd.DataFrame]:
            kept: list[pd.DataFrame] = []
            for frame in frames:
                if not len(frame):
                    continue
                same = (frame["doc_id"] == frame["doc_id"].iloc[-1]) & (frame["anchor_id"] == frame["anchor_id"].iloc[-1])
                cut = int(np.flatnonzero(same.to_numpy())[0])
                if kept and (cut or (kept[0]["doc_id"].iloc[0], kept[0]["anchor_id"].iloc[0]) != (frame["doc_id"].iloc[0], frame["anchor_id"].iloc[0])):
                    yield pd.concat([*kept, frame.iloc[:cut]])
                    kept = []
                elif cut:
                    yield frame.iloc[:cut]
                kept.append(frame.iloc[cut:])
            if kept:
                yield pd.concat(kept)

        for frame in groups():
            doc, other, pos, apos, near = (frame[c].to_numpy() for c in ("doc_id", "anchor_id", "pos", "anchor_pos", "near"))
            near = near.astype(bool) | (min_words < 2 * SIDE + SEED)  # a short passage may fill neither side
            new = np.append(True, (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]))
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(doc))
            may = np.logical_or.reduceat(near, begin) | (pos[end - 1] - pos[begin] >= SURE)
            out: dict[str, list] = {"doc_id": [], "anchor_id": [], "pos": [], "anchor_pos": []}
            for s, e in zip(begin[may].tolist(), end[may].tolist(), strict=True):
                p, q, good = pos[s:e].tolist(), apos[s:e].tolist(), near[s:e]
                last: dict[int, int] = {}
                for path in sorted(chain(p, q)):
                    lone, at = len(path) == 1, q[path[0]]
                    again = lone and p[path[0]] - last.get(at, -TILE) <= SIDE  # a short line over and over: step 5
                    if lone:
                        last[at] = p[path[0]]
                    if not again and (good[path].any() or p[path[-1]] - p[path[0]] >= SURE):
                        out["doc_id"].append(doc[s])
                        out["anchor_id"].append(other[s])
                        out["pos"].append([p[m] for m in path])
                        out["anchor_pos"].append([q[m] for m in path])
            if out["doc_id"]:
                yield pd.DataFrame(out)

    return matches.mapInPandas(run, "doc_id long, anchor_id long, pos array<int>, anchor_pos array<int>")


def tiles(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, tile, words: 32-bit word hashes of the documents in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in K.blocks(batches):
            found = K.words(block, K.SPACE_WORDS)
            small = (found.hashes >> np.uint64(32)).astype(np.uint32)
            text, number, part = [], [], []
            for i, (a, b) in enumerate(zip(found.at[:-1], found.at[1:], strict=True)):
                for k, s in enumerate(range(a, b, TILE)):
                    text.append(i), number.append(k), part.append(small[s : min(s + TILE, b)].tobytes())
            yield pa.RecordBatch.from_arrays([block.batch.column(0).take(pa.array(text, pa.int64())), pa.array(number, pa.int32()), pa.array(part, pa.binary())], names=["doc_id", "tile", "words"])

    return flagged(texts, "doc_id", wanted, "doc_id", "wanted").where("wanted").drop("wanted").mapInArrow(run, "doc_id long, tile int, words binary")


def extend(equal: np.ndarray) -> int:
    """How many places to go on along ``equal`` before the score has dropped for good."""
    score = best = at = 0
    for k, same in enumerate(equal.tolist(), 1):
        score += MATCH if same else -MISMATCH
        if score > best:
            best, at = score, k
        elif best - score > DROP:
            break
    return at


class Diagonal:
    """Equal words of ``a`` and ``b`` along a diagonal, counted once for ``AHEAD`` places of it."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a, self.b = a, b
        self.way = self.low = 0
        self.count = [0]

    def equal(self, i: int, j: int, size: int) -> int:
        """Equal words of ``a[i:i + size]`` and ``b[j:j + size]``."""
        if size > AHEAD:
            return np.count_nonzero(self.a[i : i + size] == self.b[j : j + size])
        if i - j != self.way or i < self.low or i + size - self.low >= len(self.count):
            n = min(len(self.a) - i, len(self.b) - j, AHEAD)
            self.way, self.low, self.count = i - j, i, [0, *np.cumsum(self.a[i : i + n] == self.b[j : j + n]).tolist()]
        return self.count[i + size - self.low] - self.count[i - self.low]


def gap_equal(a: np.ndarray, b: np.ndarray, x: int, y: int, i: int, j: int) -> int:
    """Equal words between (x, y) and (i, j) of two diagonals, with one change of diagonal at its best place."""
    n = min(i - x, j - y)
    before = np.append(0, np.cumsum(a[x : x + n] == b[y : y + n]))
    after = np.append(np.cumsum((a[i - n : i] == b[j - n : j])[::-1])[::-1], 0)
    return int((before + after).max())


def align(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(begin, end, anchor begin, anchor end, equal words) of each passage that ``a`` and ``b`` share along seeds p, q.

    A gap between two seeds that costs more than the drop-off ends a passage and begins another.
    """
    out = []
    begin = abegin = x = y = equal = 0
    diagonal = Diagonal(a, b)

    def close() -> None:
        room = min(len(a) - x, len(b) - y)
        same = a[x : x + room] == b[y : y + room]
        on = extend(same)
        out.append((begin, x + on, abegin, y + on, equal + np.count_nonzero(same[:on])))

    opened = False
    for i, j in zip(p.tolist(), q.tolist(), strict=True):
        if opened and (i < x or j < y):
            continue
        if opened:
            inside = diagonal.equal(x, y, i - x) if i - j == x - y else gap_equal(a, b, x, y, i, j)
            if MATCH * inside - MISMATCH * (max(i - x, j - y) - inside) < -DROP:
                close()
                opened = False
            else:
                equal += inside
        if not opened:
            left = min(i, j)
            same = (a[i - left : i] == b[j - left : j])[::-1]
            back = extend(same)
            begin, abegin, opened = i - back, j - back, True
            equal = np.count_nonzero(same[:back])
        stop = min(SEED, len(a) - i, len(b) - j)
        equal += diagonal.equal(i, j, stop)
        x, y = i + stop, j + stop
    if opened:
        close()
    return out


def widened(a: np.ndarray, b: np.ndarray, span: tuple[int, int, int, int, int], min_words: int, identity: float) -> tuple[int, int, int, int, int]:
    """A passage that its best score ends too early for ``min_words``, with its ends moved out if it keeps the identity so."""
    begin, end, abegin, aend, equal = span
    need = min_words - (end - begin)
    if need <= 0:
        return span
    left, right = min(begin, abegin, need + SEED), min(len(a) - end, len(b) - aend, need + SEED)
    ahead, behind = (a[begin - left : begin] == b[abegin - left : abegin])[::-1], a[end : end + right] == b[aend : aend + right]
    most = equal + np.count_nonzero(ahead) + np.count_nonzero(behind) - identity * need
    if left + right < need or most < identity * max(end - begin, aend - abegin) - 1e-6:  # no ends give the identity
        return span
    before, after = np.append(0, np.cumsum(ahead)), np.append(0, np.cumsum(behind))
    words = np.add.outer(np.arange(left + 1), np.arange(right + 1))
    spare = np.add.outer(before, after) - identity * words
    spare[(words < need) | ~np.logical_and.outer(np.append(True, ahead), np.append(True, behind))] = -np.inf  # a passage ends on shared words
    i, j = np.unravel_index(int(np.argmax(spare)), spare.shape)
    if equal + spare[i, j] < identity * max(end - begin, aend - abegin) - 1e-9:
        return span
    return begin - int(i), end + int(j), abegin - int(i), aend + int(j), equal + int(before[i] + after[j])


def aligned(parts: DataFrame, min_words: int, identity: float) -> DataFrame:
    """Align each chain; ``parts`` holds the chain and then its tiles in order of (chain, side, tile)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []
        out: list[tuple] = []

        def close() -> None:
            if not rows:
                return
            head = rows[0]
            sides = {}
            for r in rows[1:]:  # a repeated row gives a tile twice
                sides.setdefault(r.side, {}).setdefault(r.tile, r.words)
            if head.side >= 0 or len(sides) < 2:
                return
            a, b = (np.frombuffer(b"".join(w for _, w in sorted(sides[s].items())), np.uint32) for s in (0, 1))
            a0, b0 = (min(sides[s]) * TILE for s in (0, 1))
            p, q = np.array(head.pos) - a0, np.array(head.anchor_pos) - b0
            ok = (p + SEED <= len(a)) & (q + SEED <= len(b))
            if not ok.any():
                return
            for span in align(a, b, p[ok], q[ok]):
                begin, end, abegin, aend, equal = widened(a, b, span, min_words, identity)
                if end - begin < min_words or equal < identity * max(end - begin, aend - abegin) - 1e-9:
                    continue
                out.append((int(head.doc_id), int(head.anchor_id), begin + a0, end + a0, abegin + b0, aend + b0, equal))

        names = ["doc_id", "anchor_id", "word", "end_word", "anchor_word", "anchor_end_word", "equal_words"]
        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.chain != key:
                    close()
                    key, rows = r.chain, []
                rows.append(r)
            if out:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        close()
        if out:
            yield pd.DataFrame(out, columns=names)
        K.hand_back()

    return parts.mapInPandas(run, "doc_id long, anchor_id long, word long, end_word long, anchor_word long, anchor_end_word long, equal_words long")


def candidates(known: DataFrame, parts: int, min_words: int) -> DataFrame:
    """doc_id, low array, high array, own array: word ranges where all shared windows of ``min_words`` words lie.

    A shared window holds a repeated seed in every ``WINDOW`` runs. ``own`` are the positions of
    seeds that no earlier document has, so no window around them is a repeat. Rows are dealt out once, by
    document; a task holds a batch and one document's rows.
    """
    least = max(0, min_words - SEED - 2 * (WINDOW - 1))

    def ranges(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
        """The ranges of whole documents."""
        doc, pos, own = (np.concatenate(x) for x in zip(*rows, strict=True))
        spot = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])))  # a repeated row gives a place twice
        doc, pos, own = doc[spot], pos[spot], np.logical_or.reduceat(own, spot)
        begin = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (pos[1:] - pos[:-1] > WINDOW)))
        end = np.append(begin[1:], len(doc))
        long = pos[end - 1] - pos[begin] >= least
        own &= np.repeat(long, end - begin)
        first, last = pos[begin[long]], pos[end[long] - 1]
        of_run, of_own = doc[begin[long]], doc[own]
        docs = np.unique(of_run)

        def listed(values: np.ndarray, of: np.ndarray) -> pa.ListArray:
            bounds = np.append(np.searchsorted(of, docs), len(of))
            return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))

        lists = listed(np.maximum(0, first - (WINDOW - 1)), of_run), listed(last + SEED + WINDOW - 1, of_run), listed(pos[own], of_own)
        return pa.RecordBatch.from_arrays([pa.array(docs), *lists], names=["doc_id", "low", "high", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # rows of the last document, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if held and (cut or held[0][0][0] != rows[0][0]):
                yield ranges([*held, [x[:cut] for x in rows]])
                held = []
            elif cut:
                yield ranges([[x[:cut] for x in rows]])
            held.append([x[cut:] for x in rows])
        if held:
            yield ranges(held)

    spots = known.select("doc_id", "pos", (F.col("anchor_id") == F.col("doc_id")).alias("is_own"))
    spots = spots.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "pos")
    return spots.mapInArrow(run, "doc_id long, low array<int>, high array<int>, own array<int>")


def windows(parts: DataFrame, min_words: int) -> DataFrame:
    """doc_id, pos, hash, nth, open: the windows of each document's ranges; ``parts`` holds them and then tiles in order of (of, tile).

    ``nth`` counts equal windows of a document; a window is open if it may repeat an earlier
    document and lies in none of the ``spans`` found so far.
    """

    def of_documents(held: list[list]) -> pd.DataFrame | None:
        pieces, places, docs, opens = [], [], [], []
        for number, rows in enumerate(held):
            words: dict[int, bytes] = {}
            for r in rows[1:]:  # a repeated row gives a tile twice
                words.setdefault(r.tile, r.words)
            head, seen = rows[0], 0  # windows before ``seen`` are done, as ranges may overlap
            if head.tile >= 0:
                continue
            for low, high in zip(head.low, head.high, strict=True):
                tile, run, low = max(low, seen) // TILE, [], max(low, seen)
                while tile in words and tile * TILE < high:
                    run.append(words[tile])
                    tile += 1
                values = np.frombuffer(b"".join(run), np.uint32)[low % TILE :][: max(0, high - low)]
                if len(values) >= min_words:
                    pieces.append(values)
                    places.append(np.arange(low, low + len(values) - min_words + 1))
                    docs.append(np.full(len(places[-1]), number))
                    seen = low + len(places[-1])
                    free = np.ones(len(places[-1]), bool)
                    own = np.asarray(head.own, np.int64)
                    if len(own):
                        free = np.searchsorted(own, places[-1]) == np.searchsorted(own, places[-1] + min_words - SEED, "right")
                    for span in [] if head.spans is None else head.spans:
                        free[np.searchsorted(places[-1], span["word"]) : np.searchsorted(places[-1], span["end_word"] - min_words, "right")] = False
                    opens.append(free)
        if not pieces:
            return None
        size = np.array([len(x) for x in pieces])
        begin = np.cumsum(size) - size
        whole = np.concatenate([begin[k] + np.arange(len(p)) for k, p in enumerate(places)])
        hashes = K.window_hashes(np.concatenate(pieces), min_words)[whole]
        doc, at = np.concatenate(docs), np.concatenate(places)
        order = np.lexsort((at, hashes, doc))
        new = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1]))
        nth = np.empty(len(at), np.int32)
        nth[order] = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        names = np.array([rows[0].of for rows in held], np.int64)
        return pd.DataFrame({"doc_id": names[doc], "pos": at.astype(np.int32), "hash": hashes.view(np.int64), "nth": nth, "open": np.concatenate(opens)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list] = []  # rows of whole documents, of at least GROUP tiles at a time
        tiles = 0
        for frame in frames:
            for r in frame.itertuples(index=False):
                if not held or held[-1][0].of != r.of:
                    if tiles >= GROUP:
                        if (out := of_documents(held)) is not None:
                            yield out
                        held, tiles = [], 0
                    held.append([])
                held[-1].append(r)
                tiles += 1
        if held and (out := of_documents(held)) is not None:
            yield out
        K.hand_back()

    return parts.mapInPandas(run, "doc_id long, pos int, hash long, nth int, open boolean")


def exact(ranges: DataFrame, similar: DataFrame, words: DataFrame, parts: int, min_words: int) -> DataFrame:
    """The exact repeats of ``min_words`` words that ``similar`` leaves open, in its columns."""
    tile = F.explode(F.sequence(F.floor(F.col("low") / TILE).cast("int"), F.floor(F.col("high") / TILE).cast("int")))
    needed = ranges.select(F.col("doc_id").alias("of"), F.explode(F.arrays_zip("low", "high")).alias("r")).select("of", "r.low", "r.high").select("of", tile.alias("tile")).distinct()
    spans = similar.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("word", "end_word")).alias("spans"))
    held = ranges.withColumnRenamed("doc_id", "of").join(spans, "of", "left")
    pieces = headed(held.withColumn("tile", F.lit(-1)), needed.join(words, ["of", "tile"])).repartition(parts, "of").sortWithinPartitions("of", "tile")
    found = stored(windows(pieces, min_words), "repeats-windows")
    # a document's open windows of one hash are one row, however often a line repeats in it
    left = stored(found.where("open").groupBy("doc_id", "hash").agg(F.collect_list(F.struct("pos", "nth")).alias("places")), "repeats-open")
    # only windows that may equal an open one are grouped; the first of each (hash, nth) is made before the join
    first = flagged(found, "hash", left, "hash", "asked").where("asked").groupBy("hash", "nth").agg(F.min(F.struct("doc_id", "pos")).alias("a"))
    firsts = first.groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("nth", "a"))).alias("firsts"))  # every nth from 0 on

    def link(place: Column) -> Column:
        own, least = F.get("firsts", place["nth"])["a"], F.get("firsts", F.lit(0))["a"]
        a = F.when(own["doc_id"] != F.col("doc_id"), own).otherwise(least)
        word = place["pos"].cast("long")
        return F.struct(a["doc_id"].alias("anchor_id"), (a["pos"] - word).alias("diagonal"), word.alias("word"))

    links = left.join(firsts, "hash").select("doc_id", F.filter(F.transform("places", link), lambda x: x["anchor_id"] != F.col("doc_id")).alias("links"))
    # a document's links are one row, in order, so that only runs of windows that follow each other become rows
    links = links.groupBy("doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("links")))).alias("links"))

    def follows(one: Column, two: Column) -> Column:
        return (one["anchor_id"] == two["anchor_id"]) & (one["diagonal"] == two["diagonal"]) & (one["word"] + 1 == two["word"])

    first_of_run = F.filter("links", lambda x, i: (i == 0) | ~follows(F.get("links", i - 1), x))
    last_of_run = F.filter("links", lambda x, i: (i == F.size("links") - 1) | ~follows(x, F.get("links", i + 1)))
    run = F.zip_with(first_of_run, last_of_run, lambda x, y: F.struct(x["anchor_id"].alias("anchor_id"), x["diagonal"].alias("diagonal"), x["word"].alias("word"), y["word"].alias("last")))
    runs = links.select("doc_id", F.explode(run).alias("r")).select("doc_id", "r.*")
    end = F.col("last") + min_words
    return runs.select("doc_id", "anchor_id", "word", end.alias("end_word"), (F.col("word") + F.col("diagonal")).alias("anchor_word"), (end + F.col("diagonal")).alias("anchor_end_word"), (end - F.col("word")).alias("equal_words"))


def headed(heads: DataFrame, tiles: DataFrame) -> DataFrame:
    """One table of heads and of tiles that follow them: what a head holds is not repeated on its tiles."""
    return heads.unionByName(tiles, allowMissingColumns=True)


def found_in(texts: DataFrame, min_words: int, identity: float) -> DataFrame:
    """``repeats`` of (doc_id, text) whose ids tell texts apart."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    anchors = texts.sparkSession.sparkContext.broadcast(heavy_anchors(texts, parts))  # HEAVY * parts rows at most
    known = stored(anchored(seeds(texts, anchors), anchors, parts), "repeats-seeds")
    matches = known.where("doc_id != anchor_id")
    matches = matches.repartition(parts, "doc_id", "anchor_id").sortWithinPartitions("doc_id", "anchor_id", "pos", "anchor_pos")
    found_chains = chains(matches, min_words).withColumn("chain", F.concat_ws(":", "doc_id", "anchor_id", F.element_at("pos", 1), F.element_at("anchor_pos", 1)))
    found_chains = stored(found_chains, "repeats-chains")

    def span(column: str):
        return F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.element_at(column, 1) - min_words) / TILE)).cast("int"), F.floor((F.element_at(column, -1) + min_words + SEED) / TILE).cast("int")))

    here = found_chains.select("chain", F.lit(0).alias("side"), F.col("doc_id").alias("of"), span("pos").alias("tile"))
    there = found_chains.select("chain", F.lit(1).alias("side"), F.col("anchor_id").alias("of"), span("anchor_pos").alias("tile"))
    needed = here.union(there)
    ranges = stored(candidates(known, parts, min_words), "repeats-ranges")
    wanted = found_chains.select("doc_id").union(found_chains.select(F.col("anchor_id").alias("doc_id"))).union(ranges.select("doc_id")).distinct()
    words = tiles(texts, stored(wanted, "repeats-wanted")).select(F.col("doc_id").alias("of"), "tile", "words")
    heads = found_chains.select("chain", F.lit(-1).alias("side"), F.lit(-1).alias("tile"), "doc_id", "anchor_id", "pos", "anchor_pos")
    none = F.lit(0).cast("long")  # no nulls, so that ids stay whole numbers in pandas
    pieces = headed(heads, needed.join(words, ["of", "tile"]).select("chain", "side", "tile", "words", none.alias("doc_id"), none.alias("anchor_id")))
    joined = pieces.repartition(parts, "chain").sortWithinPartitions("chain", "side", "tile")
    similar = stored(aligned(joined, min_words, identity).distinct(), "repeats-aligned")
    return similar.union(exact(ranges, similar, words, parts, min_words))


def repeats(docs: DataFrame, min_words: int = 50, identity: float = 0.8) -> DataFrame:
    """doc_id, anchor_id, word, end_word, anchor_word, anchor_end_word, equal_words: repeated passages."""
    _, texts, others = apart(docs.select("doc_id", "text"))
    found = found_in(texts, min_words, identity)
    columns = found.columns
    for column in ("doc_id", "anchor_id") if others is not None else ():
        own = others.select(F.col("row id").alias("other row"), F.col("doc_id").alias("other id"))
        found = found.join(own, F.col(column) == F.col("other row"), "left").withColumn(column, F.coalesce("other id", column)).select(*columns)
    return found


@keeping_columns
def remove_repeats(docs: DataFrame, min_words: int = 50, identity: float = 0.8) -> DataFrame:
    """All documents with their columns; repeated passages are cut out of all but their first document.

    Documents without a repeat keep their text byte for byte and are not shuffled.
    """
    own, texts, _ = apart(docs)
    spans = found_in(texts, min_words, identity).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("word", "end_word"))).alias("hit spans"))
    spans = stored(spans.withColumnRenamed("doc_id", "hit id"), "repeats-spans")
    rows = flagged(own, "row id", spans, "hit id", "maybe hit")
    touched = rows.where(F.col("maybe hit")).join(spans, F.col("row id") == F.col("hit id"), "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans, strict=True):
            if own is None or text is None:
                out.append(text)
                continue
            block = next(K.blocks(iter([pa.RecordBatch.from_pydict({"text": [text]})])))
            found, data, kept, at = K.words(block, K.SPACE_WORDS), block.data.tobytes(), [], 0
            for s in own:
                word, end = s["word"], min(s["end_word"], len(found.begin))
                if word >= end or found.end[end - 1] <= at:
                    continue
                kept.append(data[at : max(at, found.begin[word])])
                at = int(found.end[end - 1])
            out.append(b"".join([*kept, data[at:]]).decode("utf-8", "replace"))
        return pd.Series(out)

    text = F.when(F.col("hit spans").isNull(), F.col("text")).otherwise(cut(F.make_valid_utf8("text"), F.col("hit spans")))
    changed = touched.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))
    return rows.where(~F.col("maybe hit")).select(*(F.col(f"`{c}`") for c in docs.columns)).union(changed)
