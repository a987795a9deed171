"""Near-duplicate documents: banded MinHash candidates with sequential Bayesian verification.

Plan
1. One scan gives each row the size of its shingle set, a MinHash signature and a 128-bit digest of
   its normalised words. Rows of one digest are one *node*, so exact copies cost nothing more.
2. Signature bands deal the nodes into buckets; only buckets of two or more go on. First every
   node is compared with the *leader* (least node) of each of its buckets: at most ``BANDS`` pairs a
   node, which join most of a group of near copies whatever its size.
3. Buckets whose nodes are then all of one component are done. The others are cut into chunks of
   about ``CHUNK`` nodes (and ``CHUNK_BYTES`` of words), chunks of one component apart from those of others,
   and each pair of chunks that may hold an open pair is a *unit* of bounded size.
4. In a unit, signatures are compared batch by batch. After each batch a pair goes if the
   posterior probability that its similarity reaches the threshold (uniform prior) is below
   ``miss``. Nodes with a surviving pair fetch their words, and survivors of different components are
   verified on full sets of shingles, word by word, not by hash. A unit returns a forest of its
   confirmed links: neither pairs nor links of a group are ever written in full.
5. Connected components over the links by repeated joins.

Defined results: a null or empty text, or one without words, has the empty set and links with
nothing (its component is its own doc_id). Fewer words than the shingle size make one shingle
of the whole sequence. Repeated rows share a node. A null doc_id takes part, but never becomes a component id
unless all of the component lacks one; such rows are not kept. Extra columns are ignored.
The chance that banding misses a link of similarity 0.8 is (1 - 0.8^4)^24 = 3e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import kernels as K
from siftwell.llm.common import flagged, keeping_columns, stored, without_ids
from siftwell.llm.components import connected_components

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
BATCH = 32
CHUNK, CHUNK_BYTES = 512, 1 << 24
#: Bytes of words whose shingles a task numbers at once (or one unit).
GROUP_BYTES = 1 << 22

_seeds = np.random.default_rng(20240229)
MULTIPLY = _seeds.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _seeds.integers(0, 1 << 63, HASHES, np.uint64)


def text_sets(block: K.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    found = K.words(block, K.SPACE_WORDS)
    return K.distinct_by_text(*K.shingles(found, size), len(block))


def normalised(block: K.Block) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text, A-Z lower-cased, joined by one space: all bytes, and bounds of the texts."""
    found = K.words(block, K.SPACE_WORDS)
    data = K.LOWER[block.data]
    keep = K.SPACE_WORDS[data]
    later = np.ones(len(found.begin), bool)
    later[found.at[:-1][np.diff(found.at) > 0]] = False
    keep[found.begin[later] - 1] = True
    return np.where(K.SPACE_WORDS[data], data, np.uint8(0x20))[keep], np.append(0, np.cumsum(keep))[block.at]


def digests(data: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    return [hashlib.blake2b(data[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of HASHES 32-bit minima for each non-empty set."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((len(starts), HASHES), np.uint32)
    if len(starts):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(((values * MULTIPLY[k] + ADD[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, node (null: empty set), bytes of its words, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in K.blocks(batches):
            values, at = text_sets(block, size)
            data, bounds = normalised(block)
            counts = np.diff(at)
            rows = iter(signatures(values, at))
            yield pa.RecordBatch.from_arrays(
                [
                    block.batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(digests(data, bounds), pa.binary()),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array([next(rows).tobytes() if c else None for c in counts], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "node", "bytes", "signature"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, node binary, bytes long, signature binary")


def at_least(matches: int, seen: int, threshold: float) -> float:
    """P(similarity >= threshold) after ``matches`` equal hashes of ``seen``, prior uniform."""
    n = seen + 1
    return sum(comb(n, i) * threshold**i * (1 - threshold) ** (n - i) for i in range(matches + 1))


@lru_cache
def fewest(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(hashes seen, fewest matches with which a pair stays), one for each batch."""
    return [(n, next(m for m in range(n + 1) if at_least(m, n, threshold) >= miss)) for n in range(BATCH, HASHES + 1, BATCH)]


def survivors(a: np.ndarray, b: np.ndarray, band: int, threshold: float, miss: float) -> np.ndarray:
    """Which pairs of signature rows go on to exact verification in this band."""
    stay = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    same_before = np.zeros(len(a), bool)
    before = 0
    for seen, least in fewest(threshold, miss):
        same = a[stay, before:seen] == b[stay, before:seen]
        matches = matches + same.sum(1)
        shared = same.reshape(len(stay), (seen - before) // ROWS, ROWS).all(2)
        in_band = np.arange(before // ROWS, seen // ROWS) < band
        same_before = same_before | shared[:, in_band].any(1)
        keep = (matches >= least) & ~same_before
        stay, matches, same_before, before = stay[keep], matches[keep], same_before[keep], seen
    return stay


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return new, np.append(new[1:], len(keys))


def whole_units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that no unit is cut in two."""
    kept: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        cut = int(np.flatnonzero((frame["unit"] == frame["unit"].iloc[-1]).to_numpy())[0])
        if cut or (kept and kept[0]["unit"].iloc[0] != frame["unit"].iloc[0]):
            if parts := kept + ([frame.iloc[:cut]] if cut else []):
                yield pd.concat(parts, ignore_index=True)
            kept = []
        kept.append(frame.iloc[cut:])
    if kept:
        yield pd.concat(kept, ignore_index=True)


def local_pairs(side: np.ndarray, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one unit whose components differ, a few rows of the triangle or rectangle at a time.

    Side 0: the unit pairs a chunk with itself; sides 1 and 2: two chunks.
    """
    alone = side[0] == 0
    left, right = (np.arange(len(side)),) * 2 if alone else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    step = max(1, 32768 // max(1, len(right)))
    for i in range(0, len(left), step):
        x, y = (z.ravel() for z in np.meshgrid(left[i : i + step], right, indexing="ij"))
        open_ = comp[x] != comp[y]
        if alone:
            open_ &= x < y
        yield x[open_], y[open_]


def promising(units: DataFrame, threshold: float, miss: float) -> DataFrame:
    """unit, nid: the nodes of each unit that have a surviving pair in it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_units(frames):
            sig = np.frombuffer(b"".join(frame["signature"]), np.uint32).reshape(-1, HASHES)
            side, bands, comp = (frame[c].to_numpy() for c in ("side", "band", "comp"))
            stays = np.zeros(len(frame), bool)
            waiting: dict[int, list] = {}  # pairs of small units, by band, compared many at a time

            def compare(x: np.ndarray, y: np.ndarray, band: int, sig: np.ndarray = sig, stays: np.ndarray = stays) -> None:
                stay = survivors(sig[x], sig[y], band, threshold, miss)
                stays[x[stay]] = stays[y[stay]] = True

            for s, e in zip(*runs(frame["unit"].to_numpy()), strict=True):
                for x, y in local_pairs(side[s:e], comp[s:e]):
                    if e - s > 48:
                        compare(x + s, y + s, int(bands[s]))
                    else:
                        waiting.setdefault(int(bands[s]), []).append((x + s, y + s))
            for band, found in waiting.items():
                x, y = (np.concatenate(z) for z in zip(*found, strict=True))
                for k in range(0, len(x), 32768):
                    compare(x[k : k + 32768], y[k : k + 32768], band)
            yield frame.loc[stays, ["unit", "nid"]]
        K.hand_back()

    return units.mapInPandas(run, "unit string, nid long")


def exact_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the shingles of each text and bounds of the texts; numbers are equal for equal words only."""
    at = np.append(0, np.cumsum([len(t) for t in texts]))
    data = np.frombuffer(b"".join(texts), np.uint8)
    found = K.words(K.Block(None, data, at), K.SPACE_WORDS, lower=False)
    hashes, first, word = np.unique(found.hashes, return_index=True, return_inverse=True)
    length = found.end - found.begin
    same = length == length[first][word]
    same[same] = K.equal_spans(data, found.begin[same], data, found.begin[first][word[same]], length[same])
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():  # other words of a known hash
        word[i] = others.setdefault(data[found.begin[i] : found.end[i]].tobytes(), len(hashes) + len(others))
    count = np.diff(found.at)
    own = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(texts)), own)
    begin = found.at[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(own) - own, own)
    number = word[begin].astype(np.int64) if len(begin) else begin
    for k in range(1, size):
        follows = np.where(k < count[text], word[np.minimum(begin + k, max(0, len(word) - 1))] + 1, 0) if len(begin) else begin
        number = np.unique(number << 32 | follows, return_inverse=True)[1]
    return K.distinct_by_text(number.astype(np.uint64), text, len(texts))


def confirmed(units: DataFrame, size: int, percent: int, miss: float) -> DataFrame:
    """one, two: links of each unit verified on full sets; nodes that are joined already are not compared."""

    def links_of(part: pd.DataFrame) -> Iterator[tuple[int, int]]:
        values, at = exact_sets(part["words"].tolist(), size)
        nid, comp, side, band = (part[c].to_numpy() for c in ("nid", "comp", "side", "band"))
        for s, e in zip(*runs(part["unit"].to_numpy()), strict=True):
            sig = np.frombuffer(b"".join(part["signature"].iloc[s:e]), np.uint32).reshape(-1, HASHES) if e - s > 3 else None
            parent: dict[int, int] = {}

            def root(c: int, parent: dict[int, int] = parent) -> int:
                while (up := parent.get(c, c)) != c:
                    parent[c] = c = parent.get(up, up)
                return c

            for x, y in local_pairs(side[s:e], comp[s:e]):
                if sig is not None:
                    stay = survivors(sig[x], sig[y], int(band[s]), percent / 100, miss)
                    x, y = x[stay], y[stay]
                for p, q in zip((x + s).tolist(), (y + s).tolist(), strict=True):
                    one, two = root(int(comp[p])), root(int(comp[q]))
                    if one == two:
                        continue
                    a, b = values[at[p] : at[p + 1]], values[at[q] : at[q + 1]]
                    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                        continue
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if 100 * both >= percent * (len(a) + len(b) - both):
                        parent[max(one, two)] = min(one, two)
                        yield int(nid[p]), int(nid[q])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_units(frames):
            begin, end = runs(frame["unit"].to_numpy())
            weight = np.append(0, np.cumsum(frame["words"].str.len().to_numpy()))
            at = 0
            while at < len(begin):  # whole units, about GROUP_BYTES of words at a time
                stop = max(at + 1, int(np.searchsorted(weight[end], weight[begin[at]] + GROUP_BYTES, "right")))
                yield pd.DataFrame(links_of(frame.iloc[begin[at] : end[stop - 1]]), columns=["one", "two"], dtype="int64")
                at = stop
        K.hand_back()

    return units.mapInPandas(run, "one long, two long")


def words_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """nid, words: the normalised words of the ``wanted`` (nid, node, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in K.blocks(batches):
            data, at = normalised(block)
            texts = [data[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(digests(data, at), pa.binary()), pa.array(texts, pa.binary())], names=["node", "words"])

    source = flagged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id", wanted, "doc_id", "wanted")
    rebuilt = source.where("wanted or doc_id is null").select("text").mapInArrow(run, "node binary, words binary")
    return rebuilt.join(wanted.select("nid", "node"), "node").groupBy("nid").agg(F.first("words").alias("words"))


def linked(units: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int, miss: float, name: str) -> DataFrame:
    """one, two: confirmed links of ``units`` (unit, side, band, nid, comp)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "unit").sortWithinPartitions("unit", "side", "nid")

    signed = units.join(nodes.select("nid", "signature"), "nid")
    hopeful = stored(promising(dealt(signed), percent / 100, miss).distinct(), f"minhash-{name}-hopeful")
    wanted = stored(hopeful.select("nid").distinct().join(nodes.select("nid", "node", "doc_id"), "nid"), f"minhash-{name}-wanted")
    members = hopeful.join(units, ["unit", "nid"]).join(nodes.select("nid", "signature"), "nid").join(words_of(docs, wanted), "nid")
    return stored(confirmed(dealt(members), size, percent, miss), f"minhash-{name}-links")


def star_units(buckets: DataFrame) -> DataFrame:
    """Units of a leader and a bounded share of the nodes that meet it; each pair comes once."""
    met = buckets.where("nid != leader").groupBy("leader", "nid").agg(F.max("chunks").alias("chunks"))
    met = met.select("leader", "nid", F.concat_ws(":", "leader", F.pmod(F.xxhash64("nid"), F.col("chunks"))).alias("unit"))
    rows = met.select("unit", F.lit(2).alias("side"), "nid").union(met.select("unit", F.lit(1), F.col("leader")).distinct())
    return rows.select("unit", "side", F.lit(0).alias("band"), "nid", F.col("nid").alias("comp"))


def open_units(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """Units of the buckets whose nodes are of several components: pairs of chunks that may hold an open pair."""
    known = buckets.join(label.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("label", "nid")).select("key", "band", "nid", "comp", "bytes")
    several = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("key")
    rest = known.join(several, "key")

    # components that fill a chunk have chunks of their own, the others share chunks
    own = rest.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size"))
    own = own.withColumn("big", (F.col("n") >= CHUNK // 2) | (F.col("size") >= CHUNK_BYTES // 2))
    own = own.withColumn("home", F.when(F.col("big"), F.col("comp")))
    whole = own.groupBy("key", "home").agg(F.greatest(F.ceil(F.sum("n") / CHUNK), F.ceil(F.sum("size") / CHUNK_BYTES), F.lit(1)).cast("int").alias("chunks"))
    place = F.concat_ws("/", F.coalesce(F.col("home").cast("string"), F.lit("-")), F.pmod(F.xxhash64("nid", "key"), F.col("chunks")))
    homes = own.select("key", "comp", "home").join(whole.withColumnRenamed("home", "h"), "key").where(F.col("home").eqNullSafe(F.col("h"))).select("key", "comp", "home", "chunks")
    placed = rest.join(homes, ["key", "comp"]).withColumn("chunk", place).select("key", "band", "nid", "comp", "home", "chunk")
    all_chunks = whole.select("key", F.col("home").alias("other home"), F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.concat_ws("/", F.coalesce(F.col("home").cast("string"), F.lit("-")), k))).alias("other"))
    pairs = placed.join(all_chunks, "key").where(~F.coalesce(F.col("home") == F.col("other home"), F.lit(False)))
    unit = F.concat_ws(":", "key", F.least("chunk", "other"), F.greatest("chunk", "other"))
    side = F.when(F.col("chunk") == F.col("other"), 0).when(F.col("chunk") < F.col("other"), 1).otherwise(2)
    return pairs.select(unit.alias("unit"), side.alias("side"), "band", "nid", "comp")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    rows = stored(sketch(docs, shingle), "minhash-rows")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bytes").alias("bytes"), F.first("signature").alias("signature"))
    nodes = stored(nodes.withColumn("nid", F.monotonically_increasing_id()), "minhash-nodes")  # written once, so the numbers hold
    keys = F.array(*(F.xxhash64(F.substring("signature", 1 + 4 * ROWS * b, 4 * ROWS), F.lit(b)) for b in range(BANDS)))
    bands = nodes.select("nid", "bytes", F.posexplode(keys).alias("band", "key"))
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("bytes") / CHUNK_BYTES)).cast("int")
    full = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("nid").alias("leader"), chunks.alias("chunks")).where("n > 1")
    buckets = stored(bands.join(full, "key").select("key", "band", "nid", "bytes", "leader", "chunks"), "minhash-buckets")

    links = linked(star_units(buckets), nodes, docs, shingle, percent, miss, "star")
    units = stored(open_units(buckets, connected_components(links, "one", "two")), "minhash-units")
    links = links.union(linked(units, nodes, docs, shingle, percent, miss, "open"))

    label = connected_components(links, "one", "two").withColumnRenamed("node", "nid")
    named = nodes.select("nid", "node", "doc_id").join(label, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "label").select("node", "component_id")
    out = rows.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


@keeping_columns
def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, with all its columns: the smallest doc_id.

    Rows of one doc_id go together; of rows that repeat a doc_id and its text, one stays. A null
    doc_id stays.
    """
    found = stored(near_duplicates(docs, shingle, percent).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "near-duplicates")
    left = without_ids(docs, found.where("not kept").select(F.col("doc_id").alias("out_id")), "out_id")
    repeated = found.where("kept and n > 1").select(F.col("doc_id").alias("out_id"))
    if repeated.isEmpty():
        return left
    once = left.join(repeated, F.col("doc_id").cast("long") == F.col("out_id"), "left_semi").dropDuplicates(["doc_id", "text"])
    return without_ids(left, repeated, "out_id").union(once)
