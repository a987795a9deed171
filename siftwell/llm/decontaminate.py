"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

A window is ``size`` consecutive words of an item; an item of fewer words, but not none, is one
window. Document windows of the same lengths are hashed with array operations, looked up, and
every hit is verified on the words themselves. A word inside a verified window is hit.

The broadcast holds at most ``MOST_WINDOWS`` distinct windows of ``MOST_BYTES`` in all. For a larger
benchmark it holds a bit sieve of fixed size instead: windows that the sieve lets through are joined
with the benchmark's on their words, text by text, and only those windows are shuffled.

Defined results: null or empty texts have no words and no hits; an item of null text has no
window; repeated items and rows each count by their own id; item ids are compared as strings.
An empty benchmark hits nothing. Each row is judged and cut by its own text, whatever other rows
share its doc_id. Extra columns are ignored by ``scan`` and kept by the removers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.arrays import let
from siftwell.llm import kernels as K
from siftwell.llm.common import keeping_columns, stored

WINDOW = 10
MOST_WINDOWS, MOST_BYTES = 200_000, 1 << 26
SIEVE_BITS, LARGE_SIEVE_BITS = 20, 26
#: The column of results beside a document's own.
FOUND = "benchmark hits"
SPAN = "struct<word: long, end_word: long, byte: long, end_byte: long>"


def bench_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """length, hash, words (joined by one space), items: the distinct windows of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in K.blocks(batches):
            found = K.words(block, K.ITEM_WORDS)
            hashes, text = K.shingles(found, size)
            count = np.diff(found.at)
            first = np.concatenate([found.at[i] + np.arange(max(1, n - size + 1)) for i, n in enumerate(count) if n] or [np.zeros(0, np.int64)])
            length = np.minimum(size, count)[text]
            data = K.LOWER[block.data].tobytes()
            joined = [b" ".join(data[found.begin[k] : found.end[k]] for k in range(f, f + n)) for f, n in zip(first, length, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [block.batch.column(0).take(pa.array(text)), pa.array(length, pa.int32()), pa.array(hashes.view(np.int64)), pa.array(joined, pa.binary())],
                names=["item", "length", "hash", "words"],
            )

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string")).where("item is not null").mapInArrow(run, "item string, length int, hash long, words binary")
    return rows.groupBy("length", "hash", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))


class WindowSet:
    """Windows of each length, sorted by hash, behind a small bit sieve."""

    def __init__(self, rows: list) -> None:
        self.by_length: dict[int, tuple] = {}
        for length in sorted({r["length"] for r in rows}):
            own = sorted((r for r in rows if r["length"] == length), key=lambda r: r["hash"] % (1 << 64))
            hashes = np.array([r["hash"] for r in own], np.int64).view(np.uint64)
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[hashes >> np.uint64(64 - SIEVE_BITS)] = True
            self.by_length[length] = (hashes, sieve, [bytes(r["words"]) for r in own], [list(r["items"]) for r in own])


def windows_of(found: K.Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, text and hash of each run of ``length`` words of one text."""
    begin = np.arange(max(0, len(found.begin) - length + 1))
    text = np.searchsorted(found.at, begin, "right") - 1
    begin, text = (x[begin + length <= found.at[text + 1]] for x in (begin, text))
    return begin, text, K.run_hashes(found.hashes, begin, length)


def spelled(block: K.Block, found: K.Words, begin: int, length: int, data: bytes) -> bytes:
    return b" ".join(data[found.begin[k] : found.end[k]] for k in range(begin, begin + length))


def spans_of(block: K.Block, found: K.Words, hits: list[tuple[int, int]]) -> tuple[np.ndarray, list[list[dict]]]:
    """Number of hit words of each text and their spans, from (first word, length) of the hits."""
    rise = np.zeros(len(found.begin) + 1, np.int32)
    for begin, length in hits:
        rise[begin] += 1
        rise[begin + length] -= 1
    covered = np.append(False, np.cumsum(rise[:-1]) > 0)
    total = np.cumsum(covered)
    n_hit = total[found.at[1:]] - total[found.at[:-1]]
    spans: list[list[dict]] = [[] for _ in n_hit]
    for i in np.flatnonzero(n_hit):
        a, b = found.at[i], found.at[i + 1]
        step = np.diff(np.concatenate([[0], covered[a + 1 : b + 1].astype(np.int8), [0]]))
        for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
            spans[i].append({"word": int(s), "end_word": int(e), "byte": int(found.begin[a + s] - block.at[i]), "end_byte": int(found.end[a + e - 1] - block.at[i])})
    return n_hit, spans


def with_column(block: K.Block, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*block.batch.columns, column], names=[*block.batch.schema.names, FOUND])


def mapped(docs: DataFrame, run, kind: str) -> DataFrame:
    """``docs`` with the column that ``run`` adds."""
    own = docs.withColumn("text", F.col("text").cast("string"))
    return own.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in own.dtypes) + f", `{FOUND}` {kind}")


RESULT = f"struct<n_words: long, n_hit: long, items: array<string>, spans: array<{SPAN}>>"


def looked_up(docs: DataFrame, windows: WindowSet) -> DataFrame:
    """``docs`` with FOUND, all windows being broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in K.blocks(batches):
            found = K.words(block, K.ITEM_WORDS)
            items: dict[int, set] = {}
            hits, data = [], None
            for length, (hashes, sieve, texts, owners) in shared.value.by_length.items():
                begin, text, seen = windows_of(found, length)
                maybe = np.flatnonzero(sieve[seen >> np.uint64(64 - SIEVE_BITS)])
                place = np.searchsorted(hashes, seen[maybe])
                hit = place < len(hashes)
                hit[hit] = hashes[place[hit]] == seen[maybe[hit]]
                for w, p in zip(maybe[hit].tolist(), place[hit].tolist(), strict=True):
                    data = K.LOWER[block.data].tobytes() if data is None else data
                    words = spelled(block, found, begin[w], length, data)
                    while p < len(hashes) and hashes[p] == seen[w]:
                        if texts[p] == words:
                            hits.append((begin[w], length))
                            items.setdefault(int(text[w]), set()).update(owners[p])
                        p += 1
            n_hit, spans = spans_of(block, found, hits)
            rows = [{"n_words": int(n), "n_hit": int(h), "items": sorted(items.get(i, ())), "spans": s} for i, (n, h, s) in enumerate(zip(np.diff(found.at), n_hit, spans, strict=True))]
            span = pa.struct([(c, pa.int64()) for c in ("word", "end_word", "byte", "end_byte")])
            yield with_column(block, pa.array(rows, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(span))])))

    return mapped(docs, run, RESULT)


def joined(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``docs`` with FOUND, a bit sieve being broadcast and the windows that pass it joined.

    Rows without such a window are done; the others meet the hits of their text by its digest.
    """
    place = F.shiftrightunsigned("hash", 64 - LARGE_SIEVE_BITS)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    filled = windows.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(one).alias("bits")).toPandas()  # at most 2 ** 20 rows
    sieve = np.zeros(1 << (LARGE_SIEVE_BITS - 6), np.int64)
    sieve[filled["word"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64)
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most the window size
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in K.blocks(batches):
            found = K.words(block, K.ITEM_WORDS)
            data, rows = K.LOWER[block.data].tobytes(), [{"n_words": int(n), "maybe": []} for n in np.diff(found.at)]
            for length in lengths:
                begin, text, seen = windows_of(found, length)
                place = (seen >> np.uint64(64 - LARGE_SIEVE_BITS)).astype(np.int64)
                for w in np.flatnonzero(shared.value[place >> 6] >> (place & 63) & 1).tolist():
                    a, first = begin[w], found.at[text[w]]
                    edges = [{"byte": int(found.begin[k] - block.at[text[w]]), "end_byte": int(found.end[k] - block.at[text[w]])} for k in range(a, a + length)]
                    rows[text[w]]["maybe"].append({"word": int(a - first), "hash": int(seen.view(np.int64)[w]), "words": spelled(block, found, a, length, data), "edges": edges})
            edge = pa.struct([("byte", pa.int64()), ("end_byte", pa.int64())])
            window = pa.struct([("word", pa.int64()), ("hash", pa.int64()), ("words", pa.binary()), ("edges", pa.list_(edge))])
            yield with_column(block, pa.array(rows, pa.struct([("n_words", pa.int64()), ("maybe", pa.list_(window))])))

    kind = "struct<n_words: long, maybe: array<struct<word: long, hash: long, words: binary, edges: array<struct<byte: long, end_byte: long>>>>>"
    rows = mapped(docs, run, kind).withColumn("text digest", F.sha2("text", 256))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    nothing = F.struct(F.col(FOUND)["n_words"].alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast(f"array<{SPAN}>").alias("spans")).cast(RESULT)
    clean = rows.where(F.size(F.col(FOUND)["maybe"]) == 0).select(*columns, nothing.alias(FOUND))
    hopeful = stored(rows.where(F.size(F.col(FOUND)["maybe"]) > 0), "benchmark-hopeful")
    asked = hopeful.select("text digest", F.explode(F.col(FOUND)["maybe"]).alias("w")).select("text digest", "w.word", "w.hash", "w.words", "w.edges").dropDuplicates(["text digest", "word", "words"])
    met = asked.join(windows.select("hash", "words", "items"), ["hash", "words"])
    each = met.select("text digest", "items", F.posexplode("edges").alias("k", "edge"), "word")
    place = F.struct((F.col("word") + F.col("k")).alias("word"), F.col("edge.byte").alias("byte"), F.col("edge.end_byte").alias("end_byte"))
    hit = each.groupBy("text digest").agg(F.sort_array(F.collect_set(place)).alias("places"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("own items"))
    places = F.col("places")
    opens = F.filter(places, lambda p, i: (i == 0) | (F.get(places, i - 1)["word"] != p["word"] - 1))
    closes = F.filter(places, lambda p, i: (i == F.size(places) - 1) | (F.get(places, i + 1)["word"] != p["word"] + 1))
    span = F.zip_with(opens, closes, lambda a, b: F.struct(a["word"].alias("word"), (b["word"] + 1).alias("end_word"), a["byte"].alias("byte"), b["end_byte"].alias("end_byte")))
    hit = hit.select("text digest", "own items", F.size("places").alias("n"), span.alias("own spans"))
    one = F.struct(F.col(FOUND)["n_words"].alias("n_words"), F.coalesce("n", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("own items", F.array()).alias("items"), F.coalesce("own spans", F.array()).alias("spans")).cast(RESULT)
    return clean.union(hopeful.join(hit, "text digest", "left").select(*columns, one.alias(FOUND)))


def annotated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int | None = None) -> DataFrame:
    """``docs`` with FOUND: n_words, n_hit, items (sorted as strings) and spans of hit words, of each row."""
    windows = stored(bench_windows(benchmark, size), "benchmark-windows")
    weight = F.octet_length("words") + 64 + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 64)
    n, total = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    return looked_up(docs, WindowSet(windows.collect())) if n <= (MOST_WINDOWS if most is None else most) and total <= MOST_BYTES else joined(docs, windows)


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings), spans of hit words: a row for each document row."""
    found = annotated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, size, most)
    return found.select("doc_id", *(F.col(FOUND)[c].alias(c) for c in ("n_words", "n_hit", "items", "spans")))


@keeping_columns
def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int | None = None) -> DataFrame:
    """Documents without any hit, with all their columns."""
    return annotated(docs, benchmark, size, most).where(F.col(FOUND)["n_hit"] == 0).drop(FOUND)


@keeping_columns
def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int | None = None) -> DataFrame:
    """All documents; the bytes of hit spans are cut out of the texts."""
    found = annotated(docs, benchmark, size, most)
    spans = F.col(FOUND)["spans"]

    def left_of(raw: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end_byte"])
        pieces = let(ends, lambda e: F.transform(spans, lambda s, i: cut(raw, F.coalesce(F.get(e, i - 1), F.lit(0)), s["byte"])))
        return F.array_join(F.concat(pieces, F.array(cut(raw, F.element_at(spans, -1)["end_byte"], F.octet_length(raw)))), "")

    def cut(raw: Column, begin: Column, end: Column) -> Column:
        return F.substring(raw, (begin + 1).cast("int"), (end - begin).cast("int")).cast("string")

    text = F.when(F.col(FOUND)["n_hit"] == 0, F.col("text")).otherwise(let(F.col("text").cast("binary"), left_of))
    return found.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: DuckDB SQL of the digest.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, unnest(list_transform(range(1, greatest(len(ws) - 8, 2)), lambda k: array_to_string(ws[k:k + 9], ' '))) AS win
  FROM i WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS k, unnest(list_transform(range(1, len(ws) - n + 2), lambda k: array_to_string(ws[k:k + n - 1], ' '))) AS win
  FROM w, lens WHERE len(ws) >= n),
hits AS (SELECT doc_id, dw.n, k, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS c, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(pos.c, 0)::BIGINT AS n_hit, coalesce(its.c, 0)::BIGINT AS n_items,
  sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(pos.c, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
