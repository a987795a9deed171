"""Exact top-k search by inner product with a vector-approximation file.

Vectors become integers floor(scale * x). Each dimension is cut into ``CELLS`` equal cells between
its least and greatest value over all rows; a vector's approximation is its cell numbers, a byte
each, written as a narrow table in blocks.

1. Blocks of queries scan the blocks of cells alone: a cell gives an upper and a lower bound of
   every score, from one matrix product. With several blocks a first scan gives each query's k best
   lower bounds of a block, and their kth over all blocks. A vector whose upper bound is below a
   query's kth lower bound cannot be a result; the others are candidates, as many for any number of blocks.
2. The exact vectors of each query's ``FIRST * k`` candidates of greatest upper bound (least bound of the
   distance) are read, which gives a kth exact score.
3. Only candidates whose upper bound reaches that score are read as well; then the kth result is certain.

Blocks hold about ``BLOCK`` vectors or ``QUERIES`` queries, whatever the table's size. Of equal
vectors only the k + 1 smallest ids can be results, so copies are thinned to those first.

Vectors that are null or hold null or non-finite components take no part; vectors meet only
vectors of their own length; an empty vector scores 0. Rows are told apart by a number, not by
vec_id: repeated rows are candidates and queries of their own, and only a query's own row is no
candidate of it. Fewer candidates than k are all returned; null ids take no part. Components are cut
to the range of a long, and so is a score beyond it (it is ranked by its value of up to 38 digits). Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from siftwell.llm.common import stored

CELLS = 256
BLOCK = 16384
QUERIES = 512
FIRST = 2
LONG, DIGITS = (1 << 63) - 1, 10**38 - 1


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, v array<long>, dim, row: the rows that take part, numbered once the table is written."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * float(scale)))  # stops at the ends of a long
    rows = vectors.where(x.isNotNull() & F.col(id_col).isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id())


def cell_edges(rows: DataFrame) -> DataFrame:
    """dim, lows, widths: for each vector length, the least value of each dimension and the width of its cells."""
    each = rows.select("dim", F.posexplode("v").alias("pos", "x")).groupBy("dim", "pos").agg(F.min("x").cast("double").alias("low"), F.max("x").cast("double").alias("high"))
    width = F.greatest(F.lit(1.0), F.ceil((F.col("high") - F.col("low") + 1) / CELLS).cast("double"))
    sides = F.sort_array(F.collect_list(F.struct("pos", "low", width.alias("width"))))
    return each.groupBy("dim").agg(sides.alias("s")).select("dim", F.col("s.low").alias("lows"), F.col("s.width").alias("widths"))


def approximated(rows: DataFrame) -> DataFrame:
    """dim, row, cells: a byte for each dimension. ``rows`` brings lows and widths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for v, low, width in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                place = np.floor((np.array(v, np.float64) - np.array(low or [], np.float64)) / np.array(width or [], np.float64))
                cells.append(np.clip(place, 0, CELLS - 1).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary())], names=["dim", "row", "cells"])

    return rows.select("dim", "row", "v", "lows", "widths").mapInArrow(run, "dim int, row long, cells binary")


def bounds(q: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds of the scores of queries and cells, widened by more than the rounding of doubles."""
    steps = q * width
    base = (q * low).sum(1, keepdims=True) + steps @ cells.T.astype(np.float64)
    # clipped cells at the top of a range whose values are no longer exact in doubles are covered by the slack
    slack = (np.abs(q) * (np.abs(low) + width * CELLS)).sum(1, keepdims=True) * 2.0**-40
    room = width - 1
    return base + (np.maximum(q, 0) * room).sum(1, keepdims=True) + slack, base + (np.minimum(q, 0) * room).sum(1, keepdims=True) - slack


def best_lower(q: np.ndarray, q_rows: np.ndarray, cells: np.ndarray, rows: np.ndarray, low: np.ndarray, width: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, their k greatest lower bounds in a block, or all if fewer)."""
    for start in range(0, len(q), 64):
        own = q_rows[start : start + 64]
        _, lower = bounds(q[start : start + 64], cells, low, width)
        lower[own[:, None] == rows[None, :]] = -np.inf
        yield own, np.partition(lower, -k, axis=1)[:, -k:] if lower.shape[1] > k else lower


def candidates(q: np.ndarray, q_rows: np.ndarray, least: np.ndarray, cells: np.ndarray, rows: np.ndarray, low: np.ndarray, width: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, vector, upper bound) of the pairs of a block that may be results; ``least`` is known of each query's kth score."""
    for start in range(0, len(q), 64):
        own = q_rows[start : start + 64]
        upper, lower = bounds(q[start : start + 64], cells, low, width)
        same = own[:, None] == rows[None, :]
        upper[same] = lower[same] = -np.inf
        kth = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] >= k else np.full(len(own), -np.inf)
        kth = np.maximum(kth, least[start : start + 64])
        a, b = np.nonzero((upper >= kth[:, None]) & (upper > -np.inf))
        yield own[a], rows[b], upper[a, b]


@F.pandas_udf(DecimalType(38, 0))
def large_product(v: pd.Series, q: pd.Series) -> pd.Series:
    """Inner products of any size, cut to 38 digits."""
    return pd.Series([Decimal(max(-DIGITS, min(DIGITS, sum(int(a) * int(b) for a, b in zip(x, y, strict=True))))) for x, y in zip(v, q, strict=True)], dtype=object)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best; ``is_query`` is a condition on ``vec_id``."""
    rows = stored(integers(vectors, id_col, vector_col, scale), "topk-rows")
    queries = rows.where(is_query)
    n, most, dims = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))), F.max("dim")).first()
    edges = stored(cell_edges(rows), "topk-edges")
    copies = Window.partitionBy("v").orderBy("vec_id", "row")
    thin = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).join(edges, "dim", "left")
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-queries.count() // QUERIES))
    there = approximated(thin).groupBy("dim", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("row", "cells")).alias("m"))
    there = stored(there.select("dim", "block", F.col("m.row").alias("rows"), F.col("m.cells").alias("cells")), "topk-cells")

    def asked(queries: DataFrame) -> DataFrame:
        """dim, block, q_rows, q_values, least: every block of queries for every block of cells."""
        packed = queries.groupBy("dim", F.pmod(F.xxhash64("row"), F.lit(query_blocks)).cast("int").alias("asked")).agg(F.collect_list(F.struct("row", "v", "least")).alias("m"))
        return packed.select("dim", F.col("m.row").alias("q_rows"), F.flatten("m.v").alias("q_values"), F.col("m.least").alias("least"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def scanned(queries: DataFrame, use, schema: str, name: str) -> DataFrame:
        """What ``use`` yields for each pair of blocks, as a written table."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for r in frame.itertuples(index=False):
                    q_rows, own = np.asarray(r.q_rows, np.int64), np.asarray(r.rows, np.int64)
                    q = np.asarray(r.q_values, np.float64).reshape(len(q_rows), r.dim)
                    cells = np.frombuffer(b"".join(r.cells), np.uint8).reshape(len(own), r.dim)
                    low, width = (np.asarray([] if x is None else x, np.float64) for x in (r.lows, r.widths))
                    yield from use(q, q_rows, np.asarray(r.least, np.float64), cells, own, low, width)

        pairs = there.join(edges, "dim", "left").join(asked(queries), ["dim", "block"])
        return stored(pairs.select("dim", "rows", "cells", "lows", "widths", "q_rows", "q_values", "least").mapInPandas(run, schema), name)

    def lows(q, q_rows, least, *block) -> Iterator[pd.DataFrame]:
        for own, best in best_lower(q, q_rows, *block, k):
            yield pd.DataFrame({"query": own, "lows": list(best)})

    def hopeful(q, q_rows, least, *block) -> Iterator[pd.DataFrame]:
        for a, b, upper in candidates(q, q_rows, least, *block, k):
            yield pd.DataFrame({"query": a, "row": b, "upper": upper})

    nothing = F.lit(float("-inf"))
    bounded = queries.withColumn("least", nothing)
    if blocks > 1:
        best = scanned(bounded, lows, "query long, lows array<double>", "topk-lower").groupBy("query").agg(F.sort_array(F.flatten(F.collect_list("lows")), asc=False).alias("b"))
        kth_bound = best.select(F.col("query").alias("row"), F.get("b", F.lit(k - 1)).alias("bound"))
        bounded = queries.join(kth_bound, "row", "left").withColumn("least", F.coalesce("bound", nothing)).drop("bound")
    found = scanned(bounded, hopeful, "query long, row long, upper double", "topk-candidates")

    small = (most or 0.0) ** 2 * max(1, dims or 0) < 2.0**62  # no sum of products can pass the range of a long

    def read(pairs: DataFrame) -> DataFrame:
        """query, query_id, vec_id, score of the exact vectors of the pairs."""
        there = rows.select("row", "vec_id", "v")
        here = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
        product = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x) if small else large_product("v", "q")
        return pairs.select("query", "row").join(there, "row").join(here, "query").select("query", "query_id", "vec_id", product.alias("score"))

    by_bound = Window.partitionBy("query").orderBy(F.desc("upper"), "row")
    first = found.withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= FIRST * k)
    first = stored(read(first), "topk-first")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query", F.col("score").cast("double").alias("kth"))
    # exact scores that doubles round are compared with room to spare
    rest = found.withColumn("place", F.row_number().over(by_bound)).where(F.col("place") > FIRST * k).join(kth, "query").where(F.col("upper") >= F.col("kth") - F.abs("kth") * 2.0**-50)
    every = first.union(read(rest)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    score = F.col("score") if small else F.greatest(F.least("score", F.lit(LONG)), F.lit(-LONG - 1))
    return every.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.cast("long").alias("score"))


ORACLE = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
