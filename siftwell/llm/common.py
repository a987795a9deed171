"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the filter in ``flagged`` for each id, and at most: 64 of them are one broadcast row.
BITS_PER_ID, MOST_BITS = 16, 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; on one machine, where it is unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        context_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if context_dir.isDefined():
            found = context_dir.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="siftwell-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage: what follows depends on files that every executor sees, so a
    lost executor costs a reread, not a recomputation. Tables are named by a
    fresh id and may be removed once the caller's result is written.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name cannot clash."""
    return df.select(*(df[c] for c in cols))


#: Columns of documents; others are put aside while an operator works, so that no name of theirs can clash.
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def keeping_columns(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on documents (first argument) whose result has their columns: extra ones travel in one column."""

    @functools.wraps(operator)
    def wrapped(docs: DataFrame, *args: object, **options: object) -> DataFrame:
        extra = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in DOCUMENT}
        if not extra:
            return operator(docs, *args, **options)
        aside = F.struct(*(F.col(f"`{c}`").alias(name) for c, name in extra.items())).alias("extra columns")
        found = operator(docs.select(*(c for c in docs.columns if c not in extra), aside), *args, **options)
        return found.select(*(F.col("extra columns")[extra[c]].alias(c) if c in extra else F.col(c) for c in docs.columns))

    return wrapped


def flagged(df: DataFrame, key: str, ids: DataFrame, id_col: str, flag: str) -> DataFrame:
    """``df`` with a boolean ``flag``: false only for keys that are not in ``ids`` (or null).

    The bit filter is sized by the counted ids, up to ``MOST_BITS`` (1 MB of rows for 2 million
    ids, 16 MB at most), so it can be broadcast. Beyond some ten million ids it lets more rows
    through to the exact join that follows, which costs a shuffle and changes no result.
    """
    bits = min(MOST_BITS, 1 << max(16, (BITS_PER_ID * ids.count()).bit_length()))

    def bit(column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits))

    def word(column: str) -> Column:
        return F.shiftright(bit(column), 6)

    one = F.expr("shiftleft(1L, cast(`filter bit` % 64 as int))")
    words = ids.select(word(id_col).alias("filter word"), bit(id_col).alias("filter bit")).groupBy("filter word").agg(F.bit_or(one).alias("filter bits"))
    joined = df.join(F.broadcast(words), word(key) == F.col("filter word"), "left")
    hit = F.col("filter bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (bit(key) % 64).cast("int"))) != 0
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), F.coalesce(hit & F.col(key).isNotNull(), F.lit(False)).alias(flag))


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose key is in ``ids`` (distinct, not null), all columns kept.

    Only rows that the bit filter lets through are shuffled for the exact anti-join.
    """
    rows = flagged(docs, key, ids, id_col, "maybe out")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    checked = rows.where(F.col("maybe out")).join(ids.select(F.col(id_col).alias("id out")), F.col(key).cast("long") == F.col("id out"), "left_anti")
    return rows.where(~F.col("maybe out")).select(*columns).union(checked.select(*columns))
