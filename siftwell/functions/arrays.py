"""Array building blocks: names for computed values, and prefix sums in linear time."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Elements of a chunk of ``sums_before``; a chunk's sums are built by appending.
CHUNK = 64
#: Rows of a batch that are Python objects at a time.
SLICE = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def no_null_lists(df: DataFrame) -> DataFrame:
    """``df`` with empty lists for null ones.

    For rows that go to Arrow: there each row of a run of null lists looks at the whole run again to tell the
    size of the batch, which takes a time that grows with the square of the run.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, ArrayType)}
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.array().cast(kind)) for c, kind in kinds.items()})


def sums_before(sizes: Column) -> Column:
    """For each element of an array (a column or a name given by ``let``) the sum of those before it."""
    n = F.size(sizes)

    def running(values: Column, value: Callable[[Column], Column]) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("before"))
        return F.aggregate(values, start, lambda acc, x: F.struct((acc["sum"] + value(x)).alias("sum"), F.concat(acc["before"], F.array(acc["sum"])).alias("before")))

    def of_chunk(c: Column) -> Column:
        return running(F.sequence(c * CHUNK + 1, F.least((c + 1) * CHUNK, n)), lambda i: F.element_at(sizes, i))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), of_chunk)
    both = let(chunks, lambda cs: F.flatten(F.zip_with(cs, running(cs, lambda c: c["sum"])["before"], lambda c, b: F.transform(c["before"], lambda x: x + b))))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(both)


def in_slices(one: Callable[..., tuple], types: dict[str, pa.DataType], *columns: pa.Array) -> pa.Array:
    """A struct of what ``one`` gives of each row, made a few rows at a time: the rest of a batch stays in Arrow."""
    parts = []
    for start in range(0, max(1, len(columns[0])), SLICE):
        found = [one(*row) for row in zip(*(c.slice(start, SLICE).to_pylist() for c in columns), strict=True)]
        parts.append(pa.StructArray.from_arrays([pa.array([row[k] for row in found], kind) for k, kind in enumerate(types.values())], names=list(types)))
    return pa.concat_arrays(parts)
