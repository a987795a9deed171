"""Run a stream over a table's files to the end and read what it wrote."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from siftwell.operators.index import latest_per_key
from siftwell.sources.shared import fresh_path


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream of the table's files; as a glob the path may name a folder or one file."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def drained(writer: DataStreamWriter, place: str) -> None:
    """Run a stream over all that is there."""
    writer.option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()


def appended(stream: DataFrame, name: str) -> DataFrame:
    """All rows that the stream appends, through a Parquet sink in the shared folder."""
    place = fresh_path(stream.sparkSession, name)
    drained(stream.writeStream.outputMode("append").format("parquet").option("path", f"{place}/rows"), place)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/rows")


def sliced(rows: DataFrame, order: str, slices: int, place: str) -> Iterator[DataFrame]:
    """The table as it grows: each step a stream over ``place``/input, which holds one more slice of the rows in order.

    A stream that is run at each step with one state folder meets a slice as a batch, and starts anew in between.
    """
    n = rows.agg(F.count(F.lit(1))).first()[0]
    cuts = [float("-inf"), *(rows.select(F.col(order).cast("double").alias("o")).approxQuantile("o", [k / slices for k in range(1, slices)], 0.01) if n else []), float("inf")]
    for low, high in zip(cuts, cuts[1:], strict=False):
        own = rows.where((F.col(order).cast("double") > low) & (F.col(order).cast("double") <= high))
        own.write.mode("append").parquet(f"{place}/input")
        yield rows.sparkSession.readStream.schema(rows.schema).parquet(f"{place}/input")


def through(stream: DataFrame, place: str, name: str) -> DataFrame:
    """Run the stream over all that is there and append to ``place``/name; all rows appended so far."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{place}/{name}")
    writer.option("checkpointLocation", f"{place}/{name}-state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/{name}")


def updated(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The last row of each key that the stream updates; a retried batch replaces its own folder."""
    place = fresh_path(stream.sparkSession, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/batch={batch_id}")

    drained(stream.writeStream.outputMode("update").foreachBatch(write), place)
    rows = stream.sparkSession.read.option("basePath", f"{place}/rows").parquet(f"{place}/rows")
    return latest_per_key(rows, keys, F.desc("batch")).drop("batch")
