"""Sources and sinks: files, tables, presence lists, and the registry of extractors."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import helpers as H
from siftwell.functions.pages import parse_page
from siftwell.functions.urls import EXTENSIONS

Extractor = Callable[[bytes, str], tuple[str, str, list[str]]]


def read_files(spark: SparkSession, roots: list[str], content: bool = True) -> DataFrame:
    """path, modificationTime, length and (only if asked) content of every file below the roots."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(roots)
    return files if content else files.select("path", "modificationTime", "length")


def read_tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 64, **options: str) -> DataFrame:
    """A table of another database; filters and columns are pushed to it.

    With a whole-number ``key`` its range is asked for first, and ``parts`` connections each read a
    part of it (null keys go with the first); without one, one connection reads all.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    if key is not None:
        column = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
        bounds = f"(SELECT min({column}) AS low, max({column}) AS high FROM {table}) bounds"
        low, high = spark.read.format("jdbc").options(url=url, dbtable=bounds, **options).load().first()
        if low is not None:
            reader = reader.options(partitionColumn=key, lowerBound=str(int(low)), upperBound=str(int(high) + 1), numPartitions=str(max(1, min(parts, int(high) - int(low) + 1))))
    return reader.option("dbtable", table).load()


def write_postings(postings: DataFrame, path: str, buckets: int = 64, files: int = 8) -> None:
    """Postings in folders by hash bucket of the word, so that a search reads few files.

    A bucket is up to ``files`` files by document, so a common word is no single task's work.
    """
    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int")
    place = F.pmod(F.xxhash64("db_document_id"), F.lit(files))
    postings.withColumn("bucket", bucket).repartition("bucket", place).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, words: DataFrame, most: int = 10_000, buckets: int = 64) -> DataFrame:
    """Postings of the given words; with few words only their buckets are read."""
    found = spark.read.parquet(path)
    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int").alias("bucket")
    few = words.select("word").distinct().limit(most + 1)
    if few.count() <= most:
        found = found.where(F.col("bucket").isin([r["bucket"] for r in few.select(bucket).distinct().collect()]))
    return found.join(words.select("word").distinct(), "word", "left_semi").drop("bucket")


def plain_text(content: bytes, path: str) -> tuple[str, str, list[str]]:
    text = content.decode(H.guess_encoding(content, False), "ignore").removeprefix("﻿")
    return "", text, []


def page_text(content: bytes, path: str) -> tuple[str, str, list[str]]:
    return parse_page(content.decode(H.guess_encoding(content, True), "ignore"))


class Registry:
    """Extractors by mime type; the newest goes first, a failing one hands over to the next."""

    def __init__(self) -> None:
        self.of: dict[str, list[Extractor]] = {m: [page_text if m == "text/html" else plain_text] for m in dict.fromkeys(EXTENSIONS.values())}

    def register(self, mime_type: str, extractor: Extractor) -> None:
        self.of.setdefault(mime_type, []).insert(0, extractor)

    def extract(self, files: DataFrame) -> DataFrame:
        """path, mime_type, title, text, links, error of (path, mime_type, content) rows.

        A file that no extractor reads gives a row with an error; the run goes on.
        """
        known = self.of

        def one(path: str, mime: str | None, content: bytes | None) -> tuple:
            if content is None:
                return None, None, None, "no content"
            problems = []
            for extractor in known.get(mime, []):
                try:
                    return *extractor(H.unpacked(bytes(content), path or ""), path), None
                except Exception as e:  # noqa: BLE001  an extractor is the user's code
                    problems.append(f"{type(e).__name__}: {e}")
            return None, None, None, "; ".join(problems) or f"no extractor for {mime}"

        def run(frames):
            for frame in frames:
                found = [one(*row) for row in zip(frame["path"], frame["mime_type"], frame["content"], strict=True)]
                yield pd.concat([frame[["path", "mime_type"]].reset_index(drop=True), pd.DataFrame(found, columns=["title", "text", "links", "error"])], axis=1)

        return files.select("path", "mime_type", "content").mapInPandas(run, "path string, mime_type string, title string, text string, links array<string>, error string")


def split_failures(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(indexed, rejected) rows of an extraction."""
    return extracted.where("error is null").drop("error"), extracted.where("error is not null").select("path", "mime_type", "error")
