"""Structured Streaming forms of the event-driven parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from siftwell.operators import index, usage
from siftwell.operators.index import latest_per_key
from siftwell.sources.shared import written
from siftwell.streaming.state import AddressOwner, NodePresence, Spool, with_state, with_timers

QUERY_LIFE, RESULT_LIFE = "60 seconds", "1 hour"
PERIOD_MS, SPOOL_MS, PRESENCE_MS = 2000, 40_000, 24 * 3600 * 1000


def dedupe_queries_stream(queries: DataFrame, life: str = QUERY_LIFE) -> DataFrame:
    """Each query id once within its life; later rows than the watermark are dropped."""
    return queries.withWatermark("ts", life).dropDuplicatesWithinWatermark(["query_id"])


def merge_results_stream(answers: DataFrame, queries: DataFrame, life: str = RESULT_LIFE) -> DataFrame:
    """Answers to known queries, one for each (query, document), within an hour of the query.

    A query waits in the slots of time (as long as its life) that its life touches, and an answer looks into its own
    slot alone: what an answer is compared with is what came near its time, not all that a batch holds of its key.
    """

    def slot(ts: Column) -> Column:
        return F.floor(F.unix_micros(ts) / F.expr(f"unix_micros(timestamp_seconds(0) + INTERVAL {life})")).cast("long")

    ends = F.expr(f"asked_at + INTERVAL {life}")
    asked = queries.select("query_id", F.col("ts").alias("asked_at")).withWatermark("asked_at", life)
    asked = asked.select("*", F.explode(F.sequence(slot(F.col("asked_at")), slot(ends))).alias("slot asked"))
    once = answers.withWatermark("record_ts", life).dropDuplicatesWithinWatermark(["query_id", "document_id"])
    once = once.withColumn("slot answered", slot(F.col("record_ts")))
    in_time = F.expr(f"record_ts >= asked_at AND record_ts <= asked_at + INTERVAL {life}")
    met = (once["query_id"] == asked["query_id"]) & (F.col("slot answered") == F.col("slot asked"))
    return once.join(asked, met & in_time).drop(asked["query_id"]).drop("slot answered", "slot asked")


def presence_stream(log: DataFrame, life_ms: int = PRESENCE_MS, late: str = "10 minutes") -> DataFrame:
    """node_id, change (join or leave), ip, port, us, event_id: how nodes come to addresses and go.

    ``log``: ts, event_id, node_id, action, ip, port; a logout needs no address. A node that is silent for
    24 hours leaves. Rows of a node that are older than its newest, or than the watermark, are ignored.
    """
    rows = log.withWatermark("ts", late).select("ts", F.unix_micros("ts").alias("us"), "event_id", "node_id", "action", "ip", "port")
    return with_timers(rows, ["node_id"], NodePresence(life_ms), NodePresence.OUT)


def joined_nodes(changes: DataFrame) -> DataFrame:
    """node_id, ip, port, us of the nodes that came and did not go, from the rows that ``presence_stream`` wrote."""
    last = changes.groupBy("node_id").agg(F.max_by(F.struct("change", "ip", "port", "us"), F.struct("us", "event_id", F.col("change") == "join")).alias("c"))
    return last.where("c.change = 'join'").select("node_id", "c.ip", "c.port", "c.us")


def owner_stream(changes: DataFrame) -> DataFrame:
    """ip, port, nth, node_id, us: who has an address after each of its changes (the rows of ``presence_stream``); the newest comer has it."""
    with_state(changes.sparkSession)
    return changes.groupBy("ip", "port").transformWithState(AddressOwner(), AddressOwner.OUT, "Append", "None")


def present_nodes(owners: DataFrame) -> DataFrame:
    """node_id, ip, port, us of the nodes that are there, from the rows that ``owner_stream`` wrote."""
    last = owners.groupBy("ip", "port").agg(F.max_by(F.struct("node_id", "us"), "nth").alias("o"))
    return last.where("o.node_id is not null").select("o.node_id", "ip", "port", "o.us")


def usage_stats_stream(query_log: DataFrame) -> DataFrame:
    """Running claims of each word, in update mode."""
    return usage.word_claims(query_log)


def flush_spool_stream(results: DataFrame, expected: int, period_ms: int = PERIOD_MS, life_ms: int = SPOOL_MS, late: str = "2 seconds") -> DataFrame:
    """query_id, document_id, relevance, record_ms, sent_ms: the hits that are sent for each query.

    ``results``: query_id, document_id, relevance, record_ts. Every two seconds the best unsent hits of a query
    go, ``expected`` in all; its spool lives 40 seconds from its first hit on.
    """
    rows = results.withWatermark("record_ts", late).select("record_ts", F.col("query_id").cast("string").alias("query_id"), F.col("document_id").cast("string").alias("document_id"), F.col("relevance").cast("double").alias("relevance"), F.unix_millis("record_ts").alias("ms"))
    return with_timers(rows, ["query_id"], Spool(expected, period_ms, life_ms), Spool.OUT)


FILES = "file_name string, file_time long, state int, db_document_id long"
POSTINGS = "db_document_id long, words array<string>, positions array<int>, scored array<struct<word string, download_count double, relevance double, popularity double>>"
#: Folders of the files' hash buckets, documents of a bucket of postings, and tasks that write one.
FILE_BUCKETS, BUCKET_DOCUMENTS, PIECES = 64, 1 << 16, 8


class Buckets:
    """A table in folders by bucket, of which a batch rewrites those that it touches.

    A batch's rows are written aside first and then laid over their buckets, so a batch that is tried
    again finds either the old bucket or what it wrote, and lays it over once more.
    """

    def __init__(self, path: str, schema: str, *dealt: Column) -> None:
        """``dealt``: what parts a bucket's rows among tasks (none: a task a bucket)."""
        self.path, self.schema, self.dealt = path, f"{schema}, bucket long", dealt

    def prepare(self, spark: SparkSession) -> None:
        spark.createDataFrame([], self.schema).write.mode("ignore").partitionBy("bucket").parquet(self.path)

    def read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        rows = spark.read.schema(self.schema).parquet(self.path)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def aside(self, rows: DataFrame, batch_id: int) -> None:
        """Keep the new contents of the touched buckets until they are laid over."""
        rows.write.mode("overwrite").parquet(f"{self.path}-batch-{batch_id % 2}")

    def lay_over(self, spark: SparkSession, batch_id: int) -> None:
        rows = spark.read.schema(self.schema).parquet(f"{self.path}-batch-{batch_id % 2}")
        rows.repartition("bucket", *self.dealt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)


def incremental_index_stream(crawl: DataFrame, path: str, documents_of_bucket: int = BUCKET_DOCUMENTS) -> DataStreamWriter:
    """Index files as they come: file_name, file_time, state, db_document_id, title, text.

    A file is indexed if it is new, newer than the indexed one or of another state; its postings
    take new positions, keep the scores of words that it still has, and lose the others. Postings lie in
    buckets of neighbouring documents: a batch reads and rewrites the buckets of its changed
    documents alone, so new documents do not touch old buckets. ``current_postings`` reads them.
    A document's postings are one row, with the scores of those words that have any. What changed is found
    from rows without texts; texts are moved only if a batch holds some that are not indexed.
    """
    spark = crawl.sparkSession
    files, postings = Buckets(f"{path}/files", FILES), posting_buckets(path)
    for table in (files, postings):
        table.prepare(spark)
    columns = [c.split()[0] for c in FILES.split(", ")]

    def touched(rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select("bucket").distinct().collect()]  # folders, not rows

    def bucket_of(rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.floor(F.col("db_document_id") / documents_of_bucket).cast("long"))

    def with_scores(fresh: DataFrame, old: DataFrame) -> DataFrame:
        scores = old.where("scored is not null").select("db_document_id", "scored")
        if scores.isEmpty():
            return fresh.withColumn("scored", F.lit(None).cast(scores.schema["scored"].dataType))
        left = F.filter("scored", lambda x: F.array_contains("words", x["word"]))
        return fresh.join(scores, "db_document_id", "left").withColumn("scored", F.when(F.size(left) > 0, left))

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = written(batch.withColumn("batch row", F.monotonically_increasing_id()), "index-batch")
        newest = latest_per_key(rows.select(*columns, "batch row"), ["file_name"], F.desc("file_time"), F.desc("db_document_id"), F.col("batch row"))
        newest = written(newest.withColumn("bucket", F.pmod(F.xxhash64("file_name"), F.lit(FILE_BUCKETS))), "index-newest")
        known = files.read(spark, touched(newest))
        changed = written(index.detect_changes(newest, known).where("change != 'untouched'").drop("change"), "index-changed")
        if changed.isEmpty():
            return
        own = touched(changed)
        files.aside(index.upsert(files.read(spark, own), changed.select(*columns, "bucket"), ["file_name"]), batch_id)
        ids = latest_per_key(changed.select("db_document_id", "file_time", "batch row"), ["db_document_id"], F.desc("file_time"), F.col("batch row"))
        ids = written(bucket_of(ids.drop("file_time")), "index-ids")
        documents = rows if ids.count() == rows.count() else rows.join(ids.select("batch row"), "batch row", "left_semi")
        old = postings.read(spark, touched(ids))
        fresh = with_scores(index.posting_lists(documents), old)
        postings.aside(old.join(ids.select("db_document_id"), "db_document_id", "left_anti").unionByName(bucket_of(fresh)), batch_id)
        # postings first: a batch that stops in between still finds its files changed when it is tried again
        postings.lay_over(spark, batch_id)
        files.lay_over(spark, batch_id)

    return crawl.writeStream.foreachBatch(merge)


def posting_buckets(path: str) -> Buckets:
    return Buckets(f"{path}/postings", POSTINGS, F.pmod(F.xxhash64("db_document_id"), F.lit(PIECES)))


def current_postings(spark: SparkSession, path: str) -> DataFrame:
    """(document, word) with its position and scores (0 where none are stored)."""
    rows = posting_buckets(path).read(spark).select("db_document_id", "scored", F.explode(F.arrays_zip("words", "positions")).alias("p"))
    own = F.get(F.filter("scored", lambda x: x["word"] == F.col("p.words")), F.lit(0))
    return rows.select("db_document_id", F.col("p.words").alias("word"), F.col("p.positions").alias("position"), *(F.coalesce(own[c], F.lit(0.0)).alias(c) for c in index.SCORES))
