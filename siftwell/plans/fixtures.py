"""The engine's tables, derived from the given ones by Spark jobs (documents, events, pages)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.functions import urls as U
from siftwell.functions.arrays import let
from siftwell.operators import blocks, index, peers, search, usage
from siftwell.sources.shared import written

EPOCH = 1_600_000_000


#: Stored tables by application, folder, state of its files and name: indexed once, searched often.
KEPT: dict[tuple[str, str, str, str], DataFrame] = {}


def relevance_at(position: Column) -> Column:
    """Relevance of a pair that no download has taught, from its first position."""
    return F.lit(1.0) / (position + 10.37)


class Tables:
    """Derived tables of one data folder.

    Those that many queries need (documents, postings, logs, hits) are written once to the shared
    folder and read from there as long as the given files stay as they are; the others are lazy plans.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.seen: str | None = None

    def kept(self, name: str, plan: Callable[[], DataFrame]) -> DataFrame:
        if self.seen is None:
            places = [f"{self.sf_dir}/{t}.parquet" for t in ("documents", "events")]
            files = self.spark.read.format("binaryFile").load(places)
            mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
            self.seen = repr(files.agg(F.count(F.lit(1)), F.sum(mark)).first())  # one row, however many files
        key = (self.spark.sparkContext.applicationId, self.sf_dir, self.seen, name)
        if key not in KEPT:
            KEPT[key] = written(plan(), f"engine-{name}")
        return KEPT[key]

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def extracted(self) -> DataFrame:
        """Crawled and extracted files: one row for each document row."""
        d = F.col("doc_id")
        state = F.element_at(F.array(*(F.lit(s) for s in (1, 0, 2, 4))), (d % 4 + 1).cast("int"))
        return self.given("documents").select(
            d.alias("file_id"),
            F.concat(F.lit("/"), "source", F.lit("/"), d.cast("string"), F.lit(".txt")).alias("file_name"),
            (d * 3600 + EPOCH).alias("file_time"),
            state.alias("state"),
            F.lit(index.CREATED).alias("file_state"),
            F.when(d % 5 == 0, "text/html").otherwise("text/plain").alias("mime_type"),
            T.first_chars_title(F.col("text")).alias("title"),
            "text",
        )

    def documents(self) -> DataFrame:
        return self.kept("documents", lambda: index.dedupe_content(self.extracted()))

    def files(self) -> DataFrame:
        return index.link_files(self.extracted(), self.documents())

    def crawl(self) -> DataFrame:
        """A second crawl: every seventh file is gone, every fifth newer, every ninth of another state, ten new ones in each hundred."""
        f = self.extracted().select("file_id", "file_name", "file_time", "state")
        later = F.when(F.col("file_id") % 5 == 0, F.col("file_time") + 10).otherwise(F.col("file_time"))
        state = F.when(F.col("file_id") % 9 == 0, U.PUBLISHED).otherwise(F.col("state"))
        old = f.where("file_id % 7 != 0").select("file_name", later.alias("file_time"), state.alias("state"))
        new = f.where("file_id % 10 = 3").select(F.concat(F.lit("/new"), "file_name").alias("file_name"), "file_time", F.lit(U.PUBLISHED).alias("state"))
        return old.unionByName(new)

    def posting_lists(self) -> DataFrame:
        return self.kept("posting-lists", lambda: index.posting_lists(self.documents()))

    def postings(self) -> DataFrame:
        return index.postings_of(self.posting_lists())

    def scored_postings(self) -> DataFrame:
        """Postings with the scores of the download log laid over them; other pairs have scores from their position.

        They stand in the stored blocks, in order of (word, range of documents): a search of few words skips
        most of the files, and a common word is in as many of them as it needs.
        """
        each = F.explode(F.arrays_zip("ids", "places", "one", "two")).alias("p")
        rows = self.blocks().select("word", each)
        return rows.select(F.col("p.ids").alias("db_document_id"), "word", F.col("p.places").alias("position"), F.lit(0.0).alias("download_count"), F.col("p.one").alias("relevance"), F.col("p.two").alias("popularity"))

    def blocks(self) -> DataFrame:
        """The scored postings in blocks of a word and a range of documents, for searches."""
        return self.kept("posting-blocks", lambda: blocks.posting_blocks(self.new_scored_postings()).sortWithinPartitions("word", "block"))

    def new_scored_postings(self) -> DataFrame:
        """Postings and learnt scores meet in the ranges of (word, block) that blocks are made and stored in: rows are dealt out once."""
        block = F.floor(F.col("db_document_id") / blocks.BLOCK).cast("long").alias("block")
        learnt = self.learnt().select("word", block, "db_document_id", F.lit(None).cast("int").alias("position"), "relevance", "popularity")
        none = F.lit(None).cast("double")
        known = self.postings().select("word", block, "db_document_id", "position", none.alias("relevance"), none.alias("popularity"))
        dealt = known.unionByName(learnt).repartitionByRange("word", "block")
        pairs = dealt.groupBy("word", "block", "db_document_id").agg(*(F.max(c).alias(c) for c in ("position", "relevance", "popularity"))).where("position is not null")
        place = relevance_at(F.col("position"))
        return pairs.select("word", "block", "db_document_id", "position", F.coalesce("relevance", place).alias("relevance"), F.coalesce("popularity", place * 0.5317).alias("popularity"))

    def learnt(self) -> DataFrame:
        """Scores of the download log: db_document_id, word, popularity, relevance."""
        return self.kept("learnt", lambda: usage.popularity_relevance(self.download_log()))

    def words(self) -> DataFrame:
        none = self.spark.createDataFrame([], "word string, claim_count double, download_count double")
        return index.extend_vocabulary(none, self.postings())

    def nodes(self) -> DataFrame:
        user = F.col("user_id")
        events = self.given("events")
        seen = events.groupBy("user_id").agg(*(F.coalesce(F.max(F.when(condition, F.unix_timestamp("ts"))), F.lit(0)).alias(name) for name, condition in (("last_seen_time", F.col("event_type") != "error"), ("last_sleep_time", F.col("event_type") == "error"))))
        return seen.select(
            F.sha1(user.cast("string")).alias("node_id"),
            F.concat(F.lit("10.0."), F.floor(user / 256).cast("string"), F.lit("."), (user % 256).cast("string")).alias("ip"),
            (user % 3 + 6446).cast("int").alias("port"),
            "last_seen_time",
            "last_sleep_time",
            F.lit(0.0).alias("claim_count"),
            F.lit(0.0).alias("affinity"),
            (user % 7 + 1).cast("int").alias("bandwidth"),
        )

    def event_words(self, kinds: list[str]) -> DataFrame:
        """Events with the document they are on and two of its words."""
        return self.kept("event-words", lambda: self.new_event_words(["view", "click", "purchase"])).where(F.col("event_type").isin(kinds))

    def events_on_rows(self, kinds: list[str]) -> DataFrame:
        """Events that name a key, with the document row that they are on."""
        n = self.given("documents").agg(F.count(F.lit(1)).alias("n_docs"))
        events = self.given("events").where(F.col("event_type").isin(kinds)).crossJoin(F.broadcast(n))
        k = F.get_json_object("props", "$.k").cast("long").alias("k")
        return events.select("event_id", "ts", "user_id", "event_type", k, (F.col("event_id") % F.col("n_docs")).alias("on_doc")).where("k is not null")

    def new_event_words(self, kinds: list[str]) -> DataFrame:
        docs = self.given("documents").select(F.col("doc_id").alias("on_doc"), "text")
        events = self.events_on_rows(kinds)
        # a document's events are one row, so its text is read into tokens once and no token is shuffled
        asked = events.groupBy("on_doc").agg(F.collect_list(F.struct("event_id", "ts", "user_id", "event_type", "k")).alias("events"))

        def picked(e: Column, document_id: Column, tokens: Column) -> Column:
            words = (F.element_at(tokens, (place % F.size(tokens) + 1).cast("int")) for place in (e["k"], e["k"] * e["k"] + 7))
            return F.struct(*(e[c].alias(c) for c in ("event_id", "ts", "user_id", "event_type")), document_id.alias("document_id"), F.array_distinct(F.array(*words)).alias("words"))

        tokens = T.tokenize(T.normalize_text(F.concat_ws(" ", T.first_chars_title(F.col("text")), "text")))
        each = let(T.content_id(F.col("text")), lambda own: let(tokens, lambda ts: F.when(F.size(ts) > 0, F.transform("events", lambda e: picked(e, own, ts)))))
        found = asked.join(docs, "on_doc").select(F.explode(each).alias("e")).select("e.*")
        return found.select("event_id", "ts", F.sha1(F.col("user_id").cast("string")).alias("node_id"), "event_type", "document_id", "words")

    def query_log(self) -> DataFrame:
        return self.event_words(["view"]).select("event_id", "ts", "node_id", "words")

    def queries(self) -> DataFrame:
        return self.query_log().select(F.col("event_id").alias("query_id"), "words", F.col("node_id").alias("sender"))

    def download_log(self) -> DataFrame:
        weight = F.when(F.col("event_type") == "purchase", 10).otherwise(1)
        log = self.event_words(["click", "purchase"]).join(self.documents().select("document_id", "db_document_id"), "document_id")
        return log.select("event_id", "ts", "node_id", "db_document_id", "words", weight.alias("weight"))

    def presence_log(self) -> DataFrame:
        nodes = self.nodes().select("node_id", "ip", "port", "bandwidth")
        log = self.given("events").where(F.col("event_type").isin("signup", "error")).select("ts", "event_id", F.sha1(F.col("user_id").cast("string")).alias("node_id"), F.when(F.col("event_type") == "signup", "notify").otherwise("logout").alias("action"))
        return log.join(nodes, "node_id").select("ts", "event_id", "node_id", "action", "ip", "port", "bandwidth")

    def presence_lines(self) -> DataFrame:
        log = self.presence_log()
        notify = F.concat_ws(":", "action", "node_id", "ip", "port", "bandwidth")
        return log.select("ts", "event_id", F.when(F.col("action") == "notify", notify).otherwise(F.concat_ws(":", "action", "node_id")).alias("line"))

    def hit_sets(self) -> tuple[DataFrame, DataFrame]:
        """(set, lists of its best hits; query_id, set): stored once for all queries of the same words."""
        made: dict[str, DataFrame] = {}

        def lists() -> DataFrame:
            best, made["sets"] = search.best_of_sets(self.queries(), self.scored_postings(), self.documents(), blocks=self.blocks())
            return search.hit_lists(best)

        found = self.kept("hits-of-sets", lists)
        return found, self.kept("sets-of-queries", lambda: made["sets"])

    def hits(self) -> DataFrame:
        """The best hits of every query."""
        return search.hits_of_queries(*self.hit_sets())

    def wanted(self) -> DataFrame:
        """set, words, db_document_ids: each set's words in order, each once, and its hits."""
        lists, of_query = self.hit_sets()
        words = F.array_sort(F.array_distinct("words")).alias("words")
        sets = of_query.join(self.queries(), "query_id").groupBy("set").agg(F.first("words").alias("words")).select("set", words)
        return sets.join(lists.select("set", F.col("db_document_id").alias("db_document_ids")), "set")

    def results(self) -> DataFrame:
        """Hits as they came from one to three nodes; the first copy is local."""
        asked = self.query_log().select(F.col("event_id").alias("query_id"), "ts", "node_id")
        copies = F.explode(F.sequence(F.lit(0), (F.col("query_id") % 3).cast("int"))).alias("copy")
        rows = self.hits().join(asked, "query_id").select("*", copies)
        return rows.select(
            "document_id", "query_id", F.sha1(F.concat_ws(":", "node_id", "copy")).alias("node_id"), "mime_type", "title", "size", "publication_time", "state",
            F.round("relevance", 6).alias("relevance"), F.round("popularity", 6).alias("popularity"), "url",
            F.when(F.col("copy") == 0, "localhost").otherwise(F.concat(F.lit("10.1.1."), F.col("copy").cast("string"))).alias("host"),
            F.when(F.col("copy") == 0, 0).otherwise(6446).alias("port"), F.lit("").alias("login"),
            F.timestamp_seconds(F.unix_timestamp("ts") + F.col("copy")).alias("record_ts"),
        )

    def rows_with_words(self) -> DataFrame:
        """on_doc, db_document_id: the document of each document row that holds a word."""

        def with_word(text: Column) -> Column:
            return F.regexp_like(T.normalize_text(text), F.lit(r"\w{2}"))

        text = F.col("text")
        # most rows show a word in their first characters, so the rest is not read for that
        rows = self.given("documents").where(with_word(T.first_chars_title(text)) | with_word(text)).select(F.col("doc_id").alias("on_doc"), T.content_id(text).alias("document_id"))
        return rows.join(self.documents().select("document_id", "db_document_id"), "document_id").select("on_doc", "db_document_id")

    def providers(self) -> DataFrame:
        """Nodes that downloaded a document, and when last: the nodes of ``download_log``, without its words."""
        places = self.kept("rows-with-words", self.rows_with_words)
        last = self.events_on_rows(["click", "purchase"]).join(places, "on_doc").groupBy("db_document_id", "user_id").agg(F.max("ts").alias("ts"))
        return last.select("db_document_id", F.sha1(F.col("user_id").cast("string")).alias("node_id"), F.unix_timestamp("ts").alias("last_providing_time"))

    def interests(self) -> DataFrame:
        return self.kept("interests", lambda: usage.node_interests(self.query_log()))

    def nodes_with_affinity(self, me: str) -> DataFrame:
        found = usage.affinity(self.interests(), self.nodes(), me).select(F.col("other").alias("node_id"), F.col("affinity").alias("new"))
        return self.nodes().join(found, "node_id", "left").withColumn("affinity", F.coalesce("new", "affinity")).drop("new")

    def registry(self, now) -> DataFrame:
        return peers.presence_registry(self.presence_log(), now)
