"""Usage statistics and learning from the query and download logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import hoeffding_deviation
from siftwell.sources.shared import written

FLOOR = 1e-6
AGING, AGING_FROM = 0.75, 1000
#: Nodes, and entries about, of a block that a task holds for affinities, and rows of a batch that it gives.
CHUNK, ENTRIES, OUT = 1 << 14, 1 << 22, 1 << 16


def claims(query_log: DataFrame) -> DataFrame:
    """node_id, word, claim of each query word: 1 / number of words."""
    return query_log.where(F.size("words") > 0).select("node_id", F.explode("words").alias("word"), (F.lit(1.0) / F.size("words")).alias("claim"))


def word_claims(query_log: DataFrame) -> DataFrame:
    return claims(query_log).groupBy("word").agg(F.sum("claim").alias("claim_count"))


def node_claims(query_log: DataFrame) -> DataFrame:
    """Claims of each node; ``url:`` words do not count."""
    return claims(query_log.withColumn("words", F.filter("words", lambda w: ~w.startswith("url:")))).groupBy("node_id").agg(F.sum("claim").alias("claim_count"))


def node_interests(query_log: DataFrame) -> DataFrame:
    """Claims of each (node, word), as shares of the node (specialisation) and of the word (expertise)."""
    pairs = claims(query_log).groupBy("node_id", "word").agg(F.sum("claim").alias("claim_count"))
    # totals are aggregated and joined back, so that a common word is not one window
    of_node = pairs.groupBy("node_id").agg(F.sum("claim_count").alias("of_node"))
    of_word = pairs.groupBy("word").agg(F.sum("claim_count").alias("of_word"))
    joined = pairs.join(of_word, "word").join(of_node, "node_id")
    return joined.select("node_id", "word", "claim_count", (F.col("claim_count") / F.col("of_node")).alias("specialisation"), (F.col("claim_count") / F.col("of_word")).alias("expertise"))


def running_sum(rows: DataFrame, keys: list[str], value: Column, name: str, order: list[str]) -> DataFrame:
    """``rows`` with the sum of ``value`` over the key's rows up to each, in order of ts and ``order``.

    A key's rows are cut by the hour: hours are summed and summed up over the key, and each row adds
    its hour's rows before it. No task sorts more than one key's hour.
    """
    hour = F.coalesce(F.floor(F.unix_timestamp("ts") / 3600), F.lit(-(1 << 40)))
    cut = rows.withColumns({"hour": hour, "own value": value})
    hours = cut.groupBy(*keys, "hour").agg(F.sum("own value").alias("of hour"))
    upto = F.sum("of hour").over(Window.partitionBy(*keys).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))
    before = hours.select(*keys, "hour", F.coalesce(upto, F.lit(0.0)).alias("before hour"))
    inside = F.sum("own value").over(Window.partitionBy(*keys, "hour").orderBy("ts", *order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.join(before, [*keys, "hour"]).withColumn(name, F.col("before hour") + inside).select(*rows.columns, name)


def shares(download_log: DataFrame, weighted: bool = True) -> DataFrame:
    weight = F.col("weight").cast("double") if weighted else F.lit(1.0)
    log = download_log.where(F.size("words") > 0)
    return log.select("ts", "event_id", "db_document_id", F.explode("words").alias("word"), (weight / F.size("words")).alias("share"), weight.alias("whole"))


def document_downloads(download_log: DataFrame) -> DataFrame:
    return download_log.groupBy("db_document_id").agg(F.sum(F.col("weight").cast("double")).alias("download_count"))


def word_downloads(download_log: DataFrame) -> DataFrame:
    return shares(download_log).groupBy("word").agg(F.sum("share").alias("download_count"))


def pair_downloads(download_log: DataFrame) -> DataFrame:
    return shares(download_log).groupBy("db_document_id", "word").agg(F.sum("share").alias("download_count"))


def popularity_relevance(download_log: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Popularity and relevance of each (document, word) as of the pair's last download.

    Counters run in order of (ts, event_id); a document's counter counts events, the word's and
    the pair's count shares.
    """
    events = download_log.where(F.size("words") > 0)
    # words of one event share the document's count, which grows once an event
    counted = running_sum(events.select("ts", "event_id", "db_document_id", "words"), ["db_document_id"], F.lit(1.0), "of_document", ["event_id"])
    rows = counted.select("ts", "event_id", "db_document_id", "of_document", F.explode("words").alias("word"), (F.lit(1.0) / F.size("words")).alias("share"))
    by_word = running_sum(rows, ["word"], F.col("share"), "of_word", ["event_id", "word"])
    by_pair = running_sum(by_word, ["db_document_id", "word"], F.col("share"), "of_pair", ["event_id", "word"])
    newest = F.max_by(F.struct("of_document", "of_word", "of_pair"), F.struct("ts", "event_id"))
    last = by_pair.groupBy("db_document_id", "word").agg(newest.alias("last")).select("db_document_id", "word", "last.*")
    return scored(last, floor)


def scored(counts: DataFrame, floor: float) -> DataFrame:
    popularity = F.col("of_pair") / F.col("of_word") - hoeffding_deviation(F.col("of_word"))
    relevance = F.col("of_pair") / F.col("of_document") - hoeffding_deviation(F.col("of_document"))
    return counts.select("db_document_id", "word", F.greatest(popularity, F.lit(floor)).alias("popularity"), F.greatest(relevance, F.lit(floor)).alias("relevance"))


def popularity_relevance_snapshot(download_log: DataFrame) -> DataFrame:
    """The same from final totals, floored at 0."""
    pairs = pair_downloads(download_log).withColumnRenamed("download_count", "of_pair")
    words = word_downloads(download_log).withColumnRenamed("download_count", "of_word")
    documents = document_downloads(download_log).withColumnRenamed("download_count", "of_document").where("of_document > 0")
    return scored(pairs.join(words, "word").join(documents, "db_document_id"), 0.0)


def affinity(interests: DataFrame, nodes: DataFrame, me: str | None = None) -> DataFrame:
    """Sum over shared words of my specialisation and the other's expertise; pairs that share nothing have 0.

    Zeros are given for one node's view; all pairs return only those that share a word.
    """
    mine = interests if me is None else interests.where(F.col("node_id") == me)
    left = mine.select(F.col("node_id").alias("me"), "word", "specialisation")
    right = interests.select(F.col("node_id").alias("other"), "word", "expertise")
    if me is None:
        return all_affinities(left, right)
    found = left.join(right, "word").groupBy("me", "other").agg(F.sum(F.col("specialisation") * F.col("expertise")).alias("affinity"))
    others = nodes.select(F.lit(me).alias("me"), F.col("node_id").alias("other"))
    return others.join(found, ["me", "other"], "left").select("me", "other", F.coalesce("affinity", F.lit(0.0)).alias("affinity"))


def all_affinities(left: DataFrame, right: DataFrame, chunk: int | None = None) -> DataFrame:
    """me, other, affinity of every two nodes that share a word: a product of sparse tables, block by block.

    A node's words are one row. The other nodes are cut into blocks of ``chunk`` nodes (less, if they have many words), mine into
    shares; a task holds one block by word and adds up one node's row at a time. Only results leave a task: no pair
    is shuffled, and what is moved is each node's words once for each block, or share, of the other side.
    """
    chunk = CHUNK if chunk is None else chunk
    words = written(right.select("word").distinct().where("word is not null").withColumn("number", F.monotonically_increasing_id()), "affinity-words")

    def of_nodes(rows: DataFrame, node: str, value: str) -> DataFrame:
        each = F.collect_list(F.struct("number", F.coalesce(value, F.lit(0.0)).alias("value")))
        found = rows.join(words, "word").groupBy(F.col(node).alias("node")).agg(each.alias("w"))
        return written(found.select("node", F.col("w.number").alias("numbers"), F.col("w.value").alias("values")), "affinity-nodes")

    mine, others = of_nodes(left, "me", "specialisation"), of_nodes(right, "other", "expertise")
    n, entries = others.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("numbers")), F.lit(0))).first()  # one row
    blocks = max(1, -(-n // chunk), -(-entries // ENTRIES))
    shares = max(-(-mine.count() // chunk), 2 * left.sparkSession.sparkContext.defaultParallelism)

    def part(of: int, column: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.lit(of)).cast("int").alias(column)

    def every(of: int, column: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias(column)

    lists = ["node", "numbers", "values"]
    held = others.select(every(shares, "share"), part(blocks, "block"), F.lit(0).alias("kind"), *lists)
    streamed = mine.select(part(shares, "share"), every(blocks, "block"), F.lit(1).alias("kind"), *lists)
    rows = held.select("share", "block", "kind", *lists).unionByName(streamed).repartition(4 * shares * blocks, "share", "block").sortWithinPartitions("share", "block", "kind")
    return rows.mapInArrow(products, "me string, other string, affinity double")


def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """me, other, affinity from rows (share, block, kind, node, numbers, values), of each share and block the others (kind 0) before mine."""
    now, parts, names, table = None, [], None, None
    out: list[tuple[str | None, np.ndarray, np.ndarray]] = []
    size = 0

    def made() -> pa.RecordBatch:
        me = pa.array([m for m, _, _ in out], pa.string()).take(pa.array(np.repeat(np.arange(len(out)), [len(at) for _, at, _ in out])))
        other = names.take(pa.array(np.concatenate([at for _, at, _ in out])))
        return pa.RecordBatch.from_arrays([me, other, pa.array(np.concatenate([x for _, _, x in out]))], names=["me", "other", "affinity"])

    for batch in batches:
        share, block, kind, node = (batch.column(k).to_pylist() for k in range(4))
        at = np.asarray(batch.column(4).offsets)
        numbers, values = (batch.column(k).values.to_numpy(zero_copy_only=False) for k in (4, 5))
        for i in range(batch.num_rows):
            if (share[i], block[i]) != now:
                if out:
                    yield made()
                now, parts, table, out, size = (share[i], block[i]), [], None, [], 0
            own = slice(at[i], at[i + 1])
            if kind[i] == 0:
                parts.append((node[i], numbers[own].copy(), values[own].copy()))
                continue
            if not parts:
                continue
            if table is None:  # the block's entries by word
                names = pa.array([x for x, _, _ in parts], pa.string())
                words = np.concatenate([x for _, x, _ in parts])
                order = np.argsort(words, kind="stable")
                places = np.repeat(np.arange(len(parts)), [len(x) for _, x, _ in parts])[order]
                unique, first = np.unique(words[order], return_index=True)
                table = unique, np.append(first, len(words)), places, np.concatenate([x for _, _, x in parts])[order]
                parts = [(None, None, None)] * len(parts)
            unique, first, places, weights = table
            where = np.minimum(np.searchsorted(unique, numbers[own]), len(unique) - 1)
            there = unique[where] == numbers[own]
            where, value = where[there], values[own][there]
            if not len(where):
                continue
            count = first[where + 1] - first[where]
            entry = np.arange(count.sum()) + np.repeat(first[where] - (np.cumsum(count) - count), count)
            other = places[entry]
            summed = np.bincount(other, weights[entry] * np.repeat(value, count), len(names))
            met = np.zeros(len(names), bool)
            met[other] = True
            found = np.flatnonzero(met)
            out.append((node[i], found, summed[found]))
            size += len(found)
            if size >= OUT:
                yield made()
                out, size = [], 0
    if out:
        yield made()


def matching(interests: DataFrame, postings: DataFrame, documents: DataFrame, me: str) -> DataFrame:
    """Sum over shared words of (my specialisation + .01)(relevance + .01) of every document, 0 without one."""
    mine = interests.where(F.col("node_id") == me).select("word", "specialisation")
    found = postings.join(mine, "word").groupBy("db_document_id").agg(F.sum((F.col("specialisation") + 0.01) * (F.col("relevance") + 0.01)).alias("matching"))
    return documents.select("db_document_id").join(found, "db_document_id", "left").select("db_document_id", F.coalesce("matching", F.lit(0.0)).alias("matching"))


def aging(table: DataFrame, column: str, totals: DataFrame, total: str) -> DataFrame:
    """``column`` times 0.75 where the total (one row) is over 1000."""
    factor = totals.select(F.when(F.col(total) > AGING_FROM, AGING).otherwise(1.0).alias("aging factor"))
    return table.crossJoin(F.broadcast(factor)).withColumn(column, F.col(column) * F.col("aging factor")).drop("aging factor")


def word_totals(words: DataFrame) -> DataFrame:
    return words.agg(F.sum("claim_count").alias("claim_count"), F.sum("download_count").alias("download_count"))


def documents_by_state(documents: DataFrame) -> DataFrame:
    """Count of each of the four states, zeros too."""
    states = documents.sparkSession.createDataFrame([(0,), (1,), (2,), (4,)], "state int")
    counts = documents.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return states.join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def size_by_state(documents: DataFrame) -> DataFrame:
    return documents.groupBy("state").agg(F.sum("size").alias("size"))


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.union(one)
    return out


def document_frequency(postings: DataFrame) -> DataFrame:
    """Documents of each word that has more than one."""
    return postings.groupBy("word").agg(F.count(F.lit(1)).alias("documents")).where("documents != 1")


def df_histogram(postings: DataFrame, bins: int = 1000) -> DataFrame:
    """Words of each of ``bins`` equal bins of document frequency."""
    df = document_frequency(postings)
    bounds = df.agg(F.min("documents").alias("low"), F.max("documents").alias("high"))
    bin_no = F.floor((F.col("documents") - F.col("low")) * F.lit(bins) / (F.col("high") - F.col("low") + 1)).cast("long")
    return df.crossJoin(F.broadcast(bounds)).groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("words"))


def interest_listing(interests: DataFrame, node_id: str | None = None, word: str | None = None) -> DataFrame:
    if node_id is not None:
        interests = interests.where(F.col("node_id") == node_id)
    return interests if word is None else interests.where(F.col("word") == word)
