"""Peers: registry, routing and sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.tries import Trie
from siftwell.functions.urls import is_loopback
from siftwell.operators.index import assign_document_ids, latest_per_key
from siftwell.sources.shared import written

FANOUT, BEST_NODES, PRESENCE_HOURS = 8, 100, 24
#: Interest words of a trie, and query words of a task's share of it.
WORDS, SHARE = 4096, 4096
#: Numbers of a batch of shares.
CELLS = 1 << 19
#: Rounds of ``permuted``, and steps back into its range: more than there are numbers outside for up to
#: 1,024 numbers; beyond, a number needs as many steps with a chance below 32 ** -32.
ROUNDS, STEPS = 8, 32


def register_nodes(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """node_id, ip, port, bandwidth after the calls: the last address of each node; loopback is refused."""
    fresh = latest_per_key(calls.where(~is_loopback(F.col("ip"))), ["node_id"], F.desc("ts"), F.desc("event_id"))
    fresh = fresh.select("node_id", "ip", "port", F.coalesce("bandwidth", F.lit(1)).alias("bandwidth"))
    kept = nodes.select("node_id", "ip", "port", "bandwidth").join(fresh.select("node_id"), "node_id", "left_anti")
    return kept.unionByName(fresh)


def latest_node_info(nodes: DataFrame, incoming: DataFrame) -> DataFrame:
    """Each node's newest row by last_seen_time; an incoming one wins a tie."""
    columns = nodes.columns
    both = nodes.withColumn("from peer", F.lit(0)).unionByName(incoming.withColumn("from peer", F.lit(1)))
    best = both.groupBy("node_id").agg(F.max_by(F.struct(*columns), F.struct("last_seen_time", "from peer")).alias("best"))
    return best.select("best.*")


def node_activity(activity: DataFrame) -> DataFrame:
    """last_seen_time of answers and last_sleep_time of failures of each node; 0 for none."""
    awake = F.max(F.when(~F.col("failed"), F.unix_timestamp("ts")))
    asleep = F.max(F.when(F.col("failed"), F.unix_timestamp("ts")))
    return activity.groupBy("node_id").agg(F.coalesce(awake, F.lit(0)).alias("last_seen_time"), F.coalesce(asleep, F.lit(0)).alias("last_sleep_time"))


def active_neighbors(nodes: DataFrame, me: str, ttl: int) -> DataFrame:
    """Awake nodes but me, newest first, 2 ** max(5, ttl) of them."""
    awake = nodes.where((F.col("node_id") != me) & (F.col("last_seen_time") > F.col("last_sleep_time")))
    return awake.orderBy(F.desc("last_seen_time"), "node_id").limit(2 ** max(5, ttl))


def registered_neighbors(nodes: DataFrame, me: str, count: int) -> DataFrame:
    return nodes.where(F.col("node_id") != me).orderBy(F.desc("last_seen_time"), "node_id").limit(count)


def route_lists(queries: DataFrame, nodes: DataFrame, interests: DataFrame, best: int = BEST_NODES) -> DataFrame:
    """query_id, node_ids, scores: ``route_scores`` of each query as lists.

    Every interest word weighs on every query word, but no pair of words is a row: the nodes' interest
    words, in order and in blocks of ``WORDS``, are tries; a query word walks a trie once, a row of the
    edit matrix for each node of it, and the distances times the weights give its share of each
    node. A query word's shares are one list, stored, so their size is known before they are joined. Queries of
    the same words are answered once, and a query stays one row.
    """
    chosen = nodes.orderBy(F.desc("affinity"), "node_id").limit(best).select("node_id", "affinity")
    own = interests.where("word is not null").join(F.broadcast(chosen), "node_id").select("node_id", F.col("word").alias("interest"), (F.col("specialisation") * F.col("expertise") * F.col("affinity")).alias("weight"))
    own = written(own, "route-interests")  # of ``best`` nodes
    names = own.agg(F.sort_array(F.collect_set("node_id"))).first()[0]  # ``best`` at most, as in ``chosen``
    n, node_ids = len(names), F.array(*map(F.lit, names)).cast("array<string>")
    per_word = own.groupBy("interest").agg(F.collect_list(F.struct((F.array_position(node_ids, F.col("node_id")) - 1).cast("int").alias("place"), "weight")).alias("of")).select("interest", F.col("of.place").alias("places"), F.col("of.weight").alias("weights"))
    blocks = max(1, -(-own.select("interest").distinct().count() // WORDS))
    asked = queries.select("query_id", F.array_sort(F.array_compact("words")).alias("words")).where(F.size("words") > 0)
    sets = written(asked.select("words").distinct().withColumn("set", F.monotonically_increasing_id()), "route-sets")
    words = written(sets.select(F.explode("words").alias("word")).distinct(), "route-words")
    shares = max(1, -(-words.count() // SHARE))
    most = max(1, min(SHARE, CELLS // max(1, n)))

    def each(column: str, n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(column)

    there = per_word.select(F.pmod(F.xxhash64("interest"), F.lit(blocks)).cast("int").alias("block"), each("share", shares), F.lit(0).alias("kind"), F.col("interest").alias("word"), "places", "weights")
    here = words.select(F.pmod(F.xxhash64("word"), F.lit(shares)).cast("int").alias("share"), each("block", blocks), F.lit(1).alias("kind"), "word")
    rows = there.unionByName(here, allowMissingColumns=True).repartition("block", "share").sortWithinPartitions("block", "share", "kind", "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, trie, table = None, [], None, None
        for batch in batches:
            block, share, kind, word, places, weights = (batch.column(k).to_pylist() for k in range(6))
            waiting: list[str] = []

            def walk() -> pa.RecordBatch:
                out = np.empty((len(waiting), n))
                for at, distances in trie.distances(waiting):
                    out[at] = np.exp2(-distances.astype(np.float64)) @ table
                bounds = np.arange(len(waiting) + 1, dtype=np.int32) * n
                return pa.RecordBatch.from_arrays([pa.array(waiting), pa.ListArray.from_arrays(bounds, out.reshape(-1))], names=["word", "parts"])

            for i in range(batch.num_rows):
                if (block[i], share[i]) != now:
                    now, held, trie = (block[i], share[i]), [], None
                if kind[i] == 0:
                    held.append((word[i], places[i], weights[i]))
                    continue
                if trie is None:
                    held.sort(key=lambda x: x[0])
                    trie = Trie([w for w, *_ in held])
                    table = np.zeros((len(held), n))
                    for k, (_, ps, ws) in enumerate(held):
                        for p, w in zip(ps, ws, strict=True):
                            table[k, p] += w or 0.0
                waiting.append(word[i])
                last = i + 1 == batch.num_rows or (block[i + 1], share[i + 1]) != now
                if last or len(waiting) >= most:
                    if held:
                        yield walk()
                    waiting.clear()

    def total(lists: str) -> Column:
        return F.reduce(F.slice(lists, 2, F.size(lists)), F.element_at(lists, 1), lambda x, y: F.zip_with(x, y, lambda u, v: u + v))

    shared = rows.select("block", "share", "kind", "word", "places", "weights").mapInArrow(run, "word string, parts array<double>")
    if blocks > 1:
        shared = shared.groupBy("word").agg(F.collect_list("parts").alias("lists")).select("word", total("lists").alias("parts"))
    shared = written(shared, "route-shares")
    met = sets.select("set", F.explode("words").alias("word")).join(shared, "word").select("set", "parts").repartition("set")
    summed = met.groupBy("set").agg(F.collect_list("parts").alias("lists")).select("set", total("lists").alias("scores"))
    of_query = asked.join(sets, "words").select("query_id", "set")
    return of_query.join(summed, "set").select("query_id", node_ids.alias("node_ids"), "scores")


def route_scores(queries: DataFrame, nodes: DataFrame, interests: DataFrame, best: int = BEST_NODES) -> DataFrame:
    """Of the nodes of best affinity: interest in the query's words, halved for each edit between the words; a row for each query and node."""
    found = route_lists(queries, nodes, interests, best).select("query_id", F.explode(F.arrays_zip("node_ids", "scores")).alias("s"))
    return found.select("query_id", F.col("s.node_ids").alias("node_id"), F.col("s.scores").alias("score"))


def race(seed: int, query_id: Column, node_id: Column, score: Column) -> Column:
    """A draw's place in an exponential race: with u uniform, the k least -ln(u) / score are a draw in proportion to the scores.

    u comes from a hash of seed, query and node, so a seed gives one draw whatever the partitions.
    """
    bits = F.pmod(F.xxhash64(F.lit(seed), query_id, node_id), F.lit(1 << 52)).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / score


def weighted_pick(scores: DataFrame, k: Column | int, seed: int) -> DataFrame:
    """k nodes of each query without replacement, chance in proportion to the score."""
    order = race(seed, F.col("query_id"), F.col("node_id"), F.col("score"))
    placed = scores.where("score > 0").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "node_id")))
    return placed.where(F.col("place") <= k)


def weighted_pick_lists(lists: DataFrame, k: int, seed: int, excluded: str | None = None) -> DataFrame:
    """query_id, picked: ``weighted_pick`` where a query's nodes and scores are lists (``route_lists``), in order of place; only what is picked leaves a query's row."""
    pairs = F.filter(F.arrays_zip("node_ids", "scores"), lambda x: (x["scores"] > 0) & ~x["node_ids"].eqNullSafe(F.lit(excluded)))
    runners = F.transform(pairs, lambda x: F.struct(race(seed, F.col("query_id"), x["node_ids"], x["scores"]).alias("race"), x["node_ids"].alias("node_id"), x["scores"].alias("score")))
    picked = F.slice(F.array_sort(runners), 1, k)
    return lists.select("query_id", F.transform(picked, lambda x: F.struct(x["node_id"].alias("node_id"), x["score"].alias("score"))).alias("picked"))


def random_nodes(nodes: DataFrame, excluded: DataFrame, k: int, seed: int) -> DataFrame:
    return nodes.join(excluded.select("node_id"), "node_id", "left_anti").orderBy(F.xxhash64(F.lit(seed), "node_id"), "node_id").limit(k)


def random_documents(documents: DataFrame, k: int, seed: int) -> DataFrame:
    return documents.select("db_document_id", "document_id").orderBy(F.xxhash64(F.lit(seed), "db_document_id"), "db_document_id").limit(k)


def permuted(number: Column, n: int, *keys: Column) -> Column:
    """Where a keyed permutation of 0 .. n - 1 takes a number: a Feistel network on two digits.

    A number is two digits, of bases whose product is n or a little more; each round adds a hash of
    one digit to the other. A number that leaves the range is sent on until it is back inside, which
    keeps the map one to one.
    """
    wide = math.isqrt(max(0, n - 1)) + 1
    high = -(-n // wide)

    def network(x: Column) -> Column:
        def mix(acc: Column, k: Column) -> Column:
            first = F.struct(F.pmod(acc["l"] + F.pmod(F.xxhash64(*keys, k, acc["r"]), F.lit(high)), F.lit(high)).alias("l"), acc["r"].alias("r"))
            second = F.struct(acc["l"].alias("l"), F.pmod(acc["r"] + F.pmod(F.xxhash64(*keys, k, acc["l"]), F.lit(wide)), F.lit(wide)).alias("r"))
            return F.when(k % 2 == 0, first).otherwise(second)

        digits = F.struct(F.floor(x / wide).cast("long").alias("l"), F.pmod(x, F.lit(wide)).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), digits, mix, lambda acc: acc["l"] * wide + acc["r"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), network(number.cast("long")), lambda x, _: F.when(x < n, x).otherwise(network(x)))


def random_draws(queries: DataFrame, nodes: DataFrame, draws: int, seed: int) -> DataFrame:
    """query_id, node_id, draw: for each query ``draws`` different nodes (all, if fewer) in random order.

    Nodes are numbered; the k-th draw of a query is where a permutation of its own takes k, so a query
    meets only the nodes that it draws, however many there are, and never one twice.
    """
    none = nodes.sparkSession.createDataFrame([], "db_document_id long")
    numbered = assign_document_ids(none, nodes.select("node_id").distinct(), "node_id").withColumnRenamed("db_document_id", "number")
    n = numbered.count()
    if not min(n, draws):
        return queries.select("query_id").limit(0).select("query_id", F.lit("").alias("node_id"), F.lit(0).cast("long").alias("draw"))
    drawn = queries.select("query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(n, draws) - 1).cast("long"))).alias("draw"))
    return drawn.withColumn("number", permuted(F.col("draw"), n, F.lit(seed), F.col("query_id"))).join(numbered, "number").select("query_id", "node_id", "draw")


def route_queries(queries: DataFrame, scores: DataFrame, nodes: DataFrame, me: str, seed: int, fanout: int = FANOUT) -> DataFrame:
    """Targets of each query (query_id, sender): half drawn by score, the rest at random from all nodes, never me or the sender.

    ``scores`` are rows (query_id, node_id, score) or lists (``route_lists``). Of one draw more than are wanted the
    sender is left out; of ``fanout + 1`` random draws the sender and the nodes that were drawn by score are,
    which leaves as many as are wanted, or all nodes.
    """
    half = -(-fanout // 2)
    if "scores" in scores.columns:
        some = weighted_pick_lists(scores, half + 1, seed, me).join(queries.select("query_id", "sender"), "query_id", "left")
        others = F.slice(F.filter("picked", lambda x: ~x["node_id"].eqNullSafe(F.col("sender"))), 1, half)
        picked = some.select("query_id", F.explode(F.transform(others, lambda x: x["node_id"])).alias("node_id"))
    else:
        allowed = scores.where(F.col("node_id") != me).join(queries.select("query_id", F.col("sender").alias("node_id")), ["query_id", "node_id"], "left_anti")
        picked = weighted_pick(allowed, half, seed).select("query_id", "node_id")
    drawn = written(picked.withColumn("kind", F.lit("weighted")), "route-drawn")
    counts = drawn.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    rest = random_draws(queries, nodes.where(F.col("node_id") != me), fanout + 1, seed + 1).join(queries.select("query_id", "sender"), "query_id").where(~F.col("node_id").eqNullSafe(F.col("sender")))
    rest = rest.join(drawn.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").join(counts, "query_id", "left")
    placed = rest.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("draw")))
    return drawn.unionByName(placed.where(F.col("place") <= fanout - F.coalesce("n", F.lit(0))).select("query_id", "node_id", F.lit("random").alias("kind")))


def load_presence_lines(lines: DataFrame) -> DataFrame:
    """ts, event_id, action, args of ``action:p1:p2`` lines."""
    parts = F.split("line", ":", -1)
    return lines.select("ts", "event_id", F.get(parts, 0).alias("action"), F.slice(parts, 2, F.size(parts)).alias("args"))


def presence_registry(log: DataFrame, now: Column) -> DataFrame:
    """Nodes present after notify and logout: one row a node, one node an address (the newest), newest first.

    A node is gone once its last word is a logout or older than 24 hours.
    """
    last = latest_per_key(log, ["node_id"], F.desc("ts"), F.desc("event_id")).where("action = 'notify'")
    owner = latest_per_key(last, ["ip", "port"], F.desc("ts"), F.desc("event_id"))
    fresh = owner.where(F.col("ts") > now - F.expr(f"INTERVAL {PRESENCE_HOURS} HOURS"))
    return fresh.select("node_id", "ip", "port", "bandwidth", F.unix_timestamp("ts").alias("last_seen"))


def who_lines(registry: DataFrame) -> DataFrame:
    """The ``who`` listing: tab-separated lines, newest first."""
    return registry.orderBy(F.desc("last_seen"), "node_id").select(F.concat_ws("\t", "node_id", "ip", "port", "bandwidth", "last_seen").alias("line"))


def read_neighbors(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """ip, port of ``ip port`` lines that no node has yet."""
    parts = F.split(F.trim("line"), r"\s+", -1)
    seeds = lines.where(F.size(parts) >= 2).select(F.get(parts, 0).alias("ip"), F.get(parts, 1).try_cast("int").alias("port")).where("port is not null").distinct()
    return seeds.join(nodes.select("ip", "port"), ["ip", "port"], "left_anti")
