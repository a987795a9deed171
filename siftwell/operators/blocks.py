"""Search over posting blocks, range by range of documents, for many queries at once.

A block holds a word's postings of one range of ``BLOCK`` document ids, in order of ids, with the
greatest scores among them. Blocks of one range meet blocks of the same range only, so a common
word is many rows, and the join of two words is a join of their (word, range) keys.

Queries with the same words are answered once. Neighbouring blocks make a range of some millions of
postings; a task holds one range and answers every set of words there, thousands at a time (``ranges``).
With a limit, the heads of lists in every ``STEP``-th range give each set's values at a few ranks first;
what k documents reach there is a bound, and of all ranges only what can reach it is looked at. So what
is moved is the postings (once, and a part of them for the bounds), some numbers for each set and range,
and little more than the answers. A few sets can be answered block by block instead (``met_blocks``,
``answered``, ``second_lot``): by bounds of heads, blocks that cannot matter are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.arrays import no_null_lists
from siftwell.operators.ranges import ROOM, Range
from siftwell.sources.shared import written

#: Documents of a block, blocks answered first, and queries of one task's share of a block.
BLOCK, FIRST, SHARE = 1024, 2, 16384
#: Postings of a range of neighbouring blocks, ranges of which one gives bounds, and rows of a batch that a range gives.
RANGE, STEP, OUT = 1 << 22, 4, 1 << 17
#: Queries of the same words that are one row, and sets of words that are one.
PIECE, SETS = 1024, 4096
ASKED = "set long, block long, m int, bound double"
FOUND = "set long, db_document_id long, relevance double, popularity double, score double"
LISTS = ["ids", "one", "two"]


def posting_blocks(postings: DataFrame, size: int = BLOCK) -> DataFrame:
    """word, block, n, most_relevance, most_popularity, most_product, ids, one, two (relevances and popularities), and places if positions are given.

    Postings with a column ``block`` are grouped by it; rows that are dealt out by (word, block) are not shuffled again.
    """
    product = (F.col("relevance") + 0.001) * (F.col("popularity") + 0.001)
    lists = {"ids": "db_document_id", "one": "relevance", "two": "popularity"} | ({"places": "position"} if "position" in postings.columns else {})
    each = F.sort_array(F.collect_list(F.struct(*lists.values())))
    block = F.col("block") if "block" in postings.columns else F.floor(F.col("db_document_id") / size).cast("long").alias("block")
    rows = postings.where("word is not null").groupBy("word", block)
    found = rows.agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("relevance").alias("most_relevance"), F.max("popularity").alias("most_popularity"), F.max(product).alias("most_product"), each.alias("p"))
    return found.select("word", "block", "n", "most_relevance", "most_popularity", "most_product", *(F.col(f"p.{c}").alias(name) for name, c in lists.items()))


def document_blocks(documents: DataFrame, factor: Column, key: Column, size: int = BLOCK) -> DataFrame:
    """block, most_factor, most_key, ids, one, two (factors and keys) of the documents that may be found."""
    rows = documents.select("db_document_id", factor.cast("double").alias("factor"), key.cast("double").alias("key"))
    each = F.sort_array(F.collect_list(F.struct("db_document_id", "factor", "key")))
    found = rows.groupBy(F.floor(F.col("db_document_id") / size).cast("long").alias("block")).agg(F.max("factor").alias("most_factor"), F.max("key").alias("most_key"), each.alias("p"))
    return found.select("block", "most_factor", "most_key", F.col("p.db_document_id").alias("ids"), F.col("p.factor").alias("one"), F.col("p.key").alias("two"))


def word_sets(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set, words of the distinct queries; query_id, set). Words count once; a query without words, or with a null one, finds nothing."""
    own = queries.select("query_id", F.sort_array(F.array_distinct("words")).alias("words")).where((F.size("words") > 0) & ~F.exists("words", lambda w: w.isNull()))
    sets = written(own.select("words").distinct().withColumn("set", F.monotonically_increasing_id()), "search-sets")
    return sets, own.join(sets, "words").select("query_id", "set")


def met_blocks(sets: DataFrame, blocks: DataFrame, documents: DataFrame, order: str) -> DataFrame:
    """set, block, bound: ranges where all words of a set have postings, and what a document there can reach."""
    words = sets.select("set", F.size("words").alias("m"), F.explode("words").alias("word"))
    heads = blocks.select("word", "block", "n", "most_relevance", "most_popularity", "most_product")
    asked = heads.join(words.select("word").distinct(), "word", "left_semi")
    sizes = asked.groupBy("word").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("n"))
    known = words.join(sizes, "word").groupBy("set").agg(F.count(F.lit(1)).alias("found"), F.first("m").alias("m"), F.min(F.struct("blocks", "n", "word")).alias("r"))
    rarest = known.where("found = m").select("set", F.col("r.word").alias("word"))
    # from the rarest word's ranges on
    ranges = rarest.join(asked.select("word", "block"), "word").select("set", "block").join(documents.select("block", "most_factor", "most_key"), "block")
    met = ranges.join(words, "set").join(asked.drop("n"), ["word", "block"]).groupBy("set", "block")
    met = met.agg(F.count(F.lit(1)).alias("found"), F.first("m").alias("m"), F.first("most_factor").alias("factor"), F.first("most_key").alias("key"), *(F.sum(f"most_{c}").alias(c) for c in ("relevance", "popularity", "product")))
    bound = {"score": F.col("product") * F.col("factor"), "publication_time": F.col("key")}.get(order, F.col(order if order in ("relevance", "popularity") else "relevance"))
    return met.where("found = m").select("set", "block", bound.alias("bound"))


def answered(asked: DataFrame, sets: DataFrame, blocks: DataFrame, documents: DataFrame, k: int | None, order: str) -> DataFrame:
    """set, db_document_id, relevance, popularity, score: the k best of each asked (set, block), or all, from ``least`` on if it is given."""
    asked = asked if "least" in asked.columns else asked.withColumn("least", F.lit(None).cast("double"))
    own = asked.join(sets, "set").select("set", "block", "least", "words")
    shares = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    needed = own.select("block", F.explode("words").alias("word")).distinct()
    every = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    texts = documents.join(shares, "block").select("block", every, F.lit(0).alias("kind"), *LISTS)
    posts = blocks.join(needed, ["word", "block"], "left_semi").join(shares, "block").select("block", every, F.lit(1).alias("kind"), "word", *LISTS)
    tasks = own.join(shares, "block").select("block", F.pmod(F.xxhash64("set"), F.col("shares")).cast("int").alias("share"), F.lit(2).alias("kind"), "set", "least", "words")
    rows = texts.unionByName(posts, allowMissingColumns=True).unionByName(tasks, allowMissingColumns=True)
    rows = no_null_lists(rows.select("block", "share", "kind", "word", "set", "words", *LISTS, "least")).repartition("block", "share").sortWithinPartitions("block", "share", "kind")

    def best(lists: list[tuple], least: float | None, ids: np.ndarray, factor: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
        """ids, relevance, popularity, score of the documents that hold all words (in order of words)."""
        start = min(lists, key=lambda x: len(x[0]))[0]
        place = [np.arange(len(start))]
        for other in [(ids,), *lists]:
            at = np.minimum(np.searchsorted(other[0], start), len(other[0]) - 1)
            same = other[0][at] == start
            start, place = start[same], [p[same] for p in place] + [at[same]]
        own, of_words = place[1], place[2:]
        relevance, popularity, product = np.zeros(len(start)), np.zeros(len(start)), np.zeros(len(start))
        for (_, one, two), at in zip(lists, of_words, strict=True):
            r, p = one[at], two[at]
            relevance += r
            popularity += p
            product += (r + 0.001) * (p + 0.001)
        score = product * factor[own]
        value = {"relevance": relevance, "popularity": popularity, "score": score, "publication_time": key[own]}[order]
        if least is not None:
            high = value >= least - abs(least) * ROOM - ROOM
            start, relevance, popularity, score, value = (x[high] for x in (start, relevance, popularity, score, value))
        if k is not None and len(start) > k:
            by = np.lexsort((start, -value))
            last = value[by[k - 1]]
            more = by[k:]
            keep = np.concatenate([by[:k], more[(value[more] >= last - ROOM) & (value[more] < last)]])
            start, relevance, popularity, score = start[keep], relevance[keep], popularity[keep], score[keep]
        return start, relevance, popularity, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, posts = None, None, {}
        for batch in batches:
            out: list[tuple] = []
            block, share, kind, word, number, words = (batch.column(c).to_pylist() for c in range(6))
            floor = batch.column(9).to_pylist()
            lists = [(np.asarray(c.offsets), c.values.to_numpy(zero_copy_only=False)) for c in (batch.column(6), batch.column(7), batch.column(8))]
            for i in range(batch.num_rows):
                if (block[i], share[i]) != now:
                    now, texts, posts = (block[i], share[i]), None, {}
                if kind[i] == 2:
                    found = best([posts[w] for w in words[i]], floor[i], *texts)
                    if len(found[0]):
                        out.append((np.full(len(found[0]), number[i]), *found))
                    continue
                held = tuple(v[at[i] : at[i + 1]].copy() for at, v in lists)
                if kind[i] == 0:
                    texts = held
                else:
                    posts[word[i]] = held
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["set", "db_document_id", "relevance", "popularity", "score"])

    return rows.mapInArrow(run, FOUND)


def second_lot(met: DataFrame, first: DataFrame, found: DataFrame, k: int, value: Column) -> DataFrame:
    """set, block, least: the blocks that may still hold one of a set's k best, after the first ones gave ``found``."""
    place = F.row_number().over(Window.partitionBy("set").orderBy(F.desc(value), "db_document_id"))
    least = found.select("set", value.alias("least"), place.alias("place")).where(F.col("place") == k).select("set", "least")
    left = met.join(first.select("set", "block"), ["set", "block"], "left_anti").join(least, "set", "left")
    room = F.abs("least") * ROOM + ROOM
    return left.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - room)).select("set", "block", "least")


class Held:
    """Postings of one range of documents, as places among those that may be found."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.posts: dict[str, list[tuple]] = {}
        self.ready: dict[str, tuple | None] = {}
        self.known = False

    def documents(self) -> bool:
        """Whether there are any; ``ids``, ``factor`` and ``key`` are theirs in order of ids."""
        if not self.known:
            self.known = True
            self.ids, self.factor, self.key = (np.concatenate(c) for c in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64),) * 3
        return len(self.ids) > 0

    def of(self, word: str) -> tuple | None:
        """(places, relevances, popularities, list place of each document or none) of a word; common words are looked up by place."""
        if word not in self.ready:
            parts, found = self.posts.pop(word, None), None
            if parts:
                ids, one, two = (np.concatenate(c) for c in zip(*parts, strict=True))
                at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
                there = self.ids[at] == ids
                at = at[there]
                dense = None
                if len(at) * 4 >= len(self.ids):
                    dense = np.full(len(self.ids), -1, np.int32)
                    dense[at] = np.arange(len(at))
                found = (at, one[there], two[there], dense) if len(at) else None
            self.ready[word] = found
        return self.ready[word]


#: (postings of the range, words, least, query ids) -> lists of equal length, in pieces.
Use = Callable[[Held, int, list, "float | None", "list | None"], Iterator[tuple]]


def split(blocks: DataFrame, documents: DataFrame) -> tuple[int, int, int]:
    """(first block, blocks of a range, ranges): a range holds about ``RANGE`` postings, or a task's even share of fewer."""
    total = blocks.agg(F.sum("n")).first()[0] or 0  # one row
    low, high = documents.agg(F.min("block"), F.max("block")).first()
    if low is None:
        return 0, 1, 0
    every = high - low + 1
    wanted = max(-(-total // RANGE), 2 * blocks.sparkSession.sparkContext.defaultParallelism)
    wide = -(-every // min(every, wanted))
    return low, wide, -(-every // wide)


def in_ranges(sets: DataFrame, blocks: DataFrame, documents: DataFrame, use: Use, out: str, cut: tuple[int, int, int], lists: list[str] = LISTS, step: int = 1) -> DataFrame:
    """What ``use`` makes of each set (set, words, least, query_ids) in each range (each ``step``-th) of documents.

    Postings go to their range once; every set meets every range there, and only what is found goes on.
    """
    low, wide, n = cut
    columns = [c.split()[0] for c in out.split(", ")]
    of_block = F.floor((F.col("block") - low) / wide).cast("int").alias("range")
    needed = written(sets.select(F.explode("words").alias("word")).distinct(), "search-words")
    kept = [F.col(c) if c in lists else F.lit(None).cast("array<double>").alias(c) for c in LISTS]
    texts = documents.select(of_block, F.lit(0).alias("kind"), "block", *LISTS)
    posts = blocks.join(needed, "word", "left_semi").select(of_block, F.lit(1).alias("kind"), "block", "word", *kept)
    none = {"least": F.lit(None).cast("double"), "query_ids": F.lit(None).cast("array<bigint>")}
    tasks = sets.select(F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)), F.lit(step))).alias("range"), F.lit(2).alias("kind"), "set", "words", *(c if c in sets.columns else x.alias(c) for c, x in none.items()))
    rows = texts.unionByName(posts, allowMissingColumns=True).unionByName(tasks, allowMissingColumns=True).where((F.col("range") >= 0) & (F.col("range") < n) & (F.col("range") % step == 0))
    rows = no_null_lists(rows.select("range", "kind", "word", "set", "words", "least", "query_ids", *LISTS, "block")).repartition(max(1, 4 * -(-n // step)), "range").sortWithinPartitions("range", "kind", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, Held(), 0
        made: list[tuple] = []
        for batch in batches:
            place, kind, word, number, words, least, asking = (batch.column(c).to_pylist() for c in range(7))
            held_lists = [(np.asarray(c.offsets), c.values.to_numpy(zero_copy_only=False)) for c in (batch.column(7), batch.column(8), batch.column(9))]
            for i in range(batch.num_rows):
                if place[i] != now:
                    now, held = place[i], Held()
                if kind[i] == 2:
                    if held.documents():
                        for piece in use(held, number[i], words[i], least[i], asking[i]):
                            made.append(piece)
                            size += len(piece[0])
                            if size >= OUT:
                                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], names=columns)
                                made, size = [], 0
                    continue
                ids, one, two = (v[at[i] : at[i + 1]].copy() for at, v in held_lists)
                one, two = (x if len(x) else np.zeros(len(ids)) for x in (one, two))
                if kind[i] == 0:
                    held.parts.append((ids, one, two))
                else:
                    held.posts.setdefault(word[i], []).append((ids, one, two))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], names=columns)

    return rows.mapInArrow(run, out)


def coded(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set, codes of its words in their order; word, code): words are numbers from here on."""
    words = written(sets.select(F.explode("words").alias("word")).distinct().withColumn("code", F.monotonically_increasing_id()), "search-words")
    each = sets.select("set", F.posexplode("words").alias("at", "word")).join(words, "word")
    own = each.groupBy("set").agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("c")).select("set", F.col("c.code").alias("codes"))
    return written(own, "search-codes"), words


def sets_in_ranges(sets: DataFrame, words: DataFrame, blocks: DataFrame, documents: DataFrame, use: Callable[..., Iterator[tuple]], order: str | None, out: str, cut: tuple[int, int, int], lists: list[str] = LISTS, step: int = 1) -> DataFrame:
    """What ``use`` makes of the sets (set, codes, least) in each range (each ``step``-th) of documents.

    Postings go to their range once. ``SETS`` sets are one row of lists there, and are answered together.
    """
    low, wide, n = cut
    columns = [c.split()[0] for c in out.split(", ")]
    of_block = F.floor((F.col("block") - low) / wide).cast("int").alias("range")
    kept = [F.col(c) if c in lists else F.lit(None).cast("array<double>").alias(c) for c in LISTS]
    texts = documents.select(of_block, F.lit(0).alias("kind"), "block", *LISTS)
    posts = blocks.join(words, "word").select(of_block, F.lit(1).alias("kind"), "block", "code", *kept)
    least = F.col("least") if "least" in sets.columns else F.lit(None).cast("double").alias("least")
    pieces = max(1, -(-sets.count() // SETS))
    dealt = sets.select("set", "codes", F.coalesce(least, F.lit(float("nan"))).alias("least")).groupBy(F.pmod(F.xxhash64("set"), F.lit(pieces))).agg(F.collect_list(F.struct("set", "codes", "least")).alias("s"))
    packed = dealt.select(F.col("s.set").alias("sets"), F.col("s.codes").alias("codes"), F.col("s.least").alias("least"))
    every = F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)), F.lit(step))).alias("range")
    tasks = packed.select(every, F.lit(2).alias("kind"), "sets", F.flatten("codes").alias("codes"), F.transform("codes", F.size).alias("sizes"), "least")
    rows = texts.unionByName(posts, allowMissingColumns=True).unionByName(tasks, allowMissingColumns=True).where((F.col("range") >= 0) & (F.col("range") < n) & (F.col("range") % step == 0))
    rows = no_null_lists(rows.select("range", "kind", "code", "sets", "sizes", "codes", "least", *LISTS, "block")).repartition(max(1, 4 * -(-n // step)), "range").sortWithinPartitions("range", "kind", "code", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Range(order)
        for batch in batches:
            place, kind, code = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            lists_of = [(np.asarray(c.offsets), c.values.to_numpy(zero_copy_only=False)) for c in batch.columns[3:10]]
            # rows of one range and kind lie together, and so do their lists
            changes = np.flatnonzero((place[1:] != place[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 2)) + 1
            for i, j in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows], strict=True):
                if place[i] != now:
                    now, held = place[i], Range(order)
                own = [v[at[i] : at[j]] for at, v in lists_of]
                if kind[i] == 2:
                    if held.ready():
                        for piece in use(held, *own[:4]):
                            if len(piece[0]):
                                yield pa.RecordBatch.from_arrays([pa.array(c) for c in piece], names=columns)
                    continue
                ids, one, two = (x.copy() for x in own[4:])
                one, two = (x if len(x) else np.zeros(len(ids)) for x in (one, two))
                if kind[i] == 0:
                    held.parts.append((ids, one, two))
                else:
                    held.posts.append((ids, one, two))
                    held.word_of.append(np.repeat(code[i:j].astype(np.int64), np.diff(lists_of[4][0][i : j + 1])))

    return rows.mapInArrow(run, out)


def least_of_sets(sets: DataFrame, words: DataFrame, blocks: DataFrame, documents: DataFrame, k: int, order: str, cut: tuple[int, int, int]) -> DataFrame:
    """set, least: a value that k documents of every ``STEP``-th range reach, if there are as many.

    A range gives the values at a few ranks only, each with the number of documents that it stands for.
    """
    lists = {"relevance": ["ids", "one"], "popularity": ["ids", "two"], "score": LISTS}.get(order, ["ids"])
    some = sets_in_ranges(sets, words, blocks, documents, lambda held, *asked: held.ranks(k, *asked), order, "set long, value double, documents long", cut, lists, STEP)
    upto = F.sum("documents").over(Window.partitionBy("set").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0))
    return some.withColumn("upto", upto).where(F.col("upto") >= k).groupBy("set").agg(F.max("value").alias("least"))


def terms_of_queries(queries: DataFrame, blocks: DataFrame, documents: DataFrame, room: float = 0.0001) -> DataFrame:
    """query_id, db_document_id, score: sum of (relevance + room)(popularity + room) of a query's words, times (the document's factor + room).

    All documents that hold a word of the query; sums are made once for queries of the same words, and the
    rows leave a task as they are asked for, so no posting meets a query in a shuffle. A null factor gives a null score.
    """
    own = queries.select("query_id", F.array_sort(F.array_compact(F.array_distinct("words"))).alias("words")).where(F.size("words") > 0)
    pieces = own.groupBy("words").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("pieces"))
    dealt = own.join(pieces, "words").groupBy("words", F.pmod(F.xxhash64("query_id"), "pieces").alias("piece")).agg(F.collect_list("query_id").alias("query_ids"))
    sets = written(dealt.select(F.monotonically_increasing_id().alias("set"), "words", "query_ids"), "search-sets")

    def use(held: Held, number: int, words: list[str], least: float | None, query_ids: list | None) -> Iterator[tuple]:
        total, any_of = np.zeros(len(held.ids)), np.zeros(len(held.ids), bool)
        for word in words:
            if (found := held.of(word)) is not None:
                place, one, two, _ = found
                np.add.at(total, place, (one + room) * (two + room))
                any_of[place] = True
        place = np.flatnonzero(any_of)
        if len(place):
            score, ids = total[place] * (held.factor[place] + room), held.ids[place]
            for query_id in query_ids or ():
                yield np.full(len(place), query_id), ids, score

    found = in_ranges(sets, blocks, documents, use, "query_id long, db_document_id long, score double", split(blocks, documents))
    return found.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def counted(queries: DataFrame, blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, documents: the number of documents with all words of each query that finds any; no hit is a row."""
    sets, of_query = word_sets(queries)
    own, words = coded(sets)
    parts = sets_in_ranges(own, words, blocks, documents, Range.counts, None, "set long, documents long", split(blocks, documents), ["ids"])
    return parts.groupBy("set").agg(F.sum("documents").alias("documents")).join(of_query, "set").select("query_id", "documents")


def all_words(queries: DataFrame, blocks: DataFrame, documents: DataFrame, order: str, k: int | None) -> tuple[DataFrame, DataFrame]:
    """(set, db_document_id, relevance, popularity, score; query_id, set): candidates for the k best of each set, or all.

    ``order``: relevance, popularity, score (sum of products times the document's factor) or
    publication_time (the document's key). ``documents`` are document blocks.
    """
    sets, of_query = word_sets(queries)
    cut = split(blocks, documents)
    own, words = coded(sets)
    if k is not None and cut[2] > 1:
        least = least_of_sets(own, words, blocks, documents, k, order, cut)
        own = written(own.join(least, "set", "left"), "search-least")
    best = sets_in_ranges(own, words, blocks, documents, lambda held, *asked: held.best(k, *asked), order, FOUND, cut)
    return best, of_query
