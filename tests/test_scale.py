"""Steps that must not move or make more rows than their input asks for."""

from __future__ import annotations

import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftwell.functions import excerpts as E
from siftwell.functions import helpers as H
from siftwell.functions import pages as Pages
from siftwell.functions import tokens as K
from siftwell.functions.arrays import no_null_lists
from siftwell.operators import blocks as B
from siftwell.operators import index as I
from siftwell.operators import peers as Peers
from siftwell.operators import search as S
from siftwell.operators import snippets as N
from siftwell.operators.ranges import Range
from siftwell.plans.catalog import CATALOG
from siftwell.plans.fixtures import Tables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    """Shuffles of a plan with no broadcast."""
    return len(re.findall(r"Exchange (?:hash|range|roundrobin)", plan(df), re.I))


def test_merged_postings_are_dealt_out_once(spark):
    posts = spark.range(1000).select(F.col("id").alias("db_document_id"), F.concat(F.lit("w"), F.col("id") % 7).alias("word"), F.lit(3).alias("position"), *(F.lit(1.0).alias(c) for c in I.SCORES))
    assert exchanges(I.merge_postings(posts, posts.unionByName(posts))) == 1
    documents = posts.select("db_document_id", F.lit(4).alias("state"))
    merged = plan(I.merge_known_scores(posts, posts, documents))
    assert "FullOuter" not in merged and merged.count("Window [") == 1


def test_pages_of_a_batch_are_few_python_objects_at_a_time():
    """Python's part of a batch of 6,000 pages of 3 kB is that of a few of them."""
    pages = pa.array(["<title>t</title><body>" + "word \u00e9 " * 430 + f"<a href=/x{k}>y</a>" for k in range(6000)] + [None])
    for udf, args in ((Pages.extract_html, (pages,)), (Pages.extract_html_clean, (pages,)), (H.decode_text, (pages.cast(pa.binary()), pa.array(["p.html"] * 6001)))):
        tracemalloc.start()
        found = udf.func(*args)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(found) == 6001 and set(found[6000].as_py().values()) == {None} and "word" in found[5999].as_py()["text"]
        assert peak < 4_000_000


def test_postings_of_documents_are_dropped_as_lists(spark):
    found = CATALOG["drop_orphan_scores"][0](Tables(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert found.index("Generate explode") < found.index("Join LeftSemi")


def test_index_calls_are_read_once(spark):
    calls = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, None, 7)], "db_document_id long, node_id string, last_providing_time long")
    nodes = spark.createDataFrame([("a",), ("a",), (None,)], "node_id string")
    marked = I.calls_marked(calls, nodes)
    assert {(r["db_document_id"], r["accepted"]) for r in marked.collect()} == {(1, True), (2, False), (3, False)} and marked.count() == 3
    assert [[r["db_document_id"] for r in x.orderBy("db_document_id").collect()] for x in I.provider_must_exist(calls, nodes)] == [[1], [2, 3]]
    assert plan(CATALOG["provider_must_exist"][0](Tables(spark, SF))).count("partial_max(ts") == 1


def test_routing_makes_no_row_of_a_word_and_a_node(spark):
    t = Tables(spark, SF)
    found = Peers.route_scores(t.queries(), t.nodes().withColumn("affinity", F.lit(0.5)), t.interests())
    assert not re.search(r"Exchange hashpartitioning\((word|query_id)#\d+, node_id|Exchange hashpartitioning\(query_id#\d+L, node_id", plan(found))


def test_postings_are_dealt_out_once_for_their_blocks(spark):
    found = plan(B.posting_blocks(Tables(spark, SF).new_scored_postings()))
    assert len(re.findall(r"rangepartitioning\(word#\d+ ASC NULLS FIRST, block#", found)) == 1
    assert not re.search(r"hashpartitioning\(word#\d+, (block|_groupingexpression)", found)


def test_tokens_of_texts_are_not_shuffled(spark):
    found = Tables(spark, SF).new_event_words(["view", "click"])._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("regexp_extract_all") == 1


def test_little_more_than_the_best_leaves_a_range(spark):
    """Of 40 alike blocks the bound of some ranges keeps all but a few rows inside the tasks."""
    posts = [(d, "x", ((d * 7919) % 2560) / 2560, 0.5) for d in range(64 * 40)]
    held = B.posting_blocks(spark.createDataFrame(posts, "db_document_id long, word string, relevance double, popularity double"), 64)
    documents = spark.range(64 * 40).select(F.col("id").alias("db_document_id"), F.lit(1.0).alias("factor"), F.lit(0.0).alias("key"))
    heads = B.document_blocks(documents, F.col("factor"), F.col("key"), 64)
    queries = spark.createDataFrame([(1, ["x"])], "query_id long, words array<string>")
    found, _ = B.all_words(queries, held, heads, "relevance", 30)
    rows = sorted(((-r["relevance"], r["db_document_id"]) for r in found.collect()))
    assert len(rows) <= 30 * 2 * 4
    assert [d for _, d in rows[:30]] == [p[0] for p in sorted(posts, key=lambda p: (-p[2], p[0]))[:30]]


def test_a_text_is_read_once_for_its_abstracts(monkeypatch):
    """Many abstracts of one text are made from the places of its words; only the first one reads it all."""
    text = "".join(f"w{i} " for i in range(20_000)) + "Straſe needle\nNeedle"
    read = E.Readable(text)
    assert "<b>w7</b>" in read.abstract(["w7"])
    monkeypatch.setattr(E.re, "finditer", None)
    for i in range(0, 20_000, 10):
        assert f"<b>w{i}</b>" in read.abstract([f"w{i}"])
    assert "<b>Straſe</b>" in read.abstract(["strase"]) and read.abstract(["NEEDLE"]).count("<b>") == 3


def test_hits_are_stored_for_words_and_grouped_by_query_without_a_shuffle(spark):
    t = Tables(spark, SF)
    found = plan(S.merge_spool(t.results()).select("query_id", "document_id", "place"))
    assert "hashpartitioning(query_id#" in found and not re.search(r"hashpartitioning\(query_id#\d+L, document_id", found)
    assert "hits-of-sets" in found and "title" not in found  # columns that are not asked for stay in the files
    assert t.hits().groupBy("query_id").count().agg(F.max("count")).first()[0] <= S.HITS


def test_queries_meet_documents_inside_the_tasks(spark):
    """Scores of all documents with a word: as many rows as results, none for a query and a posting."""
    posts = [(d, w, (d % 9) / 9, (d % 5) / 5) for d in range(300) for w in "xyz" if d % {"x": 1, "y": 2, "z": 7}[w] == 0]
    postings = spark.createDataFrame(posts, "db_document_id long, word string, relevance double, popularity double")
    documents = spark.range(300).select(F.col("id").alias("db_document_id"), F.when(F.col("id") != 5, F.col("id") / 300).alias("matching")).where("db_document_id != 8")
    asked = [(1, ["x", "y", "x"]), (2, ["y", "x"]), (3, ["z", "none"]), (4, ["none"]), (5, None), (6, ["z", None])]
    found = S.rank_document(spark.createDataFrame(asked, "query_id long, words array<string>"), postings, documents)
    got = {(r["query_id"], r["db_document_id"]): r["score"] for r in found.collect()}
    want = {}
    for q, words in asked:
        for d in range(300):
            own = [(r + 0.0001) * (p + 0.0001) for e, w, r, p in posts if e == d and w in set(words or [])] if d != 8 else []
            if own:
                want[q, d] = None if d == 5 else sum(own) * (d / 300 + 0.0001)
    assert got.keys() == want.keys() and all(want[k] is None and got[k] is None or abs(want[k] - got[k]) < 1e-12 for k in want)
    assert "MapInArrow" in plan(found) and not re.search(r"hashpartitioning\(query_id#\d+L, db_document_id", plan(found))


def test_patched_texts_need_not_be_utf8(spark):
    known = spark.sql("SELECT 1L AS db_document_id, concat('ab ', cast(x'ff' AS string), ' cd') AS text")
    rows = spark.createDataFrame([(1, 5, "CD")], "db_document_id long, position int, excerpt string")
    assert I.patch_sparse_text(rows, known).first()["text"] == "ab � CD"


def test_memory_of_tokens_follows_small_blocks():
    texts = pa.array(["some words of a text " * 100] * 4000)  # 8 MB
    tracemalloc.start()
    found = sum(len(K.first_of_each(K.tokens(data, at))) for _, data, at in K.blocks(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 4 * 4000 and peak < 64e6


def test_hits_are_moved_once_for_their_profiles(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARE", 2)
    monkeypatch.setattr(B, "PIECE", 2)
    lists = [(d, [f"w{(d + i) % 9}" for i in range(n)], [7 * i for i in range(n)]) for d, n in enumerate([9, 5, 1, 0, 8])]
    learnt = [(0, "w8", 0.5), (1, "w1", 0.0), (1, "x", 0.9), (4, "w4", 0.05), (4, "w5", 0.05)]
    sets = [(1, ["w0", "w1"], [0]), (2, ["w4"], [0, 1, 4]), (3, ["w5", "w6", "w7", "w8"], [0, 4]), (4, ["w2"], [0, 2, 9])]
    of_query = [(10, 1), (11, 2), (12, 2), (13, 2), (14, 3), (15, 4)]
    wanted = spark.createDataFrame(sets, "set long, words array<string>, db_document_ids array<long>")
    tables = spark.createDataFrame(of_query, "query_id long, set long"), spark.createDataFrame(lists, "db_document_id long, words array<string>, positions array<int>"), spark.createDataFrame(learnt, "db_document_id long, word string, relevance double")
    found = S.hit_profile(wanted, *tables, lambda p: 1.0 / (p + 10.37), 2)
    want = set()
    for q, s in of_query:
        words, documents = sets[s - 1][1:]
        for d, held, places in lists:
            scores = {w: 1.0 / (p + 10.37) for w, p in zip(held, places, strict=True)} | {w: r for e, w, r in learnt if e == d and w in held}
            if d in documents:
                others = sorted((-r, w) for w, r in scores.items() if r > 0 and w not in words)[: 2 + len(words)]
                want |= {(q, d, w, scores[w], True) for w in words if w in scores} | {(q, d, w, -r, False) for r, w in others}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    text = plan(found)
    assert "Window [" not in text and not re.search(r"hashpartitioning\(query_id", text)


def test_providers_need_no_words(spark):
    t = Tables(spark, SF)
    assert "regexp_extract_all" not in t.providers()._jdf.queryExecution().toString()
    slow = t.download_log().groupBy("db_document_id", "node_id").agg(F.unix_timestamp(F.max("ts")).alias("last_providing_time"))
    got, want = (sorted(map(tuple, x.collect())) for x in (t.providers(), slow))
    assert got == want and got
    assert "engine-event-words" not in " ".join(t.providers().inputFiles())


def test_rows_without_words_have_no_providers(spark, tmp_path):
    texts = [None, "", "a b ä ñ .", "ÀÉ", "x" * 3, " " * 70 + "late words", "é" * 60 + "z", "一丁 a_", "a\r\nb"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'src1' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    events = [(i, i % 3, "click", '{"k": 3}' if i % 4 else "{}") for i in range(90)]
    rows = spark.createDataFrame(events, "event_id long, user_id long, event_type string, props string").selectExpr("*", "timestamp_seconds(1700000000 + event_id) AS ts")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    t = Tables(spark, str(tmp_path))
    slow = t.download_log().groupBy("db_document_id", "node_id").agg(F.unix_timestamp(F.max("ts")).alias("last_providing_time"))
    got, want = (sorted(map(tuple, x.collect())) for x in (t.providers(), slow))
    assert got == want and {r[0] for r in got} == {3, 4, 5, 6, 7}


def test_null_lists_do_not_go_to_arrow(spark):
    """Rows of a run of null lists look at the whole run to tell a batch's size: 10,000 rows took 50 million steps for each list column."""
    rows = no_null_lists(spark.range(3).select("id", F.when(F.col("id") == 1, F.array(F.lit(7))).alias("a b"), F.lit(None).cast("array<string>").alias("s")))
    assert [(r["id"], r["a b"], r["s"]) for r in rows.orderBy("id").collect()] == [(0, [], []), (1, [7], []), (2, [], [])]
    t = Tables(spark, SF)
    asked = [S.search_by_words_count(t.queries(), None, t.documents(), t.blocks()), S.rank_document(t.queries(), None, t.documents(), t.blocks()), CATALOG["patch_sparse_text"][0](t)]
    asked += [CATALOG["hit_profile"][0](t), N.abstracts(t.hits().select("db_document_id").withColumn("words", F.lit(None).cast("array<string>")), t.documents())]
    for found in asked:
        maps = found._jdf.queryExecution().analyzed().toString().split("MapInArrow")
        assert len(maps) > 1 and any("coalesce(" in below and "cast(array() as array<" in below for below in maps[1:])


def test_excerpts_of_a_document_are_laid_as_lists(spark):
    """Lists of excerpts and their rows give the same; a document's excerpts are no rows in the plan of the query."""
    known = spark.createDataFrame([(1, "the cat sat"), (2, None), (2, "two"), (4, "unseen")], "db_document_id long, text string")
    lists = spark.createDataFrame([(1, [4, 0, 4], ["CAT", "T", "CA"]), (2, [1, None, -1, 9], ["WO", "x", "y", "z"]), (3, [2], ["abc"]), (None, [0], ["n"]), (None, [1], ["m"])], "db_document_id long, positions array<int>, excerpts array<string>")
    rows = lists.select("db_document_id", F.explode(F.arrays_zip("positions", "excerpts")).alias("p")).select("db_document_id", F.col("p.positions").alias("position"), F.col("p.excerpts").alias("excerpt"))
    want = {1: "The CAT sat", 2: "tWO      z", 3: "  abc", None: "nm"}
    assert {r[0]: r[1] for r in I.patch_sparse_text(lists, known).collect()} == want == {r[0]: r[1] for r in I.patch_sparse_text(rows, known).collect()}
    found = CATALOG["patch_sparse_text"][0](Tables(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in found and "CoGroup" not in found


def laid_out(order, lists, n, key=None):
    """A range of ``n`` documents (ids by twos) with the given postings: word -> {place: (one, two)}."""
    r = Range(order)
    r.parts.append((np.arange(n) * 2, np.linspace(1.0, 2.0, n), np.zeros(n) if key is None else key))
    for w, held in sorted(lists.items()):
        places = np.array(sorted(held))
        r.posts.append((places * 2, *(np.array([held[p][k] for p in places.tolist()], float) for k in (0, 1))))
        r.word_of.append(np.full(len(places), w))
    assert r.ready()
    return r


def test_a_bound_leaves_the_heads_of_lists(spark):
    """Of two words in all of 4,096 documents, few postings can be in a sum that reaches a high bound: all were looked at before."""
    rng = np.random.default_rng(3)
    value = {w: rng.random(4096) ** 8 for w in (0, 1)}
    r = laid_out("relevance", {w: {p: (v[p], 0.5) for p in range(4096)} for w, v in value.items()}, 4096)
    least = np.sort(value[0] + value[1])[-50]
    words = np.array([[0, 1]])
    lens = r.heads(words, np.array([least]))
    assert lens.sum() < 4096 / 4 and r.heads(words, np.array([-np.inf])).sum() == 4096
    sets, ids, relevance, *_ = (np.concatenate(c) for c in zip(*r.best(50, np.array([9]), np.array([2]), np.array([0, 1]), np.array([least])), strict=True))
    assert sorted(ids.tolist()) == sorted((np.argsort(-(value[0] + value[1]))[:50] * 2).tolist())


def test_sets_in_a_range_by_brute_force():
    """Sets of one to four words: counts, best ones with and without a bound, and values at ranks, in every order; equal and missing values too."""
    rng = np.random.default_rng(11)
    n = 300
    lists = {w: {p: (rng.integers(0, 9) / 8, rng.integers(0, 9) / 8) for p in np.flatnonzero(rng.random(n) < share).tolist()} for w, share in enumerate((0.9, 0.6, 0.3, 0.1, 0.02))}
    key = rng.integers(0, 20, n).astype(float)
    asked = [tuple(sorted(rng.choice(6, rng.integers(1, 5), replace=False).tolist())) for _ in range(80)]  # 5 has no posting
    given = np.arange(80) + 1000, np.array([len(a) for a in asked]), np.array([w for a in asked for w in a])
    for order in ("relevance", "popularity", "score", "publication_time", None):
        r = laid_out(order, lists, n, key)
        factor = np.linspace(1.0, 2.0, n)
        want = {}
        for s, words in enumerate(asked):
            for p in set.intersection(*(set(lists.get(w, ())) for w in words)):
                one, two = (sum(lists[w][p][k] for w in words) for k in (0, 1))
                score = sum((lists[w][p][0] + 0.001) * (lists[w][p][1] + 0.001) for w in words) * factor[p]
                want.setdefault(s + 1000, {})[p * 2] = {"relevance": one, "popularity": two, "score": score, "publication_time": key[p], None: 0}[order]
        none = np.full(80, np.nan)
        if order is None:
            assert {int(s): int(c) for x in r.counts(*given, none) for s, c in zip(*x, strict=True)} == {s: len(v) for s, v in want.items()}
            continue
        for k, least in ((None, none), (7, none), (7, np.array([sorted(want.get(s + 1000, {0: 0}).values())[-7:][0] for s in range(80)]))):
            got: dict = {}
            for x in r.best(k, *given, least):
                for s, d in zip(x[0].tolist(), x[1].tolist(), strict=True):
                    assert d not in got.setdefault(s, [])
                    got[s].append(d)
            for s, held in want.items():
                best = sorted(held, key=lambda d: (-round(held[d], 9), d))[:k]
                assert set(best) <= set(got[s]) and (k is not None or len(got[s]) == len(best))
        for x in r.ranks(7, *given, none):
            for s in set(x[0].tolist()):
                own = sorted(zip(x[1][x[0] == s].tolist(), x[2][x[0] == s].tolist(), strict=True), reverse=True)
                upto = 0
                for v, c in own:
                    upto += c
                    assert sum(w >= v - 1e-9 for w in want[s].values()) >= upto


def test_abstracts_of_a_set_stay_a_list(spark, monkeypatch):
    """Hits and their abstracts meet as lists of a set: no row of a hit is joined or dealt out for them, and queries of a set in pieces have all."""
    monkeypatch.setattr(B, "PIECE", 2)
    lists = spark.createDataFrame([(7, [3, 1, 2], ["u3", "u1", "u2"]), (8, [1], ["u1"]), (9, [5], ["u5"])], "set long, db_document_id array<long>, url array<string>")
    made = spark.createDataFrame([(7, 1, "a"), (7, 3, "c"), (8, 1, "z")], "set long, db_document_id long, abstract string")
    of_query = spark.createDataFrame([(q, 7) for q in range(9)] + [(20, 8), (21, 9)], "query_id long, set long")
    found = S.made_of_hits(lists, made, of_query, "abstract", "url")
    assert found.columns == ["query_id", "db_document_id", "url", "abstract"]
    assert sorted(map(tuple, found.collect())) == sorted([x for q in range(9) for x in ((q, 1, "u1", "a"), (q, 3, "u3", "c"))] + [(20, 1, "u1", "z")])
    t = Tables(spark, SF)
    whole = CATALOG["answer_payload"][0](t)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join Inner, \(.*db_document_id#\d+L = .*\bset#|Join Inner, \(.*set#\d+L = .*db_document_id#\d+L", whole)


def test_ascii_words_are_folded_without_a_table():
    assert E.folded("AbC İıſKÉ") == "abc iiské" and E.folded("X") == "x"
    read = E.Readable("Straſe strase STRASE " * 4)
    assert sorted(nth for nth, *_ in read.runs_of("strase")) == [1, 1, 2, 2, 3, 3, 4, 4, 5]
    assert E.plain("Wo_rd") == "wo_rd" and E.plain("a b") is None and E.plain("é") is None
