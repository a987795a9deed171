"""Golden cases, brute-force replays, statistics and streams."""

from __future__ import annotations

import datetime
import functools
import gzip
import itertools
import math
import os
import random
import re
import time
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwell.functions import excerpts as E
from siftwell.functions import helpers as H
from siftwell.functions import pages as X
from siftwell.functions import text as T
from siftwell.functions import tokens, tries
from siftwell.functions import urls as U
from siftwell.functions.arrays import sums_before
from siftwell.operators import blocks, index, peers, search, snippets, usage
from siftwell.plans.fixtures import Tables
from siftwell.sources import files
from siftwell.streaming import jobs, runs

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalize_and_tokenize(spark):
    assert one(spark, T.normalize_text(F.lit("Été  À\tÇa\x01ß"))) == "ete a ca ß"
    assert one(spark, T.normalize_text(F.lit("ýÿ"))) == "ýy"
    assert one(spark, T.tokenize(F.lit("ab c 9_ straße"))) == ["ab", "9_", "stra"]
    assert [len(w) for w in one(spark, T.tokenize(F.lit("x" * 120)))] == [50, 50, 20]
    assert one(spark, T.tokenize(F.lit(""))) == []


def test_deviation_and_sizes(spark):
    assert one(spark, T.hoeffding_deviation(F.lit(1))) == pytest.approx(math.sqrt(-math.log(0.45) / 2))
    assert one(spark, T.hoeffding_deviation(F.lit(4))) == pytest.approx(math.sqrt(-math.log(0.45) / 2) / 2)
    assert [one(spark, T.readable_size(F.lit(n))) for n in (999, 1000, 1001, 10**6, 10**9, 0)] == ["999", "0 GB", "1 kB", "0 GB", "1 GB", "XXX NO KNOWN SIZE"]


@pytest.mark.parametrize(("raw", "words", "filetype"), [("hello", ["hello"], None), ("hello world", ["hello", "world"], None), ("hello filetype:pdf", ["hello"], "application/pdf"), ("hello filetype:pdf world", ["hello", "world"], "application/pdf"), ("a:b a:b:c", ["a:b", "a:b:c"], None), ("", [], None)])
def test_parse_query(spark, raw, words, filetype):
    got = one(spark, U.parse_query(F.lit(raw)))
    assert (got["words"], got["filetype"]) == (words, filetype)


def test_content_ids(spark):
    lines = ["hello", "world,", "This", "is", "speaking"]
    assert len({one(spark, T.content_id(F.lit(end.join(lines)))) for end in ("\n", "\r\n", "\r")}) == 1


def test_http_date_and_ip(spark):
    assert one(spark, U.http_date(F.lit("Sun, 06 Nov 1994 08:49:37 GMT"))) == 784111777
    assert one(spark, U.http_date(F.lit("nonsense"))) is None
    assert [one(spark, U.is_private_ip(F.lit(ip))) for ip in ("10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.1.1", "8.8.8.8", "x")] == [True, True, False, True, False, False]


def test_encodings():
    assert H.guess_encoding("c'est l'ôté".encode(), False) == "UTF-8"
    assert H.guess_encoding("ôté".encode("latin-1"), False) == "ISO-8859-1"
    assert H.guess_encoding(b"<?xml version='1.0' encoding='iso-8859-15'?><a/>", False) == "ISO-8859-15"
    assert H.guess_encoding(b"<?xml version='1.0'?><a/>", False) == "UTF-8"
    assert H.guess_encoding(b'text with charset="latin1" \xe9', False) == "ISO-8859-1"
    assert H.guess_encoding(b'<meta charset="koi8-r">', True) == "koi8-r"


def test_pages():
    title, text, links = X.parse_page("<html><head><title>T &amp; U</title></head><body><b>titi</b><i>tutu</i><a href='x.html'>l</a></body>")
    assert title == "T  U"
    assert text.split() == ["titi", "tutu", "l"] and links == ["x.html"]
    title, text, links = X.parse_clean("<html><body><script>no</script><p>one &lt; two</p><a href='p#f'>a</a><a href='p'>b</a><img src='i.png'></body></html>")
    assert "no" not in text.split() and links == ["p", "i.png"]


def test_abstract_and_excerpts():
    text = "start " + "filler word " * 30 + "needle in here " + "tail words " * 30
    got = E.abstract(text, ["needle"])
    assert "<b>needle</b>" in got and got.startswith(" <b>...</b> ") and got.endswith(" <b>...</b>") and len(got) < 140
    assert E.abstract("short text", ["absent"]) == "short text"
    assert E.abstract("x" * 300, []) == " <b>...</b>" and E.abstract("ab " * 100, []).startswith("ab ab")
    many = E.abstract(" ".join(f"alpha{' pad' * 40} beta{' pad' * 40}" for _ in range(20)), ["alpha", "beta"])
    assert many.count("<b>alpha</b>") + many.count("<b>beta</b>") == 5 and many.count("<b>beta</b>") >= 2


def window_of(text, at, half=40):
    """The window by its rule, a character at a time."""
    at = 0 if at >= 65535 else at
    begin = max(0, at - half)
    if begin:
        while begin < at and text[begin] != " ":
            begin += 1
        begin += 1
    end = min(len(text), begin + 2 * half)
    if end < len(text):
        while end > at and text[end] != " ":
            end -= 1
        end += 1
    return begin, max(begin, end)


def test_excerpts_by_brute_force(spark):
    r = random.Random(6)
    texts = ["a" * 10, "", "needle", "x" * 300, "one two " * 40] + [" ".join("".join(r.choice("abé<>") for _ in range(r.choice([1, 3, 9, 60]))) for _ in range(r.randint(1, 60))) for _ in range(60)]
    rows = [(i, t, sorted(r.sample(range(max(1, len(t))), min(4, max(1, len(t)))))) for i, t in enumerate(texts)] + [(900, "w " * 40_000, [10, 65535, 70_000])]
    df = spark.createDataFrame(rows, "id long, text string, places array<int>")
    at = df.select("id", "text", F.explode("places").alias("at"))
    for x in at.select("text", "at", E.excerpt_at(F.col("text"), F.col("at")).alias("e")).collect():
        begin, end = window_of(x["text"], x["at"])
        assert x["e"] == x["text"][begin:end]
    for x in df.select("text", "places", E.merge_excerpts(F.col("text"), F.col("places")).alias("e")).collect():
        out, last = "", 0
        for begin, end in sorted(window_of(x["text"], p) for p in x["places"]):
            if end > last:
                out += ("<b>...</b>" if begin > last else "") + x["text"][max(begin, last) : end].replace("<", "&lt;").replace(">", "&gt;")
                last = end
        assert x["e"] == (out + " <b>...</b>" if out else None)


def test_links_as_the_standard_says(spark):
    from urllib.parse import urljoin

    bases = ["http://a.b/c/d/e.html?q#f", "http://a.b", "http://a.b/", "https://h:80/x/", "http://a/b/../c/d"]
    links = ["g", "./g", "g/", "/g", "//h/x", "?y", "g?y#z", "#s", "", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../../g", "/./g", "/../g", "g.", "..g", "./g/.", "g/./h", "g/../h", "mailto:x@y", "javascript:void(0)", "http://z/../q", "a b/é"]
    df = spark.createDataFrame([(b, x) for b in bases for x in links], "page string, link string")
    for r in df.select("page", "link", U.resolve_link(F.col("page"), F.col("link")).alias("t")).collect():
        assert r["t"] == urljoin(r["page"], r["link"]), (r["page"], r["link"])


def test_prefix_sums(spark):
    r = random.Random(1)
    rows = [(i, [r.randrange(50) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 255, 256, 257, 1000, 20_000])]
    for x in spark.createDataFrame(rows, "i long, a array<int>").select("a", sums_before(F.col("a")).alias("s")).collect():
        assert list(x["s"]) == [0, *itertools.accumulate(x["a"])][: len(x["a"])]


def test_files_and_extractors(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("héllo")
    (tmp_path / "y.html").write_text("<title>t</title><body>b</body>")
    (tmp_path / "z.txt.gz").write_bytes(b"bogus")
    (tmp_path / "w.txt.gz").write_bytes(gzip.compress(b"packed"))
    found = files.read_files(spark, [str(tmp_path)])
    assert found.count() == 4 and files.read_files(spark, [str(tmp_path)], content=False).columns == ["path", "modificationTime", "length"]
    registry = files.Registry()
    mime = F.coalesce(U.mime_from_path(F.regexp_replace("path", r"\.gz$", "")), F.lit("none"))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in registry.extract(found.withColumn("mime_type", mime)).collect()}
    assert rows["x.txt"]["text"] == "héllo" and rows["y.html"]["title"] == "t" and rows["w.txt.gz"]["text"] == "packed"
    assert rows["z.txt.gz"]["error"] and rows["z.txt.gz"]["text"] is None

    def mine(content, path):
        if b"packed" in content:
            raise ValueError("no")
        return "mine", "", []

    registry.register("text/plain", mine)
    good, bad = files.split_failures(registry.extract(found.withColumn("mime_type", mime)))
    titles = {r["path"].rsplit("/", 1)[1]: r["title"] for r in good.collect()}
    assert titles["x.txt"] == "mine" and titles["w.txt.gz"] == "" and bad.count() == 1


def test_postings_by_bucket(spark, tmp_path):
    t = Tables(spark, SF)
    postings = t.postings().where("db_document_id < 20")
    files.write_postings(postings, str(tmp_path / "p"), buckets=8)
    words = spark.createDataFrame([("the",), ("und",)], "word string")
    got = files.read_postings(spark, str(tmp_path / "p"), words, buckets=8)
    assert sorted(got.select("db_document_id", "word").collect()) == sorted(postings.where("word in ('the', 'und')").select("db_document_id", "word").collect())


def test_tables_of_a_database(spark):
    """A table read through several connections by its key, filters pushed down."""
    url, driver = "jdbc:derby:memory:siftwell;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(1000).selectExpr("id AS db_document_id", "concat('w', id % 7) AS word").write.jdbc(url, "postings_of_peers", "overwrite", {"driver": driver})
    got = files.read_jdbc(spark, url, "postings_of_peers", key="db_document_id", parts=5, driver=driver)
    assert got.rdd.getNumPartitions() == 5 and got.count() == got.distinct().count() == 1000
    some = got.where("db_document_id = 77")
    assert "PushedFilters: [*IsNotNull" in some._jdf.queryExecution().toString() and some.first()["word"] == "w0"
    assert files.read_jdbc(spark, url, "postings_of_peers", driver=driver).count() == 1000


def test_popularity_by_replay(spark):
    log = Tables(spark, SF).download_log()
    doc, word, pair, out = Counter(), Counter(), Counter(), {}
    dev = lambda n: math.sqrt(-math.log(0.45) / (2 * n))
    for e in sorted(log.collect(), key=lambda e: (e["ts"], e["event_id"])):
        doc[e["db_document_id"]] += 1
        for w in e["words"]:
            word[w] += 1 / len(e["words"])
            pair[e["db_document_id"], w] += 1 / len(e["words"])
            p = pair[e["db_document_id"], w]
            out[e["db_document_id"], w] = (max(1e-6, p / word[w] - dev(word[w])), max(1e-6, p / doc[e["db_document_id"]] - dev(doc[e["db_document_id"]])))
    got = {(r["db_document_id"], r["word"]): (r["popularity"], r["relevance"]) for r in usage.popularity_relevance(log).collect()}
    assert got.keys() == out.keys()
    assert all(got[k] == pytest.approx(out[k]) for k in out)


def test_invariants(spark):
    t = Tables(spark, SF)
    assert t.postings().groupBy("db_document_id", "word").count().where("count > 1").isEmpty()
    interests = t.interests()
    assert interests.groupBy("node_id").agg(F.sum("specialisation").alias("s")).where("abs(s - 1) > 1e-9").isEmpty()
    assert interests.groupBy("word").agg(F.sum("expertise").alias("s")).where("abs(s - 1) > 1e-9").isEmpty()
    total = usage.word_claims(t.query_log()).agg(F.sum("claim_count")).first()[0]
    assert total == pytest.approx(t.query_log().where(F.size("words") > 0).count())


def test_search_cases(spark):
    postings = spark.createDataFrame([(1, "x", 0, 0.0, 0.5, 0.1), (1, "y", 2, 0.0, 0.2, 0.1), (2, "x", 0, 0.0, 0.5, 0.1), (2, "y", 1, 0.0, 0.2, 0.1), (3, "x", 0, 0.0, 0.9, 0.1)], "db_document_id long, word string, position int, download_count double, relevance double, popularity double")
    documents = spark.createDataFrame([(1, "a", "text/plain", 0), (2, "b", "text/html", 1), (3, "c", "text/plain", 1)], "db_document_id long, document_id string, mime_type string, state int").selectExpr("*", "'t' title", "1L size", "1L publication_time", "'u' url", "0.0D matching")
    ask = lambda *words: spark.createDataFrame([(1, list(words))], "query_id long, words array<string>")
    ids = lambda df: [r["db_document_id"] for r in df.orderBy("rank").collect()]
    assert ids(search.search_all_words(ask("x", "y"), postings, documents)) == [1, 2]
    assert ids(search.search_all_words(ask("x", "x"), postings, documents)) == [3, 1, 2]
    assert ids(search.search_all_words(ask("x", "absent"), postings, documents)) == []
    assert ids(search.search_all_words(ask("x"), postings, documents, private=False)) == [3, 2]
    assert ids(search.search_all_words(ask("x"), postings, documents, mime_type="text/html")) == [2]
    with pytest.raises(ValueError):
        search.search_all_words(ask("x"), postings, documents, order="title")


def scored(spark, rows):
    return spark.createDataFrame(rows, "db_document_id long, word string, relevance double, popularity double")


@pytest.mark.parametrize("order", ["relevance", "popularity", "publication_time"])
def test_search_in_blocks_by_brute_force(spark, monkeypatch, order):
    """Queries of one to four words over many small blocks, with ties, repeated and unknown words and shares of one query."""
    monkeypatch.setattr(blocks, "SHARE", 3)
    r = random.Random(5)
    docs = [(d, f"h{d}", r.choice(["text/plain", "text/html"]), "t", 1, r.randint(0, 20), r.choice([0, 1, 2]), f"u{d}") for d in range(400) if d % 7]
    posts = [(d, w, r.randint(0, 8) / 8, r.randint(0, 8) / 8) for d in range(400) for w in "abcdefgh" if r.random() < {"a": 0.9, "b": 0.7, "c": 0.5}.get(w, 0.15)]
    asked = [(q, [r.choice("abcdefgh") for _ in range(r.randint(1, 4))]) for q in range(60)] + [(60, ["a", "none"]), (61, []), (62, ["a", None]), (63, None)]
    queries = spark.createDataFrame(asked, "query_id long, words array<string>")
    documents = spark.createDataFrame(docs, "db_document_id long, document_id string, mime_type string, title string, size long, publication_time long, state int, url string")
    held = blocks.posting_blocks(scored(spark, posts), 16)
    monkeypatch.setattr(blocks.document_blocks, "__defaults__", (16,))
    got = defaultdict(list)
    for x in search.search_all_words(queries, None, documents, 10, "text/plain", private=False, order=order, blocks=held).collect():
        got[x["query_id"]].append((x["rank"], x["db_document_id"], x["relevance"], x["popularity"]))
    of = {(d, w): (rel, pop) for d, w, rel, pop in posts}
    want = {}
    for q, words in asked:
        words = words or []
        hits = []
        for d, _, mime, _, _, time, state, _ in docs:
            own = [of.get((d, w)) for w in set(words)]
            if own and None not in own and mime == "text/plain" and state:
                rel, pop = sum(x[0] for x in own), sum(x[1] for x in own)
                hits.append((-{"relevance": rel, "popularity": pop, "publication_time": time}[order], d, rel, pop))
        if hits:
            want[q] = [(k + 1, *h[1:]) for k, h in enumerate(sorted(hits)[:10])]
    assert {q: sorted(x) for q, x in got.items()} == want and len(want) > 40


def test_search_skips_blocks(spark):
    """With the best documents in few blocks, the others are not read, and the answer is the same."""
    posts = [(d, w, 1.0 / (1 + d // 64) + (d % 5) / 1000, 0.5) for d in range(64 * 40) for w in ("x", "y") if w == "x" or d % 3 == 0]
    held = blocks.posting_blocks(scored(spark, posts), 64)
    documents = spark.range(64 * 40).select(F.col("id").alias("db_document_id"), F.lit(1.0).alias("factor"), F.lit(0.0).alias("key"))
    heads = blocks.document_blocks(documents, F.col("factor"), F.col("key"), 64)
    queries = spark.createDataFrame([(1, ["x", "y"]), (2, ["x"]), (3, ["y", "x", "y"])], "query_id long, words array<string>")
    sets, _ = blocks.word_sets(queries)
    assert sets.count() == 2  # equal words are asked for once
    met = blocks.met_blocks(sets, held, heads, "relevance")
    assert met.count() == 80
    first = met.withColumn("nth", F.row_number().over(Window.partitionBy("set").orderBy(F.desc("bound"), "block"))).where("nth <= 2").drop("nth")
    found = blocks.answered(first, sets, held, heads, 30, "relevance")
    assert blocks.second_lot(met, first, found, 30, F.col("relevance")).count() == 0  # 76 of 80 blocks are never read
    assert blocks.second_lot(met, first, found, 60, F.col("relevance")).groupBy("set").count().count() == 1  # y is too rare for 60 in two blocks
    plan = blocks.answered(first, sets, held, heads, 30, "relevance")._jdf.queryExecution().toString()
    assert "explode(ids" not in plan  # no row for a posting
    best, of_query = blocks.all_words(queries, held, heads, "relevance", 60)
    for q, want in ((2, sorted(posts, key=lambda p: (-p[2] * (p[1] == "x"), p[0]))[:60]),):
        own = best.join(of_query, "set").where(F.col("query_id") == q).orderBy(F.desc("relevance"), "db_document_id").limit(60).collect()
        assert [r["db_document_id"] for r in own] == [p[0] for p in want]


def test_ranked_search_by_bounds(spark):
    """The bounds of scores hold for every query, and the answer is that of all postings."""
    t = Tables(spark, SF)
    documents = t.documents().withColumn("matching", (F.col("db_document_id") % 10) / F.lit(10.0))
    one = search.search_ranked(t.queries(), None, documents, 11, 5, blocks=blocks.posting_blocks(t.scored_postings(), blocks.BLOCK))
    words = search.query_words(t.queries())
    every = words.join(t.scored_postings(), "word").groupBy("query_id", "db_document_id").agg(F.count("*").alias("n"), F.first("n_words").alias("m"), F.sum((F.col("relevance") + 0.001) * (F.col("popularity") + 0.001)).alias("s"))
    every = every.where("n = m").join(documents.where("state in (0, 1, 2)").select("db_document_id", "matching"), "db_document_id")
    two = search.top_k(every.withColumn("score", F.col("s") * (F.col("matching") + 0.001)), ["query_id"], 5, F.desc(F.round("score", 12)), F.asc("db_document_id"))
    key = lambda df: sorted((r["query_id"], r["rank"], r["db_document_id"]) for r in df.collect())
    assert key(one) == key(two)


def test_tokens_of_blocks():
    r = random.Random(6)
    texts = [None, "", "a", "ab c 9_ straße", "x" * 120, "x" * 101, "日本 abécd " * 3, *("".join(r.choice("ab _é-9") for _ in range(r.randint(0, 40))) for _ in range(200))]
    column = pa.array(["skipped", *texts, "skipped"]).slice(1, len(texts))
    got = defaultdict(list)
    for start, data, at in tokens.blocks(column):
        found = tokens.tokens(data, at)
        firsts = set(tokens.first_of_each(found).tolist())
        for i, (word, text, nth, position) in enumerate(zip(found.words.to_pylist(), found.text, found.nth, found.position, strict=True)):
            got[start + int(text)].append((int(nth), word, int(position), i in firsts))
    for k, text in enumerate(texts):
        want = [(n, m[0], m.start()) for n, m in enumerate(re.finditer(r"\w{2,50}", text or "", re.A))]
        assert [x[:3] for x in got[k]] == want
        assert [x[1] for x in got[k] if x[3]] == list(dict.fromkeys(m[1] for m in want))


def test_presence_cases(spark):
    def who(lines, now="2024-01-01 01:00:00"):
        rows = [(f"2024-01-01 00:00:{k:02d}", k, *line) for k, line in enumerate(lines)]
        log = spark.createDataFrame(rows, "ts string, event_id int, action string, node_id string, ip string, port int, bandwidth int").withColumn("ts", F.to_timestamp("ts"))
        return [r["node_id"] for r in peers.presence_registry(log, F.lit(now).cast("timestamp")).orderBy(F.desc("last_seen")).collect()]

    a, b = ("notify", "A", "1.2.3.4", 5678, 9), ("notify", "B", "1.2.3.4", 567, 8)
    assert who([a, b]) == ["B", "A"]
    assert who([a, b, ("logout", "A", None, None, None)]) == ["B"]
    assert who([a, b], "2024-01-03 00:00:00") == []
    assert who([a, a, ("notify", "A", "9.9.9.9", 1, 1)]) == ["A"]
    assert who([a, ("notify", "C", "1.2.3.4", 5678, 1)]) == ["C"]


def test_weighted_pick_frequencies(spark):
    scores = spark.createDataFrame([(q, n, s) for q in range(2000) for n, s in (("a", 1.0), ("b", 3.0), ("c", 0.0))], "query_id long, node_id string, score double")
    first = Counter(r["node_id"] for r in peers.weighted_pick(scores, 1, 5).collect())
    assert 0.7 < first["b"] / 2000 < 0.8 and first["c"] == 0
    assert sorted(peers.weighted_pick(scores, 1, 5).collect()) == sorted(peers.weighted_pick(scores.repartition(7), 1, 5).collect())


def test_routing_leaves_out(spark):
    t = Tables(spark, SF)
    routes = peers.route_queries(t.queries().select("query_id", "sender"), spark.createDataFrame([], "query_id long, node_id string, score double"), t.nodes(), "none", 3)
    joined = routes.join(t.queries(), "query_id")
    assert joined.where("node_id = sender").isEmpty()
    assert routes.groupBy("query_id", "node_id").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("n", [5, 40, 1000])
def test_routing_reaches_every_node(spark, n):
    nodes = spark.range(n).select(F.concat(F.lit("n"), "id").alias("node_id"))
    queries = spark.range(3000).select(F.col("id").alias("query_id"), F.lit("n1").alias("sender"))
    scores = queries.select("query_id", F.explode(F.array(F.lit("n2"), F.lit("n3"), F.lit("n1"))).alias("node_id"), F.lit(1.0).alias("score"))
    routes = peers.route_queries(queries, scores, nodes, "n0", 3)
    per = routes.groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("d"), F.count_if(F.col("kind") == "weighted").alias("w")).collect()
    assert {(r["n"], r["d"], r["w"]) for r in per} == {(min(8, n - 2), min(8, n - 2), 2)}
    seen = Counter(r["node_id"] for r in routes.where("kind = 'random'").collect())
    assert set(seen) == {f"n{k}" for k in range(4, n)}
    if n == 1000:  # as likely each
        assert min(seen.values()) > 2 and max(seen.values()) < 50


def test_route_scores_by_brute_force(spark, monkeypatch):
    """Tries in several blocks and shares give the sums over all pairs of words, and no pair is a row."""
    r = random.Random(12)
    words = ["".join(r.choice("abé") for _ in range(r.randint(0, 6))) for _ in range(60)] + ["x" * 40]
    interests = [(f"n{k}", w, r.random(), r.random()) for k in range(9) for w in sorted({r.choice(words) for _ in range(12)})]
    nodes = [(f"n{k}", k / 10) for k in range(9)]
    queries = [(q, [r.choice(words) for _ in range(r.randint(0, 4))]) for q in range(50)] + [(99, ["zz", None])]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = [i + 1] + [0] * len(b) if not b else functools.reduce(lambda new, j: [*new, min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != b[j]))], range(len(b)), [i + 1])
        return row[-1]

    weight = dict(nodes)
    chosen = {n for n, _ in sorted(nodes, key=lambda x: -x[1])[:5]}
    want = defaultdict(float)
    for q, ws in queries:
        for w in ws:
            for n, i, s, e in interests:
                if w is not None and n in chosen:
                    want[(q, n)] += s * e * weight[n] / 2 ** edits(w, i)
    args = spark.createDataFrame(queries, "query_id long, words array<string>"), spark.createDataFrame(nodes, "node_id string, affinity double"), spark.createDataFrame(interests, "node_id string, word string, specialisation double, expertise double")
    for size, share in ((4096, 4096), (7, 5)):
        monkeypatch.setattr(peers, "WORDS", size)
        monkeypatch.setattr(peers, "SHARE", share)
        scores = peers.route_scores(*args, best=5)
        got = {(x["query_id"], x["node_id"]): x["score"] for x in scores.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
        plan = scores._jdf.queryExecution().toString()
        assert "levenshtein" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_tries_by_brute_force(spark):
    r = random.Random(13)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(0, 7))) for _ in range(200)})
    asked = ["".join(r.choice("abcd") for _ in range(r.randint(0, 9))) for _ in range(100)]
    pairs = spark.createDataFrame([(a, w) for a in asked for w in words], "a string, w string").select("a", "w", F.levenshtein("a", "w").alias("d")).distinct()
    want = {(x["a"], x["w"]): x["d"] for x in pairs.collect()}
    trie = tries.Trie(words)
    seen = set()
    for places, distances in trie.distances(asked):
        for k, row in zip(places, distances, strict=True):
            seen.add(k)
            assert row.tolist() == [want[(asked[k], w)] for w in words]
    assert seen == set(range(100))
    assert sum(len(x[0]) for x in trie.levels) == len({w[:k] for w in words for k in range(1, len(w) + 1)})  # a node for each prefix


def test_draws_from_lists_are_those_from_rows(spark):
    """Lists of scores give the draws and routes of rows; no row is made of a query and a node, and nothing is broadcast but the nodes' names."""
    r = random.Random(3)
    names = [f"n{k}" for k in range(20)]
    lists = spark.createDataFrame([(q, names, [r.choice([0.0, r.random()]) for _ in names]) for q in range(200)], "query_id long, node_ids array<string>, scores array<double>")
    rows = lists.select("query_id", F.explode(F.arrays_zip("node_ids", "scores")).alias("s")).select("query_id", F.col("s.node_ids").alias("node_id"), F.col("s.scores").alias("score"))
    want = sorted((x["query_id"], x["place"], x["node_id"]) for x in peers.weighted_pick(rows, 4, 7).collect())
    got = peers.weighted_pick_lists(lists, 4, 7).select("query_id", F.posexplode("picked").alias("at", "p")).collect()
    assert sorted((x["query_id"], x["at"] + 1, x["p"]["node_id"]) for x in got) == want
    queries = lists.select("query_id", F.when(F.col("query_id") % 5 != 0, F.concat(F.lit("n"), F.col("query_id") % 20)).alias("sender"))
    nodes = spark.createDataFrame([(x,) for x in names], "node_id string")
    routes = [sorted(map(tuple, peers.route_queries(queries, x, nodes, "n3", 7).collect())) for x in (rows, lists)]
    assert routes[0] == routes[1] and len(routes[0]) > 1500


def test_affinities_of_heavy_words(spark):
    r = random.Random(14)
    rows = [(f"n{k}", w, r.random(), r.random()) for k in range(60) for w in "abcdef" if w == "a" or r.random() < 0.3]
    interests = spark.createDataFrame(rows, "node_id string, word string, specialisation double, expertise double")
    left, right = interests.select(F.col("node_id").alias("me"), "word", "specialisation"), interests.select(F.col("node_id").alias("other"), "word", "expertise")
    want = defaultdict(float)
    for n, w, s, _ in rows:
        for m, v, _, e in rows:
            if w == v:
                want[(n, m)] += s * e
    for chunk in (4096, 7):
        got = {(x["me"], x["other"]): x["affinity"] for x in usage.all_affinities(left, right, chunk).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_affinities_are_no_shuffled_pairs(spark):
    """Of 300 nodes with one word in common all 90,000 pairs are found, and no shuffle is by pairs."""
    rows = spark.range(300).select(F.concat(F.lit("n"), "id").alias("node"), F.lit("a").alias("word"), F.lit(0.5).alias("x"))
    found = usage.all_affinities(rows.select(F.col("node").alias("me"), "word", F.col("x").alias("specialisation")), rows.select(F.col("node").alias("other"), "word", F.col("x").alias("expertise")), 70)
    assert not re.search(r"hashpartitioning\((me|other|node)#", found._jdf.queryExecution().executedPlan().toString())
    assert found.agg(F.count("*"), F.countDistinct("me", "other"), F.min("affinity"), F.max("affinity")).first() == (90_000, 90_000, 0.25, 0.25)
    none = rows.limit(0).select(F.col("node").alias("other"), "word", F.col("x").alias("expertise"))
    assert usage.all_affinities(rows.select(F.col("node").alias("me"), "word", F.col("x").alias("specialisation")), none).isEmpty()


def test_assigned_ids_have_no_gap(spark):
    known = spark.createDataFrame([(7,), (3,)], "db_document_id long")
    new = spark.createDataFrame([(f"k{i:03d}",) for i in range(300)], "document_id string")
    got = index.assign_document_ids(known, new, "document_id").orderBy("document_id").collect()
    assert [r["db_document_id"] for r in got] == list(range(8, 308))


def test_assigned_ids_of_wide_tables(spark):
    """Many rows of three columns: what is counted is what is numbered."""
    known = spark.createDataFrame([(5,)], "db_document_id long")
    new = spark.range(500_000).select(F.sha1(F.col("id").cast("string")).alias("document_id"), F.col("id").alias("extra"), F.repeat(F.lit("text "), (F.col("id") % 9).cast("int")).alias("text")).repartition(7)
    got = index.assign_document_ids(known, new, "document_id")
    assert got.columns == ["document_id", "extra", "text", "db_document_id"]
    total = got.agg(F.count("*"), F.countDistinct("db_document_id"), F.min("db_document_id"), F.max("db_document_id")).first()
    assert tuple(total) == (500_000, 500_000, 6, 500_005)
    order = got.withColumn("before", F.lag("db_document_id").over(Window.partitionBy(F.substring("document_id", 1, 2)).orderBy("document_id")))
    assert order.where("before is not null and db_document_id != before + 1").isEmpty()
    plan = got._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan.split("== Physical Plan ==")[1].lower()  # numbered as it was written


@pytest.mark.parametrize("n", [1, 2, 5, 17, 100, 1000, 5000])
def test_permutation_is_one_to_one(spark, n):
    got = spark.range(n).select(peers.permuted(F.col("id"), n, F.lit(3), F.lit("q")).alias("x"), peers.permuted(F.col("id"), n, F.lit(4), F.lit("q")).alias("y")).collect()
    assert sorted(r["x"] for r in got) == sorted(r["y"] for r in got) == list(range(n))
    assert n < 17 or [r["x"] for r in got] != [r["y"] for r in got]


@pytest.mark.parametrize(("n", "fanout"), [(1000, 200), (66, 60), (66, 64), (50, 80)])
def test_routing_of_any_fanout(spark, n, fanout):
    nodes = spark.range(n).select(F.concat(F.lit("n"), "id").alias("node_id"))
    queries = spark.range(20).select(F.col("id").alias("query_id"), F.lit("n1").alias("sender"))
    scores = queries.select("query_id", F.explode(F.array(F.lit("n2"), F.lit("n3"), F.lit("n0"))).alias("node_id"), F.lit(1.0).alias("score"))
    routes = peers.route_queries(queries, scores, nodes, "n0", 3, fanout).groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("d")).collect()
    assert {(r["n"], r["d"]) for r in routes} == {(min(fanout, n - 2),) * 2} and len(routes) == 20


def test_random_draws_are_even(spark):
    """Of 10 nodes each is the first, second or third draw of a query as often as the others."""
    nodes = spark.range(10).select(F.concat(F.lit("n"), "id").alias("node_id"))
    got = Counter((r["node_id"], r["draw"]) for r in peers.random_draws(spark.range(5000).select(F.col("id").alias("query_id")), nodes, 3, 1).collect())
    assert len(got) == 30 and all(400 < k < 600 for k in got.values())


def stream_of(spark, tmp_path, df, name):
    path = str(tmp_path / name)
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drained(stream, mode, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.sql(f"SELECT * FROM {name}")


def test_query_stream_dedupes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (2, "2024-01-01 00:00:02")], "query_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = drained(jobs.dedupe_queries_stream(stream_of(spark, tmp_path, rows, "q")), "append", "dq")
    assert sorted(r["query_id"] for r in got.collect()) == [1, 2]


def test_result_stream_drops_unknown_queries(spark, tmp_path):
    answers = spark.createDataFrame([(1, "d", "2024-01-01 00:00:05"), (1, "d", "2024-01-01 00:00:06"), (9, "d", "2024-01-01 00:00:05")], "query_id long, document_id string, record_ts string").withColumn("record_ts", F.to_timestamp("record_ts"))
    queries = spark.createDataFrame([(1, "2024-01-01 00:00:00")], "query_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = drained(jobs.merge_results_stream(stream_of(spark, tmp_path, answers, "a"), stream_of(spark, tmp_path, queries, "b")), "append", "mr")
    assert [(r["query_id"], r["document_id"]) for r in got.collect()] == [(1, "d")]


def test_answers_meet_queries_of_their_time_alone(spark, tmp_path):
    """Answers of up to an hour later are found across the slots of time that the join is dealt out by."""
    at = lambda text: F.to_timestamp(F.concat(F.lit("2024-01-01 "), F.col(text)))
    times = ["00:59:59", "01:00:00", "01:30:00", "01:59:59", "02:00:00", "02:29:59", "02:30:00", "02:30:01", "03:00:00"]
    answers = spark.createDataFrame([(1, f"d{t}", t) for t in times], "query_id long, document_id string, record_ts string").withColumn("record_ts", at("record_ts"))
    queries = spark.createDataFrame([(1, "01:00:00"), (1, "01:30:00"), (1, None), (2, "01:30:00")], "query_id long, ts string").withColumn("ts", at("ts"))
    found = jobs.merge_results_stream(stream_of(spark, tmp_path, answers, "a"), stream_of(spark, tmp_path, queries, "b"))
    keys = found._jdf.queryExecution().analyzed().toString().split("Join Inner")[1].splitlines()[0]
    assert "slot answered" in keys and "slot asked" in keys
    got = drained(found, "append", "slots")
    assert got.columns == ["query_id", "document_id", "record_ts", "asked_at"]
    want = [(f"d{t}", q) for q, last in (("01:00:00", "02:00:00"), ("01:30:00", "02:30:00")) for t in times if q <= t <= last]
    assert sorted((r["document_id"], f"{r['asked_at']:%H:%M:%S}") for r in got.collect()) == sorted(want)


def test_usage_stream_equals_batch(spark, tmp_path):
    log = Tables(spark, SF).query_log().select("node_id", "words")
    got = drained(jobs.usage_stats_stream(stream_of(spark, tmp_path, log, "u")), "complete", "us")
    want = {r["word"]: r["claim_count"] for r in usage.word_claims(log).collect()}
    have = defaultdict(float, {r["word"]: r["claim_count"] for r in got.collect()})
    assert have.keys() == want.keys() and all(have[w] == pytest.approx(want[w]) for w in want)


def in_batches(spark, tmp_path, tables, name):
    """A stream that meets one table after the other, a batch each."""
    path = tmp_path / name
    for k, df in enumerate(tables):
        df.coalesce(1).write.mode("append").parquet(str(path))
        for f in path.glob("part-*"):
            if not f.name.startswith("part-0000-batch"):
                f.rename(path / f"part-0000-batch{k}.parquet")
                os.utime(path / f"part-0000-batch{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(tables[0].schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def batched(spark, tmp_path, tables, make, name):
    """What a stream has appended after each of the batches; it is started anew for each."""
    out = []
    for k, df in enumerate(tables):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}-in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / f"{name}-in"))
        out.append(runs.through(make(stream), str(tmp_path), name).collect())
    return out


HITS = "query_id long, document_id string, relevance double, record_ts timestamp"


def moment(text):
    return datetime.datetime.fromisoformat(f"2024-01-01 {text}")


def test_spool_sends_the_best_and_expires(spark, tmp_path):
    at = lambda s: moment("00:00:00") + datetime.timedelta(seconds=s)
    batches = [
        [(1, "a", 1.0, at(0)), (1, "b", 5.0, at(1)), (1, "c", 4.0, at(1.5)), (1, "d", 3.0, at(1.9)), (2, "z", 1.0, at(0)), (2, "z", 9.0, at(1))],
        [(2, "y", 2.0, at(10)), (2, "z", 3.0, at(11)), (1, "e", 9.0, at(12))],
        [(2, "x", 5.0, at(30)), (2, "w", 1.0, at(39.9)), (2, "v", 8.0, at(40)), (1, "f", 2.0, at(47))],
        [(3, "end", 1.0, at(200))],
        [(4, "end", 1.0, at(400))],
    ]
    tables = [spark.createDataFrame(b, HITS) for b in batches]
    got = batched(spark, tmp_path, tables, lambda s: jobs.flush_spool_stream(s, 3), "sent")
    sent = {(r["query_id"], r["document_id"], r["relevance"], r["sent_ms"] - 1_704_067_200_000) for r in got[-1]}
    # three of a query go, the best of each two seconds first; a document goes once in a spool, by its first arrival;
    # after 40 seconds a query's next hit opens a new spool
    want = {("1", "b", 5.0, 2000), ("1", "c", 4.0, 2000), ("1", "d", 3.0, 2000), ("2", "z", 1.0, 2000), ("2", "y", 2.0, 12000), ("2", "x", 5.0, 32000), ("2", "v", 8.0, 42000), ("1", "f", 2.0, 49000), ("3", "end", 1.0, 202000)}
    assert sent == want and len(got[-1]) == len(want)
    assert len(got[1]) < len(got[2]) < len(got[3])


def test_spool_does_not_depend_on_batches(spark, tmp_path):
    r = random.Random(2)
    hits = sorted(((r.randint(1, 5), f"d{r.randint(0, 30)}", r.randint(0, 9) / 2, moment("00:00:00") + datetime.timedelta(milliseconds=r.randint(0, 300_000))) for _ in range(400)), key=lambda x: x[3])
    hits.append((9, "end", 0.0, moment("01:00:00")))
    whole = batched(spark, tmp_path, [spark.createDataFrame(hits, HITS)], lambda s: jobs.flush_spool_stream(s, 4), "one")[-1]
    parts = batched(spark, tmp_path, [spark.createDataFrame(hits[k : k + 101], HITS) for k in range(0, 401, 101)], lambda s: jobs.flush_spool_stream(s, 4), "many")[-1]
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and len(whole) > 40


LOG = "node_id string, action string, ip string, port int, ts timestamp, event_id long"


def presence(spark, tmp_path, batches, name):
    """(node, address) present after each batch."""
    changes, owners, out = f"{name}-changes", f"{name}-owners", []
    for b in batches:
        spark.createDataFrame(b, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}-in"))
        stream = spark.readStream.schema(LOG).parquet(str(tmp_path / f"{name}-in"))
        rows = runs.through(jobs.presence_stream(stream), str(tmp_path), changes)
        found = runs.through(jobs.owner_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / changes))), str(tmp_path), owners)
        out.append({(r["node_id"], r["ip"]) for r in jobs.present_nodes(found).collect()})
    return out


def test_presence_with_logout_takeover_and_expiry(spark, tmp_path):
    at = moment
    batches = [
        [("A", "notify", "1.1.1.1", 5, at("00:00:00"), 1), ("B", "notify", "1.1.1.2", 5, at("00:00:01"), 2)],
        [("A", "logout", None, None, at("00:00:02"), 3)],  # names no address
        [("A", "notify", "1.1.1.1", 5, at("00:00:03"), 4), ("C", "notify", "1.1.1.1", 5, at("00:00:05"), 5), ("B", "notify", "9.9.9.9", 5, at("00:00:00"), 0)],
        [("A", "notify", "1.1.1.3", 5, at("00:00:09"), 6), ("B", "logout", None, None, at("00:00:10"), 7), ("D", "logout", None, None, at("00:00:10"), 8)],
        [("C", "logout", None, None, at("00:00:11"), 9), ("E", "notify", "1.1.1.3", 5, at("00:00:11"), 11), ("A", "logout", None, None, at("00:00:11"), 12)],
        [("F", "notify", "2.2.2.2", 5, datetime.datetime(2024, 1, 3), 13)],
        [("F", "notify", "2.2.2.2", 5, datetime.datetime(2024, 1, 3, 1), 14)],
    ]
    got = presence(spark, tmp_path, batches, "p")
    assert got[:5] == [{("A", "1.1.1.1"), ("B", "1.1.1.2")}, {("B", "1.1.1.2")}, {("C", "1.1.1.1"), ("B", "1.1.1.2")}, {("C", "1.1.1.1"), ("A", "1.1.1.3")}, {("E", "1.1.1.3")}]
    assert got[6] == {("F", "2.2.2.2")}  # E was silent for 24 hours


def test_nodes_that_came_and_stayed(spark, tmp_path):
    rows = [("A", "notify", "1.1.1.1", 5, moment("00:00:00"), 1), ("B", "notify", "1.1.1.2", 5, moment("00:00:01"), 2), ("A", "notify", "1.1.1.3", 5, moment("00:00:09"), 6), ("B", "logout", None, None, moment("00:00:10"), 7), ("C", "notify", None, 5, moment("00:00:10"), 8), ("D", "logout", None, None, moment("00:00:10"), 9)]
    changes = batched(spark, tmp_path, [spark.createDataFrame(rows[:2], LOG), spark.createDataFrame(rows[2:], LOG)], jobs.presence_stream, "c")[-1]
    assert sorted((r["node_id"], r["change"], r["ip"]) for r in changes) == [("A", "join", "1.1.1.1"), ("A", "join", "1.1.1.3"), ("A", "leave", "1.1.1.1"), ("B", "join", "1.1.1.2"), ("B", "leave", "1.1.1.2")]
    assert [tuple(r)[:3] for r in jobs.joined_nodes(spark.createDataFrame(changes)).collect()] == [("A", "1.1.1.3", 5)]


def test_presence_of_equal_times(spark, tmp_path):
    """Of two rows of one moment the greater event_id is the newer, in whatever batches they come."""
    one, two = ("A", "notify", "1.1.1.1", 5, moment("00:00:00"), 2), ("A", "notify", "1.1.1.2", 5, moment("00:00:00"), 1)
    assert presence(spark, tmp_path, [[one], [two]], "x")[-1] == presence(spark, tmp_path, [[two], [one]], "y")[-1] == presence(spark, tmp_path, [[one, two]], "z")[-1] == {("A", "1.1.1.1")}


def test_incremental_index(spark, tmp_path):
    schema = "file_name string, file_time long, state int, db_document_id long, title string, text string"
    batches = [[("/a", 10, 1, 1, "t", "red fox"), ("/b", 10, 1, 2, "t", "owl")], [("/a", 20, 1, 1, "t", "fox den"), ("/b", 5, 1, 2, "t", "changed but older"), ("/c", 1, 1, 3, "t", "new file")]]
    tables = [spark.createDataFrame(b, schema) for b in batches]
    place = str(tmp_path / "index")
    runs.drained(jobs.incremental_index_stream(in_batches(spark, tmp_path, tables, "f"), place), place)
    got = sorted((r["db_document_id"], r["word"], r["position"]) for r in jobs.current_postings(spark, place).collect())
    assert got == sorted([(1, "fox", 2), (1, "den", 6), (2, "owl", 2), (3, "new", 2), (3, "file", 6)])


def test_incremental_index_keeps_lists_and_scores(spark, tmp_path):
    """A document is one stored row; a changed one keeps the scores of words that it still has, others keep theirs; equal rows and ids count once."""
    schema = "file_name string, file_time long, state int, db_document_id long, title string, text string"
    place = str(tmp_path / "index")

    def index_rows(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        runs.drained(jobs.incremental_index_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), place), place)

    index_rows([("/a", 1, 1, 1, "t", "red fox"), ("/a", 1, 1, 1, "t", "red fox"), ("/b", 1, 1, 2, "t", "owl"), ("/c", 1, 1, 3, "t", "hen"), ("/d", 1, 1, 3, "t", "hen")])
    assert sorted(r["db_document_id"] for r in jobs.posting_buckets(place).read(spark).collect()) == [1, 2, 3]
    score = lambda w: F.struct(F.lit(w).alias("word"), *(F.lit(k).alias(c) for k, c in ((1.0, "download_count"), (2.0, "relevance"), (3.0, "popularity"))))
    scored = jobs.posting_buckets(place).read(spark).withColumn("scored", F.when(F.col("db_document_id") == 1, F.array(score("red"), score("fox"))).when(F.col("db_document_id") == 2, F.array(score("owl"))))
    jobs.posting_buckets(place).aside(scored, 7)
    jobs.posting_buckets(place).lay_over(spark, 7)
    index_rows([("/a", 2, 1, 1, "t", "fox den"), ("/b", 1, 1, 2, "t", "not newer")])
    got = {(r["db_document_id"], r["word"]): (r["position"], r["download_count"], r["relevance"], r["popularity"]) for r in jobs.current_postings(spark, place).collect()}
    assert got == {(1, "fox"): (2, 1.0, 2.0, 3.0), (1, "den"): (6, 0.0, 0.0, 0.0), (2, "owl"): (2, 1.0, 2.0, 3.0), (3, "hen"): (2, 0.0, 0.0, 0.0)}


def test_incremental_index_touches_few_buckets(spark, tmp_path):
    """Ten batches leave one version of each posting, and a batch of new documents leaves old buckets as they are."""
    schema = "file_name string, file_time long, state int, db_document_id long, title string, text string"
    rows = [[(f"/{k}", 1, 1, k, "t", f"word{k} common") for k in range(10 * b, 10 * b + 10)] for b in range(9)] + [[("/5", 2, 1, 5, "t", "fresh common"), *((f"/{k}", 1, 1, k, "t", "same time") for k in range(20, 30))]]
    place, seen = str(tmp_path / "index"), []
    for b in rows:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        runs.drained(jobs.incremental_index_stream(stream, place, 10), place)
        seen.append({f.parent.name: f.name for f in (tmp_path / "index" / "postings").glob("bucket=*/part-*")})
    for k in range(1, 9):
        assert all(seen[k][bucket] == f for bucket, f in seen[k - 1].items())  # only a new bucket came
    assert {b for b in seen[8] if seen[9][b] != seen[8][b]} == {"bucket=0"}
    got = sorted((r["db_document_id"], r["word"]) for r in jobs.current_postings(spark, place).collect())
    assert got == sorted([(k, w) for k in range(90) for w in (f"word{k}", "common") if k != 5] + [(5, "fresh"), (5, "common")])


def test_incremental_index_of_a_batch_tried_again(spark, tmp_path):
    """A batch that stopped after its postings were laid over gives the same when it comes once more."""
    schema = "file_name string, file_time long, state int, db_document_id long, title string, text string"
    place = str(tmp_path / "index")
    spark.createDataFrame([("/a", 1, 1, 1, "t", "red fox"), ("/b", 1, 1, 2, "t", "owl")], schema).write.parquet(str(tmp_path / "in"))
    real = jobs.Buckets.lay_over

    def stopping(self, spark, batch_id):
        if self.path.endswith("files"):
            raise RuntimeError("stopped")
        real(self, spark, batch_id)

    stream = lambda: jobs.incremental_index_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), place)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(jobs.Buckets, "lay_over", stopping)
        with pytest.raises(Exception, match="stopped"):
            runs.drained(stream(), place)
    runs.drained(stream(), place)
    assert sorted((r["db_document_id"], r["word"]) for r in jobs.current_postings(spark, place).collect()) == [(1, "fox"), (1, "red"), (2, "owl")]


def test_excerpts_of_every_scored_word(spark, monkeypatch):
    """Excerpts through texts that are read once, with a document in several shares, as the column functions give them."""
    from siftwell.operators import snippets

    monkeypatch.setattr(snippets, "SHARE", 5)
    r = random.Random(8)
    texts = {d: " ".join("".join(r.choice("abc<>") for _ in range(r.randint(1, 12))) for _ in range(r.randint(0, 120))) for d in range(6)}
    docs = spark.createDataFrame([*texts.items(), (9, None)], "db_document_id long, text string")
    rows = [(q, d, r.randint(0, max(0, len(texts[d]) - 1))) for q in range(40) for d in range(6)] + [(1, 7, 3), (1, 9, 3)]
    hits = spark.createDataFrame(rows, "query_id long, db_document_id long, position int")
    got = sorted((x["query_id"], x["db_document_id"], x["position"], x["excerpt"] or "") for x in snippets.excerpts_at(hits, docs).collect())
    want = hits.join(docs, "db_document_id", "left").select("query_id", "db_document_id", "position", F.coalesce(E.excerpt_at(F.col("text"), F.col("position")), F.lit("")))
    assert got == sorted(map(tuple, want.collect()))
    both = hits.groupBy("query_id", "db_document_id").agg(F.collect_list("position").alias("places")).unionByName(spark.createDataFrame([(50, 0, list(range(0, 60, 7)))], "query_id long, db_document_id long, places array<int>"))
    got = sorted((x["query_id"], x["db_document_id"], x["excerpt"] or "") for x in snippets.merged_excerpts(both, docs).collect())
    want = both.join(docs, "db_document_id", "left").select("query_id", "db_document_id", F.coalesce(E.merge_excerpts(F.col("text"), F.col("places")), F.lit("")))
    assert got == sorted(map(tuple, want.collect()))
    asked = spark.createDataFrame([(q, d, ["ab", "c"] if q % 2 else ["b", ""]) for q in range(20) for d in range(6)] + [(30, 0, None)], "query_id long, db_document_id long, words array<string>")
    for x in snippets.abstracts(asked, docs).collect():
        assert x["abstract"] == E.abstract(texts[x["db_document_id"]], [w for w in x["words"] or [] if w])
    plan = snippets.excerpts_at(hits, docs)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Python" not in plan.split("MapInArrow")[0] and "text#" not in plan.split("MapInArrow")[0]  # only snippets go on


def test_patches_by_brute_force(spark):
    r = random.Random(9)
    rows, known, want = [], [], {}
    for d in range(40):
        text = None if d % 5 == 0 else "".join(r.choice("xyz") for _ in range(r.randint(0, 30)))
        own = [(r.randint(0, 50), "".join(r.choice("ABCDE") for _ in range(r.randint(0, 15)))) for _ in range(r.randint(1, 12))]
        rows += [(d, p, x) for p, x in own]
        known += [(d, text)] if d % 7 else []
        out = list((text if d % 7 else None) or "")
        for p, x in sorted(own):
            out += [" "] * (p + len(x) - len(out))
            out[p : p + len(x)] = x
        want[d] = "".join(out)
    rows += [(0, None, "q"), (0, 3, None), (0, -1, "q")]
    got = index.patch_sparse_text(spark.createDataFrame(rows, "db_document_id long, position int, excerpt string"), spark.createDataFrame(known, "db_document_id long, text string"))
    assert {x["db_document_id"]: x["text"] for x in got.collect()} == want


def test_snippets_of_sets_are_those_of_their_queries(spark, monkeypatch):
    """What is made once for a set of words is what each of its queries had; many queries of a set are dealt out in pieces."""
    texts = spark.createDataFrame([(1, "the cat sat on the mat " * 9), (2, "a dog " + "x" * 120 + " cat"), (3, None)], "db_document_id long, text string")
    wants = spark.createDataFrame([(7, ["cat", "mat"], [1, 2, 3]), (8, ["dog", "zz", "x" * 50], [2])], "set long, words array<string>, db_document_ids array<long>")
    positions = {(r["db_document_id"], r["word"]): r["position"] for r in index.build_postings(texts.withColumn("title", F.lit("a"))).collect()}
    texts = texts.select("db_document_id", T.normalize_text(T.index_text(F.lit("a"), F.col("text"))).alias("text"))
    body = {r["db_document_id"]: r["text"] for r in texts.collect()}
    want = {(s, d, w, E.excerpt_of(body[d], positions[(d, w)])) for s, ws, ds in map(tuple, wants.collect()) for d in ds for w in ws if (d, w) in positions}
    monkeypatch.setattr(snippets, "SHARE", 1)
    assert {tuple(r) for r in snippets.word_excerpts(wants, texts).collect()} == want and len(want) == 5
    assert {(r[0], r[1]) for r in snippets.set_abstracts(wants, texts).collect()} == {(7, 1), (7, 2), (7, 3), (8, 2)}
    monkeypatch.setattr(blocks, "PIECE", 10)
    of_query = spark.range(100).select(F.col("id").alias("query_id"), F.when(F.col("id") < 95, 7).otherwise(8).cast("long").alias("set"))
    got = search.rows_of_queries(spark.createDataFrame([(7, "a"), (7, "b"), (8, "c")], "set long, v string"), of_query).collect()
    assert sorted(map(tuple, got)) == sorted([(q, v) for q in range(95) for v in "ab"] + [(q, "c") for q in range(95, 100)])


def test_patches_of_a_large_document_are_quick(spark):
    rows = spark.range(100_000).select(F.lit(1).cast("long").alias("db_document_id"), (F.col("id") * 7).cast("int").alias("position"), F.lit("word sat").alias("excerpt"))
    began = time.time()
    text = index.patch_sparse_text(rows, spark.createDataFrame([(1, "k" * 1_000_000)], "db_document_id long, text string")).first()["text"]
    assert text == "word sa" * 99_999 + "word sat" + "k" * (1_000_000 - 700_001) and time.time() - began < 30


def test_upserts_of_repeated_and_null_keys(spark):
    schema = "k string, v int"
    got = index.upsert(spark.createDataFrame([("a", 1), (None, 2), ("c", 9)], schema), spark.createDataFrame([("a", 3), ("a", 4), (None, 5), ("d", None)], schema), ["k"])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("a", 4), (None, 5), ("c", 9), ("d", None)]))
    docs = "document_id string, mime_type string, title string, size long, publication_time long, url string"
    known = spark.createDataFrame([("x", "m", "t", 1, 1, "u", 4), (None, "m", "t", 1, 1, "u", 4)], docs + ", state int")
    peers_rows = spark.createDataFrame([("x", "m2", "t2", 2, 2, "u2"), ("x", "m3", "t3", 3, 3, "u3"), (None, "m4", "t4", 4, 4, "u4"), ("y", "m5", "t5", 5, 5, "u5")], docs)
    assert {(r["document_id"], r["title"]) for r in index.merge_known_document(known, peers_rows).collect()} == {("x", "t3"), (None, "t4"), ("y", "t5")}
    posts = spark.createDataFrame([(1, "a", 5, 1.0, 1.0, 1.0), (1, None, 6, 1.0, 1.0, 1.0)], "db_document_id long, word string, position int, download_count double, relevance double, popularity double")
    fresh = spark.createDataFrame([(1, "a", 7), (1, "a", 8), (1, None, 9), (2, "b", 1)], "db_document_id long, word string, position int")
    assert sorted((r[0], r[1] or "", r[2], r[4]) for r in index.merge_postings(posts, fresh).collect()) == [(1, "", 9, 1.0), (1, "a", 8, 1.0), (2, "b", 1, 0.0)]
    scores = spark.createDataFrame([(1, "a", 0.1, 0.2), (1, "a", 0.3, 0.1), (1, None, 0.4, 0.4)], "db_document_id long, word string, relevance double, popularity double")
    got = index.merge_known_scores(posts, scores, spark.createDataFrame([(1, 4)], "db_document_id long, state int"))
    assert sorted((r["word"] or "", r["relevance"], r["popularity"]) for r in got.collect()) == [("", 0.4, 0.4), ("a", 0.3, 0.1)]


def test_bold_words_are_quoted(spark):
    assert one(spark, T.boldify(F.lit("C++ and (x) c+ a.b axb"), ["c++", "(x", "a.b", ""])) == "<b>C++</b> and <b>(x</b>) c+ <b>a.b</b> axb"
