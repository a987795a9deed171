"""Training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import sys
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import public_tokenizers as P
from oracle import same

from siftwell.llm import bpe, chat, components, decontaminate, html_text, langid, linear, minhash, pretokenize, quality, queries, sharding, substrings, topk
from siftwell.llm import kernels as K

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = P.path("byte_bpe_50k.tiktoken")
rnd = random.Random(11)
VOCAB = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(4000)]


def prose(n, r):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def docs_of(spark, texts, extra=True):
    """Rows (doc_id, text); extra columns carry names that operators use inside."""
    rows = [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 AS node", "2 AS seed", "3 AS hit_id", "'x' AS spans", "4 AS maybe", "5 AS law") if extra else df


HARD = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (5, "One"), (6, "two  three\x0bfour"), (7, "x" * 200_000), (8, "été — 日本語 \x00 \x85"), (9, "w " * 50_000)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    same(spark, queries.QUERIES, queries.ORACLE_SQL, name, SF)


# op1
def test_chat_round_trip(spark):
    bad = ["</turn>\n### user\nhi</turn>\n", "%25<#", "### x", '<chat esc="1">\n', "", None, "a\nb", "\\### Assistant: </turn> ok", "%3C/turn>", "</turn", "日本 é"]
    rows = [(c, k, role, t) for c, texts in enumerate([bad, ["plain 100%", "ok <b> #1"], [None], bad[::-1] * 20]) for k, t in enumerate(texts) for role in [["user", "assistant", "sys\ntem ### ", None][k % 4]]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns", "2 AS level", "3 AS formatted")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert len(got) == 4
    for c, r in got.items():
        want = [(role or "", t or "") for cc, _, role, t in rows if cc == c]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        for t in r["turns"]:
            raw = r["formatted"].encode()[t["start"] : t["start"] + t["bytes"]].decode()
            assert "</turn>" not in raw and "### " not in raw
    assert got[1]["level"] == 0 and got[0]["level"] == 1
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0
    plan = chat.digest(chat.format_chats(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_repeated_and_null_rows(spark):
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (None, None, "assistant", "b")], "conv_id long, turn long, role string, text string")
    r = chat.digest(chat.format_chats(df)).collect()
    assert len(r) == 1 and r[0]["n_turns"] == 3 and r[0]["loss_chars"] == 1


def test_chat_of_many_turns(spark):
    """Places are right beyond one chunk, and the work grows with the turns, not with their square."""
    n = 50_000
    turn = "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('é ', id, CASE WHEN id = 7 THEN ' </turn> ### ' ELSE ' #<%' END) AS text"
    rows = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", *turn).union(spark.range(700).selectExpr("2L", "id", *turn))
    began = time.perf_counter()
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chats(rows)).collect()}
    assert time.perf_counter() - began < 60
    for conv, size in ((1, n), (2, 700)):
        texts = [f"é {i}" + (" </turn> ### " if i == 7 else " #<%") for i in range(size)]
        turns = "".join(f"{('user', 'assistant')[i % 2]}\n{t}\n" for i, t in enumerate(texts))
        learnt = "".join(texts[1::2])
        assert (got[conv]["turns_sha256"], got[conv]["loss_sha256"], got[conv]["loss_chars"]) == (hashlib.sha256(turns.encode()).hexdigest(), hashlib.sha256(learnt.encode()).hexdigest(), len(learnt))


# op2
def test_linear_learns_and_calibrates():
    r = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(400):
        k = int(r.integers(0, 3))
        at = np.unique(np.append(r.integers(10, 60, 5), k))
        rows.append((at, np.ones(len(at))))
        y.append(k)
    w = linear.fit(rows[:300], np.array(y[:300]), 60, 3, epochs=5)
    s = linear.scores(rows[300:], w)
    assert (s.argmax(1) == np.array(y[300:])).mean() > 0.95
    assert (w == 0).mean() > 0.05  # the elastic net leaves zeros
    t = linear.temperature(s * 5, np.array(y[300:]))
    assert t > 0


def quality_tables(spark, n=500):
    r = random.Random(3)
    texts, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        texts.append((i, " ".join(r.choice(VOCAB[:300]) + ("###" if bad else "") for _ in range(60))))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 0 if bad else 1, 0))
    return docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS good", "2 AS mark_id")


def test_quality_separates(spark):
    docs, labels = quality_tables(spark)
    model = quality.learn(docs, labels)
    got = {r["doc_id"]: r["kept"] for r in quality.score(docs, model).collect()}
    wrong = [i for i, kept in got.items() if kept == (i % 4 == 0)]
    assert len(got) == 500 and len(wrong) < 10
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, k in got.items() if k}


def test_quality_edges(spark):
    docs, labels = docs_of(spark, HARD), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.learn(docs, labels) is None
    assert all(r["kept"] for r in quality.score(docs, None).collect())
    full, marks = quality_tables(spark, 200)
    model = quality.learn(full, marks)
    assert quality.score(docs, model).count() == len(HARD)
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_quality_views_agree_with_their_rows(spark):
    """The scores of a block are the products of the rows that the model learnt from."""
    docs, labels = quality_tables(spark, 200)
    model = quality.learn(docs, labels)
    texts = [t or "" for _, t in HARD] + [prose(80, random.Random(k)) + "\n#!" for k in range(70)]
    block = next(K.blocks(iter([pa.RecordBatch.from_pydict({"text": texts})]), most=1 << 30))
    own = quality.parts_of(block)
    want = [float(x @ model.text[at]) for at, x in quality.text_rows(block, own)]
    assert np.allclose(quality.text_margins(block, own, model.text), want, atol=1e-5)


def test_quality_sample_is_bounded(spark):
    """One doc_id with many texts, and many equal rows, bring a bounded share to the training task."""
    texts = [(1, f"text {i % 300}") for i in range(3000)] + [(i, prose(20, random.Random(i))) for i in range(2, 40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = quality.sample(quality.numbered(docs_of(spark, texts)), quality.marked(labels, 10_000)).groupBy("good").count().collect()
    assert {r["good"]: r["count"] for r in got} == {0: 19, 1: 19 + quality.PER_ID}


def test_co_training_helps():
    """On held-out labels a text view with few labels and a pool beats the same view without the pool."""
    r = np.random.default_rng(5)
    n, words = 1500, 400
    label = r.integers(0, 2, n)
    text, meta = [], []
    for y in label:  # weak words; the metadata are sure for most rows
        own = np.unique(np.concatenate([r.integers(0, words, 12), r.integers(0, words // 2, 5) + y * (words // 2)]))
        text.append((np.append(own, quality.TEXT_SIZE - 1), np.ones(len(own) + 1)))
        kind = y if r.random() < 0.99 else 1 - y
        meta.append((np.array([kind * 7 + 3, quality.META_SIZE - 1]), np.ones(2)))
    held = np.arange(n) >= 1000
    given = np.where(np.arange(n) < 240, label, -1)

    def accuracy(rows):
        model = quality.co_train([text[i] for i in rows], [meta[i] for i in rows], given[rows], np.arange(len(rows)) % 4)
        odds = np.array([x @ model.text[at] for at, x in (text[i] for i in np.flatnonzero(held))]) * model.text_line[0] + model.text_line[1]
        return ((odds > 0) == label[held]).mean()

    alone, together = accuracy(np.arange(240)), accuracy(np.arange(1000))
    assert together > alone + 0.02


def test_learning_equals_co_training_in_memory(spark):
    """The model learnt over a table is that of all its rows in one list: no document is left out of the pool."""
    docs, labels = quality_tables(spark, 400)
    docs = docs.unionByName(docs.where("doc_id < 60")).unionByName(docs.where("doc_id % 6 = 1").withColumn("doc_id", F.col("doc_id") + 1000))  # rows and texts that repeat
    got = quality.learn(docs.repartition(7), labels)
    mark = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = sorted({r["row"]: r for r in quality.numbered(docs).collect()}.values(), key=lambda r: r["row"])
    batch = pa.RecordBatch.from_pydict({c: [r[c] for r in rows] for c in ("text", "source", "lang")})
    block, own, metas = next(quality.features(iter([batch])))
    assert len(block) == len(rows) == 400 + 67
    text = [(np.asarray(a, np.int32), np.asarray(x, np.float32)) for a, x in quality.text_rows(block, own)]
    meta = [(np.asarray(a, np.int32), np.asarray(x, np.float32)) for a, x in metas]
    label, number, look = (np.array(x) for x in ([mark.get(r["doc_id"], -1) for r in rows], [r["row"] for r in rows], [r["look"] for r in rows]))
    want = quality.co_train(text, meta, label, number % 4, look)
    alone = quality.co_train(text, meta, label, number % 4, look, rounds=0)
    assert not np.allclose(alone.text, want.text, atol=1e-3)  # the rounds took effect
    for name in ("text", "meta", "text_line", "meta_line", "both"):
        assert np.allclose(getattr(got, name), getattr(want, name), atol=1e-4), name


def test_a_hot_text_is_handed_over_once(spark):
    """A text that holds most rows of the pool takes one place of the draw; the others still come."""
    docs, labels = quality_tables(spark, 200)
    hot = docs.where("doc_id = 1").crossJoin(spark.range(2000).select(F.col("id").alias("k"))).withColumn("doc_id", F.col("k") + 5000).drop("k")
    both = docs.unionByName(hot)
    model = quality.learn(both, labels, rounds=0)
    found = quality.sure_rows(quality.numbered(both.where("doc_id % 6 in (1, 5) or doc_id >= 5000")), model, [set(), set()]).collect()
    per = {}
    for r in found:
        per.setdefault((r["view"], r["good"]), []).append(r["look"])
    assert found and all(len(x) == len(set(x)) <= quality.PER_ROUND for x in per.values()) and len(per[0, 1]) > 20


# op3
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_bpe_equals_library(spark):
    r = random.Random(5)
    alphabet = list("ab'strvmlde  \n\t  1 2.!é½ 　'’日\x1c\x85-") + ["'re", "'ll", "'s", " '", "''"]
    texts = [(i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 80)))) for i in range(300)] + [(i + 1000, t) for i, (_, t) in enumerate(HARD)]
    texts += [(5000, "".join(r.choice("abcdehinorst") for _ in range(3000))), (5001, prose(20_000, r))]
    docs = docs_of(spark, texts)
    encoded = bpe.encode(docs, PATH)
    rows = bpe.decode(encoded, PATH).collect()
    want = dict(texts)
    assert len(rows) == len(texts)
    for row in rows:
        text = want[row["doc_id"]] or ""
        assert list(row["ids"]) == ENC.encode_ordinary(text)
        assert bytes(row["decoded"]).decode() == text
        assert list(row["offsets"]) == list(np.cumsum([0, *(len(ENC.decode_single_token_bytes(k)) for k in row["ids"])])[:-1])
    d = {r["doc_id"]: r for r in bpe.digest(bpe.round_trip(docs, PATH)).collect()}
    assert d[5001]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ENC.encode_ordinary(want[5001]))).encode()).hexdigest()
    assert d[1000]["n_tokens"] == 0
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).count() == 0


def test_transition_scan_is_associative():
    of, then, _, _ = pretokenize.monoid()
    n = len(then)
    for a in range(n):
        for b in range(n):
            assert (then[then[a, b]] == then[a][then[b]]).all()


# op4
def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, per_language=150).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    fold = {r["doc_id"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert {r["doc_id"] for r in got} == fold
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    r = random.Random(2)
    texts = [(i, " ".join(r.choice(["the", "of", "and"] if i % 2 else ["der", "und", "das"]) for _ in range(20))) for i in range(100, 200)]
    docs = docs_of(spark, texts + HARD).withColumn("lang", F.when(F.col("doc_id") >= 100, F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de")))
    got = langid.identify(docs).collect()
    assert len(got) == len(texts) + len(HARD)
    und = {x["doc_id"] for x in got if x["lang_pred"] == "und"}
    assert und == {None, 1, 2, 3}
    assert all(x["lang_pred"] == ("en" if x["doc_id"] % 2 else "de") for x in got if (x["doc_id"] or 0) >= 100)
    assert {x["lang_pred"] for x in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_language_sample_is_bounded(spark, monkeypatch):
    """More languages, rows and equal rows than the sample holds: the most frequent languages are learnt."""
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    words = {"a": ["the", "of", "and"], "b": ["der", "und", "das"], "c": ["que", "los", "una"]}
    texts = [(i, " ".join(words["abc"[k]] * 4) + (f" w{i}" if i % 3 else "")) for k, n in enumerate((300, 200, 20)) for i in range(1000 * k, 1000 * k + n)]
    docs = docs_of(spark, texts).withColumn("lang", F.when(F.col("doc_id") < 1000, "a").when(F.col("doc_id") < 2000, "b").otherwise("c"))
    got = langid.identify(docs.union(docs), per_language=40).collect()
    assert len(got) == 1040 and {x["lang_pred"] for x in got} == {"a", "b"}
    assert all(x["lang_pred"] == "ab"[x["doc_id"] // 1000] for x in got if x["doc_id"] < 2000)


# op5
def near_brute(texts, size, percent=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in texts:
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (t or "").translate(low)).split(" ") if x]
        sets.append((i, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()))
    comp = {i: i for i, _ in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(sets[a][0]), root(sets[b][0])
                comp[max(p, q)] = min(p, q)
    return {i: (len(s), root(i)) for i, s in sets}


def test_near_duplicates_by_brute_force(spark):
    r = random.Random(9)
    texts, base = [], [prose(r.randint(30, 200), r) for _ in range(12)]
    for i in range(160):
        words = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            words[r.randrange(len(words))] = r.choice(VOCAB)
        texts.append((i * 3 % 160, " ".join(words)))
    texts += [(500, None), (501, ""), (502, "a b"), (503, "A  b"), (504, "a b c"), (505, "x" * 50_000)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(docs_of(spark, texts), 4).collect()}
    want = near_brute(texts, 4)
    assert {i: g[:2] for i, g in got.items()} == want
    assert all(g[2] == (i == g[1]) for i, g in got.items())


def test_near_duplicate_edges(spark):
    got = minhash.near_duplicates(docs_of(spark, HARD), 5).collect()
    assert len(got) == len(HARD)
    by = Counter((x["doc_id"], x["component_id"], x["kept"]) for x in got)
    assert by[5, 4, False] == 2 and by[4, 4, True] == 1 and by[None, None, False] == 1
    kept = minhash.keep_one(docs_of(spark, [*HARD, (20, "solo text"), (20, "solo text")]))
    assert Counter(x["doc_id"] for x in kept.collect()) == Counter([None, 1, 2, 3, 4, 6, 7, 8, 9, 20])
    assert minhash.near_duplicates(docs_of(spark, HARD).limit(0)).count() == 0


def test_hot_bucket_is_cut_into_units(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 8)
    r = random.Random(4)
    words = prose(120, r).split()
    texts = []
    for i in range(60):
        w = list(words)
        for _ in range(r.choice([1, 2, 3, 6])):
            w[r.randrange(len(w))] = r.choice(VOCAB)
        texts.append((i, " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(docs_of(spark, texts), 4).collect()}
    assert got == {i: c for i, (_, c) in near_brute(texts, 4).items()}


def test_posterior_bound():
    assert minhash.at_least(96, 96, 0.8) > 0.99 and minhash.at_least(40, 96, 0.8) < 1e-6
    least = dict(minhash.fewest(0.8, 1e-6))
    assert 0 < least[32] < 32 and least[96] < 0.8 * 96


def test_components(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# op6
def brute_shard(key, weights):
    def cost(s, w):
        h = int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16)
        return -math.log((h + 0.5) / 2**52) / w

    return min((cost(s, w), s) for s, w in weights.items())[1]


def test_sharding(spark):
    weights = {0: 1.0, 1: 2.0, 2: 1.0}
    texts = [(i, f"text {i % 7}") for i in range(3000)]
    rows = sharding.shard(docs_of(spark, texts), weights, {3: 1.0}).collect()
    assert {r["doc_id"]: r["shard"] for r in rows} == {i: brute_shard(i, weights) for i, _ in texts}
    assert {r["doc_id"]: r["grown_shard"] for r in rows} == {i: brute_shard(i, weights | {3: 1.0}) for i, _ in texts}
    assert all(r["grown_shard"] in (r["shard"], 3) for r in rows)
    sizes = Counter(r["shard"] for r in rows)
    assert abs(sizes[1] - 1500) < 120
    for s in weights:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_sharding_edges(spark):
    rows = sharding.shard(docs_of(spark, HARD), {s: 1.0 for s in range(40)}, {40: 1.0}).collect()
    assert len(rows) == len(HARD)
    null = next(r for r in rows if r["doc_id"] == 1)
    assert (null["size"], null["text_crc32"]) == (16, 0)
    accents = next(r for r in rows if r["doc_id"] == 8)
    raw = HARD[9][1].encode()
    assert (accents["size"], accents["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    twins = [r for r in rows if r["doc_id"] == 5]
    assert len({r["shard"] for r in twins}) == 1 and len({r["slot"] for r in twins}) == 2
    assert sharding.shard(docs_of(spark, HARD).limit(0), {0: 1.0}, {1: 1.0}).count() == 0


def test_sharding_of_one_key(spark):
    """A key that holds most rows is numbered in several parts."""
    df = spark.range(0, 4000, 1, 16).selectExpr("1L AS doc_id", "concat('t', id % 5) AS text")
    rows = sharding.shard(df, {0: 1.0, 1: 1.0}, {2: 1.0}).collect()
    assert len({r["shard"] for r in rows}) == 1 and sorted(r["slot"] for r in rows) == list(range(4000))


# op7
@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>one<p>two<br>three", "one\n\ntwo\nthree"),
        ("<ul><li>x<ul><li>y</ul><li><p>z</p></ul>", "- x\n  - y\n- z"),
        ("<ol start=3><li>q<li>r</ol>", "3. q\n4. r"),
        ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a    | bbb\ncccc | d"),
        ("a<script>x('</p>')</script><style>p{}</style><!-- c --><span hidden>h</span><i style='display : none'>n</i>b", "ab"),
        ("<pre> a\n  b</pre>c", " a\n  b\n\nc"),
        ("5 < 6 &amp; 7&nbsp;x", "5 < 6 & 7\xa0x"),
        ("<b>ti</b><i>tu</i> <a href=x>l</a>", "titu l"),
        ("<div><h1>T</h1>x</div>y", "T\n\nx\ny"),
        ("<head><title>t</title></head><body>b", "b"),
        ("</p></td>x</div>", "x"),
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C<td>D</table>", "A | B\n  | C | D"),
        ("<table><tr><td colspan=2>wide<td>x<tr><td>a<td>b<td>c</table>", "wide |   | x\na    | b | c"),
        ("<table><tr><td>a<table><tr><td>b<td></td><td>c<tr><td>d</table>e<td>f</table>", "a b | c d e | f"),
        ("<div style='visibility: hidden'>no<b style='visibility:visible'>yes</b>no</div>x<p style='color:red;DISPLAY:none'>n<b style='display:block'>o", "yes\nx"),
        ("a<noscript>off</noscript>b", "ab"),
        ("<a title='x > y'>k</a> <a b=\"c>d", "k d"),
        ("", ""),
    ],
)
def test_html_rendering(page, text):
    assert html_text.extract(page)[1] == text.strip("\n")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<head><title>t</title>Hello <a href=x>Home</a><p>x", "Hello Home\n\nx"),
        ("<head><title>t</title><span>Intro<p>All the page", "Intro\n\nAll the page"),
        ("<html><head> <meta name=a> <img alt=pic><b>b</b>", "picb"),
        ("<head><noscript>off</noscript><template>no</template><style>p{}</style> </head>b", "b"),
    ],
)
def test_html_unclosed_head(page, text):
    assert html_text.extract(page)[1].split() == text.split()


def test_html_drawings_and_formulas():
    page = '<p>a <b aria-hidden="true">b</b> <svg><title>t</title><desc>d</desc><defs><text>e</text></defs><text>drawn</text></svg> <math><mi>x</mi><annotation>y</annotation></math>'
    assert html_text.extract(page) == ("", "a b drawn x")


@pytest.mark.parametrize(
    "page",
    ["<div>" * 200_000, '<a "' * 250_000, '<a b="' * 170_000, "<ul><li>x" * 100_000, "<table><tr><td>" * 60_000, "<!" * 500_000, "<table>" + "<tr>" + "<td rowspan=60000>a" * 20_000 + "<tr><td>b" * 50_000, "<table><tr><td>" + "x" * 400_000 + "<td>b" + "<tr><td>c<td>d" * 40_000, "<b>x</i>" * 100_000],
    ids=["nested", "unclosed", "quotes", "lists", "tables", "declarations", "rowspans", "wide", "unmatched"],
)
def test_html_of_a_megabyte_is_linear(page):
    began = time.perf_counter()
    html_text.extract(page)
    assert time.perf_counter() - began < 15


def test_html_spans_of_many_digits():
    assert [html_text.number(x, 1000) for x in ("2", "0003", "1234567", "9" * 5000, "", None, "x", "-1", "0")] == [2, 3, 1000, 1000, None, None, None, None, 0]


def test_html_edges(spark):
    pages = ["<li>" * 5000 + "deep", "<div>" * 5000 + "deep", "<table>" * 300 + "<td>deep", "<", "<a", "<!--", "<script>", None, "", "x" * 300_000, "<p " + "a" * 1000 + ">deep"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("*", "1 AS id", "2 AS text", "3 AS title")
    got = {r["page_id"]: r for r in html_text.extract_pages(df.union(df)).collect()}
    assert got[7]["text"] is None and got[8]["text"] == "" and len(got[9]["text"]) == 300_000
    assert all("deep" in got[k]["text"] for k in (0, 1, 2, 10))
    assert html_text.extract("<ul><li>x" * 100)[1].split("\n")[-1] == " " * 78 + "- x"
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_html_keeps_all_visible_words(spark):
    """Every word of the real pages' bodies outside scripts, styles and comments comes out, in order."""
    import re
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.off, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.off:
                self.out.append(data)

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        w = Words()
        w.feed(r["html"])
        w.close()
        want[r["page_id"]] = "".join("".join(w.out).split())
    for r in html_text.extract_pages(pages).collect():
        bare = re.sub(r"(?m)^ *(-|\d+\.) |\|", "", r["text"])
        assert "".join(bare.split()) == re.sub(r"\|", "", want[r["page_id"]])


# op8
def test_decontamination_edges(spark):
    r = random.Random(8)
    item = prose(14, r)
    texts = [*HARD, (30, prose(20, r) + " " + item.upper() + " " + prose(5, r)), (31, " ".join(item.split()[:9])), (32, "solo!word"), (33, item + " " + item)]
    items = spark.createDataFrame([(1, item), (1, item), (12, "Solo word"), (2, None), (3, "  "), (13, item)], "item_id long, text string").selectExpr("*", "1 AS hash")
    for most in (1_000_000, 2):
        got = {}
        for x in decontaminate.scan(docs_of(spark, texts), items, most=most).collect():
            got.setdefault(x["doc_id"], x)
        assert got[30]["n_hit"] == 14 and list(got[30]["items"]) == ["1", "13"]
        assert got[31]["n_hit"] == 0 and got[32]["n_hit"] == 2 and got[33]["n_hit"] == 28
        assert got[1]["n_words"] == 0 and got[2]["n_hit"] == 0
        left = decontaminate.drop_contaminated(docs_of(spark, texts), items, most=most)
        assert left.columns == docs_of(spark, texts).columns
        assert Counter(x["doc_id"] for x in left.collect()) == Counter([i for i, _ in [*HARD, (31, 0)]])
        cut = {x["doc_id"]: x["text"] for x in decontaminate.remove_spans(docs_of(spark, texts), items, most=most).collect()}
        assert cut[33] == "" and cut[31] == texts[-3][1] and cut[32] == ""
        assert cut[30] == texts[-4][1].replace(item.upper(), "")
    assert decontaminate.scan(docs_of(spark, texts), items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.scan(docs_of(spark, texts).limit(0), items).count() == 0


def test_decontamination_of_large_benchmarks(spark):
    """The broadcast and the joined way agree, also on rows that share a doc_id and on equal texts."""
    r = random.Random(18)
    items = [prose(r.randint(1, 40), r) for _ in range(30)]
    texts = []
    for i in range(60):
        words = prose(r.randint(0, 60), r).split() + r.choice(items).split()[: r.choice([0, 5, 12, 40])] + prose(8, r).split()
        texts.append((i // 3 if i % 7 else None, " ".join(words)))
    docs = docs_of(spark, texts + texts[:9])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    one, two = ([repr(x) for x in decontaminate.scan(docs, bench, most=most).collect()] for most in (10_000, 3))
    assert Counter(one) == Counter(two) and any("n_hit=12" in x for x in one)
    one, two = ([repr(x) for x in decontaminate.remove_spans(docs, bench, most=most).collect()] for most in (10_000, 3))
    assert Counter(one) == Counter(two)


# op9
def test_repeated_passages_are_found(spark):
    r = random.Random(6)
    passage, fuzzy = prose(70, r), prose(120, r)
    edited = fuzzy.split()
    for k in range(9, 120, 17):
        edited[k] = "changed"
    edited.insert(60, "added")
    texts = [(i, prose(150, r)) for i in range(40)]
    texts[3] = (3, prose(40, r) + " " + passage + " " + prose(40, r))
    for i in (8, 9, 21):
        texts[i] = (i, prose(30 + i, r) + " " + passage.upper() + " " + prose(20, r))
    texts[5] = (5, prose(25, r) + " " + fuzzy + " " + prose(10, r))
    texts[30] = (30, prose(60, r) + " " + " ".join(edited))
    texts[33] = (33, prose(10, r) + " " + " ".join(passage.split()[:40]))
    docs = docs_of(spark, texts + [(i + 100, t) for i, t in HARD if i is not None] + [(None, passage)])
    got = {x["doc_id"]: x for x in substrings.repeats(docs).where("doc_id < 100").collect()}
    assert set(got) == {8, 9, 21, 30}
    for i in (8, 9, 21):
        assert (got[i]["anchor_id"], got[i]["word"], got[i]["end_word"]) == (3, 30 + i, 100 + i)
    assert got[30]["anchor_id"] == 5 and got[30]["end_word"] - got[30]["word"] >= 115
    cut = {x["doc_id"]: x["text"] for x in substrings.remove_repeats(docs).collect()}
    assert cut[3] == texts[3][1] and cut[33] == texts[33][1] and cut[None] == passage
    assert passage.upper() not in cut[8] and cut[8].split() == texts[8][1].split()[:38] + texts[8][1].split()[108:]
    assert substrings.remove_repeats(docs).columns == docs.columns


def test_exact_copies_by_brute_force(spark):
    """Every 50 words shared with an earlier document lie in a returned span."""
    r = random.Random(12)
    pool = [prose(r.randint(50, 90), r) for _ in range(6)]
    texts = [(i, " ".join(x for _ in range(3) for x in (prose(r.randint(5, 40), r), r.choice(pool)))) for i in range(25)]
    words = {i: t.split() for i, t in texts}
    first = {}
    want = {}
    for i in sorted(words):
        w = words[i]
        grams = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        want[i] = {j for k, g in enumerate(grams) if first.get(g, i) < i for j in range(k, k + 50)}
        for g in grams:
            first.setdefault(g, i)
    got = {i: set() for i in words}
    for x in substrings.repeats(docs_of(spark, texts)).collect():
        got[x["doc_id"]] |= set(range(x["word"], x["end_word"]))
    assert all(want[i] <= got[i] for i in words)
    assert sum(len(got[i] - want[i]) for i in words) < 0.05 * sum(len(g) for g in got.values())


def covered(found, doc):
    return {j for x in found if x["doc_id"] == doc for j in range(x["word"], x["end_word"])}


def test_exact_copies_behind_other_anchors(spark):
    """A passage whose seeds first occur in two earlier documents, neither of which holds all of it."""
    r = random.Random(21)
    w = prose(60, r).split()
    texts = [prose(40, r), " ".join(w[:35]) + " " + prose(30, r), prose(30, r) + " " + " ".join(w[25:]), prose(20, r) + " " + " ".join(w) + " " + prose(9, r), prose(5, r) + " " + " ".join(w) + " " + prose(30, r)]
    found = substrings.repeats(docs_of(spark, list(enumerate(texts)))).collect()
    assert {(x["doc_id"], x["anchor_id"]) for x in found} == {(4, 3)} and covered(found, 4) >= set(range(5, 65))
    cut = {x["doc_id"]: x["text"].split() for x in substrings.remove_repeats(docs_of(spark, list(enumerate(texts)))).collect()}
    assert cut[3] == texts[3].split() and cut[4] == texts[4].split()[:5] + texts[4].split()[65:]


def test_lines_repeated_over_and_over(spark):
    r = random.Random(22)
    texts, at = [], {}
    for k, period in enumerate((1, 2, 3, 5, 6, 10, 12, 20)):
        line = prose(period, r)
        for times in (70 // period + 1, 140 // period + 1):
            before = r.randint(5, 40)
            at[len(texts)] = (before, before + times * period, times == 140 // period + 1)
            texts.append(prose(before, r) + " " + " ".join([line] * times) + " " + prose(12, r))
    found = substrings.repeats(docs_of(spark, list(enumerate(texts)))).collect()
    for i, (a, b, again) in at.items():
        assert covered(found, i) >= set(range(a, b)) if again else not covered(found, i)


def changed(words, r, share=None, every=None):
    return [f"z{r.randrange(10**6)}" if (k % every == every - 1 if every else r.random() < share) else w for k, w in enumerate(words)]


def test_recall_at_the_stated_identity(spark):
    """Passages of 60 words with changed words; brute force counts those that keep the identity."""
    r = random.Random(23)
    kinds = [("every", 5), ("every", 8), ("every", 10), ("share", 0.1), ("share", 0.15)]
    texts, pairs = [], []
    for kind, much in kinds:
        for _ in range(60):
            w = prose(60, r).split()
            edited = changed(w, r, **{kind: much})
            texts.append(prose(30, r) + " " + " ".join(w) + " " + prose(30, r))
            texts.append(prose(20, r) + " " + " ".join(edited) + " " + prose(30, r))
            if any(sum(x == y for x, y in zip(w[k : k + n], edited[k : k + n], strict=True)) >= 0.8 * n for n in range(50, 61) for k in range(61 - n)):
                pairs.append((kind, much, len(texts) - 1))
    got = {(x["doc_id"], x["anchor_id"]) for x in substrings.repeats(docs_of(spark, list(enumerate(texts)))).collect()}
    recall = {k: sum((i, i - 1) in got for a, b, i in pairs if (a, b) == k) / sum((a, b) == k for a, b, _ in pairs) for k in kinds}
    print(recall)
    assert got <= {(i, i - 1) for i in range(1, len(texts), 2)}
    assert all(recall[k] >= 0.95 for k in kinds if k != ("every", 5)) and recall[("every", 5)] >= 0.8


def test_repeats_of_empty_tables(spark):
    empty = docs_of(spark, HARD).limit(0)
    assert substrings.repeats(empty).count() == 0 and substrings.remove_repeats(empty).count() == 0


def test_chain_is_best_by_brute_force():
    r = random.Random(1)
    for _ in range(50):
        pos = sorted(r.sample(range(200), 12))
        anchor = [p + 40 if r.random() < 0.7 else r.randrange(300) for p in pos]
        out = substrings.chain(pos, anchor)
        assert sorted(m for c in out for m in c) == list(range(12))
        for c in out:
            assert all(pos[a] < pos[b] and anchor[a] < anchor[b] for a, b in zip(c, c[1:], strict=False))
    assert substrings.chain([0, 10, 20, 30], [5, 15, 25, 35]) == [[0, 1, 2, 3]]


# op10
def test_top_k_by_brute_force(spark):
    r = np.random.default_rng(2)
    vectors = r.normal(0, 0.3, (700, 16)).astype(np.float32)
    vectors[100:160] = vectors[5]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1020, [None] * 16), (1040, [float("nan")] * 16), (1060, [float("inf")] * 16), (None, rows[0][1]), (40, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "2 AS block", "3 AS dim")
    got = {}
    for x in topk.top_k(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    whole = np.floor(64 * vectors.astype(np.float64)).astype(np.int64)
    whole = np.concatenate([whole, whole[40:41]])  # the repeated row is a query and a candidate
    ids = [*range(700), 40]
    score = whole @ whole.T
    assert set(got) == set(range(0, 700, 20))
    want = {}
    for q, i in enumerate(ids):
        if i % 20 == 0:
            want.setdefault(i, []).extend((k + 1, v, -s) for k, (s, v) in enumerate(sorted((-score[q, c], ids[c]) for c in range(701) if c != q)[:20]))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}


@pytest.mark.parametrize(("cells", "scale"), [(256, 64), (4, 64), (16, 10**7), (256, 10**15)])
def test_top_k_over_many_blocks(spark, monkeypatch, cells, scale):
    """Many blocks of queries and vectors, coarse cells, and sums beyond exact doubles or a long."""
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "CELLS", cells)
    vectors = np.random.default_rng(7).normal(0, 30 if scale > 10**10 else 0.3, (500, 12))
    vectors[::9] = np.round(vectors[::9], 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for x in topk.top_k(df, F.col("vec_id") % 20 == 0, scale=scale).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    whole = [[math.floor(x * float(scale)) for x in v] for v in vectors.tolist()]
    for q in range(0, 500, 20):
        scores = [(-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in enumerate(whole) if i != q]
        assert sorted(got[q]) == [(k + 1, i, min(-s, 2**63 - 1)) for k, (s, i) in enumerate(sorted(scores)[:20])]


def test_candidates_do_not_grow_with_blocks(spark, monkeypatch):
    """One bound for a query over all blocks: 1, 4 and 16 blocks leave nearly the same candidates."""
    vectors = np.random.default_rng(9).normal(0, 0.3, (1600, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    counts, results = [], []
    real = topk.stored

    def counted(frame, name):
        out = real(frame, name)
        if name == "topk-candidates":
            counts.append(out.count() / 80)
        return out

    monkeypatch.setattr(topk, "stored", counted)
    for block in (1600, 400, 100):
        monkeypatch.setattr(topk, "BLOCK", block)
        results.append(sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0).collect())))
    assert results[0] == results[1] == results[2] and len(results[0]) == 1600
    assert max(counts) < 1.2 * counts[0] < 60


def test_bounds_hold():
    r = np.random.default_rng(3)
    for size in (3, 1000, 10**12):
        v = r.integers(-size, size, (200, 9))
        low, width = v.min(0).astype(float), np.maximum(1, np.ceil((v.max(0) - v.min(0) + 1) / topk.CELLS)).astype(float)
        cells = np.clip(np.floor((v - low) / width), 0, topk.CELLS - 1).astype(np.uint8)
        upper, lower = topk.bounds(v[:20].astype(float), cells, low, width)
        exact = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in v] for x in v[:20]]
        assert all(lower[i, j] <= exact[i][j] <= upper[i, j] for i in range(20) for j in range(200))


def test_top_k_edges(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0]), (40, [])], schema)
    got = topk.top_k(few, F.col("vec_id") % 20 == 0).collect()
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got) == [(0, 1, 1, 2048), (0, 2, 20, 0), (20, 1, 1, 2048), (20, 2, 0, 0)]
    assert topk.top_k(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# kernels
def test_blocks_keep_rows():
    texts = ["a" * 10, None, "", "b" * 40, "c"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "text": texts})
    seen = [(i, bytes(b.data[s:e]).decode()) for b in K.blocks(iter([batch, batch.slice(1, 3)]), most=12) for i, s, e in zip(b.batch.column(0).to_pylist(), b.at[:-1], b.at[1:], strict=True)]
    assert seen == [(i, t or "") for i, t in enumerate(texts)] + [(i, texts[i] or "") for i in (1, 2, 3)]
