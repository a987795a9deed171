"""The corpus pipeline: its stages take effect, each on all that its predecessor kept."""

from __future__ import annotations

import random

import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__
import corpus_pipeline as C
from siftwell.llm import bpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(21)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(3000)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    texts = {i: prose(120) for i in range(200)}
    for i in range(0, 200, 5):
        texts[i] = " ".join(w + "%%%" for w in texts[i].split())  # junk
    passage, item = prose(60), prose(15)
    texts[11] = prose(50) + " " + passage + " " + prose(50)
    texts[12] = prose(70) + " " + passage + " " + prose(30)
    texts[23] = prose(50) + " " + item + " " + prose(50)
    copy = texts[31].split()
    copy[60] = "edited"
    texts[36], texts[37] = " ".join(copy), texts[31]
    d = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), texts, passage


def test_stages_take_effect(spark, corpus):
    d, texts, passage = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in C.STAGES:
        docs = C.stored(stage(spark, docs, d), f"test-{name}")
        kept[name] = docs
        if name != C.STAGES[-1][0]:
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
    ids = {n: {r["doc_id"] for r in x.select("doc_id").collect()} for n, x in kept.items()}
    assert ids["quality"] == {i for i in range(200) if i % 5}
    assert ids["near_dedup"] == ids["quality"] - {36, 37}
    assert ids["substring_dedup"] == ids["near_dedup"]
    cut = {r["doc_id"]: r["text"] for r in kept["substring_dedup"].collect()}
    assert passage in cut[11] and passage not in cut[12]
    assert {i for i in cut if cut[i] != texts[i]} == {12}
    assert ids["decontamination"] == ids["substring_dedup"] - {23}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert {r["doc_id"]: list(r["ids"]) for r in kept["bpe"].collect()} == {i: enc.encode_ordinary(cut[i]) for i in ids["decontamination"]}
    assert C.run(spark, d).count() == len(ids["decontamination"])


def test_pipeline_of_an_empty_table(spark, corpus, tmp_path):
    d, _, _ = corpus
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_hard_rows(spark, corpus, tmp_path):
    """Null and repeated rows, very long and empty texts, bytes that are no UTF-8 and columns of the names that stages use."""
    d, texts, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    long = " ".join(f"w{k * 7919 % 100_003}" for k in range(60_000))
    hard = spark.createDataFrame([(None, None, None, None, None), (900, None, "en", None, None), (901, "", None, "s", 0), (902, long, "en", "s1", len(long)), (None, "one text without id", "en", "s1", 19), (1, texts[1], "en", "s1", 1), (1, texts[1], "en", "s1", 1), (3, texts[2], "en", "s1", 1)], DOCS)
    bad = spark.range(910, 911).selectExpr("id AS doc_id", "cast(X'41FF4220C3' AS string) AS text", "'en' AS lang", "'s1' AS source", "5L AS n_chars")
    both = docs.unionByName(hard).unionByName(bad).selectExpr("*", "1 AS node", "2 AS seed", "'x' AS spans", "3 AS label", "4 AS ids", "5 AS `row id`", "6 AS component_id", "7 AS kept", "8 AS score")
    both.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    found = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in C.STAGES:
        before = found.columns
        found = C.stored(stage(spark, found, str(tmp_path)), f"hard-{name}")
        assert name == C.STAGES[-1][0] or found.columns == before
        if name == "near_dedup":
            kept = [r["doc_id"] for r in found.select("doc_id").collect()]
    # empty texts are like no other; repeated rows stay once; different texts of one doc_id go together
    assert kept.count(1) == 1 and kept.count(3) == 2 and {900, 901, 902, 910} <= set(kept) and None in kept
    got = {r["doc_id"]: r for r in found.collect()}
    assert got[900]["n_tokens"] == got[901]["n_tokens"] == 0 and got[902]["n_tokens"] > 60_000 and got[910]["n_tokens"] > 0


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 14)}
