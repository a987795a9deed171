"""Texts with bytes that are no UTF-8: read as U+FFFD, and no operator stops at them."""

from __future__ import annotations

import hashlib
import sys
from pathlib import Path

import pytest
import tiktoken

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import public_tokenizers as P
from pyspark.sql import functions as F

from siftwell.llm import bpe, decontaminate, html_text, langid, minhash, quality, substrings



@pytest.fixture(scope="module")
def docs(spark):
    prose = " ".join(f"word{k % 97}" for k in range(200))
    rows = spark.createDataFrame([(1, prose, "en", "s1"), (2, prose, "en", "s1"), (3, None, None, None), (4, "", "de", "s2"), (5, "der Hund und die Katze", "de", "s2")], "doc_id long, text string, lang string, source string")
    bad = spark.range(6, 10).selectExpr("id AS doc_id", f"concat('{prose} ', cast(X'41FF4220C328' AS string)) AS text", "cast(X'FF' AS string) AS lang", "cast(X'73FE' AS string) AS source")
    return rows.unionByName(bad)


def test_encoding(spark, docs):
    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bpe.Encoder.of(path).ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, path).collect()}
    for r in docs.select("doc_id", F.col("text").cast("binary").alias("text")).collect():
        text = bytes(r["text"] or b"").decode("utf-8", "replace")
        assert got[r["doc_id"]]["ids"] == library.encode_ordinary(text)
        assert hashlib.sha256(got[r["doc_id"]]["decoded"]).digest() == hashlib.sha256(text.encode()).digest()


def test_languages_and_pages(spark, docs):
    assert langid.identify(docs).count() == 9
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html"))
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(pages).collect()}
    assert got[3] is None and got[4] == "" and got[6].endswith("A�B �(")


def test_dedup_quality_and_benchmark(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.learn(docs, labels)).count() == 9
    assert quality.keep_good(docs, labels, 0.0).count() == 9
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, shingle=4, percent=80).collect()}[9] == 1
    cut = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(docs).collect()}
    assert len(cut) == 9 and len(cut[6]) < 100 < len(cut[1])
    bench = spark.createDataFrame([("i", "word0 word1 word2 word3 word4 word5 word6 word7 word8 word9")], "item_id string, text string")
    assert decontaminate.drop_contaminated(docs, bench).count() == 3
