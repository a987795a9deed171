"""Whitening, archives and spelling variants against numpy, a parser of files and brute force."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import sys
import zlib
from base64 import b32encode
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from siftwell.llm import queries, spelling, warc, whiten

SF = "/root/testdata/sf0.001"


# op11
def close(one, two):
    return max(min(abs(a - b).max(), abs(a + b).max()) for a, b in zip(one, two, strict=True))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 40, 90])
def test_components_equal_the_library(size):
    r = np.random.default_rng(size)
    a = r.normal(size=(3 * size, size)) * np.linspace(1, 5, size)
    v = a.T @ a / len(a)
    e, q = whiten.components(v, 16)
    values, vectors = np.linalg.eigh(v)
    assert np.allclose(e, values[::-1][:16], rtol=1e-12)
    assert close(q, vectors.T[::-1][:16]) < 1e-10


@pytest.mark.parametrize("v", [np.zeros((4, 4)), np.eye(5), np.diag([3.0, 3, 1, 1, 0]), np.ones((6, 6)), np.diag(10.0 ** -np.arange(12)), 1 + np.diag([1e-14] * 4)])
def test_components_of_equal_and_zero_eigenvalues(v):
    e, q = whiten.components(v, 16)
    assert np.allclose(e, np.sort(np.linalg.eigvalsh(v))[::-1][:16], atol=1e-14)
    assert np.allclose(q @ q.T, np.eye(len(e)), atol=1e-13)
    assert np.allclose(q @ v @ q.T, np.diag(e), atol=1e-13)


def test_polar_factor():
    r = np.random.default_rng(4)
    a = r.normal(size=(30, 30))
    a = a + a.T
    u = whiten.polar_factor(a)
    e, q = np.linalg.eigh(a)
    assert np.allclose(u, q @ np.diag(np.sign(e)) @ q.T, atol=1e-11)


def expected(vectors, scale=64.0, shift=1_000_000):
    x = np.floor(scale * np.array(vectors, float)).astype(int) + shift
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    d = (n * u - s) / n
    v = d.T @ d / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:16], q[:, ::-1][:, :16]
    return n, ((n * x - s) ** 2).sum(1), (n * x - s) / n @ q / np.sqrt(e), e / np.trace(v)


def test_whitening_by_numpy(spark):
    r = np.random.default_rng(5)
    vectors = (r.normal(size=(300, 20)) * np.linspace(0.2, 2, 20)).astype(np.float32)
    vectors[100:200] = vectors[0]  # copies count once
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    bad = [(900, None), (901, [None] * 20), (902, [float("nan")] * 20), (903, [1.0] * 19 + [float("inf")]), (904, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 AS dim", "2 AS x", "3 AS n").repartition(5)
    got = whiten.whiten(df).orderBy("vec_id", "component").toPandas()
    n, deviation, whitened, explained = expected(vectors)
    assert set(got["n"]) == {n} == {200} and got["vec_id"].tolist() == [i for i in range(300) for _ in range(16)]
    table = got["whitened"].to_numpy().reshape(300, 16)
    assert close(table.T, whitened.T) < 1e-9
    assert got["deviation"].to_numpy().reshape(300, 16)[:, 3].tolist() == deviation.tolist()
    assert np.allclose(got["explained"].to_numpy().reshape(300, 16)[7], explained, rtol=1e-9)
    first = np.unique(vectors, axis=0, return_index=True)[1]
    cov = np.cov(table[first].T, bias=True) - np.eye(16)
    assert abs(cov).max() < 1e-9 and set(got["identity_error"]) == {got["identity_error"][0]} and got["identity_error"][0] < 1e-9


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert whiten.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    rows = [(None, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 3.0, 0.0]), (3, [2.0, 3.0, 0.0]), (4, [1e300, 0.0, 0.0])]
    got = {(r["vec_id"], r["component"]): r for r in whiten.whiten(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 13 and got[(None, 1)]["whitened"] is None and got[(1, 1)]["n"] == 1 and got[(1, 2)]["deviation"] == 0
    assert got[(4, 1)]["whitened"] == pytest.approx(2**0.5) or got[(4, 1)]["whitened"] == pytest.approx(-(2**0.5))
    assert got[(4, 1)]["deviation"] == 2**63 - 1 and got[(2, 1)]["n"] == 3


# op12
PAGES = [(1, "u", "a"), (2, "u", "a"), (2, "u", "a"), (2, "v", "a"), (None, "u", "a"), (3, None, None), (4, "x y\n", ""), (5, "http://é/", "ü" * 100_000), (6, "u", "b\r\n\r\nWARC/1.1\r\n\r\nx"), (6, "u", "b")]


def parsed(data: bytes):
    """(headers, block, offset) of every record of an archive."""
    plain, out = gzip.decompress(data), []
    at = 0
    while at < len(plain):
        cut = plain.index(b"\r\n\r\n", at)
        lines = plain[at:cut].decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        assert lines[0] == "WARC/1.1" and plain[cut + 4 + size : cut + 8 + size] == b"\r\n\r\n"
        out.append((headers, plain[cut + 4 : cut + 4 + size]))
        at = cut + 8 + size
    return out


def test_archives_hold_every_page(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS file", "2 AS offset", "3 AS number").repartition(3)
    index = warc.write_archives(df, folder=f"file://{tmp_path}/a")
    records = [r for f in sorted(Path(tmp_path / "a").glob("*.warc.gz")) for r in parsed(f.read_bytes())]
    kinds = Counter(h["WARC-Type"] for h, _ in records)
    assert kinds["response"] == 5 and kinds["revisit"] == 5 and kinds["warcinfo"] >= 1
    assert len({h["WARC-Record-ID"] for h, _ in records}) == len(records)
    bodies = sorted(b.split(b"\r\n\r\n", 1)[1] for h, b in records if h["WARC-Type"] == "response")
    assert bodies == sorted(x.encode() for x in ("a", "", "ü" * 100_000, PAGES[8][2], "b"))
    ids = {h["WARC-Record-ID"] for h, _ in records if h["WARC-Type"] == "response"}
    assert all(h["WARC-Refers-To"] in ids for h, _ in records if h["WARC-Type"] == "revisit")
    for r in index.collect():  # each range is one record
        data = Path(r["file"].removeprefix("file://")).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        headers, block = warc.opened(data)
        assert headers["WARC-Type"] == r["record_type"] and headers["WARC-Payload-Digest"] == f"sha1:{r['payload_digest']}"
        assert parsed(data) == [(headers, block)]
    got = Counter(tuple(r) for r in warc.read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = Counter()
    for text in {t or "" for _, _, t in PAGES}:
        of = sorted(((p is not None, p or 0, u or "") for p, u, t in PAGES if (t or "") == text), reverse=True)
        digest, size = b32encode(hashlib.sha1(text.encode()).digest()).decode(), len(text.encode())
        for k, (known, page, _) in enumerate(of):
            want[(page if known else None, size, digest, "revisit" if k else "response", of[0][1] if k else None)] += 1
    assert got == want


def test_archives_of_small_payloads_and_selections(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    index = warc.write_archives(df, least=2)
    assert index.where("record_type = 'revisit'").count() == 0 and index.count() == len(PAGES)
    some = warc.read_records(index.where("page_id = 6")).collect()
    assert sorted(bytes(r["payload"]) for r in some) == [b"b", PAGES[8][2].encode()]
    assert warc.read_records(index.where("page_id = 77")).count() == 0
    assert warc.archive(df.limit(0)).count() == 0
    raw = spark.sql("SELECT 1L AS page_id, cast(X'41FF' AS string) AS url, cast(X'41FF42' AS string) AS html")
    assert [bytes(r["payload"]) for r in warc.read_records(warc.write_archives(raw)).collect()] == [b"A\xffB"]


def test_damaged_archives_are_refused(spark, tmp_path):
    index = warc.write_archives(spark.createDataFrame([(1, "u", "text " * 50)], "page_id long, url string, html string"), folder=f"file://{tmp_path}/b")
    file = next(Path(tmp_path / "b").glob("*.warc.gz"))
    data = file.read_bytes()
    row = index.first()
    _, block = warc.opened(data[row["offset"] :])
    other = warc.record("response", [("WARC-Record-ID", warc.record_id(1, "X")), ("WARC-Payload-Digest", "sha1:X"), ("WARC-Block-Digest", f"sha1:{warc.base32_sha1(block)}")], block, "d")
    file.write_bytes(data[: row["offset"]] + other)
    with pytest.raises(Exception, match="damaged record"):
        warc.read_records(index.selectExpr("file", "offset", f"{len(other)}L AS length")).collect()


def test_ranges_are_joined(monkeypatch):
    monkeypatch.setattr(warc, "GAP", 10)
    monkeypatch.setattr(warc, "READ", 100)
    rows = [("a", 0, 20), ("a", 25, 20), ("a", 60, 20), ("a", 80, 90), ("b", 80, 1)]
    assert list(warc.joined_ranges(iter(rows))) == [("a", 0, 45, [0, 1]), ("a", 60, 80, [2]), ("a", 80, 170, [3]), ("b", 80, 81, [4])]


def test_files_roll_over(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ROLL", 2000)
    writer = warc.Writer(f"file://{tmp_path}/c", "d")
    places = [writer.add(warc.record("response", [("A", "b")], random.Random(k).randbytes(700), "d")) for k in range(9)]
    writer.close()
    assert len({f for f, _ in places}) > 3
    for k, (file, offset) in enumerate(places):
        data = Path(file.removeprefix("file://")).read_bytes()
        assert parsed(data[offset : next((o for f, o in places[k + 1 :] if f == file), len(data))])[0][1] == random.Random(k).randbytes(700)


# op13
def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = j = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j == 1


def brute(rows, draw):
    count = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % draw == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    alike = defaultdict(list)
    for w in words:
        for k in {w[:i] + w[i + 1 :] for i in range(len(w))} | {w}:
            alike[k].append(w)
    near = defaultdict(set)
    for group in alike.values():
        for a in group:
            near[a] |= {b for b in group if b not in near[a] and one_edit(a, b)}
    form = {w: b for w in words if near[w] for b in [min(near[w], key=lambda x: (-words[x], x))] if words[b] >= 5 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


@pytest.mark.parametrize("most", [4096, 16, 2])
def test_variants_by_brute_force(spark, most):
    r = random.Random(1)
    rows = [(d, " ".join("".join(r.choice("abÀé") for _ in range(r.randint(5, 9))) for _ in range(300))) for d in range(200)]
    rows += [(None, "Abcdefx " * 6 + "abcdef " * 40 + "abcdef× " * 7), (7, None), (8, ""), (9, ("q" * 900 + " ") * 30 + ("q" * 901 + " ") * 6 + ("q" * 899 + "é ") * 5), (10, "abcdefg " * 9), (10, "abcdefg " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "'x' AS shared").repartition(3)
    got = sorted(tuple(x) for x in spelling.grouped(spelling.vocabulary(df, 7), most=most).collect())
    want = brute(rows, 7)
    assert got == want and sum(x[4] for x in want) > 1000


def test_variants_of_chains_and_small_batches(spark, monkeypatch):
    """Forms that lead on to other forms, lists cut into blocks of few words, slices of few pairs."""
    monkeypatch.setattr(spelling, "WORDS", 7)
    monkeypatch.setattr(spelling, "PAIRS", 50)
    words = ["aaaaaa"[:k] + "b" * (6 - k) for k in range(7)]
    rows = [(k, " ".join([w] * 5**1 * (5**k if k < 5 else 5**4))) for k, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(x) for x in spelling.variants(df, 10**9).collect())
    assert got == brute(rows, 10**9) and len({x[2] for x in got}) < 4


def test_variants_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(tuple(x) for x in queries.QUERIES["op13_spelling_variants"](spark, SF).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 199) and len(got) > 100


def test_variants_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(none).count() == 0
    raw = spark.sql("SELECT 1L AS doc_id, repeat(concat(cast(X'41FF42' AS string), ' abcdef '), 6) AS text")
    assert [tuple(r) for r in spelling.variants(raw).collect()] == [("abcdef", None, "abcdef", 6, 0, None)]


def test_walk_finds_every_pair():
    r = random.Random(3)
    for _ in range(30):
        lists = [sorted({"".join(r.choice("ab") for _ in range(r.randint(0, 5))) for _ in range(r.randint(1, 30))}) for _ in range(3)]
        middle = [w for ws in lists for w in ws]
        of = [k for k, ws in enumerate(lists) for _ in ws]
        points = np.frombuffer("".join(middle).encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(w) for w in middle])]).astype(np.int64)
        new = np.array([k == 0 or of[k] != of[k - 1] for k in range(len(of))])
        begins = np.append(np.flatnonzero(new), len(of))
        got = {}
        for one, other, goes_on in spelling.pairs(points, at, begins[of], begins[np.array(of) + 1], spelling.shared_letters(points, at, new)):
            for a, b, g in zip(one.tolist(), other.tolist(), goes_on.tolist(), strict=True):
                assert (a, b) not in got
                got[(a, b)] = g
        want = {(a, b): len(middle[a]) != len(middle[b]) and (middle[a].startswith(middle[b]) or middle[b].startswith(middle[a])) for a in range(len(of)) for b in range(len(of)) if of[a] == of[b] and one_edit(middle[a], middle[b])}
        assert got == want


def test_batches_of_integers():
    batch = pa.RecordBatch.from_arrays([pa.array([2, 3, 2], pa.int32()), pa.array([np.arange(k, dtype="<i8").tobytes() for k in (2, 3, 2)], pa.binary())], names=["dim", "x"])
    assert [(d, r.tolist(), x.tolist()) for d, r, x in whiten.blocks(batch)] == [(2, [0, 2], [[0, 1], [0, 1]]), (3, [1], [[0, 1, 2]])]
