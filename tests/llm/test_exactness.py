"""Results that must not rest on hashes, on unique ids or on short inputs."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from test_operators import PATH, VOCAB, docs_of, near_brute, prose

from siftwell.llm import bpe, decontaminate, minhash, substrings
from siftwell.llm import kernels as K

LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def encoded(texts):
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    return [ids for out in bpe.encoded_batches(iter([batch]), PATH) for ids in out.column(1).to_pylist()]


# op3
def test_bpe_of_every_code_point():
    r = random.Random(5)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    r.shuffle(points)
    texts = ["".join(points[i : i + 40]) for i in range(0, len(points), 40)]
    texts += ["".join(r.choice(points) if r.random() < 0.5 else r.choice(" 'stdmlrve19aZ\n\t ") for _ in range(30)) for _ in range(5000)]
    assert encoded(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_bpe_compares_bytes(monkeypatch):
    texts = [*thue_morse(10), prose(300, random.Random(1)), "x" * 100 + " " + "y" * 100, prose(300, random.Random(2))]
    want = [LIBRARY.encode_ordinary(t) for t in texts]
    assert encoded(texts) == want
    monkeypatch.setattr(K, "byte_hashes", lambda data, begin, end: (end - begin).astype(np.uint64) % np.uint64(5))
    monkeypatch.setattr(bpe.Encoder, "kept", {})
    for _ in range(2):  # the second time from the cache
        assert encoded(texts) == want


def test_hash_helpers():
    data = np.frombuffer(b"abcabcabd" + b"z" * 200 + b"z" * 199 + b"y", np.uint8)
    begin, end = np.array([0, 3, 6, 9, 209, 0]), np.array([3, 6, 9, 209, 409, 0])
    h = K.byte_hashes(data, begin, end)
    assert h[0] == h[1] and len(set(h.tolist())) == 5
    assert K.equal_spans(data, begin, data, begin[[1, 0, 0, 4, 4, 2]], end - begin).tolist() == [True, True, False, False, True, True]
    values = K.mix(np.arange(9000, dtype=np.uint64))
    runs = K.run_hashes(np.concatenate([values, values]), np.array([0, 9000, 1]), 5000)
    assert runs[0] == runs[1] != runs[2]
    for size in (1, 2, 3, 50, 64, 300):
        twice = K.window_hashes(np.concatenate([values[:400], values[:400]]).astype(np.uint32), size)
        assert len(twice) == 801 - size and (twice[: 401 - size] == twice[400:]).all() and len(set(twice.tolist())) == 400


# op5
def test_near_duplicates_of_colliding_words(spark):
    one, two = thue_morse(10)
    texts = [(1, f"{one} b c d"), (2, f"{two} b c d"), (3, f"{one.upper()}  b c d")]
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(docs_of(spark, texts), 4).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_sets_are_compared_by_words(monkeypatch):
    r = random.Random(3)
    texts = [prose(r.randint(0, 60), r) for _ in range(20)]
    texts += [texts[4] + " tail", "b a", "a b", ""]
    monkeypatch.setattr(K, "byte_hashes", lambda data, begin, end: (end - begin).astype(np.uint64) % np.uint64(3))
    values, at = minhash.exact_sets([t.encode() for t in texts], 4)
    found = [set(values[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)]
    want = [set(map(tuple, (t.split()[k : k + 4] for k in range(max(1, len(t.split()) - 3))))) if t else set() for t in texts]
    for i in range(len(texts)):
        assert len(found[i]) == len(want[i])
        for j in range(i):
            assert len(found[i] & found[j]) == len(want[i] & want[j])


@pytest.mark.parametrize("stars", [True, False])
def test_near_duplicates_of_long_chains(spark, monkeypatch, stars):
    """Each text links with its neighbours in a chain, and with the leader only at its start."""
    monkeypatch.setattr(minhash, "CHUNK", 6)
    if not stars:
        stars_of = minhash.star_units
        monkeypatch.setattr(minhash, "star_units", lambda buckets: stars_of(buckets).limit(0))
    r = random.Random(14)
    words, texts = prose(150, r).split(), []
    for i in range(90):
        words[r.randrange(len(words))] = r.choice(VOCAB)
        texts.append((i * 7 % 90, " ".join(words)))
    texts += [(200 + i, prose(40, r)) for i in range(10)] + [(None, texts[30][1] + " end")]
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(docs_of(spark, texts), 4).collect()}
    want = {i: c for i, (_, c) in near_brute(texts[:-1], 4).items()}
    assert {i: c for i, c in got.items() if i is not None} == want
    assert got[None] == want[texts[30][0]]


# op9
def test_heavy_seeds_change_nothing(spark, monkeypatch):
    """A passage that most documents share: its seeds keep their anchors where they are read."""
    r = random.Random(31)
    line, passage = prose(9, r), prose(70, r)
    texts = [(i, " ".join([prose(r.randint(5, 90), r), passage if i % 3 else line, prose(r.randint(5, 90), r), line])) for i in range(120)]
    docs = docs_of(spark, texts)
    monkeypatch.setattr(substrings, "HEAVY", 400)
    heavy = substrings.heavy_anchors(docs.select("doc_id", "text"), 4)
    assert len(heavy.seed) > 3
    one = substrings.repeats(docs).collect()
    monkeypatch.setattr(substrings, "HEAVY", 1e-9)
    assert len(substrings.heavy_anchors(docs.select("doc_id", "text"), 4).seed) == 0
    assert Counter(substrings.repeats(docs).collect()) == Counter(one)
    assert {x["doc_id"] for x in one} == {i for i, _ in texts if i % 3 and i != 1}


def test_rows_that_share_an_id_keep_their_own_text(spark):
    """Each row is matched and cut by its own text; equal rows are one document; null ids are left alone."""
    r = random.Random(41)
    passage, clean = prose(80, r), prose(120, r)
    source, hit = prose(30, r) + " " + passage, passage + " " + prose(40, r)
    big = 1 << 60
    texts = [(1, source), (7, hit), (7, clean), (7, clean), (8, prose(30, r)), (None, hit), (big + 1, clean + " tail"), (big + 1, hit + " end"), (big + 2, "")]
    for rows in (texts, [(None if i is None else -i, t) for i, t in texts]):
        docs = docs_of(spark, rows)
        out = substrings.remove_repeats(docs)
        assert out.columns == docs.columns
        left = Counter((x["doc_id"], x["text"]) for x in out.collect())
        assert sum(left.values()) == len(rows)
        assert all(left[i, t] == 1 for i, t in rows if i is None or t == "" or abs(i) == 8)
        # one row of each repeated passage keeps it, and nothing else is lost
        held = [t for (i, t), n in left.items() for _ in range(n) if i is not None and passage in (t or "")]
        assert len(held) == 1
        whole = [t for (i, t), n in left.items() for _ in range(n) if clean in (t or "")]
        assert len(whole) in (1, 2)
    plain = docs_of(spark, [(7, hit), (7, clean), (1, source)])
    assert Counter((x["doc_id"], x["text"].strip()) for x in substrings.remove_repeats(plain).collect()) == Counter([(7, hit.removeprefix(passage).strip()), (7, clean), (1, source)])


def test_spans_of_rows_that_share_an_id(spark):
    r = random.Random(42)
    item, clean = prose(12, r), prose(60, r)
    docs = docs_of(spark, [(7, f"a {item} b"), (7, clean), (None, f"{item} c"), (None, clean)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for most in (100, 0):
        assert Counter((x["doc_id"], x["text"]) for x in decontaminate.remove_spans(docs, bench, most=most).collect()) == Counter([(7, "a  b"), (7, clean), (None, " c"), (None, clean)])
        assert Counter((x["doc_id"], x["text"]) for x in decontaminate.drop_contaminated(docs, bench, most=most).collect()) == Counter([(7, clean), (None, clean)])


def test_a_worker_hands_back_memory_at_the_end_of_a_task(monkeypatch):
    ended = []
    monkeypatch.setattr(K, "hand_back", lambda: ended.append(True))
    batches = [pa.RecordBatch.from_arrays([pa.array(["a b", None] * n, pa.string())], names=["text"]) for n in (3, 0, 2)]
    found = K.blocks(iter(batches), most=4)
    assert len(next(found)) == 2 and not ended
    assert sum(len(block) for block in found) == 8 and ended == [True]
    monkeypatch.undo()
    K.hand_back()


def test_ranges_of_repeated_seeds_are_dealt_out_once(spark):
    """Ranges of documents in one shuffle, as a plain loop over each document's seeds gives them."""
    r = np.random.default_rng(5)
    rows = [(d, int(p), int(r.choice([d, 0]))) for d in range(1, 60) for p in np.unique(r.integers(0, 400, r.integers(1, 120)))]
    known = spark.createDataFrame(rows, "doc_id long, pos int, anchor_id long").repartition(4)
    found = substrings.candidates(known.union(known.limit(7)), 4, 50)
    assert len(re.findall(r"Exchange hashpartitioning", found._jdf.queryExecution().executedPlan().toString())) == 1
    want = {}
    for d in range(1, 60):
        places = sorted((p, a == d) for x, p, a in rows if x == d)
        cuts = [k for k in range(len(places)) if not k or places[k][0] - places[k - 1][0] > substrings.WINDOW]
        runs = [places[a:b] for a, b in zip(cuts, [*cuts[1:], len(places)], strict=True)]
        runs = [x for x in runs if x[-1][0] - x[0][0] >= 50 - substrings.SEED - 2 * (substrings.WINDOW - 1)]
        if runs:
            low, high = [max(0, x[0][0] - substrings.WINDOW + 1) for x in runs], [x[-1][0] + substrings.SEED + substrings.WINDOW - 1 for x in runs]
            want[d] = low, high, [p for x in runs for p, own in x if own]
    assert len(want) > 10 and {x["doc_id"]: (x["low"], x["high"], x["own"]) for x in found.collect()} == want


def test_equal_words_along_diagonals():
    r = np.random.default_rng(6)
    a, b = r.integers(0, 2, 900, np.uint32), r.integers(0, 2, 700, np.uint32)
    diagonal = substrings.Diagonal(a, b)
    for _ in range(2000):
        i, j = int(r.integers(0, 900)), int(r.integers(0, 700))
        size = int(r.integers(0, min(900 - i, 700 - j) + 1)) if r.random() < 0.2 else min(4, 900 - i, 700 - j)
        assert all(diagonal.equal(i + k, j + k, size - k) == int((a[i + k : i + size] == b[j + k : j + size]).sum()) for k in (0, size // 2))
