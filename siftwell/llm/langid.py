"""Language identification: TF-IDF character n-grams and sparse multinomial logistic regression.

Texts are lower-cased, runs of non-letters become one blank, and n-grams of 1 to 3 characters
are hashed into ``SIZE`` buckets. Document frequencies are counted over every training document.
The weights are learnt by FTRL with elastic net on a bounded sample: about ``PER_LANGUAGE`` rows of
each language and ``SAMPLE`` in all, drawn by a hash of the row, equal rows once, from the
``LANGUAGES`` languages of the most rows (rarer ones are not learnt). Features are made before the
rows meet in the training task, so a row brings a bounded share whatever its text. A fifth of
the sample sets the softmax temperature. Every whole text is scored.

Only text and non-null lang of rows outside the held-out fold are learnt from; predictions use
the text alone. A null text, or one without a letter, is ``und`` with score 0. Without any
training row every text is ``und``. A null doc_id is never learnt from. Repeated rows are
repeated; bytes that are no UTF-8 are read as U+FFFD; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import linear
from siftwell.llm.pretokenize import LETTER, classes

SIZE = 1 << 14
PER_LANGUAGE, SAMPLE, LANGUAGES = 1500, 24_000, 1000
BLOCK_CHARS = 1 << 20
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the folded texts end to end, their bounds, and which texts have a letter."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    letter = classes()[points] == LETTER
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    gap = ~letter
    repeated = np.zeros(len(points), bool)
    repeated[1:] = gap[1:] & gap[:-1] & (text[1:] == text[:-1])
    keep = ~repeated
    counts = np.bincount(text[keep], minlength=len(texts))
    lettered = np.bincount(text[letter], minlength=len(texts)) > 0
    return np.where(letter, points, 32)[keep], np.concatenate([[0], np.cumsum(counts)]), lettered


def buckets(points: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that begins at each place, for n = 1, 2, 3."""
    p = points.astype(np.uint64)
    out, h = [], np.zeros(len(p), np.uint64)
    for n in range(3):
        h = h[: max(0, len(p) - n)] * FACTORS[1] + (p[n:] + np.uint64(n + 1)) * FACTORS[2]
        out.append(((h * FACTORS[0]) >> np.uint64(64 - 14)).astype(np.int64))
    return out


def counted(texts: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
    """Bucket counts of each text, and whether it has a letter."""
    points, at, lettered = folded(texts)
    grams = buckets(points)
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        own = [g[a : max(a, b - n)] for n, g in enumerate(grams)]
        yield np.bincount(np.concatenate(own), minlength=SIZE), bool(lettered[i])


def text_blocks(column: pa.Array) -> Iterator[list[str]]:
    block, chars = [], 0
    for value in column:
        text = value.as_py() or ""
        if block and chars + len(text) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append(text)
        chars += len(text)
    if block:
        yield block


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, and their number, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                for counts, _ in counted(block):
                    total += counts > 0
                    rows += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(SIZE), -1)), pa.array(np.append(total, rows))], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE + 1, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out[:SIZE], int(out[SIZE])


def weighted(counts: np.ndarray, idf: np.ndarray) -> linear.Row:
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


def train(sample: DataFrame, languages: list[str], idf: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and temperature, learnt in one task from the features of the bounded sample (text, label, fold)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = [weighted(c, idf) for block in text_blocks(part.column(0)) for c, _ in counted(block)]
                packed = [pa.array([np.asarray(row[k], kind).tobytes() for row in made], pa.binary()) for k, kind in ((0, np.int32), (1, np.float32))]
                yield pa.RecordBatch.from_arrays([*packed, part.column(1), part.column(2)], names=["at", "x", "label", "fold"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, labels, folds = [], [], []
        for frame in frames:
            rows += [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32)) for a, x in zip(frame["at"], frame["x"], strict=True)]
            labels += frame["label"].tolist()
            folds += frame["fold"].tolist()
        if not rows:
            return
        order = np.lexsort((np.array([len(at) for at, _ in rows]), np.array(folds)))  # whatever order rows came in
        rows, y, fold = [rows[k] for k in order], np.array(labels)[order], np.array(folds)[order]
        held = fold % 5 == 0
        fitted = linear.fit([r for r, h in zip(rows, held, strict=True) if not h], y[~held], SIZE, len(languages), alpha=2.0, l1=0.05, l2=0.1)
        heat = linear.temperature(linear.scores([r for r, h in zip(rows, held, strict=True) if h], fitted), y[held]) if held.any() else 1.0
        yield pd.DataFrame({"weights": [fitted.astype(np.float32).tobytes()], "temperature": [heat]})

    made = sample.mapInArrow(rows, "at binary, x binary, label int, fold long")
    found = made.repartition(1).mapInPandas(run, "weights binary, temperature double").collect()
    if not found:
        return np.zeros((SIZE, len(languages)), np.float32), 1.0
    return np.frombuffer(bytes(found[0]["weights"]), np.float32).reshape(SIZE, -1), found[0]["temperature"]


def identify(docs: DataFrame, folds: int = 4, held: int = 2, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8(F.col("text").cast("string")).alias("text"), F.make_valid_utf8(F.col("lang").cast("string")).alias("lang"), F.coalesce(fold == held, F.lit(False)).alias("held_out"))
    known = texts.where("doc_id is not null and text is not null and lang is not null and not held_out")
    per = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not per:
        return texts.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    languages = sorted(r["lang"] for r in per)
    most = min(per_language, SAMPLE // len(per))
    total, n = frequencies(known)
    idf = np.log((1 + n) / (1 + total)) + 1
    label = F.create_map(*(F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)))
    share = F.create_map(*(F.lit(x) for r in per for x in (r["lang"], min(1.0, most / r["count"]))))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    sample = known.where(draw < share[F.col("lang")] * float(1 << 30)).select("text", label[F.col("lang")].alias("label"), draw.alias("fold")).dropDuplicates(["label", "fold"])
    weights, heat = train(sample, languages, idf)
    model = docs.sparkSession.sparkContext.broadcast((weights, heat, idf, languages))  # SIZE numbers a language, LANGUAGES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, heat, idf, languages = model.value
        for batch in batches:
            start = 0
            for block in text_blocks(batch.column(2)):
                label, score = [], []
                for counts, lettered in counted(block):
                    if not lettered:
                        label.append("und"), score.append(0.0)
                        continue
                    at, x = weighted(counts, idf)
                    p = linear.softmax(x @ weights[at] / heat)
                    label.append(languages[int(p.argmax())]), score.append(float(p.max()))
                part = batch.slice(start, len(block))
                start += len(block)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(label), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return texts.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
