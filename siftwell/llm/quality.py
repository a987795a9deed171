"""Quality classifier by co-training of a text view and a page-metadata view.

The text view sees which words and word beginnings a document holds (hashed, by presence), its byte
pairs, and how its words repeat. The metadata view sees what is known of the page: source, language
and layout figures (size, lines, shares of character kinds), each cut into bins. Both are logistic
regressions learnt by FTRL. In each round both views judge every document that is not among the
labelled ones; of those that a view is sure of, by probabilities calibrated on labelled rows that it
has not learnt from (a view that cannot tell a kind of bad page is then never sure of a good one), a
uniform draw of different texts of either class goes to the other, which learns from them. At last
each view is calibrated on labelled rows that took no part in any round, the calibrated log-odds are
combined there, and every document is scored.

A good document has quality 1 and, where the label is given, toxic 0. The models learn from at most
about ``LABELLED`` labelled rows, drawn by a hash of the row, at most ``PER_ID`` rows of one labelled
doc_id, and one of equal rows. All other documents can be pseudo-labelled: tasks keep the
``PER_ROUND`` draws of each view and class, so what meets is a few hundred row numbers a task.
Features are made before the rows meet in the training task, so a row brings at most a few hundred
kilobytes whatever its text. All documents are scored on their whole texts. Labels are for doc_ids; of
repeated labels the worst counts. Null and empty texts are scored like others (no words). Without
labels of both kinds every document has score 0.5 and is kept. Each row is judged by itself. Extra
columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm import kernels as K
from siftwell.llm import linear
from siftwell.llm.common import keeping_columns, stored

LABELLED, PER_ID = 6000, 4
WORD_BITS, PAIR_BITS = 17, 12
#: Lengths in bytes of the word beginnings.
STEMS = (4, 5)
BINS, NAMES = 24, 512
#: Layout figures of the metadata view, figures of repetition of the text view.
LAYOUT, REPEATS = 7, 4
PAIRS_AT = 1 << WORD_BITS
REPEATS_AT = PAIRS_AT + (1 << PAIR_BITS)
TEXT_SIZE = REPEATS_AT + REPEATS * BINS + 1
META_SIZE = LAYOUT * BINS + 2 * NAMES + 1
#: Rounds, rows that a view hands over of each class in a round, and the probability that makes it sure.
ROUNDS, PER_ROUND, SURE = 2, 75, 0.99
THRESHOLD = 0.6
#: Columns of scores, by names that no document's own column is likely to have.
SCORES = {"quality text_score": "double", "quality meta_score": "double", "quality score": "double", "quality kept": "boolean"}

UPPER, DIGIT, SPACE = (np.zeros(256, bool) for _ in range(3))
UPPER[0x41:0x5B] = DIGIT[0x30:0x3A] = True
SPACE[[0x20, *range(0x09, 0x0E)]] = True
MARK = ~(K.ITEM_WORDS | UPPER | SPACE)


@dataclass
class Parts:
    """Of a block: distinct word features (text i has ``values[bounds[i]:bounds[i + 1]]``), byte pairs, figures of layout and of repetition."""

    values: np.ndarray
    bounds: np.ndarray
    pairs: np.ndarray
    layout: np.ndarray
    repeats: np.ndarray


def parts_of(block: K.Block) -> Parts:
    n = len(block)
    found = K.words(block, K.ITEM_WORDS)
    loose = K.words(block, K.SPACE_WORDS)
    word_text = np.repeat(np.arange(n), np.diff(found.at))
    lower = K.LOWER[block.data]
    stems = [K.byte_hashes(lower, found.begin, np.minimum(found.end, found.begin + k)) for k in STEMS]
    seen = np.concatenate([found.hashes, *stems]) >> np.uint64(64 - WORD_BITS)
    values, bounds = K.distinct_by_text(seen, np.tile(word_text, 1 + len(STEMS)), n)
    data = block.data.astype(np.uint64)
    pairs = ((data[:-1] * np.uint64(257) + data[1:]) * np.uint64(K.BASE)) >> np.uint64(64 - PAIR_BITS)
    size = np.maximum(1, np.diff(block.at))
    sums = [np.append(0, np.cumsum(kind[block.data])) for kind in (UPPER, DIGIT, SPACE, MARK)]
    shares = [np.diff(s[block.at]) / size for s in sums]
    lines = np.diff(np.append(0, np.cumsum(block.data == 0x0A))[block.at]) + 1
    loose_text = np.repeat(np.arange(n), np.diff(loose.at))
    words = np.maximum(1, np.diff(loose.at))
    distinct = np.diff(K.distinct_by_text(loose.hashes, loose_text, n)[1])
    follows = np.zeros(len(loose.hashes), bool)
    follows[1:] = (loose.hashes[1:] == loose.hashes[:-1]) & (loose_text[1:] == loose_text[:-1])
    stutter = np.bincount(loose_text[follows], minlength=n)
    letters = np.bincount(loose_text, weights=loose.end - loose.begin, minlength=n)
    layout = np.column_stack([np.log1p(size) / 14, np.log1p(lines) / 8, np.log1p(size / lines) / 12, *shares])
    repeats = np.column_stack([distinct / words, stutter / words, letters / words / 20, np.log1p(words) / 12])
    return Parts(values.astype(np.int64), bounds, pairs.astype(np.int64), layout, repeats)


def binned(figures: np.ndarray) -> np.ndarray:
    """A feature for each figure (last axis), by the bin of its value."""
    return np.minimum((np.clip(figures, 0, 1) * BINS).astype(np.int64), BINS - 1) + np.arange(figures.shape[-1]) * BINS


def pair_shares(block: K.Block, own: Parts, first: int, stop: int) -> np.ndarray:
    """Feature values of the byte pairs of texts ``first`` to ``stop``, a row each."""
    a, b = block.at[first], block.at[stop]
    text = np.repeat(np.arange(stop - first), np.diff(block.at[first : stop + 1]))
    inside = np.flatnonzero(text[1:] == text[:-1])  # a pair lies in one text
    key = text[inside] << PAIR_BITS | own.pairs[a:b][inside]
    count = np.bincount(key, minlength=(stop - first) << PAIR_BITS).reshape(stop - first, 1 << PAIR_BITS)
    return 12 * np.sqrt(count / np.maximum(1, np.diff(block.at[first : stop + 1]))[:, None])


def text_rows(block: K.Block, own: Parts) -> list[linear.Row]:
    """Text-view features of each text."""
    rows, repeats = [], binned(own.repeats) + REPEATS_AT
    for i in range(len(block)):
        x = pair_shares(block, own, i, i + 1)[0]
        at, words = np.flatnonzero(x), own.values[own.bounds[i] : own.bounds[i + 1]]
        rows.append((np.concatenate([words, at + PAIRS_AT, repeats[i], [TEXT_SIZE - 1]]), np.concatenate([np.ones(len(words)), x[at], np.ones(REPEATS + 1)])))
    return rows


def text_margins(block: K.Block, own: Parts, weights: np.ndarray) -> np.ndarray:
    """Log-odds of the text view of each text: the product of ``text_rows`` and the weights."""
    total = np.append(0.0, np.cumsum(weights[own.values], dtype=np.float64))[own.bounds]
    out = np.diff(total) + weights[TEXT_SIZE - 1] + weights[binned(own.repeats) + REPEATS_AT].sum(1)
    for first in range(0, len(block), 64):
        stop = min(first + 64, len(block))
        out[first:stop] += pair_shares(block, own, first, stop) @ weights[PAIRS_AT:REPEATS_AT]
    return out


def meta_row(layout: np.ndarray, source: str | None, lang: str | None) -> linear.Row:
    bins = binned(layout)
    names = [LAYOUT * BINS + k * NAMES + crc32((v or "").encode()) % NAMES for k, v in enumerate((source, lang))]
    return np.concatenate([bins, names, [META_SIZE - 1]]), np.ones(len(bins) + 3)


@dataclass
class Model:
    """Weights of both views, and coefficients (text, metadata, intercept) of the calibrated combination."""

    text: np.ndarray
    meta: np.ndarray
    text_line: np.ndarray
    meta_line: np.ndarray
    both: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities by text, by metadata and by both, from the log-odds of the views."""
        t, m = text * self.text_line[0] + self.text_line[1], meta * self.meta_line[0] + self.meta_line[1]
        both = t * self.both[0] + m * self.both[1] + self.both[2]
        return tuple(1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (t, m, both))


def margin(weights: np.ndarray) -> np.ndarray:
    """Log-odds weights of the good class."""
    return (weights[:, 1] - weights[:, 0]).astype(np.float32)


VIEWS = ((TEXT_SIZE, {"alpha": 2.0, "l1": 4.0, "l2": 0.1}), (META_SIZE, {"alpha": 0.5, "l1": 0.02, "l2": 0.1}))


def fit_views(views: list[list[linear.Row]], good: np.ndarray, fold: np.ndarray, given: list[np.ndarray], last: bool) -> Model:
    """Both views learnt from labelled rows (``good`` 1 or 0) and, each, from what the other gave it (``given``: 1, 0, else -1).

    In the rounds each of folds 1 to 3 is judged by what is learnt without it, which calibrates a view
    learnt from all three; fold 0 is put aside. At last fold 0 calibrates and combines.
    """
    folds = [0] if last else [1, 2, 3]
    held = [np.flatnonzero((good >= 0) & (fold == f)) for f in folds]
    y = good[np.concatenate(held)]
    both_kinds = len(set(y.tolist())) == 2
    weights, lines, odds = [], [], []
    for (size, params), rows, own in zip(VIEWS, views, given, strict=True):
        label = np.where((good >= 0) & (fold > 0), good, own)

        def learnt(out: int, rows=rows, label=label, size=size, params=params) -> np.ndarray:
            use = np.flatnonzero((label >= 0) & ((good < 0) | (fold != out)))
            return margin(linear.fit([rows[i] for i in use], label[use], size, 2, epochs=3 if last else 1, **params))

        w = learnt(0)
        x = np.concatenate([[rows[i][1] @ v[rows[i][0]] for i in part] for part, v in zip(held, [w] if last else map(learnt, folds), strict=True)])
        line = linear.logistic(x[:, None], y) if both_kinds else np.array([1.0, 0.0])
        weights.append(w), lines.append(line), odds.append(x * line[0] + line[1])
    both = linear.logistic(np.column_stack(odds), y) if both_kinds and last else np.array([1.0, 1.0, 0.0])
    return Model(*weights, *lines, both)


def drawn_sure(p: np.ndarray, look: np.ndarray, row: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray]:
    """(look, row) of at most PER_ROUND different texts that a view puts in the class, by least look, then row."""
    sure = np.flatnonzero((p if label else 1 - p) >= SURE)
    sure = sure[np.lexsort((row[sure], look[sure]))]
    first = np.append(True, look[sure][1:] != look[sure][:-1])[: len(sure)]
    return look[sure][first][:PER_ROUND], row[sure][first][:PER_ROUND]


def co_train(text: list[linear.Row], meta: list[linear.Row], label: np.ndarray, fold: np.ndarray, look: np.ndarray | None = None, rounds: int = ROUNDS) -> Model:
    """Co-training of rows in memory, as ``learn`` does it over a table. ``label``: 1 good, 0 bad, -1 unknown."""
    views, look = [text, meta], np.arange(len(label)) if look is None else look
    given = [np.full(len(label), -1) for _ in views]
    pool = np.flatnonzero(label < 0)
    for _ in range(rounds):
        model = fit_views(views, label, fold, given, False)
        odds = (np.array([rows[i][1] @ w[rows[i][0]] for i in pool]) for rows, w in zip(views, (model.text, model.meta), strict=True))
        found = []
        for k, p in enumerate(model.scores(*odds)[:2]):
            left = ~np.isin(look[pool], look[given[1 - k] >= 0])
            found += [(k, y, drawn_sure(p[left], look[pool][left], pool[left], y)[1]) for y in (0, 1)]
        for k, y, rows in found:
            given[1 - k][rows] = y
        if not any(len(rows) for _, _, rows in found):
            break
    return fit_views(views, label, fold, given, True)


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[K.Block, Parts, list[linear.Row]]]:
    """Blocks with the parts of their texts and the metadata rows."""
    for block in K.blocks(batches):
        own = parts_of(block)
        source, lang = ([None if x is None else x.decode("utf-8", "replace") for x in block.batch.column(block.batch.schema.get_field_index(c)).cast(pa.binary()).to_pylist()] for c in ("source", "lang"))
        yield block, own, [meta_row(f, s, g) for f, s, g in zip(own.layout, source, lang, strict=True)]


def with_strings(docs: DataFrame) -> DataFrame:
    """``docs`` with text, source and lang as strings."""
    return docs.withColumns({c: F.col(c).cast("string") for c in ("text", "source", "lang")})


def drawn(share: float, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < min(1.0, share) * float(1 << 30)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text, source, lang, with a number for each row (equal rows share it) and for each text (look)."""
    own = with_strings(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang"))
    return own.withColumns({"row": F.xxhash64("doc_id", "text", "source", "lang"), "look": F.xxhash64("text")})


def marked(labels: DataFrame, labelled: int) -> DataFrame:
    """mark id, good: about ``labelled`` labelled doc_ids, drawn by their hash."""
    good = F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0))
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("mark id")).agg(good.alias("good"))
    return marks.where(drawn(labelled / max(1, marks.count()), "mark id"))


def sample(own: DataFrame, marks: DataFrame) -> DataFrame:
    """text, source, lang, row, look, good of the labelled rows: PER_ID of a doc_id."""
    met = own.join(F.broadcast(marks), own["doc_id"] == marks["mark id"])
    few = met.dropDuplicates(["doc_id", "row"]).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("row"))).where(F.col("place") <= PER_ID)
    return few.select("text", "source", "lang", "row", "look", F.col("good").cast("int").alias("good"))


FEATURES = "a binary, b binary, c binary, d binary, row long, look long, good int"


def made_features(rows: DataFrame) -> DataFrame:
    """Packed features of both views (indexes, values, twice) of the rows of ``sample``, equal rows of a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for block, own, metas in features(batches):
            number = block.batch.column(3).to_pylist()
            fresh = [i for i, x in enumerate(number) if x not in seen and number.index(x) == i]
            seen.update(number)
            packed = [[np.asarray(view[i][k], kind).tobytes() for i in fresh] for view in (text_rows(block, own), metas) for k, kind in enumerate((np.int32, np.float32))]
            yield pa.RecordBatch.from_arrays([*(pa.array(p, pa.binary()) for p in packed), *block.batch.take(pa.array(fresh, pa.int64())).columns[3:]], names=["a", "b", "c", "d", "row", "look", "good"])

    return rows.mapInArrow(run, FEATURES)


def taught(made: DataFrame, given: list[dict[int, int]], last: bool) -> Model | None:
    """``fit_views`` in one task that reads the stored features of the bounded sample; None without labels of both kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, tuple[list[linear.Row], int]] = {}
        for batch in batches:
            a, b, c, d, row, _, good = (column.to_pylist() for column in batch.columns)
            for i, number in enumerate(row):
                rows.setdefault(number, ([(np.frombuffer(x, np.int32), np.frombuffer(v, np.float32)) for x, v in ((a[i], b[i]), (c[i], d[i]))], good[i]))
        order = sorted(rows)  # whatever order rows came in
        y = np.array([rows[r][1] for r in order], np.int64)
        if not {0, 1} <= set(y.tolist()):
            return
        own = [np.array([labels.get(r, -1) for r in order]) for labels in given]
        model = fit_views([[rows[r][0][k] for r in order] for k in (0, 1)], y, np.array(order) % 4, own, last)
        parts = [np.asarray(x, np.float64).tobytes() for x in (model.text, model.meta, model.text_line, model.meta_line, model.both)]
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names=list("abcde"))
        del rows, model, a, b, c, d
        K.hand_back()

    found = made.coalesce(1).mapInArrow(run, "a binary, b binary, c binary, d binary, e binary").collect()
    return Model(*(np.frombuffer(bytes(x), np.float64) for x in found[0])) if found else None


def sure_rows(pool: DataFrame, model: Model, taken: list[set[int]]) -> DataFrame:
    """view, good, look, row: what each view hands over of all rows of the pool, without looks that the other has (``taken``).

    A task keeps PER_ROUND of each view and class, so few numbers are shuffled.
    """
    shared = pool.sparkSession.sparkContext.broadcast((model, [np.array(sorted(t), np.int64) for t in taken]))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, taken = shared.value
        best = {(k, y): (np.zeros(0, np.int64), np.zeros(0, np.int64)) for k in (0, 1) for y in (0, 1)}
        for block, parts, metas in features(batches):
            row, look = (block.batch.column(k).to_numpy() for k in (3, 4))
            p = model.scores(text_margins(block, parts, model.text), np.array([x @ model.meta[at] for at, x in metas]))
            for (k, y), (looks, rows) in best.items():
                left = ~np.isin(look, taken[1 - k])
                known = np.full(len(looks), float(y))
                best[k, y] = drawn_sure(np.append(known, p[k][left]), np.append(looks, look[left]), np.append(rows, row[left]), y)
        for (k, y), (looks, rows) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(looks), k, np.int32)), pa.array(np.full(len(looks), y, np.int32)), pa.array(looks), pa.array(rows)], names=["view", "good", "look", "row"])

    once = pool.select("text", "source", "lang", "row", "look").mapInArrow(run, "view int, good int, look long, row long").groupBy("view", "good", "look").agg(F.min("row").alias("row"))
    place = F.row_number().over(Window.partitionBy("view", "good").orderBy("look"))
    return once.withColumn("place", place).where(F.col("place") <= PER_ROUND).drop("place")


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model | None:
    """The model; None without labels of both kinds. Each round is a pass over all documents."""
    marks = stored(marked(labels, labelled), "quality-marks")
    own = numbered(docs)
    made = stored(made_features(sample(own, marks)), "quality-sample")
    pool = own.join(F.broadcast(marks.select("mark id")), F.col("doc_id") == F.col("mark id"), "left_anti")
    given: list[dict[int, int]] = [{}, {}]
    taken: list[set[int]] = [set(), set()]
    for _ in range(rounds):
        model = taught(made, given, False)
        if model is None:
            return None
        found = sure_rows(pool, model, taken).collect()  # PER_ROUND of each view and class
        if not found:
            break
        for r in found:
            given[1 - r["view"]][r["row"]] = r["good"]
            taken[1 - r["view"]].add(r["look"])
        fresh = pool.where(F.col("row").isin([r["row"] for r in found])).select("text", "source", "lang", "row", "look", F.lit(-1).alias("good"))
        made = made.union(stored(made_features(fresh), "quality-given"))
    return taught(made, given, True)


def scored(docs: DataFrame, model: Model, columns: list[str], threshold: float, rejects: bool) -> DataFrame:
    """The given columns of ``docs`` with the scores of each row (rejects: without the rows below the threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    own = with_strings(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts, metas in features(batches):
            meta = np.array([x @ shared.value.meta[at] for at, x in metas])
            text, other, both = shared.value.scores(text_margins(block, parts, shared.value.text), meta)
            kept = both >= threshold
            arrays = [block.batch.column(block.batch.schema.get_field_index(c)) for c in columns] + [pa.array(x) for x in (text, other, both, kept)]
            out = pa.RecordBatch.from_arrays(arrays, names=[*columns, *SCORES])
            yield out.filter(pa.array(kept)) if rejects else out

    kinds = dict(own.dtypes)
    return own.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), *(f"`{c}` {kind}" for c, kind in SCORES.items())]))


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_score, meta_score (calibrated probabilities), score, kept for every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    if model is None:
        return own.select("doc_id", *(F.lit(0.5).alias(c) for c in ("text_score", "meta_score", "score")), F.lit(True).alias("kept"))
    return scored(own, model, ["doc_id"], threshold, False).withColumnsRenamed({c: c.removeprefix("quality ") for c in SCORES})


@keeping_columns
def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents with all their columns, without those that the classifier rejects: one pass, no shuffle."""
    model = learn(docs, labels)
    return docs if model is None else scored(docs, model, docs.columns, threshold, True).drop(*SCORES)
