"""Spelling variant grouping: words one edit apart, found in sorted lists by dynamic programming.

Words are maximal runs of Latin letters, A-Z lower-cased, counted over all texts. Two words are near
if one inserted, deleted or replaced code point makes one of the other. A word's form is its near
word of most occurrences, if that has ``TIMES`` as many as the word.

Near words are looked for among words that share all letters but a segment: of the shorter word's
m places one holds the edit, so a pair meets in the segment of that place, where both have the same
letters before and after it. A list of words that share them is sorted by what lies between, and
every word of the list is compared with all of it at once: rows of the edit matrix, a band of three,
are computed once for each prefix that adjacent words share (their LCP) and used for the whole range
of words behind it; a range whose prefix already needs more than one edit is skipped. The first
segments are the two halves. A list of more than ``LIST`` words is dealt out again by the halves of
its segment, down to a single place, so lists stay small and no pair is lost; a pair counts only
in the segment of its first difference, so none counts twice.

Null texts hold no word; a null doc_id is written as nothing in the key of the spelling draw. Words
of any length are compared whole. Repeated rows count again; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import ascii_lower, stored

LETTERS, LEAST_LENGTH, LEAST_COUNT, TIMES, DRAW = r"A-Za-z\x{00C0}-\x{00FF}", 6, 5, 5, 199
#: Words of a list, at most (unless its segment is one place); words and pairs handled at once in a task.
LIST, WORDS, PAIRS = 4096, 1 << 15, 1 << 18


def spelled(docs: DataFrame, draw: int = DRAW, least_length: int = LEAST_LENGTH) -> DataFrame:
    """A row for each word of at least ``least_length`` letters; ``draw`` divides the hash of a spelling that loses a letter."""
    # shorter runs cannot hold a word; a longer pattern still takes whole runs
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    low = each.select("doc", F.when(F.col("run").rlike("[A-Z]"), ascii_lower(F.col("run"))).otherwise(F.col("run")).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % draw == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least_length)


def vocabulary(docs: DataFrame, draw: int = DRAW, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of enough letters and occurrences."""
    return spelled(docs, draw, least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (word, n, m, b, e) with ``shared``, what a word's list has in common, and ``middle``, what lies in the segment."""
    size, tail = F.length("word"), F.col("m") - F.col("e")
    before = F.substring(F.col("word"), F.lit(1), F.col("b"))
    after = F.substring(F.col("word"), size - tail + 1, tail)
    middle = F.substring(F.col("word"), F.col("b") + 1, size - tail - F.col("b"))
    return rows.select("word", "n", "m", "b", "e", F.concat_ws("\n", "m", "b", "e", before, after).alias("shared"), middle.alias("middle"))


def halved(m: Column, b: Column, e: Column) -> Column:
    """The two halves of a segment."""
    cut = F.floor((b + e) / 2).cast("int")
    return F.array(F.struct(m.alias("m"), b.alias("b"), cut.alias("e")), F.struct(m.alias("m"), cut.alias("b"), e.alias("e")))


def lists(words: DataFrame, most: int | None = None) -> DataFrame:
    """word, n, m, b, e, shared, middle: every word in each list that it may find a near word in."""
    most = LIST if most is None else most
    size, zero = F.length("word"), F.lit(0)
    # a word of m letters meets words of m and m + 1, so it stands in the lists of its own length and of one less
    segments = F.concat(halved(size, zero, size), F.when(size > 1, halved(size - 1, zero, size - 1)).otherwise(F.array()))
    waiting = dealt(words.select("word", "n", F.explode(segments).alias("s")).select("word", "n", "s.*").where("b < e"))
    done = None
    while True:
        large = waiting.where("e - b > 1").groupBy("shared").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > most).select("shared")
        large = stored(large, "spelling-large")
        if large.isEmpty():
            return waiting if done is None else done.unionByName(waiting)
        fine = waiting.join(large, "shared", "left_anti").select(waiting.columns)
        done = fine if done is None else done.unionByName(fine)
        again = waiting.join(large, "shared", "left_semi").select("word", "n", F.explode(halved(F.col("m"), F.col("b"), F.col("e"))).alias("s"))
        waiting = stored(dealt(again.select("word", "n", "s.*")), "spelling-again")


def pairs(points: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(one, other, whether the longer only goes on behind the shorter): rows whose middles are one edit apart, in either order.

    Row i is compared with rows ``first[i]`` to ``last[i]``, its list, which is sorted; its middle is
    ``points[at[i]:at[i + 1]]``. ``ends[i]`` is the length of what row i - 1 and i have in common, -1 between lists.
    """
    size = np.diff(at)
    start = 0
    while start < len(size):
        stop = max(start + 1, min(len(size), int(np.searchsorted(np.cumsum(np.minimum(last - first, 64)[start:]), PAIRS)) + start))
        q = np.arange(start, stop)
        yield from walked(points, at, size, q, first[q], last[q], ends)
        start = stop


def walked(points: np.ndarray, at: np.ndarray, size: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ranges [low, high) of words that share a prefix with rows of the matrix for query q, one letter deeper each step.

    ``a``, ``b``, ``c``: edits between the prefix of d letters and the query's first d - 1, d and d + 1.
    """
    far = np.int8(2)

    def letter(row: np.ndarray, place: int) -> np.ndarray:
        found = np.zeros(len(row), points.dtype)
        if place >= 0:
            inside = size[row] > place
            found[inside] = points[at[row[inside]] + place]
        return found

    a, b = np.full(len(q), far), np.zeros(len(q), np.int8)
    c = np.where(size[q] > 0, np.int8(1), far)
    d = 0
    while len(q):
        # words that end here stand first in their range
        whole = size[low] == d
        if whole.any():
            w, n = q[whole], size[q[whole]]
            cost = np.select([n == d - 1, n == d, n == d + 1], [a[whole], b[whole], c[whole]], far)
            hit = cost == 1
            if hit.any():
                longer, shorter = (n == d + 1)[hit], (n == d - 1)[hit]
                goes_on = longer & (b[whole][hit] == 0) | shorter & (a[whole][hit] == 1) & same_start(points, at, w[hit], low[whole][hit], d - 1)
                yield w[hit], low[whole][hit], goes_on
            low = low + whole
        on = low < high
        q, low, high, a, b, c = (x[on] for x in (q, low, high, a, b, c))
        if not len(q):
            return
        # ranges of one letter more: they begin where adjacent words share d letters at most
        starts = np.flatnonzero(ends <= d)
        left = np.searchsorted(starts, low, "right")  # the first word of a range begins its first part
        parts = np.searchsorted(starts, high, "left") - left + 1
        own = np.repeat(np.arange(len(q)), parts)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.where(nth == 0, low[own], starts[np.minimum(left[own] + nth - 1, len(starts) - 1)])
        end = np.where(nth == parts[own] - 1, high[own], starts[np.minimum(left[own] + nth, len(starts) - 1)])
        q, low, high, a, b, c = q[own], begin, end, a[own], b[own], c[own]
        x = letter(low, d)
        d += 1
        n = size[q]
        one = np.where(d - 1 <= n, np.minimum(a + (letter(q, d - 2) != x) if d > 1 else far, b + 1), far)
        two = np.where(d <= n, np.minimum(np.minimum(b + (letter(q, d - 1) != x), c + 1), one + 1), far)
        three = np.where(d + 1 <= n, np.minimum(c + (letter(q, d) != x), two + 1), far)
        a, b, c = (np.minimum(v, far).astype(np.int8) for v in (one, two, three))
        near = np.minimum(np.minimum(a, b), c) <= 1  # else the whole range is skipped
        q, low, high, a, b, c = (v[near] for v in (q, low, high, a, b, c))


def same_start(points: np.ndarray, at: np.ndarray, one: np.ndarray, other: np.ndarray, size: int) -> np.ndarray:
    """Whether two middles have the same first ``size`` letters."""
    same = np.ones(len(one), bool)
    for k in range(size):
        left = np.flatnonzero(same)
        if not len(left):
            break
        same[left] = points[at[one[left]] + k] == points[at[other[left]] + k]
    return same


def shared_letters(points: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each row the letters that its middle has in common with the one before; -1 where a list begins."""
    size = np.diff(at)
    ends = np.where(new, -1, 0)
    live = np.flatnonzero(~new)
    d = 0
    while len(live):
        live = live[(size[live] > d) & (size[live - 1] > d)]
        live = live[points[at[live] + d] == points[at[live - 1] + d]]
        d += 1
        ends[live] = d
    return ends


def compared(rows: DataFrame) -> DataFrame:
    """word, near, best: for each word of a list its near words there, their number and the best of them (-n, word)."""

    def found(tables: list[pa.Table]) -> pa.RecordBatch | None:
        table = pa.concat_tables(tables).combine_chunks()
        word, middle, shared = (table.column(c).to_pylist() for c in ("word", "middle", "shared"))
        n, m, e, length = (table.column(c).to_numpy() for c in ("n", "m", "e", "length"))
        points = np.frombuffer("".join(middle).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, middle), np.int64, len(middle)))])
        new = np.array([True, *(x != y for x, y in zip(shared[1:], shared, strict=False))])
        begins = np.append(np.flatnonzero(new), len(new))
        of = np.cumsum(new) - 1
        ends = shared_letters(points, at, new)
        ones, others = [], []
        for one, other, goes_on in pairs(points, at, begins[of], begins[of + 1], ends):
            # the shorter has m letters, and the first difference lies in this segment
            keep = (np.minimum(length[one], length[other]) == m[one]) & (~goes_on | (e[one] == m[one]))
            ones.append(one[keep]), others.append(other[keep])
        one, other = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ones, others))
        if not len(one):
            return None
        used, place = np.unique(other, return_inverse=True)
        order = np.argsort(np.array([word[k] for k in used], object), kind="stable")
        rank = np.empty(len(used), np.int64)
        rank[order] = np.arange(len(used))
        by = np.lexsort((rank[place], -n[other], one))
        one, other = one[by], other[by]
        head = np.flatnonzero(np.diff(one, prepend=-1))
        near = np.diff(np.append(head, len(one)))
        return pa.RecordBatch.from_arrays([pa.array([word[k] for k in one[head]]), pa.array(near), pa.array(-n[other[head]]), pa.array([word[k] for k in other[head]])], names=["word", "near", "minus_n", "form"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        count, last = 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if count + len(table) >= WORDS and count:  # cut where a list ends
                shared = table.column("shared").to_pylist()
                cut = next((k for k, x in enumerate(shared) if x != last), len(shared))
                waiting.append(table.slice(0, cut))
                table, count = table.slice(cut), count + cut
                if len(table):
                    if (out := found(waiting)) is not None:
                        yield out
                    waiting, count = [], 0
            if len(table):
                waiting.append(table)
                count, last = count + len(table), table.column("shared")[-1].as_py()
        if count and (out := found(waiting)) is not None:
            yield out

    ready = rows.select("word", "n", "m", "e", "shared", "middle", F.length("word").alias("length")).repartition("shared").sortWithinPartitions("shared", "middle")
    return ready.mapInArrow(run, "word string, near long, minus_n long, form string")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where a word's forms end, by doubling the steps; a form has more occurrences, so there is no circle."""
    links = stored(forms.select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def grouped(words: DataFrame, times: int = TIMES, most: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a vocabulary (word, n)."""
    near = compared(lists(words, most)).groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("minus_n", "form")).alias("best"))
    enough = -F.col("best.minus_n") >= F.col("n") * times
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.minus_n")).alias("form_n"))
    found = stored(found, "spelling-forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, draw: int = DRAW) -> DataFrame:
    """The groups of all words of ``docs`` (doc_id, text)."""
    return grouped(stored(vocabulary(docs, draw), "spelling-words"))
