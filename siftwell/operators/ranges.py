"""Sets of words answered in one range of documents, thousands of sets at a time.

Postings of a range lie by word, and of a word in order of their values as well. A document that reaches a
bound has a word whose value reaches that word's share of it, however the bound is shared out; so what must be
looked at is the heads of the lists, or of the list that needs the fewest, never more than the shortest list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: What a score is compared with: sums and products may differ in their last bits.
ROOM = 1e-10
#: Candidates looked at together, heads of lists that give bounds, and parts of a bound that the first of two words may be asked for.
AT_ONCE, DEEP, PARTS = 1 << 19, 256, (0.25, 0.5, 0.75)
#: A word that so large a part of the documents holds is looked up by place.
COMMON = 4


def room_below(least: np.ndarray) -> np.ndarray:
    return least - np.abs(least) * ROOM - ROOM


class Range:
    """Postings (in order of words and ids) of one range of documents, as places among those that may be found."""

    def __init__(self, order: str | None) -> None:
        self.order = order
        self.parts: list[tuple] = []
        self.posts: list[tuple] = []
        self.word_of: list[np.ndarray] = []
        self.known = False

    def ready(self) -> bool:
        if not self.known:
            self.known = True
            self.lay_out()
        return len(self.codes) > 0

    def lay_out(self) -> None:
        self.codes = np.zeros(0, np.int64)
        if not self.parts or not self.posts:
            return
        self.ids, self.factor, self.key = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        code = np.concatenate(self.word_of)
        ids, one, two = (np.concatenate(c) for c in zip(*self.posts, strict=True))
        self.parts, self.posts, self.word_of = [], [], []
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        there = self.ids[at] == ids
        code, self.place, self.one, self.two = code[there], at[there].astype(np.int32), one[there], two[there]
        new = np.append(True, code[1:] != code[:-1])[: len(code)]
        first, word = np.flatnonzero(new), np.cumsum(new) - 1
        self.codes, self.bounds = code[first], np.append(first, len(code))
        sizes = np.diff(self.bounds)
        self.keys = word * len(self.ids) + self.place
        common = np.flatnonzero(sizes * COMMON >= len(self.ids))
        self.row = np.full(len(self.codes), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.by_place = np.full((len(common), len(self.ids)), -1, np.int32)
        dense = np.flatnonzero(self.row[word] >= 0)
        self.by_place[self.row[word[dense]], self.place[dense]] = dense
        if self.order is None:
            return
        if self.order == "score":
            value = (self.one + 0.001) * (self.two + 0.001) * self.factor[self.place]
        else:
            value = {"relevance": self.one, "popularity": self.two}[self.order] if self.order != "publication_time" else self.key[self.place]
        self.by_value = np.lexsort((-value, word)).astype(np.int32)  # no number comes last
        self.sorted = value[self.by_value]
        self.rank = np.empty(len(word), np.int32)
        self.rank[self.by_value] = np.arange(len(word)) - np.repeat(first, sizes)
        self.most = self.sorted[first]

    def reach(self, word: np.ndarray, least: np.ndarray) -> np.ndarray:
        """How many postings of each word have at least that value."""
        low, high = self.bounds[word], self.bounds[word + 1]
        start = low
        while (left := low < high).any():
            middle = (low + high) >> 1
            up = left & (self.sorted[np.minimum(middle, len(self.sorted) - 1)] >= least)
            low, high = np.where(up, middle + 1, low), np.where(left & ~up, middle, high)
        return low - start

    def find(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The posting of each word and place, or -1."""
        row = self.row[word]
        if (row >= 0).all():
            return self.by_place[row, place]
        out = np.empty(len(word), np.int32)
        dense = row >= 0
        out[dense] = self.by_place[row[dense], place[dense]]
        wanted = word[~dense] * len(self.ids) + place[~dense]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        out[~dense] = np.where(self.keys[at] == wanted, at, -1)
        return out

    def heads(self, words: np.ndarray, least: np.ndarray) -> np.ndarray:
        """How many of each list's first postings (by value) hold every document that has all words and reaches ``least`` (-inf: all do)."""
        sizes = np.diff(self.bounds)[words]
        m = words.shape[1]
        shortest = np.zeros_like(sizes)
        if self.order is None:
            at = sizes.argmin(1)[:, None]
            np.put_along_axis(shortest, at, np.take_along_axis(sizes, at, 1), 1)
            return shortest
        bound = room_below(room_below(least))[:, None]
        most = np.where(np.isnan(self.most), -np.inf, self.most)[words]
        others = np.zeros(words.shape) if self.order == "publication_time" else most.sum(1, keepdims=True) - most
        with np.errstate(invalid="ignore"):
            alone = np.where(np.isinf(bound), sizes, self.reach(words, bound - others - ROOM))
        at = alone.argmin(1)[:, None]
        np.put_along_axis(shortest, at, np.take_along_axis(alone, at, 1), 1)
        if m == 1 or self.order == "publication_time":
            return shortest
        found, total = shortest, shortest.sum(1)
        some = np.flatnonzero((total > 0) & np.isfinite(least))
        for part in PARTS if m == 2 else (None,):
            shares = np.full(m, 1 / m) if part is None else np.array([part, 1 - part])
            lens = self.reach(words[some], bound[some] * shares - ROOM)
            better = lens.sum(1) < total[some]
            found[some[better]], total[some[better]] = lens[better], lens.sum(1)[better]
        return found

    def candidates(self, words: np.ndarray, lens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(set, postings of its words) of the documents among the first ``lens`` of each list that hold all words, each once."""
        m = words.shape[1]
        ends = np.cumsum(lens.sum(1))
        start = 0
        while start < len(words):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, "right")))
            n, word = lens[start:stop].ravel(), words[start:stop].ravel()
            pair = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + self.bounds[word][pair]
            post = nth.astype(np.int32) if self.order is None else self.by_value[nth]
            of, own, place = pair // m + start, pair % m, self.place[post]
            posts = np.empty((len(of), m), np.int32)
            posts[np.arange(len(of)), own] = post
            for step in range(1, m):
                other = (own + step) % m
                at = self.find(words[of, other], place)
                posts[np.arange(len(of)), other] = at
                there = at >= 0
                if self.order is not None:  # in the head of an earlier list as well
                    there &= ~((other < own) & (self.rank[at] < lens[of, other]))
                of, own, place, posts = of[there], own[there], place[there], posts[there]
            if len(of):
                yield of, posts
            start = stop

    def scores(self, posts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """places, relevance, popularity, score (if it orders) and the value that orders."""
        place = self.place[posts[:, 0]]
        relevance, popularity, product = np.zeros(len(place)), np.zeros(len(place)), np.zeros(len(place))
        for c in range(posts.shape[1]):
            r, p = self.one[posts[:, c]], self.two[posts[:, c]]
            relevance += r
            popularity += p
            if self.order == "score":
                product += (r + 0.001) * (p + 0.001)
        score = product * self.factor[place]
        return place, relevance, popularity, score, {"relevance": relevance, "popularity": popularity, "score": score}.get(self.order) if self.order != "publication_time" else self.key[place]

    def asked(self, sets: np.ndarray, sizes: np.ndarray, codes: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(sets, their words, least) of as many words, of the sets whose words all have postings here."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        there = self.codes[at] == codes
        start = np.cumsum(sizes) - sizes
        full = np.logical_and.reduceat(there, start) if len(start) else np.zeros(0, bool)
        for m in np.unique(sizes[full]):
            own = np.flatnonzero(full & (sizes == m))
            yield sets[own], at[start[own][:, None] + np.arange(m)], np.where(np.isnan(least[own]), -np.inf, least[own])

    def counts(self, *asked: np.ndarray) -> Iterator[tuple]:
        """set, documents with all its words."""
        for sets, words, least in self.asked(*asked):
            n = np.zeros(len(sets), np.int64)
            alone = words.shape[1] == 1
            for of, _ in () if alone else self.candidates(words, self.heads(words, least)):
                n += np.bincount(of, minlength=len(sets))
            n = np.diff(self.bounds)[words[:, 0]] if alone else n
            yield sets[n > 0], n[n > 0]

    def best(self, k: int | None, *asked: np.ndarray) -> Iterator[tuple]:
        """set, id, relevance, popularity, score: the k best of each set (all without k) that reach its least; with equal values the least ids."""
        for sets, words, least in self.asked(*asked):
            made: list[tuple] = []
            for of, posts in self.candidates(words, self.heads(words, least)):
                found = self.scores(posts)
                high = (found[-1] >= room_below(least[of])) | np.isinf(least[of])
                of, (place, relevance, popularity, score, value) = of[high], (x[high] for x in found)
                if k is not None:
                    by = np.lexsort((place, -value, of))
                    first = np.searchsorted(of[by], of[by])
                    nth = np.arange(len(by)) - first
                    last = value[by][np.minimum(first + k - 1, len(by) - 1)]
                    by = by[(nth < k) | ((value[by] >= last - ROOM) & (value[by] < last))]
                    of, place, relevance, popularity, score = (x[by] for x in (of, place, relevance, popularity, score))
                if len(of):
                    made.append((sets[of], self.ids[place], relevance, popularity, score))
            yield from made

    def ranks(self, k: int, *asked: np.ndarray) -> Iterator[tuple]:
        """set, value, documents: values that so many documents more reach, at a few ranks of those found in the heads of lists."""
        wanted = np.zeros(k + 1, bool)
        wanted[[r for r in (1, 2, 4, 8, 16, 32, 64, 128) if r < k] + [k]] = True
        for sets, words, least in self.asked(*asked):
            sizes = np.diff(self.bounds)[words]
            deep = np.minimum(sizes, max(k, DEEP))
            whole = np.where(np.arange(words.shape[1]) == sizes.argmin(1)[:, None], sizes, 0)
            lens = np.where((whole.sum(1) <= deep.sum(1))[:, None], whole, deep)
            for of, posts in self.candidates(words, lens):
                value = self.scores(posts)[-1]
                of, value = of[~np.isnan(value)], value[~np.isnan(value)]
                by = np.lexsort((-value, of))
                of, value = of[by], value[by]
                first = np.searchsorted(of, of)
                nth, n = np.arange(len(of)) - first + 1, np.searchsorted(of, of, "right") - first
                given = np.flatnonzero((nth <= k) & (wanted[np.minimum(nth, k)] | (nth == n)))
                if len(given):
                    of, value, nth = of[given], value[given], nth[given]
                    before = np.where(np.append(False, of[1:] == of[:-1]), np.append(0, nth[:-1]), 0)
                    yield sets[of], value, nth - before
