"""Edit distances of a word to all words of a trie in one walk, for blocks of words inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Numbers of a step's rows.
CELLS = 1 << 22


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words end to end, and their bounds."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


class Trie:
    """Levels of nodes: each has its parent in the level above and a letter; words with a common prefix share its nodes."""

    def __init__(self, words: list[str]) -> None:
        """``words`` are distinct and in order of code points."""
        points, at = codes(words)
        size = np.diff(at)
        self.count = len(words)
        self.empty = np.flatnonzero(size == 0)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # parents, letters, words that end here, their nodes
        own = np.arange(len(words))
        node = np.zeros(len(words), np.int64)  # of each word in the level above
        d = 0
        while len(own := own[size[own] > d]):
            letter = points[at[own] + d]
            new = np.ones(len(own), bool)
            new[1:] = (node[own][1:] != node[own][:-1]) | (letter[1:] != letter[:-1])
            number = np.cumsum(new) - 1
            parents = node[own][new]
            node[own] = number
            ends = size[own] == d + 1
            self.levels.append((parents, letter[new], own[ends], number[ends]))
            d += 1

    def distances(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """(places of some words of one length, their edit distances to every word of the trie)."""
        of_size: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            of_size.setdefault(len(word), []).append(k)
        widest = max([1, *(len(p) for p, *_ in self.levels)])
        for size, places in of_size.items():
            step = max(1, CELLS // (widest * (size + 1)))
            for start in range(0, len(places), step):
                own = places[start : start + step]
                points, _ = codes([words[k] for k in own])
                yield own, self.walked(points.reshape(len(own), size))

    def walked(self, queries: np.ndarray) -> np.ndarray:
        """A row of the edit matrix for each node, made of its parent's row, a level at a time."""
        n, size = queries.shape
        out = np.empty((n, self.count), np.int32)
        out[:, self.empty] = size
        steps = np.arange(size + 1, dtype=np.int32)
        rows = np.broadcast_to(steps, (n, 1, size + 1))
        for parents, letters, ends, nodes in self.levels:
            above = rows[:, parents, :]
            rows = above + 1
            np.minimum(rows[:, :, 1:], above[:, :, :-1] + (letters[None, :, None] != queries[:, None, :]), out=rows[:, :, 1:])
            rows = np.minimum.accumulate(rows - steps, axis=2) + steps  # insertions along the row
            out[:, ends] = rows[:, nodes, size]
        return out
