"""Pre-tokenisation by an associative scan of transition functions; no regex.

Each code point becomes a symbol. A symbol is a function from state to state; functions
compose, and all that can arise form a small finite set whose composition table is built once.
A prefix scan of table look-ups then gives the state before every code point at once, and the
state with the symbol tells whether a token begins there.

The tokens are the matches of: a contraction ('s 't 're 've 'm 'll 'd), an optional space and
letters, an optional space and numbers, an optional space and other characters, white space
not followed by a word, white space.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import tiktoken

# Character classes.
LETTER, NUMBER, OTHER, WHITE = 0, 1, 2, 3

# Symbols: the classes, seen with what follows.
S_LETTER, S_NUMBER, S_OTHER, S_QUOTE1, S_QUOTE2, S_SPACE, S_LAST, S_INNER, S_RESET = range(9)
# States: what the text so far ends in.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, PREFIXED, IN_WHITE, TAKE1, TAKE2 = range(8)


def move(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, does a token begin at this symbol)."""
    if symbol == S_RESET:
        return FRESH, True
    if symbol == S_INNER:  # white space before white space or the end
        return IN_WHITE, state != IN_WHITE
    if symbol == S_LAST:  # the last white space before a word, not a plain space
        return FRESH, True
    if symbol == S_SPACE:  # a plain space before a word goes with the word
        return PREFIXED, True
    if symbol in (S_QUOTE1, S_QUOTE2) and state not in (IN_OTHER, PREFIXED):
        return (TAKE1 if symbol == S_QUOTE1 else TAKE2), True
    if symbol == S_LETTER:
        if state == TAKE1:
            return FRESH, False
        if state == TAKE2:
            return TAKE1, False
        return IN_LETTERS, state not in (IN_LETTERS, PREFIXED)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, PREFIXED)
    return IN_OTHER, state not in (IN_OTHER, PREFIXED)


@lru_cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function number of each symbol, composition table, result from FRESH, token starts by (state, symbol)."""
    basic = [tuple(move(s, c)[0] for s in range(8)) for c in range(9)]
    known = list(dict.fromkeys([tuple(range(8)), *basic]))
    place = {f: k for k, f in enumerate(known)}
    for f in known:  # grows while it is read
        for g in basic:
            if (h := tuple(g[s] for s in f)) not in place:
                place[h] = len(known)
                known.append(h)
    then = np.array([[place[tuple(g[s] for s in f)] for g in known] for f in known], np.uint16)
    starts = np.array([[move(s, c)[1] for c in range(9)] for s in range(8)])
    return np.array([place[f] for f in basic], np.uint16), then, np.array([f[FRESH] for f in known], np.uint8), starts


@lru_cache
def classes() -> np.ndarray:
    """The class of every code point, by the Unicode tables of the installed tokenizer library.

    The library encodes all code points with a pattern of one class and a vocabulary of single
    bytes; what comes back are the members.
    """
    out = np.full(0x110000, OTHER, np.uint8)
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    text = points.tobytes().decode("utf-32-le")
    single = {bytes([b]): b for b in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        probe = tiktoken.Encoding(f"class {kind}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        members = bytes(probe.encode_ordinary(text)).decode("utf-8").encode("utf-32-le")
        out[np.frombuffer(members, np.uint32)] = kind
    return out


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol of each code point; ``ends``: where texts end."""
    kind = classes()[points]
    after = np.full(len(points), WHITE, np.uint8)
    after[:-1] = kind[1:]
    after[ends[ends > 0] - 1] = WHITE
    out = kind.copy()  # LETTER, NUMBER and OTHER are their own symbols
    white = kind == WHITE
    out[white] = np.where(after[white] == WHITE, S_INNER, np.where(points[white] == 0x20, S_SPACE, S_LAST))
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        last = ends[np.searchsorted(ends, quote, "right")] - 1
        one = np.where(quote < last, points[np.minimum(quote + 1, len(points) - 1)], 0)
        two = np.where(quote + 1 < last, points[np.minimum(quote + 2, len(points) - 1)], 0)
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[quote[np.isin(one, [ord(c) for c in "stmd"])]] = S_QUOTE1
        out[quote[pair]] = S_QUOTE2
    return out


def states_before(symbol: np.ndarray, begins: np.ndarray, width: int = 64) -> np.ndarray:
    """State before each symbol: an exclusive scan, in columns of ``width`` and then over their totals.

    ``begins``: where texts begin. What stands before a text is set to the constant function.
    """
    of, then, from_fresh, _ = monoid()
    reset = of[S_RESET]
    step = np.empty(len(symbol) + 1, np.uint16)  # step[i]: the function applied just before symbol i
    step[0] = reset
    step[1:] = of[symbol]
    step[begins] = reset
    n = len(step)
    rows = -(-n // width)
    grid = np.zeros((rows, width), np.uint16)  # function 0 is the identity
    grid.ravel()[:n] = step
    for k in range(1, width):
        grid[:, k] = then[grid[:, k - 1], grid[:, k]]
    total, gap = grid[:, -1].copy(), 1
    while gap < rows:  # doubling: functions compose associatively
        total[gap:] = then[total[:-gap], total[gap:]]
        gap *= 2
    grid[1:] = then[total[:-1, None], grid[1:]]
    return from_fresh[grid.ravel()[: len(symbol)]]


def token_starts(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which code points begin a token; ``at``: bounds of the texts."""
    if not len(points):
        return np.zeros(0, bool)
    symbol = symbols(points, at[1:])
    out = monoid()[3][states_before(symbol, at[:-1][at[:-1] < len(points)]), symbol]
    out[at[:-1][np.diff(at) > 0]] = True
    return out
