"""Token-set similarity of titles, 0 to 1."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def token_set(a: str, b: str) -> float:
    """Best of three ratios over shared and unshared words; 1 if one title's words are all in the other; 0 for blank ones."""
    s, t = set((a or "").split()), set((b or "").split())
    if not s or not t:
        return 0.0
    both = s & t
    x, y = " ".join(sorted(s - t)), " ".join(sorted(t - s))
    if both and not (x and y):
        return 1.0
    n = len(" ".join(sorted(both)))
    g = 1 if n else 0
    lx, ly = n + g + len(x), n + g + len(y)
    r = 1 - (len(x) + len(y) - 2 * lcs(x, y)) / (lx + ly)
    return max(r, 1 - (g + len(x)) / (n + lx), 1 - (g + len(y)) / (n + ly)) if n else r


@F.pandas_udf(T.DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of two normal titles, in Arrow batches."""
    return pd.Series([token_set(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


class Titles:
    """Titles by length, with their words, letters, pairs of letters and lengths."""

    def __init__(self, titles: list[str], ids: dict[str, int]):
        words = [sorted(set(t.split())) for t in titles]
        joined = [" ".join(w) for w in words]
        self.order = sorted((i for i, w in enumerate(words) if w), key=lambda i: len(joined[i]))
        self.titles, self.words = [titles[i] for i in self.order], [words[i] for i in self.order]
        n = len(self.order)
        self.size = np.array([len(joined[i]) for i in self.order], np.int64)
        self.many = many = np.array([len(w) for w in self.words], np.int64)
        self.plain = (self.size < LETTERS) & (many <= WORDS)
        # the letters of all titles in a row, with a space behind each title
        points = np.frombuffer("".join([f"{joined[i]} " for i in self.order]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        long = self.size + 1
        start = np.cumsum(long) - long
        of = np.repeat(np.arange(n), long)
        at = np.arange(len(points)) - start[of]
        small = np.uint8 if n and self.size[-1] < 255 else np.int32
        inside = at < self.size[of]
        # of letters and spaces, in 64 classes
        self.counts = np.bincount(of[inside] * 64 + (points[inside] & 63), minlength=64 * n).reshape(n, 64).astype(small)
        # of two letters one behind the other, in 256 classes, with a space on both sides of each word
        before = np.where(at == 0, 32, np.roll(points, 1))
        self.pairs = np.minimum(np.bincount(of * 256 + ((before * 37 + points) & 255), minlength=256 * n), 255).reshape(n, 256).astype(np.uint8)
        # words by number with their lengths, and for each letter its class and the place of its word; WORDS if there is none
        self.ids, self.long = np.zeros((n, WORDS + 1), np.int32), np.zeros((n, WORDS + 1), np.int32)
        self.letters = np.zeros((n, LETTERS), np.int64)
        self.places = np.full((n, LETTERS), WORDS, np.int64)
        spaces = np.cumsum(points == 32) - (points == 32)
        own = self.plain[of]
        self.letters[of[own], at[own]] = points[own] & 63
        self.places[of[own], at[own]] = (spaces - spaces[start[of]])[own]
        row = np.flatnonzero(self.plain)
        listed = [w for k in row.tolist() for w in self.words[k]]
        of = np.repeat(row, many[row])
        at = np.arange(len(of)) - np.repeat(np.cumsum(many[row]) - many[row], many[row])
        self.ids[of, at] = [ids.setdefault(w, len(ids) + 1) for w in listed]
        self.long[of, at] = [len(w) for w in listed]

    def post(self) -> dict[str, np.ndarray]:
        """For each word the titles that have it."""
        out: dict[str, list[int]] = {}
        for i, ws in enumerate(self.words):
            for w in ws:
                out.setdefault(w, []).append(i)
        return {w: np.array(x) for w, x in out.items()}


TILE = 2048  # titles on each side of one matrix product
COLUMNS = 224  # levels of letters in the product, those that most titles reach
WORDS, LETTERS = 24, 128  # of the titles that are bounded many at once; longer ones are compared one by one
STEP = 2048  # pairs that are bounded at once


def contained(a: Titles, b: Titles, slack: float, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs in which the shared words are nearly all of one title, a superset of those whose ratio of shared words to it reaches the threshold.

    With a space each, n and x letters of shared and unshared words are enough
    if x <= slack (2 n + x). The shared letters of a title with all others are
    one sum over the lists of its words; of two titles the shorter one needs
    less, and both sides are in order of length.
    """
    post = b.post()
    share = (1 - slack) / (1 + slack)
    enough = (b.size + 1) * share - 1e-6
    shorter = np.searchsorted(b.size, a.size)
    for i, ws in enumerate(a.words):
        have = [w for w in ws if w in post]
        if not have:
            continue
        got = np.bincount(np.concatenate([post[w] for w in have]), np.repeat([len(w) + 1.0 for w in have], [len(post[w]) for w in have]), len(enough))
        own, k = (int(a.size[i]) + 1) * share - 1e-6, i + 1 if same else int(shorter[i])
        at = np.flatnonzero(got[k:] >= own) + k
        if not same:
            at = np.concatenate([np.flatnonzero(got[:k] >= enough[:k]), at])
        if len(at):
            yield i, at


def near(a: Titles, b: Titles, slack: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs whose letters, shared words included, agree in all but the given share, a superset of those whose whole ratio reaches the threshold.

    What two titles' letters have in common is the product of their levels (a
    column for the n-th copy of a letter), so a tile of pairs is bounded by
    one matrix product. Letters without a column are counted as shared by half
    on each side, which is never less than what is shared. Titles are in
    order of length; tiles of too unlike lengths are left out.
    """
    levels = []
    for c in range(64):
        for n in range(1, min(int(a.counts[:, c].max()), int(b.counts[:, c].max()), COLUMNS) + 1):
            levels.append((-min((a.counts[:, c] >= n).mean(), (b.counts[:, c] >= n).mean()), c, n))
    levels = sorted(levels)[:COLUMNS]
    letter, level = np.array([c for _, c, _ in levels], int), np.array([n for _, _, n in levels], int)

    def side(t: Titles) -> tuple[np.ndarray, np.ndarray]:
        bits = (t.counts[:, letter] >= level).astype(np.float32)
        return bits, (((t.size - bits.sum(axis=1)) - t.size * (1 - slack)) / 2).astype(np.float32)[:, None]

    (ba, ca), (bb, cb) = side(a), side(b)
    # the constants are two more columns
    ba, bb = np.hstack([ba, ca, np.ones_like(ca)]), np.hstack([bb, np.ones_like(cb), cb])
    for i in range(0, len(a.titles), TILE):
        for j in range(i if same else 0, len(b.titles), TILE):
            u, v = a.size[i : i + TILE], b.size[j : j + TILE]
            # what is common is at most the shorter title
            if min(u[-1], v[-1]) < (1 - slack) / 2 * (max(u[0], v[0]) + min(u[-1], v[-1])) - 1:
                continue
            common = ba[i : i + TILE] @ bb[j : j + TILE].T
            at = np.flatnonzero(common.ravel() >= -0.01 - 1e-6 * (u[-1] + v[-1]))  # more than rounding can lose
            x, y = at // len(v) + i, at % len(v) + j
            if same:
                x, y = x[x < y], y[x < y]
            yield x, y


def packed(letters: np.ndarray, keep: np.ndarray, fill: int) -> np.ndarray:
    """The kept letters of each row moved to its beginning, with a row for each place; ``fill`` stands behind them."""
    many = keep.sum(axis=1)
    out = np.full((len(many), int(many.max())), fill)
    out[np.arange(out.shape[1]) < many[:, None]] = letters[keep]
    return np.ascontiguousarray(out.T)


def ratio_bound(a: Titles, b: Titles, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For pairs of plain titles at once, the ratio of ``token_set`` over all words, or a little more where letters share a class.

    As ``lcs``, over the letters of unshared words, with a machine word for
    each 64 of them and pair. Each unshared word has a space behind it, which
    makes the subsequence longer by one.
    """
    n, few, long = len(p), int(max(a.many[p].max(), b.many[q].max())), int(max(a.size[p].max(), b.size[q].max())) + 1
    same = (a.ids[p, :few][:, :, None] == b.ids[q, :few][:, None, :]) & (a.ids[p, :few][:, :, None] > 0)
    own, other = np.zeros((2, n, WORDS + 1), bool)
    own[:, :few], other[:, :few] = ~same.any(axis=2), ~same.any(axis=1)
    keep_a, keep_b = np.take_along_axis(own, a.places[p, :long], 1), np.take_along_axis(other, b.places[q, :long], 1)
    lx, ly = keep_a.sum(axis=1), keep_b.sum(axis=1)
    row = np.arange(n) * 66
    x, y = packed(a.letters[p, :long], keep_a, 64) + row, packed(b.letters[q, :long], keep_b, 65) + row
    halves = max(1, -(-len(x) // 64))
    found = [np.zeros(n * 66, np.uint64) for _ in range(halves)]
    for k in range(len(x)):
        found[k // 64][x[k]] |= np.uint64(1 << k % 64)
    v = [np.full(n, 2**64 - 1, np.uint64) for _ in range(halves)]
    for k in range(len(y)):
        carry = None
        for h in range(halves):
            u = v[h] & found[h][y[k]]
            s = v[h] + u
            if halves > 1:
                more = s < u
                if carry is not None:
                    s += carry
                carry = more.astype(np.uint64)
            v[h] = s | (v[h] - u)
    run = sum(64 - np.bitwise_count(w).astype(np.int64) for w in v)
    return np.where(np.minimum(lx, ly) > 0, 1 - (lx + ly - 2 * run) / (a.size[p] + b.size[q]), 0.0)


def may_reach(a: Titles, b: Titles, p: np.ndarray, q: np.ndarray, threshold: float) -> np.ndarray:
    """For pairs at once, whether the ratio of ``token_set`` over all words may reach the threshold.

    Between two titles of ``s`` letters together of which ``d`` have no
    counterpart, at most ``d`` pairs of neighbours are parted, so that at least
    ``s / 2 - 1.5 d + 1`` pairs of neighbouring letters are shared.
    """
    keep = ~(a.plain[p] & b.plain[q])
    at = np.flatnonzero(~keep)
    shared = np.minimum(a.pairs[p[at]], b.pairs[q[at]]).sum(axis=1, dtype=np.int64)
    at = at[shared >= (a.size[p[at]] + b.size[q[at]]) * (0.5 - 1.5 * (1 - threshold + 1e-9)) + 1 - 1e-6]
    if len(at):
        keep[at] = ratio_bound(a, b, p[at], q[at]) >= threshold - 1e-9
    return keep


def compared(a: Titles, b: Titles, pairs: Iterable[tuple[int, int]], threshold: float) -> Iterator[tuple[int, str, str, float]]:
    """The pairs that do reach the threshold: the first one's number, both titles in order, the similarity."""
    for i, j in pairs:
        s = token_set(a.titles[i], b.titles[j])
        if s >= threshold:
            u, v = sorted((a.titles[i], b.titles[j]))
            yield i, u, v, s


def alike_within(left: list[str], right: list[str] | None, threshold: float) -> Iterator[tuple[str, str, float]]:
    """All pairs of one title of each list (or of two titles of ``left``) whose ``token_set`` reaches the threshold, in order, with it.

    Of the three ratios two need titles that share nearly all words of one of
    them (``contained``), the third titles of nearly the same letters
    (``near``), of which most are ruled out many at once (``may_reach``); only
    what is left is compared one by one.
    """
    ids: dict[str, int] = {}
    a = Titles(left, ids)
    b = a if right is None else Titles(right, ids)
    if not len(a.titles) or not len(b.titles):
        return
    slack = 1 - threshold + 1e-9
    some = {(i, j) for i, at in contained(a, b, slack, right is None) for j in at.tolist()}
    for x, y in near(a, b, slack, right is None):
        for k in range(0, len(x), STEP):
            p, q = x[k : k + STEP], y[k : k + STEP]
            keep = may_reach(a, b, p, q, threshold)
            some.update(zip(p[keep].tolist(), q[keep].tolist(), strict=True))
    for _, u, v, s in compared(a, b, some, threshold):
        yield u, v, s


@lru_cache(256)
def corners(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def alike_among(lists: list[list[str]], threshold: float) -> Iterator[tuple[int, str, str, float]]:
    """``alike_within`` of many short lists at once, each pair behind the number of its list.

    Every two titles of a list are bounded by the letters they share; of those
    that share enough, by the words they share (which must be nearly all of
    one title) and by ``may_reach``.
    """
    a = Titles([t for x in lists for t in x], {})
    slack = 1 - threshold + 1e-9
    least = (1 - slack) / (1 + slack)  # share of a title that the shared words must have
    mine = np.repeat(np.arange(len(lists)), [len(x) for x in lists])[a.order]
    by = np.argsort(mine, kind="stable")
    ends = np.cumsum(np.bincount(mine, minlength=len(lists))).tolist()
    spans = [(by[lo:hi], corners(hi - lo)) for lo, hi in zip([0, *ends], ends, strict=False) if hi - lo > 1]
    if not spans:
        return
    first, second = np.concatenate([w[i] for w, (i, _) in spans]), np.concatenate([w[j] for w, (_, j) in spans])
    for k in range(0, len(first), STEP):
        p, q = first[k : k + STEP], second[k : k + STEP]
        common = np.minimum(a.counts[p], a.counts[q]).sum(axis=1, dtype=np.int64)
        at = common >= least * np.minimum(a.size[p], a.size[q]) - 1e-6
        p, q, common = p[at], q[at], common[at]
        same = ((a.ids[p][:, :, None] == a.ids[q][:, None, :]) & (a.ids[p][:, :, None] > 0)).any(axis=2)
        shared = ((a.long[p] + 1) * same).sum(axis=1) - 1
        keep = ~(a.plain[p] & a.plain[q]) | (shared >= least * np.minimum(a.size[p], a.size[q]) - 1e-6)
        at = np.flatnonzero(~keep & (common >= (1 - slack) / 2 * (a.size[p] + a.size[q]) - 1e-6))
        keep[at] = may_reach(a, a, p[at], q[at], threshold)
        for i, u, v, s in compared(a, a, zip(p[keep].tolist(), q[keep].tolist(), strict=True), threshold):
            yield int(mine[i]), u, v, s
