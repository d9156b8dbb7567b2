"""Logistic mixing of word contexts: the last two words, the last word, none.  Plain arrays; lm_scoring runs it on tables.

A word is coded by decisions, each a logistic mix: is it one that training texts have after the last two words; if not, one they
have after the last word; if not, one they have at all.  Within the first set that holds it (less those sets already ruled out)
a word's share is a log-linear mix of its counts in all contexts, with weights gated by the evidence.  So the shares of all words
add up to 1, but for the last branch, which hands on to the spelling of words that no training text has.

An entry is a word w with the words before it, w1 and w2 further back; n: its count in training texts, c: that of w alone.
"""

from __future__ import annotations

import numpy as np

GATES, CELLS, RATE = 16, 33, 0.05
#: Entries of a step (more where one word is followed by more), and entries handled at once.
STEP, BLOCK = 65_536, 65_536
#: The largest number of keys to look up, times how many they are, up to which a table of all numbers is made.
SPARSE = 16
SHAPES = ((3, GATES, 4), (GATES, 3), (GATES, 2))
SIZE = sum(int(np.prod(s)) for s in SHAPES)


def start_weights() -> np.ndarray:
    mix = np.zeros(SHAPES[0])
    mix[:, :, 0] = 1
    pairs, singles = np.zeros(SHAPES[1]), np.zeros(SHAPES[2])
    pairs[:, 0], singles[:, 0] = 1, 1
    return np.concatenate([x.reshape(-1) for x in (mix, pairs, singles)])


def changes(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys start anew."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def kinds_of(a: np.ndarray) -> np.ndarray:
    """Distinct numbers, in order."""
    a = np.sort(a)
    return a[changes(a)]


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Of each wanted number the value that it has beside the keys (whole numbers from 0), which have it."""
    most = int(keys.max(initial=0)) + 1
    if most <= SPARSE * len(keys):
        table = np.empty(most, values.dtype)  # only what is set is read
        table[keys] = values
        return table[wanted]
    order = np.argsort(keys)
    return values[order][np.searchsorted(keys[order], wanted)]


def ordered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of whole numbers from 0, and where in it a row differs from the one before.

    Rows are sorted by one number each, in which columns that take too many bits stand for themselves by their ranks."""
    keys = list(columns)
    for k in range(len(keys) + 1):
        bits = [int(x.max(initial=0)).bit_length() for x in keys]
        if sum(bits) <= 64:
            break
        if k < len(keys):
            kinds = kinds_of(keys[k])
            keys[k] = looked_up(kinds, np.arange(len(kinds)), keys[k])
    else:
        order = np.lexsort(columns[::-1])
        return order, changes(*(x[order] for x in columns))
    key = keys[0].astype(np.uint64)
    for x, b in zip(keys[1:], bits[1:], strict=True):
        key = key << np.uint64(b) | x.astype(np.uint64)
    order = np.argsort(key)
    return order, changes(key[order])


def merged(w1: np.ndarray, w2: np.ndarray, w: np.ndarray, n: np.ndarray, c: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct entries in order of w1, w2, w with their counts added up, and the place of each given one among them."""
    order, new = ordered(w1, w2, w)
    at = np.flatnonzero(new)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    first = order[at]
    return [w1[first], w2[first], w[first], np.add.reduceat(n[order], at, dtype=np.int64) if len(at) else n, c[first]], place


def steps(w1: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of entries that hold all of each w1."""
    ends = np.append(np.flatnonzero(changes(w1))[1:], len(w1)) if len(w1) else np.zeros(0, int)
    out, a = [], 0
    while a < len(w1):
        e = int(ends[min(np.searchsorted(ends, a + STEP), len(ends) - 1)])
        out.append((a, e))
        a = e
    return out


def log_odds(n: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """That a context which met n words of so many kinds meets one of them again."""
    return np.log((n - kinds + 0.5) / (kinds + 0.5))


def gate(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), GATES - 1)


class Contexts:
    """Counts of the contexts of a stretch."""

    def __init__(self, w1, w2, w, n, c):
        self.n, self.c = n.astype(float), c.astype(float)
        new1, new2 = changes(w1), changes(w1, w2)
        self.g2, self.g1 = np.cumsum(new2) - 1, np.cumsum(new1) - 1
        key = self.g1.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64)
        order = np.argsort(key)
        new = changes(key[order])
        self.pair = np.empty(len(w), np.int64)
        self.pair[order] = np.cumsum(new) - 1
        first = order[np.flatnonzero(new)]
        self.owner, self.pair_c = self.g1[first], self.c[first]
        self.pair_n = np.bincount(self.pair, self.n, len(first))
        seen = self.pair_n > 0
        self.n1, self.kinds1 = self.by_word(self.pair_n), self.by_word(seen)
        self.known1 = self.by_word(self.pair_c * seen)
        self.n2, self.kinds2 = self.by_two(self.n), self.by_two(self.n > 0)

    def by_word(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, x)

    def by_two(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.g2, x)


def log0(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, 1))


def weighed(weights: np.ndarray, gates: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """Of each row the columns' sum, weighted by its gate's weights."""
    out = np.zeros(len(gates))
    for w, x in zip(weights.T.copy(), columns, strict=True):
        out += w[gates] * x
    return out


class WordMixer:
    """total, kinds, ones: words of training texts, distinct ones, and those that occur once."""

    def __init__(self, total: int, kinds: int, ones: int, weights: np.ndarray | None = None, cells: np.ndarray | None = None):
        self.total, self.kinds, self.ones = total, kinds, ones
        self.weights = start_weights() if weights is None else weights.copy()
        self.slopes = np.zeros(SIZE)
        self.hits, self.all = np.zeros((3 * GATES, CELLS)), np.zeros((3 * GATES, CELLS))
        self.cells = cells

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        cuts = np.cumsum([np.prod(s) for s in SHAPES])[:-1]
        return [x.reshape(s) for x, s in zip(np.split(flat, cuts), SHAPES, strict=True)]

    def decide(self, level: int, gates: np.ndarray, x: list[np.ndarray], y: np.ndarray, weight: np.ndarray | None, slope: np.ndarray) -> np.ndarray:
        """Log of the share of what is the case (y) in a decision; with weight, learns from it."""
        z = np.clip(weighed(self.parts(self.weights)[0][level], gates, x), -16, 16)
        at = (level * GATES + gates) * CELLS
        if weight is not None:
            miss = weight * (y - 1 / (1 + np.exp(-z)))
            for k in range(4):
                self.parts(slope)[0][level][:, k] += np.bincount(gates, miss * x[k], GATES)
            at = at + np.rint((z + 16) * ((CELLS - 1) / 32)).astype(np.int64)
            self.all += np.bincount(at, weight, self.all.size).reshape(self.all.shape)
            self.hits += np.bincount(at, weight * y, self.all.size).reshape(self.all.shape)
        elif self.cells is not None:
            place = (z + 16) * ((CELLS - 1) / 32)
            low = np.minimum(place.astype(np.int64), CELLS - 2)
            flat = self.cells.reshape(-1)
            at += low
            lower = flat[at]
            z = (z + lower + (flat[at + 1] - lower) * (place - low)) / 2
        return -np.log1p(np.exp(np.where(y, -z, z)))  # z stays near -16 to 16

    def step(self, w1, w2, w, n, c, learn: bool) -> np.ndarray:
        """ln share of each entry of a stretch.  learn: entries of training texts (n > 0) are coded by what the counts are without
        one occurrence of them, and the weights follow."""
        x = Contexts(w1, w2, w, n, c)
        _, pairs, singles = self.parts(self.weights)
        own = 1.0 if learn else 0.0
        # gates of contexts, with and without their own occurrence
        gate2, gate1, gate2_own, gate1_own, gate1_next = gate(x.n2), gate(x.n1), gate(x.n2 - own), gate(x.n1 - own), gate(x.n1 - own + 1)
        # sums of the sets' weights
        features1 = [log0(x.pair_n), log0(x.pair_c)]
        m1 = np.exp(weighed(singles, gate1[x.owner], features1)) * (x.pair_n > 0)
        in2 = x.n > 0
        m1_in2 = m1[x.pair] * in2
        z1, z1_in2 = x.by_word(m1), x.by_two(m1_in2)
        features2 = [log0(x.n), features1[0][x.pair], log0(x.c)]
        m2 = np.exp(weighed(pairs, gate2[x.g2], features2)) * in2
        z2 = x.by_two(m2)
        if learn:
            e2 = [x.by_two(m2 * f) for f in features2]
            e1 = [x.by_word(m1 * f) for f in features1]
            e1_in2 = [x.by_two(m1_in2 * f) for f in (features2[1], features1[1][x.pair])]
        out, slope = np.zeros(len(w)), np.zeros(SIZE)
        chosen = np.flatnonzero(in2) if learn else np.arange(len(w))
        weight_all = x.n[chosen].sum() if learn else 1.0
        for a in range(0, len(chosen), BLOCK):
            i = chosen[a : a + BLOCK] if len(chosen) < len(w) else slice(a, a + BLOCK)
            g1, g2, p, m2_ = x.g1[i], x.g2[i], x.pair[i], m2[i]
            n_, n1_, n0_ = x.n[i] - own, x.pair_n[p] - own, x.c[i] - own
            in_two, in_one = n_ > 0, n1_ > 0
            size2, kinds2 = x.n2[g2] - own, x.kinds2[g2] - own * ~in_two
            size1, kinds1 = x.n1[g1] - own, x.kinds1[g1] - own * ~in_one
            known = x.known1[g1] - own * np.where(in_one, 1, x.c[i])
            rest = self.total - own - known
            weight = x.n[i] / weight_all if learn else None
            got = np.zeros(len(g1))
            has2, has1, one = size2 > 0, size1 > 0, np.ones(len(g1))
            odds2, odds1 = log_odds(size2, kinds2) * has2, log_odds(size1, kinds1) * has1

            def decision(level: int, where: np.ndarray, gates: np.ndarray, inputs: list[np.ndarray], y: np.ndarray) -> None:
                j = np.flatnonzero(where)
                got[j] += self.decide(level, gates[j], [v[j] for v in inputs], y[j], None if weight is None else weight[j], slope)

            decision(0, has2, gate2_own[g2], [odds2, odds1, one, has2], in_two)
            decision(1, has1 & ~in_two & (kinds1 > kinds2), gate1_own[g1], [odds1, odds2, one, has2], in_one)
            novel = np.full(len(g1), np.log((self.total - self.ones + 0.5) / (self.ones + 0.5)))
            decision(2, ~in_one & ~in_two & (rest > 0), gate1_next[g1], [novel, odds1, one, has1], n0_ > 0)

            j = np.flatnonzero(in_two)
            k2, m2j = g2[j], m2_[j]
            f = [log0(n_[j]), log0(n1_[j]), log0(n0_[j])]
            gates = gate2[k2]
            m = np.exp(weighed(pairs, gates, f))
            z = np.maximum(z2[k2] - own * m2j + own * m, m)
            got[j] += np.log(m / z)
            if learn:
                for k, mine in enumerate(f):
                    e = (e2[k][k2] - m2j * features2[k][i][j] + m * mine) / z
                    self.parts(slope)[1][:, k] += np.bincount(gates, weight[j] * (mine - e), GATES)

            j = np.flatnonzero(in_one & ~in_two)
            k1, k2 = g1[j], g2[j]
            f = [log0(n1_[j]), log0(n0_[j])]
            gates = gate1[k1]
            m = np.exp(weighed(singles, gates, f))
            z = np.maximum(z1[k1] - z1_in2[k2] + own * m, m)
            got[j] += np.log(m / z)
            if learn:
                for k, mine in enumerate(f):
                    e = (e1[k][k1] - e1_in2[k][k2] + m * mine) / z
                    self.parts(slope)[2][:, k] += np.bincount(gates, weight[j] * (mine - e), GATES)

            j = np.flatnonzero(~in_one & ~in_two & (n0_ > 0))
            got[j] += np.log(n0_[j] / rest[j])
            out[i] = got
        if learn:
            self.slopes += slope * slope
            self.weights += RATE * slope / np.sqrt(self.slopes + 1e-12)
        return out

    def learn(self, entries: list[np.ndarray]) -> None:
        """One online pass."""
        for a, b in steps(entries[0]):
            if entries[3][a:b].any():
                self.step(*(x[a:b] for x in entries), learn=True)

    def log10(self, entries: list[np.ndarray]) -> np.ndarray:
        """log10 share of each entry."""
        parts = [self.step(*(x[a:b] for x in entries), learn=False) for a, b in steps(entries[0])]
        return np.concatenate(parts) / np.log(10) if parts else np.zeros(0)
