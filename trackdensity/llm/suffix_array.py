"""Suffix array and permuted common prefixes of a byte string, by induced sorting.

Suffixes are classified as larger or smaller than the next one. Leftmost-smaller substrings
are sorted by inducing from their first symbols, named in that order (neighbours compared
symbol by symbol), and the string of names is sorted by recursion; its order induces that of
all suffixes. Work is linear in the string but for stable sorts of bucket keys.

Induction walks buckets in order. Neighbouring buckets that don't push into each other are
taken in one numpy step, so names in the hundred thousands take some thousand steps.
"""

from __future__ import annotations

import numpy as np

from . import kernel as K

NONE = np.zeros(0, np.int64)


def types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S); the end counts as smallest."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1].astype(np.int64))
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return step[nearest] > 0


def _groups(lo: np.ndarray, hi: np.ndarray, symbols: int) -> np.ndarray:
    """Ends of the longest runs of symbols that hold no pair lo < hi, from the left."""
    first = np.full(symbols + 1, symbols, np.int64)  # smallest hi of the pairs from each lo on
    np.minimum.at(first, lo, hi)
    first = np.minimum.accumulate(first[::-1])[::-1].tolist()
    ends, a = [], 0
    while a < symbols:
        a = max(first[a], a + 1)
        ends.append(a)
    return np.array(ends)


def _pass(t: np.ndarray, mine: np.ndarray, seeds: np.ndarray, symbols: int, start: int | None) -> np.ndarray:
    """One induction from the left: the suffixes marked `mine`, in order, each placed when the one after it is met.

    seeds: the other suffixes that induce, in order; in a bucket they come after those of `mine`.
    start: a suffix of `mine` that comes before all (the last one), if any.
    """
    own = np.flatnonzero(mine)
    head = np.append(0, np.cumsum(np.bincount(t[own], minlength=symbols)))
    fill = head[:-1].copy()
    out = np.full(len(own), -1, np.int64)
    seed_head = np.append(0, np.cumsum(np.bincount(t[seeds], minlength=symbols)))
    before = own[own < len(t) - 1]
    lo, hi = t[before + 1], t[before]
    ends = _groups(lo[lo < hi], hi[lo < hi], symbols)
    runs = np.append(0, np.cumsum(np.bincount(lo[lo == hi], minlength=symbols)))
    count = np.arange(len(own) + 1)
    head_at, seed_at, runs_at = (x[np.append(0, ends)].tolist() for x in (head, seed_head, runs))

    def place(j: np.ndarray) -> None:
        """Puts j, in order, at the ends of their buckets."""
        k = t[j]
        if len(j) > 1:
            order = k.argsort(kind="stable")
            k, j = k[order], j[order]
            new = np.empty(len(k), bool)
            new[0] = True
            np.not_equal(k[1:], k[:-1], out=new[1:])
            cut = new.nonzero()[0]
            at = fill[k] + (count[: len(k)] - cut[new.cumsum() - 1])
        else:
            at = fill[k]
        out[at] = j
        fill[k] = at + 1  # of equal k the last one, which is the largest, stays

    def preceding(found: np.ndarray) -> np.ndarray:
        j = found[found > 0] - 1
        return j[mine[j]]

    if start is not None:
        place(np.array([start]))
    a = 0
    for g, b in enumerate(ends.tolist()):
        x, y = head_at[g], head_at[g + 1]
        if runs_at[g] < runs_at[g + 1]:  # runs of a symbol push into their own bucket, wave by wave
            wave = out[x:y]
            wave = wave[wave >= 0]
            while len(wave):
                j = preceding(wave)
                wave = j[t[j] < b]
                if len(wave):
                    place(wave)
        p, q = seed_at[g], seed_at[g + 1]
        if x == y:
            found = seeds[p:q]
        elif p == q:
            found = out[x:y]
        else:
            found = np.concatenate([out[x:y], seeds[p:q]])
            if b - a > 1:
                found = found[t[found].argsort(kind="stable")]
        j = preceding(found)
        if runs_at[g] < runs_at[g + 1]:
            j = j[t[j] >= b]
        if len(j):
            place(j)
        a = b
    return out


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in the order that the given order of leftmost-smaller ones induces."""
    lms = lms[np.argsort(t[lms], kind="stable")]
    large = _pass(t, ~small, lms, symbols, len(t) - 1)
    # the smaller ones from the right: the same walk with symbols and orders turned round
    turned = symbols - 1 - t
    less = _pass(turned, small, large[::-1], symbols, None)[::-1]
    both = np.concatenate([large, less])
    return both[np.argsort(t[both], kind="stable")]


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names (from 0) of the leftmost-smaller substrings in text order; equal ones share a name."""
    end = np.append(lms[1:] + 1, len(t))
    place = np.zeros(len(t), np.int64)
    place[lms] = np.arange(len(lms))
    seq = place[ordered]
    size = (end - lms)[seq]
    new = np.ones(len(seq), np.int64)
    new[0] = 0
    # the last one runs into the end of the text and equals no other
    like = np.flatnonzero((size[1:] == size[:-1]) & (seq[1:] != len(lms) - 1) & (seq[:-1] != len(lms) - 1)) + 1
    new[like] = ~K.same_bytes(t, ordered[like], t, ordered[like - 1], size[like])
    names = np.zeros(len(lms), np.int64)
    names[seq] = np.cumsum(new)
    return names


def suffix_array(t: np.ndarray, symbols: int = 256) -> np.ndarray:
    """Order of all suffixes of t, whose entries are below `symbols`."""
    n = len(t)
    if n == 0:
        return NONE
    t = t.astype(np.int64)
    small = types(t)
    is_lms = small.copy()
    is_lms[1:] &= ~small[:-1]
    is_lms[0] = False
    lms = np.flatnonzero(is_lms)
    if len(lms) > 1:
        first = _induce(t, small, lms, symbols)
        ordered = first[is_lms[first]]
        names = _names(t, lms, ordered)
        count = int(names.max()) + 1
        lms = ordered if count == len(lms) else lms[suffix_array(names, count)]
    return _induce(t, small, lms, symbols)


def permuted_lcp(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the text, the common prefix of its suffix with the one before it in order.

    Only irreducible ones (whose preceding bytes differ) are compared byte by byte; each other
    one is one less than that of the place before it.
    """
    n = len(t)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    known = (before < 0) | (at == 0) | (before == 0)
    inner = np.flatnonzero(~known)
    known[inner] = t[inner - 1] != t[before[inner] - 1]
    i = np.flatnonzero(known & (before >= 0))
    j, eight, live = before[i], K.windows(t), np.arange(len(i))
    got = np.zeros(len(i), np.int64)
    while len(live):
        a, b = i[live] + got[live], j[live] + got[live]
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        x = eight[a] ^ eight[b]
        low = (x & (~x + K.U(1))).astype(np.float64)  # the lowest bit that differs
        got[live] += np.where(x == 0, 8, np.log2(np.maximum(low, 1)).astype(np.int64) // 8)
        live = live[x == 0]
    lcp[i] = np.minimum(got, n - np.maximum(i, j))
    last = np.maximum.accumulate(np.where(known, at, 0))
    return lcp[last] - (at - last)
