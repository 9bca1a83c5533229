"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are S or L by whether they are less or greater than the next; the leftmost S of each run
starts a substring. Substrings are put in order by inducing once from their unsorted starts, and
named; where names repeat, the string of names is sorted by the same method. Inducing again from
the sorted starts gives the array. A bucket's entries are placed in waves rather than one by one:
all entries of a bucket that are there, then those that they have added to it, in the same order.
"""

from __future__ import annotations

import numpy as np

#: Strings of names are sorted by loops, as their buckets are too small for waves.
_WIDE = 1 << 12


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Starts of the suffixes of t in order. Symbols are below k; the last is 0, the only one of its kind."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    is_s = _types(t)
    starts = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    induce = _induce if k <= _WIDE else _induce_by_loop
    order = induce(t, k, is_s, starts)
    is_start = np.zeros(n, bool)
    is_start[starts] = True
    order = order[is_start[order]]
    names, count = _named(t, starts, order)
    if count < len(starts):
        order = starts[suffix_array(names, count)]
    return induce(t, k, is_s, order)


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S: the next symbol that differs is greater (the last suffix is S)."""
    n = len(t)
    differs = np.flatnonzero(t[1:] != t[:-1])
    up = t[differs + 1] > t[differs]
    out = np.ones(n, bool)
    lengths = np.diff(np.concatenate([[-1], differs]))
    out[: differs[-1] + 1 if len(differs) else 0] = np.repeat(up, lengths)
    return out


def _named(t: np.ndarray, starts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """The string of the substrings' names, equal for equal substrings, and how many there are."""
    end = np.empty(len(t), np.int64)
    end[starts] = np.append(starts[1:], len(t) - 1)
    size = end[order] - order + 1
    new = np.ones(len(order), bool)
    new[1:] = size[1:] != size[:-1]
    at = np.flatnonzero(~new)
    k = 0
    while len(at):  # compares neighbours of equal size, a symbol at a time
        differ = t[order[at] + k] != t[order[at - 1] + k]
        new[at[differ]] = True
        k += 1
        at = at[~differ]
        at = at[size[at] > k]
    name = np.cumsum(new) - 1
    out = np.empty(len(t), np.int64)
    out[order] = name
    return out[starts], int(name[-1]) + 1


def _induce(t: np.ndarray, k: int, is_s: np.ndarray, order: np.ndarray) -> np.ndarray:
    sizes = np.bincount(t, minlength=k)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    sa = np.full(len(t), -1, np.int64)
    first = t[order]
    n_first = np.bincount(first, minlength=k)
    # The given suffixes, in order, at the ends of their buckets; order is sorted by first symbol only if it is sorted at all.
    by = np.argsort(first, kind="stable")
    offset = np.arange(len(order)) - np.repeat(np.cumsum(n_first) - n_first, n_first)
    tail = np.repeat(ends - n_first, n_first) + offset
    given = order[by]
    given_at = np.cumsum(n_first) - n_first
    head, steps = heads.copy(), np.arange(len(t))

    def place(found: np.ndarray, at: np.ndarray, sign: int) -> None:
        c = t[found]
        if len(c) == 1:
            b = int(c[0])
            sa[at[b] if sign > 0 else at[b] - 1] = found[0]
            at[b] += sign
            return
        by = c.argsort(kind="stable")
        c = c[by]
        more = (c[1:] != c[:-1]).nonzero()[0] + 1
        turn, n = np.zeros(len(more) + 1, np.int64), np.empty(len(more) + 1, np.int64)
        turn[1:] = more
        n[:-1], n[-1] = turn[1:] - turn[:-1], len(c) - turn[-1]
        b = c[turn]
        sa[(at[b] - turn).repeat(n) + steps[: len(c)] if sign > 0 else (at[b] - 1 + turn).repeat(n) - steps[: len(c)]] = found[by]
        at[b] += sign * n

    for b in np.flatnonzero(sizes).tolist():
        lo = heads[b]
        while lo < head[b]:  # entries of type L, with those that they add to their own bucket
            hi = head[b]
            p = sa[lo:hi] - 1
            p = p[p >= 0]
            p = p[~is_s[p]]
            if len(p):
                place(p, head, 1)
            lo = hi
        p = given[given_at[b] : given_at[b] + n_first[b]] - 1
        p = p[p >= 0]
        p = p[~is_s[p]]
        if len(p):
            place(p, head, 1)
    tails = ends.copy()
    for b in np.flatnonzero(sizes).tolist()[::-1]:
        hi = ends[b]
        while hi > tails[b]:  # entries of type S, from the greatest down
            lo = tails[b]
            p = sa[lo:hi][::-1] - 1
            p = p[p >= 0]
            p = p[is_s[p]]
            if len(p):
                place(p, tails, -1)
            hi = lo
        p = sa[heads[b] : head[b]][::-1] - 1
        p = p[p >= 0]
        p = p[is_s[p]]
        if len(p):
            place(p, tails, -1)
    sa[0] = len(t) - 1
    return sa


def _induce_by_loop(t: np.ndarray, k: int, is_s: np.ndarray, order: np.ndarray) -> np.ndarray:
    sizes = np.bincount(t, minlength=k)
    ends = np.cumsum(sizes).tolist()
    head = (np.cumsum(sizes) - sizes).tolist()
    sa = [-1] * len(t)
    tail = list(ends)
    c, s = t.tolist(), is_s.tolist()
    for j in reversed(order.tolist()):
        tail[c[j]] -= 1
        sa[tail[c[j]]] = j
    for i in sa:  # meets what is placed further on
        if i > 0 and not s[i - 1]:
            b = c[i - 1]
            h = head[b]
            sa[h] = i - 1
            head[b] = h + 1
    tail = list(ends)
    for i in reversed(sa):
        if i > 0 and s[i - 1]:
            b = c[i - 1]
            tail[b] = h = tail[b] - 1
            sa[h] = i - 1
    sa[0] = len(c) - 1
    return np.array(sa, np.int64)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place, the length of the prefix that its suffix shares with the one before it in order.

    It is one less than at the place before wherever the symbols before both suffixes agree; only
    the other, irreducible, lengths are counted out, eight bytes at a time.
    """
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    i = np.arange(n)
    known = before >= 0
    agree = np.zeros(n, bool)
    inner = known & (i > 0) & (before > 0)
    agree[inner] = t[i[inner] - 1] == t[before[inner] - 1]
    at = np.flatnonzero(~agree)
    out = np.zeros(n, np.int64)
    width = 8 // t.itemsize
    padded = np.concatenate([t, np.zeros(width, t.dtype)])
    words = np.ndarray((n,), "<u8", padded.tobytes(), strides=(t.itemsize,))
    some = at[known[at]]
    live, a, b, done = np.arange(len(some)), some.copy(), before[some], np.zeros(len(some), np.int64)
    while len(live):
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        equal = words[a] == words[b]
        over = ~equal
        x = (words[a[over]] ^ words[b[over]]).view(np.int64)
        low = (x & -x).view(np.uint64)
        done[live[over]] += np.log2(low.astype(np.float64)).astype(np.int64) // (8 * t.itemsize)
        live, a, b = live[equal], a[equal] + width, b[equal] + width
        done[live] += width
    out[some] = np.minimum(done, n - np.maximum(some, before[some]))
    start = at[np.searchsorted(at, i, side="right") - 1]
    return np.maximum(out[start] - (i - start), 0)
