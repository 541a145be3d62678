"""Suffix arrays of shards by induced sorting (the substrings' names by doubling), and
permuted common prefixes.

Small helper that runs inside tasks: Spark cuts the corpus into shards of
bounded size (see suffix_dedup.py)."""

from __future__ import annotations

import numpy as np

from aspectra.llm.common import mix64


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one.  Equal neighbours take
    the type of the next place where the values differ."""
    n = len(s)
    up = np.zeros(n, bool)
    up[-1] = True
    differ = np.flatnonzero(s[1:] != s[:-1])
    if len(differ):
        at = np.searchsorted(differ, np.arange(n - 1))
        inside = at < len(differ)
        here = differ[np.minimum(at, len(differ) - 1)]
        up[:-1] = inside & (s[here] < s[here + 1])
    return up


def _deal(sa, ends, chars, values, step):
    """Writes values to the ends of their buckets, in order, and moves the ends."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    count = np.diff(np.append(first, len(c)))
    place = np.arange(len(c)) - np.repeat(first, count)
    sa[ends[c] + step * place] = values[order]
    ends[c[first]] += step * count


def _induce(s, up, lms, k):
    """Suffix array induced from the sorted leftmost-smaller places, bucket by
    bucket: all that one bucket induces is written at once, again while it
    induces into itself."""
    n = len(s)
    size = np.bincount(s, minlength=k)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    stop = start + size
    sa = np.full(n, -1, np.int64)
    _deal(sa, stop - 1, s[lms[::-1]], lms[::-1], -1)
    lms_first = stop - np.bincount(s[lms], minlength=k)
    head = start.copy()

    def spread(part, rising, ends, step):
        before = part[part > 0] - 1
        before = before[up[before] == rising]
        if len(before):
            _deal(sa, ends, s[before], before, step)

    for c in np.flatnonzero(size):
        done = start[c]
        while done < head[c]:
            now, done = sa[done:head[c]].copy(), head[c]
            spread(now, False, head, 1)
        spread(sa[lms_first[c]:stop[c]], False, head, 1)
    tail = stop - 1
    for c in np.flatnonzero(size)[::-1]:
        done = stop[c] - 1
        while done > tail[c]:
            now, done = sa[tail[c] + 1:done + 1][::-1].copy(), tail[c]
            spread(now, True, tail, -1)
        spread(sa[start[c]:head[c]][::-1], True, tail, -1)
    sa[0] = n - 1
    return sa


def _by_doubling(s):
    """Suffix array of many different values, of which each bucket would hold few:
    ranks of prefixes of doubled length; only suffixes that still tie are sorted again."""
    n = len(s)
    sa = np.argsort(s, kind="stable")
    first = np.concatenate(([True], s[sa[1:]] != s[sa[:-1]]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    step = 1
    while len(at := np.flatnonzero(~(first & np.append(first[1:], True)))):
        i = sa[at]
        key = rank[i] * n + rank[i + step]           # the last value is unique, so i + step lies within
        order = np.argsort(key)
        sa[at], key = i[order], key[order]
        first[at] = new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[sa[at]] = np.maximum.accumulate(np.where(new, at, 0))
        step *= 2
    return sa


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of integers below k whose last one is 0 and occurs once."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    if k > 1024:
        return _by_doubling(s)
    up = _types(s)
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    if len(lms) > 1:
        # names of the substrings from one leftmost-smaller place to the next, by their sorted order
        sa = _induce(s, up, lms, k)
        number = np.full(n, -1, np.int64)
        number[lms] = np.arange(len(lms))
        order = number[sa]
        order = order[order >= 0]
        codes = mix64(np.arange(1, k + 1, dtype=np.uint64))[s]
        powers = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * powers)))
        end = np.append(lms[1:], n - 1) + 1
        # equal substrings: equal sums, one moved to the other's place
        a, b = order[:-1], order[1:]
        x, y = np.minimum(lms[a], lms[b]), np.maximum(lms[a], lms[b])
        sa_, sb_ = sums[end[a]] - sums[lms[a]], sums[end[b]] - sums[lms[b]]
        low, high = np.where(lms[a] < lms[b], sa_, sb_), np.where(lms[a] < lms[b], sb_, sa_)
        same = (end[a] - lms[a] == end[b] - lms[b]) & (low * powers[y - x] == high)
        names = np.empty(len(lms), np.int64)
        names[order] = np.concatenate(([0], np.cumsum(~same)))
        if names.max() + 1 < len(lms):
            lms = lms[suffix_array(names, int(names.max()) + 1)]
        else:
            lms = lms[order]
    return _induce(s, up, lms, k)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, valid: np.ndarray, most: int) -> np.ndarray:
    """In text order: whether a place and the one before it in the suffix array
    (both valid) share ``most`` values."""
    phi = np.full(len(s), -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.flatnonzero(valid & (phi >= 0))
    at = at[valid[phi[at]]]
    for j in range(most):
        at = at[s[at + j] == s[phi[at] + j]]
    out = np.zeros(len(s), bool)
    out[at] = True
    return out


def earlier_windows(strings: list[bytes], owners: np.ndarray, width: int) -> list[np.ndarray]:
    """For each string the starts of its windows of ``width`` bytes that also occur
    in a string with a smaller owner."""
    sizes = np.array([len(x) for x in strings], np.int64)
    # 0 ends the text, 1 ends a string, bytes follow
    s = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 2
    start = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    s[start + sizes] = 1
    s = np.append(s, 0)
    which = np.append(np.repeat(np.arange(len(strings)), sizes + 1), -1)
    valid = np.zeros(len(s), bool)
    valid[:-1] = np.arange(len(s) - 1) + width <= (start + sizes)[which[:-1]]
    sa = suffix_array(s, 258)
    same = permuted_prefixes(s, sa, valid, width)
    at = sa[valid[sa]]
    if not len(at):
        return [np.zeros(0, np.int64)] * len(strings)
    first = np.flatnonzero(~same[at])
    owner = owners[which[at]]
    low = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, len(at))))
    hit = np.sort(at[low < owner])
    cut = np.searchsorted(hit, np.append(start, len(s)))
    return [hit[a:b] - o for a, b, o in zip(cut[:-1], cut[1:], start, strict=True)]
