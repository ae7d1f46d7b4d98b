"""Suffix arrays of concatenated byte strings by induced sorting, and permuted common prefixes.

Every string ends in a separator of its own; separators are smaller than all bytes and ordered by place. The
bytes are induced bucket by bucket with whole arrays: within a bucket, suffixes that induce into the
same bucket form short chains, all others go to later buckets in scanning order. The reduced string of
leftmost-smaller substring names is sorted by the same algorithm over integers, recursively.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their right neighbour; the last is."""
    n = len(t)
    differs = np.flatnonzero(t[:-1] != t[1:])
    out = np.ones(n, bool)
    at = np.searchsorted(differs, np.arange(n))
    inner = at < len(differs)
    i = differs[at[inner]]
    out[inner] = t[i] < t[i + 1]
    return out


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Suffix array from leftmost-smaller suffixes in (some) order; all separators are among them."""
    none = np.zeros(0, np.int64)
    sigma = 257
    char = t[lms]
    order = np.argsort(char, kind="stable")
    cuts = np.searchsorted(char[order], np.arange(sigma + 1))
    seeds = lms[order]
    by_bucket = [seeds[cuts[c] : cuts[c + 1]] for c in range(sigma)]
    by_bucket[0] = separators
    large: list = [[] for _ in range(sigma)]
    larges: list = [none] * sigma
    for c in range(sigma):
        cur = np.concatenate(large[c]) if large[c] else none
        parts = [cur]
        while len(cur):
            g = cur - 1
            g = g[g >= 0]
            cur = g[(t[g] == c) & ~small[g]]
            parts.append(cur)
        larges[c] = own = np.concatenate(parts)
        g = np.concatenate([own, by_bucket[c]]) - 1
        g = g[g >= 0]
        ch = t[g]
        keep = ~small[g] & (ch > c)
        g, ch = g[keep], ch[keep]
        if len(g):
            order = np.argsort(ch, kind="stable")
            ch = ch[order]
            g = g[order]
            starts = np.flatnonzero(np.diff(ch, prepend=-1))
            for s, part in zip(ch[starts].tolist(), np.split(g, starts[1:]), strict=True):
                large[s].append(part)
        large[c] = []
    falling: list = [[] for _ in range(sigma)]
    out: list = [none] * (2 * sigma)
    for c in range(sigma - 1, -1, -1):
        if c == 0:
            out[0], out[1] = larges[0], separators
            break
        cur = np.concatenate(falling[c]) if falling[c] else none
        parts = [cur]
        while len(cur):
            g = cur - 1
            g = g[g >= 0]
            cur = g[(t[g] == c) & small[g]]
            parts.append(cur)
        own = np.concatenate(parts)
        out[2 * c], out[2 * c + 1] = larges[c], own[::-1]
        g = np.concatenate([own, larges[c][::-1]]) - 1
        g = g[g >= 0]
        ch = t[g]
        keep = small[g] & (ch < c)
        g, ch = g[keep], ch[keep]
        if len(g):
            order = np.argsort(ch, kind="stable")
            ch = ch[order]
            g = g[order]
            starts = np.flatnonzero(np.diff(ch, prepend=-1))
            for s, part in zip(ch[starts].tolist(), np.split(g, starts[1:]), strict=True):
                falling[s].append(part)
    return np.concatenate(out)


def _names(t: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of the leftmost-smaller substrings [at, end], given in sorted order."""
    n = len(at)
    lens = end - at + 1
    same = np.zeros(n, bool)
    pair = np.flatnonzero((lens[1:] == lens[:-1]) & (t[end[1:]] != 0) & (t[at[1:]] != 0)) + 1
    k = 0
    while len(pair):
        pair = pair[t[at[pair] + k] == t[at[pair - 1] + k]]
        k += 1
        done = lens[pair] <= k
        same[pair[done]] = True
        pair = pair[~done]
    return np.cumsum(~same) - 1


def sort_integers(s: list[int], sigma: int) -> list[int]:
    """Suffix array of integers in [0, sigma) by induced sorting; a shorter suffix is smaller than its extensions."""
    n = len(s)
    if n <= 2:
        return sorted(range(n), key=lambda i: s[i:])
    small = [False] * (n + 1)
    small[n] = True
    for i in range(n - 2, -1, -1):
        small[i] = s[i] < s[i + 1] or (s[i] == s[i + 1] and small[i + 1])
    size = [0] * sigma
    for c in s:
        size[c] += 1
    heads, tails, total = [0] * sigma, [0] * sigma, 0
    for c in range(sigma):
        heads[c] = total
        total += size[c]
        tails[c] = total - 1

    def induce(lms: list[int]) -> list[int]:
        sa = [-1] * n
        tail = tails[:]
        for i in reversed(lms):
            sa[tail[s[i]]] = i
            tail[s[i]] -= 1
        head = heads[:]
        # the end of the string is the smallest suffix of all
        sa[head[s[n - 1]]] = n - 1
        head[s[n - 1]] += 1
        for p in range(n):
            i = sa[p] - 1
            if i >= 0 and not small[i]:
                c = s[i]
                sa[head[c]] = i
                head[c] += 1
        tail = tails[:]
        for p in range(n - 1, -1, -1):
            i = sa[p] - 1
            if i >= 0 and small[i]:
                c = s[i]
                sa[tail[c]] = i
                tail[c] -= 1
        return sa

    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]
    if not lms:
        return induce([])
    is_lms = [False] * (n + 1)
    for i in lms:
        is_lms[i] = True
    ends = dict(zip(lms, lms[1:] + [n], strict=True))
    name, before, names = -1, None, {}
    for i in induce(lms):
        if is_lms[i]:
            piece = s[i : ends[i] + 1]
            if piece != before or ends[i] == n:
                name += 1
            before = piece if ends[i] < n else None
            names[i] = name
    if name + 1 < len(lms):
        order = sort_integers([names[i] for i in lms], name + 1)
        lms = [lms[k] for k in order]
    else:
        lms.sort(key=names.__getitem__)
    return induce(lms)


def _sort_reduced(reduced: np.ndarray) -> np.ndarray:
    """Suffix order of the reduced string.

    A name that occurs once decides every comparison that reaches it, so what follows it up to the next name
    that occurs more often is left out of the recursion.
    """
    once = np.bincount(reduced)[reduced] == 1
    kept = np.flatnonzero(~once | np.concatenate([[False], ~once[:-1]]))
    used, symbols = np.unique(reduced[kept], return_inverse=True)
    rank = np.zeros(len(reduced), np.int64)
    order = np.array(sort_integers(symbols.tolist(), len(used)))
    rank[kept[order]] = np.arange(len(kept))
    return np.lexsort((rank, reduced))


def suffix_array(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text (bytes + 1, separators 0), the starts of the strings in it, and its suffix array."""
    lens = np.array([len(x) for x in strings])
    starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]]).astype(np.int64)
    t = np.zeros(int(lens.sum()) + len(strings), np.int16)
    inside = np.ones(len(t), bool)
    separators = starts + lens
    inside[separators] = False
    t[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
    # a separator is smaller than the one after it, as it is than any byte
    small = _types(np.where(inside, t, 0))
    small[separators] = True
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    # a separator after an empty string has no larger left neighbour: it is a seed all the same
    lms = np.union1d(lms, separators)
    end = np.append(lms[1:], lms[-1])
    first = _induce(t, small, lms, separators)
    place = np.full(len(t), -1, np.int64)
    place[lms] = np.arange(len(lms))
    ranked = place[first[place[first] >= 0]]
    name = _names(t, lms[ranked], end[ranked])
    if name[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), np.int64)
        reduced[ranked] = name
        ranked = _sort_reduced(reduced)
    return t, starts, _induce(t, small, lms[ranked], separators)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int, only: np.ndarray | None = None) -> np.ndarray:
    """For every suffix in text order, its common prefix with its left neighbour in the array, up to ``most``.

    With ``only`` (flags in text order), other suffixes have 0.
    """
    n = len(t)
    left = np.full(n, -1, np.int64)
    left[sa[1:]] = sa[:-1]
    # symbols before the next separator: nothing is common from there on
    place = np.where(t == 0, np.arange(n), n)
    room = np.minimum.accumulate(place[::-1])[::-1] - np.arange(n)
    raw = np.concatenate([(t - 1).astype(np.uint8), np.zeros(most + 16, np.uint8)])
    word = np.ascontiguousarray(np.ndarray((n + most + 8,), "<u8", raw, strides=(1,)))
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(left >= 0 if only is None else (left >= 0) & only)
    mate = left[live]
    cap = np.minimum(np.minimum(room[live], room[mate]), most)
    for k in range(0, most, 8):
        differ = word[live + k] ^ word[mate + k]
        stop = (differ != 0) | (cap <= k + 8)
        low = differ[stop] & (~differ[stop] + np.uint64(1))
        # the lowest set bit says how many whole bytes agree
        same = np.where(low == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        out[live[stop]] = np.minimum(k + same, cap[stop])
        live, mate, cap = live[~stop], mate[~stop], cap[~stop]
    return out
