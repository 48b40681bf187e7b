"""Suffix array by grouping suffixes with the same Lyndon prefix, in two linear phases.

Phase 1 takes the groups in descending order. The longest Lyndon prefix of a
suffix i grows when the group of i is taken: the suffix prev(i), the nearest
one before i in a smaller group, gets the prefix of i appended. Of all p that
are a prev(i) of the taken group, those of one group and one number of such i
move into a new group right behind their old one. prev is found by following
the prev of suffixes already taken. In the end a group holds the suffixes with
one Lyndon prefix, and its length tells where the next smaller suffix starts.

Phase 2 takes the groups in ascending order and emits each one's order: by the
rank of what follows the Lyndon prefix, which lies in a smaller group, after
the number of times that the prefix repeats. Nothing is ever renamed.

Large groups are handled with numpy, small ones by plain loops.
"""

from __future__ import annotations

import numpy as np

FEW = 80


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of fewer than 2**31 integers; the last one must be less than all others."""
    n = len(text)
    narrow = text.astype(np.uint16) if n and text.min() >= 0 and text.max() < 1 << 16 else text  # two bytes are sorted by counting
    sa = np.argsort(narrow, kind="stable").astype(np.int32)
    isa = np.empty(n, np.int32)
    isa[sa] = np.arange(n, dtype=np.int32)
    first = np.flatnonzero(np.r_[True, np.diff(text[sa]) != 0]) if n else np.zeros(0, np.int64)
    size = np.zeros(n + 1, np.int32)
    size[first] = np.diff(np.r_[first, n])
    label = np.empty(n, np.int32)
    label[sa] = np.repeat(first, size[first])
    length = np.ones(n + 1, np.int32)
    prev = np.full(n, -1, np.int32)
    _group(n, sa, isa, size, label, length, prev)
    return _order(n, sa, size, label, length)


def _group(n: int, sa: np.ndarray, isa: np.ndarray, size: np.ndarray, label: np.ndarray, length: np.ndarray, prev: np.ndarray) -> None:
    m_sa, m_isa, m_size, m_label, m_length, m_prev = map(memoryview, (sa, isa, size, label, length, prev))
    hi = n
    while hi > 0:
        g = m_label[m_sa[hi - 1]]
        if hi - g > FEW:
            _take_many(g, hi, sa, isa, size, label, length, prev)
            hi = g
            continue
        if hi - g == 1:  # most groups
            hi = g
            i = m_sa[g]
            j = i - 1
            while j >= 0 and m_label[j] >= g:
                j = m_prev[j]
            m_prev[i] = j
            if j < 0:
                continue
            a = m_label[j]
            s = m_size[a]
            if s == 1:
                m_length[a] += m_length[g]
                continue
            b = a + s - 1
            q, at = m_sa[b], m_isa[j]
            m_sa[at], m_isa[q] = q, at
            m_sa[b], m_isa[j] = j, b
            m_size[a], m_size[b] = s - 1, 1
            m_length[b] = m_length[a] + m_length[g]
            m_label[j] = b
            continue
        counts: dict[int, int] = {}
        for i in sorted(m_sa[g:hi]):
            j = i - 1
            while j >= 0 and m_label[j] >= g:
                j = m_prev[j]
            m_prev[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        own = m_length[g]
        hi = g
        moved: dict[int, list[tuple[int, int]]] = {}
        for p, c in counts.items():
            moved.setdefault(m_label[p], []).append((c, p))
        for a, ps in moved.items():
            s = m_size[a]
            if len(ps) > 1:
                ps.sort()
            elif s == 1:
                m_length[a] += ps[0][0] * own
                continue
            old = m_length[a]
            b = a + s
            for _, p in reversed(ps):
                b -= 1
                q, at = m_sa[b], m_isa[p]
                m_sa[at], m_isa[q] = q, at
                m_sa[b], m_isa[p] = p, b
            m_size[a] = s - len(ps)
            last = 0
            for k, (c, p) in enumerate(ps):
                if c != last:
                    start, last = b + k, c
                    m_size[start] = 0
                    m_length[start] = old + c * own
                m_label[p] = start
                m_size[start] += 1


def _take_many(g: int, hi: int, sa: np.ndarray, isa: np.ndarray, size: np.ndarray, label: np.ndarray, length: np.ndarray, prev: np.ndarray) -> None:
    members = np.sort(sa[g:hi])
    j = members - 1
    active = np.flatnonzero(j >= 0)
    while len(active):
        active = active[label[j[active]] > g]
        j[active] = prev[j[active]]
        active = active[j[active] >= 0]
    same = np.flatnonzero(j >= 0)
    same = same[label[j[same]] == g]
    while len(same):  # a member before: what is before that one
        j[same] = j[np.searchsorted(members, j[same])]
        same = same[j[same] >= 0]
        same = same[label[j[same]] == g]
    prev[members] = j
    p, count = np.unique(j[j >= 0], return_counts=True)
    if not len(p):
        return
    a = label[p]
    order = np.lexsort((count, a))
    p, count, a = p[order], count[order], a[order]
    run = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    moved = np.diff(np.r_[run, len(p)])
    labels = a[run]
    begin = labels + size[labels] - moved
    target = np.repeat(begin - run, moved) + np.arange(len(p))
    old = length[labels]
    size[labels] -= moved
    sub = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (count[1:] != count[:-1])])
    subsize = np.diff(np.r_[sub, len(p)])
    size[target[sub]] = subsize
    length[target[sub]] = np.repeat(old, moved)[sub] + count[sub] * length[g]
    label[p] = np.repeat(target[sub], subsize)
    at = isa[p]
    out = np.sort(at)
    free = out[~_in(out, target)]  # places left, outside of the targets
    taken = target[~_in(target, out)]  # targets that others hold
    sa[free] = sa[taken]
    isa[sa[free]] = free
    sa[target] = p
    isa[p] = target


def _in(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def _order(n: int, sa: np.ndarray, size: np.ndarray, label: np.ndarray, length: np.ndarray) -> np.ndarray:
    rank = np.empty(n, np.int32)
    rank[sa] = np.arange(n, dtype=np.int32)
    starts = np.unique(label)
    starts = starts[size[starts] > 1]
    m_rank, m_label, m_sa = map(memoryview, (rank, label, sa))
    for g, s, step in zip(starts.tolist(), size[starts].tolist(), length[starts].tolist(), strict=True):
        if s > FEW:
            members = np.sort(sa[g : g + s])
            members = members[np.argsort(members % step, kind="stable")]
            # Members that repeat the prefix directly after one another stand side by side now.
            ends = np.flatnonzero(np.r_[np.diff(members) != step, True])
            end = np.repeat(ends, np.diff(np.r_[-1, ends]))
            times, after = end - np.arange(s), members[end] + step
            ordered = members[np.lexsort((rank[after], times))]
            sa[g : g + s] = ordered
            rank[ordered] = np.arange(g, g + s)
        else:
            keyed = []
            for i in m_sa[g : g + s]:
                e, k = i + step, 0
                while m_label[e] == g:
                    e += step
                    k += 1
                keyed.append((k, m_rank[e], i))
            keyed.sort()
            for r, (_, _, i) in enumerate(keyed, g):
                m_sa[r] = i
                m_rank[i] = r
    return sa
