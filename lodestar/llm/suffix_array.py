"""Suffix array by induced sorting, and permuted common prefixes, in numpy, for one shard of text.

Positions are classified as smaller (S) or larger (L) than what follows; the leftmost-smaller (LMS) substrings are
sorted by inducing, named, and the shorter string of names is sorted in turn, by the same means, until all names
differ; from the sorted LMS suffixes the whole array is induced, bucket by bucket, in time linear in the shard. A bucket
is handled as a batch: its entries' left neighbours are dealt, in order, to the buckets of their letters.

Strings of names have far more letters than bytes do, so their buckets are not walked one by one: the letters and types
from a position up to the next LMS position are ranked, and the array is induced from the ranks of those LMS suffixes
for all buckets at once. Names that occur once need no further sorting and leave the string.
"""

from __future__ import annotations

import numpy as np

#: Buckets of a string with more letters than this are induced all at once, not one by one.
MOST_BUCKETS = 1024


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; t ends in a unique smallest letter."""
    n = len(t)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    step[-1] = 1
    known = np.flatnonzero(step)  # equal letters take after the first difference to their right
    return step[known[np.searchsorted(known, np.arange(n))]] > 0


def _dealt(lists: list[list[np.ndarray]], letters: np.ndarray, items: np.ndarray) -> None:
    if not len(items):
        return
    order = np.argsort(letters, kind="stable")
    letters, items = letters[order], items[order]
    cuts = np.flatnonzero(letters[1:] != letters[:-1]) + 1
    for letter, part in zip(letters[np.concatenate([[0], cuts])].tolist(), np.split(items, cuts)):
        lists[letter].append(part)


def _induced(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The suffix array, given the LMS positions in order (or in any order within a letter, to sort LMS substrings)."""
    none = np.empty(0, np.int64)
    seeds: list[list[np.ndarray]] = [[] for _ in range(k)]
    larger: list[list[np.ndarray]] = [[] for _ in range(k)]
    rising: list[list[np.ndarray]] = [[] for _ in range(k)]
    _dealt(seeds, t[lms], lms)
    done: list[np.ndarray] = [none] * k

    def before(items: np.ndarray, want: bool) -> np.ndarray:
        left = items[items > 0] - 1
        return left[smaller[left] == want]

    for c in range(k):
        out, wave = [], np.concatenate(larger[c]) if larger[c] else none
        while len(wave):
            out.append(wave)
            left = before(wave, False)
            letters = t[left]
            same = letters == c
            _dealt(larger, letters[~same], left[~same])
            wave = left[same]
        done[c] = np.concatenate(out) if out else none
        if seeds[c]:
            left = before(np.concatenate(seeds[c]), False)
            _dealt(larger, t[left], left)
    parts: list[np.ndarray] = [none] * k
    rising[int(t[-1])].append(np.array([len(t) - 1]))
    for c in range(k - 1, -1, -1):
        out, wave = [], np.concatenate(rising[c]) if rising[c] else none
        while len(wave):
            out.append(wave)
            left = before(wave, True)
            letters = t[left]
            same = letters == c
            _dealt(rising, letters[~same], left[~same])
            wave = left[same]
        left = before(done[c][::-1], True)
        _dealt(rising, t[left], left)
        parts[c] = np.concatenate([done[c], *[w[::-1] for w in out[::-1]]]) if out else done[c]
    return np.concatenate(parts)


def _named(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Name of each LMS substring (in the order of ``lms``): its rank among the different ones."""
    ends = np.append(lms[1:], lms[-1])  # the last one is the end letter alone
    size = np.zeros(len(t), np.int64)
    size[lms] = ends - lms + 1
    a, b = ordered[:-1], ordered[1:]
    same = size[a] == size[b]
    live, off = np.flatnonzero(same), 0
    while len(live):  # compare letter by letter where still equal
        x, y = a[live], b[live]
        equal = t[x + off] == t[y + off]
        same[live[~equal]] = False
        off += 1
        live = live[equal & (off < size[x])]
    name = np.empty(len(t), np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms]


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense rank of each key."""
    order = np.argsort(keys)
    ordered, out = keys[order], np.empty(len(keys), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    return out


def _lms_order(names: np.ndarray) -> np.ndarray:
    """Order of the LMS suffixes, by number, from the names of their substrings; the last is the end letter's."""
    if names.max() + 1 == len(names):
        return np.argsort(names)
    once = np.bincount(names)[names] == 1
    # comparing ends at a name that occurs once: after it, names that occur once too are not needed
    kept = ~once
    kept[1:] |= ~once[:-1]
    kept[-1] = True
    at = np.flatnonzero(kept)
    place = np.zeros(len(names), np.int64)
    place[at[suffix_array(_ranks(names[at]))]] = np.arange(len(at))
    return np.argsort(names * (len(names) + 1) + place)  # equal names have places


def _all_buckets(t: np.ndarray) -> np.ndarray:
    """The suffix array of a string with many different letters."""
    n = len(t)
    smaller, at = _smaller(t), np.arange(n)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    following = np.append(lms, n - 1)[np.searchsorted(lms, at, side="right")]
    reach, rank, width = following - at, _ranks(2 * t + smaller), 1
    # letters with their types up to the next LMS position; no such string begins another one
    while width <= reach.max() and rank.max() + 1 < n:
        ahead = np.where(width <= reach, rank[np.minimum(at + width, n - 1)] + 1, 0)
        rank, width = _ranks(rank * (n + 1) + ahead), 2 * width
    place = np.zeros(n, np.int64)
    place[lms[_lms_order(_ranks(rank[lms]))]] = np.arange(len(lms))
    return np.argsort(rank * (n + 1) + place[following])


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of t in order; t holds non-negative integers and ends in a unique smallest one."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    k = int(t.max()) + 1
    if k > MOST_BUCKETS:
        return _all_buckets(t)
    t = t.astype(np.uint16)  # so that dealing by letter is a radix sort
    smaller = _smaller(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rough = _induced(t, smaller, lms, k)
    order = _lms_order(_named(t, lms, rough[is_lms[rough]]))
    return _induced(t, smaller, lms[order], k)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted: for each position, the letters its suffix shares with the one before it in the array, up to ``most``.

    Where the letters before both suffixes are equal, the value is one less than at the position before; only the
    other positions are compared.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    prior = before - 1
    follows = (at > 0) & (before > 0) & (t[at - 1] == t[prior])
    start = np.flatnonzero(~follows)
    value = np.zeros(len(start), np.int64)
    live = np.flatnonzero(before[start] >= 0)
    off = 0
    while len(live) and off < 4 * most:
        x, y = start[live] + off, before[start[live]] + off
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        live = live[t[x] == t[y]]
        value[live] += 1
        off += 1
    origin = np.cumsum(~follows) - 1
    return np.minimum(np.maximum(value[origin] - (at - start[origin]), 0), most)
