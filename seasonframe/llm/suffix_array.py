"""Suffix arrays by induced sorting, on numpy arrays.

Suffixes are classified as S (smaller than the next suffix) or L (larger). Substrings between
leftmost S positions are sorted by induction and named, the string of names is solved by the same
method, and from the sorted leftmost positions every other suffix is induced. Induction goes bucket
by bucket: the suffixes of a bucket that are known so far place their predecessors in later buckets
in one step, and only runs of one symbol take a step per symbol.
"""

from __future__ import annotations

import numpy as np

from seasonframe.llm.hashing import mix, prefix_sums, span_hashes

#: Most symbols that are induced as they are; strings of more become strings of two digits each.
SYMBOLS = 1024
SMALL = 2048
#: So many prefixes are compared at once.
COMPARED = 1 << 17


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S; the end counts as smaller than every symbol."""
    n = len(t)
    step = np.full(n, -1, np.int8)
    np.subtract(t[1:] > t[:-1], t[1:] < t[:-1], out=step[:-1], dtype=np.int8)
    at = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n))
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return step[nearest] > 0


def _induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All suffixes, in order if lms (grouped by first symbol, ascending) are in order."""
    n, symbols = len(t), len(sizes)
    out = np.empty(n, np.int32)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    used = np.flatnonzero(sizes).tolist()
    lms_ends = np.cumsum(np.bincount(t[lms], minlength=symbols))
    head = begins.copy()

    def place(found: np.ndarray, wanted: bool) -> None:
        before = found[found > 0] - 1
        before = before[s_type[before] == wanted]
        if not len(before):
            return
        symbol = t[before]
        counts = np.bincount(symbol, minlength=symbols)
        if len(before) > 1:
            order = np.argsort(symbol, kind="stable")
            before, symbol = before[order], symbol[order]
        rank = np.arange(len(before)) - (np.cumsum(counts) - counts)[symbol]
        if wanted:
            out[tail[symbol] - 1 - rank] = before
            np.subtract(tail, counts, out=tail)
        else:
            out[head[symbol] + rank] = before
            np.add(head, counts, out=head)

    out[head[t[-1]]] = n - 1  # the end comes first and induces the last suffix
    head[t[-1]] += 1
    for c in used:
        done = begins[c]
        while done < head[c]:
            now, done = out[done:head[c]], head[c]
            place(now, False)
        first = lms_ends[c - 1] if c else 0
        if first < lms_ends[c]:
            place(lms[first:lms_ends[c]], False)
    large = head
    tail = ends.copy()
    for c in reversed(used):
        done = ends[c]
        while tail[c] < done:
            now, done = out[tail[c]:done][::-1], tail[c]
            place(now, True)
        if begins[c] < large[c]:
            place(out[begins[c]:large[c]][::-1], True)
    return out


def _doubled(t: np.ndarray) -> np.ndarray:
    """Suffix array by doubling the sorted length: for short strings."""
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    n, width = len(t), 1
    while True:
        behind = np.full(n, -1, np.int64)
        behind[:-width or None] = rank[width:] if width < n else behind[:0]
        key = rank * (n + 1) + behind + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if new.max(initial=0) == n - 1 or width >= n:
            return order.astype(np.int32)
        rank, width = new, 2 * width


def _named(t: np.ndarray, lms: np.ndarray, order: np.ndarray, symbols: int) -> np.ndarray:
    """Names of the substrings between leftmost positions, in text order; equal ones share one."""
    ends = np.append(lms[1:] + 1, np.int32(len(t)))
    sums = prefix_sums(t, mix(np.arange(1, symbols + 1, dtype=np.uint64)))
    digest = span_hashes(sums, lms, ends)
    digest[-1] = ~digest[-1]  # the last one ends at the end of the string, so no other equals it
    place = np.empty(len(t), np.int32)
    place[lms] = np.arange(len(lms))
    sorted_at = place[order]
    names = np.empty(len(lms), np.int32)
    names[sorted_at] = np.concatenate([[0], np.cumsum(np.diff(digest[sorted_at]) != 0)])
    return names


def suffix_array(t: np.ndarray, as_is: bool = False) -> np.ndarray:
    """Start positions of the suffixes of t (whole numbers from 0) in order; ties cannot occur, as
    a suffix that is a prefix of another comes before it. An empty string has no suffixes. `as_is`:
    however many symbols there are, they are not split into digits."""
    n = len(t)
    if n < SMALL:
        return _doubled(t) if n else np.empty(0, np.int32)
    sizes = np.bincount(t)
    if len(sizes) > SYMBOLS and not as_is:
        base = int(np.ceil(np.sqrt(len(sizes))))
        digits = np.stack([t // base, t % base], axis=1).ravel().astype(np.uint16)
        order = suffix_array(digits, True)
        return order[order % 2 == 0] // 2
    t = t.astype(np.uint8 if len(sizes) <= 256 else np.uint16)
    s_type = _types(t)
    leftmost = s_type.copy()
    leftmost[0] = False
    leftmost[1:] &= ~s_type[:-1]
    lms = np.flatnonzero(leftmost).astype(np.int32)
    if len(lms) > 1:
        rough = _induce(t, s_type, lms[np.argsort(t[lms], kind="stable")], sizes)
        rough = rough[leftmost[rough]]
        names = _named(t, lms, rough, len(sizes))
        if names.max() + 1 == len(lms):
            solved = np.argsort(names)
        elif 2 * len(lms) > 0.8 * n and names.max() >= SYMBOLS:
            solved = _doubled(names)  # digits would not make the string shorter
        else:
            solved = suffix_array(names)
        lms = lms[solved]
    return _induce(t, s_type, lms, sizes)


def permuted_common_prefixes(t: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per position the suffix before it in order (the first one has itself), and how many bytes
    they share.

    Where the bytes in front of both differ the prefix is compared, eight bytes at a time; behind
    such a position it is one shorter with every step.
    """
    n = len(t)
    before = np.empty(n, np.int32)
    before[order[1:]] = order[:-1]
    before[order[:1]] = order[:1]
    padded = np.concatenate([t.astype(np.uint8), np.zeros(16, np.uint8)])
    eight = np.ndarray(n + 8, "<u8", padded, strides=(1,))  # of every position, without a copy
    here = np.arange(n, dtype=np.int32)
    start = (here == 0) | (before == 0) | (before == here)
    start[1:] |= t[:-1] != t[before[1:] - 1]
    at = here[start & (before != here)]
    shared = np.zeros(n, np.int32)
    for block in range(0, len(at), COMPARED):
        mine = at[block:block + COMPARED]
        other = before[mine]
        most = n - np.maximum(mine, other)
        length = np.zeros(len(mine), np.int32)
        left = np.arange(len(mine))
        while len(left):
            a, b = mine[left] + length[left], other[left] + length[left]
            differ = eight[a] ^ eight[b]
            low = differ & (~differ + np.uint64(1))
            length[left] += np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int32)
            left = left[(differ == 0) & (length[left] < most[left])]
        shared[mine] = np.minimum(length, most)
    root = np.maximum.accumulate(np.where(start, here, np.int32(0)))
    return before, np.maximum(shared[root] - (here - root), 0)
