"""Vectorised two-stage suffix sorting of one block of bytes, and content-defined windows."""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(h):
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def powers(n: int):
    out = np.full(n, MULTIPLIER, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data, k: int):
    """A 64-bit hash of the ``k`` bytes that start at each place (a place per full gram).

    Doubling: the hash of 2 * n bytes from two of n bytes, so that only the bytes of the
    gram enter."""
    n = len(data) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    level, width = _mix((data.astype(np.uint64) + np.uint64(1)) * MULTIPLIER), 1
    acc, done, rest = None, 0, k
    while rest:
        if rest & 1:
            part = level[done:done + n]
            acc = part.copy() if acc is None else _mix(acc * MULTIPLIER + part)
            done += width
        rest >>= 1
        if rest:
            m = len(level) - width
            level = _mix(level[:m] * MULTIPLIER + level[width:width + m])
            width *= 2
    return acc


def sliding_min(values, w: int):
    """Minimum of each ``w`` consecutive values."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    padded = np.concatenate((values, np.full(-len(values) % w, values.max(), values.dtype)))
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1:w - 1 + n])


def anchored_runs(data, length: int, k: int, chunk: int = 1 << 20):
    """Runs of window starts that share an anchor: arrays (start, n_windows, anchor hash).

    The anchor of the ``length`` bytes at a place is the least hash of their ``k``-grams,
    leftmost on ties: a function of those bytes alone, so equal strings have equal anchors.
    Long texts go in chunks of window starts."""
    starts, counts, anchors = [], [], []
    w, n_win = length - k + 1, len(data) - length + 1
    place_bits = np.uint64(22)
    low = (np.uint64(1) << place_bits) - np.uint64(1)
    for at in range(0, max(0, n_win), chunk):
        n = min(chunk, n_win - at)
        hashes = gram_hashes(data[at:at + n + length - 1], k)
        places = np.arange(len(hashes), dtype=np.uint64)
        best = sliding_min((hashes & ~low) | places, w)
        first = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
        starts.append(first + at)
        counts.append(np.diff(np.concatenate((first, [n]))))
        anchors.append(hashes[(best[first] & low).astype(np.int64)])
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(anchors)


def words(data):
    """The eight bytes at each place as one big-endian number (zeros beyond the end)."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    n = len(data)
    pair = (padded[:n + 7] << np.uint64(8)) | padded[1:n + 8]
    four = (pair[:n + 5] << np.uint64(16)) | pair[2:n + 7]
    return (four[:n] << np.uint64(32)) | four[4:n + 4] if n else four[:0]


def smaller_than_successor(data):
    """True where a suffix sorts before the suffix that starts one later."""
    n = len(data)
    nxt = np.concatenate((data[1:], data[-1:]))
    differs = np.concatenate((data[:-1] != data[1:], [True]))
    # A run of equal bytes has the answer of its last place; the last suffix is the larger.
    ends = np.flatnonzero(differs)
    answer = data[ends] < nxt[ends]
    answer[-1] = False
    return np.repeat(answer, np.diff(np.concatenate(([-1], ends)))) if n else differs[:0]


def sort_directly(data, w8, places, depth: int):
    """``places`` by the ``depth`` bytes that start there (ties in any order).

    Groups that tie are refined eight bytes at a time; a group whose members all
    agree on the next ``STEP`` bytes passes over them at once."""
    step = 64
    same = gram_hashes(np.concatenate((data, np.zeros(depth + 2 * step, np.uint8))), step)
    w8 = np.concatenate((w8, np.zeros(depth + 2 * step, np.uint64)))
    order = places[np.argsort(w8[places], kind="stable")]
    first = w8[order]
    # Of every place still tied: where it stands, its group's first place, bytes compared.
    new = np.concatenate(([True], first[1:] != first[:-1]))
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    at = np.arange(len(order))
    done = np.full(len(order), 8, np.int64)
    while True:
        size = np.bincount(head, minlength=0)[head] if len(head) else head
        live = (size > 1) & (done < depth)
        at, head, done = at[live], head[live], done[live]
        if not len(at):
            return order
        starts = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
        lengths = np.diff(np.concatenate((starts, [len(at)])))
        ahead = same[order[at] + done]
        agree = np.minimum.reduceat(ahead, starts) == np.maximum.reduceat(ahead, starts)
        agree = np.repeat(agree, lengths)
        done[agree] += step
        pick = np.flatnonzero(~agree)
        if not len(pick):
            continue
        key = w8[order[at[pick]] + done[pick]]
        by = np.lexsort((key, head[pick]))
        # Groups keep their places in ``order``; members move within them.
        order[at[pick]] = order[at[pick]][by]
        key, group = key[by], head[pick]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
        head[pick] = at[pick][np.maximum.accumulate(np.where(new, np.arange(len(pick)), 0))]
        done[pick] += 8


def suffix_array(data, depth: int):
    """All places of ``data`` in the order of the suffixes that start there, exact to ``depth`` bytes.

    Two stages: suffixes smaller than their successors are sorted directly; every
    other suffix is induced by scanning the buckets (by first byte) upwards, as it
    stands where its smaller successor's place in the scan puts it."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    direct = smaller_than_successor(data)
    places = np.flatnonzero(direct)
    ordered = sort_directly(data, words(data), places, depth) if len(places) else places
    firsts = data[ordered]
    waiting = [[] for _ in range(256)]
    waiting[data[-1]].append(np.array([n - 1]))       # the successor of the last suffix is empty
    out = []
    for byte in np.unique(data):
        # Suffixes of this bucket that are larger than their successors come first; those that
        # begin with m of the byte are found from those with m - 1.
        now = np.concatenate(waiting[byte]) if waiting[byte] else np.empty(0, np.int64)
        bucket = []
        while len(now):
            bucket.append(now)
            now = now[now > 0] - 1
            now = now[(data[now] == byte) & ~direct[now]]
        bucket.append(ordered[np.searchsorted(firsts, byte, "left"):np.searchsorted(firsts, byte, "right")])
        bucket = np.concatenate(bucket)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~direct[before] & (data[before] > byte)]
        chars = data[before]
        by = np.argsort(chars, kind="stable")
        before, chars = before[by], chars[by]
        cuts = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1]))) if len(chars) else []
        for i, j in zip(cuts, [*cuts[1:], len(chars)]):
            waiting[chars[i]].append(before[i:j])
    return np.concatenate(out)


def repeated_starts(data, room, length: int):
    """Places whose ``length`` bytes also start elsewhere, among those with ``room`` for them.

    Common prefixes of neighbours in the suffix array, compared word by word."""
    order = suffix_array(data, length)
    order = order[room[order]]
    w8 = words(data)
    a, b = order[:-1], order[1:]
    alive = np.arange(len(a))
    for s in [*range(0, length - 7, 8), length - 8]:
        alive = alive[w8[a[alive] + s] == w8[b[alive] + s]]
        if not len(alive):
            break
    found = np.zeros(len(data), bool)
    found[a[alive]] = True
    found[b[alive]] = True
    return np.flatnonzero(found)
