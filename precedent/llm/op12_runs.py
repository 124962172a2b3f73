"""Periodic runs of words, by the branching-tandem test on an enhanced suffix array.

Texts are read in place, whole; a task lays the words of several documents side by side
(each document's words are numbers of its own, a number used nowhere else ends it), so
that one suffix array by prefix doubling serves them all and no match crosses documents.

1. Ranks of 1, 2, 4, ... words are refined, only where they still tie.  The last gives the
   suffix array and its inverse (ISA); going down through them gives common prefixes (LCP).
2. Every LCP interval is known by its nearest smaller values alone: no tree is built.  Of
   its children all but a largest are read (n log n members in all): a suffix i of depth d is
   one half of a branching square if ISA[i + d] or ISA[i - d] lies in the interval, outside
   the member's child.
3. A branching square is the last one of its stretch.  It is rotated to the left while words
   d apart are equal, which gives the stretch; stretches of at least ``max(24, 3 * d)`` words
   with the same ends are one run with the least period.

Nothing is shuffled (an input of few splits is dealt round robin once).  Memory is bounded
by ``BATCH_WORDS`` or by one document, whichever is larger.

``damage`` is the query's own rule: some documents get a periodic tail, by crc32 of the id.

Defined results: null, empty and blank texts have no words and no runs; the hash of no runs
is that of the empty string; null ``doc_id`` is never damaged; repeated rows are each a
document; texts of any length are read whole; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from precedent.llm.common import small_batches, spread

# Fixed values of the contract.
MIN_LENGTH, MIN_EXPONENT = 24, 3
#: Words that share one suffix array, if a document has not more.
BATCH_WORDS = 1 << 16

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()),
                    ("collapsed_sha256", pa.string())])


def damage(doc_id: int | None, words: list) -> list:
    """``words``, for one id in ten with all from some word on made periodic."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def rank_levels(x):
    """Ranks of the first 1, 2, 4, ... numbers from each place: equal ranks, equal numbers.  The last
    level has no ties.  ``x`` must not repeat its last number."""
    import numpy as np

    n = len(x)
    order = np.argsort(x, kind="stable")
    new = np.concatenate(([True], x[order][1:] != x[order][:-1]))
    rank = np.empty(n, np.int32)
    # A rank is the place of its first suffix, so that places settled once never move.
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, h = [rank], 1
    while True:
        same = np.concatenate((~new[1:], [False]))
        ties = np.flatnonzero(~new | same)                      # places of order within groups of two or more
        if not len(ties):
            return levels, order
        at = order[ties]
        # Ties never reach the end, as the last number is unique.
        first, second = rank[at].astype(np.int64), rank[np.minimum(at + h, n - 1)]
        sort = np.argsort(first * n + second, kind="stable")
        at, first, second = at[sort], first[sort], second[sort]
        order[ties] = at
        split = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        new[ties] = split
        rank = rank.copy()
        rank[at] = ties[np.maximum.accumulate(np.where(split, np.arange(len(ties)), 0))]
        levels.append(rank)
        h *= 2


def common_prefixes(levels, order):
    """``lcp[t]``: numbers that the suffixes at ``order[t - 1]`` and ``order[t]`` share; 0 at both ends."""
    import numpy as np

    n = len(order)
    lcp = np.zeros(n + 1, np.int64)
    t = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[t - 1].copy(), order[t].copy()
    got = np.zeros(len(t), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        equal = (levels[k][a] == levels[k][b]) & (a != b)
        step = equal.astype(np.int64) << k
        got += step
        a += step
        b += step
    lcp[t] = got
    return lcp


def nearest_smaller(v, strict: bool):
    """For each place the nearest place before it with a smaller value (or an equal one, if not
    ``strict``), -1 if none.  Pointers jump over values already known to be too large."""
    import numpy as np

    p = np.arange(len(v)) - 1
    todo = np.flatnonzero(p >= 0)
    while len(todo):
        at = p[todo]
        skip = v[at] >= v[todo] if strict else v[at] > v[todo]
        todo, at = todo[skip], at[skip]
        p[todo] = p[at]
        todo = todo[p[todo] >= 0]
    return p


def branching_squares(order, lcp):
    """``(i, d)``: the words from i and from i + d share exactly the next d."""
    import numpy as np

    n = len(order)
    isa = np.empty(n, np.int64)
    isa[order] = np.arange(n)
    # Boundaries t between order[t - 1] and order[t]; values of 0 end every interval.
    left_lt = nearest_smaller(lcp, True)
    left_le = nearest_smaller(lcp, False)
    back = lcp[::-1]
    right_lt = n - nearest_smaller(back, True)[::-1]
    right_le = n - nearest_smaller(back, False)[::-1]
    t = np.flatnonzero(lcp > 0)
    if not len(t):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lo, hi, d = left_lt[t], right_lt[t], lcp[t]
    leads = lcp[left_le[t]] < d                                 # the first boundary of its interval
    # Children: right of each boundary, and left of each interval's first one.
    start = np.concatenate((t, lo[leads]))
    end = np.concatenate((right_le[t], t[leads]))
    lo, hi, d = (np.concatenate((c, c[leads])) for c in (lo, hi, d))
    # A square with three equal parts has three members at its depth.
    wide = hi - lo >= MIN_EXPONENT
    start, end, lo, hi, d = (c[wide] for c in (start, end, lo, hi, d))
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    by = np.lexsort((start - end, hi, lo))                      # an interval's largest child first
    start, end, lo, hi, d = (c[by] for c in (start, end, lo, hi, d))
    small = np.concatenate(([False], (lo[1:] == lo[:-1]) & (hi[1:] == hi[:-1])))
    start, end, lo, hi, d = (c[small] for c in (start, end, lo, hi, d))
    size = end - start
    which = np.repeat(np.arange(len(size)), size)
    member = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + start[which]
    i = order[member]
    lo, hi, d, start, end = (c[which] for c in (lo, hi, d, start, end))
    found_i, found_d = [], []
    for other, first in ((i + d, i), (i - d, i - d)):
        at = isa[np.clip(other, 0, n - 1)]
        ok = ((other >= 0) & (other < n) & (at >= lo) & (at < hi) & ((at < start) | (at >= end)))
        found_i.append(first[ok])
        found_d.append(d[ok])
    return np.concatenate(found_i), np.concatenate(found_d)


def rotations(x, i, d) -> int:
    """How far the square at ``i`` of period ``d`` rotates to the left."""
    import numpy as np

    steps, width = 0, 64
    while True:
        k = min(width, i - steps)
        if not k:
            return steps
        a = i - steps - k
        differ = np.flatnonzero(x[a:a + k] != x[a + d:a + d + k])
        if len(differ):
            return steps + k - 1 - int(differ[-1])
        steps, width = steps + k, 2 * width


def find_runs(x):
    """``[(start, end, period), ...]`` sorted, for numbers whose last is unique."""
    import numpy as np

    levels, order = rank_levels(x)
    i, d = branching_squares(order, common_prefixes(levels, order))
    need = np.maximum(MIN_LENGTH, MIN_EXPONENT * d) - 2 * d     # rotations that a run of this period needs
    ok = i >= need
    i, d, need = i[ok], d[ok], need[ok]
    for step in range(1, 9):
        ok = (step > need) | (x[np.maximum(i - step, 0)] == x[np.maximum(i - step, 0) + d])
        i, d, need = i[ok], d[ok], need[ok]
    runs: dict[tuple[int, int], int] = {}
    for start, period, least in zip(i.tolist(), d.tolist(), need.tolist()):
        left = rotations(x, start, period)
        if left >= least:
            key = (start - left, start + 2 * period)
            runs[key] = min(period, runs.get(key, period))
    return sorted((s, e, p) for (s, e), p in runs.items())


def digest(doc_id, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The row of one document; ``runs`` by start, then period."""
    runs = sorted((s, e - s, p) for s, e, p in runs)
    runs.sort(key=lambda r: (r[0], r[2]))
    dropped = bytearray(len(words))
    best = None
    for s, n, p in runs:
        dropped[s + p:s + n] = b"\1" * (n - p)
        # Exponents as exact fractions; earlier starts and then lesser periods come first here.
        if best is None or n * best[2] > best[1] * p:
            best = (s, n, p)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
    kept = b" ".join([w for w, gone in zip(words, dropped) if not gone] if runs else words)
    s, n, p = best or (None, None, None)
    return (doc_id, len(runs), s, n, p, 1000 * n // p if best else None, hashlib.sha256(lines).hexdigest(),
            hashlib.sha256(kept).hexdigest())


class Batch:
    """Documents side by side until they hold ``BATCH_WORDS``."""

    def __init__(self):
        self.docs, self.parts, self.n, self.next = [], [], 0, 0

    def add(self, doc_id, words: list[bytes]):
        import numpy as np

        seen: dict[bytes, int] = {}
        ids = [seen.setdefault(w, len(seen)) for w in words]
        ids.append(len(seen))                                   # ends the document
        self.parts.append(np.asarray(ids, np.int64) + self.next)
        self.docs.append((doc_id, words, self.n))
        self.n += len(ids)
        self.next += len(seen) + 1

    def rows(self) -> list[tuple]:
        import numpy as np

        if not self.docs:
            return []
        found = find_runs(np.concatenate(self.parts))
        at, out = 0, []
        for doc_id, words, first in self.docs:
            mine = []
            while at < len(found) and found[at][0] < first + len(words) + 1:
                s, e, p = found[at]
                mine.append((s - first, e - first, p))
                at += 1
            out.append(digest(doc_id, words, mine))
        return out


def periodic_runs(docs: DataFrame, damaged: bool = False) -> DataFrame:
    """``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)`` per row
    of ``docs``; with ``damaged`` of the texts as ``damage`` changes them."""
    def run(batches):
        def flush(batch):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*batch.rows()), SCHEMA)],
                                              schema=SCHEMA)

        held = Batch()
        for batch in small_batches(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                # bytes.split() parts at ASCII white space, which is the contract's.
                words = (text or "").encode("utf-8", "surrogatepass").split()
                held.add(doc_id, damage(doc_id, words) if damaged else words)
                if held.n >= BATCH_WORDS:
                    yield flush(held)
                    held = Batch()
        if held.docs:
            yield flush(held)

    return spread(docs.select("doc_id", "text")).mapInArrow(
        run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
             "runs_sha256 string, collapsed_sha256 string")
