"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from precedent.llm import op12_runs


def brute_runs(words):
    """Every stretch keeping period q that no neighbour extends, with q its least period."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def texts(rng, n):
    out = []
    for _ in range(n):
        kind, words = rng.randrange(4), []
        for _ in range(rng.randrange(1, 6)):
            unit = [rng.choice("abc" if kind < 2 else "abcdefghijklm") for _ in range(rng.randrange(1, 12))]
            words += unit * rng.randrange(1, 30 if kind else 8) + [rng.choice("abxyz") for _ in range(rng.randrange(6))]
        out.append(rng.choice([" ", "\n ", "\t"]).join(words))
    return out


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(60):
        x = np.append(rng.integers(0, rng.integers(1, 5), rng.integers(1, 120)), 99)
        levels, order = op12_runs.rank_levels(x)
        suffixes = sorted(range(len(x)), key=lambda i: x[i:].tolist())
        assert order.tolist() == suffixes
        lcp = op12_runs.common_prefixes(levels, order)
        for t in range(1, len(x)):
            a, b = x[order[t - 1]:], x[order[t]:]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            assert lcp[t] == (differ[0] if len(differ) else m)
        v = rng.integers(0, 4, 50)
        for strict in (True, False):
            want = [max((j for j in range(i) if (v[j] < v[i] if strict else v[j] <= v[i])), default=-1)
                    for i in range(50)]
            assert op12_runs.nearest_smaller(v, strict).tolist() == want


def test_runs_equal_brute_force(make):
    rng = random.Random(12)
    rows = list(enumerate(texts(rng, 150)))
    rows += [(900, "w " * 30), (901, "a b " * 12), (902, "a b " * 11 + "a"), (903, "x"), (904, "x\x1cy  z " * 9)]
    got = sorted(map(tuple, op12_runs.periodic_runs(make(rows), damaged=True).collect()))
    assert got == sorted(brute_row(i, t) for i, t in rows)
    assert sum(r[1] for r in got) > 100


def test_runs_odd_rows(spark, make, odd):
    sha = hashlib.sha256(b"").hexdigest()
    clashing = odd.selectExpr("*", "1 as n_runs", "'x' as words")
    got = sorted(map(tuple, op12_runs.periodic_runs(clashing, True).collect()), key=str)
    want = sorted((brute_row(r.doc_id, r.text) for r in odd.where("coalesce(doc_id, 0) <> 4").collect()), key=str)
    assert [r for r in got if r[0] != 4] == want and len(got) == 9
    by = {r[0]: r for r in got}
    for i in (1, 2, 3, 7):
        assert by[i] == (i, 0, None, None, None, None, sha, sha)
    assert [r[1:] for r in got if r[0] == 5][0] == [r[1:] for r in got if r[0] == 5][1]
    # A long text of one word: one run over all of it; without an id nothing is damaged.
    long = op12_runs.periodic_runs(make([(None, "again " * 50_000)]), True).collect()[0]
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 50_000, 1, 50_000_000)
    assert op12_runs.periodic_runs(odd.limit(0)).count() == 0
