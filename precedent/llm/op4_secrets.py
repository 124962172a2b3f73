"""Secret scans: base patterns, and character Markov models for the rest.

Two character models of order two are trained from labelled samples of the
corpus: values that the base patterns mark as secrets (label random) and
identifier-like tokens that stand outside them (label ordinary).  A long token
that no base pattern covers is a secret when the mean log-likelihood ratio of
random against ordinary, per character, is above ``threshold``.

The sample is bounded (``sample_docs`` documents, a parameter): those with the
smallest id hash of the whole corpus.  Counts of character triples, bounded by
the alphabet, are what reaches the driver; the scan itself reads each whole
text once, in place, and shuffles nothing.

Defined results: null and empty texts have no spans; spans count code points,
end exclusive; long texts are scanned whole; repeated rows are each scanned; a
null ``doc_id`` stays null; an empty table gives no rows, and a corpus without
a labelled secret gets base spans only; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.llm.common import small_batches, spread

# The base patterns of the data contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")          # the maximal runs of 24 or more
KINDS = ("assign", "access", "hex", "random")

#: What the models look at: long runs of the characters keys are made of.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SAMPLE_DOCS = 10_000
THRESHOLD = 0.5
#: Characters as classes of the model: each ASCII letter, digit and mark of its own.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
N_CLASSES = len(ALPHABET) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns' matches that pass, by start, then kind."""
    out = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            out.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                out.append((m.start(), 1, m.end()))
    for m in HEX.finditer(text):
        out.append((m.start(), 2, m.end()))
    out.sort()
    return out


def secret_values(text: str, spans) -> list[str]:
    """The secret part of each base span."""
    out = []
    for start, kind, end in spans:
        if kind == 0:
            out.append(ASSIGN.match(text, start).group(2))
        else:
            out.append(text[start:end])
    return out


def outside(text: str, spans, pattern=CANDIDATE) -> list[tuple[int, int]]:
    """Places of candidate tokens that no base span touches."""
    out, k = [], 0
    by_start = sorted((s, e) for s, _, e in spans)
    for m in pattern.finditer(text):
        while k < len(by_start) and by_start[k][1] <= m.start():
            k += 1
        if not any(s < m.end() and e > m.start() for s, e in by_start[k:k + 4]):
            out.append((m.start(), m.end()))
    return out


#: Tokens taken as ordinary in training: long words and long numbers.
ORDINARY = re.compile(r"(?<![A-Za-z0-9])(?:[A-Za-z_-]{8,}|[0-9]{8,})(?![A-Za-z0-9])")


def encode_chars(token: str):
    import numpy as np

    table = np.full(256, N_CLASSES - 1, dtype=np.int64)
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = i
    return table[np.frombuffer(token.encode("latin-1", "replace"), np.uint8)]


def triples(token: str):
    """Codes of the token's character triples (previous two, next)."""
    c = encode_chars(token)
    return (c[:-2] * N_CLASSES + c[1:-1]) * N_CLASSES + c[2:]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS):
    """Per character triple the log-likelihood ratio random / ordinary, or None without a labelled secret.

    Trained on the ``sample_docs`` documents with the smallest id hash.  Conditional
    probabilities back off, by added counts, from two characters of context to one to none."""
    import numpy as np

    key = F.xxhash64("doc_id")
    ids = docs.select(key.alias("key")).orderBy("key").limit(sample_docs)
    last = ids.agg(F.max("key")).first()[0]
    if last is None:
        return None

    def count(batches):
        seen = {0: Counter(), 1: Counter()}
        for batch in small_batches(batches, "text"):
            for text in batch.column("text").to_pylist():
                if not text:
                    continue
                spans = base_spans(text)
                for value in secret_values(text, spans):
                    seen[1].update(triples(value).tolist())
                for start, end in outside(text, spans, ORDINARY):
                    seen[0].update(triples(text[start:end]).tolist())
        rows = [(label, t, n) for label, c in seen.items() for t, n in c.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                             names=["label", "triple", "n"])

    sampled = docs.select("doc_id", "text").where(key <= F.lit(last)).select("text")
    counted = (sampled.mapInArrow(count, "label long, triple long, n long")
               .groupBy("label", "triple").agg(F.sum("n").alias("n")))
    rows = counted.collect()           # at most 2 * N_CLASSES ** 3 rows, whatever the corpus
    counts = np.zeros((2, N_CLASSES ** 3))
    for label, triple, n in rows:
        counts[label, triple] = n
    if not counts[1].any() or not counts[0].any():
        return None
    logs = []
    for c in counts.reshape(2, N_CLASSES, N_CLASSES, N_CLASSES):
        p0 = (c.sum((0, 1)) + 0.5) / (c.sum() + 0.5 * N_CLASSES)
        two = c.sum(0)
        p1 = (two + 8 * p0) / (two.sum(1, keepdims=True) + 8)
        p2 = (c + 8 * p1[None]) / (c.sum(2, keepdims=True) + 8)
        logs.append(np.log(p2).reshape(-1))
    return (logs[1] - logs[0]).astype(np.float32)


def random_spans(text: str, spans, ratio, threshold: float):
    """Candidates outside the base spans whose mean ratio is above ``threshold``."""
    out = []
    for start, end in outside(text, spans):
        if float(ratio[triples(text[start:end])].mean()) > threshold:
            out.append((start, 3, end))
    return out


def find_secrets(docs: DataFrame, sample_docs: int = SAMPLE_DOCS,
                 threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random)`` per row of ``docs``."""
    ratio = train(docs, sample_docs)

    def join(spans):
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def scan(batches):
        for batch in small_batches(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                base = base_spans(text)
                more = random_spans(text, base, ratio, threshold) if ratio is not None else []
                n = [sum(1 for x in base if x[1] == k) for k in range(3)]
                rows.append((doc_id, *n, hashlib.sha256(join(base).encode()).hexdigest(),
                             join(sorted(base + more)), len(more)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
    return spread(docs.select("doc_id", "text")).mapInArrow(
        scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
              "spans string, n_random long")
