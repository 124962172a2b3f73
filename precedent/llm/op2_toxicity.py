"""Toxicity by a weighted finite-state pattern grammar.

A text is read clause by clause as a string of token classes.  Five small
transducers run over it in composition: insult and threat emit weights, target
raises them, negation and reported speech lower them.  A clause's score is the
sum of what the composition emits, so words count by the clause they stand in.

* insult: a word whose ending-free form is in the lexicon emits its weight;
* threat: a modal followed by a verb of harm within four tokens emits a weight;
* target: a pronoun of address before a match (or after it) in the clause raises it;
* negation: a match within three tokens after a negating word is lowered;
* reported speech: a clause with a verb of saying before the match is lowered.

The lexicon is learned: words and word beginnings (3 to 8 letters, so that
inflected forms are caught in any language) whose document counts favour toxic
rows, with their log odds as weights.  A logistic curve over a document's
clause scores turns them into 0..1.  Both are fitted on a bounded sample of
labelled training rows (``sample_docs``, a parameter; smallest id hash), the
lexicon on one half and the curve on the other.  Rows whose crc32(doc_id) mod 5
is 0 are never trained on.  Scoring reads every whole text in place, without a
shuffle; the model (at most ``max_lexicon`` entries) travels with the tasks.

Defined results: null and empty texts get the score of no match; texts of any
length are read whole; null ``doc_id`` counts as not held out; repeated rows
get equal scores; without labels of both kinds every score is 0; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.llm.common import free_worker, materialize, small_batches, spread

SAMPLE_DOCS = 20_000
MAX_LEXICON = 50_000
MIN_DOCS = 4
#: Words and beginnings that a task counts before it hands its counts on (some 40 MB).
MAX_COUNTED = 150_000

# Closed word classes of the four languages of the corpus.
TARGETS = set("you your yours u ur he she they him her them tu vous toi te du dich dir ihr sie tú usted te ti".split())
NEGATIONS = set("not no never isn't aren't wasn't don't pas jamais ni nicht kein keine nie no nunca jamás".split())
REPORTS = set("said says say called quoted reported claims wrote writes alleged dit dire sagte sagt dijo dice".split())
MODALS = set("will shall gonna going must should 'll vais va werde wirst wird voy vas va".split())
HARMS = set("kill hurt beat destroy burn shoot stab crush punch tuer frapper töten schlagen matar golpear".split())

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]")
OTHER, INSULT, TARGET, NEGATION, REPORT, MODAL, HARM, STOP = range(8)

TARGET_GAIN, NEGATED, REPORTED, THREAT_WEIGHT = 1.5, 0.3, 0.6, 4.0


def grams(word: str):
    """The word and its beginnings."""
    yield word
    for n in range(3, min(9, len(word))):
        yield word[:n] + "*"


def _negation(state, c):
    return 3 if c == NEGATION else max(0, state - 1)


def _report(state, c):
    return 1 if c == REPORT else state


def _target(state, c):
    return 1 if c == TARGET else state


def _threat(state, c):
    return 4 if c == MODAL else max(0, state - 1)


#: What most words are; shared, so that a word known to a worker costs its key only.
PLAIN = (OTHER, 0.0)


class Grammar:
    """The composition of the transducers over one lexicon."""

    def __init__(self, lexicon: dict[str, float], max_words: int = 150_000):
        self.lexicon, self.max_words = lexicon, max_words
        self.words: dict[str, tuple[int, float] | None] = {}
        self.arcs: dict[tuple, tuple] = {}

    def _word(self, w: str):
        if w in ".!?;\n":
            return (STOP, 0.0)
        for cls, words in ((NEGATION, NEGATIONS), (TARGET, TARGETS), (REPORT, REPORTS), (MODAL, MODALS),
                           (HARM, HARMS)):
            if w in words:
                return (cls, 0.0)
        weight = max((self.lexicon.get(g, 0.0) for g in grams(w)), default=0.0)
        return (INSULT, weight) if weight > 0 else PLAIN

    def _arc(self, state, c):
        """Next state and the factor on what the arc emits: (negation, report, target, threat)."""
        key = (state, c)
        if key not in self.arcs:
            neg, rep, tar, thr = state
            factor = 0.0
            if c == INSULT or (c == HARM and thr):
                factor = (NEGATED if neg else 1.0) * (REPORTED if rep else 1.0) * (
                    TARGET_GAIN if tar else 1.0)
            self.arcs[key] = ((_negation(neg, c), _report(rep, c), _target(tar, c), _threat(thr, c)), factor)
        return self.arcs[key]

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Greatest clause score, log of their sum, log of matched clauses, matched clauses per 100 tokens."""
        tokens = TOKEN.findall((text or "").lower())
        known = self.words
        if len(known) > self.max_words:
            known.clear()
        infos = list(map(known.get, tokens))
        if None in infos:
            for i, info in enumerate(infos):
                if info is None:
                    w = tokens[i]
                    infos[i] = known.get(w)
                    if infos[i] is None:
                        infos[i] = known[w] = self._word(w)
        if not any(c == INSULT or c == HARM for c, _ in infos):
            return (0.0, 0.0, 0.0, 0.0)
        scores, state, score, late = [], (0, 0, 0, 0), 0.0, False
        for c, weight in [*infos, (STOP, 0.0)]:
            if c == STOP:
                if score:
                    # A target after the match counts as one before it.
                    scores.append(score * (TARGET_GAIN if late else 1.0))
                state, score, late = (0, 0, 0, 0), 0.0, False
                continue
            had = state[2]
            state, factor = self._arc(state, c)
            if factor:
                score += factor * (weight if c == INSULT else THREAT_WEIGHT)
            elif c == TARGET and score and not had:
                late = True
        if not scores:
            return (0.0, 0.0, 0.0, 0.0)
        return (max(scores), math.log1p(sum(scores)), math.log1p(len(scores)),
                100.0 * len(scores) / len(tokens))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_docs: int) -> DataFrame:
    """``(key, text, toxic)`` of at most ``sample_docs`` labelled rows outside the held-out fold."""
    one = (labels.where("toxic is not null and doc_id is not null")
           .where("crc32(cast(doc_id as string)) % 5 <> 0")
           .groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic")))
    chosen = one.withColumn("key", F.xxhash64("_id")).orderBy("key").limit(sample_docs)
    # The limit bounds what is broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(
        "key", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))


def learn_lexicon(rows: DataFrame, max_lexicon: int) -> dict[str, float]:
    """Log odds of the words and beginnings that stand in toxic rows more than in others."""
    def count(batches):
        free_worker()
        seen: dict[str, list[int]] = {}
        for batch in small_batches(batches, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = {w for w in TOKEN.findall(text.lower()) if len(w) > 2}
                for g in {g for w in words for g in grams(w)}:
                    seen.setdefault(g, [0, 0])[toxic] += 1
            if len(seen) > MAX_COUNTED:
                yield flush(seen)
                seen = {}
        if seen:
            yield flush(seen)

    def flush(seen):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen)), pa.array([n for n, _ in seen.values()], pa.int64()),
             pa.array([n for _, n in seen.values()], pa.int64())], names=["gram", "n0", "n1"])

    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return {}
    counted = (rows.mapInArrow(count, "gram string, n0 long, n1 long").groupBy("gram")
               .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    odds = F.log((F.col("n1") + 0.5) / (n[1] + 1.0)) - F.log((F.col("n0") + 0.5) / (n[0] + 1.0))
    # A weight counts from where toxic rows are much likelier than chance explains.
    best = (counted.where(f"n1 >= {MIN_DOCS}").withColumn("odds", odds).where("odds > 1.5")
            .orderBy(F.desc(F.col("odds") * F.log1p("n1")), "gram").limit(max_lexicon))
    return {r["gram"]: r["odds"] for r in best.collect()}


def fit_curve(features, labels, ridge: float = 1e-2, steps: int = 50):
    """Logistic regression by Newton steps; intercept first, features standardised inside."""
    import numpy as np

    if len(set(labels)) < 2:
        return None
    x, y = np.asarray(features, float), np.asarray(labels, float)
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.ones((len(y), 1)), (x - mean) / sd])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    slope = w[1:] / sd
    return float(w[0] - slope @ mean), [float(s) for s in slope]


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, max_lexicon: int = MAX_LEXICON):
    """``(lexicon, curve)``; the curve is None when the labels have one kind only."""
    rows = materialize(labelled_sample(docs, labels, sample_docs), "toxicity-sample")
    lexicon = learn_lexicon(rows.where("key % 2 = 0"), max_lexicon)

    def measure(batches):
        free_worker()
        grammar = Grammar(lexicon)
        for batch in small_batches(batches, "text"):
            f = [grammar.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(f, pa.list_(pa.float64())), batch.column("toxic")], names=["f", "toxic"])

    measured = rows.where("key % 2 <> 0").mapInArrow(measure, "f array<double>, toxic int").collect()
    return lexicon, fit_curve([r["f"] for r in measured], [r["toxic"] for r in measured])


def score(docs: DataFrame, model) -> DataFrame:
    """``docs`` (all its columns) with ``_score``; ``model`` as ``train`` gives it."""
    lexicon, curve = model
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)       # max_lexicon entries at most

    def run(batches):
        free_worker()
        grammar = Grammar(shared.value)
        for whole in batches:
            for batch in small_batches([whole], "text"):
                out = []
                for text in batch.column("text").to_pylist():
                    if curve is None:
                        out.append(0.0)
                    else:
                        x = curve[0] + sum(a * b for a, b in zip(curve[1], grammar.features(text)))
                        out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())],
                                                 names=[*batch.schema.names, "_score"])

    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*docs.schema.fields]).add("_score", DoubleType())
    return spread(docs).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``."""
    model = train(docs, labels, sample_docs)
    scored = score(docs.select("doc_id", "text"), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"),
                         F.when(F.col("_score") >= 0.5, 1).otherwise(0).alias("predicted"))
