"""Quality by positive-unlabelled learning.

Labelled good texts are the trusted positives; texts without a label are the unlabelled web
text, a mixture of good (share ``prior``) and poor.  Labels of 0 are never used.

1. A text is measured: shares of byte classes (letters by case, digits, marks of prose, other
   symbols), words and their lengths, repeats of words, word pairs and lines, and how well it
   compresses.  Measures are spread over hinges at quantiles of the training sample, so that
   a linear score is an additive one.
2. The class prior is estimated: a curve that tells positives from unlabelled texts is fitted
   on one half of the sample; on the other half, the share of unlabelled texts above any
   threshold is at least ``prior`` times that of positives, so the least ratio (with a standard
   error for chance) bounds the prior from above, and it is met where no poor text is.  Halves
   change places, and the two estimates are averaged.
3. The score minimises the non-negative unbiased risk
   ``prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])`` with logistic loss: where a
   batch's second part falls below zero, its gradient is taken the other way.

Learnt on at most ``sample_docs`` positives and as many unlabelled texts (a parameter; least
id hash).  Rows whose crc32(doc_id) mod 4 is 2 are never learnt from, labelled or not.  Of rows
that share an id the text with the least MD5 counts, so an id that many rows hold does not swell
the sample.  Scoring reads every whole text in place, without a shuffle.

Defined results: null and empty texts are measured as texts without bytes; texts of any length
are read whole; null ``doc_id`` counts as not held out; repeated rows get equal scores; without
positives, or without training texts that have no label, all training texts are the unlabelled
ones; without positives every score is 0; an empty table gives no rows; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precedent.llm.common import materialize, small_batches, spread

SAMPLE_DOCS = 10_000
QUANTILES = (0.01, 0.05, 0.2, 0.5, 0.8, 0.9, 0.95, 0.99)
# Fixed values of the contract.
FOLDS, HELD_FOLD, THRESHOLD = 4, 2, 0.7

#: Bytes of each class; the last class holds the rest.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n",
           bytes(range(128, 256)), b".", b",", b"!", b"?", b"'\"-:;()", b"|")


def class_matrix():
    import numpy as np

    table = np.zeros((256, len(CLASSES) + 1))
    for k, members in enumerate(CLASSES):
        table[list(members), k] = 1
    table[table.sum(1) == 0, -1] = 1
    return table


def measure(text: str | None, table) -> list[float]:
    """The measures of one text; ``table`` from ``class_matrix``."""
    import numpy as np

    data = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, len(data))
    shares = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ table / size).tolist()
    words = data.split()
    n = len(words)
    if not n:
        return [*shares, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0]
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x]
    return [*shares, math.log1p(n), (size - n) / n, len(counts) / math.sqrt(n), counts.most_common(1)[0][1] / n,
            sum(map(bytes.__eq__, words, words[1:])) / n, len(set(zip(words, words[1:]))) / n,
            sum(map(bytes.isupper, words)) / n, len(set(lines)) / max(1, len(lines)), len(lines) / n,
            len(zlib.compress(data, 1)) / size]


class Model:
    """Hinges and weights; ``score`` for rows of measures."""

    def __init__(self, low, high, knots, mean, scale):
        self.low, self.high, self.knots, self.mean, self.scale = low, high, knots, mean, scale
        self.weights = self.bias = None

    def spread(self, x):
        import numpy as np

        x = np.clip(x, self.low, self.high)
        parts = [x] + [np.maximum(0.0, x - k) for k in self.knots]
        return (np.hstack(parts) - self.mean) / self.scale

    def score(self, x):
        import numpy as np

        z = self.spread(np.asarray(x, float)) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def shaped(x) -> Model:
    """A model without weights whose hinges lie at the quantiles of ``x``."""
    import numpy as np

    knots = np.quantile(x, QUANTILES, axis=0)
    model = Model(x.min(0), x.max(0), knots, 0.0, 1.0)
    wide = model.spread(x)
    scale = wide.std(0)
    # A hinge that hardly any training text passes says nothing.
    model.mean, model.scale = wide.mean(0), np.where(scale > 1e-9, scale, np.inf)
    return model


def separating_curve(z, y, ridge: float = 1.0, steps: int = 25):
    """Weights of a logistic curve, both classes weighing the same; the intercept is last."""
    import numpy as np

    z = np.hstack([z, np.ones((len(z), 1))])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + ridge * w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def class_prior(positive, unlabelled) -> float:
    """Share of positives among the unlabelled, from their scores by a curve that was fitted elsewhere."""
    import numpy as np

    best = 1.0
    for t in np.quantile(positive, np.linspace(0.0, 0.9, 19)):
        p, u = (positive >= t).mean(), (unlabelled >= t).mean()
        # A standard error of each, as the least of many ratios falls below the true one by chance.
        chance = math.sqrt(u * (1 - u) / len(unlabelled)) + math.sqrt(p * (1 - p) / len(positive))
        best = min(best, (u + chance) / max(p, 1e-9))
    return float(np.clip(best, 0.02, 0.98))


def minimise_risk(p, u, prior: float, steps: int = 800, batch: int = 1024, rate: float = 0.02, decay: float = 1e-3,
                  seed: int = 11):
    """Weights and intercept that minimise the non-negative risk, by Adam over paired batches."""
    import numpy as np

    rng = np.random.default_rng(seed)
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))
    (w, m, v), t = np.zeros((3, p.shape[1])), 0
    rounds = max(1, -(-max(len(p), len(u)) // batch))
    epochs = -(-steps // rounds)
    mean = np.zeros_like(w)
    for epoch in range(epochs):
        for at_p, at_u in zip(np.array_split(rng.permutation(len(p)), rounds), np.array_split(rng.permutation(len(u)), rounds)):
            if not len(at_p) or not len(at_u):
                continue
            xp, xu = p[at_p], u[at_u]
            zp, zu = xp @ w, xu @ w
            sp, su = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zp, zu))
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            grad_negative = xu.T @ su / len(xu) - prior * (xp.T @ sp) / len(xp)
            grad = prior * (xp.T @ (sp - 1)) / len(xp) + grad_negative if negative >= 0 else -grad_negative
            grad = grad + decay * np.append(w[:-1], 0.0)
            t += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
            if epoch >= epochs // 2:
                mean += w                                       # the later half's average is steadier
    total = max(1.0, float(rounds * (epochs - epochs // 2)))
    return mean[:-1] / total, float(mean[-1] / total)


def fit(positive, unlabelled):
    """``(model, prior)`` from rows of measures, None without positives or unlabelled rows."""
    import numpy as np

    if not len(positive) or not len(unlabelled):
        return None, None
    p, u = np.asarray(positive, float), np.asarray(unlabelled, float)
    model = shaped(np.vstack([p, u]))
    zp, zu = model.spread(p), model.spread(u)
    halves = []
    for k in (0, 1):
        own, other = ([z[i::2] if len(z) > 1 else z for z in (zp, zu)] for i in (k, 1 - k))
        w = separating_curve(np.vstack(own), np.repeat([1, 0], [len(z) for z in own]))
        halves.append(class_prior(*[z @ w[:-1] for z in other]))
    prior = sum(halves) / 2
    model.weights, model.bias = minimise_risk(zp, zu, prior)
    return model, prior


def in_fold(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, sample_docs: int) -> tuple[list, list]:
    """Measures of at most ``sample_docs`` positives and of as many unlabelled texts, in the order of their id hash."""
    known = labels.where("doc_id is not null and quality is not null").where(~in_fold(F.col("doc_id")))
    good = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    ids = docs.select("doc_id").where("doc_id is not null").where(~in_fold(F.col("doc_id")))
    free = ids.join(known.select("doc_id"), "doc_id", "left_anti")

    def chosen(rows):
        # Distinct before the limit; the limit bounds what is broadcast.
        return rows.distinct().withColumn("key", F.xxhash64("doc_id")).orderBy("key").limit(sample_docs)

    picked = chosen(good.join(ids, "doc_id", "left_semi")).withColumn("good", F.lit(True))
    blind = chosen(free).withColumn("good", F.lit(False))
    both = materialize(picked.unionAll(blind), "quality-picked")
    if both.where("not good").isEmpty():
        both = materialize(both.unionAll(chosen(ids).withColumn("good", F.lit(False))), "quality-picked")
    rows = docs.select("doc_id", "text").join(F.broadcast(both), "doc_id")

    def run(batches):
        table = class_matrix()
        for batch in small_batches(batches, "text"):
            x = [measure(t, table) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("good"), batch.column("th"), pa.array(x, pa.list_(pa.float64()))],
                names=["key", "good", "th", "x"])

    measured = rows.withColumn("th", F.md5(F.coalesce("text", F.lit("")))).mapInArrow(
        run, "key long, good boolean, th string, x array<double>")
    # One text of each id: twice the sample's rows at most reach the driver.
    one = measured.groupBy("good", "key").agg(F.min(F.struct("th", "x")).alias("best")).collect()
    one.sort(key=lambda r: r["key"])
    return [r["best"]["x"] for r in one if r["good"]], [r["best"]["x"] for r in one if not r["good"]]


def quality(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``(doc_id, held_out, score, predicted, prior)`` per row of ``docs``."""
    model, prior = fit(*training_sample(docs, labels, sample_docs))

    def run(batches):
        table = class_matrix()
        for batch in small_batches(batches, "text"):
            if not batch.num_rows:
                continue
            x = [measure(t, table) for t in batch.column("text").to_pylist()]
            score = [0.0] * len(x) if model is None else model.score(x).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())],
                                             names=["doc_id", "score"])

    scored = spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
                         F.lit(prior).cast("double").alias("prior"))
