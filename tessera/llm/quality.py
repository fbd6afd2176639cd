"""Quality by positive-unlabelled learning: the non-negative unbiased risk of a linear model.

Trusted positives are rows labelled good; the unlabelled text is drawn from all documents, whose
labels aren't looked at.  The class prior is estimated from the two samples alone (best-bin estimation), and the risk
pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)]) is minimised with the logistic loss.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, crc_fold, lean

#: Most positives, and most unlabelled documents, that are fitted.
MOST_LABELLED, MOST_UNLABELLED = 20_000, 20_000
#: Byte classes: 0 end of line, 1 other white space, 2 a-z and non-ASCII, 3 A-Z, 4 digit, 5 . , ; : ' ", 6 ! ?, 7 - ( ) / _, 8 |, 9 any other sign.
CLASSES = 10
_CLASS = np.full(256, 9, np.int64)
for _k, _set in enumerate((b"\n\r", b" \t\x0b\x0c", bytes(range(97, 123)) + bytes(range(128, 256)), bytes(range(65, 91)), b"0123456789", b".,;:'\"", b"!?", b"-()/_", b"|")):
    _CLASS[list(_set)] = _k
N_FEATURES = CLASSES * CLASSES + 12


def features(text: str | None) -> np.ndarray:
    """Shares of class pairs, and measures of repetition and of the worst line; zeros for null or empty text.

    Every byte and word of the text counts.
    """
    out = np.zeros(N_FEATURES, np.float64)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    c = _CLASS[np.frombuffer(raw, np.uint8)]
    out[: CLASSES * CLASSES] = np.sqrt(np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES) / max(1, len(c) - 1))
    words = raw.split()
    n = len(words)
    if not n:
        return out
    counts = Counter(words)
    top = max(counts.values())
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    cut = np.flatnonzero(c == 0)
    edge = np.concatenate(([0], cut + 1))
    edge = edge[edge < len(c)]
    size = np.add.reduceat(np.ones(len(c)), edge)
    share = lambda k: (np.add.reduceat((c == k).astype(float), edge) / np.maximum(size, 40)).max()
    worst = 0.0
    for line in lines:
        w = line.split()
        if len(w) > 3:
            worst = max(worst, sum(a == b for a, b in zip(w, w[1:], strict=False)) / (len(w) + 8))
    out[CLASSES * CLASSES :] = (again / n, worst, top / n, len(counts) / n, share(3), share(6), share(9), share(8), share(4), 1 - len(set(lines)) / len(lines), np.log1p(n) / 10, len(raw) / n / 20)
    return out


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.05) -> float:
    """Largest share of positives that the unlabelled scores allow: the least ratio, over thresholds, of the tails."""
    p, u = np.sort(positive), np.sort(unlabelled)
    at = np.unique(p)
    tail_p = 1 - np.searchsorted(p, at, "left") / len(p)
    tail_u = 1 - np.searchsorted(u, at, "left") / len(u)
    slack = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    ok = tail_p > 0.01
    best = np.flatnonzero(ok)[np.argmin(((tail_u + slack) / np.maximum(tail_p, 1e-9))[ok])]
    return float(np.clip(tail_u[best] / tail_p[best], 0.01, 0.99))


def fit(xp: np.ndarray, xu: np.ndarray, prior: float, rounds: int = 800, rate: float = 0.03, ridge: float = 1e-4) -> np.ndarray:
    """Weights and, last, the intercept, minimising the non-negative risk by Adam; while the negative part is below zero, its gradient is turned round."""
    a, b = (np.hstack([x, np.ones((len(x), 1))]) for x in (xp, xu))
    w = np.zeros(a.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, -z)
    for k in range(1, rounds + 1):
        zp, zu = a @ w, b @ w
        down = b.T @ sigmoid(zu) / len(b) - prior * (a.T @ sigmoid(zp)) / len(a)
        if loss(-zu).mean() - prior * loss(-zp).mean() < 0:
            g = -down
        else:
            g = down - prior * (a.T @ sigmoid(-zp)) / len(a)
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - k / (rounds + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return w


def learn(xp: np.ndarray, xu: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and prior from feature rows of positives and of unlabelled text."""
    first = fit(xp, xu, 0.5)  # ranks rows well enough for the prior, whatever the prior
    z = lambda x: x @ first[:-1]
    prior = best_bin_prior(z(xp), z(xu))
    return fit(xp, xu, prior), prior


def _features_of(rows: DataFrame) -> np.ndarray:
    """The column x of bounded ``rows``, by way of Arrow; in an order that only values decide."""
    x = rows.select("x").toArrow().column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES)
    return x[np.lexsort(x.T)]


def classify(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most_labelled: int = MOST_LABELLED, most_unlabelled: int = MOST_UNLABELLED) -> DataFrame:
    """``(doc_id long, score double)`` for every row of ``documents``, from its whole text, however long.

    Positives are the documents labelled 1 whose ids aren't held out, at most ``most_labelled`` (the
    smallest by id hash).  The unlabelled text is a sample of all documents that aren't held out, at
    most ``most_unlabelled``, whatever their labels, which aren't looked at.  Features are scaled by
    mean and deviation over all documents.  Rows with a null id aren't fitted, nor are null labels; an
    id labelled twice counts with its larger label; of rows that share an id one is fitted, by the
    hash of its features.  Null and empty texts have zero features.  If either sample is empty all
    scores are 0.5.  Equal texts have equal scores, so ties stay ties.  Repeated rows are scored
    alike; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark: SparkSession = documents.sparkSession
    scratch = Scratch(spark, "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)], np.float32).reshape(-1)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * N_FEATURES, pa.int32()), pa.array(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), cells], ["doc_id", "x"])

    rows = scratch.table(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(lean(run), "doc_id long, x array<float>"), "features")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(N_FEATURES), np.zeros(N_FEATURES)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, N_FEATURES).astype(np.float64)
            n, s, q = n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_FEATURES)), pa.array(np.full(N_FEATURES, n)), pa.array(s), pa.array(q)], ["k", "n", "s", "q"])

    stats = rows.select("x").mapInArrow(lean(sums), "k long, n long, s double, q double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("k").collect()
    n = max(1, stats[0].n if stats else 1)
    mean = np.round(np.array([r.s for r in stats]) / n if stats else np.zeros(N_FEATURES), 9)
    var = (np.array([r.q for r in stats]) / n if stats else np.zeros(N_FEATURES)) - mean**2
    scale = np.round(np.where(var > 1e-8, np.sqrt(np.maximum(var, 1e-8)), 1.0), 9)

    open_ = rows.where("doc_id is not null").where(crc_fold(F.col("doc_id")) != 0).withColumn("h", F.xxhash64("doc_id"))
    good = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y > 0").select("doc_id").distinct()
    # ids are chosen first, so that only their features are moved
    good = open_.select("doc_id", "h").distinct().join(good, "doc_id").orderBy("h", "doc_id").limit(most_labelled).select("doc_id")
    share = F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(1 << 30)) < min(1 << 30, (most_unlabelled << 30) // n)
    some = open_.where(share).select("doc_id", "h").distinct().orderBy("h", "doc_id").limit(most_unlabelled).select("doc_id")
    one = lambda ids: open_.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min_by("x", F.xxhash64("x")).alias("x"))
    scale_of = lambda x: np.clip((x - mean) / scale, -6, 6)
    weights = np.zeros(N_FEATURES + 1)
    xp, xu = _features_of(one(good)), _features_of(one(some))
    if len(xp) and len(xu):
        weights, _ = learn(scale_of(xp), scale_of(xu))
    shipped = spark.sparkContext.broadcast(pickle.dumps((mean, scale, weights)))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scale, w = pickle.loads(shipped.value)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, N_FEATURES)
            z = np.clip((x - mean) / scale, -6, 6) @ w[:-1] + w[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return rows.mapInArrow(lean(scores), "doc_id long, score double")
