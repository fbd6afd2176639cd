"""Toxicity of text restored by noisy-channel decoding.

Writers hide words by leetspeak, by spacing letters out and by repeating them.  Each suspicious
stretch becomes a lattice: every written character may stand for some letters, for nothing (a
separator) or for part of a run.  Viterbi decoding under a character trigram model of the corpus
finds the likeliest letters, and the restored text is scored by words and word beginnings whose
association with labelled toxicity is beyond chance.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, crc_fold, lean, small_batches

#: What a written character may stand for, beside itself.
SUBSTITUTES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i"}
#: Channel costs in nats: reading a substitute, leaving out a separator, shortening a run by one, keeping a sign that isn't a letter,
#: leaving out a substitute (but !) at an end.
SUBSTITUTE_COST, SEPARATOR_COST, REPEAT_COST, KEEP_COST, EDGE_COST = 1.0, 0.5, 0.4, 10.0, 8.0
#: Most labelled rows that are fitted.
MOST_LABELLED = 20_000
SYMBOLS = 28
#: Byte to symbol: 1-26 a-z in either case, 27 any byte of a non-ASCII letter, 0 all else.
_SYMBOL = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if b >= 128 else 0 for b in range(256)], np.int64)

_LEET = "".join(map(re.escape, SUBSTITUTES))
#: Two or more single letters or substitutes with anything else between them; or, up to a stop or white space, whatever holds
#: a substitute or a run of three equal letters.
_SUSPECT = re.compile(
    rf"(?P<spaced>(?<![^\W_])(?:[^\W\d_]|[{_LEET}])(?:(?:[^\w{_LEET}]|_)++(?:[^\W\d_]|[{_LEET}])(?![{_LEET}]*[^\W_]))++)"
    rf"|(?<![^\s.,;:])(?:[^\s.,;:{_LEET}]*+[{_LEET}]|[^\s.,;:]*?([^\W\d_])\2\2)[^\s.,;:]*+"
)
_APART = re.compile(rf"(?:[^\w{_LEET}]|_)+")
_HIDDEN = re.compile(rf"[{_LEET}]|([^\W\d_])\1\1")
_PLAIN = re.compile(rf"(?<![^\W_])(?<![{_LEET}])[^\W\d_]{{3,}}+(?=[{_LEET}]++(?![^\W_]))")
_ALONE = re.compile(r"(?:[\W\d_]*[^\W\d_](?![^\W\d_])){3,}[\W\d_]*")
_WORD = re.compile(r"[^\W\d_]+")


class LanguageModel:
    """Add-k smoothed character trigram model; costs are negative log probabilities."""

    def __init__(self, counts: np.ndarray, k: float = 0.5):
        c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float) + k
        self._hold(-np.log(c / c.sum(axis=2, keepdims=True)))

    def _hold(self, cost: np.ndarray) -> None:
        self.cost = cost
        #: The costs of each next symbol, by state: the last two symbols as one number.
        self.rows = cost.reshape(SYMBOLS * SYMBOLS, SYMBOLS).tolist()

    @classmethod
    def of(cls, cost: np.ndarray) -> LanguageModel:
        model = cls.__new__(cls)
        model._hold(cost)
        return model


def trigram_counts(texts: Iterator[str | None]) -> np.ndarray:
    out = np.zeros(SYMBOLS**3, np.int64)
    for t in texts:
        if t:
            s = np.concatenate(([0, 0], _SYMBOL[np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)], [0]))
            out += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    return out


def _symbol(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch.isalpha() else 0


def decode(written: str, model: LanguageModel, apart: bool = True) -> str:
    """The likeliest letters behind one lower-cased suspicious stretch of any length.

    The lattice's nodes are runs of equal characters.  A run of n is read as one to three copies of
    a letter it may stand for, or left out if it is a separator between other characters, or read as
    the blank between two words (only if ``apart``), or kept.  The states are the last two symbols,
    so time is linear in the length; paths share their beginnings, as links to what was said before.
    """
    runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", written, re.S)]
    rows, last = model.rows, len(runs) - 1
    beam: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for i, (ch, n) in enumerate(runs):
        arcs: list[tuple[str, float]] = []
        letters = [(ch, 0.0)] if ch.isalpha() else [(x, SUBSTITUTE_COST) for x in SUBSTITUTES.get(ch, "")]
        for letter, cost in letters:
            arcs += [(letter * k, cost + REPEAT_COST * (n - k)) for k in range(1, min(n, 3) + 1)]
        if not ch.isalpha():
            arcs.append((ch * n, KEEP_COST))
            if not 0 < i < last:
                arcs.append((" ", EDGE_COST if ch in SUBSTITUTES and ch != "!" else SEPARATOR_COST))
            elif ch not in SUBSTITUTES and not ch.isalnum():
                arcs.append(("", SEPARATOR_COST))
                if apart:
                    arcs.append((" ", SEPARATOR_COST))
        said = [(out, [_symbol(x) for x in out], cost) for out, cost in arcs]
        after: dict[int, tuple[float, tuple | None]] = {}
        for two, (base, link) in beam.items():
            for out, symbols, cost in said:
                total, state = base + cost, two
                for s in symbols:
                    total += rows[state][s]
                    state = state % SYMBOLS * SYMBOLS + s
                if state not in after or total < after[state][0]:
                    after[state] = (total, (link, out))
        beam = after
    link = min((cost + rows[two][0], two, link) for two, (cost, link) in beam.items())[2]
    parts = []
    while link:
        link, out = link
        parts.append(out)
    return "".join(reversed(parts))


class Restorer:
    """Restores whole texts; short stretches seen before are looked up (at most ``remember`` of them).

    Where separators may part words as well as letters, the stretch is given as one word, as several,
    and part by part; signs between single letters are left out in one more reading.  Words
    written plainly before a substitute stay.  Letters spaced out hide where words begin, and the
    decoder may part them wrongly; so ``known`` words of four letters or more that occur in such a
    stretch are named as well.  A number alone isn't read as a word, unless its digits are spaced out.
    """

    def __init__(self, model: LanguageModel, remember: int = 1 << 16, known: Iterable[str] = ()):
        self.model, self._known = model, {w for w in known if len(w) >= 4}
        self._lengths = sorted(set(map(len, self._known)))
        self._seen = lru_cache(remember)(self._read)

    def _read(self, stretch: str, spaced: bool) -> str:
        parts = [x for x in _APART.split(stretch) if x]
        said = [decode(stretch, self.model)]
        if len(parts) > 1:
            said.append(decode(stretch, self.model, apart=False))
            if not spaced:
                said += [decode(x, self.model) for x in parts if len(x) > 1 and _HIDDEN.search(x) and _WORD.search(x)]
        said += _PLAIN.findall(stretch)
        whole = [said[len(parts) > 1]]
        if _ALONE.fullmatch(stretch) and any(x in SUBSTITUTES and not x.isalnum() for x in stretch):
            whole.append("".join(_WORD.findall(stretch)))
            said.append(whole[-1])
        if spaced or len(whole) > 1:
            said += sorted({w for x in whole for n in self._lengths for i in range(len(x) - n + 1) if (w := x[i : i + n]) in self._known})
        return " ".join(dict.fromkeys(said))

    def _restore(self, m: re.Match) -> str:
        stretch, spaced = m[0], m["spaced"] is not None
        if not (_WORD.search(stretch) or "@" in stretch or (spaced and len(stretch) > 6)):
            return stretch
        return f" {(self._seen if len(stretch) <= 64 else self._read)(stretch, spaced)} "

    def __call__(self, text: str | None) -> str:
        return _SUSPECT.sub(self._restore, text.lower()) if text else ""


def features(restored: str) -> set[str]:
    """Words, and beginnings of four to six letters (marked ``-``) of longer words."""
    words = set(_WORD.findall(restored))
    out = set(words)
    for n in (4, 5, 6):
        out.update(w[:n] + "-" for w in words if len(w) > n)
    return out


def summary(found: list[float], n_words: int) -> list[float]:
    """What the calibrated score sees of a text: its strongest evidence, the sum of its five strongest, the number of all evidence, and of words.

    The sum stops at five so that long clean texts don't add up chance evidence; more of it shows in its number.
    """
    found = sorted(found, reverse=True)
    return [found[0] if found else 0.0, sum(found[:5]), math.log1p(len(found)), math.log1p(n_words)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(a.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(keep), a.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def language_model(documents: DataFrame, text: str = "text") -> LanguageModel:
    """Character trigram counts over every whole text; what reaches the driver is at most SYMBOLS^3 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            total += trigram_counts(t.as_py() for t in batch.column(0))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    counts = np.zeros(SYMBOLS**3, np.int64)
    for r in documents.select(text).mapInArrow(lean(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[r.code] = r.n
    return LanguageModel(counts)


def _evidence(cost: np.ndarray, weights: dict[str, float]):
    restore = Restorer(LanguageModel.of(cost), known=(w for w in weights if not w.endswith("-")))
    get = weights.get

    def of(text: str | None) -> list[float]:
        words = set(_WORD.findall(restore(text)))
        found = []
        for w in words:
            best = max(get(w, 0.0), get(w[:4] + "-", 0.0), get(w[:5] + "-", 0.0), get(w[:6] + "-", 0.0)) if len(w) > 4 else get(w, 0.0)
            if best:
                found.append(best)
        return summary(found, len(words))

    return of


class Model:
    """Language model, evidence of features, and calibration of the score."""

    def __init__(self, lm: LanguageModel, weights: dict[str, float], calibration: np.ndarray):
        self.lm, self.weights, self.calibration = lm, weights, calibration

    def scorer(self):
        of, w = _evidence(self.lm.cost, self.weights), self.calibration
        return lambda text: 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(of(text), w[:-1]) + w[-1])))))


def train(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most_labelled: int = MOST_LABELLED) -> Model:
    """Fit on the labelled rows that aren't held out, ``most_labelled`` of them at most (the smallest by id hash).

    The language model covers all documents.  Rows with a null id or label are left out; an id
    labelled twice counts with its larger label; of documents that share an id one is fitted, by the
    hash of its text.  Texts are read whole, however long; null and empty ones have no features.
    Features of equal weight are independent of each other, so there are no ties.  Other columns are
    ignored, whatever their names; either table may be empty.  Without both classes the model has no features and
    scores every text by the share of toxic labels (0.5 with one added to either class if none).
    """
    spark: SparkSession = documents.sparkSession
    scratch = Scratch(spark, "toxicity")
    lm = language_model(documents, text)
    rows = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    rows = rows.where(crc_fold(F.col("id")) != 0).orderBy(F.xxhash64("id"), "id").limit(most_labelled)
    rows = spark.createDataFrame(rows.collect(), "id long, y int")  # bounded by most_labelled
    sample = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).join(F.broadcast(rows), "id")
    sample = scratch.table(sample.groupBy("id").agg(F.min_by("t", F.xxhash64("t")).alias("t"), F.max("y").alias("y")).select("t", "y"), "sample")
    cost = spark.sparkContext.broadcast(pickle.dumps(lm.cost))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(LanguageModel.of(pickle.loads(cost.value)))
        for batch in batches:
            sums = (Counter(), Counter())
            for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                sums[y > 0].update(features(restore(t.as_py())))
            names = list(sums[0].keys() | sums[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([s[n] for n in names], pa.int64()) for s in sums]], ["f", "clean", "toxic"])

    n = {r.y: r["count"] for r in sample.groupBy((F.col("y") > 0).cast("int").alias("y")).count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(lm, {}, np.array([0.0, 0.0, 0.0, 0.0, math.log((n_toxic + 1) / (n_clean + 1))]))
    sums = sample.mapInArrow(lean(count), "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("b"), F.sum("toxic").alias("a"))
    p, q = F.lit(n_toxic / (n_toxic + n_clean)), F.lit(n_clean / (n_toxic + n_clean))
    a, b = F.col("a"), F.col("b")
    term = lambda x, e: F.when(x > 0, x * F.log(x / ((a + b) * e))).otherwise(0.0)
    sums = sums.where("a >= 3").withColumn("g", 2 * (term(a, p) + term(b, q)))
    sums = sums.withColumn("w", F.log((a + 0.5) / (n_toxic + 1.0)) - F.log((b + 0.5) / (n_clean + 1.0))).where("w > 2")
    # beyond chance for the number of features that there may be, about ten for each labelled word
    kept = sums.where(F.col("g") > 2 * math.log(50.0 * (n_toxic + n_clean)) + 4).collect()  # fewer than the sample has words
    weights = {r.f: float(r.w) for r in kept}
    shipped = spark.sparkContext.broadcast(pickle.dumps(weights))

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _evidence(pickle.loads(cost.value), pickle.loads(shipped.value))
        for batch in batches:
            x = [of(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    fitted = sample.mapInArrow(lean(summaries), "x array<double>, y int").collect()  # four numbers a labelled row
    x, y = np.array([r.x for r in fitted]), np.array([float(r.y > 0) for r in fitted])
    order = np.lexsort((*x.T, y))  # the same sums whatever the order of rows
    return Model(lm, weights, fit_logistic(x[order], y[order]))


def score(documents: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``documents`` and a column ``out``, 0 to 1, of the whole text.

    Texts are read whole, however long.  Null and empty texts get the score of no evidence.  Equal
    texts have equal scores; repeated rows are scored alike; an empty table gives no rows.  ``out``
    must not be a column of ``documents``, whose other columns may have any names.
    """
    spark: SparkSession = documents.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(pickle.dumps((model.lm.cost, model.weights, model.calibration)))
    schema = documents.schema
    names = [f"c{i}" for i in range(len(schema))]
    at = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, weights, calibration = pickle.loads(shipped.value)
        of = Model(LanguageModel.of(cost), weights, calibration).scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([of(t.as_py()) for t in batch.column(at)], pa.float64())], [*names, "s"])

    made = documents.toDF(*names).mapInArrow(lean(run), ", ".join([*[f"{n} {f.dataType.simpleString()}" for n, f in zip(names, schema, strict=True)], "s double"]))
    return made.toDF(*documents.columns, out)
