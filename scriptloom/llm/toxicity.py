"""Toxicity score: linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct hashed n-grams (orders 3 to 6) of the lower-cased text.
From a bounded sample of labelled rows come smoothed log-count ratios r; the
features with the largest chi-square statistic are kept, scaled by r, and a
logistic regression with L2 penalty is fitted on the driver (L-BFGS, sample
weights restore the share of the classes). Cross-validation on the sampled rows
finds the cut that keeps most toxic rows, where a share of clean rows above it
weighs ``FALSE_COST`` times as much; the intercept is moved so that this cut has the
score ``THRESHOLD``. Scoring looks up every n-gram of every whole text in one table
of the kept features; presence counts, not frequency.

Bounds: at most ``SAMPLE_TOXIC`` + ``SAMPLE_CLEAN`` labelled rows (lowest hashes of
doc_id) are fitted; executors count their features, and the driver gets the counts
of the ``KEEP`` best and which of those each sampled row holds.

Defined results: null and empty texts score as the intercept; null labels and
labels without a document are not used; without both classes in the sample every
score is the smoothed share of toxic labels (0.5 without labels); classes of fewer
than ``2 * FOLDS`` rows are not cross-validated; rows repeated or with equal ids are
scored one by one (one of them is fitted); null ids are scored, not fitted, and not
held out; extra columns, whatever their names, are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, map_rows, materialise, remove, shared_dir, slices, texts_of

ORDERS, HASH_BITS, KEEP = (3, 4, 5, 6), 20, 4_000
SAMPLE_TOXIC, SAMPLE_CLEAN = 2_000, 3_000
THRESHOLD, FOLDS, FALSE_COST = 0.3, 4, 10
_P, _K = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def _concatenated(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between spaces, and where each begins (with the end last)."""
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.cumsum([0, *map(len, padded)])


def grams(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(order, hashed n-gram that begins at each position) by extending the shorter hash."""
    h = points + np.uint32(1)
    for n in range(2, ORDERS[-1] + 1):
        if len(points) < n:
            return
        h = h[:-1] * _P
        h ^= points[n - 1 :]
        if n in ORDERS:
            yield n, (h * _K + np.uint32(n)) * _P >> np.uint32(32 - HASH_BITS)


def presence(texts: list[str], wanted: np.ndarray | None = None) -> list[np.ndarray]:
    """Distinct features of each text; only those where ``wanted`` is true, if given."""
    points, at = _concatenated(texts)
    rows, features = [], []
    for n, h in grams(points):
        where = np.flatnonzero(wanted[h]) if wanted is not None else np.arange(len(h))
        row = np.searchsorted(at, where, side="right") - 1
        inside = where + n <= at[row + 1]
        rows.append(row[inside])
        features.append(h[where[inside]])
    if not rows:
        return [np.zeros(0, np.uint32) for _ in texts]
    pairs = np.unique((np.concatenate(rows).astype(np.uint64) << np.uint64(HASH_BITS)) | np.concatenate(features))
    cuts = np.searchsorted(pairs >> np.uint64(HASH_BITS), np.arange(1, len(texts)))
    return np.split((pairs & np.uint64((1 << HASH_BITS) - 1)).astype(np.uint32), cuts)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # by feature; 0 where it was not kept
    intercept: float

    def scores(self, texts: list[str]) -> np.ndarray:
        wanted = self.weights != 0
        z = np.array([self.weights[f].sum(dtype=np.float64) for f in presence(texts, wanted)]) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _lbfgs(value_and_gradient, x: np.ndarray, steps: int = 60, memory: int = 8) -> np.ndarray:
    f, g = value_and_gradient(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = s @ d / (y @ s)
            alphas.append(a)
            d -= a * y
        d *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            d += s * (a - y @ d / (y @ s))
        t, slope = 1.0, g @ d
        while True:
            new = x - t * d
            f2, g2 = value_and_gradient(new)
            if f2 <= f - 1e-4 * t * slope or t < 1e-6:
                break
            t /= 2
        s, y = new - x, g2 - g
        done = abs(f - f2) < 1e-7 * max(1.0, abs(f))
        x, f, g = new, f2, g2
        if y @ s > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        if done:
            break
    return x


def chi_square(c1, c0, n1, n0):
    """Columns or arrays: association of a feature's presence with the label."""
    both = c1 + c0
    return (c1 * (n0 - c0) - c0 * (n1 - c1)) ** 2 / (both * (n1 + n0 - both + 0.5))


def log_count_ratios(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int, smoothing: float = 1.0) -> np.ndarray:
    """How much more often a feature is in toxic rows than in clean ones, as a logarithm."""
    return np.log((c1 + smoothing) / (n1 + 2 * smoothing)) - np.log((c0 + smoothing) / (n0 + 2 * smoothing))


def _regression(rows: list[np.ndarray], labels: np.ndarray, n: int, toxic_share: float, penalty: float) -> tuple[np.ndarray, float]:
    """(weight of each of ``n`` features, intercept) from the features each row holds."""
    n1, n0 = int(labels.sum()), int((~labels).sum())
    column = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    c1 = np.bincount(column[labels[row]], minlength=n)
    r = log_count_ratios(c1, np.bincount(column, minlength=n) - c1, n1, n0)
    weight = np.where(labels, toxic_share / n1, (1 - toxic_share) / n0) * len(labels)
    y = labels.astype(np.float64)

    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = x[:-1], x[-1]
        z = np.bincount(row, weights=(w * r)[column], minlength=len(y)) + b
        loss = (weight * (np.logaddexp(0, z) - y * z)).sum() + penalty * (w @ w) / 2
        e = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        return loss, np.append(np.bincount(column, weights=e[row], minlength=len(w)) * r + penalty * w, e.sum())

    x = _lbfgs(objective, np.zeros(n + 1))
    return x[:-1] * r, float(x[-1])


def fair_cut(z: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the largest share of toxic rows above it less ``FALSE_COST`` times that of clean rows; half way to the next value below."""
    values = np.unique(z)
    toxic, clean = np.sort(z[labels]), np.sort(z[~labels])
    above = lambda x: 1 - np.searchsorted(x, values) / len(x)
    best = int(np.argmax(above(toxic) - FALSE_COST * above(clean)))
    return float(values[best] + values[max(0, best - 1)]) / 2


def fit(rows: list[np.ndarray], labels: np.ndarray, kept: np.ndarray, toxic_share: float, penalty: float = 1.0) -> Model:
    """Fit on which of the ``kept`` features (sorted) each row holds."""
    labels = labels.astype(bool)
    weights = np.zeros(1 << HASH_BITS, np.float32)
    least = min(labels.sum(), (~labels).sum())
    if not least or not len(kept):
        return Model(weights, 0.0)
    columns = [np.searchsorted(kept, x) for x in rows]
    found, intercept = _regression(columns, labels, len(kept), toxic_share, penalty)
    if least >= 2 * FOLDS:
        fold = np.empty(len(rows), np.int64)
        for label in (True, False):
            fold[labels == label] = np.arange((labels == label).sum()) % FOLDS
        z = np.empty(len(rows))
        for k in range(FOLDS):
            w, b = _regression([columns[i] for i in np.flatnonzero(fold != k)], labels[fold != k], len(kept), toxic_share, penalty)
            for i in np.flatnonzero(fold == k):
                z[i] = w[columns[i]].sum() + b
        intercept += float(np.log(THRESHOLD / (1 - THRESHOLD))) - fair_cut(z, labels)
    weights[kept] = found
    return Model(weights, intercept)


def train(docs: DataFrame, labels: DataFrame, held_out_remainder: int = 2) -> Model:
    """Fit on labelled rows whose crc32(doc_id) mod 4 is not ``held_out_remainder``."""
    spark = docs.sparkSession
    usable = labels.filter(F.col("toxic").isin(0, 1) & (crc32_mod(F.col("doc_id"), 4) != held_out_remainder)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    # without features the share of toxic labels is all there is
    nothing = Model(np.zeros(1 << HASH_BITS, np.float32), float(np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))))
    if not counts.get(1) or not counts.get(0):
        return nothing
    order = F.xxhash64("doc_id")
    chosen = [r for label, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)) for r in usable.filter(F.col("toxic") == label).orderBy(order, "doc_id").limit(n).collect()]
    ids = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], "doc_id long, toxic int")
    folder = shared_dir(spark)
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids are broadcast
    sample = materialise(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]), f"{folder}/sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, (1 << HASH_BITS) + 1), np.int64)
        for batch in (p for b in batches for p in slices(b, 1 << 20)):
            found = presence(texts_of(batch.column(1)))
            for x, label in zip(found, batch.column(2).to_pylist(), strict=True):
                total[label, x] += 1
                total[label, -1] += 1
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[1, some]), pa.array(total[0, some])], names=["feature", "c1", "c0"])

    sums = sample.mapInArrow(count, "feature int, c1 long, c0 long").groupBy("feature").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    sums = materialise(sums, f"{folder}/features")  # at most 2^HASH_BITS + 1 rows
    whole = sums.filter(F.col("feature") == 1 << HASH_BITS).first()
    if whole is None or not whole["c1"] or not whole["c0"]:
        return nothing
    ranked = sums.filter((F.col("feature") < 1 << HASH_BITS) & (F.col("c1") + F.col("c0") >= 3)).withColumn(
        "chi", chi_square(F.col("c1").cast("double"), F.col("c0").cast("double"), float(whole["c1"]), float(whole["c0"]))
    )
    kept = np.array(sorted(r["feature"] for r in ranked.filter("chi > 0").orderBy(F.desc("chi"), "feature").limit(KEEP).select("feature").collect()), dtype=np.int64)
    if not len(kept):
        return nothing

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << HASH_BITS, bool)
        wanted[kept] = True
        for batch in (p for b in batches for p in slices(b, 1 << 20)):
            found = presence(texts_of(batch.column(1)), wanted)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())], names=["doc_id", "toxic", "features"])

    got = sorted((r["doc_id"], r["toxic"], bytes(r["features"])) for r in sample.mapInArrow(featurise, "doc_id long, toxic int, features binary").collect())
    remove(spark, folder)
    return fit([np.frombuffer(x, "<u4").astype(np.int64) for _, _, x in got], np.array([t for _, t, _ in got]), kept, counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, held_out_remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    kept = np.flatnonzero(model.weights)
    shipped = docs.sparkSession.sparkContext.broadcast((kept.astype(np.uint32), model.weights[kept], model.intercept))  # at most KEEP features
    name = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = _model(name, shipped).scores(texts_of(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    scored = map_rows(docs.select("doc_id", "text"), run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(crc32_mod(F.col("doc_id"), 4) == held_out_remainder, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


_MODELS: dict[str, Model] = {}


def _model(key: str, shipped) -> Model:
    """The model of this worker, rebuilt when another one arrives."""
    if key not in _MODELS:
        kept, weights, intercept = shipped.value
        full = np.zeros(1 << HASH_BITS, np.float32)
        full[kept] = weights
        _MODELS.clear()
        _MODELS[key] = Model(full, intercept)
    return _MODELS[key]
