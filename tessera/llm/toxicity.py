"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other. The model of a category sees the words
of a text (and the first letters of its longer words) and the probabilities of the
categories before it. For training these are out-of-fold: each comes from a model
that was fitted without the row. Models are fitted on a sample of labelled rows whose
bound is a parameter, in tasks, those of all folds at once; everything else covers all rows.
Batches of texts are scored as sparse matrices.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, lean, stage

PER_STRATUM = 4000  # labelled documents of each combination of labels that are fitted on, at most
MOST_SAMPLED = 64_000  # of all combinations together
FEATURES = 4096  # of each category at most, those that tell most
LEAST_DOCS = 3  # of the sample that hold a feature
FOLDS = 3
PENALTY = 1e-3
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Words of the lower-cased text, and the first four and five letters of longer ones."""
    words = set(_WORD.findall((text or "").lower()))
    long = [w for w in words if len(w) > 4]
    words.update([w[:4] + "*" for w in long])
    words.update([w[:5] + "*" for w in long if len(w) > 5])
    return words


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Sparse:
    """Rows of feature numbers, with dense columns beside them."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.cols = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.sizes)
        self.width = width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.cols], minlength=len(self.sizes))

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=r[self.row], minlength=self.width)


def fit(x: Sparse, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features, and of the dense columns with the intercept last, of a
    logistic regression with a quadratic penalty, by Adam over all rows at once."""
    extra = np.hstack([dense, np.ones((len(y), 1))])
    theta = np.zeros(x.width + extra.shape[1])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = weight.sum() or 1.0
    penalty = np.full(len(theta), PENALTY)
    penalty[-1] = 0
    for step in range(1, steps + 1):
        p = sigmoid(x.times(theta[: x.width]) + extra @ theta[x.width :])
        r = weight * (p - y) / total
        g = np.concatenate([x.transposed_times(r), extra.T @ r]) + penalty * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (1 - 0.9 * (step > steps // 2)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[: x.width], theta[x.width :]


@dataclass
class Chain:
    """categories in order; of each the features' weights and, for the categories before
    it and the intercept, ``after``."""

    categories: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray  # feature x category
    after: list[np.ndarray]

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities, text x category. A text of any length is a set of known features."""
        number = self.vocabulary.get
        rows = [np.array([k for k in map(number, features(t)) if k is not None], np.int64) for t in texts]
        x, out = Sparse(rows, len(self.vocabulary)), np.zeros((len(texts), len(self.categories)))
        for c, after in enumerate(self.after):
            out[:, c] = sigmoid(x.times(self.weights[:, c]) + out[:, :c] @ after[:-1] + after[-1])
        return out


def sample(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], per_stratum: int) -> DataFrame | None:
    """(_id, text, population, labels...) of at most ``per_stratum`` documents of
    each combination of labels (and MOST_SAMPLED of all), those first by a hash of the id; of
    rows of equal id the first text counts, and of contradicting labels the larger. The
    sample's ids, whose number the bounds limit, go to all tasks; texts of other documents
    stay put."""
    names = list(categories)
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), *[c.cast("double").alias(n) for n, c in categories.items()]).dropna()
    known = known.where(" AND ".join(f"`{n}` IN (0, 1)" for n in names)).groupBy("_id").agg(*[F.max(n).alias(n) for n in names])
    sizes = {tuple(r[n] for n in names): r["count"] for r in known.groupBy(*names).count().limit(MOST_SAMPLED).collect()}
    parts = []
    for values in sorted(sizes):
        own = known.where(" AND ".join(f"`{n}` = {v}" for n, v in zip(names, values)))
        parts.append(own.orderBy(F.xxhash64("_id"), "_id").limit(min(per_stratum, max(1, MOST_SAMPLED // len(sizes)))).withColumn("population", F.lit(float(sizes[values]))))
    if not parts:
        return None
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.union(part)
    found = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(chosen), "_id")
    return found.groupBy("_id").agg(F.min("text").alias("text"), *[F.max(c).alias(c) for c in ("population", *names)])


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], per_stratum: int = PER_STRATUM) -> Chain | None:
    """A chain over ``categories`` (name: 0/1 column of ``labels``), or None without any
    labelled document."""
    chosen = sample(docs, labels, categories, per_stratum)
    if chosen is None:
        return None
    names = list(categories)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(features(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found, pa.list_(pa.string())), batch.column("population"), *[batch.column(n) for n in names]], ["_id", "features", "population", *names])

    held = stage(chosen.mapInArrow(cut, "_id long, features array<string>, population double, " + ", ".join(f"`{n}` double" for n in names)), "toxic-sample")
    stats = held.agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names]).first()
    if not stats["n"]:
        return None
    counts = held.select(F.explode("features").alias("feature"), *names).groupBy("feature").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names]).where(F.col("n") >= LEAST_DOCS)
    vocabulary: dict[str, int] = {}
    for name in names:
        expected = F.col("n") * (stats[name] / stats["n"])
        told = F.pow(F.col(name) - expected, 2) / F.greatest(expected * (1 - stats[name] / stats["n"]), F.lit(1e-9))
        for r in counts.withColumn("told", told).orderBy(F.desc("told"), "feature").limit(FEATURES).select("feature").collect():
            vocabulary.setdefault(r["feature"], len(vocabulary))
    wanted = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[wanted.value[f] for f in row if f in wanted.value] for row in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found, pa.list_(pa.int32())), batch.column("population"), *[batch.column(n) for n in names]], ["_id", "rows", "population", *names])

    table = held.mapInArrow(number, "_id long, `rows` array<int>, population double, " + ", ".join(f"`{n}` double" for n in names)).toPandas().sort_values("_id", kind="stable")
    rows = [np.asarray(r, np.int64) for r in table["rows"]]
    y = table[names].to_numpy(float)
    strata = table.groupby(names)["_id"].transform("count").to_numpy(float)
    weight = table["population"].to_numpy(float) / strata
    fold = table["_id"].to_numpy(np.int64) % FOLDS
    chain = Chain(names, vocabulary, np.zeros((len(vocabulary), len(names))), [])
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((rows, y, weight, fold))  # the sample: at most MOST_SAMPLED rows of as many numbers as the vocabulary has
    before = np.zeros((len(rows), 0))
    for c in range(len(names)):
        folds = range(-1, FOLDS if c + 1 < len(names) else 0)  # -1: all rows
        made = _fits(docs, folds, shared, context.broadcast(before), c, len(vocabulary))
        chain.weights[:, c], after = made[-1][0], made[-1][1]
        chain.after.append(after)
        if c + 1 < len(names):
            before = np.hstack([before, sum(made[k][2] for k in range(FOLDS))[:, None]])
    shared.unpersist()
    return chain


def fit_fold(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, fold: np.ndarray, before: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model of one category fitted without fold ``k`` (-1: on all rows), and its
    probabilities for the fold's rows, 0 for others."""
    rest, held_out = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
    out = np.zeros(len(rows))
    if not len(rest):
        return np.zeros(width), np.zeros(before.shape[1] + 1), out
    w, a = fit(Sparse([rows[i] for i in rest], width), before[rest], y[rest], weight[rest])
    if len(held_out):
        part = Sparse([rows[i] for i in held_out], width)
        out[held_out] = sigmoid(part.times(w) + np.hstack([before[held_out], np.ones((len(held_out), 1))]) @ a)
    return w, a, out


def _fits(docs: DataFrame, folds: range, shared, before, c: int, width: int) -> dict[int, tuple]:
    """``fit_fold`` of category ``c`` for each of ``folds``, each in a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows, y, weight, fold = shared.value
                made = fit_fold(rows, y[:, c], weight, fold, before.value, k, width)
                yield pa.record_batch({"k": pa.array([k], pa.int64()), "made": pa.array([[m.tobytes() for m in made]], pa.list_(pa.binary()))})

    tasks = docs.sparkSession.range(folds.start, folds.stop, 1, len(folds))
    return {r["k"]: tuple(np.frombuffer(m) for m in r["made"]) for r in tasks.mapInArrow(lean(run), "k long, made array<binary>").collect()}


def score(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], per_stratum: int = PER_STRATUM) -> DataFrame:
    """(doc_id, p_<category>...) for each row of ``docs`` (doc_id, text; other columns are
    ignored), by a chain fitted on ``labels`` (doc_id and the columns that
    ``categories`` names).

    Labels that are null or neither 0 nor 1 are not learnt from; of several rows for a
    doc_id the larger label of each category counts. Null and empty texts are scored by what comes without words.
    Without labelled documents all probabilities are 0. Repeated rows are scored each;
    an empty table gives an empty result."""
    bound_batches(docs.sparkSession)
    names = list(categories)
    chain = train(docs, labels, categories, per_stratum)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if chain is None:
        return rows.select("doc_id", *[F.lit(0.0).alias(f"p_{n}") for n in names])
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, c]) for c in range(len(names))]], ["doc_id", *[f"p_{n}" for n in names]])

    return rows.mapInArrow(lean(run), "doc_id long, " + ", ".join(f"`p_{n}` double" for n in names))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    # the labelled categories there are, from the general to the special
    found = score(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    return found.select("doc_id", (F.col("p_toxic") >= 0.5).alias("toxic"), "p_toxic", "p_low_quality")
