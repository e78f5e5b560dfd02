"""Toxicity by cumulative-link (proportional-odds) ordinal regression over sparse word features."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Rows of each grade that a model is fitted on at most.
ROWS_PER_GRADE = 2000
#: Hash buckets of the features.
BUCKETS = 1 << 20
#: Lengths of the word beginnings that are features besides the word itself.
PREFIXES = (4, 5, 6, 7, 8)
#: Sampled rows that a feature must occur in.
MIN_ROWS = 5
#: Words whose weights a task remembers before it starts anew.
CACHE_WORDS = 400_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """The distinct words (runs of letters, lower case) of a whole text."""
    return set(_WORD.findall((text or "").lower()))


def buckets_of(word: str) -> list[int]:
    """Hash buckets of the word and of its beginnings."""
    raw = [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in raw]


def features_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how many of its distinct words fall into each."""
    return np.unique(np.fromiter((b for w in words_of(text) for b in buckets_of(w)), np.int64), return_counts=True)


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade > grades[k]) = sigmoid(w.x - theta[k]); one weight for each bucket, thresholds ascending."""

    grades: tuple[int, ...]
    theta: np.ndarray
    weights: np.ndarray

    def above(self, score: np.ndarray | float) -> np.ndarray:
        """P(grade > grades[k]) for every threshold k, along the last axis."""
        z = np.asarray(score, float)[..., None] - self.theta
        return 0.5 * (1 + np.tanh(0.5 * z))

    def severity(self, above: np.ndarray) -> np.ndarray:
        """Expected grade, from the probabilities of ``above``."""
        return self.grades[0] + above @ np.diff(np.array(self.grades, float))


def fit_ordinal(features: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, rounds: int = 200, l1: float = 1.5e-3) -> OrdinalModel:
    """Proportional-odds fit with an L1 penalty by accelerated proximal gradient steps, grades weighing alike.

    ``features`` has (buckets, counts) of each row; a feature is its count over
    the largest one seen. The penalty leaves telling features alone with a
    weight. Thresholds are not penalised and are kept in order.
    """
    levels = tuple(sorted({int(g) for g in grades}))
    none = np.zeros(BUCKETS, np.float32)
    if len(levels) < 2:
        return OrdinalModel(levels or (0,), np.zeros(0), none)
    at = np.searchsorted(levels, grades)
    k, n = len(levels) - 1, len(features)
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(b) for b, _ in features])
    columns, value = np.concatenate([b for b, _ in features]), np.concatenate([c for _, c in features]).astype(np.float64)
    seen, most = np.bincount(columns, minlength=BUCKETS), np.zeros(BUCKETS)
    np.maximum.at(most, columns, value)
    used = np.flatnonzero(seen >= min(MIN_ROWS, max(1, n // 20)))
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    kept = place[columns] >= 0
    rows, value, columns = rows[kept], value[kept] / most[columns[kept]], place[columns[kept]]
    m = len(used)
    weight = 1.0 / ((k + 1) * np.bincount(at, minlength=k + 1))[at]
    sigmoid = lambda z: 0.5 * (1 + np.tanh(0.5 * z))
    times = lambda w: np.bincount(rows, weights=w[columns] * value, minlength=n)
    back = lambda r: np.bincount(columns, weights=r[rows] * value, minlength=m)

    def gradient(w: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = sigmoid(theta[None, :] - times(w)[:, None])
        edge = np.zeros((n, 1))
        cdf, dens = np.hstack([edge, cut, edge + 1]), np.hstack([edge, cut * (1 - cut), edge])
        i = np.arange(n)
        each = weight / np.maximum(cdf[i, at + 1] - cdf[i, at], 1e-12)
        up, down = each * dens[i, at + 1], each * dens[i, at]
        dtheta = np.bincount(at, weights=-up, minlength=k + 1)[:k] + np.bincount(at, weights=down, minlength=k + 1)[1:]
        return back(up - down), dtheta

    v = np.random.default_rng(0).random(m)
    for _ in range(12):
        v = back(weight * times(v / np.linalg.norm(v)))
    step = 1.0 / ((0.25 if k == 1 else 0.5) * (np.linalg.norm(v) + 1.0) * 2)
    w, theta = np.zeros(m), np.linspace(-1, 1, k) if k > 1 else np.zeros(1)
    yw, yt, t = w.copy(), theta.copy(), 1.0
    for _ in range(rounds):
        gw, gt = gradient(yw, yt)
        new = yw - step * gw
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        bent = np.maximum.accumulate(yt - step * gt + 1e-9 * np.arange(k))
        if ((yw - new) * (new - w)).sum() > 0:
            t = 1.0
        nt = 0.5 * (1 + math.sqrt(1 + 4 * t * t))
        yw, yt = new + (t - 1) / nt * (new - w), bent + (t - 1) / nt * (bent - theta)
        w, theta, t = new, bent, nt
    full = none.copy()
    full[used] = w / most[used]
    return OrdinalModel(levels, theta, full)


def predict(texts: list[str | None], model: OrdinalModel, known: dict[str, float]) -> np.ndarray:
    """Scores w.x of whole texts; ``known`` remembers words between calls, up to a bound."""
    out = []
    for text in texts:
        found = words_of(text)
        if len(known) + len(found) > CACHE_WORDS:
            known.clear()
        for word in found.difference(known):
            known[word] = float(model.weights[buckets_of(word)].sum())
        out.append(math.fsum(map(known.__getitem__, found)))
    return np.array(out)


def training_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS_PER_GRADE, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Features and grades of at most ``rows`` labelled rows of each grade, chosen by a hash of the id.

    Only labels are ranked; texts are joined to the chosen ids and become
    bucket numbers on the executors. Null ids and grades are left out.
    """
    graded = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("grade"))
    draw = F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit("grade")), 11).cast("double") / F.lit(float(1 << 53))
    share = graded.groupBy("grade").agg((F.lit(2.0 * rows + 50) / F.count("*")).alias("share"))
    near = graded.withColumn("draw", draw).join(share, "grade").where("draw < share")
    rank = F.row_number().over(Window.partitionBy("grade").orderBy("draw", "id"))
    chosen = near.withColumn("rank", rank).where(F.col("rank") <= rows).select("id", "grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features_of(t) for t in batch.column(2).to_pylist()]
            lists = [pa.array([f[i].astype(np.int32) for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["id", "grade", "buckets", "counts"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "grade", "text")
    kind = docs.schema[id_col].dataType.simpleString()
    got = texts.mapInArrow(run, f"id {kind}, grade int, buckets array<int>, counts array<int>").toArrow().sort_by([("grade", "ascending"), ("id", "ascending")])
    ends = [np.asarray(c.combine_chunks().offsets) for c in (got["buckets"],)][0]
    flat = [np.asarray(got[c].combine_chunks().values) for c in ("buckets", "counts")]
    return [(flat[0][a:b], flat[1][a:b]) for a, b in zip(ends, ends[1:])], np.asarray(got["grade"], np.int64)


def severity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, severity (expected grade), p_toxic (above the lowest grade), grade, toxic.

    grade is the highest grade that is at least as likely reached as not; toxic
    says that it is not the lowest. Null, empty and wordless texts score as no
    features at all. Other columns are ignored; repeated rows each get a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, known = shared.value, {}
        for batch in batches:
            if len(fitted.grades) < 2:
                scores, above = np.zeros(batch.num_rows), np.zeros((batch.num_rows, 0))
            else:
                scores = predict(batch.column(1).to_pylist(), fitted, known)
                above = fitted.above(scores)
            grade = np.array(fitted.grades)[(above >= 0.5).sum(axis=1)]
            first = above[:, 0] if above.shape[1] else np.zeros(batch.num_rows)
            columns = [batch.column(0), pa.array(fitted.severity(above)), pa.array(first), pa.array(grade, pa.int32()), pa.array(first >= 0.5)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "severity", "p_toxic", "grade", "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, severity double, p_toxic double, grade int, toxic boolean")
    return out.withColumnRenamed("id", id_col)


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_ordinal(*training_sample(docs, table(spark, sf_dir, "labels")))
    return severity(docs, model)
