"""Toxicity by cumulative-link ordinal regression over sparse word features.

P(grade >= k) = logistic(w.x - theta_k): the thresholds theta_1 < theta_2 < ... share the weights w, and a document's
expected severity is its expected grade by these chances. The grades are the labels' own, however many there are; labels
of 0 and 1 have one threshold. Features are 1 + log(count) of words and of words' first five bytes, chosen on the
labelled sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import table, written

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


#: Words are also told by their first so many bytes, a feature of its own with a * behind.
_STEM = 5


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: runs of letters and digits, A-Z lower-cased."""
    return _WORD.findall(text.lower()) if text else []


def counts_of(text: bytes | None, words: dict[bytes, int]) -> dict[int, int]:
    """How often each feature of `words` is in a text, by number; features that aren't there are left out."""
    out: dict[int, int] = {}
    for w, n in Counter(words_of(text)).items():
        for i in (words.get(w), words.get(w[:_STEM] + b"*")):
            if i is not None:
                out[i] = out.get(i, 0) + n
    return out


@dataclass
class CumulativeLink:
    """Weights that all thresholds share, the rising thresholds, and the rising grades that they part."""

    words: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def chances(self, eta: np.ndarray) -> np.ndarray:
        """(rows, thresholds): the chance of at least each grade from the second."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.asarray(eta)[:, None], -60, 60)))

    def at_least(self, p: np.ndarray, grade: int) -> np.ndarray:
        """The chance of at least a grade, from the chances."""
        k = int(np.searchsorted(self.grades, grade))
        return np.ones(len(p)) if k == 0 else np.zeros(len(p)) if k == len(self.grades) else p[:, k - 1]

    def severity(self, p: np.ndarray) -> np.ndarray:
        """The expected grade, from the chances."""
        return self.grades[0] + p @ np.diff(self.grades).astype(float)

    def likely(self, p: np.ndarray) -> np.ndarray:
        """The highest grade that is at least as likely as not to be reached, from the chances."""
        return self.grades[(p >= 0.5).sum(axis=1)]

    def eta(self, text: bytes | None) -> float:
        return float(sum(self.weights[i] * (1 + np.log(n)) for i, n in sorted(counts_of(text, self.words).items())))


def _dense(rows: list[tuple[np.ndarray, np.ndarray]], d: int) -> np.ndarray:
    x = np.zeros((len(rows), d))
    for i, (at, value) in enumerate(rows):
        x[i, at] = value
    return x


def fit_cumulative_link(rows: list[tuple[np.ndarray, np.ndarray]], d: int, grades: np.ndarray, n_grades: int, l2: float = 1e-5, steps: int = 60, chunk: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Newton's method on the mean log-likelihood; grades are 0 .. n_grades - 1.

    rows are (numbers of features, values). The log-likelihood is concave; a step is halved until it is larger and the
    thresholds are in order. Rows are made dense `chunk` at a time. Without two grades in the rows the weights are 0 and
    the thresholds at a chance of nothing or of everything.
    """
    k, n = n_grades - 1, len(grades)
    if n == 0 or grades.min() == grades.max():
        return np.zeros(d), np.arange(k) + (30.0 if n == 0 or grades.min() == 0 else -30.0 - k)
    order = sorted(range(n), key=lambda i: len(rows[i][0]) == 0)  # rows without features come last and need no products
    rows, grades = [rows[i] for i in order], grades[order]
    full_rows = sum(len(at) > 0 for at, _ in rows)
    share = np.clip([(grades >= g).mean() for g in range(1, n_grades)], 1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-2 * np.arange(k))

    def look(w: np.ndarray, theta: np.ndarray, full: bool) -> tuple[float, np.ndarray, np.ndarray]:
        """The penalised mean log-likelihood, and in full its gradient and Hessian by (weights, thresholds)."""
        value, grad, hess = -l2 / 2 * float(w @ w), np.concatenate([-l2 * w, np.zeros(k)]), np.zeros((d + k, d + k))
        hess[range(d), range(d)] = -l2
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        for at in range(0, n, chunk):
            y = grades[at : at + chunk]
            x = _dense(rows[at : at + chunk], d if at < full_rows else 0)
            eta = x @ w if at < full_rows else np.zeros(len(y))
            above, below = np.clip(edges[y + 1] - eta, -500, 500), np.clip(edges[y] - eta, -500, 500)
            fa, fb = 1 / (1 + np.exp(-above)), 1 / (1 + np.exp(-below))
            # F(a) - F(b) without cancellation
            p = np.maximum(fa * (1 - fb) * -np.expm1(np.maximum(below - above, -700)), 1e-300)
            value += float(np.log(p).sum()) / n
            if not full:
                continue
            sa, sb = fa * (1 - fa), fb * (1 - fb)
            u, v = sa / p, sb / p
            aa, bb, ab = sa * (1 - 2 * fa) / p - u * u, -sb * (1 - 2 * fb) / p - v * v, u * v
            place_a, place_b = np.zeros((len(y), k)), np.zeros((len(y), k))
            some = y < k
            place_a[some, y[some]] = 1
            place_b[~(y == 0), y[y > 0] - 1] = 1
            grad[d:] += (place_a.T @ u - place_b.T @ v) / n
            both = place_a.T @ (ab[:, None] * place_b)
            if at < full_rows:
                grad[:d] += x.T @ (v - u) / n
                hess[:d, :d] += x.T @ ((aa + 2 * ab + bb)[:, None] * x) / n
                cross = -x.T @ (place_a * (aa + ab)[:, None] + place_b * (bb + ab)[:, None]) / n
                hess[:d, d:] += cross
                hess[d:, :d] += cross.T
            hess[d:, d:] += (place_a.T @ (aa[:, None] * place_a) + place_b.T @ (bb[:, None] * place_b) + both + both.T) / n
        return value, grad, hess

    w = np.zeros(d)
    for _ in range(steps):
        value, grad, hess = look(w, theta, True)
        step = np.linalg.solve(hess - 1e-9 * np.eye(d + k), -grad)
        size = 1.0
        while size > 1e-4:
            w_, theta_ = w + size * step[:d], theta + size * step[d:]
            if (np.diff(theta_) > 1e-6).all() and look(w_, theta_, False)[0] > value:
                break
            size /= 2
        else:
            break
        w, theta = w_, theta_
        if np.abs(step).max() * size < 1e-6:
            break
    return w, theta


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, grades = [], []
        for text, y in zip(b.column("text"), b.column("grade").to_pylist(), strict=True):
            own = set(words_of(text.as_py()))
            own |= {w[:_STEM] + b"*" for w in own}
            words += own
            grades += [y] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(grades, pa.int64())], ["word", "grade"])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = 8000,
    features: int = 1024,
    least_docs: int = 3,
    least_share: float = 0.001,
    least_z: float = 5.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    grade_col: str = "toxic",
) -> CumulativeLink:
    """A model of the grades in labels (id_col, grade_col: whole numbers, any and any number of them) on at most sample_rows documents.

    The sample is the labelled ids with the smallest hashes; each is one document, the one with the smallest text where
    rows repeat an id. Words are features if at least least_docs and the share least_share of sampled documents hold
    them and the mean grade of those differs from the sample's by least_z standard errors (for two grades: the usual
    comparison of two rates); the `features` strongest stay. Null labels and ids are left out; of labels that disagree
    on an id the larger counts; labelled ids without a document too. A grade that no sampled document has doesn't
    exist for the model; with one grade alone every document has it, without any every document has grade 0. Null and
    empty texts have no words; long texts count whole.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull()).groupBy(id_col).agg(F.max(grade_col).cast("long").alias("grade"))
    sample = known.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    # The sample has sample_rows rows at most.
    found = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(sample), id_col).groupBy(id_col, "grade").agg(F.min("text").alias("text"))
    rows = written(found.select("grade", F.col("text").cast("binary").alias("text")), "sample")
    n, mean, spread, *_ = rows.agg(F.count("*"), F.avg("grade"), F.stddev_pop("grade")).first()
    levels = np.array(sorted(r["grade"] for r in rows.select("grade").distinct().collect()) or [0], dtype=np.int64)
    chosen = []
    if spread:
        counts = rows.select("text", "grade").mapInArrow(_distinct, "word binary, grade long").groupBy("word").agg(F.sum("grade").alias("t"), F.count("*").alias("c"))
        z = (F.col("t") / F.col("c") - mean) / (spread * F.sqrt(F.greatest(1 / F.col("c") - 1 / n, F.lit(1e-12))))
        chosen = counts.where(F.col("c") >= max(least_docs, least_share * n)).withColumn("z", z).where(F.abs("z") >= least_z).orderBy(F.desc(F.abs("z")), "word").limit(features).collect()
    words = {bytes(r["word"]): i for i, r in enumerate(chosen)}

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counted = [counts_of(text.as_py(), words) for text in b.column("text")]
            idx, cnt = [sorted(c) for c in counted], [[c[i] for i in sorted(c)] for c in counted]
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array(idx, pa.list_(pa.int32())), pa.array(cnt, pa.list_(pa.int32()))], ["grade", "at", "n"])

    got = rows.select("text", "grade").mapInArrow(featurise, "grade long, at array<int>, n array<int>").collect()
    got.sort(key=lambda r: (r["grade"], r["at"], r["n"]))
    x = [(np.array(r["at"], dtype=np.int64), 1 + np.log(r["n"])) for r in got]
    grades = np.searchsorted(levels, np.array([r["grade"] for r in got], dtype=np.int64))
    weights, thresholds = fit_cumulative_link(x, len(words), grades, len(levels))
    return CumulativeLink(words, weights, thresholds, levels)


def score(docs: DataFrame, model: CumulativeLink, id_col: str = "doc_id", text_col: str = "text", toxic_grade: int = 1, reject: float = 0.5) -> DataFrame:
    """A row for each row of docs: doc_id, grade, severity, toxic.

    severity is the expected grade, grade the highest one at least as likely as not to be reached, toxic that toxic_grade
    or more has a chance of `reject` or more. A null or empty text has no features and the severity of such; texts of any
    length are read whole. Repeated rows and null ids are scored like any other row. Further columns are not read. An
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.chances(np.array([model.eta(t.as_py()) for t in b.column("text")], dtype=float))
            columns = [b.column("doc_id"), pa.array(model.likely(p), pa.int32()), pa.array(model.severity(p)), pa.array(model.at_least(p, toxic_grade) >= reject)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "grade", "severity", "toxic"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, grade int, severity double, toxic boolean")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every whole document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).withColumn("severity", F.round("severity", 6))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model doesn't call toxic.

    Rows with null or empty texts have no features, so they stay unless most documents are toxic; repeated rows stay or
    go together; texts of any length are read whole. Labels of documents that are no longer in docs are not used.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text").cast(pa.binary())
            p = model.chances(np.array([model.eta(t.as_py()) for t in text], dtype=float))
            yield b.filter(pa.array(model.at_least(p, 1) < 0.5))

    return docs.mapInArrow(run, docs.schema)


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE: dict[str, str] = {}
