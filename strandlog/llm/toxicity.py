"""Toxicity by cumulative-link ordinal regression (operator 1).

P(severity <= k | x) = sigmoid(theta_k - w.x): one sparse weight vector shared by all ordered
thresholds.  Features are hashed: the lower-cased letter runs of a text and their first five and
seven letters, each counted once per text.  The expected severity is the sum over k >= 1 of
P(severity >= k).

Grades.  Labels say toxic or not.  Grade 0 is "not toxic".  A toxic text is graded 1 to 3 by how many
different *marker* features it holds (features at least ``lift`` times as frequent in toxic
labelled texts as in others): up to 2, up to 5, more.

Fit: proximal gradient with an L1 penalty on the driver over at most ``max_labels`` labelled rows,
chosen by a hash of the id (documented bound); every document is scored over its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.llm.bpe import Known
from strandlog.llm.common import parts

BUCKETS = 1 << 20
LETTERS = re.compile(r"[^\W\d_]+").findall
GRADES = 4


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its first five and seven letters."""
    own = [f"w {word}", *(f"p {word[:n]}" for n in (5, 7) if len(word) > n)]
    return tuple(crc32(x.encode()) % BUCKETS for x in own)


@dataclass
class OrdinalModel:
    """theta: thresholds in order; weights: feature -> weight, those that are not zero."""

    theta: list[float]
    weights: dict[int, float]

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(severity >= k) for k = 1, 2, 3."""
        return 1 / (1 + np.exp(np.clip(np.asarray(self.theta)[None, :] - score[:, None], -50, 50)))


def grade(features: list[np.ndarray], toxic: np.ndarray, lift: float = 20.0, least: int = 5) -> np.ndarray:
    """Severity grades 0..3 of labelled rows from their features and 0/1 labels."""
    flat = np.concatenate(features) if features else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(features)), [len(f) for f in features])
    pos = np.bincount(flat[toxic[owner] == 1], minlength=BUCKETS)
    neg = np.bincount(flat[toxic[owner] == 0], minlength=BUCKETS)
    share = ((pos + 0.5) / max(1, toxic.sum())) / ((neg + 0.5) / max(1, (1 - toxic).sum()))
    marker = (pos >= least) & (share >= lift)
    held = np.bincount(owner, weights=marker[flat], minlength=len(features))
    return np.where(toxic == 1, np.where(held <= 2, 1, np.where(held <= 5, 2, 3)), 0)


def fit(features: list[np.ndarray], grades: np.ndarray, l1: float = 2e-4, steps: int = 500, least: int = 3) -> OrdinalModel:
    """Cumulative-link model with a logit link by accelerated proximal gradient."""
    n = len(features)
    if n == 0 or not (grades > 0).any():
        return OrdinalModel([30.0, 31.0, 32.0], {})
    flat = np.concatenate(features)
    common = np.flatnonzero(np.bincount(flat, minlength=BUCKETS) >= least)
    to = np.full(BUCKETS, -1)
    to[common] = np.arange(len(common))
    owner, col = np.repeat(np.arange(n), [len(f) for f in features]), to[flat]
    owner, col = owner[col >= 0], col[col >= 0]
    k = np.arange(1, GRADES)
    above = (grades[:, None] >= k).astype(float)  # n x 3
    share = np.clip(above.mean(0), 1e-4, 1 - 1e-4)
    theta, w = np.log(1 / share - 1), np.zeros(len(common))
    rows = np.arange(n)

    def scores(weights):
        return np.bincount(owner, weights=weights[col], minlength=n)

    # The curvature in a score is at most a half; the largest eigenvalue of [X 1]'[X 1] / n by power iteration.
    probe, top = np.ones(len(common) + 1), 1.0
    for _ in range(30):
        image = scores(probe[:-1]) + probe[-1]
        probe = np.concatenate([np.bincount(col, weights=image[owner], minlength=len(common)), [image.sum()]]) / n
        top = float(np.linalg.norm(probe)) or 1.0
        probe /= top
    step = 1.5 / top
    v, last, t = w.copy(), w.copy(), 1.0
    v_theta, last_theta = theta.copy(), theta.copy()
    # The likelihood is that of the grade: P(y) = s_y - s_{y+1} with s_k = P(severity >= k).
    for _ in range(steps):
        score = scores(v)
        s = 1 / (1 + np.exp(np.clip(v_theta[None, :] - score[:, None], -50, 50)))
        full = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], axis=1)
        p = np.maximum(full[rows, grades] - full[rows, grades + 1], 1e-9)
        slope = np.concatenate([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))], axis=1)
        by_score = -(slope[rows, grades] - slope[rows, grades + 1]) / p
        by_theta = np.zeros((n, GRADES + 1))
        by_theta[rows, grades] += slope[rows, grades] / p
        by_theta[rows, grades + 1] -= slope[rows, grades + 1] / p
        new = v - step * np.bincount(col, weights=by_score[owner], minlength=len(common)) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_theta = np.maximum.accumulate(v_theta - step * by_theta[:, 1:GRADES].mean(0) + np.arange(GRADES - 1) * 1e-9)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, last, t, ahead = new + (t - 1) / t2 * (new - last), new, t2, (t - 1) / t2
        v_theta, last_theta = np.maximum.accumulate(new_theta + ahead * (new_theta - last_theta)), new_theta
    theta = last_theta
    some = np.flatnonzero(np.abs(last) > 1e-6)
    return OrdinalModel([float(x) for x in theta], {int(common[i]): float(last[i]) for i in some})


def text_features(text: str | None, known: Known) -> np.ndarray:
    out: set[int] = set()
    for w in set(LETTERS((text or "").lower())):
        out.update(known[w])
    return np.fromiter(sorted(out), dtype=np.int64, count=len(out))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labels: int = 6000) -> OrdinalModel:
    """Fits on at most ``max_labels`` labelled documents; rows without a label or text are not used.

    Several labels of a document count as the largest; of several documents of an id one counts (that
    whose text has the least hash).
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    chosen = own.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(word_features)
        for batch in parts(batches):
            rows = [text_features(t, known).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64())), batch.column(1)], ["features", "y"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    one = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.select("text", "y").mapInArrow(run, "features array<long>, y int").collect()
    features = [np.array(r[0], dtype=np.int64) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1], features[i].tobytes()))  # the same whatever order tasks end in
    features, y = [features[i] for i in order], np.array([rows[i][1] for i in order], dtype=np.int64)
    return fit(features, grade(features, y))


def score(df: DataFrame, model: OrdinalModel, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """Adds expected_severity (0 to 3), grade (the largest k with P(severity >= k) >= cut) and toxic.

    Null and empty texts have no features and so the grade that the thresholds alone give (0 unless
    most labels are toxic).  Columns already named like the outputs are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    added = ["expected_severity", "grade", "toxic"]
    keep = [f for f in df.schema.fields if f.name not in added and f.name != text_col]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = model.weights
        known = Known(lambda w: tuple(f for f in word_features(w) if f in weights))
        for batch in parts(batches):
            scores = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(batch.schema.get_field_index(text_col)).to_pylist()):
                held: set[int] = set()
                for w in set(LETTERS(text.lower())) if text else ():
                    if f := known[w]:
                        held.update(f)
                scores[i] = sum(weights[f] for f in sorted(held))
            s = model.at_least(scores)
            grades = (s >= cut).sum(1).astype(np.int32)
            cols = [pa.array(s.sum(1)), pa.array(grades), pa.array(grades > 0)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + cols, names + added)

    f = T.StructField
    schema = T.StructType(keep + [f("expected_severity", T.DoubleType()), f("grade", T.IntegerType()), f("toxic", T.BooleanType())])
    return df.select(*dict.fromkeys(names + [text_col])).mapInArrow(run, schema)
