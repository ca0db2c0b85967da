"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's features are hashed words, hashed word shapes and a few bucketed statistics of the whole text,
each present or not, so the weights are one table of 2**16 numbers. All grades share the weights; ordered
thresholds cut the score: P(grade > j) = logistic(score - threshold_j). The model is fitted on a bounded
sample of rated texts; scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import textcodes as tc
from .bpe import slices
from .shared import fresh

BITS = 16
#: Classes of bytes in a word's shape: lower, upper, digit, other sign, part of a longer character.
SHAPE = np.full(256, 3, np.uint8)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = 0, 1, 2, 0


def features(text: np.ndarray) -> np.ndarray:
    """Distinct feature numbers (below 2**BITS) of a text's bytes, and the feature 0 that all texts have."""
    low = tc.LOWER[text]
    starts, ends = tc.word_spans(low)
    if not len(starts):
        return np.array([0], np.int64)
    words = tc.span_hashes(low, starts, ends)
    kinds = SHAPE[text]
    keep = np.r_[True, kinds[1:] != kinds[:-1]]
    keep[starts] = True
    keep |= tc.SPACE[text]
    runs, at = kinds[keep], np.cumsum(keep)  # each run of one class as one sign
    shapes = tc.span_hashes(runs, at[starts] - 1, np.r_[at[ends - 1]])
    letters = np.flatnonzero(SHAPE[low] == 0)
    inner = tc.span_hashes(low, starts, ends) if not len(letters) else bare_words(low, starts, ends)
    several = tc.distinct(words)
    n = len(words)
    stats = (
        min(12, int(12 * len(several) / n)),
        min(12, int(12 * float((kinds == 1).sum()) / max(1, int((kinds < 2).sum())))),
        min(12, int(24 * float(((kinds == 3) & ~tc.SPACE[text]).sum()) / len(text))),
        min(12, int(12 * len(tc.distinct(words[:-1][words[1:] == words[:-1]])) / len(several) + 8 * float((words[1:] == words[:-1]).mean() if n > 1 else 0))),
        min(12, int(np.log2(n + 1))),
    )
    extra = tc.mix(np.array([i * 64 + s for i, s in enumerate(stats)], np.uint64) + tc.U(1 << 40))
    every = np.concatenate([words, shapes + tc.U(1), inner + tc.U(2), extra])
    return tc.distinct(np.r_[0, (tc.mix(every) >> tc.U(64 - BITS)).astype(np.int64)])


def bare_words(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs of letters within words."""
    letter = SHAPE[low] == 0
    edge = np.diff(np.r_[False, letter, False].view(np.int8))
    return tc.span_hashes(low, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for each score and threshold j."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -40, 40)))


@dataclass
class Sample:
    """Rated texts: each one's grade, number of features, and those of its features that the fit sees, one after another."""

    grade: np.ndarray
    features: np.ndarray
    seen: np.ndarray
    at: np.ndarray

    def loss(self, weights: np.ndarray, thresholds: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean log likelihood and its gradients by the weights and the thresholds, block by block of texts."""
        total, by_weight, by_cut, edge = 0.0, np.zeros(len(weights)), np.zeros(len(thresholds)), np.r_[0, np.cumsum(self.seen)]
        for i in range(0, len(self.grade), 512):
            grade, seen, at = self.grade[i : i + 512], self.seen[i : i + 512], self.at[edge[i] : edge[min(i + 512, len(self.grade))]].astype(np.int64)
            rows, doc = len(grade), np.repeat(np.arange(len(grade)), seen)
            value = (np.sqrt(self.features[i : i + 512]) / seen)[doc]  # sums over features, by the root of their number
            score = np.bincount(doc, weights[at] * value, rows)
            above = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds, -40, 40)))  # P(grade > j)
            full, every = np.c_[np.ones(rows), above, np.zeros(rows)], np.arange(rows)
            p = np.maximum(full[every, grade] - full[every, grade + 1], 1e-9)
            slope = np.c_[np.zeros(rows), above * (1 - above), np.zeros(rows)]
            lower, upper = slope[every, grade] / p, slope[every, grade + 1] / p
            cuts = np.zeros((rows, len(thresholds) + 2))
            cuts[every, grade] -= lower
            cuts[every, grade + 1] += upper
            total += float(np.log(p).sum())
            by_weight += np.bincount(at, (lower - upper)[doc] * value, len(weights))
            by_cut += cuts[:, 1:-1].sum(axis=0)
        n = max(1, len(self.grade))
        return total / n, by_weight / n, by_cut / n


def fit(rows: Sample, grades: int, *, rounds: int = 200, rate: float = 0.05, decay: float = 2e-4) -> Model:
    """Maximum likelihood with a small penalty, by Adam over the whole sample."""
    share = np.array([(rows.grade > j).mean() for j in range(grades - 1)])
    cuts = -np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1 - 1e-3))
    size = 1 << BITS
    theta = np.r_[np.zeros(size), cuts[0], np.log(np.maximum(np.diff(cuts), 0.05))]  # the first threshold, logs of the steps
    cuts_of = lambda t: np.cumsum(np.r_[t[size], np.exp(t[size + 1 :])])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        _, by_weight, by_cut = rows.loss(theta[:size], cuts_of(theta))
        by_step = np.cumsum(by_cut[::-1])[::-1] * np.r_[1.0, np.exp(theta[size + 1 :])]
        gradient = np.r_[by_weight - decay * theta[:size], by_step]
        first += 0.1 * (gradient - first)
        second += 0.01 * (gradient * gradient - second)
        theta += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(theta[:size], cuts_of(theta))


def rated_sample(docs: DataFrame, ratings: DataFrame, most: int, share: int = 4096) -> Sample:
    """Features and grades of ``most`` rated ids at most, those with the smallest hash of their doc_id.

    An id with several grades counts with the lowest one, an id with several texts with one of them. The fit
    sees ``share`` features of a text at most, evenly drawn, so the sample's size is bounded however long texts are.
    """
    wanted = ratings.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                offsets, b = tc.texts(part.column(1))
                own = [features(b[i:j]) for i, j in zip(offsets[:-1], offsets[1:])]
                some = [x[np.linspace(0, len(x) - 1, min(len(x), share)).astype(np.int64)].astype("<u4").tobytes() for x in own]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([len(x) for x in own], pa.int32()), pa.array(some, pa.binary())], ["doc_id", "grade", "n", "f"]
                )

    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "grade")
    rows = rows.mapInArrow(run, "doc_id long, grade int, n int, f binary").groupBy("doc_id").agg(F.min(F.struct("n", "f", "grade")).alias("r"))
    found = rows.select("doc_id", "r.n", "r.f", "r.grade").toArrow().sort_by("doc_id").combine_chunks()
    parts = [np.frombuffer(x.as_py(), "<u4") for x in found["f"]]
    return Sample(
        found["grade"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(float),
        np.array([len(x) for x in parts], np.int64), np.concatenate([*parts, np.zeros(0, np.uint32)]),
    )


def grade_texts(
    docs: DataFrame, ratings: DataFrame, *, grades: int = 3, most: int = 6000, at_least: int = 2, tail: float = 0.35
) -> DataFrame:
    """Rates every whole text: expected grade, P(grade >= at_least) and whether that is ``tail`` or more.

    docs: doc_id, text; all columns come back with expected_grade, tail_probability and selected added
    (with an underscore where a name clashes). ratings: doc_id, grade from 0 to grades - 1; others count
    as no rating, and of several for one id the lowest counts. The fit uses ``most`` rated texts at the most.

    Null and empty texts and white space alone have no words and get the rating of a text without
    features. Without two different ratings in the sample nothing can be fitted: probabilities are null
    and every text is selected. Rows may repeat. An empty table gives no rows.
    """
    names = [fresh(docs, c) for c in ("expected_grade", "tail_probability", "selected")]
    rows = rated_sample(docs.select("doc_id", "text"), ratings.where(F.col("grade").between(0, grades - 1)).select("doc_id", "grade"), most)
    if len(np.unique(rows.grade)) < 2:
        return docs.withColumns({names[0]: F.lit(None).cast("double"), names[1]: F.lit(None).cast("double"), names[2]: F.lit(True)})
    model = fit(rows, grades)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    text_at = docs.columns.index("text")

    def run(batches):
        weights, thresholds = shared.value
        for batch in batches:
            for part in slices(batch, text_at):
                offsets, b = tc.texts(part.column(text_at))
                scores = np.zeros(part.num_rows)
                for i in range(part.num_rows):
                    f = features(b[offsets[i] : offsets[i + 1]])
                    scores[i] = weights[f].sum(dtype=float) / np.sqrt(len(f))
                tails = Model(weights, thresholds).tails(scores)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, at_least - 1]), pa.array(tails[:, at_least - 1] >= tail)], [*part.schema.names, *names]
                )

    kinds = (T.DoubleType(), T.DoubleType(), T.BooleanType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *map(T.StructField, names, kinds)]))


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """Grades from the table of labels: 0 poor, 1 fluent but toxic, 2 fluent and clean."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    return labels.select("doc_id", grade.alias("grade"))
