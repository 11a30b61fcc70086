"""Quality grades by ordinal cumulative-link regression on hashed text.

P(grade > j) = sigmoid(w.x - t_j) with one weight vector for all grades and ascending thresholds
t_0 < t_1 < ..., so the grades' order is part of the model.  It gives the expected grade and the
probability of a grade of at least some level, by which documents are selected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._terms import Adam, collect_terms, held_out, labelled_sample, scored, sigmoid, style_terms

BITS = 18


@dataclass
class CumulativeLink:
    w: np.ndarray
    thresholds: np.ndarray
    level: int

    def __call__(self, doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, n: int) -> list[np.ndarray]:
        s = np.bincount(doc, self.w[bucket] * value, n)
        above = sigmoid(s[:, None] - self.thresholds[None, :])
        tail = above[:, self.level - 1] if 0 < self.level <= len(self.thresholds) else np.ones(n)
        return [above.sum(1), tail]


def fit(sample: dict[str, np.ndarray], level: int, grades: int = 3, epochs: int = 200, rate: float = 0.05, decay: float = 1e-4) -> CumulativeLink:
    """Grades are 0 .. ``grades`` - 1; others are clipped to that range."""
    y = np.clip(sample["label"], 0, grades - 1)
    n = len(y)
    row, bucket, value = sample["row"], sample["bucket"], sample["value"]
    used, at = np.unique(bucket, return_inverse=True)
    counts = np.array([np.sum(y > j) for j in range(grades - 1)], float)
    share = (counts + 0.5) / (n + 1)
    start = -np.log(share / (1 - share))
    # thresholds are a first one and the logarithms of the steps to the next
    first, steps = np.array([start[0]]), np.log(np.maximum(np.diff(start), 1e-2))
    w = np.zeros(len(used))
    adam = Adam([w, first, steps], rate)
    for _ in range(epochs if n else 0):
        t = first[0] + np.concatenate(([0.0], np.cumsum(np.exp(steps))))
        s = np.bincount(row, w[at] * value, n)
        cdf = np.concatenate((np.zeros((n, 1)), 1 - sigmoid(s[:, None] - t), np.ones((n, 1))), 1)  # P(grade < j)
        mass = np.maximum(cdf[np.arange(n), y + 1] - cdf[np.arange(n), y], 1e-9)
        slope = cdf * (1 - cdf)  # of each cdf by its threshold
        up, low = slope[np.arange(n), y + 1] / mass, slope[np.arange(n), y] / mass
        gs = (up - low) / n  # of -log mass by s
        gt = np.zeros(grades + 1)
        np.add.at(gt, y + 1, -up / n)
        np.add.at(gt, y, low / n)
        gt = gt[1:-1]
        tails = np.cumsum(gt[::-1])[::-1]
        adam.step([np.bincount(at, gs[row] * value, len(used)) + decay * w, np.array([gt.sum()]), tails[1:] * np.exp(steps)])
    full = np.zeros(1 << BITS)
    full[used] = w
    return CumulativeLink(full, first[0] + np.concatenate(([0.0], np.cumsum(np.exp(steps)))), level)


def train(docs: DataFrame, labels: DataFrame, grade, grades: int = 3, level: int = 1, most_rows: int = 6_000) -> CumulativeLink:
    """A model of ``grade``, a column of whole numbers on ``labels``, from ``most_rows`` rows at most
    (give or take a few hundredths).  Rows with crc32(doc_id as text) mod 3 = 1 are held out."""
    return fit(collect_terms(labelled_sample(docs, labels, grade, most_rows), style_terms, BITS), level, grades)


def grade_quality(docs: DataFrame, model: CumulativeLink, least_tail: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_prob, kept of every row of ``docs`` (doc_id, text).

    tail_prob is the probability of the model's level or more; kept is tail_prob >= ``least_tail``.
    Null and empty texts are graded as texts without words.  Rows are graded one by one, so repeats
    and null ids stay; an empty table gives an empty result; other columns are ignored.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(keyed, style_terms, BITS, model, ["expected_grade", "tail_prob"], ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "expected_grade", "tail_prob", (F.col("tail_prob") >= least_tail).alias("kept"))
