"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j).  The pairwise part is computed as
half of (sum v x)^2 - sum (v x)^2 by factor, so it costs as much as the linear part.  It learns
that a term matters in company which alone does not, if one of the two shows a difference alone;
two terms that both show none alone get no weights (see ``fit``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._terms import Adam, collect_terms, labelled_sample, scored, sigmoid, word_terms

BITS = 20


@dataclass
class FactorizationMachine:
    """Weights of the buckets that were chosen; ``slot`` maps a bucket to its place or -1."""

    slot: np.ndarray
    bias: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def logits(self, row: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and the sum of each row's factors."""
        sums = np.stack([np.bincount(row, self.v[at, f], n) for f in range(self.v.shape[1])], 1)
        squares = np.bincount(row, (self.v**2).sum(1)[at], n)
        return self.bias[0] + np.bincount(row, self.w[at], n) + 0.5 * ((sums**2).sum(1) - squares), sums

    def __call__(self, doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, n: int) -> list[np.ndarray]:
        at = self.slot[bucket]
        keep = at >= 0
        # buckets are sets: two terms of one bucket count once
        pair = np.unique(doc[keep] * len(self.w) + at[keep]) if len(self.w) else np.empty(0, np.int64)
        row, at = np.divmod(pair, max(len(self.w), 1))
        return [sigmoid(self.logits(row, at, n)[0])]


def _partners(row: np.ndarray, bucket: np.ndarray, y: np.ndarray, total: np.ndarray, anchors: np.ndarray, least_rows: int, least_z: float) -> np.ndarray:
    """Buckets with which the label rate of some anchor's rows differs by ``least_z`` standard errors."""
    frequent = np.flatnonzero(total >= least_rows)
    if not len(frequent):
        return frequent
    local = np.full(1 << BITS, -1, np.int32)
    local[frequent] = np.arange(len(frequent))
    ok = local[bucket] >= 0
    row, col = row[ok].astype(np.int32), local[bucket[ok]]
    first = np.searchsorted(row, np.arange(len(y) + 1))
    rows_by_col = row[np.argsort(col, kind="stable")]
    at = np.concatenate(([0], np.cumsum(np.bincount(col, minlength=len(frequent)))))
    found = np.zeros(len(frequent), bool)
    for a in local[anchors]:
        mine = rows_by_col[at[a] : at[a + 1]]
        p = (y[mine].sum() + 0.5) / (len(mine) + 1)
        n, toxic = np.zeros(len(frequent)), np.zeros(len(frequent))
        for i in range(0, len(mine), 500):  # memory follows 500 rows
            part = mine[i : i + 500]
            k = first[part + 1] - first[part]
            terms = col[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[part], k)]
            n += np.bincount(terms, minlength=len(frequent))
            toxic += np.bincount(terms, np.repeat(y[part], k), len(frequent))
        found |= (n >= least_rows) & (np.abs(toxic - n * p) >= least_z * np.sqrt(n * p * (1 - p) + 1e-9))
    return frequent[found]


def fit(sample: dict[str, np.ndarray], factors: int = 8, epochs: int = 120, rate: float = 0.03, decay: float = 5e-5, least_rows: int = 4, least_z: float = 3.0, pair_z: float = 8.0, seed: int = 7) -> FactorizationMachine:
    """Fits on presence terms.  Buckets are chosen that differ between the labels by ``least_z``
    standard errors and occur in ``least_rows`` rows, and those that change the label rate of
    such a bucket's rows by ``pair_z`` and meet it in ``least_rows``; the others have no weight.

    ``pair_z`` is large as many pairs are tested.  ``decay`` must leave a rare pair's factors room to
    grow: at 2e-3 they shrink as fast as 12 of 6,000 rows pull.  Both were chosen by three folds of the
    training rows, among those that still learn a partner which shows nothing alone."""
    y = (sample["label"] > 0).astype(float)
    n = len(y)
    pair = np.unique(sample["row"].astype(np.int64) << BITS | sample["bucket"])
    row, bucket = pair >> BITS, pair & (1 << BITS) - 1
    del pair
    slot = np.full(1 << BITS, -1, np.int32)
    prior = (y.sum() + 0.5) / (n + 1)
    if 0 < y.sum() < n:
        total = np.bincount(bucket, minlength=1 << BITS)
        toxic = np.bincount(bucket, y[row], 1 << BITS)
        z = (toxic - total * prior) / np.sqrt(np.maximum(total, 1) * prior * (1 - prior) + 1e-9)
        chosen = np.flatnonzero((total >= least_rows) & (np.abs(z) >= least_z))
        chosen = np.union1d(chosen, _partners(row, bucket, y, total, chosen, least_rows, pair_z))
        slot[chosen] = np.arange(len(chosen))
    at = slot[bucket]
    row, at = row[at >= 0], at[at >= 0]
    m = int(slot.max()) + 1
    rng = np.random.default_rng(seed)
    model = FactorizationMachine(slot, np.array([np.log(prior / (1 - prior))]), np.zeros(m), rng.normal(0, 0.01, (m, factors)))
    if not m:
        return model
    adam = Adam([model.bias, model.w, model.v], rate)
    for _ in range(epochs):
        logits, sums = model.logits(row, at, n)
        error = (sigmoid(logits) - y) / n
        gw = np.bincount(at, error[row], m)
        gv = np.stack([np.bincount(at, error[row] * sums[row, f], m) for f in range(factors)], 1) - gw[:, None] * model.v
        adam.step([np.array([error.sum()]), gw + decay * model.w / 10, gv + decay * model.v])
    return model


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 6_000) -> FactorizationMachine:
    """A model from ``labels`` (doc_id, toxic), fitted on a sample of ``most_rows`` labelled rows.

    Rows with crc32(doc_id as text) mod 3 = 1 are held out.  Without labels of both kinds the
    score is the share of toxic labels, smoothed.
    """
    return fit(collect_terms(labelled_sample(docs, labels, F.col("toxic"), most_rows), word_terms, BITS))


def score_toxicity(docs: DataFrame, model: FactorizationMachine, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The ``keep`` columns (doc_id) of ``docs`` and a score called ``name``, 0 to 1.

    The text alone decides.  Null and empty texts have no terms, so their score is the bias's.
    Rows are scored one by one: repeats, ties and null ids stay; an empty table gives an empty
    result.  A kept column called ``name`` is an error.
    """
    return scored(docs, word_terms, BITS, model, [name], keep or ["doc_id"])
