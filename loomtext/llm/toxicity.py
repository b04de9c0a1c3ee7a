"""Toxicity: cumulative-link ordinal regression of severity grades on sparse words.

P(grade >= k) = sigmoid(w.x - b_k), with one weight vector w for all thresholds b_1 <= b_2 <= b_3. The
expected severity is the sum of the three probabilities, from 0 to 3.

The labels say toxic or not. Grades within the toxic rows are cross-fitted: each half of the sample finds the words whose rate
differs most between its toxic and its clean rows, and the toxic rows of the other half are graded 1 to 3 by thirds of how many of
those words they have. So no row is graded by words that it helped to find, and thresholds 2 and 3 are learned from how much evidence
rows hold that others have shown. Grade 0 is exactly label 0, so P(grade >= 1) is P(toxic).

Features: 1 + log(count) of each word (a run of letters, digits and non-ASCII characters, lower-cased) and of
its first 4, 5 and 6 bytes, in 2**20 buckets; weights are kept sparse by an L1 penalty and not negative, so a long clean text doesn't gather a score from many small
weights. Edge cases: a null or empty text scores as no words; an unlabelled or one-sided sample gives a
constant; repeats score alike; an empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomtext.llm import learning
from loomtext.llm.common import by_bytes, map_rows, of_row

#: At most so many labelled rows are fitted on, whatever the size of the input.
SAMPLE = 12_000
GRADES = 3
#: Beginnings of words, in bytes, that are features beside the words: inflected forms share them.
PREFIXES = (4, 5, 6)


@dataclass
class OrdinalModel:
    keep: np.ndarray
    w: np.ndarray
    cuts: np.ndarray
    threshold: float = 0.5

    def probabilities(self, texts) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES, one row per text."""
        doc, bucket, count, *_ = learning.word_counts(texts, "alnum", self.keep, PREFIXES)
        z = np.bincount(doc, (1 + np.log(count)) * self.w[bucket], minlength=len(texts)) if len(doc) else np.zeros(len(texts))
        return learning.sigmoid(z[:, None] - self.cuts[None, :])


def _contrast(present: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each feature the z-value of the difference between the shares of toxic and of clean rows that have it."""
    rows = [max(1, int((toxic == k).sum())) for k in (0, 1)]
    p, q = (present[1] + 0.5) / (rows[1] + 1), (present[0] + 0.5) / (rows[0] + 1)
    both = (present[0] + present[1] + 1) / (sum(rows) + 2)
    return (p - q) / np.sqrt(both * (1 - both) * (1 / rows[0] + 1 / rows[1]))


def _grades(evidence, toxic, half) -> np.ndarray:
    """0 for clean rows; toxic rows by thirds of the evidence among the toxic rows of their half."""
    grade = np.zeros(len(toxic), dtype=int)
    for k in (0, 1):
        on = (toxic == 1) & (half == k)
        if on.any():
            grade[on] = 1 + np.searchsorted(np.quantile(evidence[on], np.arange(1, GRADES) / GRADES), evidence[on], "left")
    return grade


def fit(rows: list[tuple[str | None, int]], least: int = 8, steps: int = 300, l1: float = 1e-5, screen: float = 7.0) -> OrdinalModel:
    """Proximal Adam on the ordinal likelihood, written as GRADES logistic losses that share w.

    Only features that toxic rows have more often, by `screen` standard errors at least, are kept: words that
    merely go with a language or a source would reject clean rows.
    """
    texts, toxic = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=int)
    share = float(np.clip(toxic.mean(), 1e-4, 1 - 1e-4)) if len(toxic) else 1e-4
    cut = np.array([-np.log(share / k / (1 - share / k)) for k in range(1, GRADES + 1)])
    nothing = OrdinalModel(np.full(1 << learning.BITS, -1, dtype=np.int32), np.zeros(1), cut)
    if not len(toxic) or toxic.min() == toxic.max():
        return nothing
    blocks, half = range(0, len(rows), 256), np.arange(len(rows)) % 2
    halves = np.zeros((2, 2, 1 << learning.BITS))
    for i in blocks:
        doc, bucket, *_ = learning.word_counts(texts[i : i + 256], "alnum", prefixes=PREFIXES)
        for h in (0, 1):
            for k in (0, 1):
                halves[h, k] += np.bincount(bucket[(toxic[i + doc] == k) & (half[i + doc] == h)], minlength=halves.shape[2])
    present = halves.sum(axis=0)
    use = (_contrast(present, toxic) >= screen) & (present.sum(axis=0) >= least)
    if not use.any():
        return nothing
    keep = np.where(use, np.cumsum(use) - 1, -1).astype(np.int32)
    parts = [(i, *learning.word_counts(texts[i : i + 256], "alnum", keep, PREFIXES)[:3]) for i in blocks]
    doc, word = np.concatenate([i + p for i, p, _, _ in parts]), np.concatenate([p for _, _, p, _ in parts])
    x, n = 1 + np.log(np.concatenate([p for _, _, _, p in parts])), int(use.sum())
    telling = np.stack([_contrast(halves[h], toxic[half == h]) >= screen / np.sqrt(2) for h in (0, 1)])[:, use]
    grade = _grades(np.bincount(doc, x * telling[1 - half[doc], word], minlength=len(toxic)), toxic, half)
    over = (grade[:, None] >= np.arange(1, GRADES + 1)[None, :]).astype(float)
    theta, m1, m2 = np.concatenate([np.zeros(n), cut]), np.zeros(n + GRADES), np.zeros(n + GRADES)
    for t in range(1, steps + 1):
        w, cut = theta[:n], theta[n:]
        z = np.bincount(doc, x * w[word], minlength=len(toxic))
        e = learning.sigmoid(z[:, None] - cut[None, :]) - over
        g = np.concatenate([np.bincount(word, x * e.sum(axis=1)[doc], minlength=n), -e.sum(axis=0)]) / len(toxic)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        rate = 0.1 * (1 - t / (steps + 1)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-7)
        theta = theta - rate * m1 / (1 - 0.9**t)
        theta[:n] = np.maximum(0, theta[:n] - rate[:n] * l1)
        theta[n:] = np.maximum.accumulate(theta[n:])
    w, cut = theta[:n], theta[n:]
    p = learning.sigmoid(np.bincount(doc, x * w[word], minlength=len(toxic)) - cut[0])
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(toxic[order])
    best = int(np.argmax(2 * hit / (np.arange(1, len(p) + 1) + toxic.sum())))
    limit = float(0.75 * p[order[best]] + 0.25 * p[order[min(best + 1, len(p) - 1)]])  # nearer to the toxic side
    return OrdinalModel(keep, np.append(w, 0.0), cut, limit)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most `sample` labelled rows outside the held-out fold, of at most learning.SAMPLE_BYTES; the same rows give the same model."""
    return fit([(r[1], r[3]) for r in learning.labelled_sample(docs, labels, "toxic", sample, least=learning.LEAST)])


def score(docs: DataFrame, model: OrdinalModel, threshold: float | None = None) -> DataFrame:
    """doc_id, held_out, severity (expected grade), p_toxic, toxic (1 if p_toxic reaches the threshold,
    by default the one with the best F1 on the fitted rows)."""
    limit = model.threshold if threshold is None else threshold
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the sample's bound, not on docs

    def run(batches):
        for b in by_bytes(batches, "text"):
            p = shared.value.probabilities(b.column("text").to_pylist())
            yield pa.record_batch(
                [b.column("doc_id"), b.column("held_out"), pa.array(p.sum(axis=1)), pa.array(np.ascontiguousarray(p[:, 0])), pa.array((p[:, 0] >= limit).astype(np.int32))],
                names=["doc_id", "held_out", "severity", "p_toxic", "toxic"],
            )

    rows = docs.select("doc_id", "text", learning.held_out().alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, severity double, p_toxic double, toxic int")


def filter_clean(docs: DataFrame, model: OrdinalModel, threshold: float | None = None) -> DataFrame:
    """The rows of docs whose P(grade >= 1) is below the threshold, with all their columns, whatever their names."""
    limit = model.threshold if threshold is None else threshold
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in by_bytes(batches, of_row("text")):
            yield b.filter(pa.array(shared.value.probabilities(of_row("text")(b).to_pylist())[:, 0] < limit))

    return map_rows(docs, run)
