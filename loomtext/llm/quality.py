"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every pair of features interacts through the inner product of two short vectors. The sum over all
pairs is computed in time linear in the features by the sum-of-squares identity
    sum_{i<j} <v_i, v_j> x_i x_j  =  1/2 * sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ].

Edge cases: a null or empty text has no words, its score comes from the statistics (all 0) and is
a number; the size of very long texts only lengthens their own row; rows are scored one by one, so
ties and repeats get equal scores; an empty table gives an empty result; extra columns are ignored. A null
id is scored, and counts as held out. A missing, null or negative n_chars counts as the length of the text.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import learning
from loomtext.llm.common import by_bytes, map_rows, of_row

#: At most so many labelled rows are fitted on, whatever the size of the input; learning.SAMPLE_BYTES bounds their texts.
SAMPLE = 12_000
THRESHOLD = 0.3

_GROUPS = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:'\"-()", b"!?",
    b"#$%&*@^~+=", b"|_<>/\\[]{}`",
]
_GROUP = np.zeros((256, len(_GROUPS) + 2))
for _i, _g in enumerate(_GROUPS):
    _GROUP[list(_g), _i] = 1
_GROUP[128:, len(_GROUPS)] = 1
_GROUP[_GROUP.sum(axis=1) == 0, len(_GROUPS) + 1] = 1
N_STATS = _GROUP.shape[1] + 9


def statistics(texts: list[str | None], n_chars: list, at: np.ndarray, size: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Structure statistics and metadata, one row per text; all finite."""
    out = np.zeros((len(texts), N_STATS))
    for i, t in enumerate(texts):
        t = t or ""
        raw = np.frombuffer(t.encode(), dtype=np.uint8)
        k = _GROUP.shape[1]
        if len(raw):
            out[i, :k] = np.bincount(raw, minlength=256) @ _GROUP / len(raw)
        w = size[at[i] : at[i + 1]]
        lines = [x for x in t.split("\n") if x]
        m = n_chars[i] if n_chars[i] is not None and n_chars[i] >= 0 else len(t)
        out[i, k:] = (
            np.log1p(len(w)), w.mean() if len(w) else 0, w.std() if len(w) else 0, (w <= 3).mean() if len(w) else 0,
            distinct[i] / max(1, len(w)), np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)),
            np.log1p(len(t) / max(1, len(lines))), np.log1p(m),
        )
    return out


@dataclass
class FactorizationMachine:
    """bias, linear weights and factor vectors: of the active word buckets, then of the statistics."""

    keep: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def inputs(self, texts, n_chars):
        """The sparse rows: text index, feature, value, sorted by text."""
        doc, bucket, count, n, size, at = learning.word_counts(texts, "space", self.keep)
        norm = np.sqrt(np.bincount(doc, count.astype(float) ** 2, minlength=len(texts)))
        distinct = np.bincount(doc, minlength=len(texts))
        s = np.clip((statistics(texts, n_chars, at, size, distinct) - self.mean) / self.scale, -4, 4) / np.sqrt(N_STATS)
        first = len(self.w) - N_STATS
        doc = np.concatenate([doc, np.repeat(np.arange(len(texts)), N_STATS)])
        feature = np.concatenate([bucket, np.tile(np.arange(first, first + N_STATS), len(texts))])
        value = np.concatenate([count / norm[doc[: len(count)]], s.ravel()])
        order = np.argsort(doc, kind="stable")
        return doc[order], feature[order], value[order]

    def logits(self, doc, feature, value, n):
        xv = self.v[feature] * value[:, None]
        starts = np.searchsorted(doc, np.arange(n))
        total, squares = np.add.reduceat(xv, starts), np.add.reduceat((xv * xv).sum(axis=1), starts)
        return self.w0 + np.add.reduceat(self.w[feature] * value, starts) + 0.5 * ((total**2).sum(axis=1) - squares), total

    def score(self, texts, n_chars) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return learning.sigmoid(self.logits(*self.inputs(texts, n_chars), len(texts))[0])


def fit(rows: list[tuple[str | None, int | None, int]], factors: int = 8, epochs: int = 8, rate: float = 0.05, l2: float = 1e-5, least: int = 12, seed: int = 7) -> FactorizationMachine:
    """Fit on (text, n_chars, label) rows by Adagrad on the logistic loss. Without both labels, a constant score."""
    rng = np.random.default_rng(seed)
    texts, n_chars, y = [r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows], dtype=float)
    blocks = [slice(i, i + 256) for i in range(0, len(rows), 256)]
    found = []
    for b in blocks:
        doc, bucket, *_ = learning.word_counts(texts[b], "space")
        found += np.split(bucket.astype(np.int32), np.searchsorted(doc, np.arange(1, len(texts[b]))))
    keep = learning.active_buckets(found, least)
    n = int(keep.max()) + 1 + N_STATS if len(keep) else N_STATS
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    m = FactorizationMachine(keep, np.zeros(N_STATS), np.ones(N_STATS), float(np.log(share / (1 - share))), np.zeros(n), np.zeros((n, factors)))
    if not len(y) or y.min() == y.max():
        return m
    stats = []
    for b in blocks:
        doc, _, _, _, size, at = learning.word_counts(texts[b], "space", keep)
        stats.append(statistics(texts[b], n_chars[b], at, size, np.bincount(doc, minlength=len(texts[b]))))
    stats = np.concatenate(stats)
    m.mean, m.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    m.v[:] = rng.normal(0, 0.05, m.v.shape)
    sparse = []
    for b in blocks:
        doc, feature, value = m.inputs(texts[b], n_chars[b])
        cut = np.searchsorted(doc, np.arange(1, len(texts[b])))
        sparse += list(zip(np.split(feature.astype(np.int32), cut), np.split(value.astype(np.float32), cut), strict=True))
    gw, gv, g0 = np.full(n, 1e-4), np.full(m.v.shape, 1e-4), 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 64):
            pick = order[i : i + 64]
            doc = np.repeat(np.arange(len(pick)), [len(sparse[p][0]) for p in pick])
            feature, value = (np.concatenate([sparse[p][k] for p in pick]) for k in (0, 1))
            z, total = m.logits(doc, feature, value, len(pick))
            e = (learning.sigmoid(z) - y[pick]) / len(pick)
            uniq, back = np.unique(feature, return_inverse=True)
            ev = e[doc] * value
            dw = np.bincount(back, ev, minlength=len(uniq)) + l2 * m.w[uniq]
            dv = np.zeros((len(uniq), factors))
            np.add.at(dv, back, ev[:, None] * (total[doc] - m.v[feature] * value[:, None]))
            dv += l2 * m.v[uniq]
            gw[uniq] += dw**2
            gv[uniq] += dv**2
            g0 += e.sum() ** 2
            m.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            m.v[uniq] -= rate * dv / np.sqrt(gv[uniq])
            m.w0 -= rate * e.sum() / np.sqrt(g0)
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorizationMachine:
    """Fit on at most `sample` labelled rows outside the held-out fold, of at most learning.SAMPLE_BYTES; the same rows give the same model."""
    return fit([r[1:] for r in learning.labelled_sample(docs, labels, "quality", sample, least=learning.LEAST)])


def score(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; only doc_id, text and n_chars are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the sample's bound, not on docs

    def run(batches):
        for b in by_bytes(batches, "text"):
            s = shared.value.score(b.column("text").to_pylist(), b.column("n").to_pylist())
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    size = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    rows = docs.select("doc_id", "text", size.cast("long").alias("n"), learning.held_out().alias("held_out"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def filter_quality(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least `threshold`, with all their columns, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    has = "n_chars" in docs.columns

    def run(batches):
        for b in by_bytes(batches, of_row("text")):
            n = [x if isinstance(x, int) else None for x in of_row("n_chars")(b).to_pylist()] if has else [None] * b.num_rows
            yield b.filter(pa.array(shared.value.score(of_row("text")(b).to_pylist(), n) >= threshold))

    return map_rows(docs, run)
