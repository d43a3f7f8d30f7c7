"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are the labelled rows of quality 1 outside the held-out fold; the unlabelled sample is
web text as it comes. The class prior is estimated from the two samples: a logistic model of positive
against unlabelled gives the density ratio p(x | positive) / p(x), which is 1 / prior where texts are
surely positive, and so about at its median over the positives that the model was not trained on. A
small network then minimises ``prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])`` with the
logistic loss l; where the second part falls below zero, its gradient is turned round.

The samples are hash samples of a bounded expected size (``POSITIVES``, ``UNLABELLED``) at every input
size; only their features reach the driver. Features are counts over the whole text (letters, capitals,
marks, repeats, lines, byte pairs), so scoring is one pass over the rows without a shuffle.

Cases: null text counts as empty and is scored by its (zero) features; without positives or unlabelled
rows every score is 0.5; repeated rows are scored each by itself; a text of any length is taken whole;
an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, first_by_hash, hash_sample, held_out, joined, materialise, python_workers, texts_of, word_hashes, word_spans

POSITIVES, UNLABELLED = 6000, 12000
PAIRS = 64
N_FEATURES = 20 + PAIRS

_CLASS = np.zeros(256, dtype=np.int64)  # of a byte: 0 other
for _k, _bytes in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\v\f\r", b".,;:'\"()-", b"!?", b"#*$%&|<>", bytes(range(128, 256))], start=1):
    _CLASS[list(_bytes)] = _k


def features(text: bytes) -> np.ndarray:
    """Fixed number of figures of a whole text."""
    out = np.zeros(N_FEATURES, dtype=np.float64)
    if not text:
        return out
    words = word_hashes(text, lower=False)
    n = max(len(words), 1)
    kinds, pairs, ends, starts = np.zeros(9), np.zeros(PAIRS), np.zeros(9), np.zeros(9)
    length, square = 0.0, 0.0
    data = np.frombuffer(text, dtype=np.uint8)
    for at in range(0, len(data), PIECE_BYTES):
        piece = data[at : at + PIECE_BYTES]
        kind = _CLASS[piece]
        kinds += np.bincount(kind, minlength=9)
        a, b = word_spans(piece)
        starts += np.bincount(kind[a], minlength=9)
        ends += np.bincount(kind[b - 1], minlength=9)
        length += float((b - a).sum())
        square += float(((b - a) ** 2).sum())
        both = kind[:-1] * 9 + kind[1:]
        pairs += np.bincount(both % PAIRS, minlength=PAIRS)
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    _, count = np.unique(words, return_counts=True)
    letters = max(kinds[1] + kinds[2], 1)
    mean = length / n
    out[:20] = [
        np.log1p(len(words)),
        mean,
        np.sqrt(max(square / n - mean * mean, 0)),
        kinds[2] / letters,
        kinds[3] / len(data),
        kinds[5] / n,
        kinds[6] / n,
        kinds[7] / n,
        kinds[8] / len(data),
        kinds[0] / len(data),
        len(count) / n,
        np.log1p(len(count)) - 0.8 * np.log1p(len(words)),
        (count.max() if len(count) else 0) / n,
        float((words[1:] == words[:-1]).sum()) / n,
        1 - len(set(full)) / max(len(full), 1),
        len(full) / n,
        starts[2] / n,
        ends[5] / n,
        ends[6] / n,
        ends[7] / n,
    ]
    out[20:] = np.sqrt(pairs / len(data))
    return out


@dataclass
class Network:
    """Standardised features, one hidden layer, one output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    prior: float = 0.5

    def value(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ self.w1 + self.b1)
        if keep is not None:
            keep += [x, h]
        return h @ self.w2 + self.b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 0.5 * np.tanh(0.5 * self.value(x)) + 0.5


def _new(x: np.ndarray, hidden: int, rng: np.random.Generator) -> Network:
    return Network(x.mean(axis=0), x.std(axis=0) + 1e-6, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1))


def _descend(net: Network, grad_of, steps: int, rate: float, decay: float) -> None:
    """Adam; ``grad_of(step)`` gives (inputs, derivative of the risk by the output)."""
    names, m = ("w1", "b1", "w2", "b2"), {}
    for step in range(1, steps + 1):
        x, derivative = grad_of(step)
        keep: list = []
        net.value(x, keep)
        x, h = keep
        dh = derivative[:, None] * net.w2 * (1 - h * h)
        grads = {"w1": x.T @ dh + decay * net.w1, "b1": dh.sum(axis=0), "w2": h.T @ derivative + decay * net.w2, "b2": np.array([derivative.sum()])}
        for k in names:
            a = m.setdefault(k, [np.zeros_like(grads[k]), np.zeros_like(grads[k])])
            a[0] += 0.1 * (grads[k] - a[0])
            a[1] += 0.001 * (grads[k] ** 2 - a[1])
            setattr(net, k, getattr(net, k) - rate * (a[0] / (1 - 0.9**step)) / (np.sqrt(a[1] / (1 - 0.999**step)) + 1e-8))


def _sig(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * z) + 0.5


def estimated_prior(p: np.ndarray, u: np.ndarray, seed: int = 3) -> float:
    """Share of positives among the unlabelled, from the density ratio on positives left out of its fit."""
    rng = np.random.default_rng(seed)
    p = p[rng.permutation(len(p))]
    half = max(1, len(p) // 2)
    fit, rest = p[:half], p[half:] if len(p) > 1 else p
    net = _new(np.concatenate([fit, u]), 8, rng)

    def grad(step: int):
        a, b = fit[rng.integers(0, len(fit), 256)], u[rng.integers(0, len(u), 256)]
        x = np.concatenate([a, b])
        return x, (_sig(net.value(x)) - np.repeat([1.0, 0.0], 256)) / 512  # as many of each: odds are the ratio

    _descend(net, grad, 400, 0.01, 1e-3)
    ratio = np.exp(np.clip(net.value(rest), -20, 20))
    return float(np.clip(1 / np.median(ratio), 0.05, 0.98))


def risk_gradient(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Of outputs on positives and unlabelled: the risk's positive part, its negative part (below zero it counts as zero), and the derivative to descend on by each output."""
    positive, negative = prior * np.logaddexp(0, -fp).mean(), np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    dp, du = -prior * _sig(fp) / len(fp), _sig(fu) / len(fu)  # of the negative part
    if negative < 0:  # the estimate of a risk went below zero: climb on it alone
        return positive, negative, -dp, -du
    return positive, negative, dp - prior * _sig(-fp) / len(fp), du


def non_negative_pu(p: np.ndarray, u: np.ndarray, prior: float, hidden: int = 16, steps: int = 1500, seed: int = 4) -> Network:
    """Minimise the non-negative unbiased risk."""
    rng = np.random.default_rng(seed)
    net = _new(u, hidden, rng)
    net.prior = prior

    def grad(step: int):
        a, b = p[rng.integers(0, len(p), 256)], u[rng.integers(0, len(u), 512)]
        return np.concatenate([a, b]), np.concatenate(risk_gradient(net.value(a), net.value(b), prior)[2:])

    _descend(net, grad, steps, 0.005, 1e-4)
    return net


def _with_features(rows: DataFrame) -> np.ndarray:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t).tobytes() for t in texts_of(batch.column(1))], pa.binary())], names=["doc_id", "x"])

    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["x"])) for r in rows.select("doc_id", "text").mapInArrow(run, "doc_id long, x binary").collect())
    return np.frombuffer(b"".join(x for _, _, x in found), dtype=np.float64).reshape(-1, N_FEATURES)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, seed: int = 6) -> Network | None:
    python_workers(docs.sparkSession)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    good = labels.where(~held_out(F.col("doc_id")) & (F.col("quality") == 1)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = materialise(hash_sample(good, F.col("doc_id"), positives, good.count(), seed), "positives")
    keys = ["doc_id", "text"]  # rows may share one id, or repeat
    p = _with_features(first_by_hash(joined(own, good, ["doc_id"], "left_semi"), keys, [], 2 * positives, seed))
    web = own.where(~held_out(F.col("doc_id")))
    web = hash_sample(web, F.struct(*keys), unlabelled, docs.select("doc_id").count() * 2 // 3, seed + 1)
    u = _with_features(first_by_hash(web, keys, [], 2 * unlabelled, seed + 1))
    if not len(p) or not len(u):
        return None
    return non_negative_pu(p, u, estimated_prior(p, u))


def scored(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    python_workers(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = np.array([features(t) for t in texts_of(batch.column(2))]).reshape(-1, N_FEATURES)
            score = np.full(len(x), 0.5) if net is None else net.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].alias("text"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))
