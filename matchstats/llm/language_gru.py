"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the lower-cased UTF-8 of a text in both directions, white space included, and gives a distribution
over languages at every byte position; a document's distribution is the mean over its positions that are not white
space. A text is read in windows: each labels ``CORE`` bytes, and begins and ends ``CONTEXT`` bytes before and after
them, so every position is labelled once, with what stands on both sides of it. It is trained in numpy by
backpropagation through time over the same windows: every position has the language of its document as its label,
and languages weigh the same.

Training texts come from a hash sample of the labelled documents, ``TRAIN_DOCS`` of each language in expectation (all
of a language with fewer), and are learnt from as a whole; the bound is the same at every input size. Prediction is
one pass over the rows of the whole table without a shuffle.

Cases: a text that is null or has no letter is ``und`` with score 0; without any labelled row every
text is ``und``; repeated rows are predicted each by itself; a text of any length is taken whole; an
empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _IS_SPACE, PIECE_BYTES, first_by_hash, held_out, joined, materialise, python_workers

CORE, CONTEXT, STEP = 224, 16, 32
TRAIN_DOCS, HIDDEN, EPOCHS, BATCH = 100, 8, 4, 64
#: Windows that go through the network together, in prediction.
WINDOWS = 1024


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Of a fresh array, in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class Direction:
    """One gated recurrent layer; ``table`` has a row for each byte (input weights and biases), gates in the order update, reset, new."""

    NAMES = ("table", "hidden", "bias")

    def __init__(self, size: int, rng: np.random.Generator):
        self.size = size
        self.table = rng.normal(0, 0.3, (256, 3 * size)).astype(np.float32)
        self.hidden = rng.normal(0, size**-0.5, (size, 3 * size)).astype(np.float32)
        self.bias = np.zeros(size, dtype=np.float32)

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, words, size) for bytes (steps, words)."""
        n, h = self.size, np.zeros((x.shape[1], self.size), dtype=np.float32)
        out = np.empty((*x.shape, n), dtype=np.float32)
        for t in range(len(x)):
            a, b = self.table[x[t]], h @ self.hidden
            gates = _sigmoid(a[:, : 2 * n] + b[:, : 2 * n])
            update, reset = gates[:, :n], gates[:, n:]
            inner = b[:, 2 * n :] + self.bias
            new = np.tanh(a[:, 2 * n :] + reset * inner)
            if keep is not None:
                keep.append((h, update, reset, inner, new))
            h = new + update * (h - new)
            out[t] = h
        return out

    def states(self, x: np.ndarray) -> np.ndarray:
        """The same as ``forward`` as (steps, size, windows): units lie in rows, so every operation runs over whole ones, in place."""
        n, windows = self.size, x.shape[1]
        # the logistic function is 0.5 tanh(z / 2) + 0.5: its factors are in the weights
        half = np.repeat(np.float32([0.5, 0.5, 1.0]), n)[:, None]
        table, hidden = self.table.T * half, np.ascontiguousarray(self.hidden.T) * np.float32(0.5)
        bias = self.bias[:, None] * np.float32(0.5)
        h, a, b = np.zeros((n, windows), np.float32), np.empty((3 * n, windows), np.float32), np.empty((3 * n, windows), np.float32)
        update, reset, gates, new, inner = a[:n], a[n : 2 * n], a[: 2 * n], a[2 * n :], b[2 * n :]
        out = np.empty((len(x), n, windows), dtype=np.float32)
        for t in range(len(x)):
            np.take(table, x[t], axis=1, out=a, mode="clip")
            np.matmul(hidden, h, out=b)
            gates += b[: 2 * n]
            np.tanh(gates, out=gates)
            inner += bias
            reset += 1
            reset *= inner
            new += reset
            np.tanh(new, out=new)
            update += 1
            update *= 0.5
            h -= new
            h *= update
            h += new
            out[t] = h
        return out

    def backward(self, x: np.ndarray, kept: list, dout: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients through time, given those of the states."""
        n = self.size
        d = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        carry = np.zeros_like(dout[0])
        inputs = np.empty((*x.shape, 3 * n), dtype=np.float32)
        for t in range(len(x) - 1, -1, -1):
            before, update, reset, inner, new = kept[t]
            dh = dout[t] + carry
            dnew = dh * (1 - update) * (1 - new * new)
            dupdate = dh * (before - new) * update * (1 - update)
            dreset = dnew * inner * reset * (1 - reset)
            inputs[t] = np.concatenate([dupdate, dreset, dnew], axis=1)
            dhidden = np.concatenate([dupdate, dreset, dnew * reset], axis=1)
            d["hidden"] += before.T @ dhidden
            d["bias"] += (dnew * reset).sum(axis=0)
            carry = dh * update + dhidden @ self.hidden.T
        one_hot = np.zeros((x.size, 256), dtype=np.float32)
        one_hot[np.arange(x.size), x.ravel()] = 1
        d["table"] = one_hot.T @ inputs.reshape(-1, 3 * n)
        return d


class ByteGRU:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.behind = Direction(hidden, rng), Direction(hidden, rng)
        self.out = np.zeros((2 * hidden, len(languages)), dtype=np.float32)
        self.out_bias = np.zeros(len(languages), dtype=np.float32)

    def probabilities(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(steps, windows, languages) for bytes (steps, windows)."""
        kept = ([], []) if keep is not None else (None, None)
        states = np.concatenate([self.ahead.forward(x, kept[0]), self.behind.forward(x[::-1], kept[1])[::-1]], axis=2)
        p = states @ self.out + self.out_bias
        p -= p.max(axis=2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=2, keepdims=True)
        if keep is not None:
            keep |= {"states": states, "kept": kept}
        return p

    def sums(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """(windows, languages): the distributions of the positions ``inside`` (steps, windows), added up."""
        n = self.ahead.size
        p = np.matmul(self.out[:n].T, self.ahead.states(x))
        p += np.matmul(self.out[n:].T, self.behind.states(x[::-1]))[::-1]
        p += self.out_bias[:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p *= (inside / p.sum(axis=1))[:, None]
        return p.sum(axis=0).T

    def gradients(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, list[tuple[object, str, np.ndarray]]]:
        """Cross-entropy weighted by position (steps, windows) and its gradients by backpropagation through time."""
        keep: dict = {}
        p = self.probabilities(x, keep)
        windows = np.arange(x.shape[1])
        scale = weight / weight.sum()
        loss = -float((np.log(p[:, windows, label] + 1e-12) * scale).sum())
        dlogits = p.copy()
        dlogits[:, windows, label] -= 1
        dlogits *= scale[:, :, None]
        states, n = keep["states"], self.ahead.size
        dstates = dlogits @ self.out.T
        found = [(self, "out", np.einsum("tbh,tbc->hc", states, dlogits)), (self, "out_bias", dlogits.sum(axis=(0, 1)))]
        for layer, data, kept, d in ((self.ahead, x, keep["kept"][0], dstates[:, :, :n]), (self.behind, x[::-1], keep["kept"][1], dstates[::-1, :, n:])):
            found += [(layer, k, g) for k, g in layer.backward(data, kept, d).items()]
        return loss, found

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, seed: int = 11) -> None:
        """Adam over batches of windows of whole texts (lower-cased UTF-8)."""
        rng = np.random.default_rng(seed)
        data, doc, begin, size = _windows(texts)
        label = labels[doc]
        count = np.bincount(label, weights=size, minlength=len(self.languages))
        weight = (size.sum() / np.maximum(count, 1)).astype(np.float32)
        moments: dict = {}
        step, total = 0, epochs * sum(1 for _ in _passes(data, begin, size, BATCH))
        for _ in range(epochs):
            mix = rng.permutation(len(begin))
            batches = [(mix[own], x, inside) for own, x, inside in _passes(data, begin[mix], size[mix], BATCH)]
            for k in rng.permutation(len(batches)):
                own, x, inside = batches[k]
                step += 1
                if not inside.any():
                    continue
                _, found = self.gradients(x, label[own], inside * weight[label[own]])
                now = rate * (1 - 0.9 * step / total)
                for owner, name, g in found:
                    m = moments.setdefault((id(owner), name), [np.zeros_like(g), np.zeros_like(g)])
                    m[0] += 0.1 * (g - m[0])
                    m[1] += 0.001 * (g * g - m[1])
                    change = now * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
                    setattr(owner, name, (getattr(owner, name) - change).astype(np.float32))

    def position_labels(self, text: str) -> list[tuple[int, str]]:
        """Byte offset in the lower-cased UTF-8 and language of every position of a text, white space left out."""
        data, _, begin, size = _windows([text.lower().encode()])
        out = []
        for own, x, inside in _passes(data, begin, size, WINDOWS):
            best = self.probabilities(x).argmax(axis=2)
            step, window = np.nonzero(inside)
            at = begin[own][window] + step - CONTEXT - _GAP
            out += zip(at.tolist(), (self.languages[c] for c in best[step, window]), strict=True)
        return sorted(out)


#: White space before, between and after texts: no window sees two.
_GAP = CONTEXT + STEP


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and of each window its text, where its core begins in them, and the core's size."""
    data = np.frombuffer(b" " * _GAP + b"".join(t + b" " * _GAP for t in texts), dtype=np.uint8)
    length = np.array([len(t) for t in texts], dtype=np.int64)
    at = _GAP + np.cumsum(length + _GAP) - (length + _GAP)
    parts = -(-length // CORE)
    doc = np.repeat(np.arange(len(texts)), parts)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    return data, doc, at[doc] + k * CORE, np.minimum(CORE, length[doc] - k * CORE)


def _passes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of one length at a time: which, their bytes (steps, windows), and which of these they label."""
    steps = 2 * CONTEXT + -(-size // STEP) * STEP
    for n in np.unique(steps):
        of = np.flatnonzero(steps == n)
        t = np.arange(n)[:, None]
        for k in range(0, len(of), most):
            own = of[k : k + most]
            x = data[begin[own] - CONTEXT + t]
            yield own, x, (t >= CONTEXT) & (t < CONTEXT + size[own]) & ~_IS_SPACE[x]


def pooled(model: ByteGRU, texts: list[bytes]) -> np.ndarray:
    """Mean distribution over the positions of each text (lower-cased UTF-8); zeros without a position."""
    total, positions = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    first = 0
    while first < len(texts):
        last, held = first, 0
        while last < len(texts) and (held == 0 or held + len(texts[last]) < PIECE_BYTES):
            held += len(texts[last]) + _GAP
            last += 1
        data, doc, begin, size = _windows(texts[first:last])
        for own, x, inside in _passes(data, begin, size, WINDOWS):
            np.add.at(total, first + doc[own], model.sums(x, inside.astype(np.float32)))
            np.add.at(positions, first + doc[own], inside.sum(axis=0))
        first = last
    return total / np.maximum(positions, 1)[:, None]


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, seed: int = 5) -> ByteGRU | None:
    """A network trained on a bounded sample of the labelled rows outside the held-out fold (``train_docs`` of each language in expectation, twice as many at most); None without any.

    Every language with a labelled row is in it.
    """
    labelled = docs.select(docs["doc_id"], docs["text"], docs["lang"].alias("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30))
    counts = materialise(labelled.groupBy("lang").agg(F.count("*").alias("rows"), F.min(place).alias("least")), "language-rows")
    # a language with few rows gives all of them, and each its first row, whatever repeats
    drawn = (place / (1 << 30) * F.col("rows") < train_docs) | (place == F.col("least"))
    sample = joined(labelled, counts, ["lang"], "inner").where(drawn | (F.col("rows") <= train_docs))
    sample = first_by_hash(sample, ["doc_id", "text"], ["lang"], 2 * train_docs, seed)  # rows may repeat
    rows = sorted((r["text"], r["lang"]) for r in sample.select("text", "lang").collect())  # the same order however the rows arrive
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    model = ByteGRU(languages)
    texts = [t.lower().encode() for t, _ in rows]
    if any(texts):
        model.train(texts, np.array([languages.index(lang) for _, lang in rows]))
    return model


def predicted(docs: DataFrame, model: ByteGRU | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row."""
    python_workers(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        letter = regex.compile(r"\p{L}")
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            known = [model is not None and letter.search(t) is not None for t in texts]
            p = pooled(model, [t.lower().encode() for t in texts]) if model else np.zeros((len(texts), 1))
            best = p.argmax(axis=1)
            lang = [model.languages[c] if k else "und" for c, k in zip(best, known, strict=True)]
            score = np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].alias("text"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op3(docs: DataFrame) -> DataFrame:
    return predicted(docs, fit(docs))
