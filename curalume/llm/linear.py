"""Linear text classifier over hashed word and character n-grams.

A document's features are hashed buckets of its words, counted over the root of their number so that a telling
word shows in a long text too, and of its 4-byte character n-grams, as shares. A score is two scaled sums of
weights over the whole text: scoring needs no vocabulary and no sort. The model is fitted
in one task on a bounded sample of labelled rows and has a fixed size, whatever the corpus.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalume.llm.bytes_np import EXACT, U64, row_groups, texts, words

BUCKETS = 1 << 16
_N = 4
_WORD, _CHAR = 5.0, 50.0


class Model(NamedTuple):
    """classes - 1 score columns against class 0; calibration is a slope and one shift per column."""

    classes: list[str]
    weights: np.ndarray  #: (2 * BUCKETS, classes - 1)
    bias: np.ndarray
    slope: float
    shift: np.ndarray


def _word_buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(48)).astype(np.int64)


def _char_buckets(data: np.ndarray) -> np.ndarray:
    """One bucket for each place of the array but the last ones."""
    if len(data) < _N:
        return np.empty(0, np.int64)
    code = np.zeros(len(data) - _N + 1, np.uint32)
    for j in range(_N):
        code |= data[j : len(data) - _N + 1 + j].astype(np.uint32) << np.uint32(8 * j)
    code *= np.uint32(0x9E3779B1)
    return (code >> np.uint32(16)).astype(np.int64) + BUCKETS


def _spans(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return offsets[:-1], np.maximum(offsets[1:] - _N + 1, offsets[:-1])


def counted(data: np.ndarray, offsets: np.ndarray):
    """Per row: the distinct buckets and their values."""
    w = words(data, offsets, values=EXACT)
    word, char = _word_buckets(w.hash), _char_buckets(data)
    lo, hi = _spans(offsets)
    for i in range(len(offsets) - 1):
        i1, c1 = np.unique(word[w.first[i] : w.first[i + 1]], return_counts=True)
        i2, c2 = np.unique(char[lo[i] : hi[i]], return_counts=True)
        yield np.concatenate((i1, i2)), np.concatenate((_WORD * c1 / max(1, c1.sum()) ** 0.5, _CHAR * c2 / max(1, c2.sum())))


def raw_scores(data: np.ndarray, offsets: np.ndarray, model: Model, word_hash: np.ndarray | None = None, first: np.ndarray | None = None) -> np.ndarray:
    """(rows, classes - 1) before calibration."""
    if word_hash is None:
        _, _, first, word_hash = words(data, offsets, values=EXACT)
    out = np.tile(model.bias, (len(offsets) - 1, 1)).astype(float)
    lo, hi = _spans(offsets)
    hi = np.minimum(hi, max(0, len(data) - _N + 1))
    lo = np.minimum(lo, hi)
    for buckets, a, b, scale in ((_word_buckets(word_hash), first[:-1], first[1:], _WORD / np.sqrt(np.maximum(1, np.diff(first)))), (_char_buckets(data), lo, hi, _CHAR / np.maximum(1, hi - lo))):
        for c in range(model.weights.shape[1]):
            total = np.zeros(len(buckets) + 1)
            np.cumsum(model.weights[buckets, c], out=total[1:])
            out[:, c] += scale * (total[b] - total[a])
    return out


def probabilities(raw: np.ndarray, model: Model) -> np.ndarray:
    """(rows, classes), calibrated."""
    z = np.column_stack((np.zeros(len(raw)), model.slope * raw + model.shift))
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.column_stack((np.zeros(len(z)), z))
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _fit(y: np.ndarray, index: np.ndarray, value: np.ndarray, lo: np.ndarray, hi: np.ndarray, chosen: np.ndarray, k: int, epochs: int, rate: float, l2: float):
    """Multinomial logistic regression of the chosen rows by AdaGrad over mini-batches in a fixed order; row r has the features from lo[r] to hi[r]."""
    w, b = np.zeros((2 * BUCKETS, k - 1)), np.zeros(k - 1)
    gw, gb = np.full_like(w, 1e-3), np.full_like(b, 1e-3)
    order = chosen[np.random.Generator(np.random.PCG64(1)).permutation(len(chosen))]
    for _ in range(epochs):
        for s in range(0, len(order), 64):
            rows = order[s : s + 64]
            pick = np.concatenate([np.arange(lo[r], hi[r]) for r in rows])
            own = np.repeat(np.arange(len(rows)), hi[rows] - lo[rows])
            i, v = index[pick], value[pick]
            z = np.stack([np.bincount(own, v * w[i, j], len(rows)) for j in range(k - 1)], 1) + b
            e = (_softmax(z) - np.eye(k)[y[rows]])[:, 1:] / len(rows)
            u, inv = np.unique(i, return_inverse=True)
            for j in range(k - 1):
                g = np.bincount(inv, v * e[own, j], len(u)) + l2 * w[u, j]
                gw[u, j] += g * g
                w[u, j] -= rate * g / np.sqrt(gw[u, j])
            gb += e.sum(0) ** 2
            b -= rate * e.sum(0) / np.sqrt(gb)
    return w, b


def _calibrated(z: np.ndarray, y: np.ndarray, k: int) -> tuple[float, np.ndarray]:
    """Slope and shifts that fit held-out scores best, by damped gradient steps; a weak prior keeps them near 1 and 0."""
    slope, shift = 1.0, np.zeros(k - 1)
    if len(y) < 10:
        return slope, shift
    scale = max(1.0, float(np.abs(z).mean()))
    for _ in range(400):
        e = (_softmax(slope * z + shift) - np.eye(k)[y])[:, 1:]
        slope = max(0.05, slope - (0.5 / scale**2) * ((e * z).sum() / len(y) + 0.01 * (slope - 1)))
        shift = shift - 0.5 * (e.mean(0) + 0.01 * shift)
    return slope, shift


def trained(docs: DataFrame, labelled: DataFrame, max_rows: int = 8000, epochs: int = 8, rate: float = 0.2, l2: float = 1e-4) -> Model | None:
    """Fit on docs(doc_id, text) with labelled(doc_id, label string); None without two labels.

    At most `max_rows` labelled documents with a text, those of least id hash, are used: the bound of the fit
    and of what is broadcast to find their texts, which never move. Features are made where the rows lie; a
    fifth of the rows is held out of the fit and calibrates it.
    """

    def features(batches):
        for batch in batches:
            data, offsets = texts(batch.column(1))
            index, value, at = [], [], [0]
            for lo, hi in row_groups(offsets):
                for i, v in counted(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                    index.append(i)
                    value.append(v)
                    at.append(at[-1] + len(i))
            flat = pa.array(np.concatenate(index) if index else np.empty(0, np.int64)).cast(pa.int32())
            share = pa.array(np.concatenate(value) if value else np.empty(0)).cast(pa.float32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat), pa.ListArray.from_arrays(pa.array(at, pa.int32()), share)], names=["doc_id", "label", "i", "v"])

    def fit(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        ids, labels = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in (0, 1))
        size = np.concatenate([b.column(2).value_lengths().to_numpy(zero_copy_only=False) for b in held]).astype(np.int64)
        i, v = (np.concatenate([b.column(c).flatten().to_numpy() for b in held]) for c in (2, 3))
        held.clear()
        order = np.argsort(ids, kind="stable")  # rows by id, whose features stay where they are
        hi = np.cumsum(size)[order]
        lo = hi - size[order]
        names = sorted(set(labels.tolist()))
        if len(names) < 2:
            return
        y = np.array([names.index(x) for x in labels[order].tolist()])
        held_out = np.arange(len(y)) % 5 == 0
        if len(set(y[~held_out])) < len(names):
            held_out[:] = False
        w, b = _fit(y, i, v, lo, hi, np.flatnonzero(~held_out), len(names), epochs, rate, l2)
        z = np.array([v[p:q] @ w[i[p:q]] for p, q in zip(lo.tolist(), hi.tolist(), strict=True)]) + b
        slope, shift = _calibrated(z[held_out], y[held_out], len(names))
        yield pa.RecordBatch.from_arrays([pa.array([names]), pa.array([w.astype(np.float32).tobytes()]), pa.array([b.tolist()]), pa.array([float(slope)]), pa.array([shift.tolist()])], names=["classes", "w", "b", "slope", "shift"])

    known = labelled.select("doc_id", "label").where("doc_id is not null and label is not null").distinct()
    sample = docs.where("text is not null").select("doc_id").join(known, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    rows = docs.where("text is not null").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label").mapInArrow(features, "doc_id long, label string, i array<int>, v array<float>")
    found = rows.repartition(1).mapInArrow(fit, "classes array<string>, w binary, b array<double>, slope double, shift array<double>").collect()
    if not found:
        return None
    m = found[0]
    return Model(list(m.classes), np.frombuffer(m.w, np.float32).reshape(-1, len(m.classes) - 1), np.array(m.b), m.slope, np.array(m.shift))
