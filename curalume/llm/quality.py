"""Document quality: counts over whole texts, and a calibrated classifier trained on labelled quality rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalume.llm.bytes_np import EXACT, NOT_SPACE, U64, grams, mix, row_groups, span_hashes, texts, words
from curalume.llm.linear import Model, probabilities, raw_scores, trained

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry: whether an earlier one of its row is equal, and whether any other one is."""
    key = mix(key ^ mix(row.astype(U64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = any_[order[:-1][same]] = True
    return later, any_


def counts(data: np.ndarray, offsets: np.ndarray, window: int = 8):
    """The words of each row and the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n = len(offsets) - 1
    w = words(data, offsets, values=EXACT)
    n_words = np.diff(w.first)
    solid = NOT_SPACE[data]
    chars = _per_row(solid & ((data & 0xC0) != 0x80), offsets)
    symbols = _per_row(_SYMBOL[data], offsets)

    newline = np.flatnonzero(data == 10)
    begin = np.union1d(offsets[:-1], newline + 1)
    begin = begin[begin < len(data)]
    end = np.r_[begin[1:], len(data)]
    end = end - ((end > begin) & (data[np.maximum(end - 1, 0)] == 10)) if len(begin) else end[:0]
    row = np.searchsorted(offsets, begin, "right") - 1
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid, out=seen[1:])
    full = seen[end] > seen[begin] if len(begin) else np.empty(0, bool)
    begin, end, row = begin[full], end[full], row[full]
    later, _ = _repeats(span_hashes(data, begin, end, EXACT), row)
    dup_lines = np.bincount(row[later], minlength=n)

    g = grams(w.hash, window)
    own = np.repeat(np.arange(n), n_words)
    ok = own[: len(g)] == own[window - 1 :] if len(g) else np.empty(0, bool)
    at = np.flatnonzero(ok)
    _, twice = _repeats(g[at], own[at])
    cover = np.zeros(len(own) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + window, -1)
    repeat = np.bincount(own[np.cumsum(cover)[:-1] > 0], minlength=n)
    return w, (n_words, chars, symbols, dup_lines, repeat)


def _judged(column: pa.Array, m: Model | None, min_words: int, repeat_percent: int, min_probability: float, good: str):
    data, offsets = texts(column)
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    for lo, hi in row_groups(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        w, found = counts(part, at)
        p = probabilities(raw_scores(part, at, m, w.hash, w.first), m)[:, m.classes.index(good)] if m and good in m.classes else np.full(hi - lo, np.nan)
        for held, x in zip(columns, (*found, p), strict=True):
            held.append(x)
    *found, p = (np.concatenate(c) if c else np.empty(0) for c in columns)
    failed = (found[0] < min_words) | (100 * found[4] > repeat_percent * found[0])
    return found, failed, p, ~failed & (np.isnan(p) | (p >= min_probability))


def quality_rules(docs: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text", min_words: int = 20, repeat_percent: int = 30, min_probability: float = 0.5, good: str = "1") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept), a row per row of `docs`.

    Words are split at ASCII white space. n_dup_lines counts lines with a word that equal an earlier line,
    n_repeat_words the words in 8-word windows found twice or more. base_failed: fewer than `min_words` words,
    or repeated words above `repeat_percent`. kept: not base_failed, and a calibrated probability of `good`
    of `min_probability` or more; without a model (no labels of two kinds) the base rules alone decide and
    probability is null. A null or empty text has no words and fails. Ids and other columns are not looked at:
    null or repeated ids each keep their row; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found, failed, p, kept = _judged(batch.column(1), shared.value, min_words, repeat_percent, min_probability, good)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in found), pa.array(failed), pa.array(p, pa.float64(), mask=np.isnan(p)), pa.array(kept)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def good_documents(docs: DataFrame, model: Model | None, text: str = "text", min_words: int = 20, repeat_percent: int = 30, min_probability: float = 0.5, good: str = "1") -> DataFrame:
    """The rows of `docs` that quality_rules keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_judged(batch.column(at), shared.value, min_words, repeat_percent, min_probability, good)[3]))

    return docs.mapInArrow(run, docs.schema)


def quality_model(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> Model | None:
    """The classifier of labels(doc_id, quality 0/1) over docs(doc_id, text); rows without text or label are left out."""
    known = labels.where("quality is not null").select("doc_id", F.col("quality").cast("string").alias("label"))
    return trained(docs.select("doc_id", "text"), known, max_rows, epochs=6, l2=5e-3)
