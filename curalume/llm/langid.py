"""Language identification by rank-order profiles of character n-grams.

A language's profile is the ranked list of its most frequent n-grams of 1 to 3 bytes over lower-cased letters,
with word ends marked. A document's own ranked list is compared with each profile by the out-of-place distance
(Cavnar and Trenkle, 1994): how far each n-gram stands from its place there, or the longest way if it is missing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curalume.llm.bytes_np import U64, row_groups, texts

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_FOLD = np.where(_LETTER, np.arange(256), 0x20).astype(np.uint8)
_FOLD[0x41:0x5B] += 0x20
_CODE = 26
_ROWS = 1 << 12
_PIECE = 1 << 22


def _codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """row << 26 | n-gram for each n-gram of each row: a word with a mark on both sides, no n-gram over two words, no mark alone."""
    x = _FOLD[data]
    if len(data) > 1:  # capital letters of the Latin-1 block in UTF-8
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        x[1:][upper] += 0x20
    # a mark on both sides of each row
    n = len(offsets) - 1
    wide = np.full(len(x) + 2 * n, 0x20, np.uint8)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    wide[np.arange(len(x)) + 2 * row + 1] = x
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(offsets) + 2) << U64(_CODE)
    mark = wide == 0x20
    out = [(row | wide)[~mark]]
    if len(wide) > 2:
        same = (row[:-1] == row[1:]) & ~(mark[:-1] & mark[1:])
        two = row[:-1] | (wide[:-1].astype(U64) << U64(8)) | wide[1:] | U64(1 << 24)
        out.append(two[same])
        same3 = same[:-1] & same[1:] & ~mark[1:-1]
        three = row[:-2] | (wide[:-2].astype(U64) << U64(16)) | (wide[1:-1].astype(U64) << U64(8)) | wide[2:] | U64(2 << 24)
        out.append(three[same3])
    return np.concatenate(out)


def _run_lengths(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.empty(0, np.int64)
    return sorted_[cut], np.diff(np.r_[cut, len(sorted_)])


def _counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct _codes, sorted, and how often each is there; a very long row is taken in pieces that end between words."""
    if len(data) <= _PIECE:
        return _run_lengths(np.sort(_codes(data, offsets)))
    key, count, lo = np.empty(0, U64), np.empty(0, np.int64), 0
    while lo < len(data):
        hi = lo + _PIECE
        gap = np.flatnonzero(~_LETTER[data[hi : hi + _PIECE]])
        hi = hi + int(gap[0]) if len(gap) else len(data)
        hi = min(hi, len(data))
        k, c = _run_lengths(np.sort(_codes(data[lo:hi], np.array([0, hi - lo]))))
        key, count = _merge(key, count, k, c)
        lo = hi
    return key, count


def _merge(key: np.ndarray, count: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.r_[key, more], np.r_[count, n]
    order = np.argsort(key, kind="stable")
    key, many = _run_lengths(key[order])
    return key, np.add.reduceat(count[order], np.r_[0, np.cumsum(many)[:-1]]) if len(key) else np.empty(0, np.int64)


def _groups(offsets: np.ndarray):
    for lo, hi in row_groups(offsets):
        for a in range(lo, hi, _ROWS):
            yield a, min(hi, a + _ROWS)


def language_profiles(labelled: DataFrame, top: int = 300) -> DataFrame:
    """(lang, gram, rank): the `top` most frequent n-grams of each language in labelled(lang, text), most frequent first, ties by n-gram."""

    def run(batches):
        names: list[str] = []
        held = np.empty(0, U64), np.empty(0, np.int64)
        for batch in batches:
            lang = batch.column(0).to_pylist()
            for x in dict.fromkeys(lang):
                if x not in names:
                    names.append(x)
            own = np.array([names.index(x) for x in lang], np.uint64)
            data, offsets = texts(batch.column(1))
            for lo, hi in _groups(offsets):
                c, count = _counted(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                key = (own[lo + (c >> U64(_CODE)).astype(np.int64)] << U64(_CODE)) | (c & U64((1 << _CODE) - 1))
                held = _merge(*held, key, count)
        lang = pa.array(names, pa.string()).take(pa.array((held[0] >> U64(_CODE)).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([lang, pa.array((held[0] & U64((1 << _CODE) - 1)).astype(np.int64)), pa.array(held[1])], names=["lang", "gram", "n"])

    counts = labelled.select("lang", "text").where("lang is not null and text is not null").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= top).select("lang", "gram", F.col("rank").cast("long").alias("rank"))


def identify(docs: DataFrame, profiles: DataFrame, id: str = "doc_id", text: str = "text", top: int = 300) -> DataFrame:
    """(doc_id, lang_pred, score): the profile at the least out-of-place distance, the first by name among equals.

    score is 1 less the distance over its maximum. A null text, one without a letter, or any text when there
    are no profiles is und with score 0. Ids, also null and repeated ones, and other columns are not looked at;
    an empty table gives no rows. Profiles are `top` rows a language and are broadcast.
    """
    rows = profiles.toPandas()
    names = sorted(rows["lang"].unique())
    grams = np.unique(rows["gram"].to_numpy(np.int64))
    place = np.full((len(grams) + 1, len(names)), -1, np.int64)
    if len(rows):
        place[np.searchsorted(grams, rows["gram"].to_numpy(np.int64)), [names.index(x) for x in rows["lang"]]] = rows["rank"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((names, grams, place))

    def scored(data, offsets):
        names, grams, place = shared.value
        n = len(offsets) - 1
        key, count = _counted(data, offsets)
        row, gram = key >> U64(_CODE), key & U64((1 << _CODE) - 1)
        # by row, falling count, n-gram: in one sort where the counts fit beside both
        if count.max(initial=0) < 1 << 25:
            order = np.sort((row << U64(51)) | ((U64((1 << 25) - 1) - count.astype(U64)) << U64(_CODE)) | gram)
            row, gram = (order >> U64(51)).astype(np.int64), (order & U64((1 << _CODE) - 1)).astype(np.int64)
        else:
            order = np.lexsort((gram, -count, row))
            row, gram = row[order].astype(np.int64), gram[order].astype(np.int64)
        begin = np.searchsorted(row, np.arange(n + 1))
        rank = np.arange(len(row)) - begin[row] + 1
        short = rank <= top
        row, gram, rank = row[short], gram[short], rank[short]
        at = np.minimum(np.searchsorted(grams, gram), max(0, len(grams) - 1))
        at = np.where(grams[at] == gram, at, len(grams)) if len(grams) else np.zeros(len(gram), np.int64)
        many = np.maximum(1, np.bincount(row, minlength=n))
        far = np.empty((n, len(names)))
        for j in range(len(names)):
            p = place[at, j]
            far[:, j] = np.bincount(row, np.where(p < 0, top, np.minimum(top, np.abs(p - rank))), n) / (many * top)
        best = far.argmin(1)
        return best, 1 - far[np.arange(n), best]

    def run(batches):
        names, *_ = shared.value
        for batch in batches:
            letter = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            data, offsets = texts(batch.column(1))
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            if names:
                for lo, hi in _groups(offsets):
                    best[lo:hi], score[lo:hi] = scored(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            known = letter & bool(names)
            lang = [names[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0))], names=["doc_id", "lang_pred", "score"])

    chosen = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.withColumn("letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id: str = "doc_id", fold: int = 5):
    """Whether crc32 of the id as text leaves no remainder by `fold`; false for a null id."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % fold == 0, F.lit(False))
