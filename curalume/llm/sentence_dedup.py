"""Substring dedup by sliding sentence spans.

Runs of `least` sentences and `min_words` words or more that occur again, in the same or another document, are found
by one join on hashes, and all sentences of any but the first occurrence go. From every sentence the shortest such
span is hashed, and the shortest that ends at it: each sentence of a longer run that repeats is in one of them that
lies in the run, so that both kinds find all that the longer runs would. Equal spans of one input partition are settled
there, so a span that is everywhere is shuffled once for each partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalume.llm.bytes_np import LOWER, NOT_SPACE, U64, Words, mix, row_groups, signed, span_hashes, texts, words
from curalume.llm.suffix_dedup import _changed, _merged, merged_by_text, text_key

_HELD = 1_500_000
_STOP = np.zeros(256, bool)
_STOP[[*b".!?"]] = True
#: Ends of sentences in other scripts, which need no space behind them.
_MARKS = [x.encode() for x in "。！？｡؟۔।॥"]
_B = 0x2545F4914F6CDD1D


def _marked(data: np.ndarray) -> np.ndarray:
    """Whether a byte is the last one of an end mark of another script."""
    out = np.zeros(len(data), bool)
    for m in _MARKS:
        at = np.flatnonzero(data[len(m) - 1 :] == m[-1])
        for k, byte in enumerate(m[:-1]):
            at = at[data[at + k] == byte]
        out[at + len(m) - 1] = True
    return out


def _unspaced(data: np.ndarray) -> np.ndarray:
    """Whether a byte begins a character of a script that is written without spaces: ideographs, kana, Thai, Lao, Khmer, Burmese."""
    after = np.r_[data[1:], np.zeros(min(1, len(data)), np.uint8)]
    return ((data >= 0xE3) & (data <= 0xE9)) | ((data == 0xE0) & (after >= 0xB8) & (after <= 0xBB)) | ((data == 0xE1) & ((after >= 0x9E) & (after <= 0x9F) | (after >= 0x80) & (after <= 0x82)))


def sentences(data: np.ndarray, offsets: np.ndarray):
    """Words, the index of the first word of each sentence, and how many words each word counts for.

    A sentence ends behind a word that ends in . ! or ?, behind an end mark of another script, at a line end, and at
    the row's end. Such a mark also ends a word. Two characters of a script without spaces count as a word.
    """
    w = words(data, offsets, NOT_SPACE, LOWER)
    marked, counts = np.zeros(len(data), bool), np.ones(len(w.start), np.int64)
    if len(data) and data.max() >= 0xD8:
        marked = _marked(data)
        after = np.flatnonzero(marked) + 1
        after = after[np.searchsorted(w.start, after, "left") != np.searchsorted(w.end, after, "right")]  # inside a word
        if len(after):
            start, end = np.sort(np.r_[w.start, after]), np.sort(np.r_[w.end, after])
            w = Words(start, end, np.searchsorted(start, offsets), span_hashes(data, start, end, LOWER))
        wide = np.r_[0, np.cumsum(_unspaced(data))]
        counts = np.maximum(1, (wide[w.end] - wide[w.start] + 1) // 2)
    n = len(w.start)
    if not n:
        return w, np.empty(0, np.int64), counts
    lines = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=lines[1:])
    begin = np.ones(n, bool)
    begin[1:] = _STOP[data[w.end[:-1] - 1]] | marked[w.end[:-1] - 1] | (lines[w.start[1:]] > lines[w.end[:-1]])
    begin[w.first[:-1][w.first[:-1] < n]] = True
    return w, np.flatnonzero(begin), counts


def spans(data: np.ndarray, offsets: np.ndarray, least: int, min_words: int):
    """(row, key, sig, index of the first sentence in its row, sentences) of each span, and the sentences of each row."""
    w, first, counts = sentences(data, offsets)
    end = np.r_[first[1:], len(w.start)]
    so_far = np.r_[0, np.cumsum(counts)]
    before, behind = so_far[first], so_far[end]  # words up to each sentence and with it
    row = np.searchsorted(w.first, first, "right") - 1
    many = np.bincount(row, minlength=len(offsets) - 1)
    base = np.cumsum(many) - many
    every = np.arange(len(first))
    last = np.maximum(every + least - 1, np.searchsorted(behind, before + min_words))  # of the shortest span from each sentence
    ok = last < (base + many)[row]
    i, last = every[ok], last[ok]
    to = np.minimum(every - least + 1, np.searchsorted(before, behind - min_words, "right") - 1)  # first of the shortest span up to each
    ok = to >= base[row]
    both = np.unique(np.r_[i, to[ok]] * (len(first) + 1) + np.r_[last, every[ok]])
    i, last = both // (len(first) + 1), both % (len(first) + 1)
    row = row[i]
    up = np.full(len(w.hash) + 1, _B, U64)
    down = np.full(len(w.hash) + 1, pow(_B, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    out = []
    for salt in (0, 0x94D049BB133111EB):
        total = np.zeros(len(w.hash) + 1, U64)
        np.cumsum(mix(w.hash ^ U64(salt)) * up[:-1], out=total[1:])
        out.append(mix((total[end[last]] - total[first[i]]) * down[first[i]] + (end[last] - first[i]).astype(U64)))
    return (row, *out, i - base[row], last - i + 1), many


_NAMES = ["key", "sig", "doc_id", "h", "at", "n", "lo", "hi"]
_ROWS = "key long, sig long, doc_id long, h long, at long, n long, lo long, hi long"


def _rows(key, sig, doc, h, at, n, lo, hi) -> pa.RecordBatch:
    size = len(doc)
    return pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()) if x is None else pa.array(signed(x) if x.dtype == U64 else x, pa.int64()) for x in (key, sig, doc, h, at, n, lo, hi)], names=_NAMES)


def _settle(held):
    """Spans by content: the sentences that go, and the first span of each content. Equal rows are one."""
    key, sig, doc, h, at, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((at, h, doc, sig, key))
    key, sig, doc, h, at, n = (x[order] for x in (key, sig, doc, h, at, n))
    first = _changed(key, sig)
    lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    gone = ~first & ((doc != doc[lead]) | (h != h[lead]) | (at != at[lead]))
    return merged_by_text(doc[gone], h[gone], at[gone], at[gone] + n[gone]), tuple(x[first] for x in (key, sig, doc, h, at, n))


def repeated_sentences(docs: DataFrame, least: int, min_words: int) -> DataFrame:
    """(doc_id, h, lo, hi): sentences lo to hi - 1 of a text are in a span that occurred before. `docs` has doc_id, text, h."""

    def local(batches):
        held, size = [], 0

        def settled():
            (d, h, lo, hi), first = _settle(held)
            yield _rows(mix(d.view(U64)), None, d, h, None, None, lo, hi)
            for i in range(0, len(first[0]), 500_000):
                yield _rows(*(x[i : i + 500_000] for x in first), None, None)

        for batch in batches:
            doc, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            data, offsets = texts(batch.column(1))
            for a, b in row_groups(offsets):
                (row, key, sig, at, n), _ = spans(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], least, min_words)
                held.append((key, sig, doc[a + row], h[a + row], at, n))
                size += len(row)
                if size > _HELD:
                    yield from settled()
                    held, size = [], 0
        if held:
            yield from settled()

    def meet(batches):
        held = []
        for batch in batches:
            gone = batch.filter(batch.column(6).is_valid())
            yield gone.select(["doc_id", "h", "lo", "hi"])
            open_ = batch.filter(batch.column(6).is_null())
            if open_.num_rows:
                c = [open_.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
                held.append((c[0].view(U64), c[1].view(U64), *c[2:]))
        if held:
            found, _ = _settle(held)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["doc_id", "h", "lo", "hi"])

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text", "h").mapInArrow(local, _ROWS).repartition("key").mapInArrow(meet, "doc_id long, h long, lo long, hi long")


def sentence_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 2, min_words: int = 12) -> DataFrame:
    """(doc_id, n_sentences, removed, kept): per row of `docs` the removed runs of sentences (start, end), maximal and ascending, and the text left.

    Sentences end at . ! or ? before white space, at the end marks of other scripts and at line ends. They are
    compared by their words, A-Z lower-cased, whatever the white space between; the first span is
    the one of the least id, and in it the earliest. A sentence takes its white space up to the next one with it.
    Every run of `least` sentences and `min_words` words that repeats goes whole; shorter ones, which many clean
    texts share by chance, stay (1 takes every run); of scripts without spaces, two characters count as a word. A null or empty text has no
    sentences; a text shorter than a span loses nothing. Rows with a null id stay whole and remove nothing. Equal rows
    are one text, and each of them loses the same; of different texts of one id, that of the least hash comes first.
    Other columns are ignored; an empty table gives no rows.
    """
    whole = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), text_key(docs, id, text))
    gone = repeated_sentences(whole, least, min_words).groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))

    def cut(batches):
        for batch in batches:
            data, offsets = texts(batch.column(1))
            raw = data.tobytes()
            kept, total, flat, at = [], [], [], [0]
            for a, b in row_groups(offsets):
                base = int(offsets[a])
                part = offsets[a : b + 1] - base
                w, first, _ = sentences(data[base : offsets[b]], part)
                per = np.searchsorted(first, w.first)
                for r in range(b - a):
                    lo_byte, hi_byte = int(part[r]) + base, int(part[r + 1]) + base
                    n = int(per[r + 1] - per[r])
                    total.append(n)
                    found = batch.column(2)[a + r].values
                    if found is None or not len(found):
                        kept.append(raw[lo_byte:hi_byte])
                    else:
                        lo, hi = (x.to_numpy(zero_copy_only=False) for x in found.flatten())
                        _, lo, hi = _merged(np.zeros(len(lo), np.int64), lo, np.minimum(hi, n))
                        start = np.r_[w.start[first[per[r] : per[r + 1]]] + base, hi_byte]
                        edges = np.r_[lo_byte, np.column_stack((start[lo], start[hi])).ravel(), hi_byte].reshape(-1, 2)
                        kept.append(b"".join(raw[x:y] for x, y in edges.tolist()))
                        flat.append(np.column_stack((lo, hi)))
                    at.append(at[-1] + (0 if found is None or not len(found) else len(lo)))
            both = np.concatenate(flat) if flat else np.empty((0, 2), np.int64)
            runs = pa.StructArray.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), runs), pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())], names=["doc_id", "n_sentences", "removed", "kept"])

    return whole.join(gone, ["doc_id", "h"], "left").select("doc_id", "text", "gone").mapInArrow(cut, "doc_id long, n_sentences long, removed array<struct<start:long,end:long>>, kept string")
