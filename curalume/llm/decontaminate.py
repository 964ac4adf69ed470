"""Benchmark decontamination as a prefix-filtered set join over item-sized windows.

A document is hit where a whole window of an item stands in it. Containment of all shingles of a window makes
one of them a sufficient prefix: the rarest in the corpus. Documents are scanned for those shingles only; the
shingle's place in the window and the document's bounds fix the one place where the window can start, and its
words are compared there, byte by byte. The scan needs no shuffle. Windows are broadcast in blocks of a fixed size, each
joined with all documents, so that a benchmark of any size fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalume.llm.bytes_np import ALNUM, LOWER, U64, grams, row_groups, signed, texts, words
from curalume.plans.tables import Scratch, saved


def _lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 0x41) & (data <= 0x5A), data + 0x20, data).astype(np.uint8)


def _equal_spans(x: np.ndarray, start: np.ndarray, end: np.ndarray, y: np.ndarray, other: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether the bytes of x in each span are those of y in the other one; no span is empty."""
    out = end - start == stop - other
    some = np.flatnonzero(out)
    if len(some):
        n = (end - start)[some]
        base = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(base, n)
        out[some] = np.logical_and.reduceat(x[np.repeat(start[some], n) + step] == y[np.repeat(other[some], n) + step], base)
    return out


def item_windows(items: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """(w, items): each distinct window of `size` words, lower-cased, and the items it is in; a shorter item is one window."""

    def run(batches):
        for batch in batches:
            data, offsets = texts(batch.column(1))
            x = words(data, offsets, ALNUM, LOWER)
            raw = _lowered(data).tobytes()
            word = [raw[s:e].decode() for s, e in zip(x.start.tolist(), x.end.tolist(), strict=True)]
            own, rows = [], []
            for i, (a, b) in enumerate(zip(x.first[:-1].tolist(), x.first[1:].tolist(), strict=True)):
                for s in range(a, max(a + 1, b - size + 1)) if b > a else ():
                    own.append(i)
                    rows.append(word[s : min(s + size, b)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array(rows, pa.list_(pa.string()))], names=["item", "w"])

    found = items.select(F.col(id).cast("string").alias("item"), text).where("item is not null").mapInArrow(run, "item string, w array<string>")
    return found.groupBy("w").agg(F.sort_array(F.collect_set("item")).alias("items"))


class _Block:
    """The windows of one block with their shingles; `rarest` leaves one shingle for each window."""

    def __init__(self, rows, shingle: int):
        self.data, offsets = texts(pa.array([" ".join(r.w) for r in rows], pa.string()))
        self.start, self.end, self.at, self.flat = words(self.data, offsets, ALNUM, LOWER)
        w = [self.flat[a:b] for a, b in zip(self.at[:-1], self.at[1:], strict=True)]
        self.items = [list(r["items"]) for r in rows]
        self.size = np.diff(self.at)
        self.widths = sorted({min(shingle, len(x)) for x in w})
        g = [grams(x, min(shingle, len(x))) for x in w]
        self.window = np.repeat(np.arange(len(w)), [len(x) for x in g])
        self.place = np.concatenate([np.arange(len(x)) for x in g]) if g else np.empty(0, np.int64)
        self.token = np.concatenate(g) if g else np.empty(0, U64)
        self._index()

    def _index(self):
        order = np.argsort(self.token, kind="stable")
        self.window, self.place, self.token = self.window[order], self.place[order], self.token[order]
        self.distinct, self.begin = np.unique(self.token, return_index=True)
        self.begin = np.r_[self.begin, len(self.token)]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.distinct >> U64(44)).astype(np.int64)] = True

    def rarest(self, count: dict[int, int]):
        seen = np.array([count.get(t, 0) for t in signed(self.token).tolist()], np.int64)
        order = np.lexsort((self.token, seen, self.window))
        first = order[np.r_[True, self.window[order][1:] != self.window[order][:-1]]] if len(order) else order
        self.window, self.place, self.token = self.window[first], self.place[first], self.token[first]
        self._index()

    def found(self, hashes: np.ndarray):
        """(position, index of the distinct token) of each of its tokens in a run of words; shingles may cross rows."""
        for n in self.widths:
            g = grams(hashes, n)
            at = np.flatnonzero(self.maybe[(g >> U64(44)).astype(np.int64)])
            i = np.minimum(np.searchsorted(self.distinct, g[at]), max(0, len(self.distinct) - 1))
            hit = self.distinct[i] == g[at] if len(self.distinct) else np.zeros(len(at), bool)
            yield at[hit], i[hit]


def _counts(docs: DataFrame, text: str, block: _Block) -> dict[int, int]:
    """How often each shingle of the block occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        b = shared.value
        total = np.zeros(len(b.distinct), np.int64)
        for batch in batches:
            data, offsets = texts(batch.column(0))
            for lo, hi in row_groups(offsets):
                x = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM, LOWER)
                for _, i in b.found(x.hash):
                    total += np.bincount(i, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(signed(b.distinct[some])), pa.array(total[some])], names=["token", "n"])

    return {r.token: r.n for r in docs.select(text).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}


def _found(batch: pa.RecordBatch, b: _Block) -> pa.RecordBatch:
    """(row, doc_id, n_words, spans, items) per row of a batch (row, doc_id, text)."""
    data, offsets = texts(batch.column(2))
    n_words, spans, span_at, items = [], [], [0], []
    for lo, hi in row_groups(offsets):
        x = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM, LOWER)
        n_words.append(np.diff(x.first))
        starts, wins = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at, i in b.found(x.hash):
            many = b.begin[i + 1] - b.begin[i]
            e = np.repeat(b.begin[i], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            start, win = np.repeat(at, many) - b.place[e], b.window[e]
            row = np.searchsorted(x.first, np.repeat(at, many), "right") - 1
            fits = (start >= x.first[row]) & (start + b.size[win] <= x.first[row + 1])
            start, win = start[fits], win[fits]
            for j in range(int(b.size[win].max()) if len(win) else 0):  # one word of all windows at a time
                short = j >= b.size[win]
                same = short | (x.hash[np.minimum(start + j, len(x.hash) - 1)] == b.flat[np.minimum(b.at[win] + j, len(b.flat) - 1)])
                start, win = start[same], win[same]
            starts.append(start)
            wins.append(win)
        start, win = np.concatenate(starts), np.concatenate(wins)
        if len(start):  # equal hashes can only be trusted to leave out, so the words themselves are compared
            low, same = _lowered(data[offsets[lo] : offsets[hi]]), np.ones(len(start), bool)
            for j in range(int(b.size[win].max())):
                at = np.flatnonzero(j < b.size[win])
                d, i = start[at] + j, b.at[win[at]] + j
                same[at] &= _equal_spans(low, x.start[d], x.end[d], b.data, b.start[i], b.end[i])
            start, win = start[same], win[same]
        order = np.argsort(start, kind="stable")
        start, win = start[order], win[order]
        row = np.searchsorted(x.first, start, "right") - 1
        cut = np.searchsorted(row, np.arange(hi - lo + 1))
        for r, (p, q) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            merged: list[list[int]] = []
            for s, t in zip((start[p:q] - x.first[r]).tolist(), (start[p:q] - x.first[r] + b.size[win[p:q]]).tolist(), strict=True):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], t)
                else:
                    merged.append([s, t])
            spans += merged
            span_at.append(len(spans))
            items.append(sorted({i for k in set(win[p:q].tolist()) for i in b.items[k]}))
    both = np.array(spans, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            batch.column(1),
            pa.array(np.concatenate(n_words) if n_words else np.empty(0, np.int64), pa.int64()),
            pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), pa.StructArray.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["start", "end"])),
            pa.array(items, pa.list_(pa.string())),
        ],
        names=["row", "doc_id", "n_words", "spans", "items"],
    )


def _hits(rows: DataFrame, block: _Block) -> DataFrame:
    """(row, doc_id, n_words, spans, items) per row of `rows`, (row, doc_id, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        for batch in batches:
            yield _found(batch, shared.value)

    return rows.mapInArrow(run, "row long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def _blocks(windows: DataFrame, docs: DataFrame, n: int, shingle: int) -> Iterator[_Block]:
    """The windows in n blocks, each window with its rarest shingle in docs(text)."""
    for i in range(n):
        block = _Block(windows.where(F.pmod(F.xxhash64("w"), F.lit(n)) == i).collect(), shingle)
        block.rarest(_counts(docs, "text", block))
        yield block


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, shingle: int = 3, block_windows: int = 250_000) -> DataFrame:
    """The rows of `docs` that decontaminated finds no window in, with all their columns: each is judged by itself, whatever its id.

    With one block of windows rows are judged where they lie, and nothing is shuffled. With more, rows are written once with a
    number, judged by one block after another, and those with a hit are taken out by that number.
    """
    scratch = Scratch(docs.sparkSession)
    windows = scratch.saved(item_windows(items, item_id, item_text, size), "windows")
    n = max(1, -(-windows.count() // block_windows))
    texts_ = docs.select(F.col(text).cast("string").alias("text"))
    if n == 1:
        out = _where_hit(docs, text, next(_blocks(windows, texts_, 1, shingle)), False)
        scratch.close()
        return out
    number = "row"
    while number in docs.columns:
        number += "_"
    rows = saved(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    judged = rows.select(number, F.col(text).cast("string").alias("text" if number != "text" else "words"))
    hit = None
    for block in _blocks(windows, texts_, n, shingle):
        found = scratch.saved(_where_hit(judged, judged.columns[1], block, True).select(number), "hit")
        hit = found if hit is None else hit.unionByName(found)
    hit = saved(hit.distinct(), "hit")
    scratch.close()
    return rows.join(hit, number, "left_anti").select(*docs.columns)


def _where_hit(rows: DataFrame, text: str, block: _Block, hit: bool) -> DataFrame:
    """The rows whose text has a window of the block, or those whose text has none."""
    shared, at = rows.sparkSession.sparkContext.broadcast(block), rows.columns.index(text)

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            none = pa.nulls(len(column), pa.int64())
            found = _found(pa.RecordBatch.from_arrays([none, none, column], names=["row", "doc_id", "text"]), shared.value)
            yield batch.filter(pc.equal(pc.greater(pc.list_value_length(found.column(3)), 0), hit))

    return rows.mapInArrow(run, rows.schema)


def decontaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, shingle: int = 3, block_windows: int = 250_000) -> DataFrame:
    """(doc_id, n_words, spans, items) per row of `docs`: word spans covered by a window of an item, maximal and ascending, and those items as sorted strings.

    Words are runs of ASCII letters and digits and of any non-ASCII characters, A-Z lower-cased. A window is
    `size` consecutive words of an item; an item of fewer words, but not none, is one window. Null, empty and
    wordless texts on either side hit nothing; items with a null id are left out, repeated item rows count as
    one item. Rows of `docs` are judged by themselves, whatever their id, and other columns are ignored; an
    empty benchmark hits nothing, an empty table gives no rows. With more than `block_windows` windows the
    documents are written once with a number for each row and joined with one block after another, and the blocks'
    findings are merged by that number.
    """
    scratch = Scratch(docs.sparkSession)
    windows = scratch.saved(item_windows(items, item_id, item_text, size), "windows")
    n = max(1, -(-windows.count() // block_windows))
    rows = docs.select((F.monotonically_increasing_id() if n > 1 else F.lit(0).cast("long")).alias("row"), F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if n > 1:
        rows = saved(rows, "rows")
    parts = [_hits(rows, block) for block in _blocks(windows, rows, n, shingle)]
    scratch.close()
    if n == 1:
        return parts[0].drop("row")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    joined = every.groupBy("row").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merge = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )
    return joined.select("doc_id", "n_words", merge.alias("spans"), "items")
