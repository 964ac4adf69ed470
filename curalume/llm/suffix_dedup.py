"""Exact byte-substring dedup with longest-previous-factor arrays over suffix order.

A byte is removed if a `length`-byte string over it also starts in a document with a smaller id.

Suffixes that agree in their first `length` bytes must meet to be compared. Each such window is keyed by its
least hashed k-byte string (minimiser), so equal windows have one key wherever they stand, and consecutive
windows with one minimiser form a run. About one run for every (length - k + 2) / 2 bytes is shuffled, not one row a byte.
Runs are compared in three steps, each exact:

1. inside an input partition, equal runs are settled at once: all but the one of the smallest document go;
   so a passage that is everywhere is shuffled once for each partition;
2. equal runs of all partitions meet by minimiser, and all but those of the smallest document go; a minimiser
   that very many different runs have is dealt out by window instead, each with its 50 bytes as key;
3. different runs with one minimiser are sorted as suffixes, up to the end of their run's windows. With
   neighbours' common prefixes, the previous and the next suffix of a smaller document in suffix order give the
   longest previous factor of each start; where it reaches `length`, as many bytes are removed.

A text is known by its id and `h`: its hash where an id has several rows, so that different texts of one id are told apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalume.llm.bytes_np import U64, Prefix, mix, signed, texts
from curalume.plans.tables import Scratch, saved

_SLICE = 1 << 20
#: Runs that a task holds before it settles them among themselves.
_HELD = 1_500_000
_LOW = U64((1 << 22) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def runs(data: np.ndarray, offsets: np.ndarray, length: int, k: int, hot: np.ndarray | None = None):
    """(row, key, sig, at) of the runs of window starts that share a minimiser, for all rows.

    key is the minimiser's hash, sig the hash of all bytes of the run's windows. `at` packs the first start (31
    bits), the number of starts (8), 12 bits each of the bytes before and behind the minimiser, which two
    windows that match must agree on at one side (0: the text ends before), and a bit for a minimiser that
    occurs twice in a window. A long row is taken in slices that overlap by a window. Runs of the sorted keys in `hot`
    are taken apart to runs of one window, whose key is the hash of its bytes.
    """
    width, half = length - k + 1, (length - k + 1) // 2
    row, last = 0, len(offsets) - 1
    while row < last:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _SLICE, "right")) - 1)
        a, b = int(offsets[row]), int(offsets[end])
        for lo in range(a, b, _SLICE) if end == row + 1 else (a,):
            hi = min(b, lo + _SLICE + length - 1) if end == row + 1 else b
            if hi - lo >= length:
                yield _slice_runs(data[lo:hi], np.clip(offsets[row : end + 1] - lo, 0, hi - lo), row, lo - offsets[row : end + 1], length, k, width, half, hot)
        row = end


def _slice_runs(part, bounds, row, shift, length, k, width, half, hot):
    p = Prefix(part)
    at = np.arange(len(part) - k + 1)
    h = p.hash(at, at + k)
    left = _sliding_min((h & ~_LOW) | at.astype(U64), width) & _LOW
    right = _LOW - (_sliding_min((h & ~_LOW) | (_LOW - at.astype(U64)), width) & _LOW)
    left = left.astype(np.int64)
    key = h[left]
    start = np.arange(len(key))
    owner = np.searchsorted(bounds, start, "right") - 1
    inside = start + length <= bounds[owner + 1]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    group = np.maximum.accumulate(np.where(new, start, 0))
    new |= (start - group) % width == 0
    cut = np.flatnonzero(new)
    stop = np.r_[cut[1:], len(key)]
    twice = np.add.reduceat((left != right.astype(np.int64)) | np.r_[False, (left[1:] != left[:-1]) & ~new[1:]], cut) > 0
    good = inside[cut]
    cut, stop, twice = cut[good], stop[good], twice[good]
    own, m = owner[cut], left[cut]
    before = np.where(m - half >= bounds[own], _short(p, np.maximum(m - half, 0), m), U64(0))
    behind = np.where(m + k + half <= bounds[own + 1], _short(p, np.minimum(m + k, len(part)), np.minimum(m + k + half, len(part))), U64(0))
    first = (cut + shift[own]).astype(U64)
    packed = (first << U64(33)) | ((stop - cut).astype(U64) << U64(25)) | (before << U64(13)) | (behind << U64(1)) | twice.astype(U64)
    found = own + row, key[cut], p.hash(cut, stop + length - 1), packed
    if hot is None or not len(hot):
        return found
    apart = hot[np.minimum(np.searchsorted(hot, found[1]), len(hot) - 1)] == found[1]
    many = (stop - cut)[apart]
    begin = np.repeat(cut[apart], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    whose = np.repeat(own[apart], many)
    place = ((begin + shift[whose]).astype(U64) << U64(33)) | (U64(1) << U64(25))
    sig = mix(p.hash(begin, begin + length - 1) ^ p.hash(begin + 1, begin + length))
    return tuple(np.concatenate((x[~apart], y)) for x, y in zip(found, (whose + row, p.hash(begin, begin + length), sig, place), strict=True))


def _short(p: Prefix, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return p.hash(start, end) % U64(4095) + U64(1)


def _changed(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans joined where they overlap or touch, by document."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return doc, lo, hi
    # running maximum of ends within a document: documents are told apart by a rank in the high bits
    rank = np.cumsum(_changed(doc)) - 1
    top = np.maximum.accumulate((rank << 32) | hi)
    new = np.ones(len(doc), bool)
    new[1:] = ((rank[1:] << 32) | lo[1:]) > top[:-1]
    cut = np.flatnonzero(new)
    return doc[cut], lo[cut], top[np.r_[cut[1:] - 1, len(doc) - 1]] & 0xFFFFFFFF


def text_key(docs: DataFrame, id: str, text: str) -> Column:
    """What tells the texts of one id apart: their hash; nothing where every id has one row."""
    ids = docs.where(F.col(id).isNotNull()).groupBy(F.col(id).cast("long")).agg(F.count("*").alias("n"))
    return (F.lit(0).cast("long") if ids.where("n > 1").isEmpty() else F.xxhash64(F.col(text).cast("string"))).alias("h")


def merged_by_text(doc: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans joined where they overlap or touch, by document and text."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = _changed(doc, h)
    text, lo, hi = _merged(np.cumsum(new) - 1, lo[order], hi[order])
    return doc[new][text], h[new][text], lo, hi


def _settled(key, sig, doc, h, at):
    """Sorted by key, sig, document, text and place; and which runs have an equal one in a smaller document."""
    order = np.lexsort((at, h, doc, sig, key))
    key, sig, doc, h, at = key[order], sig[order], doc[order], h[order], at[order]
    new = _changed(key, sig)
    return key, sig, doc, h, at, doc > doc[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]


def _spans(doc, h, at, length: int):
    lo = (at >> U64(33)).astype(np.int64)
    return merged_by_text(doc, h, lo, lo + ((at >> U64(25)) & U64(255)).astype(np.int64) + length - 1)


_ROWS = "key long, sig long, doc_id long, h long, at long, lo long, hi long"
_NAMES = ["key", "sig", "doc_id", "h", "at", "lo", "hi"]


def _batch(key, sig, doc, h, at, lo, hi) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if x is None else pa.array(signed(x) if x.dtype == U64 else x, pa.int64()) for x in (key, sig, doc, h, at, lo, hi)], names=_NAMES)


def _settle_locally(held, length: int):
    """Rows of spans that go (key, for dealing out, is the document) and of runs that stay open."""
    key, sig, doc, h, at, gone = _settled(*(np.concatenate(x) for x in zip(*held, strict=True)))
    d, t, lo, hi = _spans(doc[gone], h[gone], at[gone], length)
    yield _batch(mix(d.view(U64)), None, d, t, None, lo, hi)
    for i in range(0, len(gone), 500_000):
        s = slice(i, i + 500_000)
        open_ = ~gone[s]
        yield _batch(key[s][open_], sig[s][open_], doc[s][open_], h[s][open_], at[s][open_], None, None)


def hot_keys(docs: DataFrame, length: int, k: int, crowd: int, one_in: int = 16) -> np.ndarray:
    """Minimisers that more than `crowd` different runs have, or a millionth of all runs if that is more; so they number a million at most.

    They are estimated from one document in `one_in`, by hash: which ones are found decides how runs are dealt out,
    not what is removed, and a crowd that is overlooked is dealt out where its runs meet.
    """

    def run(batches):
        for batch in batches:
            held = [(key, sig) for _, key, sig, _ in runs(*texts(batch.column(0)), length, k)]
            key, sig = (np.concatenate([np.empty(0, U64), *(x[i] for x in held)]) for i in (0, 1))
            order = np.lexsort((sig, key))
            key = key[order][_changed(key[order], sig[order])]
            value, count = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(value)), pa.array(count)], names=["key", "n"])

    some = docs.where("doc_id is not null and text is not null").where(F.pmod(F.xxhash64("doc_id", "h"), F.lit(one_in)) == 0).select("text")
    scratch = Scratch(docs.sparkSession)
    counts = scratch.saved(some.mapInArrow(run, "key long, n long").groupBy("key").agg((F.sum("n") * one_in).alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") > max(crowd, total // 1_000_000)).select("key").toPandas()["key"]
    scratch.close()
    return np.sort(found.to_numpy(np.int64).view(U64))


def local_runs(docs: DataFrame, length: int, k: int, hot: np.ndarray | None = None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            doc, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for row, key, sig, at in runs(*texts(batch.column(1)), length, k, shared.value):
                held.append((key, sig, doc[row], h[row], at))
                size += len(row)
                if size > _HELD:
                    yield from _settle_locally(held, length)
                    held, size = [], 0
        if held:
            yield from _settle_locally(held, length)

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text", "h").mapInArrow(run, _ROWS)


def _meet(of: np.ndarray, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries share key and `of` (not 0) with an entry of another document."""
    out = np.zeros(len(key), bool)
    some = np.flatnonzero(of)
    if not len(some):
        return out
    order = some[np.lexsort((of[some], key[some]))]
    cut = np.flatnonzero(_changed(key[order], of[order]))
    differ = np.minimum.reduceat(doc[order], cut) < np.maximum.reduceat(doc[order], cut)
    out[order] = np.repeat(differ, np.diff(np.r_[cut, len(order)]))
    return out


def meeting_runs(rows: DataFrame, length: int, crowd: int) -> DataFrame:
    """Runs of all partitions by minimiser: spans that go (lo, hi), and open classes (key, doc_id, h, n, places, crowded)."""
    schema = "key long, doc_id long, h long, lo long, hi long, n long, places array<long>, crowded boolean"
    names = ["key", "doc_id", "h", "lo", "hi", "n", "places", "crowded"]

    def spans(doc, h, lo, hi):
        n = len(doc)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(doc, pa.int64()), pa.array(h, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.bool_())], names=names)

    def run(batches):
        held = []
        for batch in batches:
            ready = batch.filter(pc.is_valid(batch.column(5)))
            if ready.num_rows:
                yield spans(*(ready.column(i) for i in (2, 3, 5, 6)))
            open_ = batch.filter(pc.is_null(batch.column(5)))
            if open_.num_rows:
                held.append((*(open_.column(i).to_numpy().view(U64) for i in (0, 1)), *(open_.column(i).to_numpy() for i in (2, 3)), open_.column(4).to_numpy().view(U64)))
        if not held:
            return
        key, sig, doc, h, at, gone = _settled(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield spans(*_spans(doc[gone], h[gone], at[gone], length))
        key, sig, doc, h, at = (x[~gone] for x in (key, sig, doc, h, at))
        cut = np.flatnonzero(_changed(key, sig, h))
        k1, d1, a1 = key[cut], doc[cut], at[cut]
        bits = lambda s: ((a1 >> U64(s)) & U64(0xFFF)).astype(np.int64)
        pick = _meet(bits(13), k1, d1) | _meet(bits(1), k1, d1)
        whole = np.flatnonzero(_changed(k1)) if len(k1) else np.empty(0, np.int64)
        size = np.diff(np.r_[whole, len(k1)])
        differ = np.minimum.reduceat(d1, whole) < np.maximum.reduceat(d1, whole)
        loops = np.maximum.reduceat((a1 & U64(1)).astype(np.int64), whole) > 0
        pick |= np.repeat(differ & loops, size)
        crowded = np.repeat(size > crowd, size)
        many = np.diff(np.r_[cut, len(key)])
        c = np.flatnonzero(pick)
        places = (at[np.repeat(pick, many)] >> U64(33)).astype(np.int64)
        per = many[c]
        n = len(c)
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(k1[c])), pa.array(d1[c], pa.int64()), pa.array(h[cut][c], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(((a1[c] >> U64(25)) & U64(255)).astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)], pa.int32()), pa.array(places)), pa.array(crowded[c])], names=names
        )

    return rows.repartition("key").mapInArrow(run, schema)


def suffixes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes from each start to its stop, filled up with zeros to a common width of whole words, and their sizes."""
    size = stop - start
    wide = -(-int(size.max(initial=1)) // 8) * 8
    buffer = np.concatenate((data, np.zeros(wide, np.uint8)))
    out = np.lib.stride_tricks.sliding_window_view(buffer, wide)[start].copy()
    out[np.arange(wide) >= size[:, None]] = 0
    return out, size


def common_prefixes(suffix: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many bytes each of the sorted suffixes shares with the one before it; 0 for the first."""
    out = np.zeros(len(size), np.int64)
    differ = suffix[1:] != suffix[:-1]
    out[1:] = np.minimum(np.where(differ.any(1), differ.argmax(1), suffix.shape[1]), np.minimum(size[1:], size[:-1]))
    return out


def longest_previous_factors(lcp: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For suffixes in suffix order, the longest prefix shared with a suffix of a smaller document.

    lcp[i] is the common prefix of suffixes i - 1 and i. The longest match of a smaller document is at the
    previous or the next smaller value of `doc` in this order; both are found with a stack.
    """
    n, best = len(doc), [0] * len(doc)
    doc, lcp = doc.tolist(), [*lcp.tolist(), 0]
    for order, ahead in ((range(n), 0), (range(n - 1, -1, -1), 1)):
        stack: list[tuple[int, int]] = []  # a document, and its common prefix with the entry below
        for i in order:
            near = lcp[i + ahead] if stack else 0
            while stack and stack[-1][0] >= doc[i]:
                near = min(near, stack.pop()[1])
            if stack:
                best[i] = max(best[i], near)
            stack.append((doc[i], near if stack else 0))
    return np.array(best, np.int64)


def open_windows(texts_: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """The bytes of each open class: (key, doc_id, h, n, places, content), cut from the whole texts."""
    per_doc = classes.groupBy("doc_id", "h").agg(F.collect_list(F.struct("key", "n", "places")).alias("open"))

    def run(batches):
        for batch in batches:
            data, offsets = texts(batch.column(1))
            opened = batch.column(2)
            many = opened.value_lengths().to_numpy(zero_copy_only=False)
            ids, h = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), many) for i in (0, 3))
            key, n, places = opened.flatten().flatten()
            lo = pc.list_element(places, 0).to_numpy(zero_copy_only=False) + np.repeat(offsets[:-1], many)
            raw = data.tobytes()
            content = [raw[a:b] for a, b in zip(lo.tolist(), (lo + n.to_numpy(zero_copy_only=False) + length - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([key, pa.array(ids, pa.int64()), pa.array(h, pa.int64()), n, places, pa.array(content, pa.binary())], names=["key", "doc_id", "h", "n", "places", "content"])

    return texts_.join(per_doc, ["doc_id", "h"]).select("doc_id", "text", "open", "h").mapInArrow(run, "key long, doc_id long, h long, n long, places array<long>, content binary")


def crowded_runs(windows: DataFrame, length: int) -> DataFrame:
    """Single windows as runs, for minimisers with more classes than one task should sort: dealt out by their whole content."""

    def run(batches):
        for batch in batches:
            data, offsets = texts(batch.column(5))
            n = batch.column(3).to_numpy(zero_copy_only=False)
            places = batch.column(4)
            own = np.repeat(np.arange(len(n)), n)
            j = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            p = Prefix(data)
            start = offsets[own] + j
            key, sig = p.hash(start, start + length), mix(p.hash(start, start + length - 1) ^ p.hash(start + 1, start + length))
            doc, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            copies = places.value_lengths().to_numpy(zero_copy_only=False)
            flat, base = places.flatten().to_numpy(zero_copy_only=False), np.cumsum(copies) - copies
            rep = np.repeat(np.arange(len(own)), copies[own])
            nth = np.arange(len(rep)) - np.repeat(np.cumsum(copies[own]) - copies[own], copies[own])
            lo = flat[base[own[rep]] + nth] + j[rep]
            at = (lo.astype(U64) << U64(33)) | (U64(1) << U64(25))
            if len(rep):
                yield from _settle_locally([(key[rep], sig[rep], doc[own[rep]], h[own[rep]], at)], length)

    return windows.mapInArrow(run, _ROWS)


_PIECE = 150_000


def suffix_order_spans(windows: DataFrame, length: int) -> DataFrame:
    """(doc_id, h, lo, hi) of the longest previous factors of `length` bytes or more, among the classes of each minimiser."""

    def settle(key, doc, h, n, places, data, offsets):
        own = np.repeat(np.arange(len(n)), n)
        j = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        suffix, size = suffixes(data, offsets[own] + j, offsets[own + 1])
        columns = suffix.view(">u8").astype(U64)
        order = np.lexsort((doc[own], size, *columns.T[::-1], key[own]))
        suffix, size, group, d = suffix[order], size[order], key[own][order], doc[own][order]
        lcp = common_prefixes(suffix, size)
        lcp[1:][group[1:] != group[:-1]] = 0
        # a factor of `length` can only end at a neighbour that shares that much: the others need no stack
        near = lcp >= length
        some = np.flatnonzero(near | np.r_[near[1:], False])
        factor = np.zeros(len(order), np.int64)
        factor[some] = longest_previous_factors(np.where(near, lcp, 0)[some], d[some])
        hit = factor >= length
        at, factor = order[hit], factor[hit]
        c, off = own[at], j[at]
        copies = places.value_lengths().to_numpy(zero_copy_only=False)
        flat, base = places.flatten().to_numpy(zero_copy_only=False), np.cumsum(copies) - copies
        rep = np.repeat(np.arange(len(c)), copies[c])
        nth = np.arange(len(rep)) - np.repeat(np.cumsum(copies[c]) - copies[c], copies[c])
        lo = flat[base[c[rep]] + nth] + off[rep]
        return merged_by_text(doc[c[rep]], h[c[rep]], lo, lo + factor[rep])

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks().sort_by("key")
        key = t.column("key").to_numpy()
        n = t.column("n").to_numpy()
        total, cut, i = np.cumsum(n), np.r_[np.flatnonzero(_changed(key)), len(key)], 0
        while i < len(cut) - 1:  # whole minimisers, about _PIECE windows at a time
            done = total[cut[i] - 1] if cut[i] else 0
            j = max(i + 1, int(np.searchsorted(total[cut[1:] - 1], done + _PIECE, "right")))
            j = min(j, len(cut) - 1)
            s = t.slice(cut[i], cut[j] - cut[i]).combine_chunks()
            chunk = s.to_batches()[0]
            found = settle(*(chunk.column(x).to_numpy() for x in range(4)), chunk.column(4), *texts(chunk.column(5)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["doc_id", "h", "lo", "hi"])
            i = j

    return windows.repartition("key").mapInArrow(run, "doc_id long, h long, lo long, hi long")


def suffix_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 50, k: int = 12, crowd: int = 20_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): per row of `docs` the removed byte spans, ascending and maximal, and the bytes left.

    A byte of the UTF-8 text goes if a string of `length` bytes over it also starts in a document with a smaller
    id; strings are judged on the input, overlaps count, and none crosses documents. A null or empty text has no
    bytes and no spans, a text shorter than `length` stays whole. Rows with a null id are kept whole and remove
    nothing. Repeated rows of one id, with equal or different texts, remove nothing from each other, and each loses
    what smaller ids have. Other columns are ignored; an empty table gives no rows.
    `k` is the minimiser's width; `crowd` is how many different runs of one minimiser a task sorts; more
    are dealt out by window instead (see hot_keys). `carry` names columns that come
    along in a struct named carried, and adds kept_text, the bytes left without those of a cut character.
    """
    if not 0 < k < length or length - k + 1 > 255:
        raise ValueError("k must be below length and within 254 of it")
    taken = [F.struct(*carry).alias("carried")] if carry else []
    whole = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), text_key(docs, id, text), *taken)
    met = saved(meeting_runs(local_runs(whole, length, k, hot_keys(whole, length, k, crowd)), length, crowd), "runs")
    dealt = whole.repartition("doc_id")
    classes = met.where("n is not null")
    apart = suffix_order_spans(open_windows(dealt, classes.where("not crowded"), length), length)
    spans = met.where("hi is not null").select("doc_id", "h", "lo", "hi").unionByName(apart)
    if not classes.where("crowded").limit(1).isEmpty():
        dense = meeting_runs(crowded_runs(open_windows(dealt, classes.where("crowded"), length), length), length, 1 << 62)
        spans = spans.unionByName(dense.where("hi is not null").select("doc_id", "h", "lo", "hi"))
    per_doc = spans.groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))

    def cut(batches):
        for batch in batches:
            data, offsets = texts(batch.column(1))
            raw, gone = data.tobytes(), batch.column(2)
            kept, flat, at = [], [], [0]
            for i in range(batch.num_rows):
                a, b = int(offsets[i]), int(offsets[i + 1])
                found = gone[i].values
                if found is None or not len(found):
                    kept.append(raw[a:b])
                else:
                    lo, hi = (x.to_numpy(zero_copy_only=False) for x in found.flatten())
                    _, lo, hi = _merged(np.zeros(len(lo), np.int64), lo, hi)
                    edges = np.r_[0, np.column_stack((lo, hi)).ravel(), b - a] + a
                    kept.append(b"".join(raw[x:y] for x, y in edges.reshape(-1, 2).tolist()))
                    flat.append(np.column_stack((lo, hi)))
                at.append(at[-1] + (0 if found is None or not len(found) else len(lo)))
            both = np.concatenate(flat) if flat else np.empty((0, 2), np.int64)
            spans = pa.StructArray.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans), pa.array(kept, pa.binary()), *batch.columns[3:], *([pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())] if carry else [])], names=["doc_id", "n_bytes", "spans", "kept", "carried", "kept_text"][: 6 if carry else 4])

    joined = dealt.join(per_doc, ["doc_id", "h"], "left").select("doc_id", "text", "gone", *(["carried"] if taken else []))
    carried = f", carried {whole.schema['carried'].dataType.simpleString()}, kept_text string" if taken else ""
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary" + carried)
