"""Pairs of rows near one another in an order, by ranges that overlap.

The order is cut at every so many ranks. Each row goes to its own range and, if it is among the first `cap` rows
behind another range's end, to that range too: a halo. So a range has all that its rows can be paired with,
wide columns are shuffled once, and a window that slides over the sorted range makes the pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalume.operators.components import joined, star_of

_ROWS = 4096
#: Pairs that are sent on together.
_SENT = 1 << 16
#: What can be told of a pair.
_PAIR = {"u": "long", "v": "long", "src": "string", "dst": "string"}
_NEVER = np.iinfo(np.int64).min


class Keys(NamedTuple):
    """Ascending keys of an order by time (null first, as the least number) and name."""

    micros: np.ndarray
    names: np.ndarray

    def below(self, micros: np.ndarray, names: np.ndarray, or_equal: bool) -> np.ndarray:
        """How many of the keys are less than each given one, or equal to it. Names are compared only where times are equal."""
        low, high = np.searchsorted(self.micros, micros), np.searchsorted(self.micros, micros, "right")
        out = low.copy()
        side = "right" if or_equal else "left"
        for a, b in {*zip(low[low < high].tolist(), high[low < high].tolist(), strict=True)}:
            some = np.flatnonzero((low == a) & (high == b))
            out[some] = a + np.searchsorted(self.names[a:b], names[some], side)
        return out


class Ranges(NamedTuple):
    """Where each range begins, the last key of its halo, and the rank of its first row."""

    first: Keys
    halo: Keys
    base: np.ndarray


def _keys(rows) -> Keys:
    return Keys(np.array([_NEVER if r.micros is None else r.micros for r in rows], np.int64), np.array([r["uuid"] or "" for r in rows], object))


def ranges(ranked: DataFrame, cap: int, size: int | None = None) -> Ranges:
    """Ranges of about `size` rows of ranked(uuid, date, rank), and their halos of `cap` rows. The driver gets two keys a range."""
    rows = ranked.select("uuid", F.unix_micros("date").alias("micros"), "rank")
    if size is None:
        size = max(8 * cap, min(1 << 17, rows.count() // (4 * ranked.sparkSession.sparkContext.defaultParallelism) + 1))
    cuts = rows.where(F.col("rank") % size == 0).select("uuid", "micros").distinct()
    begin = rows.join(F.broadcast(cuts.select(F.col("uuid").alias("_u"), F.col("micros").alias("_m"))), F.col("uuid").eqNullSafe(F.col("_u")) & F.col("micros").eqNullSafe(F.col("_m")))
    # rows of equal keys lie in one range, so it begins with the first of them
    found = begin.groupBy("uuid", "micros").agg(F.min("rank").alias("rank")).orderBy("rank").collect()
    base = np.array([r["rank"] for r in found], np.int64)
    wanted = ranked.sparkSession.createDataFrame([(int(b) + cap - 1,) for b in base[1:]], "rank long")
    last = {r["rank"]: r for r in rows.join(F.broadcast(wanted), "rank").collect()}
    ends = [last[b + cap - 1] for b in base[1:].tolist() if b + cap - 1 in last]
    halo = _keys(ends)
    open_ = max(0, len(base) - len(ends))  # the last range, and those whose halo takes all that is left
    return Ranges(_keys(found), Keys(np.r_[halo.micros, np.full(open_, np.iinfo(np.int64).max)], np.r_[halo.names, np.full(open_, "", object)]), base)


def _micros(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NEVER).to_numpy()


def _names(column: pa.Array) -> np.ndarray:
    return column.fill_null("").to_numpy(zero_copy_only=False)


def _routed(rows: DataFrame, to: Ranges) -> DataFrame:
    """rows(uuid, micros, ...) with _range: a row for the own range and one for each halo it is in, and _own."""
    shared = rows.sparkSession.sparkContext.broadcast(to)

    def run(batches):
        r = shared.value
        for batch in batches:
            micros, names = _micros(batch.column(1)), _names(batch.column(0))
            own = r.first.below(micros, names, True) - 1
            first = np.minimum(r.halo.below(micros, names, False), own)
            many = own - first + 1
            at = np.repeat(np.arange(len(own)), many)
            to_ = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            out = pa.Table.from_batches([batch]).take(pa.array(at))
            yield from out.append_column("_range", pa.array(to_, pa.int64())).append_column("_own", pa.array(to_ == own[at])).combine_chunks().to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, _range long, _own boolean")


def near_pairs(rows: DataFrame, to: Ranges, cap: int, prepare: Callable[[pa.Table], object], related: Callable[[object, np.ndarray, np.ndarray, np.ndarray], np.ndarray], columns: tuple[str, ...] = tuple(_PAIR), stars: bool = False) -> DataFrame:
    """`columns` of (u, v, src, dst), ranks and names of the pairs, at most `cap` ranks apart, that `related` leaves.

    `rows` has uuid, micros and what `prepare` needs, which is called with each window's table. related(window,
    micros, i, j) says which of the pairs of its rows i and j may be kept; it gets all pairs of one distance at a time, and
    returns None once no pair further apart can be kept. With `stars`, a window's pairs become one star for each component of
    them: each of its rows but the first, as the second of a pair, with the first, whether or not the two are a pair themselves.
    """
    shared = rows.sparkSession.sparkContext.broadcast(to)

    def run(batches):
        base = shared.value.base
        held: pa.Table | None = None  # the rows that more partners can follow
        now, place = -1, 0  # the range, and the rank of the first held row
        for batch in batches:
            range_ = batch.column("_range").to_numpy()
            cuts = [0, *(np.flatnonzero(range_[1:] != range_[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for lo in range(a, b, _ROWS):
                    part = pa.Table.from_batches([batch.slice(lo, min(_ROWS, b - lo))])
                    if range_[a] != now:
                        now, held, place = range_[a], None, int(base[range_[a]])
                    old = held.num_rows if held is not None else 0
                    table = (pa.concat_tables([held, part]) if old else part).combine_chunks()
                    yield from pairs_of(table, old, place)
                    keep = min(cap, table.num_rows)
                    place, held = place + table.num_rows - keep, table.slice(table.num_rows - keep)

    def pairs_of(table, old, place):
        window, micros, own = prepare(table), _micros(table.column("micros").combine_chunks()), table.column("_own").to_numpy()
        names = table.column("uuid").combine_chunks()
        kept: list[tuple[np.ndarray, int | np.ndarray]] = []
        root = np.arange(table.num_rows)
        for k in range(1, cap + 1):
            i = np.arange(max(0, old - k), max(0, table.num_rows - k))
            i = i[own[i]]
            if not len(i):
                continue
            keep = related(window, micros, i, i + k)
            if keep is None:
                break
            if stars:
                root = joined(root, i[keep], i[keep] + k)
                continue
            kept.append((i[keep], k))
            if sum(len(x) for x, _ in kept) >= _SENT:
                yield made(names, place, kept)
                kept = []
        if stars:
            node, first = star_of(root)
            kept = [(first, node - first)]
        if any(len(x) for x, _ in kept):
            yield made(names, place, kept)

    def made(names, place, kept):
        i, j = np.concatenate([x for x, _ in kept]), np.concatenate([x + k for x, k in kept])
        have = {"u": lambda: pa.array(place + i), "v": lambda: pa.array(place + j), "src": lambda: names.take(pa.array(i)), "dst": lambda: names.take(pa.array(j))}
        return pa.RecordBatch.from_arrays([have[c]() for c in columns], names=[*columns])

    ready = _routed(rows, to).repartition("_range").sortWithinPartitions("_range", F.asc_nulls_first("micros"), F.asc_nulls_first("uuid"))
    return ready.mapInArrow(run, ", ".join(f"{c} {_PAIR[c]}" for c in columns))
