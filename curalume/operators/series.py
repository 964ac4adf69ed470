"""Series of photos: a band join over time with a rank cap, components, the best of each, and what can go."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curalume.functions.vectors import abs_seconds, cosine, hamming
from curalume.operators.components import components_by_roots, star_contraction
from curalume.operators.halo import near_pairs, ranges
from curalume.operators.ranks import with_rank, with_rank_within
from curalume.plans.tables import saved


@dataclass(frozen=True)
class SeriesRules:
    seconds: float = 60.0
    cosine: float = 0.85
    bits: int = 10
    close_seconds: float = 5.0
    cap: int = 99


def with_global_rank(photos: DataFrame, rank: str = "rank") -> DataFrame:
    """photos with their position from 0 by date (null first) and uuid; photos without a date and those of one instant are split too."""
    return with_rank(photos, F.asc_nulls_first("date"), F.asc_nulls_first("uuid"), name=rank)


def are_related(a: str, b: str, rules: SeriesRules, features: bool, phash: bool) -> Column:
    """Whether two photos (struct columns a and b) belong together: too far in time never; alike in features or hash, or within a few seconds, yes."""
    dated = F.col(f"{a}.date").isNotNull() & F.col(f"{b}.date").isNotNull()
    apart = abs_seconds(f"{a}.date", f"{b}.date")
    alike = F.lit(False)
    if features:
        alike = alike | F.coalesce(cosine(f"{a}.features", f"{b}.features") >= rules.cosine, F.lit(False))
    if phash:
        alike = alike | F.coalesce(hamming(f"{a}.phash", f"{b}.phash") <= rules.bits, F.lit(False))
    return ~F.coalesce(dated & (apart > rules.seconds), F.lit(False)) & (alike | F.coalesce(dated & (apart <= rules.close_seconds), F.lit(False)))


def _looks(photos: DataFrame) -> tuple[bool, bool]:
    return "features" in photos.columns, "phash" in photos.columns


class _Looks(NamedTuple):
    """Features and hashes of a window's photos; rows of `valid` can be compared if their widths are equal."""

    run: np.ndarray
    features: np.ndarray | None = None
    width: np.ndarray | None = None
    valid: np.ndarray | None = None
    norm: np.ndarray | None = None
    bits: np.ndarray | None = None
    hashed: np.ndarray | None = None

    def alike(self, i: np.ndarray, j: np.ndarray, rules: SeriesRules) -> np.ndarray:
        out = np.zeros(len(i), bool)
        if self.features is not None:
            length = self.norm[i] * self.norm[j]
            dot = np.einsum("ij,ij->i", self.features[i], self.features[j])
            cosine_ = np.where(length == 0, 0.0, dot / np.where(length == 0, 1.0, length))
            out |= self.valid[i] & self.valid[j] & (self.width[i] == self.width[j]) & (cosine_ >= rules.cosine)
        if self.bits is not None:
            out |= self.hashed[i] & self.hashed[j] & (np.bitwise_count(self.bits[i] ^ self.bits[j]) <= rules.bits)
        return out


def _matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows padded to one width, their widths, and whether they are arrays without null."""
    width = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    flat = column.flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), width)
    out = np.zeros((len(column), int(width.max(initial=0))))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)] = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    valid[row[~known]] = False
    return out, width, valid


def rank_pairs(photos: DataFrame, ranked: DataFrame, rules: SeriesRules = SeriesRules(), between_runs: bool = False, range_rows: int | None = None, columns: tuple[str, ...] = ("u", "v", "src", "dst"), stars: bool = False) -> DataFrame:
    """`columns` of (u, v, src, dst): ranks and uuids of related photos, the first before the second and at most `cap` apart.

    `ranked` has uuid, date and rank of the photos. Photos go to ranges of ranks, those behind a range's end also to
    that one, and are compared in a window that slides over each: features are shuffled once. between_runs leaves
    out pairs that steps of the close time connect already; stars leaves, in place of a window's pairs, as few as connect the same photos.
    """
    features, phash = _looks(photos)
    bits = F.conv(F.nullif("phash", F.lit("")), 16, -10).cast("long").alias("bits") if phash else None
    rows = photos.select(F.col("uuid").cast("string").alias("uuid"), F.unix_micros(F.col("date").cast("timestamp")).alias("micros"), *(["features"] if features else []), *([bits] if phash else []))
    step = min(rules.close_seconds, rules.seconds) * 1e6

    def prepare(table: pa.Table) -> _Looks:
        column = lambda c: table.column(c).combine_chunks()
        micros, undated = (f(column("micros")) for f in (lambda c: c.fill_null(0).to_numpy(), lambda c: c.is_null().to_numpy(zero_copy_only=False)))
        apart = np.r_[True, (np.diff(micros) > step) | undated[1:] | undated[:-1]][: len(micros)]
        found = _Looks(np.cumsum(apart))
        if features:
            m, width, valid = _matrix(column("features"))
            found = found._replace(features=m, width=width, valid=valid, norm=np.sqrt((m**2).sum(1)))
        if phash:
            found = found._replace(bits=column("bits").fill_null(0).to_numpy().view(np.uint64), hashed=column("bits").is_valid().to_numpy(zero_copy_only=False))
        return found

    def related(looks: _Looks, micros: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray | None:
        undated = np.iinfo(np.int64).min
        dated = (micros[i] != undated) & (micros[j] != undated)
        apart = np.where(dated, micros[j] - np.where(dated, micros[i], micros[j]), 0)
        far = dated & (apart > rules.seconds * 1e6)
        if far.all() and micros[0] != undated:
            return None
        keep = dated & (apart <= rules.close_seconds * 1e6) & ~far
        open_ = ~far & ~keep
        if between_runs:
            new = looks.run[i] != looks.run[j]
            keep, open_ = keep & new, open_ & new
        some = np.flatnonzero(open_)
        keep[some] = looks.alike(i[some], j[some], rules)
        return keep

    return near_pairs(rows, ranges(ranked, rules.cap, range_rows), rules.cap, prepare, related, columns, stars)


def _ranks(photos: DataFrame) -> DataFrame:
    return with_global_rank(photos.select(F.col("uuid").cast("string").alias("uuid"), F.col("date").cast("timestamp").alias("date")))


def series_pairs(photos: DataFrame, rules: SeriesRules = SeriesRules()) -> DataFrame:
    """(src, dst): related photos at most `cap` ranks apart, src before dst in rank. Needs uuid and date; features and phash count where the table has them."""
    return rank_pairs(photos, _ranks(photos), rules, columns=("src", "dst"))


def linked_ranks(photos: DataFrame, ranked: DataFrame, rules: SeriesRules = SeriesRules()) -> DataFrame:
    """(u, v): ranks of photos that connect the same photos as series_pairs, a row or so a photo where pairs can be `cap`. `ranked` as in rank_pairs."""
    return rank_pairs(photos, ranked, rules, columns=("u", "v"), stars=True)


def with_runs(ranked: DataFrame, gap: float, bucket: int = 1 << 17) -> DataFrame:
    """ranked with run: the least rank of the photos that steps of at most `gap` seconds connect, from one rank to the next; a photo without a date is alone.

    Ranks are taken in buckets, each with the last date and the last start of a run of those before it from a small table.
    """
    b = F.floor(F.col("rank") / bucket)
    order = W.partitionBy("_b").orderBy("rank")
    rows = ranked.withColumn("_b", b)
    last = rows.groupBy((F.col("_b") + 1).alias("_b")).agg(F.max_by("date", "rank").alias("_last"))
    before = F.when(F.row_number().over(order) == 1, F.col("_last")).otherwise(F.lag("date").over(order))
    apart = F.coalesce(F.unix_micros("date") - F.unix_micros("_before") > int(gap * 1_000_000), F.lit(True))
    starts = rows.join(last, "_b", "left").withColumn("_before", before).withColumn("_start", F.when(apart, F.col("rank")))
    open_ = starts.groupBy("_b").agg(F.max("_start").alias("_latest"))
    carried = open_.select("_b", F.max("_latest").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    run = F.coalesce(F.max("_start").over(order.rowsBetween(W.unboundedPreceding, 0)), "_carried")
    return starts.join(carried, "_b").withColumn("run", run).drop("_b", "_last", "_before", "_start", "_carried")


def close_time_runs(photos: DataFrame, gap: int = 5) -> DataFrame:
    """(run_start, run_end, n): runs of photos at most `gap` seconds from one to the next, the last gap included."""
    runs = photos.where("date is not null").groupBy(F.session_window("date", f"{gap} seconds")).agg(F.min("date").alias("run_start"), F.max("date").alias("run_end"), F.count("*").alias("n"))
    return runs.select("run_start", "run_end", "n")


def connected_components(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(uuid, component): the least rank of each photo's component; photos without a pair are their own.

    `vertices` has uuid and rank, `pairs` the ranks u and v, as linked_ranks makes them, or src and dst. Those are joined
    with the ranks, so all pairs are shuffled twice, with a hint: Spark takes pairs made in Python for no larger than the
    photos they come from and would send them all through the driver.
    """
    number = vertices.select("uuid", "rank")
    if {"u", "v"} <= {*pairs.columns}:
        found = components_by_roots(pairs, "u", "v")
    else:
        edges = pairs
        for end, rank in (("src", "u"), ("dst", "v")):
            edges = edges.join(number.select(F.col("uuid").alias(end), "rank").hint("merge"), end).withColumnRenamed("rank", rank)
        found = star_contraction(edges.select("u", "v"), "u", "v")
    found = found.withColumnRenamed("node", "rank").hint("merge")
    return number.join(found, "rank", "left").select("uuid", "rank", F.coalesce("component", "rank").alias("component"))


def series_components(photos: DataFrame, rules: SeriesRules = SeriesRules()) -> DataFrame:
    """(uuid, rank, component) as connected_components of series_pairs.

    Photos a few seconds apart belong together whatever they look like, so runs of them need no pairs; only runs
    that photos alike in look connect are joined as a graph, and without looks there is none.
    """
    runs = saved(with_runs(_ranks(photos), min(rules.close_seconds, rules.seconds)), "runs")
    if not any(_looks(photos)):
        return runs.select("uuid", "rank", F.col("run").alias("component"))
    pairs = rank_pairs(photos, runs, rules, between_runs=True, columns=("u", "v"), stars=True)
    for end in "uv":
        pairs = pairs.join(runs.select(F.col("rank").alias(end), F.col("run").alias(f"{end}_run")).hint("merge"), end)
    found = star_contraction(pairs.select("u_run", "v_run").distinct(), "u_run", "v_run").withColumnRenamed("node", "run")
    return runs.select("uuid", "rank", "run").join(found, "run", "left").select("uuid", "rank", F.coalesce("component", "run").alias("component"))


def series_ids(components: DataFrame, bucket: int = 1 << 20) -> DataFrame:
    """(uuid, series_id): dense ids from 0 in the order of each component's first member.

    A component is named by its least rank, so heads are numbered inside rank buckets whose sizes are summed up.
    """
    heads = components.where("rank = component").select("component", F.floor(F.col("component") / bucket).alias("_b"))
    sizes = heads.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = heads.withColumn("_in", F.row_number().over(W.partitionBy("_b").orderBy("component")) - 1).join(before, "_b").select("component", (F.col("_before") + F.col("_in")).alias("series_id"))
    return components.join(numbered, "component").select("uuid", "series_id")


def detect_series(photos: DataFrame, rules: SeriesRules = SeriesRules()) -> DataFrame:
    """photos with series_id."""
    return photos.join(series_ids(series_components(photos, rules)), "uuid")


_IN_SERIES = (F.asc_nulls_first, "date"), (F.asc_nulls_first, "uuid")


def with_series_pos(photos: DataFrame) -> DataFrame:
    """Position from 1 in the series by date (null first) and uuid. A series with many photos is ranked in ranges."""
    return with_rank_within(photos, "series_id", *(f(c) for f, c in _IN_SERIES), name="pos_in_series")


def with_best(scan: DataFrame) -> DataFrame:
    """scan with pos_in_series, series_size and is_best: the best score, null read as 0.5, the earliest among equals."""
    return with_rank_within(scan, "series_id", *(f(c) for f, c in _IN_SERIES), name="pos_in_series", best=F.coalesce("score", F.lit(0.5)))


def best_per_series(scan: DataFrame) -> DataFrame:
    """(series_id, best_uuid, n) of with_best."""
    return with_best(scan).where("is_best").select("series_id", F.col("uuid").alias("best_uuid"), F.col("series_size").alias("n"))


def deletable_photos(scan: DataFrame) -> DataFrame:
    """All but the best of series of two or more, whatever the score."""
    return with_best(scan).where((F.col("series_size") > 1) & ~F.col("is_best"))


def deletion_suggestions(scan: DataFrame, threshold: float = 0.3) -> DataFrame:
    """deletable_photos with a score under the threshold, worst first."""
    return deletable_photos(scan).where(F.col("score") < threshold).orderBy("score", "uuid")


def worst(suggestions: DataFrame, n: int = 20) -> DataFrame:
    return suggestions.orderBy("score", "uuid").limit(n)


def flag_suggested(scan: DataFrame, suggestions: DataFrame) -> DataFrame:
    """scan with suggested_delete: whether the photo is among the suggestions."""
    named = suggestions.select("uuid").distinct().withColumn("suggested_delete", F.lit(True))
    return scan.drop("suggested_delete").join(named, "uuid", "left").withColumn("suggested_delete", F.coalesce("suggested_delete", F.lit(False)))


def series_stats(scan: DataFrame) -> DataFrame:
    """photos, series, singletons, photos in series of two or more, suggested and kept ones."""
    sizes = scan.groupBy("series_id").agg(F.count("*").alias("n"), F.count_if("suggested_delete").alias("d"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return sizes.agg(total("n").alias("photos"), F.count("*").alias("series"), F.count_if(F.col("n") == 1).alias("singletons"), total(F.when(F.col("n") > 1, F.col("n"))).alias("in_series"), total("d").alias("suggested"), total(F.col("n") - F.col("d")).alias("kept"))
