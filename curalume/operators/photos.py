"""Candidates, path choice and summaries over a photo library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalume.functions.text import is_video
from curalume.functions.vectors import pct


def _usable() -> Column:
    return F.col("favorite") & F.col("date").isNotNull() & ~F.col("screenshot") & ~F.col("ismissing")


def scan_candidates(photos: DataFrame, after: Column, limit: int | None = None) -> DataFrame:
    """Favourites from `after` on that are no screenshots and not missing; with a limit, the first by date and uuid."""
    found = photos.where(_usable() & (F.col("date") >= after))
    return found if limit is None else found.orderBy("date", "uuid").limit(limit)


def training_positives(photos: DataFrame, cutoff: Column) -> DataFrame:
    return photos.where(_usable() & (F.col("date") < cutoff))


def resolve_path(photos: DataFrame, files: DataFrame, counts: bool = False) -> DataFrame:
    """Photos with the path to use: the original if it exists, else the edited file if it exists; a video of either kind is left out.

    An existing original that is a video does not fall back to an edited still. `files` lists existing paths.
    counts: return instead one row with skipped (no file) and skipped_videos.
    """
    there = files.select("path").distinct()
    known = photos.join(there.select("path", F.lit(True).alias("has_original")), "path", "left").join(there.select(F.col("path").alias("path_edited"), F.lit(True).alias("has_edited")), "path_edited", "left")
    chosen = known.withColumn("chosen", F.when(F.col("has_original"), F.col("path")).when(F.col("has_edited"), F.col("path_edited")))
    if counts:
        return chosen.agg(F.count_if(F.col("chosen").isNull()).alias("skipped"), F.count_if(is_video("chosen")).alias("skipped_videos"))
    return chosen.where(F.col("chosen").isNotNull() & ~is_video("chosen")).drop("has_original", "has_edited", "path").withColumnRenamed("chosen", "path").select(*photos.columns)


def library_summary(photos: DataFrame) -> DataFrame:
    return photos.agg(F.count("*").alias("total"), F.count_if("favorite").alias("favorites"), F.count_if(~F.col("favorite")).alias("non_favorites"))


def favorite_period_crosstab(photos: DataFrame, cutoff: Column) -> DataFrame:
    """Favourites and others before and from `cutoff` on, and both together; photos without a date are left out, and an unknown favourite is other."""
    dated = photos.where("date is not null").select("favorite", (F.col("date") < cutoff).alias("before"))
    return (
        dated.rollup("favorite").agg(F.grouping("favorite").alias("_all"), F.count_if("before").alias("before_cutoff"), F.count_if(~F.col("before")).alias("from_cutoff"))
        .select(F.when(F.col("_all") == 1, "total").when(F.col("favorite"), "favorite").otherwise("other").alias("kind"), "before_cutoff", "from_cutoff")
    )


def media_type_counts(photos: DataFrame) -> DataFrame:
    return photos.agg(*(F.count_if(c).alias(f"{c}_count") for c in ("screenshot", "selfie", "live_photo", "burst")))


def training_mode_hint(photos: DataFrame) -> DataFrame:
    """one-class with fewer than 100 photos that are no favourites, else binary."""
    return library_summary(photos).select("non_favorites", F.when(F.col("non_favorites") < 100, "one-class").otherwise("binary").alias("mode"))


def date_range(photos: DataFrame) -> DataFrame:
    return photos.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def album_count(album_members: DataFrame) -> DataFrame:
    return album_members.agg(F.countDistinct("album").alias("albums"))


def _band(score: Column | str, edges: list[float]) -> Column:
    """The greatest lower edge at or below the score."""
    c, out = F.col(score) if isinstance(score, str) else score, F.lit(None).cast("double")
    for e in sorted(edges):
        out = F.when(c >= e, F.lit(e)).otherwise(out)
    return out


def score_distribution(scan: DataFrame) -> DataFrame:
    """Photos in five half-open score bands and their share in percent; empty bands too."""
    edges = [0.0, 0.2, 0.4, 0.6, 0.8]
    counts = scan.where("score is not null").groupBy(_band(F.greatest("score", F.lit(0.0)), edges).alias("band_from")).agg(F.count("*").alias("n"))
    bands = scan.sparkSession.createDataFrame([(e,) for e in edges], "band_from double")
    total = scan.agg(F.count("score").alias("total"))
    filled = bands.join(counts, "band_from", "left").select("band_from", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return filled.join(F.broadcast(total)).select("band_from", "n", pct("n", "total").alias("percent"))


def below_threshold(scan: DataFrame, threshold: float) -> DataFrame:
    """Photos under the threshold with an id; whether they are the best of a series does not matter here."""
    return scan.where((F.col("score") < threshold) & (F.coalesce("uuid", F.lit("")) != ""))


def move_histogram(scan: DataFrame, threshold: float) -> DataFrame:
    """below_threshold in four bands under 0.8, those that are not empty."""
    return below_threshold(scan, threshold).where("score < 0.8").groupBy(_band(F.greatest("score", F.lit(0.0)), [0.0, 0.2, 0.4, 0.6]).alias("band_from")).agg(F.count("*").alias("n"))


def preview_moves(scan: DataFrame, threshold: float, n: int = 20) -> DataFrame:
    """The first rows to move in scan order (date, uuid)."""
    return below_threshold(scan, threshold).orderBy(F.asc_nulls_first("date"), "uuid").limit(n)
