"""Review of series: what to look at, in which order, and what the reviewer's decisions make of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalume.operators.ranks import with_rank_within


def rank_in_series(scan: DataFrame) -> DataFrame:
    """Rank from 1 in the series by falling score, null last, ties by date and uuid; rank 1 is the best."""
    return with_rank_within(scan, "series_id", F.desc_nulls_last("score"), F.asc_nulls_first("date"), F.asc_nulls_first("uuid"), name="rank_in_series")


def series_with_suggestions(scan: DataFrame) -> DataFrame:
    """All photos of the series that have a suggested one."""
    return scan.join(scan.where("suggested_delete").select("series_id").distinct(), "series_id", "left_semi")


def review_groups(scan: DataFrame) -> DataFrame:
    """(series_id, photos, deletable_count) of the series with a suggestion."""
    return scan.groupBy("series_id").agg(F.count("*").alias("photos"), F.count_if("suggested_delete").alias("deletable_count")).where("deletable_count > 0")


def review_order(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("deletable_count"), "series_id")


def apply_review_decisions(ranked: DataFrame, decisions: DataFrame) -> DataFrame:
    """ranked photos (rank_in_series) with decision delete, keep or none.

    k keeps the listed ranks and deletes the rest, d the other way round, da deletes all, y follows the
    suggestions, n keeps all, s or no decision leaves the series open, q leaves it and all behind it in review
    order open. Ranks that are not there match nothing; k or d without a list is no decision.
    """
    order = ranked.groupBy("series_id").agg(F.count_if("suggested_delete").alias("_d"))
    key = F.struct((-F.col("_d")).alias("d"), F.col("series_id").alias("s"))
    keyed = order.select("series_id", key.alias("_key"))
    quits = keyed.join(decisions.where("action = 'q'").select("series_id"), "series_id", "left_semi").agg(F.min("_key").alias("_quit"))
    known = ranked.join(keyed, "series_id").join(decisions, "series_id", "left").join(F.broadcast(quits))
    action = F.when(F.col("_quit").isNotNull() & (F.col("_key") >= F.col("_quit")), "s").otherwise(F.col("action"))
    listed = F.array_contains("positions", F.col("rank_in_series").cast("int"))
    gone = F.lit("delete")
    stays = F.lit("keep")
    judged = (
        F.when((action == "k") & (F.size("positions") > 0), F.when(listed, stays).otherwise(gone))
        .when((action == "d") & (F.size("positions") > 0), F.when(listed, gone).otherwise(stays))
        .when(action == "da", gone)
        .when(action == "y", F.when(F.col("suggested_delete"), gone).otherwise(stays))
        .when(action == "n", stays)
        .otherwise("none")
    )
    return known.withColumn("decision", judged).select(*ranked.columns, "decision")


def review_summary(decided: DataFrame) -> DataFrame:
    return decided.groupBy("decision").agg(F.count("*").alias("n"))


def confirmed_deletes(decided: DataFrame) -> DataFrame:
    return decided.where("decision = 'delete'").select("path")
