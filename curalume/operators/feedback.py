"""The feedback loop as sets of uuids: what was moved, rescued, deleted or is still pending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in_album(added: DataFrame, current: DataFrame) -> DataFrame:
    return added.select("uuid").distinct().join(current, "uuid", "left_anti")


def still_in_album(added: DataFrame, current: DataFrame) -> DataFrame:
    return added.select("uuid").distinct().join(current, "uuid", "left_semi")


def to_check(gone: DataFrame, feedback: DataFrame) -> DataFrame:
    """uuids not judged before."""
    return gone.join(feedback.where(F.col("status").isin("rescued", "confirmed_delete")).select("uuid"), "uuid", "left_anti")


def pending(still: DataFrame, feedback: DataFrame) -> DataFrame:
    """Photos in the album but those deleted before; rescued ones that are back are pending again."""
    return still.join(feedback.where("status = 'confirmed_delete'").select("uuid"), "uuid", "left_anti")


def split_existing(uuids: DataFrame, photos: DataFrame) -> DataFrame:
    """uuids with exists: whether the library has them."""
    there = photos.select("uuid").distinct().withColumn("exists", F.lit(True))
    return uuids.select("uuid").distinct().join(there, "uuid", "left").select("uuid", F.coalesce("exists", F.lit(False)).alias("exists"))


def feedback_status(feedback: DataFrame, current: DataFrame, photos: DataFrame) -> DataFrame:
    """(uuid, outcome) of all photos ever moved: pending, rescued, deleted, or processed if judged before.

    A photo still in the album is pending, not a bad example; one that has left it is rescued if the library
    still has it, else deleted.
    """
    flags = feedback.groupBy("uuid").agg(F.max(F.col("status") == "added").alias("added"), F.max(F.col("status") == "rescued").alias("rescued"), F.max(F.col("status") == "confirmed_delete").alias("deleted"))
    mark = lambda df, name: df.select("uuid").distinct().withColumn(name, F.lit(True))
    known = flags.where("added").join(mark(current, "here"), "uuid", "left").join(mark(photos, "exists"), "uuid", "left")
    outcome = (
        F.when(F.col("here") & ~F.col("deleted"), "pending")
        .when(F.col("here") | F.col("rescued") | F.col("deleted"), "processed")
        .when(F.col("exists"), "rescued")
        .otherwise("deleted")
    )
    return known.select("uuid", outcome.alias("outcome"))


def feedback_summary(status: DataFrame) -> DataFrame:
    return status.groupBy("outcome").agg(F.count("*").alias("n"))


def preview_feedback(status: DataFrame, n: int = 5) -> DataFrame:
    return status.where(F.col("outcome").isin("rescued", "deleted")).orderBy("outcome", "uuid").limit(n)


def new_records(history: DataFrame, uuids: DataFrame, scan_file: str, now) -> DataFrame:
    """History rows for uuids that are not in it: the first write of a uuid wins."""
    fresh = uuids.select("uuid").distinct().join(history.where("status = 'added'").select("uuid"), "uuid", "left_anti")
    return fresh.select("uuid", now.alias("added_date"), F.lit(scan_file).alias("scan_file"), F.lit("added").alias("status"))


def new_labels(labels: DataFrame, uuids: DataFrame) -> DataFrame:
    """uuids not yet in a label list."""
    return uuids.select("uuid").distinct().join(labels, "uuid", "left_anti")


def new_members(album_members: DataFrame, uuids: DataFrame, photos: DataFrame, album: str) -> DataFrame:
    """Album rows for uuids that the library has and the album has not."""
    wanted = uuids.where("uuid is not null and uuid <> ''").select("uuid").distinct()
    return wanted.join(photos.select("uuid"), "uuid", "left_semi").join(album_members.where(F.col("album") == album).select("uuid"), "uuid", "left_anti").select(F.lit(album).alias("album"), "uuid")
