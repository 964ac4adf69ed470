"""Sinks: scans, reports, caches, histories, routed media, logs. Writing a thing twice leaves it once: caches, histories, lists and albums
are tables of snapshots that take only what is not there yet, and scans, routed media and logs replace what they wrote before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalume.operators.feedback import new_labels, new_members, new_records
from curalume.operators.training import new_features
from curalume.sources import schemas
from curalume.sources.snapshots import Snapshots


def scan_header(scan: DataFrame, scan_id: str, scan_date: Column, after: Column, threshold: float) -> DataFrame:
    return scan.agg(F.count("*").alias("total_photos"), F.countDistinct("series_id").alias("total_series"), F.count_if("suggested_delete").alias("suggested_deletions")).select(
        F.lit(scan_id).alias("scan_id"), scan_date.alias("scan_date"), after.alias("after_date"), "total_photos", "total_series", F.lit(threshold).alias("score_threshold"), "suggested_deletions"
    )


def write_scan_result(scan: DataFrame, header: DataFrame, scan_id: str, path: str) -> None:
    """Header and photo rows, each in the scan's own partition; a scan that is written again replaces itself only."""
    for rows, to in ((header, "header"), (scan.withColumn("scan_id", F.lit(scan_id)), "photos")):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(f"{path}/{to}")


def scan_to_json(scan: DataFrame) -> DataFrame:
    """A JSON document a photo; dates in ISO form or null."""
    return scan.select(F.to_json(F.struct(*scan.columns), {"ignoreNullFields": "false"}).alias("value"))


def scan_from_json(documents: DataFrame) -> DataFrame:
    return documents.select(F.from_json("value", schemas.SCAN).alias("p")).select("p.*")


def deletion_report(suggestions: DataFrame) -> DataFrame:
    """Report lines, worst first."""
    return suggestions.orderBy("score", "uuid").select(F.format_string("%.3f\t%s", "score", "path").alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in their order; nothing is written without any."""
    if not lines.limit(1).isEmpty():
        lines.write.mode("overwrite").text(path)


def append_features(extracted: DataFrame, cache: DataFrame, path: str) -> int:
    """Commit features of paths that neither `cache` nor the table at `path` has; the number added."""
    table = Snapshots(extracted.sparkSession, path, schemas.FEATURES, ["path"])
    return table.append_new(new_features(extracted, cache).select("path", F.col("features").cast("array<float>")))


def record_added(history: DataFrame, uuids: DataFrame, scan_file: str, now: Column, path: str) -> int:
    """Commit records of uuids that neither `history` nor the table at `path` has; the number added. Of two writers the first one's record stays."""
    table = Snapshots(uuids.sparkSession, path, schemas.FEEDBACK, ["uuid", "status"])
    return table.append_new(new_records(history, uuids, scan_file, now))


def append_label_list(labels: DataFrame, uuids: DataFrame, path: str) -> int:
    """Commit uuids that neither `labels` nor the list at `path` has; the number added."""
    return Snapshots(uuids.sparkSession, path, "uuid string", ["uuid"]).append_new(new_labels(labels, uuids))


def add_to_album(album_members: DataFrame, uuids: DataFrame, photos: DataFrame, album: str, path: str) -> int:
    """Commit new members; the number added."""
    return Snapshots(uuids.sparkSession, path, schemas.ALBUM_MEMBERS, ["album", "uuid"]).append_new(new_members(album_members, uuids, photos, album))


def write_routed(routed: DataFrame, path: str, batch: str = "all") -> None:
    """Routed media by destination, in the folder of their batch, which a retry writes anew. Of equal file names in a destination the last medium stays."""
    order = F.struct("message_id", "media_pos")
    rest = [c for c in routed.columns if c not in ("destination", "filename")]
    last = routed.groupBy("destination", "filename").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("filename", "_r.*", "destination").select(*routed.columns)
    last.write.mode("overwrite").partitionBy("destination").parquet(f"{path}/batch={batch}")


def append_announcement_log(log: DataFrame, path: str, batch: str = "all") -> None:
    """Log entries as text, in the folder of their batch, which a retry writes anew. An entry's last line end is the writer's."""
    log.select(F.regexp_replace("entry", r"\n\z", "").alias("value")).write.mode("overwrite").text(f"{path}/batch={batch}")


def write_summary(summary: DataFrame, path: str | None = None) -> DataFrame:
    """The summaries, each with one line end; written unless path is None (a dry run)."""
    text = F.regexp_replace("summary", r"\s+\z", "")
    if path is not None:
        summary.select(text.alias("value")).write.mode("overwrite").text(path)
    return summary.select(F.concat(text, F.lit("\n")).alias("value"))
