"""Sources: library metadata, images, scans, feedback, features, messages, rules, logs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curalume.functions.text import IMAGE_EXTENSIONS
from curalume.functions.vectors import hours_before
from curalume.sources import schemas
from curalume.sources.snapshots import Snapshots


def _or_empty(spark: SparkSession, schema: str, read) -> DataFrame:
    """What `read` gives, or an empty table where there is nothing at the path."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    return _or_empty(spark, schema, lambda: spark.read.schema(schema).format(format).load(path))


def read_photos(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.PHOTOS).format(format).load(path)


def read_image_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files of the folder and below with an image extension in lower or upper case, once each; without their content."""
    glob = "*.{" + ",".join(x for e in IMAGE_EXTENSIONS for x in (e, e.upper())) + "}"
    read = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return _or_empty(spark, schemas.FILES, read).select("path", "length", "modificationTime").dropDuplicates(["path"])


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, rgb): decoded by Spark; what cannot be decoded is left out. Bytes come as BGR, BGRA or grey and leave as RGB."""
    image = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")

    def run(batches):
        for batch in batches:
            out = []
            for width, height, n, data in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                x = np.frombuffer(data, np.uint8).reshape(height, width, n)
                out.append((np.repeat(x, 3, 2) if n == 1 else x[:, :, 2::-1]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["path", "width", "height", "rgb"])

    return image.where("width > 0 and height > 0").mapInArrow(run, "path string, width int, height int, rgb binary")


def latest_scan(scans: DataFrame, scan_id: str | None = None) -> DataFrame:
    """The rows of the named scan, or of the greatest scan_id, whose name carries the time; none without a scan."""
    if scan_id is not None:
        return scans.where(F.col("scan_id") == scan_id)
    return scans.join(F.broadcast(scans.agg(F.max("scan_id").alias("scan_id"))), "scan_id", "left_semi")


def read_feedback_history(spark: SparkSession, path: str) -> DataFrame:
    """The history's JSON form as rows of status added, rescued or confirmed_delete; empty if it is absent."""
    raw = _or_empty(spark, schemas.FEEDBACK_JSON, lambda: spark.read.schema(schemas.FEEDBACK_JSON).option("multiLine", True).json(path))
    added = raw.select(F.explode("added_to_album").alias("uuid", "entry")).select("uuid", F.to_timestamp("entry.added_date").alias("added_date"), "entry.scan_file", F.lit("added").alias("status"))
    judged = [raw.select(F.explode(c).alias("uuid")).select("uuid", F.lit(None).cast("timestamp").alias("added_date"), F.lit(None).cast("string").alias("scan_file"), F.lit(c).alias("status")) for c in ("rescued", "confirmed_delete")]
    return added.unionByName(judged[0]).unionByName(judged[1])


def read_label_list(spark: SparkSession, path: str) -> DataFrame:
    """uuids of a JSON array of strings; absent or unreadable gives none."""
    raw = _or_empty(spark, "value string", lambda: spark.read.text(path, wholetext=True))
    return raw.select(F.explode(F.from_json("value", "array<string>")).alias("uuid")).where("uuid is not null")


def read_snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The latest snapshot of a table that the sinks of histories, lists, albums and caches write; none if there is no table."""
    return Snapshots(spark, path, schema, []).read()


def read_feature_cache(spark: SparkSession, path: str) -> DataFrame:
    """A cache that append_features writes, or a plain Parquet table of that shape; absent or unreadable gives none."""
    if Snapshots(spark, path, schemas.FEATURES, ["path"]).version():
        return read_snapshots(spark, path, schemas.FEATURES)
    return read_table(spark, path, schemas.FEATURES)


def read_album_members(album_members: DataFrame, album: str) -> DataFrame:
    """uuids of one album, once each."""
    return album_members.where(F.col("album") == album).select("uuid").distinct()


def monitored(messages: DataFrame, channels: list[int], live: bool = False) -> DataFrame:
    """Messages of the channels; live feeds also leave out the own ones, a backfill does not."""
    kept = messages.where(F.col("channel_id").isin(*channels) if channels else F.lit(False))
    return kept.where(~F.coalesce("is_self", F.lit(False))) if live else kept


def backfill_messages(messages: DataFrame, channels: list[int], now: Column, hours: int) -> DataFrame:
    """Messages of the channels strictly after `hours` before now; none for 0 hours."""
    return monitored(messages, channels).where((F.col("ts") > hours_before(now, hours)) & F.lit(hours > 0))


def stream_messages(spark: SparkSession, path: str, format: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schemas.MESSAGES).format(format).option("maxFilesPerTrigger", files_per_batch).load(path)


@dataclass(frozen=True)
class Rules:
    channels: tuple[int, ...] = ()
    threshold: float = 0.7
    keywords: tuple[str, ...] = ("announce", "release", "drop", "launch")
    accounts: tuple[str, ...] = ()


# Keywords where a rules file names none.
DEFAULT_KEYWORDS = ("announce", "release", "drop", "launch", "available now")


def read_rules(spark: SparkSession, path: str | None = None, threshold: float | None = None) -> Rules:
    """The rules of a JSON file with defaults by key; other defaults without a file. `threshold` overrides."""
    found = None
    if path:
        found = _or_empty(spark, schemas.RULES, lambda: spark.read.schema(schemas.RULES).option("multiLine", True).json(path)).first()
    rules = Rules()
    if found:
        keywords = DEFAULT_KEYWORDS if found.announcement_keywords is None else found.announcement_keywords
        rules = Rules(tuple(found.tweetshift_channel_ids or ()), 0.7 if found.score_threshold is None else found.score_threshold, tuple(keywords), tuple(found.always_curate_accounts or ()))
    return rules if threshold is None else Rules(rules.channels, threshold, rules.keywords, rules.accounts)


def read_announcement_log(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each log that is not blank; bytes that are not UTF-8 are replaced."""
    raw = _or_empty(spark, "path string, content binary", lambda: spark.read.format("binaryFile").load(path).select("path", "content"))
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text")).where(F.trim("text") != "")
