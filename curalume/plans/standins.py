"""Library, feedback and message tables made by Spark from the driver's tables, row for row.

Every photo is an event, every message a turn of a conversation; nothing is invented beside fixed rules on their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalume.plans.tables import table


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n, kind = F.col("event_id"), F.col("event_type")
    ext = F.when(kind == "error", ".MOV").when(kind == "view", ".heic").otherwise(".jpg")
    return e.select(
        n.cast("string").alias("uuid"),
        F.concat(F.lit("/library/"), n, ext).alias("path"),
        F.when(n % 3 == 0, F.concat(F.lit("/edited/"), n, F.lit(".jpg"))).alias("path_edited"),
        F.concat(n, ext).alias("filename"),
        F.col("ts").cast("timestamp").alias("date"),
        kind.isin("purchase", "signup", "view").alias("favorite"),
        (kind == "click").alias("screenshot"),
        (n % 17 == 0).alias("ismissing"),
        (F.col("user_id") % 2 == 0).alias("selfie"),
        (F.col("user_id") % 5 == 0).alias("live_photo"),
        (F.col("value") > 100).alias("burst"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths that exist: nine in ten originals, half of the edited files."""
    p = photos(spark, sf_dir).withColumn("n", F.col("uuid").cast("long"))
    return p.where("n % 10 <> 0").select("path").unionByName(p.where("path_edited is not null and n % 2 = 0").select(F.col("path_edited").alias("path")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uuid, path, date, score): k of the event's properties over 100, null for every 13th."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double") / 100
    return e.select(F.col("event_id").cast("string").alias("uuid"), F.concat(F.lit("/library/"), "event_id", F.lit(".jpg")).alias("path"), F.col("ts").cast("timestamp").alias("date"), F.when(F.col("event_id") % 13 != 0, k).alias("score"))


def with_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored with the embedding and a 16-digit hash of the event's number."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("features"))
    n = F.col("uuid").cast("long")
    size = vectors.count()
    return scored(spark, sf_dir).withColumn("vec_id", n % size).join(vectors, "vec_id").drop("vec_id").withColumn("phash", F.lpad(F.hex(F.floor(n / 2) * 7919), 16, "0"))


def album_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where("event_id % 7 < 2").select(F.when(F.col("event_id") % 7 == 0, "To Delete").otherwise("Trip").alias("album"), F.col("event_id").cast("string").alias("uuid"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), F.col("ts").cast("timestamp").alias("ts"))
    row = lambda cond, status: e.where(cond).select(F.col("n").cast("string").alias("uuid"), F.when(F.lit(status == "added"), F.col("ts")).alias("added_date"), F.when(F.lit(status == "added"), "scan_1").alias("scan_file"), F.lit(status).alias("status"))
    return row("n % 5 = 0 or n % 14 = 0", "added").unionByName(row("n % 25 = 0", "rescued")).unionByName(row("n % 35 = 0", "confirmed_delete"))


def library_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos that the library still has."""
    return photos(spark, sf_dir).where(F.col("uuid").cast("long") % 3 != 1)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message a turn: the channel is the conversation; first turns carry a link, every third turn an image, every fifth a video or GIF."""
    c = table(spark, sf_dir, "conversations")
    n, t = F.col("conv_id"), F.col("turn")
    link = F.concat(F.lit("https://x.com/user"), n % 50, F.lit("/status/"), n * 100 + t)
    name = F.concat(n, F.lit("_"), t)
    attachment = lambda cond, ext, kind: F.when(cond, F.struct(F.concat(F.lit("https://cdn.example/"), name, F.lit(ext)).alias("url"), F.lit(kind).alias("content_type")))
    embed = F.struct(
        F.when(n % 4 == 0, F.concat(F.lit("https://netflix.com/"), name)).otherwise(link).alias("url"),
        F.col("text").alias("description"),
        F.struct(F.when(t % 4 == 0, F.concat(F.lit("https://img.example/"), name, F.lit(".png"))).otherwise(F.concat(F.lit("https://img.example/"), name, F.lit(".GIF"))).alias("url")).alias("image"),
        F.struct(F.when(n % 6 == 0, F.concat(F.lit("https://v.example/"), name, F.lit(".mp4"))).alias("url")).alias("video"),
        F.struct(F.concat(F.lit("https://t.example/"), name, F.lit(".jpg")).alias("url"), (t * 60).cast("int").alias("width")).alias("thumbnail"),
    )
    return c.select(
        (n * 1000 + t).alias("message_id"),
        n.alias("channel_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), n % 48, t)).alias("ts"),
        F.concat(F.lit("Author "), n % 20, F.when(n % 2 == 0, " • TweetShift").otherwise("")).alias("author"),
        (F.col("role") == "system").alias("is_self"),
        F.when(t == 0, F.concat("text", F.lit(" "), link)).otherwise(F.col("text")).alias("content"),
        F.filter(F.array(attachment(t % 3 == 1, ".jpg?x=1", "image/jpeg"), attachment(t % 5 == 2, ".mp4", "video/mp4"), attachment(t % 7 == 3, ".gif", "image/gif")), lambda a: a.isNotNull()).alias("attachments"),
        F.when(n % 5 == 0, F.array(embed)).otherwise(F.array().cast(f"array<{_EMBED}>")).alias("embeds"),
    )


_EMBED = "struct<url: string, description: string, image: struct<url: string>, video: struct<url: string>, thumbnail: struct<url: string, width: int>>"


def fetched_media(rows: DataFrame) -> DataFrame:
    """media(url, score) for nine in ten of the urls in rows: by the url's hash, which also gives the score."""
    h = F.conv(F.substring(F.md5("url"), 1, 4), 16, 10).cast("long")
    return rows.select("url").distinct().where(h % 10 != 0).select("url", ((h % 1000) / 1000.0).alias("score"))
