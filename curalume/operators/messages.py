"""The message pipeline: links, previous messages, media, routing and announcements. Batch and streams share it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curalume.functions.text import (
    clean_announcement,
    clean_author,
    filled,
    image_urls,
    is_always_curate,
    is_announcement,
    media_description,
    media_filename,
    render_announcement,
    tweet_url,
    tweet_user,
    video_urls,
)
from curalume.sources.readers import Rules


def dedupe_messages(messages: DataFrame, watermark: str = "24 hours") -> DataFrame:
    """One row a message id. In a stream, a copy that comes later than the watermark can pass."""
    if messages.isStreaming:
        return messages.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["message_id"])
    return messages.dropDuplicates(["message_id"])


def enrich(messages: DataFrame) -> DataFrame:
    """(message_id, channel_id, ts, author, text, tweet_url, username, images, videos) of each message.

    Embeds add their descriptions to the text. The last embed link that has twitter.com or x.com anywhere in it
    replaces the link; the user changes only with an embed link that is a status link.
    """
    none = F.array()
    embeds = F.coalesce("embeds", none.cast(messages.schema["embeds"].dataType))
    described = F.array_join(F.transform(F.filter(embeds, lambda e: filled(e["description"]).isNotNull()), lambda e: F.concat(F.lit("\n"), e["description"])), "")
    links = F.filter(F.transform(embeds, lambda e: e["url"]), lambda u: u.contains("twitter.com") | u.contains("x.com"))
    last = F.try_element_at(links, F.lit(-1))
    users = F.filter(F.transform(links, tweet_user), lambda u: u.isNotNull())
    return messages.select(
        "message_id",
        "channel_id",
        "ts",
        clean_author("author").alias("author"),
        F.concat(F.coalesce("content", F.lit("")), described).alias("text"),
        F.coalesce(last, tweet_url("content")).alias("tweet_url"),
        F.coalesce(F.try_element_at(users, F.lit(-1)), tweet_user("content")).alias("username"),
        image_urls().alias("images"),
        video_urls().alias("videos"),
    )


def _has_media() -> Column:
    return (F.size("images") + F.size("videos")) > 0


def take_previous(messages: DataFrame, previous: str = "_previous") -> DataFrame:
    """Fill link, user, author and text of media messages without a link from the struct column `previous`, if that has a link."""
    p = lambda c: F.col(f"{previous}.{c}")
    use = _has_media() & filled("tweet_url").isNull() & filled(p("tweet_url")).isNotNull()
    new = {
        "tweet_url": F.when(use, p("tweet_url")).otherwise(F.col("tweet_url")),
        "username": F.when(use, p("username")).otherwise(F.col("username")),
        "author": F.when(use & filled("author").isNull(), F.coalesce(filled(p("author")), F.col("author"))).otherwise(F.col("author")),
        "text": F.when(use & filled("text").isNull(), F.coalesce(filled(p("text")), F.col("text"))).otherwise(F.col("text")),
    }
    return messages.withColumns(new).drop(previous)


def with_previous_message(enriched: DataFrame) -> DataFrame:
    """take_previous with the message before in the channel, by id. To be called before messages are cut off by time."""
    before = F.lag(F.struct("tweet_url", "username", "author", "text")).over(W.partitionBy("channel_id").orderBy("message_id"))
    return take_previous(enriched.withColumn("_previous", before))


def classify(enriched: DataFrame, rules: Rules) -> DataFrame:
    return enriched.withColumns({"is_important": is_announcement("text", rules.keywords), "always_curate": is_always_curate("author", rules.accounts)})


def split_by_media(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with media, and important ones without; the others are dropped."""
    return classified.where(_has_media()), classified.where(~_has_media() & F.col("is_important"))


def explode_media(classified: DataFrame) -> DataFrame:
    """A row for each medium, images before videos, with media_pos from 0, url and kind."""
    tagged = lambda c, kind: F.transform(c, lambda u: F.struct(u.alias("url"), F.lit(kind).alias("kind")))
    media = F.concat(tagged("images", "image"), tagged("videos", "video"))
    rest = [c for c in classified.columns if c not in ("images", "videos")]
    return classified.select(*rest, F.posexplode(media).alias("media_pos", "_m")).select(*rest, "media_pos", "_m.url", "_m.kind")


def attach_media(media_rows: DataFrame, media: DataFrame) -> DataFrame:
    """Media rows whose url was fetched, with the columns of media(url, ...)."""
    return media_rows.join(media, "url")


def route_media(fetched: DataFrame, rules: Rules, now: Column) -> DataFrame:
    """A row for each destination of each fetched medium.

    An image goes to curated if its author is always curated (then it has no score) or its score, 0.5 if it has
    none, reaches the threshold, else to all; an important message's image also to announcements. A video goes
    to curated if the message is important or the author always curated, else to videos.
    """
    image = F.col("kind") == "image"
    score = F.when(image & ~F.col("always_curate"), F.coalesce("score", F.lit(0.5)))
    curated = F.when(image, F.col("always_curate") | (score >= rules.threshold)).otherwise(F.col("is_important") | F.col("always_curate"))
    first = F.when(curated, "curated").when(image, "all").otherwise("videos")
    to = F.filter(F.array(first, F.when(image & F.col("is_important"), "announcements")), lambda d: d.isNotNull())
    named = fetched.select(
        "message_id", "media_pos", "url", "kind", media_filename("url", "tweet_url", "author", "username", now).alias("filename"), media_description("author", "tweet_url").alias("description"),
        "author", "tweet_url", score.alias("score"), "always_curate", "is_important", to.alias("_to"),
    )
    return named.withColumn("destination", F.explode("_to")).drop("_to")


def announcement_entries(classified: DataFrame, fetched: DataFrame) -> DataFrame:
    """(message_id, author, tweet_url, text): one for an important message without media, one for each fetched image of one with."""
    columns = ["message_id", "author", "tweet_url", "text"]
    _, bare = split_by_media(classified)
    return bare.select(*columns).unionByName(fetched.where("is_important and kind = 'image'").select(*columns))


def announcement_log(entries: DataFrame, now: Column) -> DataFrame:
    """announcements rows with the rendered entry."""
    return entries.select("message_id", now.alias("ts"), "author", "tweet_url", clean_announcement("text").alias("text"), render_announcement("author", "tweet_url", "text", now).alias("entry"))


def curation_counters(classified: DataFrame, routed: DataFrame) -> DataFrame:
    """One row: images seen and curated, announcements by message, videos saved and curated."""
    main = routed.where("destination <> 'announcements'")
    is_ = lambda kind, to=None: (F.col("kind") == kind) & (F.lit(True) if to is None else F.col("destination") == to)
    media = main.agg(F.count_if(is_("image")).alias("images_seen"), F.count_if(is_("image", "curated")).alias("images_curated"), F.count_if(is_("video", "videos")).alias("videos_saved"), F.count_if(is_("video", "curated")).alias("videos_curated"))
    return media.join(F.broadcast(classified.agg(F.count_if("is_important").alias("announcements"))))


def channel_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("channel_id").agg(F.count("*").alias("n"))
