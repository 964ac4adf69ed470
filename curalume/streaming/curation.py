"""The message pipeline as streams: backfill and live feed run the same code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from curalume.operators.messages import attach_media, classify, dedupe_messages, enrich, explode_media, route_media, with_previous_message
from curalume.sources.readers import Rules
from curalume.sources.sinks import write_routed
from curalume.streaming.ledger import Counters, Ledger
from curalume.streaming.previous import with_previous_message_stream

_COUNTERS = "channel_id long, announcements long, media long"


def deduplicated(messages: DataFrame, path: str, checkpoint: str, available_now: bool = True, slot: int = 1 << 22, every: int = 32) -> StreamingQuery:
    """Write a stream's messages to path/messages, once for each id however late a copy comes.

    dedupe_messages keeps ids in its state as long as the watermark; here they are entered in a ledger of files
    (path/ledger), and a batch looks up its own in the slots that they fall in. No id is forgotten, and the query has no state.
    A batch that is run again writes its own folder again.
    """
    spark = messages.sparkSession
    ledger = Ledger(spark, f"{path}/ledger", slot=slot, every=every)

    def write(batch: DataFrame, number: int) -> None:
        to = f"{path}/messages/batch={number}"
        ledger.unseen(batch, number).write.mode("overwrite").parquet(to)
        ledger.add(spark.read.schema(batch.schema).parquet(to), number)

    out = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def curate(messages: DataFrame, rules: Rules, watermark: str = "24 hours") -> DataFrame:
    """Deduplicated, enriched and classified messages, from a table or a stream."""
    known = enrich(dedupe_messages(messages, watermark))
    return classify(with_previous_message_stream(known) if messages.isStreaming else with_previous_message(known), rules)


def routed(classified: DataFrame, media: DataFrame, rules: Rules, now: Column) -> DataFrame:
    """Routed rows of classified messages for the media that were fetched: media(url, score)."""
    return route_media(attach_media(explode_media(classified), media), rules, now)


def run(messages: DataFrame, media: DataFrame, rules: Rules, now: Column, path: str, checkpoint: str, available_now: bool = True, watermark: str = "24 hours") -> StreamingQuery:
    """Route a stream's media into folders by destination; with available_now it ends when the backlog is done.

    A batch that is run again after a failure writes its own folder again: rows are keyed by batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        write_routed(batch, path, str(number))

    out = routed(curate(messages, rules, watermark), media, rules, now).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def running_counters(messages: DataFrame, rules: Rules, path: str, checkpoint: str, watermark: str = "24 hours", every: int = 32) -> StreamingQuery:
    """Announcements and media by channel so far: each batch writes what it adds to the channels that it has, running_totals adds up."""
    counters = Counters(messages.sparkSession, path, "channel_id", _COUNTERS, every)

    def write(batch: DataFrame, number: int) -> None:
        counters.add(batch.groupBy("channel_id").agg(F.count_if("is_important").alias("announcements"), F.sum("m").alias("media")), number)

    media = (F.size("images") + F.size("videos")).cast("long").alias("m")
    counted = curate(messages, rules, watermark).select("channel_id", "is_important", media)
    return counted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_totals(spark: SparkSession, path: str) -> DataFrame:
    """The counters of each channel that running_counters wrote so far, at a cost that does not grow with the number of batches."""
    return Counters(spark, path, "channel_id", _COUNTERS).totals()


__all__ = ["curate", "deduplicated", "routed", "run", "running_counters", "running_totals", "with_previous_message_stream", "write_routed"]
