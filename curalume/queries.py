"""The registered queries over the photo, review, feedback, training and message operators, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalume.functions import text as tx
from curalume.functions.vectors import cosine, fmt, hamming, hours_before, parse_day, pct
from curalume.operators import digest, feedback, media, messages, photos, review, series, training
from curalume.plans import standins as s
from curalume.plans.tables import saved, session_dir, table
from curalume.sources import readers, sinks
from curalume.streaming import curation

CUTOFF = "2024-01-16"
NOW = "2024-01-20 12:34:56"
#: Series by time alone on a table with an event every few minutes.
BY_TIME = series.SeriesRules(seconds=300, close_seconds=300)
#: Series by features and hashes: the embeddings are far apart, so the cut-offs are wide.
BY_LOOK = series.SeriesRules(seconds=900, cosine=0.25, bits=2, close_seconds=5)
#: The turns of the stand-in messages are two days apart in no order.
BACKLOG = "10 days"
RULES = readers.Rules(threshold=0.7, keywords=(*readers.DEFAULT_KEYWORDS, "tion"), accounts=("Author 3", "author 7"))


def cutoff():
    return parse_day(F.lit(CUTOFF))


def now():
    return F.lit(NOW).cast("timestamp")


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored photos with their series and suggestions."""
    found = saved(series.detect_series(s.scored(spark, sf_dir), BY_TIME), "scan")
    return series.flag_suggested(found, series.deletion_suggestions(found)).select("uuid", "path", "date", "score", "series_id", "suggested_delete")


def deletion_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.detect_series(s.scored(spark, sf_dir), BY_TIME)
    return series.deletion_suggestions(found).select("uuid", "series_id", "score", "series_size")


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s.scored(spark, sf_dir).select("uuid", "date")
    ranked = series.with_global_rank(found)
    return series.connected_components(ranked, series.linked_ranks(found, ranked, BY_TIME)).select("uuid", "component")


def _flagged(rows: DataFrame) -> DataFrame:
    return rows.select("uuid", "series_id", "suggested_delete")


def decisions(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """A decision for each series by its number; every 501st says quit."""
    n = F.col("series_id")
    action = F.when(n % 501 == 500, "q").otherwise(F.element_at(F.array(*(F.lit(x) for x in ("k", "d", "da", "y", "n", "s"))), (n % 6 + 1).cast("int")))
    return rows.select("series_id").distinct().select("series_id", action.alias("action"), F.when(action.isin("k", "d"), F.array(F.lit(1), F.lit(3))).otherwise(F.array().cast("array<int>")).alias("positions"))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(scan(spark, sf_dir), "flagged")
    return review.apply_review_decisions(review.rank_in_series(rows), decisions(spark, sf_dir, rows))


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, features, label): quality labels with the embedding at doc_id modulo their number."""
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.count()
    rows = table(spark, sf_dir, "labels").withColumn("vec_id", F.col("doc_id") % n).join(vectors.select("vec_id", "embedding"), "vec_id")
    return rows.select(F.col("doc_id").cast("string").alias("path"), F.col("embedding").alias("features"), F.col("quality").alias("label"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 pictures whose pixels are the embeddings' values."""
    grey = F.transform("embedding", lambda x: F.lpad(F.hex(F.least(F.greatest(F.round(x * 60 + 128), F.lit(0)), F.lit(255)).cast("int")), 2, "0"))
    hexes = F.array_join(F.transform(grey, lambda h: F.concat(h, h, h)), "")
    return table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 64).select(F.col("vec_id").cast("string").alias("path"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(F.substring(hexes, 1, 384)).alias("rgb"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.curate(s.messages(spark, sf_dir), RULES)


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages.explode_media(classified(spark, sf_dir))
    return messages.attach_media(rows, s.fetched_media(rows))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.route_media(fetched(spark, sf_dir), RULES, now())


def _streamed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The messages as a stream of files, and behind them the heartbeat of a channel of its own, far enough ahead for the watermark to pass them."""
    base = f"{session_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = s.messages(spark, sf_dir)
    rows.repartitionByRange(3, "message_id").write.parquet(f"{base}/in")
    given = {"message_id": F.lit(-1), "channel_id": F.lit(-1), "ts": F.col("last") + F.expr(f"interval {BACKLOG} 1 hour")}
    beat = rows.agg(F.max("ts").alias("last")).where("last is not null")
    beat.select(*((given.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name) for f in rows.schema)).write.mode("append").parquet(f"{base}/in")
    return readers.stream_messages(spark, f"{base}/in"), base


def curate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routed media of the stream, as it was written by destination."""
    live, base = _streamed(spark, sf_dir)
    media_rows = s.fetched_media(messages.explode_media(classified(spark, sf_dir)))
    curation.run(live, saved(media_rows, "media"), RULES, now(), f"{base}/out", f"{base}/state", watermark=BACKLOG).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("message_id", "media_pos", "url", "destination")


def dedupe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ledger lets through of the stream and of a second copy of it that comes a month later."""
    live, base = _streamed(spark, sf_dir)
    for _ in range(2):
        curation.deduplicated(live, f"{base}/out", f"{base}/state").awaitTermination()
        late = s.messages(spark, sf_dir).withColumn("ts", F.col("ts") + F.expr("interval 30 days"))
        late.repartitionByRange(3, "message_id").write.mode("append").parquet(f"{base}/in")
    return spark.read.parquet(f"{base}/out/messages").where("channel_id >= 0").select("message_id", "channel_id")


def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, base = _streamed(spark, sf_dir)
    curation.running_counters(live, RULES, f"{base}/out", f"{base}/state", BACKLOG).awaitTermination()
    return curation.running_totals(spark, f"{base}/out").where("channel_id >= 0")


def random_forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(labelled_vectors(spark, sf_dir), "labelled")
    scorer = training.train_scorer(rows.where("label = 1"), rows.where("label = 0"))
    return training.validation_stats(training.score(rows, scorer))


def one_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(labelled_vectors(spark, sf_dir), "labelled")
    scorer = training.train_scorer(rows.where("label = 1"), None)
    return training.score(rows, scorer).withColumn("gap", F.lit(scorer.gap))


def written_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans written and the later one read back."""
    rows, path = saved(scan(spark, sf_dir), "flagged"), f"{session_dir(spark)}/scans-{uuid.uuid4().hex}"
    for name in ("20240101_000000", "20240202_000000"):
        sinks.write_scan_result(rows, sinks.scan_header(rows, name, now(), cutoff(), 0.3), name, path)
    return readers.latest_scan(spark.read.parquet(f"{path}/photos").withColumn("scan_id", F.col("scan_id").cast("string"))).select("uuid", "series_id", "suggested_delete")


def training_rows(spark: SparkSession, sf_dir: str, sample: int | None = None) -> DataFrame:
    p = s.photos(spark, sf_dir)
    folder = s.files(spark, sf_dir).where("path like '/edited/%'")
    f = s.feedback(spark, sf_dir)
    return training.training_set(p, s.files(spark, sf_dir), cutoff(), folder, f.where("status = 'rescued'"), f.where("status = 'confirmed_delete'"), sample)


def training_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = s.feedback(spark, sf_dir)
    return training.training_skipped(s.photos(spark, sf_dir), s.files(spark, sf_dir), cutoff(), f.where("status = 'rescued'"), f.where("status = 'confirmed_delete'"))


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = s.with_features(spark, sf_dir)
    return v.where(F.col("uuid").cast("long") % 2 == 0).select("path", "features")


def _added(f: DataFrame) -> DataFrame:
    return f.where("status = 'added'").select("uuid")


def _sets(spark: SparkSession, sf_dir: str):
    f, here = s.feedback(spark, sf_dir), readers.read_album_members(s.album_members(spark, sf_dir), "To Delete")
    return f, _added(f), here


def _digest(array: str, scale: int):
    """md5 of an array's values as whole numbers of 1 / scale."""
    return F.md5(F.array_join(F.transform(array, lambda x: F.round(x.cast("double") * scale).cast("int").cast("string")), ","))


def _columns(rows: DataFrame, **columns) -> DataFrame:
    return rows.select(*(c.alias(k) for k, c in columns.items()))


QUERIES = {
    # sources and filters
    "read_photos": lambda k, d: s.photos(k, d).select("uuid", "path", "favorite", "screenshot", "ismissing"),
    "read_album_members": lambda k, d: readers.read_album_members(s.album_members(k, d), "To Delete"),
    "backfill_messages": lambda k, d: readers.backfill_messages(s.messages(k, d), [1, 2, 3, 5, 8, 13, 21, 34], F.lit("2024-01-02 12:00:00").cast("timestamp"), 30).select("message_id", "channel_id"),
    "monitored_channel": lambda k, d: readers.monitored(s.messages(k, d), [1, 2, 3, 5, 8], live=True).select("message_id"),
    "scan_candidates": lambda k, d: photos.scan_candidates(s.photos(k, d), cutoff()).select("uuid", "path"),
    "scan_candidates_limit": lambda k, d: photos.scan_candidates(s.photos(k, d), cutoff(), 50).select("uuid"),
    "training_positives": lambda k, d: photos.training_positives(s.photos(k, d), cutoff()).select("uuid"),
    "resolve_path": lambda k, d: photos.resolve_path(s.photos(k, d), s.files(k, d)).select("uuid", "path"),
    "resolve_path_counts": lambda k, d: photos.resolve_path(s.photos(k, d), s.files(k, d), counts=True),
    "below_threshold": lambda k, d: photos.below_threshold(s.scored(k, d), 0.8).select("uuid", "score"),
    # library summaries
    "library_summary": lambda k, d: photos.library_summary(s.photos(k, d)),
    "favorite_period_crosstab": lambda k, d: photos.favorite_period_crosstab(s.photos(k, d), cutoff()),
    "media_type_counts": lambda k, d: photos.media_type_counts(s.photos(k, d)),
    "training_mode_hint": lambda k, d: photos.training_mode_hint(s.photos(k, d)),
    "date_range": lambda k, d: photos.date_range(s.photos(k, d)).select(*(fmt(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_date", "last_date"))),
    "album_count": lambda k, d: photos.album_count(s.album_members(k, d)),
    "score_distribution": lambda k, d: photos.score_distribution(s.scored(k, d)),
    "move_histogram": lambda k, d: photos.move_histogram(s.scored(k, d), 0.7),
    "preview_moves": lambda k, d: photos.preview_moves(s.scored(k, d), 0.5).select("uuid", "score"),
    # series
    "with_global_rank": lambda k, d: series.with_global_rank(s.scored(k, d)).select("uuid", "rank"),
    "close_time_runs": lambda k, d: _columns(series.close_time_runs(s.scored(k, d), 60), run_start=fmt("run_start", "yyyy-MM-dd HH:mm:ss"), n=F.col("n")),
    "series_pairs": lambda k, d: series.series_pairs(s.scored(k, d), BY_TIME),
    "series_pairs_by_look": lambda k, d: series.series_pairs(s.with_features(k, d), BY_LOOK),
    "cosine_and_hamming": lambda k, d: (lambda v: v.alias("a").join(v.alias("b"), F.col("a.n") + 1 == F.col("b.n")).select(F.col("a.uuid"), F.round(cosine("a.features", "b.features"), 4).alias("cosine"), hamming("a.phash", "b.phash").cast("long").alias("bits")))(s.with_features(k, d).withColumn("n", F.col("uuid").cast("long"))),
    "detect_series": lambda k, d: series.detect_series(s.scored(k, d), BY_TIME).select("uuid", "series_id"),
    "connected_components": connected_components,
    "with_series_pos": lambda k, d: series.with_series_pos(scan(k, d)).select("uuid", "pos_in_series"),
    "best_per_series": lambda k, d: series.best_per_series(scan(k, d)),
    "deletable_photos": lambda k, d: series.deletable_photos(scan(k, d)).select("uuid"),
    "deletion_suggestions": deletion_suggestions,
    "worst_suggestions": lambda k, d: series.worst(series.deletion_suggestions(scan(k, d)), 20).select("uuid", "score"),
    "flag_suggested": lambda k, d: _flagged(scan(k, d)),
    "series_stats": lambda k, d: series.series_stats(scan(k, d)),
    "write_and_latest_scan": written_scan,
    "scan_json_round_trip": lambda k, d: sinks.scan_from_json(sinks.scan_to_json(scan(k, d).withColumn("scan_id", F.lit("s")))).select("uuid", "series_id", "score"),
    "deletion_report": lambda k, d: sinks.deletion_report(series.deletion_suggestions(scan(k, d))),
    # review
    "rank_in_series": lambda k, d: review.rank_in_series(scan(k, d)).select("uuid", "rank_in_series"),
    "series_with_suggestions": lambda k, d: review.series_with_suggestions(scan(k, d)).select("uuid", "series_id"),
    "review_groups": lambda k, d: review.review_order(review.review_groups(scan(k, d))),
    "apply_review_decisions": lambda k, d: decided(k, d).select("uuid", "series_id", "decision"),
    "review_summary": lambda k, d: review.review_summary(decided(k, d)),
    "confirmed_deletes": lambda k, d: review.confirmed_deletes(decided(k, d)),
    # feedback
    "not_in_album": lambda k, d: (lambda f, a, h: feedback.not_in_album(a, h))(*_sets(k, d)),
    "still_in_album": lambda k, d: (lambda f, a, h: feedback.still_in_album(a, h))(*_sets(k, d)),
    "to_check": lambda k, d: (lambda f, a, h: feedback.to_check(feedback.not_in_album(a, h), f))(*_sets(k, d)),
    "pending": lambda k, d: (lambda f, a, h: feedback.pending(feedback.still_in_album(a, h), f))(*_sets(k, d)),
    "split_existing": lambda k, d: (lambda f, a, h: feedback.split_existing(a, s.library_now(k, d)))(*_sets(k, d)),
    "feedback_status": lambda k, d: (lambda f, a, h: feedback.feedback_status(f, h, s.library_now(k, d)))(*_sets(k, d)),
    "feedback_summary": lambda k, d: (lambda f, a, h: feedback.feedback_summary(feedback.feedback_status(f, h, s.library_now(k, d))))(*_sets(k, d)),
    "preview_feedback": lambda k, d: (lambda f, a, h: feedback.preview_feedback(feedback.feedback_status(f, h, s.library_now(k, d))))(*_sets(k, d)),
    "record_added": lambda k, d: feedback.new_records(s.feedback(k, d), s.photos(k, d).where("favorite"), "scan_2", now()).select("uuid", "scan_file", "status"),
    "append_label_list": lambda k, d: feedback.new_labels(s.feedback(k, d).where("status = 'rescued'").select("uuid"), s.album_members(k, d)),
    "add_to_album": lambda k, d: feedback.new_members(s.album_members(k, d), s.scored(k, d), s.library_now(k, d), "To Delete"),
    # training
    "attach_features": lambda k, d: training.attach_features(s.scored(k, d).select("path", "uuid"), cache(k, d)).select("uuid", _digest("features", 1000).alias("features")),
    "features_to_extract": lambda k, d: training.features_to_extract(s.scored(k, d).select("path"), cache(k, d)),
    "training_set": lambda k, d: training_rows(k, d),
    "training_skipped": training_skipped,
    "training_counts": lambda k, d: training.training_counts(training_rows(k, d), s.files(k, d).where(F.length("path") % 2 == 0)),
    "exact_sample": lambda k, d: training.exact_sample(s.photos(k, d).select("path"), 500),
    "fit_scaler": lambda k, d: training.fit_scaler(labelled_vectors(k, d).where("label = 1")).select(F.posexplode(F.arrays_zip("mean", "std")).alias("i", "v")).select("i", F.round("v.mean", 4).alias("mean"), F.round("v.std", 4).alias("std")),
    "standardise": lambda k, d: (lambda v: training.scaled(v, training.fit_scaler(v)).select("path", _digest("features", 100).alias("z")))(labelled_vectors(k, d)),
    "validation_stats": lambda k, d: (lambda r: r.select(*(F.round(c, 4).alias(c) for c in r.columns if c != "verdict"), "verdict"))(training.validation_stats(labelled_vectors(k, d).select("label", F.abs(F.col("features")[0].cast("double")).alias("score")))),
    "random_forest_scores": random_forest_scores,
    "one_class_scores": one_class_scores,
    "extract_features": lambda k, d: media.extract_features(images(k, d)).select("path", F.size("features").alias("width"), *(F.round(f(F.transform("features", lambda x: x.cast("double"))), 2).alias(c) for c, f in (("least", F.array_min), ("most", F.array_max), ("mean", lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / F.size(a))))),
    "phash": lambda k, d: media.phash(images(k, d)),
    # messages
    "enrich_messages": lambda k, d: messages.enrich(s.messages(k, d)).select("message_id", "author", "tweet_url", "username", F.array_join("images", " ").alias("images"), F.array_join("videos", " ").alias("videos"), F.md5("text").alias("text")),
    "with_previous_message": lambda k, d: messages.with_previous_message(messages.enrich(s.messages(k, d))).select("message_id", "tweet_url", "username"),
    "explode_media": lambda k, d: messages.explode_media(classified(k, d)).select("message_id", "url", "kind"),
    "split_by_media": lambda k, d: messages.split_by_media(classified(k, d))[1].select("message_id"),
    "attach_media": lambda k, d: fetched(k, d).select("message_id", "url", "score"),
    "route_media": lambda k, d: routed(k, d).select("message_id", "url", "kind", "filename", "description", "score", "destination"),
    "media_filename": lambda k, d: _columns(table(k, d, "pages"), page_id=F.col("page_id"), filename=tx.media_filename("url", F.lit(None).cast("string"), F.lit("Zoë 名 of a very long name"), F.lit(None).cast("string"), now())),
    "url_parts": lambda k, d: _columns(table(k, d, "pages"), page_id=F.col("page_id"), ext=tx.file_ext("url"), hash=tx.url_hash("url"), base=tx.basename("url")),
    "announcement_entries": lambda k, d: messages.announcement_entries(classified(k, d), fetched(k, d)).withColumn("text", F.md5("text")),
    "announcement_log": lambda k, d: messages.announcement_log(messages.announcement_entries(classified(k, d), fetched(k, d)), now()).select("message_id", F.md5("entry").alias("entry")),
    "curation_counters": lambda k, d: messages.curation_counters(classified(k, d), routed(k, d)),
    "channel_counts": lambda k, d: messages.channel_counts(s.messages(k, d)),
    "dedupe_messages": lambda k, d: messages.dedupe_messages(s.messages(k, d).unionByName(s.messages(k, d))).select("message_id"),
    "is_announcement": lambda k, d: _columns(table(k, d, "documents"), doc_id=F.col("doc_id"), hit=tx.is_announcement("text", readers.DEFAULT_KEYWORDS), always=tx.is_always_curate("source", ["SRC1", "src7"])),
    "clean_announcement": lambda k, d: _columns(table(k, d, "documents"), doc_id=F.col("doc_id"), clean=F.md5(tx.clean_announcement("text")), lead=tx.preview("text")),
    "chunk_text": lambda k, d: digest.chunk_text(table(k, d, "documents")).select("doc_id", "part", "parts", F.md5("chunk").alias("chunk")),
    "summarise": lambda k, d: digest.summarise(table(k, d, "documents")),
    "hours_before": lambda k, d: s.scored(k, d).where(F.col("date") > hours_before(now(), 48)).agg(F.count("*").alias("n"), pct(F.count("score"), F.count("*")).alias("scored_percent")),
    # streams
    "curate_stream": curate_stream,
    "dedupe_stream": dedupe_stream,
    "stream_counters": stream_counters,
}

_PHOTOS = """photos AS (SELECT CAST(event_id AS VARCHAR) AS uuid, event_id AS n, '/library/' || event_id || CASE event_type WHEN 'error' THEN '.MOV' WHEN 'view' THEN '.heic' ELSE '.jpg' END AS path,
 CASE WHEN event_id % 3 = 0 THEN '/edited/' || event_id || '.jpg' END AS path_edited, ts AS date, event_type IN ('purchase', 'signup', 'view') AS favorite, event_type = 'click' AS screenshot,
 event_id % 17 = 0 AS ismissing, user_id % 2 = 0 AS selfie, user_id % 5 = 0 AS live_photo, value > 100 AS burst, event_type = 'error' AS video FROM events)"""
_FILES = "files AS (SELECT path FROM photos WHERE n % 10 <> 0 UNION ALL SELECT path_edited FROM photos WHERE path_edited IS NOT NULL AND n % 2 = 0)"
_SCORED = "scored AS (SELECT CAST(event_id AS VARCHAR) AS uuid, '/library/' || event_id || '.jpg' AS path, event_id AS n, ts AS date, CASE WHEN event_id % 13 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 END AS score FROM events)"
_SERIES = f"""{_SCORED}, gaps AS (SELECT *, CASE WHEN date - lag(date) OVER (ORDER BY date, uuid) <= INTERVAL 300 SECOND THEN 0 ELSE 1 END AS fresh FROM scored),
numbered AS (SELECT *, sum(fresh) OVER (ORDER BY date, uuid) - 1 AS series_id FROM gaps),
placed AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date, uuid) AS pos, count(*) OVER (PARTITION BY series_id) AS size, row_number() OVER (PARTITION BY series_id ORDER BY coalesce(score, 0.5) DESC, date, uuid) AS best FROM numbered),
scan AS (SELECT *, coalesce(size > 1 AND best > 1 AND score < 0.3, false) AS suggested_delete FROM placed)"""
_USABLE = "favorite AND date IS NOT NULL AND NOT screenshot AND NOT ismissing"
_ALBUMS = "members AS (SELECT CASE WHEN event_id % 7 = 0 THEN 'To Delete' ELSE 'Trip' END AS album, CAST(event_id AS VARCHAR) AS uuid FROM events WHERE event_id % 7 < 2)"
_FEEDBACK = """added AS (SELECT event_id AS n, CAST(event_id AS VARCHAR) AS uuid FROM events WHERE event_id % 5 = 0 OR event_id % 14 = 0),
 flags AS (SELECT n, uuid, n % 25 = 0 AS rescued, n % 35 = 0 AS deleted, n % 7 = 0 AS here, n % 3 <> 1 AS there FROM added),
 status AS (SELECT uuid, CASE WHEN here AND NOT deleted THEN 'pending' WHEN here OR rescued OR deleted THEN 'processed' WHEN there THEN 'rescued' ELSE 'deleted' END AS outcome FROM flags)"""
_BAND = "CASE WHEN score >= 0.8 THEN 0.8 WHEN score >= 0.6 THEN 0.6 WHEN score >= 0.4 THEN 0.4 WHEN score >= 0.2 THEN 0.2 ELSE 0.0 END"
_DECIDED = f"""{_SERIES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score DESC NULLS LAST, date, uuid) AS rk FROM scan),
 groups AS (SELECT series_id, -count(*) FILTER (suggested_delete) AS d FROM scan GROUP BY series_id), ordered AS (SELECT series_id, row_number() OVER (ORDER BY d, series_id) AS o FROM groups),
 quit AS (SELECT coalesce(min(o), 1000000000) AS q FROM ordered WHERE series_id % 501 = 500),
 decided AS (SELECT uuid, series_id, path, CASE WHEN o >= q OR series_id % 501 = 500 THEN 'none' ELSE CASE series_id % 6 WHEN 0 THEN CASE WHEN rk IN (1, 3) THEN 'keep' ELSE 'delete' END WHEN 1 THEN CASE WHEN rk IN (1, 3) THEN 'delete' ELSE 'keep' END
 WHEN 2 THEN 'delete' WHEN 3 THEN CASE WHEN suggested_delete THEN 'delete' ELSE 'keep' END WHEN 4 THEN 'keep' ELSE 'none' END END AS decision FROM ranked JOIN ordered USING (series_id), quit)"""
_VECTORS = "vectors AS (SELECT l.doc_id, l.quality AS label, CAST(e.embedding AS DOUBLE[]) AS v FROM labels l JOIN embeddings e ON e.vec_id = l.doc_id % (SELECT count(*) FROM embeddings))"
_TRAINING = f"""{_PHOTOS}, {_FILES}, resolved AS (SELECT *, CASE WHEN path IN (FROM files) THEN path WHEN path_edited IN (FROM files) THEN path_edited END AS chosen FROM photos),
 wanted AS (SELECT chosen, 'library' AS origin, 1 AS label FROM resolved WHERE {_USABLE} AND date < TIMESTAMP '{CUTOFF}' OR n % 25 = 0 UNION ALL SELECT chosen, 'feedback', 0 FROM resolved WHERE n % 35 = 0 AND NOT ismissing),
 rows AS (SELECT chosen AS path, origin, label FROM wanted WHERE chosen IS NOT NULL AND NOT lower(chosen) LIKE '%.mov' UNION ALL SELECT path, 'folder', 0 FROM files WHERE path LIKE '/edited/%')"""
_KEYWORDS = " OR ".join(f"contains(lower(coalesce(text, '')), '{k}')" for k in readers.DEFAULT_KEYWORDS)
_IMPORTANT = " OR ".join(f"contains(lower(body), '{k}')" for k in RULES.keywords)
_MESSAGES = f"""m AS (SELECT conv_id AS n, turn AS t, conv_id * 1000 + turn AS message_id, role, 'Author ' || conv_id % 20 AS author, conv_id || '_' || turn AS name,
 'https://x.com/user' || conv_id % 50 || '/status/' || (conv_id * 100 + turn) AS link, text FROM conversations),
 e AS (SELECT *, CASE WHEN t = 0 THEN text || ' ' || link ELSE text END || CASE WHEN n % 5 = 0 AND text <> '' THEN chr(10) || text ELSE '' END AS body,
 CASE WHEN n % 5 = 0 THEN CASE WHEN n % 4 = 0 THEN 'https://netflix.com/' || name ELSE link END WHEN t = 0 THEN link END AS url, CASE WHEN t = 0 OR n % 5 = 0 AND n % 4 <> 0 THEN 'user' || n % 50 END AS username,
 CASE WHEN t % 3 = 1 THEN ['https://cdn.example/' || name || '.jpg?x=1'] ELSE [] END || CASE WHEN n % 5 = 0 AND t % 4 = 0 THEN ['https://img.example/' || name || '.png'] ELSE [] END || CASE WHEN n % 5 = 0 AND t * 60 > 100 THEN ['https://t.example/' || name || '.jpg'] ELSE [] END AS images,
 CASE WHEN t % 5 = 2 THEN ['https://cdn.example/' || name || '.mp4'] ELSE [] END || CASE WHEN t % 7 = 3 THEN ['https://cdn.example/' || name || '.gif'] ELSE [] END || CASE WHEN n % 5 = 0 AND n % 6 = 0 THEN ['https://v.example/' || name || '.mp4'] ELSE [] END || CASE WHEN n % 5 = 0 AND t % 4 <> 0 THEN ['https://img.example/' || name || '.GIF'] ELSE [] END AS videos FROM m),
 b AS (SELECT *, len(images) + len(videos) > 0 AND url IS NULL AND lag(url) OVER w IS NOT NULL AS take, lag(url) OVER w AS purl, lag(username) OVER w AS puser FROM e WINDOW w AS (PARTITION BY n ORDER BY message_id)),
 c AS (SELECT * EXCLUDE (url, username), CASE WHEN take THEN purl ELSE url END AS url, CASE WHEN take THEN puser ELSE username END AS username, {_IMPORTANT} AS important, contains(lower(author), 'author 3') OR contains(lower(author), 'author 7') AS always FROM b),
 x AS (SELECT message_id, important, always, unnest(list_transform(images, lambda u: {{'url': u, 'kind': 'image'}}) || list_transform(videos, lambda u: {{'url': u, 'kind': 'video'}})) AS k FROM c),
 xs AS (SELECT message_id, important, always, k.url AS url, k.kind AS kind, ('0x' || substr(md5(k.url), 1, 4))::INTEGER AS h FROM x),
 f AS (SELECT *, (h % 1000) / 1000.0 AS score FROM xs WHERE h % 10 <> 0),
 r AS (SELECT message_id, url, kind, CASE WHEN kind = 'image' AND NOT always THEN score END AS score, CASE WHEN kind = 'image' THEN CASE WHEN always OR score >= 0.7 THEN 'curated' ELSE 'all' END WHEN important OR always THEN 'curated' ELSE 'videos' END AS destination FROM f
 UNION ALL SELECT message_id, url, kind, CASE WHEN NOT always THEN score END, 'announcements' FROM f WHERE kind = 'image' AND important)"""
_SETS = f"WITH {_FEEDBACK} SELECT uuid FROM flags WHERE "

_DIGEST = "md5(array_to_string(list_transform({}, lambda x: CAST(round(x * {}) AS INTEGER)), ','))"
_EXT = "CASE WHEN contains(split_part(split_part({0}, '/', -1), '?', 1), '.') THEN '.' || split_part(split_part(split_part({0}, '/', -1), '?', 1), '.', -1) ELSE '.jpg' END"
_ENTRIES = """entries AS (SELECT message_id, author, url AS tweet_url, body AS text FROM c WHERE important AND len(images) + len(videos) = 0
 UNION ALL SELECT message_id, c.author, c.url, c.body FROM f JOIN c USING (message_id) WHERE f.important AND kind = 'image')"""
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\[([^\]]+)\]\(<[^>]+>\)', '\1', 'g'), 'https?://(twitter|x)\.com/\S+/status/\d+', '', 'g'), '\s+', ' ', 'g'))"
_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_CHUNKS = f"""RECURSIVE d AS (SELECT doc_id, text FROM documents WHERE {_TRIM.format('text')} <> ''),
 b AS (SELECT doc_id, generate_subscripts(s, 1) AS i, {_TRIM.format('unnest(s)')} AS rest FROM (SELECT doc_id, string_split(text, chr(10) || '---' || chr(10)) AS s FROM d WHERE length(text) > 5500)),
 cuts AS (SELECT doc_id, i, 0 AS k, '' AS chunk, rest FROM b UNION ALL
  SELECT doc_id, i, k + 1, CASE WHEN length(rest) <= 5500 THEN rest ELSE left(rest, n) END, CASE WHEN length(rest) <= 5500 THEN '' ELSE {_TRIM.format('substr(rest, n + 1)')} END
  FROM (SELECT *, CASE WHEN q BETWEEN 1 AND 5499 THEN 5500 - q ELSE 5500 END AS n FROM (SELECT *, strpos(reverse(left(rest, 5500)), chr(10)) AS q FROM cuts WHERE rest <> ''))),
 pieces AS (SELECT doc_id, i, k, chunk FROM cuts WHERE k > 0 UNION ALL SELECT doc_id, 1, 1, text FROM d WHERE length(text) <= 5500),
 chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS INTEGER) AS part, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS parts, chunk FROM pieces)"""

ORACLE_SQL = {
    "read_photos": f"WITH {_PHOTOS} SELECT uuid, path, favorite, screenshot, ismissing FROM photos",
    "read_album_members": f"WITH {_ALBUMS} SELECT DISTINCT uuid FROM members WHERE album = 'To Delete'",
    "backfill_messages": "SELECT conv_id * 1000 + turn AS message_id, conv_id AS channel_id FROM conversations WHERE conv_id IN (1, 2, 3, 5, 8, 13, 21, 34) AND TIMESTAMP '2024-01-01' + to_hours(conv_id % 48) + to_minutes(turn) > TIMESTAMP '2024-01-01 06:00:00'",
    "monitored_channel": "SELECT conv_id * 1000 + turn AS message_id FROM conversations WHERE conv_id IN (1, 2, 3, 5, 8) AND role <> 'system'",
    "scan_candidates": f"WITH {_PHOTOS} SELECT uuid, path FROM photos WHERE {_USABLE} AND date >= TIMESTAMP '{CUTOFF}'",
    "scan_candidates_limit": f"WITH {_PHOTOS} SELECT uuid FROM photos WHERE {_USABLE} AND date >= TIMESTAMP '{CUTOFF}' ORDER BY date, uuid LIMIT 50",
    "training_positives": f"WITH {_PHOTOS} SELECT uuid FROM photos WHERE {_USABLE} AND date < TIMESTAMP '{CUTOFF}'",
    "resolve_path": f"WITH {_PHOTOS}, {_FILES} SELECT uuid, path FROM (SELECT uuid, CASE WHEN path IN (FROM files) THEN path WHEN path_edited IN (FROM files) THEN path_edited END AS path FROM photos) WHERE path IS NOT NULL AND NOT lower(path) LIKE '%.mov'",
    "resolve_path_counts": f"WITH {_PHOTOS}, {_FILES} SELECT count(*) FILTER (path IS NULL) AS skipped, count(*) FILTER (lower(path) LIKE '%.mov') AS skipped_videos FROM (SELECT CASE WHEN path IN (FROM files) THEN path WHEN path_edited IN (FROM files) THEN path_edited END AS path FROM photos)",
    "below_threshold": f"WITH {_SCORED} SELECT uuid, score FROM scored WHERE score < 0.8",
    "library_summary": f"WITH {_PHOTOS} SELECT count(*) AS total, count(*) FILTER (favorite) AS favorites, count(*) FILTER (NOT favorite) AS non_favorites FROM photos",
    "favorite_period_crosstab": f"WITH {_PHOTOS} SELECT CASE WHEN grouping(favorite) = 1 THEN 'total' WHEN favorite THEN 'favorite' ELSE 'other' END AS kind, count(*) FILTER (date < TIMESTAMP '{CUTOFF}') AS before_cutoff, count(*) FILTER (date >= TIMESTAMP '{CUTOFF}') AS from_cutoff FROM photos GROUP BY ROLLUP (favorite)",
    "media_type_counts": f"WITH {_PHOTOS} SELECT count(*) FILTER (screenshot) AS screenshot_count, count(*) FILTER (selfie) AS selfie_count, count(*) FILTER (live_photo) AS live_photo_count, count(*) FILTER (burst) AS burst_count FROM photos",
    "training_mode_hint": f"WITH {_PHOTOS} SELECT count(*) FILTER (NOT favorite) AS non_favorites, CASE WHEN count(*) FILTER (NOT favorite) < 100 THEN 'one-class' ELSE 'binary' END AS mode FROM photos",
    "date_range": "SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_date, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_date FROM events",
    "album_count": f"WITH {_ALBUMS} SELECT count(DISTINCT album) AS albums FROM members",
    "score_distribution": f"WITH {_SCORED}, c AS (SELECT {_BAND} AS band_from, count(*) AS n FROM scored WHERE score IS NOT NULL GROUP BY 1), b AS (SELECT unnest([0.0, 0.2, 0.4, 0.6, 0.8]) AS band_from) SELECT CAST(b.band_from AS DOUBLE) AS band_from, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT count(score) FROM scored), 1) AS percent FROM b LEFT JOIN c ON b.band_from = c.band_from",
    "move_histogram": f"WITH {_SCORED} SELECT CAST({_BAND} AS DOUBLE) AS band_from, count(*) AS n FROM scored WHERE score < 0.7 GROUP BY 1",
    "preview_moves": f"WITH {_SCORED} SELECT uuid, score FROM scored WHERE score < 0.5 ORDER BY date, uuid LIMIT 20",
    "with_global_rank": f"WITH {_SCORED} SELECT uuid, row_number() OVER (ORDER BY date, uuid) - 1 AS rank FROM scored",
    "close_time_runs": f"WITH {_SCORED}, g AS (SELECT date, CASE WHEN date - lag(date) OVER (ORDER BY date) <= INTERVAL 60 SECOND THEN 0 ELSE 1 END AS fresh FROM scored), r AS (SELECT date, sum(fresh) OVER (ORDER BY date) AS run FROM g) SELECT strftime(min(date), '%Y-%m-%d %H:%M:%S') AS run_start, count(*) AS n FROM r GROUP BY run",
    "series_pairs": f"WITH {_SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY date, uuid) AS k FROM scored) SELECT a.uuid AS src, b.uuid AS dst FROM r a JOIN r b ON b.k > a.k AND b.k <= a.k + 99 AND b.date <= a.date + INTERVAL 300 SECOND",
    "series_pairs_by_look": f"WITH {_SCORED}, v AS (SELECT s.*, CAST(e.embedding AS DOUBLE[]) AS x FROM scored s JOIN embeddings e ON e.vec_id = s.n % (SELECT count(*) FROM embeddings)), r AS (SELECT *, row_number() OVER (ORDER BY date, uuid) AS k FROM v) SELECT a.uuid AS src, b.uuid AS dst FROM r a JOIN r b ON b.k > a.k AND b.k <= a.k + 99 AND b.date <= a.date + INTERVAL 900 SECOND WHERE list_cosine_similarity(a.x, b.x) >= 0.25 OR bit_count(xor((a.n // 2) * 7919, (b.n // 2) * 7919)) <= 2 OR b.date <= a.date + INTERVAL 5 SECOND",
    "cosine_and_hamming": f"""WITH {_SCORED}, t AS (SELECT count(*) AS t FROM embeddings), e AS (SELECT vec_id, (vec_id + 1) % t AS next, CAST(embedding AS DOUBLE[]) AS x FROM embeddings, t),
c AS (SELECT a.vec_id, round(list_cosine_similarity(a.x, b.x), 4) AS cosine FROM e a JOIN e b ON b.vec_id = a.next), k AS (SELECT uuid, n, n % t AS vec_id FROM scored, t WHERE n + 1 IN (SELECT n FROM scored))
SELECT uuid, cosine, CAST(bit_count(xor((n // 2) * 7919, ((n + 1) // 2) * 7919)) AS BIGINT) AS bits FROM k JOIN c USING (vec_id)""",
    "detect_series": f"WITH {_SERIES} SELECT uuid, series_id FROM scan",
    "connected_components": f"WITH {_SERIES}, k AS (SELECT uuid, series_id, row_number() OVER (ORDER BY date, uuid) - 1 AS rank FROM scan) SELECT uuid, min(rank) OVER (PARTITION BY series_id) AS component FROM k",
    "with_series_pos": f"WITH {_SERIES} SELECT uuid, pos AS pos_in_series FROM scan",
    "best_per_series": f"WITH {_SERIES} SELECT series_id, uuid AS best_uuid, size AS n FROM scan WHERE best = 1",
    "deletable_photos": f"WITH {_SERIES} SELECT uuid FROM scan WHERE best > 1",
    "deletion_suggestions": f"WITH {_SERIES} SELECT uuid, series_id, score, size AS series_size FROM scan WHERE suggested_delete",
    "worst_suggestions": f"WITH {_SERIES} SELECT uuid, score FROM scan WHERE suggested_delete ORDER BY score, uuid LIMIT 20",
    "flag_suggested": f"WITH {_SERIES} SELECT uuid, series_id, suggested_delete FROM scan",
    "series_stats": f"WITH {_SERIES}, g AS (SELECT series_id, count(*) AS n, count(*) FILTER (suggested_delete) AS d FROM scan GROUP BY 1) SELECT sum(n) AS photos, count(*) AS series, count(*) FILTER (n = 1) AS singletons, coalesce(sum(n) FILTER (n > 1), 0) AS in_series, sum(d) AS suggested, sum(n - d) AS kept FROM g",
    "write_and_latest_scan": f"WITH {_SERIES} SELECT uuid, series_id, suggested_delete FROM scan",
    "scan_json_round_trip": f"WITH {_SERIES} SELECT uuid, series_id, score FROM scan",
    "deletion_report": f"WITH {_SERIES} SELECT format('{{:.3f}}', score) || chr(9) || path AS value FROM scan WHERE suggested_delete",
    "rank_in_series": f"WITH {_SERIES} SELECT uuid, row_number() OVER (PARTITION BY series_id ORDER BY score DESC NULLS LAST, date, uuid) AS rank_in_series FROM scan",
    "series_with_suggestions": f"WITH {_SERIES} SELECT uuid, series_id FROM scan WHERE series_id IN (SELECT series_id FROM scan WHERE suggested_delete)",
    "review_groups": f"WITH {_SERIES} SELECT series_id, count(*) AS photos, count(*) FILTER (suggested_delete) AS deletable_count FROM scan GROUP BY 1 HAVING count(*) FILTER (suggested_delete) > 0",
    "apply_review_decisions": f"WITH {_DECIDED} SELECT uuid, series_id, decision FROM decided",
    "review_summary": f"WITH {_DECIDED} SELECT decision, count(*) AS n FROM decided GROUP BY 1",
    "confirmed_deletes": f"WITH {_DECIDED} SELECT path FROM decided WHERE decision = 'delete'",
    "not_in_album": _SETS + "NOT here",
    "still_in_album": _SETS + "here",
    "to_check": _SETS + "NOT here AND NOT rescued AND NOT deleted",
    "pending": _SETS + "here AND NOT deleted",
    "split_existing": f'WITH {_FEEDBACK} SELECT uuid, there AS "exists" FROM flags',
    "feedback_status": f"WITH {_FEEDBACK} SELECT uuid, outcome FROM status",
    "feedback_summary": f"WITH {_FEEDBACK} SELECT outcome, count(*) AS n FROM status GROUP BY 1",
    "preview_feedback": f"WITH {_FEEDBACK} SELECT uuid, outcome FROM status WHERE outcome IN ('rescued', 'deleted') ORDER BY outcome, uuid LIMIT 5",
    "record_added": f"WITH {_PHOTOS} SELECT uuid, 'scan_2' AS scan_file, 'added' AS status FROM photos WHERE favorite AND n % 5 <> 0 AND n % 14 <> 0",
    "append_label_list": f"WITH {_ALBUMS} SELECT DISTINCT uuid FROM members WHERE CAST(uuid AS BIGINT) % 25 <> 0",
    "add_to_album": f"WITH {_PHOTOS} SELECT 'To Delete' AS album, uuid FROM photos WHERE n % 3 <> 1 AND n % 7 <> 0",
    "attach_features": f"WITH {_SCORED} SELECT s.uuid, {_DIGEST.format('CAST(e.embedding AS DOUBLE[])', 1000)} AS features FROM scored s JOIN embeddings e ON e.vec_id = s.n % (SELECT count(*) FROM embeddings) WHERE s.n % 2 = 0",
    "features_to_extract": f"WITH {_SCORED} SELECT path FROM scored WHERE n % 2 <> 0",
    "training_set": f"WITH {_TRAINING} SELECT path, origin, label FROM rows",
    "exact_sample": f"WITH {_PHOTOS} SELECT path FROM photos ORDER BY substr(md5(path || '|42'), 1, 15), path LIMIT 500",
    "training_skipped": f"WITH {_TRAINING} SELECT origin, count(*) FILTER (chosen IS NULL) AS skipped, count(*) FILTER (lower(chosen) LIKE '%.mov') AS skipped_videos FROM wanted GROUP BY origin",
    "training_counts": f"WITH {_TRAINING} SELECT label, origin, path IN (SELECT path FROM files WHERE length(path) % 2 = 0) AS cached, count(*) AS n FROM rows GROUP BY ALL",
    "fit_scaler": f"WITH {_VECTORS}, u AS (SELECT generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM vectors WHERE label = 1) SELECT i, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std FROM u GROUP BY i",
    "standardise": f"WITH {_VECTORS}, u AS (SELECT doc_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM vectors), m AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM u GROUP BY i) SELECT CAST(doc_id AS VARCHAR) AS path, md5(string_agg(CAST(CAST(round((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END * 100) AS INTEGER) AS VARCHAR), ',' ORDER BY i)) AS z FROM u JOIN m USING (i) GROUP BY doc_id",
    "validation_stats": f"WITH {_VECTORS}, a AS (SELECT avg(abs(v[1])) FILTER (label = 1) AS gm, stddev_pop(abs(v[1])) FILTER (label = 1) AS gs, avg(abs(v[1])) FILTER (label = 0) AS bm, stddev_pop(abs(v[1])) FILTER (label = 0) AS bs FROM vectors) SELECT round(gm, 4) AS good_mean, round(gs, 4) AS good_std, round(bm, 4) AS bad_mean, round(bs, 4) AS bad_std, round(gm - bm, 4) AS separation, CASE WHEN gm - bm > 0.3 THEN 'good' WHEN gm - bm > 0.1 THEN 'moderate' ELSE 'low' END AS verdict FROM a",
    "extract_features": """
WITH a AS (SELECT i // 8 AS g, greatest(0, least(7, (i + 0.5) / 4 - 0.5)) AS x FROM (SELECT unnest(range(32)) AS i)),
w AS (SELECT g, p, sum(x) / 8 AS w FROM (SELECT g, floor(x) AS p, 1 - (x - floor(x)) AS x FROM a UNION ALL SELECT g, least(floor(x) + 1, 7), x - floor(x) FROM a) GROUP BY g, p),
c AS (SELECT y.g AS gy, x.g AS gx, y.p * 8 + x.p + 1 AS k, y.w * x.w AS w FROM w y, w x),
v AS (SELECT vec_id, gy, gx, sum(w * least(greatest(round(CAST(embedding[CAST(k AS INTEGER)] AS DOUBLE) * 60 + 128), 0), 255)) / 255 AS v FROM embeddings, c GROUP BY ALL),
n AS (SELECT vec_id, unnest([(v - 0.485) / 0.229, (v - 0.456) / 0.224, (v - 0.406) / 0.225]) AS z FROM v)
SELECT CAST(vec_id AS VARCHAR) AS path, CAST(count(*) AS INTEGER) AS width, round(min(z), 2) + 0 AS least, round(max(z), 2) + 0 AS most, round(avg(z), 2) + 0 AS mean FROM n GROUP BY vec_id""",
    "enrich_messages": f"WITH {_MESSAGES} SELECT message_id, author, url AS tweet_url, username, array_to_string(images, ' ') AS images, array_to_string(videos, ' ') AS videos, md5(body) AS text FROM e",
    "with_previous_message": f"WITH {_MESSAGES} SELECT message_id, url AS tweet_url, username FROM c",
    "explode_media": f"WITH {_MESSAGES} SELECT message_id, url, kind FROM xs",
    "split_by_media": f"WITH {_MESSAGES} SELECT message_id FROM c WHERE important AND len(images) + len(videos) = 0",
    "attach_media": f"WITH {_MESSAGES} SELECT message_id, url, CAST(score AS DOUBLE) AS score FROM f",
    "route_media": f"""WITH {_MESSAGES} SELECT r.message_id, r.url, kind, replace(coalesce(c.username, c.author), ' ', '_') || '_20240120_123456_' || substr(md5(r.url), 1, 8) || {_EXT.format('r.url')} AS filename,
 'Author: ' || c.author || chr(10) || coalesce('Source: ' || c.url, '') AS description, CAST(score AS DOUBLE) AS score, destination FROM r JOIN c USING (message_id)""",
    "media_filename": "SELECT page_id, 'Zoë_名_of_a_very_long' || '_20240120_123456_' || substr(md5(url), 1, 8) || CASE WHEN contains(split_part(split_part(url, '/', -1), '?', 1), '.') THEN '.' || split_part(split_part(split_part(url, '/', -1), '?', 1), '.', -1) ELSE '.jpg' END AS filename FROM pages",
    "url_parts": "SELECT page_id, CASE WHEN contains(split_part(split_part(url, '/', -1), '?', 1), '.') THEN '.' || split_part(split_part(split_part(url, '/', -1), '?', 1), '.', -1) ELSE '.jpg' END AS ext, substr(md5(url), 1, 8) AS hash, split_part(url, '/', -1) AS base FROM pages",
    "announcement_entries": f"WITH {_MESSAGES}, {_ENTRIES} SELECT message_id, author, tweet_url, md5(text) AS text FROM entries",
    "announcement_log": f"WITH {_MESSAGES}, {_ENTRIES} SELECT message_id, md5(chr(10) || '---' || chr(10) || 'Date: 2024-01-20 12:34' || chr(10) || 'From: ' || author || coalesce(chr(10) || 'Link: ' || tweet_url, '') || chr(10) || chr(10) || {_CLEAN} || chr(10)) AS entry FROM entries",
    "chunk_text": f"WITH {_CHUNKS} SELECT doc_id, part, parts, md5(chunk) AS chunk FROM chunks",
    "summarise": f"""WITH {_CHUNKS}, n AS (SELECT doc_id, parts, any_value(chunk) AS chunk FROM chunks GROUP BY doc_id, parts)
SELECT doc_id, CASE WHEN parts > 1 THEN array_to_string(list_transform(range(1, parts + 1), lambda i: '### Part ' || i), chr(10))
 ELSE array_to_string(list_transform(list_filter(string_split(chunk, chr(10) || '---' || chr(10)), lambda b: {_TRIM.format('b')} <> ''), lambda b: split_part({_TRIM.format('b')}, chr(10), 1)), chr(10)) END AS summary FROM n""",
    "curation_counters": f"WITH {_MESSAGES} SELECT count(*) FILTER (kind = 'image' AND destination <> 'announcements') AS images_seen, count(*) FILTER (kind = 'image' AND destination = 'curated') AS images_curated, (SELECT count(*) FROM c WHERE important) AS announcements, count(*) FILTER (destination = 'videos') AS videos_saved, count(*) FILTER (kind = 'video' AND destination = 'curated') AS videos_curated FROM r",
    "channel_counts": "SELECT conv_id AS channel_id, count(*) AS n FROM conversations GROUP BY 1",
    "dedupe_messages": "SELECT DISTINCT conv_id * 1000 + turn AS message_id FROM conversations",
    "is_announcement": f"SELECT doc_id, {_KEYWORDS} AS hit, contains(lower(source), 'src1') OR contains(lower(source), 'src7') AS always FROM documents",
    "clean_announcement": f"SELECT doc_id, md5({_CLEAN}) AS clean, substr(text, 1, 100) AS lead FROM documents",
    "hours_before": f"WITH {_SCORED} SELECT count(*) AS n, round(100.0 * count(score) / count(*), 1) AS scored_percent FROM scored WHERE date > TIMESTAMP '{NOW}' - INTERVAL 48 HOUR",
    "curate_stream": f"WITH {_MESSAGES}, p AS (SELECT message_id, generate_subscripts(images || videos, 1) - 1 AS media_pos, unnest(images || videos) AS url FROM c) SELECT r.message_id, p.media_pos, r.url, r.destination FROM r JOIN p ON p.message_id = r.message_id AND p.url = r.url",
    "dedupe_stream": "SELECT DISTINCT conv_id * 1000 + turn AS message_id, conv_id AS channel_id FROM conversations",
    "stream_counters": f"WITH {_MESSAGES} SELECT n AS channel_id, count(*) FILTER (important) AS announcements, CAST(sum(len(images) + len(videos)) AS BIGINT) AS media FROM c GROUP BY 1",
}
