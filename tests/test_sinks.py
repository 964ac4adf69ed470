from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from curalume.functions import text as tx
from curalume.operators import media, photos, training
from curalume.plans import tables
from curalume.sources import readers, schemas, sinks
from curalume.sources.snapshots import Snapshots

import pytest

D = datetime(2024, 1, 1)
ROUTED = "message_id long, media_pos int, url string, filename string, destination string"


def test_scans_written_twice_are_there_once(spark, frame, tmp_path):
    scan = frame([("a", 1, True), ("b", 1, False)], "uuid string, series_id long, suggested_delete boolean")
    for name in ("1", "2", "1"):
        sinks.write_scan_result(scan, sinks.scan_header(scan, name, F.lit(D), F.lit(D), 0.3), name, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "photos")).count() == 4 and spark.read.parquet(str(tmp_path / "header")).count() == 2


def test_routed_media_overwrite_equal_names_and_retries(spark, frame, tmp_path):
    rows = frame([(1, 0, "u", "x.jpg", "all"), (2, 0, "v", "x.jpg", "all"), (2, 0, "v", "x.jpg", "curated")], ROUTED)
    for _ in range(2):
        sinks.write_routed(rows, str(tmp_path), "7")
    assert {(r.message_id, r.url, r.destination) for r in spark.read.parquet(str(tmp_path)).collect()} == {(2, "v", "all"), (2, "v", "curated")}


def test_two_writers_from_one_snapshot(spark, frame, tmp_path):
    path, keys = str(tmp_path / "t"), ["uuid"]
    one, other = (Snapshots(spark, path, "uuid string, scan_file string", keys) for _ in range(2))
    assert one.read().count() == 0 and one.version() == 0
    rows = lambda names, file: frame([(n, file) for n in names], "uuid string, scan_file string")
    seen = []

    def late(now):
        seen.append(now.count())
        if len(seen) == 1:  # another writer commits after this one has read the table
            assert other.append_new(rows("bc", "second")) == 2
        return rows("abb", "first")

    assert one.append_new(late) == 1 and seen == [0, 2]
    assert sorted(tuple(r) for r in one.read().collect()) == [("a", "first"), ("b", "second"), ("c", "second")]
    assert one.append_new(rows("abc", "again")) == 0 and one.version() == 2
    assert sorted(r.uuid for r in one.read(1).collect()) == ["b", "c"]
    rows("z", "of a job that broke off").write.parquet(f"{path}/commit=orphan")
    assert one.append_new(rows([None, None], "null")) == 1 and one.append_new(rows([None], "null")) == 0
    assert one.read().count() == 4 and one.vacuum() == 1 and one.read().count() == 4 and one.version() == 3


def test_many_commits_are_packed(spark, frame, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), "uuid string", ["uuid"], every=3)
    for i in range(8):
        assert table.append_new(frame([(str(i),), (str(i // 2),)], "uuid string")) == 1
    assert sorted(r.uuid for r in table.read().collect()) == [str(i) for i in range(8)]
    assert len(table._folders(table.version())) <= 3 and table.vacuum() > 0 and table.read().count() == 8


def test_sinks_of_histories_take_each_row_once(spark, frame, tmp_path):
    none = frame([], "uuid string, added_date timestamp, scan_file string, status string")
    for file in ("one", "two"):
        n = sinks.record_added(none, frame([("a",), ("b",), ("b",)], "uuid string"), file, F.lit(D), str(tmp_path / "h"))
        assert n == (2 if file == "one" else 0)
    assert {r.scan_file for r in readers.read_snapshots(spark, str(tmp_path / "h"), schemas.FEEDBACK).collect()} == {"one"}
    labels = frame([("a",)], "uuid string")
    assert [sinks.append_label_list(labels, frame([("a",), ("b",)], "uuid string"), str(tmp_path / "l")) for _ in range(2)] == [1, 0]
    sinks.append_features(frame([("p", [1.0])], "path string, features array<double>"), frame([], "path string, features array<double>"), str(tmp_path / "c"))
    assert [(r.path, r.features) for r in readers.read_feature_cache(spark, str(tmp_path / "c")).collect()] == [("p", [1.0])]


def test_logs_and_summaries(spark, frame, tmp_path):
    log = frame([("\n---\nDate: x\n",)], "entry string").coalesce(1)
    for batch in ("1", "2", "1"):
        sinks.append_announcement_log(log, str(tmp_path / "log"), batch)
    assert sorted(r.text for r in readers.read_announcement_log(spark, str(tmp_path / "log" / "*" / "*.txt")).collect()) == ["\n---\nDate: x\n"] * 2
    summary = frame([("one \n",)], "summary string").coalesce(1)
    assert [r.value for r in sinks.write_summary(summary).collect()] == ["one\n"]
    sinks.write_summary(summary, str(tmp_path / "s"))
    assert [r.value for r in spark.read.text(str(tmp_path / "s"), wholetext=True).collect()] == ["one\n"]


def test_feature_cache_and_lists(spark, frame, tmp_path):
    assert readers.read_feature_cache(spark, str(tmp_path / "none")).count() == 0
    frame([("a", [1.0, 2.0])], "path string, features array<float>").write.parquet(str(tmp_path / "c"))
    assert [(r.path, r.features) for r in readers.read_feature_cache(spark, str(tmp_path / "c")).collect()] == [("a", [1.0, 2.0])]
    paths = frame([("a",), ("a",), ("b",)], "path string")
    assert sorted(r.path for r in training.distinct_paths(paths).collect()) == ["a", "b"]
    named = frame([("1", "a"), ("2", "b")], "uuid string, path string")
    more = frame([("2", "other"), ("3", "c"), ("3", "c")], "uuid string, path string")
    assert sorted(tuple(r) for r in training.union_positives(named, more).collect()) == [("1", "a"), ("2", "b"), ("3", "c")]


def test_exact_sample_is_of_its_size_and_the_same_each_time(frame):
    rows = frame([(str(i),) for i in range(300)], "path string")
    a, b = ({r.path for r in training.exact_sample(x, 40).collect()} for x in (rows, rows.repartition(7)))
    assert a == b and len(a) == 40 and training.exact_sample(rows, 999).count() == 300
    assert a != {r.path for r in training.exact_sample(rows, 40, seed=1).collect()}


def test_formats_and_descriptions(frame):
    found = frame([(bytearray(b"\xff\xd8\xff"),), (bytearray(b"\x89PNG\r"),), (bytearray(b"GIF8"),), (bytearray(b""),)], "c binary").select(tx.sniff_format("c").alias("k"), "c").collect()
    assert {bytes(r.c)[:1]: r.k for r in found} == {b"\xff": "jpeg", b"\x89": "png", b"G": "other", b"": "other"}
    rows = frame([("Ann", "http://l"), (None, "http://l"), ("Ann", ""), ("", None)], "a string, l string").select(tx.media_description("a", "l").alias("d"))
    assert sorted(r.d for r in rows.collect()) == ["", "Author: Ann\n", "Author: Ann\nSource: http://l", "Source: http://l"]


def test_bad_pixels_are_left_out(frame):
    good = bytes(range(192))
    rows = [("a", 8, 8, good), ("b", 8, 8, None), ("c", 8, 8, good[:9]), ("d", None, 8, good), ("e", 0, 0, b"")]
    images = frame(rows, "path string, width int, height int, rgb binary")
    assert [r.path for r in media.extract_features(images).collect()] == ["a"]
    assert {r.path: r.phash is not None for r in media.phash(images).collect()} == {x: x == "a" for x in "abcde"}


def test_phash_matches_a_plain_transform(frame):
    r = np.random.default_rng(1)
    image = r.integers(0, 256, (32, 32, 3), dtype=np.uint8)
    grey = image @ np.array([0.299, 0.587, 0.114])
    low = [[sum(grey[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
    middle = np.median(low)
    expected = f"{int(''.join('1' if c > middle else '0' for row in low for c in row), 2):016x}"
    assert media.phash(frame([("a", 32, 32, image.tobytes())], "path string, width int, height int, rgb binary")).first().phash == expected


def test_unknown_favourite_is_no_total(frame):
    rows = frame([(True, D), (None, D), (None, D), (False, D)], "favorite boolean, date timestamp")
    found = photos.favorite_period_crosstab(rows, F.lit("2024-06-01").cast("timestamp")).collect()
    assert sorted((r.kind, r.before_cutoff) for r in found) == [("favorite", 1), ("other", 1), ("other", 2), ("total", 4)]


def test_a_cluster_must_name_the_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        tables.shared_dir(Session())
