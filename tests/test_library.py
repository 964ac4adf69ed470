import struct
import zlib
from datetime import datetime

from pyspark.sql import functions as F

from curalume.operators import feedback, media, photos, review
from curalume.sources import readers, sinks

D = datetime(2024, 1, 1)


def test_resolve_path_prefers_an_existing_original(frame):
    p = frame([("1", "/a.jpg", "/e1.jpg"), ("2", "/b.MOV", "/e2.jpg"), ("3", "/c.jpg", "/e3.jpg"), ("4", "/d.jpg", None), ("5", "/f.jpg", "/e5.mp4")], "uuid string, path string, path_edited string")
    files = frame([("/a.jpg",), ("/b.MOV",), ("/e2.jpg",), ("/e3.jpg",), ("/e5.mp4",)], "path string")
    assert {r.uuid: r.path for r in photos.resolve_path(p, files).collect()} == {"1": "/a.jpg", "3": "/e3.jpg"}
    assert tuple(photos.resolve_path(p, files, counts=True).first()) == (1, 2)


def test_histogram_edges_fall_in_the_upper_band(frame):
    s = frame([(x,) for x in (0.2, 0.4, 0.6, 0.8, None)], "score double").withColumn("uuid", F.lit("u"))
    assert {r.band_from: (r.n, r.percent) for r in photos.score_distribution(s).collect()} == {0.0: (0, 0.0), 0.2: (1, 25.0), 0.4: (1, 25.0), 0.6: (1, 25.0), 0.8: (1, 25.0)}


def test_below_threshold_ignores_series(frame):
    s = frame([("best", 0.7), ("", 0.1), ("high", 0.9)], "uuid string, score double")
    assert [r.uuid for r in photos.below_threshold(s, 0.8).collect()] == ["best"]


def test_rescued_photo_back_in_the_album_is_pending(frame):
    f = frame([("r", D, "s", "added"), ("r", None, None, "rescued"), ("d", D, "s", "added"), ("x", D, "s", "added"), ("x", None, None, "confirmed_delete"), ("k", D, "s", "added")], "uuid string, added_date timestamp, scan_file string, status string")
    status = feedback.feedback_status(f, frame([("r",), ("x",)], "uuid string"), frame([("k",)], "uuid string"))
    assert {r.uuid: r.outcome for r in status.collect()} == {"r": "pending", "d": "deleted", "x": "processed", "k": "rescued"}


def test_first_write_wins_and_appends_are_idempotent(spark, frame, tmp_path):
    history = frame([("a", D, "old", "added")], "uuid string, added_date timestamp, scan_file string, status string")
    path = str(tmp_path / "history")
    sinks.record_added(history, frame([("a",), ("b",), ("b",)], "uuid string"), "new", F.lit(D), path)
    assert [(r.uuid, r.scan_file) for r in spark.read.parquet(path).collect()] == [("b", "new")]


def test_album_takes_only_new_photos_of_the_library(frame, tmp_path):
    members, library = frame([("A", "1")], "album string, uuid string"), frame([("1",), ("2",)], "uuid string")
    assert sinks.add_to_album(members, frame([("1",), ("2",), ("3",), ("",)], "uuid string"), library, "A", str(tmp_path / "m")) == 1


def test_decisions(frame):
    rows = [(i, f"{i}{k}", k, k == 3) for i in range(7) for k in (1, 2, 3)]
    ranked = frame(rows, "series_id long, uuid string, rank_in_series int, suggested_delete boolean")
    d = frame([(0, "k", [1, 9]), (1, "d", [2]), (2, "da", []), (3, "y", []), (4, "n", []), (5, "q", []), (6, "da", [])], "series_id long, action string, positions array<int>")
    found = {}
    for r in review.apply_review_decisions(ranked, d).orderBy("uuid").collect():
        found[r.series_id] = found.get(r.series_id, "") + r.decision[0]
    assert found == {0: "kdd", 1: "kdk", 2: "ddd", 3: "kkd", 4: "kkk", 5: "nnn", 6: "nnn"}


def png(path, rows):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(x for p in r for x in p) for r in rows)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    folder = tmp_path / "bad"
    (folder / "deep").mkdir(parents=True)
    png(folder / "a.png", [[(255, 0, 0)] * 8, *[[(0, 0, 255)] * 8] * 7])
    png(folder / "deep" / "b.PNG", [[(0, 0, 0), (255, 255, 255)] * 4] * 8)
    (folder / "c.Png").write_bytes(b"mixed case")
    (folder / "d.jpg").write_bytes(b"not an image")
    assert sorted(r.path.rsplit("/", 1)[1] for r in readers.read_image_folder(spark, str(folder)).collect()) == ["a.png", "b.PNG", "d.jpg"]
    images = readers.load_images(spark, str(folder)).cache()
    red = images.where("path like '%a.png'").first()
    assert (red.width, red.height, bytes(red.rgb[:3])) == (8, 8, b"\xff\0\0")
    assert images.count() == 2
    assert all(len(r.features) == 48 for r in media.extract_features(images).collect())
    hashes = {r.phash for r in media.phash(images).collect()}
    assert len(hashes) == 2 and all(len(h) == 16 for h in hashes)
    assert readers.read_image_folder(spark, str(tmp_path / "none")).count() == 0


def test_rules_and_histories(spark, tmp_path):
    assert readers.read_rules(spark, str(tmp_path / "none.json")) == readers.Rules()
    (tmp_path / "r.json").write_text('{"score_threshold": 0.9, "always_curate_accounts": ["x"]}')
    rules = readers.read_rules(spark, str(tmp_path / "r.json"))
    assert rules.threshold == 0.9 and rules.keywords == readers.DEFAULT_KEYWORDS and rules.accounts == ("x",)
    assert readers.read_rules(spark, str(tmp_path / "r.json"), 0.1).threshold == 0.1
    (tmp_path / "h.json").write_text('{"added_to_album": {"u": {"added_date": "2024-01-01T00:00:00", "scan_file": "s"}}, "rescued": ["v"], "confirmed_delete": []}')
    assert {(r.uuid, r.status) for r in readers.read_feedback_history(spark, str(tmp_path / "h.json")).collect()} == {("u", "added"), ("v", "rescued")}
    (tmp_path / "l.json").write_text('["a", "b"]')
    assert {r.uuid for r in readers.read_label_list(spark, str(tmp_path / "l.json")).collect()} == {"a", "b"}
    assert readers.read_label_list(spark, str(tmp_path / "no.json")).count() == 0
    (tmp_path / "log.txt").write_bytes(b"a\xff\n---\n")
    assert readers.read_announcement_log(spark, str(tmp_path / "log.txt")).first().text.startswith("a")
