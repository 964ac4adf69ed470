import random
import types
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import functions as F

from curalume.functions import text as tx
from curalume.operators import digest, messages
from curalume.plans.tables import complete, saved
from curalume.sources import readers, schemas
from curalume.streaming import curation, previous
from curalume.streaming.ledger import Counters, Ledger
from curalume.streaming.previous import PreviousMessage, with_previous_message_stream

D = datetime(2024, 1, 1)
RULES = readers.Rules(threshold=0.7, keywords=("drop", "NEW"), accounts=("Star",))


class Longest(AccumulatorParam):
    def zero(self, value):
        return value

    def addInPlace(self, a, b):
        return max(a, b)


def now():
    return F.lit("2024-01-08 14:30:22").cast("timestamp")



def one(frame, column, value):
    return frame([(value,)], "x string").select(column("x")).first()[0]


def test_keywords(frame):
    assert one(frame, lambda x: tx.is_announcement(x, RULES.keywords), "raindrop")
    assert not one(frame, lambda x: tx.is_announcement(x, ("NEW",)), "NEW thing")
    assert one(frame, lambda x: tx.is_always_curate(x, ("STAR",)), "a star b")
    assert not one(frame, lambda x: tx.is_always_curate(x, ("STAR",)), None)


def test_names_and_links(frame):
    name = lambda u, a=None, n=None: frame([(u, a, n)], "u string, a string, n string").select(tx.media_filename("u", F.lit(None).cast("string"), "a", "n", now())).first()[0]
    assert name("https://h/a.png?x=1", "Zoë 名").startswith("Zoë_名_20260108"[:6]) and name("https://h/a.png?x=1", "Zoë 名").endswith(".png")
    assert name("https://h/") .endswith(".jpg") and name("https://h/a?b=/c.gif").endswith(".gif")
    assert name("https://h/a", "!!!").startswith("_2024")
    assert one(frame, tx.clean_author, "Ann • tweetshift ") == "Ann"
    assert one(frame, tx.tweet_user, "see http://x.com/bob/status/12 and https://twitter.com/al/status/3") == "bob"
    assert one(frame, tx.clean_announcement, "[#Tag](<http://u>) [t](<http://v>) https://x.com/a/status/1  end") == "#Tag t end"
    assert frame([(None, "t", None)], "a string, t string, l string").select(tx.render_announcement("a", "l", "t", now())).first()[0] == "\n---\nDate: 2024-01-08 14:30\nFrom: None\n\nt\n"


def message(id_, channel=1, ts=D, author="Bob", content="", attachments=(), embeds=()):
    return (id_, channel, ts, author, False, content, list(attachments), list(embeds))


IMAGE = {"url": "https://c/i.jpg", "content_type": "image/jpeg"}
VIDEO = {"url": "https://c/v.mp4", "content_type": "video/mp4"}


def rows():
    link = "https://x.com/bob/status/9"
    return [
        message(1, content=link + " text", ts=D - timedelta(seconds=1)),
        message(2, ts=D + timedelta(seconds=1), attachments=[IMAGE], author=""),
        message(3, content="a drop", attachments=[VIDEO], ts=D + timedelta(seconds=2)),
        message(4, content="drop two", attachments=[IMAGE, {**IMAGE, "url": "https://c/j.jpg"}], ts=D + timedelta(seconds=3)),
        message(5, content="https://x.com/a/status/1", embeds=[{"url": "https://netflix.com/a", "description": "d", "image": None, "video": None, "thumbnail": {"url": "https://c/t.jpg", "width": 100}}], ts=D + timedelta(seconds=4)),
        message(6, content="a drop without media", ts=D + timedelta(seconds=5)),
        message(6, content="a drop without media", ts=D + timedelta(seconds=5)),
        message(7, channel=2, author="superstar", attachments=[{**IMAGE, "url": "https://c/k.gif", "content_type": "image/gif"}, {**IMAGE, "url": "https://c/l.jpg"}], ts=D + timedelta(seconds=6)),
    ]


def media(frame):
    return frame([("https://c/i.jpg", 0.7), ("https://c/j.jpg", None), ("https://c/v.mp4", None), ("https://c/k.gif", None), ("https://c/l.jpg", 0.1)], "url string, score double")


def test_pipeline(frame):
    found = curation.curate(frame(rows(), schemas.MESSAGES), RULES)
    by = {r.message_id: r for r in found.collect()}
    assert len(by) == 7 == found.count()
    assert (by[2].tweet_url, by[2].username, by[2].author, by[2].text) == ("https://x.com/bob/status/9", "bob", "Bob", "https://x.com/bob/status/9 text")
    assert (by[5].tweet_url, by[5].username, by[5].text, by[5].images) == ("https://netflix.com/a", "a", "https://x.com/a/status/1\nd", [])
    routed = curation.routed(found, media(frame), RULES, now())
    assert {(r.url[10:], r.message_id, r.destination) for r in routed.collect()} == {
        ("i.jpg", 2, "curated"), ("v.mp4", 3, "curated"), ("i.jpg", 4, "curated"), ("i.jpg", 4, "announcements"), ("j.jpg", 4, "all"), ("j.jpg", 4, "announcements"), ("k.gif", 7, "curated"), ("l.jpg", 7, "curated"),
    }
    assert routed.where("message_id = 7 and kind = 'image'").first().score is None
    fetched = messages.attach_media(messages.explode_media(found), media(frame))
    assert sorted(r.message_id for r in messages.announcement_entries(found, fetched).collect()) == [4, 4, 6]
    assert messages.curation_counters(found, routed).first().asDict() == {"images_seen": 4, "images_curated": 3, "announcements": 3, "videos_saved": 0, "videos_curated": 2}


def test_stream_gives_what_the_batch_gives(spark, frame, tmp_path):
    feed(spark, str(tmp_path / "in"), [*([rows()[k] for k in part] for part in ([0, 1], [2, 3, 4], [5, 6, 7])), [message(99, channel=-1, ts=D + timedelta(days=2))]])
    live = readers.stream_messages(spark, str(tmp_path / "in"))
    curation.run(live, media(frame), RULES, now(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = curation.routed(curation.curate(frame(rows(), schemas.MESSAGES), RULES), media(frame), RULES, now())
    key = lambda df: sorted((r.message_id, r.media_pos, r.filename, r.destination) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch)


def feed(spark, path, parts):
    for part in parts:
        spark.createDataFrame(part, schemas.MESSAGES).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_messages_out_of_order_get_their_previous_one(spark, frame, tmp_path, seed):
    r = random.Random(seed)
    told = []
    for i in range(60):
        link = f"https://x.com/u{i}/status/{i}" if r.random() < 0.4 else ""
        media = [IMAGE] if r.random() < 0.6 else []
        told.append(message(i, channel=r.choice([1, 1, 2]), ts=D + timedelta(seconds=i // 2), content=link, attachments=media, author=f"A{i}" if r.random() < 0.7 else ""))
    disordered = sorted(told, key=lambda m: m[2] + timedelta(seconds=r.random() * 20))
    heartbeat = [message(999, channel=-1, ts=D + timedelta(hours=1))]
    feed(spark, str(tmp_path / "in"), [disordered[i : i + 13] for i in range(0, 60, 13)] + [heartbeat])
    live = readers.stream_messages(spark, str(tmp_path / "in"))
    curation.curate(live, RULES, "30 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((m.message_id, m.channel_id, m.ts, m.author, m.text, m.tweet_url, m.username, m.images, m.videos) for m in df.collect())
    found = key(spark.read.parquet(str(tmp_path / "out")).where("channel_id > 0"))
    assert found == key(curation.curate(frame(told, schemas.MESSAGES), RULES)) and len(found) == 60
    assert sum(m[5] is not None and not told[m[0]][5] for m in found) > 2, "some took a link from the message before"


def test_a_silent_channel_forgets_its_last_message(spark, tmp_path):
    link = message(1, content="https://x.com/a/status/1")
    late = message(2, ts=D + timedelta(days=9), attachments=[IMAGE])
    soon = message(3, channel=2, content="https://x.com/b/status/1"), message(4, channel=2, ts=D + timedelta(days=1), attachments=[IMAGE])
    beats = [message(100 + i, channel=-1, ts=D + timedelta(days=d)) for i, d in enumerate((2, 8, 20))]
    feed(spark, str(tmp_path / "in"), [[link, *soon], beats[:1], beats[1:2], [late], beats[2:]])
    known = messages.enrich(readers.stream_messages(spark, str(tmp_path / "in")).withWatermark("ts", "1 second"))
    with_previous_message_stream(known, ttl_days=5).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    found = {m.message_id: m.tweet_url for m in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found[2] is None and found[4] == "https://x.com/b/status/1"


def test_a_copy_months_late_does_not_pass(spark, tmp_path):
    copy = [message(1), message(1), message(2, ts=D + timedelta(days=40))]
    parts = [[message(1), message(5)], [message(2, ts=D + timedelta(days=40))], copy, [message(3, ts=D - timedelta(days=99))], copy + [message(None)], [message(None), message(4)]]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    feed(spark, str(tmp_path / "in"), parts)
    live = readers.stream_messages(spark, str(tmp_path / "in"))
    curation.deduplicated(live, out, state, slot=2, every=2).awaitTermination()
    found = spark.read.parquet(f"{out}/messages")
    assert sorted((m.message_id or 0, m.batch) for m in found.select("message_id", "batch").collect()) == [(0, 4), (0, 5), (1, 0), (2, 1), (3, 3), (4, 5), (5, 0)]
    assert len(list((tmp_path / "out" / "ledger" / "merged").iterdir())) == 1 and len(list((tmp_path / "out" / "ledger" / "batch").iterdir())) <= 3


def test_a_batch_of_the_ledger_that_is_run_again_decides_as_before(spark, frame, tmp_path):
    ledger = Ledger(spark, str(tmp_path), slot=3, every=2)
    ids = lambda df: sorted(x.message_id for x in df.collect())
    for number in range(9):
        rows = frame([(number + k,) for k in range(3)], "message_id long")
        for _ in range(2):
            fresh = saved(ledger.unseen(rows, number))
            assert ids(fresh) == ([0, 1, 2] if number == 0 else [number + 2])
            ledger.add(fresh, number)
    assert ids(ledger.unseen(frame([(i,) for i in range(20)], "message_id long"), 99)) == list(range(11, 20))
    assert len(complete(spark, f"{tmp_path}/batch")) <= 3 and complete(spark, f"{tmp_path}/none") == {}


def test_counters_are_put_together_and_counted_once(spark, frame, tmp_path):
    counters = Counters(spark, str(tmp_path), "channel_id", "channel_id long, n long", every=3)
    assert counters.totals().count() == 0
    for number in range(11):
        for _ in range(2):  # a retry of the last batch
            counters.add(frame([(number % 4, 1), (7, number)], "channel_id long, n long"), number)
    counters.add(frame([(0, 1000)], "channel_id long, n long"), 2)  # put together with others long ago
    assert {x.channel_id: x.n for x in counters.totals().collect()} == {0: 3, 1: 3, 2: 3, 3: 2, 7: 55}
    assert len(complete(spark, f"{tmp_path}/batch")) <= 4 and len(complete(spark, f"{tmp_path}/merged")) == 1


def test_a_text_of_very_many_parts_is_merged_in_bounded_rows(spark):
    rows = spark.range(1, 100_001, 1, 8).selectExpr("1L as doc_id", "cast(id as int) as part", "100000 as parts", "concat('summary ', id) as summary")
    longest = spark.sparkContext.accumulator(0, Longest())

    def fn(text):
        longest.add(len(text))
        return text.split("\n")[1]

    assert [r.summary for r in digest.merge_summaries(rows, fn).collect()] == ["summary 1"]
    assert longest.value < 64 * 50


def test_backfill_cutoff(frame):
    m = frame(rows(), schemas.MESSAGES)
    now = F.lit(D + timedelta(hours=1)).cast("timestamp")
    assert {r.message_id for r in readers.backfill_messages(m, [1], now, 1).collect()} == {2, 3, 4, 5, 6}
    assert readers.backfill_messages(m, [1], now, 0).count() == 0


def test_chunks_and_summaries(frame):
    docs = frame([("a", "x" * 5500), ("b", "x" * 5501), ("c", "one\nmore\n---\ntwo\n" + "y" * 5500), ("d", None), ("e", " ")], "doc_id string, text string")
    found = {}
    for r in digest.chunk_text(docs).orderBy("part").collect():
        found.setdefault(r.doc_id, []).append(len(r.chunk))
    assert found == {"a": [5500], "b": [5500, 1], "c": [8, 3, 5500]}

    def fn(text):
        if len(text) > 3000:
            raise digest.TooLong
        return text[:2]

    summaries = [(d, i + 1, n, f"{d}{i}") for d, n in (("p", 1), ("q", 3), ("r", 4), ("s", 21)) for i in range(n)]

    def joined(text):
        return text.replace("\n---\n", "|")

    found = digest.merge_summaries(frame(summaries, "doc_id string, part int, parts int, summary string"), joined, fan=4).collect()
    want = {d: [s for x, _, _, s in summaries if x == d] for d in "pqrs"}

    def expected(parts):
        if len(parts) == 1:
            return parts[0]
        first = [parts[i : i + 4] for i in range(0, len(parts), 4)]
        return expected(["|".join(f"### Part {4 * g + i + 1}\n{x}" for i, x in enumerate(some)) for g, some in enumerate(first)])

    assert {r.doc_id: r.summary for r in found} == {d: expected(x) for d, x in want.items()}
    out = {r.doc_id: r.summary for r in digest.summarise(docs, fn).collect()}
    assert set(out) == {"a", "b", "c"} and out["a"] == "xx"


class _Store:
    """State of a shard as the processor sees it, with the number of calls."""

    def __init__(self):
        self.calls = 0
        self.value, self.list, self.map, self.timers = None, [], {}, set()

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return getattr(self, f"_{name}")(*args)

        return call

    def _getMapState(self, *_):
        return self

    _getListState = _getValueState = _getMapState

    def _exists(self):
        return self.value is not None

    def _get(self):
        return self.value if self.value is not None else iter(self.list)

    def _update(self, value):
        self.value = value

    def _appendList(self, rows):
        self.list += rows

    _put = _updateValue = _clear = _registerTimer = _removeKey = lambda self, *_: None

    def _containsKey(self, key):
        return False


def test_calls_of_the_state_store_do_not_grow_with_messages():
    columns = ["message_id", "channel_id", "ts", "author", "text", "tweet_url", "username", "images", "videos"]
    calls = []
    for n in (10, 1000):
        processor, store = PreviousMessage(columns, 1000), _Store()
        processor.init(store)
        rows = pd.DataFrame([(k, k % 3, pd.Timestamp(D) + pd.Timedelta(seconds=k), "a", "t", None, None, ["i"], []) for k in range(n)], columns=columns)
        clock = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
        assert list(processor.handleInputRows((0,), iter([rows]), clock)) == []
        calls.append(store.calls)
    assert calls[0] == calls[1] < 10


class _Entries(dict):
    """A map, list or value of the state store, entry by entry."""

    updateValue, getValue, containsKey = dict.__setitem__, dict.get, dict.__contains__
    removeKey, iterator = dict.__delitem__, lambda self: iter(list(self.items()))
    keys = lambda self: iter(list(self))

    def appendList(self, rows):
        super().update({len(self) + k: x for k, x in enumerate(rows)})

    def put(self, rows):
        self.clear()
        self.appendList(rows)

    def exists(self):
        return bool(self)

    def get(self):
        return self["value"] if "value" in self else list(self.values())

    def update(self, value):
        self["value"] = value


class _Shard:
    def __init__(self):
        self.states, self.timers = {}, set()
        self.registerTimer = self.timers.add

    def getMapState(self, name, *_):
        return self.states.setdefault(name, _Entries())

    getListState = getValueState = getMapState


_COLUMNS = ["message_id", "channel_id", "ts", "author", "text", "tweet_url", "username", "images", "videos"]


def test_a_frame_of_messages_is_one_entry_of_the_state_however_many_they_are():
    entries = []
    for n in (10, 1000):
        processor, shard = PreviousMessage(_COLUMNS, 1000), _Shard()
        processor.init(shard)
        rows = pd.DataFrame([(k, k % 3, pd.Timestamp(D) + pd.Timedelta(seconds=k), "a", "t" * 500, "u" if k % 2 else None, "n", ["i"], []) for k in range(n)], columns=_COLUMNS)
        list(processor.handleInputRows((0,), iter([rows]), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
        entries.append(len(shard.states["waiting"]))
    assert entries == [1, 1], "entries of the state grow with messages"


@pytest.mark.parametrize("block", [100, 4 << 20])
def test_blocks_of_the_state_are_released_in_part(monkeypatch, block):
    monkeypatch.setattr(previous, "_BLOCK", block)
    r = random.Random(7)
    processor, shard = PreviousMessage(_COLUMNS, 10**9), _Shard()
    processor.init(shard)
    told = []
    for i in range(400):
        url = r.choice([f"https://x.com/u{i}/status/{i}", "", None])
        told.append((i, r.choice([1, 1, 2, 3]), pd.Timestamp(D) + pd.Timedelta(seconds=i // 2), r.choice([f"A{i}", None]), r.choice([f"t{i}", ""]), url, f"n{i}" if url else None, r.choice([[], ["i"], None]), r.choice([[], ["v"]])))
    arrived = sorted(told, key=lambda m: m[2] + pd.Timedelta(seconds=r.random() * 20))
    found, clock, blocks, ms = [], 0, 0, lambda ts: ts.value // 1_000_000
    for at in [*range(0, 400, 37), None]:
        some = arrived[at : at + 37] if at is not None else []
        now = types.SimpleNamespace(getCurrentWatermarkInMs=lambda t=clock: t)
        if some:
            found += processor.handleInputRows((0,), iter([pd.DataFrame(some[:20], columns=_COLUMNS), pd.DataFrame(some[20:], columns=_COLUMNS)]), now)
        blocks = max(blocks, len(shard.states["waiting"]))
        for timer in sorted(t for t in shard.timers if t <= clock):
            shard.timers.discard(timer)
            found += processor.handleExpiredTimer((0,), now, types.SimpleNamespace(getExpiryTimeInMs=lambda t=timer: t))
        clock = max(clock, max((ms(m[2]) - 21_000 for m in some), default=0)) if at is not None and at + 37 < 400 else ms(told[-1][2])
    got = {m["message_id"]: m for f in found for m in f.to_dict("records")}
    assert len(got) == sum(len(f) for f in found) == 400 and not shard.states["waiting"]
    last = {}
    for m in told:
        row = got[m[0]]
        assert (row["channel_id"], row["ts"], row["author"], row["text"], row["tweet_url"]) == (*m[1:6],)
        assert [x for k in ("images", "videos") if row[k] is not None for x in row[k]] == (m[7] or []) + m[8]
        if not m[5] and (m[7] or m[8]) and (before := last.get(m[1])) and before[5]:
            assert (row["_tweet_url"], row["_username"], row["_author"], row["_text"]) == (before[5], before[6], before[3], before[4])
        else:
            assert not row["_tweet_url"]
        last[m[1]] = m
    assert blocks > 20 or block > 100, "entries are cut by their size"
