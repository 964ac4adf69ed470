import random
import re
import types
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from curalume.operators import halo, ranks, series
from curalume.operators.components import components_by_roots, contracted, forest, star_contraction
from curalume.plans.tables import saved, session_dir
from curalume.queries import QUERIES

T0 = datetime(2024, 1, 1)
SHAPE = "uuid string, date timestamp, features array<float>, phash string"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def pairs(frame, rows, **rules):
    return {(r.src, r.dst) for r in series.series_pairs(frame(rows, SHAPE), series.SeriesRules(**rules)).collect()}


def test_window_edge_is_inclusive(frame):
    v = [1.0, 0.0]
    assert pairs(frame, [("a", at(0), v, None), ("b", at(60), v, None)]) == {("a", "b")}
    assert pairs(frame, [("a", at(0), v, None), ("b", at(60.000001), v, None)]) == set()


def test_five_seconds_override_looks(frame):
    rows = [("a", at(0), [1.0, 0.0], "0" * 16), ("b", at(5), [0.0, 1.0], "f" * 16), ("c", at(11), [0.0, -1.0], "")]
    assert pairs(frame, rows) == {("a", "b")}


def test_hash_and_zero_vector(frame):
    rows = [("a", at(0), [0.0, 0.0], "00000000000000ff"), ("b", at(30), [1.0, 0.0], "000000000000000f"), ("c", at(59), [1.0, 0.0], None)]
    assert pairs(frame, rows) == {("a", "b"), ("b", "c")}


def test_rank_cap(frame):
    far, near = [0.0, 1.0], [1.0, 0.0]
    rows = [(f"a{i:02}", at(i / 60), near if i == 0 else far, None) for i in range(60)] + [(f"b{i:02}", at(50 + i / 60), near if i == 59 else [-1.0, 0.0], None) for i in range(60)]
    found = series.detect_series(frame(rows, SHAPE), series.SeriesRules())
    assert found.select("series_id").distinct().count() == 2
    assert series.detect_series(frame(rows, SHAPE), series.SeriesRules(cap=200)).select("series_id").distinct().count() == 1


def test_undated_photos_meet_by_rank(frame):
    rows = [("a", None, [1.0, 0.0], None), ("b", None, [1.0, 0.1], None), ("c", at(0), [1.0, 0.0], None), ("d", at(900), [0.0, 1.0], None)]
    assert pairs(frame, rows) == {("a", "b"), ("a", "c"), ("b", "c")}


def test_no_nested_loop_or_single_partition_window(spark, frame):
    plan = series.series_pairs(frame([("a", at(0), [1.0], None)], SHAPE).select("uuid", "date"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    expected = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    found = {x.node: x.component for x in star_contraction(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == expected
    assert star_contraction(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_tasks_leave_stars_of_their_own_edges(spark):
    r = np.random.default_rng(3)
    u, v = r.integers(0, 500, (2, 400))
    parent = np.arange(500)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(u.tolist(), v.tolist()):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    node, root = forest(u, v)
    assert dict(zip(node.tolist(), root.tolist())) == {x: find(x) for x in {*u.tolist(), *v.tolist()} if find(x) != x}
    assert [len(x) for x in forest(u[:0], v[:0])] == [0, 0]
    edges = spark.range(0, 20_000, 1, 4).selectExpr("id + 1 as u", "id as v")
    assert contracted(edges, held=3000).count() == 20_000 and contracted(edges.unionByName(edges), held=50_000).distinct().count() <= 40_000


def test_a_long_path_takes_few_rounds(spark):
    rounds = []

    def save(df, name):
        rounds.append(name)
        return saved(df, name)

    path = spark.range(0, 200_000, 1, 8).selectExpr("id + 1 as src", "id as dst")
    found = star_contraction(path, save=save)
    assert found.agg(F.count("*"), F.max("component")).first() == (200_001, 0) and len(rounds) <= 6


def scan(frame):
    rows = [("a", at(0), None, 0), ("b", at(1), 0.4, 0), ("c", at(2), 0.5, 0), ("d", at(9), 0.0, 1), ("e", at(20), 0.2, 2), ("f", at(21), 0.1, 2)]
    return frame(rows, "uuid string, date timestamp, score double, series_id long")


def test_best_null_score_and_ties(frame):
    assert {r.series_id: (r.best_uuid, r.n) for r in series.best_per_series(scan(frame)).collect()} == {0: ("a", 3), 1: ("d", 1), 2: ("e", 2)}


def test_suggestions_leave_the_best(frame):
    assert [r.uuid for r in series.deletion_suggestions(scan(frame), 0.5).collect()] == ["f", "b"]
    assert {r.uuid for r in series.deletable_photos(scan(frame)).collect()} == {"b", "c", "f"}
    flagged = series.flag_suggested(scan(frame), series.deletion_suggestions(scan(frame), 0.5))
    assert series.series_stats(flagged).first().asDict() == {"photos": 6, "series": 3, "singletons": 1, "in_series": 5, "suggested": 2, "kept": 4}


def test_runs_join_at_the_gap(frame):
    rows = [("a", at(0)), ("b", at(5)), ("c", at(10.000001))]
    assert sorted(r.n for r in series.close_time_runs(frame(rows, "uuid string, date timestamp")).collect()) == [1, 2]


def test_ranks_and_runs_across_buckets(frame):
    r = random.Random(5)
    rows = [(f"u{i:03}", at(r.choice([0, 0, 0, 3, 8, 50, 51, 200])) if i % 9 else None) for i in range(120)]
    ordered = sorted(rows, key=lambda x: (x[1] is not None, x[1] or T0, x[0]))
    ranked = series.with_global_rank(frame(rows, "uuid string, date timestamp"))
    assert {x.uuid: x["rank"] for x in ranked.collect()} == {u: i for i, (u, _) in enumerate(ordered)}
    expected, run = {}, 0
    for i, (u, d) in enumerate(ordered):
        if i == 0 or d is None or ordered[i - 1][1] is None or (d - ordered[i - 1][1]).total_seconds() > 5:
            run = i
        expected[u] = run
    for bucket in (7, 1 << 17):
        assert {x.uuid: x["run"] for x in series.with_runs(ranked, 5, bucket).collect()} == expected


@pytest.mark.parametrize("looks", [True, False])
def test_series_components_match_components_of_all_pairs(frame, looks):
    r = random.Random(6)
    rows = [(f"u{i:03}", at(r.choice([0, 40, 90, 300]) + r.randrange(40)) if i % 11 else None, [r.random(), r.random() - 0.5], f"{r.getrandbits(64):016x}") for i in range(150)]
    photos = frame(rows, SHAPE)
    photos = photos if looks else photos.select("uuid", "date")
    rules = series.SeriesRules(cosine=0.999, cap=9)
    plain = series.connected_components(series.with_global_rank(photos.select("uuid", "date")), series.series_pairs(photos, rules))
    found = {x.uuid: x.component for x in series.series_components(photos, rules).collect()}
    assert found == {x.uuid: x.component for x in plain.collect()} and len(set(found.values())) < 150


@pytest.mark.parametrize("range_rows", [None, 40, 7])
def test_ranges_with_halos_make_the_pairs_of_a_plain_join(frame, range_rows):
    r = random.Random(7)
    rows = []
    for i in range(260):
        when = at(r.choice([0, 0, 40, 90, 95, 300]) + r.choice([0, 0, r.random() * 30])) if i % 9 else None
        looks = r.choice([None, [], [r.random(), r.random() - 0.5], [r.random(), None], [0.0, 0.0], [1.0, 2.0, r.random()]])
        rows.append((f"u{i % 250:03}", when, looks, r.choice([None, "", f"{r.getrandbits(4):016x}", f"{r.getrandbits(64):016x}"])))
    rules, photos = series.SeriesRules(cosine=0.99, bits=2, cap=6), frame(rows, SHAPE)
    ranked = photos.withColumn("key", F.struct(F.coalesce(F.unix_micros("date"), F.lit(-1)), "uuid")).withColumn("rank", F.row_number().over(Window.orderBy("key"))).drop("key")
    joined = ranked.alias("a").join(ranked.alias("b"), (F.col("b.rank") - F.col("a.rank")).between(1, rules.cap)).select(F.struct("a.*").alias("a"), F.struct("b.*").alias("b"))
    plain = joined.where(series.are_related("a", "b", rules, True, True)).select("a.uuid", "b.uuid")
    found = series.rank_pairs(photos, series.with_global_rank(photos.select("uuid", "date")), rules, range_rows=range_rows)
    repeated = {f"u{i:03}" for i in range(10)}  # ranks of rows with equal keys can be dealt out either way
    keep = lambda df: sorted(tuple(x) for x in df.collect() if not repeated & {*x})
    assert keep(found.select("src", "dst")) == keep(plain) and len(keep(plain)) > 100
    assert all(1 <= x.v - x.u <= 6 for x in found.collect())


def test_features_are_shuffled_once(frame):
    photos = frame([(f"u{i}", at(i), [1.0], None) for i in range(40)], SHAPE)
    plan = series.series_pairs(photos)._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in plan.split("\n") if "Exchange hashpartitioning" in line]) == 1 and "Join" not in plan


def test_ranks_within_a_key_that_fills_many_ranges(spark, frame):
    rows = spark.range(6000).selectExpr("cast(id as string) as uuid", "timestampadd(second, id % 50, timestamp'2024-01-01') as date", "if(id % 97 = 0, null, (id * 37 % 1000) / 1000) as score", "if(id < 5000, 0, if(id < 5900, null, id)) as series_id")
    order = Window.partitionBy("series_id").orderBy(F.asc_nulls_first("date"), "uuid")
    plain = rows.withColumn("pos", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("series_id")))
    want = {r.uuid: (r.pos, r.n) for r in plain.collect()}
    found = series.with_best(rows).collect()
    assert {r.uuid: (r.pos_in_series, r.series_size) for r in found} == want
    leaders = {}
    for r in sorted(found, key=lambda r: (-(0.5 if r.score is None else r.score), r.pos_in_series)):
        leaders.setdefault(r.series_id, r.uuid)
    assert {r.uuid for r in found if r.is_best} == {*leaders.values()} and len(leaders) == 102
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay as they are, as those of a large table do
    try:
        sizes = ranks.dealt(rows, F.asc_nulls_first("series_id"), "date", "uuid").groupBy("_part", "series_id").count().agg(F.max("count")).first()[0]
        found = series.with_best(rows).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sizes < 2500, "no task has the large key whole"
    assert {r.uuid: (r.pos_in_series, r.series_size) for r in found} == want and sum(r.is_best for r in found) == 102


def test_one_instant_makes_bounded_candidates(spark):
    photos = spark.range(3000).selectExpr("cast(id as string) as uuid", "timestamp'2024-01-01' as date")
    assert series.series_pairs(photos, series.SeriesRules(cap=10)).count() == 10 * 3000 - 55
    assert series.detect_series(photos).select("series_id").distinct().count() == 1


def test_pairs_are_never_sent_through_the_driver(spark, frame, monkeypatch):
    """Spark's guess of their size is far too small, so only a hint keeps them from a broadcast."""
    rows = [(f"{k}", at(k), None, None) for k in range(20)]
    given = []
    monkeypatch.setattr(series, "star_contraction", lambda edges, *_: given.append(edges) or star_contraction(edges, *_))
    photos = frame(rows, SHAPE).select("uuid", "date")
    found = series.connected_components(series.with_global_rank(photos), series.series_pairs(photos, series.SeriesRules()))
    assert {r.component for r in found.collect()} == {0}
    plan = given[0]._jdf.queryExecution().executedPlan().toString()
    assert "rank" in plan and plan.count("SortMergeJoin") == 2


def test_components_of_a_crowd_write_no_more_than_photos(spark, tmp_path):
    """All pairs, 99 a photo, were shuffled twice to find their ranks and then written."""
    n = 4000
    spark.range(n).selectExpr("id as event_id", "timestampadd(second, id, timestamp'2024-01-01') as ts", "'{}' as props").write.parquet(str(tmp_path / "events.parquet"))
    shared = Path(session_dir(spark).removeprefix("file://"))
    before = {*shared.iterdir()} if shared.exists() else set()
    found = QUERIES["connected_components"](spark, str(tmp_path))
    assert found.agg(F.count("*"), F.min("component"), F.max("component")).first() == (n, 0, 0)
    assert sum(spark.read.parquet(str(p)).count() for p in {*shared.iterdir()} - before if p.name.startswith("edges")) <= 2 * n
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan, "what is returned is read from tables"


@pytest.mark.parametrize("range_rows", [None, 40, 7])
def test_stars_connect_the_same_photos_as_all_pairs(spark, frame, range_rows):
    r = random.Random(8)
    rows = [(f"u{i:03}", at(r.choice([0, 40, 90, 300, 700]) + r.randrange(40)) if i % 11 else None, [r.random(), r.random() - 0.5], f"{r.getrandbits(64):016x}") for i in range(240)]
    photos, rules = frame(rows, SHAPE), series.SeriesRules(cosine=0.999, cap=9, close_seconds=1)
    ranked = series.with_global_rank(photos.select("uuid", "date"))
    pairs = series.rank_pairs(photos, ranked, rules, range_rows=range_rows).select("u", "v")
    stars = series.rank_pairs(photos, ranked, rules, range_rows=range_rows, columns=("u", "v", "src", "dst"), stars=True)
    rank = {x.uuid: x["rank"] for x in ranked.collect()}
    assert all(x.u < x.v and (rank[x.src], rank[x.dst]) == (x.u, x.v) for x in stars.collect()) and stars.count() < pairs.count()
    want = {x.node: x.component for x in star_contraction(pairs, "u", "v").collect()}
    assert {x.node: x.component for x in components_by_roots(stars, "u", "v").collect()} == want and 3 < len(set(want.values()))
    assert {x.node: x.component for x in components_by_roots(pairs, "u", "v").collect()} == want


def test_roots_of_tasks_meet(spark):
    """Edges that do not lie together: each node is in stars of many tasks, roots among them."""
    r = np.random.default_rng(5)
    edges = [*map(tuple, r.integers(0, 600, (500, 2)).tolist()), *((i + 1, i) for i in range(700, 760)), (900, 900), (901, None)]
    spread = spark.createDataFrame(edges, "src long, dst long").repartition(8)
    want = {x.node: x.component for x in star_contraction(spread).collect()}
    found = components_by_roots(spread).collect()
    assert {x.node: x.component for x in found} == want and len(found) == len(want)
    assert components_by_roots(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_pairs_leave_python_with_what_is_asked_for_and_many_together(frame):
    """Each distance of a window had a batch of its own, and ranks and names were always sent."""
    photos = frame([(f"u{i:04}", at(i), None, None) for i in range(1500)], SHAPE).select("uuid", "date")
    found = series.series_pairs(photos, series.SeriesRules(seconds=30, close_seconds=30))
    assert re.search(r"MapInArrow run\([^\n]*\[src#\d+, dst#\d+\]", found._jdf.queryExecution().executedPlan().toString())
    assert sorted(tuple(r) for r in found.collect()) == [(f"u{i:04}", f"u{j:04}") for i in range(1500) for j in range(i + 1, min(i + 31, 1500))]
    table = pa.table({"uuid": [f"u{i:04}" for i in range(1500)], "micros": np.arange(1500), "_range": np.zeros(1500, int), "_own": np.ones(1500, bool)})
    sent = []
    rows = types.SimpleNamespace(sparkSession=types.SimpleNamespace(sparkContext=types.SimpleNamespace(broadcast=lambda x: types.SimpleNamespace(value=x))))
    ready = types.SimpleNamespace(repartition=lambda *_: ready, sortWithinPartitions=lambda *_: ready, mapInArrow=lambda run, _: sent.extend(run(table.combine_chunks().to_batches())))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(halo, "_routed", lambda *_: ready)
        halo.near_pairs(rows, halo.Ranges(None, None, np.array([0])), 30, lambda _: None, lambda _, micros, i, j: np.ones(len(i), bool), ("u", "v"))
    assert len(sent) == 1 and sent[0].num_rows == 30 * 1500 - 30 * 31 // 2
