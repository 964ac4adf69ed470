import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from curalume.operators import forest, training
from curalume.plans.tables import saved


def rows_of(seed, n, width=5):
    r = np.random.default_rng(seed)
    x = r.normal(0, 1, (n, width))
    return x, (x[:, 0] + x[:, 1] * x[:, 2] + r.normal(0, 0.3, n) > 0).astype(int)


def as_frame(frame, x, y):
    return frame([(int(b), a) for a, b in zip(x.tolist(), y, strict=True)], "label int, features array<double>")


def test_jobs_of_a_fit_do_not_grow_with_depth(spark, frame):
    """Spark's forest made a pass over all rows for each level, and more where nodes were many."""
    r = np.random.default_rng(1)
    good, bad = (frame([(v,) for v in r.normal(0, 1, (300, 4)).tolist()], "features array<double>") for _ in range(2))
    jobs = []
    for depth in (2, 12):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, group)
        training.train_scorer(good, bad, trees=5, depth=depth)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[0] == jobs[1]


def plain_gain(x, y, w):
    """The largest fall in weighted Gini impurity that a split of one feature brings."""
    spread = lambda some: (w[some].sum() - ((w * y)[some].sum() ** 2 + (w * (1 - y))[some].sum() ** 2) / w[some].sum()) if some.any() else 0.0
    everything = np.ones(len(x), bool)
    return max((spread(everything) - spread(x[:, f] <= b) - spread(x[:, f] > b) for f in range(x.shape[1]) for b in range(31)), default=0.0)


def test_a_tree_has_the_best_splits_and_ends_where_none_helps():
    r = np.random.default_rng(2)
    x, w = r.integers(0, 32, (300, 3)).astype(np.uint8), r.integers(1, 4, 300)
    y = (x[:, 0] > 15) ^ (r.random(300) < 0.2)
    tree = forest.grown(x, y, w, 4, 3, np.random.default_rng(3))
    inside = {0: np.arange(300)}
    for node, f in enumerate(tree.feature):
        some = inside[node]
        assert tree.share[node] == pytest.approx((w * y)[some].sum() / w[some].sum())
        if f >= 0:
            goes = x[some, f] > tree.at[node]
            inside[int(tree.left[node])], inside[int(tree.left[node]) + 1] = some[~goes], some[goes]
            parts = [some, some[~goes], some[goes]]
            spread = [w[p].sum() - ((w * y)[p].sum() ** 2 + (w * ~y)[p].sum() ** 2) / w[p].sum() for p in parts]
            assert spread[0] - spread[1] - spread[2] == pytest.approx(plain_gain(x[some], y[some].astype(int), w[some]))
    ends = {int(n) for n in tree.end(x, np.zeros(300, int))}
    assert ends == {n for n, f in enumerate(tree.feature) if f < 0} and len(ends) > 4
    whole = forest.grown(x, y, w, 40, 3, np.random.default_rng(3))
    same = {}
    for row, cell in zip(y, map(bytes, x), strict=True):
        same.setdefault(cell, set()).add(bool(row))
    clear = np.array([len(same[bytes(c)]) == 1 for c in x])
    assert ((whole.share[whole.end(x, np.zeros(300, int))] > 0.5) == y)[clear].all()


@pytest.mark.parametrize("held", [40, 1 << 16])
def test_scores_are_those_of_the_trees_row_for_row(spark, frame, held):
    x, y = rows_of(4, 500)
    fitted = forest.fit_forest(as_frame(frame, x, y), 7, 20, 42, held)
    assert (len(fitted.upper.feature) > 7) == (held == 40)
    new, real = rows_of(5, 1300)  # more than it was fitted on: three copies
    given = saved(frame([(i, v) for i, v in enumerate(new.tolist())], "id long, features array<double>"))
    found = {r.id: r.score for r in forest.forest_scores(given, fitted).collect()}
    bins = np.stack([np.searchsorted(b, c) for b, c in zip(fitted.bounds, new.T, strict=True)], 1).astype(np.uint8)
    lower = {r.node: forest.Trees.unpacked(bytes(r.tree)) for r in fitted.lower.collect()}
    want = np.zeros(len(new))
    for tree in range(7):
        for i, node in enumerate(fitted.upper.end(bins, np.full(len(new), tree)).tolist()):
            t = lower.get(node)
            want[i] += (t.share[t.end(bins[i : i + 1], np.zeros(1, int))[0]] if t else fitted.upper.share[node]) / 7
    assert len(found) == len(new) and np.allclose([found[i] for i in range(len(new))], want, atol=1e-9)
    assert ((want > 0.5) == real).mean() > 0.8


def test_no_task_grows_more_rows_than_it_may_hold(frame):
    x, y = rows_of(6, 600)
    rows = as_frame(frame, x, y)
    bounds = forest._bounds(rows)
    binned = saved(forest._binned(rows.select(F.monotonically_increasing_id().alias("id"), "label", "features"), bounds))
    upper, level, ended = forest._upper(binned, 4, 20, 1, 3, 5, 50, 600)
    sizes, good = np.zeros(len(upper.feature)), np.zeros(len(upper.feature))
    for r in binned.collect():
        b = np.frombuffer(bytes(r.bins), np.uint8)[None]
        for tree in range(4):
            w = int(forest._drawn(np.array([r.id]), tree, 1)[0])
            node = upper.end(b, np.array([tree]))[0]
            sizes[node] += w
            good[node] += w * r.label
    leaves = upper.feature < 0
    assert sizes[leaves & ~ended].max() <= 50 and sizes[~leaves].sum() == 0 and level.max() > 2
    assert np.allclose(good[leaves] / sizes[leaves], upper.share[leaves])


def test_draws_have_mean_and_variance_one_and_differ_by_tree():
    ids = np.arange(200_000) + (3 << 33)
    a, b = (forest._drawn(ids, t, 42) for t in (0, 1))
    for w in (a, b):
        assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.01 and abs(np.corrcoef(a[1:], a[:-1])[0, 1]) < 0.01
