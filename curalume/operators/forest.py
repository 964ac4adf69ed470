"""A random forest for two classes whose trees, like its rows, lie in tables.

Spark's own forest makes a pass over all rows for each group of nodes whose counts fit in memory, and keeps every tree in
the driver. Where deep trees end in a few rows each, nodes grow with rows, and so do the passes. Here passes
over all rows split only nodes of more than `held` rows; then each row goes once, for each tree that drew it, to its
node, and a task grows all below. Scoring sends rows to the same nodes.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalume.plans.tables import saved

_BINS = 32
#: Shares are summed as whole numbers of this fraction, so that their order doesn't matter.
_ONE = 1 << 40
#: Nodes of the upper trees whose counts one pass takes, and cells of counts that a growing task has at once.
_SLOTS, _CELLS = 8192, 1 << 19
_NODE = np.dtype([("feature", "<i4"), ("at", "u1"), ("left", "<i4"), ("share", "<f8")])
_TREE = "node long, tree binary"
_DRAWN = np.cumsum([np.exp(-1) / factorial(k) for k in range(12)])


@dataclass(frozen=True)
class Trees:
    """Nodes as arrays: the feature that splits one (-1: none), the last bin that goes left, the left child (the right one is next), the share of good rows."""

    feature: np.ndarray
    at: np.ndarray
    left: np.ndarray
    share: np.ndarray

    def end(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Where rows of bins end up that start at these nodes."""
        node = node.copy()
        live = np.flatnonzero(self.feature[node] >= 0)
        while len(live):
            n = node[live]
            node[live] = self.left[n] + (x[live, self.feature[n]] > self.at[n])
            live = live[self.feature[node[live]] >= 0]
        return node

    def packed(self) -> bytes:
        out = np.empty(len(self.feature), _NODE)
        for c in _NODE.names:
            out[c] = getattr(self, c)
        return out.tobytes()

    @staticmethod
    def unpacked(nodes: bytes) -> Trees:
        x = np.frombuffer(nodes, _NODE)
        return Trees(*(x[c].copy() for c in _NODE.names))


@dataclass(frozen=True)
class Forest:
    """Bounds of the bins of each feature, the upper trees, whose first nodes are the roots, and a table of what grows below each of their ends."""

    bounds: np.ndarray
    trees: int
    rows: int  #: that it was fitted on
    upper: Trees
    lower: DataFrame

    def save(self, path: str) -> None:
        self.lower.write.mode("overwrite").parquet(f"{path}/lower")
        head = [(self.bounds.tolist(), self.trees, self.rows, self.upper.packed())]
        self.lower.sparkSession.createDataFrame(head, "bounds array<array<double>>, trees int, rows long, upper binary").write.mode("overwrite").parquet(f"{path}/upper")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        u = spark.read.parquet(f"{path}/upper").first()
        return Forest(np.array(u.bounds), u.trees, u.rows, Trees.unpacked(u.upper), spark.read.schema(_TREE).parquet(f"{path}/lower"))


def _binary(x: np.ndarray) -> pa.Array:
    n, width = x.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(x))])


def _bytes(column: pa.Array) -> np.ndarray:
    """Rows of bins, all of one width."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)


def _bounds(rows: DataFrame) -> np.ndarray:
    """Bounds of 32 bins of each feature: its quantiles over all rows."""
    at = [(k + 1) / _BINS for k in range(_BINS - 1)]
    width = rows.where("features is not null").select(F.size("features")).first()[0]
    out = rows.select(*(F.percentile_approx(F.col("features")[i], at, 1000).alias(f"f{i}") for i in range(width)))
    return np.array([list(x) for x in out.first()])


def _binned(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """rows without `features`, with the bin of each."""
    rest = [f for f in rows.schema.fields if f.name != "features"]
    shape, to = rows.where("features is not null").select(*(f.name for f in rest), F.col("features").cast("array<double>").alias("features")), len(rest)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(to).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                bins = np.stack([np.searchsorted(b, c) for b, c in zip(bounds, x.T, strict=True)], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*batch.columns[:to], _binary(bins)], names=[f.name for f in rest] + ["bins"])

    return shape.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["bins binary"]))


def _drawn(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row: Poisson numbers of mean 1 that hang on the id, the tree and the seed alone."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree * 0xD1B54A32D192ED03 + seed * 0x8CB92BA72F3D8DD7) % (1 << 64))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return np.searchsorted(_DRAWN, ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / 2.0**53, "right")


def _counts(cell: np.ndarray, y: np.ndarray, w: np.ndarray, cells: int) -> np.ndarray:
    """(2, cells): weights of bad and good rows by cell; a row has a cell for each feature."""
    by = cell + np.where(y, cells, 0)[:, None]
    return np.bincount(by.ravel(), np.repeat(w, cell.shape[1]), 2 * cells).reshape(2, cells)


def _best(counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of counts (2, nodes, features, bins): whether a split lowers the Gini impurity, its feature's place, the last bin that goes left, and (2, nodes) counts on the left."""
    left = counts.cumsum(3)[..., :-1]
    whole = counts.sum(3, keepdims=True)
    right = whole - left
    n_left, n_right = left.sum(0), right.sum(0)
    purity = (left**2).sum(0) / np.maximum(n_left, 1) + (right**2).sum(0) / np.maximum(n_right, 1)
    gain = np.where((n_left > 0) & (n_right > 0), purity - ((whole**2).sum(0) / np.maximum(whole.sum(0), 1)), -1.0)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(1)
    node, (place, at) = np.arange(len(best)), np.divmod(best, gain.shape[2])
    return flat[node, best] > 1e-9, place, at, left[:, node, place, at]


def _picked(r: np.random.Generator, nodes: int, width: int, some: int) -> np.ndarray:
    """`some` of the features for each node."""
    return r.random((nodes, width)).argpartition(some - 1, 1)[:, :some]


def grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, some: int, r: np.random.Generator) -> Trees:
    """A tree on rows of bins, level by level; a split whose sides both end and foretell the same is taken back."""
    feature, at, left, share, levels = [], [], [], [], [0]
    order, sizes = np.arange(len(x)), np.array([len(x)])
    for level in range(depth + 1):
        starts = np.cumsum(sizes) - sizes
        good, all_ = (np.add.reduceat(v[order].astype(float), starts) for v in (w * y, w))
        f, a, after = np.full(len(sizes), -1), np.zeros(len(sizes), int), []
        open_ = np.flatnonzero((good > 0) & (good < all_)) if level < depth else np.empty(0, int)
        step = max(1, _CELLS // (2 * some * _BINS))
        for lo in range(0, len(open_), step):
            k = open_[lo : lo + step]
            of = np.repeat(np.arange(len(k)), sizes[k])
            rows = order[np.arange(len(of)) + np.repeat(starts[k] - (np.cumsum(sizes[k]) - sizes[k]), sizes[k])]
            pick = _picked(r, len(k), x.shape[1], some)
            cells = x[rows[:, None], pick[of]]
            counts = _counts((of[:, None] * some + np.arange(some)) * _BINS + cells, y[rows], w[rows], len(k) * some * _BINS)
            splits, place, last, _ = _best(counts.reshape(2, len(k), some, _BINS))
            f[k[splits]], a[k[splits]] = pick[splits, place[splits]], last[splits]
            mine = splits[of]
            side = 2 * of + (cells[np.arange(len(of)), place[of]] > last[of])
            after.append((rows[mine][np.argsort(side[mine], kind="stable")], np.bincount(side[mine], minlength=2 * len(k)).reshape(-1, 2)[splits].ravel()))
        split = f >= 0
        child = np.full(len(sizes), -1)
        child[split] = levels[-1] + len(sizes) + 2 * np.arange(split.sum())
        for kept, new in ((feature, f), (at, a), (left, child), (share, good / all_)):
            kept.append(new)
        levels.append(levels[-1] + len(sizes))
        if not split.any():
            break
        order, sizes = (np.concatenate(z) for z in zip(*after, strict=True))
    found = Trees(*(np.concatenate(z) for z in (feature, at, left, share)))
    for lo, hi in zip(levels[-2::-1], levels[:0:-1], strict=True):
        inner = lo + np.flatnonzero(found.feature[lo:hi] >= 0)
        a, b = found.left[inner], found.left[inner] + 1
        same = (found.feature[a] < 0) & (found.feature[b] < 0) & ((found.share[a] > 0.5) == (found.share[b] > 0.5))
        found.feature[inner[same]] = -1
    return _without_lost(found)


def _without_lost(t: Trees) -> Trees:
    """The nodes that the root still reaches, numbered anew; children come behind their parents."""
    reached = np.zeros(len(t.feature), bool)
    reached[0] = True
    front = np.zeros(1, int)
    while len(front):
        inner = front[t.feature[front] >= 0]
        front = np.concatenate((t.left[inner], t.left[inner] + 1))
        reached[front] = True
    number = np.cumsum(reached) - 1
    return Trees(t.feature[reached], t.at[reached], np.where(t.feature[reached] >= 0, number[t.left[reached]], -1), t.share[reached])


def _upper(rows: DataFrame, trees: int, depth: int, seed: int, some: int, width: int, held: int, n: int) -> tuple[Trees, np.ndarray, np.ndarray]:
    """The trees as far as nodes have more than `held` rows; of each node, its level and whether nothing can grow below it."""
    feature, at, left, share, level, ended = [-1] * trees, [0] * trees, [-1] * trees, [0.5] * trees, [0] * trees, [False] * trees
    open_ = [*range(trees)] if n > held else []
    while open_:
        now, open_ = open_[:_SLOTS], open_[_SLOTS:]
        pick = _picked(np.random.default_rng((seed, now[0], len(feature))), len(now), width, some)
        for s, bad, good, place, last, bad_left, good_left in _splits(rows, Trees(*map(np.array, (feature, at, left, share))), now, pick, trees, seed):
            node = now[s]
            share[node] = good / (bad + good)
            if place < 0:
                ended[node] = True
                continue
            feature[node], at[node], left[node] = int(pick[s, place]), last, len(feature)
            for b, g in ((bad_left, good_left), (bad - bad_left, good - good_left)):
                done = not b or not g or level[node] + 1 >= depth
                if b + g > held and not done:
                    open_.append(len(feature))
                for kept, new in ((feature, -1), (at, 0), (left, -1), (share, g / (b + g)), (level, level[node] + 1), (ended, done)):
                    kept.append(new)
    return Trees(*map(np.array, (feature, at, left, share))), np.array(level), np.array(ended)


def _splits(rows: DataFrame, upper: Trees, nodes: list[int], pick: np.ndarray, trees: int, seed: int) -> list[tuple]:
    """For each of the nodes: its place in the list, bad and good rows, the split (place of the feature, or -1, and bin), and bad and good rows on its left."""
    some = pick.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((upper, np.array(nodes), pick))

    def count(batches):
        upper, nodes, pick = shared.value
        slot = np.full(len(upper.feature), -1)
        slot[nodes] = np.arange(len(nodes))
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy() > 0, _bytes(batch.column(2))
            for tree in range(trees):
                w = _drawn(ids, tree, seed)
                s = slot[upper.end(x, np.full(len(x), tree))]
                mine = np.flatnonzero((w > 0) & (s >= 0))
                if len(mine):
                    these, of = np.unique(s[mine], return_inverse=True)
                    cell = (of[:, None] * some + np.arange(some)) * _BINS + x[mine[:, None], pick[s[mine]]]
                    new = _counts(cell, y[mine], w[mine], len(these) * some * _BINS).reshape(2, len(these), -1)
                    for i, k in enumerate(these.tolist()):
                        counts[k] = counts[k] + new[:, i] if k in counts else new[:, i].copy()
        for k, c in counts.items():
            yield pa.RecordBatch.from_pydict({"s": pa.array([k], pa.int64()), "counts": pa.array([c.tobytes()], pa.binary())})

    def split(table: pa.Table) -> pa.Table:
        c = sum(np.frombuffer(b) for b in table.column("counts").to_pylist()).reshape(2, 1, some, _BINS)
        found, place, last, on_left = _best(c)
        bad, good = c[:, 0, 0].sum(1)
        row = [table.column("s")[0].as_py(), bad, good, place[0] if found[0] else -1, last[0], *on_left[:, 0]]
        return pa.table({k: pa.array([int(v)], pa.int64()) for k, v in zip(("s", "bad", "good", "place", "last", "bad_left", "good_left"), row, strict=True)})

    parts = rows.mapInArrow(count, "s long, counts binary")
    return [tuple(r) for r in parts.groupBy("s").applyInArrow(split, "s long, bad long, good long, place long, last long, bad_left long, good_left long").orderBy("s").collect()]


def _to_nodes(rows: DataFrame, upper: Trees, trees: int, kinds: str, made) -> DataFrame:
    """What `made` has for the rows of each batch and tree, given the tree, the node they come to, and the batch."""
    shared = rows.sparkSession.sparkContext.broadcast(upper)

    def run(batches):
        for batch in batches:
            x = _bytes(batch.column("bins")) if batch.num_rows else ()
            for tree in range(trees if len(x) else 0):
                yield made(tree, shared.value.end(x, np.full(len(x), tree)), batch, x)

    return rows.mapInArrow(run, kinds)


def fit_forest(rows: DataFrame, trees: int, depth: int, seed: int, held: int = 1 << 16) -> Forest:
    """A forest on rows(label 0 or 1, features): 32 bins a feature, Poisson draws, the best Gini split among as many features as the root of their number."""
    bounds = _bounds(rows)
    width, some = len(bounds), int(np.ceil(np.sqrt(len(bounds))))
    numbered = rows.select(F.monotonically_increasing_id().alias("id"), F.col("label").cast("int").alias("label"), "features")
    binned = saved(_binned(numbered, bounds), "binned")
    n = binned.count()
    upper, level, ended = _upper(binned, trees, depth, seed, some, width, held, n)

    def drawn(tree, node, batch, x):
        w = _drawn(batch.column("id").to_numpy(), tree, seed)
        mine = np.flatnonzero((w > 0) & ~ended[node])
        return pa.RecordBatch.from_arrays([pa.array(node[mine]), batch.column("label").take(pa.array(mine)), pa.array(w[mine].astype(np.int32)), _binary(x[mine])], names=["node", "label", "w", "bins"])

    def grow(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py()
        x, y, w = _bytes(table.column("bins").combine_chunks()), table.column("label").to_numpy() > 0, table.column("w").to_numpy()
        tree = grown(x, y, w, depth - int(level[node]), some, np.random.default_rng((seed, node)))
        return pa.table({"node": pa.array([node], pa.int64()), "tree": pa.array([tree.packed()], pa.binary())})

    dealt = _to_nodes(binned, upper, trees, "node long, label int, w int, bins binary", drawn)
    return Forest(bounds, trees, n, upper, saved(dealt.groupBy("node").applyInArrow(grow, _TREE), "forest"))


def forest_scores(rows: DataFrame, forest: Forest) -> DataFrame:
    """(id, score) of rows(id from 0, features): the mean over the trees of the share of good rows.

    A row goes to its node of each tree, behind the tree that grows there, which is all that a task holds. Where there are more
    rows than the forest was fitted on, they are dealt to copies of it.
    """
    copies = max(1, -(-rows.count() // max(1, forest.rows)))

    def routed(tree, node, batch, x):
        return pa.RecordBatch.from_arrays([pa.array(node * copies + batch.column("id").to_numpy() % copies), batch.column("id"), batch.column("bins")], names=["key", "id", "data"])

    upper, trees = forest.upper, forest.trees
    ready = _to_nodes(_binned(rows.select("id", "features"), forest.bounds), upper, trees, "key long, id long, data binary", routed)
    grown_ = forest.lower.select(F.explode(F.sequence(F.col("node") * copies, F.col("node") * copies + (copies - 1))).alias("key"), F.lit(-1).cast("long").alias("id"), F.col("tree").alias("data"))
    shared = rows.sparkSession.sparkContext.broadcast(upper)

    def run(batches):
        now, tree = -1, None
        for batch in batches:
            key, id_, data = batch.column("key").to_numpy(), batch.column("id").to_numpy(), batch.column("data")
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (id_[:-1] < 0), True]) if len(key) else ()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if id_[a] < 0:
                    now, tree = key[a], Trees.unpacked(data[a].as_py())
                    continue
                if key[a] == now:
                    x = _bytes(data.slice(a, b - a))
                    share = tree.share[tree.end(x, np.zeros(len(x), int))]
                else:  # nothing grows below this node
                    share = np.full(b - a, shared.value.share[key[a] // copies])
                yield pa.RecordBatch.from_arrays([pa.array(id_[a:b]), pa.array(np.round(share * _ONE).astype(np.int64))], names=["id", "part"])

    parts = ready.unionByName(grown_).repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "id long, part long")
    return parts.groupBy("id").agg((F.sum("part") / (trees * float(_ONE))).alias("score"))
