"""Exact n-gram Jaccard join that skips by set relations.

Sets of word shingles are indexed by the rare end of their shingles (prefix filter). Two relations keep the pairs few:

* Index lists are read by block and position: blocks whose sizes or positions leave too few common shingles, or that
  are of one component or one family, are skipped whole. A pair that is left must also agree in the parity marks of
  both sets: these differ in no more places than the sets do.
* Sets much like one another make a family with one pivot, to which each member is compared once. A member's answers
  follow from the pivot's: with A and B written as what they change of the pivot, A and B differ exactly where
  the changes do. So pairs of one family are joined on their changes, which are small, and a link is
  decided from both lists of changes alone. Families that the comparison with the pivot has linked whole are done.

Sets that are in one component already are not compared again. Results are classes (connected components of the
links), not all pairs: a group of copies costs one comparison a copy.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalume.llm.bytes_np import U64, grams, mix, row_groups, signed, texts, words
from curalume.operators.components import star_contraction
from curalume.plans.tables import Scratch, saved

_BLOCK = 256
#: Bits of a set's parity mark: the next power of two from its size on, within these bounds.
_LEAST_BITS, _MOST_BITS = 512, 8192


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-word shingles of each text; a shorter text has its whole sequence as one."""
    data, offsets = texts(column)
    for lo, hi in row_groups(offsets):
        base = offsets[lo]
        w = words(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
        g = grams(w.hash, n)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(g[a : b - n + 1])
            elif b > a:
                yield grams(w.hash[a:b], b - a)
            else:
                yield np.empty(0, U64)


def frequent_shingles(docs: DataFrame, text: str, n: int, share: float, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in about `share` of the documents or more, sorted, and in how many.

    Every document is counted. A shingle of that share has it in some batch at least, so batches report
    only those. They number at most mean length / share and `limit`; the order of shingles that they fix
    changes the join's work, never its result.
    """

    def local(batches):
        counts: dict[int, int] = {}
        for batch in batches:
            found = [*_sets(batch.column(0), n)]
            value, count = np.unique(np.concatenate(found) if found else np.empty(0, U64), return_counts=True)
            many = count >= max(3, share / 2 * batch.num_rows)
            for v, c in zip(signed(value[many]).tolist(), count[many].tolist(), strict=True):
                counts[v] = counts.get(v, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array([*counts], pa.int64()), pa.array([*counts.values()], pa.int64())], names=["token", "c"])

    total = docs.count()
    top = docs.select(text).mapInArrow(local, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= max(3, share * total)).orderBy(F.desc("c"), "token").limit(limit).toPandas()
    token, count = top["token"].to_numpy(np.int64).view(U64), top["c"].to_numpy(np.int64)
    order = np.argsort(token)
    return token[order], count[order]


def parity_mark(s: np.ndarray) -> bytes:
    """Whether an odd number of the set's shingles falls in each place; half as many places are the two halves' difference."""
    bits = min(_MOST_BITS, max(_LEAST_BITS, 1 << max(0, len(s) - 1).bit_length()))
    odd = np.bincount((mix(s ^ U64(0x1F83D9ABFB41BD6B)) % U64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def shingle_sets(docs: DataFrame, id: str, text: str, n: int, percent: int, frequent: tuple[np.ndarray, np.ndarray], cut: int) -> DataFrame:
    """(id, n_shingles, sig1, sig2, prefix, chunk, mark): set size, 128 bits of the set, the shingles that a partner must share one of, and its parity mark.

    chunk deals a shingle's list out where it has more than `cut` sets, from 1 on by the set's hash; else it is 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        token, count = shared.value
        for batch in batches:
            size, sig1, sig2, prefix, chunk, mark, at = [], [], [], [], [], [], [0]
            for s in _sets(batch.column(1), n):
                size.append(len(s))
                sig1.append(int(mix(s).sum(dtype=U64)))
                sig2.append(int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)))
                k = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                p = np.minimum(np.searchsorted(token, s), max(0, len(token) - 1))
                hot = token[p] == s if len(token) else np.zeros(len(s), bool)
                rare = s[~hot][:k]
                lot = np.zeros(len(rare), np.int32)
                if len(rare) < k:
                    c = count[p[hot]]
                    last = np.argsort(c, kind="stable")[: k - len(rare)]
                    rare = np.concatenate((rare, s[hot][last]))
                    lot = np.concatenate((lot, np.where(c[last] > cut, 1 + (sig2[-1] >> 16) % -(-c[last] // cut), 0).astype(np.int32)))
                prefix.append(rare)
                chunk.append(lot)
                mark.append(parity_mark(s))
                at.append(at[-1] + len(rare))
            flat = signed(np.concatenate(prefix)) if prefix else np.empty(0, np.int64)
            lots = np.concatenate(chunk) if chunk else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(np.array(sig1, U64).view(np.int64)), pa.array(np.array(sig2, U64).view(np.int64)), *(pa.ListArray.from_arrays(pa.array(at, pa.int32()), x) for x in (pa.array(flat, pa.int64()), pa.array(lots, pa.int32()))), pa.array(mark, pa.binary())],
                names=["doc_id", "n_shingles", "sig1", "sig2", "prefix", "chunk", "mark"],
            )

    return docs.select(F.col(id).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, n_shingles long, sig1 long, sig2 long, prefix array<long>, chunk array<int>, mark binary")


def index_lists(entries: DataFrame) -> DataFrame:
    """entries (token, chunk, doc_id, n, pos) of tokens that two sets or more have; lists are sorted by Spark and read as a stream, never held whole."""

    def run(batches):
        held = None  # the last entry, whose list can go on
        began = False  # whether the list of `held` has an entry before it
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            token, chunk = t.column("token").to_numpy(), t.column("chunk").to_numpy()
            same = token[1:] == token[:-1]
            keep = np.r_[began, same] | np.r_[same, False] | (chunk > 0)
            if len(keep) > 1:
                began = bool(same[-1])
            yield from t.filter(pa.array(np.r_[keep[:-1], False])).to_batches()
            held = t.slice(len(t) - 1).to_batches()[0]
        if held is not None and (began or held.column("chunk")[0].as_py() > 0):
            yield held

    ordered = entries.repartition("token", "chunk").sortWithinPartitions("token")
    return ordered.mapInArrow(run, "token long, chunk int, doc_id long, n long, pos long")


def leading_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): each set with the leader that it meets most often.

    A list has a leader for each class of sizes that fit: the set with the largest share of its shingles in lists.
    """
    prefix = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    met = lists.groupBy("doc_id").agg(F.count("*").alias("met"))
    sized = lists.join(met, "doc_id").select("token", "chunk", "doc_id", "n", F.floor(F.log("n") / math.log(100 / percent)).alias("fits"), (F.col("met") / prefix).alias("common"))
    leaders = sized.groupBy("token", "chunk", "fits").agg(F.max_by("doc_id", F.struct("common", -F.col("doc_id"))).alias("b"))
    pairs = sized.join(leaders, ["token", "chunk", "fits"]).where("doc_id <> b").groupBy(F.col("doc_id").alias("a"), "b").agg(F.count("*").alias("c"))
    return pairs.groupBy("a").agg(F.max_by("b", F.struct("c", -F.col("b"))).alias("b"))


def verified(pairs: DataFrame, wanted: DataFrame, n: int, save: Callable[[DataFrame, str], DataFrame], near: int = 101, group_rows: int = 2000) -> DataFrame:
    """(a, b, common, na, nb, change) of pairs (a, b), exactly, from the whole texts in wanted(doc_id, text).

    change is what a has beyond b, then what it lacks of b, where they share `near` per cent of their union or
    more, else null. Partners of one set b are compared with it where its text arrives once for every `group_rows` of them.
    """
    part = F.when(F.col("m") <= group_rows, F.lit(0)).otherwise(F.pmod(F.xxhash64("a"), F.ceil(F.col("m") / group_rows))).cast("int")
    pairs = save(pairs.select("a", "b"), "pairs")
    counted = save(pairs.join(pairs.groupBy("b").agg(F.count("*").alias("m")), "b").select("a", "b", part.alias("part")), "dealt")
    # what each text is wanted for: as a's, or (a null) as b's, so that texts are shuffled to their pairs once
    asked = counted.select(F.col("a").alias("doc_id"), "b", "part", "a").unionByName(counted.select(F.col("b").alias("doc_id"), "b", "part", F.lit(None).cast("long").alias("a")).distinct())

    def made(rows):
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i < 5 else pa.list_(pa.int64())) for i, x in enumerate(cols)], names=["a", "b", "common", "na", "nb", "change"])

    def run(batches):
        key, mine = None, []
        for batch in batches:
            b, part, a = (batch.column(i).to_pylist() for i in range(3))
            rows, held = [], 0
            for i, s in enumerate(_sets(batch.column(3), n)):
                if (b[i], part[i]) != key:
                    key, mine = (b[i], part[i]), []
                if a[i] is None:
                    mine.append(s)
                    continue
                for o in mine:
                    common = len(np.intersect1d(s, o, assume_unique=True))
                    close = 100 * common >= near * (len(s) + len(o) - common)
                    rows.append((a[i], b[i], common, len(s), len(o), signed(np.r_[np.setdiff1d(s, o, True), np.setdiff1d(o, s, True)]) if close else None))
                    held += len(s) + len(o) - 2 * common if close else 0
                if held > 1_000_000:
                    yield made(rows)
                    rows, held = [], 0
            yield made(rows)

    both = wanted.select("doc_id", "text").join(asked.hint("merge"), "doc_id").select("b", "part", "a", "text").repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return both.mapInArrow(run, "a long, b long, common long, na long, nb long, change array<long>")


def families(close: DataFrame, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(doc_id, family, pivot, size) of the sets in pairs (a, b) of much alike sets: connected ones are a family, its pivot the one that most are paired with."""
    members = star_contraction(close.select(F.col("a").alias("src"), F.col("b").alias("dst")), save=save).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    followers = close.groupBy(F.col("b").alias("doc_id")).agg(F.count("*").alias("k"))
    pivots = members.join(followers, "doc_id", "left").groupBy("family").agg(F.max_by("doc_id", F.struct(F.coalesce("k", F.lit(0)), -F.col("doc_id"))).alias("pivot"), F.count("*").alias("size"))
    return members.join(pivots, "family").select("doc_id", "family", "pivot", "size")


def change_lists(members: DataFrame, percent: int, cut: int) -> DataFrame:
    """Index lists over the changes of a family's members: (token, chunk, doc_id, n, size, pos, component, family).

    `members` has doc_id, n, component, family and change. Partners of a set that is not linked with the pivot share
    changes with it, one of the first that its size allows at least; what a set has beyond the pivot comes first,
    as that is rare. Lists of more than `cut` sets are dealt out.
    """
    first = F.floor((100 - percent) * F.col("n") / percent).cast("int") + 1
    key = F.xxhash64("family", "token")
    entries = members.select("doc_id", "n", F.size("change").cast("long").alias("size"), "component", "family", F.posexplode(F.slice("change", F.lit(1), first)).alias("pos", "token")).withColumn("token", key)
    many = entries.groupBy("token").agg(F.count("*").alias("k")).where("k > 1")
    chunk = F.when(F.col("k") > cut, 1 + F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("k") / cut))).otherwise(0).cast("int")
    return entries.join(many, "token").select("token", chunk.alias("chunk"), "doc_id", "n", "size", F.col("pos").cast("long").alias("pos"), "component", "family")


def _differences(percent: int, n: Column) -> Column:
    """The most places where two sets of n shingles together can differ and link."""
    return (100 - percent) * n / (100 + percent)


def block_pairs(lists: DataFrame, percent: int, inside: bool) -> DataFrame:
    """(token, x, y): pairs of chunks, x <= y, of the lists with more than one that no bound of theirs excludes."""
    bounds = lists.groupBy("token", "chunk").agg(*(f(k).alias(f"{to}_{k}") for k in ("n", "size", "pos", "component", "family") for f, to in ((F.min, "low"), (F.max, "high"))), F.max(F.col("size") - F.col("pos")).alias("rest"))
    l, r = (bounds.select("token", *(F.col(c).alias(f"{side}_{c}") for c in bounds.columns[1:])) for side in "xy")
    pairs = l.join(r, "token").where("x_chunk <= y_chunk")
    pairs = pairs.where(f"100 * x_high_n >= {percent} * y_low_n and 100 * y_high_n >= {percent} * x_low_n")
    most = F.least("x_rest", "y_rest")
    if not inside:
        most = most + F.least("x_high_pos", "y_high_pos")
    pairs = pairs.where(2 * most >= F.col("x_low_size") + F.col("y_low_size") - _differences(percent, F.col("x_high_n") + F.col("y_high_n")))
    one = lambda k: f"x_low_{k} = x_high_{k} and y_low_{k} = y_high_{k} and x_low_{k} = y_low_{k}"
    pairs = pairs.where(f"not ({one('component')})")
    if not inside:
        pairs = pairs.where(f"not ({one('family')})")
    return pairs.select("token", F.col("x_chunk").alias("x"), F.col("y_chunk").alias("y"))


def _whole(batches, keys: int) -> Iterator[pa.Table]:
    """Batches sorted by their first `keys` columns as tables that no key crosses."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:keys]]
        new = np.zeros(batch.num_rows, bool)
        for x, c in zip(k, batch.columns, strict=False):
            new[1:] |= x[1:] != x[:-1]
        new[0] = bool(held) and any(x[0] != c[-1].as_py() for x, c in zip(k, held[-1].columns, strict=False))
        cut = np.flatnonzero(new)
        if len(cut):
            held.append(batch.slice(0, cut[-1]))
            yield pa.Table.from_batches(held)
            batch, held = batch.slice(cut[-1]), []
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


class _Marks:
    """Parity marks of some sets, to be compared in pairs."""

    def __init__(self, column: pa.Array):
        data, offsets = texts(column)
        self.words, self.at = data.view(U64), offsets[:-1] // 8
        self.width = np.diff(offsets) // 8

    def differ(self, e: np.ndarray, f: np.ndarray) -> np.ndarray:
        """In how many places the marks of e and f differ, at the width of the shorter one."""
        out = np.zeros(len(e), np.int64)
        width = np.minimum(self.width[e], self.width[f])
        for w in np.unique(width[width > 0]).tolist():
            some = np.flatnonzero(width == w)
            out[some] = np.bitwise_count(self._folded(e[some], w) ^ self._folded(f[some], w)).sum(1)
        return out

    def _folded(self, e: np.ndarray, w: int) -> np.ndarray:
        x = self.words[self.at[e][:, None] + np.arange(w)]
        wide = self.width[e]
        for k in range(1, int(wide.max()) // w):
            more = np.flatnonzero(wide > k * w)
            x[more] ^= self.words[self.at[e[more]][:, None] + k * w + np.arange(w)]
        return x


def meeting_pairs(lists: DataFrame, percent: int, inside: bool) -> DataFrame:
    """(a, b, na, nb, c): pairs of different components that meet in a list and that no bound excludes, and in how many lists.

    `lists` has token, chunk, doc_id, n, size, pos, component, family and mark. `size` counts what is indexed
    of a set, `pos` is the place of the token in it. inside: pairs of one family, in lists of changes; else pairs of
    different families, in lists of shingles. Lists in chunks (from 1 on) are dealt by pairs of chunks, those
    that their bounds leave, so that a task holds two chunks of a list at most.
    """
    cut = lists.where("chunk > 0")
    chosen = block_pairs(cut, percent, inside)
    sides = chosen.select("token", "x", "y", F.col("x").alias("chunk")).unionByName(chosen.where("x < y").select("token", "x", "y", F.col("y").alias("chunk")))
    zero = F.lit(0).cast("int")
    names = ["token", "x", "y", "chunk", "doc_id", "n", "size", "pos", "component", "family", "mark"]
    dealt = lists.where("chunk = 0").withColumns({"x": zero, "y": zero}).select(names).unionByName(cut.join(sides, ["token", "chunk"]).select(names)).repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")

    def run(batches):
        for whole in _whole(batches, 3):
            yield from pairs_of(whole)

    def pairs_of(table):
        c = {k: table.column(k).to_numpy() for k in names[:-1]}
        order = np.lexsort((c["doc_id"], c["pos"], c["size"], c["chunk"], c["y"], c["x"], c["token"]))
        marks = _Marks(table.column("mark").combine_chunks().take(pa.array(order)))
        c = {k: v[order] for k, v in c.items()}
        c["rest"] = c["size"] - c["pos"]
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = (c["token"][1:] != c["token"][:-1]) | (c["x"][1:] != c["x"][:-1]) | (c["y"][1:] != c["y"][:-1])
        cuts = np.flatnonzero(new)
        out: list[tuple[np.ndarray, ...]] = []
        held = 0

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out]) if out else np.empty(0, np.int64), pa.int64()) for i in range(4)], names=["a", "b", "na", "nb"])

        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a < 2 or (c["component"][a:b] == c["component"][a]).all() or not inside and (c["family"][a:b] == c["family"][a]).all():
                continue
            middle = a + int(np.searchsorted(c["chunk"][a:b], c["y"][a])) if c["x"][a] < c["y"][a] else a
            blocks = [(i, min(i + _BLOCK, q)) for p, q in ((a, middle), (middle, b)) for i in range(p, q, _BLOCK)]
            low = {k: [c[k][i:j].min() for i, j in blocks] for k in ("n", "size", "component", "family")}
            high = {k: [c[k][i:j].max() for i, j in blocks] for k in ("n", "pos", "rest", "component", "family")}
            for x, (i, j) in enumerate(blocks):
                for y in range(x, len(blocks)):
                    if middle > a and not i < middle <= blocks[y][0]:
                        continue
                    if 100 * high["n"][x] < percent * low["n"][y] or 100 * high["n"][y] < percent * low["n"][x]:
                        continue
                    most = min(high["rest"][x], high["rest"][y]) + (0 if inside else min(high["pos"][x], high["pos"][y]))
                    if (100 + percent) * (2 * most - low["size"][x] - low["size"][y]) < -(100 - percent) * (high["n"][x] + high["n"][y]):
                        continue
                    if any(low[k][x] == high[k][x] == low[k][y] == high[k][y] for k in (("component",) if inside else ("component", "family"))):
                        continue
                    p, q = blocks[y]
                    l, r = slice(i, j), slice(p, q)
                    n1, n2 = c["n"][l, None], c["n"][None, r]
                    most = np.minimum(c["rest"][l, None], c["rest"][None, r])
                    if not inside:
                        most = most + np.minimum(c["pos"][l, None], c["pos"][None, r])
                    ok = (c["component"][l, None] != c["component"][None, r]) & ((c["family"][l, None] == c["family"][None, r]) == inside) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))
                    ok &= (100 + percent) * (2 * most - c["size"][l, None] - c["size"][None, r]) >= -(100 - percent) * (n1 + n2)
                    if x == y:
                        ok = np.triu(ok, 1)
                    u, v = np.nonzero(ok)
                    u, v = u + i, v + p
                    for at in range(0, len(u), 10_000):
                        e, f = u[at : at + 10_000], v[at : at + 10_000]
                        fine = (100 + percent) * marks.differ(e, f) <= (100 - percent) * (c["n"][e] + c["n"][f])
                        e, f = e[fine], f[fine]
                        first = c["doc_id"][e] < c["doc_id"][f]
                        e, f = np.where(first, e, f), np.where(first, f, e)
                        out.append((c["doc_id"][e], c["doc_id"][f], c["n"][e], c["n"][f]))
                        held += len(e)
                    if held > 500_000:
                        yield batch_of()
                        out, held = [], 0
        yield batch_of()

    return dealt.mapInArrow(run, "a long, b long, na long, nb long").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))


def _enough(na: str, nb: str, c: str, percent: int) -> Column:
    """Whether sets of these sizes that share c prefix shingles can still link.

    Common shingles outside both prefixes lie behind the end of one of them.
    """
    behind = F.greatest(*(F.ceil(F.col(x) * percent / F.lit(100)) - 1 for x in (na, nb)))
    return (100 + percent) * (F.col(c) + behind) >= percent * (F.col(na) + F.col(nb))


def linked_by_changes(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(src, dst) of the pairs of one family that link: both sets differ where one of them changes the pivot and the other doesn't."""
    l, r = (members.select(F.col("doc_id").alias(x), F.col("change").alias(f"{x}_change")) for x in "ab")
    both = pairs.join(l, "a").join(r, "b")
    differ = F.size("a_change") + F.size("b_change") - 2 * F.size(F.array_intersect("a_change", "b_change"))
    return both.where((100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb"))).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def ngram_jaccard_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85, share: float = 0.0002, limit: int = 200_000, cut: int = 4096) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs`.

    Two texts link when 100 * |intersection| >= percent * |union| of their sets of distinct n-word shingles
    (A-Z lower-cased, words split at ASCII white space; a text with fewer words is one shingle). component_id
    is the least id reachable by links. A null, empty or blank text has no shingles and no links. Of repeated
    rows with one id each gets a row; the id links if any of its texts does. A row with a null id keeps its
    count and gets a null component. Other columns are ignored; an empty table gives no rows.
    `share` and `limit` bound the list of frequent shingles that is broadcast (see frequent_shingles);
    `cut` is the number of entries of a list from which it is dealt out in chunks of about that many.
    """
    scratch = Scratch(docs.sparkSession)
    save = scratch.saved
    try:
        return saved(_classes(docs, id, text, n, percent, share, limit, cut, save), "components")
    finally:
        scratch.close()


def _classes(docs: DataFrame, id: str, text: str, n: int, percent: int, share: float, limit: int, cut: int, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    sets = save(shingle_sets(docs, id, text, n, percent, frequent_shingles(docs, text, n, share, limit), cut), "sets")
    known = sets.where("n_shingles > 0 and doc_id is not null")
    copies = save(known.groupBy("n_shingles", "sig1", "sig2").agg(F.min("doc_id").alias("first")), "copies")
    firsts = known.join(copies.select(F.col("first").alias("doc_id"), "n_shingles", "sig1", "sig2").hint("merge"), ["doc_id", "n_shingles", "sig1", "sig2"], "left_semi")
    entries = firsts.select("doc_id", F.col("n_shingles").alias("n"), F.posexplode(F.arrays_zip("prefix", "chunk")).alias("pos", "x")).select(F.col("x.prefix").alias("token"), F.col("x.chunk").alias("chunk"), "doc_id", "n", F.col("pos").cast("long").alias("pos"))
    lists = save(index_lists(entries), "lists")
    return classes_of_lists(docs, id, text, n, percent, cut, save, sets, copies, lists, leading_pairs(lists, percent), lambda pairs: pairs.where(_enough("na", "nb", "c", percent)))


def classes_of_lists(
    docs: DataFrame, id: str, text: str, n: int, percent: int, cut: int, save: Callable[[DataFrame, str], DataFrame],
    sets: DataFrame, copies: DataFrame, lists: DataFrame, leaders: DataFrame, fits: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """(doc_id, n_shingles, component_id) from the sets, the first ones of equal sets, and index lists that bring all sets together that can link.

    `leaders` has pairs (a, b) to compare first, one an a at most; `fits` leaves those of the pairs (a, b, na, nb, c) of
    different families that are worth reading texts for.
    """
    known = sets.where("n_shingles > 0 and doc_id is not null")
    wanted = save(docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(lists.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), "wanted")

    linked = (100 + percent) * F.col("common") >= percent * (F.col("na") + F.col("nb"))
    first = save(verified(leaders, wanted, n, save, near=50), "compared")
    # an id with several texts is in no family
    mixed_ids = known.select("doc_id", "n_shingles", "sig1", "sig2").distinct().groupBy("doc_id").count().where("count > 1").select("doc_id")
    close = first.where("change is not null")
    for end in "ab":
        close = close.join(mixed_ids.withColumnRenamed("doc_id", end).hint("merge"), end, "left_anti")
    close = save(close.select("a", "b", "common", "na", "nb", "change"), "close")
    members = save(families(close, save), "families")
    apart = members.where("size > 2 and doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))
    second = save(verified(apart.join(close.select("a", "b"), ["a", "b"], "left_anti"), wanted, n, save, near=0), "compared")
    ends = [F.col("a").alias("src"), F.col("b").alias("dst")]
    exact = first.where(linked).select(*ends).unionByName(second.where(linked).select(*ends))
    parts = star_contraction(exact, save=save).select(F.col("node").alias("doc_id"), "component")

    # pairs of one family: by what they change of its pivot
    placed = members.join(parts, "doc_id", "left").select("doc_id", "family", "pivot", "size", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("family").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("family")
    changes = close.unionByName(second).join(apart, ["a", "b"]).select(F.col("a").alias("doc_id"), F.col("na").alias("n"), "change")
    open_ = save(changes.dropDuplicates(["doc_id"]).join(placed.join(mixed, "family", "left_semi"), "doc_id").select("doc_id", "n", "component", "family", "change"), "changes")
    by_change = meeting_pairs(change_lists(open_, percent, cut).withColumn("mark", F.lit(None).cast("binary")), percent, inside=True)
    inner = linked_by_changes(by_change, open_, percent)

    # pairs of different families, or of none: by their shingles
    labelled = lists.join(placed.select("doc_id", "component", "family"), "doc_id", "left").select("token", "chunk", "doc_id", "n", F.col("n").alias("size"), "pos", *(F.coalesce(c, "doc_id").alias(c) for c in ("component", "family")))
    labelled = save(labelled, "labelled")
    several = labelled.groupBy("token").agg(*(f(c).alias(f"{to}_{c}") for c in ("component", "family") for f, to in ((F.min, "low"), (F.max, "high"))), F.count("*").alias("k")).where("low_component <> high_component and low_family <> high_family").select("token", "k")
    # any list that is still whole and long is dealt out here, whether its shingle was known as frequent or not
    lot = F.when((F.col("chunk") == 0) & (F.col("k") > cut), 1 + F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("k") / cut))).otherwise(F.col("chunk")).cast("int")
    marked = labelled.join(several.hint("merge"), "token").withColumn("chunk", lot).drop("k").join(known.select("doc_id", F.col("n_shingles").alias("n"), "mark").hint("merge"), ["doc_id", "n"])
    across = fits(meeting_pairs(marked, percent, inside=False))
    outer = verified(across, wanted, n, save).where(linked).select(*ends)

    same_id = known.join(copies, ["n_shingles", "sig1", "sig2"]).where("doc_id <> first").select(F.col("first").alias("src"), F.col("doc_id").alias("dst"))
    classes = star_contraction(exact.unionByName(inner).unionByName(outer).unionByName(same_id), save=save).withColumnRenamed("node", "doc_id")
    return sets.select("doc_id", "n_shingles").join(classes, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
