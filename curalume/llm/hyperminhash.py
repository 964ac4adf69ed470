"""MinHash near-dedup with HyperMinHash registers.

A hash function deals a set's shingles to buckets; of each bucket's least value the register keeps the count of
leading zeros and some mantissa bits behind the leading one, 16 bits in all. Several hash functions with few buckets
each fill the registers of short texts too.

Bands of registers that agree bring sets together. Before texts are read, the share of registers in which a
pair agrees, less what registers of unlike sets agree in by collision, estimates its similarity; pairs that
are too far below the threshold for chance to explain go. The rest is verified on full sets, and pairs are
chosen, compared by families and linked as in the n-gram join, so that a group of copies costs one comparison a copy.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalume.llm.bytes_np import U64, mix, row_groups, signed, texts
from curalume.llm.ngram_join import _sets, classes_of_lists, parity_mark
from curalume.plans.tables import Scratch, saved

#: Hash functions, buckets of each, registers of a band. 32 bands of 4: a pair of similarity 0.85 misses all of them once in 10^10.
_FUNCTIONS, _BUCKETS, _BAND = 16, 8, 4
_REGISTERS = _FUNCTIONS * _BUCKETS
#: Mantissa bits; the other 6 of a register count leading zeros.
_MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
_SEEDS = mix(np.arange(1, _FUNCTIONS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def compressed(least: np.ndarray) -> np.ndarray:
    """Registers of bucket minima: leading zeros, then the bits behind the leading one. All bits set: an empty bucket."""
    high = (least >> U64(11)).astype(np.float64)  # 53 bits, so that the exponent is exact
    length = np.where(high > 0, np.frexp(high)[1] + 11, np.frexp((least & U64(0x7FF)).astype(np.float64))[1])
    zeros = np.minimum(64 - length, 62).astype(U64)
    mantissa = (least << zeros << U64(1)) >> U64(64 - _MANTISSA)
    out = ((zeros << U64(_MANTISSA)) | mantissa).astype(np.uint16)
    return np.where(least == U64(0xFFFFFFFFFFFFFFFF), EMPTY, out)


def registers(shingles: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """(rows, registers) of the sets that `row` deals the hashed shingles to."""
    out = np.empty((rows, _FUNCTIONS, _BUCKETS), np.uint16)
    for i, seed in enumerate(_SEEDS):
        h = mix(shingles ^ seed)
        least = np.full(rows * _BUCKETS, 0xFFFFFFFFFFFFFFFF, U64)
        np.minimum.at(least, row * _BUCKETS + (h >> U64(61)).astype(np.int64), h << U64(3))
        out[:, i] = compressed(least).reshape(rows, _BUCKETS)
    return out.reshape(rows, _REGISTERS)


def band_keys(found: np.ndarray) -> np.ndarray:
    """(rows, bands): a key of each band's registers, 0 where they are all empty."""
    packed = np.ascontiguousarray(found).view(U64)
    keys = mix(packed ^ mix(np.arange(1, packed.shape[1] + 1, dtype=U64)))
    return np.where(packed == U64(0xFFFFFFFFFFFFFFFF), U64(0), keys)


@functools.lru_cache(maxsize=100_000)
def _collisions(a: int, b: int) -> float:
    """How often two unlike sets of 2^(a/4) and 2^(b/4) shingles agree in a register, of those that one of them fills."""
    n, m = 2 ** (a / 4), 2 ** (b / 4)
    edge = np.concatenate([2.0 ** -(i + 1) * (1 + np.arange(1 << _MANTISSA) / (1 << _MANTISSA)) for i in range(61)] + [[1.0]])
    edge.sort()
    falls = [-np.diff(np.exp(size * np.log1p(-edge / _BUCKETS))) for size in (n, m)]
    either = 1 - np.exp((n + m) * math.log1p(-1 / _BUCKETS))
    return float(falls[0] @ falls[1] / either)


def estimated(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of pairs from their registers (pairs, registers) and set sizes, corrected for collisions, and how many registers tell."""
    told = ((a != EMPTY) | (b != EMPTY)).sum(1)
    agree = ((a == b) & (a != EMPTY)).sum(1)
    steps = [np.rint(4 * np.log2(np.maximum(n, 1))).astype(int).tolist() for n in (na, nb)]
    chance = np.array([_collisions(*x) for x in zip(*steps, strict=True)])
    return (agree / np.maximum(told, 1) - chance) / (1 - chance), told


def sketches(docs: DataFrame, id: str, text: str, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, sig1, sig2, mark, registers, bands) per row: set size, 128 bits of the set, parity mark, registers and band keys.

    A set so small that no other set can be similar enough has no bands. A batch is taken in slices of bounded text, so
    that a worker holds the shingles of one slice.
    """

    def run(batches):
        for batch in (whole.slice(lo, hi - lo) for whole in batches for lo, hi in row_groups(texts(whole.column(1))[1])):
            sets = [*_sets(batch.column(1), n)]
            size = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate([np.empty(0, U64), *sets])
            row = np.repeat(np.arange(len(sets)), size)
            found = registers(flat, row, len(sets))
            keys = band_keys(found)
            wanted = (keys != 0) & (100 * size >= percent * (size + 1))[:, None]
            sigs = [np.array([f(s).sum(dtype=U64) for s in sets], U64) for f in (mix, lambda s: mix(s ^ U64(0x5851F42D4C957F2D)))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size),
                    *(pa.array(signed(s)) for s in sigs),
                    pa.array([parity_mark(s) for s in sets], pa.binary()),
                    pa.array([r.tobytes() for r in found], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(wanted.sum(1))], pa.int32()), pa.array(signed(keys[wanted]))),
                ],
                names=["doc_id", "n_shingles", "sig1", "sig2", "mark", "registers", "bands"],
            )

    return docs.select(F.col(id).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, n_shingles long, sig1 long, sig2 long, mark binary, registers binary, bands array<long>")


def band_lists(firsts: DataFrame, cut: int) -> DataFrame:
    """(token, chunk, doc_id, n, pos): the sets of each band key that two or more have. Keys of more than `cut` sets are dealt out in chunks from 1 on; a band has no place in a set, so pos is 0."""
    entries = firsts.select(F.explode("bands").alias("token"), "doc_id", F.col("n_shingles").alias("n"))
    many = entries.groupBy("token").agg(F.count("*").alias("k")).where("k > 1")
    chunk = F.when(F.col("k") > cut, 1 + F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("k") / cut))).otherwise(0).cast("int")
    return entries.join(many.hint("merge"), "token").select("token", chunk.alias("chunk"), "doc_id", "n", F.lit(0).cast("long").alias("pos"))


def leading_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): each set with the leader that it meets in most bands. A list's leader, one for each class of sizes, is the set that is in most lists."""
    met = lists.groupBy("doc_id").agg(F.count("*").alias("met"))
    sized = lists.join(met.hint("merge"), "doc_id").select("token", "chunk", "doc_id", "n", F.floor(F.log("n") / math.log(100 / percent)).alias("fits"), "met")
    leaders = sized.groupBy("token", "chunk", "fits").agg(F.max(F.struct("met", (-F.col("doc_id")).alias("first"), "n")).alias("b"))
    pairs = sized.join(leaders.select("token", "chunk", "fits", (-F.col("b.first")).alias("b"), F.col("b.n").alias("nb")).hint("merge"), ["token", "chunk", "fits"])
    counted = pairs.where("doc_id <> b").groupBy(F.col("doc_id").alias("a"), "b", F.col("n").alias("na"), "nb").agg(F.count("*").alias("c"))
    best = counted.groupBy("a", "na").agg(F.max(F.struct("c", (-F.col("b")).alias("first"), "nb")).alias("x"))
    return best.select("a", (-F.col("x.first")).alias("b"), "na", F.col("x.nb").alias("nb"))


def likely(pairs: DataFrame, known: DataFrame, percent: int, sigmas: float = 6.0) -> DataFrame:
    """(a, b) of the pairs (a, b, na, nb) whose estimate is not more than so many deviations under the threshold."""
    sides = [known.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("registers").alias(f"r{x}")).hint("merge") for x in "ab"]
    both = pairs.select("a", "b", "na", "nb").join(sides[0], ["a", "na"]).join(sides[1], ["b", "nb"]).select("a", "b", "na", "nb", "ra", "rb")
    least = percent / 100

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, _REGISTERS) for i in (4, 5))
            found, told = estimated(a, b, batch.column(2).to_numpy(), batch.column(3).to_numpy())
            keep = found >= least - sigmas * np.sqrt(least * (1 - least) / np.maximum(told, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long").distinct()


def minhash_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 3, percent: int = 85, cut: int = 4096) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs`.

    Two texts link when 100 * |intersection| >= percent * |union| of their sets of distinct n-word shingles
    (A-Z lower-cased, words split at ASCII white space; a text with fewer words is one shingle). component_id is
    the least id reachable by links; kept tells that it is the row's own. Every link is confirmed on full sets; a
    link between different sets is missed if no band agrees, which happens once in 10^10 at 85 per cent.
    A null, empty or blank text has no shingles and no links. Of repeated rows with one id each gets a row; the
    id links if any of its texts does. A row with a null id keeps its count, has a null component and is
    kept. Other columns are ignored; an empty table gives no rows. `cut` is the number of sets of a band from which
    its list is dealt out in chunks.
    """
    scratch = Scratch(docs.sparkSession)
    try:
        return saved(_classes(docs, id, text, n, percent, cut, scratch.saved), "components")
    finally:
        scratch.close()


def _classes(docs: DataFrame, id: str, text: str, n: int, percent: int, cut: int, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    sets = save(sketches(docs, id, text, n, percent), "sets")
    known = sets.where("n_shingles > 0 and doc_id is not null")
    copies = save(known.groupBy("n_shingles", "sig1", "sig2").agg(F.min("doc_id").alias("first")), "copies")
    firsts = known.join(copies.select(F.col("first").alias("doc_id"), "n_shingles", "sig1", "sig2").hint("merge"), ["doc_id", "n_shingles", "sig1", "sig2"], "left_semi")
    lists = save(band_lists(firsts, cut), "lists")
    fits = lambda pairs: likely(pairs, known, percent)
    classes = classes_of_lists(docs, id, text, n, percent, cut, save, sets, copies, lists, fits(leading_pairs(lists, percent)), fits)
    return classes.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
