import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from curalume.llm.bytes_np import U64, mix
from curalume.llm.hyperminhash import EMPTY, _collisions, band_keys, band_lists, compressed, estimated, minhash_classes, registers, sketches
from tests.llm.test_ngram_join import SCHEMA, brute, families


def check(frame, rows, n=3, percent=85, **given):
    found = minhash_classes(frame([(*x, "clash") for x in rows], SCHEMA), n=n, percent=percent, **given).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, n, percent)
    assert len(found) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in found)


def sketch_of(sets):
    flat = np.concatenate([mix(np.array([*s], U64)) for s in sets])
    return registers(flat, np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets))


@pytest.mark.parametrize(("seed", "n", "percent", "cut"), [(1, 3, 85, 4096), (2, 3, 85, 20), (3, 5, 80, 4096)])
def test_classes_equal_brute_force(frame, seed, n, percent, cut):
    rows = families(seed)
    rows += [(d + 5000, t) for d, t in rows[:40]] + [(9000 + i, " ".join(f"u{seed}{i}{j}" for j in range(50))) for i in range(40)]
    check(frame, rows, n, percent, cut=cut)


def test_short_texts_link_where_few_shingles_differ(frame):
    r, rows = random.Random(5), []
    for i in range(120):
        base = [f"b{i}_{j}" for j in range(r.randrange(1, 14))]
        for k in range(3):
            rows.append((i * 10 + k, " ".join(base + [f"end{k}"] * r.randrange(0, 2))))
    check(frame, rows)


def test_nulls_empty_texts_repeated_rows_and_ids(frame, spark):
    long_ = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long_), (4, long_), (5, long_.upper()), (6, "two words"), (7, "TWO words"), (8, "one")]
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_classes(frame([(*x, "") for x in rows], SCHEMA)).collect())
    assert found == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 38, 4, True), (4, 38, 4, True), (5, 38, 4, False), (6, 1, 6, True), (7, 1, 6, False), (8, 1, 8, True)]
    null = minhash_classes(frame([(None, long_, ""), (9, long_, ""), (9, "another text of one id", "")], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in null) == [(0, 38, 0, True), (9, 3, 9, True), (9, 38, 9, True)]
    assert minhash_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_very_long_text(frame):
    r = random.Random(6)
    base = [f"w{r.randrange(20_000)}" for _ in range(120_000)]
    other = [w if r.random() > 0.02 else "new" for w in base]
    check(frame, [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base[:60_000])), (4, "x" * 300_000)])


def test_registers_keep_zeros_and_mantissa():
    least = np.array([0xFFFFFFFFFFFFFFFF, 1 << 63, (1 << 63) | (0x2AB << 53), (1 << 40) | (3 << 38), 8, 0], U64)
    assert compressed(least).tolist() == [int(EMPTY), 0, 0x2AB, (23 << 10) | (3 << 8), 60 << 10, 62 << 10]


def test_estimates_of_similarity(spark):
    r = np.random.default_rng(7)
    for size, share in [(400, 0.9), (400, 0.5), (60, 0.85), (5000, 0.2), (400, 0.0)]:
        both = round(2 * size * share / (1 + share))
        pairs = []
        for _ in range(60):
            x = r.integers(0, 2**62, 2 * size).tolist()
            pairs += [set(x[:size]), set(x[:both] + x[size : 2 * size - both])]
        found = sketch_of(pairs)
        n = np.full(60, size)
        got, told = estimated(found[::2], found[1::2], n, n)
        assert abs(got.mean() - share) < 0.02 and got.std() < 0.07 and (told > 100).all()


def test_collisions_are_as_frequent_as_expected():
    r = np.random.default_rng(8)
    agree = []
    for _ in range(400):
        a, b = sketch_of([set(r.integers(0, 2**62, 256).tolist()) for _ in range(2)])
        agree.append((a == b).mean())
    assert 0.3 < np.mean(agree) / _collisions(32, 32) < 3 and _collisions(32, 32) < 1e-3


def test_bands_of_pairs_at_the_threshold_are_not_missed():
    r = np.random.default_rng(9)
    for size, apart in [(6, 1), (40, 3), (300, 24)]:
        sets = []
        for _ in range(400):
            x = r.integers(0, 2**62, size + 2 * apart).tolist()
            sets += [set(x[:size]), set(x[: size - apart] + x[size : size + apart]) if size > 6 else set(x[: size + 1])]
        keys = band_keys(sketch_of(sets))
        met = ((keys[::2] == keys[1::2]) & (keys[::2] != 0)).sum(1)
        assert (met > 2).all(), "a bound far from none"


def test_lists_of_frequent_bands_are_dealt_out(frame):
    rows = [(i, 10, [1, 100 + i] if i % 2 else [2]) for i in range(60)]
    found = band_lists(frame(rows, "doc_id long, n_shingles long, bands array<long>"), 8).collect()
    assert len(found) == 60 and {r.token for r in found} == {1, 2} and len({(r.token, r.chunk) for r in found}) > 4


def test_a_batch_of_many_texts_is_held_in_slices(spark):
    class Docs:
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    run = sketches(Docs(), "doc_id", "text", 3, 85)
    told = [" ".join(f"w{i}x{k}" for k in range(800)) for i in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(told)], names=["doc_id", "text"])
    [*run(iter([batch.slice(0, 400)]))]
    tracemalloc.start()
    rows = sum(x.num_rows for x in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1500 and peak < 60e6, peak
