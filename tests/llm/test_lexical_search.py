import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from curalume.llm import lexical_search as module
from curalume.llm.lexical_search import Ranking, Shard, Vocabulary, lexical_search, thresholds
from curalume.llm.bytes_np import ALNUM, LOWER, texts, words

DOCS, ITEMS = "doc_id long, text string, rank string, score string", "item_id long, text string, doc_id string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=50):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, occurrences = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for d, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * n // occurrences
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:k], 1)]
    return out


def corpus(seed, n=400):
    r = random.Random(seed)
    words_ = [f"w{i}" for i in range(300)] + ["Über", "naïve", "日本", "ÉTÉ"]
    weights = [1 / (i + 1) for i in range(len(words_))]
    docs = [(i * 3, " ".join(r.choices(words_, weights, k=r.randrange(1, 60)))) for i in range(n)]
    items = [(i, ", ".join(r.choices(words_, weights, k=r.randrange(1, 12)))) for i in range(20)]
    return docs, items


def check(frame, docs, items, **given):
    found = lexical_search(frame([(*d, "x", "y") for d in docs], DOCS), frame([(*i, "x") for i in items], ITEMS), **given).collect()
    order = lambda rows: sorted(rows, key=lambda r: (str(r[0]), r[3], r[1]))
    got, want = order(tuple(r) for r in found), order(brute(docs, items, given.get("k", 50)))
    assert got == want and len(found)


@pytest.mark.parametrize("given", [{}, {"k": 3}, {"k": 7, "short": 0.3}, {"short": 0.0, "k": 5}, {"short": 1.0}, {"block_terms": 20, "k": 5}, {"shard_documents": 60, "k": 4}])
def test_search_equals_brute_force(frame, given):
    check(frame, *corpus(1), **given)


def test_skipping_over_many_blocks(frame, monkeypatch):
    monkeypatch.setattr(module, "_BLOCK", 16)  # in the driver only: the executors' blocks hold the whole shard
    docs, items = corpus(2, 700)
    table = pa.table({"doc_id": pa.array([d for d, _ in docs]), "n": pa.array([len(terms(t)) for _, t in docs])})
    vocabulary = Vocabulary(sorted({t for _, x in docs for t in terms(x)}))
    number = {t: i for i, t in enumerate(sorted({t for _, x in docs for t in terms(x)}))}
    counts = [Counter(number[t] for t in terms(x)) for _, x in docs]
    table = table.append_column("terms", pa.array([sorted(c) for c in counts], pa.list_(pa.int32()))).append_column("tfs", pa.array([[c[t] for t in sorted(c)] for c in counts], pa.list_(pa.int32())))
    df = np.bincount([t for c in counts for t in c], minlength=len(vocabulary))
    weight = np.floor(1000 * np.log((2 * len(docs) + 2) / (2 * df + 1))).astype(np.int64)
    for share in (0.0, 0.05, 1.0):
        ranking = Ranking(weight, df <= share * len(docs), len(docs), sum(len(terms(t)) for _, t in docs), [], 6, np.ones(0, np.int64))
        shard = Shard(table, ranking)
        for item, text in items:
            own = np.array(sorted({number[t] for t in terms(text) if t in number}), np.int64)
            want = [(d, s) for _, _, d, s in brute(docs, [(item, text)], 6)]
            for least in (1, want[-1][1] if want else 1):
                at, scores = shard.best(own, ranking.short, least, 6)
                assert sorted(zip((-scores).tolist(), shard.id[at].tolist(), strict=True))[:6] == [(-s, d) for d, s in want]


def test_thresholds_are_reached_by_the_kth_best(frame):
    docs, items = corpus(3)
    for k in (1, 10):
        worst = {i: s for i, rank, _, s in brute(docs, items, k) if rank == k}
        seen = []
        real = module.thresholds
        try:
            module.thresholds = lambda *a: seen.append((a[1].queries, real(*a))) or seen[-1][1]
            rows = sorted(((i, t) for i, t in items), key=str)
            lexical_search(frame([(*d, "", "") for d in docs], DOCS), frame([(*i, "") for i in rows], ITEMS), k=k)
        finally:
            module.thresholds = real
        assert sorted(seen[0][1].tolist())[-1] <= max(worst.values()) and (seen[0][1] > 1).any()


def test_nulls_ties_repeated_rows_and_clashing_names(frame):
    docs = [(5, "alpha beta"), (3, "alpha beta"), (None, "alpha beta"), (3, "alpha beta"), (9, None), (8, ""), (7, "...")] + [(20 + i, f"filler{i} gamma") for i in range(9)]
    items = [(1, "alpha"), (1, "alpha"), (1, "beta gamma"), (None, "BETA"), (2, None), (4, "-"), (6, "absent")]
    check(frame, docs, items)
    check(frame, docs, items, k=2)


def test_empty_tables(spark, frame):
    none, item = spark.createDataFrame([], DOCS), frame([(1, "alpha", "")], ITEMS)
    assert lexical_search(none, item).count() == 0
    assert lexical_search(frame([(1, "alpha", "", "")], DOCS), spark.createDataFrame([], ITEMS)).count() == 0
    assert lexical_search(frame([(1, "...", "", "")], DOCS), item).columns == ["item_id", "rank", "doc_id", "score"]


def test_very_long_texts(frame):
    docs = [(1, "needle " + "hay " * 400_000), (2, "needle hay"), (3, "hay"), (4, "x" * 500_000)] + [(10 + i, "hay straw") for i in range(5)]
    check(frame, docs, [(1, "needle hay"), (2, "x" * 500_000), (3, "hay " * 1000)])


def test_terms_of_one_hash_are_told_apart():
    v = Vocabulary(["aa", "bb", "cc"])
    v.hash, v.most = np.full(3, v.hash[0]), 3
    data, offsets = texts(pa.array(["bb cc aa dd"]))
    x = words(data, offsets, ALNUM, LOWER)._replace(hash=np.full(4, v.hash[0]))
    assert v.codes(data, x).tolist() == [1, 2, 0, -1]


def test_thresholds_count_short_lists_only(frame):
    index = frame([(i, 2, [0, 1], [1, 1]) for i in range(8)] + [(99, 1, [1], [3])], "doc_id long, n long, terms array<int>, tfs array<int>")
    ranking = Ranking(np.array([10, 5]), np.array([True, False]), 9, 17, [np.array([0, 1]), np.array([1])], 4, np.ones(2, np.int64))
    found = thresholds(index, ranking, 3, 1000).tolist()
    assert found[0] > 1 and found[1] == 1
