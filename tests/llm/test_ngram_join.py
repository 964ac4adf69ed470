import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from curalume.llm.ngram_join import _Marks, block_pairs, ngram_jaccard_classes, parity_mark

SCHEMA = "doc_id long, text string, component_id string"


def brute(rows, n, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    where, parent = defaultdict(list), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for k in s for j in where[k])
        for j, c in shared.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[find(i)] = find(j)
        for k in s:
            where[k].append(i)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return {d: (len(sets[i]), min(least[find(i)])) for i, (d, _) in enumerate(rows)}


def families(seed, copies=60, words=120):
    """Families of near copies with a few to many edits each, so that some link, some link by others and some don't."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, d = [], seed * 1000
    for _ in range(3):
        base = [r.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randrange(0, 9)):
                w[r.randrange(len(w))] = r.choice([f"x{r.randrange(10**6)}", "edit", r.choice(vocabulary)])
            if r.random() < 0.3:
                del w[: r.randrange(1, 25)]
            rows.append((d, " ".join(w)))
            d += 1
    r.shuffle(rows)
    return rows


def check(frame, rows, n=4, percent=85):
    found = ngram_jaccard_classes(frame([(*x, "clash") for x in rows], SCHEMA), n=n, percent=percent).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == brute(rows, n, percent)
    assert len(found) == len(rows)


def test_families_match_brute_force(frame):
    check(frame, families(1))


def test_other_width_and_similarity(frame):
    check(frame, families(2), n=5, percent=80)


def test_edges(frame):
    rows = [(5, None), (3, ""), (9, " \n\t"), (1, "one two"), (2, "ONE two"), (4, "a b c d"), (7, "A B C D"), (8, "a b c d"), (6, "x " * 5000), (10, "x " * 4000)]
    check(frame, rows)


def test_null_and_repeated_ids_and_empty_table(frame):
    found = ngram_jaccard_classes(frame([(None, "a b c d e", ""), (1, "a b c d e", ""), (1, "a b c d e", "")], SCHEMA)).collect()
    assert sorted((x.doc_id is None, x.n_shingles, x.component_id) for x in found if x.doc_id is not None) == [(False, 2, 1)] * 2
    assert [x.component_id for x in found if x.doc_id is None] == [None]
    assert ngram_jaccard_classes(frame([], SCHEMA)).count() == 0


def test_lists_dealt_in_chunks_match_brute_force(frame):
    rows = families(3)
    found = ngram_jaccard_classes(frame([(*x, "clash") for x in rows], SCHEMA), cut=8).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == brute(rows, 4, 85)


def test_long_lists_of_shingles_that_are_not_known_as_frequent(frame):
    rows = two_families(9)
    found = ngram_jaccard_classes(frame([(*x, "clash") for x in rows], SCHEMA), cut=8, share=2.0).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == brute(rows, 4, 85)


def two_families(seed, copies=50, words=150):
    """Two families whose bases share about three in four shingles, with copies between them, so that pairs of both are near the bound."""
    r = random.Random(seed)
    first = [f"w{r.randrange(300)}" for _ in range(words)]
    second = [*first[:-20], *(f"v{i}" for i in range(20))]
    rows, d = [], 0
    for _ in range(copies):
        for base in (first, second, [*first[:-10], *second[-10:]]):
            w = list(base)
            for _ in range(r.randrange(0, 7)):
                w[r.randrange(len(w))] = r.choice([f"x{r.randrange(10**6)}", "edit", "other"])
            for _ in range(r.randrange(0, 3)):
                a = r.randrange(len(w) - 8)
                del w[a : a + r.randrange(1, 8)]
            rows.append((d, " ".join(w)))
            d += 1
    return rows


@pytest.mark.parametrize("n, percent, cut", [(4, 85, 4096), (5, 80, 16), (3, 90, 4096)])
def test_near_families_match_brute_force(frame, n, percent, cut):
    rows = two_families(n)
    found = ngram_jaccard_classes(frame([(*x, "clash") for x in rows], SCHEMA), n=n, percent=percent, cut=cut).collect()
    expected = brute(rows, n, percent)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == expected
    assert len({c for _, c in expected.values()}) > 3


def test_an_id_with_several_texts_links_by_any(frame):
    rows = families(4, copies=20)
    more = [(5_000_000, rows[0][1]), (5_000_000, rows[1][1]), (5_000_000, "quite another text of its own")]
    found = {}
    for x in ngram_jaccard_classes(frame([(*x, "") for x in rows + more], SCHEMA)).collect():
        found.setdefault(x.doc_id, set()).add(x.component_id)
    parent = {d: c for d, (_, c) in brute(rows, 4, 85).items()}
    joined = {parent[rows[0][0]], parent[rows[1][0]]}
    expected = {d: {min(joined) if c in joined else c} for d, c in parent.items()}
    assert found == expected | {5_000_000: {min(joined)}}


def test_pairs_of_chunks_by_their_bounds(frame):
    # chunks 1 and 2 are of one component, 3 has another, 4 is far from all in size
    rows = [(9, b, d, n, n, p, c, d) for b, n, c in [(1, 100, 1), (2, 100, 1), (3, 100, 2), (4, 900, 3)] for p, d in [(b, 10 * b), (b, 10 * b + 1)]]
    rows += [(9, 4, 39, 900, 900, 3, 4, 39)]
    found = block_pairs(frame(rows, "token long, chunk int, doc_id long, n long, size long, pos long, component long, family long"), 85, False)
    assert sorted((r.x, r.y) for r in found.collect()) == [(1, 3), (2, 3), (4, 4)]


def test_parity_marks_differ_no_more_than_the_sets():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 3000, dtype=np.uint64)
    sets = [base[: r.integers(100, 3000)] for _ in range(30)] + [np.union1d(base[:900], r.integers(0, 2**63, 90, dtype=np.uint64)), base[:0]]
    marks = _Marks(pa.array([parity_mark(s) for s in sets]))
    e, f = (x.ravel() for x in np.meshgrid(range(len(sets)), range(len(sets))))
    for i, j, d in zip(e, f, marks.differ(e, f)):
        assert d <= len(np.setxor1d(sets[i], sets[j])) and (d == 0 or i != j)
    assert marks.differ(np.array([0]), np.array([31])).sum() > 0
