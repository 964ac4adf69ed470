import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from curalume.llm.sentence_dedup import sentence_dedup
from curalume.llm.suffix_dedup import common_prefixes, hot_keys, local_runs, longest_previous_factors, suffix_dedup, suffixes

SCHEMA = "doc_id long, text string, spans string"


def brute(rows, length):
    first, out = {}, {}
    for d, text in sorted(rows):
        b = (text or "").encode()
        mark = np.zeros(len(b), bool)
        windows = [b[i : i + length] for i in range(len(b) - length + 1)]
        for i, w in enumerate(windows):
            if first.get(w, d) < d:
                mark[i : i + length] = True
        for w in windows:
            first.setdefault(w, d)
        edges = np.flatnonzero(np.diff(np.r_[0, mark.astype(int), 0])).reshape(-1, 2)
        out[d] = ([tuple(x) for x in edges.tolist()], bytes(np.frombuffer(b, np.uint8)[~mark]))
    return out


def passages(seed):
    """Texts that share passages of all lengths, repeat themselves, and hold characters of several bytes."""
    r = random.Random(seed)
    letter = lambda: r.choice("abcdeé 名\n")
    shared = ["".join(letter() for _ in range(r.randrange(10, 200))) for _ in range(12)] + ["ab" * 60, "z" * 300]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(r.randrange(0, 8)):
            p = r.choice(shared)
            a = r.randrange(len(p))
            parts.append(p[a : a + r.randrange(1, 200)] if r.random() < 0.7 else "".join(letter() for _ in range(r.randrange(60))))
        rows.append((d, "".join(parts)))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (99, None), (98, ""), (97, "short")]
    return rows


@pytest.mark.parametrize("crowd", [20_000, 0])
def test_suffix_dedup_matches_brute_force(frame, crowd):
    rows = passages(1)
    found = suffix_dedup(frame([(*x, "clash") for x in rows], SCHEMA), crowd=crowd)
    assert {r.doc_id: ([(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in found.collect()} == brute(rows, 50)


def test_suffix_dedup_other_length_carry_and_edges(frame):
    rows = passages(2)
    found = suffix_dedup(frame([(*x, f"c{x[0]}") for x in rows], SCHEMA), length=20, k=6, carry=("spans",))
    expected = brute(rows, 20)
    for r in found.collect():
        assert bytes(r.kept) == expected[r.doc_id][1] and r.carried.spans == f"c{r.doc_id}"
        assert r.kept_text == expected[r.doc_id][1].decode("utf-8", "ignore")
    assert suffix_dedup(frame([], SCHEMA)).count() == 0
    twice = suffix_dedup(frame([(1, "x" * 99, ""), (1, "x" * 99, ""), (None, "x" * 99, ""), (2, "x" * 99, "")], SCHEMA))
    assert sorted((str(r.doc_id), len(r.kept)) for r in twice.collect()) == [("1", 99), ("1", 99), ("2", 0), ("None", 99)]


def one_passage(n):
    r = random.Random(5)
    passage = "".join(r.choice("abcdefgh ") for _ in range(120))
    noise = lambda: "".join(r.choice("ijklmnopqrstuvwxyz ") for _ in range(60))
    return [(d, noise() + passage + noise()) for d in range(n)]


def test_no_minimiser_brings_more_runs_together_than_a_bound(frame):
    docs = frame(one_passage(3000), "doc_id long, text string").withColumn("h", F.lit(0).cast("long"))
    most = lambda hot: local_runs(docs, 50, 12, hot).where("hi is null").groupBy("key").count().agg(F.max("count")).first()[0]
    hot = hot_keys(docs, 50, 12, crowd=100)
    assert most(None) > 2500 and 1 < len(hot) < 40 and most(hot) < 200


@pytest.mark.parametrize("crowd", [20, 20_000])
def test_a_passage_in_every_document_goes(frame, crowd):
    rows = one_passage(200)
    found = suffix_dedup(frame(rows, "doc_id long, text string"), crowd=crowd)
    assert {r.doc_id: ([(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in found.collect()} == brute(rows, 50)


def test_longest_previous_factors():
    r = random.Random(3)
    for _ in range(50):
        n = r.randrange(1, 30)
        lcp, doc = [0] + [r.randrange(6) for _ in range(n - 1)], [r.randrange(5) for _ in range(n)]
        expected = [max([0] + [min(lcp[min(i, j) + 1 : max(i, j) + 1]) for j in range(n) if doc[j] < doc[i]]) for i in range(n)]
        assert longest_previous_factors(np.array(lcp), np.array(doc)).tolist() == expected


def all_runs_brute(rows, least, min_words):
    """The sentences of each text that lie in a run of `least` sentences and `min_words` words or more that occurred before."""
    seen, out = set(), {}
    for d, text in sorted((r for r in rows if r[1] is not None)):
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        starts = [i for i in range(len(words)) if i == 0 or text[words[i - 1][1] - 1] in ".!?" or "\n" in text[words[i - 1][1] : words[i][0]]]
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), text[a:b]) for a, b in words]
        ends, gone = [*starts[1:], len(words)], set()
        for j in range(len(starts)):
            for i in range(j - least + 2):
                cut = [tuple(low[starts[k] : ends[k]]) for k in range(i, j + 1)]
                key = sum(cut, ())
                if len(key) >= min_words:
                    if key in seen:
                        gone |= set(range(i, j + 1))
                    seen.add(key)
        out[d] = gone
    return out


def removed_sentences(found):
    return {x.doc_id: {k for s in x.removed for k in range(s.start, s.end)} for x in found.collect()}


def test_last_short_sentences_of_a_repeated_run_go(frame):
    long = lambda d: " ".join(f"{d}{i}" for i in range(20)) + "."
    shared = f"{long('a')} {long('b')} Three words here. And three more."
    rows = [(1, f"{shared} Own end of one.", ""), (2, f"{shared} Some other end.", ""), (3, shared, "")]
    assert removed_sentences(sentence_dedup(frame(rows, SCHEMA))) == {1: set(), 2: {0, 1, 2, 3}, 3: {0, 1, 2, 3}}


@pytest.mark.parametrize("least, min_words", [(2, 12), (2, 1), (3, 5), (1, 9)])
def test_sentence_dedup_matches_all_runs(frame, least, min_words):
    r = random.Random(least)
    pool = [" ".join(r.choice(["One", "two", "thrée", "four"]) for _ in range(r.choice([1, 2, 3, 9, 14]))) + r.choice([".", "!", "?", "\n", ". \n"]) for _ in range(40)]
    rows = [(d, " ".join(pool[(k + i) % 40] if r.random() < 0.9 else r.choice(pool) for k in [r.randrange(40)] for i in range(r.randrange(0, 12)))) for d in range(80)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, rows[3][1])]
    result = sentence_dedup(frame([(*x, "clash") for x in rows], SCHEMA), least=least, min_words=min_words)
    found = removed_sentences(result)
    assert found == all_runs_brute(rows, least, min_words) | {200: set()} and any(found.values())
    texts = dict(rows)
    for x in result.collect():
        text = texts[x.doc_id] or ""
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        starts = [w[0] for i, w in enumerate(words) if i == 0 or text[words[i - 1][1] - 1] in ".!?" or "\n" in text[words[i - 1][1] : w[0]]]
        at = [*starts, len(text)]
        assert x.n_sentences == len(starts)
        assert x.kept == (text[: at[0]] + "".join(text[at[i] : at[i + 1]] for i in range(len(starts)) if i not in found[x.doc_id]) if starts else text)
    assert sentence_dedup(frame([], SCHEMA)).count() == 0


def test_two_sentences_that_repeat_go_without_a_floor(frame):
    docs = frame([(1, "I agree here. You do too.", ""), (2, "Well. I agree here. You do too.", "")], SCHEMA)
    assert removed_sentences(sentence_dedup(docs, min_words=1)) == {1: set(), 2: {1, 2}}
    assert removed_sentences(sentence_dedup(docs)) == {1: set(), 2: set()}


def test_repeated_ids_in_sentence_dedup(frame):
    a, b = "One two three four five six seven. Eight nine ten eleven twelve thirteen.", "Short start. And an end of its own, which is long. "
    rows = [(5, a, ""), (5, a, ""), (5, b + a, ""), (None, a, ""), (None, a, ""), (7, a, "")]
    found = sorted((str(x.doc_id), x.kept) for x in sentence_dedup(frame(rows, SCHEMA)).collect())
    kept = [k for d, k in found if d == "5"]
    assert [x for x in found if x[0] != "5"] == [("7", ""), ("None", a), ("None", a)]
    # equal rows fare alike; the passage stays in the text of least hash, or in both rows that are equal
    assert sorted(kept) in (sorted([a, a, b]), sorted(["", "", b + a]))


def test_one_id_with_two_texts_in_suffix_dedup(frame):
    x, y = "x" * 30 + "abcdefghij" * 8, "q" * 9 + "0123456789" * 30
    rows = [(1, y, ""), (3, x, ""), (3, x + y, ""), (3, x + y, ""), (9, y[50:] + x, ""), (None, x, "")]
    found = sorted((str(r.doc_id), r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept).decode()) for r in suffix_dedup(frame(rows, SCHEMA)).collect())
    assert found == sorted([("1", 309, [], y), ("3", 110, [], x), *[("3", 419, [(110, 419)], x)] * 2, ("9", 369, [(0, 369)], ""), ("None", 110, [], x)])


def test_previous_factors_of_real_suffixes(frame):
    r = random.Random(8)
    docs = ["".join(r.choice("ab") for _ in range(r.randrange(1, 60))) for _ in range(12)]
    data = np.frombuffer("".join(docs).encode(), np.uint8)
    ends = np.cumsum([len(d) for d in docs])
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    start = np.arange(len(data))
    suffix, size = suffixes(data, start, ends[doc])
    order = np.lexsort((doc, size, *suffix.T[::-1]))
    assert [bytes(data[i : ends[doc[i]]]) for i in order] == sorted(bytes(data[i : ends[doc[i]]]) for i in start)
    factor = np.zeros(len(data), int)
    factor[order] = longest_previous_factors(common_prefixes(suffix[order], size[order]), doc[order])
    text = lambda i: bytes(data[i : ends[doc[i]]])
    for i in start:
        best = 0
        for j in start[doc < doc[i]]:
            n = 0
            while n < min(len(text(i)), len(text(j))) and text(i)[n] == text(j)[n]:
                n += 1
            best = max(best, n)
        assert factor[i] == best


CHINESE = "今天的天气非常好，我们一起去公园散步。孩子们在草地上玩耍！你想和我们一起来吗？晚上我们回家吃饭。"
THAI = "วันนี้อากาศดีมากเราไปเดินเล่นในสวนสาธารณะด้วยกัน\nเด็กๆเล่นอยู่บนสนามหญ้าและหัวเราะเสียงดัง\n"


def test_repeats_in_scripts_without_spaces_go(frame):
    rows = [(1, CHINESE), (2, CHINESE), (3, "他说了别的话。" + CHINESE + "最后一句不同。"), (4, "很好。谢谢。"), (5, "很好。谢谢。"), (6, THAI), (7, "หัวข้อ\n" + THAI + "จบ"), (8, "क्या यह सही है? हाँ यह बिल्कुल सही है। हम सब यहाँ बहुत खुश हैं।"), (9, "क्या यह सही है? हाँ यह बिल्कुल सही है। हम सब यहाँ बहुत खुश हैं। और।")]
    found = {x.doc_id: x for x in sentence_dedup(frame([(*x, "") for x in rows], SCHEMA)).collect()}
    assert {d: x.kept for d, x in found.items()} == {1: CHINESE, 2: "", 3: "他说了别的话。最后一句不同。", 4: "很好。谢谢。", 5: "很好。谢谢。", 6: THAI, 7: "หัวข้อ\nจบ", 8: rows[7][1], 9: "और।"}
    assert found[1].n_sentences == 4 and found[3].n_sentences == 6 and found[8].n_sentences == 3


def in_marks(text):
    """Words with the bytes that they span, split behind end marks of other scripts; whether a sentence begins there; and words each counts for."""
    out = []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        for p in re.finditer(r"[^。！？｡؟۔।॥]*[。！？｡؟۔।॥]|[^。！？｡؟۔।॥]+", m[0]):
            fresh = not out or out[-1][0][-1] in ".!?。！？｡؟۔।॥" or "\n" in text[out[-1][2] : m.start() + p.start()]
            wide = len(re.findall(r"[\u3000-\u9fff\u0e00-\u0eff\u1780-\u17ff\u1000-\u10bf]", p[0]))
            out.append((p[0], m.start() + p.start(), m.start() + p.end(), fresh, max(1, -(-wide // 2))))
    return out


def test_mixed_scripts_match_all_runs(frame):
    r = random.Random(4)
    part = lambda: r.choice(["好", "天气很好", "ไทย", "word", "Two words", "é", "हाँ", "。", "!", "の"]) + r.choice(["。", "！", "", " ", "\n", ".", "? ", "।"])
    pool = ["".join(part() for _ in range(r.randrange(1, 7))) for _ in range(25)]
    rows = [(d, "".join(r.choice(pool) for _ in range(r.randrange(0, 9)))) for d in range(60)]
    seen, want = set(), {}
    for d, text in rows:
        w = in_marks(text)
        starts = [i for i, x in enumerate(w) if x[3]]
        ends, gone = [*starts[1:], len(w)], set()
        for j in range(len(starts)):
            for i in range(j):
                key = tuple(re.sub("[A-Z]", lambda m: m[0].lower(), x[0]) for x in w[starts[i] : ends[j]])
                if sum(x[4] for x in w[starts[i] : ends[j]]) >= 4:
                    if (key, tuple(ends[k] - starts[k] for k in range(i, j + 1))) in seen or key in seen:
                        gone |= set(range(i, j + 1))
                    seen.add(key)
        want[d] = (len(starts), gone)
    found = sentence_dedup(frame([(*x, "") for x in rows], SCHEMA), min_words=4).collect()
    assert {x.doc_id: (x.n_sentences, {k for s in x.removed for k in range(s.start, s.end)}) for x in found} == want and any(g for _, g in want.values())


def test_planted_passage_goes_from_later_documents(frame):
    passage = "This is the first sentence of it here. " + " ".join(f"word{i}" for i in range(30)) + ". And a third one closes the passage now. "
    rows = [(d, f"Lead {d} of its own kind. {passage}Tail {d} is its own as well.", "") for d in range(20)]
    for r in sentence_dedup(frame(rows, SCHEMA)).collect():
        assert ("word3" in r.kept) == (r.doc_id == 0) and f"Tail {r.doc_id}" in r.kept and f"Lead {r.doc_id}" in r.kept


def test_digest_is_of_the_bytes_left(spark):
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
