import math
import random
import re
from collections import Counter

import numpy as np

from curalume.llm.bytes_np import EXACT, NOT_SPACE, words
from curalume.llm.decontaminate import _equal_spans, clean_documents, decontaminated
from curalume.llm.langid import held_out, identify, language_profiles
from curalume.llm.quality import good_documents, quality_model, quality_rules
from curalume.llm.token_counts import PRE_TOKEN, Trie, token_counts, zipf_scores

DOCS = "doc_id long, text string, kept string"


def junk(r, n):
    return " ".join(r.choice(["BUY", "WIN", "$$$", "%%%"]) + "!!" for _ in range(n))


def prose(r, n):
    return " ".join(r.choice(["river", "stone", "walks", "green", "over", "the", "quietly", "morning"]) + str(r.randrange(50)) for _ in range(n))


def test_quality_counts_match_brute_force_and_model_separates(frame):
    r = random.Random(1)
    rows = [(d, junk(r, 40) if d % 3 == 0 else prose(r, 60)) for d in range(150)]
    rows += [(900, None), (901, ""), (902, "a b\na b\n\n \na b #$%"), (903, "one two three four five six seven eight nine " * 6), (904, "É é x " * 30)]
    docs = frame([(*x, "clash") for x in rows], DOCS)
    labels = frame([(d, 0 if d % 3 == 0 else 1) for d in range(150)] + [(5000, 1), (1, None)], "doc_id long, quality int")
    model = quality_model(docs, labels)
    found = {x.doc_id: x for x in quality_rules(docs, model).collect()}
    for d, text in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w))
        f = found[d]
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed) == expected
    assert all(found[d].kept == (d % 3 != 0) for d in range(150))
    kept = good_documents(docs, model)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {d for d in found if found[d].kept}
    assert quality_model(docs, labels.where("quality = 1")) is None
    bare = {x.doc_id: x for x in quality_rules(docs, None).collect()}
    assert bare[0].probability is None and bare[0].kept != bare[0].base_failed
    assert quality_rules(frame([], DOCS), model).count() == 0


def test_quality_verdict_matches_a_plain_score(frame):
    """Word and 4-byte buckets looked up one by one, scaled, calibrated and held against the threshold."""
    r = random.Random(9)
    rows = [(d, junk(r, 30) if d % 2 else prose(r, 40)) for d in range(80)] + [(200, "été " * 30), (201, "ab " * 25), (202, "river1 BUY!! " * 2 + prose(r, 18))]
    docs = frame([(*x, "") for x in rows], DOCS)
    model = quality_model(docs, frame([(d, d % 2) for d in range(80)], "doc_id long, quality int"))
    for x in quality_rules(docs, model).collect():
        data = dict(rows)[x.doc_id].encode()
        tokens = re.findall(rb"[^\x20\x09-\x0D]+", data)
        z = float(model.bias[0])
        for t in tokens:
            one = np.frombuffer(t, np.uint8)
            z += 5.0 / len(tokens) ** 0.5 * float(model.weights[int(words(one, np.array([0, len(one)]), NOT_SPACE, EXACT).hash[0]) >> 48, 0])
        for i in range(len(data) - 3):
            code = (int.from_bytes(data[i : i + 4], "little") * 0x9E3779B1) % (1 << 32)
            z += 50.0 / (len(data) - 3) * float(model.weights[(1 << 16) + (code >> 16), 0])
        p = 1 / (1 + math.exp(-(model.slope * z + float(model.shift[0]))))
        p = p if model.classes[1] == "1" else 1 - p
        assert math.isclose(x.probability, p, rel_tol=1e-6, abs_tol=1e-9)
        assert x.kept == (not x.base_failed and x.probability >= 0.5)


def test_null_and_repeated_ids_in_quality_and_token_counts(frame):
    r = random.Random(10)
    text = prose(r, 40)
    rows = [(None, text, ""), (1, text, ""), (1, text, ""), (1, "few words", ""), (None, None, "")]
    found = sorted((str(x.doc_id), x.n_words, x.kept) for x in quality_rules(frame(rows, DOCS), None).collect())
    assert found == [("1", 2, False), ("1", 40, True), ("1", 40, True), ("None", 0, False), ("None", 40, True)]
    docs, labels = frame([(None, "a b", ""), (1, prose(r, 30), ""), (1, prose(r, 30), ""), (2, junk(r, 30), "")], DOCS), frame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    assert quality_model(docs, labels).classes == ["0", "1"]
    counts = sorted((str(x.doc_id), x.n_tokens) for x in token_counts(frame(rows, DOCS), {b"r": -1.0, b"few": -1.0, b" words": -1.0}).collect())
    assert [d for d, _ in counts] == ["1", "1", "1", "None", "None"] and ("1", 2) in counts and ("None", 0) in counts
    assert len({n for d, n in counts if n > 2}) == 1


def decontaminate_brute(docs, items, size):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, who = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    who |= windows[tuple(w[k : k + n])]
        out[d] = (len(w), len(hit), sorted(who))
    return out


def test_decontamination_matches_brute_force_in_one_and_more_blocks(frame):
    r = random.Random(2)
    word = lambda: r.choice(["Alpha", "beta", "été", "x1", "名", "the"])
    items = [(i, ", ".join(word() for _ in range(r.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(30)] + [(31, None), (32, "--"), (33, "alpha beta"), (33, "alpha beta")]
    docs = [(d, " ".join(r.choice(items)[1] or "" if r.random() < 0.3 else word() for _ in range(r.randrange(0, 30)))) for d in range(60)] + [(90, None), (91, ""), (92, "Alpha-BETA")]
    df, it = frame([(*x, "clash") for x in docs], DOCS), frame(items, "item_id long, text string")
    expected = decontaminate_brute(docs, items, 10)
    for block in (100_000, 40):
        found = {x.doc_id: (x.n_words, sum(s.end - s.start for s in x.spans), x["items"]) for x in decontaminated(df, it, block_windows=block).collect()}
        assert found == expected
    assert all(not x.spans for x in decontaminated(df, frame([], "item_id long, text string")).collect())
    assert decontaminated(frame([], DOCS), it).count() == 0


def test_decontamination_keeps_rows_of_null_and_repeated_ids(frame):
    items = frame([(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(8)], "item_id long, text string")
    text = lambda i: " ".join(f"i{i}w{j}" for j in range(12))
    docs = frame([(d, t, "clash") for d, t in [(None, "one"), (None, text(1)), (None, None), (7, f"a b {text(2)}"), (7, f"{text(3)} c"), (7, f"{text(3)} c"), (8, "")]], DOCS)
    expected = sorted([("None", 1, [], []), ("None", 12, [(0, 12)], ["1"]), ("None", 0, [], []), ("7", 14, [(2, 14)], ["2"]), *[("7", 13, [(0, 12)], ["3"])] * 2, ("8", 0, [], [])])
    for block in (100_000, 5):
        found = decontaminated(docs, items, block_windows=block)
        assert found.columns == ["doc_id", "n_words", "spans", "items"]
        assert sorted((str(x.doc_id), x.n_words, [(s.start, s.end) for s in x.spans], x["items"]) for x in found.collect()) == expected


def test_clean_documents_are_the_rows_without_a_hit(frame):
    items = frame([(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(8)], "item_id long, text string")
    hit = lambda i: "lead " + " ".join(f"I{i}W{j}" for j in range(12))
    rows = [(None, "one", "a"), (None, hit(1), "b"), (7, hit(2), "c"), (7, "clean text", "d"), (8, None, "e"), (9, "", "f"), (10, hit(3)[:-5], "g"), (11, hit(3)[:-18], "h")]
    for block in (100_000, 5):
        found = clean_documents(frame(rows, DOCS), items, block_windows=block)
        assert found.columns == ["doc_id", "text", "kept"] and sorted(x.kept for x in found.collect()) == list("adef") + ["h"]
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 1, "no task holds two blocks"


def test_words_are_compared_byte_by_byte():
    x, y = (np.frombuffer(b, np.uint8) for b in (b"abcd ab", b"xabcabd"))
    start, end = np.array([0, 0, 5, 0]), np.array([3, 3, 7, 2])
    assert _equal_spans(x, start, end, y, np.array([1, 4, 4, 1]), np.array([4, 7, 6, 4])).tolist() == [True, False, True, False]


def lang_grams(text):
    """n-grams of 1 to 3 bytes of lower-cased words with a mark on both sides, by falling count, then size and bytes."""
    folded = re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text or "").encode()
    counts = Counter()
    for w in re.findall(rb"[a-z\x80-\xff]+", folded):
        w = b" " + w + b" "
        for n in (1, 2, 3):
            counts.update(w[i : i + n] for i in range(len(w) - n + 1) if w[i : i + n] != b" ")
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))], counts


def test_profiles_and_distances_match_brute_force(frame):
    r = random.Random(11)
    pool = {"en": "the and that Éve with from-this have x9y".split(), "fr": "les des une dans être leçon ÉTÉ".split(), "de": "und der nicht über Schön".split()}
    rows = [(d, None if d % 17 == 0 else " ".join(r.choice(pool[lang]) for _ in range(r.randrange(0, 25))), lang) for d in range(90) for lang in [r.choice([*pool])]]
    top = 25
    learnt = {}
    for lang in pool:
        learnt[lang] = {g: i + 1 for i, g in enumerate(lang_grams("\n".join(t or "" for _, t, k in rows if k == lang))[0][:top])}
    docs = frame(rows, "doc_id long, text string, lang string")
    profiles = language_profiles(docs, top=top)
    code = lambda g: int.from_bytes(g, "big") + ((len(g) - 1) << 24)
    assert {(x.lang, x.gram): x["rank"] for x in profiles.collect()} == {(lang, code(g)): k for lang, p in learnt.items() for g, k in p.items()}
    for x in identify(docs, profiles, top=top).collect():
        own = lang_grams(dict((d, t) for d, t, _ in rows)[x.doc_id])[0][:top]
        if not own:
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        far = {lang: sum(min(top, abs(p[g] - i)) if g in p else top for i, g in enumerate(own, 1)) / (top * len(own)) for lang, p in learnt.items()}
        assert math.isclose(1 - x.score, min(far.values()), abs_tol=1e-9) and math.isclose(far[x.lang_pred], min(far.values()), abs_tol=1e-9)


def test_language_profiles(frame):
    words = {"en": "the and that with from this have".split(), "fr": "les des une pour dans être leçon".split(), "de": "und der nicht über schön wird".split()}
    r = random.Random(3)
    rows = [(d, " ".join(r.choice(words[lang]) for _ in range(30)).capitalize(), lang) for d, lang in ((i, r.choice(list(words))) for i in range(200))]
    docs = frame(rows, "doc_id long, text string, lang string")
    profiles = language_profiles(docs.where(~held_out()))
    found = {x.doc_id: (x.lang_pred, x.score) for x in identify(docs, profiles).collect()}
    assert np.mean([found[d][0] == lang for d, _, lang in rows]) > 0.98
    assert all(0 <= s <= 1 for _, s in found.values())
    odd = frame([(1, None), (2, ""), (3, "123 !?"), (4, "ÜBER SCHÖN und der " * 2000), (None, "the that with")], "doc_id long, text string")
    got = {x.doc_id: x.lang_pred for x in identify(odd, profiles).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "de", None: "en"}
    assert {x.lang_pred for x in identify(odd, language_profiles(docs.limit(0))).collect()} == {"und"}
    assert identify(docs.limit(0), profiles).count() == 0


def test_rank_order_distance_by_hand(frame):
    profiles = frame([("xx", ord("a"), 1), ("xx", ord("b"), 2), ("yy", ord("b"), 1)], "lang string, gram long, rank long")
    # "ab" in marks: a, b once each, then five more n-grams that no profile has
    found = identify(frame([(1, "ab")], "doc_id long, text string"), profiles, top=10).first()
    grams = 2 + 3 + 2
    assert found.lang_pred == "xx" and math.isclose(found.score, 1 - (0 + 0 + 10 * (grams - 2)) / (10 * grams))


def token_brute(text, scores, unknown):
    import regex

    total = 0
    for t in regex.findall(PRE_TOKEN, text or ""):
        b = t.encode()
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(b)
        for i in range(1, len(b) + 1):
            options = [(best[i - 1][0] + unknown, -(best[i - 1][1]) - 1)] + [(best[j][0] + scores[b[j:i]], -best[j][1] - 1) for j in range(i) if b[j:i] in scores]
            s, n = max(options)
            best[i] = (s, -n)
        total += best[-1][1]
    return total


def test_token_counts_match_plain_dynamic_programming(frame, tmp_path):
    import base64

    r = random.Random(5)
    pieces = [bytes([b]) for b in b"abcdefghijklmnopqrstuvwxyz "] + list({"".join(r.choice("abcde ") for _ in range(r.randrange(2, 6))).encode() for _ in range(80)}) + ["é".encode()]
    path = tmp_path / "vocabulary.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(p) + f" {i}\n".encode() for i, p in enumerate(pieces)))
    scores = zipf_scores(path.read_bytes().splitlines())
    assert math.isclose(sum(map(math.exp, scores.values())), 1)
    rows = [(d, "".join(r.choice("abcdeé  \n9名") for _ in range(r.randrange(60)))) for d in range(60)] + [(100, None), (101, ""), (102, "abc " * 5000)]
    docs = frame([(*x, "clash") for x in rows], DOCS)
    expected = {d: token_brute(t, scores, -30.0) for d, t in rows}
    assert {x.doc_id: x.n_tokens for x in token_counts(docs, scores).collect()} == expected
    assert {x.doc_id: x.n_tokens for x in token_counts(docs, str(path)).collect()} == expected
    assert token_counts(docs.limit(0), scores).count() == 0


def test_very_long_pre_tokens_are_counted_the_same(frame):
    r = random.Random(6)
    pieces = [b"a", b"b", b"ab", b"aab", b"abab", b"bbbbbb", b"ba"]
    scores = {p: -1.0 - r.random() * len(p) ** 0.5 for p in pieces}
    trie = Trie(scores, -30.0)
    for _ in range(40):
        token = bytes(r.choice(b"abc") for _ in range(r.randrange(1, 300)))
        assert trie.count_of(token) == trie.add(token)
    rows = [(1, "ab" * 400_000, ""), (2, "ab" * 400, ""), (3, "".join(r.choice("ab") for _ in range(900)), "")]
    found = {x.doc_id: x.n_tokens for x in token_counts(frame(rows, DOCS), scores).collect()}
    assert found[1] == found[2] * 1000 and found[3] == token_brute(rows[2][1], scores, -30.0)
