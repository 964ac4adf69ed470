"""Texts of millions of bytes go through every operator in slices of bounded size."""

import random

from curalume.llm.decontaminate import decontaminated
from curalume.llm.langid import identify, language_profiles
from curalume.llm.ngram_join import ngram_jaccard_classes
from curalume.llm.quality import quality_rules
from curalume.llm.sentence_dedup import sentence_dedup
from curalume.llm.suffix_dedup import suffix_dedup


def test_long_texts(frame):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(20_000)]
    long = " ".join(r.choice(words) for _ in range(450_000))
    part = long[1_000_000:1_300_000]
    near = long.replace(" ", "\n", 50)
    docs = frame([(1, long), (2, "own start " + part + " own end"), (3, near), (4, "z" * 3_000_000), (5, long[-2000:])], "doc_id long, text string")

    cut = {x.doc_id: x for x in suffix_dedup(docs).collect()}
    assert len(cut[1].spans) == 0 and len(cut[4].spans) == 0 and bytes(cut[5].kept) == b""
    assert [(s.start, s.end) for s in cut[2].spans][0][1] - cut[2].spans[0].start in range(300_000, 300_004) and len(cut[2].spans) == 1
    assert 0 < len(cut[3].kept) < 1000

    assert {x.doc_id: x.component_id for x in ngram_jaccard_classes(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    q = {x.doc_id: x for x in quality_rules(docs, None).collect()}
    assert q[1].n_words == 450_000 and q[4].word_chars == 3_000_000
    item = " ".join(long.split()[200_000:200_010])
    hit = {x.doc_id: x for x in decontaminated(docs, frame([(9, item)], "item_id long, text string")).collect()}
    assert [(s.start, s.end) for s in hit[1].spans] == [(200_000, 200_010)] and not hit[4].spans
    assert {x.doc_id: x.n_sentences for x in sentence_dedup(docs).collect()}[3] == 51
    profiles = language_profiles(frame([("x", long)], "lang string, text string"))
    assert {x.doc_id: x.lang_pred for x in identify(docs, profiles).collect()}[1] == "x"
