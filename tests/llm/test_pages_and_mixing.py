import gzip
import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from curalume.llm import html_extract, warc
from curalume.llm.html_extract import extracted, main_text
from curalume.llm.mixing import mix_to_targets, with_rates


def test_article_without_what_is_around():
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href=/>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- x -->
    <article class=post><h1>Head &amp; line</h1><p><b>First <i>para</i>
    graph.<br><p>Second, with &eacute; &#233; &lt;b&gt;.<form><input>Search</form><aside>Side</aside>
    <div class="ad">Buy</div><ul><li>One<li>Two</ul><p>Tiny.</article>
    <div id="comments"><p>Reader says a lot of things, truly, and more.</div><footer>&copy; x</footer>"""
    assert main_text(page) == "Head & line\n\nFirst para graph.\n\nSecond, with é é <b>.\n\nOne\n\nTwo\n\nTiny."


def test_paths_by_ratio_without_an_article():
    words = "A long sentence, with marks; and it goes on. " * 4
    page = f"<body><div class=top><span>Home</span></div><div id=text><h2>Title</h2><p>{words}</p><p>Short.</p><p>{words}</p></div><table><tr><td>1<td>2</table></body>"
    assert main_text(page) == f"Title\n\n{words.strip()}\n\nShort.\n\n{words.strip()}"


def test_paths_by_ratio_inside_an_article():
    words = "A long sentence, with marks; and it goes on. " * 4
    teasers = "".join(f"<li><a href=/{i}>Another headline, number {i}</a></li>" for i in range(5))
    page = f"""<body><article><h1>Head</h1><div>We use small files.</div><div><p>Buy it now</p></div><ul>{teasers}</ul><a href=/x>All news</a>
    <p>{words}</p><p>Short.</p><h2>Next</h2><p>{words}</p><blockquote><p>Said so.</p></blockquote><ul><li>One<li>Two</ul>
    <figure><figcaption>A picture</figcaption></figure><p>{words}</p><div><div><p>Nice one</p></div><div><p>Me too</p></div></div></article><p>{words}</p>"""
    one = words.strip()
    assert main_text(page) == "\n\n".join(["Head", one, "Short.", "Next", one, "Said so.", "One", "Two", "A picture", one])
    deep = f"<main><h1><a href=/>Head</a></h1><div class=text><p>{words}<p><a name=x>{words}<p>Short.</div><section><h3><a href=/1>Teaser</a></h3></section></main>"
    assert main_text(deep) == "\n\n".join(["Head", one, one, "Short."])


def test_outside_the_article_is_scored_and_weighs_little():
    words = "A long sentence, with marks; and it goes on. " * 4
    page = f"<body><div><p>{words}</p></div><article><p>{words}</p></article><section><p>{words}</p></section></body>"
    assert main_text(page) == words.strip()
    assert main_text(f"<article><h1> </h1></article><p>{words}</p>") == words.strip()


def test_ratios_match_a_plain_computation():
    """Means of length and marks by path, half from the siblings' weighted means, times the text outside links, against a tenth of the best."""
    p1, p2, short = "One, two, three; four. " * 9, "Five six seven eight nine. " * 7, "Ten."
    page = f"<div><p>{p1}<p>{p2}<p class=x>{short}</div><div><span>{'z' * 30}</span></div><div class=y>{'k' * 9}</div><ul class=l><li><a href=/>{'Link text ' * 9}</a></ul>"
    kept = {"p": [p1.strip(), p2.strip()], "p.x": [short], "span": ["z" * 30], "y": ["k" * 9], "li": [("Link text " * 9).strip()]}
    marks = lambda s: len(re.findall(r"[.,;:!?]", s))
    size = {k: sum(map(len, v)) / len(v) for k, v in kept.items()}
    punct = {k: sum(map(marks, v)) / len(v) for k, v in kept.items()}
    chars = {k: sum(map(len, v)) for k, v in kept.items()}
    near = lambda m: (m["p"] * chars["p"] + m["p.x"] * chars["p.x"]) / (chars["p"] + chars["p.x"])
    score = {k: (size[k] + near(size)) / 2 * (1 + (punct[k] + near(punct)) / 2) for k in ("p", "p.x")} | {"span": 30.0, "y": 9.0, "li": 0.0}
    best = max(score.values())
    assert score["p.x"] > best / 10 > score["y"] and best / 10 > score["span"]
    assert main_text(page) == "\n\n".join(x for k, v in kept.items() for x in v if score[k] >= best / 10)


def test_ratios_find_the_given_articles_without_their_marks(monkeypatch):
    """Pages of sf0.01 with article tags turned into div: 95 of 100 keep their text without the label list, 4 of 5 without lists of elements too."""
    html = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()
    marked = [main_text(x) for x in html]
    plain = [re.sub(r"<(/?)(?:article|main)\b", r"<\1div", x or "") for x in html]
    monkeypatch.setattr(html_extract, "_AROUND", frozenset())
    assert [main_text(x) for x in html] == marked
    assert sum(main_text(x) == y for x, y in zip(plain, marked)) >= 0.95 * len(html)
    monkeypatch.setattr(html_extract, "_NEVER", html_extract._RAW | {"head"})
    assert sum(main_text(x) == y for x, y in zip(plain, marked)) >= 0.8 * len(html)


def test_core_by_mass_without_an_article():
    """What is outside the core weighs its share, a heading above the core is inside, and paragraphs of the text elsewhere stay."""
    words = "A long sentence, with marks; and it goes on. " * 4
    text = f"<div class=text>{f'<p>{words}</p>' * 8}</div>"
    one = words.strip()
    assert main_text(f"<body><div class=line>Buy two of these, now, today.</div>{text}<div class=low>All rights are kept, by us.</div></body>") == "\n\n".join([one] * 8)
    assert main_text(f"<body><h1>Head</h1>{text}<div class=last><p>{words}</p></div></body>") == "\n\n".join(["Head", *[one] * 9])
    halves = "".join(f"<div class=part{i}><p>{words}</p></div>" for i in range(2))
    assert main_text(f"<body>{halves}</body>") == "\n\n".join([one] * 2)
    assert main_text("<ul><li><a href=/>All links</a></ul>") == "All links" and main_text("<div>" * 3000 + "deep text, here") == "deep text, here"


def test_characters_without_width_stay():
    assert main_text("<p>a\u200bb c\ufeffd \u00a0 e and more, of it") == "a\u200bb c\ufeffd e and more, of it"


def test_very_long_pages_and_texts(frame):
    html = "<article>" + "<p>Some words, and more of them.</p>" * 40_000 + "<p>" + "x" * 2_000_000 + "</article>"
    found = extracted(frame([(1, "u", html)], "page_id long, url string, html string")).first()
    assert len(found.text) == 2_000_000 + 40_000 * 31
    back = warc.archived_pages(frame([(1, "u", html), (2, "u", html)], "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.refers_to) for r in back) == [(1, len(html), None), (2, len(html), 1)]
    docs = frame([(1, "good words " * 300_000), (2, "bad words " * 10), (3, "good words"), (4, "bad words")], "doc_id long, text string")
    rated, _ = mix_to_targets(docs, frame([(3, "g"), (4, "b")], "doc_id long, domain string"), {"g": 0.5, "b": 0.5})
    assert {r.doc_id: r.n_tokens for r in rated.collect()} == {1: 600_000, 2: 20, 3: 2, 4: 2}


def test_odd_pages(frame):
    rows = [(1, "u", None, 0), (2, None, "", 0), (3, "u", "<p>a < b<p>", 0), (None, "u", "plain text", 0), (3, "u", "<div", 0), (4, "u", "<p>" + "word " * 50_000, 0)]
    found = extracted(frame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(found) == 6 and sorted(r.text[:10] for r in found) == ["", "", "<div", "a < b", "plain text", "word word "]
    assert extracted(frame([], "page_id long, url string, html string")).count() == 0


def test_arc_versions_round_trip():
    body = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\n<p>\n1 2 3\n"
    for version in (1, 2):
        data = warc.arc_header(version, "x.arc", "20240102030405") + warc.arc_record(version, "http://h/a b", "1.2.3.4", "20240102030405", "text/html", body) + warc.arc_record(version, "http://h/e", "1.2.3.4", "2024", "text/plain", b"")
        rows = [*warc.convert(data)]
        assert [r[1] for r in rows] == ["http://h/a b", "http://h/e"] and rows[0][3] == "2024-01-02T03:04:05Z" and rows[0][5] == b"<p>\n1 2 3\n"
        assert rows[0][7] == hashlib.sha256(b"<p>\n1 2 3\n").hexdigest() and rows[0][0].startswith("urn:uuid:")
        assert len([*warc.convert(data[:-30])]) < 2
    assert [*warc.convert(b"")] == [] and [*warc.convert(b"http://h 1.1.1.1 2024 text/html 99\nshort")] == []


def test_bytes_of_any_kind_keep_their_length_and_digest(spark, frame, tmp_path):
    latin = b"HTTP/1.0 200 OK\r\nServer: caf\xe9\r\nX-Page-Id: 1\r\n\r\n<p>caf\xe9</p>"
    raw = bytes(range(256)) * 5
    arc = warc.arc_header(1, "x", "20000101000000") + b"".join(warc.arc_record(1, f"http://h/{i}", "1.1.1.1", "20000101000000", "image/png", b) for i, b in enumerate([latin, raw, latin]))
    records = warc.arc_records(frame([(bytearray(arc),)], "arc binary")).withColumn("refers_to", F.when(F.col("uri") == "http://h/2", "urn:uuid:x"))
    warc.write_warc(records.coalesce(1), str(tmp_path / "w"), file_bytes=700)
    files = list((tmp_path / "w").glob("part-*"))
    assert len(files) == 3
    payload = latin.partition(b"\r\n\r\n")[2]
    back = warc.read_warc(spark, str(tmp_path / "w")).where("record_type <> 'revisit'").collect()
    assert sorted((r.uri, r.record_type, r.payload_bytes, r.payload_digest) for r in back) == [("http://h/0", "response", len(payload), hashlib.sha256(payload).hexdigest()), ("http://h/1", "resource", 1280, hashlib.sha256(raw).hexdigest())]
    blocks = [(f, b) for x in files for f, b in warc.parse_warc(warc.unpacked(x.read_bytes())) if f["warc-type"] != "warcinfo"]
    assert all(hashlib.sha256(b).hexdigest() == f["warc-block-digest"][7:] and len(b) == int(f["content-length"]) for f, b in blocks) and len(blocks) == 3


def test_broken_records_are_counted_and_passed_over(frame):
    good = lambda i: warc.arc_record(1, f"http://h/{i}", "1.1.1.1", "20000101000000", "text/html", b"<p>%d" % i)
    head = warc.arc_header(1, "x", "20000101000000")
    bad = [b"no header at all\nof any kind\n", b"http://h/9 1.1.1.1 20000101000000 text/html 999999\nshort\n", b"http://h/9 1.1.1.1 20000101000000 text/html x\n"]
    arcs = [head + good(1) + b + good(2) for b in bad] + [head + good(1) + good(2)[:-3], b""]
    rows = frame([(bytearray(a),) for a in arcs], "arc binary")
    assert tuple(warc.broken_records(rows).first()) == (7, 4)
    assert sorted(r.uri for r in warc.arc_records(rows).collect()) == ["http://h/1"] * 4 + ["http://h/2"] * 3
    packed = gzip.compress(head + good(1)) + gzip.compress(good(2))
    assert warc.unpacked(packed) == head + good(1) + good(2) and warc.unpacked(packed[:-9]).startswith(head + good(1)) and warc.unpacked(b"plain") == b"plain"
    assert warc.unpacked(gzip.compress(bytes(300_000)) + gzip.compress(b"end")) == bytes(300_000) + b"end"


def test_pages_to_warc_and_back(spark, frame):
    same, small = "<p>" + "é" * 60, "<p>small"
    rows = [(5, "http://a", same, "x"), (2, "http://b c", same, "x"), (9, None, same, "x"), (1, "u", small, "x"), (3, "u", small, "x"), (4, "u", None, "x"), (6, "u", "a\r\n\r\nWARC/1.1\r\n" * 20, "x"), (None, "u", "null id " * 20, "x")]
    found = {r.page_id: r for r in warc.archived_pages(frame(rows, "page_id long, url string, html string, record_type string"), version=2).collect()}
    assert len(found) == 8
    for page, _, html, _ in rows:
        body = (html or "").encode()
        assert (found[page].payload_bytes, found[page].payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        expected = ("revisit", 2) if page in (5, 9) else ("response", None)
        assert (found[page].record_type, found[page].refers_to) == expected
    assert warc.archived_pages(frame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_one_id_keep_every_payload(frame, tmp_path, spark, monkeypatch):
    a, b, c = ("<p>" + x * 150 for x in "abc")
    rows = [(1, "u", a), (2, "u", a), (2, "u", b), (1, "v", c), (3, "u", b), (3, "u", b)]
    folder = str(tmp_path / "w")
    real = warc.write_warc
    monkeypatch.setattr(warc, "write_warc", lambda records, path: (real(records, folder), real(records, path)))
    found = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.archived_pages(frame(rows, "page_id long, url string, html string")).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert found == sorted([(1, sha(a), "response", 0), (2, sha(a), "revisit", 1), (2, sha(b), "response", 0), (1, sha(c), "response", 0), (3, sha(b), "revisit", 2), (3, sha(b), "revisit", 2)])
    bodies = {bytes(block).partition(b"\r\n\r\n")[2] for x in tmp_path.glob("w/*.gz") for f, block in warc.parse_warc(warc.unpacked(x.read_bytes())) if f["warc-type"] == "response"}
    assert bodies == {x.encode() for x in (a, b, c)}


def test_rates_meet_the_targets_and_the_optimum(frame):
    r = random.Random(1)
    rows = [(d, " ".join((["idiot", "moron"] if d % 4 == 0 else ["river", "stone"])[r.randrange(2)] + ("" if r.random() < 0.5 else str(r.randrange(30))) for _ in range(r.randrange(20, 60)))) for d in range(240)]
    docs = frame([(*x, 1.0) for x in rows] + [(500, None, 1.0), (501, "", 1.0)], "doc_id long, text string, posterior double")
    labels = frame([(d, "bad" if d % 4 == 0 else "good") for d in range(0, 240, 2)], "doc_id long, domain string")
    rated, mix = mix_to_targets(docs, labels, {"good": 0.9, "bad": 0.1})
    got = rated.toPandas()
    p = np.array(got.posterior.tolist())
    w = got.n_tokens / got.n_tokens.sum()
    a = (np.array(w * got.rate)[:, None] * p).sum(0)
    assert dict(zip(mix.domains, np.round(a, 2))) == {"good": 0.9, "bad": 0.1}
    # the plain projected gradient without momentum, run for long, ends at the same rates
    s, want, x = (np.array(w)[:, None] * p).sum(0), np.array([0.1 if d == "bad" else 0.9 for d in mix.domains]), np.ones(len(got))
    for _ in range(20_000):
        total = ((np.array(w) * x)[:, None] * p).sum(0)
        x = np.maximum(0, x - (p @ ((total - want) / s) + 1e-3 * (x - 1)) / 1.001)
    assert np.abs(x - got.rate).max() < 0.05
    assert np.allclose(mix.reached, a) and mix.gradient < 1e-3
    again = {x.doc_id: x.rate for x in with_rates(docs.withColumn("rate", F.lit("clash")), mix).collect()}
    assert all(abs(again[d] - v) < 1e-9 for d, v in zip(got.doc_id, got.rate))
    flat, none = mix_to_targets(docs, labels.where("domain = 'good'"), {"good": 1.0})
    assert none.model is None and {x.rate for x in flat.collect()} == {1.0}
    assert mix_to_targets(docs.limit(0), labels, {"good": 1.0})[0].count() == 0


def test_overlapping_posteriors_reach_the_optimum(frame):
    r = random.Random(2)
    rows = [(d, " ".join(r.choice(["idiot", "moron", "river"] if d % 3 == 0 else ["river", "stone", "idiot"]) for _ in range(r.randrange(5, 12)))) for d in range(300)]
    docs = frame(rows, "doc_id long, text string")
    rated, mix = mix_to_targets(docs, frame([(d, "bad" if d % 3 == 0 else "good") for d in range(300)], "doc_id long, domain string"), {"good": 0.8, "bad": 0.2})
    got = rated.toPandas()
    p, w = np.array(got.posterior.tolist()), np.array(got.n_tokens / got.n_tokens.sum())
    s, want, x = (w[:, None] * p).sum(0), np.array([0.2 if d == "bad" else 0.8 for d in mix.domains]), np.ones(len(got))
    for _ in range(50_000):
        pull = (((w * x)[:, None] * p).sum(0) - want) / s
        x = np.maximum(0, x - (p @ pull + 1e-3 * (x - 1)) / 1.001)
    best = ((w * x)[:, None] * p).sum(0)
    assert np.abs(np.array(mix.reached) - best).max() < 0.01


def test_null_and_repeated_ids_in_mixing(frame):
    docs = frame([(None, "river stone"), (1, "river stone"), (1, "river stone"), (2, "idiot moron"), (None, None)], "doc_id long, text string")
    labels = frame([(1, "good"), (2, "bad"), (None, "bad"), (3, None)], "doc_id long, domain string")
    rated, _ = mix_to_targets(docs, labels, {"good": 0.7, "bad": 0.3})
    found = sorted((str(r.doc_id), r.n_tokens, round(r.rate, 9)) for r in rated.collect())
    assert len(found) == 5 and len({x for x in found if x[1] == 2 and x[0] != "2"}) == 2 and len({x[2] for x in found if x[1] == 2 and x[0] != "2"}) == 1
