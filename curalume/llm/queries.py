"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalume.llm.decontaminate import decontaminated
from curalume.llm.html_extract import extracted
from curalume.llm.hyperminhash import minhash_classes
from curalume.llm.langid import held_out, identify, language_profiles
from curalume.llm.lexical_search import lexical_search
from curalume.llm.mixing import mix_to_targets
from curalume.llm.ngram_join import ngram_jaccard_classes
from curalume.llm.quality import quality_model, quality_rules
from curalume.llm.sentence_dedup import sentence_dedup
from curalume.llm.suffix_dedup import suffix_dedup
from curalume.llm.token_counts import token_counts
from curalume.llm.warc import archived_pages
from curalume.llm.whitening import whitened_embeddings
from curalume.plans.tables import table

#: Target shares of the tokens of the domains in the labels table.
TARGETS = {"clean": 0.9, "low": 0.05, "toxic": 0.05}


def domains(labels: DataFrame) -> DataFrame:
    """labels as (doc_id, domain): toxic text, else low or clean by quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean").alias("domain"))


def op1_mixing_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated, mix = mix_to_targets(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), TARGETS)
    return rated.select("doc_id", "n_tokens", *(F.col("posterior")[j].alias(f"p_{d}") for j, d in enumerate(mix.domains)), "rate")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_sentences", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_classes(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_profiles(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return identify(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, quality_model(docs, table(spark, sf_dir, "labels")))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


#: Where the ranked vocabulary of op8 lies; files of the public tokenizers are not in this repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op8_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_embeddings(table(spark, sf_dir, "embeddings"))


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_classes(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing_to_targets": op1_mixing_to_targets,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_html_extraction": op7_html_extraction,
    "op8_token_counts": op8_token_counts,
    "op9_warc": op9_warc,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_ranked_lexical_search": op12_ranked_lexical_search,
    "op13_minhash_near_dedup": op13_minhash_near_dedup,
}

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _near_copies_sql(words: int, more: str = "") -> str:
    """Classes of texts whose sets of shingles of so many words have a Jaccard similarity of 0.85 or more."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= {words} THEN list_distinct(list_transform(range(1, len(ws) - {words} + 2), lambda i: array_to_string(ws[i:i + {words} - 1], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id{more}
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.x = d.doc_id"""


ORACLE_SQL = {
    "op3_ngram_jaccard_join": _near_copies_sql(4),
    "op6_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '{_ALNUM}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_ASCII_LOWER}, '{_ALNUM}') AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, unnest(list_transform(range(1, greatest(1, len(ws) - 9) + 1), lambda j: array_to_string(ws[j:j + 9], ' '))) AS g FROM b WHERE len(ws) > 0),
p AS (SELECT doc_id, n, unnest(list_transform(range(1, greatest(0, len(ws) - n + 1) + 1), lambda j: {{'j': j, 'g': array_to_string(ws[j:j + n - 1], ' ')}})) AS x FROM d, (SELECT DISTINCT n FROM i)),
h AS (SELECT p.doc_id, p.x.j AS j, i.n, i.item_id FROM p JOIN i ON i.n = p.n AND i.g = p.x.g),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS k FROM h) GROUP BY doc_id),
a AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(a.n_items, 0) AS n_items, sha256(coalesce(a.s, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND page_id > f THEN f END AS refers_to
FROM d""",
    "op10_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
t AS (SELECT doc_id, s, substr(h, 2 * s + 1, 1098) AS x FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 500)) AS s FROM d)),
y AS (SELECT doc_id, s, x, unnest(range(0, least(500, len(x) // 2))) AS i FROM t),
w AS (SELECT doc_id, s + i AS p, substr(x, 2 * i + 1, 100) AS g FROM y WHERE 2 * i + 100 <= len(x)),
m AS (SELECT g, min(doc_id) AS f FROM w GROUP BY g),
r AS (SELECT w.doc_id, w.p FROM w JOIN m ON m.g = w.g WHERE w.doc_id > m.f),
b AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM r),
c AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (z IS NULL OR z < q - 1) AS n_spans FROM (SELECT doc_id, q, lag(q) OVER (PARTITION BY doc_id ORDER BY q) AS z FROM b) GROUP BY doc_id),
k AS (SELECT a.doc_id, string_agg(a.c, '' ORDER BY a.q) AS h FROM (SELECT doc_id, s + i AS q, substr(x, 2 * i + 1, 2) AS c FROM y) a ANTI JOIN b ON b.doc_id = a.doc_id AND b.q = a.q GROUP BY a.doc_id)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, ''))) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op12_ranked_lexical_search": rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_ASCII_LOWER}, '{_ALNUM}')) AS w FROM documents),
p AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_ASCII_LOWER}, '{_ALNUM}')) AS w FROM benchmark),
f AS (SELECT w, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY w, big_n),
s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score FROM q JOIN p USING (w) JOIN f USING (w) JOIN d USING (doc_id), c GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""",
    "op13_minhash_near_dedup": _near_copies_sql(3, ", d.doc_id <= coalesce(m.y, d.doc_id) AS kept"),
}
