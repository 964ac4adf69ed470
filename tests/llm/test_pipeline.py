"""The pipeline against plain versions of its stages, on few rows."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from curalume.llm.quality import quality_model, quality_rules  # noqa: E402
from tests.llm.test_dedup import brute as bytes_left  # noqa: E402
from tests.llm.test_ngram_join import brute as near_classes  # noqa: E402
from tests.llm.test_text_ops import decontaminate_brute, junk, prose  # noqa: E402

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, rate string, component_id long, carried string"


def tables(spark, folder, docs):
    spark.createDataFrame([(*x, "en", "s", len(x[1] or ""), "old", 3, "c") for x in docs], SHAPE).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(d, 0 if d % 3 == 0 else 1, 1 if d % 5 == 1 else 0) for d, _ in docs if d is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, "the benchmark item has these words and some more of them here"), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def test_pipeline_matches_its_stages(spark, tmp_path):
    r = random.Random(3)
    docs = [(d, junk(r, 40) if d % 3 == 0 else prose(r, 60) + (" idiot moron" * 5 if d % 5 == 1 else "")) for d in range(60)]
    passage = prose(r, 30)
    docs += [(100 + i, prose(r, 40) + " " + passage + " " + prose(r, 40)) for i in range(6)]
    docs += [(200, docs[1][1]), (201, docs[1][1] + " and more"), (202, prose(r, 30) + " the benchmark item has these words and some more of them here " + prose(r, 30))]
    docs += [(300, None), (301, ""), (302, "short"), (None, prose(r, 50)), (None, docs[2][1])]
    items = tables(spark, str(tmp_path), docs)
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "component_id", "carried", "rate"]

    table = lambda n: spark.read.parquet(f"{tmp_path}/{n}.parquet")
    judged = quality_rules(table("documents"), quality_model(table("documents"), table("labels"))).collect()
    good = {x.doc_id for x in judged if x.doc_id is not None and x.kept}
    nulls = [t for d, t in docs if d is None]
    rows = [(d, t) for d, t in docs if d in good]
    classes = near_classes(rows, 5, 80)
    rows = [(d, t) for d, t in rows if classes[d][1] == d]
    left = bytes_left(rows, 50)
    rows = [(d, left[d][1].decode("utf-8", "ignore")) for d, _ in rows]
    rows = [(d, t) for d, t in rows if not decontaminate_brute([(d, t)], items, 10)[d][1]]
    got = [(x.doc_id, x.text) for x in found.collect()]
    assert sorted(x for x in got if x[0] is not None) == sorted(rows) and all(x.rate > 0 for x in found.collect())
    assert {t for d, t in got if d is None} <= set(nulls)
    assert {200, 201, 202, 302} & {d for d, _ in got} == set() and 100 in {d for d, _ in got}


def test_pipeline_of_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
