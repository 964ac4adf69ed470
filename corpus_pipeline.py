"""From raw documents to a weighted training corpus, in five stages over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalume.llm.decontaminate import clean_documents
from curalume.llm.mixing import mix_to_targets, with_rates
from curalume.llm.ngram_join import ngram_jaccard_classes
from curalume.llm.quality import good_documents, quality_model
from curalume.llm.queries import domains
from curalume.llm.suffix_dedup import suffix_dedup
from curalume.plans.tables import Scratch, saved, table


#: Target shares of the tokens; documents of low quality have gone before.
TARGETS = {"clean": 0.95, "toxic": 0.05}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the classifier reject go."""
    return good_documents(docs, quality_model(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (5-word shingles, Jaccard similarity 0.8 or more) the document of the least id stays."""
    classes = ngram_jaccard_classes(docs, n=5, percent=80)
    return docs.join(classes.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document of a smaller id has are cut out; bytes of a cut character go with it."""
    rest = [c for c in docs.columns if c != "text"]
    found = suffix_dedup(docs, carry=tuple(rest))
    return found.select(*(F.col("carried")[c].alias(c) if c in rest else F.col("kept_text").alias(c) for c in docs.columns))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the rate at which it should be drawn, in place of a column rate that it may have; documents of rate 0 go."""
    _, mix = mix_to_targets(docs, domains(table(spark, sf_dir, "labels")).where("domain <> 'low'"), TARGETS)
    return with_rates(docs, mix).where("rate > 0")


#: Order and operators are fixed; each stage is written and read again.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_free),
    ("mixing to target weights", mixing),
]

#: The classifiers and the iterative stages have no SQL form; tests compare with brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written and read again; what came before is removed then."""
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        kept = Scratch(spark)
        save = saved if i == len(STAGES) - 1 else kept.saved
        docs = save(stage(spark, docs, sf_dir), name.split()[0])
        if last:
            last.close()
        last = kept
    last.close()
    return docs
