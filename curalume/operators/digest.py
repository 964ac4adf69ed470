"""Announcement digests: texts in pieces of bounded size, a summary of each piece, and one of the summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalume.plans.tables import saved


class TooLong(Exception):
    """Raised by a summary function for a text that it cannot take; the text is then halved."""


def pieces(text: str, size: int) -> Iterator[str]:
    """A text of at most `size` code points whole; else its blocks between --- lines, each cut at the last line end in reach, or at `size`."""
    if len(text) <= size:
        yield text
        return
    for block in text.split("\n---\n"):
        block = block.strip()
        while len(block) > size:
            at = block.rfind("\n", 0, size)
            at = at if at > 0 else size
            yield block[:at]
            block = block[at:].strip()
        if block:
            yield block


def chunk_text(docs: DataFrame, size: int = 5500, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, part, parts, chunk): the pieces of each text, from part 1; a blank or null text has none."""

    def run(batches):
        for batch in batches:
            ids, part, parts, chunk = [], [], [], []
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                found = [*pieces(t.as_py(), size)] if (t.as_py() or "").strip() else []
                ids += [d.as_py()] * len(found)
                part += range(1, len(found) + 1)
                parts += [len(found)] * len(found)
                chunk += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(part, pa.int32()), pa.array(parts, pa.int32()), pa.array(chunk, pa.string())], names=[id, "part", "parts", "chunk"])

    return docs.select(id, text).mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, part int, parts int, chunk string")


def first_lines(text: str) -> str:
    """The default summary: the first line of each entry."""
    return "\n".join(b.strip().split("\n")[0] for b in text.split("\n---\n") if b.strip())


def halved(fn: Callable[[str], str], text: str) -> str:
    """fn's summary; where the text is too long for it, that of its halves' summaries."""
    try:
        return fn(text)
    except TooLong:
        if len(text) < 2:
            raise
        cut = text.rfind("\n", 0, len(text) // 2)
        cut = cut if cut > 0 else len(text) // 2
        return halved(fn, halved(fn, text[:cut]) + "\n" + halved(fn, text[cut:]))


def _mapped(rows: DataFrame, fn: Callable[[str], str], source: str, name: str) -> DataFrame:
    at = rows.columns.index(source)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([halved(fn, x.as_py()) for x in batch.column(at)], pa.string())], names=[*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, `{name}` string")


def summarise_chunks(chunks: DataFrame, fn: Callable[[str], str] = first_lines) -> DataFrame:
    """chunks with the summary of each; pieces of a longer text are told which part they are."""
    told = F.when(F.col("parts") > 1, F.concat(F.lit("part "), F.col("part"), F.lit(" of "), F.col("parts"), F.lit("\n---\n"), F.col("chunk"))).otherwise(F.col("chunk"))
    return _mapped(chunks.withColumn("_told", told), fn, "_told", "summary").drop("_told")


def merge_summaries(summaries: DataFrame, fn: Callable[[str], str] = first_lines, id: str = "doc_id", fan: int = 64) -> DataFrame:
    """(id, summary): the one summary of a text, or fn's of its parts under headings.

    `fan` consecutive parts at most are merged at a time. A text of more is merged in rounds: a round's summaries are
    the parts of the next one. So no row holds more than `fan` summaries, however many parts a text has.
    """
    rows = saved(summaries.select(id, "part", "parts", "summary"), "summaries")
    most = rows.agg(F.max("parts")).first()[0] or 0
    while most > 1:
        group = F.floor((F.col("part") - 1) / fan).cast("int")
        joined = rows.where("parts > 1").groupBy(id, group.alias("g")).agg(F.sort_array(F.collect_list(F.struct("part", "summary"))).alias("s"), F.max("parts").alias("parts"))
        text = F.array_join(F.transform("s", lambda x: F.concat(F.lit("### Part "), x["part"], F.lit("\n"), x["summary"])), "\n---\n")
        merged = _mapped(joined.select(id, (F.col("g") + 1).alias("part"), F.ceil(F.col("parts") / fan).cast("int").alias("parts"), text.alias("_text")), fn, "_text", "summary").drop("_text")
        rows = rows.where("parts <= 1").unionByName(merged)
        most = -(-most // fan)
        if most > 1:
            rows = saved(rows, "summaries")
    return rows.select(id, F.rtrim("summary").alias("summary"))


def summarise(docs: DataFrame, fn: Callable[[str], str] = first_lines, size: int = 5500, id: str = "doc_id", text: str = "text") -> DataFrame:
    return merge_summaries(summarise_chunks(chunk_text(docs, size, id, text), fn), fn, id)
