"""Ranked lexical search: accumulators of short lists as one iterator among long lists.

Every item is a query against all documents. Documents are kept as rows of the query terms they hold (a forward
index), so nothing of a list is shuffled: each task turns its documents into the lists of a shard and
ranks them, term at a time where that is cheap and document at a time where it is not:

* Lists of terms that few documents hold are summed at once, per document. The sums are one iterator more, sorted by
  document and bounded by their largest.
* That iterator and the long lists are read together, document by document in blocks. A block whose bounds
  cannot reach the threshold is skipped whole. In the others, documents come only from the iterators that the rest cannot
  outweigh; a document that they bring is looked up in the remaining lists, from the largest bound to
  the least, as long as it can still reach the threshold.

The threshold starts with the k-th best sum of short lists over all shards, which a first pass finds: no
document under it can be among the k best, in any shard.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curalume.llm.bytes_np import ALNUM, LOWER, row_groups, texts, words
from curalume.llm.decontaminate import _equal_spans, _lowered
from curalume.plans.tables import Scratch, saved

_BLOCK = 2048


def query_terms(items: DataFrame, id: str, text: str) -> DataFrame:
    """(item_id, terms) of each distinct item row with a term: its distinct terms, A-Z lower-cased."""

    def run(batches):
        for batch in batches:
            data, offsets = texts(batch.column(1))
            raw = _lowered(data).tobytes()
            x = words(data, offsets, ALNUM, LOWER)
            term = [raw[s:e].decode() for s, e in zip(x.start.tolist(), x.end.tolist(), strict=True)]
            own = pa.array([sorted(set(term[a:b])) for a, b in zip(x.first[:-1].tolist(), x.first[1:].tolist(), strict=True)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), own], names=["item_id", "terms"])

    rows = items.select(F.col(id).alias("item_id"), F.col(text).cast("string").alias("text")).distinct()
    return rows.mapInArrow(run, f"item_id {rows.schema['item_id'].dataType.simpleString()}, terms array<string>").where(F.size("terms") > 0)


class Vocabulary:
    """The terms of a block of queries, found in texts by hash and told apart byte by byte."""

    def __init__(self, terms: list[str]):
        self.data, offsets = texts(pa.array(terms, pa.string()))
        self.start, self.end, _, hashes = words(self.data, offsets, ALNUM, LOWER)
        self.order = np.argsort(hashes, kind="stable")
        self.hash = hashes[self.order]
        self.most = int(np.unique(hashes, return_counts=True)[1].max())  # terms of one hash: one, but for a collision

    def __len__(self) -> int:
        return len(self.hash)

    def codes(self, data: np.ndarray, x) -> np.ndarray:
        """The term of each word, -1 for words that are none."""
        out = np.full(len(x.hash), -1, np.int64)
        first = np.searchsorted(self.hash, x.hash)
        low = _lowered(data)
        for step in range(self.most):
            i = np.minimum(first + step, len(self) - 1)
            some = np.flatnonzero((out < 0) & (self.hash[i] == x.hash))
            term = self.order[i[some]]
            same = _equal_spans(low, x.start[some], x.end[some], self.data, self.start[term], self.end[term])
            out[some[same]] = term[same]
        return out


def forward_index(docs: DataFrame, vocabulary: Vocabulary, id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: all its terms with repeats, and those of the vocabulary with how often they occur."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        v = shared.value
        for batch in batches:
            data, offsets = texts(batch.column(1))
            for lo, hi in row_groups(offsets):
                part = data[offsets[lo] : offsets[hi]]
                x = words(part, offsets[lo : hi + 1] - offsets[lo], ALNUM, LOWER)
                n = np.diff(x.first)
                code = v.codes(part, x)
                key = np.repeat(np.arange(hi - lo), n)[code >= 0] * len(v) + code[code >= 0]
                key, tf = np.unique(key, return_counts=True)
                at = pa.array(np.searchsorted(key, np.arange(hi - lo + 1) * len(v)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(c.astype(np.int32))) for c in (key % len(v), tf)]
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])
                yield rows.filter(pa.array(n > 0))

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def document_counts(index: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in index.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


class Ranking(NamedTuple):
    """What a task needs to rank its documents: integer weights of terms, the corpus, the queries' terms, and thresholds."""

    weight: np.ndarray
    short: np.ndarray  #: whether a term's list is summed beforehand
    documents: int
    occurrences: int
    queries: list[np.ndarray]
    k: int
    least: np.ndarray  #: a score for each query that its k-th best document has at least; 1 where none is known

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """A document's length measure m."""
        if len(n) and 50 * int(n.max()) * self.documents >= 1 << 63:
            return np.array([50 + 50 * x * self.documents // self.occurrences for x in n.tolist()], np.int64)
        return 50 + 50 * n * self.documents // self.occurrences


class _List(NamedTuple):
    docs: np.ndarray
    scores: np.ndarray
    edges: np.ndarray  #: where each block of documents begins in it
    most: np.ndarray  #: the largest score in each block


class Shard:
    """The lists of some documents, which are numbered by ascending id, null last."""

    def __init__(self, table: pa.Table, ranking: Ranking):
        ids = table.column("doc_id").combine_chunks()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((ids.fill_null(0).to_numpy(), null))
        table = table.take(pa.array(order))
        self.id, self.null = ids.fill_null(0).to_numpy()[order], null[order]
        terms = table.column("terms").combine_chunks()
        doc = np.repeat(np.arange(len(order)), np.diff(terms.offsets.to_numpy()))
        code, tf = terms.flatten().to_numpy(), table.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        m = ranking.lengths(table.column("n").to_numpy())
        score = ranking.weight[code] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        by = np.argsort(code, kind="stable")  # documents ascend already
        self.doc, self.score = doc[by], score[by]
        self.at = np.searchsorted(code[by], np.arange(len(ranking.weight) + 1))
        self.blocks = np.arange(0, len(order) + _BLOCK, _BLOCK)
        self.known: dict[int, _List] = {}

    def _list(self, docs: np.ndarray, scores: np.ndarray) -> _List:
        edges = np.searchsorted(docs, self.blocks)
        most = np.zeros(len(edges) - 1, np.int64)
        full = np.flatnonzero(np.diff(edges))
        if len(full):
            most[full] = np.maximum.reduceat(scores, edges[full])
        return _List(docs, scores, edges, most)

    def of(self, term: int) -> _List:
        if term not in self.known:
            self.known[term] = self._list(self.doc[self.at[term] : self.at[term + 1]], self.score[self.at[term] : self.at[term + 1]])
        return self.known[term]

    def accumulators(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of these terms, ascending, with their summed scores."""
        docs = np.concatenate([self.doc[self.at[t] : self.at[t + 1]] for t in terms.tolist()] or [np.empty(0, np.int64)])
        scores = np.concatenate([self.score[self.at[t] : self.at[t + 1]] for t in terms.tolist()] or [np.empty(0, np.int64)])
        order = np.argsort(docs, kind="stable")
        docs, scores = docs[order], scores[order]
        first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]][: len(docs)])
        return docs[first], np.add.reduceat(scores, first) if len(first) else scores

    def best(self, terms: np.ndarray, short: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of at least this score: all of the k best ones, ties by number, and possibly others."""
        lists = [self._list(*self.accumulators(terms[short[terms]])), *(self.of(t) for t in terms[~short[terms]].tolist())]
        lists = [x for x in lists if len(x.docs)]
        docs = scores = np.empty(0, np.int64)
        if not lists:
            return docs, scores
        bound = np.array([x.most for x in lists])
        reach = bound.sum(0)
        for b in range(len(reach)):
            if reach[b] < least:
                continue
            new, found = self._block(lists, bound[:, b], b, least)
            docs, scores = np.concatenate((docs, new)), np.concatenate((scores, found))
            if len(docs) > k:
                top = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[top], scores[top]
                least = max(least, int(scores[-1]))
        return docs, scores

    def _block(self, lists: list[_List], bound: np.ndarray, b: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rest = np.r_[np.cumsum(bound[order][::-1])[::-1], 0]  # what the iterators from here on can give
        base = self.blocks[b]
        score = np.zeros(_BLOCK, np.int64)
        essential = int((rest[:-1] >= least).sum())
        for i in order[:essential].tolist():
            x = lists[i]
            p, q = x.edges[b], x.edges[b + 1]
            score[x.docs[p:q] - base] += x.scores[p:q]
        docs = np.flatnonzero(score)
        for j in range(essential, len(order)):
            docs = docs[score[docs] + rest[j] >= least]
            if not len(docs):
                break
            x = lists[order[j]]
            p, q = x.edges[b], x.edges[b + 1]
            mine = x.docs[p:q] - base
            at = np.minimum(np.searchsorted(mine, docs), len(mine) - 1)
            met = mine[at] == docs
            score[docs[met]] += x.scores[p:q][at[met]]
        docs = docs[score[docs] >= max(1, least)]
        return docs + base, score[docs]


def _shards(batches, ranking: Ranking, documents: int, postings: int):
    held: list[pa.RecordBatch] = []
    rows = entries = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            held.append(part)
            rows, entries = rows + part.num_rows, entries + len(part.column("terms").flatten())
            if rows >= documents or entries >= postings:
                yield Shard(pa.Table.from_batches(held), ranking)
                held, rows, entries = [], 0, 0
    if held:
        yield Shard(pa.Table.from_batches(held), ranking)


def thresholds(index: DataFrame, ranking: Ranking, documents: int, postings: int) -> np.ndarray:
    """For each query the k-th best sum of its short lists over all documents, 1 where fewer have one."""
    shared = index.sparkSession.sparkContext.broadcast(ranking)

    def run(batches):
        r = shared.value
        best = [np.empty(0, np.int64) for _ in r.queries]
        for shard in _shards(batches, r, documents, postings):
            for i, terms in enumerate(r.queries):
                sums = shard.accumulators(terms[r.short[terms]])[1]
                best[i] = np.sort(np.concatenate((best[i], sums)))[-r.k :]
        query = np.repeat(np.arange(len(best), dtype=np.int32), [len(x) for x in best])
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([np.empty(0, np.int64), *best]))], names=["query", "score"])

    sums = index.mapInArrow(run, "query int, score long")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score")))
    out = np.ones(len(ranking.queries), np.int64)
    for r in sums.withColumn("place", place).where(F.col("place") == ranking.k).collect():
        out[r["query"]] = max(1, r.score)
    return out


def ranked(index: DataFrame, ranking: Ranking, documents: int, postings: int) -> DataFrame:
    """(query, doc_id, score): of each task the k best documents of each query that reach its threshold."""
    shared = index.sparkSession.sparkContext.broadcast(ranking)

    def run(batches):
        r = shared.value
        none = np.empty(0, np.int64)
        best = [(none, none, none) for _ in r.queries]  # scores, ids, whether the id is null
        least = r.least.copy()
        for shard in _shards(batches, r, documents, postings):
            for i, terms in enumerate(r.queries):
                docs, scores = shard.best(terms, r.short, int(least[i]), r.k)
                if not len(docs):
                    continue
                own = [np.concatenate(x) for x in zip(best[i], (scores, shard.id[docs], shard.null[docs].astype(np.int64)), strict=True)]
                top = np.lexsort((own[1], own[2], -own[0]))[: r.k]
                best[i] = tuple(x[top] for x in own)
                if len(top) == r.k:
                    least[i] = max(least[i], int(best[i][0][-1]))
        query = np.repeat(np.arange(len(best), dtype=np.int32), [len(x[0]) for x in best])
        score, id_, null = (np.concatenate([none, *(x[j] for x in best)]) for j in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(id_, mask=null.astype(bool)), pa.array(score)], names=["query", "doc_id", "score"])

    return index.mapInArrow(run, "query int, doc_id long, score long")


def lexical_search(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 50, short: float = 0.02, block_terms: int = 250_000, shard_documents: int = 16_384, shard_postings: int = 4_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 for each item, equal scores by ascending id, null last.

    Terms are runs of ASCII letters and digits and of any non-ASCII characters, A-Z lower-cased. With N documents that
    have a term, L terms in all of them, n in one, df documents that hold a term and tf its occurrences in one,
    the score sums floor(1000 ln((2N + 2) / (2df + 1))) * (10^9 tf div (1000 tf + 20 m)) over the item's distinct
    terms, m = 50 + 50 n N div L. Null and empty texts have no terms: such documents are not ranked or counted, such items
    have no rows. Repeated document rows are documents of their own; equal item rows are one item, and items of one id
    with different texts are ranked each by itself. Other columns are ignored; empty tables give no rows.
    Lists of terms that up to a share `short` of the documents hold are summed beforehand. Items are broadcast in blocks of
    about `block_terms` terms, and documents scanned once for each block; a shard has at most about
    `shard_documents` documents and `shard_postings` entries, whatever the size of a partition.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    scratch = Scratch(spark)
    try:
        queries = scratch.saved(query_terms(items, item_id, item_text), "queries")
        total = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
        n = -(-total // block_terms)
        parts = []
        for block in range(n):
            rows = queries.where(F.pmod(F.xxhash64("terms"), F.lit(n)) == block).collect()
            if not rows:
                continue
            number = {t: i for i, t in enumerate(sorted({t for r in rows for t in r.terms}))}
            vocabulary = Vocabulary([*number])
            index = scratch.saved(forward_index(docs, vocabulary, id, text), "index")
            documents, occurrences = index.agg(F.count("*"), F.sum("n")).first()
            if not documents:
                continue
            df = document_counts(index, len(number))
            weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
            ranking = Ranking(weight, df <= short * documents, documents, occurrences, [np.array([number[t] for t in r.terms]) for r in rows], k, np.ones(len(rows), np.int64))
            ranking = ranking._replace(least=thresholds(index, ranking, shard_documents, shard_postings))
            place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
            top = ranked(index, ranking, shard_documents, shard_postings).withColumn("rank", place).where(F.col("rank") <= k)
            names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"query int, item_id {kind}")
            parts.append(saved(top.join(names, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked"))
        out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
        for p in parts:
            out = p if p is parts[0] else out.unionByName(p)
        return out
    finally:
        scratch.close()
