"""Tables that a stream's batches write and read again: all ids seen, and counters so far.

A batch writes a folder of its own number, which a retry writes anew, and reads those of other batches; so what a batch
that failed half-way has left does no harm. Every so many batches the folders are put together in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curalume.plans.tables import complete, delete

#: Beyond so many slots a batch's ids are not looked up by slot.
_SLOTS = 1000


def _numbered(spark: SparkSession, folder: str) -> dict[int, str]:
    """The complete tables of a folder by the number in their names."""
    return {int(name.rpartition("=")[2]): path for name, path in complete(spark, folder).items()}


class Ledger:
    """The ids that a stream has passed on, by slot of their value, so that a batch of neighbouring ids reads few files.

    Ids ascend with time in most feeds; where they don't, the answers are the same and more is read.
    """

    def __init__(self, spark: SparkSession, path: str, id: str = "message_id", slot: int = 1 << 22, every: int = 32):
        self.spark, self.path, self.id, self.slot, self.every = spark, path, id, slot, every
        self.schema = T.StructType([T.StructField(id, T.LongType()), T.StructField("slot", T.LongType())])

    def _slot(self):
        return F.floor(F.col(self.id) / self.slot).cast("long")

    def _read(self, paths: list[str]) -> DataFrame:
        out = self.spark.createDataFrame([], self.schema)
        for p in paths:
            out = out.unionByName(self.spark.read.schema(self.schema).parquet(p))
        return out

    def _tables(self) -> tuple[dict[int, str], dict[int, str]]:
        """Tables of many batches by their last one, and those of single batches that come behind."""
        merged, single = (_numbered(self.spark, f"{self.path}/{k}") for k in ("merged", "batch"))
        return merged, {n: p for n, p in single.items() if n > max(merged, default=-1)}

    def unseen(self, rows: DataFrame, number: int) -> DataFrame:
        """The rows whose id no other batch has passed on, one for each id. Null ids are passed on all."""
        merged, single = self._tables()
        known = rows.where(F.col(self.id).isNotNull()).dropDuplicates([self.id]).withColumn("slot", self._slot())
        slots = [r.slot for r in known.select("slot").distinct().limit(_SLOTS + 1).collect()]
        seen = self._read([*([merged[max(merged)]] if merged else []), *(p for n, p in single.items() if n != number)])
        if len(slots) <= _SLOTS:
            seen = seen.where(F.col("slot").isin(slots))
        new = known.join(seen, ["slot", self.id], "left_anti").select(*rows.columns)
        return new.unionByName(rows.where(F.col(self.id).isNull()))

    def add(self, rows: DataFrame, number: int) -> None:
        """Enter the ids that a batch passes on."""
        ids = rows.where(F.col(self.id).isNotNull()).select(self.id, self._slot().alias("slot"))
        options = {f"parquet.bloom.filter.enabled#{self.id}": "true"}
        ids.repartition("slot").write.mode("overwrite").options(**options).partitionBy("slot").parquet(f"{self.path}/batch/n={number}")
        merged, single = self._tables()
        if len(single) > self.every and number > max(merged, default=-1):
            upto = max(n for n in single if n < number)  # the batch itself can be run again
            kept = {n: p for n, p in single.items() if n <= upto}
            every = self._read([*([merged[max(merged)]] if merged else []), *kept.values()]).distinct()
            every.repartition("slot").sortWithinPartitions("slot", self.id).write.mode("overwrite").options(**options).partitionBy("slot").parquet(f"{self.path}/merged/n={upto}")
            for old in [*merged.values(), *kept.values()]:
                delete(self.spark, old)


class Counters:
    """Sums by key so far: each batch writes what it adds; every so many batches are put together, so reading them costs no more as they grow in number."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, every: int = 32):
        self.spark, self.path, self.key, self.every = spark, path, key, every
        self.schema = T._parse_datatype_string(schema)

    def _tables(self) -> tuple[dict[int, str], dict[int, str]]:
        merged, single = (_numbered(self.spark, f"{self.path}/{k}") for k in ("merged", "batch"))
        return merged, {n: p for n, p in single.items() if n > max(merged, default=-1)}

    def _sums(self, paths: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame([], self.schema)
        if paths:
            rows = self.spark.read.schema(self.schema).parquet(*paths)
        return rows.groupBy(self.key).agg(*(F.sum(c).alias(c) for c in self.schema.names if c != self.key))

    def add(self, sums: DataFrame, number: int) -> None:
        """Enter what a batch adds. A batch that was put together with others before is not counted again."""
        merged, single = self._tables()
        if number <= max(merged, default=-1):
            return
        sums.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/batch/n={number}")
        before = {n: p for n, p in single.items() if n < number}  # the batch itself can be run again
        if len(before) >= self.every:
            upto = max(before)
            self._sums([*([merged[max(merged)]] if merged else []), *before.values()]).write.mode("overwrite").parquet(f"{self.path}/merged/n={upto}")
            for old in [*merged.values(), *before.values()]:
                delete(self.spark, old)

    def totals(self) -> DataFrame:
        """The sums of all batches, from one merged table and the batches behind it."""
        merged, single = self._tables()
        return self._sums([*([merged[max(merged)]] if merged else []), *single.values()])
