"""Positions in an order, over all rows or inside a key, that no task has to hold whole.

Rows are dealt out by ranges of the order, so that equal leading values are split too. A row's place in its range
and a small table of the ranges' sizes give its position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curalume.plans.tables import saved

_PLACE = (1 << 33) - 1


def dealt(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows in ranges of `order`, sorted and written once, with _part, the range, and _at, which ascends with the order."""
    at = F.monotonically_increasing_id()  # the partition's number above 33 bits of the row's place in it
    ordered = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ranked")
    return ordered.withColumn("_part", F.shiftright("_at", 33))


def with_rank(rows: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """rows with their position from 0 in `order`."""
    ordered = dealt(rows, *order)
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    return ordered.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(_PLACE)).drop("_part", "_at", "_before")


def with_rank_within(rows: DataFrame, key: str, *order: Column | str, name: str, best: Column | None = None) -> DataFrame:
    """rows with their position from 1 in `order` among those of one key, null being a key too.

    With `best`, also series_size, how many rows the key has, and is_best: the greatest value of that column, the first among equals.
    A key with many rows lies in many ranges: each is ranked by itself, and the ranges' counts, and the best row
    of each, are carried along the key, a row a range.
    """
    rows = rows.drop(name, *(["series_size", "is_best"] if best is not None else []))
    ordered = dealt(rows, F.asc_nulls_first(key), *order)
    local = ordered.withColumn("_local", F.row_number().over(W.partitionBy("_part", key).orderBy("_at")))
    place = F.struct(*([best.alias("value")] if best is not None else []), (-F.col("_part")).alias("part"), (-F.col("_local")).alias("local"))
    runs = local.groupBy(F.col("_part").alias("_p"), F.col(key).alias("_k")).agg(F.count("*").alias("_n"), F.max(place).alias("_b"))
    along = W.partitionBy("_k")
    carried = runs.select("_p", "_k", (F.sum("_n").over(along.orderBy("_p")) - F.col("_n")).alias("_before"), F.sum("_n").over(along).alias("_size"), F.max("_b").over(along).alias("_best"))
    out = local.join(carried, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k"))).withColumn(name, (F.col("_before") + F.col("_local")).cast("int"))
    if best is not None:
        out = out.withColumn("series_size", F.col("_size")).withColumn("is_best", (F.col("_part") == -F.col("_best.part")) & (F.col("_local") == -F.col("_best.local")))
    return out.select(*rows.columns, name, *(["series_size", "is_best"] if best is not None else []))
