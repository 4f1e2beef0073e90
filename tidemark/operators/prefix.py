"""Running totals over keys of any size: a prefix scan in slices.

Rows are put in order of key and place and cut into slices of about SLICE rows, so a key with many rows has many slices and keys
with few share one. Each slice adds up its own; a key that goes over a slice's end takes along what its earlier slices came
to, one row a slice. So no task holds more than a slice, even if all rows have one key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.storage import stored

SLICE = 1 << 18
COMBINE = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b), "max": (F.max, lambda a, b: F.greatest(a, b))}


def sliced(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """rows, stored, with `_slice`: consecutive ranges of the columns' values. Rows that are equal in all of them share a slice."""
    return stored(rows.repartitionByRange(n, *columns).withColumn("_slice", F.spark_partition_id()))


def running(rows: DataFrame, by: list[str], order: list[str], totals: dict[str, tuple[str, Column]], slice_rows: int | None = None) -> DataFrame:
    """rows with, for each name of `totals`, the running "sum" or "max" of a column over the rows of the same key up to this one; a sum
    counts null as 0. `order` tells a key's rows apart: of rows equal in it, each may come first."""
    for name, (_, value) in totals.items():
        rows = rows.withColumn(name, value)
    rows = stored(rows)
    n = -(-rows.count() // (slice_rows or SLICE))
    along = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    if n <= 1:
        return rows.withColumns({name: COMBINE[kind][0](F.coalesce(name, F.lit(0)) if kind == "sum" else F.col(name)).over(along) for name, (kind, _) in totals.items()})
    dealt = sliced(rows, [*by, *order], n)
    own = dealt.groupBy("_slice", *by).agg(*(COMBINE[kind][0](name).alias(f"_{name}") for name, (kind, _) in totals.items()), F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    earlier = own.select("_slice", *by, *(COMBINE[kind][0](f"_{name}").over(before).alias(f"_{name}") for name, (kind, _) in totals.items()), F.count(F.lit(1)).over(before).alias("_before"))
    earlier = earlier.where("_before > 0").drop("_before").alias("e")  # keys that go on from another slice: a slice has one at most
    same = reduce(lambda a, b: a & b, (F.col(f"d.{c}").eqNullSafe(F.col(f"e.{c}")) for c in by), F.col("d._slice") == F.col("e._slice"))
    inside = W.partitionBy("_slice", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    part = dealt.withColumns({name: COMBINE[kind][0](F.coalesce(name, F.lit(0)) if kind == "sum" else F.col(name)).over(inside) for name, (kind, _) in totals.items()})
    joined = part.alias("d").join(earlier, same, "left")
    return joined.select(*(F.col(f"d.{c}") for c in rows.columns if c not in totals), *(COMBINE[kind][1](F.col(f"e._{name}"), F.col(f"d.{name}")).alias(name) for name, (kind, _) in totals.items()))


def following(rows: DataFrame, order: list[str], column: str, name: str, slice_rows: int | None = None) -> DataFrame:
    """rows with the column's value in the next row of all, null for the last one."""
    rows = stored(rows)
    n = -(-rows.count() // (slice_rows or SLICE))
    if n <= 1:
        return rows.withColumn(name, F.lead(column).over(W.orderBy(*order)))
    dealt = sliced(rows, order, n)
    heads = dealt.groupBy("_slice").agg(F.min_by(F.struct(column), F.struct(*order)).alias("_head"))  # one row a slice
    heads = heads.select("_slice", F.lead("_head").over(W.orderBy("_slice")).alias("_head"))
    inside = W.partitionBy("_slice").orderBy(*order)
    part = dealt.withColumn("_next", F.lead(F.struct(column)).over(inside)).join(heads, "_slice")
    return part.select(*rows.columns, F.coalesce("_next", "_head")[column].alias(name))
