"""Backward as-of join: each left row gets the latest right row at or before its time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roundhouse.dims import MAX_DIM_ROWS
from roundhouse.functions.arrays import last_at_most
from roundhouse.operators.ordering import sorted_slices


def asof_backward(
    left: DataFrame, right: DataFrame, on: str, right_on: str, *, by: Sequence[str] = (), small: bool = False
) -> DataFrame:
    """Left rows with the columns of the latest right row whose ``right_on <= on`` within ``by``; nulls when there is none.

    Both sides go through one sort. A caller who knows the right side to be a dimension (at most ``MAX_DIM_ROWS`` rows, checked
    when the query runs) says ``small``: then every left row searches a sorted array, and nothing is shuffled; the answer is the
    same. Right rows with a null time or a null in ``by`` match nothing, and left rows with one stay unmatched. Of right rows
    with equal times, the one with the greatest hash counts.
    """
    right = right.dropna(subset=[right_on, *by])
    return _by_search(left, right, on, right_on, by) if small else _by_sort(left, right, on, right_on, by)


def _by_search(left: DataFrame, right: DataFrame, on: str, right_on: str, by: Sequence[str]) -> DataFrame:
    """Binary search inside the row. Without ``by`` the array is a constant of the query, with it one for each key, broadcast."""
    payload = [c for c in right.columns if c not in by]
    entry = F.struct(F.col(right_on).alias("t"), _tie(right).alias("tie"), F.struct(*payload).alias("row"))
    in_order = F.array_sort(F.collect_list(entry), _by_time)
    table = F.struct(F.transform(in_order, lambda e: e["t"]).alias("times"), F.transform(in_order, lambda e: e["row"]).alias("rows"))
    size = right.agg(F.count(F.lit(1)).alias("n")).scalar()
    too_large = F.raise_error(F.lit(f"the right side has more than {MAX_DIM_ROWS} rows; leave out small"))
    if by:
        keys = [F.col(c).alias(f"_by_{c}") for c in by]
        tables = right.groupBy(*keys).agg(table.alias("_table")).withColumn("_table", F.when(size <= MAX_DIM_ROWS, F.col("_table")).otherwise(too_large))
        match = reduce(lambda a, b: a & b, [left[c] == F.col(f"_by_{c}") for c in by])
        joined = left.join(F.broadcast(tables), match, "left")
    else:
        whole = right.agg(F.when(F.count(F.lit(1)) <= MAX_DIM_ROWS, table).otherwise(too_large).alias("t")).scalar()
        joined = left.withColumn("_table", whole)
    hit = F.get(F.col("_table.rows"), last_at_most(F.col("_table.times"), F.col(on)))
    found = joined.withColumn("_hit", hit)
    return found.select(*left.columns, *[F.col(f"_hit.{c}").alias(c) for c in payload])


def _by_time(a: Column, b: Column) -> Column:
    """Comparison of entries by time, then tie; their rows may hold what can't be compared."""
    return (
        F.when(a["t"] < b["t"], -1).when(a["t"] > b["t"], 1).when(a["tie"] < b["tie"], -1).when(a["tie"] > b["tie"], 1).otherwise(0)
    )


def _tie(right: DataFrame) -> Column:
    """A hash of the row's columns; maps can't be hashed."""
    return F.xxhash64(*[name for name, kind in right.dtypes if "map<" not in kind])


def _by_sort(left: DataFrame, right: DataFrame, on: str, right_on: str, by: Sequence[str]) -> DataFrame:
    """Sort both sides together, carry the last right row forward inside a slice, then across slices.

    Only groups cut by a slice edge need a carry from earlier slices: at most two groups per slice, hence a broadcast table
    of at most two rows per partition.
    """
    payload = [c for c in right.columns if c not in by]
    kept = [c for c in left.columns if c not in by]
    usable = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (on, *by)])
    unmatched = left.filter(~usable).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in payload])
    left = left.filter(usable)
    one = right.select(
        *by, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), _tie(right).alias("_tie"), F.lit(None).alias("_row"), F.struct(*payload).alias("_right")
    )
    two = left.select(
        *by, F.col(on).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_tie"), F.struct(*kept).alias("_row"), F.lit(None).alias("_right")
    )
    sliced = sorted_slices(one.unionByName(two), [*by, "_t", "_side", "_tie"])

    inside = W.partitionBy("_slice", *by).orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    filled = sliced.withColumn("_found", F.last("_right", ignorenulls=True).over(inside)).filter("_side = 1")

    group = F.struct(F.lit(0).alias("_all"), *by)
    edges = sliced.groupBy("_slice").agg(
        F.struct(F.min_by(group, "_place").alias("first"), F.max_by(group, "_place").alias("last")).alias("edge")
    )
    edge_groups = edges.select("_slice", F.explode(F.array_distinct(F.array("edge.first", "edge.last"))).alias("_group"))
    lasts = (
        sliced.withColumn("_group", group)
        .join(F.broadcast(edge_groups), ["_slice", "_group"])
        .groupBy("_slice", "_group")
        .agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col("_place"))).alias("_last"))
    )
    earlier = W.partitionBy("_group").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carry = lasts.select("_slice", "_group", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    carried = filled.withColumn("_group", group).join(F.broadcast(carry), ["_slice", "_group"], "left")
    return carried.select(
        *by, *[F.col(f"_row.{c}") for c in kept], F.coalesce("_found", "_carry").alias("_hit")
    ).select(*left.columns, *[F.col(f"_hit.{c}").alias(c) for c in payload]).unionAll(unmatched)
