"""Exact order-dependent operators that never put one group, or the whole table, into one task.

A window without ``PARTITION BY`` runs in one task, and a window over a hot key puts all its rows into one task. Here the
rows are range-sorted into slices (a range sort splits a hot key, because the sort tells its rows apart), numbered inside their
slice, and corrected by one small summary per slice, of which there are as many as partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roundhouse.dims import local_frame
from roundhouse.session import materialise, tasks_for

HOT_ROWS = 1_000_000  # a group up to this size is sorted in one task anyway
HOT_SHARE = 0.001  # and so is one with a smaller share of the rows than this
TRACKED, CANDIDATES = 16_384, 4_096  # hashes a sketch of frequent groups tracks, and most of them looked at
SKETCH_PARTS = 64
BINS = 10_000
PLACE_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33 and the row number below


def sorted_slices(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Sort globally and add ``_slice`` (partition) and ``_place`` (row number inside it, from 0).

    The input row number comes last in the sort, so that rows equal in ``order`` can be split over slices too.
    """
    rows = df.withColumn("_row_id", F.monotonically_increasing_id())
    numbered = rows.orderBy(*order, "_row_id").drop("_row_id").withColumn("_id", F.monotonically_increasing_id())
    return materialise(
        numbered.withColumn("_slice", F.shiftright("_id", PLACE_BITS))
        .withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
        .drop("_id")
    )


def _slice_offsets(sliced: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Per slice, the sum of each total over all earlier slices. One row per partition passes through the driver."""
    rows = sliced.groupBy("_slice").agg(*[total.alias(name) for name, total in totals.items()]).collect()
    running = dict.fromkeys(totals, 0)
    offsets = []
    for row in sorted(rows, key=lambda r: r["_slice"]):
        offsets.append({"_slice": row["_slice"], **running})
        running = {name: value + (row[name] or 0) for name, value in running.items()}
    fields = [("_slice", pa.int64())] + [(name, pa.int64()) for name in totals]
    return local_frame(sliced.sparkSession, offsets, fields)


def global_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """Exact 0-based position of every row in the global order."""
    sliced = sorted_slices(df, order)
    offsets = _slice_offsets(sliced, {"_before": F.count(F.lit(1))})
    return (
        sliced.join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.col("_before") + F.col("_place"))
        .drop("_slice", "_place", "_before")
    )


def running_totals(df: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_before``: the sum of a whole-number column over all rows that sort strictly earlier."""
    sliced = sorted_slices(df, order)
    offsets = _slice_offsets(sliced, {f"_off_{c}": F.sum(c) for c in columns})
    earlier = W.partitionBy("_slice").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    out = sliced.join(F.broadcast(offsets), "_slice")
    for c in columns:
        out = out.withColumn(f"{c}_before", F.col(f"_off_{c}") + F.coalesce(F.sum(c).over(earlier), F.lit(0)))
    return out.drop("_slice", "_place", *[f"_off_{c}" for c in columns])


def same_keys(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    """Null-safe equality on all of ``by``."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in by])


def heavy_groups(df: DataFrame, by: Sequence[str], hot_rows: int = HOT_ROWS, hot_share: float = HOT_SHARE) -> DataFrame | None:
    """The groups with more than ``hot_rows`` rows and more than ``hot_share`` of all, or None.

    A sketch of frequent items is filled in every task and merged in two steps, so one row a task moves and no group is counted
    but the candidates. The sketch tracks ``TRACKED`` hashes: it misses no group above ``7 / TRACKED`` of the rows, which is less
    than ``HOT_SHARE``, and never counts a group short, so the exact count of the candidates decides.
    """
    return counted_heavy_groups(df, by, hot_rows, hot_share)[0]


def counted_heavy_groups(df: DataFrame, by: Sequence[str], hot_rows: int = HOT_ROWS, hot_share: float = HOT_SHARE) -> tuple[DataFrame | None, int]:
    """:func:`heavy_groups` and how many rows there are."""
    keys = df.select(F.xxhash64(*by).alias("_key"))
    parts = keys.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_PARTS)).alias("_part")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(_key, {TRACKED})").alias("sketch")
    )
    # grouped, because combining without a group fails in tasks that have no rows
    found = parts.groupBy((F.col("_part") * 0).alias("_all")).agg(
        F.sum("n").alias("n"), F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {TRACKED}), {CANDIDATES})").alias("top")
    ).first()
    if found is None:
        return None, 0
    floor = max(hot_rows, int(hot_share * found["n"]))
    hashes = [entry["item"] for entry in found["top"] if entry["count"] > floor]
    if not hashes:
        return None, found["n"]
    large = df.filter(F.xxhash64(*by).isin(hashes)).groupBy(*by).count().filter(F.col("count") > floor).select(*by)
    large = materialise(large)
    return None if large.isEmpty() else large, found["n"]


def rank_in_group(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, *, hot_rows: int = HOT_ROWS, hot_share: float = HOT_SHARE, told: dict | None = None
) -> DataFrame:
    """Exact 0-based row number inside each group.

    Most groups take a plain window. Those that one task shouldn't sort (:func:`heavy_groups`, fewer than ``1 / hot_share``) are
    ranked from their global order instead. Rows equal in ``order`` are ranked by a hash of their columns, so the way a group
    takes doesn't change its ranks. How many rows there are is left in ``told`` as ``rows``.
    """
    tie = F.xxhash64(*[column for column, kind in df.dtypes if "map<" not in kind])
    window = W.partitionBy(*by).orderBy(*order, tie)
    large, rows = counted_heavy_groups(df, by, hot_rows, hot_share)
    if told is not None:
        told["rows"] = rows
    parts = tasks_for(df.sparkSession, rows)
    if large is None:
        dealt = df.repartition(parts, *by) if parts else df
        return dealt.withColumn(name, (F.row_number().over(window) - 1).cast("bigint"))
    match = same_keys(df, large, by)
    cold = df.join(F.broadcast(large), match, "left_anti")
    cold = cold.repartition(parts, *by) if parts else cold
    cold = cold.withColumn(name, (F.row_number().over(window) - 1).cast("bigint"))
    ranked = global_rank(df.join(F.broadcast(large), match, "left_semi"), [*by, *order, tie], "_rank")
    starts = ranked.groupBy(*by).agg(F.min("_rank").alias("_start"))
    starts = starts.select(*[F.col(c).alias(f"_g_{c}") for c in by], "_start")
    found = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by])
    hot = ranked.join(F.broadcast(starts), found).withColumn(name, F.col("_rank") - F.col("_start"))
    return cold.unionByName(hot.select(*cold.columns))


def order_violations(df: DataFrame, position: Sequence[str], value: str) -> DataFrame:
    """One row with ``violations``: how often ``value`` falls from one position to the next (0 = sorted)."""
    sliced = sorted_slices(df.select(*position, value), position)
    inside = W.partitionBy("_slice").orderBy("_place")
    falls = sliced.select((F.lag(value).over(inside) > F.col(value)).cast("bigint").alias("fall"))
    edges = sliced.groupBy("_slice").agg(F.min_by(value, "_place").alias("first"), F.max_by(value, "_place").alias("last")).collect()
    edges.sort(key=lambda r: r["_slice"])
    between = sum(
        before["last"] is not None and after["first"] is not None and before["last"] > after["first"]
        for before, after in zip(edges, edges[1:])
    )
    return falls.agg((F.coalesce(F.sum("fall"), F.lit(0)) + F.lit(between)).cast("bigint").alias("violations"))


def select_ranks(df: DataFrame, column: str, ranks: Sequence[int]) -> list[tuple[int, int]]:
    """For each 0-based rank, the value of a whole-number column at that rank and how many rows are smaller.

    Exact selection by repeated histograms: each pass counts the rows of at most ``BINS`` bins inside the interval still
    open and only the counts reach the driver. Nothing is sorted or shuffled but those counts.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    state = [{"low": low, "high": high, "below": 0, "rank": rank} for rank in ranks]
    while any(s["low"] < s["high"] for s in state):
        binned = []
        for number, s in enumerate(state):
            s["width"] = max(1, -(-(s["high"] - s["low"] + 1) // BINS))
            if s["low"] < s["high"]:
                inside = F.col(column).between(s["low"], s["high"])
                # an interval over most of the 64-bit range, as hashes have, needs wider arithmetic for its first pass
                kind = "bigint" if s["high"] - s["low"] < 1 << 62 else "decimal(20,0)"
                offset = F.when(inside, F.col(column).cast(kind) - F.lit(s["low"]).cast(kind))
                bin_ = F.call_function("div", offset, F.lit(s["width"]).cast(kind))
                binned.append(F.struct(F.lit(number).alias("number"), bin_.alias("bin")))
        span = (min(s["low"] for s in state), max(s["high"] for s in state))
        counts = (
            df.filter(F.col(column).between(*span))
            .select(F.explode(F.array(*binned)).alias("b"))
            .filter("b.bin is not null")
            .groupBy("b.number", "b.bin")
            .count()
            .collect()
        )
        for number, s in enumerate(state):
            for row in sorted((r for r in counts if r["number"] == number), key=lambda r: r["bin"]):
                if s["below"] + row["count"] > s["rank"]:
                    start = s["low"] + row["bin"] * s["width"]
                    s["low"], s["high"] = start, min(s["high"], start + s["width"] - 1)
                    break
                s["below"] += row["count"]
    return [(s["low"], s["below"]) for s in state]


def seeded_shuffle(df: DataFrame, key: str | Column, seed: int, name: str = "shuffle_key") -> DataFrame:
    """Add a reproducible pseudo-random sort key that depends on the row's key and the seed only."""
    return df.withColumn(name, F.md5(F.concat(_text(key), F.lit(f"|{seed}"))))


def _text(key: str | Column) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("string")
