"""Operators on unit rows, one row per unit on a board: ``key.., team, pos, unit, tier, item_ids, loc``.

``key`` are the columns that identify a round and ``pos`` is anything that sorts like the list order of a board. All
aggregates combine on the map side, so a round that holds a large share of the rows is reduced before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roundhouse.dims import Dims
from roundhouse.functions.arrays import dense, literal_lookup
from roundhouse.functions.cells import bare, board_cell, cell_code, code_col, code_row
from roundhouse.functions.scalars import item_at, tier_multiplier
from roundhouse.schema import CHANNELS, MAX_ITEMS, MAX_UNITS, TEAMS, TIERS


def explode_boards(rounds: DataFrame, key: Sequence[str], *, outer: bool = False) -> DataFrame:
    """Both boards of every round as unit rows in one pass; with ``outer`` an empty board yields one row of nulls."""
    sides = F.array(*[F.struct(F.lit(team).alias("team"), F.col(f"{team}_board").alias("board")) for team in TEAMS])
    each = F.posexplode_outer if outer else F.posexplode
    return (
        rounds.select(*key, F.explode(sides).alias("side"))
        .select(*key, "side.team", each("side.board").alias("pos", "u"))
        .select(*key, "team", "pos", "u.unit", "u.tier", "u.item_ids", "u.loc")
    )


def enrich_units(units: DataFrame, dims: Dims) -> DataFrame:
    """Add ``cost`` and ``traits`` of the unit; unknown units get nulls."""
    frame = dims.unit_frame(units.sparkSession).select("unit", "cost", "traits")
    return units.join(F.broadcast(frame), "unit", "left")


def unit_cost() -> Column:
    """Cost of one enriched unit row at its tier; unknown units count nothing."""
    return F.coalesce(F.col("cost") * tier_multiplier(F.col("tier")), F.lit(0)).cast("bigint")


def team_cost(units: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key, team, total_cost`` of enriched unit rows."""
    return units.groupBy(*key, "team").agg(F.sum(unit_cost()).alias("total_cost"))


def both_sides() -> Column:
    """Aggregate over the unit rows of a round: neither board is empty."""
    return F.bool_or(F.col("team") == TEAMS[0]) & F.bool_or(F.col("team") == TEAMS[1])


def unit_tier_names(dims: Dims) -> list[str]:
    """``team_unit_tier`` in canonical order."""
    return [f"{team}_{unit}_{tier}" for team in TEAMS for unit in dims.units for tier in TIERS]


def unit_tier_pivot(units: DataFrame, key: Sequence[str], dims: Dims) -> DataFrame:
    """One count column per team, known unit and tier, zeros for rounds without such a unit.

    Until it is written a round is the list of its few counts, at most one per column; a pivot would hold a buffer with every
    column for each round of a task. Counts move by round before they are collected, so no task holds both tables at once.
    """
    names = unit_tier_names(dims)
    place = literal_lookup({name: number for number, name in enumerate(names)}, "int")
    feature = F.concat("team", F.lit("_"), "unit", F.lit("_"), F.col("tier").cast("string"))
    counted = units.select(*key, place(feature).alias("_slot")).groupBy(*key, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    entry = F.when(F.col("_slot").isNotNull(), F.struct(F.col("_slot").alias("idx"), F.col("_n").alias("n")))
    lists = counted.repartition(*key).groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
    wide = lists.select(*key, dense(F.col("_entries"), len(names), "bigint").alias("_counts"))
    return wide.select(*key, *[F.get("_counts", F.lit(number)).alias(name) for number, name in enumerate(names)]).fillna(0, names)


def place_units(units: DataFrame, dims: Dims) -> DataFrame:
    """Unit rows with a valid cell and a known unit, plus ``row, col, unit_id``; the rest is dropped."""
    vocab = dims.unit_frame(units.sparkSession).select("unit", "unit_id")
    code = F.col("_code")
    placed = units.withColumn("_code", cell_code(bare(F.col("loc")))).filter(code >= 0)
    placed = placed.withColumn("row", code_row(code)).withColumn("col", code_col(code)).drop("_code")
    return placed.join(F.broadcast(vocab), "unit")


def encode_items(units: DataFrame, dims: Dims) -> DataFrame:
    """Add ``item1..3``: vocabulary ids of the first three slots by position, 0 for an empty, null or unknown slot."""
    ids = literal_lookup(dict(dims.item_vocab), "bigint")
    for slot in range(MAX_ITEMS):
        found = ids(item_at(F.col("item_ids"), slot))
        units = units.withColumn(f"item{slot + 1}", F.coalesce(found, F.lit(0).cast("bigint")))
    return units


def cap_units(placed: DataFrame, key: Sequence[str], max_units: int = MAX_UNITS) -> DataFrame:
    """Keep the first ``max_units`` units of a round, player's first, in list order.

    ``row_number() <= k`` makes Spark keep only ``k`` rows per round in each map task before the shuffle.
    """
    order = W.partitionBy(*key).orderBy((F.col("team") == TEAMS[0]).desc(), "pos")
    return placed.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_units).drop("_n")


def unit_records(units: DataFrame, key: Sequence[str], dims: Dims, max_units: int = MAX_UNITS) -> DataFrame:
    """Placed, encoded and capped units: ``key, team, pos, row, col, cell, unit_id, tier, item1..3``."""
    placed = encode_items(place_units(units, dims), dims)
    is_player = F.col("team") == TEAMS[0]
    return cap_units(placed, key, max_units).select(
        *key,
        "team",
        "pos",
        "row",
        "col",
        board_cell(F.col("row"), F.col("col"), is_player).alias("cell"),
        "unit_id",
        F.coalesce("tier", F.lit(0)).cast("bigint").alias("tier"),
        *[f"item{slot + 1}" for slot in range(MAX_ITEMS)],
    )


def cell_values(records: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per occupied cell; of two units on a cell the later list element wins."""
    last = F.max_by(F.struct(*CHANNELS), "pos").alias("u")
    return records.groupBy(*key, "cell").agg(last).select(*key, "cell", *[f"u.{c}" for c in CHANNELS])
