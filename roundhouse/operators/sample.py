"""Reproducible sample boards: up to ``per_stage`` per stage, each match used once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roundhouse.dims import Dims
from roundhouse.functions.cells import cell_col, cell_row
from roundhouse.functions.scalars import clamp_tier, compact_then_take, stage_of
from roundhouse.operators.ordering import seeded_shuffle
from roundhouse.operators.rounds import sample_eligible, sample_valid
from roundhouse.session import materialise

PARTS = 64
FEW_ROWS = 100_000  # a sample up to this size is broadcast to find its boards


def first_per_match(rows: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Earliest row of each ``by`` group in shuffle order: a minimum, so it combines on the map side."""
    return rows.groupBy(*by).agg(F.min(F.struct("shuffle_key", F.col(key).alias("key"))).alias("first")).select(
        *by, "first.shuffle_key", F.col("first.key").alias(key)
    )


def top_per_stage(rows: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` rows per stage in shuffle order.

    Each stage is cut in ``PARTS`` hashed parts first, so a stage with most rows is never sorted in one task.
    """
    part = F.pmod(F.xxhash64("shuffle_key"), F.lit(PARTS))
    for by in (("stage", "_part"), ("stage",)):
        order = W.partitionBy(*by).orderBy("shuffle_key")
        rows = rows.withColumn("_part", part).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")
    return rows.drop("_part")


def pick_relaxed(rows: DataFrame, key: str, match: str, per_stage: int) -> DataFrame:
    """First row of each match, then the first ``per_stage`` of each stage. One pass of plain SQL; unlike the exact form, a
    match is tied to the stage of its first row, so a stage can stay short."""
    firsts = rows.groupBy(match).agg(F.min(F.struct("shuffle_key", "stage", F.col(key).alias("key"))).alias("first"))
    return top_per_stage(firsts.select(match, "first.shuffle_key", "first.stage", F.col("first.key").alias(key)), per_stage)


def pick_exact(rows: DataFrame, key: str, match: str, per_stage: int) -> DataFrame:
    """The rows that a walk in shuffle order takes: each one whose stage has room and whose match is unused.

    Found in rounds instead of row by row. Each stage proposes its first ``per_stage`` rows, each match holds its earliest
    proposal, and rows of a match behind the one it holds are out; the stages that lost one propose their next. All agree on
    one order, so the rounds end, when every proposal is held, with what the walk takes. Only a match's first row per stage can
    be taken, and while a stage has room the walk meets at most ``per_stage * stages`` matches in it, so no stage looks further.
    """
    firsts = materialise(first_per_match(rows, ["stage", match], key))  # of all rows with their boards there is one pass
    stages = firsts.agg(F.count_distinct("stage")).first()[0]
    candidates = materialise(top_per_stage(firsts, per_stage * max(stages, 1)))
    place = F.struct("shuffle_key", key)
    proposed = candidates
    while True:
        proposed = materialise(top_per_stage(proposed, per_stage))
        held = proposed.groupBy(F.col(match).alias("_match")).agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_held"))
        if held.filter("_n > 1").isEmpty():
            return proposed.select(match, "shuffle_key", "stage", key)
        same = F.col(match).eqNullSafe(F.col("_match"))
        proposed = candidates.join(materialise(held), same, "left").filter(F.col("_held").isNull() | (place <= F.col("_held"))).select(*candidates.columns)


def shown_side(board: Column) -> Column:
    """One side of a board as the viewer takes it: clamped tier, compacted items, numeric cell."""
    return F.transform(
        board,
        lambda u: F.struct(
            u["unit"].alias("unit"),
            clamp_tier(u["tier"]).alias("tier"),
            compact_then_take(u["item_ids"]).alias("items"),
            cell_row(u["loc"]).alias("row"),
            cell_col(u["loc"]).alias("col"),
        ),
    )


def sample_boards(
    rounds: DataFrame,
    dims: Dims,
    *,
    key: str,
    match: str = "match_uuid",
    per_stage: int = 10,
    min_units: int = 3,
    seed: int = 16,
    exact: bool = True,
    units: Sequence[str] | None = None,
    items: Sequence[str] | None = None,
) -> DataFrame:
    """``stage, outcome, player, opponent`` of the sampled rounds, ordered by stage; ``stage`` is the full round name.

    ``units`` and ``items`` are those that may be shown; by default all of the dimensions.
    """
    valid = sample_valid(sample_eligible(rounds, min_units=min_units), dims, units=units, items=items)
    staged = valid.withColumn("stage", stage_of(F.col("round_name"))).filter("stage is not null")
    shuffled = seeded_shuffle(staged.select(key, match, "stage"), key, seed)
    pick = pick_exact if exact else pick_relaxed
    chosen = materialise(pick(shuffled, key, match, per_stage).select(key, "stage", "shuffle_key"))
    return (
        valid.join(F.broadcast(chosen) if chosen.count() <= FEW_ROWS else chosen, key)
        .orderBy("stage", "shuffle_key")
        .select(
            F.col("round_name").alias("stage"),
            F.col("round_outcome").alias("outcome"),
            shown_side(F.col("board_data.player_board")).alias("player"),
            shown_side(F.col("board_data.opponent_board")).alias("opponent"),
        )
    )
