"""Operators on rounds: filters, labels, keys and instances."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundhouse.dims import Dims
from roundhouse.functions.arrays import literal_array
from roundhouse.functions.cells import is_strict_cell
from roundhouse.functions.scalars import compact_then_take
from roundhouse.operators.ordering import HOT_ROWS, rank_in_group
from roundhouse.schema import TEAMS

GROUP = ("match_uuid", "player_uuid", "round_name")


def countable_round(exclude_type: str = "PVE", exclude_prefix: str = "1-") -> Column:
    """The part of the usable-round rule that does not look at the boards; a null operand drops the row."""
    return (
        (F.col("round_type") != exclude_type)
        & ~F.col("round_name").startswith(exclude_prefix)
        & F.col("round_outcome").isNotNull()
    )


def usable_rounds(
    rounds: DataFrame, *, board: str = "board_data", exclude_type: str = "PVE", exclude_prefix: str = "1-"
) -> DataFrame:
    """Rounds with an outcome and two non-empty boards, without the excluded type and name prefix.

    Every field of the board struct must be a non-empty list, so added board fields are checked as well.
    """
    sides = [F.col(f"{board}.{field}") for field in rounds.schema[board].dataType.fieldNames()]
    filled = reduce(lambda a, b: a & b, [side.isNotNull() & (F.size(side) > 0) for side in sides])
    return rounds.filter(countable_round(exclude_type, exclude_prefix) & filled)


def label(outcome: str | Column = "round_outcome", win: str = "victory") -> Column:
    """1 for a win, 0 for any other outcome, null for none."""
    outcome = F.col(outcome) if isinstance(outcome, str) else outcome
    return (outcome == win).cast("tinyint")


def labelled_rounds(rounds: DataFrame, *, board: str = "board_data") -> DataFrame:
    """Add the label as ``outcome`` and unnest the board struct into its columns."""
    kept = [c for c in rounds.columns if c not in (board, "round_outcome")]
    return rounds.select(*kept, label().alias("outcome"), f"{board}.*")


def with_round_instance(
    rounds: DataFrame,
    *,
    by: Sequence[str] = GROUP,
    order: Sequence[str] = ("timestamp",),
    name: str = "round_instance",
    hot_rows: int = HOT_ROWS,
    told: dict | None = None,
) -> DataFrame:
    """Number the rounds that share match, player and round name, from 0 in time order, before any filter."""
    return rank_in_group(rounds, by, order, name, hot_rows=hot_rows, told=told)


def round_key(*, include_player: bool = True) -> Column:
    """Text key of a round; without the player it is the form that lets tracked players of one match collide."""
    parts = [F.col("match_uuid"), *([F.col("player_uuid")] if include_player else []), F.col("round_name")]
    pieces: list[Column] = []
    for part in (*parts, F.col("round_instance")):
        pieces += [part.cast("string"), F.lit("_")]
    return F.concat(*pieces[:-1])


def sample_eligible(
    rounds: DataFrame, *, board: str = "board_data", round_type: str = "PVP", outcomes: Sequence[str] = ("victory", "defeat"), min_units: int = 3
) -> DataFrame:
    """Rounds that may be shown as samples: exact type, decided outcome, enough units on each side."""
    big_enough = [F.size(f"{board}.{team}_board") >= min_units for team in TEAMS]
    return rounds.filter((F.col("round_type") == round_type) & F.col("round_outcome").isin(*outcomes) & big_enough[0] & big_enough[1])


def clean_board(board: Column, units: Sequence[str], items: Sequence[str]) -> Column:
    """True when every unit is placed on a strict cell and the unit and its first three items are in the catalog."""
    known_units, known_items = literal_array(units, "string"), literal_array(items, "string")
    return F.forall(
        board,
        lambda u: is_strict_cell(u["loc"])
        & F.coalesce(F.array_contains(known_units, u["unit"]), F.lit(False))
        & F.forall(compact_then_take(u["item_ids"]), lambda item: F.array_contains(known_items, item)),
    )


def sample_valid(
    rounds: DataFrame, dims: Dims, *, units: Sequence[str] | None = None, items: Sequence[str] | None = None, board: str = "board_data"
) -> DataFrame:
    """Drop a round as a whole when any unit or item of it is unknown or unplaced."""
    names, items = list(units if units is not None else dims.units), list(items if items is not None else dims.items)
    return rounds.filter(
        clean_board(F.col(f"{board}.player_board"), names, items) & clean_board(F.col(f"{board}.opponent_board"), names, items)
    )
