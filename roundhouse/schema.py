"""Declared schemas of the nested round tables and the layout constants of a board."""

from __future__ import annotations

from pyspark.sql import types as T

ROWS = 4
COLS = 7
CELLS = 2 * ROWS * COLS
CHANNELS = ("unit_id", "tier", "item1", "item2", "item3")
MAX_UNITS = 24
MAX_ITEMS = 3
MAX_TRAITS = 15
TIERS = (1, 2, 3, 4)
TEAMS = ("player", "opponent")

UNIT = T.StructType(
    [
        T.StructField("unit", T.StringType()),
        T.StructField("tier", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("loc", T.StringType()),
    ]
)

BOARD_DATA = T.StructType([T.StructField(f"{team}_board", T.ArrayType(UNIT)) for team in TEAMS])

ROUNDS = T.StructType(
    [
        T.StructField("match_uuid", T.StringType()),
        T.StructField("player_uuid", T.StringType()),
        T.StructField("round_name", T.StringType()),
        T.StructField("round_type", T.StringType()),
        T.StructField("round_outcome", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("board_data", BOARD_DATA),
    ]
)

# A board as a caller of the scoring job supplies it: cells as numbers in the side's own frame.
PLACED_UNIT = T.StructType(
    [
        T.StructField("unit", T.StringType()),
        T.StructField("tier", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("row", T.LongType()),
        T.StructField("col", T.LongType()),
    ]
)

REQUESTS = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("player", T.ArrayType(PLACED_UNIT)),
        T.StructField("opponent", T.ArrayType(PLACED_UNIT)),
    ]
)
