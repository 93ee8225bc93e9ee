"""Scalar and array functions on literals, against expected values or plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from roundhouse.functions import arrays, cells, scalars


def evaluate(spark, values, kind, expression):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [row[0] for row in df.select(expression(F.col("v"))).collect()]


CELLS = [
    ("A1", (0, 0)), ("D7", (3, 6)), ("A_1", (0, 0)), ("B_4", (1, 3)), (None, (-1, -1)), ("", (-1, -1)), ("Z1", (-1, -1)),
    ("A9", (-1, -1)), ("X_5", (-1, -1)), ("A_", (-1, -1)), ("c3", (2, 2)), (" B2 ", (1, 1)), ("A 07", (0, 6)), ("A+3", (0, 2)),
    ("A-1", (-1, -1)), ("A10", (-1, -1)), ("0", (-1, -1)), ("A0", (-1, -1)), ("1A", (-1, -1)), ("A", (-1, -1)), ("_1", (-1, -1)),
]


def test_tolerant_cells(spark):
    texts = [text for text, _ in CELLS]
    rows = evaluate(spark, texts, "string", cells.cell_row)
    cols = evaluate(spark, texts, "string", cells.cell_col)
    assert list(zip(rows, cols)) == [cell for _, cell in CELLS]


def test_strict_cells(spark):
    texts = ["A1", "A_1", "D7", "a1", "E1", "A8", "A01", " A1", None, ""]
    assert evaluate(spark, texts, "string", cells.is_strict_cell) == [True, True, True] + [False] * 7


def test_cell_format_round_trip_and_mirror(spark):
    df = spark.createDataFrame([(r, c) for r in range(4) for c in range(7)], "r int, c int")
    text = cells.format_cell(F.col("r"), F.col("c"))
    row = df.select("r", "c", cells.cell_row(text).alias("r2"), cells.cell_col(text).alias("c2"))
    assert row.filter("r <> r2 or c <> c2").count() == 0
    both = df.select("r", "c", *[cells.board_cell(F.col("r"), F.col("c"), F.lit(p)).alias(n) for p, n in ((True, "p"), (False, "o"))])
    for r in both.collect():
        assert (r.p, r.o) == ((4 + r.r) * 7 + r.c, (3 - r.r) * 7 + 6 - r.c)


def test_tiers(spark):
    tiers = [None, -1, 0, 1, 2, 3, 4, 5]
    assert evaluate(spark, tiers, "bigint", scalars.clamp_tier) == [1, 1, 1, 1, 2, 3, 4, 4]
    assert evaluate(spark, tiers, "bigint", scalars.tier_multiplier) == [0, 0, 0, 1, 3, 9, 27, 0]


def test_item_rules(spark):
    lists = [["a", None, "", "b", "c", "d"], [None], [], None, ["", "a", "b", "c"]]
    assert evaluate(spark, lists, "array<string>", scalars.compact_then_take) == [["a", "b", "c"], [], [], [], ["a", "b", "c"]]
    assert evaluate(spark, lists, "array<string>", scalars.take_then_compact) == [["a"], [], [], [], ["a", "b"]]


def test_stage_decision_and_names(spark):
    assert evaluate(spark, ["2-1", "12-3", "x-1", "7", "-1", None], "string", scalars.stage_of) == ["2", "12", None, "7", None, None]
    assert evaluate(spark, [0.49, 0.5, 0.51], "double", scalars.decision) == ["defeat", "victory", "victory"]
    assert evaluate(spark, ["Kai's Lane"], "string", scalars.safe_name) == ["Kais_Lane"]
    assert evaluate(spark, ["A/B.TEX", "c.dds"], "string", scalars.icon_path) == ["a/b.png", "c.png"]
    assert evaluate(spark, [0.0, 100.0, -100.0], "double", scalars.sigmoid) == pytest.approx([0.5, 1.0, 0.0])


@pytest.mark.parametrize("values, expected", [([1, 2, 3, 4, 5, 6], [4, 5, 6, 1, 2, 3]), ([1, 2, 3, 4, 5], [3, 4, 5, 1, 2]), ([], [])])
def test_swap_halves(spark, values, expected):
    assert evaluate(spark, [values], "array<int>", arrays.swap_halves) == [expected]


def test_rotate_board_flips_each_channel(spark):
    tensor = list(range(280))
    (turned,) = evaluate(spark, [tensor], "array<int>", lambda t: arrays.rotate_board(t, 5))
    for channel in range(5):
        for row in range(8):
            for col in range(7):
                assert turned[channel * 56 + row * 7 + col] == channel * 56 + (7 - row) * 7 + 6 - col


def test_tally_and_dense_against_python(spark):
    rng = random.Random(1)
    lists = [[rng.randrange(12) for _ in range(rng.randrange(20))] for _ in range(200)]
    dense = evaluate(spark, lists, "array<int>", lambda v: arrays.dense(arrays.tally(v), 12))
    assert dense == [[values.count(n) for n in range(12)] for values in lists]


def test_pad(spark):
    assert evaluate(spark, [[], [3], [1, 2, 3, 4]], "array<int>", lambda v: arrays.pad(v, 3)) == [[0, 0, 0], [3, 0, 0], [1, 2, 3]]


def test_item_categories(spark):
    rows = [
        ("S_Item_EmblemX", None, True, "emblem"),
        ("S_Item_Bow", ["component"], False, "component"),
        ("S_Item_Bilgewater_Gun", [scalars.RADIANT_TAG], False, "bilgewater"),
        ("S_BowRadiant", [], False, "radiant"),
        ("S_Bow", [scalars.RADIANT_TAG], False, "radiant"),
        ("S_Artifact_Bow", None, False, "artifact"),
        ("S_Bow", [scalars.ARTIFACT_TAG], False, "artifact"),
        ("S_Bow", None, False, "normal"),
    ]
    df = spark.createDataFrame(rows, "name string, tags array<string>, emblem boolean, expected string")
    got = df.select("expected", scalars.item_category(F.col("name"), F.col("tags"), F.col("emblem"), "S").alias("got"))
    assert got.filter("expected <> got").count() == 0


def test_trait_classes(spark):
    rows = [(0, 2, "none"), (1, 1, "unique"), (3, 3, "prism"), (2, 3, "gold"), (1, 3, "silver"), (1, 4, "bronze")]
    df = spark.createDataFrame(rows, "level int, levels int, expected string")
    assert df.filter(scalars.trait_class(F.col("level"), F.col("levels")) != F.col("expected")).count() == 0
