"""Boards: records, tensor, wide features and whole extraction."""

from pyspark.sql import functions as F

from round_rows import raw_round, unit
from roundhouse import BoardEncoder
from roundhouse.operators import assemble, rounds, units
from roundhouse.plans import extract
from roundhouse.schema import ROUNDS

KEY = ["round_idx"]


def boards(spark, *rows):
    return spark.createDataFrame([raw_round(p, o, name=f"2-{n}") for n, (p, o) in enumerate(rows, 1)], ROUNDS)


def sides(df):
    return df.select("round_name", "board_data.*")


P, O = "player_board", "opponent_board"


def test_records_skip_bad_cells_and_unknown_units(spark, dims):
    player = [unit("U1", items=["Item1"], loc="A1"), unit("U2", loc="Z9"), unit("Ghost", loc="A2"), unit("U3", loc=None)]
    df = sides(boards(spark, (player, [unit("U2", tier=None, items=[None, "Ghost", "Item3", "Item1"], loc="D7")])))
    (records,) = df.select(BoardEncoder(dims).unit_records(F.col(P), F.col(O))).first()
    assert [(r.row, r.col, r.unit_id, r.tier, r.item1, r.item2, r.item3, r.is_player) for r in records] == [
        (0, 0, 1, 1, 1, 0, 0, 1),
        (3, 6, 2, 0, 0, 0, 3, 0),
    ]


def test_tensor_places_both_sides(spark, dims):
    df = sides(boards(spark, ([unit("U1", loc="A1")], [unit("U2", loc="A1")])))
    (tensor,) = df.select(BoardEncoder(dims).board_tensor(F.col(P), F.col(O))).first()
    assert len(tensor) == 280
    assert {i: v for i, v in enumerate(tensor) if v} == {4 * 7: 1, 3 * 7 + 6: 2, 56 + 4 * 7: 1, 56 + 3 * 7 + 6: 1}


def test_cap_counts_valid_units_and_last_one_wins(spark, dims):
    player = [unit("Ghost", loc="A1")] * 3 + [unit("U1", tier=1, loc="A1")] * 23 + [unit("U2", tier=2, loc="A1")]
    df = sides(boards(spark, (player, [unit("U3", loc="B1")])))
    encoder = BoardEncoder(dims)
    row = df.select(encoder.unit_records(F.col(P), F.col(O)).alias("r"), encoder.board_tensor(F.col(P), F.col(O)).alias("t")).first()
    assert len(row.r) == 24 and row.r[-1].unit_id == 2
    assert row.t[28] == 2 and row.t[56 + 28] == 2 and sum(v != 0 for v in row.t) == 2


def test_unit_rows_and_row_expressions_agree(spark, dims):
    import random

    rng = random.Random(5)

    def board(size):
        names = ["U1", "U2", "U3", "U4", "U5", "Ghost"]
        items = ["Item1", "Item2", "EmblemA", "EmblemB", "", None, "Ghost"]
        return [
            unit(rng.choice(names), rng.choice([None, 0, 1, 2, 3, 4, 5]), rng.choices(items, k=rng.randrange(5)), rng.choice("ABCDEad") + rng.choice(["", "_"]) + str(rng.randrange(1, 9)))
            for _ in range(size)
        ]

    df = sides(boards(spark, *[(board(rng.randrange(1, 30)), board(rng.randrange(1, 30))) for _ in range(60)])).withColumnRenamed("round_name", "round_idx")
    encoder = BoardEncoder(dims)
    inside = df.select("round_idx", encoder.wide_vector(F.col(P), F.col(O), "bigint").alias("wide"), encoder.board_tensor(F.col(P), F.col(O)).alias("tensor"))
    exploded = units.explode_boards(df, KEY).repartition(7)
    wide = assemble.wide_vectors(units.enrich_units(exploded, dims), KEY, dims, "wide")
    tensor = assemble.board_tensors(exploded, KEY, dims)
    expected = {r.round_idx: (r.wide, r.tensor) for r in inside.collect()}
    outside = {r.round_idx: r.wide for r in wide.collect()}
    tensors = {r.round_idx: r.tensor for r in tensor.collect()}
    assert {k: v[0] for k, v in expected.items()} == outside
    flags = assemble.onehot_vectors(units.enrich_units(exploded, dims), KEY, dims).collect()
    onehot = df.select("round_idx", encoder.onehot_pair(F.col(P), F.col(O)).alias("onehot"))
    assert {r.round_idx: r.onehot for r in flags} == {r.round_idx: r.onehot for r in onehot.collect()}
    assert {k: v[1] for k, v in expected.items() if any(v[1])} == {k: v for k, v in tensors.items() if any(v)}


def test_usable_rounds_rules(spark):
    one = [unit("U1")]
    rows = [
        raw_round(one, one, match="ok"),
        raw_round(one, one, match="pve", kind="PVE"),
        raw_round(one, one, match="type", kind=None),
        raw_round(one, one, match="stage one", name="1-1"),
        raw_round(one, one, match="underscore", name="1_1"),
        raw_round(one, one, match="outcome", outcome=None),
        raw_round([], one, match="empty"),
        raw_round(one, None, match="missing"),
        ("none", "p", "2-1", "PvP", "victory", 1, None),
    ]
    df = rounds.usable_rounds(spark.createDataFrame(rows, ROUNDS))
    assert sorted(r.match_uuid for r in df.collect()) == ["ok", "underscore"]


def test_labels(spark):
    one = [unit("U1")]
    rows = [raw_round(one, one, match=o or "none", outcome=o) for o in ("victory", "defeat", "draw", None)]
    got = {r.match_uuid: r.outcome for r in rounds.labelled_rounds(spark.createDataFrame(rows, ROUNDS)).collect()}
    assert got == {"victory": 1, "defeat": 0, "draw": 0, "none": None}


def test_extraction_end_to_end(spark, dims, tmp_path):
    one, two = [unit("U1", loc="A1"), unit("U2", loc="B2")], [unit("U3", loc="C3")]
    rows = [raw_round(one, two, ts=1500), raw_round(one, two, kind="PVE", ts=1600), raw_round(one, two, ts=2500, outcome="defeat"), raw_round(two, one, uuid="q", ts=10)]
    raw = str(tmp_path / "raw")
    spark.createDataFrame(rows, ROUNDS).write.parquet(raw)
    for name in ("baseline", "cnn", "vit"):
        getattr(extract, f"extract_{name}_features")(spark, raw, str(tmp_path / name), dims)
    wide, onehot, ids = (spark.read.parquet(str(tmp_path / n)).orderBy("timestamp").collect() for n in ("baseline", "cnn", "vit"))
    assert [(r.round_idx, r.outcome) for r in ids] == [("m_q_2-1_0", 1), ("m_p_2-1_0", 1), ("m_p_2-1_2", 0)]
    assert [r.patch_id for r in ids] == [0, 2, 1], "ids follow the source order, releases the time"
    assert len(wide[0]) == 3 + len(dims.wide_names) and wide[1]["player_U1_1"] == 1 and wide[1]["player_total_cost"] == 3
    assert onehot[1].traits == [1, 0, 1, 0, 0, 0, 0, 0] and len(onehot[1].tensor) == 280


def test_reindex(spark):
    df = spark.createDataFrame([("r", 5, None)], "round_idx string, a int, b int")
    assert assemble.reindex(df, ["b", "c", "a"], KEY).first().asDict() == {"round_idx": "r", "b": 0, "c": 0, "a": 5}


def test_explode_keeps_empty_boards_when_asked(spark):
    df = sides(boards(spark, ([], [unit("U1"), unit("U2")]))).withColumnRenamed("round_name", "round_idx")
    assert units.explode_boards(df, KEY).count() == 2
    rows = units.explode_boards(df, KEY, outer=True).collect()
    assert sorted((r.team, r.pos, r.unit) for r in rows if r.unit is None or r.team == "opponent") == sorted([("opponent", 0, "U1"), ("opponent", 1, "U2"), ("player", None, None)], key=lambda t: t[0])
