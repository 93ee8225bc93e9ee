"""Trait counts and encodings, from unit rows and inside the row."""

from pyspark.sql import functions as F

from round_rows import unit
from roundhouse import BoardEncoder
from roundhouse.operators import assemble, traits

KEY = ["round_key"]
UNITS = "round_key string, team string, pos int, unit string, tier bigint, item_ids array<string>, loc string"

# name, units as (unit, items), ids expected
CASES = [
    ("three carriers of A, one also of B", [("U1", []), ("U2", []), ("U3", [])], [1, 3]),
    ("one carrier of B", [("U4", [])], [3]),
    ("one innate and one emblem reach the breakpoint", [("U1", ["EmblemA"])], [1]),
    ("two innate A and an emblem of B", [("U1", ["EmblemB"]), ("U3", [])], [1, 3]),
    ("emblems alone, two on one unit", [("U5", ["EmblemA", "EmblemB", "EmblemA"])], [1, 3]),
    ("other items give nothing", [("U1", ["Item1"]), ("U3", ["Item2"])], [1]),
    ("copies of a unit count once", [("U1", []), ("U1", [])], []),
    ("unknown unit with an emblem", [("Ghost", ["EmblemB"])], [3]),
    ("null items", [("U4", None)], [3]),
]


def boards(spark):
    rows = []
    for number, (_, board, _) in enumerate(CASES):
        rows += [(f"r{number}", "player", pos, name, 1, items, "A1") for pos, (name, items) in enumerate(board)]
        rows.append((f"r{number}", "opponent", 0, "U2", 1, [], "A1"))
    return spark.createDataFrame(rows, UNITS)


def test_ids_from_unit_rows(spark, dims):
    rows = boards(spark)
    counts = traits.trait_counts(rows, KEY, dims, distinct_units=True, emblems=True)
    vectors = traits.trait_id_vector(traits.active_traits(counts, dims), rows.select(*KEY).distinct(), KEY, dims)
    got = {r.round_key: r.trait_ids for r in vectors.collect()}
    for number, (name, _, ids) in enumerate(CASES):
        assert got[f"r{number}"] == ids + [0] * (15 - len(ids)) + [3] + [0] * 14, name


def test_ids_in_one_pass(spark, dims):
    vectors = assemble.trait_id_vectors(boards(spark), KEY, dims)
    got = {r.round_key: r.trait_ids for r in vectors.filter("both_sides").collect()}
    for number, (name, _, ids) in enumerate(CASES):
        assert got[f"r{number}"] == ids + [0] * (15 - len(ids)) + [3] + [0] * 14, name


def test_a_side_without_units_is_told(spark, dims):
    one_sided = boards(spark).filter("team = 'player'")
    assert assemble.trait_id_vectors(one_sided, KEY, dims).filter("both_sides").count() == 0
    assert assemble.trait_id_vectors(one_sided, KEY, dims).count() == len(CASES)


def test_ids_inside_the_row(spark, dims):
    rows = [(n, [unit(name, items=items) for name, items in board]) for n, (_, board, _) in enumerate(CASES)]
    kind = "n int, board array<struct<unit:string,tier:bigint,item_ids:array<string>,loc:string>>"
    df = spark.createDataFrame(rows, kind)
    got = {r.n: r.ids for r in df.select("n", BoardEncoder(dims).trait_ids(F.col("board")).alias("ids")).collect()}
    for number, (name, _, ids) in enumerate(CASES):
        assert got[number] == ids + [0] * (15 - len(ids)), name


def test_copies_count_for_one_hot_but_emblems_do_not(spark, dims):
    kind = "board array<struct<unit:string,tier:bigint,item_ids:array<string>,loc:string>>"
    df = spark.createDataFrame([([unit("U1"), unit("U1"), unit("U4", items=["EmblemB", "EmblemB"])],), ([],)], kind)
    got = [r[0] for r in df.select(BoardEncoder(dims).trait_onehot(F.col("board"))).collect()]
    assert got == [[1, 0, 1, 0], [0, 0, 0, 0]]


def test_level_is_ordinal_and_breakpoint_is_value(spark, dims):
    counts = spark.createDataFrame([("r", "player", "TraitA", 1), ("r", "player", "TraitB", 3), ("q", "player", "TraitA", 9), ("q", "player", "None", 5)], "round_key string, team string, trait string, n bigint")
    got = {(r.round_key, r.trait): (r.level, r.breakpoint) for r in traits.active_traits(counts, dims).collect()}
    assert got == {("r", "TraitB"): (2, 3), ("q", "TraitA"): (2, 4)}


def test_more_than_fifteen_ids_are_cut(spark):
    from roundhouse import Dims
    from roundhouse.dims import Unit

    names = [f"T{n}" for n in range(20)]
    many = Dims(units={f"U{n}": Unit(1, (name,)) for n, name in enumerate(names)}, traits={name: (1,) for name in names})
    kind = "board array<struct<unit:string,tier:bigint,item_ids:array<string>,loc:string>>"
    df = spark.createDataFrame([([unit(f"U{n}") for n in reversed(range(20))],)], kind)
    assert df.select(BoardEncoder(many).trait_ids(F.col("board"))).first()[0] == list(range(1, 16))


def test_partitioning_does_not_matter(spark, dims):
    found = []
    for partitions in (1, 4, 17):
        rows = boards(spark).repartition(partitions)
        counts = traits.trait_counts(rows, KEY, dims, distinct_units=True, emblems=True)
        found.append({(r.round_key, r.team, r.trait): r.n for r in counts.collect()})
    assert found[0] == found[1] == found[2]
    assert found[0][("r4", "player", "TraitA")] == 2 and found[0][("r0", "player", "TraitA")] == 3


def test_progress_order_and_next(spark, dims):
    rows = [("r", "player", t, n) for t, n in (("TraitA", 1), ("TraitB", 5))] + [("q", "player", "TraitA", 3)]
    counts = spark.createDataFrame(rows, "round_key string, team string, trait string, n bigint")
    progress = traits.trait_progress(counts, dims)
    got = {(r.round_key, r.trait): (r.level, r.next, r.active, r["class"]) for r in progress.collect()}
    assert got == {("r", "TraitA"): (0, 2, False, "none"), ("r", "TraitB"): (2, 3, True, "prism"), ("q", "TraitA"): (1, 4, True, "silver")}
    assert [r.trait for r in progress.filter("round_key = 'r'").orderBy(*traits.progress_order()).collect()] == ["TraitB", "TraitA"]
