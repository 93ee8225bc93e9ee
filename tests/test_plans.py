"""Physical plans: what is shuffled, what is not, and what must never appear."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from roundhouse import BoardEncoder
from roundhouse.operators import rounds, units
from roundhouse.plans import extract
from roundhouse.schema import ROUNDS
from roundhouse.sources.rounds import read_rounds, scan_rounds
from testbed import adapter

SF = "/root/testdata/sf0.001"
RELATIONAL = [name for name in entry.oracle_sql() if name not in ("search_board",)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning") + plan(df).count("Exchange rangepartitioning") + plan(df).count("Exchange SinglePartition")


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "rounds")
    nested = adapter.nested_rounds(spark, SF)
    nested.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ROUNDS.fields]).write.parquet(path)
    return path


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for forbidden in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups"):
        assert forbidden not in text


def test_no_nested_loops(spark):
    for name in ("patch_asof", "recency_weight", "extract_vit_job", "asof_join_union"):
        assert "BroadcastNestedLoopJoin" not in plan(entry.queries()[name](spark, SF))
    assert "Window" not in plan(entry.queries()["patch_asof"](spark, SF))


def test_features_inside_the_row_do_not_shuffle(spark, raw):
    usable = rounds.labelled_rounds(rounds.usable_rounds(read_rounds(spark, raw)).withColumn("round_idx", F.col("match_uuid")))
    dims = adapter.dims()
    for encode in (extract.wide_rows, extract.onehot_rows, extract.trait_id_rows):
        text = plan(encode(usable, dims))
        assert "Exchange" not in text and "Join" not in text


def test_extraction_shuffles_only_for_the_instance(spark, raw):
    prepared = extract.prepared_rounds(read_rounds(spark, raw))
    assert shuffles(extract.trait_id_rows(prepared, adapter.dims())) == 1


def test_scan_reads_one_nested_field(spark, raw):
    df = scan_rounds(spark, raw, F.col("round_type") == "PVP", ["match_uuid", "board_data.player_board"])
    text = plan(df)
    assert "PushedFilters: [IsNotNull(round_type), EqualTo(round_type,PVP)]" in text
    assert "opponent_board" not in text and "timestamp" not in text


def test_cap_is_cut_before_the_shuffle_and_reused_after_it(spark):
    records = units.unit_records(adapter.units(spark, SF), ["round_key"], adapter.dims())
    cells = units.cell_values(records, ["round_key"])
    text = plan(cells)
    assert text.count("WindowGroupLimit") == 2 and text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")
    assert shuffles(cells) == 1


def test_dimensions_are_broadcast(spark):
    enriched = units.enrich_units(adapter.units(spark, SF), adapter.dims())
    assert "SortMergeJoin" not in plan(enriched) and shuffles(enriched) == 0


def test_counts_combine_before_the_shuffle(spark):
    text = plan(units.team_cost(units.enrich_units(adapter.units(spark, SF), adapter.dims()), ["round_key"]))
    assert text.count("HashAggregate") == 2 and "partial_sum" in text


def test_split_moves_no_rows(spark):
    assert shuffles(entry.queries()["chrono_split"](spark, SF)) == 0


def test_constants_are_folded(spark, raw):
    df = read_rounds(spark, raw).select(BoardEncoder(adapter.dims()).total_cost(F.col("board_data.player_board")).alias("cost"))
    assert "from_json" not in plan(df)
