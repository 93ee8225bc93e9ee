"""What a task holds and how often rows are read, on rows of the tests' own."""

import re
from collections import Counter

from pyspark.sql import functions as F
from test_models import game

from roundhouse import Dims
from roundhouse.dims import Unit
from roundhouse.operators import ordering, sample, traits, units
from roundhouse.plans import extract, train
from roundhouse.session import tasks_for
from roundhouse.sources import features
from testbed import adapter


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


UNITS = [(k, team, unit, tier) for k in (1, 2, None) for team in ("player", "opponent", None) for unit in ("U1", "U2", "?", None) for tier in (1, 1, 4, 7, None)]
UNITS += [(4, "player", "?", 1)]


def unit_rows(spark):
    return spark.createDataFrame(UNITS, "k bigint, team string, unit string, tier bigint").repartition(3)


def test_pivot_keeps_no_buffer_of_all_columns(spark, dims):
    wide = units.unit_tier_pivot(unit_rows(spark), ["k"], dims)
    counts = Counter((k, f"{team}_{unit}_{tier}") for k, team, unit, tier in UNITS)
    names = units.unit_tier_names(dims)
    assert wide.columns == ["k", *names]
    got = {row.k: [row[n] for n in names] for row in wide.collect()}
    assert got == {k: [counts[k, n] for n in names] for k in (1, 2, None, 4)}
    assert "pivotfirst" not in plan(wide)


def test_distinct_units_are_one_set_a_board(spark):
    dims = Dims(units={"U1": Unit(1, ("A", "B")), "U2": Unit(1, ("A", "unlisted")), "U3": Unit(1, ())}, traits={"A": (1,), "B": (1,)})
    counts = traits.innate_counts(unit_rows(spark), ["k"], dims, distinct_units=True)
    boards = {(k, team) for k, team, unit, _ in UNITS if unit == "U1"}
    each = [("A", 2), ("B", 1), ("unlisted", 1)]
    assert Counter(map(tuple, counts.collect())) == Counter((k, team, *entry) for k, team in boards for entry in each)
    keyed = re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", plan(counts))
    assert keyed and not any("unit" in keys or "trait" in keys for keys in keyed)


def test_tasks_grow_with_the_rows(spark):
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark, 10 * own, 10) is None and tasks_for(spark, 10 * own + 1, 10) == own + 1


def test_numbering_and_features_are_dealt_by_their_rows(spark, dims, tmp_path, monkeypatch):
    import roundhouse.session as session

    few = lambda spark, rows: session.tasks_for(spark, rows, 5)
    raw = game(spark, 100)
    plain = extract.prepared_rounds(raw)
    extract.write_features(extract.wide_rows(plain, dims), str(tmp_path / "plain"))
    monkeypatch.setattr(ordering, "tasks_for", few)
    monkeypatch.setattr(features, "tasks_for", few)
    dealt = extract.prepared_rounds(raw)
    assert re.search(r"hashpartitioning\([^)]*, 20\), REPARTITION_BY_NUM", plan(dealt))
    raw.write.parquet(str(tmp_path / "raw"))
    extract.extract_baseline_features(spark, str(tmp_path / "raw"), str(tmp_path / "dealt"), dims)
    one, two = (spark.read.parquet(str(tmp_path / name)) for name in ("plain", "dealt"))
    assert one.columns == two.columns and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    assert two.select(F.input_file_name()).distinct().count() > 8 > one.select(F.input_file_name()).distinct().count()


def test_features_are_made_behind_the_sort(spark, tmp_path):
    seen = []
    df = spark.createDataFrame([(f"r{n}", n * 37 % 100) for n in range(100)], "round_idx string, timestamp bigint")

    def encode(ordered):
        seen.append(plan(ordered))
        return ordered.withColumn("made", F.col("timestamp") + 1)

    features.write_features(df, str(tmp_path / "f"), encode=encode)
    assert "rangepartitioning" in seen[0] and "Sort" in seen[0]
    assert features.read_features(spark, str(tmp_path / "f")).filter("made = timestamp + 1").count() == 100


def test_boards_are_sampled_in_one_pass(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(k, f"M{k % 7}", str(k % 3), f"{k:03d}") for k in range(60)], "key bigint, match string, stage string, shuffle_key string")

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    picked = sample.pick_exact(rows.mapInArrow(count, rows.schema), "key", "match", 2)
    assert picked.count() == 6 and read.value == 60


def test_words_of_both_sides_are_those_of_turned_boards(spark, dims):
    prepared = extract.prepared_rounds(game(spark, 30))
    rows = extract.trait_id_rows(prepared, dims).withColumn("split", F.lit("train"))
    both = train.both_words(rows, trait_ids=True)
    for prob, column in ((0.0, "words"), (1.0, "swapped_words")):
        turned = train.augment_sides(rows, "round_idx", prob=prob)
        tokens = turned.select("round_idx", train.board_tokens(F.col("tensor"), F.col("traits"), trait_ids=True).alias("w"))
        assert sorted(map(str, tokens.collect())) == sorted(map(str, both.select("round_idx", F.col(column).alias("w")).collect()))


def test_one_file_of_orders_is_dealt_to_all_cores(spark):
    nested = adapter.nested_rounds(spark, "/root/testdata/sf0.001")
    assert nested.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_traits_are_turned_once_a_board():
    assert str(train.board_tokens(F.col("tensor"), F.reverse("traits"), trait_ids=True)).count("reverse(") == 1
