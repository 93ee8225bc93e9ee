"""Metrics, training, scoring, streaming, validation, catalogs and storage."""

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from round_rows import raw_round, unit
from roundhouse import Dims
from roundhouse import dims as dimensions
from roundhouse.operators import catalog, metrics, sample, validate
from roundhouse.plans import extract, score, train
from roundhouse.schema import REQUESTS, ROUNDS
from roundhouse.sources import features, rounds as sources
from roundhouse.streaming import scorer as stream


def test_auc_with_ties_against_pairs_and_evaluator(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(2), rng.randrange(12) / 12) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, s double")
    positives, negatives = [s for y, s in rows if y], [s for y, s in rows if not y]
    pairs = sum((p > n) + 0.5 * (p == n) for p in positives for n in negatives) / (len(positives) * len(negatives))
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(pairs)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0)
    assert evaluator.evaluate(df.withColumn("y", F.col("y").cast("double"))) == pytest.approx(pairs)


def test_auc_of_one_class_is_null(spark):
    assert metrics.roc_auc(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s").first()[0] is None


def test_class_report(spark):
    rng = random.Random(7)
    rows = [(float(rng.randrange(3)), float(rng.randrange(2))) for _ in range(200)]
    report = {r["class"]: r for r in metrics.class_report(spark.createDataFrame(rows, "y double, p double"), "y", "p").collect()}
    for c in (0.0, 1.0, 2.0):
        hit, support = sum(y == p == c for y, p in rows), sum(y == c for y, _ in rows)
        predicted = sum(p == c for _, p in rows)
        assert report[str(c)].support == support
        assert report[str(c)].precision == pytest.approx(hit / predicted if predicted else 0)
        assert report[str(c)].recall == pytest.approx(hit / support)
    evaluator = MulticlassClassificationEvaluator(labelCol="y", predictionCol="p", metricName="accuracy")
    assert report["accuracy"].f1 == pytest.approx(evaluator.evaluate(spark.createDataFrame(rows, "y double, p double")))
    assert report["macro avg"].recall == pytest.approx(sum(report[str(c)].recall for c in (0.0, 1.0, 2.0)) / 3)


def test_log_loss_forms_agree_and_stay_finite(spark):
    df = spark.createDataFrame([(1, 2.0), (0, -1.0), (1, -0.5)], "y int, x double")
    from_probability = metrics.log_loss(metrics.with_probability(df, "x", "p"), "y", "p").first()[0]
    assert metrics.log_loss(df, "y", "x", from_logit=True).first()[0] == pytest.approx(from_probability)
    assert metrics.log_loss(spark.createDataFrame([(1, 0.0)], "y int, p double"), "y", "p").first()[0] == pytest.approx(34.538776, rel=1e-6)
    assert metrics.brier(spark.createDataFrame([(1, 0.5), (0, 0.0)], "y int, p double"), "y", "p").first()[0] == 0.125


def test_best_trial(spark):
    trials = spark.createDataFrame([(0, 0.4, "a"), (1, 0.2, "b"), (2, 0.2, "c"), (3, float("nan"), "d")], "trial int, loss double, params string")
    assert metrics.best_trial(trials).first().params == "b"


def game(spark, n=160):
    """Rounds that the side with more tiers wins."""
    rng = random.Random(9)
    names = ["U1", "U2", "U3", "U4"]
    rows = []
    for k in range(n):
        boards = [[unit(rng.choice(names), rng.randrange(1, 4), ["Item1"][: rng.randrange(2)], f"{'ABCD'[i]}{rng.randrange(1, 8)}") for i in range(3)] for _ in range(2)]
        strength = [sum(u[1] for u in board) for board in boards]
        rows.append(raw_round(*boards, match=f"m{k}", outcome="victory" if strength[0] >= strength[1] else "defeat", ts=1000 + k // 2))
    return spark.createDataFrame(rows, ROUNDS).repartition(4)


@pytest.fixture(scope="module")
def trained(spark, dims):
    prepared = extract.prepared_rounds(game(spark)).persist()
    tree = train.train_tabular(extract.wide_rows(prepared, dims), dims.wide_names, params={"maxIter": 3, "maxDepth": 3})
    board = train.train_board(extract.trait_id_rows(prepared, dims), trait_ids=True, width=4096, decay=0.1, params={"maxIter": 5})
    flags = train.train_board(extract.onehot_rows(prepared, dims), trait_ids=False, width=4096, params={"maxIter": 5})
    return {"vit": board, "cnn": flags, "xgboost": tree}


@pytest.fixture(scope="module")
def scorers(trained):
    return {name: score.Scorer(t.model, name, tuple(t.features) if name == "xgboost" else ()) for name, t in trained.items()}


def test_training_reports(trained):
    values = {r.metric: r.value for r in trained["xgboost"].metrics.collect()}
    assert set(values) == {"roc_auc", "accuracy", "log_loss", "brier"} and values["roc_auc"] > 0.6
    top = train.top_importances(trained["xgboost"]).collect()
    assert len(top) == 10 and top[0].importance >= top[-1].importance
    assert {r["class"] for r in trained["vit"].report.collect()} >= {"accuracy", "macro avg", "weighted avg"}


def as_requests(spark, rows, model):
    """The same boards in request form."""

    def side(board):
        return [{"unit": u, "tier": t, "items": i, "row": ord(loc[0]) - 65, "col": int(loc[1]) - 1} for u, t, i, loc in board]

    return sources.requests_frame(
        spark, [{"request_id": r.match_uuid, "model": model, "player": side(r.board_data.player_board), "opponent": side(r.board_data.opponent_board)} for r in rows]
    )


@pytest.mark.parametrize("model", ["vit", "cnn", "xgboost"])
def test_batch_request_and_stream_score_the_same(spark, dims, scorers, model, tmp_path):
    raw = game(spark, 20)
    batch = {r.match_uuid: r.win_probability for r in stream.score_rounds(raw, scorers[model], dims).collect()}
    scored, rejected = score.score_requests(as_requests(spark, raw.collect(), model.upper()), scorers, dims)
    assert {r.request_id: r.win_probability for r in scored.collect()} == pytest.approx(batch)
    assert rejected.count() == 0
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    raw.write.parquet(source)
    stream.stream_score(spark, source, target, str(tmp_path / "state"), scorers[model], dims, max_files=2).awaitTermination()
    streamed = spark.read.parquet(target).collect()
    assert {r.match_uuid: r.win_probability for r in streamed} == pytest.approx(batch)
    assert all(r.prediction == ("victory" if r.win_probability >= 0.5 else "defeat") for r in streamed)


def test_every_model_scores_every_board(spark, dims, scorers):
    boards = game(spark, 6).select("match_uuid", "board_data.*")
    rows = score.score_boards(boards, scorers, dims).collect()
    assert len(rows) == 18 and {r.model for r in rows} == set(scorers)


def test_model_and_feature_order_round_trip(spark, dims, trained, tmp_path):
    from pyspark.ml import PipelineModel

    path = str(tmp_path / "model")
    trained["xgboost"].model.write().overwrite().save(path)
    features.write_feature_order(spark, trained["xgboost"].features, path)
    assert features.read_feature_order(spark, path) == dims.wide_names
    again = score.Scorer(PipelineModel.load(path), "xgboost", tuple(features.read_feature_order(spark, path)))
    assert score.score_boards(game(spark, 3).select("match_uuid", "board_data.*"), {"xgboost": again}, dims).count() == 3


def test_search_is_reproducible(spark):
    space = {"a": train.Choice((1, 2, 3)), "b": train.Uniform(0, 1), "c": train.Uniform(1e-4, 1e-1, log=True), "d": train.Uniform(100, 500, step=100)}
    assert train.draw_trials(space, 20, 1) == train.draw_trials(space, 20, 1) != train.draw_trials(space, 20, 2)
    drawn = train.draw_trials(space, 200, 1)
    assert {t["d"] for t in drawn} == {100, 200, 300, 400, 500} and all(1e-4 <= t["c"] <= 1e-1 for t in drawn)
    trials, best = train.search(spark, space, 6, 5, lambda p: abs(p["b"] - 0.5))
    assert trials.count() == 6 and best.first().loss == trials.agg(F.min("loss")).first()[0]


def test_validation(spark):
    good = {"unit": "U", "tier": 1, "items": ["", "x", None, "y"], "row": 0, "col": 6}
    rows = [
        ("ok", "VIT", [good], []),
        ("no model", None, [good], None),
        ("tier", "cnn", [{**good, "tier": 5}, {**good, "tier": 0}], []),
        ("cells", "xgboost", [{**good, "row": 4}], [{**good, "col": -1}, {**good, "col": None}]),
        ("model", "tree", [], []),
        ("unit", "vit", [{**good, "unit": None, "tier": None}], []),
    ]
    df = validate.validate_boards(spark.createDataFrame(rows, REQUESTS))
    assert {r.request_id: r.violations for r in df.collect()} == {
        "ok": [], "no model": [], "tier": ["player.tier"], "cells": ["opponent.col", "player.row"], "model": ["model"], "unit": ["player.unit"],
    }
    clean, rejected = validate.split_valid(df)
    assert clean.count() == 2 and rejected.count() == 4
    (board,) = clean.filter("request_id = 'ok'").select(validate.request_board(F.col("player"))).first()
    assert (board[0].unit, board[0].tier, board[0].item_ids, board[0].loc) == ("U", 1, ["x"], "A7")


def test_sample_boards_form(spark, dims, tmp_path):
    rows = [raw_round([unit("U1", 0, ["", "Item1", None, "Item2", "Item3", "Item1"], "A_2")] * 3, [unit("U2", 9)] * 3, match=f"m{n}", kind="PVP", name=f"{2 + n % 2}-{n}") for n in range(8)]
    rows += [raw_round([unit("U1")] * 2, [unit("U2")] * 3, match="small", kind="PVP"), raw_round([unit("Ghost")] * 3, [unit("U2")] * 3, match="ghost", kind="PVP")]
    raw = spark.createDataFrame(rows, ROUNDS).withColumn("key", F.xxhash64("match_uuid"))
    boards = sample.sample_boards(raw, dims, key="key", per_stage=3)
    got = boards.collect()
    assert [r.stage[0] for r in got] == ["2"] * 3 + ["3"] * 3
    assert got[0].player[0].asDict() == {"unit": "U1", "tier": 1, "items": ["Item1", "Item2", "Item3"], "row": 0, "col": 1}
    assert got[0].opponent[0].tier == 4
    sources.write_sample_boards(boards, str(tmp_path / "boards"))
    assert spark.read.json(str(tmp_path / "boards")).count() == 6


def test_dimension_files_round_trip(spark, dims, tmp_path):
    dims.write_json(tmp_path)
    assert Dims.from_json(tmp_path) == dims
    assert dimensions.parse_trait_key("Some Trait_3") == ("Some Trait", 3)
    vocab = dimensions.build_trait_vocab(spark, dims).collect()
    assert {(r.trait, r.breakpoint): r.id for r in vocab} == dims.trait_vocab
    text = spark.read.text(str(tmp_path / "vocabulary" / "unit_vocab.json"), wholetext=True)
    assert [(r.key, r.id) for r in dimensions.ordered_mapping(text, "value").orderBy("pos").collect()] == [(f"U{n}", n) for n in range(1, 6)]
    items = spark.createDataFrame([(["x", "y"],)], "items array<string>")
    assert [(r.key, r.id) for r in dimensions.build_vocab(items, "items").collect()] == [("x", 1), ("y", 2)]


def test_large_dimensions_are_refused():
    with pytest.raises(ValueError, match="not a broadcast table"):
        Dims(units={}, traits={}, items=tuple(str(n) for n in range(10_001)))


def test_dimensions_from_metadata(spark, tmp_path):
    path = tmp_path / "meta.json"
    path.write_text(
        """{"champions": [{"apiName": "A", "cost": 2, "traits": ["T"]}, {"apiName": "B"}],
        "traits": [{"name": "T", "effects": [{"minUnits": 2}, {"style": 1}, {"minUnits": 4}]}, {"name": "S", "effects": []}]}"""
    )
    units, traits = dimensions.dims_from_metadata(sources.read_metadata(spark, str(path)))
    assert [(r.unit, r.cost, r.traits) for r in units.orderBy("unit").collect()] == [("A", 2, ["T"]), ("B", None, [])]
    assert {r.trait: r.breakpoints for r in traits.collect()} == {"T": [2, 4], "S": []}


def test_unit_catalog_order(spark):
    units = spark.createDataFrame([("a", 3, ["T"]), ("b", 1, None), ("c", None, []), ("d", 2, []), ("h", 1, [])], "unit string, cost bigint, traits array<string>")
    meta = spark.createDataFrame([("a", "Zed", 1, []), ("b", "", 1, ["S"]), ("d", "Dee", None, [])], "unit string, name string, cost bigint, traits array<string>")
    rows = catalog.catalog_units(units, meta, hidden=["h"], special=["c"]).orderBy(*catalog.unit_order()).collect()
    assert [(r.unit, r.name, r.cost, r.traits, r.has_icon, r.special) for r in rows] == [
        ("a", "Zed", 1, ["T"], True, False), ("b", "b", 1, ["S"], True, False), ("d", "Dee", None, [], True, False), ("c", "c", None, [], False, True),
    ] or [r.unit for r in rows] == ["a", "b", "d", "c"]


def test_union_and_filtered_scan(spark, tmp_path):
    path = str(tmp_path / "raw")
    game(spark, 10).write.parquet(path)
    both = sources.union_rounds([sources.read_rounds(spark, path), spark.createDataFrame([("x", 1)], "match_uuid string, timestamp bigint")])
    assert both.count() == 11 and both.filter("match_uuid = 'x'").first().round_name is None
    assert sources.scan_rounds(spark, path, F.col("round_outcome") == "victory", ["match_uuid"]).columns == ["match_uuid"]


def test_feature_table_is_time_ordered(spark, tmp_path):
    df = spark.createDataFrame([(f"r{n}", (n * 37) % 100, "train" if n % 2 else "test") for n in range(100)], "round_idx string, timestamp bigint, split string")
    features.write_features(df, str(tmp_path / "f"), split="split")
    back = features.read_features(spark, str(tmp_path / "f"))
    assert back.count() == 100
    ranges = sorted((r.low, r.high) for r in back.filter("split = 'train'").groupBy(F.input_file_name()).agg(F.min("timestamp").alias("low"), F.max("timestamp").alias("high")).collect())
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
