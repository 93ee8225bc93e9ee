"""Stores and sinks: split and appended feature tables, sparse vectors, one pass for many models, checked streams, metadata."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from round_rows import raw_round, unit
from roundhouse import BoardEncoder
from roundhouse import dims as dimensions
from roundhouse.operators.validate import validate_rounds
from roundhouse.plans import extract, jobs, score, train
from roundhouse.schema import ROUNDS
from roundhouse.sources import features
from roundhouse.sources import rounds as sources
from roundhouse.streaming import scorer as stream
from test_models import game
from test_plans import plan


def test_training_reads_its_split_only(spark, dims, tmp_path):
    raw, wide, split = (str(tmp_path / name) for name in ("raw", "wide", "split"))
    game(spark, 120).write.parquet(raw)
    dims.write_json(tmp_path / "dims")
    jobs.main(["extract-sparse-features", "--raw-path", raw, "--feature-path", wide, "--dims", str(tmp_path / "dims")])
    jobs.main(["split-features", "--feature-path", wide, "--out", split])
    assert sorted(p.name for p in Path(split).glob("split=*")) == ["split=test", "split=train", "split=val"]
    rows = features.read_features(spark, split)
    assert [rows.filter(F.col("split") == s).count() for s in ("train", "val", "test")] == [96, 12, 12]
    text = plan(rows.filter(F.col("split") == "train"))
    assert "PartitionFilters: [isnotnull(split" in text and "= train)" in text
    jobs.main(["train-baseline", "--feature-path", split, "--model-path", str(tmp_path / "tree"), "--dims", str(tmp_path / "dims"), "--iterations", "3"])
    loaded = jobs.load_scorer(spark, str(tmp_path / "tree"), "xgboost")
    assert loaded.features == () and stream.score_rounds(game(spark, 5), loaded, dims).count() == 5


def test_sparse_vectors_equal_the_wide_columns(spark, dims):
    prepared = extract.prepared_rounds(game(spark, 100)).persist()
    names = dims.wide_names
    sparse = extract.sparse_rows(prepared, dims)
    made = train.wide_stages(sparse, names)
    vectors = made[1].transform(made[0].transform(sparse)).select("round_idx", vector_to_array("features").alias("v"))
    wide = {r["round_idx"]: [float(r[n]) for n in names] for r in extract.wide_rows(prepared, dims).collect()}
    assert {r.round_idx: r.v for r in vectors.collect()} == wide
    assert len(sparse.columns) < 10
    few = {"maxIter": 3, "maxDepth": 3}
    one, two = (train.train_tabular(rows, names, params=few) for rows in (sparse, extract.wide_rows(prepared, dims)))
    assert one.train_accuracy == two.train_accuracy and {tuple(r) for r in one.metrics.collect()} == {tuple(r) for r in two.metrics.collect()}


@pytest.fixture(scope="module")
def models(spark, dims):
    prepared = extract.prepared_rounds(game(spark)).persist()
    few = {"maxIter": 3}
    tree = train.train_tabular(extract.wide_rows(prepared, dims), dims.wide_names, params=few)
    sparse = train.train_tabular(extract.sparse_rows(prepared, dims), dims.wide_names, params=few)
    ids = train.train_board(extract.trait_id_rows(prepared, dims), trait_ids=True, width=4096, params=few)
    flags = train.train_board(extract.onehot_rows(prepared, dims), trait_ids=False, width=4096, params=few)
    assert ids.train_accuracy > 0.5
    return {
        "vit": score.Scorer(ids.model, "vit"), "cnn": score.Scorer(flags.model, "cnn"),
        "xgboost": score.Scorer(tree.model, "xgboost", tuple(tree.features)), "sparse": score.Scorer(sparse.model, "xgboost"),
    }


def test_many_models_read_the_boards_once(spark, dims, models, tmp_path):
    game(spark, 30).write.parquet(str(tmp_path / "raw"))
    boards = sources.read_rounds(spark, str(tmp_path / "raw")).select("match_uuid", "board_data.*")
    every = score.score_boards(boards, models, dims)
    assert plan(every).count("FileScan") == 1 and "Union" not in plan(every) and "Exchange" not in plan(every)
    got = {(r.match_uuid, r.model): r.win_probability for r in every.collect()}
    assert len(got) == 120
    for name, model in models.items():
        alone = model.score(boards, BoardEncoder(dims)).collect()
        assert {(r.match_uuid, name): r.win_probability for r in alone} == pytest.approx({k: v for k, v in got.items() if k[1] == name})
    assert all(got[m, "sparse"] == pytest.approx(got[m, "xgboost"]) for m, _ in got)


def broken_game(spark):
    bad = [[unit("U1", 9)], [unit(None)], [unit("U2", loc="Z9"), unit("U1", 0)], [unit("U1", None, None, "A1")]]
    rows = [raw_round(board, [unit("U2")], match=f"bad{k}", name="2-1") for k, board in enumerate(bad)]
    rows += [raw_round([unit("U1")], [unit("U2", loc=None)], match="bad9", name="2-1"), raw_round(None, [unit("U9", 7)], match="empty", name="2-1")]
    return game(spark, 40).unionByName(spark.createDataFrame(rows, ROUNDS)).repartition(5)


def test_checked_stream_keeps_broken_boards_apart(spark, dims, models, tmp_path):
    source, target, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    raw = broken_game(spark)
    raw.write.parquet(source)
    run = lambda: stream.stream_checked(spark, source, target, state, models["vit"], dims, max_files=2).awaitTermination()
    run()
    usable = validate_rounds(raw.filter("match_uuid <> 'empty'"))
    wanted = {r.match_uuid: r.violations for r in usable.filter("NOT valid").collect()}
    assert wanted == {"bad0": ["player.tier"], "bad1": ["player.unit"], "bad2": ["player.col", "player.row", "player.tier"], "bad9": ["opponent.col", "opponent.row"]}
    assert {r.match_uuid: r.violations for r in stream.read_quarantine(spark, target).collect()} == wanted
    batch = {r.match_uuid: r.win_probability for r in stream.score_rounds(raw, models["vit"], dims).collect() if r.match_uuid not in wanted}
    scores = stream.read_scores(spark, target)
    assert {r.match_uuid: r.win_probability for r in scores.collect()} == pytest.approx(batch) and "violations" not in scores.columns
    assert "PartitionFilters: [isnotnull(valid" in plan(scores)
    # the last batch is run again, as after a crash before its commit
    commits = sorted((Path(state) / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    assert len(commits) > 1
    for name in (commits[-1].name, f".{commits[-1].name}.crc"):
        (Path(state) / "commits" / name).unlink(missing_ok=True)
    run()
    assert scores.count() == len(batch) == spark.read.parquet(target).count() - len(wanted)


def test_chunks_are_numbered_like_one_extraction(spark, dims, tmp_path):
    rows = [raw_round([unit("U1")], [unit("U2")], match=f"m{k % 3}", uuid=None if k % 5 == 0 else "p", name="2-1", ts=k, outcome="victory" if k % 2 else "defeat") for k in range(30)]
    rows += [raw_round([], [unit("U2")], match="m0", name="2-1", ts=k) for k in (3, 13)]  # they count but are no features
    df = spark.createDataFrame(rows, ROUNDS)
    out, state = str(tmp_path / "out"), str(tmp_path / "out_instances")
    for chunk, low in (("a", 0), ("b", 10), ("b", 10), ("c", 20)):
        df.filter(F.col("timestamp").between(low, low + 9)).write.mode("overwrite").parquet(str(tmp_path / chunk))
        extract.extract_sparse_features(spark, str(tmp_path / chunk), out, dims, chunk=chunk)
    df.write.parquet(str(tmp_path / "all"))
    extract.extract_sparse_features(spark, str(tmp_path / "all"), str(tmp_path / "whole"), dims)
    both = [sorted(map(str, features.read_features(spark, path).select("round_idx", "timestamp", "outcome", "words").collect())) for path in (out, str(tmp_path / "whole"))]
    assert both[0] == both[1] and len(both[0]) == 30
    assert {r.chunk for r in extract.read_state(spark, state).collect()} == {"a", "b", "c"}
    df.filter("timestamp = 5").write.parquet(str(tmp_path / "late"))
    with pytest.raises(Exception, match="earlier chunk"):
        extract.extract_sparse_features(spark, str(tmp_path / "late"), out, dims, chunk="d")


def test_extraction_takes_few_jobs(spark, dims, tmp_path):
    game(spark, 60).write.parquet(str(tmp_path / "raw"))
    spark.sparkContext.setJobGroup("extraction", "extraction")
    extract.extract_vit_features(spark, str(tmp_path / "raw"), str(tmp_path / "out"), dims)
    found = spark.sparkContext.statusTracker().getJobIdsForGroup("extraction")
    spark.sparkContext.setJobGroup("", "")
    # the sketch's two merges, the window's shuffle, the sample of the time ranges, their shuffle, the write
    assert len(found) <= 8


@pytest.mark.parametrize("as_list", [True, False])
def test_metadata_of_odd_shapes(spark, tmp_path, as_list):
    champions = {"a": {"apiName": "A", "cost": "3", "traits": ["X", "Y"], "more": {"deep": [1]}}, "b": {"apiName": "B", "cost": [1], "traits": "X"}, "c": {"name": 5}}
    traits = {"x": {"name": "X", "effects": {"one": {"minUnits": 2}, "two": {"style": 1}, "three": {"minUnits": 4.0}}}, "y": {"name": "Y", "effects": None}, "z": 7}
    chosen = {"champions": list(champions.values()) if as_list else champions, "traits": list(traits.values()) if as_list else traits, "extra": [[]]}
    path = str(tmp_path / "meta.json")
    Path(path).write_text(json.dumps({"sets": [None, chosen] if as_list else {"1": chosen, "2": "broken"}, "items": {"i": {"apiName": "I", "tags": None}} if as_list else [{"apiName": "I", "new": 1}]}))
    units, found = dimensions.dims_from_metadata(sources.read_set(spark, path, 1))
    assert sorted(units.collect(), key=str) == sorted([("A", 3, ["X", "Y"]), ("B", None, []), (None, None, [])], key=str)
    points = {r.trait: sorted(r.breakpoints) for r in found.collect()}
    assert points["X"] in ([2, 4], [2]) and points["Y"] == []
    assert [tuple(r) for r in sources.read_items(spark, path).collect()] == [("I", None, None, None)]
    with pytest.raises(ValueError, match="no set 3"):
        sources.read_set(spark, path, 3)
