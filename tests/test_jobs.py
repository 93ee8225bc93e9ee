"""The jobs from the command line, on storage, and the catalog job."""

import json

import pytest
from pyspark.sql import functions as F

from roundhouse.dims import Dims, Unit
from roundhouse.plans import catalog, jobs
from test_models import game


def test_extract_train_sample_score_and_stream(spark, dims, tmp_path):
    path = {name: str(tmp_path / name) for name in ("raw", "dims", "wide", "vit", "tree", "board", "boards", "scores", "stream", "state", "requests", "trials")}
    game(spark, 80).withColumn("round_type", F.lit("PVP")).write.parquet(path["raw"])
    dims.write_json(path["dims"])
    static = ["--dims", path["dims"]]
    jobs.main(["extract-baseline-features", "--raw-path", path["raw"], "--feature-path", path["wide"], *static])
    jobs.main(["extract-vit-features", "--raw-path", path["raw"], "--feature-path", path["vit"], *static])
    jobs.main(["train-baseline", "--feature-path", path["wide"], "--model-path", path["tree"]])
    jobs.main(["train-vit", "--feature-path", path["vit"], "--model-path", path["board"]])
    jobs.main(["hpo-vit", "--feature-path", path["vit"], "--out", path["trials"], "--n-trials", "2"])
    assert spark.read.parquet(path["trials"]).count() == 2
    jobs.main(["extract-sample-boards", "--raw-path", path["raw"], "--out", path["boards"], "--per-stage", "4", *static])
    assert spark.read.json(path["boards"]).count() == 4
    request = {"request_id": "a", "model": "xgboost", "player": [{"unit": "U1", "tier": 2, "row": 0, "col": 0}], "opponent": []}
    (tmp_path / "requests").write_text("\n".join(json.dumps(r) for r in (request, {**request, "request_id": "b", "model": "tree"}, {**request, "request_id": "c", "model": "ViT"})))
    jobs.main(["score", "--requests", path["requests"], "--out", path["scores"], "--model", f"xgboost={path['tree']}", "--model", f"vit={path['board']}", *static])
    scored = {r.request_id: r for r in spark.read.parquet(path["scores"]).collect()}
    assert {k: r.model for k, r in scored.items()} == {"a": "xgboost", "c": "vit"} and all(0 < r.win_probability < 1 for r in scored.values())
    assert [r.violations for r in spark.read.parquet(path["scores"] + "_rejected").collect()] == [["model"]]
    jobs.main(["stream-score", "--raw-path", path["raw"], "--out", path["stream"], "--model-path", path["board"], "--state", path["state"], *static])
    assert spark.read.parquet(path["stream"]).count() == 80


def test_catalog_job(spark, dims):
    meta = spark.createDataFrame(
        [([("U2", "Bee", 9, ["X"]), ("U4", "", None, [])], [("TraitA", "a.tex"), ("TraitB", None)])],
        "champions array<struct<apiName:string,name:string,cost:int,traits:array<string>>>, traits array<struct<name:string,icon:string>>",
    )
    items = spark.createDataFrame([("Item1", "Zap", ["component"], "i"), ("Item2", None, None, "")], "apiName string, name string, tags array<string>, icon string")
    built = catalog.build_catalog(spark, dims, meta, items, set_prefix="S", hidden_units=["U1"], special_units=["U3"], hidden_items=["Item3"])
    assert [(r.unit, r.name, r.cost, r.special) for r in built["units"].collect()] == [
        ("U2", "Bee", 9, False), ("U4", "U4", None, False), ("U5", "U5", None, False), ("U3", "U3", 3, True)
    ]
    assert [(r.item, r.name, r.category, r.has_icon) for r in built["items"].collect()] == [("Item2", "Item2", "normal", False), ("Item1", "Zap", "component", True)]
    assert {r.trait: (r.breakpoints, r.unique, r.has_icon) for r in built["traits"].collect()} == {"TraitA": ([2, 4], False, True), "TraitB": ([1, 3], False, False)}


@pytest.mark.parametrize("as_list", [True, False])
def test_dims_and_catalog_from_metadata(spark, dims, tmp_path, as_list):
    chosen = {
        "champions": [{"apiName": "U9", "name": "Nine", "cost": 4, "traits": ["Zeta"]}, {"apiName": "U1", "name": "One"}, {"apiName": "U2", "cost": 2, "traits": []}],
        "traits": [{"name": "Zeta", "icon": "z.tex", "effects": [{"minUnits": 2}, {}, {"minUnits": 4}]}, {"name": "Alpha"}],
    }
    items = [{"apiName": "Item1", "name": "Zap", "tags": ["component"], "icon": "i"}, {"apiName": "Other"}]
    (tmp_path / "meta.json").write_text(json.dumps({"sets": [{}, {}, chosen] if as_list else {"2": chosen}, "items": items}, indent=1))
    dims.write_json(tmp_path / "old")
    folder = {name: str(tmp_path / name) for name in ("meta.json", "old", "new", "catalog")}
    jobs.main(["build-dims", "--metadata", folder["meta.json"], "--set", "2", "--dims", folder["old"], "--out", folder["new"]])
    built = Dims.read(spark, folder["new"])
    assert built == Dims(
        units={"U9": Unit(4, ("Zeta",)), "U1": Unit(None, ()), "U2": Unit(2, ())},
        traits={"Zeta": (2, 4), "Alpha": ()}, emblems=dims.emblems, items=dims.items, patches=dims.patches,
    )
    assert list(built.unit_vocab) == ["U9", "U1", "U2"] and Dims.read(spark, folder["old"]) == dims
    command = ["build-catalog", "--metadata", folder["meta.json"], "--set", "2", "--dims", folder["new"], "--out", folder["catalog"], "--set-prefix", "S"]
    jobs.main([*command, "--hidden-units", "U2", "--hidden-items", "Item2"])
    tables = {name: spark.read.parquet(f"{folder['catalog']}/{name}").collect() for name in ("units", "items", "traits")}
    assert {r.unit: r.name for r in tables["units"]} == {"U9": "Nine", "U1": "One"}
    assert {r.item: (r.name, r.has_icon) for r in tables["items"]} == {"Item1": ("Zap", True), "Item3": ("Item3", False)}
    assert {r.trait: (r.breakpoints, r.has_icon) for r in tables["traits"]} == {"Zeta": ([2, 4], True), "Alpha": ([], False)}
    with pytest.raises(ValueError, match="no set 7"):
        jobs.main(["build-dims", "--metadata", folder["meta.json"], "--set", "7", "--out", folder["new"]])


def test_unknown_job_is_refused():
    with pytest.raises(SystemExit):
        jobs.main(["nothing"])
