"""``spark-submit`` entry: one sub-command per job."""

from __future__ import annotations

import argparse

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from roundhouse.dims import Dims, built_dims
from roundhouse.operators.sample import sample_boards
from roundhouse.plans import extract, score, train
from roundhouse.plans.catalog import build_catalog
from roundhouse.session import get_spark
from roundhouse.sources.features import read_feature_order, read_features, write_feature_order
from roundhouse.sources.rounds import read_items, read_requests, read_rounds, read_set, write_sample_boards
from roundhouse.streaming.scorer import stream_checked, stream_score

EXTRACTORS = {
    "extract-baseline-features": extract.extract_baseline_features,
    "extract-sparse-features": extract.extract_sparse_features,
    "extract-cnn-features": extract.extract_cnn_features,
    "extract-vit-features": extract.extract_vit_features,
}
BOARD_SPACE = {
    "regParam": train.Uniform(1e-4, 1e-1, log=True),
    "elasticNetParam": train.Uniform(0.0, 1.0),
    "augment": train.Uniform(0.0, 0.5, step=0.25),
    "width": train.Choice((1 << 14, 1 << 16, 1 << 18)),
}


def parser() -> argparse.ArgumentParser:
    """Command line of all jobs."""
    top = argparse.ArgumentParser(prog="roundhouse")
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, *paths: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name)
        for path in paths:
            sub.add_argument(f"--{path}", required=True)
        return sub

    for name in EXTRACTORS:
        sub = job(name, "raw-path", "feature-path", "dims")
        sub.add_argument("--short-key", action="store_true", help="leave the player out of the round key")
        sub.add_argument("--chunk", help="name of new files' chunk: they are numbered and added behind the chunks extracted before")
    sub = job("split-features", "feature-path", "out")
    sub.add_argument("--train-split", type=float, default=0.8)
    sub.add_argument("--val-split", type=float, default=0.1)
    sub = job("train-baseline", "feature-path", "model-path")
    sub.add_argument("--test-size", type=float, default=0.2)
    sub.add_argument("--dims", help="for features as words: the folder of the dimensions they were extracted with")
    sub.add_argument("--iterations", type=int, default=20)
    for name in ("train-cnn", "train-vit"):
        sub = job(name, "feature-path", "model-path")
        sub.add_argument("--train-split", type=float, default=0.8)
        sub.add_argument("--val-split", type=float, default=0.1)
        for option, kind, default in (("seed", int, 0), ("augment", float, 0.5), ("decay", float, None), ("iterations", int, 30), ("regularisation", float, 0.01)):
            sub.add_argument(f"--{option}", type=kind, default=default)
    for name in ("hpo-cnn", "hpo-vit"):
        sub = job(name, "feature-path", "out")
        sub.add_argument("--n-trials", type=int, default=30)
        sub.add_argument("--seed", type=int, default=0)
    sub = job("extract-sample-boards", "raw-path", "out", "dims")
    for option, default in (("per-stage", 10), ("min-units", 3), ("seed", 16)):
        sub.add_argument(f"--{option}", type=int, default=default)
    sub.add_argument("--catalog", help="folder of the written catalog tables units and items; only what they show is sampled")
    sub = job("build-dims", "metadata", "out")
    sub.add_argument("--set", type=int, required=True)
    sub.add_argument("--dims", help="folder whose emblems, items and patches are taken over")
    sub = job("build-catalog", "metadata", "dims", "out", "set-prefix")
    sub.add_argument("--set", type=int, required=True)
    for option in ("hidden-units", "special-units", "hidden-items"):
        sub.add_argument(f"--{option}", nargs="*", default=[])
    sub = job("score", "requests", "out", "dims")
    sub.add_argument("--model", action="append", required=True, metavar="KIND=PATH", help="once for each model that requests can name; the first is the default")
    sub = job("stream-score", "raw-path", "out", "model-path", "dims", "state")
    sub.add_argument("--kind", choices=("vit", "cnn", "xgboost"), default="vit")
    sub.add_argument("--keep-running", action="store_true")
    sub.add_argument("--quarantine", action="store_true", help="keep boards that break a rule apart, in valid=false of the output")
    return top


def shown_names(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Units with an icon and items of a written catalog; hidden ones aren't in it, and both are as few as in the dimensions."""
    units = spark.read.parquet(f"{path}/units").filter("has_icon").select("unit")
    items = spark.read.parquet(f"{path}/items").select("item")
    return {"units": [r[0] for r in units.collect()], "items": [r[0] for r in items.collect()]}


def load_scorer(spark: SparkSession, path: str, kind: str) -> score.Scorer:
    """A saved model, with its feature order when it takes columns."""
    model = PipelineModel.load(path)
    columns = kind == "xgboost" and not isinstance(model.stages[0], CountVectorizerModel)
    return score.Scorer(model, kind, tuple(read_feature_order(spark, path)) if columns else ())


def save(trained: train.Trained, spark: SparkSession, path: str) -> None:
    """Model and feature order; metrics go to the log."""
    trained.model.write().overwrite().save(path)
    write_feature_order(spark, trained.features, path)
    trained.metrics.show(truncate=False)
    trained.report.show(truncate=False)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    """Run one parsed job."""
    if args.job in EXTRACTORS:
        EXTRACTORS[args.job](spark, args.raw_path, args.feature_path, Dims.read(spark, args.dims), include_player=not args.short_key, chunk=args.chunk)
    elif args.job == "split-features":
        extract.split_features(spark, args.feature_path, args.out, (args.train_split, args.val_split))
    elif args.job == "train-baseline":
        features = read_features(spark, args.feature_path)
        names = [c for c in features.columns if c not in (*extract.KEYS, "split", "chunk")]
        if "words" in names:
            if not args.dims:
                raise SystemExit("features as words need --dims")
            names = Dims.read(spark, args.dims).wide_names
        trained = train.train_tabular(features, names, test_size=args.test_size, params={"maxIter": args.iterations})
        save(trained, spark, args.model_path)
        print(f"accuracy on the training rows: {trained.train_accuracy}")
        train.top_importances(trained).show(truncate=False)
    elif args.job in ("train-cnn", "train-vit"):
        features = read_features(spark, args.feature_path)
        trained = train.train_board(
            features, trait_ids=args.job == "train-vit", fractions=(args.train_split, args.val_split), augment=args.augment, seed=args.seed,
            decay=args.decay, params={"maxIter": args.iterations, "regParam": args.regularisation},
        )
        save(trained, spark, args.model_path)
        print(f"accuracy on the training rows: {trained.train_accuracy}")
    elif args.job in ("hpo-cnn", "hpo-vit"):
        trials, best = train.search_board(
            read_features(spark, args.feature_path), BOARD_SPACE, n_trials=args.n_trials, seed=args.seed, trait_ids=args.job == "hpo-vit"
        )
        trials.write.mode("overwrite").parquet(args.out)
        best.show(truncate=False)
    elif args.job == "extract-sample-boards":
        raw = read_rounds(spark, args.raw_path).withColumn("_key", F.xxhash64("match_uuid", "player_uuid", "round_name", "timestamp", "board_data"))
        shown = shown_names(spark, args.catalog) if args.catalog else {}
        boards = sample_boards(
            raw, Dims.read(spark, args.dims), key="_key", per_stage=args.per_stage, min_units=args.min_units, seed=args.seed, **shown
        )
        write_sample_boards(boards, args.out)
    elif args.job == "build-dims":
        built_dims(read_set(spark, args.metadata, args.set), Dims.read(spark, args.dims) if args.dims else None).write(spark, args.out)
    elif args.job == "build-catalog":
        tables = build_catalog(
            spark, Dims.read(spark, args.dims), read_set(spark, args.metadata, args.set), read_items(spark, args.metadata), set_prefix=args.set_prefix,
            hidden_units=args.hidden_units, special_units=args.special_units, hidden_items=args.hidden_items,
        )
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{args.out}/{name}")
    elif args.job == "score":
        models = {kind: load_scorer(spark, path, kind) for kind, _, path in (model.partition("=") for model in args.model)}
        scored, rejected = score.score_requests(read_requests(spark, args.requests), models, Dims.read(spark, args.dims))
        scored.write.mode("overwrite").parquet(args.out)
        rejected.select("request_id", "violations").write.mode("overwrite").parquet(args.out + "_rejected")
    else:
        scorer = load_scorer(spark, args.model_path, args.kind)
        query = (stream_checked if args.quarantine else stream_score)(
            spark, args.raw_path, args.out, args.state, scorer, Dims.read(spark, args.dims), once=not args.keep_running
        )
        query.awaitTermination()


def main(argv: list[str] | None = None) -> None:
    """Parse the command line and run the job."""
    args = parser().parse_args(argv)
    run(get_spark(f"roundhouse {args.job}"), args)


if __name__ == "__main__":
    main()
