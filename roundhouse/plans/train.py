"""Training, evaluation and hyper-parameter search with Spark ML."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, HashingTF, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundhouse.dims import local_frame
from roundhouse.functions.arrays import let, literal_array, rotate_board, swap_halves
from roundhouse.operators.assemble import quoted
from roundhouse.operators.augment import augment_sides, with_recency_weight
from roundhouse.operators.metrics import best_trial, brier, class_report, log_loss, roc_auc
from roundhouse.operators.split import chrono_split, with_tie
from roundhouse.plans import boosting
from roundhouse.schema import CELLS, CHANNELS
from roundhouse.session import materialise, stored

LABEL = "outcome"


@dataclass
class Trained:
    """A fitted model, what it was measured at, and what it takes in."""

    model: PipelineModel
    metrics: DataFrame
    report: DataFrame
    features: list[str]
    train_accuracy: float | None = None


def short_names(names: Sequence[str]) -> list[str]:
    """Column names free of dots and blanks for the assembler; the real names stay in the feature order."""
    return [f"f{place}" for place in range(len(names))]


def probability(model_output: DataFrame) -> Column:
    """Probability of class 1."""
    return vector_to_array(F.col("probability"))[1]


def evaluate(predicted: DataFrame, *, label: str = LABEL, score: str = "score") -> tuple[DataFrame, DataFrame]:
    """``metric, value`` and the class report of scored rows. Scores are materialised once, two numbers per row."""
    scored = materialise(predicted.select(F.col(label).cast("double").alias(label), F.col(score).cast("double").alias(score)))
    decided = scored.withColumn("prediction", (F.col(score) > 0.5).cast("int")).withColumn(label, F.col(label).cast("int"))
    report = class_report(decided, label, "prediction")
    values = [
        roc_auc(scored, label, score).select(F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value")),
        report.filter(F.col("class") == "accuracy").select(F.lit("accuracy").alias("metric"), F.col("f1").alias("value")),
        log_loss(scored, label, score).select(F.lit("log_loss").alias("metric"), F.col("log_loss").alias("value")),
        brier(scored, label, score).select(F.lit("brier").alias("metric"), F.col("brier").alias("value")),
    ]
    metrics = values[0]
    for value in values[1:]:
        metrics = metrics.unionByName(value)
    return metrics, report


def split_rows_of(features: DataFrame, fractions: Sequence[float], key: str) -> DataFrame:
    """The features with their ``split``: the one they were written with, else one made now."""
    if "split" in features.columns:
        return features
    return chrono_split(with_tie(features, key), "timestamp", "_tie", fractions).drop("_tie")


def wide_stages(features: DataFrame, names: Sequence[str]) -> list:
    """Pipeline stages that make the feature vector, in the order of ``names``: a sparse one of words, or one of columns."""
    if "words" in features.columns:
        counts = CountVectorizerModel.from_vocabulary(list(names[:-2]), inputCol="words", outputCol="counts")
        return [counts, VectorAssembler(inputCols=["counts", *names[-2:]], outputCol="features")]
    return [VectorAssembler(inputCols=short_names(names), outputCol="features")]


def train_tabular(
    features: DataFrame, names: Sequence[str], *, test_size: float = 0.2, params: Mapping | None = None, key: str = "round_idx"
) -> Trained:
    """Gradient-boosted trees: oldest rounds train, newest test; the accuracy on the training rows is told too.

    ``features`` has the wide columns, or ``words`` and the two costs, which go into a sparse vector in the order of ``names``.
    Rows that have a ``split`` keep it; those of ``val`` take no part.
    """
    kept = [c for c in dict.fromkeys(("split", "timestamp", key)) if c in features.columns]
    packed = valued(features, names).select(F.col(LABEL).cast("double").alias(LABEL), *kept, VALUES)
    rows = split_rows_of(stored(packed), (1.0 - test_size,), key)
    boosted = GBTClassifier(labelCol=LABEL, featuresCol="features", seed=0, **{"maxIter": 20, "maxDepth": 5, **(params or {})})
    fit, test = (rows.filter(F.col("split") == name) for name in ("train", "test"))
    known = {p.name for p in boosted.extractParamMap() if boosted.isSet(p)} <= set(boosting.PARAMS)
    if known and fit.count() * len(names) > boosting.SMALL_CELLS:
        trees = boosting.fit_boosted(fit, LABEL, VALUES, key if key in kept else VALUES, len(names), boosted)
    else:
        trees = boosted.fit(with_vector(fit))
    scored = trees.transform(with_vector(test))
    metrics, report = evaluate(scored.select(LABEL, probability(scored).alias("score")))
    model = PipelineModel([*wide_stages(features, names), trees])
    return Trained(model, metrics, report, list(names), train_accuracy(trees, with_vector(fit)))


VALUES = "_values"


def valued(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows with all features as one array in the order of ``names``, of whole numbers where all columns are."""
    if "words" in features.columns:
        return PipelineModel(wide_stages(features, names)).transform(features).withColumn(VALUES, vector_to_array("features"))
    kinds = dict(features.dtypes)
    kind = "int" if all(kinds[name] in ("tinyint", "smallint", "int") for name in names) else "double"
    each = ", ".join(f"cast({quoted(name)} AS {kind})" for name in names)
    return features.selectExpr(*[quoted(c) for c in features.columns if c not in set(names)], f"array({each}) AS {VALUES}")


def with_vector(rows: DataFrame) -> DataFrame:
    """Label and features as Spark ML's vector."""
    return rows.select(LABEL, array_to_vector(F.col(VALUES).cast("array<double>")).alias("features"))


def train_accuracy(model: PipelineModel, rows: DataFrame) -> float | None:
    """Share of the rows that a model trained on them gets right."""
    return model.transform(rows).agg(F.avg((F.col("prediction") == F.col(LABEL)).cast("double"))).first()[0]


def top_importances(trained: Trained, k: int = 10) -> DataFrame:
    """The ``k`` most important features of a tree model."""
    weights = trained.model.stages[-1].featureImportances.toArray().tolist()
    rows = [{"feature": name, "importance": weight} for name, weight in zip(trained.features, weights)]
    frame = local_frame(trained.metrics.sparkSession, rows, [("feature", pa.string()), ("importance", pa.float64())])
    return frame.orderBy(F.col("importance").desc(), "feature").limit(k)


def board_tokens(tensor: Column, traits: Column, *, trait_ids: bool) -> Column:
    """A board as words: what stands on which cell at which tier with which items, and which traits each side has.

    Hashed to a sparse vector they are one-hot features, without a wide column per cell and value. With ``trait_ids`` the
    second input holds ids, else flags.
    """

    starts = literal_array([f"{channel}:{place}:" for channel in CHANNELS for place in range(CELLS)], "string")

    def trait(v: Column, place: Column, half: Column) -> Column:
        side = F.when(place < half, "p").otherwise("o")
        what = v if trait_ids else place
        return F.when(v != 0, F.concat(F.lit("trait:"), side, F.lit(":"), what.cast("string")))

    boards = F.zip_with(tensor, starts, lambda v, start: F.when(v != 0, F.concat(start, v.cast("string"))))
    # traits may be an expression, which would be made again for each of them
    flags = let(traits, lambda given: F.transform(given, lambda v, place: trait(v, place, F.size(given) / 2)))
    return F.concat(F.array_compact(boards), F.array_compact(flags))


def both_words(rows: DataFrame, *, trait_ids: bool) -> DataFrame:
    """The rows with the words of each board as it is and as the other side sees it, in place of tensor and traits."""
    tensor, traits = F.col("tensor"), F.col("traits")
    seen = board_tokens(tensor, traits, trait_ids=trait_ids)
    other = board_tokens(rotate_board(tensor, len(CHANNELS)), swap_halves(traits), trait_ids=trait_ids)
    return rows.select(*[c for c in rows.columns if c not in ("tensor", "traits")], seen.alias("words"), other.alias("swapped_words"))


def train_board(
    features: DataFrame,
    *,
    trait_ids: bool,
    fractions: Sequence[float] = (0.8, 0.1),
    augment: float = 0.5,
    seed: int = 0,
    decay: float | None = None,
    params: Mapping | None = None,
    width: int = 1 << 16,
    key: str = "round_idx",
    split_rows: DataFrame | None = None,
    measured: str = "test",
) -> Trained:
    """Logistic regression on hashed board words, with side-swap augmentation of the train split.

    ``decay`` weights rounds by recency when the features hold ``patch_id``. This stands in for an image network: it trains
    on any cluster, and is not expected to reach its scores. ``split_rows`` may hold :func:`both_words` in place of tensor and traits.
    """
    rows = split_rows if split_rows is not None else split_rows_of(features, fractions, key)
    rows = rows.filter(F.col("split").isin("train", measured))
    told = "swapped_words" in rows.columns
    if augment > 0:
        made = {"tensor": None, "traits": None, "words": "swapped_words"} if told else {}
        rows = augment_sides(rows, key, prob=augment, seed=seed, where=F.col("split") == "train", **made)
    weights = {}
    if decay is not None:
        rows, weights = with_recency_weight(rows, "patch_id", decay=decay), {"weightCol": "weight"}
    kept = [c for c in ("weight", "split") if c in rows.columns]
    words = F.col("words") if told else board_tokens(F.col("tensor"), F.col("traits"), trait_ids=trait_ids)
    words = rows.select(F.col(LABEL).cast("double").alias(LABEL), *kept, words.alias("words"))
    words = words if told else stored(words)
    hashing = HashingTF(inputCol="words", outputCol="features", numFeatures=width, binary=True)
    options = {"maxIter": 30, "regParam": 0.01, **(params or {})}
    model = Pipeline(stages=[hashing, LogisticRegression(labelCol=LABEL, **weights, **options)]).fit(words.filter("split = 'train'"))
    scored = model.transform(words.filter(F.col("split") == measured))
    metrics, report = evaluate(scored.select(LABEL, probability(scored).alias("score")))
    fitted = train_accuracy(model, words.filter("split = 'train'"))
    return Trained(model, metrics, report, ["words"], fitted)


# -- search ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Choice:
    """One of several values."""

    values: tuple

    def draw(self, rng: random.Random) -> object:
        return rng.choice(self.values)


@dataclass(frozen=True)
class Uniform:
    """A number between two bounds, evenly or on a log scale, optionally on a grid of ``step`` from ``low``."""

    low: float
    high: float
    log: bool = False
    step: float | None = None

    def draw(self, rng: random.Random) -> float:
        if self.log:
            return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))
        if self.step:
            return self.low + self.step * rng.randint(0, int((self.high - self.low) / self.step + 1e-9))
        return rng.uniform(self.low, self.high)


def draw_trials(space: Mapping[str, Choice | Uniform], n_trials: int, seed: int) -> list[dict]:
    """``n_trials`` parameter sets, the same for the same seed."""
    rng = random.Random(seed)
    return [{name: kind.draw(rng) for name, kind in space.items()} for _ in range(n_trials)]


def search(
    spark, space: Mapping[str, Choice | Uniform], n_trials: int, seed: int, loss: Callable[[dict], float], *, parallelism: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Seeded random search: all trials as a table, and the best one. Trials are independent Spark jobs run side by side."""
    trials = draw_trials(space, n_trials, seed)
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        losses = list(pool.map(loss, trials))
    rows = [
        {"trial": number, "loss": float(value), "params": {k: str(v) for k, v in params.items()}}
        for number, (params, value) in enumerate(zip(trials, losses))
    ]
    table = spark.createDataFrame(rows, "trial int, loss double, params map<string,string>")
    return table, best_trial(table)


def search_board(
    features: DataFrame,
    space: Mapping[str, Choice | Uniform],
    *,
    n_trials: int,
    seed: int = 0,
    trait_ids: bool = True,
    parallelism: int = 2,
    key: str = "round_idx",
) -> tuple[DataFrame, DataFrame]:
    """Search the board model's parameters; each trial is measured by its log-loss on the validation split."""
    rows = split_rows_of(features, (0.8, 0.1), key).filter("split <> 'test'")
    rows = stored(both_words(rows, trait_ids=trait_ids))

    def loss(params: dict) -> float:
        options = dict(params)
        augment, width = options.pop("augment", 0.5), int(options.pop("width", 1 << 14))
        trained = train_board(
            features, trait_ids=trait_ids, augment=augment, seed=seed, params=options, width=width, key=key, split_rows=rows, measured="val"
        )
        return trained.metrics.filter("metric = 'log_loss'").first()["value"]

    return search(features.sparkSession, space, n_trials, seed, loss, parallelism=parallelism)
