"""Queries on jobs: extraction into stored feature tables, unions of sources, scoring of rounds, requests and streams.

Rounds and features are written to the folder that driver and executors share, and read back as the jobs do.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from roundhouse.functions.scalars import sigmoid
from roundhouse.operators import assemble
from roundhouse.plans import extract, score
from roundhouse.session import ensure_checkpoint_dir
from roundhouse.sources.features import read_feature_order, read_features, write_feature_order
from roundhouse.sources.rounds import union_rounds
from roundhouse.streaming.scorer import ROUND_ID, score_rounds, stream_score
from testbed import adapter
from testbed.adapter import dims
from testbed.queries_rounds import INSTANCE_SQL, requests
from testbed.queries_units import COST, SLOT_NAMES
from testbed.queries_vectors import NIDS, NRECORDS, TENSOR, WIDE, wide_ctes
from testbed.registry import COL_SQL, COPIES, FLAT, NENRICHED, NESTED, REACHED, ROW_SQL, query

NAMED = f""", named AS (SELECT round_key, concat(match_uuid, '_', player_uuid, '_', round_name, '_', round_instance) AS round_idx FROM ({INSTANCE_SQL}))"""
KEYED = "round_idx, cast(outcome AS bigint) AS outcome, ts AS timestamp"
TENSORS = TENSOR.replace("{usable}", "nusable")


def folder(spark) -> str:
    """A new folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/jobs-{uuid.uuid4().hex}"


def stored_rounds(spark, d) -> str:
    """The nested rounds as raw files."""
    path = f"{folder(spark)}/rounds"
    adapter.nested_rounds(spark, d).drop("round_key").write.parquet(path)
    return path


def extracted(spark, d, job):
    """What an extraction job wrote, read back, and where."""
    raw = stored_rounds(spark, d)
    job(spark, raw, f"{raw}-features", dims())
    return read_features(spark, f"{raw}-features").withColumn("outcome", F.col("outcome").cast("bigint")), f"{raw}-features"


@query(
    "extract_baseline_job",
    f"""{NESTED}{NENRICHED}{COPIES}{REACHED.format(counts='copies')}{wide_ctes('nusable')}{NAMED}
    SELECT {KEYED}, wide.* EXCLUDE (round_key) FROM wide JOIN nusable USING (round_key) JOIN named USING (round_key)""",
)
def extract_baseline_job(spark, d):
    """The columns of the table that aren't keys, in the order kept beside it."""
    features, path = extracted(spark, d, extract.extract_baseline_features)
    write_feature_order(spark, [c for c in features.columns if c not in extract.KEYS], path)
    names = read_feature_order(spark, path)
    shown = assemble.reindex(features, names, extract.KEYS)
    return shown.selectExpr(*extract.KEYS, *[f"cast(`{c}` AS bigint) AS `{c}`" for c in WIDE])


@query(
    "extract_cnn_job",
    f"""{NRECORDS}{TENSORS}{NENRICHED}{COPIES}{REACHED.format(counts='copies')}, onehot AS (SELECT round_key, concat_ws(',', """
    + ", ".join(f"coalesce(max(CASE WHEN reached.team = '{t}' AND trait = '{n}' AND level = {v} THEN 1 END), 0)" for c, t, n, v in SLOT_NAMES)
    + f""") AS traits FROM nusable LEFT JOIN reached USING (round_key) GROUP BY round_key){NAMED}
    SELECT {KEYED}, tensor, traits FROM nusable JOIN tensor USING (round_key) JOIN onehot USING (round_key) JOIN named USING (round_key)""",
)
def extract_cnn_job(spark, d):
    features, _ = extracted(spark, d, extract.extract_cnn_features)
    return features.select(*extract.KEYS, *[F.array_join(c, ",").alias(c) for c in ("tensor", "traits")])


@query(
    "extract_vit_job",
    f"""{NRECORDS}{TENSORS}{NIDS}{NAMED}
    SELECT {KEYED}, tensor, trait_ids AS traits,
      cast(coalesce((SELECT max(patch_id) FROM patch_dim p WHERE p.release_ts <= ts), 0) AS bigint) AS patch_id
    FROM nusable JOIN tensor USING (round_key) JOIN ids USING (round_key) JOIN named USING (round_key)""",
)
def extract_vit_job(spark, d):
    features, _ = extracted(spark, d, extract.extract_vit_features)
    return features.select(*extract.KEYS, *[F.array_join(c, ",").alias(c) for c in ("tensor", "traits")], F.col("patch_id").cast("bigint").alias("patch_id"))


@query(
    "union_rounds",
    f"""{FLAT} SELECT round_key, match_uuid, ts AS timestamp, CASE WHEN round_key % 3 = 0 THEN NULL ELSE round_outcome END AS round_outcome FROM rounds""",
)
def union_sources(spark, d):
    rows = adapter.rounds(spark, d).select("round_key", "match_uuid", "timestamp", "round_outcome")
    return union_rounds([rows.filter("round_key % 3 > 0"), rows.filter("round_key % 3 = 0").drop("round_outcome")])


# -- scoring by a stated formula, so that SQL can say the same -----------------------------------------------------------


@dataclass(frozen=True)
class CostModel:
    """Probability from the difference of the team costs; stands where a fitted pipeline does."""

    scale: float

    def transform(self, rows):
        player, opponent = rows.columns[-2:]
        p = sigmoid((F.col(player) - F.col(opponent)) / self.scale)
        return rows.withColumn("probability", array_to_vector(F.array(1 - p, p)))


def scorer(scale: float) -> score.Scorer:
    return score.Scorer(CostModel(scale), "xgboost", ("player_total_cost", "opponent_total_cost"))


SCALES = {"vit": 20.0, "cnn": 10.0, "XGBoost": 40.0}
CHANCE = "1 / (1 + exp(-(player_total_cost - opponent_total_cost) / {scale}))"
SCORED = "round({p}, 9) AS win_probability, CASE WHEN {p} >= 0.5 THEN 'victory' ELSE 'defeat' END AS prediction"
SUMS = ", ".join(f"coalesce(sum(CASE WHEN team = '{t}' THEN {COST} END), 0) AS {t}_total_cost" for t in ("player", "opponent"))
ROUND_SCORES = f"""{NESTED}{NENRICHED}, costs AS (SELECT round_key, {SUMS} FROM enriched GROUP BY round_key)
    SELECT match_uuid, player_uuid, round_name, ts AS timestamp, {SCORED.format(p=CHANCE.format(scale=20.0))} FROM nusable JOIN costs USING (round_key)"""


def rounded(scores):
    return scores.withColumn("win_probability", F.round("win_probability", 9))


@query("score_rounds", ROUND_SCORES)
def scored_rounds(spark, d):
    return rounded(score_rounds(adapter.nested_rounds(spark, d), scorer(20.0), dims()))


@query("stream_score", ROUND_SCORES)
def streamed(spark, d):
    """The raw files as a stream, a few at a time, and what the stream wrote."""
    raw = stored_rounds(spark, d)
    stream_score(spark, raw, f"{raw}-scores", f"{raw}-state", scorer(20.0), dims(), max_files=4).awaitTermination()
    return rounded(spark.read.parquet(f"{raw}-scores").select(*ROUND_ID, "win_probability", "prediction"))


@query(
    "score_requests",
    f"""{NESTED}, placed AS (SELECT n.*, {ROW_SQL} AS r, {COL_SQL} AS c FROM nunits n),
    bad AS (SELECT round_key FROM placed WHERE coalesce(tier, 1) NOT BETWEEN 1 AND 4 OR r NOT BETWEEN 0 AND 3 OR c NOT BETWEEN 0 AND 6),
    sent AS (SELECT round_key, team, cost, coalesce(tier, 1) AS tier FROM nunits LEFT JOIN unit_dim USING (unit)),
    costs AS (SELECT round_key, {SUMS} FROM sent GROUP BY round_key),
    asked AS (
      SELECT round_key, CASE round_key % 4 WHEN 0 THEN 'vit' WHEN 1 THEN 'cnn' ELSE 'xgboost' END AS model,
        CASE round_key % 4 WHEN 0 THEN 20.0 WHEN 1 THEN 10.0 ELSE 40.0 END AS scale,
        coalesce(player_total_cost, 0) AS player_total_cost, coalesce(opponent_total_cost, 0) AS opponent_total_cost
      FROM rounds LEFT JOIN costs USING (round_key) WHERE round_key % 4 <> 3 AND round_key NOT IN (SELECT round_key FROM bad))
    SELECT round_key, model, {SCORED.format(p=CHANCE.format(scale='scale'))} FROM asked""",
)
def scored_requests(spark, d):
    """Requests sent to the model that each names, in any case; a unit sent without a tier has tier 1."""
    models = {name: scorer(scale) for name, scale in SCALES.items()}
    return rounded(score.score_requests(requests(spark, d), models, dims())[0])
