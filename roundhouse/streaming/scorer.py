"""Score raw rounds as their files arrive.

Encoding, checks and scoring are row expressions, so the stream is stateless: no watermark, no state store, no ``foreachBatch``, and a
file goes through exactly the expressions a batch would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roundhouse.dims import Dims
from roundhouse.functions.board import BoardEncoder
from roundhouse.operators.rounds import usable_rounds
from roundhouse.operators.validate import validate_rounds
from roundhouse.plans.score import Scorer
from roundhouse.schema import ROUNDS

ROUND_ID = ("match_uuid", "player_uuid", "round_name", "timestamp")


def score_rounds(rounds: DataFrame, scorer: Scorer, dims: Dims) -> DataFrame:
    """Usable rounds with win probability and verdict; the same for a batch and a stream."""
    boards = usable_rounds(rounds).select(*ROUND_ID, "board_data.*")
    return scorer.score(boards, BoardEncoder(dims))


def read_round_stream(spark: SparkSession, source: str, *, max_files: int | None = None) -> DataFrame:
    """New Parquet files of raw rounds as a stream."""
    reader = spark.readStream.schema(ROUNDS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(source)


def stream_score(
    spark: SparkSession, source: str, target: str, state: str, scorer: Scorer, dims: Dims, *, max_files: int | None = None, once: bool = True
) -> StreamingQuery:
    """Start scoring ``source`` into Parquet at ``target``; ``state`` is the checkpoint folder on shared storage.

    With ``once`` it takes what is there and stops, else it keeps running.
    """
    scored = score_rounds(read_round_stream(spark, source, max_files=max_files), scorer, dims)
    writer = scored.withColumn("scored_at", F.current_timestamp()).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", target).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer).start()


def checked_rounds(rounds: DataFrame, scorer: Scorer, dims: Dims) -> DataFrame:
    """Usable rounds with ``violations`` and ``valid``; only valid ones have a probability and a verdict."""
    checked = validate_rounds(usable_rounds(rounds)).select(*ROUND_ID, "violations", "valid", "board_data.*")
    told = scorer.score(checked, BoardEncoder(dims), where=F.col("valid"))
    return told.withColumns({c: F.when(F.col("valid"), F.col(c)) for c in ("win_probability", "prediction")})


def stream_checked(
    spark: SparkSession, source: str, target: str, state: str, scorer: Scorer, dims: Dims, *, max_files: int | None = None, once: bool = True
) -> StreamingQuery:
    """Like :func:`stream_score`, but boards that break a rule are kept apart instead of scored.

    Both outcomes are one sink, in the folders ``valid=true`` (scores) and ``valid=false`` (quarantine, with ``violations``) of ``target``: a
    batch is committed as a whole, so no round is in neither or both, and a batch that is run again after a crash is known by its number
    and writes nothing twice. Readers go through :func:`read_scores` and :func:`read_quarantine`, which open their folder only.
    """
    told = checked_rounds(read_round_stream(spark, source, max_files=max_files), scorer, dims)
    writer = told.withColumn("scored_at", F.current_timestamp()).writeStream.format("parquet").outputMode("append").partitionBy("valid")
    writer = writer.option("path", target).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_scores(spark: SparkSession, target: str) -> DataFrame:
    """Scored rounds of :func:`stream_checked`."""
    return spark.read.parquet(target).filter(F.col("valid").cast("string") == "true").drop("valid", "violations")


def read_quarantine(spark: SparkSession, target: str) -> DataFrame:
    """Rejected rounds of :func:`stream_checked` with the rules they break."""
    return spark.read.parquet(target).filter(F.col("valid").cast("string") == "false").drop("valid", "win_probability", "prediction")
