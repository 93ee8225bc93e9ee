"""Feature tables on storage: one keyed Parquet table per feature family, sorted by time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundhouse.session import tasks_for

ORDER_SUFFIX = "_columns"


def write_features(
    df: DataFrame,
    path: str,
    *,
    ts: str = "timestamp",
    key: str = "round_idx",
    split: str | None = None,
    replace: bool = True,
    encode: Callable[[DataFrame], DataFrame] | None = None,
    rows: int = 0,
) -> None:
    """Range-partition by time and sort inside each file, so that a time range or a split is a run of few files.

    With ``split`` the table is also partitioned by that column and readers of one split open its files only; without ``replace``
    the folders of other values stay as they are. ``encode`` makes the features row by row, behind the sort: the ranges take a pass over
    the rows for a sample, and what is sampled, moved and sorted is then smaller. With ``rows``, at least how many there are, the
    number of ranges grows with them.
    """
    leading = [split] if split else []
    parts = tasks_for(df.sparkSession, rows)
    ranged = df.repartitionByRange(parts, *leading, ts, key) if parts else df.repartitionByRange(*leading, ts, key)
    ordered = ranged.sortWithinPartitions(*leading, ts, key)
    writer = (encode(ordered) if encode else ordered).write.mode("overwrite").option("partitionOverwriteMode", "static" if replace else "dynamic")
    (writer.partitionBy(split) if split else writer).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A feature table."""
    return spark.read.parquet(path)


def write_feature_order(spark: SparkSession, names: Sequence[str], path: str) -> None:
    """The ordered feature names a model was trained on, as ``(pos, name)`` beside the model."""
    rows = spark.createDataFrame([(pos, name) for pos, name in enumerate(names)], "pos int, name string")
    rows.coalesce(1).write.mode("overwrite").json(path + ORDER_SUFFIX)


def read_feature_order(spark: SparkSession, path: str) -> list[str]:
    """Feature names in training order; as many as the model has inputs."""
    rows = spark.read.schema("pos int, name string").json(path + ORDER_SUFFIX).orderBy("pos")
    return [row["name"] for row in rows.select("name", F.col("pos")).collect()]
