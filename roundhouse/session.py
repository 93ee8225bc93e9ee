"""Session helper and the one place that decides where intermediate results are persisted."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
ROWS_A_TASK = 200_000  # rounds with their boards that one task sorts


def get_spark(app: str = "roundhouse", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session; cluster settings such as master come from ``spark-submit`` unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for name, value in {**settings, **(conf or {})}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder: the cluster's own when set, a throw-away one in local mode only."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="roundhouse-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def tasks_for(spark: SparkSession, rows: int, rows_a_task: int = ROWS_A_TASK) -> int | None:
    """How many tasks ``rows`` are dealt to so that none gets much more than ``rows_a_task``, or None where the session's own number does.

    The session's number of shuffle partitions is fixed, so without this the memory of a task grows with the input.
    """
    needed = -(-rows // rows_a_task)
    return needed if needed > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def stored(df: DataFrame, options: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` as Parquet files in the shared checkpoint folder: for rows read several times, of which a reader opens only its columns.

    Wide or wordy rows take a small part of the room that a cache or a checkpoint of them takes.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written copy.

    Row ids that depend on the physical order are only stable once they are written: a lost executor would
    otherwise recompute them from a reshuffled input.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
