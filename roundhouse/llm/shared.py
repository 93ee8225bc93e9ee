"""What the operators share: tables in the cluster's shared folder, and safe column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: rows and bytes of text that a Python task is handed at a time, unless the session says otherwise; long texts make small batches
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, "8m")}
_LOCAL: dict[str, str] = {}
_OPENED: ContextVar[list[Scratch] | None] = ContextVar("opened", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a session on one machine may do without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='llm-')}")


def bound_batches(spark: SparkSession) -> None:
    """Set the limits that the session leaves at Spark's defaults."""
    for name, (default, limit) in BATCH_LIMITS.items():
        if spark.sparkContext.getConf().get(name) is None and spark.conf.get(name, None) in (default, None, "67108864", "64m", "64MB", "9223372036854775807", "9223372036854775807b", "-1"):
            spark.conf.set(name, limit)


class Scratch:
    """Intermediate tables of one call. Each is written once and read back, so later steps neither repeat nor depend on lost executors.

    Rows that were numbered by their place in a task are safe once written: readers see one attempt of each task.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        bound_batches(spark)
        if _OPENED.get() is not None:
            _OPENED.get().append(self)

    def path(self) -> str:
        self.count += 1
        return f"{self.folder}/{self.count}"

    def save(self, frame: DataFrame) -> DataFrame:
        path = self.path()
        frame.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def again(self, frame: DataFrame) -> DataFrame:
        """A written table read anew, with columns of its own."""
        return self.spark.read.schema(frame.schema).parquet(*{file.rsplit("/", 1)[0] for file in frame.inputFiles()})

    def drop(self, *frames: DataFrame) -> None:
        """Delete written tables that no later step reads."""
        for frame in frames:
            for path in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
                if f"/{self.folder.rsplit('/', 1)[1]}/" in path:
                    self.delete(path)

    def clear(self) -> None:
        """Delete all tables of the call; what is made of them must have been written."""
        self.delete(self.folder)

    def delete(self, path: str) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def cleared() -> Iterator[None]:
    """Delete the tables of all calls made inside when it ends; results that are still wanted must have been written elsewhere by then."""
    opened: list[Scratch] = []
    before = _OPENED.set(opened)
    try:
        yield
    finally:
        _OPENED.reset(before)
        for scratch in opened:
            scratch.clear()


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names like the given ones that a table doesn't have; Spark compares names without case."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        k = 0
        while (found := f"{name}_{k}" if k else name).lower() in used:
            k += 1
        used.add(found.lower())
        out.append(found)
    return out
