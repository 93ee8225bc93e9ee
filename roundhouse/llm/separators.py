"""Token counts from flat, unindexed token files: find end-of-document ids block by block and stitch the blocks.

The files are one stream in the order of the manifest. Blocks of a fixed size are searched with one vectorised comparison each; a
block reports its separators and a summary. A prefix scan over the summaries (within each file by a window, over the files on one row
for each file) gives every block the ids before it, the documents ended before it and where the open document began, so documents may
run over any number of blocks and files.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roundhouse.llm.shared import Scratch
from roundhouse.llm.tokenfiles import create, own_path, read_range
from roundhouse.llm.tokens import encoder

BLOCK_IDS = 1 << 20
BLOCKS_PER_TASK = 32
BATCH = 256
FOUND = pa.schema([("part", pa.int64()), ("path", pa.string()), ("begin", pa.int64()), ("n", pa.int64()), ("found", pa.binary()), ("seps", pa.int64()), ("last", pa.int64())])
LABELS = pa.schema([("part", pa.int32()), ("k", pa.int64()), ("path", pa.string()), ("n_ids", pa.int64())])


def write_flat(docs: DataFrame, folder: str, tokenizer: str, end_id: int, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write one flat file for each task and return a written table ``doc_id, part, k, path, n_ids`` of what went where.

    ``k`` numbers the documents of a task; ``n_ids`` is on a task's last row (else null) and counts the ids of its file. Null text
    counts as empty and writes the end id alone. Special tokens' strings in a text are text, so no id of a text imitates a separator. Ids must
    fit the dtype.
    """
    limit = np.iinfo(dtype).max
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, k, total, path, last = None, 0, 0, "", None
        part, end = TaskContext.get().partitionId(), int(end_id).to_bytes(4, "little")

        def rows(ids: pa.Array, first: int, n_ids: int | None) -> pa.RecordBatch:
            n = len(ids)
            return pa.RecordBatch.from_arrays([ids, pa.array([part] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), pa.array([path] * n, pa.string()), pa.array([None] * (n - 1) + [n_ids], pa.int64())], names=["doc_id", *LABELS.names])

        for whole in batches:
            encoded = encoder(tokenizer, plain=True).encode(whole.column(1).to_pylist())
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                if out is None:
                    path = own_path(folder, ".ids")
                    out = create(path)
                ids = np.frombuffer(b"".join(b + end for b in islice(encoded, BATCH)), "<u4")
                if ids.max() > limit:
                    raise ValueError(f"ids up to {ids.max()} don't fit {dtype}")
                out.write(ids.astype(dtype).tobytes())
                total += len(ids)
                if last is not None:
                    yield rows(*last, None)
                last = (batch.column(0), k)
                k += batch.num_rows
        if out is not None:
            out.close()
            yield rows(*last, total)

    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, part int, k bigint, path string, n_ids bigint")
    return Scratch(docs.sparkSession, "flat").save(found)


def scan(spark: SparkSession, files: pd.DataFrame, separator: int, dtype: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Rows ``doc_no, start, n_tokens, ended`` of the stream of all files (``path, n_ids``, in order).

    ``n_tokens`` counts the separator that ends a document; ids behind the last separator are a document with ``ended`` false. Files
    may be empty, and empty documents (a separator after a separator) count. No files: no rows.
    """
    width = np.dtype(dtype).itemsize
    listed = pd.DataFrame({"part": np.arange(len(files), dtype="int64"), "path": files["path"].astype(str), "n_ids": files["n_ids"].astype("int64")})
    table = spark.createDataFrame(listed, "part bigint, path string, n_ids bigint")
    begins = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("n_ids") - 1, F.lit(0)), F.lit(block_ids).cast("bigint")))
    blocks = table.where("n_ids > 0").select("part", "path", begins.alias("begin"), "n_ids")
    n_blocks = max(1, int((-(-listed["n_ids"] // block_ids)).sum()))
    tasks = max(-(-n_blocks // BLOCKS_PER_TASK), min(n_blocks, spark.sparkContext.defaultParallelism))
    blocks = blocks.select("part", "path", "begin", F.least(F.lit(block_ids), F.col("n_ids") - F.col("begin")).cast("bigint").alias("n")).repartition(tasks)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(read_range(row["path"], row["begin"] * width, row["n"] * width), dtype)
                if len(ids) != row["n"]:
                    raise ValueError(f"{row['path']} is shorter than its manifest says")
                found = np.flatnonzero(ids == separator).astype("<i8")
                yield pa.RecordBatch.from_pylist([row | {"found": found.tobytes(), "seps": len(found), "last": int(found[-1]) if len(found) else None}], schema=FOUND)

    searched = Scratch(spark, "separators").save(blocks.mapInArrow(find, "part bigint, path string, begin bigint, n bigint, found binary, seps bigint, last bigint"))
    sums = searched.groupBy("part").agg(F.sum("n").alias("n"), F.sum("seps").alias("seps"), F.max(F.col("begin") + F.col("last")).alias("last"))
    by_file = listed[["part"]].merge(sums.toPandas(), "left", "part").fillna({"n": 0, "seps": 0})
    offset = (by_file["n"].cumsum() - by_file["n"]).astype("int64")
    ends = (offset + by_file["last"] + 1).cummax().ffill()  # where the document begins that is open after each file
    total, final = int(by_file["n"].sum()), int(ends.dropna().iloc[-1]) if ends.notna().any() else 0
    carried = pd.DataFrame({"part": by_file["part"], "offset": offset, "docs": (by_file["seps"].cumsum() - by_file["seps"]).astype("int64"), "open": ends.shift().fillna(0).astype("int64")})
    earlier = Window.partitionBy("part").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (
        searched.join(F.broadcast(spark.createDataFrame(carried, "part bigint, offset bigint, docs bigint, open bigint")), "part")
        .withColumn("first_doc", F.col("docs") + F.coalesce(F.sum("seps").over(earlier), F.lit(0)))
        .withColumn("open", F.coalesce(F.col("offset") + F.max(F.col("begin") + F.col("last")).over(earlier) + 1, F.col("open")))
        .select("first_doc", "open", (F.col("offset") + F.col("begin")).alias("at"), "found")
        .where(F.length("found") > 0)
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.frombuffer(row["found"], "<i8") + row["at"] + 1
                starts = np.append(row["open"], ends[:-1])
                numbers = np.arange(row["first_doc"], row["first_doc"] + len(ends), dtype="i8")
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(np.ones(len(ends), bool))], names=["doc_no", "start", "n_tokens", "ended"])

    out = stitched.mapInArrow(split, "doc_no bigint, start bigint, n_tokens bigint, ended boolean")
    if total > final:
        out = out.unionAll(spark.createDataFrame([(int(by_file["seps"].sum()), final, total - final, False)], out.schema))
    return out


def count_documents(docs: DataFrame, folder: str, tokenizer: str, end_id: int, dtype: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    """``doc_id, doc_no, start, n_tokens`` of every document: written flat, counted by the scan alone, then named by its place."""
    spark = docs.sparkSession
    labels = write_flat(docs, folder, tokenizer, end_id, dtype)
    by_task = labels.groupBy("part").agg(F.max("path").alias("path"), F.max("n_ids").alias("n_ids"), F.count("*").alias("docs")).orderBy("part").toPandas()
    offsets = pd.DataFrame({"part": by_task["part"].astype("int32"), "before": (by_task["docs"].cumsum() - by_task["docs"]).astype("int64")})
    named = labels.join(F.broadcast(spark.createDataFrame(offsets, "part int, before bigint")), "part").select("doc_id", (F.col("before") + F.col("k")).alias("doc_no"))
    counted = scan(spark, by_task[["path", "n_ids"]], end_id, dtype, block_ids)
    return named.join(counted, "doc_no").select("doc_id", "doc_no", "start", "n_tokens")
