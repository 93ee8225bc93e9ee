"""Concatenate and cut: all documents as one stream of ids, cut into windows of a fixed length.

1. Each task encodes its documents and writes the ids with the number of ids that came before in the task.
2. The tasks' totals (one row for each task) are summed up to the offset of each task: two passes of a prefix sum.
3. A document's place in the stream is the offset of its task plus its place there. A window boundary inside a document cuts it, and
   both parts are rows of their own; no window is ever put together in one place unless :func:`sequences` asks for it.

No row is shuffled: steps 1 and 3 keep the input's partitions, and what is broadcast has one row for each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundhouse.llm.shared import Scratch
from roundhouse.llm.tokens import encoder

WINDOW = 2048
BATCH = 256


def encode(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", plain: bool = True) -> DataFrame:
    """Rows ``doc_id, part, before, n_tokens, ids``: ids as little-endian 32-bit bytes with ``end_id`` last, and the ids before it in the task.

    Null text counts as empty, so each row has at least the end id. Rows that repeat an id are encoded each for itself.
    ``plain`` reads the strings of special tokens as text, so that no id of a text imitates the end id; else ids are the tokenizer's own.
    """
    end = int(end_id).to_bytes(4, "little")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        tokens, part, before = encoder(tokenizer, plain), TaskContext.get().partitionId(), 0
        for whole in batches:
            encoded = tokens.encode(whole.column(1).to_pylist())
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                ids = [b + end for b in islice(encoded, BATCH)]
                counts = [len(b) // 4 for b in ids]
                places = []
                for n in counts:
                    places.append(before)
                    before += n
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(places, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "before", "n_tokens", "ids"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, part int, before bigint, n_tokens bigint, ids binary")


def task_offsets(encoded: DataFrame) -> DataFrame:
    """Ids before each task: ``part, offset``, one row for each task that wrote rows. ``encoded`` must be a written table."""
    totals = encoded.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("total")).orderBy("part").toPandas()
    offsets = totals["total"].cumsum().shift(fill_value=0)
    frame = pd.DataFrame({"part": totals["part"].astype("int32"), "offset": offsets.astype("int64")})
    return encoded.sparkSession.createDataFrame(frame, "part int, offset bigint")


def placed(encoded: DataFrame) -> DataFrame:
    """The same rows with ``start``, the ids of all documents before. The broadcast has one row for each task of the encoding."""
    return encoded.join(F.broadcast(task_offsets(encoded)), "part").withColumn("start", F.col("offset") + F.col("before")).drop("offset", "before", "part")


def cut(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces ``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` of documents that have ``start, n_tokens, ids``.

    ``start`` is the piece's place in its document, ``offset`` its place in the sequence. Ids are never copied for other pieces.
    """
    w = F.lit(window)
    first = F.col("start")
    last = first + F.col("n_tokens") - 1

    def piece(k: Column) -> Column:
        begin = F.greatest(k * w, first)
        end = F.least((k + 1) * w, last + 1)
        return F.struct(
            (begin - first).alias("start"),
            (end - begin).alias("length"),
            F.substring(F.col("ids"), ((begin - first) * 4 + 1).cast("int"), ((end - begin) * 4).cast("int")).alias("ids"),
            k.alias("sequence_id"),
            (begin - k * w).alias("offset"),
        )

    pieces = F.transform(F.sequence(F.floor(first / w), F.floor(last / w)), piece)
    rows = documents.where("n_tokens > 0").select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.explode(pieces).alias("p"))
    return rows.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", change: Callable[[DataFrame], DataFrame] | None = None, plain: bool = True) -> DataFrame:
    """Pieces of all documents, in sequences of ``window`` ids without gaps; only the last sequence can be shorter.

    An empty table gives no rows. Other columns of ``docs`` are not carried; ``change`` may alter the encoded rows before they are written;
    ``plain`` is that of :func:`encode`.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    encoded = encode(docs, tokenizer, end_id, id_col, text_col, plain)
    return cut(placed(scratch.save(change(encoded) if change else encoded)), window)


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``sequence_id, ids, n_tokens, padded_length, doc_ids, starts``: one row for each sequence, from at most ``window`` pieces.

    ``padded_length`` is the window, or the number of ids where that is a power of two.
    """
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    power = F.expr("n_tokens & (n_tokens - 1)") == 0
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), "n_tokens", F.when(power, F.col("n_tokens")).otherwise(window).alias("padded_length"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))
