"""Token ids in compressed files that give back single documents.

A shard holds one zstandard frame for each document, compressed with a dictionary shared by all shards, then an index and a trailer:

``b"TOKZ0001"``, SHA-256 of the dictionary (32 bytes), the frames, the index as an Arrow stream (``doc_id, offset, size, n_tokens``),
the index's offset (8 bytes, little-endian), ``b"TOKZ0001"``.

Shards are ranges of ``doc_id`` in ascending order, so a document is found by its shard's range, its index row and one read.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundhouse.llm.shared import Scratch
from roundhouse.llm.tokenfiles import create, own_path, place, read_range
from roundhouse.llm.tokens import encoder

MAGIC = b"TOKZ0001"
HEADER = len(MAGIC) + 32
LEVEL = 3
#: the dictionary is trained on so many documents, those of the least hashed ids, and on so many of their first characters; it changes sizes, never ids
SAMPLE_DOCS, SAMPLE_CHARS = 500, 2048
DICTIONARY_BYTES = 64 << 10
BATCH = 256
MANIFEST = "part int, path string, n_docs bigint, n_tokens bigint, bytes bigint, dictionary string"


def encoded_ids(texts: list[str | None], tokenizer: str, end_id: int, plain: bool) -> Iterator[bytes]:
    end = int(end_id).to_bytes(4, "little")
    return (ids + end for ids in encoder(tokenizer, plain).encode(texts))


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, plain: bool = True) -> bytes:
    """Dictionary for serialized id arrays. The sample has a fixed bound; an empty table gives an empty dictionary."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(encoded_ids(batch.column(0).to_pylist(), tokenizer, end_id, plain)), pa.binary())], names=["ids"])

    sample = docs.select(F.xxhash64("doc_id").alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("text")).orderBy("h", "text").limit(SAMPLE_DOCS)
    samples = [bytes(r[0]) for r in sample.select("text").mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: their bytes serve as they are
        return b"".join(samples)[-DICTIONARY_BYTES:]


def dictionary_of(data: bytes):
    """A zstandard dictionary, or None if there is none; plain bytes count as content."""
    import zstandard

    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", plain: bool = True) -> DataFrame:
    """Write every document's ids and return the manifest (a written table): one row for each shard, ``part`` in the order of ids.

    Null text counts as empty and has the end id alone. Null ids come first; rows that repeat an id are documents of their own, in the
    order of their texts. Ranges of ids are as even as Spark's range sample makes them; no row's neighbours are gathered.
    ``plain`` reads the strings of special tokens as text; else ids are the tokenizer's own.
    """
    import zstandard

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    data = train_dictionary(rows, tokenizer, end_id, plain)
    digest = hashlib.sha256(data).hexdigest()
    with create(f"{folder}/{digest}.dictionary") as out:
        out.write(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, index, total, docs_here, at, path = None, [], 0, 0, HEADER, ""
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary_of(data)).compress
        for whole in batches:
            encoded = encoded_ids(whole.column(1).to_pylist(), tokenizer, end_id, plain)
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                if out is None:
                    path = own_path(folder, ".tokz")
                    out = create(path)
                    out.write(MAGIC + bytes.fromhex(digest))
                ids = list(islice(encoded, BATCH))
                frames = [compress(b) for b in ids]
                offsets = []
                for frame in frames:
                    offsets.append(at)
                    at += len(frame)
                out.write(b"".join(frames))
                counts = [len(b) // 4 for b in ids]
                index.append(pa.RecordBatch.from_arrays([batch.column(0), pa.array(offsets, pa.int64()), pa.array(map(len, frames), pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "offset", "size", "n_tokens"]))
                total += sum(counts)
                docs_here += len(ids)
        if out is None:
            return
        buffer = io.BytesIO()
        with pa.ipc.new_stream(buffer, index[0].schema) as writer:
            for part in index:
                writer.write_batch(part)
        out.write(buffer.getvalue() + at.to_bytes(8, "little") + MAGIC)
        out.close()
        size = at + buffer.tell() + 16
        from pyspark import TaskContext

        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "path": path, "n_docs": docs_here, "n_tokens": total, "bytes": size, "dictionary": digest}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.int64()), ("dictionary", pa.string())]))

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return Scratch(docs.sparkSession, "tokz").save(ordered.mapInArrow(run, MANIFEST))


def load_dictionary(path: str, digest: str):
    """The dictionary beside a shard, checked against the hash."""
    system, inner = place(f"{path.rsplit('/', 1)[0]}/{digest}.dictionary")
    with system.open_input_stream(inner) as file:
        data = file.read()
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError(f"the dictionary of {path} isn't the one it was written with")
    return dictionary_of(data)


class Shard:
    """One file: its index, and ids of single documents by index row."""

    def __init__(self, path: str):
        import zstandard

        self.system, self.path = place(path)
        with self.system.open_input_file(self.path) as file:
            size = file.size()
            head, tail = file.read_at(HEADER, 0), file.read_at(16, size - 16)
            if head[:8] != MAGIC or tail[8:] != MAGIC:
                raise ValueError(f"{path} isn't a token file")
            at = int.from_bytes(tail[:8], "little")
            self.index = pa.ipc.open_stream(file.read_at(size - 16 - at, at)).read_all()
        self.decompress = zstandard.ZstdDecompressor(dict_data=load_dictionary(path, head[8:].hex())).decompress

    def batches(self, rows: int = BATCH) -> Iterator[tuple[pa.Table, list[bytes]]]:
        """Index rows with their documents' ids; of the frames, one batch is in memory."""
        with self.system.open_input_file(self.path) as file:
            for start in range(0, self.index.num_rows, rows):
                part = self.index.slice(start, rows)
                offsets, sizes = part["offset"].to_pylist(), part["size"].to_pylist()
                data = file.read_at(offsets[-1] + sizes[-1] - offsets[0], offsets[0])
                yield part, [self.decompress(data[o - offsets[0] : o - offsets[0] + s]) for o, s in zip(offsets, sizes)]

    def document(self, row: int) -> bytes:
        """Ids of one document: one read of its frame."""
        with self.system.open_input_file(self.path) as file:
            return self.decompress(file.read_at(self.index["size"][row].as_py(), self.index["offset"][row].as_py()))


def read(spark: SparkSession, manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Rows ``doc_id, start, n_tokens, ids`` of all shards: ``start`` counts the ids of all documents before, in ascending order of ids.

    The manifest has one row for each shard; their sums are taken on the driver.
    """
    shards = manifest.orderBy("part").toPandas()
    listed = pd.DataFrame({"path": shards["path"], "before": (shards["n_tokens"].cumsum() - shards["n_tokens"]).astype("int64")})
    tasks = spark.createDataFrame(listed, "path string, before bigint").repartition(max(1, len(listed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part, ids in Shard(path).batches():
                    starts = []
                    for n in part["n_tokens"].to_pylist():
                        starts.append(before)
                        before += n
                    counts = [len(b) // 4 for b in ids]
                    yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks(), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return tasks.mapInArrow(run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids binary")
