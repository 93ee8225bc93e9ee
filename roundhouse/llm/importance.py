"""Importance resampling: documents that look like a target set get larger weights, and a seeded draw without replacement follows them.

Features are runs of one and two words, hashed to ``buckets``. A bucket's gain compares its share in the target with its share in the corpus, both
counted over everything. A document's weight is the mean of its features' gains, looked up in one array; noise from a hash of its id turns
weights into a draw.

Ranks come from parallel sorting by regular sampling: every task sorts its run, rows at regular places of all runs give the splitters, each
run's rows go to the segment between two splitters, segments are merged by sorting them where they arrive, and sums of the counts of
earlier segments make places in a segment exact ranks. With ``p`` segments a segment gets at most ``1 / p`` of the rows and a regular step of
each run more, ties included, because the row's number ends every key.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundhouse.llm.shared import Scratch

BUCKETS = 10_000
#: rows a segment is meant to hold, and the most segments; the driver sees about their square in sampled keys
SEGMENT_ROWS, MOST_SEGMENTS = 4096, 512
#: bytes of a text worked on at a time, words that a task remembers
STEP, REMEMBERED = 1 << 22, 1 << 20
PLACE = 33

#: bytes of words as they are, A-Z in lower case; all other bytes part words
PLAIN = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: words with more bytes than this are hashed by zlib with the word before them
SHORT = 64


def crc_table() -> np.ndarray:
    """The byte table of CRC-32 (reflected polynomial EDB88320)."""
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, values >> np.uint32(1) ^ np.uint32(0xEDB88320), values >> np.uint32(1))
    return values.astype(np.uint32)


def shifts(most: int) -> np.ndarray:
    """``[n, k, v]``: what byte ``k`` with value ``v`` of a checksum becomes when ``n`` more bytes follow."""
    table = crc_table()
    out = np.empty((most + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
    for n in range(most):
        out[n + 1] = table[out[n] & np.uint32(255)] ^ out[n] >> np.uint32(8)
    return out


TABLE, SHIFTS = crc_table(), shifts(SHORT)
BLANK = zlib.crc32(b" ")


class Known(dict):
    """Word to checksum and length, packed in one number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = zlib.crc32(word) | len(word) << 32
        return value


def pairs_crc(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Checksums of ``first blank second`` from those of its words. ``words`` are the second ones."""
    short = np.minimum(sizes, SHORT)
    crc = SHIFTS[1, 0][first & np.uint32(255)] ^ first >> np.uint32(8) ^ np.uint32(BLANK)
    out = second.copy()
    for k in range(4):
        out ^= SHIFTS[short, k, crc >> np.uint32(8 * k) & np.uint32(255)]
    for i in np.flatnonzero(sizes > SHORT):
        out[i] = zlib.crc32(words[i], int(crc[i]))
    return out


def features(text: bytes, known: Known, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Words and buckets of all features of a text, stretch by stretch."""
    text = text.translate(PLAIN)
    start, before = 0, None
    while start < len(text):
        end = len(text) if len(text) - start <= STEP else text.find(b" ", start + STEP)
        end = len(text) if end < 0 else end
        words = text[start:end].split()
        start = end
        if not words:
            continue
        packed = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        crc, sizes = (packed & 0xFFFFFFFF).astype(np.uint32), packed >> 32
        if before is not None:
            first, second, lengths, follow = np.concatenate([[before], crc[:-1]]).astype(np.uint32), crc, sizes, words
        else:
            first, second, lengths, follow = crc[:-1], crc[1:], sizes[1:], words[1:]
        both = pairs_crc(first, second, lengths, follow)
        before = crc[-1]
        yield len(words), np.concatenate([crc, both]).astype(np.int64) % buckets


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Features of all texts (one column) by bucket; each task sends at most one row a bucket, the driver gets ``buckets`` sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = Known(), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                for _, found in features(text or b"", known, buckets):
                    counts += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln(share in the target / share in the corpus))``, each bucket counted once more than it is."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    more = len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + more) / ((s + 1) * (t.sum() + more)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id, row, n_words, n_features, weight`` of ``doc_id, row, text``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                words = many = total = 0
                for n, found in features(text or b"", known, buckets):
                    words, many, total = words + n, many + len(found), total + int(gains[found].sum())
                n_words.append(words), n_features.append(many), weight.append(total // many if many else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], names=["doc_id", "row", "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, f"doc_id {kind}, row bigint, n_words bigint, n_features bigint, weight bigint")


def noise(key: Column, seed: int) -> Column:
    """A whole number from the id's hash, distributed so that the largest sums of weight and noise are a weighted draw."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def ranked(rows: DataFrame, order: list[Column], keys: list[str], scratch: Scratch, name: str = "rank") -> DataFrame:
    """Exact ranks from 1 in a total order over ``keys`` (the last of which is unique), by regular sampling.

    ``order`` gives the columns that sort the rows; ``keys`` name comparable columns in the same, ascending order.
    """
    spark = rows.sparkSession
    mask = F.lit((1 << PLACE) - 1)
    local = rows.sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id().bitwiseAND(mask))
    runs = scratch.save(local)
    n = runs.count()
    p = min(MOST_SEGMENTS, max(1, n // SEGMENT_ROWS))
    step = max(1, n // (p * p))
    sample = sorted(tuple(r) for r in runs.where(F.col("place") % step == 0).select(*keys).collect()) if p > 1 else []
    cuts = sample[len(sample) // p :: max(1, len(sample) // p)][: p - 1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            found = [bisect_right(cuts, key) for key in zip(*columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, "segment"])

    dealt = runs.mapInArrow(segments, f"{schema}, segment int").repartitionById(p, F.col("segment"))
    merged = scratch.save(dealt.sortWithinPartitions("segment", *order).withColumn("place", F.monotonically_increasing_id().bitwiseAND(mask)))
    before, starts = 0, []
    for segment, many in sorted(tuple(r) for r in merged.groupBy("segment").count().collect()):
        starts.append((segment, before))
        before += many
    offsets = spark.createDataFrame(starts, "segment int, before bigint")
    return merged.join(F.broadcast(offsets), "segment").withColumn(name, F.col("before") + F.col("place") + 1).drop("segment", "place", "before")


def draw(docs: DataFrame, target: DataFrame, *, percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` counts from 1 over the drawn ones and is null for the others.

    Of the documents with at least ``least_words`` words, ``percent`` of a hundred (rounded down) with the largest scores are drawn, ties to
    the smaller id. Null texts have no words: no features, weight 0, not drawn. A null id hashes as empty text and goes behind the others;
    rows that repeat an id rank one after the other. Empty tables give no rows; an empty target gives every bucket its smoothed share.
    Other columns are left out.
    """
    scratch = Scratch(docs.sparkSession, "draw")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    gains = bucket_gains(bucket_counts(plain.select("text"), buckets), bucket_counts(target.select(F.col(target_text).alias("text")), buckets))
    weighed = weigh(plain, gains)
    scored = scratch.save(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = scored.where(F.col("n_words") >= least_words)
    keyed = able.withColumn("less", -F.col("score")).withColumn("no_id", F.col("doc_id").isNull())
    filler = F.lit("" if dict(scored.dtypes)["doc_id"] == "string" else 0).cast(scored.schema["doc_id"].dataType)
    keyed = keyed.withColumn("key", F.coalesce("doc_id", filler))
    keys = ["less", "no_id", "key", "row"]
    placed = ranked(keyed, [F.col(k).asc() for k in keys], keys, scratch)
    drawn = able.count() * percent // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    columns = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*columns, rank.cast("bigint").alias("rank")).unionAll(scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("bigint").alias("rank")))
