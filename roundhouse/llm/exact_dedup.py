"""Exact duplicates by counting quotient filters and a comparison of bytes.

1. Every row gets a 64-bit fingerprint. Each task puts its fingerprints into a counting quotient filter: the high bits are a quotient,
   the low bits a remainder kept in sorted order in the quotient's run, with a count.
2. Filters are cut by their highest bits into segments, and the segments merged by sorted remainders; counts add up, so nothing is lost.
   A group of copies is one counter in each filter, however large it is.
3. Rows whose fingerprint counts more than one are grouped by their bytes, so unequal texts with equal fingerprints stay apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundhouse.llm.shared import Scratch, fresh

#: fingerprints in a segment of the merged filter, about
SEGMENT_ROWS = 1 << 20
#: slots of 64 bits in the largest bitmap of fingerprints that is broadcast
MOST_SLOTS = 1 << 19
SEGMENT = "segment bigint, runs binary, remainders binary, counts binary"


class QuotientFilter:
    """Counts of 64-bit fingerprints: run lengths by quotient, sorted remainders, counters.

    A filter covers the fingerprints whose highest ``shared`` bits equal ``segment``; the next ``bits`` bits are the quotient.
    """

    def __init__(self, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.runs, self.remainders, self.counts = runs, remainders, counts

    @staticmethod
    def of(fingerprints: np.ndarray, counts: np.ndarray, shared: int, bits: int) -> QuotientFilter:
        """From sorted, distinct fingerprints of one segment."""
        low = 64 - shared - bits
        quotients = (fingerprints >> np.uint64(low)) & np.uint64((1 << bits) - 1)
        runs = np.bincount(quotients.astype(np.int64), minlength=1 << bits).astype("<u4")
        return QuotientFilter(runs, fingerprints & np.uint64((1 << low) - 1), counts)

    def fingerprints(self, segment: int, shared: int, bits: int) -> np.ndarray:
        """The fingerprints again, in order: nothing is lost in a filter."""
        low = 64 - shared - bits
        quotients = np.repeat(np.arange(1 << bits, dtype=np.uint64), self.runs)
        head = np.uint64((segment << (64 - shared)) if shared else 0)
        return head | (quotients << np.uint64(low)) | self.remainders


def merged(fingerprints: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, distinct fingerprints with the sums of their counts."""
    values = np.concatenate(fingerprints) if fingerprints else np.zeros(0, np.uint64)
    if not len(values):
        return values, np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")  # runs that are sorted already merge fast
    values, sums = values[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[first], np.add.reduceat(sums, first)


def repeated(prints: DataFrame, rows: int) -> DataFrame:
    """``fp, n``: fingerprints (column ``fp``) that occur more than once, by merged filters."""
    shared = max(2, math.ceil(math.log2(max(1, rows) / SEGMENT_ROWS + 1)))
    bits = 12

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, sums, waiting = [], [], 0

        def compact() -> None:
            values, counts = merged(kept, sums)
            kept[:], sums[:] = [values], [counts]

        for batch in batches:
            values = np.asarray(batch.column(0)).view(np.uint64)
            kept.append(values)
            sums.append(np.ones(len(values), np.int64))
            waiting += len(values)
            if waiting > SEGMENT_ROWS:
                compact()
                waiting = 0
        compact()
        values, counts = kept[0], sums[0]
        segments = values >> np.uint64(64 - shared)
        starts = np.flatnonzero(np.append(True, segments[1:] != segments[:-1])) if len(values) else []
        for a, b in zip(starts, [*starts[1:], len(values)]):
            filtered = QuotientFilter.of(values[a:b], counts[a:b], shared, bits)
            yield pa.RecordBatch.from_pylist([{"segment": int(segments[a]), "runs": filtered.runs.tobytes(), "remainders": filtered.remainders.tobytes(), "counts": filtered.counts.astype("<i8").tobytes()}])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(kept: list, sums: list) -> pa.RecordBatch:
            values, counts = merged(kept, sums)
            many = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(counts[many])], names=["fp", "n"])

        segment, kept, sums = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["segment"] != segment:
                    if kept:
                        yield finish(kept, sums)
                    segment, kept, sums = row["segment"], [], []
                one = QuotientFilter(np.frombuffer(row["runs"], "<u4"), np.frombuffer(row["remainders"], np.uint64), np.frombuffer(row["counts"], "<i8"))
                kept.append(one.fingerprints(segment, shared, bits))
                sums.append(one.counts)
        if kept:
            yield finish(kept, sums)

    filters = prints.select("fp").mapInArrow(build, SEGMENT)
    return filters.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "fp bigint, n bigint")


def bitmap(prints: DataFrame, many: int) -> tuple[DataFrame, int]:
    """``slot, bits`` of fingerprints, and the number of slots: a table that can be broadcast however many there are.

    With more fingerprints than ``MOST_SLOTS`` has bits it lets more rows through, never fewer.
    """
    size = min(MOST_SLOTS, 1 << max(8, math.ceil(math.log2(many / 4 + 1))))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("fp").bitwiseAND(F.lit(63)).cast("int"))
    return prints.select(slot_of(F.col("fp"), size).alias("slot"), one.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")), size


def slot_of(fp: Column, size: int) -> Column:
    return F.shiftrightunsigned(fp, 6).bitwiseAND(F.lit(size - 1))


def flagged(rows: DataFrame, fp: str, bits: DataFrame, size: int, name: str) -> DataFrame:
    """Add ``name``: whether a row's fingerprint may be in the bitmap. Nothing is shuffled."""
    slot, mask = fresh([*rows.columns, name], "slot", "bits")
    bits = bits.select(F.col("slot").alias(slot), F.col("bits").alias(mask))
    joined = rows.withColumn(name, slot_of(F.col(fp), size)).join(F.broadcast(bits), F.col(name) == F.col(slot), "left")
    place = F.col(fp).bitwiseAND(F.lit(63)).cast("int")
    found = F.coalesce(F.call_function("shiftright", F.col(mask), place).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return joined.withColumn(name, found).drop(slot, mask)


def classes(docs: DataFrame, text: Column, scratch: Scratch, prints: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``fp, sha, keep_id, keep_row, group_size`` of each text that occurs more than once, and a bitmap of their fingerprints.

    ``prints`` is a written table ``doc_id, row, fp, sha`` of ``docs``. A text moves only if its fingerprint may be repeated. Different texts
    with equal SHA-256 and fingerprint would end the job.
    """
    twice = scratch.save(repeated(prints, prints.count()))
    bits, size = bitmap(twice, twice.count())
    bits = scratch.save(bits)
    bodies = flagged(docs.select(F.xxhash64(text).alias("fp"), text.alias("text")), "fp", bits, size, "again").where("again").drop("again")
    by_bytes = bodies.join(twice.select("fp"), "fp").groupBy("fp", "text").agg(F.count("*").alias("group_size")).where("group_size > 1")
    verified = scratch.save(by_bytes.select("fp", F.sha2("text", 256).alias("sha"), "group_size"))
    one = verified.groupBy("fp", "sha").agg(F.count("*").alias("texts"), F.max("group_size").alias("group_size"))
    one = one.withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error("different texts have the same SHA-256")))
    last = prints.join(twice.select("fp"), "fp").groupBy("fp", "sha").agg(F.max(F.struct("doc_id", "row")).alias("keep"))
    found = last.join(one, ["fp", "sha"]).select("fp", "sha", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size")
    return scratch.save(found), bits, size


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row; null text counts as empty.

    Of equal texts the largest id stays; of rows that repeat both id and text, one. Null ids are smallest. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    text = F.coalesce(F.col(text_col), F.lit(""))
    prints = scratch.save(docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("fp"), F.sha2(text, 256).alias("sha")))
    found = prints.join(classes(docs, text, scratch, prints)[0], ["fp", "sha"], "left")
    return found.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("group_size").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; null text counts as empty, null ids are smallest. An empty table gives no rows.

    Only rows whose fingerprint may be repeated are shuffled; a bitmap of bounded size, broadcast, tells the others apart in the scan.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    text = F.coalesce(F.col(text_col), F.lit(""))
    fp, sha, keep, again = fresh(docs.columns, "fp", "sha", "keep_id", "again")
    prints = scratch.save(docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("fp"), F.sha2(text, 256).alias("sha")))
    groups, bits, size = classes(docs, text, scratch, prints)
    scratch.drop(prints)
    groups = groups.select(F.col("fp").alias(fp), F.col("sha").alias(sha), F.col("keep_id").alias(keep), F.lit(True).alias(again))
    rows = flagged(docs.withColumn(fp, F.xxhash64(text)), fp, bits, size, again)
    alone = rows.where(~F.col(again)).select(*docs.columns)
    told = rows.where(F.col(again)).drop(again).withColumn(sha, F.sha2(text, 256)).join(groups, [fp, sha], "left")
    single = told.where(F.col(again).isNull()).select(*docs.columns)
    last = told.where(F.col(again) & F.col(id_col).eqNullSafe(F.col(keep))).dropDuplicates([fp, sha]).select(*docs.columns)
    return alone.unionAll(single).unionAll(last)
