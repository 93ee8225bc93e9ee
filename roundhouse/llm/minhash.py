"""Near duplicates: sketches by rounds of hashed placement, bands, exact verification.

A document's set holds its distinct runs of ``words`` words. Documents with equal sets become one node first, so copies cost one row.

Sketch: in each round every element falls into one of ``bands * rows`` bins; an empty bin takes the round's least value. Rounds go on
until all bins are full, and the last rounds deal each element to one stated bin, so every coordinate is filled. Agreement of two
sketches estimates similarity with sharp concentration. With the defaults (64 bands of 8), a pair at similarity 0.8 shares no band with
probability (1 - 0.8 ** 8) ** 64, under 1e-5, and lower above.

Candidates: nodes that share a band meet in a bucket. A bucket's nodes are compared with one pivot, not with each other; links are put
together into components, and only buckets that still span several components go on, then with blocks of pivots, until
every pair of unconnected nodes of every bucket has been compared. Before the second round, elements that only one of the remaining nodes
has are counted: they can be in no common part, which bounds the similarity of every pair without comparing it, and nodes with the
fewest of them, the middle of a crowd, are the next pivots. So no link is lost to a cap, and a large group costs one comparison a member.
All comparisons are of whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from roundhouse.llm.components import components
from roundhouse.llm.shared import Scratch
from roundhouse.llm.words import U, documents, mix, runs

BANDS, ROWS = 64, 8
PLACED = 4096
BATCH = 256
#: members and pivots that are compared at a time
BLOCK = 1024
_RANDOM = np.random.default_rng(5)
ROUND_KEYS = _RANDOM.integers(0, 1 << 63, 4096, dtype=U) * U(2) + U(1)
FULL = np.iinfo(U).max


def shingle_set(words: np.ndarray, length: int) -> np.ndarray:
    """Sorted hashes of the distinct runs; fewer words than ``length`` count as one run, none as no set."""
    if not len(words):
        return words
    return np.unique(runs(words, min(length, len(words))))


def sketch(elements: np.ndarray, bins: int) -> np.ndarray:
    """``bins`` values of a set that isn't empty, all filled. Values hold the round in their high bits."""
    best = np.full(bins, FULL, U)
    rounds = max(1, PLACED // len(elements))
    for first in range(0, bins, rounds):
        keys = ROUND_KEYS[first : min(first + rounds, bins)]
        values = mix(elements[None, :] ^ keys[:, None])
        where = ((values >> U(32)) * U(bins)) >> U(32)
        tagged = (np.arange(first, first + len(keys), dtype=U)[:, None] << U(40)) | (mix(values) >> U(24))
        np.minimum.at(best, where.ravel().astype(np.int64), tagged.ravel())
        if not (best == FULL).any():
            return best
    for b in np.flatnonzero(best == FULL):  # round bins + b deals every element to bin b
        best[b] = (U(bins + b) << U(40)) | (mix(elements ^ ROUND_KEYS[bins + b]) >> U(24)).min()
    return best


def band_hashes(values: np.ndarray, bands: int) -> np.ndarray:
    rows = len(values) // bands
    table = ROUND_KEYS[-bands * rows :].reshape(bands, rows)
    return mix((values.reshape(bands, rows) * table).sum(axis=1, dtype=U) ^ ROUND_KEYS[:bands])


def digest(elements: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    parts = np.array([elements.sum(dtype=U), mix(elements ^ ROUND_KEYS[7]).sum(dtype=U)])
    parts = mix(parts ^ U(len(elements))).view(np.int64)
    return int(parts[0]), int(parts[1])


SIGNATURE = pa.schema([("row", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, row, th, n, d1, d2, bands`` of ``doc_id, row, th, text``; of equal sets in a batch only the first carries bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            seen: set[tuple[int, int]] = set()
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                n, d1, d2, found = [], [], [], []
                for _, _, hashes, _, _ in documents(batch.column(3), lower=True):
                    elements = shingle_set(hashes, words)
                    n.append(len(elements))
                    if not len(elements):
                        d1.append(None), d2.append(None), found.append(None)
                        continue
                    key = digest(elements)
                    d1.append(key[0]), d2.append(key[1])
                    found.append(None if key in seen else band_hashes(sketch(elements, bands * rows), bands).view(np.int64))
                    seen.add(key)
                arrays = [pa.array(x, f.type) for x, f in zip((n, d1, d2, found), list(SIGNATURE)[2:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *arrays], names=["doc_id", *SIGNATURE.names])

    return docs.mapInArrow(run, f"doc_id {kind}, row bigint, th bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``row, elements`` (sorted 64-bit numbers) for wanted ``row, doc_id, d1, d2``; the text is found by id and told by its digest."""
    own = wanted.select(F.col("doc_id").alias("own"), "row", "d1", "d2")
    rows = docs.select("doc_id", "text").join(own, F.col("doc_id").eqNullSafe(F.col("own"))).select("row", "d1", "d2", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                ids, found = [], []
                keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
                for i, _, hashes, _, _ in documents(batch.column(3), lower=True):
                    elements = shingle_set(hashes, words)
                    if len(elements) and digest(elements) == keys[i][1:]:
                        ids.append(keys[i][0])
                        found.append(elements.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["row", "elements"])

    return rows.mapInArrow(run, "row bigint, elements binary").dropDuplicates(["row"])


@pandas_udf(T.LongType())
def common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Elements that two sorted sets share."""
    out, left, right = [], b"", np.zeros(0, U)
    for x, y in zip(a, b):
        if x is not left:
            left, known = x, np.frombuffer(x, U)
        right = np.frombuffer(y, U)
        at = np.minimum(np.searchsorted(known, right), len(known) - 1)
        out.append(int((known[at] == right).sum()))
    return pd.Series(out, dtype="int64")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``u, v`` whose sets have ``100 * common >= percent * union``."""
    a, b = sets.select(F.col("row").alias("u"), F.col("elements").alias("x")), sets.select(F.col("row").alias("v"), F.col("elements").alias("y"))
    rows = pairs.select("u", "v").join(b, "v").join(a, "u")
    rows = rows.select("u", "v", common("x", "y").alias("c"), ((F.length("x") + F.length("y")) / 8).cast("bigint").alias("both"))
    return rows.where(F.col("c") * 100 >= (F.col("both") - F.col("c")) * percent).select("u", "v")


def shared_in_batch(sets: DataFrame) -> DataFrame:
    """``row, settled, single, many`` of ``row, elements``: how many of a set's elements another set of its batch has, and which none has.

    ``many`` lists the elements that the batch holds more than once, on one row for each batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements = [np.frombuffer(b, U) for b in batch.column(1).to_pylist()]
            found, inverse, counts = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
            alone, ends = (counts == 1)[inverse], np.cumsum([0] + [len(e) for e in elements])
            single = [e[alone[a:b]].view(np.int64) for e, a, b in zip(elements, ends[:-1], ends[1:])]
            settled = [int((~alone[a:b]).sum()) for a, b in zip(ends[:-1], ends[1:])]
            many = [found[counts > 1].view(np.int64)] + [found[:0].view(np.int64)] * (len(elements) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(settled, pa.int64()), pa.array(single, pa.list_(pa.int64())), pa.array(many, pa.list_(pa.int64()))], names=["row", "settled", "single", "many"])

    return sets.mapInArrow(run, "row bigint, settled bigint, single array<bigint>, many array<bigint>")


def element_counts(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``row, c``: how many of a set's elements are shared among these sets. A written table."""
    found = scratch.save(shared_in_batch(sets))
    single = found.select("row", F.explode("single").alias("e"))
    twice = single.select("e", F.lit(1).alias("k")).unionAll(found.select(F.explode("many").alias("e"), F.lit(2).alias("k"))).groupBy("e").agg(F.sum("k").alias("k")).where("k > 1").select("e")
    more = single.join(twice, "e").groupBy("row").agg(F.count("*").alias("more"))
    return scratch.save(found.join(more, "row", "left").select("row", (F.col("settled") + F.coalesce("more", F.lit(0))).alias("c")))


def block_links(members: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """``u, v`` of near members and pivots with different labels. Both have ``bucket, row, label, elements`` and the bucket's ``parts``.

    A bucket's members are dealt to parts of about ``BLOCK``, each compared with the bucket's pivots, of which there are at most as many.
    """
    left = members.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts")
    right = pivots.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = ([np.frombuffer(x, U) for x in f["elements"]] for f in (a, b))
        own = np.concatenate(mine) if mine else np.zeros(0, U)
        vocabulary, number = np.unique(own, return_inverse=True)
        size = np.array([len(x) for x in mine])
        begins = np.cumsum(size) - size
        labels, rows = a["label"].to_numpy(), a["row"].to_numpy()
        us, vs = [], []
        for x, label, row in zip(theirs, b["label"], b["row"]) if len(own) else ():
            mark = np.zeros(len(vocabulary), np.int32)
            at = np.minimum(np.searchsorted(vocabulary, x), len(vocabulary) - 1)
            mark[at[vocabulary[at] == x]] = 1
            common = np.add.reduceat(mark[number], begins)
            near = rows[(common * 100 >= (size + len(x) - common) * percent) & (labels != label)]
            us.append(near)
            vs.append(np.full(len(near), row))
        return pd.DataFrame({"u": np.concatenate(us) if us else np.zeros(0, np.int64), "v": np.concatenate(vs) if vs else np.zeros(0, np.int64)})

    return left.groupBy("bucket", "part").cogroup(right.groupBy("bucket", "part")).applyInPandas(compare, "u bigint, v bigint").distinct()


def links(docs: DataFrame, nodes: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame | None:
    """``node, label`` of all nodes that have a link, or None if no two share a band.

    ``nodes`` is a written table ``row, doc_id, n, d1, d2, bands``.
    """
    members = nodes.select("row", "n", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "row", "n")
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    # until elements have been counted, all of a node's may be shared
    left = scratch.save(members.join(shared, "bucket").withColumn("c", F.col("n")))
    label = sets = None
    step = 0
    while True:
        at = left if label is None else left.join(label.withColumnRenamed("node", "row"), "row", "left")
        at = at.withColumn("label", F.coalesce(F.col("label"), F.col("row")) if label is not None else F.col("row"))
        same = [F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.shiftright(F.xxhash64("row", F.lit(1)), 24)).alias("y"), F.count("*").alias("z")]
        open_buckets = at.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), *same).where("lo < hi")
        open_buckets = open_buckets.groupBy("x", "y", "z").agg(F.min("bucket").alias("bucket")).select("bucket")  # of buckets with the same nodes one
        at = scratch.save(at.join(open_buckets, "bucket"))
        if at.isEmpty():
            break
        if step == 1:
            sets = scratch.save(sets_of(docs, nodes.select("row", "doc_id", "d1", "d2").join(at.select("row").distinct(), "row"), words))
            able = element_counts(sets, scratch).join(nodes.select("row", F.col("n").alias("own")), "row").where(F.col("c") * 100 >= F.col("own") * percent)
            at = at.drop("c").join(scratch.save(able.select("row", "c")), "row")
        at = at.withColumn("h", F.struct((F.col("n") - F.col("c")) / F.col("n"), F.xxhash64("row", F.lit(step))))
        if step < 2:
            chosen = at.groupBy("bucket").agg(F.min(F.struct("h", "row", "n", "c", "label")).alias("p"))
            chosen = scratch.save(chosen.select("bucket", F.col("p.row").alias("v"), F.col("p.n").alias("m"), F.col("p.c").alias("d"), F.col("p.label").alias("other")))
            most = F.least("c", "d")  # elements that the two can have in common
            pairs = at.join(chosen, "bucket").where((F.col("label") != F.col("other")) & (most * 100 >= (F.col("n") + F.col("m") - most) * percent))
            pairs = scratch.save(pairs.select(F.col("row").alias("u"), "v").distinct())
            ends = pairs.select(F.col("u").alias("row")).unionAll(pairs.select(F.col("v").alias("row"))).distinct()
            own = sets if sets is not None else scratch.save(sets_of(docs, nodes.select("row", "doc_id", "d1", "d2").join(ends, "row"), words))
            new = scratch.save(verified(pairs, own, percent))
            done = chosen.select("bucket", F.col("v").alias("row"))
        else:
            rank = F.row_number().over(Window.partitionBy("bucket").orderBy("h", "row"))
            chosen = scratch.save(at.withColumn("rank", rank).where(F.col("rank") <= BLOCK).select("bucket", "row", "label"))
            parts = scratch.save(at.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("parts")))
            everyone = at.select("bucket", "row", "label").join(sets, "row").join(parts, "bucket")
            middle = scratch.again(chosen).join(scratch.again(sets), "row").join(scratch.again(parts), "bucket")
            new = scratch.save(block_links(everyone, middle, percent))
            done = chosen.select("bucket", "row")
        if not new.isEmpty():
            known = new if label is None else new.unionAll(label.select(F.col("node").alias("u"), F.col("label").alias("v")))
            label = scratch.save(components(known, scratch))
        left = scratch.save(at.join(done, ["bucket", "row"], "left_anti").select("bucket", "row", "n", "c"))
        step += 1
    return label


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, th`` for every row (``th``: hash of the text, to tell rows that repeat an id).

    Documents are linked if their sets of ``words``-word runs, A-Z in lower case, share ``percent`` of their union, and ``component_id`` is
    the least id that links reach. Null text, or text without words, has an empty set and no links. Rows with one id and one set are
    one node, and all of them are kept or none. An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near")
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    numbered = plain.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("th"), "text")
    signed = scratch.save(signatures(numbered, words, bands, rows))
    narrow = signed.drop("bands")
    least = signed.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.min(F.when(F.col("bands").isNotNull(), F.col("row"))).alias("row"))
    with_bands = signed.where("bands IS NOT NULL").select("row", F.col("doc_id").alias("own_id"), "n", "bands")
    nodes = scratch.save(least.join(with_bands, "row").select("row", F.col("own_id").alias("doc_id"), F.col("doc_id").alias("least_id"), "n", "d1", "d2", "bands"))
    label = links(plain, nodes, words, percent, scratch)
    first = nodes.select("row", "d1", "d2", F.col("least_id").alias("component_id"))
    if label is not None:
        named = first.join(label.withColumnRenamed("node", "row"), "row")
        ids = named.groupBy("label").agg(F.min("component_id").alias("group_id"))
        moved = named.join(ids, "label").select("row", "group_id")
        first = first.join(moved, "row", "left").withColumn("component_id", F.coalesce("group_id", "component_id"))
    found = narrow.join(first.select("d1", "d2", "component_id"), ["d1", "d2"], "left")
    group = F.coalesce(F.col("component_id"), F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), group.alias("component_id"), group.eqNullSafe(F.col("doc_id")).alias("kept"), "th")


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one document of each group.

    Only the list of rows that go is left of the tables written on the way. Rows without words stay; so does a null id that no other row is
    linked with. An empty table gives no rows.
    """
    from roundhouse.llm.shared import fresh

    key, th = fresh(docs.columns, "gone_id", "gone_hash")
    scratch = Scratch(docs.sparkSession, "near")
    gone = near_duplicates(docs, words, percent, id_col=id_col, text_col=text_col, scratch=scratch).where("NOT kept").select(F.col("doc_id").alias(key), F.col("th").alias(th)).distinct()
    gone = Scratch(docs.sparkSession, "near-gone").save(gone)
    scratch.clear()
    same = F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(th))
    return docs.join(gone, same, "left_anti")
