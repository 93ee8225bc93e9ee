"""Remove passages that recur: repeated-phrase automata.

A window is ``length`` consecutive words of a document. Every word covered by a window that starts anywhere else as well is removed.

1. Anchors: in each window the run of ``GRAM`` words with the least hash. Equal windows have equal anchors, so a window whose anchor occurs
   once can't recur. There are a few anchors for every hundred words.
2. Windows: for documents with a recurring anchor, the windows over one. Their hashes (96 bits) are counted; a task first counts by itself,
   so a passage that a third of all documents share is one row a batch, not one row a document. This only proposes passages.
3. Passages: each stretch of recurring windows is tiled by windows that begin where the anchor changes (and by its first and last), so
   copies of a passage are soon tiled alike wherever they stand. Distinct passages, told apart by their words, are dealt to shards by their anchor.
4. Automata: a shard's passages become an Aho-Corasick automaton over words (two letters each). From every document the windows over anchors that
   any passage has stream through the shards that own these anchors, where any occurrence of a passage must be; words are compared as they
   are. Only what the automata find is removed, and only if a passage is found at two places or more.

A document streams only through shards that can hold one of its passages, so work grows with the text and not with text times shards. Stretches
are dealt to tasks by range of (shard, document), so a shard that a third of all documents visit is shared by many tasks.

Windows are judged on the input; removal changes nothing that is counted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundhouse.llm.shared import Scratch
from roundhouse.llm.tokenfiles import place
from roundhouse.llm.words import U, chunks, mix, runs

LENGTH = 35
GRAM = 8
BATCH = 2048
#: passages of an automaton at most; shards have half as many on average, and one that has more is worked off in pieces
SHARD = 1 << 13
#: bytes of stretches that pass through the pieces of a shard together, about
HELD = 1 << 23
OTHER = U(0x5851F42D4C957F2D)


def anchors(words: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the position of its anchor, and the hashes of all runs of ``gram`` words."""
    grams = runs(words, gram)
    width = length - gram + 1
    if len(words) < length:
        return np.zeros(0, np.int64), grams
    least, wide = np.arange(len(grams)), 1  # first least of the ``wide`` runs from each place on
    while wide < width:
        step = min(wide, width - wide)
        left, right = least[:-step], least[step:]
        least = np.where(grams[left] <= grams[right], left, right)
        wide += step
    return least, grams


def once(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value whether it occurs once, and the distinct values that occur more often."""
    found, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    return (counts == 1)[inverse], found[counts > 1]


def ragged(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Lists of so many values each."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values))


def over_anchors(words: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose words lie end to end from ``first`` on, the windows that share an anchor: text, first and last begin, hash of the anchor."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    if not len(text):
        return text, text, text, np.zeros(0, U)
    begins = np.arange(len(text)) + (first[:-1] - np.cumsum(counts) + counts)[text]
    at, grams = anchors(words, length, gram)
    at = at[begins]
    heads = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return text[heads], begins[heads], begins[np.append(heads[1:], len(at)) - 1], grams[at[heads]]


def among(text: np.ndarray, anchor: np.ndarray, listed: pa.Array) -> np.ndarray:
    """Whether an anchor is in its text's list."""
    values = np.asarray(listed.flatten(), np.int64).view(U)
    owner = np.repeat(np.arange(len(listed)), np.asarray(listed.value_lengths()))
    _, number = np.unique(np.concatenate([anchor, values]), return_inverse=True)
    keys = number + np.concatenate([text, owner]) * len(number)
    return np.isin(keys[: len(text)], keys[len(text) :])


def anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``doc_id, k1, k2, n_words, sha, known, single, many`` of ``doc_id, k1, k2, text``.

    Anchors (distinct in a document) are ``known`` to recur from the batch alone, or ``single`` in it; ``many`` lists those that the batch has
    more than once, on one row for each batch.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "k1", "k2", "n_words", "sha", "known", "single", "many"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                n, shas, found, owners = [], [], [], []
                for row, part, own, words, _, _, first in chunks(batch.column(3)):
                    text, _, _, anchor = over_anchors(words, first, length, gram)
                    n.append(np.diff(first))
                    found.append(anchor)
                    owners.append(text + row)
                    data = part.tobytes()
                    shas += [hashlib.sha256(b" ".join(data[a:b].split())).hexdigest() for a, b in pairwise(own.tolist())]
                found, owners = np.concatenate(found), np.concatenate(owners)
                alone, many = once(found)
                again, whose = found[~alone], owners[~alone]
                order = np.lexsort((again, whose))
                again, whose = again[order], whose[order]
                new = np.append(True, (again[1:] != again[:-1]) | (whose[1:] != whose[:-1]))[: len(again)]
                counts = [np.bincount(x, minlength=batch.num_rows) for x in (whose[new], owners[alone])]
                listed = np.append(len(many), np.zeros(batch.num_rows - 1, np.int64))
                arrays = [ragged(x.view(np.int64), c) for x, c in zip((again[new], found[alone], many), (*counts, listed))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.concatenate(n), pa.int64()), pa.array(shas), *arrays], names=names)

    return docs.mapInArrow(run, f"doc_id {kind}, k1 bigint, k2 bigint, n_words bigint, sha string, known array<bigint>, single array<bigint>, many array<bigint>")


def windowed(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``row, known, single, checks, at, many, many_checks`` of documents with their recurring anchors (``row, text, anchors``).

    Windows over such an anchor: begin positions ``known`` to recur from the batch alone; hash, check and begin of those ``single`` in it.
    """
    names = ["row", "known", "single", "checks", "at", "many", "many_checks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                owners, begins, hashes, checks = [], [], [], []
                for row, _, own, words, _, _, first in chunks(batch.column(1)):
                    text, low, last, anchor = over_anchors(words, first, length, gram)
                    wanted = among(text, anchor, batch.column(2).slice(row, len(own) - 1))
                    text, low, counts = text[wanted], low[wanted], (last - low + 1)[wanted]
                    places = np.arange(counts.sum()) + np.repeat(low - np.cumsum(counts) + counts, counts)
                    text = np.repeat(text, counts)
                    owners.append(text + row)
                    begins.append(places - first[text])
                    hashes.append(runs(words, length)[places])
                    checks.append((runs(mix(words ^ OTHER), length)[places] >> U(33)).astype(np.int32))
                owners, begins, hashes, checks = (np.concatenate(x) for x in (owners, begins, hashes, checks))
                begins = begins.astype(np.int32)
                pairs = mix(hashes) ^ checks.astype(U) * OTHER
                alone, _ = once(pairs)
                _, one = np.unique(pairs[~alone], return_index=True)
                known, single = (np.bincount(owners[x], minlength=batch.num_rows) for x in (~alone, alone))
                many = np.append(len(one), np.zeros(batch.num_rows - 1, np.int64))
                arrays = [ragged(begins[~alone], known), ragged(hashes[alone].view(np.int64), single), ragged(checks[alone], single), ragged(begins[alone], single), ragged(hashes[~alone][one].view(np.int64), many), ragged(checks[~alone][one], many)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    return docs.mapInArrow(run, "row bigint, known array<int>, single array<bigint>, checks array<int>, at array<int>, many array<bigint>, many_checks array<int>")


def tiles(begins: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Of sorted window begins, some that cover the same words.

    Candidates are where the window's anchor (``at``) is another than the window's before, and the first and last of each stretch. As windows share
    an anchor for fewer than their length, the farthest candidate that still touches the last tile leaves no word out.
    """
    if not len(begins):
        return begins
    gap = np.diff(begins) > 1
    first, last = np.append(True, gap), np.append(gap, True)
    changed = np.append(True, np.diff(at[begins]) != 0)
    possible = begins[first | last | changed]
    farthest = np.searchsorted(possible, possible + length, "right") - 1
    following = np.maximum(farthest, np.arange(len(possible)) + 1).tolist()
    chosen, k = [], 0
    while k < len(possible):
        chosen.append(k)
        k = following[k]
    return possible[chosen]


def passages(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``anchor, words`` of the passages that tile the recurring windows of ``text, known, found`` (their begins); distinct in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = set()
            for row, part, own, words, starts, stops, first in chunks(batch.column(0)):
                at, grams = anchors(words, length, gram)
                data = part.tobytes()
                for i, a in enumerate(first[:-1]):
                    begins = [np.asarray(c[row + i].values, np.int64) for c in (batch.column(1), batch.column(2)) if c[row + i].is_valid]
                    chosen = tiles(np.unique(np.concatenate(begins)) + a, at, length)
                    spans = zip(grams[at[chosen]].view(np.int64).tolist(), starts[chosen].tolist(), stops[chosen + length - 1].tolist())
                    met.update((anchor, b" ".join(data[start:stop].split())) for anchor, start, stop in spans)
            listed = list(met)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in listed], pa.int64()), pa.array([x[1] for x in listed], pa.binary())], names=["anchor", "words"])

    return docs.mapInArrow(run, "anchor bigint, words binary")


def dealt(found: DataFrame, shards: int, path: str) -> str:
    """Write passages (``id, anchor, words``) to a folder for each shard."""
    own = F.pmod(F.col("anchor"), F.lit(shards)).cast("int").alias("shard")
    found.select("id", "words", own).repartition("shard").write.partitionBy("shard").parquet(path)
    return path


def stretches(docs: DataFrame, length: int, gram: int, shards: int) -> DataFrame:
    """``row, shard, begin, words`` of ``row, text, anchors``: for each shard the words of the windows over its anchors, as they stand in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                rows, owners, begins, texts = [], [], [], []
                for row, part, own, words, starts, stops, first in chunks(batch.column(1)):
                    text, low, last, anchor = over_anchors(words, first, length, gram)
                    wanted = among(text, anchor, batch.column(2).slice(row, len(own) - 1))
                    text, low, high, owner = text[wanted], low[wanted], last[wanted] + length, np.mod(anchor[wanted].view(np.int64), shards)
                    order = np.lexsort((low, owner, text))
                    text, low, high, owner = text[order], low[order], high[order], owner[order]
                    new = np.append(True, (text[1:] != text[:-1]) | (owner[1:] != owner[:-1]) | (low[1:] > high[:-1]))[: len(text)]
                    edges = np.flatnonzero(new)
                    text, owner, low, high = text[edges], owner[edges], low[edges], high[np.append(edges[1:], len(high))[: len(edges)] - 1]
                    data = part.tobytes()
                    rows.append(text + row), owners.append(owner), begins.append(low - first[text])
                    texts += [data[a:b] for a, b in zip(starts[low].tolist(), stops[high - 1].tolist())]
                rows, owners, begins = (np.concatenate(x) for x in (rows, owners, begins))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(owners, pa.int32()), pa.array(begins, pa.int64()), pa.array(texts, pa.binary())], names=["row", "shard", "begin", "words"])

    return docs.mapInArrow(run, "row bigint, shard int, begin bigint, words binary")


def spelt(words: pa.Array, known: pa.Array, side: int) -> np.ndarray:
    """Two code points for each word by its place in ``known``; zeros for any other."""
    places = pc.index_in(words, value_set=known).fill_null(-1).to_numpy()
    return np.where((places < 0)[:, None], 0, np.stack([0x10000 + places % side, 0x80000 + places // side], axis=1)).astype("<u4")


def automaton(listed: pa.Array) -> tuple[object, pa.Array, int]:
    """An automaton that tells the number of a passage, and what ``spelt`` needs: two letters stand for each word.

    Letters at odd and even places differ, so what is found begins with a word; two letters keep the children of a node few. Most words of a
    text begin no passage and are looked up at the root and below it, so there are as many first letters as keep both small.
    """
    import ahocorasick

    words = pc.ascii_split_whitespace(listed.cast(pa.string()))
    known = words.values.unique()
    starts = len(words.values.take(words.offsets[:-1]).unique())
    side = max(math.isqrt(starts), len(known) >> 19) + 1
    text = spelt(words.values, known, side).tobytes().decode("utf-32-le")
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, (a, b) in enumerate(pairwise(words.offsets.to_pylist())):
        machine.add_word(text[2 * a : 2 * b], k)
    machine.make_automaton()
    return machine, known, side


def located(parts: DataFrame, folder: str, length: int, size: int) -> DataFrame:
    """``row, ids, at``: what the automata of the shards in ``folder`` find in the stretches, which lie in the order of their shards.

    An automaton holds ``size`` passages at most. If a shard has several, each is made once for about ``HELD`` bytes of stretches.
    """

    def compiled(shard: int) -> Iterator[tuple[np.ndarray, object, pa.Array, int]]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, inner = place(f"{folder}/shard={shard}")
        if system.get_file_info(inner).type == fs.FileType.NotFound:  # no passage has an anchor of this shard
            return
        for batch in ds.dataset(inner, filesystem=system, format="parquet").to_batches(columns=["id", "words"], batch_size=size):
            if batch.num_rows:
                yield np.asarray(batch.column(0)), *automaton(batch.column(1))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        """Neighbouring stretches of a shard, about ``HELD`` bytes at a time."""
        shard, held = None, []
        for batch in batches:
            owners = np.asarray(batch.column(1))
            edges = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))[: len(owners)].tolist()
            for a, b in pairwise([*edges, len(owners)]):
                if held and (owners[a] != shard or sum(x.nbytes for x in held) > HELD):
                    yield shard, pa.Table.from_batches(held).combine_chunks()
                    held = []
                shard = int(owners[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield shard, pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, piece = None, ()
        for shard, part in together(batches):
            rows, _, begins, texts = (column.chunk(0) for column in part.columns)
            words = pc.ascii_split_whitespace(texts.cast(pa.string()))
            ends = np.asarray(words.offsets, np.int64) + np.arange(len(words) + 1)  # a word that is none follows each stretch
            letters = np.zeros((ends[-1], 2), "<u4")
            places = np.ones(ends[-1], bool)
            places[ends[1:] - 1] = False
            pieces = 0
            for piece in [piece] if kept == shard else compiled(shard):
                pieces += 1
                ids, machine, known, side = piece
                letters[places] = spelt(words.values, known, side)
                hits = np.fromiter(machine.iter(letters.tobytes().decode("utf-32-le")), np.dtype((np.int64, 2)))
                at = hits[:, 0] // 2
                stretch = np.searchsorted(ends, at, "right") - 1
                at += np.asarray(begins)[stretch] - ends[stretch] + 1 - length
                counts = np.bincount(stretch, minlength=len(rows))
                found, counts = rows.filter(pa.array(counts > 0)), counts[counts > 0]
                yield pa.RecordBatch.from_arrays([found, ragged(ids[hits[:, 1]], counts), ragged(at, counts)], names=["row", "ids", "at"])
            kept = shard if pieces == 1 else None  # a shard's only automaton serves its next stretches as well

    return parts.mapInArrow(run, "row bigint, ids array<bigint>, at array<bigint>")


def cleaned(docs: DataFrame, length: int) -> DataFrame:
    """``doc_id, n_words, n_removed, text`` of ``doc_id, text, at``, the begins of what was found; ``text`` is what is kept."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                n_words, removed, kept = [], [], []
                for text, found in zip(batch.column(1), batch.column(2)):
                    own = text.as_buffer().to_pybytes().split()
                    n_words.append(len(own))
                    removed.append(0)
                    if found.is_valid:
                        begins = np.asarray(found.values, np.int64)
                        marks = np.bincount(begins, minlength=len(own) + 1) - np.bincount(begins + length, minlength=len(own) + 1)
                        keep = np.cumsum(marks[:-1]) == 0
                        removed[-1] = int((~keep).sum())
                        own = compress(own, keep.tolist())
                    kept.append(b" ".join(own))
                texts = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), texts], names=["doc_id", "n_words", "n_removed", "text"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, text string")


def recurring(rows: DataFrame) -> DataFrame:
    """Keys (all columns but ``n``) whose ``n`` sum up to more than one."""
    keys = [c for c in rows.columns if c != "n"]
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 1").select(*keys)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: documents with recurring anchors as ``doc_id, n_words, n_removed, text`` (what is kept, words joined by one space), and
    the others as ``doc_id, n_words, sha`` (SHA-256 of all words joined by one space; nothing is removed).

    Null text has no words. Documents of fewer than ``length`` words keep all. Rows that repeat an id are documents of their own, and
    equal texts recur in each other. An empty table gives no rows. Texts are told apart by 128 bits, what is removed by its words.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = plain.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")
    met = scratch.save(anchored(keyed, length, gram).withColumn("row", F.monotonically_increasing_id()))
    first = scratch.save(met.select("doc_id", "k1", "k2", "n_words", "sha"))
    single = met.select("row", F.explode("single").alias("anchor"))
    counted = single.select("anchor", F.lit(1).alias("n")).unionAll(met.select(F.explode("many").alias("anchor"), F.lit(2).alias("n")))
    again = single.join(recurring(counted), "anchor").groupBy("row").agg(F.collect_list("anchor").alias("found"))
    found = met.where(F.size("single") + F.size("known") > 0).select("row", "k1", "k2", "known").join(again, "row", "left")
    found = found.select("row", "k1", "k2", F.concat("known", F.coalesce("found", F.array().cast("array<bigint>"))).alias("anchors")).where(F.size("anchors") > 0)
    found = scratch.save(found)
    scratch.drop(met)
    # copies of a text have anchors by batch, so the text's are those of all its rows, as many as it has windows
    by_text = found.select("k1", "k2", F.explode("anchors").alias("a")).distinct().groupBy("k1", "k2").agg(F.collect_list("a").alias("anchors"))
    texts = scratch.save(keyed.join(by_text, ["k1", "k2"]).select("doc_id", "text", "anchors").withColumn("row", F.monotonically_increasing_id()))
    second = scratch.save(windowed(texts.select("row", "text", "anchors"), length, gram))
    window = second.select("row", F.explode(F.arrays_zip("single", "checks", "at")).alias("w")).select("row", F.col("w.single").alias("hash"), F.col("w.checks").alias("check"), F.col("w.at").alias("at"))
    many = second.select(F.explode(F.arrays_zip("many", "many_checks")).alias("w")).select(F.col("w.many").alias("hash"), F.col("w.many_checks").alias("check"), F.lit(2).alias("n"))
    repeated = recurring(window.select("hash", "check", F.lit(1).alias("n")).unionAll(many))
    places = window.join(repeated, ["hash", "check"]).groupBy("row").agg(F.collect_list("at").alias("found"))
    places = second.select("row", "known").join(places, "row", "left").where(F.col("found").isNotNull() | (F.size("known") > 0))
    places = scratch.save(places)
    scratch.drop(second)
    proposed = passages(texts.select("row", "text").join(places, "row").select("text", "known", "found"), length, gram).distinct()
    proposed = scratch.save(proposed.withColumn("id", F.monotonically_increasing_id()))
    scratch.drop(places)
    shards = max(1, math.ceil(2 * proposed.count() / SHARD))
    folder = dealt(proposed, shards, scratch.path())
    # only where a passage's anchor stands can the passage
    asked = texts.select("row", F.explode("anchors").alias("anchor")).join(proposed.select("anchor").distinct(), "anchor", "left_semi")
    asked = asked.groupBy("row").agg(F.collect_list("anchor").alias("anchors"))
    parts = scratch.save(stretches(texts.select("row", "text").join(asked, "row"), length, gram, shards))
    scratch.drop(proposed)
    hits = scratch.save(located(parts.repartitionByRange("shard", "row").sortWithinPartitions("shard"), folder, length, SHARD))
    scratch.drop(parts)
    once_only = scratch.save(hits.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n < 2").select("id"))
    marks = hits.select("row", F.explode(F.arrays_zip("ids", "at")).alias("w")).select("row", F.col("w.ids").alias("id"), F.col("w.at").alias("at"))
    marks = marks.join(once_only, "id", "left_anti").groupBy("row").agg(F.collect_list("at").alias("at"))
    hit = cleaned(texts.select("row", "doc_id", "text").join(marks, "row", "left").select("doc_id", "text", "at"), length)
    untouched = first.join(by_text.select("k1", "k2"), ["k1", "k2"], "left_anti").select("doc_id", "n_words", "sha")
    return hit, untouched


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""
    hit, untouched = without_repeats(docs, length, gram, id_col, text_col)
    hit = hit.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
    return hit.unionByName(untouched.select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("sha").alias("kept_sha256")))
