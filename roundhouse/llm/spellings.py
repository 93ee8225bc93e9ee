"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found by pairs of trie nodes.

The words' prefixes are the nodes of one trie, the suffixes those of another, built over the reversed words. Both are numbered without
ever holding a trie: words are dealt to ranges by splitters and sorted; neighbours in that order share a stem of known length, below which every
node of the later word is new. A node that reaches over a range's edge is a stem of the splitter there, and has its number from the list of
splitters, which every task knows. So a number stands for exactly one prefix or suffix, and no text is compared afterwards.

A word of ``L`` code points without its ``i``-th is the pair (node of the first ``i``, node of the last ``L - 1 - i``); cut before its ``i``-th it
is (node of the first ``i``, node of the last ``L - i``). Two words with one pair by leaving a code point out differ by a replacement; a pair by
leaving out and a pair by cutting differ by an insertion, counted only where the left-out code point starts a run of equal ones, since others
give the same shorter word. At most one word of a length fills a place with a given letter, so a pair has no more words than letters.
Each word takes count and best of its neighbours from the pair's sorted rows; pairs of words are never written out.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundhouse.llm.shared import Scratch

RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: code points of a text worked on at a time, words that a task counts before it passes them on
STEP, HELD = 1 << 20, 1 << 19
#: words a range is meant to hold, the most ranges, sampled words for each splitter, code points kept of a splitter
RANGE_WORDS, MOST_RANGES, SAMPLED, KEPT = 20_000, 4096, 32, 64
ROWS = 4096
PART = 40


def runs(text: str) -> Iterator[list[str]]:
    """Runs of letters in lower case (A-Z only), a stretch of whole runs at a time."""
    start = 0
    while start < len(text):
        end = start + STEP
        while end < len(text) and RUN.match(text[end].lower() if text[end] < "\x80" else text[end]):
            end += 1
        yield RUN.findall(text[start:end].encode().translate(LOWER).decode())
        start = end


def word_counts(docs: DataFrame, least_length: int, least_count: int, damage: int | None, id_col: str, text_col: str) -> DataFrame:
    """``word, n`` of all documents. With ``damage``, a run loses one code point where that number divides the hash of id and run."""

    def tell(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                begin = zlib.crc32(f"{'' if key is None else key}:".encode())
                for part in runs(text or ""):
                    for word, n in Counter(part).items():
                        if damage and (h := zlib.crc32(word.encode(), begin)) % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= least_length:
                            total[word] += n
                    if len(total) >= HELD:
                        yield tell(total)
                        total.clear()
        yield tell(total)

    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def stem(a: str, b: str) -> int:
    """Code points that two words share from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is shared, a[:high] is not
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low


def splitters(words: DataFrame, column: str, ranges: int, rows: int) -> list[str]:
    """Edges of the ranges, from a sample that a hash takes; no word has to be one of them."""
    if ranges < 2:
        return []
    every = max(1, rows // (ranges * SAMPLED))
    sample = words.where(F.pmod(F.xxhash64(column, F.lit(11)), F.lit(every)) == 0).select(F.substring(column, 1, KEPT).alias("w"))
    found = sorted(r["w"] for r in sample.collect())
    return sorted({found[k * len(found) // ranges] for k in range(1, ranges)}) if found else []


def edge_nodes(edges: list[str]) -> list[np.ndarray]:
    """Numbers of each splitter's stems, by length. They are below zero; -1 is the root."""
    out, before, nodes, count = [], "", np.array([-1]), 1
    for edge in edges:
        shared = stem(before, edge)
        new = len(edge) - shared
        nodes = np.concatenate([nodes[: shared + 1], -1 - np.arange(count, count + new)])
        count, before = count + new, edge
        out.append(nodes)
    return out


def numbered(words: DataFrame, column: str, edges: list[str], carried: list[str]) -> DataFrame:
    """``word, nodes`` with the carried columns, and ``place``: a number in the words' order. ``nodes`` holds the trie node of each stem."""
    known = edge_nodes(edges)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            parts = [bisect_right(edges, w) for w in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int32())], names=[*batch.schema.names, "part"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, nodes, count, place = -1, "", np.array([-1]), 0, 0
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                places, found, sizes = [], [], []
                for word, own in zip(batch.column(batch.schema.get_field_index(column)).to_pylist(), batch.column(batch.schema.get_field_index("part")).to_pylist()):
                    if own != part:
                        part, before, nodes, count, place = own, "", np.array([-1]), 0, 0
                    shared = stem(before, word)
                    new = (part << PART) + np.arange(count, count + len(word) - shared)
                    count += len(new)
                    nodes = np.concatenate([nodes[: shared + 1], new])
                    if shared < len(word):  # only new nodes can be a splitter's
                        for k in (part - 1, part):
                            if 0 <= k < len(edges):
                                reach = stem(edges[k], word)
                                nodes[: reach + 1] = known[k][: reach + 1]
                    places.append((part << PART) + place)
                    place += 1
                    found.append(nodes)
                    sizes.append(len(nodes))
                    before = word
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)) if found else pa.array([], pa.int64()))
                kept = [batch.column(batch.schema.get_field_index(c)) for c in carried]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(places, pa.int64()), lists], names=[*carried, "place", "nodes"])

    fields = {f.name: f.dataType.simpleString() for f in words.schema}
    dealt = words.mapInArrow(deal, ", ".join(f"{c} {k}" for c, k in fields.items()) + ", part int")
    ordered = dealt.repartition("part").sortWithinPartitions("part", column)
    return ordered.mapInArrow(scan, ", ".join(f"{c} {fields[c]}" for c in carried) + ", place bigint, nodes array<bigint>")


def node_pairs(words: DataFrame) -> DataFrame:
    """``p, s, kind, n, place``: each word's pairs. ``kind`` 0 is a cut, 1 a left-out code point, 2 one that starts a run of equal ones.

    ``words`` has ``word, n, place, front, back``.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                texts, n, place = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                front, back = (batch.column(k).flatten().to_numpy() for k in (3, 4))
                sizes = np.array([len(t) for t in texts])
                letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
                first = np.cumsum(sizes + 1) - sizes - 1  # of a word's nodes
                word = np.repeat(np.arange(len(texts)), sizes + 1)
                i = np.arange(len(front)) - first[word]
                cut_s = back[first[word] + sizes[word] - i]
                some = i < sizes[word]
                skip_w, skip_i = word[some], i[some]
                skip_s = back[first[skip_w] + sizes[skip_w] - 1 - skip_i]
                fresh = np.ones(len(letters), bool)
                fresh[1:] = letters[1:] != letters[:-1]
                fresh |= skip_i == 0
                who = np.concatenate([word, skip_w])
                kind = np.concatenate([np.zeros(len(word), np.int8), 1 + fresh.astype(np.int8)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (np.concatenate([front, front[some]]), np.concatenate([cut_s, skip_s]), kind, n[who], place[who])], names=["p", "s", "kind", "n", "place"]
                )

    return words.select("word", "n", "place", "front", "back").mapInArrow(expand, "p bigint, s bigint, kind tinyint, n bigint, place bigint")


def best_of(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The larger count, of equal ones the earlier place; 0 counts stand for none."""
    other = (n2 > n1) | ((n2 == n1) & (p2 < p1))
    return np.where(other, n2, n1), np.where(other, p2, p1)


def group_neighbours(p: np.ndarray, s: np.ndarray, kind: np.ndarray, n: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """``place, near, n, place`` (of the best neighbour) for rows sorted by pair, then left-out before cut, then larger counts and earlier places."""
    edge = np.flatnonzero((p[1:] != p[:-1]) | (s[1:] != s[:-1])) + 1
    begin, size = np.concatenate([[0], edge]), np.diff(np.concatenate([[0], edge, [len(p)]]))
    keep = np.repeat(size > 1, size)
    kind, n, place, size = kind[keep], n[keep], place[keep], size[size > 1]
    if not len(size):
        return [np.zeros(0, np.int64)] * 4
    end = np.cumsum(size)
    begin = end - size
    group = np.repeat(np.arange(len(size)), size)
    cut = kind[end - 1] == 0
    skips = size - cut
    index = np.arange(len(kind))
    first_fresh = np.minimum.reduceat(np.where(kind == 2, index, len(kind)), begin)
    n_fresh = np.add.reduceat((kind == 2).astype(np.int64), begin)
    other = np.where(index == begin[group], begin[group] + 1, begin[group])  # the best among those left out, itself aside
    some = (kind > 0) & (skips[group] > 1)
    other = np.minimum(other, len(kind) - 1)
    n1, p1 = np.where(some, n[other], 0), place[other]
    last = end[group] - 1
    linked = cut[group] & (kind == 2)
    n1, p1 = best_of(n1, p1, np.where(linked, n[last], 0), place[last])
    near = np.where(kind > 0, skips[group] - 1 + linked, n_fresh[group])
    of_cut = (kind == 0) & (n_fresh[group] > 0)
    head = np.minimum(first_fresh[group], len(kind) - 1)
    n1, p1 = np.where(of_cut, n[head], n1), np.where(of_cut, place[head], p1)
    found = near > 0
    return [place[found], near[found].astype(np.int64), n1[found], p1[found]]


def neighbours(pairs: DataFrame) -> DataFrame:
    """``place, n_near, best_n, best_place`` of every word that has a near one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        names = ["place", "near", "best_n", "best_place"]
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if not len(columns[0]):
                continue
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            p, s = columns[:2]
            edge = np.flatnonzero((p != p[-1]) | (s != s[-1]))
            whole = edge[-1] + 1 if len(edge) else 0
            held = [c[whole:] for c in columns]
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in group_neighbours(*(c[:whole] for c in columns))], names=names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in group_neighbours(*held)], names=names)

    together = pairs.repartition("p", "s").sortWithinPartitions("p", "s", F.col("kind") == 0, F.col("n").desc(), "place")
    found = together.mapInArrow(scan, "place bigint, near bigint, best_n bigint, best_place bigint")
    best = F.max(F.struct(F.col("best_n").alias("n"), (-F.col("best_place")).alias("place"))).alias("best")
    return found.groupBy("place").agg(F.sum("near").alias("n_near"), best).select("place", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.place")).alias("best_place"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``place, root`` of ``place, form``: the last of each chain of forms, by doubling. Counts at least double at each step, so chains are short."""
    found = scratch.save(forms.select("place", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not found.where("moved").isEmpty():
        on = scratch.again(found).select(F.col("place").alias("at"), F.col("root").alias("further"))
        after = found.join(on, F.col("root") == F.col("at"), "left")
        step = scratch.save(after.select("place", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        scratch.drop(found)
        found = step
    return found.select("place", "root")


def variants(docs: DataFrame, *, least_length: int = 5, least_count: int = 3, ratio: int = 2, damage: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word with enough code points and occurrences.

    Words are runs of ``A-Z a-z`` and U+00C0 to U+00FF, A-Z in lower case. ``form`` is the near word of the largest count (ties: the first in
    code-point order) if that is at least ``ratio`` times the word's, else null; ``root`` is the end of the chain of forms, the word itself
    where it has none; ``n_near`` counts near words. Null and empty texts have no words, a null id counts as an empty one for ``damage``,
    rows that repeat count again, a table without words gives no rows. Other columns are left out.
    """
    scratch = Scratch(docs.sparkSession, "spellings")
    words = scratch.save(word_counts(docs, least_length, least_count, damage, id_col, text_col).withColumn("turned", F.reverse("word")))
    rows = words.count()
    ranges = min(MOST_RANGES, max(1, rows // RANGE_WORDS))
    front = numbered(words.select("word", "n"), "word", splitters(words, "word", ranges, rows), ["word", "n"])
    back = numbered(words.select("word", "turned"), "turned", splitters(words, "turned", ranges, rows), ["word"])
    both = front.withColumnRenamed("nodes", "front").join(back.select("word", F.col("nodes").alias("back")), "word")
    placed = scratch.save(both.select("word", "n", "place", "front", "back"))
    near = scratch.save(neighbours(node_pairs(placed)))
    own = placed.select("word", "n", "place")
    told = own.join(near, "place", "left")
    form = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best_place"))
    told = scratch.save(told.select("word", "n", "place", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n")))
    ends = roots(told.where("form IS NOT NULL").select("place", "form"), scratch)
    names = own.select(F.col("place").alias("at"), F.col("word").alias("name"))
    found = told.join(names.select(F.col("at").alias("form"), F.col("name").alias("form_word")), "form", "left").join(ends, "place", "left")
    found = found.join(names.select(F.col("at").alias("root"), F.col("name").alias("root_word")), "root", "left")
    return found.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
