"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from roundhouse.llm import exact_dedup, minhash
from roundhouse.llm.components import components
from roundhouse.llm.shared import Scratch

from llm_edges import SCHEMA


def plain_near(rows, words, percent):
    """Least reachable id and set size for each id."""
    sets = {}
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall("[^\x20\x09-\x0d]+", low)
        sets[i] = {tuple(found[k : k + words]) for k in range(max(1, len(found) - words + 1))} if found else set()
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_set = defaultdict(list)
    for i in ids:
        by_set[frozenset(sets[i])].append(i)
    for k, group in by_set.items():
        if k:
            for i in group:
                parent[root(i)] = min(group)
    reps = [(min(g), k) for k, g in by_set.items() if k]
    for a in range(len(reps)):
        for b in range(a):
            x, y = reps[a][1], reps[b][1]
            common = len(x & y)
            if common and 100 * common >= percent * (len(x) + len(y) - common):
                p, q = sorted((root(reps[a][0]), root(reps[b][0])))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("words", "percent"), [(2, 80), (5, 80)])
def test_near_duplicates(docs, words, percent):
    rows = minhash.near_duplicates(docs, words, percent).collect()
    wanted = plain_near([(r.doc_id, r.text) for r in docs.collect()], words, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and len(rows) == docs.count()


def test_near_edges(edge_docs, no_docs):
    rows = minhash.near_duplicates(edge_docs, 2, 80).collect()
    wanted = plain_near({(r.doc_id, r.text) for r in edge_docs.collect()}, 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == wanted
    assert len(rows) == edge_docs.count()
    assert minhash.near_duplicates(no_docs).collect() == []
    assert minhash.without_near_duplicates(no_docs).columns == no_docs.columns


def test_chain_and_crowd(spark):
    """A chain of links, and a crowd in which not every member is near every other."""
    rng = np.random.default_rng(1)
    rows, words = [], [f"c{i}" for i in range(100)]
    for i in range(40):  # each step replaces five words
        rows.append((i, " ".join(words)))
        words = words[5:] + [f"s{i}_{k}" for k in range(5)]
    base = [f"b{i}" for i in range(60)]
    for i in range(150):
        own = list(base)
        for at in rng.choice(60, 3, replace=False):
            own[at] = f"x{i}_{at}"
        rows.append((1000 + i, " ".join(own)))
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame, 2, 80).collect()}
    assert got == {i: c for i, (_, c) in plain_near(rows, 2, 80).items()}


def test_sketch_estimates():
    rng = np.random.default_rng(2)
    for n in (1, 3, 40, 700, 9000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.unique(np.append(a[n // 10 :], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)))
        x, y = minhash.sketch(np.unique(a), 512), minhash.sketch(b, 512)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((x == y).mean() - true) < 0.1
        assert (x != minhash.FULL).all()


def test_without_near_duplicates(spark, docs):
    odd = docs.withColumnRenamed("n_chars", "Gone_Id").withColumnRenamed("lang", "row")
    kept = minhash.without_near_duplicates(odd)
    wanted = {i for i, (_, c) in plain_near([(r.doc_id, r.text) for r in docs.collect()], 5, 80).items() if i == c}
    assert {r.doc_id for r in kept.collect()} == wanted and kept.columns == odd.columns


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "u bigint, v bigint"), Scratch(spark, "t")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {x: root(x) for x in parent}


def plain_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def test_exact(edge_docs, docs, no_docs):
    for frame in (edge_docs, docs):
        local = [(r.doc_id, r.text) for r in frame.collect()]
        rows = exact_dedup.exact_duplicates(frame).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == plain_exact(local)
        kept = [r for r in rows if r.kept]
        assert len(kept) == len({t or "" for _, t in local}) and all(r.doc_id == r.keep_id for r in kept)
        left = exact_dedup.without_duplicates(frame)
        assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in kept) and left.columns == frame.columns
    assert exact_dedup.exact_duplicates(no_docs).collect() == [] and exact_dedup.without_duplicates(no_docs).collect() == []


def test_exact_with_clashing_names(docs):
    odd = docs.withColumnRenamed("n_chars", "FP").withColumnRenamed("lang", "sha")
    assert exact_dedup.without_duplicates(odd).columns == odd.columns
    assert exact_dedup.exact_duplicates(odd).count() == odd.count()


def test_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 64, 5000, dtype=np.uint64)
    parts = [np.unique(rng.choice(values, 3000), return_counts=True) for _ in range(4)]
    total, sums = exact_dedup.merged([p[0] for p in parts], [p[1] for p in parts])
    wanted = np.unique(np.concatenate([np.repeat(*p) for p in parts]), return_counts=True)
    assert (total == wanted[0]).all() and (sums == wanted[1]).all()
    for a, counts in parts:
        top = a >> np.uint64(60)
        for s in np.unique(top):
            own = top == s
            one = exact_dedup.QuotientFilter.of(a[own], counts[own], 4, 12)
            assert (one.fingerprints(int(s), 4, 12) == a[own]).all() and one.runs.sum() == own.sum()


def test_null_ids_keep_links(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base), (5, base), (7, base + " x"), (9, base + " y z"), (None, None), (11, "alone here")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).coalesce(1)
    found = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(docs, words=2, percent=80).collect()}
    assert {k: v for k, v in found.items() if k[1] > 1 or k[0] == 11} == {(None, 59): (5, False), (5, 59): (5, True), (7, 60): (5, False), (9, 61): (5, False), (11, 1): (11, True)}


def test_few_slots_only_let_more_rows_through(spark, edge_docs, monkeypatch):
    wide = edge_docs.withColumn("FP", F.lit(1)).withColumn("again", F.lit("x"))
    whole = sorted(map(str, exact_dedup.without_duplicates(wide).collect()))
    monkeypatch.setattr(exact_dedup, "MOST_SLOTS", 1)
    assert sorted(map(str, exact_dedup.without_duplicates(wide).collect())) == whole


def test_cleared_calls_leave_nothing(spark, docs, tmp_path):
    from pathlib import Path

    from roundhouse.llm.shared import Scratch, cleared, shared_folder

    place = Path(shared_folder(spark).removeprefix("file://"))
    before = {x.name for x in place.iterdir()}
    with cleared():
        out = minhash.without_near_duplicates(docs)
        assert {x.name.rsplit("-", 1)[0] for x in place.iterdir() if x.name not in before} == {"near-gone"}
        out.write.parquet(f"{tmp_path}/kept")
    assert {x.name for x in place.iterdir()} == before
    Scratch(spark, "later").save(docs.limit(1))  # calls outside keep theirs
    assert len({x.name for x in place.iterdir()} - before) == 1
