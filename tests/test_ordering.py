"""Order-dependent operators against brute force, with ties, hot keys and several partitionings."""

import random

import pytest
from pyspark.sql import functions as F

from roundhouse.operators import asof, augment, ordering, sample, split

PARTITIONS = (1, 4, 17)


def table(spark, rows, schema, partitions=4):
    return spark.createDataFrame(rows, schema).repartition(partitions)


@pytest.mark.parametrize("partitions", PARTITIONS)
def test_global_rank(spark, partitions):
    rng = random.Random(partitions)
    rows = [(n, rng.randrange(20)) for n in range(300)]
    got = ordering.global_rank(table(spark, rows, "id int, ts bigint", partitions), ["ts", "id"]).collect()
    expected = {id_: place for place, (id_, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r.id: r["rank"] for r in got} == expected


def test_equal_rows_are_split_over_slices(spark):
    rows = [(1,)] * 400
    sliced = ordering.sorted_slices(table(spark, rows, "v int"), ["v"])
    sizes = [r["count"] for r in sliced.groupBy("_slice").count().collect()]
    assert len(sizes) > 1 and sum(sizes) == 400


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_rank_in_group_with_a_hot_group(spark, hot_rows):
    rng = random.Random(3)
    rows = [(n, "hot" if n % 3 == 0 else rng.choice(["a", "b", None]) if n % 3 == 1 else f"k{n}", rng.randrange(9)) for n in range(400)]
    df = table(spark, rows, "id int, g string, ts bigint")
    got = {r.id: r.n for r in ordering.rank_in_group(df, ["g"], ["ts", "id"], "n", hot_rows=hot_rows).collect()}
    expected, seen = {}, {}
    for id_, g, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        expected[id_] = seen.get(g, 0)
        seen[g] = expected[id_] + 1
    assert got == expected


def test_running_totals(spark):
    rng = random.Random(4)
    rows = [(n, rng.randrange(5)) for n in range(200)]
    got = {r.k: r.v_before for r in ordering.running_totals(table(spark, rows, "k int, v bigint", 9), ["k"], ["v"]).collect()}
    assert got == {k: sum(v for other, v in rows if other < k) for k, _ in rows}


@pytest.mark.parametrize("partitions", PARTITIONS)
def test_order_violations(spark, partitions):
    rng = random.Random(partitions)
    values = [rng.randrange(30) for _ in range(250)]
    df = table(spark, list(enumerate(values)), "pos int, ts bigint", partitions)
    assert ordering.order_violations(df, ["pos"], "ts").first()[0] == sum(a > b for a, b in zip(values, values[1:]))


def test_assert_chronological(spark):
    split.assert_chronological(table(spark, [(n, n // 2) for n in range(50)], "pos int, ts bigint"), ["pos"], "ts")
    with pytest.raises(ValueError, match="falls 1 times"):
        split.assert_chronological(table(spark, [(0, 5), (1, 4), (2, 4)], "pos int, ts bigint"), ["pos"], "ts")


@pytest.mark.parametrize("wide", range(3))
def test_select_ranks_over_wide_ranges(spark, wide):
    rng = random.Random(8)
    spread = [1 << 63, 10**15, 50][wide]
    values = [rng.choice([rng.randrange(-spread, spread), 7, 7, -3]) for _ in range(500)]
    df = table(spark, [(v,) for v in values], "v bigint")
    ranks = [0, 1, 250, 498, 499]
    ordered = sorted(values)
    assert ordering.select_ranks(df, "v", ranks) == [(ordered[r], sum(v < ordered[r] for v in values)) for r in ranks]


@pytest.mark.parametrize("fractions", [(0.8, 0.1), (0.8,), (0.5, 0.5), (0.0, 0.3)])
def test_chrono_split(spark, fractions):
    rng = random.Random(len(fractions))
    rows = [(n, rng.choice([5, 5, 5, rng.randrange(10)]), n % 11) for n in range(203)]
    df = table(spark, rows, "id bigint, ts bigint, m int")
    ordered = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    ends = [int(f * len(rows)) for f in fractions]
    labels = ["train"] * ends[0] + (["val"] * ends[1] if len(ends) > 1 else [])
    labels += ["test"] * (len(rows) - len(labels))
    expected = dict(zip(ordered, labels))
    assert {r.id: r.split for r in split.chrono_split(df, "ts", "id", fractions).collect()} == expected
    together = split.chrono_split(df, "ts", "id", fractions, keep_together="m").collect()
    first = {}
    for id_ in ordered:
        first.setdefault(id_ % 11, expected[id_])
    assert {r.id: r.split for r in together} == {r[0]: first[r[2]] for r in rows}


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_asof_backward(spark, small, by):
    rng = random.Random(2)
    keys = ["hot", "hot", "hot", "a", "b", "c"]
    left = [(n, rng.choice(keys), rng.choice([40, rng.randrange(100)])) for n in range(300)]
    stamps = sorted(rng.sample(range(5, 100), 30))
    right = [(ts, rng.choice(keys), f"p{ts}") for ts in stamps]
    one = table(spark, left, "id int, g string, ts bigint", 6)
    two = table(spark, right, "release bigint, g string, name string", 3)
    two = two if by else two.drop("g")
    got = {r.id: r.name for r in asof.asof_backward(one, two, "ts", "release", by=by, small=small).collect()}
    expected = {}
    for id_, g, ts in left:
        hits = [r for r in right if r[0] <= ts and (not by or r[1] == g)]
        expected[id_] = max(hits)[2] if hits else None
    assert got == expected


@pytest.mark.parametrize("small", [True, False])
def test_asof_nulls_and_ties(spark, small):
    left = [(1, "a", 5), (2, None, 5), (3, "a", None), (4, "b", 9), (5, "c", 9)]
    right = [(3, "a", "x"), (None, "a", "never"), (3, None, "never"), (9, "b", "y"), (9, "b", "z"), (None, "c", "never")]
    one, two = table(spark, left, "id int, g string, ts bigint", 2), table(spark, right, "at bigint, g string, name string", 3)
    got = {r.id: r.name for r in asof.asof_backward(one, two, "ts", "at", by=["g"], small=small).collect()}
    other = {r.id: r.name for r in asof.asof_backward(one, two.repartition(1), "ts", "at", by=["g"], small=not small).collect()}
    assert got == other and got.pop(4) in ("y", "z") and got == {1: "x", 2: None, 3: None, 5: None}


def test_split_leaves_rows_without_a_time(spark):
    rows = [(n, None if n % 10 == 0 else n, n) for n in range(100)]
    frame = table(spark, rows, "id int, ts bigint, tie bigint", 3)
    got = {r.id: r.split for r in split.chrono_split(frame, "ts", "tie").collect()}
    timed = [n for n in range(100) if n % 10]
    assert all(got[n] is None for n in range(0, 100, 10))
    assert [got[n] for n in timed] == ["train"] * 72 + ["val"] * 9 + ["test"] * 9
    assert {r.split for r in split.chrono_split(frame.withColumn("ts", F.lit(None).cast("bigint")), "ts", "tie").collect()} == {None}


def test_auc_of_many_rows(spark):
    from roundhouse.operators import metrics

    frame = table(spark, [(1, 0.9), (0, 0.1), (1, 0.1)], "label int, score double")
    assert metrics.roc_auc(frame, "label", "score").first().roc_auc == 0.75
    counts = spark.range(1).select(F.lit(10**10).alias("pos"), F.lit(10**10).alias("neg"))
    assert counts.agg(F.sum("pos").cast("double") * F.sum("neg").cast("double")).first()[0] == 1e20


def walk(rows, per_stage):
    """The sample taken row by row in shuffle order."""
    room, used, taken = {}, set(), []
    for row in sorted(rows, key=lambda r: r.shuffle_key):
        if room.get(row.stage, 0) < per_stage and row.match not in used:
            room[row.stage] = room.get(row.stage, 0) + 1
            used.add(row.match)
            taken.append(row.id)
    return sorted(taken)


@pytest.mark.parametrize("seed", range(4))
def test_exact_sample_equals_the_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(n, f"m{rng.choice([0, rng.randrange(25)])}", str(rng.choice([2, 2, 2, 3, 4, 12]))) for n in range(200)]
    shuffled = ordering.seeded_shuffle(table(spark, rows, "id bigint, match string, stage string"), "id", seed)
    per_stage = 1 + seed * 2
    got = sorted(r.id for r in sample.pick_exact(shuffled, "id", "match", per_stage).collect())
    assert got == walk(shuffled.collect(), per_stage)
    relaxed = sample.pick_relaxed(shuffled, "id", "match", per_stage).collect()
    assert len({r.match for r in relaxed}) == len(relaxed)


@pytest.mark.parametrize("limit", [7, 1500])
def test_top_per_stage(spark, limit):
    rows = [(n, str(n % 5 // 3)) for n in range(4000)]
    shuffled = ordering.seeded_shuffle(table(spark, rows, "id bigint, stage string"), "id", 1)
    got = sorted(r.id for r in sample.top_per_stage(shuffled, limit).collect())
    ordered = sorted(shuffled.collect(), key=lambda r: r.shuffle_key)
    assert got == sorted(r.id for stage in "01" for r in [r for r in ordered if r.stage == stage][:limit])


def test_augmentation(spark):
    rows = [(n, 1, list(range(280)), [1, 2, 3, 4, 5, 6]) for n in range(60)]
    df = table(spark, rows, "k int, outcome int, tensor array<int>, traits array<int>")
    same = augment.augment_sides(df, "k", prob=0.0).collect()
    assert all(r.outcome == 1 and r.traits == [1, 2, 3, 4, 5, 6] for r in same)
    turned = augment.augment_sides(df, "k", prob=1.0).collect()
    assert all(r.outcome == 0 and r.traits == [4, 5, 6, 1, 2, 3] and r.tensor[:56] == list(range(55, -1, -1)) for r in turned)
    some = {r.k: r.outcome for r in augment.augment_sides(df, "k", prob=0.5, seed=1).collect()}
    again = {r.k: r.outcome for r in augment.augment_sides(df.repartition(9), "k", prob=0.5, seed=1).collect()}
    assert some == again and 15 < sum(some.values()) < 45
    assert some != {r.k: r.outcome for r in augment.augment_sides(df, "k", prob=0.5, seed=1, epoch=1).collect()}
    limited = augment.augment_sides(df, "k", prob=1.0, where=F.col("k") < 10).collect()
    assert {r.k for r in limited if r.outcome == 0} == set(range(10))


def test_exact_sample_of_many_stages(spark):
    rng = random.Random(9)
    rows = [(n, None if n % 50 == 0 else rng.randrange(700), str(rng.choice([0, rng.randrange(1000)]))) for n in range(4000)]
    shuffled = ordering.seeded_shuffle(table(spark, rows, "id bigint, match bigint, stage string"), "id", 1)
    assert sorted(r.id for r in sample.pick_exact(shuffled, "id", "match", 2).collect()) == walk(shuffled.collect(), 2)


def test_heavy_groups_are_found_by_a_sketch(spark):
    rows = [(n, None if n % 10 == 0 else "hot" if n % 4 == 0 else f"k{n}") for n in range(9000)]
    df = table(spark, rows, "id int, g string", 9)
    assert sorted(str(r.g) for r in ordering.heavy_groups(df, ["g"], 500).collect()) == ["None", "hot"]
    assert [r.g for r in ordering.heavy_groups(df, ["g"], 1000).collect()] == ["hot"]
    assert ordering.heavy_groups(df, ["g"], 5, hot_share=0.5) is None
    assert ordering.heavy_groups(df.filter("id < 0"), ["g"], 0) is None


def counted_source(spark, rows, schema):
    """The rows and a counter of how many of them jobs have read."""
    read = spark.sparkContext.accumulator(0)

    def scan(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return table(spark, rows, schema, 5).mapInArrow(scan, schema), read


@pytest.mark.parametrize("kind", ["spread", "tied", "edge", "one"])
def test_cut_points_take_three_scans(spark, kind):
    rng = random.Random(5)
    n = 6000
    time = {
        "spread": lambda i: rng.randrange(-(1 << 62), 1 << 62),
        "tied": lambda i: rng.choice([7, 7, 7, 9, rng.randrange(20)]),
        "edge": lambda i: 5 if i < int(0.8 * n) else 6 if i < int(0.9 * n) + 1 else 7 + i,
        "one": lambda i: 3,
    }[kind]
    rows = [(time(i), rng.randrange(-(1 << 63), 1 << 63)) for i in range(n)]
    df, read = counted_source(spark, rows, "ts bigint, tie bigint")
    ordered = sorted(rows)
    assert split.cut_points(df, "ts", "tie", (0.8, 0.1)) == [ordered[int(0.8 * n)], ordered[int(0.8 * n) + int(0.1 * n)]]
    assert read.value <= 3 * n


def test_cut_points_when_a_sketch_is_wrong(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.randrange(100), n) for n in range(3000)]
    df = table(spark, rows, "ts bigint, tie bigint")
    ordered = sorted(rows)
    right = split._quantiles
    monkeypatch.setattr(split, "_quantiles", lambda sketch, ranks: right(sketch, [0.1] * len(ranks)))
    assert split.cut_points(df, "ts", "tie", (0.5, 0.2)) == [ordered[1500], ordered[2100]]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_asof_refuses_a_large_right_side(spark, monkeypatch, by):
    monkeypatch.setattr(asof, "MAX_DIM_ROWS", 10)
    one = table(spark, [(1, "a", 5)], "id int, g string, ts bigint")
    two = table(spark, [(n, "a", "x") for n in range(11)], "at bigint, g string, name string")
    with pytest.raises(Exception, match="more than 10 rows"):
        asof.asof_backward(one, two if by else two.drop("g"), "ts", "at", by=by, small=True).collect()


def test_binary_search(spark):
    from roundhouse.functions.arrays import last_at_most

    arrays = [[], [5], [1, 3], [1, 1, 1, 4], list(range(0, 200, 3))]
    rows = [(a, v) for a in arrays for v in (-1, 0, 1, 2, 3, 4, 5, 100, 198, 500, None)] + [(None, 1)]
    got = spark.createDataFrame(rows, "a array<bigint>, v bigint").select("a", "v", last_at_most(F.col("a"), F.col("v")).alias("p")).collect()
    assert all(r.p == (-1 if r.v is None else sum(x <= r.v for x in r.a or []) - 1) for r in got)
