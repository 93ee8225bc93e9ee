"""Queries on rounds: scans, filters, keys, order, split, as-of, sampling, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from roundhouse.functions import cells, scalars
from roundhouse.operators import asof, augment, ordering, rounds, sample, split, units, validate
from testbed import adapter
from testbed.adapter import KEY, dims
from testbed.registry import COL_SQL, FLAT, NESTED, ROW_SQL, USABLE, query

ROUND_COLS = ["round_key", "match_uuid", "player_uuid", "round_name", "round_type", "round_outcome"]


def usable_nested(spark, d):
    """Usable rounds, labelled and with the boards unnested."""
    return rounds.labelled_rounds(rounds.usable_rounds(adapter.nested_rounds(spark, d)))


@query("scan_rounds", f"{FLAT} SELECT {', '.join(ROUND_COLS)}, ts FROM rounds")
def scan_rounds(spark, d):
    return adapter.rounds(spark, d).select(*ROUND_COLS, F.col("timestamp").alias("ts"))


@query(
    "scan_filter_project",
    f"{FLAT} SELECT match_uuid, round_name, round_outcome FROM rounds WHERE round_type = 'PVP' AND round_outcome IN ('victory', 'defeat')",
)
def scan_filter_project(spark, d):
    r = adapter.rounds(spark, d)
    return r.filter((F.col("round_type") == "PVP") & F.col("round_outcome").isin("victory", "defeat")).select(
        "match_uuid", "round_name", "round_outcome"
    )


@query(
    "usable_rounds",
    f"""{NESTED} SELECT round_key, round_name,
    (SELECT n FROM sizes s WHERE s.round_key = u.round_key AND side = 0) AS player_units,
    (SELECT n FROM sizes s WHERE s.round_key = u.round_key AND side = 1) AS opponent_units FROM nusable u""",
)
def usable_rounds(spark, d):
    return rounds.usable_rounds(adapter.nested_rounds(spark, d)).select(
        "round_key",
        "round_name",
        F.size("board_data.player_board").cast("bigint").alias("player_units"),
        F.size("board_data.opponent_board").cast("bigint").alias("opponent_units"),
    )


@query("usable_rounds_flat", f"{FLAT}{USABLE} SELECT round_key, match_uuid, round_name, ts FROM usable")
def usable_rounds_flat(spark, d):
    # one row per round leaves the map side, and only those rows are joined
    sides = adapter.units(spark, d).groupBy("round_key").agg(units.both_sides().alias("both")).filter("both")
    wanted = adapter.rounds(spark, d).filter(rounds.countable_round())
    return wanted.join(sides, KEY, "left_semi").select("round_key", "match_uuid", "round_name", F.col("timestamp").alias("ts"))


@query("round_labels", f"{NESTED} SELECT round_key, cast(outcome AS bigint) AS outcome FROM nusable")
def round_labels(spark, d):
    return usable_nested(spark, d).select("round_key", F.col("outcome").cast("bigint").alias("outcome"))


INSTANCE_SQL = """SELECT *, row_number() OVER (PARTITION BY match_uuid, player_uuid, round_name ORDER BY ts, round_key) - 1
AS round_instance FROM rounds"""


def instanced(spark, d, **options):
    return rounds.with_round_instance(adapter.rounds(spark, d), order=("timestamp", "round_key"), **options)


@query("round_instance", f"{FLAT} SELECT round_key, round_instance FROM ({INSTANCE_SQL})")
def round_instance(spark, d):
    return instanced(spark, d).select("round_key", "round_instance")


@query(
    "round_key",
    f"""{FLAT} SELECT round_key, concat(match_uuid, '_', player_uuid, '_', round_name, '_', round_instance) AS full_key,
    concat(match_uuid, '_', round_name, '_', round_instance) AS short_key FROM ({INSTANCE_SQL})""",
)
def round_key(spark, d):
    return instanced(spark, d).select(
        "round_key", rounds.round_key().alias("full_key"), rounds.round_key(include_player=False).alias("short_key")
    )


@query("stage_of", rf"{FLAT} SELECT round_key, CASE WHEN regexp_matches(split_part(round_name, '-', 1), '^[0-9]+$') THEN split_part(round_name, '-', 1) END AS stage FROM rounds")
def stage_of(spark, d):
    return adapter.rounds(spark, d).select("round_key", scalars.stage_of(F.col("round_name")).alias("stage"))


# -- order and split ---------------------------------------------------------------------------------------------------


@query("chrono_sort", f"{FLAT} SELECT round_key, ts FROM rounds ORDER BY ts, round_key")
def chrono_sort(spark, d):
    r = adapter.rounds(spark, d).select("round_key", F.col("timestamp").alias("ts"))
    return split.chrono_sort(r, "ts", "round_key")


@query("chrono_rank", f"{FLAT} SELECT round_key, row_number() OVER (ORDER BY ts, round_key) - 1 AS chrono_rank FROM rounds")
def chrono_rank(spark, d):
    r = adapter.rounds(spark, d).select("round_key", "timestamp")
    return ordering.global_rank(r, ["timestamp", "round_key"], "chrono_rank").select("round_key", "chrono_rank")


CUTS = "cast(floor(0.8::double * count(*)) AS bigint) AS a, cast(floor(0.1::double * count(*)) AS bigint) AS b"


@query(
    "chrono_split",
    f"""{FLAT}, ranked AS (SELECT round_key, row_number() OVER (ORDER BY ts, round_key) - 1 AS r FROM rounds),
    cut AS (SELECT {CUTS} FROM rounds)
    SELECT round_key, CASE WHEN r < a THEN 'train' WHEN r < a + b THEN 'val' ELSE 'test' END AS split FROM ranked, cut""",
)
def chrono_split(spark, d):
    r = adapter.rounds(spark, d).select("round_key", "timestamp")
    return split.chrono_split(r, "timestamp", "round_key").select("round_key", "split")


@query(
    "chrono_split_2way",
    f"""{FLAT}, ranked AS (SELECT round_key, row_number() OVER (ORDER BY ts, round_key) - 1 AS r FROM rounds),
    cut AS (SELECT {CUTS} FROM rounds)
    SELECT round_key, CASE WHEN r < a THEN 'train' ELSE 'test' END AS split FROM ranked, cut""",
)
def chrono_split_2way(spark, d):
    r = adapter.rounds(spark, d).select("round_key", "timestamp")
    return split.chrono_split(r, "timestamp", "round_key", (0.8,)).select("round_key", "split")


@query(
    "chrono_split_by_match",
    f"""{FLAT}, ranked AS (SELECT round_key, match_uuid, row_number() OVER (ORDER BY ts, round_key) - 1 AS r FROM rounds),
    cut AS (SELECT {CUTS} FROM rounds), firsts AS (SELECT match_uuid, min(r) AS r FROM ranked GROUP BY 1)
    SELECT ranked.round_key, CASE WHEN f.r < a THEN 'train' WHEN f.r < a + b THEN 'val' ELSE 'test' END AS split
    FROM ranked JOIN firsts f USING (match_uuid), cut""",
)
def chrono_split_by_match(spark, d):
    r = adapter.rounds(spark, d).select("round_key", "match_uuid", "timestamp")
    return split.chrono_split(r, "timestamp", "round_key", keep_together="match_uuid").select("round_key", "split")


@query(
    "chrono_violations",
    """SELECT cast(coalesce(sum(CASE WHEN before > ts THEN 1 ELSE 0 END), 0) AS bigint) AS violations
    FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS before FROM events)""",
)
def chrono_violations(spark, d):
    return ordering.order_violations(adapter.table(spark, d, "events"), ["event_id"], "ts")


@query(
    "seeded_shuffle",
    "SELECT o_orderkey AS round_key, row_number() OVER (ORDER BY md5(concat(o_orderkey, '|16'))) - 1 AS position FROM orders",
)
def seeded_shuffle(spark, d):
    keys = adapter.table(spark, d, "orders").select(F.col("o_orderkey").alias("round_key"))
    shuffled = ordering.seeded_shuffle(keys, "round_key", 16)
    return ordering.global_rank(shuffled, ["shuffle_key", "round_key"], "position").select("round_key", "position")


# -- as-of -------------------------------------------------------------------------------------------------------------


@query(
    "patch_asof",
    f"""{FLAT} SELECT round_key, cast(coalesce((SELECT max(patch_id) FROM patch_dim p WHERE p.release_ts <= r.ts), 0) AS bigint) AS patch_id FROM rounds r""",
)
def patch_asof(spark, d):
    r = adapter.rounds(spark, d).select("round_key", "timestamp")
    joined = asof.asof_backward(r, dims().patch_frame(spark), "timestamp", "release_ts", small=True)
    return joined.select("round_key", F.coalesce("patch_id", F.lit(0).cast("bigint")).alias("patch_id"))


@query(
    "asof_join_union",
    """SELECT l.event_id, r.event_id AS signup_id, r.value AS signup_value FROM
    (SELECT * FROM events WHERE event_type <> 'signup') l
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') r ON l.user_id = r.user_id AND l.ts >= r.ts""",
)
def asof_join_union(spark, d):
    e = adapter.table(spark, d, "events")
    left = e.filter("event_type <> 'signup'").select("user_id", "event_id", "ts")
    right = e.filter("event_type = 'signup'").select(
        "user_id", F.col("ts").alias("signup_ts"), F.col("event_id").alias("signup_id"), F.col("value").alias("signup_value")
    )
    joined = asof.asof_backward(left, right, "ts", "signup_ts", by=["user_id"], small=False)
    return joined.select("event_id", "signup_id", "signup_value")


@query(
    "asof_nulls",
    """WITH e AS (SELECT event_id, event_type, value, CASE WHEN event_id % 7 <> 0 THEN user_id END AS u, CASE WHEN event_id % 11 <> 0 THEN ts END AS t FROM events)
    SELECT l.event_id, r.event_id AS signup_id FROM (SELECT * FROM e WHERE event_type <> 'signup') l
    ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'signup' AND u IS NOT NULL AND t IS NOT NULL) r ON l.u = r.u AND l.t >= r.t""",
)
def asof_nulls(spark, d):
    """As-of join in which keys and times are missing on both sides."""
    e = adapter.table(spark, d, "events")
    e = e.select("event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("u"), F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("t"))
    left = e.filter("event_type <> 'signup'").select("event_id", "u", "t")
    right = e.filter("event_type = 'signup'").select("u", F.col("t").alias("signup_t"), F.col("event_id").alias("signup_id"))
    return asof.asof_backward(left, right, "t", "signup_t", by=["u"]).select("event_id", "signup_id")


@query(
    "recency_weight",
    f"""{FLAT}, p AS (SELECT round_key, coalesce((SELECT max(patch_id) FROM patch_dim p WHERE p.release_ts <= r.ts), 0) AS patch_id FROM rounds r)
    SELECT round_key, round(exp(-0.1 * ((SELECT max(patch_id) FROM p) - patch_id)), 8) AS weight FROM p""",
)
def recency_weight(spark, d):
    weighted = augment.with_recency_weight(patch_asof(spark, d), "patch_id")
    return weighted.select("round_key", F.round("weight", 8).alias("weight"))


# -- sampling ----------------------------------------------------------------------------------------------------------

ELIGIBLE = """, eligible AS (
  SELECT round_key FROM rounds WHERE round_type = 'PVP' AND round_outcome IN ('victory', 'defeat')
    AND round_key IN (SELECT round_key FROM sizes GROUP BY round_key HAVING min(coalesce(n, 0)) >= 3))"""
BAD_UNITS = r""", bad AS (
  SELECT DISTINCT round_key FROM nunits
  WHERE NOT coalesce(regexp_matches(replace(loc, '_', ''), '^[A-D][1-7]$'), false)
     OR unit NOT IN (SELECT unit FROM unit_dim)
     OR len(list_filter(list_filter(item_ids, lambda i: i IS NOT NULL AND i <> '')[1:3],
                        lambda i: NOT list_contains(['I0', 'I1', 'I2', 'I3', 'I4', 'I5', 'I6', 'I7', 'I8', 'I9', 'I10', 'I11'], i))) > 0)"""


@query("sample_eligible", f"{NESTED}{ELIGIBLE} SELECT round_key FROM eligible")
def sample_eligible(spark, d):
    return rounds.sample_eligible(adapter.nested_rounds(spark, d)).select("round_key")


@query("sample_valid", f"{NESTED}{BAD_UNITS} SELECT round_key FROM sizes GROUP BY round_key HAVING count(n) = 2 AND round_key NOT IN (SELECT round_key FROM bad)")
def sample_valid(spark, d):
    return rounds.sample_valid(adapter.nested_rounds(spark, d), dims()).select("round_key")


def staged(spark, d, min_units=1):
    valid = rounds.sample_valid(rounds.sample_eligible(adapter.nested_rounds(spark, d), min_units=min_units), dims())
    rows = valid.withColumn("stage", scalars.stage_of(F.col("round_name"))).filter("stage is not null")
    return ordering.seeded_shuffle(rows.select("round_key", "match_uuid", "stage"), "round_key", 16)


@query(
    "stage_sample",
    f"""{NESTED}, eligible AS (
      SELECT * FROM rounds WHERE round_type = 'PVP' AND round_outcome IN ('victory', 'defeat')
        AND round_key IN (SELECT round_key FROM sizes GROUP BY round_key HAVING min(coalesce(n, 0)) >= 1)){BAD_UNITS},
    hashed_rows AS (SELECT round_key, match_uuid, split_part(round_name, '-', 1) AS stage, md5(concat(round_key, '|16')) AS k
      FROM eligible WHERE round_key NOT IN (SELECT round_key FROM bad)),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY match_uuid ORDER BY k) AS m FROM hashed_rows),
    tops AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY k) AS n FROM firsts WHERE m = 1)
    SELECT stage, round_key, match_uuid FROM tops WHERE n <= 10""",
)
def stage_sample(spark, d):
    picked = sample.pick_relaxed(staged(spark, d), "round_key", "match_uuid", 10)
    return picked.select("stage", "round_key", "match_uuid")


@query(
    "stage_sample_exact",
    f"""{NESTED.replace("WITH", "WITH RECURSIVE", 1)}, eligible AS (
      SELECT * FROM rounds WHERE round_type = 'PVP' AND round_outcome IN ('victory', 'defeat')
        AND round_key IN (SELECT round_key FROM sizes GROUP BY round_key HAVING min(coalesce(n, 0)) >= 1)){BAD_UNITS},
    hashed_rows AS (SELECT round_key, match_uuid, split_part(round_name, '-', 1) AS stage, md5(concat(round_key, '|16')) AS k
      FROM eligible WHERE round_key NOT IN (SELECT round_key FROM bad)),
    queue AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY k) AS i FROM hashed_rows),
    walk AS (
      SELECT cast(0 AS bigint) AS i, cast([] AS varchar[]) AS used, cast([] AS varchar[]) AS stages, cast([] AS bigint[]) AS taken
      UNION ALL
      SELECT i, CASE WHEN ok THEN list_append(used, match_uuid) ELSE used END, CASE WHEN ok THEN list_append(stages, stage) ELSE stages END,
        CASE WHEN ok THEN list_append(taken, round_key) ELSE taken END
      FROM (SELECT q.*, used, stages, taken, NOT list_contains(used, match_uuid) AND len(list_filter(stages, lambda s: s = stage)) < 10 AS ok
            FROM walk JOIN queue q ON q.i = walk.i + 1))
    SELECT stage, round_key, match_uuid FROM queue WHERE round_key IN (SELECT unnest(taken) FROM (SELECT taken FROM walk ORDER BY i DESC LIMIT 1))""",
)
def stage_sample_exact(spark, d):
    picked = sample.pick_exact(staged(spark, d), "round_key", "match_uuid", 10)
    return picked.select("stage", "round_key", "match_uuid")


# -- validation --------------------------------------------------------------------------------------------------------


def requests(spark, d):
    """Boards as a caller would send them, with the raw rounds' bad cells and tiers left in."""

    def side(board):
        return F.transform(
            board,
            lambda u: F.struct(
                u["unit"].alias("unit"),
                u["tier"].alias("tier"),
                u["item_ids"].alias("items"),
                cells.cell_row(u["loc"]).cast("bigint").alias("row"),
                cells.cell_col(u["loc"]).cast("bigint").alias("col"),
            ),
        )

    model = F.element_at(F.array(*[F.lit(m) for m in ("vit", "cnn", "XGBoost", "tree")]), (1 + F.col("round_key") % 4).cast("int"))
    return adapter.nested_rounds(spark, d).select(
        "round_key",
        model.alias("model"),
        side(F.col("board_data.player_board")).alias("player"),
        side(F.col("board_data.opponent_board")).alias("opponent"),
    )


@query(
    "board_validation",
    f"""{NESTED}, placed AS (SELECT round_key, team, tier, {ROW_SQL} AS r, {COL_SQL} AS c FROM nunits),
    found AS (
      SELECT round_key, team || '.tier' AS v FROM placed WHERE coalesce(tier, 1) NOT BETWEEN 1 AND 4
      UNION SELECT round_key, team || '.row' FROM placed WHERE r NOT BETWEEN 0 AND 3
      UNION SELECT round_key, team || '.col' FROM placed WHERE c NOT BETWEEN 0 AND 6
      UNION SELECT round_key, 'model' FROM rounds WHERE round_key % 4 = 3)
    SELECT r.round_key, coalesce(v.list, '') AS violations, CASE WHEN v.list IS NULL THEN 1 ELSE 0 END AS valid
    FROM rounds r LEFT JOIN (SELECT round_key, string_agg(v, ',' ORDER BY v) AS list FROM found GROUP BY 1) v USING (round_key)""",
)
def board_validation(spark, d):
    checked = validate.validate_boards(requests(spark, d))
    return checked.select("round_key", F.array_join("violations", ",").alias("violations"), F.col("valid").cast("int").alias("valid"))
