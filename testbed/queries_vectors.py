"""Queries on feature vectors: wide, one-hot, ids, tensor, augmentation; from unit rows and inside the row."""

from __future__ import annotations

from pyspark.sql import functions as F

from roundhouse import BoardEncoder
from roundhouse.functions.arrays import rotate_board, swap_halves
from roundhouse.operators import assemble, augment, rounds, units
from roundhouse.schema import CHANNELS
from testbed import adapter
from testbed.adapter import KEY, dims
from testbed.queries_rounds import usable_nested
from testbed.queries_units import COST, ENCODED_FLAT, IDS_SQL, SLOT_NAMES, enriched, exploded, usable_flat
from testbed.registry import COL_SQL, COPIES, ENRICHED, FLAT, NENRICHED, NESTED, REACHED, ROW_SQL, TOTALS, USABLE, query

WIDE = dims().wide_names


def wide_ctes(usable: str) -> str:
    unit_columns = ", ".join(
        f"""cast(count(*) FILTER (team = '{t}' AND unit = '{u}' AND tier = {n}) AS bigint) AS "{t}_{u}_{n}" """
        for t in ("player", "opponent")
        for u in dims().units
        for n in (1, 2, 3, 4)
    )
    trait_columns = ", ".join(
        f"""cast(coalesce(max(CASE WHEN team = '{t}' AND trait = '{n}' AND level = {v} THEN 1 END), 0) AS bigint) AS "{c}" """
        for c, t, n, v in SLOT_NAMES
    )
    cost_columns = ", ".join(
        f"cast(sum(CASE WHEN team = '{t}' THEN {COST} ELSE 0 END) AS bigint) AS {t}_total_cost" for t in ("player", "opponent")
    )
    return f""", u AS (SELECT round_key, {unit_columns}, {cost_columns} FROM enriched GROUP BY round_key),
    t AS (SELECT round_key, {trait_columns} FROM {usable} LEFT JOIN reached USING (round_key) GROUP BY round_key),
    wide AS (SELECT * FROM u JOIN t USING (round_key))"""


def wide_as_bigint(df):
    return df.selectExpr("round_key", *[f"cast(`{c}` AS bigint) AS `{c}`" for c in WIDE])


@query("wide_features", f"{FLAT}{ENRICHED}{USABLE}{COPIES}{REACHED.format(counts='copies')}{wide_ctes('usable')} SELECT * FROM wide")
def wide_features(spark, d):
    vectors = assemble.wide_vectors(enriched(spark, d), KEY, dims()).filter("both_sides").drop("both_sides")
    wanted = adapter.rounds(spark, d).filter(rounds.countable_round()).select("round_key")
    return wide_as_bigint(assemble.spread(vectors.join(wanted, KEY), "features", WIDE))


@query("nested_wide_features", f"{NESTED}{NENRICHED}{COPIES}{REACHED.format(counts='copies')}{wide_ctes('nusable')} SELECT * FROM wide")
def nested_wide_features(spark, d):
    vector = BoardEncoder(dims()).wide_vector(F.col("player_board"), F.col("opponent_board"))
    return wide_as_bigint(assemble.spread(usable_nested(spark, d).select("round_key", vector.alias("features")), "features", WIDE))


REINDEXED = ["player_Brand#3_1", "missing_one", "opponent_T1_1", "player_total_cost", "missing_two"]


@query(
    "reindex_features",
    f"""{NESTED}{NENRICHED}{COPIES}{REACHED.format(counts='copies')}{wide_ctes('nusable')}
    SELECT round_key, "player_Brand#3_1", cast(0 AS bigint) AS missing_one, "opponent_T1_1", player_total_cost, cast(0 AS bigint) AS missing_two FROM wide""",
)
def reindex_features(spark, d):
    shown = assemble.reindex(nested_wide_features(spark, d), REINDEXED, KEY)
    return shown.select("round_key", *[F.col(f"`{c}`").cast("bigint").alias(c) for c in REINDEXED])


@query(
    "nested_trait_ids",
    f"{NESTED}{NENRICHED}{TOTALS}{REACHED.format(counts='totals')}{IDS_SQL.format(usable='nusable')} SELECT * FROM ids",
)
def nested_trait_ids(spark, d):
    ids = BoardEncoder(dims()).trait_id_pair(F.col("player_board"), F.col("opponent_board"))
    return usable_nested(spark, d).select("round_key", F.array_join(ids, ",").alias("trait_ids"))


@query(
    "nested_trait_onehot",
    f"{NESTED}{NENRICHED}{COPIES}{REACHED.format(counts='copies')} SELECT round_key, concat_ws(',', "
    + ", ".join(f"coalesce(max(CASE WHEN team = '{t}' AND trait = '{n}' AND level = {v} THEN 1 END), 0)" for c, t, n, v in SLOT_NAMES)
    + ") AS onehot FROM nusable LEFT JOIN reached USING (round_key) GROUP BY round_key",
)
def nested_trait_onehot(spark, d):
    flags = BoardEncoder(dims()).onehot_pair(F.col("player_board"), F.col("opponent_board"))
    return usable_nested(spark, d).select("round_key", F.array_join(flags, ",").alias("onehot"))


# -- boards ------------------------------------------------------------------------------------------------------------

RECORDS = f""", placed AS (SELECT s.*, unit_id, {ROW_SQL} AS r, {COL_SQL} AS c FROM slots s JOIN unit_dim USING (unit)),
records AS (
  SELECT *, (CASE WHEN team = 'player' THEN r + 4 ELSE 3 - r END) * 7 + CASE WHEN team = 'player' THEN c ELSE 6 - c END AS cell
  FROM (SELECT *, row_number() OVER (PARTITION BY round_key ORDER BY team DESC, {{order}}) AS k FROM placed WHERE r >= 0) WHERE k <= 24),
cells AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY round_key, cell ORDER BY k DESC) AS last FROM records) WHERE last = 1)"""
NSLOTS = ENCODED_FLAT.format(source="(SELECT n.* FROM nunits n JOIN nusable USING (round_key))")
NRECORDS = f"{NESTED}{NSLOTS}{RECORDS.format(order='pos')}"
FRECORDS = f"{FLAT}{USABLE}{ENCODED_FLAT.format(source='(SELECT n.* FROM units n JOIN usable USING (round_key))')}{RECORDS.format(order='p1, p2, p3')}"
TENSOR = """, tensor AS (
  SELECT round_key, array_to_string([{lists}], ',') AS tensor FROM {usable} LEFT JOIN cells USING (round_key) GROUP BY round_key)""".replace(
    "{lists}",
    ", ".join(
        f"coalesce(max(CASE WHEN cell = {cell} THEN {value} END), 0)"
        for value in ("unit_id", "coalesce(tier, 0)", "item1", "item2", "item3")
        for cell in range(56)
    ),
)


@query("unit_records", f"{NRECORDS} SELECT round_key, team, pos, r, c, unit_id, coalesce(tier, 0) AS tier, item1, item2, item3 FROM records")
def unit_records(spark, d):
    records = units.unit_records(exploded(spark, d), KEY, dims())
    return records.select(
        "round_key", "team", F.col("pos").cast("bigint").alias("pos"), F.col("row").alias("r"), F.col("col").alias("c"), "unit_id", "tier", "item1", "item2", "item3"
    )


@query("unit_cap", f"{NRECORDS} SELECT round_key, count(*) AS kept FROM records GROUP BY round_key")
def unit_cap(spark, d):
    placed = units.place_units(exploded(spark, d), dims())
    return units.cap_units(placed, KEY).groupBy("round_key").agg(F.count(F.lit(1)).alias("kept"))


@query("cell_dedup", f"{NRECORDS} SELECT round_key, cell, unit_id, coalesce(tier, 0) AS tier, item1, item2, item3 FROM cells")
def cell_dedup(spark, d):
    return units.cell_values(units.unit_records(exploded(spark, d), KEY, dims()), KEY)


@query("board_cells", f"{FRECORDS} SELECT round_key, cell, unit_id, coalesce(tier, 0) AS tier, item1, item2, item3 FROM cells")
def board_cells(spark, d):
    records = units.unit_records(adapter.units(spark, d), KEY, dims())
    return units.cell_values(records, KEY).join(usable_flat(spark, d).select("round_key"), KEY)


def flat_tensor(spark, d):
    """Tensors of the usable rounds of the flat form; a round without a placed unit is an empty board."""
    tensors = assemble.board_tensors(adapter.units(spark, d), KEY, dims())
    empty = F.array_repeat(F.lit(0), len(CHANNELS) * 56)
    joined = usable_flat(spark, d).join(tensors, KEY, "left")
    return joined.select("round_key", "match_uuid", "ts", F.coalesce("tensor", empty).alias("tensor"))


@query("board_tensor", f"{FRECORDS}{TENSOR.replace('{usable}', 'usable')} SELECT * FROM tensor")
def board_tensor(spark, d):
    return flat_tensor(spark, d).select("round_key", F.array_join("tensor", ",").alias("tensor"))


def nested_tensor(spark, d):
    encoder = BoardEncoder(dims())
    sides = F.col("player_board"), F.col("opponent_board")
    return usable_nested(spark, d).select(
        "round_key",
        "timestamp",
        F.col("outcome").cast("int").alias("outcome"),
        encoder.board_tensor(*sides).alias("tensor"),
        encoder.trait_id_pair(*sides).alias("traits"),
    )


@query("nested_board_tensor", f"{NRECORDS}{TENSOR.replace('{usable}', 'nusable')} SELECT * FROM tensor")
def nested_board_tensor(spark, d):
    return nested_tensor(spark, d).select("round_key", F.array_join("tensor", ",").alias("tensor"))


TURNED = "array_to_string(flatten([list_reverse(list_slice(string_split(tensor, ','), c * 56 + 1, c * 56 + 56)) for c in [0, 1, 2, 3, 4]]), ',')"


@query("rotate_board", f"{NRECORDS}{TENSOR.replace('{usable}', 'nusable')} SELECT round_key, {TURNED} AS tensor FROM tensor")
def rotate(spark, d):
    turned = rotate_board(F.col("tensor"), len(CHANNELS))
    return nested_tensor(spark, d).select("round_key", F.array_join(turned, ",").alias("tensor"))


SWAPPED = "array_to_string(list_slice(string_split(trait_ids, ','), 16, 30) || list_slice(string_split(trait_ids, ','), 1, 15), ',')"
NIDS = f"{NENRICHED}{TOTALS}{REACHED.format(counts='totals')}{IDS_SQL.format(usable='nusable')}"


@query("swap_halves", f"{NESTED}{NIDS} SELECT round_key, {SWAPPED} AS trait_ids FROM ids")
def swap(spark, d):
    return nested_tensor(spark, d).select("round_key", F.array_join(swap_halves(F.col("traits")), ",").alias("trait_ids"))


@query(
    "augment",
    f"""{NRECORDS}{TENSOR.replace('{usable}', 'nusable')}{NIDS},
    coins AS (SELECT *, ('0x' || substr(md5(concat(round_key, '|7|0')), 1, 8))::bigint / 4294967296.0 < 0.5 AS swap
      FROM nusable JOIN tensor USING (round_key) JOIN ids USING (round_key))
    SELECT round_key, CASE WHEN swap THEN 1 - outcome ELSE outcome END AS outcome,
      CASE WHEN swap THEN {TURNED} ELSE tensor END AS tensor, CASE WHEN swap THEN {SWAPPED} ELSE trait_ids END AS traits FROM coins""",
)
def augmented(spark, d):
    swapped = augment.augment_sides(nested_tensor(spark, d), "round_key", seed=7)
    return swapped.select("round_key", "outcome", F.array_join("tensor", ",").alias("tensor"), F.array_join("traits", ",").alias("traits"))
