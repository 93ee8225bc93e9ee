"""Test tables as rounds and units, in Spark and, as text, in SQL.

Two forms. *Flat*: ``orders`` are rounds and ``lineitem`` join ``part`` are unit rows. *Nested*: each order carries two boards
computed from its own columns, with the irregular cases the flat form lacks (empty and missing boards, more than 24 units,
null tiers, cells and items, lower-case cells).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundhouse.dims import Dims, Unit
from roundhouse.functions.arrays import let

KEY = ["round_key"]
DAY_MS = 86_400_000
BRANDS = [b for b in range(1, 26) if b != 24]

TRAITS = {
    "T0": (1, 2, 3),
    "T1": (2,),
    "T2": (1,),
    "T3": (2, 3),
    "T4": (1, 3),
    "T5": (2, 4),
    "T6": (1, 2),
    "T7": (2, 3, 4),
    "T8": (1,),
    "T9": (1, 2),
}
EMBLEMS = {"I0": "T0", "I3": "T7", "I7": "T4"}
RELEASES = [(f"R{n}", year, month) for n, (year, month) in enumerate(((y, m) for y in range(1995, 2001) for m in (6, 12)), start=1)]


def _brand_traits(b: int) -> tuple[str, ...]:
    if b == 25:
        return ()
    first = f"T{b % 6}"
    return (first,) if b % 5 == 0 else (first, f"T{6 + b % 4}")


def _epoch_ms(year: int, month: int) -> int:
    from datetime import UTC, datetime

    return int(datetime(year, month, 1, tzinfo=UTC).timestamp()) * 1000


def dims() -> Dims:
    """The literal dimensions of the adapter."""
    return Dims(
        units={f"Brand#{b}": Unit(1 + b % 5, _brand_traits(b)) for b in BRANDS},
        traits=TRAITS,
        emblems=EMBLEMS,
        items=tuple(f"I{n}" for n in range(12)),
        patches=tuple((name, _epoch_ms(year, month)) for name, year, month in RELEASES),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round per order."""
    k = F.col("o_orderkey")
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint") * DAY_MS
    return table(spark, sf_dir, "orders").select(
        k.alias("round_key"),
        F.concat(F.lit("M"), _text("o_custkey")).alias("match_uuid"),
        F.concat(F.lit("P"), _text(k % 2)).alias("player_uuid"),
        F.concat(_text(1 + k % 7), F.lit("-"), _text(1 + k % 3)).alias("round_name"),
        F.when(F.col("o_orderpriority") == "5-LOW", "PVE").otherwise("PVP").alias("round_type"),
        F.when(F.col("o_orderstatus") == "F", "victory")
        .when((F.col("o_orderstatus") == "P") & (k % 4 == 0), F.lit(None).cast("string"))
        .otherwise("defeat")
        .alias("round_outcome"),
        (day + (k % 86400) * 1000).alias("timestamp"),
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit row per lineitem. ``pos`` is a struct that sorts like the list order, so no window is needed to make it."""
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    i_part, i_supp = (F.concat(F.lit("I"), _text(F.col(c) % 12)) for c in ("l_partkey", "l_suppkey"))
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("round_key"),
        F.when(F.col("l_linestatus") == "F", "player").otherwise("opponent").alias("team"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"),
        F.col("p_brand").alias("unit"),
        (F.col("l_linenumber") % 5).cast("bigint").alias("tier"),
        F.concat(
            F.substring(F.lit("ABCDE"), (1 + F.col("l_partkey") % 5).cast("int"), F.lit(1)),
            F.when(F.col("l_linenumber") % 2 == 0, "_").otherwise(""),
            _text(1 + F.col("l_suppkey") % 8),
        ).alias("loc"),
        F.slice(F.array(i_part, i_supp, F.lit("IX"), i_part), F.lit(1), (F.col("l_quantity").cast("int") % 5)).alias("item_ids"),
    )


def nested_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds with both boards as arrays, every board computed inside its row."""
    # a board is far larger than its order, and files of orders can be one row group each: orders are dealt to all cores first
    cores = spark.sparkContext.defaultParallelism
    base = rounds(spark, sf_dir).withColumn("cust", F.substring("match_uuid", 2, 30).cast("bigint")).repartition(cores, "round_key")
    k, c = F.col("round_key"), F.col("cust")
    sizes = {
        "player": F.when(k % 50 == 0, 0).when(k % 97 == 0, 30).otherwise(1 + k % 10),
        "opponent": F.when(k % 97 == 0, 12).otherwise(1 + c % 10),
    }
    boards = {}
    for side, team in enumerate(("player", "opponent")):
        board = F.transform(
            F.slice(F.sequence(F.lit(0), F.lit(29)), F.lit(1), sizes[team].cast("int")), _unit_maker(k, c, side)
        )
        boards[team] = F.when(k % 61 == 0, F.lit(None)).otherwise(board) if side else board
    made = F.struct(*[board.alias(f"{team}_board") for team, board in boards.items()])
    # exploding a single element computes the boards once per row, where a projection would be inlined into every use
    return base.select(
        "round_key",
        *["match_uuid", "player_uuid", "round_name", "round_type", "round_outcome", "timestamp"],
        F.explode(F.array(made)).alias("board_data"),
    )


def _unit_maker(k: Column, c: Column, side: int):
    def unit(i: Column, h: Column) -> Column:
        item = [F.concat(F.lit("I"), _text(((h - h % 7) / 7).cast("bigint") % 14)), F.lit(""), F.lit(None).cast("string"), F.concat(F.lit("I"), _text(h % 12))]
        letter = F.substring(F.lit("ABCDabcdABCDE"), (1 + (h + i) % 13).cast("int"), F.lit(1))
        return F.struct(
            F.concat(F.lit("Brand#"), _text(1 + h % 25)).alias("unit"),
            F.when(h % 11 == 0, F.lit(None)).otherwise((h + k) % 6).cast("bigint").alias("tier"),
            F.slice(F.array(item[3], *item[:3]), F.lit(1), (h % 5).cast("int")).alias("item_ids"),
            F.when(h % 13 == 0, F.lit(None)).otherwise(
                F.concat(letter, F.when(h % 3 == 0, "_").otherwise(""), _text(1 + (h + i * 5) % 8))
            ).alias("loc"),
        )

    def numbered(i: Column) -> Column:
        i = i.cast("bigint")
        return let(k * 7919 + c * 104729 + i * 613 + side * 31337, lambda h: unit(i, h))

    return numbered


# -- the same definitions for the oracle ------------------------------------------------------------------------------

ROUNDS_SQL = """
rounds AS (
  SELECT o_orderkey AS round_key, o_custkey AS cust,
         concat('M', cast(o_custkey AS varchar)) AS match_uuid,
         concat('P', cast(o_orderkey % 2 AS varchar)) AS player_uuid,
         concat(cast(1 + o_orderkey % 7 AS varchar), '-', cast(1 + o_orderkey % 3 AS varchar)) AS round_name,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'PVE' ELSE 'PVP' END AS round_type,
         CASE WHEN o_orderstatus = 'F' THEN 'victory'
              WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN NULL ELSE 'defeat' END AS round_outcome,
         epoch_ms(o_orderdate) + (o_orderkey % 86400) * 1000 AS ts
  FROM orders)"""

UNITS_SQL = """
units AS (
  SELECT l_orderkey AS round_key,
         CASE WHEN l_linestatus = 'F' THEN 'player' ELSE 'opponent' END AS team,
         l_linenumber AS p1, l_partkey AS p2, l_suppkey AS p3,
         p_brand AS unit,
         cast(l_linenumber % 5 AS bigint) AS tier,
         concat(substr('ABCDE', cast(1 + l_partkey % 5 AS int), 1),
                CASE WHEN l_linenumber % 2 = 0 THEN '_' ELSE '' END,
                cast(1 + l_suppkey % 8 AS varchar)) AS loc,
         list_slice(['I' || (l_partkey % 12), 'I' || (l_suppkey % 12), 'IX', 'I' || (l_partkey % 12)],
                    1, cast(trunc(l_quantity) AS int) % 5) AS item_ids
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

NESTED_SQL = """
sizes AS (
  SELECT round_key, cust, 0 AS side, 'player' AS team,
         CASE WHEN round_key % 50 = 0 THEN 0 WHEN round_key % 97 = 0 THEN 30 ELSE 1 + round_key % 10 END AS n FROM rounds
  UNION ALL
  SELECT round_key, cust, 1, 'opponent',
         CASE WHEN round_key % 61 = 0 THEN NULL WHEN round_key % 97 = 0 THEN 12 ELSE 1 + cust % 10 END FROM rounds),
hashed AS (
  SELECT round_key, team, i AS pos, round_key * 7919 + cust * 104729 + i * 613 + side * 31337 AS h
  FROM sizes JOIN (SELECT unnest(range(0, 30)) AS i) ON i < n),
nunits AS (
  SELECT round_key, team, pos, concat('Brand#', cast(1 + h % 25 AS varchar)) AS unit,
         CASE WHEN h % 11 = 0 THEN NULL ELSE (h + round_key) % 6 END AS tier,
         list_slice(['I' || (h % 12), 'I' || ((h // 7) % 14), '', NULL], 1, h % 5) AS item_ids,
         CASE WHEN h % 13 = 0 THEN NULL
              ELSE concat(substr('ABCDabcdABCDE', cast(1 + (h + pos) % 13 AS int), 1),
                          CASE WHEN h % 3 = 0 THEN '_' ELSE '' END, cast(1 + (h + pos * 5) % 8 AS varchar)) END AS loc
  FROM hashed),
nusable AS (
  SELECT round_key, cust, match_uuid, player_uuid, round_name, ts,
         CASE WHEN round_outcome = 'victory' THEN 1 ELSE 0 END AS outcome
  FROM rounds
  WHERE round_type <> 'PVE' AND NOT starts_with(round_name, '1-') AND round_outcome IS NOT NULL
    AND round_key IN (SELECT round_key FROM sizes GROUP BY round_key HAVING min(coalesce(n, 0)) > 0))"""

_POINTS = ", ".join(f"('{t}', {list(p)}, {n})" for n, (t, p) in enumerate(TRAITS.items()))
_EMBLEM_ROWS = ", ".join(f"('{i}', '{t}')" for i, t in EMBLEMS.items())
_PATCH_ROWS = ", ".join(f"('{name}', {_epoch_ms(y, m)}, {n})" for n, (name, y, m) in enumerate(RELEASES, start=1))

DIMS_SQL = f"""
unit_dim AS (
  SELECT concat('Brand#', cast(b AS varchar)) AS unit, 1 + b % 5 AS cost,
         CASE WHEN b = 25 THEN CAST([] AS varchar[]) WHEN b % 5 = 0 THEN ['T' || (b % 6)]
              ELSE ['T' || (b % 6), 'T' || (6 + b % 4)] END AS traits,
         row_number() OVER (ORDER BY b) AS unit_id
  FROM (SELECT unnest(range(1, 26)) AS b) WHERE b <> 24),
trait_dim AS (SELECT * FROM (VALUES {_POINTS}) t(trait, points, trait_no)),
trait_points AS (
  SELECT trait, trait_no, bp, row_number() OVER (ORDER BY trait_no, bp) AS trait_id,
         row_number() OVER (PARTITION BY trait ORDER BY bp) AS level
  FROM (SELECT trait, trait_no, unnest(points) AS bp FROM trait_dim)),
emblem_dim AS (SELECT * FROM (VALUES {_EMBLEM_ROWS}) e(item, trait)),
item_vocab AS (SELECT 'I' || i AS item, i + 1 AS item_id FROM (SELECT unnest(range(0, 12)) AS i)),
patch_dim AS (SELECT * FROM (VALUES {_PATCH_ROWS}) p(patch, release_ts, patch_id))"""
