"""Where queries register themselves with, when SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from testbed.adapter import DIMS_SQL, NESTED_SQL, ROUNDS_SQL, UNITS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FLAT = f"WITH {ROUNDS_SQL}, {UNITS_SQL}, {DIMS_SQL}"
NESTED = f"WITH {ROUNDS_SQL}, {NESTED_SQL}, {DIMS_SQL}"

# fragments shared by several oracles
ENRICHED = """, enriched AS (SELECT u.*, d.cost, d.traits, d.unit_id FROM units u LEFT JOIN unit_dim d USING (unit))"""
NENRICHED = """, enriched AS (SELECT u.*, d.cost, d.traits, d.unit_id FROM nunits u JOIN nusable USING (round_key) LEFT JOIN unit_dim d USING (unit))"""
USABLE = """, usable AS (
  SELECT * FROM rounds WHERE round_type <> 'PVE' AND NOT starts_with(round_name, '1-') AND round_outcome IS NOT NULL
    AND round_key IN (SELECT round_key FROM units GROUP BY round_key HAVING count(DISTINCT team) = 2))"""
COPIES = """, copies AS (
  SELECT round_key, team, trait, count(*) AS n FROM (SELECT round_key, team, unnest(traits) AS trait FROM enriched) GROUP BY ALL)"""
TOTALS = """, totals AS (
  SELECT round_key, team, trait, sum(n) AS n FROM (
    SELECT round_key, team, trait, count(*) AS n
    FROM (SELECT round_key, team, unnest(traits) AS trait FROM (SELECT DISTINCT round_key, team, unit, traits FROM enriched)) GROUP BY ALL
    UNION ALL
    SELECT round_key, team, trait, count(*) AS n
    FROM (SELECT round_key, team, unnest(item_ids) AS item FROM enriched) JOIN emblem_dim USING (item) GROUP BY ALL)
  GROUP BY ALL)"""
# the same sums for one board column: best level and breakpoint per trait
REACHED = """, reached AS (
  SELECT c.round_key, c.team, c.trait, c.n, max(p.level) AS level, max(p.bp) AS breakpoint, max(p.trait_id) AS trait_id
  FROM {counts} c JOIN trait_points p ON p.trait = c.trait AND p.bp <= c.n GROUP BY ALL)"""
CELL = r"^\s*([A-Da-d])\s*\+?0*([1-7])\s*$"
ROW_SQL = f"CASE WHEN coalesce(regexp_matches(replace(loc, '_', ''), '{CELL}'), false) THEN ascii(upper(regexp_extract(replace(loc, '_', ''), '{CELL}', 1))) - 65 ELSE -1 END"
COL_SQL = f"CASE WHEN coalesce(regexp_matches(replace(loc, '_', ''), '{CELL}'), false) THEN cast(regexp_extract(replace(loc, '_', ''), '{CELL}', 2) AS int) - 1 ELSE -1 END"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; without SQL only its rows are checked."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register
