"""Queries on unit rows: explode, enrich, cells, items, costs, traits."""

from __future__ import annotations

from pyspark.sql import functions as F

from roundhouse.functions import cells, scalars
from roundhouse.operators import assemble, catalog, rounds, traits, units
from testbed import adapter
from testbed.adapter import KEY, dims
from testbed.queries_rounds import usable_nested
from testbed.registry import (
    COL_SQL,
    COPIES,
    ENRICHED,
    FLAT,
    NESTED,
    REACHED,
    ROW_SQL,
    TOTALS,
    USABLE,
    query,
)


def pos():
    """The list position of a flat unit row as plain columns."""
    names = ("l_linenumber", "l_partkey", "l_suppkey")
    return [F.col(f"pos.{name}").alias(f"p{n}") for n, name in enumerate(names, start=1)]


P = "p1, p2, p3"


def enriched(spark, d):
    return units.enrich_units(adapter.units(spark, d), dims())


def exploded(spark, d):
    return units.explode_boards(usable_nested(spark, d), KEY)


@query(
    "board_explode",
    f"""{NESTED} SELECT round_key, team, pos, unit, tier, loc, coalesce(array_to_string(list_transform(item_ids, lambda i: coalesce(i, '?')), ','), '') AS items
    FROM nunits JOIN nusable USING (round_key)""",
)
def board_explode(spark, d):
    return exploded(spark, d).select(
        "round_key", "team", F.col("pos").cast("bigint").alias("pos"), "unit", "tier", "loc", F.array_join("item_ids", ",", "?").alias("items")
    )


@query(
    "board_explode_outer",
    f"""{NESTED} SELECT s.round_key, s.team, u.pos, u.unit FROM sizes s LEFT JOIN nunits u USING (round_key, team)""",
)
def board_explode_outer(spark, d):
    boards = adapter.nested_rounds(spark, d).select("round_key", "board_data.*")
    return units.explode_boards(boards, KEY, outer=True).select("round_key", "team", F.col("pos").cast("bigint").alias("pos"), "unit")


@query(
    "unit_enrich",
    f"{FLAT}{ENRICHED} SELECT round_key, team, {P}, unit, cost, coalesce(array_to_string(traits, ','), '?') AS traits FROM enriched",
)
def unit_enrich(spark, d):
    return enriched(spark, d).select("round_key", "team", *pos(), "unit", "cost", F.coalesce(F.array_join("traits", ","), F.lit("?")).alias("traits"))


@query(
    "catalog_semi_anti",
    f"""{FLAT} SELECT round_key, team, {P}, 1 AS known FROM units WHERE unit IN (SELECT unit FROM unit_dim)
    UNION ALL SELECT round_key, team, {P}, 0 FROM units WHERE unit NOT IN (SELECT unit FROM unit_dim)""",
)
def catalog_semi_anti(spark, d):
    """Both sides at once, as a flag."""
    flagged = catalog.catalog_flagged(adapter.units(spark, d), dims())
    return flagged.select("round_key", "team", *pos(), F.col("known").cast("int").alias("known"))


@query("catalog_semi", f"{FLAT} SELECT round_key, team, {P} FROM units WHERE unit IN (SELECT unit FROM unit_dim)")
def catalog_semi(spark, d):
    return catalog.catalog_known(adapter.units(spark, d), dims()).select("round_key", "team", *pos())


@query("catalog_anti", f"{FLAT} SELECT round_key, team, {P} FROM units WHERE unit NOT IN (SELECT unit FROM unit_dim)")
def catalog_anti(spark, d):
    return catalog.catalog_known(adapter.units(spark, d), dims(), known=False).select("round_key", "team", *pos())


# -- cells and items ---------------------------------------------------------------------------------------------------


@query("parse_cell", f"{NESTED} SELECT round_key, team, pos, {ROW_SQL} AS r, {COL_SQL} AS c FROM nunits JOIN nusable USING (round_key)")
def parse_cell(spark, d):
    loc = F.col("loc")
    return exploded(spark, d).select(
        "round_key", "team", F.col("pos").cast("bigint").alias("pos"), cells.cell_row(loc).alias("r"), cells.cell_col(loc).alias("c")
    )


@query(
    "parse_cell_strict",
    f"""{NESTED} SELECT round_key, team, pos, cast(coalesce(regexp_matches(replace(loc, '_', ''), '^[A-D][1-7]$'), false) AS int) AS strict
    FROM nunits JOIN nusable USING (round_key)""",
)
def parse_cell_strict(spark, d):
    return exploded(spark, d).select(
        "round_key", "team", F.col("pos").cast("bigint").alias("pos"), cells.is_strict_cell(F.col("loc")).cast("int").alias("strict")
    )


@query(
    "format_cell",
    f"""{FLAT}, parsed AS (SELECT *, {ROW_SQL} AS r, {COL_SQL} AS c FROM units)
    SELECT round_key, team, {P}, chr(65 + r) || cast(c + 1 AS varchar) AS cell FROM parsed WHERE r >= 0""",
)
def format_cell(spark, d):
    row, col = cells.cell_row(F.col("loc")), cells.cell_col(F.col("loc"))
    placed = adapter.units(spark, d).filter(row >= 0)
    return placed.select("round_key", "team", *pos(), cells.format_cell(row, col).alias("cell"))


@query(
    "mirror_cell",
    f"""{FLAT}, parsed AS (SELECT *, {ROW_SQL} AS r, {COL_SQL} AS c FROM units)
    SELECT round_key, team, {P}, CASE WHEN team = 'player' THEN r + 4 ELSE 3 - r END AS board_row,
    CASE WHEN team = 'player' THEN c ELSE 6 - c END AS board_col FROM parsed WHERE r >= 0""",
)
def mirror_cell(spark, d):
    row, col, is_player = cells.cell_row(F.col("loc")), cells.cell_col(F.col("loc")), F.col("team") == "player"
    placed = adapter.units(spark, d).filter(row >= 0)
    return placed.select(
        "round_key", "team", *pos(), cells.board_row(row, is_player).alias("board_row"), cells.board_col(col, is_player).alias("board_col")
    )


@query(
    "valid_placements",
    f"""{FLAT}, parsed AS (SELECT *, {ROW_SQL} AS r, {COL_SQL} AS c FROM units)
    SELECT round_key, team, {P}, r, c, unit_id FROM parsed JOIN unit_dim USING (unit) WHERE r >= 0""",
)
def valid_placements(spark, d):
    placed = units.place_units(adapter.units(spark, d), dims())
    return placed.select("round_key", "team", *pos(), F.col("row").alias("r"), F.col("col").alias("c"), "unit_id")


ENCODED_FLAT = """, slots AS (
  SELECT u.*, coalesce(a.item_id, 0) AS item1, coalesce(b.item_id, 0) AS item2, coalesce(c.item_id, 0) AS item3
  FROM {source} u LEFT JOIN item_vocab a ON a.item = item_ids[1] LEFT JOIN item_vocab b ON b.item = item_ids[2]
  LEFT JOIN item_vocab c ON c.item = item_ids[3])"""


@query(
    "vocab_encode",
    f"{FLAT}{ENCODED_FLAT.format(source='units')} SELECT round_key, team, {P}, unit_id, item1, item2, item3 FROM slots JOIN unit_dim USING (unit)",
)
def vocab_encode(spark, d):
    vocab = F.broadcast(dims().unit_frame(spark).select("unit", "unit_id"))
    rows = units.encode_items(adapter.units(spark, d), dims()).join(vocab, "unit")
    return rows.select("round_key", "team", *pos(), "unit_id", "item1", "item2", "item3")


@query(
    "item_slots",
    f"{NESTED}{ENCODED_FLAT.format(source='nunits')} SELECT round_key, team, pos, item1, item2, item3 FROM slots JOIN nusable USING (round_key)",
)
def item_slots(spark, d):
    rows = units.encode_items(exploded(spark, d), dims())
    return rows.select("round_key", "team", F.col("pos").cast("bigint").alias("pos"), "item1", "item2", "item3")


@query(
    "items_compact",
    f"""{NESTED} SELECT round_key, team, pos, array_to_string(list_filter(item_ids, lambda i: i IS NOT NULL AND i <> '')[1:3], ',') AS items
    FROM nunits JOIN nusable USING (round_key)""",
)
def items_compact(spark, d):
    items = F.array_join(scalars.compact_then_take(F.col("item_ids")), ",")
    return exploded(spark, d).select("round_key", "team", F.col("pos").cast("bigint").alias("pos"), items.alias("items"))


@query(
    "items_take_then_compact",
    f"""{NESTED} SELECT round_key, team, pos, array_to_string(list_filter(item_ids[1:3], lambda i: i IS NOT NULL AND i <> ''), ',') AS items
    FROM nunits JOIN nusable USING (round_key)""",
)
def items_take_then_compact(spark, d):
    items = F.array_join(scalars.take_then_compact(F.col("item_ids")), ",")
    return exploded(spark, d).select("round_key", "team", F.col("pos").cast("bigint").alias("pos"), items.alias("items"))


@query("tier_clamp", f"{NESTED} SELECT round_key, team, pos, least(greatest(coalesce(nullif(tier, 0), 1), 1), 4) AS tier FROM nunits JOIN nusable USING (round_key)")
def tier_clamp(spark, d):
    return exploded(spark, d).select(
        "round_key", "team", F.col("pos").cast("bigint").alias("pos"), scalars.clamp_tier(F.col("tier")).cast("bigint").alias("tier")
    )


# -- unit counts and cost ----------------------------------------------------------------------------------------------

COST = "coalesce(cost * CASE tier WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 9 WHEN 4 THEN 27 ELSE 0 END, 0)"


@query(
    "team_cost",
    f"""{FLAT}{ENRICHED}{USABLE} SELECT round_key, cast(sum(CASE WHEN team = 'player' THEN {COST} ELSE 0 END) AS bigint) AS player_cost,
    cast(sum(CASE WHEN team = 'opponent' THEN {COST} ELSE 0 END) AS bigint) AS opponent_cost
    FROM enriched JOIN usable USING (round_key) GROUP BY round_key""",
)
def team_cost(spark, d):
    cost = units.unit_cost()

    def side(team):
        return F.when(F.col("team") == team, cost)

    # a sum over no rows is null, which marks a side without units; one aggregate gives both costs and the board check
    costs = enriched(spark, d).groupBy("round_key").agg(
        F.sum(side("player")).alias("player_cost"), F.sum(side("opponent")).alias("opponent_cost")
    )
    both = costs.filter("player_cost is not null and opponent_cost is not null")
    return both.join(adapter.rounds(spark, d).filter(rounds.countable_round()).select("round_key"), KEY)


@query(
    "team_cost_long",
    f"{FLAT}{ENRICHED} SELECT round_key, team, cast(sum({COST}) AS bigint) AS total_cost FROM enriched GROUP BY ALL",
)
def team_cost_long(spark, d):
    return units.team_cost(enriched(spark, d), KEY)


def _pivot_sql(name, team, unit, tier):
    return f"""cast(count(*) FILTER (team = '{team}' AND unit = '{unit}' AND tier = {tier}) AS bigint) AS "{name}" """


@query(
    "unit_tier_pivot",
    f"{FLAT} SELECT round_key, "
    + ", ".join(_pivot_sql(f"{t}_{u}_{n}", t, u, n) for t in ("player", "opponent") for u in dims().units for n in (1, 2, 3, 4))
    + " FROM units GROUP BY round_key",
)
def unit_tier_pivot(spark, d):
    return units.unit_tier_pivot(adapter.units(spark, d), KEY, dims())


# -- traits ------------------------------------------------------------------------------------------------------------


@query("trait_count_copies", f"{FLAT}{ENRICHED}{COPIES} SELECT * FROM copies")
def trait_count_copies(spark, d):
    return traits.innate_counts(adapter.units(spark, d), KEY, dims(), distinct_units=False)


@query(
    "trait_count_distinct",
    f"""{FLAT}{ENRICHED} SELECT round_key, team, trait, count(*) AS n FROM
    (SELECT round_key, team, unnest(traits) AS trait FROM (SELECT DISTINCT round_key, team, unit, traits FROM enriched)) GROUP BY ALL""",
)
def trait_count_distinct(spark, d):
    return traits.innate_counts(adapter.units(spark, d), KEY, dims(), distinct_units=True)


@query(
    "emblem_bonus",
    f"""{FLAT} SELECT round_key, team, trait, count(*) AS n FROM (SELECT round_key, team, unnest(item_ids) AS item FROM units)
    JOIN emblem_dim USING (item) GROUP BY ALL""",
)
def emblem_bonus(spark, d):
    return traits.emblem_counts(adapter.units(spark, d), KEY, dims())


def totals(spark, d):
    return traits.trait_counts(adapter.units(spark, d), KEY, dims(), distinct_units=True, emblems=True)


@query("trait_count_total", f"{FLAT}{ENRICHED}{TOTALS} SELECT round_key, team, trait, cast(n AS bigint) AS n FROM totals")
def trait_count_total(spark, d):
    return totals(spark, d)


@query("trait_level", f"{FLAT}{ENRICHED}{COPIES}{REACHED.format(counts='copies')} SELECT round_key, team, trait, n, level FROM reached")
def trait_level(spark, d):
    active = traits.active_traits(trait_count_copies(spark, d), dims())
    return active.select("round_key", "team", "trait", "n", "level")


@query(
    "trait_breakpoint",
    f"""{FLAT}{ENRICHED}{TOTALS}{REACHED.format(counts='totals')}
    SELECT round_key, team, trait, cast(n AS bigint) AS n, cast(breakpoint AS bigint) AS breakpoint FROM reached""",
)
def trait_breakpoint(spark, d):
    active = traits.active_traits(totals(spark, d), dims())
    return active.select("round_key", "team", "trait", "n", "breakpoint")


def usable_flat(spark, d):
    """Usable rounds of the flat form; the unit rows are reduced to one row per round first."""
    from testbed.queries_rounds import usable_rounds_flat

    return usable_rounds_flat(spark, d)


SLOT_NAMES = [(f"{t}_{name}_{level}", t, name, level) for t in ("player", "opponent") for name, level in dims().trait_levels]


ONEHOT_SQL = (
    f"{FLAT}{ENRICHED}{USABLE}{COPIES}{REACHED.format(counts='copies')} SELECT round_key, "
    + ", ".join(
        f"""cast(coalesce(max(CASE WHEN team = '{t}' AND trait = '{n}' AND level = {v} THEN 1 END), 0) AS int) AS "{c}" """
        for c, t, n, v in SLOT_NAMES
    )
    + " FROM usable LEFT JOIN reached USING (round_key) GROUP BY round_key"
)


@query("trait_onehot", ONEHOT_SQL)
def trait_onehot(spark, d):
    """The columns in one pass over the unit rows."""
    flags = onehot_flags(spark, d)
    return assemble.spread(flags, "onehot", [c for c, *_ in SLOT_NAMES]).select("round_key", *[F.col(f"`{c}`").cast("int").alias(c) for c, *_ in SLOT_NAMES])


@query("trait_onehot_long", ONEHOT_SQL)
def trait_onehot_long(spark, d):
    """The same from trait counts as rows."""
    active = traits.active_traits(trait_count_copies(spark, d), dims())
    return traits.trait_onehot_pivot(active, usable_flat(spark, d), KEY, dims())


def onehot_flags(spark, d):
    vector = assemble.onehot_vectors(enriched(spark, d), KEY, dims()).filter("both_sides").drop("both_sides")
    wanted = adapter.rounds(spark, d).filter(rounds.countable_round()).select("round_key")
    return vector.join(wanted, KEY)


@query(
    "trait_onehot_vector",
    f"{FLAT}{ENRICHED}{USABLE}{COPIES}{REACHED.format(counts='copies')} SELECT round_key, concat_ws(',', "
    + ", ".join(f"coalesce(max(CASE WHEN team = '{t}' AND trait = '{n}' AND level = {v} THEN 1 END), 0)" for c, t, n, v in SLOT_NAMES)
    + ") AS onehot FROM usable LEFT JOIN reached USING (round_key) GROUP BY round_key",
)
def trait_onehot_vector(spark, d):
    return onehot_flags(spark, d).select("round_key", F.array_join("onehot", ",").alias("onehot"))


IDS_SQL = """, ids AS (
  SELECT round_key, array_to_string(list_resize(coalesce(list(trait_id ORDER BY trait_id) FILTER (team = 'player'), [])[1:15], 15, 0)
    || list_resize(coalesce(list(trait_id ORDER BY trait_id) FILTER (team = 'opponent'), [])[1:15], 15, 0), ',') AS trait_ids
  FROM {usable} LEFT JOIN reached USING (round_key) GROUP BY round_key)"""


@query(
    "trait_ids",
    f"{FLAT}{ENRICHED}{USABLE}{TOTALS}{REACHED.format(counts='totals')}{IDS_SQL.format(usable='usable')} SELECT * FROM ids",
)
def trait_ids(spark, d):
    vector = assemble.trait_id_vectors(adapter.units(spark, d), KEY, dims()).filter("both_sides")
    wanted = adapter.rounds(spark, d).filter(rounds.countable_round()).select("round_key")
    return vector.join(wanted, KEY).select("round_key", F.array_join("trait_ids", ",").alias("trait_ids"))


@query(
    "trait_ids_from_counts",
    f"{FLAT}{ENRICHED}{USABLE}{TOTALS}{REACHED.format(counts='totals')}{IDS_SQL.format(usable='usable')} SELECT * FROM ids",
)
def trait_ids_from_counts(spark, d):
    active = traits.active_traits(totals(spark, d), dims())
    vector = traits.trait_id_vector(active, usable_flat(spark, d), KEY, dims())
    return vector.select("round_key", F.array_join("trait_ids", ",").alias("trait_ids"))


@query(
    "trait_progress",
    f"""{FLAT}{ENRICHED}{TOTALS}, p AS (
      SELECT t.round_key, t.team, t.trait, cast(t.n AS bigint) AS n, cast(len(list_filter(points, lambda b: b <= t.n)) AS bigint) AS level,
        cast(len(points) AS bigint) AS levels,
        cast(coalesce(list_min(list_filter(points, lambda b: b > t.n)), list_max(points)) AS bigint) AS next
      FROM totals t JOIN trait_dim USING (trait))
    SELECT *, CASE WHEN level = 0 THEN 'none' WHEN levels = 1 THEN 'unique' WHEN level >= levels THEN 'prism'
      WHEN level / levels >= 0.66 THEN 'gold' WHEN level / levels >= 0.33 THEN 'silver' ELSE 'bronze' END AS class,
      row_number() OVER (PARTITION BY round_key, team ORDER BY level > 0 DESC, (level > 0 AND levels = 1) DESC, level DESC, n DESC, trait)
        AS place FROM p""",
)
def trait_progress(spark, d):
    from pyspark.sql import Window as W

    progress = traits.trait_progress(totals(spark, d), dims())
    # a board has at most one row per trait, so this window is bounded by the trait dimension
    place = F.row_number().over(W.partitionBy("round_key", "team").orderBy(*traits.progress_order()))
    return progress.select(
        "round_key", "team", "trait", "n", "level", "levels", F.col("next").cast("bigint").alias("next"), "class", place.cast("bigint").alias("place")
    )
