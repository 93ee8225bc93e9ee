"""Trait counts, levels and encodings over unit rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundhouse.dims import Dims
from roundhouse.functions.arrays import literal_array, literal_lookup, pad, tally
from roundhouse.functions.scalars import trait_class
from roundhouse.operators.units import enrich_units
from roundhouse.schema import MAX_TRAITS, TEAMS


def innate_counts(units: DataFrame, key: Sequence[str], dims: Dims, *, distinct_units: bool) -> DataFrame:
    """``key, team, trait, n`` from unit rows; ``distinct_units`` counts each unit of a board once.

    Distinct units are collected as one set a board, which holds at most the known units, and their traits are counted inside the
    row: no task keeps a table of units or of traits.
    """
    if distinct_units:
        place = literal_lookup({name: number for number, name in enumerate(dims.units)}, "int")
        traits = literal_array([list(unit.traits) for unit in dims.units.values()], "array<string>")
        sets = units.select(*key, "team", place(F.col("unit")).alias("_unit")).groupBy(*key, "team").agg(F.collect_set("_unit").alias("_units"))
        carried = F.flatten(F.transform("_units", lambda p: F.get(traits, p)))
        each = sets.select(*key, "team", F.inline(tally(carried)).alias("trait", "n"))
        return each.withColumn("n", F.col("n").cast("bigint"))
    rows = enrich_units(units.select(*key, "team", "unit"), dims)
    return rows.select(*key, "team", F.explode("traits").alias("trait")).groupBy(*key, "team", "trait").agg(F.count(F.lit(1)).alias("n"))


def emblem_counts(units: DataFrame, key: Sequence[str], dims: Dims) -> DataFrame:
    """``key, team, trait, n``: one per emblem item carried, copies included."""
    items = units.select(*key, "team", F.explode("item_ids").alias("item"))
    emblems = F.broadcast(dims.emblem_frame(units.sparkSession))
    return items.join(emblems, "item").groupBy(*key, "team", "trait").agg(F.count(F.lit(1)).alias("n"))


def trait_counts(units: DataFrame, key: Sequence[str], dims: Dims, *, distinct_units: bool, emblems: bool) -> DataFrame:
    """Innate counts, plus emblem counts when asked, summed per trait.

    With emblems, unit rows are read once: names of units and items are counted per board, and the few that are left get
    their traits. A unit then counts once or as often as it stands there, an emblem always as often.
    """
    if not emblems:
        return innate_counts(units, key, dims, distinct_units=distinct_units)
    spark = units.sparkSession
    items = F.coalesce("item_ids", F.array().cast("array<string>"))
    entries = F.concat(
        F.array(F.struct(F.col("unit").alias("_name"), F.lit(False).alias("_emblem"))),
        F.transform(items, lambda i: F.struct(i.alias("_name"), F.lit(True).alias("_emblem"))),
    )
    named = units.select(*key, "team", F.inline(entries)).groupBy(*key, "team", "_name", "_emblem").agg(F.count(F.lit(1)).alias("_times"))
    own = dims.unit_frame(spark).select(F.col("unit").alias("_name"), F.lit(False).alias("_emblem"), "traits")
    given = dims.emblem_frame(spark).select(F.col("item").alias("_name"), F.lit(True).alias("_emblem"), F.array("trait").alias("traits"))
    times = F.col("_times") if not distinct_units else F.when(F.col("_emblem"), F.col("_times")).otherwise(1)
    found = named.join(F.broadcast(own.unionByName(given)), ["_name", "_emblem"]).select(*key, "team", F.explode("traits").alias("trait"), times.alias("_times"))
    return found.groupBy(*key, "team", "trait").agg(F.sum("_times").alias("n"))


def active_traits(counts: DataFrame, dims: Dims) -> DataFrame:
    """Add ``level`` (how many breakpoints are reached) and ``breakpoint`` (the highest of them); keep level > 0."""
    joined = counts.join(F.broadcast(dims.trait_frame(counts.sparkSession)), "trait", "left")
    reached = F.filter("breakpoints", lambda b: b <= F.col("n"))
    return (
        joined.withColumn("level", F.size(reached).cast("bigint"))
        .withColumn("breakpoint", F.array_max(reached))
        .filter("level > 0")
        .drop("breakpoints")
    )


def trait_slot_names(dims: Dims) -> list[str]:
    """``team_trait_level`` in canonical order."""
    return [f"{team}_{trait}_{level}" for team in TEAMS for trait, level in dims.trait_levels]


def trait_onehot_pivot(active: DataFrame, rounds: DataFrame, key: Sequence[str], dims: Dims) -> DataFrame:
    """One flag column per team, trait and level; rounds without active traits stay as zeros."""
    names = trait_slot_names(dims)
    feature = F.concat("team", F.lit("_"), "trait", F.lit("_"), F.col("level").cast("string"))
    wide = active.select(*key, feature.alias("feature")).groupBy(*key).pivot("feature", names).agg(F.max(F.lit(1)))
    return rounds.select(*key).join(wide, list(key), "left").fillna(0, names)


def trait_id_vector(
    active: DataFrame, rounds: DataFrame, key: Sequence[str], dims: Dims, *, max_traits: int = MAX_TRAITS, name: str = "trait_ids"
) -> DataFrame:
    """Per round, the ids of (trait, highest breakpoint) of the player, then the opponent, each ascending, cut and padded.

    A round has at most one id per trait and side, so the collected lists are bounded by the trait dimension.
    """
    vocab = F.broadcast(dims.trait_vocab_frame(active.sparkSession))
    ids = active.join(vocab, ["trait", "breakpoint"])
    lists = ids.groupBy(*key).agg(
        *[F.sort_array(F.collect_set(F.when(F.col("team") == team, F.col("trait_id").cast("int")))).alias(team) for team in TEAMS]
    )
    none = F.array().cast("array<int>")
    return (
        rounds.select(*key)
        .join(lists, list(key), "left")
        .select(*key, F.concat(*[pad(F.coalesce(team, none), max_traits) for team in TEAMS]).alias(name))
    )


def trait_progress(counts: DataFrame, dims: Dims) -> DataFrame:
    """Per board and trait: count, reached and total breakpoints, the next one to aim for, flags and display class."""
    joined = counts.join(F.broadcast(dims.trait_frame(counts.sparkSession)), "trait", "left")
    points = F.coalesce("breakpoints", F.array().cast("array<bigint>"))
    level = F.size(F.filter(points, lambda b: b <= F.col("n")))
    ahead = F.array_min(F.filter(points, lambda b: b > F.col("n")))
    return joined.select(
        *[c for c in counts.columns],
        level.cast("bigint").alias("level"),
        F.size(points).cast("bigint").alias("levels"),
        F.coalesce(ahead, F.array_max(points), F.col("n")).alias("next"),
        (level > 0).alias("active"),
        (F.size(points) == 1).alias("unique"),
        trait_class(level, F.nullif(F.size(points), F.lit(0))).alias("class"),
    )


def progress_order() -> list:
    """Display order of the traits of one board: active, active unique, level, count (all descending), name."""
    unique_active = F.col("active") & F.col("unique")
    return [F.col("active").desc(), unique_active.desc(), F.col("level").desc(), F.col("n").desc(), F.col("trait").asc()]
