"""Display catalogs of units, items and traits: dimensions joined with metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundhouse.dims import Dims
from roundhouse.functions.scalars import category_rank, item_category, safe_name
from roundhouse.functions.arrays import literal_array

NO_COST = 99  # sorts units without a cost behind all others


def _one_each(metadata: DataFrame, key: str) -> DataFrame:
    """One metadata row per key: of several, the greatest by its other columns."""
    rest = [c for c in metadata.columns if c != key]
    return metadata.groupBy(key).agg(F.max(F.struct(*rest)).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def catalog_units(dims_units: DataFrame, metadata: DataFrame, *, hidden: Sequence[str] = (), special: Sequence[str] = ()) -> DataFrame:
    """``unit, name, cost, traits, has_icon, special``: the vocabulary's units with their metadata where there is any.

    ``metadata`` has ``unit, name, cost, traits``; its cost wins when the unit is described there, the dimension's traits win.
    """
    meta = _one_each(metadata.select("unit", "name", "cost", "traits"), "unit").select(
        "unit", F.col("name").alias("_name"), F.col("cost").alias("_cost"), F.col("traits").alias("_traits"), F.lit(True).alias("_known")
    )
    shown = dims_units.filter(~F.col("unit").isin(*hidden)) if hidden else dims_units
    known = F.coalesce("_known", F.lit(False))
    return shown.join(meta, "unit", "left").select(
        "unit",
        F.coalesce(F.nullif("_name", F.lit("")), "unit").alias("name"),
        F.when(known, F.col("_cost")).otherwise(F.col("cost")).alias("cost"),
        F.coalesce("traits", "_traits", F.array().cast("array<string>")).alias("traits"),
        known.alias("has_icon"),
        F.col("unit").isin(*special).alias("special") if special else F.lit(False).alias("special"),
    )


def unit_order() -> list:
    """Regular units by cost and name, special ones last; no cost, or a cost of 0, sorts as ``NO_COST``."""
    return [F.col("special").asc(), F.coalesce(F.nullif("cost", F.lit(0)), F.lit(NO_COST)).asc(), F.col("name").asc()]


def catalog_items(items: DataFrame, emblems: DataFrame, metadata: DataFrame, *, set_prefix: str, hidden: Sequence[str] = ()) -> DataFrame:
    """``item, name, category, is_emblem, emblem_trait, has_icon``; ``metadata`` has ``item, name, tags, icon``."""
    meta = _one_each(metadata.select("item", "name", "tags", "icon"), "item").select("item", F.col("name").alias("_name"), F.col("tags").alias("_tags"), F.col("icon").alias("_icon"))
    shown = items.filter(~F.col("item").isin(*hidden)) if hidden else items
    joined = shown.join(meta, "item", "left").join(emblems.withColumnRenamed("trait", "emblem_trait"), "item", "left")
    is_emblem = F.col("emblem_trait").isNotNull()
    return joined.select(
        "item",
        F.coalesce(F.nullif("_name", F.lit("")), "item").alias("name"),
        item_category(F.col("item"), F.col("_tags"), is_emblem, set_prefix).alias("category"),
        is_emblem.alias("is_emblem"),
        "emblem_trait",
        (F.coalesce("_icon", F.lit("")) != "").alias("has_icon"),
    )


def item_order() -> list:
    """By category in display order, then name."""
    return [category_rank(F.col("category")).asc(), F.col("name").asc()]


def catalog_traits(traits: DataFrame, metadata: DataFrame) -> DataFrame:
    """``trait, breakpoints, unique, icon_name, has_icon``; ``metadata`` has ``trait, icon``."""
    meta = _one_each(metadata.select("trait", "icon"), "trait").select("trait", F.col("icon").alias("_icon"))
    return traits.join(meta, "trait", "left").select(
        "trait",
        F.sort_array("breakpoints").alias("breakpoints"),
        (F.size("breakpoints") == 1).alias("unique"),
        safe_name(F.col("trait")).alias("icon_name"),
        (F.coalesce("_icon", F.lit("")) != "").alias("has_icon"),
    )


def catalog_flagged(units: DataFrame, dims: Dims, name: str = "known") -> DataFrame:
    """Unit rows with a flag: is their unit in the catalog? One pass, where a semi and an anti join would read the rows twice."""
    names = dims.unit_frame(units.sparkSession).select("unit", F.lit(True).alias("_found"))
    return units.join(F.broadcast(names), "unit", "left").withColumn(name, F.coalesce("_found", F.lit(False))).drop("_found")


def catalog_known(units: DataFrame, dims: Dims, *, known: bool = True) -> DataFrame:
    """Unit rows whose unit is (or is not) in the catalog."""
    names = dims.unit_frame(units.sparkSession).select("unit")
    return units.join(F.broadcast(names), "unit", "left_semi" if known else "left_anti")


def catalog_known_items(units: DataFrame, dims: Dims) -> DataFrame:
    """Unit rows all of whose non-empty items are in the catalog."""
    items = literal_array(list(dims.items), "string")
    given = F.filter(F.coalesce("item_ids", F.array().cast("array<string>")), lambda i: i.isNotNull() & (i != ""))
    return units.filter(F.forall(given, lambda i: F.array_contains(items, i)))
