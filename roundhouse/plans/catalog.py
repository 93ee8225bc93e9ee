"""The display catalog of a game set from its dimensions and metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundhouse.dims import Dims
from roundhouse.functions.arrays import literal_array
from roundhouse.operators.catalog import catalog_items, catalog_traits, catalog_units, item_order, unit_order


def build_catalog(
    spark: SparkSession,
    dims: Dims,
    metadata: DataFrame,
    item_metadata: DataFrame,
    *,
    set_prefix: str,
    hidden_units: Sequence[str] = (),
    special_units: Sequence[str] = (),
    hidden_items: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Units and items in display order, traits in that of the dimension.

    ``metadata`` is one row of set metadata (``champions``, ``traits``); ``item_metadata`` has ``apiName, name, tags, icon``.
    """
    units = metadata.select(F.inline("champions")).select(
        F.col("apiName").alias("unit"), "name", F.col("cost").cast("bigint").alias("cost"), "traits"
    )
    items = item_metadata.select(F.col("apiName").alias("item"), "name", "tags", "icon")
    traits = metadata.select(F.inline("traits")).select(F.col("name").alias("trait"), "icon")
    return {
        "units": catalog_units(dims.unit_frame(spark), units, hidden=hidden_units, special=special_units).orderBy(*unit_order()),
        "items": catalog_items(
            dims.item_frame(spark).select("item"), dims.emblem_frame(spark), items, set_prefix=set_prefix, hidden=hidden_items
        ).orderBy(*item_order()),
        "traits": catalog_traits(dims.trait_frame(spark), traits).orderBy(F.array_position(literal_array(list(dims.traits), "string"), F.col("trait"))),
    }
