"""Scalar rules on single values: tiers, stages, scores, names and item lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from roundhouse.schema import MAX_ITEMS

# Cost multiplier of a tier; any other tier counts nothing.
TIER_MULTIPLIERS = {0: 0, 1: 1, 2: 3, 3: 9, 4: 27}


def tier_multiplier(tier: Column) -> Column:
    """1, 3, 9, 27 for tiers 1 to 4, else 0."""
    result = None
    for value, factor in TIER_MULTIPLIERS.items():
        result = F.when(tier == value, factor) if result is None else result.when(tier == value, factor)
    return result.otherwise(0)


def clamp_tier(tier: Column) -> Column:
    """Missing and 0 become 1; the rest is forced into 1..4."""
    return F.least(F.greatest(F.coalesce(F.nullif(tier, F.lit(0)), F.lit(1)), F.lit(1)), F.lit(4))


def stage_of(round_name: Column) -> Column:
    """Digits before the first ``-``; null when that part is not a number."""
    head = F.split_part(round_name, F.lit("-"), F.lit(1))
    return F.when(head.rlike("^[0-9]+$"), head)


def recency_weight(latest: Column, current: Column, decay: float = 0.1) -> Column:
    """``exp(-decay * age)`` with the age in patches."""
    return F.exp(F.lit(-decay) * (latest - current))


def sigmoid(logit: Column) -> Column:
    """Logit to probability."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def decision(probability: Column, threshold: float = 0.5) -> Column:
    """``victory`` from the threshold upwards, else ``defeat``."""
    return F.when(probability >= threshold, "victory").otherwise("defeat")


def vocab_key_parts(key: Column) -> tuple[Column, Column]:
    """``"Name_3"`` -> name before the first ``_`` and number after the last."""
    return F.split_part(key, F.lit("_"), F.lit(1)), F.split_part(key, F.lit("_"), F.lit(-1)).cast("bigint")


def item_at(items: Column, slot: int) -> Column:
    """Item in a 0-based slot by position, null when the list is shorter."""
    return F.get(items, F.lit(slot))


def _present(item: Column) -> Column:
    return item.isNotNull() & (item != "")


def compact_then_take(items: Column, limit: int = MAX_ITEMS) -> Column:
    """Drop empty slots first, then keep ``limit`` items (sampler rule)."""
    return F.slice(F.filter(F.coalesce(items, F.array().cast("array<string>")), _present), 1, limit)


def take_then_compact(items: Column, limit: int = MAX_ITEMS) -> Column:
    """Keep ``limit`` slots first, then drop the empty ones (request rule)."""
    return F.filter(F.slice(F.coalesce(items, F.array().cast("array<string>")), 1, limit), _present)


# Display order of the item categories and the tags that mark them in the metadata.
ITEM_CATEGORIES = ("normal", "component", "emblem", "artifact", "bilgewater", "radiant")
COMPONENT_TAG = "component"
ARTIFACT_TAG = "{44ace175}"
RADIANT_TAG = "{6ef5c598}"


def item_category(name: Column, tags: Column, is_emblem: Column, set_prefix: str) -> Column:
    """Category of an item; the first matching rule wins. ``set_prefix`` is the set's item name prefix."""
    tagged = F.coalesce(tags, F.array().cast("array<string>"))
    return (
        F.when(is_emblem, "emblem")
        .when(F.array_contains(tagged, COMPONENT_TAG), "component")
        .when(name.startswith(f"{set_prefix}_Item_Bilgewater_"), "bilgewater")
        .when(F.array_contains(tagged, RADIANT_TAG) | name.endswith("Radiant"), "radiant")
        .when(F.array_contains(tagged, ARTIFACT_TAG) | name.contains("_Artifact_"), "artifact")
        .otherwise("normal")
    )


def item_category_fallback(name: Column, is_emblem: Column) -> Column:
    """Category from the name alone, for catalogs without tags."""
    return (
        F.when(is_emblem, "emblem")
        .when(name.rlike("(?i)Artifact|Ornn|Shimmerscale|TheDarkin"), "artifact")
        .when(name.rlike("(?i)Radiant$"), "radiant")
        .when(name.rlike("(?i)Bilgewater_"), "bilgewater")
        .otherwise("normal")
    )


def category_rank(category: Column, order: Sequence[str] = ITEM_CATEGORIES) -> Column:
    """Position of a category in the display order."""
    return F.array_position(F.array(*[F.lit(c) for c in order]), category) - 1


def safe_name(name: Column) -> Column:
    """File-name form of a display name: blanks to ``_``, apostrophes removed."""
    return F.replace(F.replace(name, F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))


def icon_path(path: Column) -> Column:
    """Rendered picture of an asset path."""
    lowered = F.lower(path)
    for suffix in (".tex", ".dds"):
        lowered = F.replace(lowered, F.lit(suffix), F.lit(".png"))
    return lowered


@dataclass(frozen=True)
class ProgressClass:
    """Thresholds of the reached share of breakpoints."""

    gold: float = 0.66
    silver: float = 0.33


def trait_class(level: Column, levels: Column, limits: ProgressClass = ProgressClass()) -> Column:
    """Display class of a trait from how many of its breakpoints are reached."""
    share = level / levels
    return (
        F.when(level <= 0, "none")
        .when(levels == 1, "unique")
        .when(level >= levels, "prism")
        .when(share >= limits.gold, "gold")
        .when(share >= limits.silver, "silver")
        .otherwise("bronze")
    )
