"""Raw rounds, requests, metadata and sample boards on storage."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundhouse.schema import REQUESTS, ROUNDS


def read_rounds(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = ROUNDS) -> DataFrame:
    """Raw rounds from Parquet with the declared schema. Row groups become splits; unused columns are never read."""
    return spark.read.schema(schema).parquet(*([path] if isinstance(path, str) else path))


def scan_rounds(spark: SparkSession, path: str, where: Column, columns: Sequence[str]) -> DataFrame:
    """Filter and project at the scan, nested fields included (``board_data.player_board`` reads that side only)."""
    return read_rounds(spark, path).filter(where).select(*columns)


def union_rounds(sources: Iterable[DataFrame]) -> DataFrame:
    """Rounds of several sources; columns a source lacks become null."""
    combined = None
    for source in sources:
        combined = source if combined is None else combined.unionByName(source, allowMissingColumns=True)
    if combined is None:
        raise ValueError("no sources")
    return combined


def requests_frame(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """Requests given as Python rows, typed explicitly so that empty boards keep their type."""
    return spark.createDataFrame(list(rows), REQUESTS)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests from JSON lines."""
    return spark.read.schema(REQUESTS).json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Set metadata from a local JSON document: one row with ``champions`` and ``traits`` arrays per set."""
    return spark.read.option("multiLine", True).json(path)


def members(value: Column) -> Column:
    """Elements of a list or values of an object, as variants; null for anything else."""
    listed, named = F.try_variant_get(value, "$", "array<variant>"), F.try_variant_get(value, "$", "map<string,variant>")
    return F.coalesce(listed, F.map_values(named))


def fields(value: Column, **kinds: str) -> Column:
    """A struct of named fields of a variant; null where a field is missing or of another kind."""
    return F.struct(*[F.try_variant_get(value, f"$.{name}", kind).alias(name) for name, kind in kinds.items()])


def read_set(spark: SparkSession, path: str, number: int) -> DataFrame:
    """One row ``champions, traits`` of set ``number`` out of a document whose ``sets`` are a list or an object.

    Only the chosen set is parsed, without a declared schema: champions, traits and effects may be lists or objects, fields may be
    missing, of another kind or unknown. What can't be read as its kind is null.
    """
    text = spark.read.text(path, wholetext=True)
    chosen = F.coalesce(*[F.get_json_object("value", place) for place in (f"$.sets[{number}]", f"$.sets['{number}']")])
    found = text.select(F.try_parse_json(chosen).alias("set"))
    if found.filter("set is null").count():
        raise ValueError(f"{path} has no set {number}")

    def champion(c: Column) -> Column:
        return fields(c, apiName="string", name="string", cost="bigint", traits="array<string>")

    def trait(t: Column) -> Column:
        effects = F.transform(members(F.try_variant_get(t, "$.effects", "variant")), lambda e: fields(e, minUnits="bigint"))
        own = fields(t, name="string", icon="string")
        return F.struct(own["name"].alias("name"), own["icon"].alias("icon"), effects.alias("effects"))

    lists = {name: members(F.try_variant_get("set", f"$.{name}", "variant")) for name in ("champions", "traits")}
    return found.select(F.transform(lists["champions"], champion).alias("champions"), F.transform(lists["traits"], trait).alias("traits"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """``apiName, name, tags, icon`` of the items in the same document, in a list or an object."""
    text = spark.read.text(path, wholetext=True)
    items = members(F.try_parse_json(F.get_json_object("value", "$.items")))
    return text.select(F.explode(items).alias("i")).select(fields(F.col("i"), apiName="string", name="string", tags="array<string>", icon="string").alias("f")).select("f.*")


def write_sample_boards(boards: DataFrame, path: str) -> None:
    """Sampled boards as JSON lines, in their order; the sample is a bounded report, hence one file."""
    boards.coalesce(1).write.mode("overwrite").json(path)
