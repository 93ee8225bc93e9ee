"""Dimension data: units, traits, emblems, items, patches and the vocabularies built from them.

Dimensions are small by nature (a few hundred entries). They are broadcast in joins and folded into literals in row
expressions, so the size is checked here, once.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundhouse.schema import TEAMS, TIERS

MAX_DIM_ROWS = 10_000


@dataclass(frozen=True)
class Unit:
    """Static facts about one unit."""

    cost: int | None
    traits: tuple[str, ...] = ()


def enumerate_vocab(keys: Sequence[str]) -> dict[str, int]:
    """Ids from 1 in source order; 0 stays free for padding and unknown keys."""
    return {key: number for number, key in enumerate(keys, start=1)}


@dataclass(frozen=True)
class Dims:
    """All dimension tables of one game set."""

    units: Mapping[str, Unit]
    traits: Mapping[str, tuple[int, ...]]
    emblems: Mapping[str, str] = field(default_factory=dict)
    items: tuple[str, ...] = ()
    patches: tuple[tuple[str, int], ...] = ()
    unit_vocab: Mapping[str, int] | None = None
    item_vocab: Mapping[str, int] | None = None
    trait_vocab: Mapping[tuple[str, int], int] | None = None
    patch_vocab: Mapping[str, int] | None = None

    def __post_init__(self) -> None:
        ordered = {name: tuple(sorted(points)) for name, points in self.traits.items()}
        patches = tuple(sorted(self.patches, key=lambda patch: patch[1]))
        pairs = [(name, point) for name, points in ordered.items() for point in points]
        defaults = {
            "traits": ordered,
            "patches": patches,
            "unit_vocab": self.unit_vocab or enumerate_vocab(list(self.units)),
            "item_vocab": self.item_vocab or enumerate_vocab(list(self.items)),
            "trait_vocab": self.trait_vocab or enumerate_vocab(pairs),
            "patch_vocab": self.patch_vocab or enumerate_vocab([name for name, _ in self.patches]),
        }
        for name, value in defaults.items():
            object.__setattr__(self, name, value)
        for name in ("units", "traits", "emblems", "items", "patches", "unit_vocab", "item_vocab", "trait_vocab"):
            if len(getattr(self, name)) > MAX_DIM_ROWS:
                raise ValueError(f"dimension {name} has more than {MAX_DIM_ROWS} entries; it is not a broadcast table")

    # -- canonical orders ------------------------------------------------------------------------------------------

    @property
    def trait_levels(self) -> list[tuple[str, int]]:
        """Every (trait, level) in canonical order: trait order of the dimension, then level from 1."""
        return [(name, level) for name, points in self.traits.items() for level in range(1, len(points) + 1)]

    @property
    def wide_names(self) -> list[str]:
        """Names of the wide feature columns in canonical order."""
        units = [f"{team}_{unit}_{tier}" for team in TEAMS for unit in self.units for tier in TIERS]
        traits = [f"{team}_{trait}_{level}" for team in TEAMS for trait, level in self.trait_levels]
        return units + traits + [f"{team}_total_cost" for team in TEAMS]

    # -- the dimensions as DataFrames ------------------------------------------------------------------------------

    def unit_frame(self, spark: SparkSession) -> DataFrame:
        """``unit, cost, traits, unit_id``."""
        rows = [
            {"unit": name, "cost": unit.cost, "traits": list(unit.traits), "unit_id": self.unit_vocab.get(name)}
            for name, unit in self.units.items()
        ]
        fields = [("unit", pa.string()), ("cost", pa.int64()), ("traits", pa.list_(pa.string())), ("unit_id", pa.int64())]
        return local_frame(spark, rows, fields)

    def trait_frame(self, spark: SparkSession) -> DataFrame:
        """``trait, breakpoints``."""
        rows = [{"trait": name, "breakpoints": list(points)} for name, points in self.traits.items()]
        return local_frame(spark, rows, [("trait", pa.string()), ("breakpoints", pa.list_(pa.int64()))])

    def trait_vocab_frame(self, spark: SparkSession) -> DataFrame:
        """``trait, breakpoint, trait_id``."""
        rows = [{"trait": t, "breakpoint": b, "trait_id": i} for (t, b), i in self.trait_vocab.items()]
        return local_frame(spark, rows, [("trait", pa.string()), ("breakpoint", pa.int64()), ("trait_id", pa.int64())])

    def emblem_frame(self, spark: SparkSession) -> DataFrame:
        """``item, trait``."""
        rows = [{"item": item, "trait": trait} for item, trait in self.emblems.items()]
        return local_frame(spark, rows, [("item", pa.string()), ("trait", pa.string())])

    def item_frame(self, spark: SparkSession) -> DataFrame:
        """``item, item_id`` with ids from the vocabulary."""
        rows = [{"item": item, "item_id": number} for item, number in self.item_vocab.items()]
        return local_frame(spark, rows, [("item", pa.string()), ("item_id", pa.int64())])

    def patch_frame(self, spark: SparkSession) -> DataFrame:
        """``patch, release_ts, patch_id`` ordered by release."""
        rows = [{"patch": p, "release_ts": ts, "patch_id": self.patch_vocab[p]} for p, ts in self.patches]
        return local_frame(spark, rows, [("patch", pa.string()), ("release_ts", pa.int64()), ("patch_id", pa.int64())])

    # -- loading ---------------------------------------------------------------------------------------------------

    @classmethod
    def from_json(cls, folder: str | Path) -> Dims:
        """Load ``unit/trait/emblem/item/patch.json`` and, when present, the ``vocabulary`` files from a folder of this machine."""
        return cls.from_texts({path.stem: path.read_text(encoding="utf-8") for path in Path(folder).rglob("*.json")})

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Dims:
        """The same from any folder that Spark reads; a name can be a file or, as :meth:`write` leaves it, a folder of one."""
        files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
        name = F.regexp_extract("path", r"([a-z_]+)\.json(/[^/]*)?$", 1).alias("name")
        return cls.from_texts({row["name"]: row["value"] for row in files.select(name, "value").filter("name <> ''").collect()})

    @classmethod
    def from_texts(cls, texts: Mapping[str, str]) -> Dims:
        """Dimensions from JSON texts by name, such as ``unit`` or ``unit_vocab``."""

        def load(name: str, default: object = None) -> object:
            return json.loads(texts[name]) if name in texts else default

        trait_vocab = load("trait_vocab")
        return cls(
            units={name: Unit(info.get("cost"), tuple(info.get("traits") or ())) for name, info in load("unit").items()},
            traits={name: tuple(points) for name, points in load("trait").items()},
            emblems=load("emblem", {}),
            items=tuple(load("item", [])),
            patches=tuple((name, int(ts)) for name, ts in load("patch", {}).items()),
            unit_vocab=load("unit_vocab"),
            item_vocab=load("item_vocab"),
            trait_vocab=None if trait_vocab is None else {parse_trait_key(key): i for key, i in trait_vocab.items()},
            patch_vocab=load("patch_vocab"),
        )

    def texts(self) -> dict[str, str]:
        """Dimensions and vocabularies as JSON texts by file name."""
        content = {
            "unit.json": {name: {"traits": list(u.traits), "cost": u.cost} for name, u in self.units.items()},
            "trait.json": {name: list(points) for name, points in self.traits.items()},
            "emblem.json": dict(self.emblems),
            "item.json": list(self.items),
            "patch.json": dict(self.patches),
            "vocabulary/unit_vocab.json": dict(self.unit_vocab),
            "vocabulary/item_vocab.json": dict(self.item_vocab),
            "vocabulary/trait_vocab.json": {f"{t}_{b}": i for (t, b), i in self.trait_vocab.items()},
            "vocabulary/patch_vocab.json": dict(self.patch_vocab),
        }
        return {name: json.dumps(value, ensure_ascii=False) for name, value in content.items()}

    def write_json(self, folder: str | Path) -> None:
        """Write dimensions and vocabularies in the layout that :meth:`from_json` reads."""
        root = Path(folder)
        (root / "vocabulary").mkdir(parents=True, exist_ok=True)
        for name, text in self.texts().items():
            (root / name).write_text(text, encoding="utf-8")

    def write(self, spark: SparkSession, folder: str) -> None:
        """Write them to any folder that Spark writes, in the layout that :meth:`read` reads."""
        for name, text in self.texts().items():
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def parse_trait_key(key: str) -> tuple[str, int]:
    """``"Name_3"`` -> ``("Name", 3)``: the name ends at the first underscore, the number starts after the last."""
    return key.split("_", 1)[0], int(key.rsplit("_", 1)[-1])


def local_frame(spark: SparkSession, rows: list[dict], fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """Small driver-side rows as a local relation, so that the optimiser knows their size."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=pa.schema(fields)))


def dims_from_metadata(metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unit and trait dimensions out of nested set metadata (``champions`` and ``traits`` arrays of one set).

    A trait effect without ``minUnits`` is not a breakpoint.
    """
    units = metadata.select(F.explode("champions").alias("c")).select(
        F.col("c.apiName").alias("unit"),
        F.col("c.cost").cast("bigint").alias("cost"),
        F.coalesce(F.col("c.traits"), F.array().cast("array<string>")).alias("traits"),
    )
    traits = metadata.select(F.explode("traits").alias("t")).select(
        F.col("t.name").alias("trait"),
        F.transform(
            F.filter(F.coalesce(F.col("t.effects"), F.array()), lambda e: e["minUnits"].isNotNull()),
            lambda e: e["minUnits"].cast("bigint"),
        ).alias("breakpoints"),
    )
    return units, traits


def built_dims(metadata: DataFrame, rest: Dims | None = None) -> Dims:
    """Dimensions with units and traits out of one set's metadata, in its order; of entries with one name the last counts.

    Emblems, items and patches are those of ``rest``. More than ``MAX_DIM_ROWS`` entries are refused.
    """
    units, traits = (frame.limit(MAX_DIM_ROWS + 1).collect() for frame in dims_from_metadata(metadata))
    return Dims(
        units={row["unit"]: Unit(row["cost"], tuple(row["traits"])) for row in units},
        traits={row["trait"]: tuple(row["breakpoints"]) for row in traits},
        emblems=rest.emblems if rest else {},
        items=rest.items if rest else (),
        patches=rest.patches if rest else (),
    )


def ordered_mapping(df: DataFrame, text: str, value_type: str = "string") -> DataFrame:
    """A JSON object held as text -> ``(pos, key, value)`` rows in the order of the text, with 1-based ``id``."""
    parsed = F.from_json(F.col(text), f"map<string,{value_type}>")
    return df.select(F.posexplode(parsed).alias("pos", "key", "value")).withColumn("id", F.col("pos") + 1)


def build_vocab(df: DataFrame, source: str) -> DataFrame:
    """A list column -> ``(key, id)`` with ids from 1 in list order."""
    return df.select(F.posexplode(source).alias("pos", "key")).select("key", (F.col("pos") + 1).cast("bigint").alias("id"))


def vocab_of(df: DataFrame, key: str, position: str) -> DataFrame:
    """``(key, id)`` of a table's distinct keys in the order of their first appearance, ids from 1."""
    from roundhouse.operators.ordering import global_rank

    firsts = df.groupBy(F.col(key).alias("key")).agg(F.min(position).alias("_first"))
    return global_rank(firsts, ["_first", "key"], "_rank").select("key", (F.col("_rank") + 1).alias("id"))


def build_trait_vocab(spark: SparkSession, dims: Dims) -> DataFrame:
    """``(trait, breakpoint, id)``: traits in dimension order, breakpoints ascending."""
    ordered = local_frame(
        spark,
        [{"traits": [{"trait": t, "points": list(p)} for t, p in dims.traits.items()]}],
        [("traits", pa.list_(pa.struct([("trait", pa.string()), ("points", pa.list_(pa.int64()))])))],
    )
    pairs = F.flatten(
        F.transform(
            "traits",
            lambda t: F.transform(
                F.sort_array(t["points"]), lambda p: F.struct(t["trait"].alias("trait"), p.alias("breakpoint"))
            ),
        )
    )
    return ordered.select(F.posexplode(pairs).alias("pos", "pair")).select(
        "pair.trait", "pair.breakpoint", (F.col("pos") + 1).cast("bigint").alias("id")
    )
