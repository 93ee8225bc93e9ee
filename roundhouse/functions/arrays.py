"""Array building blocks for features kept inside one row."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from roundhouse.schema import CELLS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times.

    Catalyst inlines expressions into lambdas and would evaluate them again for every element; a lambda variable is
    evaluated once.
    """
    return F.transform(F.array(value), body).getItem(0)


def literal_array(values: Sequence, element: str) -> Column:
    """A constant array, nested if the values are. Given as text that the optimiser parses once, while planning."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{element}>")


def literal_lookup(pairs: Mapping[str, object], value: str) -> Callable[[Column], Column]:
    """A constant map with text keys, as a function from a key to its value (null for other keys).

    Spark searches a map's keys one by one. Here the keys are dealt to twice as many small maps by a checksum, so that a look-up takes
    the same time however many keys there are.
    """
    slots = 2 * len(pairs) + 1
    maps: list[dict] = [{} for _ in range(slots)]
    for name, found in pairs.items():
        maps[zlib.crc32(name.encode()) % slots][name] = found
    table = literal_array(maps, f"map<string,{value}>")
    return lambda name: F.try_element_at(F.get(table, F.pmod(F.crc32(name), F.lit(slots)).cast("int")), name)


def tally(values: Column) -> Column:
    """Count equal values: ``array<struct<idx, n>>`` ordered by value. One sort, one comparison of neighbours."""

    def counted(ordered: Column) -> Column:
        marked = F.transform(
            ordered, lambda v, place: F.struct(v.alias("idx"), place.alias("at"), ((place == 0) | (F.get(ordered, place - 1) != v)).alias("first"))
        )
        heads = F.filter(marked, lambda h: h["first"])
        return let(
            heads,
            lambda h: F.transform(
                h, lambda e, k: F.struct(e["idx"].alias("idx"), (F.coalesce(F.get(h, k + 1)["at"], F.size(ordered)) - e["at"]).alias("n"))
            ),
        )

    return let(F.sort_array(values), counted)


def dense(entries: Column, length: int, kind: str = "int") -> Column:
    """Sparse ``array<struct<idx, n>>``, ordered by distinct 0-based ``idx``, to a dense array of ``length``.

    Works run by run: each entry contributes its gap of zeros and itself, so the cost follows the entries, not the length.
    """

    def zeros(count: Column) -> Column:
        return F.array_repeat(F.lit(0).cast(kind), count.cast("int"))

    def build(given: Column) -> Column:
        before = F.concat(F.array(F.lit(-1).cast("bigint")), F.transform(given, lambda e: e["idx"].cast("bigint")))
        runs = F.zip_with(
            given,
            F.slice(before, F.lit(1), F.size(given)),
            lambda e, prev: F.concat(zeros(e["idx"] - prev - 1), F.array(e["n"].cast(kind))),
        )
        return F.concat(F.flatten(runs), zeros(F.lit(length - 1) - F.get(before, F.size(given))))

    return let(entries, build)


def last_at_most(ordered: Column, value: Column) -> Column:
    """0-based place of the last element of an ascending array that is at most ``value``, -1 if there is none or ``value`` is null.

    A binary search: it takes as many steps as the array's length has binary digits.
    """

    def narrow(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"], 1)
        found = F.coalesce(F.get(ordered, middle) <= value, F.lit(False))
        open_ = state["high"] - state["low"] > 1
        return F.struct(
            F.when(open_ & found, middle).otherwise(state["low"]).alias("low"),
            F.when(open_ & ~found, middle).otherwise(state["high"]).alias("high"),
        )

    start = F.struct(F.lit(-1).alias("low"), F.coalesce(F.size(ordered), F.lit(0)).alias("high"))
    steps = F.sequence(F.lit(1), F.length(F.bin(F.coalesce(F.size(ordered), F.lit(0)) + 1)))
    return F.aggregate(steps, start, narrow, lambda state: state["low"])


def pad(values: Column, length: int) -> Column:
    """First ``length`` values, 0-filled on the right."""
    return let(
        F.slice(values, 1, length),
        lambda kept: F.concat(kept, F.array_repeat(F.lit(0).cast("int"), F.lit(length) - F.size(kept))),
    )


def swap_halves(values: Column) -> Column:
    """Element ``i`` becomes element ``(i + n // 2) mod n``."""
    return let(
        values,
        lambda v: let(
            (F.size(v) / 2).cast("int"),
            lambda half: F.concat(F.slice(v, half + 1, F.size(v) - half), F.slice(v, F.lit(1), half)),
        ),
    )


def rotate_board(tensor: Column, channels: int) -> Column:
    """Turn every channel of a flat board by 180 degrees: both spatial axes flip, which reverses its cells."""
    return let(
        tensor,
        lambda t: F.concat(*[F.reverse(F.slice(t, channel * CELLS + 1, CELLS)) for channel in range(channels)]),
    )
