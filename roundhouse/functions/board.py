"""Features of one round as row expressions over its nested boards.

A round is one row and its two boards are arrays in that row, so every feature is a function of the row: extraction needs
no shuffle and no join, runs the same in batch and streaming, and survives any partitioning. The dimensions are constants
of the expression (``Dims`` checks their size).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roundhouse.dims import Dims
from roundhouse.functions.arrays import dense, let, literal_array, literal_lookup, pad, tally
from roundhouse.functions.cells import bare, board_cell, cell_code, code_col, code_row
from roundhouse.functions.scalars import item_at, tier_multiplier
from roundhouse.schema import CELLS, CHANNELS, MAX_ITEMS, MAX_TRAITS, MAX_UNITS, TIERS


class BoardEncoder:
    """Encodes nested boards with one set of dimensions."""

    def __init__(self, dims: Dims, max_units: int = MAX_UNITS, max_traits: int = MAX_TRAITS) -> None:
        self.dims = dims
        self.max_units = max_units
        self.max_traits = max_traits
        trait_position = {name: place for place, name in enumerate(dims.traits)}
        offsets, total = [], 0
        for points in dims.traits.values():
            offsets.append(total)
            total += len(points)
        self.trait_slots = total
        self.unit_slots = len(dims.units) * len(TIERS)
        self._unit_position = literal_lookup({name: place for place, name in enumerate(dims.units)}, "int")
        self._unit_cost = literal_array([unit.cost for unit in dims.units.values()], "bigint")
        self._unit_traits = literal_array(
            [[trait_position[t] for t in unit.traits if t in trait_position] for unit in dims.units.values()], "array<int>"
        )
        self._emblem_trait = literal_lookup({item: trait_position[trait] for item, trait in dims.emblems.items() if trait in trait_position}, "int")
        self._breakpoints = literal_array([list(points) for points in dims.traits.values()], "array<int>")
        self._trait_ids = literal_array(
            [[dims.trait_vocab.get((name, point)) for point in points] for name, points in dims.traits.items()], "array<int>"
        )
        self._trait_offset = literal_array(offsets, "int")
        self._unit_id = literal_lookup(dict(dims.unit_vocab), "int")
        self._item_id = literal_lookup(dict(dims.item_vocab), "int")

    # -- one side ----------------------------------------------------------------------------------------------------

    def _positions(self, board: Column) -> Column:
        """Dimension positions of the known units, in list order, copies kept."""
        return F.array_compact(F.transform(board, lambda u: self._unit_position(u["unit"])))

    def total_cost(self, board: Column) -> Column:
        """Sum of cost times tier multiplier; unknown units count nothing."""

        def add(total: Column, u: Column) -> Column:
            cost = F.get(self._unit_cost, self._unit_position(u["unit"]))
            return total + F.coalesce(cost * tier_multiplier(u["tier"]), F.lit(0).cast("bigint"))

        return F.aggregate(board, F.lit(0).cast("bigint"), add)

    def unit_tier_slots(self, board: Column) -> Column:
        """Slot of every known unit by unit and tier, copies kept, in list order; other tiers are dropped."""
        slots = F.transform(
            board,
            lambda u: F.when(
                u["tier"].between(TIERS[0], TIERS[-1]),
                self._unit_position(u["unit"]) * len(TIERS) + u["tier"].cast("int") - 1,
            ),
        )
        return F.array_compact(slots)

    def unit_tier_entries(self, board: Column) -> Column:
        """Counts per (unit, tier) as sparse entries over ``len(units) * 4`` slots."""
        return tally(self.unit_tier_slots(board))

    def trait_counts(self, board: Column, *, distinct_units: bool, emblems: bool) -> Column:
        """``array<struct<idx: trait position, n>>`` of one side.

        ``distinct_units`` counts a unit once however many copies stand on the board; ``emblems`` adds one per emblem item.
        """
        positions = self._positions(board)
        if distinct_units:
            positions = F.array_distinct(positions)
        carried = self.carried_traits(positions)
        if emblems:
            items = F.flatten(F.transform(board, lambda u: F.coalesce(u["item_ids"], F.array().cast("array<string>"))))
            carried = F.concat(
                carried, F.array_compact(F.transform(items, lambda i: self._emblem_trait(i)))
            )
        return tally(carried)

    def _level(self, count: Column) -> Column:
        return F.size(F.filter(F.get(self._breakpoints, count["idx"]), lambda b: b <= count["n"]))

    def level_entries(self, counts: Column) -> Column:
        """Trait counts ordered by trait -> sparse flags of the level each trait reaches, in canonical order."""
        reached = F.transform(
            counts,
            lambda c: F.struct((F.get(self._trait_offset, c["idx"]) + self._level(c) - 1).alias("idx"), self._level(c).alias("n")),
        )
        return F.transform(
            F.filter(reached, lambda e: e["n"] > 0), lambda e: F.struct(e["idx"].alias("idx"), F.lit(1).cast("bigint").alias("n"))
        )

    def ids_of(self, counts: Column) -> Column:
        """Trait counts -> ids of the highest breakpoints reached, ascending, cut and 0-padded to ``max_traits``."""
        ids = F.transform(counts, lambda c: F.get(F.get(self._trait_ids, c["idx"]), self._level(c) - 1))
        return pad(F.sort_array(F.array_compact(ids)), self.max_traits)

    def carried_traits(self, positions: Column) -> Column:
        """Trait positions of units given by dimension position, one entry per unit and trait."""
        return F.flatten(F.transform(positions, lambda p: F.get(self._unit_traits, p)))

    def trait_onehot(self, board: Column, *, distinct_units: bool = False, emblems: bool = False) -> Column:
        """One flag per (trait, level): only the reached level is 1, in canonical order."""
        counts = self.trait_counts(board, distinct_units=distinct_units, emblems=emblems)
        return dense(self.level_entries(counts), self.trait_slots)

    def trait_ids(self, board: Column, *, distinct_units: bool = True, emblems: bool = True) -> Column:
        """Vocabulary ids of the traits a side has active: distinct units and emblems by default."""
        return self.ids_of(self.trait_counts(board, distinct_units=distinct_units, emblems=emblems))

    # -- both sides --------------------------------------------------------------------------------------------------

    def wide_vector(self, player: Column, opponent: Column, kind: str = "int") -> Column:
        """The wide layout as one array in the order of :attr:`wide_names`."""
        sides = (player, opponent)
        units = [dense(self.unit_tier_entries(side), self.unit_slots, kind) for side in sides]
        counts = [self.trait_counts(side, distinct_units=False, emblems=False) for side in sides]
        traits = [dense(self.level_entries(count), self.trait_slots, kind) for count in counts]
        costs = F.array(*[self.total_cost(side).cast(kind) for side in sides])
        return F.concat(*units, *traits, costs)

    def wide_words(self, player: Column, opponent: Column) -> Column:
        """The wide layout but for the costs as names of its features, each as often as its value says."""
        names = literal_array(self.dims.wide_names, "string")
        sides = (player, opponent)
        units = [_named(names, self.unit_tier_slots(board), k * self.unit_slots) for k, board in enumerate(sides)]
        traits = []
        for k, board in enumerate(sides):
            flags = self.level_entries(self.trait_counts(board, distinct_units=False, emblems=False))
            traits.append(_named(names, F.transform(flags, lambda e: e["idx"]), len(sides) * self.unit_slots + k * self.trait_slots))
        return F.concat(*units, *traits)

    def onehot_pair(self, player: Column, opponent: Column) -> Column:
        """Trait one-hot of both sides, player first: copies count, emblems do not."""
        return F.concat(self.trait_onehot(player), self.trait_onehot(opponent))

    def trait_id_pair(self, player: Column, opponent: Column) -> Column:
        """Trait ids of both sides, player first: distinct units plus emblems."""
        return F.concat(self.trait_ids(player), self.trait_ids(opponent))

    def unit_records(self, player: Column, opponent: Column) -> Column:
        """Known, placed units of both sides, player first in list order, at most ``max_units``.

        ``array<struct<cell, row, col, unit_id, tier, item1, item2, item3, is_player>>``.
        """

        def known(board: Column, is_player: bool) -> Column:
            """Placed, known units as (u, code, unit_id, is_player); the dropped ones are not encoded any further."""
            found = F.transform(
                F.coalesce(board, F.array().cast(board_type())),
                lambda u: F.struct(
                    u.alias("u"),
                    let(bare(u["loc"]), cell_code).alias("code"),
                    self._unit_id(u["unit"]).alias("unit_id"),
                    F.lit(is_player).alias("is_player"),
                ),
            )
            return F.filter(found, lambda r: (r["code"] >= 0) & r["unit_id"].isNotNull())

        def record(r: Column) -> Column:
            row, col = code_row(r["code"]), code_col(r["code"])
            items = [
                F.coalesce(self._item_id(item_at(r["u"]["item_ids"], slot)), F.lit(0)).alias(f"item{slot + 1}")
                for slot in range(MAX_ITEMS)
            ]
            return F.struct(
                board_cell(row, col, r["is_player"]).alias("cell"),
                row.alias("row"),
                col.alias("col"),
                r["unit_id"].alias("unit_id"),
                F.coalesce(r["u"]["tier"], F.lit(0)).cast("int").alias("tier"),
                *items,
                r["is_player"].cast("int").alias("is_player"),
            )

        kept = F.slice(F.concat(known(player, True), known(opponent, False)), 1, self.max_units)
        return F.transform(kept, record)

    def occupied_cells(self, player: Column, opponent: Column) -> Column:
        """:meth:`unit_records` with one entry per cell, ordered by cell; the later list element wins."""

        return let(self.unit_records(player, opponent), last_on_cell)

    def board_tensor(self, player: Column, opponent: Column) -> Column:
        """Five channels of 8 x 7 cells, flat, channel-major; 0 is an empty cell."""
        return tensor_of(self.unit_records(player, opponent))

    def patch_id(self, timestamp: Column) -> Column:
        """Id of the latest patch released at or before ``timestamp``; 0 before the first."""
        releases = literal_array([ts for _, ts in self.dims.patches], "bigint")
        ids = literal_array([self.dims.patch_vocab[name] for name, _ in self.dims.patches], "int")
        return F.coalesce(F.get(ids, F.size(F.filter(releases, lambda r: r <= timestamp)) - 1), F.lit(0))


def _named(names: Column, places: Column, first: int) -> Column:
    """Names at the given places, counted from ``first``."""
    return F.transform(places, lambda place: F.get(names, place.cast("int") + first))


def last_on_cell(records: Column) -> Column:
    """One record per ``cell``, ordered by cell: of several in list order the last wins. One sort, one comparison of neighbours."""
    placed = F.transform(records, lambda r, place: F.struct(r["cell"].alias("cell"), place.alias("place"), *[r[c].alias(c) for c in CHANNELS]))

    def last(ordered: Column) -> Column:
        return F.filter(ordered, lambda r, k: F.coalesce(F.get(ordered, k + 1)["cell"] != r["cell"], F.lit(True)))

    return F.transform(let(F.sort_array(placed), last), lambda r: F.struct(r["cell"].alias("cell"), *[r[c].alias(c) for c in CHANNELS]))


def tensor_of(records: Column) -> Column:
    """Flat board tensor of an array of records in list order with ``cell`` and the channel fields.

    All channels are scattered at once: the run of empty cells before each record is made once, every channel lines these runs up with
    its own values, and one flattening joins all pieces.
    """

    def zeros(count: Column) -> Column:
        return F.array_repeat(F.lit(0), count)

    def gaps(occupied: Column) -> Column:
        before = lambda k: F.when(k > 0, F.get(occupied, k - 1)["cell"]).otherwise(-1)
        return F.transform(occupied, lambda r, k: F.struct(zeros(r["cell"] - before(k) - 1).alias("gap"), *[r[c].alias(c) for c in CHANNELS]))

    def pieces(runs: Column, rest: Column) -> Column:
        def channel(name: str) -> Column:
            return F.concat(F.flatten(F.transform(runs, lambda r: F.array(r["gap"], F.array(r[name])))), F.array(rest))

        return F.flatten(F.concat(*[channel(name) for name in CHANNELS]))

    def scattered(occupied: Column) -> Column:
        after = F.lit(CELLS - 1) - F.coalesce(F.get(occupied, F.size(occupied) - 1)["cell"], F.lit(-1))
        return let(zeros(after), lambda rest: let(gaps(occupied), lambda runs: pieces(runs, rest)))

    return let(last_on_cell(records), scattered)


def board_type() -> str:
    """SQL type of a board."""
    return "array<struct<unit:string,tier:bigint,item_ids:array<string>,loc:string>>"
