"""Board cells: parsing, formatting and the point mirror between the two sides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roundhouse.functions.arrays import let
from roundhouse.schema import COLS, ROWS

# The accepted spellings of a cell once every "_" is removed. The tolerant one takes what an integer
# parser takes for the column (blanks, a plus sign, leading zeros); the strict one is a clean snapshot cell.
TOLERANT = r"^\s*([A-Da-d])\s*\+?0*([1-7])\s*$"
STRICT = r"^[A-D][1-7]$"


def bare(loc: Column) -> Column:
    """Cell text without ``_``."""
    return F.replace(loc.cast("string"), F.lit("_"), F.lit(""))


def cell_code(text: Column) -> Column:
    """``row * 7 + col`` of a tolerant cell text given without ``_``, -1 when it is not a cell.

    Two plain characters, the usual case, are read directly; only other spellings go through the pattern.
    """

    def plain(two: Column) -> Column:
        row, col = F.ascii(F.upper(two)) - ord("A"), F.ascii(F.substring(two, 2, 1)) - ord("1")
        return F.when(row.between(0, ROWS - 1) & col.between(0, COLS - 1), row * COLS + col).otherwise(-1)

    def other(spelled: Column) -> Column:
        return F.when(F.length(spelled) == 2, plain(spelled)).otherwise(-1)

    return F.when(F.length(text) == 2, plain(text)).otherwise(let(F.regexp_replace(text, TOLERANT, "$1$2"), other))


def code_row(code: Column) -> Column:
    """Row of a cell code, -1 for none."""
    return F.when(code >= 0, ((code - code % COLS) / COLS).cast("int")).otherwise(-1)


def code_col(code: Column) -> Column:
    """Column of a cell code, -1 for none."""
    return F.when(code >= 0, code % COLS).otherwise(-1)


def cell_row(loc: Column) -> Column:
    """Row 0-3 of a tolerant cell text, -1 when it is not a cell."""
    return code_row(cell_code(bare(loc)))


def cell_col(loc: Column) -> Column:
    """Column 0-6 of a tolerant cell text, -1 when it is not a cell."""
    return code_col(cell_code(bare(loc)))


def is_strict_cell(loc: Column) -> Column:
    """True for ``A1`` .. ``D7`` (with or without ``_``), upper case only; null counts as not a cell."""
    return F.coalesce(bare(loc).rlike(STRICT), F.lit(False))


def format_cell(row: Column, col: Column) -> Column:
    """``(0, 0)`` -> ``A1``."""
    return F.concat(F.char(row + F.lit(ord("A"))), (col + 1).cast("string"))


def board_row(row: Column, is_player: Column) -> Column:
    """Row 0-7 on the shared board: the player owns the lower half, the opponent the mirrored upper half."""
    return F.when(is_player, row + ROWS).otherwise(F.lit(ROWS - 1) - row)


def board_col(col: Column, is_player: Column) -> Column:
    """Column 0-6 on the shared board; the opponent's are mirrored."""
    return F.when(is_player, col).otherwise(F.lit(COLS - 1) - col)


def board_cell(row: Column, col: Column, is_player: Column) -> Column:
    """Flat index 0-55 on the shared board."""
    return board_row(row, is_player) * COLS + board_col(col, is_player)
