"""Typing of text cells: which number grammar a cell follows, and how it is read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters stripped from both ends of a cell, and the number grammars.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
DIGITS = r"[0-9]+(?:_[0-9]+)*"
INTEGER_TEXT = rf"^[+-]?{DIGITS}$"
FLOAT_TEXT = rf"^[+-]?(?:{DIGITS}(?:\.(?:{DIGITS})?)?|\.{DIGITS})(?:[eE][+-]?{DIGITS})?$"
NUMBER_TEXT = rf"^(?:{FLOAT_TEXT[1:-1]}|[+-]?(?i:inf|infinity|nan))$"

#: Cell classes, in the order in which a column of mixed cells widens.
EMPTY, LONG, BIG_INTEGER, FLOAT, TEXT = range(5)

CLASS_TYPES: dict[int, T.DataType] = {
    EMPTY: T.StringType(),
    LONG: T.LongType(),
    BIG_INTEGER: T.DecimalType(38, 0),
    FLOAT: T.DoubleType(),
    TEXT: T.StringType(),
}


def strip(cell: Column) -> Column:
    """The cell without surrounding white space; blank cells become null."""
    return F.nullif(F.btrim(cell, F.lit(WHITESPACE)), F.lit(""))


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(""))


def class_of_stripped(text: Column) -> Column:
    """Class of one stripped text: with a dot it may be a float, without one an integer."""
    whole = text.rlike(INTEGER_TEXT)
    return (
        F.when(text.isNull(), EMPTY)
        .when(F.contains(text, F.lit(".")), F.when(text.rlike(FLOAT_TEXT), FLOAT).otherwise(TEXT))
        .when(~whole, TEXT)
        .when(F.length(text) < 19, LONG)
        .when(_plain(text).try_cast("bigint").isNotNull(), LONG)
        .when(_plain(text).try_cast("decimal(38,0)").isNotNull(), BIG_INTEGER)
        .otherwise(TEXT)
    )


def cell_class(cell: Column) -> Column:
    """Class of one text cell."""
    return class_of_stripped(strip(cell))


def read_stripped(text: Column, as_type: T.DataType) -> Column:
    """A stripped text as ``as_type``; texts outside the grammar become null."""
    if isinstance(as_type, T.StringType):
        return text
    grammar = INTEGER_TEXT if isinstance(as_type, (T.LongType, T.DecimalType)) else FLOAT_TEXT
    return F.when(text.rlike(grammar), _plain(text).try_cast(as_type))


def read_cell(cell: Column, as_type: T.DataType) -> Column:
    """A text cell, stripped and read as ``as_type``."""
    return read_stripped(strip(cell), as_type)


def as_number(value: Column, of_type: T.DataType) -> Column:
    """A double for anything that reads as a number, else null. Booleans count as 0 and 1."""
    if isinstance(of_type, T.StringType):
        text = strip(value)
        return F.when(text.rlike(NUMBER_TEXT), _plain(text).try_cast("double"))
    if isinstance(of_type, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    return F.lit(None).cast("double")
