"""Whole rows in one column, so that an operator's own columns can't clash with the caller's."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns of df in one struct: beside it, any name can be used for a column of one's own."""
    return F.struct(*map(column, df.columns))


def unpacked(df: DataFrame, names: list[str], row: str = "row", **new: Column) -> DataFrame:
    """The fields `names` of the struct `row`, in order; new columns take the place of fields of their name, or follow them."""
    kept = [new[n].alias(n) if n in new else F.col(row).getField(n).alias(n) for n in names]
    return df.select(*kept, *(c.alias(n) for n, c in new.items() if n not in names))
