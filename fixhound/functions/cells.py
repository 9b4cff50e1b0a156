"""Sheet cells: a falsy value reads as the empty string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType


def cell_text(df: DataFrame, name: str) -> Column:
    """Text of a cell by its declared type: null, zero, false and "" all become ""."""
    cell, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, StringType):
        text = cell
    elif isinstance(kind, NumericType):
        text = F.when(cell != 0, cell.cast("string"))
    elif isinstance(kind, BooleanType):
        text = F.when(cell, F.lit("True"))
    else:
        text = cell.cast("string")
    return F.coalesce(text, F.lit(""))
