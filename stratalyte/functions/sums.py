"""Sums of doubles in the order of a table's rows, and rounding, as the SQL engine has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def running_sum(df: DataFrame, keys: list[str], value: str, *carry: str) -> DataFrame:
    """keys, carry, file, row and so_far, the sum of a key's values up to this row, in the order in which the files hold them.

    Doubles added up in another order may differ in their last bits, which shows where a sum is compared with another one or
    with a bound that it meets to the cent. `df` is a table as it was read; a group is streamed, not held.
    """
    rows = df.select(*keys, value, *carry, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    w = Window.partitionBy(*keys).orderBy("file", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("so_far", F.sum(value).over(w))


def whole_sum() -> Column:
    """The sum of a group, as an aggregate of the rows of `running_sum`."""
    return F.max_by("so_far", F.struct("file", "row"))


def nearest(c: Column, places: int) -> Column:
    """Rounded as the SQL engine does, by the scaled double: decimal digits that end in a five would round up where the double lies below."""
    return F.round(c * 10.0**places) / 10.0**places
