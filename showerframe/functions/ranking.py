"""Top-1 and ordinal numbering without collecting a group in one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(value: Column, *order: Column) -> Column:
    """Value of the row with the greatest ``order`` tuple: an aggregate with map-side combine, hence safe for a group
    of any size, and deterministic when the order is total."""
    return F.max_by(value, F.struct(*order))


def totals_before(rows: DataFrame, by: list[str], column: str, value: str, out: str, bits: int = 21) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the same ``by`` whose ``column`` is smaller.

    A plain window over ``by`` would sort a whole group in one task. The non-negative ``column`` is read as digits of
    ``bits`` bits instead: values are summed per prefix, and every window covers the children of one prefix, at most
    2**bits rows. ``rows`` must hold each (by, column) once; a negative or null ``column`` is an error."""
    digits = F.when(F.col(column) >= 0, F.col(column).cast("long")).otherwise(
        F.raise_error(F.lit(f"{column} must not be negative")).cast("long"))
    prefixes = {f"_p{shift}": F.shiftrightunsigned(digits, shift) for shift in range(bits, 63, bits)}
    names = list(prefixes)
    keyed = rows.withColumns(prefixes)

    def before(parents: list[str], order: str):
        return Window.partitionBy(*by, *parents).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    ranked = keyed.withColumn(out, F.coalesce(F.sum(value).over(before(names, column)), F.lit(0)))
    for depth, name in enumerate(names):
        level = keyed.groupBy(*by, *names[depth:]).agg(F.sum(value).alias("_n"))
        offset = level.withColumn("_off", F.coalesce(F.sum("_n").over(before(names[depth + 1:], name)), F.lit(0)))
        ranked = (ranked.join(offset.drop("_n"), [*by, *names[depth:]])
                  .withColumn(out, F.col(out) + F.col("_off")).drop("_off"))
    return ranked.drop(*names)


def ordinals(keys: DataFrame, by: list[str], column: str, out: str, bits: int = 21) -> DataFrame:
    """0-based rank of each distinct non-negative ``column`` value within ``by``; ``keys`` holds each pair once."""
    ones = keys.select(*by, column, F.lit(1).cast("long").alias("_one"))
    return totals_before(ones, by, column, "_one", out, bits).select(*by, column, out)
