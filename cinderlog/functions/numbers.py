"""Rounding rules of the dashboard figures, computed on decimals."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int) -> Column:
    """part / whole in percent, half up; 0 when there is nothing."""
    ratio = F.lit(100) * part.cast("decimal(18,4)") / whole.cast("decimal(18,0)")
    return (
        F.when(whole == 0, F.lit(0.0))
        .otherwise(F.round(ratio, digits).cast("double"))
    )


def half_up(value: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(value + F.lit(0.5)).cast("long")
