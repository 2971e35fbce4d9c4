"""Names for intermediate values within one expression."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body refers to it."""
    return F.transform(F.array(value), body)[0]


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: elsewhere Spark may copy an expression into each filter and field
    that use it, but not one that a generator gives."""
    return df.withColumn(name, F.explode(F.array(value)))
