"""Folds over long arrays whose result is another array, in time that grows with their length.

An array that grows by one element at a time is copied at each step. Here arrays are cut into runs, what a run needs to
know of those before it is found by one fold over the runs, and a run's own result grows by short steps only.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = 256


def runs_of(items: Column) -> Column:
    """items should be a column: it is looked at several times."""
    last = F.floor((F.size(items) - 1) / RUN).cast("int")
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: k <= last), lambda k: F.slice(items, k * RUN + 1, RUN))


def before_each(runs: Column, total: Callable[[Column], Column]) -> Column:
    """For each run the sum of total (an int) over the runs before it."""
    step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
    return F.aggregate(F.transform(runs, total), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]
