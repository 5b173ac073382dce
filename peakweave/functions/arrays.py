"""Array expressions: running values in log2(n) passes, one evaluation of shared intermediate values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running values of an array under an associative combine(earlier, later).

    Each pass combines every element with the one twice as far before it: n log n steps, where appending to
    an array in a fold copies it at every step.
    """
    passes = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    reach = F.transform(passes, lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(reach, values, lambda acc, step: F.transform(acc, lambda x, i: F.when(i >= step, combine(F.get(acc, i - step), x)).otherwise(x)))
