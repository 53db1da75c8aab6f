"""Running sums and maxima over arrays, which Spark's functions on arrays don't have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def _running(values: Column, first: Column, kind: str, step_on, block: int) -> Column:
    """What `step_on` has made of the values before each place, from `first` on. An array grows
    by being copied, so results are gathered in blocks, and work stays near to linear in long
    arrays. `values` is named once and outside of any lambda, in which it would be worked out at
    every step."""
    none = F.array().cast(f"array<{kind}>")

    def step(acc, n):
        full = F.size(acc["open"]) == block - 1
        grown = F.concat(acc["open"], F.array(acc["at"]))
        done = F.when(full, F.concat(acc["done"], F.array(grown))).otherwise(acc["done"])
        return F.struct(step_on(acc["at"], n).alias("at"), done.alias("done"), F.when(full, none).otherwise(grown).alias("open"))

    start = F.struct(first.cast(kind).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("done"), none.alias("open"))
    return F.aggregate(values, start, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["open"]))))


def running_starts(sizes: Column, block: int = BLOCK) -> Column:
    """For an array<bigint> of sizes, where each begins."""
    return _running(sizes, F.lit(0), "bigint", lambda at, n: at + n, block)


def running_reach(ends: Column, block: int = BLOCK) -> Column:
    """For an array<int>, the greatest value before each place, or -1."""
    return _running(ends, F.lit(-1), "int", lambda at, n: F.greatest(at, n), block)
