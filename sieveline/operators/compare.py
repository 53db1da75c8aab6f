"""Results against results: set differences, unions without repeats, digests, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTITY = ["path", "abs_start", "abs_end"]


def differences(expected: DataFrame, got: DataFrame, key: list[str] | None = None) -> DataFrame:
    """key and side: `missing` for rows of expected only, `extra` for rows of got only;
    rows count as often as they stand. One shuffle of both sides, with partial counts."""
    key = key or IDENTITY
    both = expected.select(*key, F.lit(1).alias("n")).unionByName(got.select(*key, F.lit(-1).alias("n")))
    net = both.groupBy(*key).agg(F.sum("n").alias("n")).where("n <> 0")
    return net.select(*key, F.when(F.col("n") > 0, "missing").otherwise("extra").alias("side"), F.abs("n").alias("times"))


def joined(expected: DataFrame, got: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Full outer join on identity, with where each row is met."""
    key = key or IDENTITY
    left, right = expected.select(*key, F.lit(True).alias("in_expected")), got.select(*key, F.lit(True).alias("in_got"))
    no = F.lit(False)
    return left.join(right, key, "full_outer").select(*key, F.coalesce("in_expected", no).alias("in_expected"), F.coalesce("in_got", no).alias("in_got"))


def rollup(outcomes: DataFrame) -> DataFrame:
    """One row of outcomes(status, missing, extra): how many queries, failures, errors,
    missing and extra rows, and whether all is well."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    all_ = outcomes.agg(
        F.count("*").alias("n_queries"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if(F.col("status") == "error").alias("n_errors"), n("missing").alias("n_missing"), n("extra").alias("n_extra")
    )
    return all_.withColumn("passed", (F.col("n_failed") == 0) & (F.col("n_errors") == 0) & (F.col("n_missing") == 0) & (F.col("n_extra") == 0))


def union_once(*results: DataFrame, key: tuple[str, ...] = ("path", "line_no")) -> DataFrame:
    """All results; a key that several hold is taken once."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.dropDuplicates(list(key))


def is_set(rows: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row: how many rows and keys there are, and whether no key repeats."""
    each = rows.groupBy(*(key or IDENTITY)).agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), F.count("*").alias("n_keys"), F.coalesce(F.max("n") <= 1, F.lit(True)).alias("unique"))


def framed(*values: Column) -> Column:
    """Values each led by their length in bytes, so that no two lists look alike."""
    return F.concat(*(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v) for v in values))


def digest_of(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n and a digest of each group's values that doesn't depend on their order: the sum of
    their framed hashes. Sums begin before the shuffle, so groups may be of any size."""
    number = F.conv(F.substring(F.sha2(F.encode(framed(F.col(value)), "UTF-8"), 256), 1, 13), 16, 10).cast("decimal(20,0)")
    total = (F.sum(number) % F.lit(10**18).cast("decimal(20,0)")).cast("long")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), total.alias("digest"))


def alike(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Whether two numbers are equal but for rounding."""
    return F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
