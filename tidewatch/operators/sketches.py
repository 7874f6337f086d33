"""Counts that merge: frequency sketches with exact heavy hitters, and distinct counts (exact or as sketches), stored by run and united later.

A frequency sketch is a table (depth, bucket, count) of at most ``depth`` x ``width`` rows, whatever the number of keys; beside it stand the keys
that are frequent enough, with their exact counts. Sketches of several runs merge by adding rows. An estimate is never below the true
count, and above it by more than e / width of all rows with a probability of at most exp(-depth).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH, WIDTH = 4, 1 << 16
#: lg of the registers of a distinct count: about 1.6 % of standard error.
REGISTERS = 12


def _buckets(key: list[str], depth: int, width: int) -> Column:
    return F.inline(F.array(*[F.struct(F.lit(i).alias("depth"), F.pmod(F.xxhash64(F.lit(i), *key), F.lit(width)).alias("bucket")) for i in range(depth)]))


def frequency_sketch(rows: DataFrame, key: list[str], depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(depth, bucket, count) over all rows. Rows are counted by key before they are dealt, so a frequent key is no hot bucket."""
    counts = rows.groupBy(*key).agg(F.count("*").alias("__n"))
    return counts.select("__n", _buckets(key, depth, width)).groupBy("depth", "bucket").agg(F.sum("__n").alias("count"))


def heavy_hitters(rows: DataFrame, key: list[str], least: int) -> DataFrame:
    """(key, count) of keys with at least ``least`` rows."""
    return rows.groupBy(*key).agg(F.count("*").alias("count")).filter(F.col("count") >= least)


def merged(tables: list[DataFrame], key: list[str]) -> DataFrame:
    """Sketches (key ``depth``, ``bucket``) or exact counts of several runs as one."""
    return reduce(DataFrame.unionByName, tables).groupBy(*key).agg(F.sum("count").alias("count"))


def estimated(keys: DataFrame, key: list[str], sketch: DataFrame, heavy: DataFrame | None = None, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """Different keys with their ``count``: exact where a key is among the heavy ones, else the least of its buckets."""
    asked = keys.select(*key).distinct()
    found = asked.select(*key, _buckets(key, depth, width)).join(sketch, ["depth", "bucket"], "left")
    out = found.groupBy(*key).agg(F.min(F.coalesce("count", F.lit(0))).alias("__least"))
    if heavy is None:
        return out.withColumnRenamed("__least", "count")
    exact = heavy.select(*[F.col(k).alias(f"__{k}") for k in key], "count")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    return out.join(exact, same, "left").select(*key, F.coalesce("count", "__least").alias("count"))


def distinct_sketches(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One sketch a group and column, each a few kilobytes however many values there are."""
    return rows.groupBy(*by).agg(*[F.hll_sketch_agg(c, F.lit(REGISTERS)).alias(c) for c in columns])


def united(sketches: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Distinct counts over the union of sketches: values that several runs share count once."""
    return sketches.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])


def distinct_values(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(group, name, value): the different values of text columns as rows, null too, where the counts must be exact."""
    return rows.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns]))).distinct()


def united_values(values: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Exact distinct counts over the union of ``distinct_values``: values that several runs share count once, null doesn't count."""
    each = values.select(*by, "name", "value").distinct()
    return each.groupBy(*by).agg(*[F.count(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in columns])
