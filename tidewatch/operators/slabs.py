"""Scans over the time of an entity in two levels, so that one busy entity is many tasks.

An entity's time is cut into slabs. What a row needs from the rows before it in its slab comes from a window over (entity, slab); what it needs
from earlier slabs is a small carry, one row a slab: the carries of an entity are scanned in order of time, and each slab's rows
meet theirs by (entity, slab). Results are those of one window over the entity.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECOND = 1_000_000
#: Seconds of a slab.
WIDTH = 86_400


def slab_of(t: Column, seconds: int = WIDTH) -> Column:
    return F.floor(t / (seconds * SECOND))


def _met(rows: DataFrame, carries: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the carry of their slab; entities may have null keys."""
    named = carries.select(*[F.col(c).alias(f"__c_{c}") for c in by], "__slab", "__carry")
    keys = [F.col(c).eqNullSafe(F.col(f"__c_{c}")) for c in by]
    return rows.join(named.withColumnRenamed("__slab", "__c_slab"), reduce(lambda a, b: a & b, keys, F.col("__slab") == F.col("__c_slab"))).drop("__c_slab", *[f"__c_{c}" for c in by])


def numbered_runs(rows: DataFrame, by: list[str], order: list[str], state: list[str], cut: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], name: str, seconds: int = WIDTH) -> DataFrame:
    """Number the runs of each entity from 1: a new one begins where ``cut(before, here)`` holds between two rows that follow each other, both given as
    functions from a column of ``state`` to its value. ``order`` begins with ``t``."""
    here, before, first, last = (lambda c: F.col(c)), (lambda c: F.col(f"__before.{c}")), (lambda c: F.col(f"__first.{c}")), (lambda c: F.col(f"__last.{c}"))
    window = Window.partitionBy(*by, "__slab").orderBy(*order)
    marked = rows.withColumn("__slab", slab_of(F.col("t"), seconds)).withColumn("__before", F.lag(F.struct(*state)).over(window))
    marked = marked.withColumn("__cut", F.when(F.col("__before").isNull(), 0).otherwise(cut(before, here).cast("int")))
    place = F.struct(*order)
    slabs = marked.groupBy(*by, "__slab").agg(F.min_by(F.struct(*state), place).alias("__first"), F.max_by(F.struct(*state), place).alias("__last_own"), F.sum("__cut").alias("__cuts"))
    time = Window.partitionBy(*by).orderBy("__slab")
    slabs = slabs.withColumn("__last", F.lag("__last_own").over(time))
    slabs = slabs.withColumn("__opens", F.when(F.col("__last").isNull(), 1).otherwise(cut(last, first).cast("int")))
    slabs = slabs.withColumn("__carry", F.sum(F.col("__opens") + F.col("__cuts")).over(time) - F.col("__cuts"))
    met = _met(marked.withColumn("__run", F.sum("__cut").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("__before", "__cut"), slabs, by)
    return met.withColumn(name, F.col("__carry") + F.col("__run")).drop("__slab", "__carry", "__run")


def last_before(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str, seconds: int = WIDTH) -> DataFrame:
    """Each row with the latest ``value`` that isn't null of the rows before it. ``order`` begins with ``t``."""
    window = Window.partitionBy(*by, "__slab").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumns({"__slab": slab_of(F.col("t"), seconds), "__value": value})
    slabs = marked.groupBy(*by, "__slab").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(*order))).alias("__own"))
    carry = F.last("__own", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__slab").rowsBetween(Window.unboundedPreceding, -1))
    met = _met(marked.withColumn("__near", F.last("__value", ignorenulls=True).over(window)).drop("__value"), slabs.withColumn("__carry", carry), by)
    return met.withColumn(name, F.coalesce("__near", "__carry")).drop("__slab", "__near", "__carry")
