"""Data-quality jobs: accounting, context checks, invariants of a run, and an order-free fingerprint of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import signals as S


def accounting(raw: DataFrame, key: str, needed: list[str]) -> DataFrame:
    """Rows read, complete, distinct and dropped."""
    complete = F.lit(True)
    for c in needed:
        complete = complete & F.col(c).isNotNull()
    return raw.agg(F.count("*").alias("raw"), F.count_if(complete).alias("complete"), F.count_distinct(F.when(complete, F.col(key))).alias("final")).withColumn("dropped", F.col("raw") - F.col("final"))


class LostRows(RuntimeError):
    """A write that left nothing of what it read."""


def accounted_write(raw: DataFrame, needed: list[str], path: str) -> dict[str, int]:
    """Write the complete rows of ``raw`` and count both in the same pass, by observations on the write itself: one scan.

    Raises ``LostRows`` if there were rows and none was complete; what was written then is an empty table.
    """
    from functools import reduce

    from pyspark.sql import Observation

    read, kept = Observation("read"), Observation("kept")
    complete = reduce(lambda a, c: a & F.col(c).isNotNull(), needed, F.lit(True))
    raw.observe(read, F.count(F.lit(1)).alias("n")).filter(complete).observe(kept, F.count(F.lit(1)).alias("n")).write.parquet(path)
    counts = {"raw": read.get["n"], "complete": kept.get["n"]}
    if counts["raw"] and not counts["complete"]:
        raise LostRows(f"none of {counts['raw']} rows has all of {', '.join(needed)}")
    return counts | {"dropped": counts["raw"] - counts["complete"]}


def context_problems(events: DataFrame) -> DataFrame:
    """Events that lack what a burst needs, with what is missing."""
    missing = F.array_compact(F.array(*[F.when(S.clean(F.col(c)).isNull(), F.lit(c)) for c in ("image", "computer", "user", "parent_image")]))
    return events.withColumn("missing", F.array_join(missing, ",")).filter("missing <> ''")


def invariants(bursts: DataFrame, edge_sums: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """Violations by kind: a score without evidence, edges (``edge_sums``) that end in an event of no campaign, a child before
    its parent, a node in two campaigns, a burst that ends before it starts."""
    parents = links.select(F.col("event_id").alias("parent_id"), F.col("t").alias("parent_t"))
    checks = {
        "score without evidence": bursts.filter((F.col("risk") > 0) & (F.col("n") == 0)),
        "burst runs backwards": bursts.filter("end_t < start_t"),
        "edge without ends": edge_sums.join(members, "node", "left_anti"),
        "node in two campaigns": members.groupBy("node").agg(F.count_distinct("component").alias("c")).filter("c > 1"),
        "child before parent": links.join(parents, "parent_id").filter("t < parent_t"),
    }
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("invariant"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def table_fingerprint(rows: DataFrame, columns: list[str], buckets: int = 256) -> DataFrame:
    """A digest that any order of rows and partitions gives alike and any engine with SHA-256 can check: each row's values as text are
    joined by tabs (a null is an empty field) and hashed; the first 120 bits are summed as two numbers in ``buckets`` buckets, and one digest is made of the sums."""
    h = F.sha2(F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), "\t"), 256)
    word = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")
    by = rows.select((F.conv(F.substring(h, 31, 8), 16, 10).cast("long") % buckets).alias("b"), word(1).alias("x"), word(16).alias("y")).groupBy("b").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.count("*").alias("n"))
    lines = F.array_sort(F.collect_list(F.struct("b", "x", "y", "n")))  # a row a bucket
    digest = F.sha2(F.array_join(F.transform(lines, lambda x: F.concat_ws(":", *[x[c].cast("string") for c in ("b", "x", "y", "n")])), "|"), 256)
    return by.agg(digest.alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
