"""Profiles stored in versions: statistics, habits and hourly baselines of entities, merged run by run.

A version is a folder of tables, each bucketed by its entity, so a merge shuffles only what is new. A version counts once its line
is in the table of commits, written last: a failed write leaves the version before as the latest, and its half-written folder is never read.
Counts and sums merge exactly; means and squared deviations by Chan's formula. So two runs stored one after the other are what one
run over both would have given.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import signals as S
from tidewatch.operators import profiles as N

ENTITY = ["computer", "account", "image"]
HOURLY = [*ENTITY, "parent", "hour"]
BUCKETS = 32
#: Keys of each table, and for each mean its count and its squared deviations, if there are any; all else is added.
TABLES: dict[str, tuple[list[str], dict[str, tuple[str, str | None]]]] = {
    "entities": (ENTITY, {"mean": ("n", "m2"), "e_mean": ("e_n", "e_m2")}),
    "habits": ([*ENTITY, "kind", "key"], {}),
    "hourly": (HOURLY, {"mean": ("days", "m2"), "length": ("days", None), "follow": ("days", None)}),
}


def with_account(events: DataFrame) -> DataFrame:
    """Adds ``account``: whether a user is one of the system's own or interactive."""
    user = F.upper(F.coalesce("user", F.lit("")))
    own = F.contains(user, F.lit("SYSTEM")) | F.contains(user, F.lit("NETWORK SERVICE"))
    return events.withColumn("account", F.when(own, "system").otherwise("interactive"))


def profiles_of(events: DataFrame) -> dict[str, DataFrame]:
    """The three tables of one run's events (``profiles.with_keys``). Runs begin and end at full hours, since hourly baselines count the days on which an hour was seen."""
    x = with_account(events)
    entities, habits = N.profile_rows(x, ENTITY)
    entities = entities.select(*ENTITY, "n", "mean", "m2", "e_n", "e_mean", "e_m2")
    day = x.groupBy(*ENTITY, F.coalesce("parent_image", F.lit("")).alias("parent"), "hour", F.floor(F.col("t") / N.DAY).alias("day")).agg(
        F.count("*").alias("exec_count"), F.avg(F.length("command_line")).alias("command_length"), F.count_if(F.col("event_code").isin(3, 11, 13)).alias("followups"))
    return {"entities": entities, "habits": habits, "hourly": N.hourly_profile(day.fillna(0.0, ["command_length"]), HOURLY)}


def _sum(old: str, new: str) -> Column:
    return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))


def merge_table(name: str, old: DataFrame, new: DataFrame) -> DataFrame:
    """One table of two versions: a full outer join by its keys."""
    keys, means = TABLES[name]
    squares = {m2 for _, m2 in means.values() if m2}
    o, w = (f.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in f.columns if c not in keys]) for p, f in (("o", old), ("w", new)))
    out = {}
    for c in [c for c in new.columns if c not in keys]:
        if c in squares:
            continue
        if c not in means:
            out[c] = _sum(f"o_{c}", f"w_{c}")
            continue
        n, m2 = means[c]
        a, b = F.coalesce(f"o_{n}", F.lit(0)), F.coalesce(f"w_{n}", F.lit(0))
        step = F.coalesce(f"w_{c}", F.lit(0.0)) - F.coalesce(f"o_{c}", F.lit(0.0))
        out[c] = F.when(a + b > 0, F.coalesce(f"o_{c}", F.lit(0.0)) + step * b / (a + b))
        if m2:
            out[m2] = F.when(a + b > 0, _sum(f"o_{m2}", f"w_{m2}") + step * step * a * b / (a + b)).otherwise(_sum(f"o_{m2}", f"w_{m2}"))
    return o.join(w, keys, "full").select(*keys, *[out[c].alias(c) for c in new.columns if c not in keys])


class ProfileStore:
    """Versions of profiles under one folder, which all executors reach."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def latest(self) -> tuple[int, str] | None:
        """Number and folder of the latest version; null if nothing was stored yet."""
        try:
            return self.spark.read.schema("version long, place string").parquet(f"{self.folder}/commits").agg(F.max(F.struct("version", "place")).alias("m")).select("m.*").dropna().first()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def read(self) -> dict[str, DataFrame]:
        """The tables of the latest version, as bucketed tables."""
        found = self.latest()
        return {name: self._table(f"{found[1]}/{name}", name) for name in TABLES} if found else {}

    def _table(self, path: str, name: str) -> DataFrame:
        spark, keys = self.spark, ", ".join(ENTITY)
        table = f"profile_{name}_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        if not spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return spark.table(table)

    def add(self, new: dict[str, DataFrame]) -> int:
        """Merge a run's tables with the latest version and store the outcome as the next one; returns its number."""
        found, old = self.latest(), self.read()
        version = found[0] + 1 if found else 1
        place = f"{self.folder}/versions/{version:06d}-{uuid.uuid4().hex}"
        for name, (keys, _) in TABLES.items():
            rows = merge_table(name, old[name], new[name]) if old else new[name]
            table = f"profile_write_{uuid.uuid4().hex}"
            writer = rows.repartition(self.buckets, *ENTITY).write.bucketBy(self.buckets, *ENTITY).sortBy(*ENTITY).format("parquet").option("path", f"{place}/{name}")
            writer.saveAsTable(table)
            self.spark.sql(f"DROP TABLE {table}")  # of an external table only the name goes
        self.spark.createDataFrame([(version, place)], "version long, place string").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return version


def system_habits(store: dict[str, DataFrame]) -> DataFrame:
    """How many observations and habits of each kind the accounts of a host have."""
    seen = reduce(lambda a, b: a.join(b, ENTITY, "left"), [store["entities"], store["habits"].groupBy(*ENTITY).agg(F.count("*").alias("habits"), F.count_if(F.col("kind") == "p").alias("parents"))])
    return seen.groupBy("computer", "account").agg(F.count("*").alias("entities"), F.sum("n").alias("n"), F.sum("habits").alias("habits"), F.sum("parents").alias("parents"))


def anomaly_events(events: DataFrame, store: dict[str, DataFrame]) -> DataFrame:
    """How often the stored habits hold each key of each event: (event_uid, kind, key, count, total), for events scored against a stored version."""
    seen = N.habits(with_account(events), ENTITY, ["event_uid"])
    totals = store["habits"].groupBy(*ENTITY, "kind").agg(F.sum("count").alias("total"))
    out = seen.join(store["habits"], [*ENTITY, "kind", "key"], "left").join(totals, [*ENTITY, "kind"], "left")
    return out.select("event_uid", "kind", "key", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("total", F.lit(0)).alias("total"))
