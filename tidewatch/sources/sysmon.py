"""Event sources and sinks: event-log XML, run tables, CSV exports, rule files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import signals as S
from tidewatch.operators import bursts as B
from tidewatch.operators import graph as G
from tidewatch.operators import report as A
from tidewatch.operators import rules as R

XML_SCHEMA = "System struct<EventID: string, TimeCreated: struct<_SystemTime: string>, Computer: string>, EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>, _corrupt_record string"
# The field names that each canonical column may come under, in order of preference.
ALIASES = {
    "image": ["image", "processimage"], "parent_image": ["parentimage"], "command_line": ["commandline", "cmdline"], "user": ["user"], "pid": ["processid"], "ppid": ["parentprocessid"],
    "src_ip": ["sourceip"], "dst_ip": ["destinationip"], "dst_port": ["destinationport"], "file_path": ["targetfilename"], "reg_key": ["targetobject", "details"], "dns_query": ["queryname"], "hashes": ["hashes"],
}

#: Fields that pattern sets are looked for in.
SCANNED = ["image", "parent_image", "command_line", "file_path", "reg_key", "dst_ip", "user"]


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Canonical events of event-log XML files, namespaced or not; broken rows have ``corrupt`` set and no code."""
    return parse_xml(spark.read.format("xml").option("rowTag", "Event").option("mode", "PERMISSIVE").option("ignoreNamespace", "true").schema(XML_SCHEMA).load(path))


def stream_xml(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of files that are put into a folder; what was read is kept by the query's checkpoint."""
    return parse_xml(spark.readStream.format("xml").option("rowTag", "Event").option("mode", "PERMISSIVE").option("ignoreNamespace", "true").schema(XML_SCHEMA).load(path))


def parse_xml(raw: DataFrame) -> DataFrame:
    data = F.coalesce("EventData.Data", F.array().cast("array<struct<_Name: string, _VALUE: string>>"))
    named = F.filter(data, lambda x: x["_Name"].isNotNull())
    fields = F.map_from_entries(F.transform(F.array_distinct(F.transform(named, lambda x: F.lower(x["_Name"]))), lambda n: F.struct(n, F.get(F.filter(named, lambda x: F.lower(x["_Name"]) == n), F.lit(0))["_VALUE"])))

    def pick(names: list[str]) -> Column:
        return F.coalesce(*[S.clean(F.element_at("__f", n)) for n in names])

    base = raw.withColumn("__f", fields)
    out = base.select(
        F.expr("try_cast(System.EventID as int)").alias("event_code"), S.parse_time(F.col("System.TimeCreated._SystemTime")).alias("event_time"), S.clean(F.col("System.Computer")).alias("computer"),
        *[pick(names).alias(c) for c, names in ALIASES.items()], F.col("_corrupt_record").isNotNull().alias("corrupt"),
    )
    out = out.withColumn("image", S.basename(F.col("image"))).withColumn("parent_image", S.basename(F.col("parent_image")))
    return out.withColumn("event_uid", S.event_uid("computer", "event_time", "event_code", "image", "pid", "ppid", "command_line"))


def ingest(events: DataFrame) -> DataFrame:
    """Rows with a code and a time, one of each uid, with severity and command signals."""
    kept = events.filter("event_code is not null and event_time is not null").dropDuplicates(["event_uid"])
    return kept.withColumn("severity", S.severity(F.col("event_code"))).withColumn("entropy", S.entropy(F.col("command_line")))


def ingest_run(raw: DataFrame, rules: list[R.Rule] = R.RULES, sets: dict[str, list[list[str]]] | None = None) -> dict[str, DataFrame]:
    """A whole upload: its ``events`` with signals, parent chain and pattern sets, the ``behaviors`` among them, and the ``detections`` of
    rules and sets in one schema. Columns that a rule may ask for and an event log doesn't have are null."""
    e = raw if "value" in raw.columns else raw.withColumn("value", F.lit(None).cast("double"))
    e = R.with_signals(ingest(e).withColumn("t", F.unix_micros("event_time")).withColumn("event_id", F.xxhash64("event_uid")))
    e = R.pattern_sets(e.join(G.parent_chain(e), "event_uid", "left"), sets or {}, SCANNED) if sets else e.join(G.parent_chain(e), "event_uid", "left")
    shown = ["event_uid", "t", "computer", "user", "image", "detection_source", "rule_id", "confidence_score"]
    found = R.match_rules(e, rules).select(*shown, F.col("rule_severity").alias("severity"))
    if sets:
        found = found.unionByName(R.set_detections(e).select(*shown, "severity"))
    return {"events": e, "behaviors": B.behaviors(e), "detections": found}


def correlate_run(events: DataFrame) -> dict[str, DataFrame]:
    """Of a run's events: ``correlations``, a row for each event that near ones lead to, with what they come to and its campaign, and ``campaigns``."""
    e = A.with_mitre(events)
    members, sums = G.members(e), G.edge_sums(e)
    found = G.campaigns(e, sums, members)
    told = sums.join(members, "node").join(events.select(F.col("event_id").alias("node"), "event_uid", "t", "computer", "image"), "node")
    return {"correlations": told.select("event_uid", "t", "computer", "image", F.col("component").alias("campaign"), "edges", "weight", "forward", "backward"), "campaigns": found}


def earliest(rows: DataFrame, time: str, most: int = 10) -> DataFrame:
    """The first ``most`` rows by time: what a run's page shows of its correlations."""
    return rows.orderBy(time, *[c for c in ("event_uid", "component") if c in rows.columns]).limit(most)


SPOOL = "event_id string, event_time string, computer string, image string, parent_image string, command_line string, user string, pid string, ppid string, src_ip string, dst_ip string, dst_port string, file_path string, reg_key string, dns_query string, hashes string, _corrupt_record string"


def parse_spool(raw: DataFrame) -> DataFrame:
    """Canonical events of a collector's spool, one JSON object a line; broken lines have ``corrupt`` set and no code."""
    out = raw.select(
        F.expr("try_cast(event_id as int)").alias("event_code"), S.parse_time(F.col("event_time")).alias("event_time"), S.clean(F.col("computer")).alias("computer"),
        *[S.clean(F.col(c)).alias(c) for c in ALIASES], F.col("_corrupt_record").isNotNull().alias("corrupt"),
    )
    out = out.withColumn("image", S.basename(F.col("image"))).withColumn("parent_image", S.basename(F.col("parent_image")))
    return out.withColumn("event_uid", S.event_uid("computer", "event_time", "event_code", "image", "pid", "ppid", "command_line"))


def read_spool(spark: SparkSession, path: str) -> DataFrame:
    return parse_spool(spark.read.schema(SPOOL).option("mode", "PERMISSIVE").json(path))


def stream_spool(spark: SparkSession, path: str) -> DataFrame:
    """The spool as a stream; what was read is kept by the query's checkpoint, so a restart goes on where it stopped."""
    return parse_spool(spark.readStream.schema(SPOOL).option("mode", "PERMISSIVE").json(path))


#: Keys of the tables of a run, where it isn't the event's uid.
KEYS = {"detections": ("event_uid", "rule_id"), "campaigns": ("component",)}


def persist_run(parts: dict[str, DataFrame], path: str, run_id: str) -> None:
    """Append what ``ingest_run`` gives, each part to its own table; a second call adds nothing."""
    for name, rows in parts.items():
        append_run(rows, f"{path}/{name}", run_id, KEYS.get(name, ("event_uid",)))


def append_run(events: DataFrame, path: str, run_id: str, keys: tuple[str, ...] = ("event_uid",)) -> None:
    """Add a run's new rows to a table partitioned by run; those whose ``keys`` it has already are left out."""
    spark = events.sparkSession
    new = events.withColumn("run_id", F.lit(run_id))
    try:
        old = spark.read.parquet(path).filter(F.col("run_id") == run_id).select(*keys).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    else:
        new = new.join(old, list(keys), "left_anti")
    new.write.partitionBy("run_id").mode("append").parquet(path)


def load_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """One run's events: the partition filter prunes all others."""
    return spark.read.parquet(path).filter(F.col("run_id") == run_id)


def by_uids(events: DataFrame, uids: DataFrame, uid_list: str = "event_uids", by: str = "incident_id") -> DataFrame:
    """The events of each incident in the order of its uid list."""
    each = uids.select(by, F.posexplode(uid_list).alias("place", "event_uid"))
    return each.join(events, "event_uid").orderBy(by, "place")


def export_csv(df: DataFrame, path: str) -> None:
    """Arrays become comma-joined text."""
    flat = df.select(*[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").option("header", True).csv(path)


def retained(events: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return events.filter(F.col("event_time") >= as_of - F.make_interval(hours=F.lit(hours)))
