"""Hunting: predicate trees over event fields, beacons, indicators of compromise, saved hunts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import constants as K
from tidewatch.functions import signals as S

SECOND = 1_000_000
#: Field names that a hunt may use, and the columns they mean.
FIELDS = {
    "image": "image", "process": "image", "parent": "parent_image", "parent_image": "parent_image", "cmd": "command_line", "command_line": "command_line",
    "user": "user", "host": "computer", "computer": "computer", "pid": "pid", "ip": "dst_ip", "dst_ip": "dst_ip", "port": "dst_port", "file": "file_path",
    "file_path": "file_path", "registry": "reg_key", "reg_key": "reg_key", "event_id": "event_code",
}


def term(field: str, value: str) -> Column:
    """``field`` holds ``value``: case-blind literal substring; event codes compare as numbers; unknown fields never match."""
    name = FIELDS.get(field.lower())
    if name is None:
        return F.lit(False)
    if name == "event_code":
        return F.coalesce(F.col(name) == int(value), F.lit(False)) if value.isdigit() else F.lit(False)
    return F.coalesce(F.contains(F.lower(name), F.lit(value.lower())), F.lit(False))


def all_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests)


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)


def hunt(events: DataFrame, where: Column, limit: int | None = None) -> DataFrame:
    """Plain Boolean algebra over ``term``s: Catalyst pushes it to the scan. ``limit`` only where a page is wanted."""
    found = events.filter(where)
    return found.orderBy(F.desc("t"), "event_uid").limit(limit) if limit else found


def saved_hunts(events: DataFrame, hunts: dict[str, Column]) -> DataFrame:
    """Hits of every saved hunt in one scan."""
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in hunts.items()]))
    return events.select(F.explode(names).alias("hunt"), "event_uid").groupBy("hunt").agg(F.count("*").alias("hits"))


def beacons(events: DataFrame, most_cv: float = 0.3, least_hits: int = 6, least_mean: float = 5.0, known: list[str] = K.KNOWN_DOMAINS, callers: list[str] = K.BROWSERS) -> DataFrame:
    """Regular connections of an image to one address and port: interval mean, deviation, and confidence.

    A browser's calls of a known domain are left out, unless they are as regular as a machine's.
    """
    net = events.filter("event_code = 3 and dst_ip is not null")
    order = Window.partitionBy("image", "dst_ip", "dst_port").orderBy("t", "event_id")
    steps = net.withColumn("step", (F.col("t") - F.lag("t").over(order)) / SECOND)
    g = steps.groupBy("image", "dst_ip", "dst_port").agg(F.count("*").alias("hits"), F.avg("step").alias("mean"), F.stddev_pop("step").alias("std"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    cv = F.col("std") / F.col("mean")
    bonus = F.when(F.col("std") < 1.5, 10).otherwise(0) + F.when(F.col("std") < 0.5, 10).otherwise(0)
    sure = F.least(F.lit(99.0), F.greatest(F.lit(0.0), 60 + 35 * (1 - cv / 0.2) + bonus)).cast("int")
    usual = S.any_of(F.lower("dst_ip"), known) & F.lower("image").isin(callers) & (cv >= 0.10) & (F.col("std") >= 1.0)
    found = g.filter(~F.coalesce(usual, F.lit(False))).filter((F.col("hits") >= least_hits) & (F.col("mean") >= least_mean) & (cv <= most_cv))
    return found.select("image", "dst_ip", "dst_port", "hits", F.round("mean", 4).alias("mean_s"), F.round("std", 4).alias("std_s"), F.round(cv, 6).alias("cv"), sure.alias("confidence"), "first_t", "last_t")


#: Indicator types and their patterns (no look-around, so any engine can run them).
IOC_PATTERNS = {
    "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "sha256": r"\b[a-f0-9]{64}\b",
    "sha1": r"\b[a-f0-9]{40}\b",
    "md5": r"\b[a-f0-9]{32}\b",
    "url": r"https?://[^\s\"'<>]+",
}


def iocs(rows: DataFrame, text: str, key: str, kinds: dict[str, str] = IOC_PATTERNS) -> DataFrame:
    """(ioc_type, value, rows, first_key): every indicator in a text column, private addresses excluded."""
    low = F.lower(text)

    def named(kind: str, pattern: str) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all(low, F.lit(pattern), F.lit(0))), lambda v: F.struct(F.lit(kind).alias("ioc_type"), v.alias("value")))

    each = F.flatten(F.array(*[named(*x) for x in kinds.items()]))
    found = rows.select(F.col(key).alias("key"), F.explode(each).alias("x")).select("key", "x.*")
    wanted = found.filter((F.col("ioc_type") != "ip") | S.external_address(F.col("value")))
    return wanted.groupBy("ioc_type", "value").agg(F.count("*").alias("n"), F.min("key").alias("first_key")).withColumn("ioc_id", F.substring(F.sha2(F.concat_ws("|", "ioc_type", "value"), 256), 1, 16))


def ioc_lists(events: DataFrame, by: str, limit: int = 20) -> DataFrame:
    """Sorted addresses, files and keys of each ``by``, the first ``limit`` of each (a report).

    Distinct values are ranked by a window and cut before they are gathered, so no list grows with a host.
    """
    kinds = {"ips": F.when(S.external_address(F.col("dst_ip")), F.col("dst_ip")), "files": F.col("file_path"), "keys": F.col("reg_key")}
    each = events.select(by, F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in kinds.items()]))).filter("value is not null").distinct()
    first = each.withColumn("o", F.row_number().over(Window.partitionBy(by, "kind").orderBy("value"))).filter(F.col("o") <= limit)
    lists = [F.coalesce(F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("value")))), ","), F.lit("")).alias(k) for k in kinds]
    return events.select(by).distinct().join(first.groupBy(by).agg(*lists), by, "left").select(by, *[F.coalesce(k, F.lit("")).alias(k) for k in kinds])


def field_iocs(events: DataFrame, addresses: list[str], commands: list[str], hashes: list[str] = ()) -> DataFrame:
    """Typed indicators of named fields: outside addresses, hashes, and URLs and domains in commands, each with the event and field that
    showed it first. An id is made of type and value, the confidence is 70."""
    def each(kind: str, field: str, pattern: str) -> Column:
        found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(field, F.lit(""))), F.lit(pattern), F.lit(0)))
        return F.transform(found, lambda v: F.struct(F.lit(kind).alias("ioc_type"), v.alias("value"), F.lit(field).alias("field")))

    parts = [each("ip", c, "^" + IOC_PATTERNS["ip"]) for c in addresses] + [each(k, c, IOC_PATTERNS[k]) for c in hashes for k in ("sha256", "sha1", "md5")]
    parts += [each(k, c, p) for c in commands for k, p in (("url", IOC_PATTERNS["url"]), ("domain", K.DOMAIN))]
    rows = events.select("event_uid", "t", F.explode(F.flatten(F.array(*parts))).alias("x")).select("event_uid", "t", "x.*")
    wanted = rows.filter((F.col("ioc_type") != "ip") | (S.external_address(F.col("value")) & ~F.col("value").isin(K.SAFE_ADDRESSES)))
    first = F.min(F.struct("t", "event_uid", "field"))
    g = wanted.groupBy("ioc_type", "value").agg(first.alias("f"), F.count("*").alias("seen"))
    ioc = F.concat(F.lit("IOC-"), F.substring(F.sha2(F.concat_ws(":", "ioc_type", "value"), 256), 1, 12))
    return g.select("ioc_type", "value", ioc.alias("ioc_id"), F.col("f.event_uid").alias("first_uid"), F.col("f.field").alias("field"), "seen", F.lit(70).alias("confidence"))
