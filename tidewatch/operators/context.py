"""Joins that put events, bursts, detections and incidents into each other's context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import signals as S
from tidewatch.operators.graph import stored, with_edge
from tidewatch.operators.slabs import last_before

SECOND = 1_000_000


def as_of(left: DataFrame, right: DataFrame, by: list[str], value: str, name: str, strict: bool = True) -> DataFrame:
    """Each left row with ``value`` of the latest right row before it, of the same key.

    One union and a scan by time slabs in place of a range join: the work doesn't depend on the number of earlier rows, and a busy
    key is spread over its time.
    """
    marked = left.withColumn("__side", F.lit(1 if strict else 2)).withColumn("__v", F.lit(None).cast(dict(right.dtypes)[value]))
    given = right.select(*by, "t", F.col(value).alias("__v")).withColumn("__side", F.lit(2 if strict else 1))
    both = last_before(marked.unionByName(given, allowMissingColumns=True), by, ["t", "__side"], F.col("__v"), name)
    return both.filter(F.col("__side") == (1 if strict else 2)).drop("__side", "__v")


def with_grandparent(events: DataFrame) -> DataFrame:
    """Adds ``grandparent``: the image of the parent's parent, by (computer, ppid) to (computer, pid); of both the latest event of
    that process before the row's own."""
    seen = events.filter("computer is not null and pid is not null").groupBy("computer", F.col("pid").alias("__pid"), "t").agg(F.max_by(F.struct("image", "ppid"), "event_id").alias("__p"))
    x = as_of(events.withColumn("__pid", F.col("ppid")), seen, ["computer", "__pid"], "__p", "__parent").withColumn("__pid", F.col("__parent.ppid"))
    return as_of(x, seen, ["computer", "__pid"], "__p", "__grand").withColumn("grandparent", F.col("__grand.image")).drop("__pid", "__parent", "__grand")


def prior_correlation(bursts: DataFrame, links: DataFrame, seconds: int = 900) -> DataFrame:
    """Each burst with the strongest link of its computer that began within the slack of it: an interval left join by buckets."""
    width = seconds * SECOND
    ls = links.select(F.col("computer").alias("l_computer"), F.col("t").alias("l_t"), F.col("weight").alias("l_weight"), F.explode(F.array(*[F.floor(F.col("t") / width) + k for k in (-1, 0, 1)])).alias("l_bucket"))
    b = bursts.withColumn("bucket", F.floor(F.col("start_t") / width))
    found = b.join(ls, (F.col("computer") == F.col("l_computer")) & (F.col("bucket") == F.col("l_bucket")) & (F.abs(F.col("l_t") - F.col("start_t")) <= width), "left")
    return found.groupBy("burst_id").agg(F.max("l_weight").alias("link_weight"), F.count("l_t").alias("links"))


def first_correlation(bursts: DataFrame, links: DataFrame, seconds: int = 900) -> DataFrame:
    """Each burst with the first link of its computer and image that ends within the slack of its start; null where there is none."""
    width, keys = seconds * SECOND, ["computer", "image", "bucket"]
    near = links.select("computer", "image", F.col("t").alias("l_t"), "weight", F.explode(F.array(*[F.floor(F.col("t") / width) + k for k in (-1, 0, 1)])).alias("bucket"))
    found = bursts.withColumn("bucket", F.floor(F.col("start_t") / width)).join(near, keys).filter(F.abs(F.col("l_t") - F.col("start_t")) <= width)
    first = found.groupBy("burst_id").agg(F.min(F.struct("l_t", F.col("weight").alias("link_weight"))).alias("f"))
    return bursts.select("burst_id").join(first, "burst_id", "left").select("burst_id", F.col("f.l_t").alias("link_t"), "f.link_weight")


def detected_stage(bursts: DataFrame, hits: DataFrame) -> DataFrame:
    """Burst stages promoted by the highest stage detected for their image."""
    top = hits.groupBy("image").agg(F.max_by("kill_chain_stage", S.stage_rank(F.col("kill_chain_stage"))).alias("detected"))
    return bursts.join(top, "image", "left").withColumn("final_stage", F.when(F.col("detected").isNull(), F.col("stage")).otherwise(S.promote(F.col("stage"), F.col("detected"))))


def alternate_primary(hits: DataFrame, by: list[str]) -> DataFrame:
    """The best hit of a group by source (sequence, rule, anomaly) and then confidence."""
    rank = S.lookup(F.col("detection_source"), {"sequence": 3, "rule": 2, "anomaly": 1}, 0)
    return hits.groupBy(*by).agg(F.max_by(F.struct("rule_id", "event_uid", "confidence_score"), F.struct(rank, "confidence_score", "event_uid")).alias("p")).select(*by, "p.*")


def burst_detail(bursts: DataFrame, events: DataFrame, most: int = 50) -> DataFrame:
    """Events inside each burst, the images its image started on its computer (the first ``most`` by name, a display list), and an indicator risk (60
    critical code, 20 medium, 15 or 5 by number, 10 external)."""
    # bursts of an entity don't overlap, so an event can only be inside the last one that began before it
    starts = bursts.select("computer", "image", F.col("start_t").alias("t"), F.lit(0).alias("kind"), F.struct("burst_id", "end_t").alias("b"))
    rows = events.select("computer", "image", "t", F.lit(1).alias("kind"), "event_code", "dst_ip")
    both = last_before(starts.unionByName(rows, allowMissingColumns=True), ["computer", "image"], ["t", "kind"], F.col("b"), "last")
    inside = both.filter("kind = 1 and t <= last.end_t").select("last.burst_id", "event_code", "dst_ip")
    g = inside.groupBy("burst_id").agg(F.count("*").alias("events"), F.max(F.col("event_code").isin(8, 9, 25)).alias("critical"), F.max(F.col("event_code").isin(3, 7, 10, 11, 22, 23)).alias("medium"), F.max(S.external_address(F.col("dst_ip"))).alias("external"))
    points = F.when(F.col("critical"), 60).otherwise(0) + F.when(F.col("medium"), 20).otherwise(0) + F.when(F.col("events") > 50, 15).when(F.col("events") > 10, 5).otherwise(0) + F.when(F.col("external"), 10).otherwise(0)
    started = events.select("computer", F.col("parent_image").alias("image"), F.col("image").alias("child")).dropna().distinct()
    started = started.withColumn("k", F.row_number().over(Window.partitionBy("computer", "image").orderBy("child"))).filter(F.col("k") <= most)
    names = started.groupBy("computer", "image").agg(F.array_join(F.array_sort(F.collect_list("child")), ",").alias("children"))
    owned = bursts.select("burst_id", "computer", "image").join(names, ["computer", "image"], "left").select("burst_id", F.coalesce("children", F.lit("")).alias("children"))
    return g.withColumn("indicator_risk", F.least(F.lit(100), points)).join(owned, "burst_id")


def actions(incidents: DataFrame, asked: DataFrame, most: int = 20) -> DataFrame:
    """The last action on each incident: new status, analyst kept where none is given, and the newest ``most`` notes in order of time (a display
    list; all of them are the rows of ``asked``)."""
    newest = F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("t"), F.desc("note")))
    asked = asked.withColumn("note", F.when(newest <= most, F.col("note")))
    g = asked.groupBy("incident_id").agg(F.max_by("action", "t").alias("action"), F.max_by("analyst", F.when(F.col("analyst").isNotNull(), F.col("t"))).alias("new_analyst"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("t", "note")))), lambda x: x["note"]), "\n").alias("notes"))
    status = S.lookup(F.col("action"), {"false_positive": "Closed - False Positive", "escalate": "Escalated", "close_benign": "Closed - Benign"})
    return incidents.join(g, "incident_id", "left").withColumn("status", F.coalesce(status, F.col("status"))).withColumn("analyst", F.coalesce("new_analyst", "analyst")).drop("new_analyst")


def campaign_upsert(old: DataFrame, new: DataFrame, key: str, how: str = "full") -> DataFrame:
    """Two snapshots of campaigns: bursts added, the greater confidence, the later stage, the wider time. Campaigns of one snapshot stay as they
    are; with ``how`` "inner" only those of both are given."""
    o, n = [f.select(key, *[F.col(c).alias(f"{p}_{c}") for c in ("bursts", "confidence", "stage", "first_t", "last_t")]) for p, f in (("o", old), ("n", new))]
    x = o.join(n, key, how)
    stage = F.when(F.col("o_stage").isNull(), F.col("n_stage")).when(F.col("n_stage").isNull(), F.col("o_stage")).otherwise(S.promote(F.col("o_stage"), F.col("n_stage")))
    return x.select(key, (F.coalesce("o_bursts", F.lit(0)) + F.coalesce("n_bursts", F.lit(0))).alias("bursts"), F.greatest("o_confidence", "n_confidence").alias("confidence"), stage.alias("stage"), F.least("o_first_t", "n_first_t").alias("first_t"), F.greatest("o_last_t", "n_last_t").alias("last_t"))


def _soon_after(events: DataFrame, rows: DataFrame, seconds: int) -> DataFrame:
    """Events whose time may be up to ``seconds`` after that of one of ``rows`` on the same computer: those of its bucket and the next."""
    bucket = F.floor(F.col("t") / (seconds * SECOND))
    near = rows.select("computer", F.explode(F.array(bucket, bucket + 1)).alias("bucket")).distinct()
    return events.withColumn("bucket", bucket).join(near, ["computer", "bucket"], "left_semi").drop("bucket")


def first_with_edge(events: DataFrame, tried: int = 256, seconds: int = 900) -> DataFrame:
    """(computer, node): the least event of each computer that has one of ``graph.edges`` to a later event. The least ``tried`` events of each
    computer are looked at first, and all events of the computers where none of these has an edge."""
    place = F.row_number().over(Window.partitionBy("computer").orderBy("event_id"))
    few = stored(events.withColumn("k", place).filter(F.col("k") <= tried).drop("k"))
    found = stored(with_edge(few, _soon_after(events, few, seconds), False, seconds))
    rest = events.join(found, "computer", "left_anti")
    return found.unionByName(with_edge(rest, rest, False, seconds)).groupBy("computer").agg(F.min("node").alias("node"))


def reachable(events: DataFrame, depth: int, most: int = 20, sure: DataFrame | None = None, far: int = 5, seconds: int = 900) -> DataFrame:
    """Nodes within ``depth`` steps along ``graph.edges`` of each computer's first edge, the nearest ``most`` of each (a display list); within ``far``
    steps on the computers of ``sure``. Edges aren't listed: a step takes the events soon after the last step's nodes and finds by
    windows which of them have an edge from one (``graph.with_edge``). Computers that have ``most`` nodes take no further step,
    as its nodes would come after these. The events and each round are stored tables, so no round computes those before it again."""
    events = stored(events.filter("computer is not null").select("event_id", "t", "computer", "user", "image", "parent_image", "kill_chain_stage"))
    front = seen = stored(first_with_edge(events, seconds=seconds).withColumn("depth", F.lit(0)))
    for d in range(1, (far if sure is not None else depth) + 1):
        if d == depth + 1:
            front = front.join(sure.select("computer"), "computer", "left_semi")
        full = seen.groupBy("computer").agg(F.count("*").alias("n")).filter(F.col("n") >= most)
        front = front.join(full, "computer", "left_anti").withColumnRenamed("node", "event_id")
        rows = stored(events.join(front, ["computer", "event_id"], "left_semi"))
        if rows.isEmpty():
            break
        front = with_edge(_soon_after(events, rows, seconds), rows, True, seconds).join(seen.select("computer", "node"), ["computer", "node"], "left_anti")
        front = stored(front.withColumn("depth", F.lit(d)))
        seen = seen.unionByName(front)
    place = F.row_number().over(Window.partitionBy("computer").orderBy("depth", "node"))
    return seen.withColumn("k", place).filter(F.col("k") <= most).drop("k")


def empty_suspicion(detections: DataFrame, sequences: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Whether there are over five detections and a sequence but no campaign."""
    d, s, c = (f.agg(F.count("*").alias(n)) for f, n in ((detections, "detections"), (sequences, "sequences"), (campaigns, "campaigns")))
    return d.join(s).join(c).withColumn("suspicious", (F.col("detections") > 5) & (F.col("sequences") > 0) & (F.col("campaigns") == 0))
