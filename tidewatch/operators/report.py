"""Reports: counts, roll-ups and top lists over events, detections and bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import constants as K
from tidewatch.functions import signals as S

SECOND = 1_000_000


def severity_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce(F.lower("severity"), F.lit("low")).alias("severity")).agg(F.count("*").alias("n"))


def top_codes(events: DataFrame, limit: int = 10) -> DataFrame:
    return events.groupBy("event_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_code").limit(limit)


def events_per_hour(events: DataFrame) -> DataFrame:
    return events.groupBy((F.floor(F.col("t") / (3600 * SECOND)) * 3600).alias("hour_epoch")).agg(F.count("*").alias("n"))


def with_mitre(events: DataFrame) -> DataFrame:
    """Technique, tactic, stage and description by event code: a broadcast join to 27 fixed rows."""
    table = events.sparkSession.createDataFrame(K.EVENT_CODES, "event_code int, mitre_id string, mitre_tactic string, kill_chain_stage string, code_description string")
    return events.join(F.broadcast(table), "event_code", "left")


def mitre_summary(events: DataFrame) -> DataFrame:
    return with_mitre(events).groupBy(F.coalesce("mitre_tactic", F.lit("Unknown")).alias("tactic"), F.coalesce("mitre_id", F.lit("Unmapped")).alias("technique")).agg(F.count("*").alias("n"))


def lolbin_summary(events: DataFrame, limit: int = 10) -> DataFrame:
    odd = F.when(S.suspicious_chain(F.col("parent_image")), F.col("parent_image"))
    g = events.filter(F.col("image").isin(list(K.LOLBIN_WEIGHTS))).groupBy("image").agg(F.count("*").alias("executions"), F.count_distinct("command_line").alias("commands"), F.count_distinct(odd).alias("odd_parents"))
    verdict = F.when(F.col("odd_parents") > 2, "suspicious").when(F.col("commands") > 20, "review").otherwise("normal")
    return g.withColumn("weight", S.lookup(F.col("image"), K.LOLBIN_WEIGHTS)).withColumn("verdict", verdict).orderBy(F.desc("executions"), "image").limit(limit)


def execution_context(events: DataFrame, limit: int = 10) -> DataFrame:
    """First and last seen, rate a minute, activity label and modal parent of each image on each computer."""
    parents = events.filter("parent_image is not null").groupBy("image", "computer", "parent_image").agg(F.count("*").alias("c"))
    modal = parents.groupBy("image", "computer").agg(F.max_by("parent_image", F.struct("c", "parent_image")).alias("modal_parent"))
    g = events.groupBy("image", "computer").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))
    rate = F.col("n") * 60.0 / F.greatest(F.lit(60.0), (F.col("last_t") - F.col("first_t")) / SECOND)
    out = g.withColumn("rate", F.round(rate, 6)).withColumn("activity", F.when(rate < 1, "low").when(rate < 10, "moderate").otherwise("high"))
    return out.join(modal, ["image", "computer"], "left").orderBy(F.desc("n"), "image", "computer").limit(limit)


def process_neighbours(events: DataFrame, image: str) -> DataFrame:
    """Parents and children of one image with their counts."""
    parents = events.filter((F.col("image") == image) & F.col("parent_image").isNotNull()).groupBy(F.col("parent_image").alias("other")).agg(F.count("*").alias("n")).withColumn("role", F.lit("parent"))
    children = events.filter(F.col("parent_image") == image).groupBy(F.col("image").alias("other")).agg(F.count("*").alias("n")).withColumn("role", F.lit("child"))
    return parents.unionByName(children)


def dominant_host(events: DataFrame) -> DataFrame:
    return events.groupBy("computer").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "computer").limit(1)


def class_mix(events: DataFrame) -> DataFrame:
    return events.agg(F.round(F.avg(F.when(F.col("event_code").isin(12, 13, 14), 1.0).otherwise(0.0)), 6).alias("persistence_share"), F.count("*").alias("n"))


def run_confidence(hits: DataFrame, bursts: DataFrame, correlations: DataFrame) -> DataFrame:
    """Points for the best detection (45 from 80, 25 from 50, 10), tactics, the highest stage, correlations and the highest risk.

    The highest stage is that of the bursts with a risk of 45, else of the hits, else of all bursts; it also caps the score, after
    the level is read from it.
    """
    rank = S.stage_rank(F.col("stage"))
    d = hits.agg(F.count("*").alias("detections"), F.coalesce(F.max("confidence_score"), F.lit(0)).alias("best"), F.count_distinct(F.when(F.trim("mitre_tactic") != "", F.trim("mitre_tactic"))).alias("tactics"), F.max(S.stage_rank(F.col("kill_chain_stage"))).alias("hit_rank"))
    b = bursts.agg(F.coalesce(F.max("risk"), F.lit(0)).alias("peak"), F.max(F.when(F.col("risk") >= 45, rank)).alias("risky_rank"), F.max(rank).alias("any_rank"))
    c = correlations.agg((F.count("*") > 0).alias("correlated"))
    best, tactics, stage = F.col("best"), F.col("tactics"), F.col("stage")
    x = d.join(b).join(c).withColumn("stage", F.get(F.array(*map(F.lit, K.STAGES)), F.coalesce("risky_rank", "hit_rank", "any_rank"))).drop("risky_rank", "hit_rank", "any_rank")
    points = (
        F.when(best >= 80, 45).when(best >= 50, 25).when(best > 0, 10).otherwise(0) + F.when(tactics >= 3, 25).when(tactics >= 1, 10).otherwise(0) + F.when(stage.isin("Command and Control", "Actions on Objectives"), 25).when(stage.isNotNull(), 10).otherwise(0)
        + F.when(F.col("correlated"), 15).otherwise(0) + F.least(F.lit(20), F.floor(F.col("peak") / 5))
    )
    score = F.least(F.lit(100), points).cast("int")
    x = x.withColumn("level", F.when(score >= 80, "High").when(score >= 50, "Medium").when(score > 0, "Low").otherwise("None"))
    return x.withColumn("score", F.least(score, S.lookup(stage, {"Actions on Objectives": 100, "Command and Control": 80, "Persistence": 75}, 50)).cast("int"))


def alert_level(scores: DataFrame) -> DataFrame:
    s, k = F.col("risk"), F.col("stages")
    return scores.withColumn("alert", F.when((s >= 75) & (k >= 2), "critical").when(s >= 75, "high").when((s >= 45) & (k >= 1), "medium").otherwise("low"))


def peer_baseline(events: DataFrame) -> DataFrame:
    """For each image over hosts: how many, mean and deviation of their event counts, and the five commonest parents."""
    hosts = events.groupBy("image", "computer").agg(F.count("*").alias("c"))
    stats = hosts.groupBy("image").agg(F.count("*").alias("hosts"), F.round(F.avg("c"), 6).alias("mean_rate"), F.round(F.stddev_samp("c"), 6).alias("std_rate"))
    parents = events.filter("parent_image is not null").groupBy("image", "parent_image").agg(F.count("*").alias("c"))
    place = F.row_number().over(Window.partitionBy("image").orderBy(F.desc("c"), "parent_image"))
    top = parents.withColumn("k", place).filter("k <= 5").groupBy("image").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "parent_image"))), lambda x: x["parent_image"]), ",").alias("top_parents"))
    return stats.join(top, "image", "left")


def rare_processes(events: DataFrame, split_t: int, most: int = 3) -> DataFrame:
    """Parent-child pairs after ``split_t`` that were seen at most ``most`` times before."""
    pairs = events.filter("parent_image is not null").groupBy("computer", "parent_image", "image").agg(F.count_if(F.col("t") < split_t).alias("before"), F.count_if(F.col("t") >= split_t).alias("after"))
    return pairs.filter((F.col("after") > 0) & (F.col("before") <= most))


def new_addresses(events: DataFrame, split_t: int) -> DataFrame:
    """Addresses that a computer meets after ``split_t`` for the first time."""
    net = events.filter("dst_ip is not null")
    old = net.filter(F.col("t") < split_t).select("computer", "dst_ip").distinct()
    return net.filter(F.col("t") >= split_t).join(old, ["computer", "dst_ip"], "left_anti").groupBy("computer", "dst_ip").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


def recent_interesting(events: DataFrame, words: list[str], limit: int = 100) -> DataFrame:
    return events.filter(S.any_of(F.lower("image"), words)).orderBy(F.desc("t"), "event_uid").limit(limit)


def raw_page(events: DataFrame, page: int, size: int = 50) -> DataFrame:
    return events.orderBy(F.desc("t"), "event_uid").offset(page * size).limit(size)


def duration_label(microseconds: Column) -> Column:
    """Hours and minutes, hours only where there are any."""
    minutes = F.floor(microseconds / 60_000_000)
    text = F.concat((minutes % 60).cast("string"), F.lit("m"))
    return F.when(minutes >= 60, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), text)).otherwise(text)


def activity(events: DataFrame) -> DataFrame:
    """Each image and computer: extent with its label, events a minute (over a minute at least) in words, and the most frequent parent
    (of equal ones the least name)."""
    counts = events.groupBy("image", "computer", "parent_image").agg(F.count("*").alias("c"), F.min("t").alias("a"), F.max("t").alias("b"))
    parent = F.min_by("parent_image", F.when(F.col("parent_image").isNotNull(), F.struct(-F.col("c"), "parent_image")))
    g = counts.groupBy("image", "computer").agg(F.min("a").alias("first_t"), F.max("b").alias("last_t"), F.sum("c").alias("n"), parent.alias("parent"))
    span = F.col("last_t") - F.col("first_t")
    rate = F.col("n") * 60_000_000 / F.greatest(span, F.lit(60_000_000))
    words = F.when(rate < 1, "low").when(rate < 10, "bursting").otherwise("heavy")
    return g.withColumn("duration", duration_label(span)).withColumn("rate", F.round(rate, 6)).withColumn("state", words)


def stage_summary(b: DataFrame, hits: DataFrame) -> DataFrame:
    """Numbers of bursts by stage; where there is no burst at all, of detections."""
    some = b.agg((F.count("*") > 0).alias("some"))
    told = hits.groupBy(F.col("kill_chain_stage").alias("stage")).agg(F.count("*").alias("n")).join(F.broadcast(some)).filter(~F.col("some")).select("stage", "n", F.lit("detections").alias("basis"))
    return b.groupBy("stage").agg(F.count("*").alias("n")).withColumn("basis", F.lit("bursts")).unionByName(told)


def correlated_alert(scores: DataFrame) -> DataFrame:
    """Alert level of (score, stages, correlation): critical needs two stages or a correlation beside a score of 75."""
    s = F.col("score")
    level = F.when((s >= 75) & ((F.col("stages") >= 2) | (F.col("correlation") > 0)), "critical").when(s >= 75, "high").when((s >= 45) & (F.col("stages") >= 1), "medium").otherwise("low")
    return scores.withColumn("alert", level).withColumn("alertable", level != "low")
