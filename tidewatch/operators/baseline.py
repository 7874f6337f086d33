"""Learned baselines of entities, and how far new events deviate from them.

A profile is kept in long form (entity, key, count), never as one growing map, so an entity with very many parents or
addresses is only more rows. Statistics are (n, mean, m2) triples, which merge by Chan's formula.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import constants as K

ENTITY = ["computer", "image"]


def statistics(events: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """n, mean and m2 (sum of squared deviations) of a value for each entity."""
    return events.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def merge_statistics(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Two snapshots of statistics as one (Chan et al.): a full outer join on the entity."""
    o, w = old.select(*by, F.struct("n", "mean", "m2").alias("o")), new.select(*by, F.struct("n", "mean", "m2").alias("w"))
    na, nb = F.coalesce("o.n", F.lit(0)), F.coalesce("w.n", F.lit(0))
    ma, mb = F.coalesce("o.mean", F.lit(0.0)), F.coalesce("w.mean", F.lit(0.0))
    total, delta = na + nb, mb - ma
    return o.join(w, by, "full").select(
        *by, total.alias("n"), (ma + delta * nb / total).alias("mean"),
        (F.coalesce("o.m2", F.lit(0.0)) + F.coalesce("w.m2", F.lit(0.0)) + delta * delta * na * nb / total).alias("m2"),
    )


def decayed(profile: DataFrame, days: Column, half: float = 7.0) -> DataFrame:
    """Counts and m2 fade by exp(-days / 7); a profile never falls below one observation."""
    factor = F.exp(-days / half)
    return profile.withColumn("n", F.greatest(F.lit(1), F.floor(F.col("n") * factor))).withColumn("m2", F.col("m2") * factor)


def shares(events: DataFrame, by: list[str], key: str, name: str) -> DataFrame:
    """(entity, key, count, share, total): what part of the entity's events has this key."""
    counts = events.filter(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count("*").alias(f"{name}_n"))
    totals = counts.groupBy(*by).agg(F.sum(f"{name}_n").alias(f"{name}_total"))
    return counts.join(totals, by).withColumn(f"{name}_share", F.col(f"{name}_n") / F.col(f"{name}_total"))


def deviation_scores(events: DataFrame, history: DataFrame, by: list[str] = ENTITY) -> DataFrame:
    """Frequency, parent, time and network anomalies of each event against the history of its entity.

    f: |z| / 3 within 0.2..1 (0.25 without history, 0.3 under ten observations); p, h, i: one less the share of the
    parent, hour and address (defaults under five or ten observations). Young profiles are damped.
    """
    hour = F.pmod(F.floor(F.col("t") / 3_600_000_000), F.lit(24))
    old, now = history.withColumn("hour", hour), events.withColumn("hour", hour)
    x = now.join(statistics(old, by), by, "left")
    for key, name in (("parent_image", "p"), ("hour", "h"), ("dst_ip", "i")):
        s = shares(old, by, key, name)
        x = x.join(s.select(*by, key, f"{name}_share"), [*by, key], "left").join(s.select(*by, f"{name}_total").distinct(), by, "left")
    n = F.coalesce("n", F.lit(0))
    std = F.greatest(F.lit(0.1), F.sqrt(F.col("m2") / F.greatest(n - 1, F.lit(1))))
    f = F.when(n == 0, 0.25).when(n < 10, 0.3).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.2), F.abs((F.col("value") - F.col("mean")) / std) / 3)))
    share = lambda name: 1 - F.coalesce(f"{name}_share", F.lit(0.0))
    total = lambda name: F.coalesce(f"{name}_total", F.lit(0))
    p = F.when(total("p") < 5, 0.10).otherwise(share("p") * F.when(F.col("parent_image").isin(K.BENIGN_PARENTS), 0.5).otherwise(1.0))
    h = F.when(total("h") < 10, 0.05).otherwise(share("h"))
    i = F.when(F.col("dst_ip").isNull(), 0.05).when(total("i") < 5, 0.15).otherwise(share("i"))
    raw = 0.40 * f + 0.25 * p + 0.15 * h + 0.20 * i
    score = F.least(F.lit(1.0), F.when(n < 15, F.greatest(F.lit(0.2), 0.75 * raw)).otherwise(raw))
    return x.select("event_uid", *by, *[F.round(c, 6).alias(a) for c, a in ((f, "f"), (p, "p"), (h, "h"), (i, "i"), (score, "deviation"))])


def should_learn(scores: DataFrame, most_deviation: float = 0.2) -> DataFrame:
    """Events quiet enough to learn from."""
    return scores.filter(F.col("deviation") < most_deviation)


def hourly_baseline(events: DataFrame) -> DataFrame:
    """(computer, image, hour): mean and deviation of the daily number of events, and the days seen."""
    day = F.floor(F.col("t") / 86_400_000_000)
    hour = F.pmod(F.floor(F.col("t") / 3_600_000_000), F.lit(24))
    daily = events.groupBy("computer", "image", hour.alias("hour"), day.alias("day")).agg(F.count("*").alias("c"), F.avg(F.length("command_line")).alias("len"))
    return daily.groupBy("computer", "image", "hour").agg(F.count("*").alias("days"), F.round(F.avg("c"), 6).alias("mean"), F.round(F.var_samp("c"), 6).alias("var"), F.round(F.avg("len"), 6).alias("cmd_length"))


def entity_profile(events: DataFrame) -> DataFrame:
    """One row for each entity: statistics and the size of its habits."""
    return events.groupBy(*ENTITY).agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_samp("value"), 4).alias("var"),
        F.count_distinct("parent_image").alias("parents"), F.count_distinct("dst_ip").alias("addresses"), F.count_distinct(F.substring_index("dst_ip", ".", 3)).alias("subnets"),
    )


def ngrams(events: DataFrame) -> DataFrame:
    """Parent > image pairs and grandparent > parent > image triples of each computer, with counts."""
    from tidewatch.operators.context import with_grandparent

    x = with_grandparent(events)
    two = x.filter("parent_image is not null").select("computer", F.concat_ws(">", "parent_image", "image").alias("gram"), F.lit(2).alias("size"))
    three = x.filter("grandparent is not null").select("computer", F.concat_ws(">", "grandparent", "parent_image", "image").alias("gram"), F.lit(3).alias("size"))
    return two.unionByName(three).groupBy("computer", "size", "gram").agg(F.count("*").alias("n"))
