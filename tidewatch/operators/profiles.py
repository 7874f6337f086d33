"""Anomaly scores against the whole profile of an entity, the learning gate, and baselines by the hour.

Habits stay in long form (entity, kind, key, count): one table for all kinds, which the events' keys meet in one join; beside it
there is one row of statistics and totals an entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import constants as K
from tidewatch.functions import signals as S
from tidewatch.operators.baseline import ENTITY
from tidewatch.operators.context import with_grandparent

HOUR, DAY = 3_600_000_000, 86_400_000_000


def with_keys(events: DataFrame) -> DataFrame:
    """Hour, subnet, transition keys and entropy of each event; the grandparent comes from the process ids."""
    parent = F.coalesce("parent_image", F.lit("unknown"))
    return with_grandparent(events).withColumns({
        "hour": F.pmod(F.floor(F.col("t") / HOUR), F.lit(24)), "subnet": F.substring_index("dst_ip", ".", 3), "two": F.concat_ws(">", parent, "image"),
        "three": F.when(F.col("grandparent").isNotNull(), F.concat_ws(">", "grandparent", parent, "image")), "entropy": S.entropy(F.col("command_line")),
    })


def _z(value: str, n: str, mean: str, m2: str) -> Column:
    """Absolute distance from the mean in sample deviations of 0.1 at least."""
    return F.abs((F.col(value) - F.col(mean)) / F.greatest(F.lit(0.1), F.sqrt(F.col(m2) / F.greatest(F.col(n) - 1, F.lit(1)))))


def entropy_part(z: Column) -> Column:
    """0.4 entropy (half a z-score), 0.3 encoded flag, 0.15 length, 0.15 share of special characters."""
    cmd = F.col("command_line")
    length = F.length(cmd)
    special = F.lit(3.0) * (length - F.length(F.regexp_replace(cmd, K.SPECIAL_CHARACTERS, ""))) / F.greatest(length, F.lit(1))
    return 0.40 * z + 0.30 * F.when(S.encoded_flag(cmd), 0.8).otherwise(0.0) + 0.15 * F.when(length > 500, 0.6).when(length > 200, 0.3).otherwise(0.0) + 0.15 * F.least(special, F.lit(1.0))


#: Kind of habit: the column with its key.
HABITS = {"p": "parent_image", "h": "hour", "i": "dst_ip", "u": "subnet", "b": "two", "r": "three"}


def habits(events: DataFrame, by: list[str], more: list[str] = ()) -> DataFrame:
    """(entity, kind, key): a row for each key of each event that has it."""
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("key")) for kind, c in HABITS.items()])
    return events.select(*by, *more, F.inline(pairs)).filter("key is not null")


def profile_rows(history: DataFrame, by: list[str] = ENTITY) -> tuple[DataFrame, DataFrame]:
    """(entity: n, mean and m2 of value and entropy, a total for each kind) and (entity, kind, key, count)."""
    counts = habits(history, by).groupBy(*by, "kind", "key").agg(F.count("*").alias("count"))
    totals = counts.groupBy(*by).agg(*[F.sum(F.when(F.col("kind") == k, F.col("count")).otherwise(0)).alias(f"{k}_total") for k in HABITS])
    triple = lambda c, p: [F.count(c).alias(f"{p}n"), F.avg(c).alias(f"{p}mean"), (F.var_pop(c) * F.count(c)).alias(f"{p}m2")]
    return history.groupBy(*by).agg(*triple("value", ""), *triple("entropy", "e_")).join(totals, by, "left"), counts


def anomaly_scores(events: DataFrame, history: DataFrame, by: list[str] = ENTITY) -> DataFrame:
    """The six parts, deviation, behavior and the names of what stands out. Both inputs come from ``with_keys``; ``event_uid`` is unique.

    Weights: frequency 0.25, parent 0.15, sequence 0.15, entropy 0.20, time 0.10, network 0.15, and 0.20 for slow attacks:
    at least two strong signals at a value of 5 at most. Young profiles are damped, unknown entities score 0.25. Sums are made
    of whole values; limits apply to the values as printed, with six digits.
    """
    entities, counts = profile_rows(history, by)
    seen = habits(events, by, ["event_uid"]).join(counts, [*by, "kind", "key"])
    seen = seen.groupBy("event_uid").agg(*[F.max(F.when(F.col("kind") == k, F.col("count"))).alias(f"{k}_count") for k in HABITS])
    x = events.join(entities, by, "left").join(seen, "event_uid", "left")
    total = lambda name: F.coalesce(f"{name}_total", F.lit(0))
    rare = lambda name: 1 - F.coalesce(F.col(f"{name}_count") / F.col(f"{name}_total"), F.lit(0.0))
    n, one = F.coalesce("n", F.lit(0)), F.lit(1.0)
    parts = {
        "f": F.when(n == 0, 0.25).when(n < 10, 0.3).otherwise(F.least(one, F.greatest(F.lit(0.2), _z("value", "n", "mean", "m2") / 3))),
        "p": F.when(total("p") < 5, 0.10).otherwise(rare("p") * F.when(F.col("parent_image").isin(K.BENIGN_PARENTS), 0.5).otherwise(1.0)),
        "s": F.least(one, F.greatest(F.when(total("b") >= 10, rare("b")).otherwise(0.10), F.when(F.col("three").isNotNull() & (total("r") >= 10), 1.3 * rare("r")).otherwise(0.0))),
        "e": F.least(one, entropy_part(F.when(F.coalesce("e_n", F.lit(0)) >= 5, F.least(one, _z("entropy", "e_n", "e_mean", "e_m2") / 2)).otherwise(0.10))),
        "h": F.when(total("h") < 10, 0.05).otherwise(rare("h")),
        "i": F.when(F.col("dst_ip").isNull(), 0.05).otherwise(F.greatest(F.when(total("i") >= 5, rare("i")).otherwise(0.15), F.when(total("u") >= 5, 0.7 * rare("u")).otherwise(0.10))),
    }
    x = x.withColumns({f"__{k}": v for k, v in parts.items()})
    shown = lambda k: S.rounded(F.col(f"__{k}"))
    strong = sum(((c).cast("int") for c in (shown("e") > 0.6, shown("s") > 0.7, shown("i") > 0.7, F.col("event_code").isin(12, 13, 14), F.col("event_code") == 8)), F.lit(0))
    x = x.withColumn("slow", (strong >= 2) & (F.col("value") <= 5)).withColumn("__f", F.when(F.col("slow"), F.greatest("__f", F.lit(0.4))).otherwise(F.col("__f")))
    part = {k: F.col(f"__{k}") for k in parts}
    raw = 0.25 * part["f"] + 0.15 * part["p"] + 0.15 * part["s"] + 0.20 * part["e"] + 0.10 * part["h"] + 0.15 * part["i"] + F.when(F.col("slow"), 0.20).otherwise(0.0)
    deviation = F.when(n == 0, 0.25).otherwise(F.least(one, F.when(n < 15, F.greatest(F.lit(0.2), 0.75 * raw)).otherwise(raw)))
    six = F.array(*part.values())
    top, mean = F.array_max(six), F.aggregate(six, F.lit(0.0), lambda a, b: a + b) / 6
    x = x.withColumn("__d", deviation).withColumn("behavior", S.rounded(F.greatest(0.7 * top + 0.3 * mean, 0.85 * top, 0.8 * F.col("__d"))))
    limits = {"f": (0.6, "frequency"), "p": (0.6, "parent"), "s": (0.7, "transition"), "e": (0.6, "entropy"), "h": (0.7, "hour"), "i": (0.7, "destination")}
    told = F.array_compact(F.array(*[F.when(shown(k) > most, F.lit(name)) for k, (most, name) in limits.items()], F.when(F.col("slow"), F.lit("slow"))))
    return x.select("event_uid", *by, F.coalesce("n", F.lit(0)).alias("observed"), *[shown(k).alias(k) for k in parts], "slow", S.rounded(F.col("__d")).alias("deviation"), "behavior", F.array_join(told, ",").alias("anomalies"))


def learning_gate(scored: DataFrame, never: list[str] = K.NEVER_LEARN) -> DataFrame:
    """Add ``learn``: whether an event is quiet enough to shape the profile. ``scored``: events with their anomaly scores and a
    risk and stage. Young clean profiles are let in early; flags, entropy above 4, or a later stage keep an event out."""
    clean = (F.col("risk") <= 40) & ~F.lower("image").isin(never)
    early = (F.col("observed") < 15) & (F.col("deviation") < 0.15) & (F.col("behavior") < 0.3)
    quiet = (F.col("deviation") < 0.2) & (F.col("behavior") < 0.4) & ~F.col("event_code").isin(8, 12, 13, 14) & (F.col("entropy") <= 4.0) & ~S.encoded_flag(F.col("command_line")) & (F.col("s") <= 0.7)
    quiet = quiet & ~F.coalesce(S.external_address(F.col("dst_ip")), F.lit(False)) & F.col("stage").isin("Execution", "Background")
    return scored.withColumn("learn", F.coalesce(clean & (early | quiet), F.lit(False)))


def throttled(scored: DataFrame, most: int = 50, per: str = "computer") -> DataFrame:
    """Of the events let through the gate, the ``most`` least deviating of each host: what one batch may teach."""
    order = Window.partitionBy(per).orderBy("deviation", "event_uid")
    return scored.filter("learn").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def daily_features(events: DataFrame) -> DataFrame:
    """What an entity under one parent does in one hour of one day."""
    code = F.col("event_code")
    outside = F.coalesce(S.external_address(F.col("dst_ip")), F.lit(False))
    return events.groupBy("computer", "image", F.coalesce("parent_image", F.lit("")).alias("parent"), F.pmod(F.floor(F.col("t") / HOUR), F.lit(24)).alias("hour"), F.floor(F.col("t") / DAY).alias("day")).agg(
        F.count("*").alias("exec_count"), F.avg(F.length("command_line")).alias("command_length"), F.count_if(code.isin(3, 11, 13)).alias("followups"),
        F.max(F.when(outside, 2).when(F.col("dst_ip").isNotNull(), 1).otherwise(0)).alias("network_strength"),
    )


def hourly_profile(features: DataFrame, keys: list[str]) -> DataFrame:
    """Days seen, mean and m2 of the executions, mean command length and follow-ups."""
    return features.groupBy(*keys).agg(
        F.count("*").alias("days"), F.avg("exec_count").alias("mean"), (F.var_pop("exec_count") * F.count("*")).alias("m2"), F.avg("command_length").alias("length"), F.avg("followups").alias("follow"))


def _measured(features: DataFrame, history: DataFrame) -> tuple[DataFrame, Column]:
    """Feature rows with ``b``, the profile of their hour (that of the parent, else of any), and how far they are from it: 0.30 frequency, 0.25
    command length, 0.20 follow-ups and 0.15 network."""
    exact, wide = ["computer", "image", "parent", "hour"], ["computer", "image", "hour"]
    profile = lambda keys, name: hourly_profile(history, keys).select(*keys, F.struct("days", "mean", "m2", "length", "follow").alias(name))
    x = features.join(profile(exact, "own"), exact, "left").join(profile(wide, "any"), wide, "left").withColumn("b", F.coalesce("own", "any"))
    x = x.withColumn("basis", F.when(F.col("own").isNotNull(), "parent").when(F.col("any").isNotNull(), "any parent").otherwise("none")).drop("own", "any")
    days, length = F.col("b.days"), F.greatest(F.col("b.length"), F.lit(1.0))
    std = F.greatest(F.lit(1.0), F.sqrt(F.when(days > 1, F.col("b.m2") / (days - 1)).otherwise(0.0)))
    capped = lambda c: F.least(F.lit(3.0), F.abs(c))
    raw = 0.30 * capped((F.col("exec_count") - F.col("b.mean")) / std) + 0.25 * capped((F.col("command_length") - length) / length)
    return x, raw + 0.20 * F.when(F.col("followups") >= F.col("b.follow") + 2, 1.0).otherwise(0.0) + 0.15 * F.when(F.col("network_strength") == 2, 1.0).when(F.col("network_strength") == 1, 0.5).otherwise(0.0)


def hourly_deviation(features: DataFrame, history: DataFrame, mature: int = 20, noise_factor: float = 1.0) -> DataFrame:
    """Deviation of each feature row from its hour's profile: that of its parent, else that of any parent.

    Unknown 0.40, under five days 0.25, below the usual number 0.1 (times ``noise_factor``); else the measured distance divided by three; at most 0.4
    before ``mature`` days.
    """
    x, raw = _measured(features, history)
    days, known = F.col("b.days"), F.least(F.lit(1.0), raw / 3)
    score = F.when(F.col("b").isNull(), 0.40).when(days < 5, 0.25).when(F.col("exec_count") < F.greatest(F.lit(5.0), F.col("b.mean")), 0.1 * noise_factor).when(days < mature, F.least(F.lit(0.4), known)).otherwise(known)
    return x.withColumn("deviation", F.round(score, 6)).drop("b")


def hunted_deviation(features: DataFrame, history: DataFrame, mature: int = 30, noise: float = 0.5) -> DataFrame:
    """The hunter's form: below the usual number the distance is raised by ``noise`` (at most half) in place of a fixed value."""
    x, raw = _measured(features, history)
    days, below = F.col("b.days"), F.col("exec_count") < F.greatest(F.lit(5.0), F.col("b.mean"))
    known = raw * F.when(below, 1 + min(noise, 0.5)).otherwise(1.0) / 3
    score = F.when(F.col("b").isNull(), 0.40).when(days < 5, 0.25).when(days < mature, F.least(F.lit(0.4), known)).otherwise(F.least(F.lit(1.0), known))
    return x.withColumn("deviation", S.rounded(score)).drop("b")


def pruned(profiles: DataFrame, most: int = 5000, least: int = 3, at_once: int = 2000) -> DataFrame:
    """A store of over ``most`` profiles without its thinnest: those under ``least`` observations, ``at_once`` of them."""
    if profiles.count() <= most:
        return profiles
    thin = profiles.filter(F.col("n") < least).orderBy("n", *ENTITY).limit(at_once).select(*ENTITY)
    return profiles.join(thin, ENTITY, "left_anti")


def forced_samples(verdicts: DataFrame, times: int = 5) -> DataFrame:
    """Clean samples that a verdict of False Positive or Benign adds to the learning input: ``times`` of each."""
    calm = verdicts.filter(F.col("verdict").isin("False Positive", "Benign"))
    return calm.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(times))))
