"""Risk scores of bursts and runs, their drivers, the decision they lead to, and feedback on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import constants as K
from tidewatch.functions import signals as S


def rule_points(hits: DataFrame, by: list[str]) -> DataFrame:
    """Half of each hit's confidence, weighed by severity, summed over a group."""
    weight = S.lookup(F.col("rule_severity"), {"critical": 1.8, "high": 1.5, "medium": 1.0, "low": 0.6}, 0.6)
    return hits.groupBy(*by).agg(F.sum(F.col("confidence_score") / 2 * weight).alias("rule_points"), F.max(S.stage_rank(F.col("kill_chain_stage"))).alias("stage_rank"), F.count_distinct("kill_chain_stage").alias("depth"))


def burst_scores(b: DataFrame) -> DataFrame:
    """Scores from (rule_points, sequence_confidence, behavior, correlation, group_size, depth, n, lolbin), nulls as none.

    Without any signal the score is 0. Otherwise the parts are added, raised by the chain factor, and kept in 0..100.
    """
    num = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    rule = num("rule_points")
    sequence = 0.8 * num("sequence_confidence") + F.when(num("sequence_confidence") >= 80, 20).otherwise(0)
    behavior = 40 * num("behavior") + F.when(num("behavior") > 0.8, 5).otherwise(0)
    correlation = F.least(F.lit(35.0), 4 * F.sqrt(num("correlation")) * F.least(F.lit(1.5), F.log2(num("group_size") + 1)))
    none = (rule == 0) & (sequence == 0) & (num("behavior") < 0.1) & (num("correlation") == 0)
    total = (rule + sequence + behavior + correlation + F.when(F.col("lolbin"), 10).otherwise(0)) * (1 + F.least(F.lit(0.35), 0.1 * num("depth"))) + 0.5 * num("n") + F.when(num("depth") >= 3, 15).otherwise(0)
    parts = F.array(*[F.struct(v.alias("points"), F.lit(-k).alias("order"), F.lit(name).alias("name")) for k, (name, v) in enumerate({"rule": rule, "sequence": sequence, "behavior": behavior, "correlation": correlation}.items())])
    score = F.when(none, 0.0).otherwise(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)), 1))
    best = F.array_max(parts)
    share = best["points"] / (rule + sequence + behavior + correlation)
    driver = F.when(none, "benign").when(share < 0.4, "mixed").otherwise(best["name"])
    return b.withColumn("score", score).withColumn("driver", driver).withColumn("severity", F.when(score >= 70, "high").when(score >= 40, "medium").when(score > 0, "low").otherwise("none"))


def run_score(scores: DataFrame, by: str) -> DataFrame:
    """Mean of the three best scores of at least 45, damped when few; half of the best where none reaches 45."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "burst_id")
    x = scores.withColumn("k", F.row_number().over(order))
    strong = F.when((F.col("k") <= 3) & (F.col("score") >= 45), F.col("score"))
    g = x.groupBy(by).agg(F.avg(strong).alias("top"), F.count_if(F.col("score") >= 45).alias("strong"), F.max("score").alias("best"))
    return g.select(by, "strong", "best", F.round(F.when(F.col("strong") > 0, F.col("top") * (1 - 1 / (1 + F.col("strong")))).otherwise(F.col("best") * 0.5), 6).alias("run_score"))


def health_factor(scores: DataFrame) -> DataFrame:
    """0.9 less a tenth of the share of unhealthy groups."""
    bad = F.avg(F.when(F.col("severity") == "none", 1.0).otherwise(0.0))
    return scores.agg(F.round(0.9 - 0.1 * bad, 6).alias("factor"), F.count("*").alias("n"))


def decision(runs: DataFrame) -> DataFrame:
    s = F.col("run_score")
    action = F.when((s >= 60) | (F.col("strong") >= 10), "ESCALATE").when(s >= 40, "INVESTIGATE").when(s >= 20, "MONITOR").otherwise("BASELINE")
    return runs.withColumn("decision", action).withColumn("priority", S.lookup(F.col("decision"), {"ESCALATE": "P1", "INVESTIGATE": "P2", "MONITOR": "P3", "BASELINE": "P4"}))


def record_verdicts(verdicts: DataFrame) -> DataFrame:
    """One row for each pattern (image, parent): times seen, last verdict, and the adjustment it stands for."""
    last = F.max_by("verdict", F.struct("t", "event_id"))
    g = verdicts.groupBy("image", "parent_image").agg(F.count("*").alias("hit_count"), last.alias("verdict"))
    adjustment = S.lookup(F.col("verdict"), {"False Positive": -20, "Benign": -15, "True Positive": 15}, 0)
    return g.withColumn("adjustment", adjustment).withColumn("fingerprint", F.substring(F.sha2(F.concat_ws("|", F.coalesce("image", F.lit("")), F.coalesce("parent_image", F.lit(""))), 256), 1, 16))


def merged_verdicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two memories of verdicts as one (``record_verdicts``): hits add up, the later memory's verdict and adjustment stand. A full outer join by
    the pattern's fingerprint."""
    o, n = (f.select("fingerprint", F.struct("image", "parent_image", "hit_count", "verdict", "adjustment").alias(c)) for f, c in ((old, "o"), (new, "n")))
    last = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    hits = F.coalesce("o.hit_count", F.lit(0)) + F.coalesce("n.hit_count", F.lit(0))
    return o.join(n, "fingerprint", "full").select(last("image").alias("image"), last("parent_image").alias("parent_image"), hits.alias("hit_count"), last("verdict").alias("verdict"), last("adjustment").alias("adjustment"), "fingerprint")


def feedback_adjustment(b: DataFrame, memory: DataFrame, least: int = 3) -> DataFrame:
    """Each burst's adjustment of largest size among patterns with its image (3 points) and parent (2), kept in -20..15."""
    m = memory.select(F.col("image").alias("m_image"), F.col("parent_image").alias("m_parent"), "adjustment", "fingerprint")
    order = F.struct(F.abs("adjustment"), "fingerprint")
    exact = m.groupBy("m_image", "m_parent").agg(F.max_by("adjustment", order).alias("own"))
    wide = m.groupBy("m_image").agg(F.max_by("adjustment", order).alias("any"))  # what an image's patterns come down to: one row each
    both = b.join(exact, (F.col("image") == F.col("m_image")) & (F.col("parent_image") == F.col("m_parent")), "left").drop("m_image", "m_parent")
    both = both.join(wide, F.col("image") == F.col("m_image"), "left").drop("m_image") if least <= 3 else both.withColumn("any", F.lit(None).cast("int"))
    return both.withColumn("adjustment", F.coalesce("own", "any")).drop("own", "any").withColumn("adjustment", F.greatest(F.lit(-20), F.least(F.lit(15), F.coalesce("adjustment", F.lit(0)))))


def priority(confidence: Column) -> Column:
    return F.when(confidence >= 80, "P1").when(confidence >= 60, "P2").when(confidence >= 40, "P3").otherwise("P4")


def sla_status(incidents: DataFrame, as_of_t: int) -> DataFrame:
    """Deadline by priority, and whether it is met, near (a quarter of the time left) or missed at ``as_of_t``."""
    hours = S.lookup(F.col("priority"), K.SLA_HOURS, 72).cast("long")
    due = F.col("created_t") + hours * 3_600_000_000
    state = F.when(F.lit(as_of_t) > due, "breached").when(due - as_of_t <= hours * 900_000_000, "at risk").otherwise("on track")
    return incidents.withColumn("deadline_t", due).withColumn("sla", state)


def transitions(requests: DataFrame) -> DataFrame:
    """Requests (current, requested) with whether the change is allowed, and why not."""
    allowed = requests.sparkSession.createDataFrame([(a, b) for a, bs in K.TRANSITIONS.items() for b in bs], "current string, requested string").withColumn("ok", F.lit(True))
    done = [a for a, bs in K.TRANSITIONS.items() if not bs]
    x = requests.join(F.broadcast(allowed), ["current", "requested"], "left").withColumn("accepted", F.coalesce("ok", F.lit(False))).drop("ok")
    return x.withColumn("reason", F.when(F.col("accepted"), "").when(F.col("current").isin(done), "terminal").otherwise("not allowed"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """Rows of both, the newest of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(newest)))
    return old.unionByName(new).withColumn("__k", place).filter("__k = 1").drop("__k")


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key ``old`` doesn't have."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def decision_ladder(runs: DataFrame) -> DataFrame:
    """The first step that fits (score, stage, sequence_hits, has_persistence, has_injection), its reason and priority."""
    s, chains = F.col("score"), F.col("sequence_hits")
    steps = [
        ((chains >= 2) & (s >= 45), "ESCALATE", "several chains"), (F.col("stage").isin("Lateral Movement", "Command and Control"), "ESCALATE", "critical stage"), (s >= 70, "ESCALATE", "high score"),
        ((s >= 45) | F.col("has_persistence") | F.col("has_injection") | (chains >= 1), "INVESTIGATE", "suspicious"), (s >= 20, "MONITOR", "low score"), (F.lit(True), "BASELINE", "normal"),
    ]
    first = F.coalesce(*[F.when(test, F.struct(F.lit(action).alias("decision"), F.lit(why).alias("why"))) for test, action, why in steps])
    out = runs.withColumn("__d", first).select("*", "__d.*").drop("__d")
    return out.withColumn("priority", S.lookup(F.col("decision"), {"ESCALATE": "P1", "INVESTIGATE": "P2", "MONITOR": "P3", "BASELINE": "P4"}))


def response_tasks(decided: DataFrame, by: str) -> DataFrame:
    """One row for each task that a decision or stage calls for, in order."""
    tasks = F.array_compact(F.array(*[F.when(F.col("decision").isin(keys) | F.col("stage").isin(keys), F.struct(F.lit(task).alias("task"), F.lit(urgency).alias("urgency"))) for keys, task, urgency in K.TASKS]))
    return decided.select(by, F.posexplode(tasks).alias("place", "x")).select(by, "place", "x.*")


def full_run_score(scores: DataFrame, by: str, failed: tuple[str, ...] = ()) -> DataFrame:
    """Run scores of (score, driver, behavior, correlation, modifier, feedback): the damped mean of the three best of at least 45, or half
    of the best; 5 more where one driver stands behind over 0.7 of the scores of 30 and is strong itself; at least the best
    score; times the modifier (0.8 of the mean, 0.2 of the least but one) and a factor for each stage of analysis that ``failed``.

    The best three and the two least modifiers are gathered by rank, so nothing grows with a run; of drivers equally frequent
    the least name is taken.
    """
    x = scores.withColumn("s", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("score") + F.coalesce("feedback", F.lit(0)))))
    best, least = Window.partitionBy(by).orderBy(F.desc("s"), "burst_id"), Window.partitionBy(by).orderBy("modifier", "burst_id")
    x = x.withColumn("k", F.row_number().over(best)).withColumn("j", F.row_number().over(least))
    known = F.col("s") >= 30
    drivers = x.filter(known).groupBy(by, "driver").agg(F.count("*").alias("c")).groupBy(by).agg(F.min_by("driver", F.struct(-F.col("c"), "driver")).alias("dominant"), F.max("c").alias("c"), F.sum("c").alias("relevant"))
    g = x.groupBy(by).agg(
        F.avg(F.when((F.col("k") <= 3) & (F.col("s") >= 45), F.col("s"))).alias("top"), F.count_if(F.col("s") >= 45).alias("strong"), F.max("s").alias("best"), F.avg("modifier").alias("mean_modifier"), F.count("*").alias("n"),
        F.min("modifier").alias("m1"), F.max(F.when(F.col("j") == 2, F.col("modifier"))).alias("m2"), F.avg(F.when(known, F.col("behavior"))).alias("b"), F.avg(F.when(known, F.col("correlation"))).alias("c0"),
    )
    g = g.join(drivers, by, "left")
    raw = F.round(F.when(F.col("strong") > 0, F.col("top") * (1 - 1 / (1 + F.col("strong")))).otherwise(F.col("best") * 0.5), 4)
    strength = F.when(F.col("dominant") == "behavior", F.col("b")).when(F.col("dominant").isin("correlation", "campaign"), F.col("c0") / 100).otherwise(0.5)
    consistent = F.coalesce((F.col("c") / F.col("relevant") > 0.7) & (strength > 0.5), F.lit(False))
    modifier = 0.8 * F.col("mean_modifier") + 0.2 * F.when(F.col("n") > 2, F.col("m2")).otherwise(F.col("m1"))
    factor = 1.0
    for stage in failed:
        factor *= {"rule": 0.5, "sequence": 0.7, "correlation": 0.85}[stage]
    total = F.round(F.round(F.greatest(raw + F.when(consistent, 5).otherwise(0), F.col("best")) * modifier * factor, 6), 0)
    capped = F.least(total, F.lit(50.0)) if {"rule", "sequence"} <= set(failed) else total
    return g.select(by, "strong", "best", "dominant", consistent.alias("consistent"), F.round(modifier, 6).alias("modifier"), capped.cast("int").alias("run_score"))


def substring_matches(patterns: DataFrame, names: DataFrame, q: int = 3) -> DataFrame:
    """(pattern, name): every pattern with the names that contain it, both lower-cased, by an inverted index of q-grams.

    A pattern meets only the names that have its rarest gram (of ``q`` characters, or all of a shorter pattern); of those it is looked for.
    ``patterns`` and ``names`` are tables of one column; null and empty patterns match nothing.
    """
    asked, given = (t.select(F.lower(F.col(t.columns[0])).alias(n)).filter(f"{n} <> ''").distinct() for t, n in ((patterns, "pattern"), (names, "name")))
    grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))
    each = F.array_distinct(F.flatten(F.array(*[F.when(F.length("name") >= n, grams(F.col("name"), n)).otherwise(F.array().cast("array<string>")) for n in range(1, q + 1)])))
    index = given.select("name", F.explode(each).alias("gram"))
    often = index.groupBy("gram").agg(F.count("*").alias("n"))
    own = asked.select("pattern", F.explode(F.array_distinct(F.when(F.length("pattern") < q, F.array("pattern")).otherwise(grams(F.col("pattern"), q)))).alias("gram"))
    rarest = own.join(often, "gram").groupBy("pattern").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return rarest.join(index, "gram").filter(F.contains("name", "pattern")).select("pattern", "name")


def pattern_feedback(b: DataFrame, memory: DataFrame) -> DataFrame:
    """Each burst's adjustment by remembered patterns of (image, parent_image, stage, rule_id, adjustment), any of which may be null.

    A match counts image 3, parent 2, stage 2, rule 3, host 1; the names of a memory are looked for as parts of the burst's names, without case.
    Two points suffice, so any one of the first four does; stages of high risk need five, with the rule or with image and stage, and the strict
    ones among them are lowered only by their rule. A host's point never decides: no set of keys lacks just one. So what decides
    are the memories of one or two keys, each brought down to its adjustment of largest size (of equal ones the higher): plain joins
    with one row a key. Names are matched once each (``substring_matches``), so nothing grows with bursts times memories.
    """
    names, m = {"i": "image", "p": "parent_image", "s": "stage", "r": "rule_id"}, memory.withColumn("adjustment", F.greatest(F.lit(-20), F.least(F.lit(15), F.col("adjustment"))))
    part = {c: substring_matches(m.select(c), b.select(c)) for c in ("image", "parent_image")}
    low = lambda c: F.lower(c) if c in part else F.col(c)
    out = b
    for keys in ("i", "p", "s", "r", "ri", "rp", "rs", "is", "is+"):
        columns = [names[k] for k in keys.rstrip("+")]
        kept = m.dropna(subset=columns).filter("adjustment >= 0") if keys.endswith("+") else m.dropna(subset=columns)
        for c in columns:
            if c in part:
                kept = kept.withColumn("pattern", F.lower(c)).drop(c).join(part[c].withColumnRenamed("name", c), "pattern")
        one = kept.groupBy(*[F.col(c).alias(f"__{c}") for c in columns]).agg(F.max(F.struct(F.abs("adjustment").alias("size"), "adjustment")).alias(f"__by_{keys}"))
        out = out.join(one, [low(c) == F.col(f"__{c}") for c in columns], "left").drop(*[f"__{c}" for c in columns])
    strict, risky = F.coalesce(F.col("stage").isin(K.STRICT_STAGES), F.lit(False)), F.coalesce(F.col("stage").isin(K.RISKY_STAGES), F.lit(False))
    by = lambda *keys: F.greatest(*[F.col(f"`__by_{k}`") for k in keys])
    best = F.when(strict, by("ri", "rp", "rs", "is+")).when(risky, by("ri", "rp", "rs", "is")).otherwise(by("i", "p", "s", "r"))
    return out.withColumn("feedback", F.coalesce(best["adjustment"], F.lit(0))).drop(*[c for c in out.columns if c.startswith("__by_")])
