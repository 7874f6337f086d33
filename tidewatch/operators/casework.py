"""From bursts to cases: suppression, what is kept, classification, score ledgers, verdicts, histories and narratives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import constants as K
from tidewatch.functions import signals as S
from tidewatch.operators.graph import stored


def suppressed(b: DataFrame) -> DataFrame:
    """Caps of the risk of benign bursts, first reason wins: SYSTEM with little deviation 15, known benign images 20, children of
    known benign parents 25. ``b``: bursts with risk, deviation, stage."""
    outside = F.coalesce(S.external_address(F.col("dst_ip")), F.lit(False))
    follows = outside | F.col("has_reg")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    reason = (
        F.when(F.upper(F.coalesce("user", F.lit(""))).contains("SYSTEM") & (F.col("deviation") < 0.3) & ~follows, "system")
        .when(low("image").isin(K.KNOWN_BENIGN) & (F.col("deviation") < 0.4) & F.col("stage").isin("Background", "Execution"), "benign image")
        .when(low("parent_image").isin(K.KNOWN_BENIGN_PARENTS) & ~outside & (F.col("deviation") < 0.5), "benign parent")
    )
    cap = S.lookup(F.col("suppression"), {"system": 15, "benign image": 20, "benign parent": 25}, 100)
    return b.withColumn("suppression", reason).withColumn("risk", F.least(F.col("risk"), cap))


def worth_keeping(b: DataFrame) -> DataFrame:
    """Bursts to persist, once each: a risk of 45, a stage that hides, or five events."""
    return b.filter((F.col("risk") >= 45) | F.col("stage").isin("Persistence", "Privilege Escalation") | (F.col("n") >= 5)).dropDuplicates(["burst_id"])


def classified(b: DataFrame) -> DataFrame:
    """Severity and class of bursts (risk, stage, has_reg, floor): the floor rises with the noise of the host; what may be an
    attack is marked as never to be learned from a score of 80 on."""
    s = F.col("risk")
    severity = F.when(F.col("stage").isin(K.HIGH_STAGES) | (s >= 60), "high").when(s >= 40, "medium").otherwise("low")
    kind = F.when((s >= F.least(F.lit(60), F.col("floor"))) | F.col("has_reg"), "attack_candidate").otherwise("background_activity")
    return b.withColumn("severity", severity).withColumn("classification", kind).withColumn("never_learn", s >= 80)


def ledger(b: DataFrame) -> DataFrame:
    """One row for each part of a burst's score that is not nothing: label, points, share, colour; the parts as in ``burst_scores``."""
    num = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    parts = {
        "rule": num("rule_points"), "sequence": 0.8 * num("sequence_confidence") + F.when(num("sequence_confidence") >= 80, 20).otherwise(0),
        "behavior": 40 * num("behavior") + F.when(num("behavior") > 0.8, 5).otherwise(0), "lolbin": F.when(F.col("lolbin"), 10.0).otherwise(0.0), "volume": 0.5 * num("n"),
        "depth": F.when(num("depth") >= 3, 15.0).otherwise(0.0),
    }
    entries = F.array_compact(F.array(*[F.when(v > 0, F.struct(F.lit(k).alias("label"), F.round(v, 6).alias("points"))) for k, v in parts.items()]))
    total = F.aggregate("entries", F.lit(0.0), lambda a, x: a + x["points"])
    out = b.withColumn("entries", entries).withColumn("total", total).select("burst_id", "total", F.inline("entries"))
    share = F.col("points") / F.col("total")
    return out.withColumn("share", F.round(share, 6)).withColumn("colour", F.when(share >= 0.5, "red").when(share >= 0.25, "orange").otherwise("blue")).drop("total")


def chain_dedup(found: DataFrame) -> DataFrame:
    """The first of each (pattern, host, stage, confidence in steps of five, whether it connects, whether it persists); rows with neither
    confidence nor a signal (``has_signal``) go. Columns that ``found`` lacks count as no."""
    flags = ["has_net", "has_persistence", "has_signal"]
    x = found.withColumns({c: F.coalesce(F.col(c), F.lit(False)) if c in found.columns else F.lit(False) for c in flags})
    x = x.withColumn("confidence", F.when(F.isnan(F.col("confidence").cast("double")), 0).otherwise(F.coalesce("confidence", F.lit(0)))).filter("confidence <> 0 or has_signal")
    x = x.withColumn("step", (F.floor(F.col("confidence") / 5) * 5).cast("int"))
    keys = ["pattern_id", "computer", "stage", "step", "has_net", "has_persistence"]
    first = F.min_by(F.struct(*[c for c in x.columns if c not in keys]), F.struct("first_t", "last_t", "first_uid", "matched"))
    return x.groupBy(*keys).agg(first.alias("x"), F.count("*").alias("merged")).select(*keys, "x.*", "merged")


def verdict_checks(verdicts: DataFrame, least_reason: int = 10) -> DataFrame:
    """Whether a verdict (verdict, reason) is one of the options with a reason long enough; else why not; and its next steps."""
    known = F.col("verdict").isin(list(K.VERDICTS))
    problem = F.when(~known, "unknown verdict").when(F.length(F.trim(F.coalesce("reason", F.lit("")))) < least_reason, "reason too short").otherwise("")
    steps = F.when(F.col("problem") == "", S.lookup(F.col("verdict"), {k: "; ".join(v) for k, v in K.VERDICTS.items()}))
    return verdicts.withColumn("problem", problem).withColumn("valid", F.col("problem") == "").withColumn("remediation", steps)


def state_history(changes: DataFrame, allowed: list[tuple[str, str]], by: str = "run_id") -> DataFrame:
    """Each change of state of a run with the state before it, whether the step is allowed, and how long the state had lasted.

    ``changes``: (run, state, t, event_id). The first state of a run is always allowed.
    """
    order = Window.partitionBy(by).orderBy("t", "event_id")
    x = changes.withColumn("before", F.lag("state").over(order)).withColumn("lasted", F.col("t") - F.lag("t").over(order))
    ok = F.concat_ws(">", "before", "state").isin([f"{a}>{b}" for a, b in allowed])
    return x.withColumn("accepted", F.col("before").isNull() | (F.col("before") == F.col("state")) | ok)


def audit_rows(decided: DataFrame, actor: Column) -> DataFrame:
    """One line of audit for each decided request (current, requested, accepted, reason)."""
    text = F.concat_ws(" ", F.when(F.col("accepted"), "changed").otherwise("refused"), "current", F.lit("to"), "requested", F.when(F.col("reason") != "", F.concat(F.lit("("), "reason", F.lit(")"))))
    return decided.select("event_uid", actor.alias("actor"), F.when(F.col("accepted"), "status_change").otherwise("status_refused").alias("action"), text.alias("details"))


def narrative(scores: DataFrame, chains: DataFrame, by: str = "computer", top: int = 3, campaigns: DataFrame | None = None) -> DataFrame:
    """Headline and strongest bursts and chains of each run: critical from a score of 75, suspicious from 45; with ``campaigns`` (run, id, hosts,
    confidence) also a line on each of the two strongest."""
    def best(df: DataFrame, value: str, order: list, name: str) -> DataFrame:
        ranked = df.withColumn("o", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("o") <= top)
        return ranked.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", value))), lambda x: x[value]), ", ").alias(name))

    bursts = best(scores, "burst_id", [F.desc("score"), "burst_id"], "top_bursts")
    found = best(chains.groupBy(by, "pattern_id").agg(F.max("confidence").alias("c")), "pattern_id", [F.desc("c"), "pattern_id"], "top_chains")
    g = scores.groupBy(by).agg(F.max("score").alias("best"), F.count("*").alias("bursts"))
    tier = F.when(F.col("best") >= 75, "Critical activity").when(F.col("best") >= 45, "Suspicious activity").otherwise("Routine activity")
    headline = F.concat(tier, F.lit(" on "), F.col(by), F.lit(": "), F.col("bursts").cast("string"), F.lit(" bursts"))
    out = g.join(bursts, by, "left").join(found, by, "left").select(by, headline.alias("headline"), "best", "top_bursts", "top_chains")
    if campaigns is None:
        return out
    told = F.concat(F.lit("Multi-stage campaign across "), F.col("hosts").cast("string"), F.lit(" host(s): confidence "), F.col("confidence").cast("long").cast("string"), F.lit("%"))
    top = 2
    return out.join(best(campaigns.withColumn("line", told), "line", [F.desc("confidence"), "id"], "top_campaigns"), by, "left")


def cross_run(campaigns: DataFrame, by: str, run: str) -> DataFrame:
    """Campaigns of several runs that share a key: how many runs, the first and last time, the highest stage and confidence."""
    return campaigns.groupBy(by).agg(
        F.count_distinct(run).alias("runs"), F.count("*").alias("campaigns"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"),
        F.max("confidence").alias("confidence"), F.max_by("stage", F.struct(S.stage_rank(F.col("stage")), "stage")).alias("stage"),
    )


def cross_run_rows(campaigns: DataFrame, iocs: DataFrame, by: str, run: str) -> DataFrame:
    """What the campaigns of several runs have in them, as child rows (key, kind, value): each run once, each indicator once. ``iocs``: (key, ioc)."""
    runs = campaigns.select(by, F.lit("run").alias("kind"), F.col(run).cast("string").alias("value"))
    return runs.unionByName(iocs.select(by, F.lit("ioc").alias("kind"), F.col("ioc").alias("value"))).dropna().distinct()


def evidence(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence tags of both, the newest tag of each (incident, event); ties go to the greater tag."""
    order = Window.partitionBy(*keys).orderBy(F.desc("t"), F.desc("tag"))
    return old.unionByName(new).withColumn("o", F.row_number().over(order)).filter("o = 1").drop("o")


def schema_problems(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """One row for each wanted column: its type here, whether it is missing or of another type, and how many values are null."""
    have = dict(df.dtypes)
    counts = df.select(*[F.count_if(F.col(c).isNull()).alias(c) if c in have else F.lit(None).cast("long").alias(c) for c in wanted])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(have.get(c)).cast("string").alias("type"), F.lit("missing" if c not in have else "" if have[c] == t else "type").alias("problem"), F.col(c).alias("nulls")) for c, t in wanted.items()]
    return counts.select(F.inline(F.array(*rows)))


def pre_order(tree: DataFrame, links: DataFrame) -> DataFrame:
    """Number the nodes of each process tree in pre-order, children by (time, id). ``tree``: (event_id, root_id, depth).

    The successor of a node is its first child, else the next sibling of the nearest node at or above it that has one; such nodes, and then the
    distance to the last node, are found by pointer doubling, in rounds that grow with the logarithm of the longest path. Each
    round is a stored table.
    """
    nodes = stored(tree.join(links.select("event_id", "parent_id", "t"), "event_id"))
    sibling = F.lead("event_id").over(Window.partitionBy("parent_id").orderBy("t", "event_id"))
    inner = nodes.filter("parent_id is not null").select("event_id", "parent_id", sibling.alias("sibling"))
    rooted = nodes.filter("parent_id is null").select("event_id", "parent_id", F.lit(None).cast(dict(nodes.dtypes)["event_id"]).alias("sibling"))
    up = inner.unionByName(rooted).select("event_id", F.coalesce("sibling", "parent_id").alias("to"), (F.col("sibling").isNotNull() | F.col("parent_id").isNull()).alias("done"))
    up = stored(up)
    while up.filter("not done").take(1):
        at = up.select(F.col("event_id").alias("to"), F.col("to").alias("further"), F.col("done").alias("there"))
        going = up.filter("not done").join(at, "to").select("event_id", F.col("further").alias("to"), F.col("there").alias("done"))
        up = stored(up.filter("done").unionByName(going))
    child = nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("event_id")).agg(F.min_by("event_id", F.struct("t", "event_id")).alias("child"))
    line = stored(up.join(child, "event_id", "left").select("event_id", F.coalesce("child", "to").alias("to")).withColumn("left", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long")))
    while line.filter("to is not null").take(1):
        at = line.select(F.col("event_id").alias("to"), F.col("to").alias("further"), F.col("left").alias("more"))
        going = line.filter("to is not null").join(at, "to").select("event_id", F.col("further").alias("to"), (F.col("left") + F.col("more")).alias("left"))
        line = stored(line.filter("to is null").unionByName(going))
    all_left = line.select(F.col("event_id").alias("root_id"), F.col("left").alias("whole"))
    placed = nodes.select("event_id", "root_id", "depth").join(line.select("event_id", "left"), "event_id").join(all_left, "root_id")
    return placed.select("event_id", "root_id", "depth", (F.col("whole") - F.col("left") + 1).cast("int").alias("place"))


def expected_transitions(decided: DataFrame) -> DataFrame:
    """Decided requests (``scoring.transitions``) that also say which status they ``expected``: refused where it is another by now."""
    moved = F.col("expected") != F.col("current")
    return decided.withColumn("reason", F.when(moved, "changed meanwhile").otherwise(F.col("reason"))).withColumn("accepted", F.col("accepted") & ~moved)


def valid_evidence(tags: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence tags whose event is one of its incident's."""
    return tags.join(members.select(*keys), keys, "left_semi")


def triage(incidents: DataFrame, hits: DataFrame, by: list[str], most: int = 100) -> DataFrame:
    """Open incidents, best confidence first, the oldest of equal ones first, with the reason of their strongest hit."""
    top = hits.groupBy(*by).agg(F.max_by("match_reason", F.struct("confidence_score", "event_uid")).alias("why"))
    queue = incidents.filter(~F.startswith("status", F.lit("Closed"))).orderBy(F.desc("confidence"), "created_t", *by).limit(most)
    return queue.join(top, by, "left").withColumn("why", F.array_join("why", "; "))


def incident_detail(incidents: DataFrame, members: DataFrame, tags: DataFrame, by: str) -> DataFrame:
    """One row for each event of an incident in order of time, with its evidence tag; an incident without events has one row, not valid.

    Rows instead of a list for each incident, so that a large incident is no large row.
    """
    x = incidents.select(by, "status").join(members, by, "left").join(tags, [by, "event_uid"], "left")
    order = Window.partitionBy(by).orderBy("t", "event_uid")
    shown = {c: F.coalesce(c, F.lit("")).alias(c) for c in ("image", "parent_image", "command_line", "dst_ip", "user")}
    return x.withColumn("place", F.row_number().over(order)).select(by, "status", "place", "event_uid", "t", "event_code", *shown.values(), "tag", F.col("event_uid").isNotNull().alias("valid"))


def uid_rows(incidents: DataFrame, by: str, uid_list: str = "event_uids") -> DataFrame:
    """(incident, place, event uid) from incidents whose uids are held as a JSON list."""
    return incidents.select(by, F.posexplode(F.from_json(uid_list, "array<string>")).alias("place", "event_uid"))
