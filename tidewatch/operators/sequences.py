"""Ordered attack sequences within a host: steps that follow each other within a few rows and a time gap.

The next step of a pattern must be one of the next ``skip + 1`` rows of the host and not later than its gap (with a
tolerance). Those rows are read with ``lead`` over one window shared by all patterns: one sort, no self-join, no UDF. No chain
is longer than the sum of its gaps, so a host's time is cut into slabs of four times that, and the rows at the beginning of a
slab are also at the end of the one before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import signals as S
from tidewatch.operators.slabs import slab_of

TOLERANCE = 5


@dataclass(frozen=True)
class Step:
    image_any: tuple[str, ...] = ()
    event_code: int | None = None
    cmd_contains: str | None = None
    max_gap_seconds: int = 300
    max_skip_steps: int = 1


@dataclass(frozen=True)
class Pattern:
    pattern_id: str
    stage: str
    confidence: int
    steps: tuple[Step, ...]


PATTERNS = [
    Pattern("SEQ-A", "Execution", 85, (Step(("powershell",), 1), Step(("certutil",), 11, max_gap_seconds=1800))),
    Pattern("SEQ-B", "Lateral Movement", 80, (Step(("powershell",), 1), Step(("cmd",), 3, max_gap_seconds=3600), Step(("reg",), 13, max_gap_seconds=7200))),
    Pattern("SEQ-C", "Persistence", 92, (Step(("certutil",), 11), Step(("reg",), 13, max_gap_seconds=3600), Step(("svchost",), 22, max_gap_seconds=3600))),
]


_OFFICE, _SHELLS = ("winword.exe", "excel.exe", "outlook.exe"), ("powershell.exe", "cmd.exe")
#: The built-in patterns.
BUILT_IN = [
    Pattern("SEQ-001", "Execution", 90, (Step(("winword.exe", "excel.exe", "outlook.exe", "powerpnt.exe"), 1), Step(("powershell",), 1, max_gap_seconds=300))),
    Pattern("SEQ-002", "Command and Control", 95, (Step(_OFFICE, 1), Step(("powershell",), 1, max_gap_seconds=600), Step(("powershell",), 3, max_gap_seconds=120))),
    Pattern("SEQ-003", "Execution", 85, (Step(("powershell",), 1, "-enc"), Step(("powershell",), 11, max_gap_seconds=300))),
    Pattern("SEQ-004", "Lateral Movement", 80, (Step(("powershell",), 1), Step(("cmd.exe",), 1, max_gap_seconds=120), Step(("cmd.exe",), 3, max_gap_seconds=60))),
    Pattern("SEQ-005", "Credential Access", 95, (Step((), 10), Step((), 1, "sekurlsa", max_gap_seconds=300))),
    Pattern("SEQ-006", "Persistence", 85, (Step(("powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe"), 1), Step((), 13, max_gap_seconds=600))),
    Pattern("SEQ-007", "Persistence", 82, (Step(_SHELLS, 1), Step(("schtasks",), 1, "/create", max_gap_seconds=120))),
    Pattern("SEQ-008", "Actions on Objectives", 95, (Step(_SHELLS, 1), Step((), 1, "shadowcopy", max_gap_seconds=300))),
    Pattern("SEQ-009", "Command and Control", 90, (Step(("netsh",), 1, "firewall"), Step((), 3, max_gap_seconds=300))),
    Pattern("SEQ-010", "Execution", 92, (Step(("mshta",), 1), Step(("mshta",), 3, max_gap_seconds=120), Step((), 11, max_gap_seconds=120))),
    Pattern("SEQ-011", "Lateral Movement", 80, (Step(("net.exe", "net1.exe", "nltest.exe"), 1), Step(("psexec.exe", "psexec64.exe", "wmic.exe"), 1, max_gap_seconds=1800))),
    Pattern("SEQ-012", "Execution", 88, (Step(("certutil",), 1, "-urlcache"), Step((), 1, max_gap_seconds=300))),
]


def matches(step: Step) -> Column:
    tests = []
    if step.event_code is not None:
        tests.append(F.col("event_code") == step.event_code)
    if step.image_any:
        tests.append(S.any_of(F.lower("image"), list(step.image_any)))
    if step.cmd_contains:
        tests.append(F.contains(S.normal_command(F.col("command_line")), F.lit(step.cmd_contains)))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False))


def detect(events: DataFrame, patterns: list[Pattern] = PATTERNS) -> DataFrame:
    """One row for each chain and each of its prefixes of two steps or more: partial matches count with less confidence.

    A row's matches of all steps are the bits of one array, so all patterns read the next rows through the same few leads. From
    the last hop to the first, each row then gets the ends of the chains that go on from it.
    """
    reach = max(sum(s.max_gap_seconds + TOLERANCE for s in p.steps[1:]) for p in patterns)
    own = slab_of(F.col("t"), 4 * reach)
    events = events.withColumn("__slab", F.explode(F.array_distinct(F.array(own, slab_of(F.col("t") - reach * 1_000_000, 4 * reach)))))
    order = Window.partitionBy("computer", "__slab").orderBy("t", "event_id")
    bits = {(p.pattern_id, k): i for i, (p, k) in enumerate((p, k) for p in patterns for k in range(len(p.steps)))}
    ahead = max(s.max_skip_steps for p in patterns for s in p.steps[1:]) + 1
    here = F.array(*[matches(s) for p in patterns for s in p.steps])
    rows = events.withColumn("__m", here).withColumn("__row", F.struct("t", F.col("event_uid").alias("uid"), F.col("__m").alias("m"))).withColumns({f"__next{j}": F.lead("__row", j).over(order) for j in range(1, ahead + 1)})
    end = "array<struct<matched:int,last_t:bigint,last_uid:string>>"
    hops = {}
    for p in patterns:
        for k, step in enumerate(p.steps[1:]):
            late = (step.max_gap_seconds + TOLERANCE) * 1_000_000
            hops[p.pattern_id, k] = F.coalesce(*[F.when(F.col(f"__next{j}.m")[bits[p.pattern_id, k + 1]] & (F.col(f"__next{j}.t") - F.col("t") <= late), F.lit(j)) for j in range(1, step.max_skip_steps + 2)])
    rows = rows.withColumn("__hops", F.array(*[hops.get((p.pattern_id, k), F.lit(None)).cast("int") for p in patterns for k in range(len(p.steps))])).withColumn("__ends", F.array(*[F.array().cast(end) for _ in patterns]))
    for depth in range(max(len(p.steps) for p in patterns) - 2, -1, -1):
        if depth < max(len(p.steps) for p in patterns) - 2:
            rows = rows.withColumns({f"__go{j}": F.lead("__ends", j).over(order) for j in range(1, ahead + 1)})
        else:
            rows = rows.withColumns({f"__go{j}": F.lit(None).cast(f"array<{end}>") for j in range(1, ahead + 1)})
        ends = []
        for i, p in enumerate(patterns):
            if depth > len(p.steps) - 2:
                ends.append(F.array().cast(end))
                continue
            hop = F.col("__hops")[bits[p.pattern_id, depth]]
            pick = lambda name, hop=hop: F.coalesce(*[F.when(hop == j, F.col(f"{name[0]}{j}{name[1]}")) for j in range(1, ahead + 1)])
            first = F.array(F.struct(F.lit(depth + 2).alias("matched"), pick(("__next", ".t")).alias("last_t"), pick(("__next", ".uid")).alias("last_uid")))
            more = F.coalesce(*[F.when(hop == j, F.col(f"__go{j}")[i]) for j in range(1, ahead + 1)], F.array().cast(end))
            ends.append(F.when(hop.isNotNull(), F.concat(first, more)).otherwise(F.array().cast(end)))
        rows = rows.withColumn("__ends", F.array(*ends))
    level = lambda c: "critical" if c >= 90 else "high" if c >= 75 else "medium" if c >= 55 else "low"
    found = F.array(*[
        F.struct(F.lit(p.pattern_id).alias("pattern_id"), F.lit(p.stage).alias("stage"), F.lit(level(p.confidence)).alias("severity"), F.lit(p.confidence).alias("base"), F.lit(len(p.steps)).alias("total"),
                 F.when(F.col("__m")[bits[p.pattern_id, 0]], F.col("__ends")[i]).otherwise(F.array().cast(end)).alias("ends"))
        for i, p in enumerate(patterns)
    ])
    starts = rows.filter((F.col("__slab") == own) & F.exists("__ends", lambda e: F.size(e) > 0))
    out = starts.select("computer", F.col("event_uid").alias("first_uid"), F.col("t").alias("first_t"), F.inline(found)).select("*", F.inline("ends")).drop("ends")
    return out.withColumn("confidence", F.floor(F.col("base") * F.col("matched") / F.col("total")).cast("int")).drop("base").dropDuplicates(["pattern_id", "computer", "first_t", "last_t", "matched"])


def grouped(found: DataFrame, bucket_seconds: int = 30) -> DataFrame:
    """The best of each pattern, host and time bucket, divided by the logarithm of how often it fires."""
    g = found.groupBy("pattern_id", "computer", F.floor(F.col("first_t") / (bucket_seconds * 1_000_000)).alias("bucket")).agg(F.max("confidence").alias("best"), F.count("*").alias("freq"))
    damp = F.when(F.col("freq") > 1, F.log(1.0 + F.col("freq"))).otherwise(1.0)
    return g.withColumn("confidence", F.floor(F.col("best") / damp * F.when(F.col("freq") > 5, 0.5).otherwise(1.0)).cast("int"))


def boost(bursts: DataFrame, found: DataFrame) -> DataFrame:
    """Burst risk raised by the best sequence of its computer: at most 10 points, at most 100 in all."""
    best = found.groupBy("computer").agg(F.max("confidence").alias("sequence_confidence"))
    add = F.least(F.lit(10.0), F.coalesce("sequence_confidence", F.lit(0)) / 10)
    return bursts.join(best, "computer", "left").withColumn("boosted", F.least(F.lit(100.0), F.col("risk") + add))


def with_last_event(found: DataFrame, events: DataFrame) -> DataFrame:
    """Sequences with image, parent and command of the event that ends them."""
    last = events.select(F.col("event_uid").alias("last_uid"), "image", "parent_image", S.normal_command(F.col("command_line")).alias("command"))
    return found.join(last, "last_uid", "left")


def grouped_by_event(found: DataFrame, bucket_seconds: int = 30) -> DataFrame:
    """The best of each (image, parent, pattern, computer, command, time bucket), divided by the logarithm of one more than how often it
    fires; half of that over five times, and half for a task scheduler under a benign parent. ``found``: ``with_last_event``."""
    keys = [F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in ("image", "parent_image")]
    g = found.groupBy(*keys, "pattern_id", "computer", "command", F.floor(F.col("last_t") / (bucket_seconds * 1_000_000)).alias("bucket")).agg(F.max("confidence").alias("best"), F.count("*").alias("freq"))
    planned = F.contains("image", F.lit("schtasks.exe")) & S.any_of(F.col("parent_image"), ["svchost.exe", "services.exe", "explorer.exe", "wininit.exe"])
    score = F.col("best") / F.log(1.0 + F.col("freq")) * F.when(F.col("freq") > 5, 0.5).otherwise(1.0) * F.when(planned, 0.5).otherwise(1.0)
    return g.withColumn("confidence", F.floor(score).cast("int"))


def boost_by_image(bursts: DataFrame, found: DataFrame) -> DataFrame:
    """Burst risk raised by the best sequence that ends in the burst's image: a tenth of its confidence times 0.5 and the behavior
    score, at most 10 points, at most 100 in all. ``found``: ``with_last_event``; ``bursts`` need ``behavior``."""
    best = found.groupBy(F.lower("image").alias("seq_image")).agg(F.max("confidence").alias("sequence_confidence"))
    x = bursts.join(best, F.lower("image") == F.col("seq_image"), "left").drop("seq_image")
    add = F.least(F.lit(10.0), F.coalesce("sequence_confidence", F.lit(0)) / 10 * (0.5 + F.col("behavior")))
    return x.withColumn("in_sequence", F.col("sequence_confidence").isNotNull()).withColumn("boosted", F.least(F.lit(100.0), F.col("risk") + add))
