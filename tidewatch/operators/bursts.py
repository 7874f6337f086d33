"""Bursts and sessions: gaps-and-islands over time, with measures, stages, filters and ranks.

Bursts are numbered by scans in two levels (``slabs``), so a busy key is spread over its time; nothing gathered grows with a burst but the
list of its codes (``with_code_list``), which is as long as the burst has events and is put together by slabs as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import constants as K
from tidewatch.functions import signals as S
from tidewatch.operators.slabs import numbered_runs, slab_of

SECOND = 1_000_000


def behaviors(events: DataFrame) -> DataFrame:
    """Events that say what a process did, with their type; others are dropped."""
    from tidewatch.functions.constants import BEHAVIORS

    return events.withColumn("behavior_type", S.lookup(F.col("event_code"), dict(BEHAVIORS))).filter("behavior_type is not null")


def with_burst(events: DataFrame, keys: list[str], gap_seconds: int = 900) -> DataFrame:
    """Number each event's burst within its key: a new one begins after a gap of more than ``gap_seconds``."""
    return numbered_runs(events, keys, ["t", "event_id"], ["t"], lambda before, here: here("t") - before("t") > gap_seconds * SECOND, "burst_no")


def _filled(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.withColumns({k: F.coalesce(k, F.lit(f"unknown_{k}")) for k in keys})


def burst_events(events: DataFrame, keys: list[str] | None = None, gap_seconds: int = 900) -> DataFrame:
    """The events of each burst as rows, with its ``burst_id``: the whole list that a burst's row doesn't hold."""
    keys = keys or ["image", "pid", "computer", "user"]
    numbered = with_burst(_filled(events, keys), keys, gap_seconds)
    starts = numbered.groupBy(*keys, "burst_no").agg(F.min("t").alias("start_t"))
    return numbered.join(starts.select(*keys, "burst_no", _burst_id(keys).alias("burst_id")), [*keys, "burst_no"])


def _burst_id(keys: list[str]) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *keys, F.col("start_t").cast("string")), 256), 1, 16)


def bursts(events: DataFrame, keys: list[str] | None = None, gap_seconds: int = 900, more: list[Column] = ()) -> DataFrame:
    """One row for each burst of a key, with its measures and those of ``more``; its id is a hash of the key and the start. ``codes``: the
    different event codes in it."""
    keys = keys or ["image", "pid", "computer", "user"]
    code = F.col("event_code")
    out = with_burst(_filled(events, keys), keys, gap_seconds).groupBy(*keys, "burst_no").agg(
        F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("n"),
        F.count_if(code == 1).alias("exec_count"), F.count_if(code == 3).alias("net_count"),
        F.max(code == 11).alias("has_file"), F.max(code.isin(12, 13, 14)).alias("has_reg"),
        F.array_join(F.transform(F.array_sort(F.collect_set(code)), lambda c: c.cast("string")), ",").alias("codes"),
        F.max_by("dst_ip", F.when(F.col("dst_ip").isNotNull(), F.struct("t", "event_id"))).alias("dst_ip"),
        F.max_by("parent_image", F.when(F.col("parent_image").isNotNull(), F.struct("t", "event_id"))).alias("parent_image"),
        F.round(F.max("value"), 6).alias("peak"), *more,
    )
    return out.withColumn("burst_id", _burst_id(keys))


def with_code_list(b: DataFrame, events: DataFrame, keys: list[str] | None = None, gap_seconds: int = 900, slab_seconds: int = 3600) -> DataFrame:
    """Bursts ``b`` of these events with ``code_list``: the codes of all of a burst's events in order of time, null where it has none. Codes are
    sorted and joined within slabs of time, so a long burst is sorted by many tasks; its row puts one text a slab together."""
    keys = keys or ["image", "pid", "computer", "user"]
    place = F.struct("t", "event_id", "event_code")
    joined = lambda rows, value: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x[value].cast("string")), ",")
    coded = with_burst(_filled(events, keys), keys, gap_seconds).filter("event_code is not null").withColumn("slab", slab_of(F.col("t"), slab_seconds))
    pieces = coded.groupBy(*keys, "burst_no", "slab").agg(joined(place, "event_code").alias("piece"))
    lists = pieces.groupBy(*keys, "burst_no").agg(joined(F.struct("slab", "piece"), "piece").alias("code_list"))
    return b.join(lists, [*keys, "burst_no"], "left")


def behavior_features(b: DataFrame) -> DataFrame:
    """What a burst is compared by with its hour's baseline. ``b``: bursts with ``command_line``; shells count with part of their
    command's length, follow-ups are the kinds of traces it left, commands are read to 2,000 characters (a fixed value)."""
    command = F.substring(F.coalesce("command_line", F.lit("")), 1, 2000)
    low, image = F.lower(command), F.lower("image")
    length = F.length(command) / F.when(F.endswith(image, F.lit("powershell.exe")) | F.endswith(image, F.lit("pwsh.exe")), 2.0).when(F.endswith(image, F.lit("cmd.exe")), 1.5).otherwise(1.0)
    kinds = (F.col("net_count") > 0).cast("int") + F.col("has_file").cast("int") + F.col("has_reg").cast("int")
    strength = F.when(F.coalesce(S.external_address(F.col("dst_ip")), F.lit(False)) & (F.col("net_count") >= 3), 2).when(F.col("net_count") > 0, 1).otherwise(0)
    account = F.when(F.contains(F.upper(F.coalesce("user", F.lit(""))), F.lit("SYSTEM")), "system").otherwise("interactive") if "user" in b.columns else F.lit("interactive")
    return b.select(
        "burst_id", "image", F.coalesce("parent_image", F.lit("unknown_parent")).alias("parent"), account.alias("account"), F.pmod(F.floor(F.col("start_t") / 3_600_000_000), F.lit(24)).alias("hour"), "exec_count",
        F.sha2(low, 256).alias("command_hash"), length.alias("command_length"), (F.contains(low, F.lit("-enc")) | F.contains(low, F.lit("/enc"))).alias("has_encoded_flag"), S.download_flag(low).alias("has_download_flag"),
        kinds.alias("followups"), strength.alias("network_strength"),
    )


def kill_chain_stage(b: DataFrame) -> DataFrame:
    """Stage by flags, promoted by the codes seen; a later stage always wins."""
    flags = F.when(F.col("has_reg"), "Persistence").when(F.col("exec_count") > 0, "Execution").otherwise("Background")
    net = F.when(F.col("net_count") > 0, "Command and Control").otherwise("Background")
    return b.withColumn("stage", S.promote(flags, net))


def risk(n: str = "n", exec_count: str = "exec_count", net_count: str = "net_count") -> Column:
    """A plain burst risk in 0..100: 2 a event, 5 an execution, 8 a connection, and 20 and 10 for registry and file."""
    raw = 2 * F.col(n) + 5 * F.col(exec_count) + 8 * F.col(net_count) + F.when(F.col("has_reg"), 20).otherwise(0) + F.when(F.col("has_file"), 10).otherwise(0)
    return F.least(F.lit(100), raw).cast("int")


def scored(b: DataFrame) -> DataFrame:
    return kill_chain_stage(b).withColumn("risk", risk())


def shown(b: DataFrame) -> DataFrame:
    """Bursts worth showing: 3 events, a risk of 40, or a stage that matters by itself."""
    return b.filter((F.col("n") >= 3) | (F.col("risk") >= 40) | F.col("stage").isin("Execution", "Persistence", "Privilege Escalation"))


def prioritised(b: DataFrame, limit: int = 50) -> DataFrame:
    p = F.col("risk") + 2 * S.stage_rank(F.col("stage")) + F.when(F.col("has_reg"), 10).otherwise(0) + F.when(F.col("net_count") > 0, 5).otherwise(0)
    return b.withColumn("priority_score", p).orderBy(F.desc("priority_score"), "start_t", "burst_id").limit(limit)


def most_dangerous(b: DataFrame, limit: int = 10) -> DataFrame:
    return b.orderBy(F.desc("peak"), F.desc(S.stage_rank(F.col("stage"))), F.desc("n"), "burst_id").limit(limit)


def sessions(b: DataFrame, gap_seconds: int = 300) -> DataFrame:
    """Bursts of a host and stage that follow each other within the gap, by the running latest end."""
    order = Window.partitionBy("computer", "stage").orderBy("start_t", "burst_id")
    reach = F.max("end_t").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce(F.col("start_t") - reach >= gap_seconds * SECOND, F.lit(True)).cast("int")
    numbered = b.withColumn("__cut", cut).withColumn("session_no", F.sum("__cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("computer", "stage", "session_no").agg(F.min("start_t").alias("start_t"), F.max("end_t").alias("end_t"), F.count("*").alias("bursts"), F.sum("n").alias("events"), F.max("risk").alias("risk"))


def collapsed(b: DataFrame, bucket_seconds: int = 300) -> DataFrame:
    """The best burst of each (parent > image chain, host, stage, time bucket)."""
    chain = F.concat_ws(">", F.coalesce("parent_image", F.lit("unknown")), "image")
    keyed = b.withColumn("chain", chain).withColumn("bucket", F.floor(F.col("start_t") / (bucket_seconds * SECOND)))
    return keyed.groupBy("chain", "computer", "stage", "bucket").agg(F.max_by(F.struct("burst_id", "risk"), F.struct("risk", "burst_id")).alias("x"), F.count("*").alias("merged")).select("chain", "computer", "stage", "bucket", "x.burst_id", "x.risk", "merged")


def hourly(b: DataFrame) -> DataFrame:
    """Burst aggregates for each image, computer and hour of the start."""
    hour = F.floor(F.col("start_t") / (3600 * SECOND))
    top = F.max_by("stage", F.struct(S.stage_rank(F.col("stage")), "stage"))
    return b.withColumn("hour", hour).groupBy("image", "computer", "hour").agg(
        F.sum("n").alias("events"), F.round(F.max("peak"), 6).alias("peak"), F.sum("exec_count").alias("execs"), F.sum("net_count").alias("nets"), F.max("has_reg").alias("any_reg"), top.alias("stage"),
    )


def auto_correlated(b: DataFrame, as_of: Column, by: list[str], least_age_seconds: int = 300) -> DataFrame:
    """Groups with two bursts of two stages, old enough at ``as_of`` (microseconds): strength 20, or 30 from three stages."""
    g = b.groupBy(*by).agg(F.count("*").alias("bursts"), F.count_distinct("stage").alias("stages"), F.min("start_t").alias("first_t"))
    return g.filter((F.col("bursts") >= 2) & (F.col("stages") >= 2) & (as_of - F.col("first_t") >= least_age_seconds * SECOND)).withColumn("strength", F.when(F.col("stages") >= 3, 30).otherwise(20))


def reasons(linked: Column) -> Column:
    return F.array_join(F.array_compact(F.array(F.when(F.col("n") > 10, F.lit("high frequency")), F.when(linked, F.lit("sequence linked")), F.when(S.suspicious_chain(F.col("parent_image")), F.lit("abnormal parent")))), ";")


def _has(text: str, words: list[str]) -> Column:
    return F.coalesce(S.any_of(F.lower(text), words), F.lit(False))


def _kept(name: str) -> Column:
    """The last value with a word of weight in it, else the first value."""
    order = F.struct("t", "event_id")
    strong = F.max_by(name, F.when(_has(name, K.HIGH_SIGNAL), order))
    return F.coalesce(strong, F.min_by(name, F.when(F.col(name).isNotNull(), order)))


def evidence() -> list[Column]:
    """Further measures for ``bursts``: port, targets, the set of codes, and one flag for each family of words in a command, so that
    nothing gathered grows with a burst."""
    code = F.col("event_code")
    families = [F.max(_has("command_line", words) if words else F.lit(False)).alias(f"says_{i}") for i, (words, _, _) in enumerate(K.CONTENT_STAGES)]
    return [
        F.max_by("dst_port", F.when(F.col("dst_port").isNotNull(), F.struct("t", "event_id"))).alias("dst_port"), _kept("file_path").alias("target"), _kept("reg_key").alias("target_key"),
        F.array_sort(F.collect_set(code)).alias("code_set"), F.max(code.isin(8, 25)).alias("has_injection"), *families, F.max(_has("command_line", K.ENCODED_WORDS)).alias("says_encoded"),
    ]


def with_persistence(b: DataFrame) -> DataFrame:
    """Whether a burst (with ``evidence``) persists: a registry write to a key that starts programs or whose target is a program,
    or a file that an execution put among the scheduled ones. Words are looked for in the key as well as in the file."""
    both = F.concat_ws(" ", "target", "target_key")
    runs = reduce(lambda x, y: x | y, [F.coalesce(F.endswith(F.lower("target"), F.lit(e)), F.lit(False)) for e in K.RUNNABLE])
    keys = F.col("has_reg") & (F.coalesce(S.any_of(F.lower(both), K.PERSISTENT_KEYS), F.lit(False)) | runs)
    files = (F.col("exec_count") > 0) & F.col("has_file") & _has("target", K.PERSISTENT_FILES)
    return b.withColumn("has_persistence", keys | files)


def layered_stage(b: DataFrame) -> DataFrame:
    """The stage by four layers, each of which can only raise it: flags, words and codes, ``prior_stage`` and ``detected``.

    ``b``: bursts with ``evidence`` and persistence; the last two columns may be null, and are left out where there are none.
    """
    outside, has = S.external_address(F.col("dst_ip")), lambda codes: F.arrays_overlap("code_set", F.array(*map(F.lit, codes)))
    net, execs = F.col("net_count"), F.col("exec_count") > 0
    outward = (net >= 3) & outside & ((F.col("n") >= 5) | ~execs)
    flags = F.when(F.col("has_injection"), "Privilege Escalation").when(F.col("has_persistence"), "Persistence").when(outward | ((net >= 5) & ~outside), "Command and Control").when(execs, "Execution").otherwise("Background")
    content = F.when(F.lit(False), None)
    for i, (words, codes, stage) in enumerate(K.CONTENT_STAGES):
        said = F.col(f"says_{i}")
        content = content.when(said & has(codes) if words and codes else said if words else has(codes), stage)
    content = content.when(((net > 0) & outside) | has([22]), "Command and Control").when(F.col("says_encoded"), "Execution")
    out = b.withColumn("flag_stage", flags).withColumn("content_stage", content).withColumn("stage", F.col("flag_stage"))
    for layer in ("content_stage", "prior_stage", "detected"):
        if layer in out.columns:
            out = out.withColumn("stage", S.promote(F.col("stage"), F.col(layer)))
    return out


def priority_score(b: DataFrame) -> DataFrame:
    """Risk, twice the stage's rank, and what persists 10, injects 15, is correlated 5, connects 5, is part of a sequence 20."""
    points = {"has_persistence": 10, "has_injection": 15, "correlated": 5, "connects": 5, "in_sequence": 20}
    flagged = b.withColumn("connects", F.col("net_count") > 0)
    score = F.col("risk") + 2 * S.stage_rank(F.col("stage"))
    for name, n in points.items():
        score = score + F.when(F.col(name), n).otherwise(0)
    return flagged.withColumn("priority_score", score).drop("connects")


def in_order(b: DataFrame, by: str = "computer") -> DataFrame:
    """Bursts numbered within ``by`` by risk, stage and number of events; ties by start and id."""
    order = Window.partitionBy(by).orderBy(F.desc("risk"), F.desc(S.stage_rank(F.col("stage"))), F.desc("n"), "start_t", "burst_id")
    return b.withColumn("place", F.row_number().over(order))


def rolled_up(b: DataFrame, run: Column) -> DataFrame:
    """Aggregates of bursts (with ``evidence``) by image, computer, run and hour of the start: totals, peak, all codes, flags."""
    top = F.max_by("stage", F.struct(S.stage_rank(F.col("stage")), "stage"))
    g = b.withColumn("run", run).withColumn("hour", F.floor(F.col("start_t") / (3600 * SECOND))).groupBy("image", "computer", "run", "hour").agg(
        F.count("*").alias("bursts"), F.sum("n").alias("events"), F.max("risk").alias("peak_risk"), F.sum("exec_count").alias("execs"), F.sum("net_count").alias("nets"), F.count_if("has_file").alias("files"), F.count_if("has_reg").alias("regs"),
        F.array_join(F.transform(F.array_sort(F.array_distinct(F.flatten(F.collect_set("code_set")))), lambda c: c.cast("string")), ",").alias("codes"), top.alias("stage"),
    )
    return g


def hints(b: DataFrame, images: DataFrame) -> DataFrame:
    """Why each burst is shown, linked to sequences by image (``images``: the images of found ones), and the stage its computer reached
    where that is later than its own."""
    far = Window.partitionBy("computer")
    top = F.max(F.struct(S.stage_rank(F.col("stage")), "stage")).over(far)["stage"]
    x = b.join(images.select("image").distinct().withColumn("linked", F.lit(True)), "image", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    return x.withColumn("reasons", reasons(F.col("linked"))).withColumn("top", top).withColumn("stage_hint", F.when(S.stage_rank(F.col("top")) > S.stage_rank(F.col("stage")), F.col("top"))).drop("top")
