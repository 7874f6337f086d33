"""Rule detection: field rules, conditions, registry fallback, pattern sets, and how hits are ranked.

Rules are compiled to one array of conditions over an event, so matching is one pass without a join or a shuffle; a rule
list that is long or held in a table goes through ``match_rule_table``, an equi-join on the event code with the
remaining predicates as its condition.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import constants as K
from tidewatch.functions import signals as S
from tidewatch.operators.graph import stored


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    severity: str
    confidence: int
    mitre_id: str
    mitre_tactic: str
    kill_chain_stage: str
    event_id: tuple[int, ...] = ()
    image_contains: str | None = None
    image_any: tuple[str, ...] = ()
    parent_any: tuple[str, ...] = ()
    cmd_any: tuple[str, ...] = ()
    path_prefix_any: tuple[str, ...] = ()
    severity_required: str | None = None
    filter_benign_parent: bool = False
    conditions: tuple[tuple[str, str, object], ...] = field(default=())
    exact_image: bool = False
    parent_child: tuple[tuple[str, str], ...] = ()


RULES = [
    Rule("DET-001", "Encoded shell command", "high", 75, "T1059.001", "Execution", "Execution", (1,), image_contains="powershell", cmd_any=("-enc ", "-encodedcommand", " -e ")),
    Rule("DET-003", "Shell with guards switched off", "medium", 55, "T1059.001", "Execution", "Execution", (1,), image_contains="powershell", cmd_any=("-bypass", "-noprofile"), filter_benign_parent=True),
    Rule("DET-004", "Console under a script engine", "high", 70, "T1059.003", "Execution", "Execution", (3,), image_any=("cmd.exe",), parent_any=("powershell.exe", "certutil.exe")),
    Rule("DET-020", "Run key written", "high", 80, "T1547.001", "Defense Evasion", "Persistence", (12, 13, 14), path_prefix_any=("hklm\\software\\microsoft\\windows\\currentversion\\run",)),
    Rule("DET-031", "Executable dropped in a public folder", "medium", 60, "T1105", "Command and Control", "Command and Control", (11,), path_prefix_any=("c:\\users\\public\\",), severity_required="medium"),
    Rule("DET-040", "Large transfer by a console", "low", 45, "T1041", "Exfiltration", "Exfiltration", (3,), conditions=(("value", ">", 100.0), ("image", "==", "cmd.exe"))),
]
_COMPARE = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def target_path() -> Column:
    return F.coalesce(S.registry_path(F.coalesce("file_path", "reg_key")), F.lit(""))


def _low(name: str) -> Column:
    return F.coalesce(F.lower(name), F.lit(""))


def condition(rule: Rule) -> Column:
    """The rule as one predicate over canonical events with ``severity``; cheap tests first."""
    tests: list[Column] = []
    if rule.event_id:
        tests.append(F.col("event_code").isin(list(rule.event_id)))
    if rule.severity_required:
        tests.append(_low("severity") == rule.severity_required)
    tests += [_COMPARE[op](F.col(name), F.lit(value)) for name, op, value in rule.conditions]
    if rule.image_contains:
        tests.append(F.contains(_low("image"), F.lit(rule.image_contains)))
    if rule.image_any:
        tests.append(_low("image").isin(list(rule.image_any)) if rule.exact_image else S.any_of(_low("image"), list(rule.image_any)))
    if rule.parent_any:
        tests.append(S.any_of(_low("parent_image"), list(rule.parent_any)))
    if rule.parent_child:
        tests.append(reduce(lambda a, b: a | b, [F.contains(_low("parent_image"), F.lit(p)) & F.contains(_low("image"), F.lit(c)) for p, c in rule.parent_child]))
    if rule.filter_benign_parent:
        tests.append(~S.basename(_low("parent_image")).isin(K.BENIGN_PARENTS))
    if rule.cmd_any:
        tests.append(S.any_of(_low("command_line"), list(rule.cmd_any)))
    if rule.path_prefix_any:
        tests.append(reduce(lambda a, b: a | b, [F.startswith(F.col("__path"), F.lit(p)) for p in rule.path_prefix_any]))
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def boosted(confidence: Column) -> Column:
    """+15 for high entropy, then +10 for base64 or an encoded flag, each capped at 100."""
    c = F.least(F.lit(100), confidence + F.when(F.col("is_high_entropy"), 15).otherwise(0))
    return F.least(F.lit(100), c + F.when(F.col("b64_detected") | F.col("has_encoded_flag"), 10).otherwise(0))


def with_signals(events: DataFrame) -> DataFrame:
    cmd = F.col("command_line")
    return events.withColumn("severity", S.severity(F.col("event_code"))).withColumn("entropy", S.entropy(cmd)).withColumns({
        "is_high_entropy": S.high_entropy(cmd, F.col("entropy")), "b64_detected": F.coalesce(cmd.rlike(K.BASE64_RUN), F.lit(False)), "has_encoded_flag": S.encoded_flag(cmd),
    })


def _reasons(rule: Rule) -> Column:
    """What matched, in words and lists."""
    def found(name: str, words: tuple[str, ...]) -> Column:
        return F.array_join(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(_low(name), w)), ", ")

    parts = []
    if rule.image_contains or rule.image_any:
        parts.append(F.concat(F.lit("image "), _low("image")))
    if rule.parent_any:
        parts.append(F.concat(F.lit("parent "), found("parent_image", rule.parent_any)))
    if rule.cmd_any:
        parts.append(F.concat(F.lit("command "), found("command_line", rule.cmd_any)))
    if rule.path_prefix_any:
        parts.append(F.concat(F.lit("path "), F.col("__path")))
    return F.array(*parts) if parts else F.array(F.lit("event code"))


#: Lists of a rule and the columns in which their words are looked for.
LISTS = {"image_contains": "image", "image_any": "image", "parent_any": "parent_image", "cmd_any": "command_line", "path_prefix_any": "__path"}


def _matched(rule: Rule) -> Column:
    """A map from field to the words of the rule that were found there, with the compared values of its conditions."""
    def found(name: str, column: str, words: tuple[str, ...]) -> Column:
        test = (lambda w: F.startswith(F.col(column), w)) if name == "path_prefix_any" else (lambda w: F.contains(_low(column), w))
        return F.struct(F.lit(name).alias("key"), F.filter(F.array(*map(F.lit, words)), test).alias("value"))

    entries = []
    for name, column in LISTS.items():
        words = getattr(rule, name) or ()
        if words:
            entries.append(found(name, column, (words,) if isinstance(words, str) else words))
    for column, op, _ in rule.conditions:
        entries.append(F.struct(F.lit(f"{column} {op}").alias("key"), F.array(F.col(column).cast("string")).alias("value")))
    entries = F.array(*entries) if entries else F.array().cast("array<struct<key:string,value:array<string>>>")
    return F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0))


def match_rules(events: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """One row for each (event, rule) that matches. ``events`` needs the columns of ``with_signals``."""
    hits = [
        F.when(condition(r), F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("rule_severity"), F.lit(r.confidence).alias("base_confidence"),
            F.lit(r.mitre_id).alias("mitre_id"), F.lit(r.mitre_tactic).alias("mitre_tactic"), F.lit(r.kill_chain_stage).alias("kill_chain_stage"), _reasons(r).alias("match_reason"), _matched(r).alias("matched_fields"),
        )) for r in rules
    ]
    found = events.withColumn("__path", target_path()).withColumn("__hit", F.explode(F.array_compact(F.array(*hits))))
    return found.select("*", "__hit.*").drop("__hit", "__path").withColumn("confidence_score", boosted(F.col("base_confidence"))).withColumn("detection_source", F.lit("rule"))


def match_rule_table(events: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for rules held in a table: (rule_id, event_id array, image_any, cmd_any arrays, confidence)."""
    flat = rules.withColumn("rule_code", F.explode("event_id"))
    has = lambda words, text: (F.size(words) == 0) | F.exists(words, lambda w: F.contains(text, F.lower(w)))
    on = (events["event_code"] == flat["rule_code"]) & has(flat["image_any"], F.lower(events["image"])) & has(flat["cmd_any"], F.lower(events["command_line"]))
    return events.join(flat, on)


def registry_fallback(events: DataFrame, hits: DataFrame) -> DataFrame:
    """Persistence keys that no rule caught: the first fallback rule that fits, unless the path is known noise."""
    path = F.col("__path")
    first = F.when(F.lit(False), None)
    for words, rule, technique, confidence, level in K.FALLBACK_RULES:
        first = first.when(S.any_of(path, words), F.struct(F.lit(rule).alias("rule_id"), F.lit(technique).alias("mitre_id"), F.lit(min(confidence, 70)).alias("confidence_score"), F.lit(level).alias("rule_severity")))
    open_events = events.filter(F.col("event_code").isin(12, 13, 14)).join(hits.select("event_uid").distinct(), "event_uid", "left_anti")
    found = open_events.withColumn("__path", target_path()).filter(~S.any_of(path, K.REGISTRY_NOISE)).withColumn("__hit", first).filter("__hit is not null")
    return found.select("*", "__hit.*").drop("__hit", "__path").withColumn("detection_source", F.lit("fallback"))


def pattern_scan(rows: DataFrame, text: Column, patterns: dict[str, str]) -> DataFrame:
    """Named patterns over a text: the names that match, and the score 20 a hit (+20 from three on, 100 at most)."""
    names = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()]))
    hits = F.size("yara_names")
    return rows.withColumn("yara_names", names).withColumn("yara_hits", hits).withColumn("yara_score", F.least(F.lit(100), hits * 20 + F.when(hits >= 3, 20).otherwise(0)))


def pattern_sets(events: DataFrame, sets: dict[str, list[list[str]]], fields: list[str]) -> DataFrame:
    """Named sets of pattern groups over several fields at once: a set matches if each of its groups has a pattern that does.

    Adds the names, their score (as in ``pattern_scan``), and the severity raised: medium on a hit, high from a score of 60.
    """
    text = F.lower(F.concat_ws(" ", *fields))
    names = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [text.rlike(p) for p in group]) for group in groups]), F.lit(name)) for name, groups in sets.items()]))
    hits = F.size("set_names")
    out = events.withColumn("set_names", names).withColumn("set_score", F.least(F.lit(100), hits * 20 + F.when(hits >= 3, 20).otherwise(0)))
    level = F.when(F.col("set_score") >= 60, "high").when((hits > 0) & (F.col("severity") == "low"), "medium").otherwise(F.col("severity"))
    return out.withColumn("severity", level)


def set_detections(scanned: DataFrame) -> DataFrame:
    """One detection for each set that ``pattern_sets`` found in an event."""
    found = scanned.withColumn("rule_id", F.explode("set_names"))
    return found.withColumn("confidence_score", F.col("set_score")).withColumn("detection_source", F.lit("pattern")).drop("set_names")


def signal_strength(confidence: Column, source: Column, level: Column) -> Column:
    return 0.6 * confidence / 100 + 0.2 * S.lookup(source, K.SOURCE_WEIGHT, 0.5) + 0.2 * S.lookup(level, K.SEVERITY_BASE, 0.3)


def primary_detection(hits: DataFrame, by: list[str]) -> DataFrame:
    """The strongest hit of each group, with the count and the best confidence of those that support it."""
    strength = signal_strength(F.col("confidence_score"), F.col("detection_source"), F.col("rule_severity"))
    key = F.struct(F.round(strength, 9), S.lookup(F.col("rule_severity"), K.SEVERITY_RANK, 0), F.col("confidence_score"), F.col("rule_id"), F.col("event_uid"))
    value = F.struct("rule_id", "event_uid", "confidence_score", "rule_severity", F.round(strength, 6).alias("strength"))
    return hits.groupBy(*by).agg(F.max_by(value, key).alias("p"), F.count("*").alias("supporting"), F.max("confidence_score").alias("supporting_max_conf")).select(*by, "p.*", "supporting", "supporting_max_conf")


def kill_chain_rollup(hits: DataFrame, by: list[str]) -> DataFrame:
    stage = F.col("kill_chain_stage")
    return hits.groupBy(*by).agg(F.collect_set(F.struct(S.stage_rank(stage).alias("r"), stage.alias("s"))).alias("x")).select(
        *by, F.array_join(F.transform(F.array_sort("x"), lambda y: y["s"]), " > ").alias("stages"), F.element_at(F.array_sort("x"), -1)["s"].alias("highest_stage"))


def rule_summary(hits: DataFrame) -> DataFrame:
    return hits.filter("image is not null").groupBy("rule_id", "image", "mitre_id").agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.count("*").alias("n"), F.count_distinct("parent_image").alias("parents"))


def _sides(bursts: DataFrame, hits: DataFrame, seconds: int) -> tuple[DataFrame, DataFrame, DataFrame, Column]:
    """Hits and bursts as ``detections_for_bursts`` compares them, their pairs by pid and time, and the points of a pair."""
    h = hits.select("computer", F.col("pid").alias("d_pid"), F.col("image").alias("d_image"), F.col("parent_image").alias("d_parent"), F.substring("command_line", 1, 50).alias("d_cmd"), F.col("t").alias("d_t"), F.col("event_uid").alias("d_uid"), F.col("rule_id").alias("d_rule"))
    both = bursts if "rule_id" in bursts.columns else bursts.withColumn("rule_id", F.lit(None).cast("string"))
    both = both if "command_line" in both.columns else both.withColumn("command_line", F.lit(None).cast("string"))
    slack, width = seconds * 1_000_000, 900_000_000
    slots = F.explode(F.sequence(F.floor((F.col("start_t") - slack) / width), F.floor((F.col("end_t") + slack) / width)))
    by_pid = both.withColumn("slot", slots).join(h.withColumns({"slot": F.floor(F.col("d_t") / width), "pid": F.col("d_pid")}), ["computer", "pid", "slot"]).filter(F.col("d_t").between(F.col("start_t") - slack, F.col("end_t") + slack)).drop("slot")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    points = F.when(same("rule_id", "d_rule"), 3).otherwise(0) + F.when(same("parent_image", "d_parent"), 2).otherwise(0) + F.when(same("image", "d_image"), 2).otherwise(0) + F.when(F.substring("command_line", 1, 50) == F.col("d_cmd"), 1).otherwise(0)
    return h, both, by_pid, points


def detections_for_bursts(bursts: DataFrame, hits: DataFrame, seconds: int = 5) -> DataFrame:
    """Hits that belong to a burst of the same computer: same pid within the slack, or at least 5 points of likeness.

    Likeness: rule 3 (the burst's ``rule_id``, where it has one), parent 2, image 2, first 50 letters of the command 1. Five
    points need the rule and one of the others but for all of parent, image and command; so both ways are equi-joins.
    """
    h, both, by_pid, points = _sides(bursts, hits, seconds)
    keyed = both.withColumn("cmd", F.substring("command_line", 1, 50))
    copy = lambda **names: h.withColumns({k: F.col(v) for k, v in names.items()})
    by_rule = both.join(copy(rule_id="d_rule", image="d_image"), ["computer", "rule_id", "image"]).filter(points >= 5)
    by_rule = by_rule.unionByName(both.join(copy(rule_id="d_rule", parent_image="d_parent"), ["computer", "rule_id", "parent_image"]).filter(points >= 5))
    by_all = keyed.join(copy(image="d_image", parent_image="d_parent", cmd="d_cmd"), ["computer", "image", "parent_image", "cmd"]).drop("cmd")
    return by_pid.unionByName(by_rule).unionByName(by_all).dropDuplicates(["burst_id", "d_uid", "d_rule"])


def detection_counts(bursts: DataFrame, hits: DataFrame, seconds: int = 5) -> DataFrame:
    """(burst_id, detections, rules): the rows of ``detections_for_bursts`` counted, without listing those that are alike.

    Like hits are numbers of groups: those of the burst's rule with its image, and with its parent, less those with both, and those of
    other rules with its image, parent and command. What is listed is what only pid and time join, a few pairs a hit. Hits whose event
    and rule stand in several different rows are listed in full, as they count once. Bursts and hits are stored tables, as each is read often.
    """
    alike = ["computer", "pid", "image", "parent_image", "command_line", "t", "event_uid", "rule_id"]
    once = F.count("*").over(Window.partitionBy("event_uid", "rule_id"))
    marked = stored(hits.select(*alike).withColumn("command_line", F.substring("command_line", 1, 50)).distinct().withColumn("__rows", once))
    bursts = stored(bursts)
    _, both, by_pid, points = _sides(bursts, marked.filter("__rows = 1"), seconds)
    cell = ["computer", "rule_id", "image", "parent_image"]
    cells = marked.filter("__rows = 1").groupBy(*cell, F.col("command_line").alias("cmd")).agg(F.count("*").alias("n"))
    own = both.select("burst_id", *cell)
    for i, key in enumerate((["image"], ["parent_image"], ["image", "parent_image"])):
        key = ["computer", "rule_id", *key]
        own = own.join(cells.dropna(subset=key).groupBy(*key).agg(F.sum("n").alias(f"n{i}")), key, "left")
    number = [F.coalesce(f"n{i}", F.lit(0)) for i in range(3)]
    parts = [
        own.select("burst_id", F.col("rule_id").alias("d_rule"), (number[0] + number[1] - number[2]).alias("n")).filter("n > 0"),
        by_pid.filter(points < 5).select("burst_id", "d_rule", F.lit(1).cast("long").alias("n")),
        detections_for_bursts(bursts, marked.filter("__rows > 1"), seconds).select("burst_id", "d_rule", F.lit(1).cast("long").alias("n")),
    ]
    if "command_line" in bursts.columns:
        others = cells.groupBy("computer", "image", "parent_image", "cmd", F.col("rule_id").alias("d_rule")).agg(F.sum("n").alias("n"))
        like = both.withColumn("cmd", F.substring("command_line", 1, 50)).join(others, ["computer", "image", "parent_image", "cmd"]).filter(~F.col("rule_id").eqNullSafe(F.col("d_rule")))
        parts.append(like.select("burst_id", "d_rule", "n"))
    each = reduce(DataFrame.unionByName, parts).groupBy("burst_id", "d_rule").agg(F.sum("n").alias("n"))
    return each.groupBy("burst_id").agg(F.sum("n").alias("detections"), F.count("d_rule").alias("rules"))


def heuristic_detections(events: DataFrame) -> DataFrame:
    """What the event code alone says, for runs without rules: ``HEUR-n`` with confidence 40."""
    told = F.create_map(*[x for code, (m, tactic, stage, text) in K.HEURISTICS.items() for x in (F.lit(code), F.struct(F.lit(m).alias("mitre_id"), F.lit(tactic).alias("mitre_tactic"), F.lit(stage).alias("kill_chain_stage"), F.lit(text).alias("description")))])
    found = events.filter(F.col("event_code").isin(list(K.HEURISTICS))).withColumn("__h", told[F.col("event_code")])
    return found.select("*", "__h.*", F.concat(F.lit("HEUR-"), F.col("event_code").cast("string")).alias("rule_id"), F.lit(40).alias("confidence_score"), F.lit("heuristic").alias("detection_source")).drop("__h")


def all_detections(hits: DataFrame, chains: DataFrame, others: list[DataFrame] = ()) -> DataFrame:
    """Rule hits, sequences and further detections in one schema; a sequence stands at its last event."""
    columns = ["detection_source", "rule_id", "computer", "event_uid", "t", "kill_chain_stage", "confidence_score", "severity"]
    rules = hits.select("detection_source", "rule_id", "computer", "event_uid", "t", "kill_chain_stage", "confidence_score", F.col("rule_severity").alias("severity"))
    found = chains.select(F.lit("sequence").alias("detection_source"), F.col("pattern_id").alias("rule_id"), "computer", F.col("last_uid").alias("event_uid"), F.col("last_t").alias("t"), F.col("stage").alias("kill_chain_stage"), F.col("confidence").alias("confidence_score"), "severity")
    out = rules.unionByName(found)
    for more in others:
        out = out.unionByName(more.select(*columns))
    return out


def host_floor(hits: DataFrame, small: int = 10_000, large: int = 50_000) -> DataFrame:
    """The adaptive score floor by a host's total of events: 40, 45 above ``small``, 50 above ``large``."""
    n = F.sum("n").over(Window.partitionBy("computer"))
    return hits.withColumn("host_total", n).withColumn("floor", F.when(n > large, 50).when(n > small, 45).otherwise(40))
