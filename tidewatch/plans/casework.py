"""Registered queries: detections of all sources, full anomaly scores, cases and their histories, with the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.functions import signals as S
from tidewatch.operators import casework as W
from tidewatch.operators import graph as G
from tidewatch.operators import profiles as N
from tidewatch.operators import report as A
from tidewatch.operators import rules as R
from tidewatch.operators import scoring as C
from tidewatch.operators import sequences as Q
from tidewatch.operators.baseline import ENTITY, statistics
from tidewatch.plans import behaviour as P
from tidewatch.plans import response as X
from tidewatch.plans.detection import EXTERNAL, HITS, RANKS, SPLIT_T, hits
from tidewatch.sources.telemetry import SQL as TELE
from tidewatch.sources.telemetry import telemetry

WEEK = 604_800_000_000
STATES = ["INGESTED", "ANALYZING", "COMPLETE", "DEGRADED", "FAILED"]
OPTIONS = [*K.VERDICTS, "Other"]


def _element(values: list[str], place) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (place + 1).cast("int"))


def heuristic_detections(spark, d):
    return R.heuristic_detections(telemetry(spark, d)).select("event_uid", "rule_id", "mitre_id", "mitre_tactic", "kill_chain_stage", "description", "confidence_score")


def all_detections(spark, d):
    return R.all_detections(hits(spark, d), Q.detect(telemetry(spark, d)))


def builtin_sequences(spark, d):
    return Q.detect(telemetry(spark, d), Q.BUILT_IN).select("pattern_id", "stage", "computer", "first_uid", "last_uid", "first_t", "last_t", "matched", "confidence", "severity")


def chain_dedup(spark, d):
    return W.chain_dedup(Q.detect(telemetry(spark, d))).select("pattern_id", "computer", "stage", "step", "first_uid", "merged")


def recent_shells(spark, d):
    """Of the newest 100 events those of a shell, 20 at most: the limit comes before the filter."""
    newest = telemetry(spark, d).orderBy(F.desc("t"), F.desc("event_id")).limit(100)
    return newest.filter(F.lower("image").rlike("powershell|cmd|wscript|cscript|bash|mshta|rundll32|regsvr32|certutil")).orderBy(F.desc("t"), F.desc("event_id")).limit(20).select("event_uid", "image", "t")


def _anomalies(spark, d):
    e = G.stored(N.with_keys(telemetry(spark, d)))  # read four times
    return N.anomaly_scores(e.filter(F.col("t") >= SPLIT_T), e.filter(F.col("t") < SPLIT_T)), e


def anomaly_scores(spark, d):
    return _anomalies(spark, d)[0].drop("observed")


def learning_gate(spark, d):
    """How many events of each host may shape its profile, and how many the throttle of ten lets through."""
    scores, e = _anomalies(spark, d)
    x = scores.join(A.with_mitre(e).select("event_uid", "event_code", "entropy", "command_line", "dst_ip", F.col("kill_chain_stage").alias("stage"), F.least(F.lit(100.0), "value").alias("risk")), "event_uid")
    gated = N.learning_gate(x)
    taught = N.throttled(gated, 10).groupBy("computer").agg(F.count("*").alias("taught"), F.round(F.max("deviation"), 6).alias("worst"))
    return gated.groupBy("computer").agg(F.count_if("learn").alias("learn"), F.count("*").alias("n")).join(taught, "computer", "left")


def hourly_deviation(spark, d):
    f = N.daily_features(telemetry(spark, d))
    day = SPLIT_T // N.DAY
    return N.hourly_deviation(f.filter(F.col("day") >= day), f.filter(F.col("day") < day)).select("computer", "image", "parent", "hour", "day", "deviation", "basis")


def _deviating(spark, d):
    """Host bursts with a stand-in user and deviation, so that all caps have something to do."""
    return P.host_bursts(spark, d).withColumn("user", F.when(F.col("n") % 3 == 0, "NT AUTHORITY\\SYSTEM").otherwise("u")).withColumn("deviation", F.col("n") / 10)


def suppressed_bursts(spark, d):
    return W.suppressed(_deviating(spark, d)).select("burst_id", "risk", "suppression")


def kept_bursts(spark, d):
    return W.worth_keeping(W.suppressed(_deviating(spark, d))).select("burst_id", "risk", "stage")


def classified_bursts(spark, d):
    b = R.host_floor(P.host_bursts(spark, d), 400, 520)
    return W.classified(b).select("burst_id", "floor", "severity", "classification", "never_learn")


def tagged_events(spark, d):
    e = A.with_mitre(telemetry(spark, d))
    members = G.members(e)
    return G.tagged(e.select("event_id", "computer"), G.campaigns(e, G.edge_sums(e), members), members)


def cross_run_campaigns(spark, d):
    b = P.host_bursts(spark, d).withColumn("run", F.floor(F.col("start_t") / WEEK))
    runs = b.groupBy("computer", "run").agg(F.max("risk").alias("confidence"), F.max_by("stage", F.struct(S.stage_rank(F.col("stage")), "stage")).alias("stage"), F.min("start_t").alias("first_t"), F.max("end_t").alias("last_t"))
    return W.cross_run(runs, "computer", "run")


def tree_order(spark, d):
    links = G.parent_links(telemetry(spark, d))
    return W.pre_order(G.tree_depths(links), links)


def score_ledger(spark, d):
    return W.ledger(X._scores(spark, d))


def verdict_checks(spark, d):
    e = telemetry(spark, d)
    asked = e.select("event_uid", _element(OPTIONS, F.col("k") % len(OPTIONS)).alias("verdict"), F.when(F.col("k") % 3 == 0, "short").otherwise(F.concat(F.lit("reason number "), F.col("k").cast("string"))).alias("reason"))
    return W.verdict_checks(asked)


def run_history(spark, d):
    changes = telemetry(spark, d).filter("event_code = 22").select(F.col("computer").alias("run_id"), _element(STATES, F.col("k") % 5).alias("state"), "t", "event_id")
    return W.state_history(changes, K.RUN_STEPS).select("event_id", "run_id", "before", "state", "accepted", "lasted")


def audit_rows(spark, d):
    return W.audit_rows(X.transitions(spark, d), F.lit("analyst"))


def narrative(spark, d):
    return W.narrative(X._scores(spark, d), Q.detect(telemetry(spark, d)))


def evidence_tags(spark, d):
    tags = telemetry(spark, d).filter("event_code = 11").select(F.col("computer").alias("incident_id"), F.col("user").alias("subject"), "t", F.concat(F.lit("tag "), F.col("event_uid")).alias("tag"))
    return W.evidence(tags.filter(F.col("t") < SPLIT_T), tags.filter(F.col("t") >= SPLIT_T), ["incident_id", "subject"])


def newest_incidents(spark, d):
    g = hits(spark, d).groupBy("computer", "rule_id").agg(F.min("t").alias("created_t"), F.max("confidence_score").alias("confidence"))
    return g.orderBy(F.desc("created_t"), "computer", "rule_id").limit(500)


def schema_problems(spark, d):
    return W.schema_problems(spark.read.parquet(f"{d}/documents.parquet"), {"doc_id": "bigint", "text": "string", "lang": "string", "n_chars": "string", "author": "string"})


def pruned_profiles(spark, d):
    return N.pruned(statistics(telemetry(spark, d), ENTITY).select(*ENTITY, "n"), 10, 150, 20)


def forced_samples(spark, d):
    verdict = _element(["False Positive", "Benign", "True Positive", "Undecided"], F.col("k") % 4)
    last = telemetry(spark, d).groupBy("computer", "image").agg(F.max_by(F.struct(verdict.alias("verdict"), "value"), F.struct("t", "event_id")).alias("x")).select("computer", "image", "x.*")
    return N.forced_samples(last)


def incident_priorities(spark, d):
    """Incidents by priority and status of their deadline."""
    g = C.sla_status(newest_incidents(spark, d).withColumn("priority", C.priority(F.col("confidence"))), X.AS_OF)
    return g.groupBy("priority", "sla").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    heuristic_detections, all_detections, builtin_sequences, chain_dedup, recent_shells, anomaly_scores, learning_gate, hourly_deviation, suppressed_bursts, kept_bursts, classified_bursts, tagged_events, cross_run_campaigns,
    tree_order, score_ledger, verdict_checks, run_history, audit_rows, narrative, evidence_tags, newest_incidents, schema_problems, pruned_profiles, forced_samples, incident_priorities,
)}

_HITS_CTE = HITS[HITS.index(", sig AS") :]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_SHARE = "(length(command_line) - length(replace(command_line, ch, '')))::DOUBLE / length(command_line)"
_KEYS = {"p": "parent_image", "h": "hour", "i": "dst_ip", "u": "subnet", "b": "two", "r": "three"}
ANOMALY = TELE + P.GRAND + f""",
  ky AS (SELECT *, (t // 3600000000) % 24 AS hour, regexp_extract(dst_ip, '^(\\d+\\.\\d+\\.\\d+)', 1) AS subnet, coalesce(parent_image, 'unknown') || '>' || image AS two, CASE WHEN gp IS NOT NULL THEN gp || '>' || coalesce(parent_image, 'unknown') || '>' || image END AS three,
    round_even(list_sum(list_transform(list_distinct(string_split(command_line, '')), lambda ch: -({_SHARE}) * log2({_SHARE}))), 3) AS entropy FROM kx),
  old AS (SELECT * FROM ky WHERE t < {SPLIT_T}), cur AS (SELECT * FROM ky WHERE t >= {SPLIT_T}),
  vs AS (SELECT computer, image, count(value) AS n, avg(value) AS mean, var_pop(value) * count(value) AS m2, count(entropy) AS en, avg(entropy) AS em, var_pop(entropy) * count(entropy) AS em2 FROM old GROUP BY ALL),
""".replace("\\\\", "\\") + ",\n".join(f"{a}c AS (SELECT computer, image, {c}, count(*) AS c FROM old WHERE {c} IS NOT NULL GROUP BY ALL), {a}t AS (SELECT computer, image, sum(c) AS total FROM {a}c GROUP BY ALL)" for a, c in _KEYS.items()) + """,
  dx AS (SELECT cur.*, coalesce(n, 0) AS n, mean, m2, coalesce(en, 0) AS en, em, em2, """ + ", ".join(f"coalesce({a}t.total, 0) AS {a}_t, 1 - coalesce({a}c.c / {a}t.total, 0) AS {a}_r" for a in _KEYS) + """
    FROM cur LEFT JOIN vs USING (computer, image) """ + " ".join(f"LEFT JOIN {a}t USING (computer, image) LEFT JOIN {a}c USING (computer, image, {c})" for a, c in _KEYS.items()) + f"""),
  dy AS (SELECT *, CASE WHEN n = 0 THEN 0.25::DOUBLE WHEN n < 10 THEN 0.3 ELSE least(1.0, greatest(0.2, abs((value - mean) / greatest(0.1, sqrt(m2 / greatest(n - 1, 1)))) / 3)) END AS f0,
    (CASE WHEN p_t < 5 THEN 0.10::DOUBLE ELSE p_r * CASE WHEN parent_image IN ({", ".join(f"'{x}'" for x in K.BENIGN_PARENTS)}) THEN 0.5 ELSE 1.0 END END) AS p,
    (least(1.0::DOUBLE, greatest(CASE WHEN b_t >= 10 THEN b_r ELSE 0.10::DOUBLE END, CASE WHEN three IS NOT NULL AND r_t >= 10 THEN 1.3::DOUBLE * r_r ELSE 0.0 END))) AS s,
    (least(1.0::DOUBLE, 0.40::DOUBLE * CASE WHEN en >= 5 THEN least(1.0::DOUBLE, abs((entropy - em) / greatest(0.1::DOUBLE, sqrt(em2 / greatest(en - 1, 1)))) / 2) ELSE 0.10 END + 0.30::DOUBLE * CASE WHEN contains(lower(command_line), '-enc ') OR contains(lower(command_line), ' -e ') THEN 0.8::DOUBLE ELSE 0.0 END
      + 0.15::DOUBLE * CASE WHEN length(command_line) > 500 THEN 0.6::DOUBLE WHEN length(command_line) > 200 THEN 0.3 ELSE 0.0 END
      + 0.15::DOUBLE * least(3.0::DOUBLE * (length(command_line) - length(regexp_replace(command_line, '{K.SPECIAL_CHARACTERS.replace("'", "''")}', '', 'g'))) / greatest(length(command_line), 1), 1.0::DOUBLE))) AS e,
    (CASE WHEN h_t < 10 THEN 0.05::DOUBLE ELSE h_r END) AS h, (CASE WHEN dst_ip IS NULL THEN 0.05::DOUBLE ELSE greatest(CASE WHEN i_t >= 5 THEN i_r ELSE 0.15::DOUBLE END, CASE WHEN u_t >= 5 THEN 0.7::DOUBLE * u_r ELSE 0.10 END) END) AS i FROM dx),
  dz AS (SELECT *, ((floor(e * 1e6 + 0.500001) / 1e6 > 0.6)::INT + (floor(s * 1e6 + 0.500001) / 1e6 > 0.7)::INT + (floor(i * 1e6 + 0.500001) / 1e6 > 0.7)::INT + (event_code IN (12, 13, 14))::INT + (event_code = 8)::INT >= 2) AND value <= 5 AS slow FROM dy), dw AS (SELECT *, CASE WHEN slow THEN greatest(f0, 0.4::DOUBLE) ELSE f0 END AS f FROM dz),
  dv AS (SELECT *, 0.25::DOUBLE * f + 0.15::DOUBLE * p + 0.15::DOUBLE * s + 0.20::DOUBLE * e + 0.10::DOUBLE * h + 0.15::DOUBLE * i + CASE WHEN slow THEN 0.20::DOUBLE ELSE 0.0 END AS raw FROM dw),
  du AS (SELECT *, (CASE WHEN n = 0 THEN 0.25::DOUBLE ELSE least(1.0::DOUBLE, CASE WHEN n < 15 THEN greatest(0.2::DOUBLE, 0.75::DOUBLE * raw) ELSE raw END) END) AS deviation_whole, greatest(f, p, s, e, h, i) AS top, (0.0 + f + p + s + e + h + i) / 6 AS avg6 FROM dv),
  an AS (SELECT * EXCLUDE (f, p, s, e, h, i), floor(f * 1e6 + 0.500001) / 1e6 AS f, floor(p * 1e6 + 0.500001) / 1e6 AS p, floor(s * 1e6 + 0.500001) / 1e6 AS s, floor(e * 1e6 + 0.500001) / 1e6 AS e, floor(h * 1e6 + 0.500001) / 1e6 AS h, floor(i * 1e6 + 0.500001) / 1e6 AS i, floor(deviation_whole * 1e6 + 0.500001) / 1e6 AS deviation, floor(greatest(0.7::DOUBLE * top + 0.3::DOUBLE * avg6, 0.85::DOUBLE * top, 0.8::DOUBLE * deviation_whole) * 1e6 + 0.500001) / 1e6 AS behavior,
    concat_ws(',', CASE WHEN floor(f * 1e6 + 0.500001) / 1e6 > 0.6 THEN 'frequency' END, CASE WHEN floor(p * 1e6 + 0.500001) / 1e6 > 0.6 THEN 'parent' END, CASE WHEN floor(s * 1e6 + 0.500001) / 1e6 > 0.7 THEN 'transition' END, CASE WHEN floor(e * 1e6 + 0.500001) / 1e6 > 0.6 THEN 'entropy' END, CASE WHEN floor(h * 1e6 + 0.500001) / 1e6 > 0.7 THEN 'hour' END, CASE WHEN floor(i * 1e6 + 0.500001) / 1e6 > 0.7 THEN 'destination' END, CASE WHEN slow THEN 'slow' END) AS anomalies FROM du)"""
_GATE = ANOMALY + f""", {P._STAGES}, ag AS (SELECT an.*, kill_chain_stage AS stage, least(100.0::DOUBLE, value) AS risk FROM an JOIN stg USING (event_code)),
  gt AS (SELECT *, risk <= 40 AND lower(image) NOT IN ({", ".join(f"'{x}'" for x in K.NEVER_LEARN)}) AND ((n < 15 AND deviation < 0.15 AND behavior < 0.3) OR (deviation < 0.2 AND behavior < 0.4 AND event_code NOT IN (8, 12, 13, 14) AND entropy <= 4.0
    AND NOT (contains(lower(command_line), '-enc ') OR contains(lower(command_line), ' -e ')) AND s <= 0.7 AND NOT {EXTERNAL.format('dst_ip')} AND stage IN ('Execution', 'Background'))) AS learn FROM ag)"""
_FEATURES = TELE + f""", ft AS (SELECT computer, image, coalesce(parent_image, '') AS parent, (t // 3600000000) % 24 AS hour, t // 86400000000 AS day, count(*) AS exec_count, avg(length(command_line)) AS command_length, count(*) FILTER (event_code IN (3, 11, 13)) AS followups,
  max(CASE WHEN {EXTERNAL.format('dst_ip')} THEN 2 WHEN dst_ip IS NOT NULL THEN 1 ELSE 0 END) AS ns FROM tele GROUP BY ALL)"""
_PROFILE = "SELECT {0}, count(*) AS days, avg(exec_count) AS mean, var_pop(exec_count) * count(*) AS m2, avg(command_length) AS length, avg(followups) AS follow FROM ft WHERE day < {1} GROUP BY ALL"
_DAY = SPLIT_T // 86_400_000_000
_SUPPRESSED = P.HOST + f""", dvb AS (SELECT *, CASE WHEN n % 3 = 0 THEN 'NT AUTHORITY\\SYSTEM' ELSE 'u' END AS usr, n / 10 AS deviation, {EXTERNAL.format('dst_ip')} AS ext FROM st),
  sp0 AS (SELECT *, CASE WHEN contains(upper(usr), 'SYSTEM') AND deviation < 0.3 AND NOT (ext OR has_reg) THEN 'system' WHEN lower(image) IN ({", ".join(f"'{x}'" for x in K.KNOWN_BENIGN)}) AND deviation < 0.4 AND stage IN ('Background', 'Execution') THEN 'benign image'
    WHEN lower(coalesce(parent_image, '')) IN ({", ".join(f"'{x}'" for x in K.KNOWN_BENIGN_PARENTS)}) AND NOT ext AND deviation < 0.5 THEN 'benign parent' END AS suppression FROM dvb),
  spd AS (SELECT burst_id, n, stage, suppression, least(risk, CASE suppression WHEN 'system' THEN 15 WHEN 'benign image' THEN 20 WHEN 'benign parent' THEN 25 ELSE 100 END) AS risk FROM sp0)"""
_TREE = P.SQL["process_tree"]
SQL = {
    "heuristic_detections": TELE + f", he(event_code, mitre_id, mitre_tactic, kill_chain_stage, description) AS (VALUES {_values((c, *v) for c, v in K.HEURISTICS.items())}) SELECT event_uid, 'HEUR-' || event_code AS rule_id, mitre_id, mitre_tactic, kill_chain_stage, description, 40 AS confidence_score FROM tele JOIN he USING (event_code)",
    "all_detections": P.SEQ + _HITS_CTE + """SELECT detection_source, rule_id, computer, event_uid, t, kill_chain_stage, confidence_score, rule_severity AS severity FROM hits
      UNION ALL SELECT 'sequence', pattern_id, computer, last_uid, last_t, stage, confidence, severity FROM sq""",
    "builtin_sequences": TELE + ", " + P._sequence_sql(Q.BUILT_IN) + "SELECT * FROM sq",
    "chain_dedup": P.SEQ + """, cd AS (SELECT *, (confidence // 5) * 5 AS step FROM sq WHERE confidence > 0) SELECT pattern_id, computer, stage, step, first_uid, count(*) OVER w2 AS merged FROM cd
      WINDOW w2 AS (PARTITION BY pattern_id, computer, stage, step) QUALIFY row_number() OVER (PARTITION BY pattern_id, computer, stage, step ORDER BY first_t, last_t, first_uid, matched) = 1""",
    "recent_shells": TELE + "SELECT event_uid, image, t FROM (SELECT * FROM tele ORDER BY t DESC, event_id DESC LIMIT 100) WHERE regexp_matches(image, 'powershell|cmd|wscript|cscript|bash|mshta|rundll32|regsvr32|certutil') ORDER BY t DESC, event_id DESC LIMIT 20",
    "anomaly_scores": ANOMALY + "SELECT event_uid, computer, image, f, p, s, e, h, i, slow, deviation, behavior, anomalies FROM an",
    "learning_gate": _GATE + """, th AS (SELECT computer, deviation FROM gt WHERE learn QUALIFY row_number() OVER (PARTITION BY computer ORDER BY deviation, event_uid) <= 10), tg AS (SELECT computer, count(*) AS taught, round(max(deviation), 6) AS worst FROM th GROUP BY 1)
      SELECT computer, learn, n, taught, worst FROM (SELECT computer, count(*) FILTER (learn) AS learn, count(*) AS n FROM gt GROUP BY 1) LEFT JOIN tg USING (computer)""",
    "hourly_deviation": _FEATURES + f""", own AS ({_PROFILE.format('computer, image, parent, hour', _DAY)}), wide AS ({_PROFILE.format('computer, image, hour', _DAY)}),
      fj AS (SELECT f.*, own.days IS NOT NULL AS has_own, coalesce(own.days, wide.days) AS days, coalesce(own.mean, wide.mean) AS mean, coalesce(own.m2, wide.m2) AS m2, greatest(coalesce(own.length, wide.length), 1.0) AS len, coalesce(own.follow, wide.follow) AS follow
        FROM ft f LEFT JOIN own USING (computer, image, parent, hour) LEFT JOIN wide USING (computer, image, hour) WHERE f.day >= {_DAY}),
      fk AS (SELECT *, least(1.0::DOUBLE, (0.30::DOUBLE * least(3.0::DOUBLE, abs((exec_count - mean) / greatest(1.0::DOUBLE, sqrt(CASE WHEN days > 1 THEN m2 / (days - 1) ELSE 0.0 END)))) + 0.25::DOUBLE * least(3.0::DOUBLE, abs((command_length - len) / len)) + 0.20::DOUBLE * CASE WHEN followups >= follow + 2 THEN 1 ELSE 0 END
        + 0.15::DOUBLE * CASE ns WHEN 2 THEN 1.0::DOUBLE WHEN 1 THEN 0.5 ELSE 0.0 END) / 3) AS known FROM fj)
      SELECT computer, image, parent, hour, day, round(CASE WHEN days IS NULL THEN 0.40::DOUBLE WHEN days < 5 THEN 0.25 WHEN exec_count < greatest(5.0, mean) THEN 0.1 WHEN days < 20 THEN least(0.4::DOUBLE, known) ELSE known END, 6) AS deviation, CASE WHEN has_own THEN 'parent' WHEN days IS NOT NULL THEN 'any parent' ELSE 'none' END AS basis FROM fk""",
    "suppressed_bursts": _SUPPRESSED + "SELECT burst_id, risk, suppression FROM spd",
    "kept_bursts": _SUPPRESSED + "SELECT burst_id, risk, stage FROM spd WHERE risk >= 45 OR stage IN ('Persistence', 'Privilege Escalation') OR n >= 5",
    "classified_bursts": P.HOST + f""", fl AS (SELECT *, CASE WHEN sum(n) OVER (PARTITION BY computer) > 520 THEN 50 WHEN sum(n) OVER (PARTITION BY computer) > 400 THEN 45 ELSE 40 END AS floor FROM st)
      SELECT burst_id, floor, CASE WHEN stage IN ({", ".join(f"'{x}'" for x in K.HIGH_STAGES)}) OR risk >= 60 THEN 'high' WHEN risk >= 40 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN risk >= least(60, floor) OR has_reg THEN 'attack_candidate' ELSE 'background_activity' END AS classification, risk >= 80 AS never_learn FROM fl""",
    "tagged_events": P.SQL["campaigns"].rsplit("SELECT component, computer", 1)[0] + "SELECT e.event_id, e.computer, c.component AS campaign_id, c.score AS campaign_score FROM sx e LEFT JOIN cp ON cp.node = e.event_id LEFT JOIN cs c ON c.component = cp.component",
    "cross_run_campaigns": P.HOST + f""", rn AS (SELECT computer, start_t // {WEEK} AS run, max(risk) AS confidence, arg_max(stage, rank) AS stage, max(rank) AS rank, min(start_t) AS first_t, max(end_t) AS last_t FROM st GROUP BY 1, 2)
      SELECT computer, count(DISTINCT run) AS runs, count(*) AS campaigns, min(first_t) AS first_t, max(last_t) AS last_t, max(confidence) AS confidence, arg_max(stage, rank) AS stage FROM rn GROUP BY 1""",
    "tree_order": _TREE[: _TREE.index("tr AS (")] + """tr AS (SELECT p.event_id, p.event_id AS root_id, 0::BIGINT AS depth, lpad(t::VARCHAR, 20, '0') || lpad(p.event_id::VARCHAR, 20, '0') AS path FROM pl p JOIN x USING (event_id) WHERE parent_id IS NULL
        UNION ALL SELECT pl.event_id, tr.root_id, tr.depth + 1, tr.path || lpad(x.t::VARCHAR, 20, '0') || lpad(pl.event_id::VARCHAR, 20, '0') FROM tr JOIN pl ON pl.parent_id = tr.event_id JOIN x ON x.event_id = pl.event_id)
      SELECT event_id, root_id, depth, row_number() OVER (PARTITION BY root_id ORDER BY path) AS place FROM tr""",
    "score_ledger": X.SCORES + """, le AS (SELECT burst_id, unnest([{'label': 'rule', 'points': r::DOUBLE}, {'label': 'sequence', 'points': s::DOUBLE}, {'label': 'behavior', 'points': b::DOUBLE}, {'label': 'lolbin', 'points': CASE WHEN image IN ('powershell.exe', 'certutil.exe', 'cmd.exe') THEN 10.0::DOUBLE ELSE 0.0 END},
        {'label': 'volume', 'points': 0.5::DOUBLE * n}, {'label': 'depth', 'points': CASE WHEN dp >= 3 THEN 15.0::DOUBLE ELSE 0.0 END}]) AS x FROM v), lp AS (SELECT burst_id, x.label AS label, round(x.points, 6) AS points FROM le WHERE x.points > 0), lt AS (SELECT *, points / sum(points) OVER (PARTITION BY burst_id) AS sh FROM lp)
      SELECT burst_id, label, points, round(sh, 6) AS share, CASE WHEN round(sh, 12) >= 0.5 THEN 'red' WHEN round(sh, 12) >= 0.25 THEN 'orange' ELSE 'blue' END AS colour FROM lt""",
    "verdict_checks": TELE + f""", vr(verdict, steps) AS (VALUES {_values((k, '; '.join(v)) for k, v in K.VERDICTS.items())}), q AS (SELECT event_uid, {_list(OPTIONS)}[k % {len(OPTIONS)} + 1] AS verdict, CASE WHEN k % 3 = 0 THEN 'short' ELSE 'reason number ' || k END AS reason FROM tele),
      c AS (SELECT q.*, steps, CASE WHEN vr.verdict IS NULL THEN 'unknown verdict' WHEN length(trim(reason)) < 10 THEN 'reason too short' ELSE '' END AS problem FROM q LEFT JOIN vr ON vr.verdict = q.verdict)
      SELECT event_uid, verdict, reason, problem, problem = '' AS valid, CASE WHEN problem = '' THEN steps END AS remediation FROM c""",
    "run_history": TELE + f""", q AS (SELECT event_id, computer AS run_id, {_list(STATES)}[k % 5 + 1] AS state, t FROM tele WHERE event_code = 22), w AS (SELECT *, lag(state) OVER o AS before, t - lag(t) OVER o AS lasted FROM q WINDOW o AS (PARTITION BY run_id ORDER BY t, event_id))
      SELECT event_id, run_id, before, state, before IS NULL OR before = state OR before || '>' || state IN ({", ".join(f"'{a}>{b}'" for a, b in K.RUN_STEPS)}) AS accepted, lasted FROM w""",
    "audit_rows": X.SQL["transitions"].replace("SELECT current, requested, event_uid, c IS NOT NULL", ", tr AS (SELECT current, requested, event_uid, c IS NOT NULL", 1) + """) SELECT event_uid, 'analyst' AS actor, CASE WHEN accepted THEN 'status_change' ELSE 'status_refused' END AS action,
      concat_ws(' ', CASE WHEN accepted THEN 'changed' ELSE 'refused' END, current, 'to', requested, CASE WHEN reason <> '' THEN '(' || reason || ')' END) AS details FROM tr""",
    "narrative": X.SCORES + """, nb AS (SELECT computer, string_agg(burst_id, ', ' ORDER BY o) AS top_bursts FROM (SELECT *, row_number() OVER (PARTITION BY computer ORDER BY score DESC, burst_id) AS o FROM bs2) WHERE o <= 3 GROUP BY 1),
      nc AS (SELECT computer, string_agg(pattern_id, ', ' ORDER BY o) AS top_chains FROM (SELECT computer, pattern_id, row_number() OVER (PARTITION BY computer ORDER BY max(confidence) DESC, pattern_id) AS o FROM sq GROUP BY computer, pattern_id) WHERE o <= 3 GROUP BY 1),
      ng AS (SELECT computer, max(score) AS best, count(*) AS bursts FROM bs2 GROUP BY 1)
      SELECT computer, CASE WHEN best >= 75 THEN 'Critical activity' WHEN best >= 45 THEN 'Suspicious activity' ELSE 'Routine activity' END || ' on ' || computer || ': ' || bursts || ' bursts' AS headline, best, top_bursts, top_chains FROM ng LEFT JOIN nb USING (computer) LEFT JOIN nc USING (computer)""",
    "evidence_tags": TELE + "SELECT computer AS incident_id, \"user\" AS subject, t, 'tag ' || event_uid AS tag FROM tele WHERE event_code = 11 QUALIFY row_number() OVER (PARTITION BY computer, \"user\" ORDER BY t DESC, 'tag ' || event_uid DESC) = 1",
    "newest_incidents": HITS + "SELECT computer, rule_id, min(t) AS created_t, max(confidence_score) AS confidence FROM hits GROUP BY 1, 2 ORDER BY created_t DESC, computer, rule_id LIMIT 500",
    "schema_problems": "SELECT * FROM (VALUES ('doc_id', 'bigint', '', (SELECT count(*) FILTER (doc_id IS NULL) FROM documents)), ('text', 'string', '', (SELECT count(*) FILTER (text IS NULL) FROM documents)), ('lang', 'string', '', (SELECT count(*) FILTER (lang IS NULL) FROM documents)), ('n_chars', 'bigint', 'type', (SELECT count(*) FILTER (n_chars IS NULL) FROM documents)), ('author', NULL, 'missing', NULL)) v(\"column\", type, problem, nulls)",
    "pruned_profiles": TELE + ", g AS (SELECT computer, image, count(value) AS n FROM tele GROUP BY 1, 2), thin AS (SELECT * FROM g WHERE n < 150 AND (SELECT count(*) FROM g) > 10 ORDER BY n, computer, image LIMIT 20) SELECT * FROM g WHERE (computer, image) NOT IN (SELECT (computer, image) FROM thin)",
    "forced_samples": TELE + ", g AS (SELECT computer, image, ['False Positive', 'Benign', 'True Positive', 'Undecided'][k % 4 + 1] AS verdict, value FROM tele QUALIFY row_number() OVER (PARTITION BY computer, image ORDER BY t DESC, event_id DESC) = 1) SELECT *, unnest(range(1, 6))::INT AS sample FROM g WHERE verdict IN ('False Positive', 'Benign')",
    "incident_priorities": "SELECT priority, sla, count(*) AS n FROM (" + X.SQL["sla_status"] + ") GROUP BY 1, 2",
}
