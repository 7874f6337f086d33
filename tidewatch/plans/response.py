"""Registered queries: scores, decisions, feedback, incidents and quality, with the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.operators import baseline as N
from tidewatch.operators import graph as G
from tidewatch.operators import quality as V
from tidewatch.operators import report as A
from tidewatch.operators import scoring as C
from tidewatch.operators import sequences as Q
from tidewatch.plans import behaviour as P
from tidewatch.plans.detection import HITS, SPLIT_T, hits
from tidewatch.sources.telemetry import SQL as TELE
from tidewatch.sources.telemetry import telemetry


def _scores(spark, d):
    """Host bursts joined with their computer's signals, scored."""
    b = P.host_bursts(spark, d)
    rules = C.rule_points(hits(spark, d).withColumn("hour", F.floor(F.col("t") / 3_600_000_000)), ["computer", "image", "hour"])
    seq = Q.detect(telemetry(spark, d)).groupBy("computer", F.floor(F.col("first_t") / 3_600_000_000).alias("hour")).agg(F.max("confidence").alias("sequence_confidence"))
    x = b.withColumn("hour", F.floor(F.col("start_t") / 3_600_000_000)).join(rules, ["computer", "image", "hour"], "left").join(seq, ["computer", "hour"], "left")
    x = x.withColumn("behavior", F.when(F.col("n") > 2, 0.5).otherwise(0.0)).withColumn("correlation", F.when(F.col("has_reg"), 4).otherwise(0)).withColumn("group_size", F.col("n")).withColumn("lolbin", F.col("image").isin("powershell.exe", "certutil.exe", "cmd.exe"))
    return C.burst_scores(x)


def burst_scores(spark, d):
    return _scores(spark, d).select("burst_id", "score", "driver", "severity")


def run_scores(spark, d):
    return C.run_score(_scores(spark, d), "computer")


def decisions(spark, d):
    return C.decision(C.run_score(_scores(spark, d), "computer"))


def health_factor(spark, d):
    return C.health_factor(_scores(spark, d))


def _verdicts(spark, d):
    verdict = F.when(F.col("k") % 4 == 0, "False Positive").when(F.col("k") % 4 == 1, "Benign").when(F.col("k") % 4 == 2, "True Positive").otherwise("Undecided")
    return telemetry(spark, d).filter("parent_image is not null").withColumn("verdict", verdict)


def verdict_memory(spark, d):
    return C.record_verdicts(_verdicts(spark, d))


def feedback_adjust(spark, d):
    return C.feedback_adjustment(P.host_bursts(spark, d), C.record_verdicts(_verdicts(spark, d))).select("burst_id", "adjustment")


def _incidents(spark, d):
    """One incident for each computer and rule: its first hit, best confidence and number of hits."""
    g = hits(spark, d).groupBy("computer", "rule_id").agg(F.min("t").alias("created_t"), F.max("confidence_score").alias("confidence"), F.count("*").alias("hits"))
    return g.withColumn("priority", C.priority(F.col("confidence")))


def sla_status(spark, d):
    return C.sla_status(_incidents(spark, d), P.AS_OF_T - 29 * 86_400_000_000)


def triage_queue(spark, d):
    return _incidents(spark, d).orderBy(F.desc("confidence"), "created_t", "computer", "rule_id").limit(100).select("computer", "rule_id", "confidence", "priority", "hits")


def transitions(spark, d):
    names = F.array(*map(F.lit, K.TRANSITIONS))
    return C.transitions(telemetry(spark, d).select("event_uid", F.element_at(names, (F.col("k") % 7 + 1)).alias("current"), F.element_at(names, (F.floor(F.col("k") / 7) % 7 + 1).cast("int")).alias("requested")))


def incident_upsert(spark, d):
    e = telemetry(spark, d).select("computer", "image", "event_id", "t", "value")
    return C.upsert(e.filter(F.col("t") < SPLIT_T), e.filter(F.col("t") >= SPLIT_T), ["computer", "image"], "event_id")


def insert_new(spark, d):
    e = telemetry(spark, d).select("user", "image", "event_id", "t", "k")
    return C.insert_new(e.filter(F.col("t") < SPLIT_T), e.filter(F.col("t") >= SPLIT_T), ["user", "image", "k"])


def accounting(spark, d):
    return V.accounting(telemetry(spark, d), "event_uid", ["image", "parent_image"])


def context_problems(spark, d):
    return V.context_problems(telemetry(spark, d)).select("event_uid", "missing")


def invariants(spark, d):
    e = A.with_mitre(telemetry(spark, d))
    return V.invariants(P.host_bursts(spark, d), G.edge_sums(e), G.members(e), G.parent_links(telemetry(spark, d)))


def table_fingerprint(spark, d):
    return V.table_fingerprint(spark.read.parquet(f"{d}/events.parquet"), ["event_id", "user_id", "event_type", "props"])


def slow_entities(spark, d):
    """Entities whose mean gap between events is far above their peers'."""
    g = N.entity_profile(telemetry(spark, d))
    peers = g.groupBy("image").agg(F.avg("n").alias("peer_mean"), F.stddev_samp("n").alias("peer_std"))
    return g.join(peers, "image").select("computer", "image", "n", F.round((F.col("n") - F.col("peer_mean")) / F.greatest(F.lit(0.1), "peer_std"), 6).alias("z"))


QUERIES = {f.__name__: f for f in (
    burst_scores, run_scores, decisions, health_factor, verdict_memory, feedback_adjust, sla_status, triage_queue, transitions, incident_upsert, insert_new, accounting, context_problems, invariants, table_fingerprint, slow_entities,
)}

_HITS_CTE = HITS[HITS.index(", sig AS") :]
SCORES = P.SEQ + _HITS_CTE + f""", rp AS (SELECT computer, image, t // 3600000000 AS hour, sum(confidence_score / 2 * CASE rule_severity WHEN 'critical' THEN 1.8::DOUBLE WHEN 'high' THEN 1.5 WHEN 'medium' THEN 1.0 ELSE 0.6 END) AS rule_points, count(DISTINCT kill_chain_stage) AS depth FROM hits GROUP BY ALL),
  sp AS (SELECT computer, first_t // 3600000000 AS hour, max(confidence) AS sc FROM sq GROUP BY ALL),
  j AS (SELECT st.*, coalesce(rule_points, 0) AS r, coalesce(depth, 0) AS dp, coalesce(sc, 0) AS sc, CASE WHEN n > 2 THEN 0.5::DOUBLE ELSE 0.0 END AS bh, CASE WHEN has_reg THEN 4 ELSE 0 END AS co FROM (SELECT *, start_t // 3600000000 AS hour FROM st) st LEFT JOIN rp USING (computer, image, hour) LEFT JOIN sp USING (computer, hour)),
  v AS (SELECT *, 0.8::DOUBLE * sc + CASE WHEN sc >= 80 THEN 20 ELSE 0 END AS s, 40 * bh AS b, least(35.0::DOUBLE, 4 * sqrt(co) * least(1.5::DOUBLE, log2(n + 1))) AS c FROM j),
  w AS (SELECT *, (r = 0 AND s = 0 AND bh < 0.1 AND co = 0) AS none, greatest(r, s, b, c) AS best, (r + s + b + c + CASE WHEN image IN ('powershell.exe', 'certutil.exe', 'cmd.exe') THEN 10 ELSE 0 END) * (1 + least(0.35::DOUBLE, 0.1::DOUBLE * dp)) + 0.5::DOUBLE * n + CASE WHEN dp >= 3 THEN 15 ELSE 0 END AS total FROM v),
  bsc AS (SELECT computer, burst_id, CASE WHEN none THEN 0.0::DOUBLE ELSE round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, total)), 1) END AS score,
    CASE WHEN none THEN 'benign' WHEN best / (r + s + b + c) < 0.4 THEN 'mixed' WHEN r = best THEN 'rule' WHEN s = best THEN 'sequence' WHEN b = best THEN 'behavior' ELSE 'correlation' END AS driver FROM w),
  bs2 AS (SELECT *, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS severity FROM bsc)"""
RUNS = SCORES + """, o AS (SELECT *, row_number() OVER (PARTITION BY computer ORDER BY score DESC, burst_id) AS o FROM bs2),
  rs AS (SELECT computer, count(*) FILTER (score >= 45) AS strong, max(score) AS best, round(CASE WHEN count(*) FILTER (score >= 45) > 0 THEN avg(score) FILTER (o <= 3 AND score >= 45) * (1 - 1.0::DOUBLE / (1 + count(*) FILTER (score >= 45))) ELSE max(score) * 0.5 END, 6) AS run_score FROM o GROUP BY 1)"""
_MEMORY = """, vd AS (SELECT *, CASE k % 4 WHEN 0 THEN 'False Positive' WHEN 1 THEN 'Benign' WHEN 2 THEN 'True Positive' ELSE 'Undecided' END AS verdict FROM tele WHERE parent_image IS NOT NULL),
  me AS (SELECT image, parent_image, count(*) AS hit_count, arg_max(verdict, t) AS verdict FROM vd GROUP BY 1, 2), mm AS (SELECT *, CASE verdict WHEN 'False Positive' THEN -20 WHEN 'Benign' THEN -15 WHEN 'True Positive' THEN 15 ELSE 0 END AS adjustment, substr(sha256(image || '|' || parent_image), 1, 16) AS fingerprint FROM me)"""
_INCIDENTS = HITS + """, ic AS (SELECT computer, rule_id, min(t) AS created_t, max(confidence_score) AS confidence, count(*) AS hits FROM hits GROUP BY 1, 2),
  ip AS (SELECT *, CASE WHEN confidence >= 80 THEN 'P1' WHEN confidence >= 60 THEN 'P2' WHEN confidence >= 40 THEN 'P3' ELSE 'P4' END AS priority FROM ic)"""
_NAMES = "[" + ", ".join(f"'{n}'" for n in K.TRANSITIONS) + "]"
_ALLOWED = "al(c, r) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, bs in K.TRANSITIONS.items() for b in bs) + ")"
AS_OF = P.AS_OF_T - 29 * 86_400_000_000
SQL = {
    "burst_scores": SCORES + "SELECT burst_id, score, driver, severity FROM bs2",
    "run_scores": RUNS + "SELECT * FROM rs",
    "decisions": RUNS + ", dc AS (SELECT *, CASE WHEN run_score >= 60 OR strong >= 10 THEN 'ESCALATE' WHEN run_score >= 40 THEN 'INVESTIGATE' WHEN run_score >= 20 THEN 'MONITOR' ELSE 'BASELINE' END AS decision FROM rs) SELECT *, CASE decision WHEN 'ESCALATE' THEN 'P1' WHEN 'INVESTIGATE' THEN 'P2' WHEN 'MONITOR' THEN 'P3' ELSE 'P4' END AS priority FROM dc",
    "health_factor": SCORES + "SELECT round(0.9 - 0.1 * avg(CASE WHEN severity = 'none' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS factor, count(*) AS n FROM bs2",
    "verdict_memory": TELE + _MEMORY + "SELECT * FROM mm",
    "feedback_adjust": P.HOST + _MEMORY + """, fa AS (SELECT burst_id, adjustment, row_number() OVER (PARTITION BY burst_id ORDER BY CASE WHEN st.parent_image = mm.parent_image THEN 5 ELSE 3 END DESC, abs(adjustment) DESC, fingerprint DESC) AS o FROM st JOIN mm ON st.image = mm.image)
      SELECT burst_id, greatest(-20, least(15, coalesce(adjustment, 0))) AS adjustment FROM st LEFT JOIN (SELECT * FROM fa WHERE o = 1) USING (burst_id)""",
    "sla_status": _INCIDENTS + f", sl AS (SELECT *, CASE priority WHEN 'P1' THEN 1 WHEN 'P2' THEN 4 WHEN 'P3' THEN 24 ELSE 72 END::BIGINT AS h FROM ip) SELECT computer, rule_id, created_t, confidence, hits, priority, created_t + h * 3600000000 AS deadline_t, CASE WHEN {AS_OF} > created_t + h * 3600000000 THEN 'breached' WHEN created_t + h * 3600000000 - {AS_OF} <= h * 900000000 THEN 'at risk' ELSE 'on track' END AS sla FROM sl",
    "triage_queue": _INCIDENTS + "SELECT computer, rule_id, confidence, priority, hits FROM ip ORDER BY confidence DESC, created_t, computer, rule_id LIMIT 100",
    "transitions": TELE + f", {_ALLOWED}, q AS (SELECT event_uid, {_NAMES}[k % 7 + 1] AS current, {_NAMES}[(k // 7) % 7 + 1] AS requested FROM tele) SELECT current, requested, event_uid, c IS NOT NULL AS accepted, CASE WHEN c IS NOT NULL THEN '' WHEN starts_with(current, 'Closed') THEN 'terminal' ELSE 'not allowed' END AS reason FROM q LEFT JOIN al ON c = current AND r = requested",
    "incident_upsert": TELE + ", u AS (SELECT computer, image, event_id, t, value, row_number() OVER (PARTITION BY computer, image ORDER BY event_id DESC) AS o FROM tele) SELECT computer, image, event_id, t, value FROM u WHERE o = 1",
    "insert_new": TELE + f"SELECT \"user\", image, event_id, t, k FROM tele a WHERE t >= {SPLIT_T} AND NOT EXISTS (SELECT 1 FROM tele b WHERE b.t < {SPLIT_T} AND b.\"user\" = a.\"user\" AND b.image = a.image AND b.k = a.k)",
    "accounting": TELE + "SELECT count(*) AS raw, count(*) FILTER (image IS NOT NULL AND parent_image IS NOT NULL) AS complete, count(DISTINCT event_uid) FILTER (image IS NOT NULL AND parent_image IS NOT NULL) AS final, count(*) - count(DISTINCT event_uid) FILTER (image IS NOT NULL AND parent_image IS NOT NULL) AS dropped FROM tele",
    "context_problems": TELE + "SELECT event_uid, 'parent_image' AS missing FROM tele WHERE parent_image IS NULL",
    "invariants": P.COMP + ", " + P.HOST[P.HOST.index("hb_c AS") :] + """, px AS (SELECT event_id, t, pid, ppid, computer FROM tele WHERE event_code = 1), pc AS (SELECT c.event_id, c.t, (SELECT p.event_id FROM px p WHERE p.computer = c.computer AND p.pid = c.ppid AND p.t < c.t ORDER BY p.t DESC, p.event_id DESC LIMIT 1) AS parent_id FROM px c)
      SELECT 'score without evidence' AS invariant, count(*) AS violations FROM st WHERE risk > 0 AND n = 0 UNION ALL SELECT 'burst runs backwards', count(*) FROM st WHERE end_t < start_t
      UNION ALL SELECT 'edge without ends', count(*) FROM (SELECT a_event_id AS node FROM ed UNION SELECT b_event_id FROM ed) e WHERE node NOT IN (SELECT node FROM cp)
      UNION ALL SELECT 'node in two campaigns', count(*) FROM (SELECT node FROM cp GROUP BY 1 HAVING count(DISTINCT component) > 1) UNION ALL SELECT 'child before parent', count(*) FROM pc c JOIN pc p ON c.parent_id = p.event_id WHERE c.t < p.t""",
    "table_fingerprint": """WITH h AS (SELECT sha256(concat_ws(chr(9), coalesce(event_id::VARCHAR, ''), coalesce(user_id::VARCHAR, ''), coalesce(event_type, ''), coalesce(props, ''))) AS h FROM events),
      b AS (SELECT ('0x' || substr(h, 31, 8))::BIGINT % 256 AS b, sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT) AS x, sum(('0x' || substr(h, 16, 15))::BIGINT::HUGEINT) AS y, count(*) AS n FROM h GROUP BY 1)
      SELECT sha256(string_agg(b || ':' || x || ':' || y || ':' || n, '|' ORDER BY b)) AS digest, sum(n)::BIGINT AS rows FROM b""",
    "slow_entities": TELE + ", g AS (SELECT computer, image, count(*) AS n FROM tele GROUP BY 1, 2), p AS (SELECT image, avg(n) AS m, stddev_samp(n) AS s FROM g GROUP BY 1) SELECT computer, image, n, round((n - m) / greatest(0.1::DOUBLE, s), 6) AS z FROM g JOIN p USING (image)",
}
