"""Registered queries: bursts, sessions, baselines, sequences, correlation and trees, with the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import constants as K

from tidewatch.operators import baseline as N
from tidewatch.operators import bursts as B
from tidewatch.operators import graph as G
from tidewatch.operators import report as A
from tidewatch.operators import rules as R
from tidewatch.operators import sequences as Q
from tidewatch.plans.detection import HITS, RANKS, SPLIT_T, hits
from tidewatch.sources.telemetry import SQL as TELE
from tidewatch.sources.telemetry import telemetry

AS_OF_T = 1706659200000000  # 2024-01-31 00:00 UTC


def host_bursts(spark, d):
    """Bursts of a computer's user, scored."""
    return B.scored(B.bursts(telemetry(spark, d), ["computer", "image"], 900))


def bursts(spark, d):
    e = telemetry(spark, d)
    b = B.with_code_list(B.bursts(e), e)
    return b.select("burst_id", "image", "pid", "computer", "user", "start_t", "end_t", "n", "exec_count", "net_count", "has_file", "has_reg", F.col("code_list").alias("codes"), "dst_ip", "peak")


def burst_events(spark, d):
    return B.burst_events(telemetry(spark, d)).select("burst_id", "event_uid", "t", "event_code")


def bursts_by_image(spark, d):
    return host_bursts(spark, d).select("burst_id", "computer", "image", "n", "start_t", "end_t", "stage", "risk", "dst_ip", "parent_image")


def shown_bursts(spark, d):
    return B.shown(host_bursts(spark, d)).select("burst_id", "risk", "stage")


def prioritised_bursts(spark, d):
    return B.prioritised(host_bursts(spark, d)).select("burst_id", "priority_score")


def dangerous_bursts(spark, d):
    return B.most_dangerous(host_bursts(spark, d)).select("burst_id", "peak", "n")


def sessions(spark, d):
    return B.sessions(host_bursts(spark, d))


def collapsed_bursts(spark, d):
    return B.collapsed(host_bursts(spark, d), 7200)


def burst_aggregates(spark, d):
    return B.hourly(host_bursts(spark, d))


def auto_correlated(spark, d):
    return B.auto_correlated(host_bursts(spark, d), F.lit(AS_OF_T), ["computer"])


def burst_reasons(spark, d):
    return host_bursts(spark, d).select("burst_id", B.reasons(F.col("net_count") > 2).alias("reasons"))


def behavior_counts(spark, d):
    return B.behaviors(telemetry(spark, d)).groupBy("computer", "behavior_type").agg(F.count("*").alias("n"))


def detections_for_bursts(spark, d):
    """Bursts carry the rule of their first hit, so likeness has something to compare."""
    found = G.stored(hits(spark, d).select("event_id", "event_uid", "t", "computer", "pid", "image", "parent_image", "command_line", "rule_id"))
    first = found.groupBy("computer", "pid").agg(F.min_by("rule_id", F.struct("t", "event_id", "rule_id")).alias("rule_id"))
    b = B.bursts(telemetry(spark, d)).select("burst_id", "computer", "pid", "image", "parent_image", "start_t", "end_t").join(first, ["computer", "pid"], "left")
    return R.detection_counts(b, found)


def run_confidence(spark, d):
    return A.run_confidence(hits(spark, d), host_bursts(spark, d), auto_correlated(spark, d))


def alert_levels(spark, d):
    g = host_bursts(spark, d).groupBy("computer").agg(F.max("risk").alias("risk"), F.count_distinct("stage").alias("stages"))
    return A.alert_level(g)


def _split(spark, d):
    e = telemetry(spark, d)
    return e.filter(F.col("t") >= SPLIT_T), e.filter(F.col("t") < SPLIT_T)


def deviation_scores(spark, d):
    return N.deviation_scores(*_split(spark, d))


def learnable(spark, d):
    return N.should_learn(N.deviation_scores(*_split(spark, d)), 0.4).groupBy("computer").agg(F.count("*").alias("n"))


def entity_profile(spark, d):
    return N.entity_profile(telemetry(spark, d))


def hourly_baseline(spark, d):
    return N.hourly_baseline(telemetry(spark, d))


def merged_profile(spark, d):
    new, old = _split(spark, d)
    m = N.merge_statistics(N.statistics(old, N.ENTITY), N.statistics(new, N.ENTITY), N.ENTITY)
    return m.select(*N.ENTITY, "n", F.round("mean", 6).alias("mean"), F.round("m2", 1).alias("m2"))


def ngrams(spark, d):
    return N.ngrams(telemetry(spark, d))


def _found(spark, d):
    return Q.detect(telemetry(spark, d))


def sequences(spark, d):
    return _found(spark, d).select("pattern_id", "computer", "first_uid", "last_uid", "first_t", "last_t", "matched", "confidence", "severity")


def sequence_groups(spark, d):
    return Q.grouped(_found(spark, d), 86400)


def sequence_boost(spark, d):
    return Q.boost(host_bursts(spark, d), _found(spark, d)).select("burst_id", F.round("boosted", 6).alias("boosted"))


def _staged(spark, d):
    return A.with_mitre(telemetry(spark, d))


def corr_edges(spark, d):
    return G.edges(_staged(spark, d))


def campaigns(spark, d):
    e = _staged(spark, d)
    return G.stale(G.campaigns(e, G.edge_sums(e), G.members(e)), AS_OF_T).select("component", "computer", "nodes", "edges", "first_t", "last_t", "stages", F.round("weight", 6).alias("weight"), "score", "status", "confidence")


def campaign_members(spark, d):
    return G.members(_staged(spark, d))


def process_tree(spark, d):
    links = G.parent_links(telemetry(spark, d))
    return G.tree_depths(links)


def parent_chain(spark, d):
    return G.parent_chain(telemetry(spark, d))


def story_steps(spark, d):
    return G.story(_staged(spark, d))


QUERIES = {f.__name__: f for f in (
    bursts, burst_events, bursts_by_image, shown_bursts, prioritised_bursts, dangerous_bursts, sessions, collapsed_bursts, burst_aggregates, auto_correlated, burst_reasons, behavior_counts, detections_for_bursts, run_confidence,
    alert_levels, deviation_scores, learnable, entity_profile, hourly_baseline, merged_profile, ngrams, sequences, sequence_groups, sequence_boost, corr_edges, campaigns, campaign_members, process_tree, parent_chain, story_steps,
)}


#: tele with gp, the grandparent by process ids.
GRAND = """, sn AS (SELECT computer, pid, t, arg_max(image, event_id) AS image, arg_max(ppid, event_id) AS ppid FROM tele GROUP BY ALL),
  pa AS (SELECT e.*, p.ppid AS above FROM tele e ASOF LEFT JOIN sn p ON e.computer = p.computer AND e.ppid = p.pid AND e.t > p.t),
  kx AS (SELECT e.*, p.image AS gp FROM pa e ASOF LEFT JOIN sn p ON e.computer = p.computer AND e.above = p.pid AND e.t > p.t)"""


#: The different codes of a burst, and all of them in order.
CODE_SET = "array_to_string(list_sort(list_distinct(list(event_code))), ',')"
CODE_LIST = "string_agg(CAST(event_code AS VARCHAR), ',' ORDER BY t, event_id)"


def _bursts_sql(keys: list[str], name: str, codes: str = CODE_SET) -> str:
    k = ", ".join(f'"{x}"' for x in keys)
    text = " || '|' || ".join(f'"{x}"' for x in keys)
    return f"""{name}_c AS (SELECT *, CASE WHEN coalesce(t - lag(t) OVER w > 900000000, true) THEN 1 ELSE 0 END AS cut FROM tele WINDOW w AS (PARTITION BY {k} ORDER BY t, event_id)),
{name}_n AS (SELECT *, sum(cut) OVER (PARTITION BY {k} ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS burst_no FROM {name}_c),
{name} AS (SELECT {k}, min(t) AS start_t, max(t) AS end_t, count(*) AS n, count(*) FILTER (event_code = 1) AS exec_count, count(*) FILTER (event_code = 3) AS net_count,
  bool_or(event_code = 11) AS has_file, bool_or(event_code IN (12, 13, 14)) AS has_reg, {codes} AS codes,
  last(dst_ip ORDER BY t, event_id) FILTER (dst_ip IS NOT NULL) AS dst_ip, last(parent_image ORDER BY t, event_id) FILTER (parent_image IS NOT NULL) AS parent_image, round(max(value), 6) AS peak,
  substr(sha256({text} || '|' || min(t)), 1, 16) AS burst_id FROM {name}_n GROUP BY {k}, burst_no)"""


FULL = TELE + ", " + _bursts_sql(["image", "pid", "computer", "user"], "fb")
HOST = TELE + ", " + _bursts_sql(["computer", "image"], "hb") + f""", sb AS (SELECT *, CASE WHEN net_count > 0 THEN 'Command and Control' WHEN has_reg THEN 'Persistence' WHEN exec_count > 0 THEN 'Execution' ELSE 'Background' END AS stage,
  least(100, 2 * n + 5 * exec_count + 8 * net_count + CASE WHEN has_reg THEN 20 ELSE 0 END + CASE WHEN has_file THEN 10 ELSE 0 END)::INT AS risk FROM hb), st AS (SELECT *, {RANKS.format('stage')} AS rank FROM sb)"""
DEV = TELE + f""", hh AS (SELECT *, (t // 3600000000) % 24 AS hour FROM tele), old AS (SELECT * FROM hh WHERE t < {SPLIT_T}), cur AS (SELECT * FROM hh WHERE t >= {SPLIT_T}),
  bs AS (SELECT computer, image, count(value) AS n, avg(value) AS mean, var_pop(value) * count(value) AS m2 FROM old GROUP BY ALL),
""" + ",\n".join(f"""{a}c AS (SELECT computer, image, {c}, count(*) AS c FROM old WHERE {c} IS NOT NULL GROUP BY ALL), {a}t AS (SELECT computer, image, sum(c) AS total FROM {a}c GROUP BY ALL)""" for a, c in (("p", "parent_image"), ("h", "hour"), ("i", "dst_ip"))) + f""",
  dx AS (SELECT cur.*, coalesce(n, 0) AS n, mean, greatest(0.1, sqrt(m2 / greatest(coalesce(n, 0) - 1, 1))) AS sd, coalesce(pt.total, 0) AS pt, coalesce(pc.c, 0) / pt.total AS ps, coalesce(ht.total, 0) AS ht, coalesce(hc.c, 0) / ht.total AS hs, coalesce(it.total, 0) AS it, coalesce(ic.c, 0) / it.total AS "is"
    FROM cur LEFT JOIN bs USING (computer, image) LEFT JOIN pt USING (computer, image) LEFT JOIN ht USING (computer, image) LEFT JOIN it USING (computer, image)
    LEFT JOIN pc USING (computer, image, parent_image) LEFT JOIN hc USING (computer, image, hour) LEFT JOIN ic USING (computer, image, dst_ip)),
  dy AS (SELECT event_uid, computer, image, n, CASE WHEN n = 0 THEN 0.25::DOUBLE WHEN n < 10 THEN 0.3 ELSE least(1.0, greatest(0.2, abs((value - mean) / sd) / 3)) END AS f,
    CASE WHEN pt < 5 THEN 0.10::DOUBLE ELSE (1 - ps) * CASE WHEN parent_image IN ({", ".join(f"'{b}'" for b in K.BENIGN_PARENTS)}) THEN 0.5 ELSE 1.0 END END AS p, CASE WHEN ht < 10 THEN 0.05::DOUBLE ELSE 1 - hs END AS h,
    CASE WHEN dst_ip IS NULL THEN 0.05::DOUBLE WHEN it < 5 THEN 0.15 ELSE 1 - "is" END AS i FROM dx),
  dz AS (SELECT *, 0.40 * f + 0.25 * p + 0.15 * h + 0.20 * i AS raw FROM dy), ds AS (SELECT event_uid, computer, image, round(f, 6) AS f, round(p, 6) AS p, round(h, 6) AS h, round(i, 6) AS i, least(1.0, CASE WHEN n < 15 THEN greatest(0.2, 0.75 * raw) ELSE raw END) AS dev FROM dz)"""


def _sequence_sql(patterns=Q.PATTERNS, rows="pos", out="sq") -> str:
    quoted = lambda x: x.replace("'", "''")

    def test(s, a: str) -> str:
        parts = [f"{a}.event_code = {s.event_code}"]
        if s.image_any:
            parts.append("(" + " OR ".join(f"contains({a}.image, '{quoted(i)}')" for i in s.image_any) + ")")
        if s.cmd_contains:
            parts.append(f"contains(lower({a}.command_line), '{quoted(s.cmd_contains)}')")
        return " AND ".join(parts)

    parts = [f"{rows} AS (SELECT computer, event_uid, t, image, event_code, command_line, row_number() OVER (PARTITION BY computer ORDER BY t, event_id) AS rn FROM tele)"]
    names = []
    for p in patterns:
        name = p.pattern_id.replace("-", "").lower()
        before = f"SELECT computer, event_uid AS first_uid, t AS first_t, event_uid AS uid, t, rn FROM {rows} WHERE {test(p.steps[0], rows)}"
        for k, s in enumerate(p.steps[1:], 2):
            parts.append(f"""{name}{k} AS (SELECT * FROM (SELECT a.computer, a.first_uid, a.first_t, b.event_uid AS uid, b.t, b.rn, row_number() OVER (PARTITION BY a.computer, a.first_uid ORDER BY b.rn) AS o
              FROM ({before}) a JOIN {rows} b ON a.computer = b.computer AND b.rn BETWEEN a.rn + 1 AND a.rn + {s.max_skip_steps + 1} AND b.t - a.t <= {(s.max_gap_seconds + 5) * 1000000} AND {test(s, 'b')}) WHERE o = 1)""")
            before = f"SELECT computer, first_uid, first_t, uid, t, rn FROM {name}{k}"
            level = "critical" if p.confidence >= 90 else "high"
            names.append(f"SELECT '{p.pattern_id}' AS pattern_id, '{p.stage}' AS stage, computer, first_uid, uid AS last_uid, first_t, t AS last_t, {k} AS matched, {p.confidence * k // len(p.steps)} AS confidence, '{level}' AS severity FROM {name}{k}")
    return ", ".join(parts) + f", {out} AS (" + " UNION ALL ".join(names) + ")"


SEQUENCES = _sequence_sql()
SEQ = HOST + ", " + SEQUENCES
_STAGE_LIST = ", ".join(f"'{x}'" for x in K.STAGES)
_STAGES = "stg(event_code, kill_chain_stage) AS (VALUES " + ", ".join(f"({c}, '{s}')" for c, _, _, s, _ in K.EVENT_CODES) + ")"
STAGED = TELE + f""", {_STAGES}, sx AS (SELECT tele.*, kill_chain_stage, {RANKS.format('kill_chain_stage')} AS rk FROM tele JOIN stg USING (event_code))"""
EDGES = STAGED + """, er AS (SELECT a.event_id AS a_event_id, b.event_id AS b_event_id, a.computer, a.rk AS ra, b.rk AS rb,
  CASE WHEN b.parent_image = a.image AND a."user" = b."user" THEN 'structural' WHEN b.rk = a.rk + 1 AND a.rk > 0 AND b.rk > 0 THEN 'tactic' WHEN a.rk = b.rk AND a."user" = b."user" THEN 'stage' WHEN a."user" = b."user" AND a.rk > 0 AND b.rk > 0 THEN 'user' END AS kind
  FROM sx a JOIN sx b ON a.computer = b.computer AND (b.t > a.t OR (b.t = a.t AND b.event_id > a.event_id)) AND b.t - a.t <= 900000000),
 ed AS (SELECT a_event_id, b_event_id, computer, kind, CASE kind WHEN 'structural' THEN 5.0::DOUBLE WHEN 'tactic' THEN 3.0 WHEN 'stage' THEN 2.0 ELSE 1.0 END * CASE WHEN rb < ra THEN 0.5 ELSE 1.0 END AS weight,
  CASE WHEN rb > ra THEN 'forward' WHEN rb < ra THEN 'backward' ELSE 'lateral' END AS direction FROM er WHERE kind IS NOT NULL)"""
COMP = EDGES.replace("WITH ev", "WITH RECURSIVE ev", 1) + """, nb AS (SELECT a_event_id AS u, b_event_id AS v FROM ed UNION SELECT b_event_id, a_event_id FROM ed),
 rc(node, seen) AS (SELECT u, u FROM nb UNION SELECT nb.v, rc.seen FROM rc JOIN nb ON nb.u = rc.node WHERE rc.seen < nb.v OR true), cp AS (SELECT node, min(seen) AS component FROM rc GROUP BY 1)"""

SQL = {
    "bursts": TELE + ", " + _bursts_sql(["image", "pid", "computer", "user"], "fb", CODE_LIST) + "SELECT burst_id, image, pid, computer, \"user\", start_t, end_t, n, exec_count, net_count, has_file, has_reg, codes, dst_ip, peak FROM fb",
    "burst_events": FULL + 'SELECT burst_id, event_uid, t, event_code FROM fb_n n JOIN fb b ON n.image = b.image AND n.pid = b.pid AND n.computer = b.computer AND n."user" = b."user" AND n.t BETWEEN b.start_t AND b.end_t',
    "bursts_by_image": HOST + "SELECT burst_id, computer, image, n, start_t, end_t, stage, risk, dst_ip, parent_image FROM st",
    "shown_bursts": HOST + "SELECT burst_id, risk, stage FROM st WHERE n >= 3 OR risk >= 40 OR stage IN ('Execution', 'Persistence', 'Privilege Escalation')",
    "prioritised_bursts": HOST + "SELECT burst_id, risk + 2 * rank + CASE WHEN has_reg THEN 10 ELSE 0 END + CASE WHEN net_count > 0 THEN 5 ELSE 0 END AS priority_score FROM st ORDER BY 2 DESC, start_t, burst_id LIMIT 50",
    "dangerous_bursts": HOST + "SELECT burst_id, peak, n FROM st ORDER BY peak DESC, rank DESC, n DESC, burst_id LIMIT 10",
    "sessions": HOST + """, sc AS (SELECT *, CASE WHEN coalesce(start_t - max(end_t) OVER (PARTITION BY computer, stage ORDER BY start_t, burst_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 300000000, true) THEN 1 ELSE 0 END AS cut FROM st),
      sn AS (SELECT *, sum(cut) OVER (PARTITION BY computer, stage ORDER BY start_t, burst_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM sc)
      SELECT computer, stage, session_no, min(start_t) AS start_t, max(end_t) AS end_t, count(*) AS bursts, sum(n)::BIGINT AS events, max(risk) AS risk FROM sn GROUP BY 1, 2, 3""",
    "collapsed_bursts": HOST + """, ck AS (SELECT *, coalesce(parent_image, 'unknown') || '>' || image AS chain, start_t // 7200000000 AS bucket FROM st), cr AS (SELECT *, row_number() OVER (PARTITION BY chain, computer, stage, bucket ORDER BY risk DESC, burst_id DESC) AS o, count(*) OVER (PARTITION BY chain, computer, stage, bucket) AS merged FROM ck)
      SELECT chain, computer, stage, bucket, burst_id, risk, merged FROM cr WHERE o = 1""",
    "burst_aggregates": HOST + "SELECT image, computer, start_t // 3600000000 AS hour, sum(n)::BIGINT AS events, round(max(peak), 6) AS peak, sum(exec_count)::BIGINT AS execs, sum(net_count)::BIGINT AS nets, bool_or(has_reg) AS any_reg, arg_max(stage, rank) AS stage FROM st GROUP BY 1, 2, 3",
    "auto_correlated": HOST + f"SELECT computer, count(*) AS bursts, count(DISTINCT stage) AS stages, min(start_t) AS first_t, CASE WHEN count(DISTINCT stage) >= 3 THEN 30 ELSE 20 END AS strength FROM st GROUP BY 1 HAVING bursts >= 2 AND stages >= 2 AND {AS_OF_T} - first_t >= 300000000",
    "burst_reasons": HOST + "SELECT burst_id, concat_ws(';', CASE WHEN n > 10 THEN 'high frequency' END, CASE WHEN net_count > 2 THEN 'sequence linked' END, CASE WHEN parent_image <> '' AND parent_image NOT IN (" + ", ".join(f"'{b}'" for b in K.BENIGN_PARENTS) + ") THEN 'abnormal parent' END) AS reasons FROM st",
    "behavior_counts": TELE + "SELECT computer, CASE event_code WHEN 1 THEN 'execution' WHEN 3 THEN 'network' WHEN 11 THEN 'file' ELSE 'registry' END AS behavior_type, count(*) AS n FROM tele WHERE event_code IN (1, 3, 11, 12, 13, 14, 15) GROUP BY 1, 2",
    "detections_for_bursts": HITS + ", " + _bursts_sql(["image", "pid", "computer", "user"], "fb") + """, fr AS (SELECT computer, pid, rule_id AS own FROM hits QUALIFY row_number() OVER (PARTITION BY computer, pid ORDER BY t, event_id, rule_id) = 1),
      bb AS (SELECT fb.*, own FROM fb LEFT JOIN fr USING (computer, pid)),
      dm AS (SELECT DISTINCT burst_id, event_uid, rule_id FROM bb b JOIN hits h ON b.computer = h.computer WHERE (b.pid = h.pid AND h.t BETWEEN start_t - 5000000 AND end_t + 5000000)
        OR CASE WHEN own = rule_id THEN 3 ELSE 0 END + CASE WHEN b.parent_image = h.parent_image THEN 2 ELSE 0 END + CASE WHEN b.image = h.image THEN 2 ELSE 0 END >= 5)
      SELECT burst_id, count(*) AS detections, count(DISTINCT rule_id) AS rules FROM dm GROUP BY 1""",
    "run_confidence": HITS + ", " + HOST[HOST.index("hb_c AS") :] + f""", co AS (SELECT computer FROM st GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT stage) >= 2 AND {AS_OF_T} - min(start_t) >= 300000000),
      q AS (SELECT count(*) AS detections, coalesce(max(confidence_score), 0) AS best, count(DISTINCT mitre_tactic) AS tactics, (SELECT coalesce(max(risk), 0) FROM st) AS peak, (SELECT count(*) > 0 FROM co) AS correlated,
        [{_STAGE_LIST}][coalesce((SELECT max(rank) FROM st WHERE risk >= 45), max({RANKS.format('kill_chain_stage')}), (SELECT max(rank) FROM st)) + 1] AS stage FROM hits),
      p AS (SELECT *, least(100, CASE WHEN best >= 80 THEN 45 WHEN best >= 50 THEN 25 WHEN best > 0 THEN 10 ELSE 0 END + CASE WHEN tactics >= 3 THEN 25 WHEN tactics >= 1 THEN 10 ELSE 0 END + CASE WHEN stage IN ('Command and Control', 'Actions on Objectives') THEN 25 WHEN stage IS NOT NULL THEN 10 ELSE 0 END
        + CASE WHEN correlated THEN 15 ELSE 0 END + least(20, peak // 5)) AS raw FROM q)
      SELECT detections, best, tactics, peak, correlated, stage, CASE WHEN raw >= 80 THEN 'High' WHEN raw >= 50 THEN 'Medium' WHEN raw > 0 THEN 'Low' ELSE 'None' END AS level, least(raw, CASE stage WHEN 'Actions on Objectives' THEN 100 WHEN 'Command and Control' THEN 80 WHEN 'Persistence' THEN 75 ELSE 50 END)::INT AS score FROM p""",
    "alert_levels": HOST + ", g AS (SELECT computer, max(risk) AS risk, count(DISTINCT stage) AS stages FROM st GROUP BY 1) SELECT *, CASE WHEN risk >= 75 AND stages >= 2 THEN 'critical' WHEN risk >= 75 THEN 'high' WHEN risk >= 45 AND stages >= 1 THEN 'medium' ELSE 'low' END AS alert FROM g",
    "deviation_scores": DEV + "SELECT event_uid, computer, image, f, p, h, i, round(dev, 6) AS deviation FROM ds",
    "learnable": DEV + "SELECT computer, count(*) AS n FROM ds WHERE round(dev, 6) < 0.4 GROUP BY 1",
    "entity_profile": TELE + "SELECT computer, image, count(*) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS var, count(DISTINCT parent_image) AS parents, count(DISTINCT dst_ip) AS addresses, count(DISTINCT regexp_extract(dst_ip, '^(\\d+\\.\\d+\\.\\d+)', 1)) AS subnets FROM tele GROUP BY 1, 2",
    "hourly_baseline": TELE + ", dd AS (SELECT computer, image, (t // 3600000000) % 24 AS hour, t // 86400000000 AS day, count(*) AS c, avg(length(command_line)) AS len FROM tele GROUP BY ALL) SELECT computer, image, hour, count(*) AS days, round(avg(c), 6) AS mean, round(var_samp(c), 6) AS var, round(avg(len), 6) AS cmd_length FROM dd GROUP BY ALL",
    "merged_profile": TELE + "SELECT computer, image, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value) * count(value), 1) AS m2 FROM tele GROUP BY 1, 2",
    "ngrams": TELE + GRAND + ", g AS (SELECT computer, 2 AS size, parent_image || '>' || image AS gram FROM kx WHERE parent_image IS NOT NULL UNION ALL SELECT computer, 3, concat_ws('>', gp, parent_image, image) FROM kx WHERE gp IS NOT NULL) SELECT computer, size, gram, count(*) AS n FROM g GROUP BY ALL",
    "sequences": SEQ + "SELECT pattern_id, computer, first_uid, last_uid, first_t, last_t, matched, confidence, severity FROM sq",
    "sequence_groups": SEQ + ", g AS (SELECT pattern_id, computer, first_t // 86400000000 AS bucket, max(confidence) AS best, count(*) AS freq FROM sq GROUP BY ALL) SELECT *, floor(best / CASE WHEN freq > 1 THEN ln(1.0 + freq) ELSE 1.0 END * CASE WHEN freq > 5 THEN 0.5 ELSE 1.0 END)::INT AS confidence FROM g",
    "sequence_boost": SEQ + ", b AS (SELECT computer, max(confidence) AS c FROM sq GROUP BY 1) SELECT burst_id, round(least(100.0::DOUBLE, risk + least(10.0::DOUBLE, coalesce(c, 0) / 10)), 6) AS boosted FROM st LEFT JOIN b USING (computer)",
    "corr_edges": EDGES + "SELECT * FROM ed",
    "campaigns": COMP + f""", nn AS (SELECT component, count(*) AS nodes, min(t) AS first_t, max(t) AS last_t, any_value(computer) AS computer, count(DISTINCT kill_chain_stage) AS stages, bool_or(event_code IN (12, 13, 14)) AS pe, bool_or(event_code = 3) AS ne, bool_or(event_code IN (8, 9, 25)) AS ce FROM sx JOIN cp ON event_id = node GROUP BY 1),
      ee AS (SELECT component, count(*) AS edges, sum(weight) AS weight, count(*) FILTER (direction = 'forward') AS fw, count(*) FILTER (direction = 'backward') AS bw FROM ed JOIN cp ON a_event_id = node GROUP BY 1),
      cs AS (SELECT *, round(least(100.0::DOUBLE, greatest(10.0::DOUBLE, 0.5 * least(50.0::DOUBLE, least(20.0::DOUBLE, 5 * weight) + CASE WHEN bw = 0 THEN least(15, 5 * fw) ELSE 0 END) + 30 + CASE WHEN pe THEN 15 ELSE 0 END + CASE WHEN ne THEN 10 ELSE 0 END + CASE WHEN ce THEN 20 ELSE 0 END)
        * CASE least(5, stages + 1) WHEN 3 THEN 1.5 WHEN 4 THEN 2.5 WHEN 5 THEN 4.0 ELSE 1.0 END), 6) AS score FROM nn JOIN ee USING (component))
      SELECT component, computer, nodes, edges, first_t, last_t, stages, round(weight, 6) AS weight, score, CASE WHEN last_t < {AS_OF_T - 86400000000} THEN 'dormant' ELSE 'active' END AS status, CASE WHEN last_t < {AS_OF_T - 86400000000} THEN greatest(20.0, floor(0.9 * score)) ELSE floor(score) END AS confidence FROM cs""",
    "campaign_members": COMP + "SELECT node, component FROM cp",
    "process_tree": TELE.replace("WITH ev", "WITH RECURSIVE ev", 1) + """, x AS (SELECT event_id, t, pid, ppid, computer FROM tele WHERE event_code = 1), pl AS (SELECT c.event_id, (SELECT p.event_id FROM x p WHERE p.computer = c.computer AND p.pid = c.ppid AND (p.t < c.t) ORDER BY p.t DESC, p.event_id DESC LIMIT 1) AS parent_id FROM x c),
      tr AS (SELECT event_id, event_id AS root_id, 0::BIGINT AS depth FROM pl WHERE parent_id IS NULL UNION ALL SELECT pl.event_id, tr.root_id, tr.depth + 1 FROM tr JOIN pl ON pl.parent_id = tr.event_id) SELECT event_id, root_id, depth FROM tr""",
    "parent_chain": TELE + """, w AS (SELECT computer, pid, image, ppid FROM tele QUALIFY row_number() OVER (PARTITION BY computer, pid ORDER BY t DESC, event_id DESC) = 1)
      SELECT e.event_uid, concat_ws(' > ', g.image, p.image, e.image) AS chain, 1 + CASE WHEN p.image IS NOT NULL AND p.image <> 'svchost.exe' THEN 1 ELSE 0 END + CASE WHEN g.image IS NOT NULL AND g.image <> 'svchost.exe' THEN 1 ELSE 0 END AS process_depth
      FROM tele e LEFT JOIN w p ON p.computer = e.computer AND p.pid = e.ppid LEFT JOIN w g ON g.computer = p.computer AND g.pid = p.ppid""",
    "story_steps": STAGED + """, c1 AS (SELECT *, CASE WHEN coalesce(image = lag(image) OVER w AND kill_chain_stage = lag(kill_chain_stage) OVER w, false) THEN 0 ELSE 1 END AS cut FROM sx WINDOW w AS (PARTITION BY computer ORDER BY t, event_id)),
      c2 AS (SELECT *, sum(cut) OVER (PARTITION BY computer ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS step FROM c1),
      c3 AS (SELECT computer, step, min(t) AS start_t, max(t) AS end_t, count(*) AS n, any_value(image) AS image, any_value(kill_chain_stage) AS stage, (array_agg(parent_image ORDER BY t, event_id))[1] AS pi FROM c2 GROUP BY 1, 2)
      SELECT computer, step, start_t, end_t, n, image, stage, CASE WHEN lag(image) OVER w IS NULL THEN 'start' WHEN pi = lag(image) OVER w THEN 'spawned' WHEN start_t - lag(end_t) OVER w <= 5000000 THEN 'likely related' ELSE 'related' END AS link FROM c3 WINDOW w AS (PARTITION BY computer ORDER BY step)""",
}
