"""Registered queries: bursts by all their evidence, layered stages, decisions with tasks, incidents in detail, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.functions import signals as S
from tidewatch.operators import bursts as B
from tidewatch.operators import casework as W
from tidewatch.operators import context as Y
from tidewatch.operators import graph as G
from tidewatch.operators import hunt as H
from tidewatch.operators import report as A
from tidewatch.operators import rules as R
from tidewatch.operators import scoring as C
from tidewatch.operators import sequences as Q
from tidewatch.plans import behaviour as P
from tidewatch.plans import casework as L
from tidewatch.plans import response as X
from tidewatch.plans.detection import EXTERNAL, HITS, RANKS, SPLIT_T, hits
from tidewatch.sources.telemetry import SQL as TELE
from tidewatch.sources.telemetry import telemetry

WEEK = 604_800_000_000
FIELDS = ["image", "parent_image", "command_line", "file_path", "reg_key", "dst_ip", "user"]
SETS = {
    "encoded shell": [["powershell"], ["-enc ", "-encodedcommand"]], "download": [["https?://"], ["powershell", "cmd\\.exe", "certutil"]], "public program": [["users.public.*\\.exe"]],
    "run key": [["currentversion.run"]], "console": [["cmd\\.exe", "powershell"], ["-noprofile", "/create"]], "reaches out": [["203\\.0\\.113\\."], ["cmd\\.exe"]],
}
HOLDERS = ["New", "Triage", "Closed - Benign"]


def _bursts(spark, d):
    """Bursts of a computer's image with their evidence; the stage by all four layers (what was found before is ``prior_stage``)."""
    e, found = telemetry(spark, d), hits(spark, d)
    b = B.with_persistence(B.bursts(e, ["computer", "image"], 900, B.evidence())).withColumn("risk", B.risk())
    top = lambda df, by, name: df.groupBy(*by).agg(F.max_by("kill_chain_stage", S.stage_rank(F.col("kill_chain_stage"))).alias(name))
    return B.layered_stage(b.join(top(found.filter(F.col("t") < SPLIT_T), ["computer", "image"], "prior_stage"), ["computer", "image"], "left").join(top(found, ["image"], "detected"), "image", "left"))


def burst_evidence(spark, d):
    return _bursts(spark, d).select("burst_id", "dst_port", "target", "target_key", F.array_join(F.transform("code_set", lambda c: c.cast("string")), ",").alias("codes"), "has_injection", "has_persistence")


def layered_stages(spark, d):
    return _bursts(spark, d).select("burst_id", "flag_stage", "content_stage", "stage")


def _linked(spark, d):
    return Q.with_last_event(Q.detect(telemetry(spark, d)), telemetry(spark, d))


def priorities(spark, d):
    """The ten bursts to look at first, by all six terms."""
    b = _bursts(spark, d)
    both = B.auto_correlated(b, F.lit(P.AS_OF_T), ["computer", "image"]).select("computer", "image", F.lit(True).alias("correlated"))
    x = Q.boost_by_image(b.withColumn("behavior", F.lit(0.0)).join(both, ["computer", "image"], "left"), _linked(spark, d))
    return B.priority_score(x).orderBy(F.desc("priority_score"), "start_t", "burst_id").limit(10).select("burst_id", "priority_score")


def burst_order(spark, d):
    return B.in_order(_bursts(spark, d)).select("burst_id", "computer", "place")


def burst_rollup(spark, d):
    return B.rolled_up(_bursts(spark, d), F.floor(F.col("start_t") / WEEK))


def correlated_images(spark, d):
    return B.auto_correlated(_bursts(spark, d), F.lit(P.AS_OF_T), ["computer", "image"])


def burst_hints(spark, d):
    return B.hints(_bursts(spark, d), _linked(spark, d)).select("burst_id", "reasons", "stage_hint")


def event_texts(spark, d):
    return S.event_text(telemetry(spark, d)).select("event_uid", "text")


def pattern_sets(spark, d):
    return R.set_detections(R.pattern_sets(R.with_signals(telemetry(spark, d)), SETS, FIELDS)).select("event_uid", "rule_id", "confidence_score", "severity")


def best_of_sources(spark, d):
    return Y.alternate_primary(L.all_detections(spark, d), ["computer"])


def activity(spark, d):
    return A.activity(telemetry(spark, d))


def stage_summary(spark, d):
    return A.stage_summary(_bursts(spark, d), hits(spark, d))


def correlated_alerts(spark, d):
    b = _bursts(spark, d)
    own = F.when(~F.col("stage").isin("Background", "Unclassified"), F.col("stage"))
    g = b.groupBy("computer").agg(F.max("risk").alias("score"), F.count_distinct(own).alias("stages"), F.avg(F.when(F.col("risk") >= 40, F.col("risk"))).alias("m"))
    score = F.least(F.lit(30.0), F.coalesce("m", F.lit(0.0)) * 0.3) * F.when(F.col("stages") < 2, 0.5).otherwise(1.0)
    return A.correlated_alert(g.withColumn("correlation", F.round(score, 6)).drop("m"))


def field_iocs(spark, d):
    return H.field_iocs(telemetry(spark, d), ["dst_ip"], ["command_line"])


def page_iocs(spark, d):
    """URLs and domains of all page addresses."""
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").cast("string").alias("event_uid"), F.col("page_id").cast("long").alias("t"), "url")
    return H.field_iocs(pages, [], ["url"])


def campaign_facts(spark, d):
    e = A.with_mitre(telemetry(spark, d))
    return G.campaign_facts(e, G.members(e))


def campaign_scores(spark, d):
    """Campaign scores from the best confidence of their events' hits."""
    best = hits(spark, d).groupBy("event_uid").agg(F.max("confidence_score").alias("confidence"))
    e = A.with_mitre(telemetry(spark, d)).join(best, "event_uid", "left")
    return G.campaigns(e, G.edge_sums(e), G.members(e)).select("component", "nodes", "edges", "score")


def sequence_event_groups(spark, d):
    return Q.grouped_by_event(_linked(spark, d))


def sequence_image_boost(spark, d):
    b = _bursts(spark, d).withColumn("behavior", F.when(F.col("n") > 2, 0.5).otherwise(0.0))
    return Q.boost_by_image(b, _linked(spark, d)).select("burst_id", "in_sequence", F.round("boosted", 6).alias("boosted"))


def _decided(spark, d):
    b = _bursts(spark, d)
    top = F.max_by("stage", F.struct(S.stage_rank(F.col("stage")), "stage"))
    g = b.groupBy("computer", "image").agg(F.max("risk").alias("score"), top.alias("stage"), F.max("has_persistence").alias("has_persistence"), F.max("has_injection").alias("has_injection"))
    chains = _linked(spark, d).groupBy("computer", "image").agg(F.count("*").alias("sequence_hits"))
    g = g.join(chains, ["computer", "image"], "left").withColumn("sequence_hits", F.coalesce("sequence_hits", F.lit(0)))
    return C.decision_ladder(g).withColumn("entity", F.concat_ws("/", "computer", "image"))


def decision_ladder(spark, d):
    return _decided(spark, d).select("entity", "score", "stage", "sequence_hits", "decision", "why", "priority")


def response_tasks(spark, d):
    return C.response_tasks(_decided(spark, d), "entity")


def full_run_scores(spark, d):
    x = X._scores(spark, d).withColumn("modifier", F.when(F.col("n") % 3 == 0, 0.75).otherwise(1.0)).withColumn("feedback", F.when(F.col("n") > 3, -5).otherwise(0))
    return C.full_run_score(x, "computer", ("correlation",))


def _cases(spark, d):
    """One incident for each computer and rule; every third is closed."""
    found = hits(spark, d).withColumn("incident", F.concat_ws("/", "computer", "rule_id"))
    g = found.groupBy("incident").agg(F.min("t").alias("created_t"), F.max("confidence_score").alias("confidence"), F.count("*").alias("hits"))
    return g.withColumn("status", L._element(HOLDERS, F.col("hits") % 3)), found


def triage_reasons(spark, d):
    cases, found = _cases(spark, d)
    return W.triage(cases, found, ["incident"]).select("incident", "confidence", "status", "why")


def _tags(spark, d):
    """Tags of every seventh event, for the incident of the encoded shell of its computer, whether it belongs there or not."""
    return telemetry(spark, d).filter("k % 7 = 0").select(F.concat(F.col("computer"), F.lit("/DET-001")).alias("incident"), "event_uid", F.concat(F.lit("tag "), F.col("k").cast("string")).alias("tag"))


def valid_evidence(spark, d):
    return W.valid_evidence(_tags(spark, d), _cases(spark, d)[1], ["incident", "event_uid"])


def incident_detail(spark, d):
    cases, found = _cases(spark, d)
    return W.incident_detail(cases, found.filter("rule_id <> 'DET-003'").select("incident", "event_uid", "t", "event_code", "image", "parent_image", "command_line", "dst_ip", "user"), _tags(spark, d), "incident")


def incident_uids(spark, d):
    """The uid list of each computer's persistence incident, held as JSON, as rows."""
    found = hits(spark, d).filter("rule_id = 'DET-020'").groupBy("computer").agg(F.to_json(F.array_sort(F.collect_list("event_uid"))).alias("event_uids"))
    return W.uid_rows(found, "computer")


def expected_transitions(spark, d):
    names = F.array(*map(F.lit, K.TRANSITIONS))
    asked = telemetry(spark, d).select("event_uid", F.element_at(names, (F.col("event_code") % 7 + 1).cast("int")).alias("expected"))
    return W.expected_transitions(X.transitions(spark, d).join(asked, "event_uid")).select("event_uid", "current", "requested", "expected", "accepted", "reason")


def first_correlation(spark, d):
    e = telemetry(spark, d)
    links = G.edges(A.with_mitre(e)).groupBy(F.col("b_event_id").alias("event_id")).agg(F.max("weight").alias("weight")).join(e.select("event_id", "computer", "image", "t"), "event_id")
    return Y.first_correlation(_bursts(spark, d), links)


def trimmed_far(spark, d):
    """Nodes near each computer's first edge: three steps, five where the best hit is surer than 80."""
    sure = hits(spark, d).filter("confidence_score > 80").select("computer").distinct()
    return Y.reachable(A.with_mitre(telemetry(spark, d)), 3, 20, sure)


def pattern_feedback(spark, d):
    """Feedback remembered by image, parent, stage and rule; every third memory has no image, every third but one the start of its name, every
    fifth no stage."""
    found = hits(spark, d)
    size = F.col("k") % 7 * 7 - 25
    g = found.groupBy("image", "parent_image", F.col("kill_chain_stage").alias("stage"), "rule_id").agg(F.max_by(F.struct("k", size.alias("adjustment")), F.struct("t", "event_id")).alias("x")).select("*", "x.*").filter("adjustment % 2 = 0")
    memory = g.withColumn("image", F.when(F.col("k") % 3 == 1, F.upper(F.substring("image", 1, 4))).when(F.col("k") % 3 == 2, F.col("image"))).withColumn("stage", F.when(F.col("k") % 5 > 0, F.col("stage"))).drop("x")
    first = found.groupBy("computer", "image").agg(F.min_by("rule_id", F.struct("t", "event_id", "rule_id")).alias("rule_id"))
    return C.pattern_feedback(_bursts(spark, d).join(first, ["computer", "image"], "left"), memory).select("burst_id", "feedback")


QUERIES = {f.__name__: f for f in (
    burst_evidence, layered_stages, priorities, burst_order, burst_rollup, correlated_images, burst_hints, event_texts, pattern_sets, best_of_sources, activity, stage_summary, correlated_alerts, field_iocs, page_iocs, campaign_facts,
    campaign_scores, sequence_event_groups, sequence_image_boost, decision_ladder, response_tasks, full_run_scores, triage_reasons, valid_evidence, incident_detail, incident_uids, expected_transitions,
    first_correlation, trimmed_far, pattern_feedback,
)}


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({column}, '')), {_quote(w)})" for w in words) + ")" if words else "false"


def _kept(c: str) -> str:
    return f"coalesce(last({c} ORDER BY t, event_id) FILTER ({_any(c, K.HIGH_SIGNAL)}), first({c} ORDER BY t, event_id) FILTER ({c} IS NOT NULL))"


def _content() -> str:
    out = []
    for i, (words, codes, stage) in enumerate(K.CONTENT_STAGES):
        has = f"list_has_any(cset, {codes})"
        out.append(f"WHEN {f'says_{i} AND {has}' if words and codes else f'says_{i}' if words else has} THEN '{stage}'")
    return " ".join(out) + " WHEN (net_count > 0 AND ext) OR list_contains(cset, 22) THEN 'Command and Control' WHEN says_e THEN 'Execution'"


def _promote(a: str, b: str) -> str:
    return f"CASE WHEN coalesce({RANKS.format(b)}, 0) > {RANKS.format(a)} THEN {b} ELSE {a} END"


FOUND = HITS[HITS.index(", sig AS") :]
BURSTS = P.HOST + FOUND + """, ms AS (SELECT computer AS mc, image AS mi, burst_no AS mb, min(t) AS m_t, last(dst_port ORDER BY t, event_id) FILTER (dst_port IS NOT NULL) AS dst_port, """ + f"""{_kept('file_path')} AS target, {_kept('reg_key')} AS target_key,
  list_sort(list(DISTINCT event_code)) AS cset, bool_or(event_code IN (8, 25)) AS has_injection, """ + ", ".join(f"bool_or({_any('command_line', w)}) AS says_{i}" for i, (w, _, _) in enumerate(K.CONTENT_STAGES)) + f""", bool_or({_any('command_line', K.ENCODED_WORDS)}) AS says_e FROM hb_n GROUP BY 1, 2, 3),
  e0 AS (SELECT sb.* EXCLUDE (stage), ms.*, {EXTERNAL.format('dst_ip')} AS ext, (has_reg AND ({_any("concat_ws(' ', target, target_key)", K.PERSISTENT_KEYS)} OR {" OR ".join(f"coalesce(ends_with(lower(target), '{x}'), false)" for x in K.RUNNABLE)})) OR (exec_count > 0 AND has_file AND {_any('target', K.PERSISTENT_FILES)}) AS has_persistence
    FROM sb JOIN ms ON computer = mc AND image = mi AND start_t = m_t),
  e1 AS (SELECT *, CASE WHEN has_injection THEN 'Privilege Escalation' WHEN has_persistence THEN 'Persistence' WHEN (net_count >= 3 AND ext AND (n >= 5 OR exec_count = 0)) OR (net_count >= 5 AND NOT ext) THEN 'Command and Control' WHEN exec_count > 0 THEN 'Execution' ELSE 'Background' END AS flag_stage,
    CASE {_content()} END AS content_stage FROM e0),
  pr AS (SELECT computer, image, arg_max(kill_chain_stage, {RANKS.format('kill_chain_stage')}) AS prior_stage FROM hits WHERE t < {SPLIT_T} GROUP BY 1, 2), de AS (SELECT image, arg_max(kill_chain_stage, {RANKS.format('kill_chain_stage')}) AS detected FROM hits GROUP BY 1),
  e2 AS (SELECT e1.*, prior_stage, detected, {_promote('flag_stage', 'content_stage')} AS s1 FROM e1 LEFT JOIN pr USING (computer, image) LEFT JOIN de USING (image)), e3 AS (SELECT *, {_promote('s1', 'prior_stage')} AS s2 FROM e2), e4 AS (SELECT *, {_promote('s2', 'detected')} AS stage FROM e3),
  eb AS (SELECT *, {RANKS.format('stage')} AS rank FROM e4)"""
_CORRELATED = f", ci AS (SELECT computer, image, count(*) AS bursts, count(DISTINCT stage) AS stages, min(start_t) AS first_t FROM eb GROUP BY 1, 2 HAVING bursts >= 2 AND stages >= 2 AND {P.AS_OF_T} - min(start_t) >= 300000000)"
_PAYLOAD = r"regexp_extract(c, '(-enc|-e|-encoded\w+)\s+([a-z0-9+/= ]{10,})', 2)"
_NORMAL = rf"substr(trim(regexp_replace(regexp_replace(CASE WHEN {_PAYLOAD} <> '' THEN replace(c, {_PAYLOAD}, replace({_PAYLOAD}, ' ', '')) ELSE c END, '[0-9a-f]{{20,}}', '[HEX]', 'g'), '\s+', ' ', 'g')), 1, 100)"
LINKED = ", " + P.SEQUENCES + f", lc AS (SELECT event_uid AS last_uid, image, parent_image, lower(replace(command_line, '`', '')) AS c FROM tele), li AS (SELECT sq.*, image, parent_image, {_NORMAL} AS command FROM sq LEFT JOIN lc USING (last_uid))"
_BEST = ", ib AS (SELECT image AS si, max(confidence) AS sc FROM li GROUP BY 1)"
_DECIDED = BURSTS + LINKED + """, dg AS (SELECT computer, image, max(risk) AS score, arg_max(stage, rank) AS stage, bool_or(has_persistence) AS hp, bool_or(has_injection) AS hi FROM eb GROUP BY 1, 2), dh AS (SELECT computer, image, count(*) AS c FROM li GROUP BY 1, 2),
  dj AS (SELECT computer || '/' || image AS entity, score, stage, hp, hi, coalesce(c, 0) AS sequence_hits FROM dg LEFT JOIN dh USING (computer, image)),
  dk AS (SELECT *, CASE WHEN sequence_hits >= 2 AND score >= 45 THEN 'several chains' WHEN stage IN ('Lateral Movement', 'Command and Control') THEN 'critical stage' WHEN score >= 70 THEN 'high score' WHEN score >= 45 OR hp OR hi OR sequence_hits >= 1 THEN 'suspicious' WHEN score >= 20 THEN 'low score' ELSE 'normal' END AS why FROM dj),
  dl AS (SELECT *, CASE why WHEN 'suspicious' THEN 'INVESTIGATE' WHEN 'low score' THEN 'MONITOR' WHEN 'normal' THEN 'BASELINE' ELSE 'ESCALATE' END AS decision FROM dk)"""
_TASKS = "tk(o, k, task, urgency) AS (VALUES " + ", ".join(f"({i}, {_quote(k)}, {_quote(t)}, '{u}')" for i, (keys, t, u) in enumerate(K.TASKS) for k in keys) + ")"
_CASES = HITS + f""", hi AS (SELECT *, computer || '/' || rule_id AS incident FROM hits), cg AS (SELECT incident, min(t) AS created_t, max(confidence_score) AS confidence, count(*) AS n FROM hi GROUP BY 1), ca AS (SELECT *, [{", ".join(map(_quote, HOLDERS))}][n % 3 + 1] AS status FROM cg),
  tg AS (SELECT computer || '/DET-001' AS incident, event_uid, 'tag ' || k AS tag FROM tele WHERE k % 7 = 0)"""
_KEY = "lower(coalesce(reg_key, file_path, '?'))"


def _template(text: str) -> str:
    names = {"image": "coalesce(image, 'Unknown process')", "key": _KEY, "image_loaded": "'?'", "dns_query": "'?'"}
    for n in ("dst_ip", "dst_port", "file_path", "reg_key"):
        names[n] = f"coalesce({n}, '?')"
    out, rest = [], text
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [_quote(before), names[name]]
    return " || ".join([*out, _quote(rest)])


def _sets_case() -> list[str]:
    text = "lower(concat_ws(' ', image, parent_image, command_line, file_path, reg_key, dst_ip, \"user\"))"
    return ["(" + " AND ".join("(" + " OR ".join(f"regexp_matches({text}, {_quote(p)})" for p in g) + ")" for g in groups) + ")" for groups in SETS.values()]


_RISKY, _STRICT = (", ".join(map(_quote, x)) for x in (K.RISKY_STAGES, K.STRICT_STAGES))
SQL = {
    "pattern_feedback": BURSTS + f""", fm AS (SELECT image, parent_image, kill_chain_stage AS stage, rule_id, k, k % 7 * 7 - 25 AS a FROM hits QUALIFY row_number() OVER (PARTITION BY image, parent_image, kill_chain_stage, rule_id ORDER BY t DESC, event_id DESC) = 1),
      fn AS (SELECT CASE k % 3 WHEN 1 THEN upper(substr(image, 1, 4)) WHEN 2 THEN image END AS i, parent_image AS p, CASE WHEN k % 5 > 0 THEN stage END AS s, rule_id AS r, greatest(-20, least(15, a)) AS adj FROM fm WHERE a % 2 = 0),
      fr AS (SELECT computer, image, rule_id FROM hits QUALIFY row_number() OVER (PARTITION BY computer, image ORDER BY t, event_id, rule_id) = 1),
      fb AS (SELECT burst_id, stage, coalesce(i <> '' AND contains(lower(image), lower(i)), false) AS mi, coalesce(p <> '' AND contains(lower(parent_image), lower(p)), false) AS mp, coalesce(s = stage, false) AS ms, coalesce(r = rule_id, false) AS mr, adj FROM (SELECT eb.*, rule_id FROM eb LEFT JOIN fr USING (computer, image)) CROSS JOIN fn),
      fc AS (SELECT * FROM fb WHERE CASE WHEN stage IN ({_STRICT}) AND adj < 0 AND NOT mr THEN false WHEN stage IN ({_RISKY}) AND NOT (mr OR (mi AND ms)) THEN false
        ELSE 3 * mi::INT + 2 * mp::INT + 2 * ms::INT + 3 * mr::INT >= CASE WHEN stage IN ({_RISKY}) THEN 5 ELSE 2 END END),
      fd AS (SELECT burst_id, adj FROM fc QUALIFY row_number() OVER (PARTITION BY burst_id ORDER BY abs(adj) DESC, adj DESC) = 1) SELECT burst_id, coalesce(adj, 0)::INT AS feedback FROM eb LEFT JOIN fd USING (burst_id)""",
    "first_correlation": P.EDGES + BURSTS[BURSTS.index(", hb_c AS") :] + """, lw AS (SELECT computer, image, t, w FROM (SELECT b_event_id AS event_id, max(weight) AS w FROM ed GROUP BY 1) JOIN tele USING (event_id)),
      lf AS (SELECT burst_id, lw.t AS link_t, w AS link_weight FROM eb JOIN lw ON eb.computer = lw.computer AND eb.image = lw.image AND abs(lw.t - start_t) <= 900000000 QUALIFY row_number() OVER (PARTITION BY burst_id ORDER BY lw.t, w) = 1)
      SELECT burst_id, link_t, link_weight FROM eb LEFT JOIN lf USING (burst_id)""",
    "trimmed_far": P.EDGES.replace("WITH ev", "WITH RECURSIVE ev", 1) + FOUND + """, su AS (SELECT DISTINCT computer FROM hits WHERE confidence_score > 80), rr AS (SELECT computer, min(a_event_id) AS node, 0 AS depth FROM ed GROUP BY 1
        UNION SELECT rr.computer, b_event_id, depth + 1 FROM rr JOIN ed ON ed.a_event_id = node AND ed.computer = rr.computer WHERE depth < CASE WHEN rr.computer IN (SELECT computer FROM su) THEN 5 ELSE 3 END),
      rm AS (SELECT computer, node, min(depth) AS depth FROM rr GROUP BY 1, 2) SELECT computer, node, depth FROM rm QUALIFY row_number() OVER (PARTITION BY computer ORDER BY depth, node) <= 20""",
    "burst_evidence": BURSTS + "SELECT burst_id, dst_port, target, target_key, array_to_string(cset, ',') AS codes, has_injection, has_persistence FROM eb",
    "layered_stages": BURSTS + "SELECT burst_id, flag_stage, content_stage, stage FROM eb",
    "priorities": BURSTS + LINKED + _CORRELATED + _BEST + """SELECT burst_id, risk + 2 * rank + CASE WHEN has_persistence THEN 10 ELSE 0 END + CASE WHEN has_injection THEN 15 ELSE 0 END + CASE WHEN ci.stages IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN net_count > 0 THEN 5 ELSE 0 END + CASE WHEN sc IS NOT NULL THEN 20 ELSE 0 END AS priority_score
      FROM eb LEFT JOIN ci USING (computer, image) LEFT JOIN ib ON si = image ORDER BY 2 DESC, start_t, burst_id LIMIT 10""",
    "burst_order": BURSTS + "SELECT burst_id, computer, row_number() OVER (PARTITION BY computer ORDER BY risk DESC, rank DESC, n DESC, start_t, burst_id) AS place FROM eb",
    "burst_rollup": BURSTS + f"""SELECT image, computer, start_t // {WEEK} AS run, start_t // 3600000000 AS hour, count(*) AS bursts, sum(n)::BIGINT AS events, max(risk) AS peak_risk, sum(exec_count)::BIGINT AS execs, sum(net_count)::BIGINT AS nets, count(*) FILTER (has_file) AS files, count(*) FILTER (has_reg) AS regs,
      array_to_string(list_sort(list_distinct(flatten(list(cset)))), ',') AS codes, arg_max(stage, rank) AS stage FROM eb GROUP BY 1, 2, 3, 4""",
    "correlated_images": BURSTS + _CORRELATED + "SELECT *, CASE WHEN stages >= 3 THEN 30 ELSE 20 END AS strength FROM ci",
    "burst_hints": BURSTS + LINKED + _BEST + """, tp AS (SELECT *, max(rank) OVER (PARTITION BY computer) AS top_rank, arg_max(stage, rank) OVER (PARTITION BY computer) AS top FROM eb)
      SELECT burst_id, concat_ws(';', CASE WHEN n > 10 THEN 'high frequency' END, CASE WHEN sc IS NOT NULL THEN 'sequence linked' END, CASE WHEN parent_image <> '' AND parent_image NOT IN (""" + ", ".join(f"'{b}'" for b in K.BENIGN_PARENTS) + """) THEN 'abnormal parent' END) AS reasons,
        CASE WHEN top_rank > rank THEN top END AS stage_hint FROM tp LEFT JOIN ib ON si = image""",
    "event_texts": TELE + "SELECT event_uid, CASE WHEN event_code = 1 THEN image || ' executed' || CASE WHEN coalesce(parent_image, '') <> '' THEN ' (parent: ' || parent_image || ')' ELSE '' END "
      + " ".join(f"WHEN event_code = 13 AND {' OR '.join(f'contains({_KEY}, {_quote(w)})' for w in words).join('()')} THEN {_template(t)}" for words, t in K.REGISTRY_TEXTS) + " " + " ".join(f"WHEN event_code = {c} THEN {_template(t)}" for c, t in K.EVENT_TEXTS.items()) + " END AS text FROM tele",
    "pattern_sets": HITS + ", ps AS (SELECT event_uid, severity, list_filter([" + ", ".join(f"CASE WHEN {test} THEN {_quote(name)} END" for name, test in zip(SETS, _sets_case(), strict=True)) + """], lambda x: x IS NOT NULL) AS names FROM sig), pt AS (SELECT *, least(100, len(names) * 20 + CASE WHEN len(names) >= 3 THEN 20 ELSE 0 END) AS score FROM ps WHERE len(names) > 0)
      SELECT event_uid, unnest(names) AS rule_id, score::INT AS confidence_score, CASE WHEN score >= 60 THEN 'high' WHEN severity = 'low' THEN 'medium' ELSE severity END AS severity FROM pt""",
    "best_of_sources": "WITH al AS (" + L.SQL["all_detections"] + """) SELECT computer, rule_id, event_uid, confidence_score FROM al QUALIFY row_number() OVER (PARTITION BY computer ORDER BY CASE detection_source WHEN 'sequence' THEN 3 WHEN 'rule' THEN 2 ELSE 1 END DESC, confidence_score DESC, event_uid DESC) = 1""",
    "activity": TELE + """, pc AS (SELECT image, computer, parent_image, count(*) AS c FROM tele WHERE parent_image IS NOT NULL GROUP BY ALL), pm AS (SELECT image, computer, parent_image AS parent FROM pc QUALIFY row_number() OVER (PARTITION BY image, computer ORDER BY c DESC, parent_image) = 1),
      g AS (SELECT image, computer, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM tele GROUP BY 1, 2), r AS (SELECT *, n * 60000000::DOUBLE / greatest(last_t - first_t, 60000000) AS rt, (last_t - first_t) // 60000000 AS m FROM g)
      SELECT image, computer, first_t, last_t, n, parent, CASE WHEN m >= 60 THEN (m // 60) || 'h ' ELSE '' END || (m % 60) || 'm' AS duration, round(rt, 6) AS rate, CASE WHEN rt < 1 THEN 'low' WHEN rt < 10 THEN 'bursting' ELSE 'heavy' END AS state FROM r LEFT JOIN pm USING (image, computer)""",
    "stage_summary": BURSTS + "SELECT stage, count(*) AS n, 'bursts' AS basis FROM eb GROUP BY 1 UNION ALL SELECT kill_chain_stage, count(*), 'detections' FROM hits WHERE NOT EXISTS (SELECT 1 FROM eb) GROUP BY 1",
    "correlated_alerts": BURSTS + """, g AS (SELECT computer, max(risk) AS score, count(DISTINCT stage) FILTER (stage <> 'Background') AS stages, avg(risk) FILTER (risk >= 40) AS m FROM eb GROUP BY 1), h AS (SELECT computer, score, stages, round(least(30.0::DOUBLE, coalesce(m, 0) * 0.3::DOUBLE) * CASE WHEN stages < 2 THEN 0.5::DOUBLE ELSE 1.0 END, 6) AS correlation FROM g),
      l AS (SELECT *, CASE WHEN score >= 75 AND (stages >= 2 OR correlation > 0) THEN 'critical' WHEN score >= 75 THEN 'high' WHEN score >= 45 AND stages >= 1 THEN 'medium' ELSE 'low' END AS alert FROM h) SELECT *, alert <> 'low' AS alertable FROM l""",
    "field_iocs": TELE + f""", fi AS (SELECT 'ip' AS ioc_type, dst_ip AS value, event_uid, t, 'dst_ip' AS field FROM tele WHERE {EXTERNAL.format('dst_ip')} UNION ALL SELECT 'url', unnest(list_distinct(regexp_extract_all(lower(command_line), 'https?://[^\\s"''<>]+'))), event_uid, t, 'command_line' FROM tele
        UNION ALL SELECT 'domain', unnest(list_distinct(regexp_extract_all(lower(command_line), '{K.DOMAIN}'))), event_uid, t, 'command_line' FROM tele)
      SELECT ioc_type, value, 'IOC-' || substr(sha256(ioc_type || ':' || value), 1, 12) AS ioc_id, first(event_uid ORDER BY t, event_uid) AS first_uid, first(field ORDER BY t, event_uid) AS field, count(*) AS seen, 70 AS confidence FROM fi GROUP BY 1, 2""",
    "page_iocs": f"""WITH fi AS (SELECT 'url' AS ioc_type, unnest(list_distinct(regexp_extract_all(lower(coalesce(url, '')), 'https?://[^\\s"''<>]+'))) AS value, page_id FROM pages UNION ALL SELECT 'domain', unnest(list_distinct(regexp_extract_all(lower(coalesce(url, '')), '{K.DOMAIN}'))), page_id FROM pages)
      SELECT ioc_type, value, 'IOC-' || substr(sha256(ioc_type || ':' || value), 1, 12) AS ioc_id, min(page_id)::VARCHAR AS first_uid, 'url' AS field, count(*) AS seen, 70 AS confidence FROM fi GROUP BY 1, 2""",
    "campaign_facts": P.COMP + """, cn AS (SELECT cp.component, sx.* FROM sx JOIN cp ON event_id = node), cm AS (SELECT component, count(*) AS events, first(image ORDER BY t, event_id) AS fi, first(computer ORDER BY t, event_id) AS fc, min(t) AS first_t, max(t) AS last_t, count(DISTINCT "user") AS n_users, count(DISTINCT image) AS n_images,
        array_to_string(list_sort(list(DISTINCT "user"))[1:10], ',') AS users, array_to_string(list_sort(list(DISTINCT image))[1:10], ',') AS images FROM cn GROUP BY 1),
      cq AS (SELECT component, string_agg(kill_chain_stage, ' > ' ORDER BY rk) AS stages, count(*) AS ns, arg_max(kill_chain_stage, rk) AS top FROM (SELECT DISTINCT component, kill_chain_stage, rk FROM cn) GROUP BY 1)
      SELECT component, 'CAMP-' || regexp_replace(lower(substr(fi, 1, 12)), '[^a-z0-9]', '_', 'g') || '-' || regexp_replace(lower(substr(fc, 1, 8)), '[^a-z0-9]', '_', 'g') || '-' || strftime(make_timestamp(first_t), '%Y%m%d') AS campaign_id, events, first_t, last_t, stages, n_users, users, n_images, images,
        fi || ' on ' || fc || ': ' || events || ' events over ' || ns || ' stages, up to ' || top AS narrative FROM cm JOIN cq USING (component)""",
    "campaign_scores": P.COMP + FOUND + """, eh AS (SELECT event_uid, max(confidence_score) AS cf FROM hits GROUP BY 1), nn AS (SELECT component, count(*) AS nodes, count(DISTINCT kill_chain_stage) AS stages, bool_or(event_code IN (12, 13, 14)) AS pe, bool_or(event_code = 3) AS ne, coalesce(max(cf), 0) AS base FROM sx JOIN cp ON event_id = node LEFT JOIN eh USING (event_uid) GROUP BY 1),
      ee AS (SELECT component, count(*) AS edges, sum(weight) AS weight, count(*) FILTER (direction = 'forward') AS fw, count(*) FILTER (direction = 'backward') AS bw FROM ed JOIN cp ON a_event_id = node GROUP BY 1)
      SELECT component, nodes, edges, round(least(100.0::DOUBLE, greatest(10.0::DOUBLE, 0.5 * least(50.0::DOUBLE, least(20.0::DOUBLE, 5 * weight) + CASE WHEN bw = 0 THEN least(15, 5 * fw) ELSE 0 END) + CASE WHEN base > 0 THEN base ELSE 30 END + CASE WHEN pe THEN 15 ELSE 0 END + CASE WHEN ne THEN 10 ELSE 0 END)
        * CASE least(5, stages + 1) WHEN 3 THEN 1.5 WHEN 4 THEN 2.5 WHEN 5 THEN 4.0 ELSE 1.0 END), 6) AS score FROM nn JOIN ee USING (component)""",
    "sequence_event_groups": P.HOST + LINKED + """, sg AS (SELECT image, coalesce(parent_image, '') AS parent_image, pattern_id, computer, command, last_t // 30000000 AS bucket, max(confidence) AS best, count(*) AS freq FROM li GROUP BY ALL)
      SELECT *, floor(best / ln(1.0 + freq) * CASE WHEN freq > 5 THEN 0.5 ELSE 1.0 END)::INT AS confidence FROM sg""",
    "sequence_image_boost": BURSTS + LINKED + _BEST + "SELECT burst_id, sc IS NOT NULL AS in_sequence, round(least(100.0::DOUBLE, risk + least(10.0::DOUBLE, coalesce(sc, 0) / 10 * (0.5::DOUBLE + CASE WHEN n > 2 THEN 0.5 ELSE 0.0 END))), 6) AS boosted FROM eb LEFT JOIN ib ON si = image",
    "decision_ladder": _DECIDED + "SELECT entity, score, stage, sequence_hits, decision, why, CASE decision WHEN 'ESCALATE' THEN 'P1' WHEN 'INVESTIGATE' THEN 'P2' WHEN 'MONITOR' THEN 'P3' ELSE 'P4' END AS priority FROM dl",
    "response_tasks": _DECIDED + ", " + _TASKS + ", tu AS (SELECT DISTINCT entity, o, task, urgency FROM dl JOIN tk ON k = decision OR k = stage) SELECT entity, (row_number() OVER (PARTITION BY entity ORDER BY o) - 1)::INT AS place, task, urgency FROM tu",
    "full_run_scores": X.SCORES + """, fx AS (SELECT b.*, v.bh, v.co, v.n, greatest(0.0::DOUBLE, least(100.0::DOUBLE, b.score + CASE WHEN v.n > 3 THEN -5 ELSE 0 END)) AS s0, CASE WHEN v.n % 3 = 0 THEN 0.75::DOUBLE ELSE 1.0 END AS mo FROM bs2 b JOIN v USING (burst_id)),
      fy AS (SELECT *, row_number() OVER (PARTITION BY computer ORDER BY s0 DESC, burst_id) AS k1, row_number() OVER (PARTITION BY computer ORDER BY mo, burst_id) AS k2 FROM fx),
      fd AS (SELECT computer, driver AS dominant, c, sum(c) OVER (PARTITION BY computer) AS rel FROM (SELECT computer, driver, count(*) AS c FROM fy WHERE s0 >= 30 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY computer ORDER BY c DESC, driver) = 1),
      fg AS (SELECT computer, avg(s0) FILTER (k1 <= 3 AND s0 >= 45) AS top, count(*) FILTER (s0 >= 45) AS strong, max(s0) AS best, avg(mo) AS mm, count(*) AS n, min(mo) AS m1, max(mo) FILTER (k2 = 2) AS m2, avg(bh) FILTER (s0 >= 30) AS b, avg(co) FILTER (s0 >= 30) AS c0 FROM fy GROUP BY 1),
      fh AS (SELECT *, coalesce(c / rel > 0.7 AND CASE WHEN dominant = 'behavior' THEN b WHEN dominant = 'correlation' THEN c0 / 100 ELSE 0.5 END > 0.5, false) AS consistent, 0.8::DOUBLE * mm + 0.2::DOUBLE * CASE WHEN n > 2 THEN m2 ELSE m1 END AS modifier, round(CASE WHEN strong > 0 THEN top * (1 - 1.0::DOUBLE / (1 + strong)) ELSE best * 0.5 END, 4) AS raw FROM fg LEFT JOIN fd USING (computer))
      SELECT computer, strong, best, dominant, consistent, round(modifier, 6) AS modifier, round(round(greatest(raw + CASE WHEN consistent THEN 5 ELSE 0 END, best) * modifier * 0.85::DOUBLE, 6), 0)::INT AS run_score FROM fh""",
    "valid_evidence": _CASES + "SELECT incident, event_uid, tag FROM tg WHERE (incident, event_uid) IN (SELECT (incident, event_uid) FROM hi)",
    "incident_detail": _CASES + """, im AS (SELECT * FROM hi WHERE rule_id <> 'DET-003') SELECT ca.incident, ca.status, row_number() OVER (PARTITION BY ca.incident ORDER BY im.t, im.event_uid)::INT AS place, im.event_uid, im.t, im.event_code, coalesce(im.image, '') AS image, coalesce(im.parent_image, '') AS parent_image, coalesce(im.command_line, '') AS command_line,
      coalesce(im.dst_ip, '') AS dst_ip, coalesce(im."user", '') AS "user", tg.tag, im.event_uid IS NOT NULL AS valid FROM ca LEFT JOIN im ON im.incident = ca.incident LEFT JOIN tg ON tg.incident = ca.incident AND tg.event_uid = im.event_uid""",
    "incident_uids": HITS + "SELECT computer, (row_number() OVER (PARTITION BY computer ORDER BY event_uid) - 1)::INT AS place, event_uid FROM hits WHERE rule_id = 'DET-020'",
    "expected_transitions": "WITH xt AS (" + X.SQL["transitions"] + f"), ev2 AS (SELECT event_id::VARCHAR AS event_uid, {X._NAMES}[CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 11 WHEN 'signup' THEN 13 WHEN 'error' THEN 22 END % 7 + 1] AS expected FROM events) "
      "SELECT event_uid, current, requested, expected, accepted AND expected = current AS accepted, CASE WHEN expected <> current THEN 'changed meanwhile' ELSE reason END AS reason FROM xt JOIN ev2 USING (event_uid)",
}
