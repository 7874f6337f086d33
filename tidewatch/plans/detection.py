"""Registered queries: signals, rules, reports and hunts, with the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.functions import signals as S
from tidewatch.operators import hunt as H
from tidewatch.operators import report as A
from tidewatch.operators import rules as R
from tidewatch.sources.telemetry import SQL as TELE
from tidewatch.sources.telemetry import telemetry


def _quoted(words) -> str:
    return ", ".join("'" + str(w).replace("'", "''") + "'" for w in words)


def _likes(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


SPLIT_T = 1705320000000000  # 2024-01-15 12:00 UTC, between history and the present
PATTERNS = {"secret": r"(api|secret)[_ ]?key|token", "address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "license": r"licen[cs]e", "mail": r"[a-z0-9._]+@[a-z0-9.]+", "shout": r"!!"}
HUNT_SQL = {
    "encoded": "contains(lower(image), 'powershell') AND contains(lower(command_line), '-enc')",
    "public drop": "coalesce(contains(lower(file_path), 'public'), false) OR coalesce(contains(lower(reg_key), 'currentversion\\run'), false)",
    "not local": "event_code = 3 AND NOT coalesce(contains(lower(dst_ip), '10.0.0.'), false)",
}

SEVERITY = f"CASE WHEN event_code IN ({', '.join(map(str, K.HIGH_CODES))}) THEN 'high' WHEN event_code IN ({', '.join(map(str, K.MEDIUM_CODES))}) THEN 'medium' ELSE 'low' END"
EXTERNAL = r"coalesce({0} <> '' AND NOT regexp_matches(lower({0}), '^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|127\.|::1|fe80:)'), false)"
ODD_PARENT = f"coalesce(parent_image <> '' AND lower(parent_image) NOT IN ({_quoted(K.BENIGN_PARENTS)}), false)"
HITS = TELE + rf""", sig AS (
  SELECT *, {SEVERITY} AS severity, coalesce(lower(replace(coalesce(file_path, reg_key), '\registry\machine\', 'hklm\')), '') AS path,
    regexp_matches(command_line, '(?:[A-Za-z0-9+/]{{4}}){{4,}}(?:[A-Za-z0-9+/]{{2}}==|[A-Za-z0-9+/]{{3}}=|[A-Za-z0-9+/]{{4}})') AS b64,
    (contains(lower(command_line), '-enc ') OR contains(lower(command_line), ' -e ')) AS enc
  FROM tele),
rl(rule_id, rule_severity, base, mitre_id, mitre_tactic, kill_chain_stage) AS (VALUES
  ('DET-001', 'high', 75, 'T1059.001', 'Execution', 'Execution'), ('DET-003', 'medium', 55, 'T1059.001', 'Execution', 'Execution'), ('DET-004', 'high', 70, 'T1059.003', 'Execution', 'Execution'),
  ('DET-020', 'high', 80, 'T1547.001', 'Defense Evasion', 'Persistence'), ('DET-031', 'medium', 60, 'T1105', 'Command and Control', 'Command and Control'), ('DET-040', 'low', 45, 'T1041', 'Exfiltration', 'Exfiltration')),
hits AS (
  SELECT sig.*, rl.*, 'rule' AS detection_source, least(100, base + CASE WHEN b64 OR enc THEN 10 ELSE 0 END) AS confidence_score
  FROM sig, rl WHERE CASE rule_id
    WHEN 'DET-001' THEN event_code = 1 AND contains(image, 'powershell') AND (contains(lower(command_line), '-enc ') OR contains(lower(command_line), '-encodedcommand') OR contains(lower(command_line), ' -e '))
    WHEN 'DET-003' THEN event_code = 1 AND contains(image, 'powershell') AND coalesce(parent_image, '') NOT IN ({_quoted(K.BENIGN_PARENTS)}) AND (contains(command_line, '-bypass') OR contains(command_line, '-noprofile'))
    WHEN 'DET-004' THEN event_code = 3 AND contains(image, 'cmd.exe') AND parent_image IN ('powershell.exe', 'certutil.exe')
    WHEN 'DET-020' THEN event_code IN (12, 13, 14) AND starts_with(path, 'hklm\software\microsoft\windows\currentversion\run')
    WHEN 'DET-031' THEN event_code = 11 AND severity = 'medium' AND starts_with(path, 'c:\users\public\')
    ELSE event_code = 3 AND value > 100.0 AND image = 'cmd.exe' END)
"""
RANKS = "list_position([" + _quoted(K.STAGES) + "], {0}) - 1"
STRENGTH = "(0.6 * confidence_score / 100 + 0.2 * 0.9 + 0.2 * CASE rule_severity WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5 WHEN 'critical' THEN 1.0 ELSE 0.3 END)"


def hits(spark, d):
    return R.match_rules(R.with_signals(telemetry(spark, d)))


def rule_hits(spark, d):
    return hits(spark, d).select("event_uid", "rule_id", "rule_severity", "confidence_score", "kill_chain_stage", F.array_join("match_reason", ";").alias("reason"))


def rule_summary(spark, d):
    return R.rule_summary(hits(spark, d))


def rule_fallback(spark, d):
    events = R.with_signals(telemetry(spark, d))
    return R.registry_fallback(events, R.match_rules(events)).select("event_uid", "rule_id", "mitre_id", "confidence_score", "rule_severity")


def primary_detection(spark, d):
    return R.primary_detection(hits(spark, d), ["computer", "image"])


def kill_chain_rollup(spark, d):
    return R.kill_chain_rollup(hits(spark, d), ["computer"])


def host_floor(spark, d):
    h = telemetry(spark, d).groupBy("computer", "image").agg(F.count("*").alias("n"))
    return R.host_floor(h, 400, 520).select("computer", "image", "n", "host_total", "floor")


def pattern_scan(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return R.pattern_scan(docs, F.lower("text"), PATTERNS).filter("yara_hits > 0").select("doc_id", F.array_join("yara_names", ",").alias("names"), "yara_hits", "yara_score")


def cmd_entropy(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    bits = docs.select("doc_id", "text", S.entropy(F.col("text")).alias("entropy"))
    return bits.select("doc_id", "entropy", S.high_entropy(F.col("text"), F.col("entropy")).alias("is_high"))


def cmd_signals(spark, d):
    e = telemetry(spark, d)
    c = F.col("command_line")
    return e.select("event_uid", S.severity(F.col("event_code")).alias("severity"), S.priority(F.col("event_code")).alias("priority"), S.encoded_flag(c).alias("encoded"), S.download_flag(c).alias("download"),
                    S.external_address(F.col("dst_ip")).alias("external"), S.suspicious_chain(F.col("parent_image")).alias("odd_chain"), F.col("image").isin(K.SYSTEM_PROCESSES).alias("system"),
                    S.lookup(F.col("image"), K.LOLBIN_WEIGHTS, 0.0).alias("lolbin_weight"), S.event_uid("computer", "t", "event_code", "image", "pid").alias("uid"))


def b64_scan(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    runs = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/]{20,}={0,2}"), F.lit(0))
    return docs.select("doc_id", F.size(runs).cast("long").alias("runs"), F.array_max(F.transform(runs, lambda x: F.length(x))).cast("long").alias("longest")).filter("runs > 0")


def normal_commands(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", S.normal_command(F.col("text")).alias("normal"))


def event_story(spark, d):
    return telemetry(spark, d).select("event_uid", S.description().alias("what"))


def severity_counts(spark, d):
    return A.severity_counts(R.with_signals(telemetry(spark, d)))


def top_codes(spark, d):
    return A.top_codes(telemetry(spark, d))


def events_per_hour(spark, d):
    return A.events_per_hour(telemetry(spark, d))


def mitre_summary(spark, d):
    return A.mitre_summary(telemetry(spark, d))


def lolbin_summary(spark, d):
    return A.lolbin_summary(telemetry(spark, d))


def execution_context(spark, d):
    return A.execution_context(telemetry(spark, d), 40)


def process_neighbours(spark, d):
    return A.process_neighbours(telemetry(spark, d), "cmd.exe")


def class_mix(spark, d):
    return A.class_mix(telemetry(spark, d))


def dominant_host(spark, d):
    return A.dominant_host(telemetry(spark, d))


def peer_baseline(spark, d):
    return A.peer_baseline(telemetry(spark, d))


def rare_processes(spark, d):
    return A.rare_processes(telemetry(spark, d), SPLIT_T, 6)


def new_addresses(spark, d):
    return A.new_addresses(telemetry(spark, d), SPLIT_T)


def recent_interesting(spark, d):
    return A.recent_interesting(telemetry(spark, d), ["powershell", "certutil"]).select("event_uid", "image", "t")


def raw_page(spark, d):
    return A.raw_page(telemetry(spark, d), 3).select("event_uid", "image", "t")


def hunt_filter(spark, d):
    where = H.any_of(H.all_of(H.term("process", "CERTUTIL"), ~H.term("cmd", "http")), H.all_of(H.term("port", "443"), H.term("user", "u1")))
    return H.hunt(telemetry(spark, d), where).select("event_uid", "image", "computer")


def saved_hunts(spark, d):
    hunts = {
        "encoded": H.all_of(H.term("image", "powershell"), H.term("cmd", "-enc")),
        "public drop": H.any_of(H.term("file", "public"), H.term("registry", "currentversion\\run")),
        "not local": H.all_of(H.term("event_id", "3"), ~H.term("ip", "10.0.0.")),
    }
    return H.saved_hunts(telemetry(spark, d), hunts)


def beacons(spark, d):
    return H.beacons(telemetry(spark, d), most_cv=1.0)


def iocs(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("text"), F.col("doc_id").alias("k"))
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.concat_ws(" ", "url", "html").alias("text"), F.col("page_id").alias("k"))
    return H.iocs(docs.unionByName(pages), "text", "k")


def ioc_lists(spark, d):
    return H.ioc_lists(telemetry(spark, d), "computer")


QUERIES = {f.__name__: f for f in (
    rule_hits, rule_summary, rule_fallback, primary_detection, kill_chain_rollup, host_floor, pattern_scan, cmd_entropy, cmd_signals, b64_scan, normal_commands, event_story, severity_counts, top_codes,
    events_per_hour, mitre_summary, lolbin_summary, execution_context, process_neighbours, class_mix, dominant_host, peer_baseline, rare_processes, new_addresses, recent_interesting, raw_page, hunt_filter,
    saved_hunts, beacons, iocs, ioc_lists,
)}

_MITRE = "mit(event_code, mitre_id, mitre_tactic) AS (VALUES " + ", ".join(f"({c}, '{m}', '{t}')" for c, m, t, _, _ in K.EVENT_CODES) + ")"
_FALLBACK = " ".join(f"WHEN {_likes('path', words)} THEN '{rule}'" for words, rule, *_ in K.FALLBACK_RULES)
_FALLBACK_ROWS = ", ".join(f"('{rule}', '{m}', {min(c, 70)}, '{s}')" for _, rule, m, c, s in K.FALLBACK_RULES)
SQL = {
    "rule_hits": HITS + """SELECT event_uid, rule_id, rule_severity, confidence_score, kill_chain_stage,
      CASE rule_id WHEN 'DET-001' THEN 'image ' || image || ';command ' || array_to_string(list_filter(['-enc ', '-encodedcommand', ' -e '], lambda w: contains(lower(command_line), w)), ', ')
        WHEN 'DET-003' THEN 'image ' || image || ';command ' || array_to_string(list_filter(['-bypass', '-noprofile'], lambda w: contains(lower(command_line), w)), ', ')
        WHEN 'DET-004' THEN 'image ' || image || ';parent ' || parent_image WHEN 'DET-040' THEN 'event code' ELSE 'path ' || path END AS reason FROM hits""",
    "rule_summary": HITS + "SELECT rule_id, image, mitre_id, min(t) AS first_seen, max(t) AS last_seen, count(*) AS n, count(DISTINCT parent_image) AS parents FROM hits GROUP BY ALL",
    "rule_fallback": HITS + f""", f AS (SELECT event_uid, CASE {_FALLBACK} END AS rule_id FROM sig WHERE event_code IN (12, 13, 14) AND NOT {_likes('path', K.REGISTRY_NOISE)}),
      fr(rule_id, mitre_id, confidence_score, rule_severity) AS (VALUES {_FALLBACK_ROWS}) SELECT event_uid, rule_id, mitre_id, confidence_score, rule_severity FROM f JOIN fr USING (rule_id) WHERE event_uid NOT IN (SELECT event_uid FROM hits)""",
    "primary_detection": HITS + f""", s AS (SELECT *, {STRENGTH} AS st, row_number() OVER (PARTITION BY computer, image ORDER BY round({STRENGTH}, 9) DESC, CASE rule_severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, confidence_score DESC, rule_id DESC, event_uid DESC) AS rk,
      count(*) OVER (PARTITION BY computer, image) AS supporting, max(confidence_score) OVER (PARTITION BY computer, image) AS supporting_max_conf FROM hits)
      SELECT computer, image, rule_id, event_uid, confidence_score, rule_severity, round(st, 6) AS strength, supporting, supporting_max_conf FROM s WHERE rk = 1""",
    "kill_chain_rollup": HITS + f""", s AS (SELECT DISTINCT computer, {RANKS.format('kill_chain_stage')} AS r, kill_chain_stage AS s FROM hits)
      SELECT computer, string_agg(s, ' > ' ORDER BY r) AS stages, arg_max(s, r) AS highest_stage FROM s GROUP BY computer""",
    "host_floor": TELE + ", h AS (SELECT computer, image, count(*) AS n FROM tele GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY computer)::BIGINT AS host_total FROM h) SELECT *, CASE WHEN host_total > 520 THEN 50 WHEN host_total > 400 THEN 45 ELSE 40 END AS floor FROM w",
    "pattern_scan": "WITH p AS (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in PATTERNS.items()) + """], lambda x: x IS NOT NULL) AS a FROM documents)
      SELECT doc_id, array_to_string(a, ',') AS names, len(a)::INT AS yara_hits, least(100, len(a) * 20 + CASE WHEN len(a) >= 3 THEN 20 ELSE 0 END)::INT AS yara_score FROM p WHERE len(a) > 0""",
    "cmd_entropy": """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), g AS (SELECT doc_id, ch, count(*)::DOUBLE AS c FROM c GROUP BY ALL),
      n AS (SELECT doc_id, c, sum(c) OVER (PARTITION BY doc_id) AS n FROM g), e AS (SELECT doc_id, round_even(sum(-(c / n) * log2(c / n)), 3) AS entropy FROM n GROUP BY 1)
      SELECT d.doc_id, coalesce(entropy, 0.0::DOUBLE) AS entropy, coalesce(length(text) >= 20 AND entropy > 4.5 + least(1.5, length(text) / 500.0), false) AS is_high FROM documents d LEFT JOIN e USING (doc_id)""",
    "cmd_signals": TELE + f"""SELECT event_uid, {SEVERITY} AS severity, CASE WHEN event_code IN (1, 13) THEN 'critical' WHEN event_code IN (3, 11, 22) THEN 'high' ELSE 'low' END AS priority,
      {_likes('lower(command_line)', ['-enc ', '-encodedcommand', ' -e ', '-ec '])} AS encoded, contains(lower(command_line), 'http://') AS download, {EXTERNAL.format('dst_ip')} AS external, {ODD_PARENT} AS odd_chain,
      image IN ({_quoted(K.SYSTEM_PROCESSES)}) AS system, CASE image WHEN 'powershell.exe' THEN 0.7::DOUBLE WHEN 'cmd.exe' THEN 0.5 WHEN 'certutil.exe' THEN 0.9 ELSE 0.0 END AS lolbin_weight,
      sha256(computer || '|' || t || '|' || event_code || '|' || image || '|' || pid) AS uid FROM tele""",
    "b64_scan": "WITH r AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9+/]{20,}={0,2}') AS a FROM documents) SELECT doc_id, len(a)::BIGINT AS runs, list_max(list_transform(a, lambda x: length(x)))::BIGINT AS longest FROM r WHERE len(a) > 0",
    "normal_commands": r"""WITH c AS (SELECT doc_id, replace(lower(coalesce(text, '')), '`', '') AS x FROM documents), p AS (SELECT *, regexp_extract(x, '(-enc|-e|-encoded\w+)\s+([a-z0-9+/= ]{10,})', 2) AS y FROM c)
      SELECT doc_id, substr(trim(regexp_replace(regexp_replace(CASE WHEN y <> '' THEN replace(x, y, replace(y, ' ', '')) ELSE x END, '[0-9a-f]{20,}', '[HEX]', 'g'), '\s+', ' ', 'g')), 1, 100) AS normal FROM p""",
    "event_story": TELE + """SELECT event_uid, CASE event_code WHEN 1 THEN coalesce(parent_image, 'unknown') || ' started ' || image WHEN 3 THEN image || ' connected to ' || coalesce(dst_ip, '?') || ':' || coalesce(dst_port, '?')
      WHEN 11 THEN image || ' wrote ' || file_path WHEN 13 THEN image || ' changed ' || reg_key ELSE image || ' resolved a name' END AS what FROM tele""",
    "severity_counts": TELE + f"SELECT {SEVERITY} AS severity, count(*) AS n FROM tele GROUP BY 1",
    "top_codes": TELE + "SELECT event_code, count(*) AS n FROM tele GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "events_per_hour": TELE + "SELECT (t // 3600000000) * 3600 AS hour_epoch, count(*) AS n FROM tele GROUP BY 1",
    "mitre_summary": TELE + f", {_MITRE} SELECT coalesce(mitre_tactic, 'Unknown') AS tactic, coalesce(mitre_id, 'Unmapped') AS technique, count(*) AS n FROM tele LEFT JOIN mit USING (event_code) GROUP BY 1, 2",
    "lolbin_summary": TELE + f""", g AS (SELECT image, count(*) AS executions, count(DISTINCT command_line) AS commands, count(DISTINCT CASE WHEN {ODD_PARENT} THEN parent_image END) AS odd_parents FROM tele WHERE image IN ({_quoted(K.LOLBIN_WEIGHTS)}) GROUP BY 1)
      SELECT *, CASE image WHEN 'powershell.exe' THEN 0.7::DOUBLE WHEN 'cmd.exe' THEN 0.5 ELSE 0.9 END AS weight, CASE WHEN odd_parents > 2 THEN 'suspicious' WHEN commands > 20 THEN 'review' ELSE 'normal' END AS verdict FROM g ORDER BY executions DESC, image LIMIT 10""",
    "execution_context": TELE + """, p AS (SELECT image, computer, parent_image, count(*) AS c FROM tele WHERE parent_image IS NOT NULL GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY image, computer ORDER BY c DESC, parent_image DESC) AS k FROM p),
      g AS (SELECT image, computer, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM tele GROUP BY ALL), r AS (SELECT *, n * 60.0 / greatest(60.0, (last_t - first_t) / 1000000.0) AS q FROM g)
      SELECT r.image, r.computer, first_t, last_t, n, round(q, 6) AS rate, CASE WHEN q < 1 THEN 'low' WHEN q < 10 THEN 'moderate' ELSE 'high' END AS activity, parent_image AS modal_parent
      FROM r LEFT JOIN m ON r.image = m.image AND r.computer = m.computer AND k = 1 ORDER BY n DESC, r.image, r.computer LIMIT 40""",
    "process_neighbours": TELE + "SELECT parent_image AS other, count(*) AS n, 'parent' AS role FROM tele WHERE image = 'cmd.exe' AND parent_image IS NOT NULL GROUP BY 1 UNION ALL SELECT image, count(*), 'child' FROM tele WHERE parent_image = 'cmd.exe' GROUP BY 1",
    "class_mix": TELE + "SELECT round(avg(CASE WHEN event_code IN (12, 13, 14) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS persistence_share, count(*) AS n FROM tele",
    "dominant_host": TELE + "SELECT computer, count(*) AS n FROM tele GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "peer_baseline": TELE + """, h AS (SELECT image, computer, count(*) AS c FROM tele GROUP BY ALL), s AS (SELECT image, count(*) AS hosts, round(avg(c), 6) AS mean_rate, round(stddev_samp(c), 6) AS std_rate FROM h GROUP BY 1),
      p AS (SELECT image, parent_image, row_number() OVER (PARTITION BY image ORDER BY count(*) DESC, parent_image) AS k FROM tele WHERE parent_image IS NOT NULL GROUP BY image, parent_image)
      SELECT s.*, (SELECT string_agg(parent_image, ',' ORDER BY k) FROM p WHERE p.image = s.image AND k <= 5) AS top_parents FROM s""",
    "rare_processes": TELE + f"SELECT computer, parent_image, image, count(*) FILTER (t < {SPLIT_T}) AS before, count(*) FILTER (t >= {SPLIT_T}) AS after FROM tele WHERE parent_image IS NOT NULL GROUP BY ALL HAVING after > 0 AND before <= 6",
    "new_addresses": TELE + f"SELECT computer, dst_ip, count(*) AS n, min(t) AS first_t FROM tele WHERE dst_ip IS NOT NULL GROUP BY ALL HAVING min(t) >= {SPLIT_T}",
    "recent_interesting": TELE + "SELECT event_uid, image, t FROM tele WHERE contains(image, 'powershell') OR contains(image, 'certutil') ORDER BY t DESC, event_uid LIMIT 100",
    "raw_page": TELE + "SELECT event_uid, image, t FROM tele ORDER BY t DESC, event_uid LIMIT 50 OFFSET 150",
    "hunt_filter": TELE + "SELECT event_uid, image, computer FROM tele WHERE (contains(image, 'certutil') AND NOT contains(command_line, 'http')) OR (coalesce(contains(dst_port, '443'), false) AND contains(\"user\", 'u1'))",
    "saved_hunts": TELE + " UNION ALL ".join(f"SELECT '{n}' AS hunt, count(*) AS hits FROM tele WHERE {w}" for n, w in HUNT_SQL.items()),
    "beacons": TELE + """, s AS (SELECT image, dst_ip, dst_port, t, (t - lag(t) OVER (PARTITION BY image, dst_ip, dst_port ORDER BY t, event_id)) / 1000000.0::DOUBLE AS step FROM tele WHERE event_code = 3 AND dst_ip IS NOT NULL),
      g AS (SELECT image, dst_ip, dst_port, count(*) AS hits, avg(step) AS m, stddev_pop(step) AS sd, min(t) AS first_t, max(t) AS last_t FROM s GROUP BY ALL)
      SELECT image, dst_ip, dst_port, hits, round(m, 4) AS mean_s, round(sd, 4) AS std_s, round(sd / m, 6) AS cv, trunc(least(99.0, greatest(0.0, 60 + 35 * (1 - sd / m / 0.2) + CASE WHEN sd < 1.5 THEN 10 ELSE 0 END + CASE WHEN sd < 0.5 THEN 10 ELSE 0 END)))::INT AS confidence, first_t, last_t
      FROM g WHERE hits >= 6 AND m >= 5 AND sd / m <= 1.0""",
    "iocs": "WITH r AS (SELECT lower(text) AS x, doc_id AS k FROM documents UNION ALL SELECT lower(concat_ws(' ', url, html)), page_id FROM pages), e AS (" + " UNION ALL ".join(f"SELECT '{n}' AS ioc_type, unnest(list_distinct(regexp_extract_all(x, '{p.replace(chr(39), chr(39) * 2)}'))) AS value, k FROM r" for n, p in H.IOC_PATTERNS.items()) + f"""),
      w AS (SELECT * FROM e WHERE ioc_type <> 'ip' OR {EXTERNAL.format('value')}) SELECT ioc_type, value, count(*) AS n, min(k) AS first_key, substr(sha256(ioc_type || '|' || value), 1, 16) AS ioc_id FROM w GROUP BY 1, 2""",
    "ioc_lists": TELE + f"""SELECT computer, coalesce(array_to_string(list_sort(list(DISTINCT dst_ip) FILTER ({EXTERNAL.format('dst_ip')}))[1:20], ','), '') AS ips,
      coalesce(array_to_string(list_sort(list(DISTINCT file_path) FILTER (file_path IS NOT NULL))[1:20], ','), '') AS files, coalesce(array_to_string(list_sort(list(DISTINCT reg_key) FILTER (reg_key IS NOT NULL))[1:20], ','), '') AS keys FROM tele GROUP BY 1""",
}
