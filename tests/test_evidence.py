"""Evidence, stages, sets, scores and cases on planted rows that the driver's events don't hold."""

from pyspark.sql import functions as F

from tidewatch.functions import signals as S
from tidewatch.operators import bursts as B
from tidewatch.operators import casework as W
from tidewatch.operators import hunt as H
from tidewatch.operators import report as A
from tidewatch.operators import rules as R
from tidewatch.operators import scoring as C

EVENT = "event_id long, event_uid string, t long, computer string, user string, pid string, image string, parent_image string, command_line string, event_code int, dst_ip string, dst_port string, file_path string, reg_key string, value double, severity string"


def events(spark, *rows):
    base = {"computer": "pc", "user": "u", "pid": "1", "image": "a.exe", "command_line": "a", "event_code": 1, "value": 1.0, "severity": "low"}
    names = [c.split()[0] for c in EVENT.split(", ")]
    full = [base | {"event_id": i, "event_uid": str(i), "t": i * 1_000_000} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], EVENT)


def staged(spark, *rows):
    b = B.with_persistence(B.bursts(events(spark, *rows), ["computer", "image"], 900, B.evidence()))
    return B.layered_stage(b).first()


def test_stages_follow_their_precedence(spark):
    assert staged(spark, {"event_code": 8})["stage"] == "Privilege Escalation"
    assert staged(spark, {"event_code": 10}, {"command_line": "vssadmin delete shadows"})["stage"] == "Actions on Objectives"
    assert staged(spark, {"event_code": 10}, {"command_line": None})["content_stage"] == "Privilege Escalation"
    assert staged(spark, {"event_code": 12, "command_line": "x services"})["content_stage"] == "Persistence"
    assert staged(spark, {"event_code": 5, "command_line": "x services"})["stage"] == "Background"
    assert staged(spark, {"event_code": 3, "dst_ip": "203.0.113.1"})["stage"] == "Command and Control"
    assert staged(spark, {"event_code": 3, "dst_ip": "10.0.0.1"})["stage"] == "Background"
    assert staged(spark, *[{"event_code": 3, "dst_ip": "10.0.0.1"}] * 5)["flag_stage"] == "Command and Control"


def test_targets_keep_what_weighs_more(spark):
    row = staged(spark, {"event_code": 13, "reg_key": "first"}, {"event_code": 13, "reg_key": "HKLM\\Services\\x"}, {"event_code": 13, "reg_key": "later"})
    assert row["target_key"] == "HKLM\\Services\\x" and row["has_persistence"] and row["code_set"] == [13]
    row = staged(spark, {"event_code": 13, "reg_key": "first"}, {"event_code": 13, "reg_key": "later"})
    assert row["target_key"] == "first" and not row["has_persistence"]
    row = staged(spark, {"event_code": 1}, {"event_code": 11, "file_path": "C:\\Windows\\System32\\Tasks\\t"})
    assert row["has_persistence"] and row["flag_stage"] == "Persistence"
    assert B.bursts(events(spark).limit(0), ["computer", "image"], 900, B.evidence()).count() == 0


def test_event_texts(spark):
    rows = events(
        spark, {"event_code": 13, "reg_key": "HKLM\\X\\Image File Execution Options\\y"}, {"event_code": 13, "image": None}, {"event_code": 25}, {"event_code": 99},
        {"event_code": 13, "reg_key": "HKCU\\Software\\Winlogon"}, {"event_code": 1, "parent_image": "p.exe"}, {"event_code": 3, "dst_ip": "1.2.3.4"},
    )
    assert [r["text"] for r in S.event_text(rows).orderBy("event_id").collect()] == [
        "IFEO hijack — a.exe modified Image File Execution Options: hklm\\x\\image file execution options\\y", "Unknown process set registry value: ?", "a.exe tampered with a process image", None,
        "Winlogon hijack by a.exe: hkcu\\software\\winlogon", "a.exe executed (parent: p.exe)", "a.exe made outbound connection to 1.2.3.4:?",
    ]


def test_pattern_sets_need_each_group_and_raise_severity(spark):
    sets = {"x": [["alpha"], ["beta", "gamma"]], "y": [["alpha"]], "z": [["gamma"]]}
    rows = events(spark, {"command_line": "ALPHA"}, {"command_line": "alpha", "file_path": "gamma"}, {"command_line": None})
    out = R.pattern_sets(rows, sets, ["command_line", "file_path"]).orderBy("event_id")
    assert [(r["set_names"], r["set_score"], r["severity"]) for r in out.collect()] == [(["y"], 20, "medium"), (["x", "y", "z"], 80, "high"), ([], 0, "low")]
    assert R.set_detections(out).count() == 4


def test_parent_and_child_rule(spark):
    rule = R.Rule("P", "p", "high", 50, "T", "Execution", "Execution", parent_child=(("word", "cmd"), ("word", "shell")))
    rows = events(spark, {"parent_image": "winword.exe", "image": "CMD.exe"}, {"parent_image": "winword.exe", "image": "calc.exe"}, {"image": "cmd.exe"})
    assert [r["event_uid"] for r in R.match_rules(R.with_signals(rows), [rule]).collect()] == ["0"]


def test_known_domains_are_left_out_unless_regular(spark):
    calls = lambda image, ip, gaps: [{"image": image, "event_code": 3, "dst_ip": ip, "t": 1_000_000 * sum(gaps[:i])} for i in range(len(gaps) + 1)]
    odd, even = [60, 75, 50, 70, 60, 80], [60] * 6
    rows = events(spark, *calls("chrome.exe", "a.google.com", odd), *calls("chrome.exe", "b.google.com", even), *calls("tool.exe", "c.google.com", odd), *calls("chrome.exe", "203.0.113.9", odd))
    assert sorted((r["image"], r["dst_ip"]) for r in H.beacons(rows).collect()) == [("chrome.exe", "203.0.113.9"), ("chrome.exe", "b.google.com"), ("tool.exe", "c.google.com")]


def test_indicators_are_typed_and_first_seen(spark):
    rows = events(spark, {"command_line": "get HTTPS://Evil.Example.COM/x", "dst_ip": "8.8.8.8"}, {"command_line": "ping evil.example.com", "dst_ip": "203.0.113.5"}, {"command_line": None, "dst_ip": "192.168.0.1"})
    got = {(r["ioc_type"], r["value"], r["first_uid"], r["seen"]) for r in H.field_iocs(rows, ["dst_ip"], ["command_line"]).collect()}
    assert got == {("url", "https://evil.example.com/x", "0", 1), ("domain", "evil.example.com", "0", 2), ("ip", "203.0.113.5", "1", 1)}


def test_decisions_and_tasks(spark):
    schema = "id string, score int, stage string, sequence_hits int, has_persistence boolean, has_injection boolean"
    rows = spark.createDataFrame([("a", 50, "Execution", 2, False, False), ("b", 5, "Lateral Movement", 0, False, False), ("c", 5, "Execution", 0, True, False), ("d", 20, "Execution", 0, False, False), ("e", 19, "Credential Access", 0, False, False)], schema)
    decided = C.decision_ladder(rows)
    assert [r["decision"] for r in decided.orderBy("id").collect()] == ["ESCALATE", "ESCALATE", "INVESTIGATE", "MONITOR", "BASELINE"]
    assert {r["id"]: r["count"] for r in C.response_tasks(decided, "id").groupBy("id").count().collect()} == {"a": 8, "b": 9, "c": 3, "d": 2, "e": 1}


def test_run_scores_by_hand(spark):
    schema = "run string, burst_id string, score double, driver string, behavior double, correlation double, modifier double, feedback int"
    rows = [("a", str(i), s, "behavior", 0.9, 0.0, m, None) for i, (s, m) in enumerate([(90.0, 1.0), (60.0, 1.0), (60.0, 0.5), (50.0, 1.0)])]
    rows += [("b", "9", 40.0, "rule", 0.0, 0.0, 1.0, 0)]
    got = {r["run"]: r for r in C.full_run_score(spark.createDataFrame(rows, schema), "run").collect()}
    assert got["a"]["consistent"] and got["a"]["modifier"] == 0.9 and got["a"]["run_score"] == round(90 * 0.9)  # 70 * 0.8 + 5 = 61 is below the best
    assert got["b"]["run_score"] == 40 and not got["b"]["consistent"]
    failed = {r["run"]: r["run_score"] for r in C.full_run_score(spark.createDataFrame(rows, schema), "run", ("rule", "sequence")).collect()}
    assert failed == {"a": 28, "b": 14}


def test_cases(spark):
    cases = spark.createDataFrame([("i", "New", 80, 1), ("j", "Closed - Benign", 99, 1), ("k", "Triage", 80, 0)], "incident string, status string, confidence int, created_t long")
    hits = spark.createDataFrame([("i", "1", 50, ["weak"]), ("i", "2", 80, ["image a", "path b"])], "incident string, event_uid string, confidence_score int, match_reason array<string>")
    assert [(r["incident"], r["why"]) for r in W.triage(cases, hits, ["incident"]).orderBy("created_t").collect()] == [("k", None), ("i", "image a; path b")]
    members = events(spark, {}, {}).withColumn("incident", F.lit("i"))
    tags = spark.createDataFrame([("i", "1", "x"), ("i", "77", "y")], "incident string, event_uid string, tag string")
    rows = W.incident_detail(cases, members, tags, "incident").orderBy("incident", "place").collect()
    assert [(r["incident"], r["event_uid"], r["tag"], r["valid"]) for r in rows] == [("i", "0", None, True), ("i", "1", "x", True), ("j", None, None, False), ("k", None, None, False)]
    assert [r["tag"] for r in W.valid_evidence(tags, members, ["incident", "event_uid"]).collect()] == ["x"]
    lists = spark.createDataFrame([(1, '["b", "a"]'), (2, "[]"), (3, None)], "n int, event_uids string")
    assert [tuple(r) for r in W.uid_rows(lists, "n").collect()] == [(1, 0, "b"), (1, 1, "a")]


def test_summary_falls_back_to_detections(spark):
    b = spark.createDataFrame([("Execution",)], "stage string")
    hits = spark.createDataFrame([("Persistence",), ("Persistence",)], "kill_chain_stage string")
    assert [tuple(r) for r in A.stage_summary(b, hits).collect()] == [("Execution", 1, "bursts")]
    assert [tuple(r) for r in A.stage_summary(b.limit(0), hits).collect()] == [("Persistence", 2, "detections")]
