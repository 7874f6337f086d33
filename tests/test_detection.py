"""Table-driven cases of the detection, scoring and hunting operators."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import signals as S
from tidewatch.operators import bursts as B
from tidewatch.operators import graph as G
from tidewatch.operators import hunt as H
from tidewatch.operators import rules as R
from tidewatch.operators import scoring as C
from tidewatch.operators import sequences as Q

EVENT = (
    "event_id long, event_uid string, t long, computer string, user string, pid string, ppid string, event_code int, image string, value double, k int, parent_image string, command_line string, "
    "dst_ip string, dst_port string, file_path string, reg_key string"
)
NAMES = [x.split()[0] for x in EVENT.split(", ")]
SEC = 1_000_000


def events(spark, rows):
    """Rows of named fields over one default event a second."""
    out = []
    for i, r in enumerate(rows):
        base = dict.fromkeys(NAMES) | {"event_id": i, "event_uid": str(i), "t": i * SEC, "computer": "h", "user": "u", "event_code": 1, "image": "a.exe", "value": 1.0}
        out.append(tuple((base | r)[c] for c in NAMES))
    return spark.createDataFrame(out, EVENT)


def test_rules_find_encoded_command_and_run_key(spark):
    df = events(spark, [
        {"image": "powershell.exe", "command_line": "powershell -enc QQBC"}, {"event_code": 13, "reg_key": "\\REGISTRY\\MACHINE\\Software\\Microsoft\\Windows\\CurrentVersion\\Run\\x"}, {"event_code": None, "command_line": None}, {"image": None},
    ])
    got = {(r["event_uid"], r["rule_id"]) for r in R.match_rules(R.with_signals(df)).collect()}
    assert got == {("0", "DET-001"), ("1", "DET-020")}


def test_fallback_skips_noise_and_finds_persistence(spark):
    keys = ["hklm\\software\\classes\\CLSID\\{1}", "hklm\\x\\TypeLib\\1", "hklm\\a\\Image File Execution Options\\b", "hklm\\a\\AppInit_DLLs", "hklm\\a\\Services\\b"]
    df = R.with_signals(events(spark, [{"event_code": 13, "reg_key": k} for k in keys]))
    got = {r["event_uid"]: r["rule_id"] for r in R.registry_fallback(df, df.filter("false").withColumn("rule_id", F.lit(""))).collect()}
    assert got == {"2": "FB-IFEO", "3": "FB-APPINIT", "4": "FB-SVC"}


def test_signal_strength(spark):
    one = spark.range(1).select(R.signal_strength(F.lit(100), F.lit("sequence"), F.lit("high")).alias("a"), R.signal_strength(F.lit(40), F.lit("rule"), F.lit("low")).alias("b")).first()
    assert abs(one["a"] - 0.96) < 1e-9 and abs(one["b"] - 0.48) < 1e-9


def test_burst_gap_is_more_than_900_seconds(spark):
    df = events(spark, [{"t": 0, "pid": "1"}, {"t": 900 * SEC, "pid": "1"}, {"t": 1801 * SEC, "pid": "1"}])
    assert sorted(r["n"] for r in B.bursts(df).collect()) == [1, 2]


def test_sequence_allows_one_skip(spark):
    p = [Q.Pattern("P", "Execution", 90, (Q.Step(("one",)), Q.Step(("two",)), Q.Step(("three",))))]
    names = lambda *x: events(spark, [{"image": i} for i in x])
    assert [(r["matched"], r["confidence"]) for r in Q.detect(names("one", "x", "two"), p).collect()] == [(2, 60)]
    assert Q.detect(names("one", "x", "x", "two"), p).count() == 0
    assert sorted(r["matched"] for r in Q.detect(names("one", "two", "x", "three"), p).collect()) == [2, 3]


def test_beacon(spark):
    df = events(spark, [{"t": i * 30 * SEC, "event_code": 3, "dst_ip": "1.2.3.4", "dst_port": None} for i in range(20)])
    (r,) = H.beacons(df).collect()
    assert (r["hits"], r["mean_s"], r["cv"], r["confidence"]) == (20, 30.0, 0.0, 99)


def test_hunt_is_boolean_algebra(spark):
    df = events(spark, [{"image": "cmd.exe"}, {"image": "reg.exe"}, {"image": None}])
    hit = lambda w: sorted(r["event_uid"] for r in H.hunt(df, w).collect())
    assert hit(H.any_of(H.term("image", "CMD"), H.all_of(H.term("image", "reg")))) == ["0", "1"]
    assert hit(~H.term("image", "cmd")) == ["1", "2"]
    assert hit(H.term("nonsense", "x")) == []


def test_edges_only_within_the_window(spark):
    df = events(spark, [{"t": i * 3600 * SEC} for i in range(5)]).withColumn("kill_chain_stage", F.lit("Execution"))
    assert G.edges(df).count() == 0
    near = events(spark, [{"t": 0}, {"t": 899 * SEC}]).withColumn("kill_chain_stage", F.lit("Execution"))
    assert [r["kind"] for r in G.edges(near).collect()] == ["stage"]


def test_components(spark):
    pairs = spark.createDataFrame([(2, 1), (3, 2), (9, 8), (5, 5), (4, 3), (20, 9)], "u long, v long")
    assert {(r["node"], r["component"]) for r in G.components(pairs).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8), (20, 8)}
    assert G.components(pairs.filter("false")).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_few_links_connect_what_all_edges_connect(spark, seed):
    draw = random.Random(seed)
    images, stages = ["a.exe", "b.exe", "c.exe", None], ["Background", "Delivery", "Execution", "Defense Evasion", "Discovery"]
    rows = [(i, str(i), draw.randrange(40_000) * G.SECOND, draw.choice(["h1", "h2"]), draw.choice(["u", "v", "w", "x", None]), draw.choice(images), draw.choice(images), draw.choice(stages)) for i in range(250)]
    rows += [(300, "300", 14_399 * G.SECOND, "h3", "u", "a.exe", None, "Execution"), (301, "301", 14_400 * G.SECOND, "h3", "v", "b.exe", None, "Defense Evasion"), (302, "302", 15_000 * G.SECOND, "h3", "w", "b.exe", None, "Defense Evasion")]
    e = spark.createDataFrame(rows, "event_id long, event_uid string, t long, computer string, user string, image string, parent_image string, kill_chain_stage string")
    all_pairs = G.edges(e).select(F.col("a_event_id").alias("u"), F.col("b_event_id").alias("v"))
    got, want = ({(r["node"], r["component"]) for r in df.collect()} for df in (G.members(e), G.components(all_pairs)))
    assert got == want
    assert len({c for _, c in want}) > 3


def test_same_pid_gives_two_roots(spark):
    df = events(spark, [{"pid": "7", "ppid": "1", "t": 0}, {"pid": "7", "ppid": "1", "t": 1000}])
    got = G.tree_depths(G.parent_links(df)).collect()
    assert sorted((r["event_id"], r["root_id"], r["depth"]) for r in got) == [(0, 0, 0), (1, 1, 0)]


def test_transitions(spark):
    asks = [("New", "Triage"), ("Triage", "Investigating"), ("New", "Escalated"), ("Closed - Benign", "New")]
    got = {(r["current"], r["requested"]): (r["accepted"], r["reason"]) for r in C.transitions(spark.createDataFrame(asks, "current string, requested string")).collect()}
    assert [got[a] for a in asks] == [(True, ""), (True, ""), (False, "not allowed"), (False, "terminal")]


def test_empty_burst_scores_nothing(spark):
    row = spark.createDataFrame([(None,) * 7 + (False,)], "rule_points double, sequence_confidence int, behavior double, correlation int, group_size int, depth int, n int, lolbin boolean")
    r = C.burst_scores(row).first()
    assert (r["score"], r["driver"]) == (0.0, "benign")


def test_expressions(spark):
    df = spark.createDataFrame([("aabb",), ("",), (None,), ("powershell `-Enc   " + "ab" * 12,)], "x string")
    got = [tuple(r) for r in df.select(S.entropy(F.col("x")), S.normal_command(F.col("x"))).collect()]
    assert got[0] == (1.0, "aabb") and got[1] == (0.0, "") and got[2] == (0.0, "") and got[3][1] == "powershell -enc [HEX]"
    times = spark.createDataFrame([("2024-01-02T03:04:05.1234567Z",), ("nan",), ("junk",)], "x string").select(S.parse_time(F.col("x")).alias("t")).collect()
    assert str(times[0]["t"]) == "2024-01-02 03:04:05.123456" and times[1]["t"] is None and times[2]["t"] is None


def test_signals_read_whole_texts(spark):
    from tidewatch.operators import rules as R

    texts = ["a" * 4096 + "b" * 4096, "- " * 3000 + "QUJD" * 50_000]
    df = spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], "k int, event_code int, command_line string")
    got = {r["k"]: r for r in R.with_signals(df).collect()}
    assert got[0]["entropy"] == 1.0 and got[1]["b64_detected"]


def test_queries_take_real_campaigns_and_all_hits(spark):
    from tidewatch import plans

    data, q = "/root/testdata/sf0.001", plans.queries()
    got = q["empty_suspicion"](spark, data).collect()[0]
    assert got["campaigns"] == q["campaigns"](spark, data).count() > 0 and not got["suspicious"]
    caught = {r["event_uid"] for r in q["rule_hits"](spark, data).collect()}
    assert not caught & {r["event_uid"] for r in q["rule_fallback"](spark, data).collect()}


def test_merged_statistics_equal_the_whole(spark):
    from tidewatch.operators import baseline as N

    df = spark.createDataFrame([(i % 3, float(i * i % 17), i) for i in range(60)], "g int, value double, i int")
    merged = N.merge_statistics(N.statistics(df.filter("i < 20"), ["g"]), N.statistics(df.filter("i >= 20"), ["g"]), ["g"])
    want = {r["g"]: r for r in N.statistics(df, ["g"]).collect()}
    for r in merged.collect():
        assert r["n"] == want[r["g"]]["n"] and abs(r["mean"] - want[r["g"]]["mean"]) < 1e-9 and abs(r["m2"] - want[r["g"]]["m2"]) < 1e-6


def test_spaced_payloads_are_joined(spark):
    df = spark.createDataFrame([("powershell -enc Z m 9 v Y m F y",), ("tool -e short",)], "x string")
    assert [r[0] for r in df.select(S.normal_command(F.col("x"))).collect()] == ["powershell -enc zm9vymfy", "tool -e short"]


@pytest.mark.parametrize(("risk", "stage", "confidence", "want"), [(100, "Command and Control", 85, ("High", 80)), (20, "Execution", 60, ("Medium", 50)), (0, None, None, ("None", 0))])
def test_run_confidence_is_capped_by_the_stage(spark, risk, stage, confidence, want):
    from tidewatch.operators import report as A

    hits = spark.createDataFrame([(confidence, "Execution", "Execution")] if confidence else [], "confidence_score int, mitre_tactic string, kill_chain_stage string")
    bursts = spark.createDataFrame([(risk, stage)] if stage else [], "risk int, stage string")
    r = A.run_confidence(hits, bursts, bursts).first()
    assert (r["level"], r["score"]) == want
