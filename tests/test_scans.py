"""Scans in two levels, sums over near pairs without pairs, and grandparents, against plain windows, pairs and loops."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch import plans
from tidewatch.functions import signals as S
from tidewatch.operators import bursts as B
from tidewatch.operators import context as Y
from tidewatch.operators import graph as G
from tidewatch.operators import quality as V
from tidewatch.operators import sequences as Q
from tidewatch.operators.slabs import last_before, numbered_runs

SEC = 1_000_000
SCHEMA = "event_id long, event_uid string, t long, computer string, user string, image string, parent_image string, kill_chain_stage string, event_code int, command_line string, pid string, ppid string"


def telemetry(spark, seed, n=300, span=40_000, hosts=("h1", "h2", None)):
    draw = random.Random(seed)
    images, stages = ["a.exe", "b.exe", "c.exe", None], ["Background", "Delivery", "Execution", "Defense Evasion", "Discovery", "not a stage", None]
    rows = []
    for i in range(n):
        t = draw.randrange(span) // draw.choice([1, 900]) * SEC
        rows.append((i, str(i), t, draw.choice(hosts), draw.choice(["u", "v", None]), draw.choice(images), draw.choice(images), draw.choice(stages), draw.choice([1, 3]), "x", draw.choice("123"), draw.choice(["1", "2", "3", None])))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("seconds", [10, 700, 86_400])
def test_runs_and_last_values_equal_one_window(spark, seconds):
    e = telemetry(spark, seconds)
    order = Window.partitionBy("computer").orderBy("t", "event_id")
    cut = F.coalesce(F.col("t") - F.lag("t").over(order) > 300 * SEC, F.lit(True)).cast("int")
    value = F.when(F.col("event_code") == 3, F.col("image"))
    want = e.withColumn("cut", cut).select("event_id", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("no"), F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("last"))
    runs = numbered_runs(e, ["computer"], ["t", "event_id"], ["t"], lambda before, here: here("t") - before("t") > 300 * SEC, "no", seconds)
    last = last_before(e, ["computer"], ["t", "event_id"], value, "last", seconds)
    want = {r["event_id"]: (r["no"], r["last"]) for r in want.collect()}
    assert {r["event_id"]: r["no"] for r in runs.collect()} == {k: v[0] for k, v in want.items()}
    assert {r["event_id"]: r["last"] for r in last.collect()} == {k: v[1] for k, v in want.items()}
    assert set(runs.columns) == {*e.columns, "no"} and numbered_runs(e.filter("false"), ["computer"], ["t", "event_id"], ["t"], lambda b, h: h("t") > b("t"), "no").count() == 0


def test_a_busy_host_is_many_tasks(spark):
    """The windows over events are partitioned by the slab as well as by the host; those over the host alone see a row a slab."""
    b = B.bursts(telemetry(spark, 1).withColumns({"dst_ip": F.lit(None).cast("string"), "value": F.lit(1.0)}), ["computer", "image"])
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__slab" in line for line in windows)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_edge_sums_equal_all_edges(spark, seed):
    e = telemetry(spark, seed, 350)
    forward, backward = F.count_if(F.col("direction") == "forward"), F.count_if(F.col("direction") == "backward")
    want = G.edges(e).groupBy(F.col("b_event_id").alias("node")).agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"), forward.alias("forward"), backward.alias("backward"))
    got = G.edge_sums(e)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_edge_sums_at_the_border(spark):
    rows = [(1, 0, "u"), (2, 900 * SEC, "u"), (3, 900 * SEC + 1, "u"), (4, 14_399 * SEC, "v"), (5, 14_400 * SEC, "v"), (6, 14_400 * SEC, "v")]
    e = spark.createDataFrame([(i, str(i), t, "h", u, "a", None, "Execution", 1, "x", "1", "0") for i, t, u in rows], SCHEMA)
    assert {r["node"]: (r["edges"], r["weight"]) for r in G.edge_sums(e).collect()} == {2: (1, 2.0), 3: (1, 2.0), 5: (1, 2.0), 6: (2, 4.0)}
    assert G.edge_sums(e.filter("false")).count() == 0


@pytest.mark.parametrize("shift", [0, 1, 5_000, 21_000, 43_210, 100_000])
def test_chains_across_slabs(spark, shift):
    """Where slabs begin changes nothing."""
    draw = random.Random(7)
    rows = [(i, str(i), draw.randrange(0, 300_000) * SEC, draw.choice("hk"), "u", draw.choice(["powershell.exe", "cmd.exe", "certutil.exe", "reg.exe"]), None, None, draw.choice([1, 3, 11, 13]), "x", "1", "0") for i in range(600)]
    e = spark.createDataFrame(rows, SCHEMA)
    found = lambda df, s: sorted((r["pattern_id"], r["first_uid"], r["last_uid"], r["first_t"] - s * SEC, r["matched"]) for r in Q.detect(df).collect())
    assert found(e.withColumn("t", F.col("t") + shift * SEC), shift) == found(e, 0) != []


def test_grandparents_are_the_latest_of_their_pid(spark):
    rows = [(1, 10, "1", None, "old.exe"), (2, 20, "2", "1", "mid.exe"), (3, 30, "1", None, "new.exe"), (4, 40, "3", "2", "leaf.exe"), (5, 15, "3", "2", "early.exe"), (6, 50, "9", None, "root.exe")]
    e = spark.createDataFrame([(i, str(i), t * SEC, "h", "u", image, None, None, 1, "x", pid, ppid) for i, t, pid, ppid, image in rows], SCHEMA)
    assert {r["event_id"]: r["grandparent"] for r in Y.with_grandparent(e).collect()} == {1: None, 2: None, 3: None, 4: "new.exe", 5: None, 6: None}


def test_bursts_hold_sets_and_their_events_are_rows(spark):
    e = telemetry(spark, 5).withColumns({"dst_ip": F.lit(None).cast("string"), "value": F.lit(1.0)})
    b = B.bursts(e, ["computer", "image"], 900)
    listed = defaultdict(list)
    for r in B.burst_events(e, ["computer", "image"], 900).collect():
        listed[r["burst_id"]].append(r["event_code"])
    assert sum(map(len, listed.values())) == e.count()
    assert {r["burst_id"]: (r["n"], r["codes"]) for r in b.collect()} == {k: (len(v), ",".join(map(str, sorted(set(v))))) for k, v in listed.items()}


@pytest.mark.parametrize("seconds", [5, 700, 86_400])
def test_code_lists_hold_every_event_in_order(spark, seconds):
    e = telemetry(spark, 6).withColumns({"dst_ip": F.lit(None).cast("string"), "value": F.lit(1.0), "event_code": F.when(F.col("event_id") % 7 > 0, F.col("event_code"))})
    keys, listed = ["computer", "image"], defaultdict(list)
    for r in B.burst_events(e, keys, 900).orderBy("t", "event_id").collect():
        listed[r["burst_id"]] += [str(r["event_code"])] if r["event_code"] else []
    got = {r["burst_id"]: r["code_list"] for r in B.with_code_list(B.bursts(e, keys, 900), e, keys, 900, seconds).collect()}
    assert got == {k: ",".join(listed[k]) or None for k in got} and max(map(len, listed.values())) > 2
    assert B.with_code_list(B.bursts(e.filter("false"), keys), e.filter("false"), keys).count() == 0


def test_bursts_query_lists_repeated_codes(spark):
    rows = plans.queries()["bursts"](spark, "/root/testdata/sf0.01").filter("n > 1").select("n", "codes").collect()
    assert rows and all(r["codes"].count(",") == r["n"] - 1 for r in rows)


def test_entropy_of_any_text(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choice("aab€𝒳 %'\\.$é") for _ in range(n)) for n in (1, 2, 3, 17, 300)] + ["\0\0a", "aaaa", "x" * 5000 + "y"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.entropy(F.col("t")).alias("e")).orderBy("i").select("e").collect()]
    assert got == [round(-sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values()), 3) + 0.0 for t in texts]


def test_planted_violations_are_found(spark):
    bursts = spark.createDataFrame([(5, 0, 1, 2), (5, 1, 9, 2), (5, 1, 1, 2)], "risk int, n int, start_t long, end_t long")
    sums, members = spark.createDataFrame([(1,), (2,)], "node long"), spark.createDataFrame([(1, 1), (3, 1), (3, 2)], "node long, component long")
    links = spark.createDataFrame([(1, None, 10), (2, 1, 5), (3, 1, 20)], "event_id long, parent_id long, t long")
    got = {r["invariant"]: r["violations"] for r in V.invariants(bursts, sums, members, links).collect()}
    assert got == {"score without evidence": 1, "burst runs backwards": 1, "edge without ends": 1, "node in two campaigns": 1, "child before parent": 1}


def test_tables_of_rounds_are_dropped(spark):
    from pathlib import Path

    df = G.stored(spark.range(3))
    (folder,) = {Path(f.removeprefix("file:")).parent for f in df.inputFiles()}
    assert df.count() == 3 and folder.exists()
    G.drop_stored()
    assert not folder.exists() and not G._made
