"""What shows on larger or denser tables than the driver's small ones."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidewatch import plans
from tidewatch.operators import context as X
from tidewatch.operators import graph as G
from tidewatch.operators import rules as U
from tidewatch.plans.detection import SPLIT_T

duckdb = pytest.importorskip("duckdb")
KINDS = ("view", "click", "purchase", "signup", "error")


def planted(folder, rows):
    """An events table of (event_id, microseconds, user_id, event_type, value, k)."""
    os.makedirs(folder, exist_ok=True)
    c = duckdb.connect()
    c.execute("create table x (event_id bigint, t bigint, user_id bigint, event_type varchar, value double, k int)")
    c.executemany("insert into x values (?, ?, ?, ?, ?, ?)", rows)
    c.execute(f"""copy (select event_id, make_timestamp(t) as ts, user_id, event_type, value, '{{"k": ' || k || '}}' as props from x) to '{folder}/events.parquet' (format parquet)""")
    return str(folder)


def both(spark, name, data):
    """Rows of the query, and those of its SQL."""
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{data}/events.parquet'")
    df, want = plans.queries()[name](spark, data), c.sql(plans.oracle_sql()[name])
    key = lambda r: [(x is None, x) for x in r]
    return sorted(map(tuple, df.collect()), key=key), sorted((tuple(r[want.columns.index(x)] for x in df.columns) for r in want.fetchall()), key=key)


def test_united_counts_are_exact(spark, tmp_path):
    """More users on a host than a sketch counts exactly, some in several weeks; a host without addresses."""
    rows = [(i, SPLIT_T + i % 3 * 604_800_000_000 + i, 20 * (i % 4000), KINDS[i % 2], 1.0, i % 90) for i in range(6000)] + [(6000, SPLIT_T, 1, "view", 1.0, 1)]
    got, want = both(spark, "united_counts", planted(tmp_path / "d", rows))
    assert got == want and [r[1:] for r in got] == [(4000, 45), (1, 0)]


def test_upserts_of_campaigns_on_one_side(spark, tmp_path):
    """A host before the split only, one after it only, one in a single burst over it, one on both sides."""
    hour = 3_600_000_000
    times = {0: [-9 * hour], 1: [9 * hour], 2: [-300_000_000, 300_000_000], 3: [-2 * hour, 2 * hour]}
    rows = [(20 * host + i, SPLIT_T + t, host, KINDS[host == 3 and t > 0], 1.0, 3) for host, ts in times.items() for i, t in enumerate(ts)]
    data = planted(tmp_path / "d", rows)
    got, want = both(spark, "campaign_upsert", data)
    assert got == want and [r[0] for r in got] == ["host-3"]
    whole, stated = both(spark, "whole_upsert", data)
    assert whole == stated and [r[0] for r in whole] == ["host-0", "host-1", "host-2", "host-3"] and set(got) < set(whole)


def most_rows(spark, run):
    """The greatest number of rows that a node of a plan gave while ``run`` ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    most, found = 0, store.executionsList()
    for i in range(before, found.size()):
        number = found.apply(i).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for metric in (m for j in range(nodes.size()) for m in _metrics(nodes.apply(j))):
            if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most


def _metrics(node):
    metrics = node.metrics()
    return [metrics.apply(i) for i in range(metrics.size())]


@pytest.mark.parametrize("commands", [True, False])
def test_hits_of_bursts_are_counted_as_listed(spark, commands):
    """Null keys, hits in several different rows, exact copies, bursts without rule or command."""
    draw = random.Random(8)
    some = lambda *xs: draw.choice([*xs, None])
    bursts = [(str(i), some("h", "g"), some("1", "2"), some("a", "b"), some("p", "q"), (t := draw.randrange(4000)) * 1_000_000, (t + draw.randrange(900)) * 1_000_000, some("R", "S"), some("cmd x", "cmd y")) for i in range(60)]
    hits = [(some("h", "g"), some("1", "2"), some("a", "b"), some("p", "q"), some("cmd x", "cmd y"), draw.randrange(5000) * 1_000_000, str(draw.randrange(200)), draw.choice("RST")) for i in range(250)]
    b = spark.createDataFrame(bursts, "burst_id string, computer string, pid string, image string, parent_image string, start_t long, end_t long, rule_id string, command_line string")
    h = spark.createDataFrame(hits + hits[:40], "computer string, pid string, image string, parent_image string, command_line string, t long, event_uid string, rule_id string")
    b = b if commands else b.drop("command_line")
    listed = U.detections_for_bursts(b, h).groupBy("burst_id").agg(F.count("*").alias("detections"), F.count_distinct("d_rule").alias("rules"))
    want = sorted(map(tuple, listed.collect()))
    assert sorted(map(tuple, U.detection_counts(b, h).collect())) == want and len(want) > 30


def test_like_hits_are_not_listed(spark, tmp_path):
    """2,000 users of a host with one hit each, all of one rule and image: four million pairs."""
    data = planted(tmp_path / "d", [(i, SPLIT_T + i * 1_000_000, 20 * i, "view", 1.0, 5) for i in range(2000)])
    rows = []
    assert most_rows(spark, lambda: rows.extend(both(spark, "detections_for_bursts", data))) < 100_000
    assert rows[0] == rows[1] and {r[1:] for r in rows[0]} == {(2000, 1)}


def test_steps_along_edges_as_listed(spark):
    """Equal to steps along the list of all edges: dense hosts and sparse ones, equal times, null columns, repeated ids, first edges late."""
    draw = random.Random(3)
    some = lambda *xs: draw.choice([*xs, None])
    stages = ["Background", "Execution", "Defense Evasion", "Persistence", None, "odd"]
    rows = [(draw.randrange(400), draw.randrange(span) * 300_000_000, some("e", *hosts), some("u", "v", "w"), some("a", "b"), some("a", "b"), draw.choice(stages)) for hosts, span, n in (("ab", 20, 120), ("cd", 400, 120), ("f", 9, 60)) for _ in range(n)]
    rows += [(i, i * 2_000_000_000, "late", "u", "a", None, "Execution") for i in range(1000, 1300)] + [(1300, 1299 * 2_000_000_000 + 5, "late", "u", "a", None, "Execution")]
    e = spark.createDataFrame([(i, str(i), *r) for i, *r in rows], "event_id long, event_uid string, t long, computer string, user string, image string, parent_image string, kill_chain_stage string")
    steps, first = {}, {}
    for r in G.edges(e).select("computer", "a_event_id", "b_event_id").distinct().collect():
        steps.setdefault((r[0], r[1]), set()).add(r[2])
        first[r[0]] = min(r[1], first.get(r[0], r[1]))

    def near(most, far):
        out = set()
        for host, node in first.items():
            depth, front = {node: 0}, {node}
            for d in range(1, (far if host in "ad" else 3) + 1):
                front = {b for a in front for b in steps.get((host, a), ())} - set(depth)
                depth |= dict.fromkeys(front, d)
            out |= {(host, n, d) for d, n in sorted((d, n) for n, d in depth.items())[:most]}
        return out

    sure = spark.createDataFrame([("a",), ("d",)], "computer string")
    for most, far, who in ((20, 3, None), (4, 5, sure), (500, 5, sure)):
        assert set(map(tuple, X.reachable(e, 3, most, who).select("computer", "node", "depth").collect())) == near(most, far)
    assert first["late"] == 1299


def test_edges_of_a_busy_host_are_not_listed(spark, tmp_path):
    """2,000 events of one user within minutes: two million pairs."""
    data = planted(tmp_path / "d", [(i, SPLIT_T + i * 200_000, 0, "view", 1.0, 3) for i in range(2000)])
    rows = []
    assert most_rows(spark, lambda: rows.extend(both(spark, "trimmed_edges", data))) < 100_000
    assert rows[0] == rows[1] and len(rows[0]) == 20
