"""Whole scores and their ledgers, trees by list ranking, parts of names, fingerprints and chains, on planted rows."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import casework as W
from tidewatch.operators import graph as G
from tidewatch.operators import quality as V
from tidewatch.operators import risk as R
from tidewatch.operators import rules as U
from tidewatch.operators import scoring as C

BURST = "burst_id string, image string, parent_image string, encoded boolean, rule_points double, sequence_points double, sequence_hits int, behavior double, frequency int, correlation int, group_size int, n int, entropy double, sequence_anomaly double, samples int, drift double, depth int"


def scored(spark, *rows):
    names = [c.split()[0] for c in BURST.split(", ")]
    full = [{"burst_id": str(i), "image": "a.exe"} | r for i, r in enumerate(rows)]
    return R.scored(spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], BURST))


def test_lines_add_up_to_the_score(spark):
    draw = random.Random(1)
    rows = []
    for _ in range(300):
        rows.append({
            "image": draw.choice(["powershell.exe", "CMD.exe", "a.exe"]), "parent_image": draw.choice([None, "explorer.exe", "odd.exe"]), "encoded": draw.choice([True, False, None]), "rule_points": draw.choice([None, 0.0, 12.5, 90.0]),
            "sequence_points": draw.choice([None, 0.0, 40.0, 88.0]), "sequence_hits": draw.choice([None, 0, 1, 3]), "behavior": draw.choice([0.0, 0.3, 0.78, 0.9]), "frequency": draw.choice([None, 1, 2, 3, 50, 5000]), "correlation": draw.choice([None, 0, 4, 400]),
            "group_size": draw.choice([None, 1, 9]), "n": draw.choice([1, 4, 300]), "entropy": draw.choice([None, 3.0, 4.5]), "sequence_anomaly": draw.choice([None, 0.9]), "samples": draw.choice([0, 6, 12, 40]), "drift": draw.choice([0.0, 0.4]), "depth": draw.choice([None, 1, 2, 5]),
        })
    got = scored(spark, *rows)
    sums = defaultdict(float)
    for r in R.ledger(got).collect():
        sums[r["burst_id"]] += r["points"]
    scores = {r["burst_id"]: r for r in got.collect()}
    assert all(abs(sums[k] - r["score"]) < 1e-9 and 0 <= r["score"] <= 100 for k, r in scores.items())
    assert len({line["label"] for r in scores.values() for line in r["lines"]}) == len(R.LINES)
    silent = [r for r in scores.values() if not r["lines"]]
    assert silent and all((r["score"], r["driver"], r["severity"]) == (0.0, "benign", "informational") for r in silent)


def test_terms_of_the_score(spark):
    points = lambda **r: {x["label"]: round(x["points"], 6) for x in scored(spark, {"rule_points": 20.0, "n": 2, "samples": 40} | r).first()["lines"]}
    assert points()["rarity"] == round(14 * (1.5 - 0.3 * 0.30103), 6) and "first seen" not in points()
    assert points(behavior=0.5)["first seen"] > 0 and "rarity" not in points(frequency=4)
    assert points(behavior=0.8, encoded=True)["stealth"] == 15 and "stealth" not in points(behavior=0.8, encoded=True, parent_image="Explorer.exe") and "stealth" not in points(behavior=0.8, samples=5, entropy=5.0)
    assert points(drift=0.31)["drift"] == 10 and "drift" not in points(drift=0.3)
    assert points(correlation=100, group_size=3)["correlation"] == 35 and points(depth=3)["depth"] == 15
    assert points(samples=3)["maturity"] < 0 and points(rule_points=500.0)["limit"] < 0 and points(sequence_hits=2)["override"] > 0
    assert points(image="powershell.exe", encoded=True, frequency=9)["floor"] > 0


def test_a_long_chain_is_numbered_in_few_rounds(spark):
    """10,000 processes, each the child of the one before: rounds by doubling, no nested joins."""
    n = 10_000
    links = spark.range(n).select(F.col("id").alias("event_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.col("id").alias("t"))
    tree = spark.range(n).select(F.col("id").alias("event_id"), F.lit(0).cast("long").alias("root_id"), F.col("id").alias("depth"))
    before = len(G._made)
    out = W.pre_order(tree, links)
    assert len(G._made) - before < 40
    assert out.filter("place <> event_id + 1").count() == 0 and out.count() == n


def test_pre_order_of_random_trees(spark):
    draw = random.Random(3)
    parent = {i: (draw.randrange(max(0, i - 9), i) if i % 40 and draw.random() < 0.95 else None) for i in range(300)}
    when = {i: draw.randrange(50) for i in parent}
    kids, root, depth, want = defaultdict(list), {}, {}, {}
    for i, p in parent.items():
        root[i], depth[i] = (i, 0) if p is None else (root[p], depth[p] + 1)
        if p is not None:
            kids[p].append(i)
    for r in (i for i, p in parent.items() if p is None):
        stack, k = [r], 0
        while stack:
            x = stack.pop()
            k += 1
            want[x] = (r, depth[x], k)
            stack += sorted(kids[x], key=lambda c: (when[c], c), reverse=True)
    links = spark.createDataFrame([(i, p, when[i]) for i, p in parent.items()], "event_id long, parent_id long, t long")
    tree = spark.createDataFrame([(i, root[i], depth[i]) for i in parent], "event_id long, root_id long, depth long")
    assert {r["event_id"]: (r["root_id"], r["depth"], r["place"]) for r in W.pre_order(tree, links).collect()} == want
    assert W.pre_order(tree.filter("false"), links.filter("false")).count() == 0


def test_substrings_equal_a_nested_loop(spark):
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("abcdeé.") for _ in range(n))
    names = [word(draw.randrange(0, 14)) for _ in range(10_000)] + [None]
    patterns = [word(draw.randrange(0, 7)) for _ in range(970)] + [n[2:6].upper() for n in names[:29]] + [None]
    got = C.substring_matches(spark.createDataFrame([(p,) for p in patterns], "p string"), spark.createDataFrame([(n,) for n in names], "n string"))
    clean = lambda xs: {x.lower() for x in xs if x}
    want = {(p, n) for p in clean(patterns) for n in clean(names) if p in n}
    assert {(r["pattern"], r["name"]) for r in got.collect()} == want and len(want) > 1000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_feedback_takes_parts_of_names(spark):
    b = spark.createDataFrame([("1", "C:\\x\\PowerShell.exe", "winword.exe", "Execution", "R1"), ("2", "cmd.exe", None, "Credential Access", "R1"), ("3", "calc.exe", None, "Execution", None)], "burst_id string, image string, parent_image string, stage string, rule_id string")
    memory = spark.createDataFrame([("powershell", None, None, None, -40), (None, "WORD", None, None, 5), ("cmd", None, None, "R1", -7), ("", None, None, None, 15)], "image string, parent_image string, stage string, rule_id string, adjustment int")
    assert {r["burst_id"]: r["feedback"] for r in C.pattern_feedback(b, memory).collect()} == {"1": -20, "2": -7, "3": 0}


def test_fingerprints_of_tables(spark):
    rows = [(i, None if i % 7 == 0 else f"é{i % 50}") for i in range(500)] + [(1, "twice")] * 2
    df = spark.createDataFrame(rows, "a long, b string")
    one, other = (V.table_fingerprint(x, ["a", "b"]).first() for x in (df.repartition(1), df.orderBy(F.desc("b")).repartition(7)))
    assert one == other and one["rows"] == 502
    sums = defaultdict(lambda: [0, 0, 0])
    for a, b in rows:
        h = hashlib.sha256(f"{a}\t{b or ''}".encode()).hexdigest()
        s = sums[int(h[30:38], 16) % 256]
        s[0], s[1], s[2] = s[0] + int(h[:15], 16), s[1] + int(h[15:30], 16), s[2] + 1
    assert one["digest"] == hashlib.sha256("|".join(f"{k}:{x}:{y}:{n}" for k, (x, y, n) in sorted(sums.items())).encode()).hexdigest()
    changed = V.table_fingerprint(df.filter("b <> 'twice' or b is null").union(spark.createDataFrame([(1, "twice")], df.schema)), ["a", "b"]).first()
    assert changed["digest"] != one["digest"] and V.table_fingerprint(df.filter("false"), ["a", "b"]).first()["rows"] == 0


def test_chains_keep_what_connects_or_persists_apart(spark):
    rows = [("P", "h", "s", 41, i, net, keeps, False) for i, (net, keeps) in enumerate([(True, False), (False, False), (True, False), (False, True), (None, None)])] + [("P", "h", "s", 0, 9, False, False, True), ("P", "h", "s", 0, 10, False, False, False), ("P", "h", "s", None, 11, None, None, None)]
    df = spark.createDataFrame([(*r[:4], str(r[4]), r[4], r[4], 2, *r[5:]) for r in rows], "pattern_id string, computer string, stage string, confidence int, first_uid string, first_t int, last_t int, matched int, has_net boolean, has_persistence boolean, has_signal boolean")
    got = sorted((r["step"], r["has_net"], r["has_persistence"], r["first_uid"], r["merged"]) for r in W.chain_dedup(df).collect())
    assert got == [(0, False, False, "9", 1), (40, False, False, "1", 2), (40, False, True, "3", 1), (40, True, False, "0", 2)]


def test_hits_meet_bursts_by_keys(spark):
    """Equal to looking at all pairs."""
    draw = random.Random(5)
    some = lambda *xs: draw.choice([*xs, None])
    bursts = [(str(i), some("h", "g"), some("1", "2"), some("a", "b"), some("p", "q"), (t := draw.randrange(4000)) * 1_000_000, (t + draw.randrange(900)) * 1_000_000, some("R", "S"), some("cmd x", "cmd y")) for i in range(60)]
    hits = [(some("h", "g"), some("1", "2"), some("a", "b"), some("p", "q"), some("cmd x", "cmd y"), draw.randrange(5000) * 1_000_000, str(i), draw.choice("RS")) for i in range(80)]
    b = spark.createDataFrame(bursts, "burst_id string, computer string, pid string, image string, parent_image string, start_t long, end_t long, rule_id string, command_line string")
    h = spark.createDataFrame(hits, "computer string, pid string, image string, parent_image string, command_line string, t long, event_uid string, rule_id string")
    same = lambda x, y: x is not None and x == y
    want = {(i, uid, rule) for i, host, pid, image, parent, start, end, own, cmd in bursts for c, p, im, pa, co, t, uid, rule in hits if same(host, c) and (
        (same(pid, p) and start - 5_000_000 <= t <= end + 5_000_000) or 3 * same(own, rule) + 2 * same(parent, pa) + 2 * same(image, im) + same(cmd, co) >= 5)}
    got = U.detections_for_bursts(b, h)
    assert {(r["burst_id"], r["d_uid"], r["d_rule"]) for r in got.collect()} == want and len(want) > 30


def test_actions_of_stages(spark):
    rows = [("a", "Execution"), ("a", "Persistence"), ("a", "Command and Control"), ("b", "Background"), ("c", "Discovery"), ("c", "Discovery"), ("d", "Collection"), ("e", "Delivery")]
    e = spark.createDataFrame([(h, s, 1) for h, s in rows], "computer string, kill_chain_stage string, t int")
    found = spark.createDataFrame([("c", True), ("d", False)], "computer string, severe boolean")
    got = {r["computer"]: r for r in G.story_reports(e, found).collect()}
    assert (got["a"]["attack_type"], got["a"]["final_stage"], got["a"]["confidence"]) == ("Multi-stage compromise", "Command and Control", 0.3) and got["a"]["action"].startswith("CRITICAL")
    assert got["b"]["final_stage"] == "Execution" and got["c"]["action"].startswith("HIGH: Perform") and got["d"]["action"].startswith("Investigate") and got["e"]["attack_type"] == "Initial Access / Delivery"
    assert Counter(r["attack_type"] for r in got.values())["Suspicious Activity"] == 3


@pytest.mark.parametrize("rows", [[], [("h", None, 0)]])
def test_stories_without_steps(spark, rows):
    e = spark.createDataFrame([(1, t, h, x, "Execution", None, "a") for h, x, t in rows], "event_id long, t long, computer string, text string, kill_chain_stage string, parent_image string, image string")
    assert G.ranked_story(e).count() == 0
