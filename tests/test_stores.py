"""Stored profiles, merged sketches, live sinks and state that ends."""

import datetime
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import graph as G
from tidewatch.operators import profiles as N
from tidewatch.operators import sketches as H
from tidewatch.sources import profile_store as T
from tidewatch.sources.telemetry import telemetry
from tidewatch.streaming import live

DATA = "/root/testdata/sf0.001"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module")
def keyed(spark):
    e = N.with_keys(telemetry(spark, DATA))
    return G.stored(e.withColumn("user", F.when(F.col("event_id") % 5 == 0, "nt authority\\system").otherwise(F.col("user"))))


def rows_of(tables):
    return {name: {tuple(r[k] for k in keys): tuple(r[c] for c in sorted(set(tables[name].columns) - set(keys))) for r in tables[name].collect()} for name, (keys, _) in T.TABLES.items()}


def same(a, b):
    """Equal but for the order in which doubles were added."""
    return all(set(a[n]) == set(b[n]) and all(x == pytest.approx(y, rel=1e-9, abs=1e-9) for k, v in a[n].items() for x, y in zip(v, b[n][k], strict=True)) for n in T.TABLES)


def test_two_runs_stored_equal_one_over_both(spark, keyed, tmp_path):
    store = T.ProfileStore(spark, str(tmp_path / "store"), 4)
    assert store.latest() is None and store.read() == {}
    cut = (keyed.agg(F.percentile_approx("t", 0.5)).first()[0] // N.HOUR) * N.HOUR
    first, second = T.profiles_of(keyed.filter(F.col("t") < cut)), T.profiles_of(keyed.filter(F.col("t") >= cut))
    assert store.add(first) == 1 and store.add(second) == 2
    whole = rows_of(T.profiles_of(keyed))
    assert same(rows_of(store.read()), whole) and all(len(v) > 20 for v in whole.values())
    assert {k[1] for k in whole["entities"]} == {"system", "interactive"}
    again = T.ProfileStore(spark, str(tmp_path / "store"), 4)
    assert again.latest()[0] == 2 and same(rows_of(again.read()), whole)
    seen = T.anomaly_events(keyed.limit(50), again.read())
    assert seen.filter("kind = 'h' and count = 0").count() == 0 and seen.count() > 150
    totals = T.system_habits(again.read()).agg(F.sum("n")).first()[0]
    assert totals == keyed.filter("value is not null").count()


def test_a_failed_write_leaves_the_last_version(spark, keyed, tmp_path):
    store = T.ProfileStore(spark, str(tmp_path / "store"), 4)
    tables = T.profiles_of(keyed)
    store.add(tables)
    before = rows_of(store.read())
    broken = tables | {"hourly": tables["hourly"].withColumn("days", F.raise_error(F.lit("lost")).cast("long"))}
    with pytest.raises(Exception, match="lost"):
        store.add(broken)
    assert store.latest()[0] == 1 and same(rows_of(store.read()), before)
    assert store.add(tables) == 2
    entities = store.read()["entities"].agg(F.sum("n")).first()[0]
    assert entities == 2 * sum(v[-1] for v in ((r["n"],) for r in tables["entities"].collect()))


def test_a_merge_does_not_shuffle_the_stored_side(spark, keyed, tmp_path):
    store = T.ProfileStore(spark, str(tmp_path / "store"), 4)
    store.add(T.profiles_of(keyed))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        merged = T.merge_table("entities", store.read()["entities"], T.profiles_of(keyed)["entities"])
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    old = plan[plan.index("SortMergeJoin") :].split("Project [computer")[1]
    assert "Exchange" not in old.split("\n+- ")[0].split("profile_entities")[0] and "Bucketed: true" in plan


def test_sketches_merge_and_do_not_undercount(spark):
    draw = random.Random(1)
    rows = [(draw.choice("ab"), f"k{min(draw.randrange(400), draw.randrange(400))}" if draw.random() < 0.9 else None) for _ in range(6000)]
    df = spark.createDataFrame(rows, "g string, k string")
    halves = [df.filter("xxhash64(g, k) % 2 = 0"), df.filter("coalesce(xxhash64(g, k) % 2, 1) <> 0")]
    true = Counter(rows)
    for width, heavy in ((1 << 16, None), (64, None), (64, H.heavy_hitters(df, ["g", "k"], 20))):
        sketch = H.merged([H.frequency_sketch(h, ["g", "k"], 4, width) for h in halves], ["depth", "bucket"])
        assert sketch.count() <= 4 * width
        got = {(r["g"], r["k"]): r["count"] for r in H.estimated(df, ["g", "k"], sketch, heavy, 4, width).collect()}
        assert set(got) == set(true) and all(got[k] >= n for k, n in true.items())
        over = sum(got[k] > n + 2.72 / width * len(rows) for k, n in true.items())
        assert over <= 0.05 * len(true) and (width == 64 or got == true)
        if heavy is not None:
            assert all(got[k] == n for k, n in true.items() if n >= 20)
    empty = H.frequency_sketch(df.filter("false"), ["g", "k"])
    assert {r["count"] for r in H.estimated(df, ["g", "k"], empty).collect()} == {0}


def test_distinct_counts_of_united_runs(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 2).alias("run"), (F.col("id") % 40_000).cast("string").alias("v"))
    got = {r["g"]: r["v"] for r in H.united(H.distinct_sketches(df, ["g", "run"], ["v"]), ["g"], ["v"]).collect()}
    true = {r["g"]: r["n"] for r in df.groupBy("g").agg(F.count_distinct("v").alias("n")).collect()}
    assert set(got) == set(true) and all(abs(got[g] - n) <= 0.05 * n for g, n in true.items())


HIT = "event_uid string, t long, rule_id string, rule_severity string, image string, computer string, mitre_id string, mitre_tactic string, kill_chain_stage string, parent_image string, pid string, ppid string, confidence_score int"


def test_a_repeated_batch_leaves_two_tables_that_agree(spark, tmp_path):
    """The second table fails once; the batch runs again, and both tables hold each row once."""
    rows = [(str(i), i, "R", "high", "a.exe", "h", "T1", "Execution", "Execution", None, "1", "0", 40) for i in range(20)]
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, HIT).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(HIT).parquet(str(tmp_path / "in" / "*"))
    sink = tmp_path / "sink"
    (sink / "detections").parent.mkdir(exist_ok=True)
    (sink / "detections").write_text("a file where the folder should be")
    with pytest.raises(Exception):  # noqa: B017, PT011
        live.write_twice(stream, str(sink), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert live.read_sink(spark, str(sink), "alerts").count() == 20
    (sink / "detections").unlink()
    live.write_twice(stream, str(sink), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    alerts, detections = (live.read_sink(spark, str(sink), n) for n in ("alerts", "detections"))
    assert sorted(r["event_uid"] for r in alerts.collect()) == sorted(r["event_uid"] for r in detections.collect()) == sorted(str(i) for i in range(20))
    assert {r["confidence_score"] for r in detections.collect()} == {85}


def batches(spark, folder, groups, schema):
    import os

    for i, rows in enumerate(groups):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/x{i}")
        (file,) = Path(f"{folder}/x{i}").glob("*.parquet")
        os.rename(file, f"{folder}/{i}.parquet")
        os.utime(f"{folder}/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*.parquet")


def test_state_ends_after_silence(spark, tmp_path):
    schema = "computer string, image string, event_id long, event_uid string, t long, value double, event_code int, command_line string, event_time timestamp"
    at = lambda s: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=s)
    row = lambda i, host, s: (host, "powershell.exe", i, str(i), int(at(s).timestamp()) * 1_000_000, 1.0, 1, "x", at(s))
    day = 86_400
    groups = [[row(i, f"h{i}", i) for i in range(6)], [row(10, "late", 40 * day)], [row(11, "late", 40 * day + 10)], [row(12, "h0", 40 * day + 20), row(13, "h1", 5)]]
    (tmp_path / "in").mkdir()
    stream = batches(spark, str(tmp_path / "in"), groups, schema)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        for name, df in (("ends_learned", live.learning_baseline(stream, late="1 hour")), ("ends_chains", live.chains(stream, late="1 hour"))):
            q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
            q.awaitTermination()
            progress = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
            held = [p["numRowsTotal"] for p in progress]
            assert max(held[:2]) >= 6 and held[-1] <= 6 and held[-1] < max(held)
            assert sum(p["numRowsDroppedByWatermark"] for p in progress) >= 1
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    got = {r["event_uid"]: r["known"] for r in spark.table("ends_learned").collect()}
    assert got["12"] == 0 and "13" not in got and got["11"] == 1  # h0 was forgotten; what came too late is left out


def test_writes_are_accounted_in_one_pass(spark, tmp_path):
    from tidewatch.operators import quality as V

    df = spark.createDataFrame([(1, "a"), (2, None), (None, "c"), (4, "d")], "k int, v string")
    assert V.accounted_write(df, ["k", "v"], str(tmp_path / "a")) == {"raw": 4, "complete": 2, "dropped": 2} and spark.read.parquet(str(tmp_path / "a")).count() == 2
    assert V.accounted_write(df.filter("false"), ["k"], str(tmp_path / "b")) == {"raw": 0, "complete": 0, "dropped": 0}
    with pytest.raises(V.LostRows):
        V.accounted_write(df.withColumn("w", F.lit(None).cast("string")), ["w"], str(tmp_path / "c"))


def test_verdicts_of_two_runs(spark):
    from tidewatch.operators import scoring as C

    rows = [("a.exe", "p.exe", "Benign", 1), ("a.exe", "p.exe", "False Positive", 2), (None, "q.exe", "Benign", 3), ("a.exe", "p.exe", "True Positive", 4), ("n.exe", None, "Undecided", 5)]
    v = spark.createDataFrame([(*r, r[3]) for r in rows], "image string, parent_image string, verdict string, t int, event_id int")
    got = {r["image"]: (r["hit_count"], r["verdict"], r["adjustment"]) for r in C.merged_verdicts(C.record_verdicts(v.filter("t < 4")), C.record_verdicts(v.filter("t >= 4"))).collect()}
    assert got == {"a.exe": (3, "True Positive", 15), None: (1, "Benign", -15), "n.exe": (1, "Undecided", 0)}
