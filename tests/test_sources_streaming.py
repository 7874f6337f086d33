"""Event-log XML, run tables and live operators."""

from pyspark.sql import functions as F

from tidewatch.operators import bursts as B
from tidewatch.sources import sysmon
from tidewatch.sources.telemetry import telemetry
from tidewatch.streaming import live

DATA = "/root/testdata/sf0.001"
NS = ' xmlns="http://schemas.microsoft.com/win/2004/08/events/event"'


def event(ns="", code="<EventID>1</EventID>", image="C:\\Windows\\Cmd.EXE"):
    return f'<Event{ns}><System>{code}<TimeCreated SystemTime="2024-01-01T00:00:01.1234567Z"/><Computer>pc</Computer></System><EventData><Data Name="Image">{image}</Data><Data Name="CommandLine">cmd /c x</Data><Data>odd</Data></EventData></Event>'


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(f"<Events>{event(NS)}{event(code='')}{event(image='D:/x/reg.exe')}</Events>")
    rows = sysmon.read_xml(spark, str(tmp_path / "a.xml")).collect()
    assert sorted((r["event_code"] or 0, r["image"], r["computer"], r["command_line"]) for r in rows) == [(0, "cmd.exe", "pc", "cmd /c x"), (1, "cmd.exe", "pc", "cmd /c x"), (1, "reg.exe", "pc", "cmd /c x")]
    assert sysmon.ingest(sysmon.read_xml(spark, str(tmp_path / "a.xml"))).count() == 2


def test_append_leaves_out_what_is_there(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "event_uid string, x int")
    path = str(tmp_path / "runs")
    sysmon.append_run(rows, path, "r1")
    sysmon.append_run(rows.union(spark.createDataFrame([("c", 3)], rows.schema)), path, "r1")
    sysmon.append_run(rows, path, "r2")
    assert sorted(r["event_uid"] for r in sysmon.load_run(spark, path, "r1").collect()) == ["a", "b", "c"]


def test_by_uids_keeps_their_order(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "event_uid string, x int")
    lists = spark.createDataFrame([(1, ["b", "zz", "a"])], "incident_id int, event_uids array<string>")
    assert [r["event_uid"] for r in sysmon.by_uids(rows, lists).collect()] == ["b", "a"]


def streamed(spark, tmp_path):
    batch = telemetry(spark, DATA).withColumn("event_time", F.timestamp_micros("t"))
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    return batch, spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_live_equals_batch(spark, tmp_path):
    batch, stream = streamed(spark, tmp_path)
    assert run(live.alerts(stream), tmp_path, "live_alerts").count() == live.alerts(batch).count()
    assert run(live.deduplicated(stream.union(stream)), tmp_path, "live_once").count() == batch.count()
    closed = run(live.live_bursts(stream), tmp_path, "live_bursts")
    key = lambda df: {(r["computer"], r["image"], r["s"], r["n"]) for r in df.collect()}
    got = key(closed.select("computer", "image", F.unix_micros("start_time").alias("s"), "n"))
    want = key(B.bursts(batch, ["computer", "image"]).select("computer", "image", F.col("start_t").alias("s"), "n"))
    assert got <= want and len(want) - len(got) < 10


def test_stateful_pairs_equal_a_window(spark, tmp_path):
    from pyspark.sql.window import Window

    batch, stream = streamed(spark, tmp_path)
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = run(live.pair_sequences(stream, "powershell.exe", "cmd.exe"), tmp_path, "live_pairs").collect()
    finally:
        spark.conf.unset(key)
    order = Window.partitionBy("computer").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    ms = F.floor(F.col("t") / 1000)
    rows = batch.withColumn("last", F.last(F.when(F.col("image") == "powershell.exe", ms), ignorenulls=True).over(order))
    want = rows.filter((F.col("image") == "cmd.exe") & (ms - F.col("last") <= 900_000)).select("computer", "event_uid", (ms - F.col("last")).alias("gap_ms")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
    assert run(live.throughput(stream), tmp_path, "live_rate", "append").count() > 0


def test_rule_files(spark, tmp_path):
    import json

    from tidewatch.operators import rules as R
    from tidewatch.sources.rule_files import load_rules

    spec = {"rules": [{"rule_id": "X", "event_id": [1], "image_contains": "Power", "cmd_any": ["-ENC "], "confidence": 60, "extra": 1, "conditions": [{"field": "value", "operator": ">", "value": 5}]}]}
    (tmp_path / "r.json").write_text(json.dumps(spec))
    (rule,) = load_rules(str(tmp_path / "none.yaml"), str(tmp_path / "r.json"))
    hits = R.match_rules(R.with_signals(telemetry(spark, DATA)), [rule])
    want = telemetry(spark, DATA).filter("event_code = 1 and command_line like '%-enc %' and value > 5").count()
    assert hits.count() == want > 0


def parts(batch, stream_dir, n=3):
    """The table as files in order of time, so that a stream reads it in several batches."""
    import os

    rows = batch.orderBy("t", "event_id").collect()
    step = -(-len(rows) // n)
    for i in range(n):
        out = os.path.join(stream_dir, f"p{i}")
        batch.sparkSession.createDataFrame(rows[i * step : (i + 1) * step], batch.schema).coalesce(1).write.parquet(out)
        for f in sorted(os.listdir(out)):
            if f.endswith(".parquet"):
                os.rename(os.path.join(out, f), os.path.join(stream_dir, f"{i}.parquet"))
                os.utime(os.path.join(stream_dir, f"{i}.parquet"), (1_700_000_000 + i, 1_700_000_000 + i))


def test_stateful_operators_over_several_batches(spark, tmp_path):
    import math

    from tidewatch.operators import sequences as Q

    batch = telemetry(spark, DATA)
    (tmp_path / "in").mkdir()
    parts(batch, str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*.parquet"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        chains = run(live.chains(stream), tmp_path, "live_chains").collect()
        learned = run(live.learning_baseline(stream), tmp_path, "live_learned").collect()
    finally:
        spark.conf.unset(key)
    want = Q.detect(batch).select("pattern_id", "computer", "first_uid", "last_uid", "first_t", "last_t", "matched", "confidence").collect()
    assert want and sorted(map(tuple, chains)) == sorted(map(tuple, want))

    profiles, expected = {}, {}
    for r in batch.orderBy("t", "event_id").collect():
        if r["value"] is None or math.isnan(r["value"]):
            continue
        seen = profiles.setdefault((r["computer"], r["image"]), [])
        n, mean = len(seen), sum(seen) / len(seen) if seen else 0.0
        spread = max(0.1, math.sqrt(sum((x - mean) ** 2 for x in seen) / max(n - 1, 1)))
        deviation = 0.25 if n == 0 else 0.3 if n < 10 else min(1.0, max(0.2, abs(r["value"] - mean) / spread / 3))
        expected[r["event_uid"]] = (n, round(deviation, 6), n < 15 or deviation < 0.4)
        if expected[r["event_uid"]][2]:
            seen.append(r["value"])
    assert {r["event_uid"]: (r["known"], round(r["deviation"], 6), r["learned"]) for r in learned} == expected


def test_ingest_run_and_its_tables(spark, tmp_path):
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml" / "a.xml").write_text(f"<Events>{event(NS)}{event(NS)}{event(image='D:/x/powershell.exe')}{event(code='')}</Events>")
    made = sysmon.ingest_run(sysmon.read_xml(spark, str(tmp_path / "xml")), sets={"console": [["cmd"]], "none": [["cmd"], ["absent"]]})
    sysmon.persist_run(made, str(tmp_path / "runs"), "r1")
    sysmon.persist_run(made, str(tmp_path / "runs"), "r1")
    rows = {name: sysmon.load_run(spark, str(tmp_path / "runs" / name), "r1").count() for name in made}
    assert rows == {"events": 2, "behaviors": 2, "detections": 2}
    assert {r["rule_id"] for r in sysmon.load_run(spark, str(tmp_path / "runs" / "detections"), "r1").collect()} == {"console"}
    assert run(sysmon.stream_xml(spark, str(tmp_path / "xml")), tmp_path, "live_xml").filter("event_code = 1").count() == 3


def test_correlations_and_campaigns_of_a_run(spark, tmp_path):
    events = telemetry(spark, DATA)
    made = sysmon.correlate_run(events)
    for _ in range(2):
        sysmon.persist_run(made, str(tmp_path / "runs"), "r1")
    found = {name: sysmon.load_run(spark, str(tmp_path / "runs" / name), "r1") for name in made}
    assert found["campaigns"].count() == made["campaigns"].count() > 0
    assert found["correlations"].count() == made["correlations"].count() > 10
    assert {r["campaign"] for r in found["correlations"].collect()} <= {r["component"] for r in found["campaigns"].collect()}
    first = sysmon.earliest(found["correlations"], "t").collect()
    assert len(first) == 10 and [r["t"] for r in first] == sorted(r["t"] for r in found["correlations"].collect())[:10]


def test_spool_as_table_and_stream(spark, tmp_path):
    import json

    (tmp_path / "spool").mkdir()
    lines = [json.dumps({"event_id": 1, "event_time": "2024-01-02T03:04:05Z", "computer": "pc", "image": "C:/x/Cmd.exe", "pid": 7}), "{broken", json.dumps({"event_id": "none", "user": "nan"})]
    (tmp_path / "spool" / "a.jsonl").write_text("\n".join(lines))
    rows = sysmon.read_spool(spark, str(tmp_path / "spool")).collect()
    assert [(r["event_code"], r["image"], r["corrupt"]) for r in sorted(rows, key=lambda r: (r["event_code"] is None, r["corrupt"]))] == [(1, "cmd.exe", False), (None, None, False), (None, None, True)]
    assert run(sysmon.stream_spool(spark, str(tmp_path / "spool")), tmp_path, "live_spool").filter("event_code = 1").count() == 1


def test_exact_and_partial_images(spark):
    from tidewatch.operators import rules as R

    e = R.with_signals(telemetry(spark, DATA))
    part, exact, none = (R.Rule("X", "x", "low", 10, "T", "Execution", "Execution", (1,), image_any=(w,), exact_image=x) for w, x in (("power", False), ("powershell.exe", True), ("power", True)))
    counts = [R.match_rules(e, [r]).count() for r in (part, exact, none)]
    assert counts[0] == counts[1] > 0 and counts[2] == 0
    assert R.match_rules(e, [part]).first()["matched_fields"] == {"image_any": ["power"]}
