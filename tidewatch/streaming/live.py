"""Live operators: the batch expressions over streams, with watermarks and checkpointed state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import signals as S
from tidewatch.operators import rules as R
from tidewatch.operators import sequences as Q


ALERT = ["event_uid", "t", "rule_id", "rule_severity", "image", "computer", "mitre_id"]
DETECTION = ["event_uid", "t", "rule_id", "mitre_id", "mitre_tactic", "kill_chain_stage", "rule_severity", "image", "parent_image", "computer", "pid", "ppid", "confidence_score"]
#: Fixed value: the confidence of live hits.
LIVE_CONFIDENCE = 85


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within the lateness allowed."""
    return events.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["event_uid"])


def alerts(events: DataFrame, rules: list[R.Rule] | None = None) -> DataFrame:
    """Rule hits of each event as it comes: the same compiled conditions as in batch, so no state is needed."""
    return R.match_rules(R.with_signals(events), rules or R.RULES)


def write_twice(alerts: DataFrame, folder: str, checkpoint: str):
    """A writer of rule hits to two tables that agree: ``alerts`` and ``detections``, the latter with the fixed confidence of live hits.

    Each batch goes to a folder with its number, which a repeated batch overwrites in both tables; so after a failure between the two, the
    batch is written again whole, and every row is there once. Read them back with ``read_sink``.
    """
    def both(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, rows in (("alerts", batch.select(*ALERT)), ("detections", batch.select(*DETECTION))):
                rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        finally:
            batch.unpersist()

    return alerts.withColumn("confidence_score", F.lit(LIVE_CONFIDENCE)).writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)


def read_sink(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def live_bursts(events: DataFrame, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Closed bursts of each computer and image; an event just at the gap still belongs."""
    w = F.session_window("event_time", gap)
    return events.withWatermark("event_time", late).groupBy("computer", "image", w).agg(F.count("*").alias("n"), F.min("event_time").alias("start_time"), F.max("event_time").alias("end_time")).drop("session_window")


def throughput(events: DataFrame, width: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Events by collection priority in tumbling windows."""
    return events.withWatermark("event_time", late).groupBy(F.window("event_time", width), S.priority(F.col("event_code")).alias("priority")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "priority", "n")


def silent_hosts(events: DataFrame, as_of, seconds: int = 300) -> DataFrame:
    """Hosts whose last event is older than the limit at ``as_of``."""
    last = events.groupBy("computer").agg(F.max("event_time").alias("last_seen"))
    return last.filter(as_of.cast("double") - F.col("last_seen").cast("double") > seconds)


def pair_sequences(events: DataFrame, first: str, second: str, gap_ms: int = 900_000) -> DataFrame:
    """Stateful two-step sequences of a computer: ``second`` within the gap after the latest ``first``.

    The state of a computer is one timestamp, with a time to live of the gap, so it stays small whatever the stream.
    """
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class Pairs(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", "ms bigint")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            table = pd.concat(rows).sort_values(["event_time", "event_uid"])
            held = self.last.get()[0] if self.last.exists() else None
            out = []
            for image, time, uid in zip(table["image"], table["event_time"], table["event_uid"], strict=True):
                ms = int(time.timestamp() * 1000)
                if image == second and held is not None and 0 <= ms - held <= gap_ms:
                    out.append((key[0], uid, ms - held))
                if image == first:
                    held = ms
            if held is not None:
                self.last.update((held,))
            yield pd.DataFrame(out, columns=["computer", "event_uid", "gap_ms"])

        def close(self) -> None:
            pass

    rows = events.filter(F.col("image").isin(first, second)).select("computer", "image", "event_time", "event_uid")
    return rows.groupBy("computer").transformWithStateInPandas(Pairs(), "computer string, event_uid string, gap_ms bigint", "Append", "None")


def chains(events: DataFrame, patterns: list[Q.Pattern] = Q.PATTERNS, late: str | None = None) -> DataFrame:
    """Sequences of any number of steps over a stream, by the rules of ``sequences.detect``, one row for each prefix of two steps or more.

    Step tests are Columns. A computer's state is its open chains; each lives for the few rows that its next step may skip. With ``late``
    (events have an ``event_time``) rows that come later than that are left out, and a timer in event time ends the state of a computer that is silent
    for longer than any step may wait.
    """
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    shape = [(p.pattern_id, p.confidence, [(s.max_skip_steps, (s.max_gap_seconds + Q.TOLERANCE) * 1_000_000) for s in p.steps]) for p in patterns]
    names = ["pattern_id", "computer", "first_uid", "last_uid", "first_t", "last_t", "matched", "confidence"]

    class Chains(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.open = handle.getListState("open", "pattern int, matched int, uid string, first bigint, last bigint, left int")
            self.timer = _Timer(handle) if late else None

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            table = pd.concat(rows).sort_values(["t", "event_id"])
            held, out = [tuple(x) for x in self.open.get()] if self.open.exists() else [], []
            for uid, t, fits in zip(table["event_uid"], table["t"], table["fits"], strict=True):
                t, going = int(t), []
                for i, matched, first_uid, first, last, left in held:
                    name, base, steps = shape[i]
                    if fits[i][matched] and t - last <= steps[matched][1]:
                        out.append((name, key[0], first_uid, uid, first, t, matched + 1, base * (matched + 1) // len(steps)))
                        if matched + 1 < len(steps):
                            going.append((i, matched + 1, first_uid, first, t, steps[matched + 1][0] + 1))
                    elif left > 1:
                        going.append((i, matched, first_uid, first, last, left - 1))
                going += [(i, 1, uid, t, t, steps[1][0] + 1) for i, (_, _, steps) in enumerate(shape) if fits[i][0]]
                held = going
            self.open.put(held) if held else self.open.clear()
            if late:
                self.timer.restart(held and max(x[4] for x in held) // 1000 + longest)
            yield pd.DataFrame(out, columns=names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            self.open.clear()
            self.timer.forget()
            yield pd.DataFrame([], columns=names)

        def close(self) -> None:
            pass

    longest = max(s.max_gap_seconds + Q.TOLERANCE for p in patterns for s in p.steps[1:]) * 1000
    fits = F.array(*[F.array(*[Q.matches(s) for s in p.steps]) for p in patterns])
    columns = ["computer", "event_id", "event_uid", "t", fits.alias("fits")]
    rows = events.withWatermark("event_time", late).select(*columns, "event_time") if late else events.select(*columns)
    return rows.groupBy("computer").transformWithStateInPandas(Chains(), "pattern_id string, computer string, first_uid string, last_uid string, first_t bigint, last_t bigint, matched int, confidence int", "Append", "EventTime" if late else "None")


class _Timer:
    """One timer in event time for each key, which the key's newest state moves on."""

    def __init__(self, handle) -> None:
        self.handle, self.at = handle, handle.getValueState("timer", "ms bigint")

    def restart(self, ms: int | None) -> None:
        if self.at.exists():
            self.handle.deleteTimer(self.at.get()[0])
            self.at.clear()
        if ms:
            self.handle.registerTimer(ms)
            self.at.update((ms,))

    def forget(self) -> None:
        self.at.clear()


def learning_baseline(events: DataFrame, most_deviation: float = 0.4, young: int = 15, late: str | None = None, silent_days: int = 30) -> DataFrame:
    """Each event's deviation from the profile of its computer and image so far; events that deviate little, and all of a young
    profile, are then learned. The state of an entity is three numbers: count, mean and sum of squared differences. With ``late`` (events have
    an ``event_time``) rows that come later are left out, and the profile of an entity that is silent for ``silent_days`` ends."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class Learns(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.profile = handle.getValueState("profile", "n bigint, mean double, m2 double")
            self.timer = _Timer(handle) if late else None

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            table = pd.concat(rows).sort_values(["t", "event_id"])
            n, mean, m2 = self.profile.get() if self.profile.exists() else (0, 0.0, 0.0)
            out = []
            for uid, value in zip(table["event_uid"], table["value"], strict=True):
                spread = max(0.1, (m2 / max(n - 1, 1)) ** 0.5)
                deviation = 0.25 if n == 0 else 0.3 if n < 10 else min(1.0, max(0.2, abs(value - mean) / spread / 3))
                learned = n < young or deviation < most_deviation
                out.append((*key, uid, n, deviation, learned))
                if learned:
                    n, step = n + 1, value - mean
                    mean += step / n
                    m2 += step * (value - mean)
            self.profile.update((n, mean, m2))
            if late:
                self.timer.restart(int(table["t"].max()) // 1000 + silent_days * 86_400_000)
            yield pd.DataFrame(out, columns=names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            self.profile.clear()
            self.timer.forget()
            yield pd.DataFrame([], columns=names)

        def close(self) -> None:
            pass

    names = ["computer", "image", "event_uid", "known", "deviation", "learned"]
    columns = ["computer", "image", "event_id", "event_uid", "t", "value"]
    rows = events.filter("value is not null and not isnan(value)")
    rows = rows.withWatermark("event_time", late).select(*columns, "event_time") if late else rows.select(*columns)
    return rows.groupBy("computer", "image").transformWithStateInPandas(Learns(), "computer string, image string, event_uid string, known bigint, deviation double, learned boolean", "Append", "EventTime" if late else "None")
