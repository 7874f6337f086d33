"""The telemetry view: the driver's ``events`` table as canonical endpoint events.

``t`` is microseconds since 1970 in UTC, so results do not depend on the session's time zone. Ties in time are broken by
``event_id`` everywhere. A process is a user; its parent is the user of the same computer twenty numbers before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: event_type -> (event code, image)
KINDS = {"view": (1, "powershell.exe"), "click": (3, "cmd.exe"), "purchase": (11, "certutil.exe"), "signup": (13, "reg.exe"), "error": (22, "svchost.exe")}


def _kind(column: int):
    out = None
    for name, values in KINDS.items():
        test = F.col("event_type") == name
        out = F.when(test, values[column]) if out is None else out.when(test, values[column])
    return out


def from_events(events: DataFrame) -> DataFrame:
    code, k = F.col("event_code"), F.col("k")
    base = events.select(
        F.col("event_id"), F.col("event_id").cast("string").alias("event_uid"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("t"),
        F.concat(F.lit("host-"), (F.col("user_id") % 20).cast("string")).alias("computer"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"),
        F.col("user_id").cast("string").alias("pid"), (F.col("user_id") - 20).cast("string").alias("ppid"),
        _kind(0).alias("event_code"), _kind(1).alias("image"), "value",
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"),
    )
    text = k.cast("string")
    by_user = Window.partitionBy("user").orderBy("t", "event_id")
    suffix = F.when(k % 5 == 0, F.lit(" -enc QQBCAEMARABFAEYARwBI")).when(k % 5 == 1, F.concat(F.lit(" http://10.0.0."), text, F.lit("/a"))).when(k % 5 == 2, F.concat(F.lit(" /create task"), text)).when(k % 5 == 3, F.lit(" -noprofile")).otherwise("")
    key = F.when(k % 3 == 0, F.concat(F.lit("HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run\\a"), text)).when(k % 3 == 1, F.concat(F.lit("HKLM\\Software\\Classes\\CLSID\\"), text)).otherwise(F.concat(F.lit("HKLM\\System\\CurrentControlSet\\Services\\s"), text))
    return base.withColumns({
        "parent_image": F.lag("image").over(by_user),
        "command_line": F.concat("image", suffix, F.lit(" "), text),
        "dst_ip": F.when(code == 3, F.concat(F.when(k % 2 == 0, F.lit("203.0.113.")).otherwise(F.lit("10.0.0.")), text)),
        "dst_port": F.when(code == 3, F.when(k % 3 == 0, F.lit("443")).otherwise(F.lit("8080"))),
        "file_path": F.when(code == 11, F.concat(F.lit("C:\\Users\\Public\\f"), text, F.lit(".exe"))),
        "reg_key": F.when(code == 13, key),
    })


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


#: The same view for DuckDB, as the start of a WITH list.
SQL = r"""WITH ev AS (
  SELECT event_id, epoch_us(ts) AS t, user_id, event_type, value, CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS k FROM events),
tel AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS event_uid, t, 'host-' || CAST(user_id % 20 AS VARCHAR) AS computer, 'u' || CAST(user_id AS VARCHAR) AS "user",
    CAST(user_id AS VARCHAR) AS pid, CAST(user_id - 20 AS VARCHAR) AS ppid,
    CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 11 WHEN 'signup' THEN 13 WHEN 'error' THEN 22 END AS event_code,
    CASE event_type WHEN 'view' THEN 'powershell.exe' WHEN 'click' THEN 'cmd.exe' WHEN 'purchase' THEN 'certutil.exe' WHEN 'signup' THEN 'reg.exe' WHEN 'error' THEN 'svchost.exe' END AS image,
    value, k FROM ev),
tele AS (
  SELECT *, lag(image) OVER (PARTITION BY "user" ORDER BY t, event_id) AS parent_image,
    image || CASE k % 5 WHEN 0 THEN ' -enc QQBCAEMARABFAEYARwBI' WHEN 1 THEN ' http://10.0.0.' || k || '/a' WHEN 2 THEN ' /create task' || k WHEN 3 THEN ' -noprofile' ELSE '' END || ' ' || k AS command_line,
    CASE WHEN event_code = 3 THEN (CASE WHEN k % 2 = 0 THEN '203.0.113.' ELSE '10.0.0.' END) || k END AS dst_ip,
    CASE WHEN event_code = 3 THEN (CASE WHEN k % 3 = 0 THEN '443' ELSE '8080' END) END AS dst_port,
    CASE WHEN event_code = 11 THEN 'C:\Users\Public\f' || k || '.exe' END AS file_path,
    CASE WHEN event_code = 13 THEN (CASE k % 3 WHEN 0 THEN 'HKLM\Software\Microsoft\Windows\CurrentVersion\Run\a' WHEN 1 THEN 'HKLM\Software\Classes\CLSID\' ELSE 'HKLM\System\CurrentControlSet\Services\s' END) || k END AS reg_key
  FROM tel)
"""
