"""The whole burst score, and a ledger whose lines add up to it.

Every step that changes the score is a line: signals as they come, then what the chain factor, volume, rarity, maturity, floors and
limits add or take. So the sum of a burst's lines is its score, to the last digit shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.functions import signals as S

#: What ``steps`` reads; columns that a table lacks count as nothing.
INPUTS = {
    "rule_points": 0.0, "sequence_points": 0.0, "sequence_hits": 0.0, "behavior": 0.0, "frequency": 1.0, "correlation": 0.0, "group_size": 1.0, "n": 1.0, "entropy": 0.0, "sequence_anomaly": 0.0,
    "samples": 0.0, "drift": 0.0, "depth": 1.0,
}
LINES = ["rule", "sequence", "behavior", "correlation", "lolbin", "stealth", "drift", "chain factor", "volume", "rarity", "first seen", "depth", "maturity", "limit", "floor", "override", "rounding"]


def scored(b: DataFrame) -> DataFrame:
    """Adds ``lines`` (an array of label and points in the order of ``LINES``, those of no points left out), ``score``, ``driver`` and ``severity``.

    ``b``: bursts with image, parent_image, encoded and the columns of ``INPUTS``. Without a rule, sequence or behavior there is no score.
    """
    num = {c: F.coalesce(F.col(c), F.lit(v)).cast("double") if c in b.columns else F.lit(v) for c, v in INPUTS.items()}
    b = b.withColumns({f"__{c}": v for c, v in num.items()})
    x = {c: F.col(f"__{c}") for c in INPUTS}
    image, low = F.lower(F.col("image")), F.lower(F.coalesce("parent_image", F.lit("")))
    encoded, one, none = F.coalesce("encoded", F.lit(False)), F.lit(1.0), F.lit(0.0)
    when = lambda test, points: F.when(test, F.lit(points)).otherwise(none)
    behavior = 40 * x["behavior"] + when(x["behavior"] > 0.8, 5.0)
    odd = (x["entropy"] > 4.0) | encoded | (x["sequence_anomaly"] > 0.7)
    stealth = (x["behavior"] > 0.75) & (x["n"] <= 5) & odd & (x["samples"] > 5) & ~low.isin(K.TRUSTED_PARENTS)
    b = b.withColumns({
        "__silent": (x["rule_points"] == 0) & (x["sequence_points"] == 0) & (x["behavior"] == 0), "__b": behavior,
        "__c": F.least(F.lit(35.0), 4 * F.sqrt(F.greatest(none, x["correlation"])) * F.least(F.lit(1.5), F.log2(F.greatest(one, x["group_size"]) + 1))),
        "__l": when(image.isin("powershell.exe", "cmd.exe", "wscript.exe") & (encoded | (x["depth"] >= 2)), 10.0), "__s": when(stealth, 15.0), "__d": when(x["drift"] > 0.3, 10.0),
        "__rarity": F.when(x["frequency"] <= 3, 10 * (1.5 - 0.1 * x["frequency"])).otherwise(none), "__first": when((x["frequency"] == 1) & (x["behavior"] > 0.4), 10.0),
        "__weight": F.greatest(F.lit(0.6), F.least(F.lit(1.5), 1.5 - 0.3 * F.log10(F.greatest(one, x["frequency"]) + 1))),
    })
    signals = x["rule_points"] + x["sequence_points"] + F.col("__b") + F.col("__c") + F.col("__l") + F.col("__s") + F.col("__d")
    b = b.withColumn("__signals", signals).withColumn("__chain", F.col("__signals") * F.least(F.lit(0.35), 0.1 * F.greatest(one, x["depth"])))
    total = F.col("__signals") + F.col("__chain") + 0.5 * x["n"] + (F.col("__rarity") + F.col("__first")) * F.col("__weight") + when(x["depth"] >= 3, 15.0)
    penalty = F.when(x["samples"] < 5, 0.85).otherwise(F.greatest(F.lit(0.75), 1 - 0.015 * F.greatest(none, 20 - x["samples"])))
    floor = F.when(image.isin("powershell.exe", "pwsh.exe"), 45.0).when(image.isin("cmd.exe", "wscript.exe", "cscript.exe"), 40.0).otherwise(none)
    seen = encoded | (x["behavior"] > 0.5) | (x["depth"] >= 2)
    b = b.withColumn("__total", total).withColumn("__mature", F.col("__total") * penalty).withColumn("__limited", F.greatest(none, F.least(F.lit(99.0), F.col("__mature"))))
    b = b.withColumn("__floored", F.when(seen, F.greatest(F.col("__limited"), floor)).otherwise(F.col("__limited")))
    b = b.withColumn("__over", F.when((x["sequence_points"] + F.col("__l") >= 50) | (x["sequence_hits"] >= 2), F.greatest(F.col("__floored"), F.lit(75.0))).otherwise(F.col("__floored")))
    b = b.withColumn("score", F.when(F.col("__silent"), none).otherwise(S.rounded(F.col("__over"), 1)))
    points = [
        x["rule_points"], x["sequence_points"], F.col("__b"), F.col("__c"), F.col("__l"), F.col("__s"), F.col("__d"), F.col("__chain"), 0.5 * x["n"], F.col("__rarity") * F.col("__weight"), F.col("__first") * F.col("__weight"),
        when(x["depth"] >= 3, 15.0), F.col("__mature") - F.col("__total"), F.col("__limited") - F.col("__mature"), F.col("__floored") - F.col("__limited"), F.col("__over") - F.col("__floored"), F.col("score") - F.col("__over"),
    ]
    lines = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("label"), v.alias("points")) for i, (name, v) in enumerate(zip(LINES, points, strict=True))])
    parts = {"rule": x["rule_points"], "sequence": x["sequence_points"] + F.col("__l"), "behavior": F.col("__b") + F.col("__s") + F.col("__d"), "rarity": F.col("__rarity") + F.col("__first"), "correlation": F.col("__c")}
    best = F.array_max(F.array(*[F.struct(v.alias("points"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, v) in enumerate(parts.items())]))
    share = best["points"] / sum(parts.values(), none)
    driver = F.when(F.col("__silent"), "benign").when(share < 0.4, "mixed").otherwise(best["name"])
    severity = F.when(F.col("score") >= 70, "high").when(F.col("score") >= 40, "medium").when(F.col("score") > 0, "low").otherwise("informational")
    lines = F.when(F.col("__silent"), F.filter(lines, lambda x: F.lit(False))).otherwise(F.filter(lines, lambda x: F.abs(x["points"]) > 1e-12))
    out = b.withColumns({"lines": lines, "driver": driver, "severity": severity})
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def ledger(scores: DataFrame, by: str = "burst_id") -> DataFrame:
    """One row for each line: points, share of all that was added, and a colour by size; what is taken off is gray."""
    gained = F.aggregate("lines", F.lit(0.0), lambda a, x: a + F.greatest(x["points"], F.lit(0.0)))
    out = scores.select(by, gained.alias("__gained"), F.inline("lines"))
    p = F.col("points")
    colour = F.when(p < 0, "gray").when(p >= 20, "red").when(p >= 10, "orange").when(p >= 5, "yellow").otherwise("green")
    return out.select(by, "place", "label", "points", (F.greatest(p, F.lit(0.0)) / F.col("__gained")).alias("share"), colour.alias("colour"))
