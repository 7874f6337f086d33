"""Sharding by minimax contiguous partition of atomic groups. DataFrame functions only.

Groups are documents of equal text; none is split. They stand in the order of a 63-bit hash of their text, so sizes are mixed
all along the order, and a shard is a range of hashes: a row's shard follows from its own text, without a join. (Texts whose
hashes agree count as one group.)

A binary search finds the smallest capacity with which a greedy pass fills ``shards`` shards. It runs on the driver over
*units*, ranges of hashes with their bytes: 16,384 at first. Units as indivisible pieces give a capacity that suffices, units
of several groups as divisible ones a capacity that is needed; units that a cut may fall into are parted on the cluster, and
the search is repeated until both agree. So the driver sees some ten thousand sums, whatever the corpus, and the capacity
is the exact one for single groups. A second binary search within it finds the greatest least load, so no shard takes all the slack.

Slots are ranks within parts of a shard, whose number grows with the table.

Defined results: a null text has no bytes and is grouped with the empty text; repeated rows are rows of one group; with
fewer groups than shards some shards are empty; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import plain, stored

SHARDS, OVERHEAD = 40, 16
#: Bits of a group's hash; of the first units; of each parting; rows of a part in which slots are counted.
BITS, FIRST, FINER, PART = 63, 14, 6, 100_000
#: (first hash, bits left open, bytes, whether it is a single group)
Unit = tuple[int, int, int, bool]


def greedy(units: list[Unit], sums: list[int], capacity: int, shards: int, divisible: bool) -> tuple[bool, list[int]]:
    """Whether ``shards`` shards of the capacity hold all units, and the places (in bytes) where shards 1, 2, .. begin.

    ``sums``: the bytes before each unit, and all bytes. With ``divisible``, units of several groups may be cut anywhere.
    """
    at, cuts = 0, []
    for _ in range(shards):
        if sums[-1] - at <= capacity:
            return True, cuts
        k = bisect_right(sums, at + capacity) - 1  # the unit that overflows
        to = at + capacity if divisible and not units[k][3] else sums[k]
        if to <= at:
            return False, cuts + [at] * (shards - 1 - len(cuts))
        at = to
        cuts.append(at)
    return False, cuts[: shards - 1]


def least_capacity(units: list[Unit], sums: list[int], shards: int, divisible: bool) -> int:
    low, high = -(-sums[-1] // shards), sums[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy(units, sums, middle, shards, divisible)[0]:
            high = middle
        else:
            low = middle + 1
    return low


def units_to_part(units: list[Unit], shards: int) -> tuple[int, list[Unit]]:
    """The least capacity for indivisible units, and the units of several groups that one of its cuts may fall into."""
    sums = [0, *accumulate(u[2] for u in units)]
    enough, needed = (least_capacity(units, sums, shards, d) for d in (False, True))
    if enough == needed:
        return enough, []
    from_, to = greedy(units, sums, needed, shards, False)[1], greedy(units, sums, enough, shards, True)[1]
    inside: set[int] = set()
    for k in range(max(len(from_), len(to))):
        a = from_[k] if k < len(from_) else sums[-1]
        b = to[k] if k < len(to) else sums[-1]
        a, b = min(a, b), max(a, b)
        inside |= set(range(bisect_right(sums, a) - 1, min(bisect_left(sums, b) + 1, len(units))))
    return enough, [units[k] for k in sorted(inside) if not units[k][3]]


def cuts_between(sums: list[int], low: int, high: int, shards: int) -> list[int] | None:
    """Indices into ``sums`` where shards 1, 2, .. begin so that all loads are from ``low`` to ``high``; None where there are none.

    Goes from shard to shard over all places where its end may be; of several, those nearest to equal shares are taken,
    and where shards stay empty the last ones do.
    """
    total, ends = sums[-1], [[0]]
    for k in range(1, shards):
        before, found, a = ends[-1], [], 0
        first = bisect_left(sums, max(sums[before[0]] + low, total - (shards - k) * high))
        last = bisect_right(sums, min(sums[before[-1]] + high, total - (shards - k) * low))
        for j in range(first, last):
            while a < len(before) and sums[before[a]] < sums[j] - high:
                a += 1
            if a == len(before):
                break
            if sums[before[a]] <= sums[j] - low:
                found.append(j)
        if not found:
            return None
        ends.append(found)
    cuts, to = [], total
    for k in range(shards - 1, 0, -1):
        a, b = bisect_left(ends[k], to - high, key=sums.__getitem__), bisect_right(ends[k], to - low, key=sums.__getitem__)
        if a == b:
            return None
        cuts.append(min(ends[k][a:b], key=lambda j: abs(sums[j] * shards - total * k) if low else -j))
        to = sums[cuts[-1]]
    return cuts[::-1] if low <= to <= high else None


def even_cuts(units: list[Unit], capacity: int, shards: int) -> list[int]:
    """Hashes where shards 1, 2, .. begin: within the capacity, the least load is the greatest that the units allow."""
    sums = [0, *accumulate(u[2] for u in units)]
    low, high = 0, sums[-1] // shards
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if cuts_between(sums, middle, capacity, shards) else (low, middle - 1)
    return [units[k][0] for k in cuts_between(sums, low, capacity, shards) or [] if k < len(units)]


def group_hash(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - BITS)


def units_of(rows: DataFrame, open_bits: int, within: list[Unit] | None = None) -> list[Unit]:
    """The units of the table's groups (group, size), ``open_bits`` wide; within given units of some other width only."""
    if within:
        above = within[0][1]
        wanted = rows.sparkSession.createDataFrame([(u[0] >> above,) for u in within], "above long")  # as many as there are units
        rows = rows.withColumn("above", F.shiftright("group", above)).join(F.broadcast(wanted), "above")
    sums = rows.groupBy(F.shiftright("group", open_bits).alias("unit")).agg(F.sum("size").alias("bytes"), F.min("group").alias("low"), F.max("group").alias("high"))
    return sorted((r["unit"] << open_bits, open_bits, r["bytes"], r["low"] == r["high"]) for r in sums.collect())


def minimax_cuts(rows: DataFrame, shards: int, first: int = FIRST, finer: int = FINER) -> tuple[int, list[int]]:
    """(smallest capacity, hashes where shards 1, 2, .. begin) over rows (group, size)."""
    units = units_of(rows, BITS - first)
    if not units:
        return 0, []
    while True:
        capacity, rough = units_to_part(units, shards)
        if not rough:
            return capacity, even_cuts(units, capacity, shards)
        for bits in {u[1] for u in rough}:
            mine = [u for u in rough if u[1] == bits]
            gone = set(mine)
            units = [u for u in units if u not in gone] + units_of(rows, max(0, bits - finer), mine)
        units.sort()


def with_slots(placed: DataFrame, part: int = PART) -> DataFrame:
    """Add ``slot``, the rank from 0 within a shard. ``placed`` is read twice. Parts of a shard hold about ``part`` rows."""
    most = placed.groupBy("shard").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(-(-most // part) or 1)))
    sizes = parts.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1)
    return ranked.join(before, ["shard", "part"]).withColumn("slot", F.col("before") + F.col("rank")).drop("part", "before", "rank")


def shard_documents(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, first: int = FIRST, part: int = PART) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row, by the law ``bytes``."""
    text = plain("text")
    rows = stored(docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), group_hash(text).alias("group")), "rows")
    _, cuts = minimax_cuts(rows.select("group", "size"), shards, first)
    shard = reduce(lambda a, b: a + b, [(F.col("group") >= F.lit(c)).cast("int") for c in cuts], F.lit(0))
    out = with_slots(rows.select("doc_id", "size", "text_crc32", shard.alias("shard")), part)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
