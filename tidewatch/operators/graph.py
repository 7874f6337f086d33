"""Correlation: edges between events of a host near in time, campaigns as components, process trees.

The near-in-time self-join is an equi-join on (computer, time bucket): a row goes to its own bucket and its partner looks
in its own and the one before, so no pair of rows is compared that is not within two buckets of each other.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import constants as K
from tidewatch.functions import signals as S
from tidewatch.operators.slabs import last_before, numbered_runs

SECOND = 1_000_000


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-rounds-")


#: What deletes each table made by ``stored``.
_made: dict[str, Callable[[], bool]] = {}


@atexit.register
def drop_stored() -> None:
    """Delete the tables stored so far; also done at the end of the program. Results that still read them are lost."""
    while _made:
        with contextlib.suppress(Exception):  # the session may be gone
            _made.popitem()[1]()


def shared_folder(spark, name: str) -> str:
    """A new folder of this name where all executors reach it, dropped at the end of the program."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{shared or _own_folder()}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    _made[path] = lambda: place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return path


def stored(df: DataFrame) -> DataFrame:
    """A table in the shared folder, of a round or of what is read often: lineage stays short, and a lost executor re-reads it. It is
    dropped at the end of the program."""
    spark = df.sparkSession
    path = shared_folder(spark, "round")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def near_pairs(events: DataFrame, seconds: int = 900) -> DataFrame:
    """Pairs (a before b) of one computer at most ``seconds`` apart."""
    width = seconds * SECOND
    a = events.select(*[F.col(c).alias(f"a_{c}") for c in events.columns], F.floor(F.col("t") / width).alias("bucket"))
    b = events.select(*[F.col(c).alias(f"b_{c}") for c in events.columns], F.explode(F.array(F.floor(F.col("t") / width), F.floor(F.col("t") / width) - 1)).alias("bucket"))
    after = (F.col("b_t") > F.col("a_t")) | ((F.col("b_t") == F.col("a_t")) & (F.col("b_event_id") > F.col("a_event_id")))
    return a.join(b, (a["bucket"] == b["bucket"]) & (F.col("a_computer") == F.col("b_computer")) & after & (F.col("b_t") - F.col("a_t") <= width)).drop("bucket")


def edges(events: DataFrame, seconds: int = 900) -> DataFrame:
    """Weighted edges: parent and child 5, later tactic 3, same stage and user 2, same user 1; halved when going back."""
    keep = events.select("event_id", "event_uid", "t", "computer", "user", "image", "parent_image", "kill_chain_stage")
    p = near_pairs(keep, seconds)
    ra, rb = S.stage_rank(F.col("a_kill_chain_stage")), S.stage_rank(F.col("b_kill_chain_stage"))
    user = F.coalesce("a_user", F.lit("")) == F.coalesce("b_user", F.lit(""))
    busy = (F.col("a_kill_chain_stage") != "Background") & (F.col("b_kill_chain_stage") != "Background")
    kind = F.when((F.col("b_parent_image") == F.col("a_image")) & user, "structural").when((rb == ra + 1) & busy, "tactic").when((ra == rb) & user, "stage").when(user & busy, "user")
    weight = S.lookup(F.col("kind"), {"structural": 5.0, "tactic": 3.0, "stage": 2.0, "user": 1.0}) * F.when(rb < ra, 0.5).otherwise(1.0)
    direction = F.when(rb > ra, "forward").when(rb < ra, "backward").otherwise("lateral")
    return p.withColumn("kind", kind).filter("kind is not null").select("a_event_id", "b_event_id", F.col("a_computer").alias("computer"), "kind", weight.alias("weight"), direction.alias("direction"))


def edge_sums(events: DataFrame, seconds: int = 900) -> DataFrame:
    """(node, edges, weight, forward, backward): what the ``edges`` that end in each event come to, without listing a pair.

    Every event is added to running counts by class of stage when it happens and taken off ``seconds`` later, so an event finds in them how
    many earlier ones are near: of its user, of its user with the parent's image, and of its host with the stage before. What an edge
    weighs depends on the two classes only, and pairs that are parent and child are taken off the other kinds. Groups are
    (host, slab of sixteen times ``seconds``, kind, name): the work is a sort of some eight rows an event.
    """
    width, slab = seconds * SECOND, 16 * seconds * SECOND
    busy, rank = F.coalesce(F.col("kill_chain_stage") != "Background", F.lit(False)), S.stage_rank(F.col("kill_chain_stage"))
    odd = len(K.STAGES)  # the class of stages that aren't in the list, of rank -1
    user, end = F.coalesce("user", F.lit("")), F.col("t") + width
    number = lambda at: F.floor(at / slab)

    def entries(kind: str, name: Column, value: int, at: Column, when: Column, number_: Column | None = None) -> Column:
        """``value``: 0 asks, 1 adds (in its own slab and where it ends), -1 takes off."""
        places = F.array_distinct(F.array(number(F.col("t")), number(end))) if value == 1 else F.array(number(at))
        row = lambda s: F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.coalesce(number_, F.lit(0)).cast("int").alias("number") if number_ is not None else F.lit(0).alias("number"), s.alias("slab"), at.alias("at"), F.lit(value).alias("value"))
        return F.when(when, F.transform(places, row)).otherwise(F.array())

    t, yes, none = F.col("t"), F.lit(True), F.lit("")
    mine, above = F.concat_ws("\0", user, "image"), F.concat_ws("\0", user, "parent_image")
    rows = F.concat(
        *[entries("user", user, v, a, yes) for v, a in ((0, t), (1, t), (-1, end))],
        entries("parent", above, 0, t, F.col("parent_image").isNotNull()), *[entries("parent", mine, v, a, F.col("image").isNotNull()) for v, a in ((1, t), (-1, end))],
        entries("tactic", none, 0, t, busy, rank - 1), *[entries("tactic", none, v, a, busy, rank) for v, a in ((1, t), (-1, end))],
    )
    x = events.filter("computer is not null").select("event_id", "computer", rank.alias("rank"), busy.alias("busy"), F.when(rank < 0, odd).otherwise(rank).alias("class"), rows.alias("rows"))
    x = x.select("event_id", "computer", "rank", "busy", "class", F.inline("rows"))
    # what ends at some time is still near at that time; of one time the smaller id is the earlier; an event doesn't meet itself
    order = Window.partitionBy("computer", "slab", "kind", "name", "number").orderBy("at", F.when(F.col("value") < 0, 1).otherwise(0), "event_id", "value").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({f"__{c}": F.coalesce(F.sum(F.when(F.col("class") == c, F.col("value")).otherwise(0)).over(order), F.lit(0)) for c in range(odd + 1)}).filter("value = 0")

    kind, b = F.col("kind"), F.col("rank")
    sums: dict[str, Column] = {k: F.lit(0) for k in ("edges", "weight", "forward", "backward")}
    for c in range(odd + 1):
        a, both = (-1 if c == odd else c), (F.lit(c > 0) & F.col("busy"))
        later, back = F.when(b > a, 1).otherwise(0), F.when(b < a, 1).otherwise(0)
        half = F.when(b < a, 0.5).otherwise(1.0)
        tactic, stage = both & (b == a + 1), b == a
        other = F.when(stage, 2.0).when(both & ~tactic, half)  # what the pair weighs as stage or user, null if neither
        as_user = {"edges": F.when(other.isNotNull(), 1).otherwise(0), "weight": F.coalesce(other, F.lit(0.0)), "forward": F.when(other.isNotNull(), later).otherwise(0), "backward": F.when(other.isNotNull(), back).otherwise(0)}
        as_tactic = {"edges": F.when(tactic, 1).otherwise(0), "weight": F.when(tactic, 3.0).otherwise(0.0), "forward": F.when(tactic, 1).otherwise(0), "backward": F.lit(0)}
        as_child = {"edges": F.lit(1), "weight": 5.0 * half, "forward": later, "backward": back}
        for k in sums:
            each = F.when(kind == "user", as_user[k]).when(kind == "tactic", as_tactic[k]).otherwise(as_child[k] - as_user[k] - as_tactic[k])
            sums[k] = sums[k] + F.col(f"__{c}") * each
    found = x.groupBy(F.col("event_id").alias("node")).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    return found.filter("edges > 0")


def links(events: DataFrame, seconds: int = 900) -> DataFrame:
    """(u, v): as few edges as connect what all of ``edges`` connect; their number grows with the events, not with their pairs.

    Events of one user and stage, or of one user outside of Background, form chains: each is linked to the one before. Where
    parents meet children, or a stage the next, each later event is linked to the latest earlier one, and two earlier ones
    that follow each other are linked if the same later event is near to both. All of it is found by windows within time slabs
    of sixteen times ``seconds``; events near the end of a slab are also in the next, so a busy host is cut into many parts.
    """
    width, slab = seconds * SECOND, 16 * seconds * SECOND
    rank, busy, user = S.stage_rank(F.col("kill_chain_stage")), F.col("kill_chain_stage") != "Background", F.coalesce("user", F.lit(""))
    both, earlier, later = 2, 1, 0

    def place(kind: str, role: int, name: Column, number: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), name.cast("string").alias("name"), number.cast("int").alias("number"))

    none = F.lit("")
    places = F.array_compact(F.array(
        place("stage", both, user, rank), F.when(busy, place("user", both, user, F.lit(0))),
        F.when(busy, place("tactic", earlier, none, rank)), F.when(busy, place("tactic", later, none, rank - 1)),
        F.when(F.col("image").isNotNull(), place("parent", earlier, F.concat_ws("\0", user, "image"), F.lit(0))), F.when(F.col("parent_image").isNotNull(), place("parent", later, F.concat_ws("\0", user, "parent_image"), F.lit(0))),
    ))
    slabs = F.array_distinct(F.array(F.floor(F.col("t") / slab), F.floor((F.col("t") + width) / slab)))
    rows = events.filter("computer is not null").select("event_id", "t", "computer", F.explode(slabs).alias("slab"), places.alias("places")).select("event_id", "t", "computer", "slab", F.inline("places"))
    group = Window.partitionBy("computer", "slab", "kind", "name", "number")
    before = F.last(F.when(F.col("role") != later, F.struct("event_id", "t")), ignorenulls=True).over(group.orderBy("t", "event_id", "role").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last(F.when(F.col("role") == later, F.col("t")), ignorenulls=True).over(group.orderBy(F.desc("t"), F.desc("event_id"), F.desc("role")).rowsBetween(Window.unboundedPreceding, -1))
    near = F.when(F.col("role") == earlier, F.col("after")).otherwise(F.col("t")) - F.col("before.t") <= width
    return rows.withColumn("before", before).withColumn("after", after).filter(near).select(F.col("before.event_id").alias("u"), F.col("event_id").alias("v"))


def with_edge(asked: DataFrame, given: DataFrame, back: bool = True, seconds: int = 900) -> DataFrame:
    """(computer, node) of the rows ``asked`` that one of ``edges`` joins to an earlier row of ``given``, or to a later one if not ``back``.

    No pair is listed: in each kind of edge the nearest row on that side is found by a window within time slabs of sixteen times
    ``seconds``, as in ``links``; earlier rows near the end of a slab are also in the next.
    """
    width, slab = seconds * SECOND, 16 * seconds * SECOND
    rank, busy, user = S.stage_rank(F.col("kill_chain_stage")), F.col("kill_chain_stage") != "Background", F.coalesce("user", F.lit(""))

    def rows(events: DataFrame, later: bool, asks: bool) -> DataFrame:
        image = "parent_image" if later else "image"
        place = lambda kind, name, number: F.named_struct(F.lit("kind"), F.lit(kind), F.lit("name"), name, F.lit("number"), number.cast("int"))
        places = F.array(
            place("stage", user, rank), F.when(busy, place("user", user, F.lit(0))), F.when(busy, place("tactic", F.lit(""), rank - 1 if later else rank)),
            F.when(F.col(image).isNotNull(), place("parent", F.concat_ws("\0", user, image), F.lit(0))),
        )
        slabs = F.array(F.floor(F.col("t") / slab)) if later else F.array_distinct(F.array(F.floor(F.col("t") / slab), F.floor((F.col("t") + width) / slab)))
        x = events.filter("computer is not null and t is not null").select("event_id", "t", "computer", F.explode(slabs).alias("slab"), places.alias("places"))
        x = x.select("event_id", "t", "computer", "slab", F.inline("places")).filter("kind is not null")
        return x.withColumns({"role": F.lit(0 if later else 1), "asks": F.lit(asks)})

    both = rows(asked, back, True).unionByName(rows(given, not back, False))
    # of one time and id no row is before the other: those that ask come first
    order = [c if back else F.desc(c) for c in ("t", "event_id", "role")]
    near = F.last(F.when(~F.col("asks"), F.col("t")), ignorenulls=True).over(Window.partitionBy("computer", "slab", "kind", "name", "number").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("near", near).filter(F.col("asks") & (F.abs(F.col("t") - F.col("near")) <= width)).select("computer", F.col("event_id").alias("node")).distinct()


def members(events: DataFrame, seconds: int = 900) -> DataFrame:
    """(node, component) of all events that have an edge."""
    return components(links(events, seconds))


def components(pairs: DataFrame) -> DataFrame:
    """(node, component): the least node of each component of an edge table (u, v), by repeated star contraction."""
    now = stored(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == mark or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = stored(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def campaigns(events: DataFrame, sums: DataFrame, comp: DataFrame) -> DataFrame:
    """Components with their score: structure and signals, times a factor for the number of stages. ``sums``: the ``edge_sums`` of
    the events, ``comp``: their ``members``. Where events have
    a ``confidence``, the greatest is the base of the score, else and where it is 0 the base is 30."""
    nodes = events.join(comp, events["event_id"] == comp["node"])
    n = nodes.groupBy("component").agg(
        F.count("*").alias("nodes"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.first("computer").alias("computer"), F.count_distinct("kill_chain_stage").alias("stages"),
        F.max(S.stage_rank(F.col("kill_chain_stage"))).alias("top_rank"), F.max(F.col("event_code").isin(12, 13, 14)).alias("persists"), F.max(F.col("event_code") == 3).alias("nets"), F.max(F.col("event_code").isin(8, 9, 25)).alias("critical"),
        F.max(F.col("confidence") if "confidence" in events.columns else F.lit(0)).alias("base"), F.max(F.col("event_code") == 8).alias("injects"),
    )
    e = sums.join(comp, "node").groupBy("component").agg(*[F.sum(c).alias(c) for c in ("edges", "weight", "forward", "backward")])
    signal = F.when(F.col("base") > 0, F.col("base")).otherwise(30) + F.when(F.col("persists"), 15).otherwise(0) + F.when(F.col("injects"), 25).otherwise(0) + F.when(F.col("nets"), 10).otherwise(0) + F.when(F.col("critical"), 20).otherwise(0)
    structure = F.least(F.lit(50.0), F.least(F.lit(20.0), 5 * F.col("weight")) + F.when(F.col("backward") == 0, F.least(F.lit(15), 5 * F.col("forward"))).otherwise(0))
    factor = F.element_at(F.array(*map(F.lit, K.DEPTH_MULTIPLIER)), F.least(F.lit(len(K.DEPTH_MULTIPLIER)), F.col("stages") + 1).cast("int"))
    score = F.least(F.lit(100.0), F.greatest(F.lit(10.0), 0.5 * structure + signal) * factor)
    return n.join(e, "component").withColumn("score", F.round(score, 6)).drop("persists", "nets", "critical", "base", "injects")


def tagged(events: DataFrame, found: DataFrame, members: DataFrame) -> DataFrame:
    """Events with their campaign (``component``) and its score; null for events in none."""
    mine = members.join(found.select("component", "score"), "component").select(F.col("node").alias("event_id"), F.col("component").alias("campaign_id"), F.col("score").alias("campaign_score"))
    return events.join(mine, "event_id", "left")


def stale(found: DataFrame, as_of_t: int, hours: int = 24) -> DataFrame:
    """Campaigns silent for ``hours`` go dormant and lose a tenth of their score, down to 20."""
    old = F.col("last_t") < as_of_t - hours * 3600 * SECOND
    return found.withColumn("status", F.when(old, "dormant").otherwise("active")).withColumn("confidence", F.when(old, F.greatest(F.lit(20.0), F.floor(0.9 * F.col("score")))).otherwise(F.floor(F.col("score"))))


def parent_links(events: DataFrame) -> DataFrame:
    """Executions with their parent: the latest earlier execution of the user's host whose pid is the row's ppid."""
    nodes = events.filter("event_code = 1")
    key = F.when(F.col("kind") == 0, F.col("pid")).otherwise(F.col("ppid"))
    both = nodes.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("key", key)
    asks = both.withColumn("order", -F.col("kind"))  # of one time those that ask come first
    found = last_before(asks, ["computer", "key"], ["t", "order", "event_id"], F.when(F.col("kind") == 0, F.col("event_id")), "parent_id")
    return found.filter("kind = 1").select("event_id", "computer", "pid", "ppid", "t", "parent_id")


def tree_depths(links: DataFrame) -> DataFrame:
    """(event_id, root_id, depth), by pointer doubling: as many rounds as the logarithm of the depth."""
    now = stored(links.select("event_id", F.coalesce("parent_id", "event_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    while True:
        step = now.select(F.col("event_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        after = stored(now.join(step, "up").select("event_id", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth")))
        if after.agg(F.sum("depth")).first() == now.agg(F.sum("depth")).first():
            return now.select("event_id", F.col("up").alias("root_id"), "depth")
        now = after


def parent_chain(events: DataFrame) -> DataFrame:
    """Grandparent > parent > image of each event, by (computer, ppid) to (computer, pid), and its depth by ancestors that are not
    benign. Of the events of one pid the latest names the process."""
    last = F.max_by(F.struct("image", "ppid"), F.struct("t", "event_id"))
    named = events.groupBy("computer", "pid").agg(last.alias("w"))
    parent = named.select("computer", F.col("pid").alias("ppid"), F.col("w.image").alias("parent"), F.col("w.ppid").alias("above"))
    grand = named.select("computer", F.col("pid").alias("above"), F.col("w.image").alias("grandparent"))
    x = events.select("event_uid", "computer", "ppid", "image").join(parent, ["computer", "ppid"], "left").join(grand, ["computer", "above"], "left")
    odd = lambda c: F.when(S.suspicious_chain(F.col(c)), 1).otherwise(0)
    return x.select("event_uid", F.concat_ws(" > ", "grandparent", "parent", "image").alias("chain"), (1 + odd("parent") + odd("grandparent")).alias("process_depth"))


def story(events: DataFrame) -> DataFrame:
    """Steps of each computer in order of time, runs of one image and stage folded, with how each step follows the last."""
    differs = lambda before, here: ~F.coalesce((here("image") == before("image")) & (here("kill_chain_stage") == before("kill_chain_stage")), F.lit(False))
    x = numbered_runs(events, ["computer"], ["t", "event_id"], ["image", "kill_chain_stage"], differs, "step")
    g = x.groupBy("computer", "step").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("n"), F.first("image").alias("image"), F.first("kill_chain_stage").alias("stage"), F.min_by("parent_image", F.struct("t", "event_id")).alias("parent_image"))
    before = g.select(F.col("computer").alias("b_computer"), (F.col("step") + 1).alias("b_step"), F.col("image").alias("b_image"), F.col("end_t").alias("b_end_t"))
    g = g.join(before, F.col("computer").eqNullSafe(F.col("b_computer")) & (F.col("step") == F.col("b_step")), "left")  # steps have no gaps
    gap = F.col("start_t") - F.col("b_end_t")
    link = F.when(F.col("b_image").isNull(), "start").when(F.col("parent_image") == F.col("b_image"), "spawned").when(gap <= 5 * SECOND, "likely related").otherwise("related")
    return g.withColumn("link", link).drop("parent_image", "b_computer", "b_step", "b_image", "b_end_t")


def ranked_story(events: DataFrame) -> DataFrame:
    """Steps of each computer in order of the kill chain, then of time: what was done (``text``), how often in a row, and how a step follows the
    one before. Events without a text are no steps. Runs are counted within (computer, stage) by slabs; steps are numbered from
    the few totals by stage."""
    x = events.filter("text is not null and computer is not null").withColumn("rank", S.stage_rank(F.col("kill_chain_stage")))
    runs = numbered_runs(x, ["computer", "rank"], ["t", "event_id"], ["text"], lambda before, here: here("text") != before("text"), "run")
    first = F.min_by("parent_image", F.struct("t", "event_id"))
    steps = runs.groupBy("computer", "rank", "run").agg(F.first("kill_chain_stage").alias("stage"), F.first("text").alias("text"), F.count("*").alias("n"), F.min("t").alias("start_t"), F.max("t").alias("end_t"), first.alias("parent"), F.first("image").alias("image"))
    totals = steps.groupBy("computer", "rank").agg(F.count("*").alias("runs"))
    lower = totals.select("computer", "rank", (F.sum("runs").over(Window.partitionBy("computer").orderBy("rank")) - F.col("runs")).alias("lower"))
    steps = steps.join(lower, ["computer", "rank"]).withColumn("step", F.col("lower") + F.col("run"))
    before = steps.select("computer", (F.col("step") + 1).alias("step"), F.col("image").alias("b_image"), F.col("end_t").alias("b_end_t"))
    steps = steps.join(before, ["computer", "step"], "left")
    link = F.when(F.col("step") == 1, "start").when(F.col("parent") == F.col("b_image"), "spawned").when(F.abs(F.col("start_t") - F.col("b_end_t")) <= 5 * SECOND, "likely related").otherwise("related")
    text = F.concat("text", F.when(F.col("n") > 1, F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(" times, burst activity)"))).otherwise(""))
    return steps.select("computer", "step", "stage", text.alias("text"), "n", "start_t", link.alias("link"))


def story_reports(events: DataFrame, found: DataFrame) -> DataFrame:
    """What the story of each computer comes to: kind of attack by the stages seen, the last stage, what to do, and how sure that is by the number
    of events. ``found``: (computer, severe), whether a detection is severe."""
    rank = S.stage_rank(F.col("kill_chain_stage"))
    g = events.groupBy("computer").agg(F.count("*").alias("events"), F.collect_set("kill_chain_stage").alias("stages"), F.max_by("kill_chain_stage", F.when(rank > 0, rank)).alias("final_stage"))
    g = g.join(found, "computer", "left").withColumn("final_stage", F.coalesce("final_stage", F.lit("Execution")))
    kind = F.coalesce(*[F.when(F.size(F.array_intersect("stages", F.array(*map(F.lit, stages)))) == len(stages), name) if stages else F.lit(name) for stages, name in K.ATTACK_TYPES])
    action = F.coalesce(S.lookup(F.col("final_stage"), K.STAGE_ACTIONS), F.when(F.col("severe"), K.SEVERE_ACTION).otherwise(K.OTHER_ACTION))
    return g.select("computer", "events", kind.alias("attack_type"), "final_stage", action.alias("action"), F.round(F.least(F.col("events") / 10, F.lit(1.0)), 2).alias("confidence"))


def campaign_facts(events: DataFrame, comp: DataFrame, most: int = 10) -> DataFrame:
    """What a campaign is made of: its id (image and host of its first event, day of the data), numbers of users and images, the
    first ``most`` of both by name (a display list, cut before it is gathered), stages in order, and a sentence."""
    nodes = events.join(comp, events["event_id"] == comp["node"])
    first = F.min_by(F.struct("image", "computer"), F.struct("t", "event_id"))
    stages = F.array_sort(F.collect_set(F.struct(S.stage_rank(F.col("kill_chain_stage")).alias("r"), F.col("kill_chain_stage").alias("s"))))
    g = nodes.groupBy("component").agg(F.count("*").alias("events"), first.alias("f"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.transform(stages, lambda x: x["s"]).alias("st"))
    each = nodes.select("component", F.inline(F.array(F.struct(F.lit("users").alias("kind"), F.col("user").alias("value")), F.struct(F.lit("images").alias("kind"), F.col("image").alias("value"))))).filter("value is not null").distinct()
    place = each.withColumn("o", F.row_number().over(Window.partitionBy("component", "kind").orderBy("value")))
    lists = [f for k in ("users", "images") for f in (F.count_if(F.col("kind") == k).alias(f"n_{k}"), F.array_join(F.array_sort(F.collect_list(F.when((F.col("kind") == k) & (F.col("o") <= most), F.col("value")))), ",").alias(k))]
    safe = lambda c, n: F.regexp_replace(F.lower(F.substring(c, 1, n)), "[^a-z0-9]", "_")
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("first_t") / 86_400_000_000).cast("int")), "yyyyMMdd")
    text = F.concat(F.col("f.image"), F.lit(" on "), F.col("f.computer"), F.lit(": "), F.col("events").cast("string"), F.lit(" events over "), F.size("st").cast("string"), F.lit(" stages, up to "), F.element_at("st", -1))
    return g.join(place.groupBy("component").agg(*lists), "component").select(
        "component", F.concat_ws("-", F.lit("CAMP"), safe("f.image", 12), safe("f.computer", 8), day).alias("campaign_id"), "events", "first_t", "last_t", F.array_join("st", " > ").alias("stages"), "n_users", "users", "n_images", "images", text.alias("narrative"),
    )
