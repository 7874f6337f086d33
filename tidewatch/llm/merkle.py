"""Document fingerprints: a Merkle tree over sections, paragraphs and short runs of words. DataFrame functions only.

Sections are parted by blank lines, paragraphs by line breaks; a paragraph's leaves are runs of ``RUN`` words. A node is
the 64-bit xxhash64 of its children in order; nothing below the root is shortened. Equal texts have equal roots, and texts
with equal roots are the same but for a collision of 64 bits. The printed fingerprint writes the tree level by level: root,
sections, paragraphs with half their digits, and one digest of all leaves.

Two trees are compared from the root down. Equal roots end the comparison. Else the sections that agree from the start and
from the end are left out, then the paragraphs of the rest that do, then the leaves: what remains is where the edit is, and
only there are leaves compared as multisets. The likeness is the Dice share of common nodes, counting the root and the
leaves with their repeats: 1 for equal roots, and below 1 for any other pair.

"The next document" needs an order over the whole table without a single task: ids are cut into ranges at approximate
quantiles, null ids into ranges of the text's digest; each range is one window partition, and the first document of each range is
handed to the range before it.

Defined results: a null text is the empty text; equal texts have equal fingerprints; of equal ids the text with the greater
digest (xxhash64) comes first; null ids come last; a single document is its own next one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import plain

#: Words of a leaf.
RUN = 4
#: Documents of a range, and parts of each coarse range at most: with more documents than both allow, ranges are larger.
ROWS_A_RANGE, FINE = 2_000, 256
#: Ranges of which a table (40 bytes each) is broadcast.
FEW = 100_000


def with_tree(df: DataFrame, text: str, to: str) -> DataFrame:
    """Add the tree of a non-null text column: root, and the nodes of each level in order with their numbers of children."""
    deep, pars, secs = f"{to}_deep", f"{to}_pars", f"{to}_secs"

    def leaves(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(words), F.lit(RUN)), lambda i: F.xxhash64(F.slice(words, i, RUN)))

    split = F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.transform(F.split(s, "\n"), lambda p: F.split(p, " ")), leaves))
    return (
        df.withColumn(deep, split)
        .withColumn(pars, F.transform(deep, lambda s: F.transform(s, lambda p: F.xxhash64(p))))
        .withColumn(secs, F.transform(pars, lambda s: F.xxhash64(s)))
        .withColumn(to, F.struct(
            F.xxhash64(secs).alias("root"), F.col(secs).alias("sections"), F.transform(pars, lambda s: F.size(s)).alias("section_sizes"),
            F.flatten(pars).alias("paragraphs"), F.flatten(F.transform(deep, lambda s: F.transform(s, lambda p: F.size(p)))).alias("paragraph_sizes"),
            F.flatten(F.flatten(deep)).alias("leaves"),
        ))
        .drop(deep, pars, secs)
    )


def printed(tree: str) -> Column:
    """Root and sections with 16 hexadecimal digits, paragraphs with 8, and 16 for the leaves."""
    digits = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    t = F.col(tree)
    return F.concat_ws(
        ":", digits(t["root"]), F.array_join(F.transform(t["sections"], digits), ""), F.array_join(F.transform(t["paragraphs"], lambda x: F.right(digits(x), F.lit(8))), ""), digits(F.xxhash64(t["leaves"])),
    )


def _common_start(x: Column, y: Column) -> Column:
    """How many elements agree from the start; arrays of no nulls."""
    differs = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p != q, F.lit(True))), True)
    return F.when(differs == 0, F.size(x)).otherwise(differs - 1).cast("int")


def _middle(df: DataFrame, x: str, y: str, to: str) -> DataFrame:
    """Add ``<to>_start`` and ``<to>_end``, how many elements of two array columns agree at either end, without overlap."""
    rest = lambda c: F.reverse(F.slice(c, F.col(f"{to}_start") + 1, F.size(c)))
    return df.withColumn(f"{to}_start", _common_start(F.col(x), F.col(y))).withColumn(f"{to}_end", _common_start(rest(x), rest(y)))


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda a, b: a + b)


def _numbered(df: DataFrame, values: str, to: str) -> DataFrame:
    """Add an array of distinct numbers, one for each value and each of its repeats, so sets of them act as multisets."""
    line, begins = f"{to}_line", f"{to}_begins"
    n = F.size(line)
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(line, i) != F.get(line, i - 1)))
    ends = F.concat(F.slice(begins, F.lit(2), F.size(begins)), F.array(n))
    each = F.zip_with(begins, ends, lambda a, b: F.transform(F.sequence(F.lit(1), b - a), lambda k: F.xxhash64(F.get(line, a), k)))
    return (
        df.withColumn(line, F.array_sort(values))
        .withColumn(begins, F.when(n > 0, at).otherwise(F.array().cast("array<int>")))
        .withColumn(to, F.when(n > 0, F.flatten(each)).otherwise(F.array().cast("array<bigint>")))
        .drop(line, begins)
    )


def with_difference(df: DataFrame, a: str, b: str, to: str) -> DataFrame:
    """Compare two trees: adds ``<to>`` (likeness) and ``<to>_edit``, where the first tree differs from the second.

    The edit: first differing section, paragraph and leaf, numbered through the document from 0, and how many of each of the
    first tree differ; null where the roots are equal. Nothing but the trees is read.
    """
    level, k = {"sections": ("section_sizes", f"{to}_s"), "paragraphs": ("paragraph_sizes", f"{to}_p"), "leaves": (None, f"{to}_l")}, {}
    df = df.withColumn(f"{to}_a_sections", F.col(a)["sections"]).withColumn(f"{to}_b_sections", F.col(b)["sections"])
    offset = F.lit(0)
    for name, (sizes, short) in level.items():
        x, y = f"{to}_a_{name}", f"{to}_b_{name}"
        df = _middle(df, x, y, short)
        start, end = F.col(f"{short}_start"), F.col(f"{short}_end")
        df = df.withColumn(f"{short}_from", offset + start).withColumn(f"{short}_a", F.size(x) - start - end).withColumn(f"{short}_b", F.size(y) - start - end)
        k[name] = short
        if sizes:  # all that comes before is equal in both trees, so the children start at one place
            below, first = ("paragraphs" if name == "sections" else "leaves"), F.col(f"{short}_from")
            df = df.withColumn(f"{short}_off", _total(F.slice(F.col(a)[sizes], F.lit(1), first)))
            for tree, side in ((a, "a"), (b, "b")):
                n = _total(F.slice(F.col(tree)[sizes], first + 1, F.col(f"{short}_{side}")))
                df = df.withColumn(f"{to}_{side}_{below}", F.slice(F.col(tree)[below], F.col(f"{short}_off") + 1, n))
            offset = F.col(f"{short}_off")
    short = k["leaves"]
    for side in "ab":
        inner = F.slice(f"{to}_{side}_leaves", F.col(f"{short}_start") + 1, F.col(f"{short}_{side}"))
        df = _numbered(df.withColumn(f"{to}_{side}_inner", inner), f"{to}_{side}_inner", f"{to}_{side}_numbers")
    n_a, n_b = F.size(F.col(a)["leaves"]), F.size(F.col(b)["leaves"])
    common = n_a - F.col(f"{short}_a") + F.size(F.array_intersect(f"{to}_a_numbers", f"{to}_b_numbers"))
    same = F.col(a)["root"] == F.col(b)["root"]
    names = ("section", "paragraph", "leaf")
    edit = F.struct(*[F.col(f"{s}_from").alias(n) for s, n in zip(k.values(), names, strict=True)], *[F.col(f"{s}_a").alias(f"{n}_count") for s, n in zip(k.values(), names, strict=True)])
    kept = [c for c in df.columns if not c.startswith(f"{to}_")]
    return df.select(*kept, F.when(same, 1.0).otherwise(2.0 * common / (n_a + n_b + 2)).alias(to), F.when(~same, edit).alias(f"{to}_edit"))


def _quantiles(df: DataFrame, key: str, parts: int) -> Column:
    return F.percentile_approx(key, [k / parts for k in range(1, parts)], max(1000, 20 * parts))


def with_range(docs: DataFrame, rows: int = ROWS_A_RANGE, width: int = 256) -> DataFrame:
    """Add ``range``, the number of the row's range in descending order of ids, and ``coarse``, that of some ranges that follow each other.

    Ids are cut into ``width`` parts at most by literals, and those, where they hold more than ``rows`` documents, further by
    a broadcast table of ``width`` rows with ``FINE`` bounds (8 bytes) at most. Null ids come last, parted by ``digest`` where there is one.
    """
    n, named = docs.agg(F.count("*"), F.count("doc_id")).first()
    rows = max(rows, -(-n // (width * FINE)))
    coarse = max(1, min(width, -(-named // rows)))
    fine = max(1, -(-named // (rows * coarse)))
    ids, kind = docs.select("doc_id").dropna(), dict(docs.dtypes)["doc_id"]
    first = sorted(set(ids.agg(_quantiles(ids, "doc_id", coarse).alias("q")).first()["q"] or []), reverse=True) if coarse > 1 else []
    above = lambda bounds: F.size(F.filter(bounds, lambda b: b >= F.col("doc_id")))
    out = docs.withColumn("coarse", above(F.array(*[F.lit(b).cast(kind) for b in first])) if first else F.lit(0)).withColumn("range", F.col("coarse"))
    if fine > 1:
        bounds = out.dropna(subset=["doc_id"]).groupBy("coarse").agg(F.sort_array(F.array_distinct(_quantiles(ids, "doc_id", fine)), False).alias("inner"))
        out = out.join(F.broadcast(bounds), "coarse", "left").withColumn("range", F.col("coarse") * (fine + 1) + F.coalesce(above(F.col("inner")), F.lit(0))).drop("inner")
    parts = -(-(n - named) // rows) or 1
    place = F.least(F.lit(parts - 1), F.floor((0.5 - F.col("digest") / 2.0**64) * parts)) if "digest" in docs.columns else F.lit(0)
    none, last, blocks = F.col("doc_id").isNull(), len(first) + 1, -(-parts // width)
    out = out.withColumn("range", F.when(none, last * (fine + 1) + place).otherwise(F.col("range")).cast("long"))
    return out.withColumn("coarse", F.when(none, last + F.floor(place / blocks)).otherwise(F.col("coarse")).cast("long"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS_A_RANGE, width: int = 256) -> tuple[DataFrame, Window]:
    """(doc_id, text, range, last) with one extra row (last = 1) at each range's end: the next range's first document.

    Ranges are put in order within their ``coarse`` ones, of which there are ``2 width + 1`` at most; these the driver puts in order.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), plain(text_col).alias("text")).withColumn("digest", F.xxhash64("text"))
    ranged = with_range(base, rows, width)
    order = Window.partitionBy("range").orderBy("last", F.desc_nulls_last("doc_id"), F.desc("digest"), F.desc("text"))
    tops = ranged.groupBy("coarse", "range").agg(F.max(F.struct("doc_id", "digest")).alias("top"))  # a row for each range
    ends = sorted(map(tuple, tops.groupBy("coarse").agg(F.max("range"), F.count("*")).collect()))
    above = {c: ends[k - 1][1] for k, (c, _, _) in enumerate(ends)}  # the first one's is the last range of all
    before = F.create_map(*[F.lit(x).cast("long") for pair in above.items() for x in pair]) if above else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    receiver = F.coalesce(F.lag("range").over(Window.partitionBy("coarse").orderBy("range")), before[F.col("coarse")])
    givers = tops.select(F.col("range").alias("giver"), F.col("top.doc_id").alias("top"), F.col("top.digest").alias("top_digest"), receiver.alias("receiver"))
    if sum(e[2] for e in ends) <= FEW:  # else a join that shuffles the documents once more
        givers = F.broadcast(givers)
    heads = (
        ranged.join(givers, (ranged["range"] == givers["giver"]) & ranged["doc_id"].eqNullSafe(givers["top"]) & (ranged["digest"] == givers["top_digest"]))
        .groupBy("doc_id", "digest", "receiver").agg(F.max("text").alias("text"))
        .select("doc_id", "text", "digest", F.col("receiver").alias("range"), F.lit(1).alias("last"))
    )
    return ranged.drop("coarse").withColumn("last", F.lit(0)).unionByName(heads), order


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint and that of its edited text: the second half replaced by the next document's start."""
    rows, order = with_next(docs)
    near = rows.withColumn("next_text", F.lead("text").over(order)).filter("last = 0").select("doc_id", "text", "next_text")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    out = near.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    for text, tree in (("text", "tree"), ("edited", "other"), ("next_text", "next")):
        out = with_tree(out, text, tree)
    out = with_difference(with_difference(out, "tree", "other", "near_edited"), "tree", "next", "near_next")
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed("tree").alias("fingerprint"), printed("other").alias("edited_fingerprint"), "near_edited", "near_next",
        F.col("near_edited_edit.leaf").alias("edited_from_leaf"), F.col("near_edited_edit.leaf_count").alias("edited_leaves"),
    )
