"""How much the sources of a language differ in their words: exact count vectors, group sums, and sparse pair evaluation.

Each language gets a CountVectorizer of its own, with ``minDF`` documents and the largest ``vocabSize``, so nothing is cut. It is
fitted to the different words of each document, which is all that ``minDF`` asks for, and its vocabulary turns every document into an exact
sparse vector: 1 for each different word, and the rest of each word's count in binary digits, a row of words for each digit,
so that a frequent word is handed over a few times and not as often as it occurs. The vectors are made in Arrow batches, and added up by source as
a Summarizer does it, but sparsely and in whole numbers: (source, index, count) triples, combined before the shuffle, so a
source that holds most documents is no hot key. Documents are read and split once; their words are stored by language.

A group gives every kept term t the share p = 1 + floor(10^9 (count + 2) / (N + 2 V)). Two groups differ by the sum over all V terms
of floor((p - q)^2 / (p + q)). Terms of one language are dealt into blocks, and a block's counts meet the shares that each source
gives to absent terms in one task: per source one sweep over the block's counts, so the work is sources x counts that are
not zero, and terms that both lack are counted, not visited. A block holds at most ``TERMS`` terms of two sets of ``SOURCES``
sources. No list of pairs by term is made; what leaves a block is one sum for each pair of sources.

A CountVectorizer keeps its vocabulary on the driver and sends it to the executors. So that it is bounded, words are dealt by their hash
into parts of about ``WORDS`` different words (estimated from a sample), each part gets a CountVectorizer of its own, one after the
other, and the vectors of the parts stand side by side. The driver goes over the languages that have ``min_docs``
documents; all others, however many, keep no term and are settled together.

Defined results: null text, lang and source are the empty string, which are values like others; a group without terms has all
its shares at the default; a language without kept terms has values of 0; repeated rows count each; an empty table gives
no rows; a language with one source has no pairs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import map_batches, plain, stored

MIN_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
#: Terms of a block, and sources of each of the two sets that meet in a task.
TERMS, SOURCES = 4096, 1000
#: Folders that languages are dealt into.
FOLDERS = 64
LARGEST = 2**31 - 1
#: Different words of a part of the vocabulary.
WORDS = 2_000_000
#: Words of vectors that a task adds up at once: some 100 MB while they are sorted.
TOGETHER = 2_000_000
#: What each byte of a text becomes: A-Z lower case, other letters and bytes of non-ASCII characters themselves, all else a blank.
LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters; only A-Z are lower-cased."""
    return text.encode().translate(LETTERS).split(b" ")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), in decimals that hold it for any corpus."""
    whole = lambda c: c.cast("decimal(19,0)")
    return 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (whole(count) + 2).cast("decimal(20,0)"), (whole(total) + whole(kept) * 2).cast("decimal(20,0)"))


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares, which are at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def word_rows(counts: Counter) -> Iterator[tuple[int, list[bytes]]]:
    """(times, words) that add up to the counts: all words once, then what is left of them by binary digits."""
    yield 1, list(counts)
    left, times = [(w, n - 1) for w, n in counts.items() if n > 1], 1
    while left:
        yield times, [w for w, n in left if n & 1]
        left, times = [(w, n >> 1) for w, n in left if n > 1], 2 * times


def words_by_language(docs: DataFrame) -> DataFrame:
    """(lang, source, whole, times, terms, folder), stored in a folder for each hash of the language. Rows with ``whole`` hold the different
    words of a document, the others say how often more some of them occur. No term is the empty string: each document gets one, so that
    a vocabulary is never empty, which CountVectorizer refuses."""

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("lang", "source", "whole", "times", "terms")}
            held = 0
            for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"].to_pylist(), strict=True):
                counts = Counter(terms(text))
                counts[b""] = 1
                for k, (times, words) in enumerate(word_rows(counts)):
                    for name, value in zip(out, (lang, source, k == 0, times, words), strict=True):
                        out[name].append(value)
                    held += len(words)
                if held > 200_000:
                    yield out | {"terms": pa.array(out["terms"], pa.list_(pa.binary())).cast(pa.list_(pa.string()))}
                    out, held = {k: [] for k in out}, 0
            yield out | {"terms": pa.array(out["terms"], pa.list_(pa.binary())).cast(pa.list_(pa.string()))}

    rows = docs.select(plain("lang").alias("lang"), plain("source").alias("source"), plain("text").alias("text"))
    split = map_batches(rows, "lang string, source string, whole boolean, times long, terms array<string>", work)
    return stored(split.withColumn("folder", F.pmod(F.xxhash64("lang"), F.lit(FOLDERS)).cast("int")), "words", by=["folder"])


def vocabulary_parts(whole: DataFrame, langs: list[str], words_in_part: int) -> dict[str, int]:
    """How many parts each language's words are dealt into. The number of different words is carried on from a 64th and a 16th of the
    documents by the power at which it grows between them; growth slows down, so that is too many rather than too few. It
    sizes the parts and changes no result."""
    sample = whole.sample(1 / 16, seed=1).select("lang", (F.rand(2) < 0.25).alias("few"), F.explode("terms").alias("term"))
    found = sample.groupBy("lang").agg(F.approx_count_distinct(F.when(F.col("few"), F.col("term"))).alias("few"), F.approx_count_distinct("term").alias("more"))
    sizes = {r["lang"]: r["more"] * 16 ** min(1.0, max(0.0, math.log(r["more"] / r["few"], 4))) for r in found.collect() if r["few"]}
    return {lang: max(1, math.ceil(sizes.get(lang, 0) / words_in_part)) for lang in langs}


def cell_sums(cells: list[np.ndarray], counts: list[np.ndarray], codes: dict[str, int], width: int) -> dict:
    """(source, idx, count) of cells, numbered code * width + idx, with their counts added up."""
    cell, count = np.concatenate(cells), np.concatenate(counts)
    order = np.argsort(cell)
    cell = cell[order]
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    found = cell[first]
    return {"source": pa.array(list(codes), pa.string()).take(pa.array(found // width)), "idx": found % width, "count": np.add.reduceat(count[order], first)}


def count_sums(words: DataFrame, lang: str, min_docs: int, part: int = 0, parts: int = 1, together: int = TOGETHER) -> DataFrame:
    """Of one part of a language's words: (lang, source, idx, term, count) of the kept terms that a source has."""
    own = words.filter((F.col("folder") == F.pmod(F.xxhash64(F.lit(lang)), F.lit(FOLDERS)).cast("int")) & (F.col("lang") == lang))
    if parts > 1:
        own = own.withColumn("terms", F.filter("terms", lambda w: (w == "") | (F.pmod(F.xxhash64(w), F.lit(parts)) == part)))
    model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=LARGEST).fit(own.filter("whole"))
    names = words.sparkSession.sparkContext.broadcast(model.vocabulary)  # bounded by the size of a part

    def vectors(batches: Iterator[dict]) -> Iterator[dict]:
        """Each row's words as indices of the vocabulary (unknown ones none), added up by source over ``together`` words at a time."""
        vocabulary, codes, cells, counts, held = pa.array(names.value, pa.string()), {}, [], [], 0
        for b in batches:
            lists = b["terms"]
            row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            idx = pc.index_in(lists.flatten(), value_set=vocabulary)
            known = np.asarray(idx.is_valid())
            idx, row = np.asarray(idx.fill_null(0))[known].astype(np.int64), row[known]
            source = b["source"].dictionary_encode()
            number = np.array([codes.setdefault(x, len(codes)) for x in source.dictionary.to_pylist()], np.int64)
            cells.append(number[np.asarray(source.indices)][row] * len(vocabulary) + idx)
            counts.append(np.asarray(b["times"])[row])
            held += len(idx)
            if held >= together:
                yield cell_sums(cells, counts, codes, len(vocabulary))
                codes, cells, counts, held = {}, [], [], 0
        if held:
            yield cell_sums(cells, counts, codes, len(vocabulary))

    sums = map_batches(own.select("source", "times", "terms"), "source string, idx long, count long", vectors).groupBy("source", "idx").agg(F.sum("count").alias("count"))
    kept = words.sparkSession.createDataFrame(pa.table({"idx": pa.array(range(len(names.value)), pa.int64()), "term": pa.array(names.value, pa.string())}))
    sums = sums.join(kept.filter("term <> ''"), "idx")
    return sums.select(F.lit(lang).alias("lang"), "source", (F.col("idx") * parts + part).alias("idx"), "term", "count")


def _block_sums(block: pa.Table, in_set: int) -> pa.Table:
    """Of one block and two sets of sources: the sum of differences for each pair, one source of the first set and a later one of
    the second. Rows of idx -1 give the share of absent terms, of every source and with the number of terms in the block."""
    number, idx, p = (block[c].to_numpy() for c in ("number", "idx", "p"))
    default = idx < 0
    lang, n_terms, low, high = block["lang"][0], int(block["terms"][0].as_py()), int(block["low"][0].as_py()), int(block["high"][0].as_py())
    numbers = np.sort(number[default])
    zero = p[default][np.argsort(number[default])]
    s = np.searchsorted(numbers, number[~default])
    _, t = np.unique(idx[~default], return_inverse=True)
    p, width, k = p[~default], int(t.max(initial=-1)) + 1, len(numbers)
    order = np.argsort(s, kind="stable")
    s, t, p = s[order], t[order], p[order]
    ends = np.searchsorted(s, np.arange(k + 1))
    f = lambda a, b: (a - b) * (a - b) // (a + b)
    add = lambda at, w: np.bincount(at, w, k).astype(np.int64)  # noqa: E731  sums below 2^53
    one, two, out = [], [], []
    later = numbers // in_set == high
    for g in np.flatnonzero(numbers // in_set == low):
        mine = slice(ends[g], ends[g + 1])
        row, has = np.full(width, zero[g]), np.zeros(width, bool)
        row[t[mine]], has[t[mine]] = p[mine], True
        shared = has[t]
        both = np.bincount(s[shared], minlength=k)
        theirs = np.diff(ends)
        total = add(s, f(row[t], p))  # over the other's terms
        counts, often = np.unique(p[mine], return_counts=True)
        for value, times in zip(counts, often, strict=True):  # over mine, as if the other had none of them
            total = total + times * f(value, zero)
        total = total - add(s[shared], f(row[t[shared]], zero[s[shared]]))
        total = total + (n_terms - len(row[has]) - theirs + both) * f(zero[g], zero)
        pick = np.flatnonzero(later & (numbers > numbers[g]))
        one += [int(numbers[g])] * len(pick)
        two += numbers[pick].tolist()
        out += total[pick].tolist()
    return pa.table({"lang": pa.array([lang.as_py()] * len(out), pa.string()), "one": pa.array(one, pa.int64()), "two": pa.array(two, pa.int64()), "sum": pa.array(out, pa.int64())})


def pair_sums(sums: DataFrame, groups: DataFrame, kept: DataFrame, terms_in_block: int = TERMS, in_set: int = SOURCES) -> DataFrame:
    """(lang, one, two, sum) of every pair of sources, by number, one < two.

    ``sums``: (lang, number, idx, p) of counts that are not zero; ``groups``: (lang, number, zero) of all sources; ``kept``: (lang,
    terms), how many terms a language keeps.
    """
    kept = kept.filter("terms > 0").withColumn("blocks", F.ceil(F.col("terms") / terms_in_block))
    block = F.pmod("idx", F.col("blocks"))
    size = F.floor((F.col("terms") - 1 - F.col("block")) / F.col("blocks")) + 1  # how many of 0 .. terms - 1 have this remainder
    counts = sums.join(kept, "lang").select("lang", "number", "idx", "p", block.alias("block"), "terms", "blocks")
    absent = groups.join(kept, "lang").select("lang", "number", F.lit(-1).alias("idx"), F.col("zero").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "terms", "blocks")
    sets = groups.groupBy("lang").agg(F.floor(F.max("number") / in_set).alias("last"))
    own = F.floor(F.col("number") / in_set)
    rows = counts.unionByName(absent).withColumn("terms", size).join(sets, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    rows = rows.select("lang", "block", F.least(own, "other").alias("low"), F.greatest(own, "other").alias("high"), "number", "idx", "p", "terms")
    found = rows.groupBy("lang", "block", "low", "high").applyInArrow(lambda block: _block_sums(block, in_set), "lang string, one long, two long, sum long")
    return found.groupBy("lang", "one", "two").agg(F.sum("sum").alias("sum"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, terms_in_block: int = TERMS, in_set: int = SOURCES, words_in_part: int = WORDS) -> DataFrame:
    """(lang, source, part, item, value, rank), as the contract of the query says."""
    words = words_by_language(docs)
    first = words.filter("whole")
    sizes = first.groupBy("lang", "source").agg(F.count("*").alias("docs"))
    numbered = stored(sizes.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1), "groups")
    large = [r["lang"] for r in numbered.groupBy("lang").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang").collect()]
    plan = vocabulary_parts(first, large, words_in_part)
    kept_counts = [stored(count_sums(words, lang, min_docs, k, parts), "counts") for lang, parts in sorted(plan.items()) for k in range(parts)]
    counts = reduce(DataFrame.unionByName, kept_counts, docs.sparkSession.createDataFrame([], "lang string, source string, idx long, term string, count long"))
    kept = counts.groupBy("lang").agg(F.count_distinct("idx").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = numbered.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["total", "kept"])
    groups = stored(groups.withColumn("zero", F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept")))), "shares")
    shared = stored(counts.join(groups.drop("docs", "zero"), ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("total"), F.col("kept"))), "terms")

    per_lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    whole = shared.groupBy("lang", "idx").agg(F.sum("count").alias("lang_count"), F.first("kept").alias("kept")).join(per_lang, "lang")
    whole = whole.select("lang", "idx", share(F.col("lang_count"), F.col("lang_total"), F.col("kept")).alias("q"))
    over = shared.join(whole, ["lang", "idx"]).filter(F.col("p") > F.col("q"))
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))

    sums = pair_sums(shared.select("lang", "number", "idx", "p"), groups.select("lang", "number", "zero"), groups.groupBy("lang").agg(F.max("kept").alias("terms")), terms_in_block, in_set)
    mine = groups.select("lang", "source", F.col("number").alias("a"))
    both = mine.join(groups.select("lang", F.col("source").alias("item"), F.col("number").alias("b")), "lang").filter(F.col("a") != F.col("b"))
    both = both.withColumns({"one": F.least("a", "b"), "two": F.greatest("a", "b")}).join(sums, ["lang", "one", "two"], "left")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("sum", F.lit(0)).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    return pairs.withColumn("rank", rank).unionByName(over.withColumn("rank", rank).filter(F.col("rank") <= top))


#: DuckDB, for the query; every (group, kept term) is written out.
SQL = """
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
words AS (SELECT id, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_count FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
sizes AS (SELECT lang, count(*) AS v, sum(lang_count) AS lang_total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * s.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.lang_count + 2)) // (s.lang_total + 2 * s.v)::HUGEINT AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes s ON g.lang = s.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
pair_values AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(v.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair_values v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
