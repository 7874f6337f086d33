"""The corpus pipeline: language ID, SimHash near-dedup, suffix-array dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on whatever its predecessor kept; all but the last return the columns
of ``documents``. ``run`` applies them in order, each one's result written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import language, packing, simhash, suffix
from tidewatch.llm.common import documents, drop_stored, plain, stored, stored_tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least probability of the best language.
LEAST_SCORE = 0.3
#: Words of a shingle, and differing bits up to which all links of 64-bit fingerprints are found.
SHINGLE, BITS = 5, 4
#: A passage that repeats is cut if it has more words than this.
WORDS = 50


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a recognised language: those without letters and those that no language explains go."""
    found = language.identify(docs.select(*COLUMNS), keep=COLUMNS)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates: the least doc_id and, among rows that share it, the least text digest.

    Rows without an id stay. Of rows with equal id and text, the least (lang, source, n_chars) stays.
    """
    groups = stored(simhash.similar_documents(docs.select("doc_id", "text"), SHINGLE, BITS), "similar")
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("first_digest"))
    gone = groups.filter(F.col("doc_id").isNotNull() & ~first).select("doc_id", "digest").distinct()
    digest = F.substring(F.unhex(F.sha2(plain("text"), 256)), 1, 16)
    kept = docs.select(*COLUMNS, digest.alias("digest")).join(gone, ["doc_id", "digest"], "left_anti")
    again = stored(groups.filter(first).groupBy("doc_id", "digest").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "again")
    if not again.take(1):
        return kept.select(*COLUMNS)
    once = kept.join(again, ["doc_id", "digest"], "left_semi").groupBy("doc_id", "digest").agg(F.min("text").alias("text"), F.min(F.struct("lang", "source", "n_chars")).alias("least"))
    return kept.join(again, ["doc_id", "digest"], "left_anti").select(*COLUMNS).unionByName(once.select("doc_id", "text", "least.*").select(*COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every passage of over WORDS words that repeats; documents of which nothing is left go."""
    cut = suffix.remove_repeats(docs, WORDS + 1, suffix.GRAM_WORDS, keep=["doc_id", "lang", "source"], with_text=True, words=True)
    left = cut.filter((F.size("spans") == 0) | (F.length("kept_text") > 0))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row for each piece of a document, with its place."""
    return packing.packed_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", pack)]
#: SQL can express none of the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages; what a stage stores for itself is dropped when its result is written, and after a failure."""
    docs, before = documents(spark, sf_dir), stored_tables()
    try:
        for name, stage in STAGES[:-1]:
            last = stored_tables()
            docs = stored(stage(spark, docs, sf_dir), name)
            drop_stored(keep=before | {max(stored_tables() - last, key=lambda n: f"/{name}-" in n)})
        return STAGES[-1][1](spark, docs, sf_dir)
    except Exception:
        drop_stored(keep=before)
        raise
