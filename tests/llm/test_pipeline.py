"""The corpus pipeline's stages on a small table with planted cases."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import random  # noqa: E402

WORDS = {"en": "the and with there would shall thing river stone over", "de": "der und nicht schön über zwischen ein haus strom", "fr": "le et être où garçon très leur rivière pierre"}


def prose(seed, n, lang="en"):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang].split()) + str(rng.randint(0, 99)) for _ in range(n))


def test_stages(spark, tmp_path):
    passage = prose(777, 90)
    rows = [(i, prose(i, 60 + i % 5, list(WORDS)[i % 3]), list(WORDS)[i % 3], "s", None) for i in range(90)]
    rows += [(100, rows[3][1], "en", "s", 1), (101, "12345 !!", "en", "s", 1), (102, None, None, None, None), (104, prose(50, 40) + " " + passage, "en", "s", 1), (105, passage + " " + prose(51, 40), "en", "s", 1)]
    rows.append(rows[5])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    ids = lambda name: sorted(r["doc_id"] for r in seen[name])
    clean = {*range(90), 104, 105}
    assert set(ids("language_id")) == clean | {100}
    assert ids("near_dedup") == sorted(clean)
    cut = {r["doc_id"]: r for r in seen["suffix_dedup"]}
    assert set(cut) == clean and passage not in cut[104]["text"] and len(cut[104]["text"]) < 500 and cut[7]["text"] == rows[7][1]
    assert all(r["n_chars"] == len(r["text"]) for r in cut.values())
    assert set(ids("packing")) == clean
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_passages_of_short_words(spark):
    rng = random.Random(3)
    passage, short = " ".join(rng.choice("abcdefghij") for _ in range(51)), prose(8, 30)
    rows = [(k, f"{prose(60 + k, 40)} {p} {prose(80 + k, 40)}", "en", "s", None) for k, p in enumerate([passage, passage, short, short])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}
    assert len(passage) == 101 and len(short) > 101
    assert all(passage not in got[k] and len(got[k]) <= len(rows[k][1]) - 101 for k in (0, 1))
    assert all(got[k] == rows[k][1] for k in (2, 3))


KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_that_share_an_id(spark):
    """Equal ids with different texts are two documents; equal rows are one; rows without an id stay."""
    a, b = prose(1, 60), prose(2, 60)
    near = a.replace(a.split()[30], "changed")
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, b, "de", "s", 1), (2, a, "en", "s", 1), (1, near, "en", "s", 1), (None, a, "en", "s", 1), (7, None, "en", "s", 1), (7, None, None, None, None)]
    got = sorted(map(tuple, corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, KIND), "").collect()), key=str)
    assert len(got) == 4 and (None, a, "en", "s", 1) in got and (1, b, "de", "s", 1) in got and sum(r[0] == 1 and r[1] in (a, near) for r in got) == 1
    assert sum(r[0] == 7 for r in got) == 1


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], KIND)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_run_leaves_no_tables_but_those_of_its_result(spark, tmp_path):
    from tidewatch.llm import common

    rows = [(i, prose(i, 60), "en", "s", 1) for i in range(20)]
    spark.createDataFrame(rows, KIND).write.parquet(str(tmp_path / "documents.parquet"))
    before = common.stored_tables()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 20
    left = {n.rsplit("/", 1)[-1].split("-")[0] for n in common.stored_tables() - before}
    assert left == {"suffix_dedup", "pieces"}
    common.drop_stored(keep=before)
