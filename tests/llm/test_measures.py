"""Whitening, source divergence and token files against brute force, and odd tables."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import divergence, token_files, whitening
from tidewatch.llm.token_files import EliasFano, TokenFile

# --- op11

VECTORS = "vec_id long, embedding array<float>, component int, n long, whitened double, __row int"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, 2, 0.5, 3) for i, v in rows], VECTORS).repartition(parts)


def whitened_brute(rows, k=8):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(0)
    y = np.array((n * x - s) / n, float)
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [int(d) for d in ((n * x - s) ** 2).sum(1)], y @ u / np.sqrt(e), e / np.trace(y.T @ y / n)


def test_counts_of_eigenvalues_and_pairs():
    rng = np.random.default_rng(3)
    for d in (1, 2, 3, 9, 40):
        a = rng.standard_normal((d, d))
        a = a + a.T  # indefinite: needs pivots of two
        e = np.linalg.eigvalsh(a)
        for shift in [*rng.uniform(e[0] - 1, e[-1] + 1, 20), 0.0]:
            assert whitening.eigenvalues_above(a, shift) == (e > shift).sum()
        c = a @ a
        values, x = whitening.leading_eigenpairs(c, 8)
        assert np.allclose(values, np.linalg.eigvalsh(c)[::-1][:8], rtol=1e-12, atol=1e-12) or d == 1
        assert np.abs(x @ x.T - np.eye(len(x))).max() < 1e-14 and np.abs(c @ x.T - x.T * values).max() < 1e-12 * values[0]


def test_equal_and_zero_eigenvalues():
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((12, 12)))
    for given, left in (([4.0] * 3 + [1.0] * 9, 8), ([2.0, 2.0 - 1e-13, 1.0] + [0.0] * 9, 3), ([1.0] * 12, 8), ([0.0] * 12, 0)):
        c = q @ np.diag(given) @ q.T
        c = (c + c.T) / 2
        values, x = whitening.leading_eigenpairs(c, 8)
        assert len(values) == left and np.allclose(values, given[:left])
        assert np.abs(x @ x.T - np.eye(left)).max(initial=0) < 1e-13 and np.abs(c @ x.T - x.T * values).max(initial=0) < 1e-12


@pytest.mark.parametrize(("n", "d", "scale"), [(300, 12, 0.3), (40, 5, 3e3), (900, 3, 1.0)])
def test_whitening_equals_brute_force(spark, n, d, scale):
    rng = np.random.default_rng(n)
    base = rng.standard_normal((n, d)) @ np.diag(np.linspace(2, 0.5, d)) * scale + 5 * scale
    rows = [(i, base[i if i % 3 else 0].astype(np.float32).tolist()) for i in range(n)]  # a third of the rows are copies
    bad = [(-1, None), (-2, [None, *rows[0][1][1:]]), (-3, [float("nan"), *rows[0][1][1:]]), (-4, [*rows[0][1][1:], float("-inf")]), (-5, []), (-6, rows[0][1][1:]), (-7, [1e30, *rows[0][1][1:]])]
    got = whitening.whitened_rows(vectors(spark, rows + bad)).toPandas().sort_values(["vec_id", "component"])
    k = min(d, 8)
    deviation, white, share = whitened_brute(rows)
    assert len(got) == n * k and got.n.unique().tolist() == [n] and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    assert got.deviation.tolist() == [v for v in deviation for _ in range(k)] and got.deviation_digits.tolist() == [str(v) for v in deviation for _ in range(k)]
    assert np.allclose(np.abs(got.whitened.to_numpy().reshape(n, k)), np.abs(white), atol=1e-8) and np.allclose(got.explained[:k], share, rtol=1e-9)


def test_whitening_does_not_depend_on_partitions(spark):
    rows = [(i, np.random.default_rng(i).standard_normal(6).astype(np.float32).tolist()) for i in range(200)]
    one, many = (whitening.fit(vectors(spark, rows, p)) for p in (1, 7))
    assert one.sums == many.sums and (one.vectors == many.vectors).all() and (one.values == many.values).all()


def test_whitening_of_large_entries_and_odd_tables(spark):
    big = [(i, [float(2**40 + 2**32 * (i % 5)), float(i), 2.0**49 * (i % 3)]) for i in range(30)]
    got = whitening.whitened_rows(vectors(spark, big)).toPandas().sort_values(["vec_id", "component"])
    assert len(got) and got.deviation_digits.tolist() == [str(v) for v in whitened_brute(big)[0] for _ in range(len(got) // 30)] and got.deviation.isna().any()
    assert whitening.whitened_rows(vectors(spark, [(1, [1.0, 2.0])] * 5)).count() == 0  # no variance
    assert whitening.whitened_rows(vectors(spark, [(1, None), (None, [])])).count() == 0
    two = whitening.whitened_rows(vectors(spark, [(None, [1.0, 2.0, 0.0]), (None, [1.0, 3.0, 0.0]), (7, [1.0, 3.0, 0.0])])).collect()
    assert len(two) == 3 and {r["component"] for r in two} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in two) and sum(r["vec_id"] is None for r in two) == 2


# --- op12

DOCS = "doc_id long, text string, lang string, source string, term string, idx int, n long, number long, p long"


def documents(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, la, s, "x", 1, 2, 3, 4) for i, (t, la, s) in enumerate(rows)], DOCS).repartition(parts)


def divergence_brute(rows, min_docs, top):
    split = [(la or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, la, s in rows]
    out = []
    for lang in {x[0] for x in split}:
        mine = [x for x in split if x[0] == lang]
        df = Counter(t for x in mine for t in set(x[2]))
        kept = [t for t in df if df[t] >= min_docs]
        count = {s: Counter(t for x in mine if x[1] == s for t in x[2] if df[t] >= min_docs) for s in {x[1] for x in mine}}
        whole = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        shares, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s, p in shares.items():
            pairs = [(h, sum(f(p[t], other[t]) for t in kept)) for h, other in shares.items() if h != s]
            words = [(t, f(p[t], q[t])) for t in kept if count[s][t] and p[t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", words, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def audit_rows(seed, n, sources=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.35 else f"s{rng.randrange(sources)}"
        words = [rng.choice(["THE", "the", "a", "İx", "naïve", "中文", "x1y", "q" + chr(97 + rng.randrange(26)), f"{source}word".replace("0", "")]) for _ in range(rng.randrange(30))]
        rows.append((rng.choice([" ", "\n", "-", "9"]).join(words), rng.choice(["en", "en", "de", None, ""]), source))
    return rows + [(None, "en", None), ("", "en", "none"), (None, None, None), ("only few words", "rare", "s1"), ("few", "rare", "s2"), ("few", "lone", "s")]


@pytest.mark.parametrize(("block", "sources", "words"), [(4096, 1000, 10**6), (5, 1000, 4), (5, 2, 10**6)])
def test_divergence_equals_brute_force(spark, block, sources, words):
    rows = audit_rows(block, 160)
    got = divergence.divergence(documents(spark, rows), 6, 4, block, sources, words)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == divergence_brute(rows, 6, 4)


def test_parts_of_a_vocabulary(spark):
    rows = [(f"l{i % 2}", [f"w{(i * k) % (50 if i % 2 else 100_000)}" for k in range(1, 60)]) for i in range(4000)]
    got = divergence.vocabulary_parts(spark.createDataFrame(rows, "lang string, terms array<string>"), ["l0", "l1", "none"], 10_000)
    different = len({w for la, ws in rows if la == "l0" for w in ws})
    assert got["l1"] == got["none"] == 1 and 0.5 * different / 10_000 < got["l0"] < 4 * different / 10_000 + 1  # growth slows down, so it errs on the high side


def test_rows_of_words_add_up():
    counts = Counter({b"a": 1, b"b": 2, b"c": 37, b"d": 1024})
    total = Counter()
    for times, words in divergence.word_rows(counts):
        total.update({w: times for w in words})
    assert total == counts and divergence.terms("Zoë-X1y \x7fÀ\n") == [b"zo\xc3\xab", b"x", b"y", b"", "À".encode(), b""]


def test_vectors_are_added_up_over_batches(spark):
    """A task hands over a source's count of a word once and not once a batch, and the sums don't depend on how much it holds."""
    rows = [("en", "ab"[i % 2], True, 1, [f"w{i % 3}", "all"], 0) for i in range(5000)]
    words = spark.createDataFrame(rows, "lang string, source string, whole boolean, times long, terms array<string>, folder int").coalesce(1)
    words = words.withColumn("folder", F.pmod(F.xxhash64("lang"), F.lit(divergence.FOLDERS)).cast("int"))
    want = Counter((s, t) for _, s, _, _, ts, _ in rows for t in ts)
    for together in (1, 3000, 10**9):
        got = divergence.count_sums(words, "en", 1, together=together).collect()
        assert len(got) == len(want) and {(r["source"], r["term"]): r["count"] for r in got} == want
    one = divergence.cell_sums([np.array([5, 1]), np.array([5, 0])], [np.array([1, 2]), np.array([3, 4])], {"x": 0, "y": 1}, 4)
    assert (one["source"].to_pylist(), list(one["idx"]), list(one["count"])) == (["x", "x", "y"], [0, 1, 1], [4, 2, 4])


def test_divergence_of_odd_tables(spark):
    assert divergence.divergence(documents(spark, [("x", "en", "s")]).filter("doc_id < 0")).count() == 0
    assert divergence.divergence(documents(spark, [(None, None, None)] * 12)).count() == 0  # one source, no term
    got = divergence.divergence(documents(spark, [("word", "en", "a")] * 10 + [("", "en", "b")])).collect()
    assert sorted((r["source"], r["part"], r["item"], r["rank"]) for r in got) == [("a", "pair", "b", 1), ("b", "pair", "a", 1)]
    long = ("w" * 100_000 + " ") * 3 + "É " * 200_000
    assert divergence.divergence(documents(spark, [(long, "en", "a")] * 10 + [("É", "en", "b")])).filter("part = 'pair'").count() == 2


def test_divergence_sql_says_the_same(spark):
    rows = audit_rows(9, 300)
    docs = documents(spark, rows).toPandas()  # noqa: F841  DuckDB reads it by name
    con = duckdb.connect()
    con.register("documents", docs)
    assert sorted(con.execute(divergence.SQL).fetchall()) == sorted(map(tuple, divergence.divergence(documents(spark, rows)).collect()))


# --- op13


def test_ascending_numbers():
    rng = np.random.default_rng(0)
    for n, top in ((1, 0), (1, 9), (3, 10**12), (700, 50), (3000, 10**6), (70_000, 10**9), (500, 2**62), (257, 256)):
        v = np.sort(rng.integers(0, top + 1, n))
        data = EliasFano.encode(v)
        e = EliasFano(memoryview(data))
        assert (e.values(0, n) == v).all() and len(e.values(n, 3)) == 0
        for first, count, x in zip(rng.integers(0, n, 20), rng.integers(1, 600, 20), rng.integers(0, top + 2, 20), strict=True):
            assert (e.values(int(first), int(count)) == v[first : first + count]).all() and e.select(int(first)) == v[first]
            assert e.first_at_least(int(x)) == np.searchsorted(v, x)
        if n >= 500:  # no more than a bit a number over the information it takes
            assert 8 * len(data) / n < 3.3 + max(0, math.log2(max(1, top / n)))
    assert EliasFano(memoryview(EliasFano.encode(np.zeros(0)))).n == 0


def expected_files(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(token_files.read_vocabulary(None))
    out, at = [], 0
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("in_file", [1 << 24, 60])
def test_token_files_equal_the_library(spark, in_file):
    rng = random.Random(4)
    rows = [(3 * i - 90, " ".join(rng.choice(["the", "river", "É", "<|endoftext|>", "x\ny", "漢字"]) for _ in range(rng.randrange(40)))) for i in range(80)]
    rows += [(-1000, "word " * 3000), (2**62, None), (2**62 - 1, "")]
    docs = documents(spark, [(t, None, None) for _, t in rows])
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start long").repartition(5)
    manifest = token_files.write_token_files(docs, ids_in_file=in_file)
    got = sorted(map(tuple, token_files.read_token_files(manifest).collect()))
    assert got == expected_files(sorted(rows)) and (manifest.count() > 40) == (in_file == 60)
    for r in manifest.collect():
        with TokenFile(r["path"]) as f:
            names = f.doc_ids(0, f.docs)
            assert f.width == 2 and f.docs == r["docs"] and f.ids == r["ids"] and names == sorted(names) and f.find(-999) is None
            for k, name in enumerate(names):
                assert f.find(name) == k and len(f.document(k)) == f.bounds(k, 1)[1] - f.bounds(k, 1)[0]


def test_long_document_is_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
    monkeypatch.setattr(token_files, "BLOCK_DOCS", 3)
    rows = [(i, "one two three " * (1 + 40 * (i == 4))) for i in range(9)]
    manifest = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(*d, s, n, c) for r in manifest.orderBy("part", "file").collect() for b in token_files._documents(TokenFile(r["path"]), 0) for *d, s, n, c in zip(b["doc_id"].to_pylist(), b["start"].tolist(), b["n_tokens"].tolist(), b["ids_crc32"], strict=True)]
    assert [(g[0], *g[2:]) for g in got] == [(w[0], *w[2:]) for w in expected_files(rows)]


def test_token_files_of_odd_tables(spark):
    rows = [(None, "no id"), (None, None), (5, "same"), (5, "same"), (5, "other"), (1, ""), (-7, "x")] + [(9, "copy")] * 300
    got = token_files.token_file_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = Counter((i, n, c) for i, _, n, c in expected_files(rows))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by_start] == [None, None, -7, 1, 5, 5, 5] + [9] * 300
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(by_start, by_start[1:], strict=False)) and by_start[0]["start"] == 0
    assert token_files.token_file_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0
