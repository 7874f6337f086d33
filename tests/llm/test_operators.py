"""Each training-data operator against brute force, exact round trips, and odd tables.

Odd tables hold nulls in every column, empty and one-letter texts, repeated rows, equal texts, and extra columns whose
names operators use themselves.
"""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import bpe, components, language, lm, media, merkle, packing, sharding, simhash, suffix, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, fp long, score double, hash long"


def table(spark, rows, parts=3):
    """Rows of (doc_id, text) or (doc_id, text, lang), with extra columns of clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, 7, "x", 1, 0.5, 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


ODD = [(1, None), (2, ""), (3, "a"), (4, "same text here"), (5, "same text here"), (5, "same text here"), (None, "no id\n\ntwo"), (None, None), (9, "ü 中 é" * 40), (10, "  \n\t "), (11, "<|endoftext|>x")]


@pytest.fixture
def odd(spark):
    return table(spark, ODD)


@pytest.fixture
def empty(spark):
    return table(spark, [(1, "x")]).filter("doc_id < 0")


def prose(seed, n, words="the of and a river stone light moves over under slowly before night city people were"):
    rng = random.Random(seed)
    return " ".join(rng.choice(words.split()) for _ in range(n))


# --- shared


def test_stored_tables_are_dropped(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from tidewatch.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda s: str(tmp_path))
    before = common.stored_tables()
    one, two = common.stored(spark.range(5), "one"), common.stored(spark.range(6), "two")
    assert two.count() == 6 and len(list(tmp_path.iterdir())) == 2
    common.discard(one)
    assert len(list(tmp_path.iterdir())) == 1
    common.drop_stored(keep=before)
    assert not list(tmp_path.iterdir()) and common.stored_tables() == before and isinstance(tmp_path, Path)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from tidewatch.llm import common

    with pytest.raises(ValueError):
        common.shared_folder(N(conf=N(get=lambda k, d: d), sparkContext=N(master="spark://host:7077")))
    assert common.shared_folder(N(conf=N(get=lambda k, d: "/shared"), sparkContext=N(master="spark://host:7077"))) == "/shared"


def test_group_values_of_a_hot_group(spark):
    from tidewatch.llm.common import with_group

    rows = spark.range(500).selectExpr("id", "if(id % 3 = 0, id, -1) as k")
    got = with_group(rows, ["k"], {"n": (suffix.F.count("*"), suffix.F.sum), "least": (suffix.F.min("id"), suffix.F.min)}, ["id"]).collect()
    c = Counter(r["k"] for r in got)
    assert len(got) == 500 and all(r["n"] == c[r["k"]] and r["least"] == (1 if r["k"] < 0 else r["k"]) for r in got)


# --- op1


def test_lm_base_scores_and_model(spark):
    rows = [(i, prose(i, 20 + i % 50) + (f" rare{i}" if i % 3 else "")) for i in range(120)] + ODD
    got = sorted(map(tuple, lm.score_documents(table(spark, rows), sample=100, known=10).collect()), key=str)
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    part = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not part(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((i, part(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    assert sum(g[6] for g in got) > sum(g[5] for g in got)


def test_lm_without_training_rows_or_rows(spark, empty):
    held = [(i, prose(i, 9)) for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = lm.score_documents(table(spark, held)).collect()
    assert len(got) == len(held) and all((r["train_tokens"], r["n_known"], r["held_out"]) == (0, 0, True) for r in got)
    assert lm.score_documents(empty).count() == 0


def test_lm_learns_from_all_training_texts(spark):
    """After the pass over all texts, held-out texts are likelier than after the driver's start on a few of them."""
    rows = [(i, " ".join(["a b c d e f g h".split()[(i + k * (i % 3 + 1)) % 8] for k in range(60)])) for i in range(700)]
    docs = table(spark, rows, 4)
    train = docs.filter(~lm.held_out("doc_id")).select("text")
    counts = lm.word_counts(train)
    model = lm.learn(train, counts, 10, 50)
    held = [lm.units_of(lm.words_of(t), model.v)[1] for i, t in rows if zlib.crc32(str(i).encode()) % 7 == 2]
    before = model.score(held).sum()
    assert lm.read_all(train, model).score(held).sum() > before + 1


def test_lm_is_a_distribution_and_carries_state():
    v = lm.Vocabulary([(b"", 10), (b"a", 9), (b"b", 5), (b"zz", 1)], {k: (0, 0) for k in range(16)} | {lm.tail_class(b""): (10, 1), lm.tail_class(b"a"): (14, 2), lm.tail_class(b"zz"): (1, 1)}, shortlist=3, classes=2)
    m = lm.Model(v, hidden=4)
    states = np.random.default_rng(0).normal(size=(1, 4)).astype("f4")
    total = sum(np.exp(m.log_probabilities(states, np.array([y]))[0]) for y in range(v.size + lm.TAILS))
    assert abs(total - 1) < 1e-5
    doc = np.array([1, 2, 1, 1, 2, 0] * 30)
    h, before, want = np.zeros((4, 1), "f4"), np.array([0]), 0.0
    for y in doc:
        h = m.step(h, before)
        want += m.log_probabilities(h.T, np.array([y]))[0]
        before = np.array([y])
    assert abs(m.score([doc[:3], doc])[1] - want / np.log(10)) < 1e-3


def test_lm_lays_tokens_side_by_side():
    """Scores are (outputs, tokens), so that sums over the outputs run along rows; the numbers are the plain softmax's."""
    x, y = np.random.default_rng(2).normal(size=(5, 40)), np.arange(40) % 5
    plain = np.exp(x) / np.exp(x).sum(0)
    assert np.allclose(lm._log_shares(x.copy(), y), np.log(plain[y, np.arange(40)]))
    loss, slope = lm._softmax_loss(x.copy(), y)
    assert np.isclose(loss, -np.log(plain[y, np.arange(40)]).sum()) and np.allclose(slope, plain - np.eye(5)[y].T)


def test_lm_scores_and_copies_stand_alone(spark):
    """How many tokens a task scores at once changes no score; training a copy leaves its original as it was."""
    rows = [(i, " ".join(f"w{(i * j) % 11}" for j in range(i % 40))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    one, all_ = ({r["doc_id"]: r["score"] for r in lm.score_documents(docs, 20, together=n).collect()} for n in (1, 10**9))
    assert one.keys() == all_.keys() == set(range(90)) and all(abs(one[i] - all_[i]) < 1e-3 for i in one)
    m = lm.Model(lm.Vocabulary([(b"", 10), (b"a", 9)], {}), hidden=3)
    before, other = m.weights(), m.apart()
    other.read([np.array([1, 1, 0] * 40)])
    assert (m.weights() == before).all() and (other.weights() != before).any() and other.v is m.v and not hasattr(m, "moments")


def test_lm_gradients():
    v = lm.Vocabulary([(b"", 10), (b"a", 9), (b"b", 5), (b"c", 4), (b"d", 3)], {}, shortlist=5, classes=2)
    m = lm.Model(v, hidden=3)
    m.p = {k: a.astype("f8") for k, a in m.p.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 9, (5, 2)), rng.integers(0, 9, (5, 2))
    _, _, grads = m.gradients(np.zeros((3, 2)), x, y)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        losses = []
        for d in (1e-4, -1e-4):
            m.p[k][at] += d
            losses.append(m.gradients(np.zeros((3, 2)), x, y)[1])
            m.p[k][at] -= d
        assert abs((losses[0] - losses[1]) / 2e-4 - g[at]) < 1e-4, k


# --- op2

WORDS = {"en": "the and with there would shall thing", "de": "der und nicht schön über zwischen ein", "fr": "le et être où garçon très leur"}


def test_language_held_out_accuracy_and_odd_rows(spark):
    rows = [(i, prose(i, 12, WORDS[k]), k) for i in range(300) for k in [list(WORDS)[i % 3]]]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "1234 !!", "fr"), (1003, prose(5, 4000, WORDS["de"]), None), (None, "the and", None)]
    got = {r["doc_id"]: r for r in language.language_rows(table(spark, rows)).collect()}
    held = [i for i in range(300) if got[i]["held_out"]]
    assert len(held) > 30 and np.mean([got[i]["lang_pred"] == list(WORDS)[i % 3] for i in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == len(rows)


def test_language_without_labels_or_rows(spark, empty):
    assert {r["lang_pred"] for r in language.language_rows(table(spark, ODD)).collect()} == {"und"}
    assert language.language_rows(empty).count() == 0


def test_language_gradients():
    net = language.Network(["a", "b"], hidden=3)
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y, live = rng.integers(0, 256, (6, 4)), np.array([0, 1, 1, 0]), np.ones((6, 4))
    _, grads = net.gradients(x, y, live)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        losses = []
        for d in (1e-3, -1e-3):
            net.p[k][at] += d
            losses.append(net.gradients(x, y, live)[0])
            net.p[k][at] -= d
        assert abs((losses[0] - losses[1]) / 2e-3 - g[at]) < 2e-3, k


# --- op3

PIECES = ["a", "b", "the", "  ", " ", "\n", "\n\n", "\t", "!", "!!", "é", "ü", "€", "\u2028", "\xa0", "1", "²", "Ⅷ", "'s", "'ll", "<|endoftext|>", "<|", "aaaa", "中", "\u0301", "x\x1cy", "\x85", "🙂", "ing", "A", "_", "\r\n"]


def test_bpe_equals_the_library():
    """Through the automaton alone, and with the cache of units on top."""
    tokenizers = pytest.importorskip("tokenizers")
    content = bpe.read_vocabulary(None)
    tok = tokenizers.Tokenizer.from_str(content)
    a, cache = bpe.automaton(bpe.compiled(content))
    small = bpe.UnitCache(a.encode_spans, a.special, a.cuts, room=2000)
    rng = random.Random(4)
    texts = ["", "a" * 3000, "!" * 500, " " * 300, "ab" * 6000 + "x", "".join(rng.choice("abcdeth") for _ in range(9000))] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for got in (cache.encode_batch(texts), small.encode_batch(texts, chars=500)):
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    bare = [k for k, t in enumerate(texts) if "<|endoftext|>" not in t]
    assert [np.frombuffer(x, "<u4").tolist() for x in a.encode_spans([texts[k] for k in bare])] == [want[k] for k in bare]
    assert all(a.decode(ids) == tok.decode(ids, skip_special_tokens=False) for ids in want)
    assert sum(small.OVERHEAD + len(u) + len(x) for u, x in small.units.items()) <= 2000


def test_bpe_states_have_the_right_arcs():
    """A pair of labels follows each other in the automaton just if encoding their joint bytes keeps both."""
    a, _ = bpe.automaton(bpe.compiled(bpe.read_vocabulary(None)))
    rng = random.Random(2)
    pairs = [(rng.randrange(256, 3000), rng.randrange(256, 3000)) for _ in range(4000)]
    got = a.encode_words([a.labels[x] + a.labels[y] for x, y in pairs])
    kept = [np.frombuffer(g, "<u4").tolist() == list(p) for g, p in zip(got, pairs, strict=True)]
    assert a.open_arcs(*np.array(pairs).T).tolist() == kept and 100 < sum(kept) < 3900


def test_bpe_gadgets_one_by_one():
    """The compiled table against an automaton whose arcs are written out and changed merge by merge."""
    letters = "abc"
    rng = random.Random(9)
    for _ in range(40):
        vocab = {c: i for i, c in enumerate(letters)}
        merges, names = [], list(letters)
        arcs = {(x, y) for x in names for y in names}
        while len(merges) < 9:
            a, b = rng.choice(names), rng.choice(names)
            if a + b in vocab or (a, b) not in arcs:
                continue
            vocab[a + b] = len(vocab)
            merges.append(f"{a} {b}")
            arcs.discard((a, b))
            after_b, before_a = [y for x, y in arcs if x == b], [x for x, y in arcs if y == a]
            if a == b:
                before_a = [x for x in before_a if x != a]
            arcs |= {(a + b, y) for y in after_b} | {(x, a + b) for x in before_a}
            if (a + b, a) in arcs:
                arcs.add((a + b, a + b))
            names.append(a + b)
        made = bpe.Automaton(bpe.compile_automaton(__import__("json").dumps({"model": {"vocab": vocab, "merges": merges}})))
        for x in names:
            for y in names:
                if (x, y) in arcs:
                    assert made.encode_words([(x + y).encode()])[0] == np.array([vocab[x], vocab[y]], "<u4").tobytes()


def test_bpe_rows(odd, empty):
    got = bpe.token_digests(odd).collect()
    assert len(got) == len(ODD)
    for r in got:
        if r["doc_id"] is not None:
            text = dict(ODD)[r["doc_id"]] or ""
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.token_digests(empty).count() == 0
    assert bpe.encode_documents(odd).filter("decoded is null").count() == 0


# --- op4


def test_images_round_trip():
    rng = np.random.default_rng(0)
    for h, w in ((1, 1), (3, 5), (7, 64)):
        rgb, g = rng.integers(0, 256, (h, w, 3), np.uint8), rng.integers(0, 256, (h, w), np.uint8)
        assert (media.decode(media.encode_ppm(rgb)) == rgb).all() and (media.decode(media.encode_ppm(g)) == g).all() and (media.decode(media.encode_bmp(rgb)) == rgb).all()
        plain = b"P3 # c\n%d %d\n255\n" % (w, h) + b" ".join(b"%d" % x for x in rgb.ravel())
        assert (media.decode(plain) == rgb).all()
    assert media.decode(b"P1\n2 1\n1 0").tolist() == [[0, 255]] and media.decode(b"P4\n2 1\n\x80").tolist() == [[0, 255]]
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_area_resize_is_the_mean_of_areas():
    rng = np.random.default_rng(1)
    x = rng.random((12, 20))
    assert np.allclose(media.area_resize(x, 3, 5), x.reshape(3, 4, 5, 4).mean((1, 3)))
    assert np.allclose(media.area_resize(x, 24, 40), x.repeat(2, 0).repeat(2, 1))
    fine = x.repeat(7, 0).repeat(9, 1)
    assert np.allclose(media.area_resize(x, 7, 9), fine.reshape(7, 12, 9, 20).mean((1, 3)))


def test_media_rows(odd, empty):
    rows = media.media_digests(odd).collect()
    for r in rows:
        if r["doc_id"] is not None:
            raw = (dict(ODD)[r["doc_id"]] or "").encode()
            full = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    assert len(rows) == len(ODD) and len({r["feature"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    assert media.media_digests(empty).count() == 0
    tile = np.load(__import__("io").BytesIO(bytes(media.media_columns(odd, "bmp").first()["tile"])))
    assert tile.shape == (32, 32, 3)


# --- op5


def brute_tree(text):
    """Nested lists of leaves (tuples of words)."""
    return [[[tuple(w[i : i + 4]) for w in [p.split(" ")] for i in range(0, len(w), 4)] for p in s.split("\n")] for s in text.split("\n\n")]


def brute_likeness(a, b):
    if a == b:
        return 1.0
    x, y = (Counter(leaf for s in brute_tree(t) for p in s for leaf in p) for t in (a, b))
    return 2.0 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()) + 2)


def test_merkle_edits(spark, odd, empty):
    rows = [(i, prose(i, 100 + i) + "\n" + prose(i + 999, 50) + "\n\n" * (i % 3) + prose(i % 4, 60)) for i in range(40)] + [(100, ""), (101, None), (102, "a b"), (103, "b a\n\n\n"), (104, "ü" * 9 + " é" * 700)]
    df = table(spark, rows)
    for size, width in ((7, 256), (1000, 256), (3, 4)):
        with_next, order = merkle.with_next(df, rows=size, width=width)
        assert with_next.filter("last = 0").count() == len(rows)
        follows = {r["doc_id"]: r["next"] for r in with_next.withColumn("next", merkle.F.lead("doc_id").over(order)).filter("last = 0").collect()}
        down = sorted((i for i, _ in rows), reverse=True)
        assert follows == dict(zip(down, down[1:] + down[:1], strict=True))
    got = {r["doc_id"]: r for r in merkle.edited_fingerprints(df).collect()}
    texts = {i: t or "" for i, t in rows}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i]["near_edited"] - brute_likeness(t, edited)) < 1e-12 and abs(got[i]["near_next"] - brute_likeness(t, nxt)) < 1e-12
        tree = brute_tree(t)
        parts = got[i]["fingerprint"].split(":")
        assert [len(p) for p in parts] == [16, 16 * len(tree), 8 * sum(map(len, tree)), 16]
        leaves, other = ([leaf for s in brute_tree(x) for p in s for leaf in p] for x in (t, edited))
        if t != edited:
            same = next((j for j, (x, y) in enumerate(zip(leaves, other)) if x != y), min(len(leaves), len(other)))
            assert got[i]["edited_from_leaf"] <= same and got[i]["edited_from_leaf"] + got[i]["edited_leaves"] <= len(leaves)
        else:
            assert got[i]["edited_from_leaf"] is None
    assert got[100]["fingerprint"] == got[101]["fingerprint"]
    assert len({r["fingerprint"] for r in got.values()}) == len(set(texts.values()))
    assert merkle.edited_fingerprints(odd).count() == len(ODD)
    assert merkle.edited_fingerprints(empty).count() == 0
    one = merkle.edited_fingerprints(table(spark, [(7, "only one here")])).first()
    assert one["near_next"] == 1.0


def test_merkle_finds_the_edit(spark):
    text = "\n\n".join("\n".join(prose(9 * s + p, 20) for p in range(3)) for s in range(5))
    words = text.split(" ")
    words[150] = "edited"
    df = spark.createDataFrame([(text, " ".join(words)), (text, text), (text, text + " more")], "a string, b string")
    out = merkle.with_difference(merkle.with_tree(merkle.with_tree(df, "a", "x"), "b", "y"), "x", "y", "like").select("like", "like_edit").collect()
    place = next((s, p, q) for s, p, q, leaf in ((s, p, q, leaf) for s, sec in enumerate(brute_tree(" ".join(words))) for p, par in enumerate(sec) for q, leaf in enumerate(par)) if "edited" in leaf)
    assert out[0]["like_edit"] == (place[0], place[0] * 3 + place[1], (place[0] * 3 + place[1]) * 5 + place[2], 1, 1, 1)
    assert out[1]["like"] == 1.0 and out[1]["like_edit"] is None
    assert out[2]["like_edit"] == (4, 14, 75, 1, 1, 0)


def test_merkle_short_texts_have_fingerprints_of_their_own(spark):
    df = spark.range(30_000).select(merkle.F.concat(merkle.F.lit("w"), "id").alias("text"))
    assert merkle.with_tree(df, "text", "t").select(merkle.printed("t").alias("f")).distinct().count() == 30_000


def test_merkle_order_has_no_single_task_and_parts_null_ids(spark):
    rows = [(i if i % 3 else None, f"text {i % 150}") for i in range(300)] + [(500, "one"), (500, "two"), (500, "one")]
    docs = table(spark, rows)
    with_next, order = merkle.with_next(docs, rows=9, width=4)
    lead = with_next.withColumn("next", merkle.F.lead("text").over(order)).filter("last = 0")
    got = lead.select("doc_id", "text", "digest", "next", "range").collect()
    down = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["digest"]), reverse=True)
    assert [r["next"] for r in down] == [r["text"] for r in down[1:] + down[:1]]
    assert len({r["range"] for r in got if r["doc_id"] is None}) > 5
    merkle.edited_fingerprints(docs).count()
    assert "SinglePartition" not in lead._jdf.queryExecution().executedPlan().toString()


def test_merkle_range_of_ids(spark):
    df = table(spark, [(i, str(i)) for i in range(200)]).select("doc_id")
    bounds = merkle.with_range(df, rows=5, width=4).collect()
    ordered = [r["range"] for r in sorted(bounds, key=lambda r: -r["doc_id"])]
    assert ordered == sorted(ordered) and len(set(ordered)) > 20


# --- op6


def brute_repeats(texts, n):
    raws = [(t or "").encode() for t in texts]
    c = Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - n + 1):
            if c[r[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        out.append((len(r), hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest(), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))))
    return out


@pytest.mark.parametrize(("cap", "many"), [(30_000, 30_000), (30_000, 3), (3, 2)])
def test_repeats_equal_brute_force(spark, cap, many):
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [some(rng.randint(10, 60)) for _ in range(10)]
    texts = [None, "", "ab" * 200, "x" * 90, "x" * 41] + ["".join(rng.choice([rng.choice(shared), some(rng.randint(1, 60)), "ab " * rng.randint(1, 20)]) for _ in range(rng.randint(1, 7))) for _ in range(80)]
    texts += [texts[7]] * 3 + [shared[0] + some(30) + shared[1] for _ in range(10)]
    got = {r["doc_id"]: r for r in suffix.remove_repeats(table(spark, list(enumerate(texts))), 40, 8, cap, with_text=True, many=many).collect()}
    for i, want in enumerate(brute_repeats(texts, 40)):
        assert (got[i]["n_bytes"], got[i]["kept_sha256"], len(got[i]["spans"])) == want


@pytest.mark.parametrize(("cap", "many"), [(suffix.CAP, suffix.MANY), (4, 3)])
def test_whole_query_of_repeats_equals_brute_force(spark, cap, many, monkeypatch):
    """With the query's own length, and texts that cross the border of a chunk."""
    monkeypatch.setattr(suffix, "CHUNK", 3000)
    rng = random.Random(12)
    some = lambda n: " ".join(rng.choice(["river", "stone", "light", "über", "night", "a", "of"]) + str(rng.randint(0, 99)) for _ in range(n))
    shared = [some(rng.randint(40, 160)) for _ in range(8)]
    rows = [(i, " ".join(rng.choice([rng.choice(shared), some(rng.randint(5, 150))]) for _ in range(rng.randint(1, 8)))) for i in range(120)]
    rows += [(200, " ".join([some(300), shared[0], some(900), shared[0], some(20)])), (201, "ab" * 5000), (202, None), (203, rows[5][1]), (204, rows[5][1][:399]), (None, shared[1])]
    got = sorted(map(tuple, suffix.remove_repeats(table(spark, rows), cap=cap, many=many).select("doc_id", "n_bytes", "kept_sha256", suffix.F.size("spans")).collect()), key=str)
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute_repeats([t for _, t in rows], 400), strict=True)), key=str)
    assert got == want and sum(w[3] > 0 for w in want) > 60


@pytest.mark.parametrize(("cap", "many"), [(suffix.CAP, suffix.MANY), (4, 3)])
def test_repeated_runs_of_words_equal_brute_force(spark, cap, many):
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice(["a", "be", "sea", "é"]) + rng.choice([" ", " ", "\n", "  "]) for _ in range(n))
    shared = [some(rng.randint(6, 30)) for _ in range(8)]
    texts = [None, "", "  ", "a " * 60] + ["".join(rng.choice([rng.choice(shared), some(rng.randint(1, 30))]) for _ in range(rng.randint(1, 6))) for _ in range(80)]
    texts += [texts[9], texts[9], " ".join(texts[10].split())]
    n, c = 12, Counter()
    for t in texts:
        w = (t or "").split()
        c.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    got = {r["doc_id"]: r["kept_text"].split() for r in suffix.remove_repeats(table(spark, list(enumerate(texts))), n, 4, cap, with_text=True, words=True, many=many).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        gone = {j for k in range(len(w) - n + 1) if c[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}
        assert got[i] == [x for j, x in enumerate(w) if j not in gone], i


def test_blind_trie_and_deep_shallow_sort():
    rng = random.Random(5)
    for shallow in (0, 1, 12):
        for _ in range(30):
            s = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 24))) for _ in range(rng.randint(1, 40))]
            assert [s[i] for i in suffix.blind_trie_order(s)] == sorted(s)
            group = np.array([rng.randint(0, 2) for _ in s])
            rows, sizes = suffix._matrix(s, 24)
            order, common = suffix.deep_shallow(rows, sizes, group, shallow)
            for k in range(1, len(s)):
                a, b = order[k - 1], order[k]
                assert common[k] == (suffix.common_prefix(s[a], s[b]) if group[a] == group[b] else -1)


def test_repeat_rows(odd, empty):
    assert suffix.repeat_rows(odd).count() == len(ODD)
    assert suffix.repeat_rows(empty).count() == 0


# --- op7


def brute_capacity(sizes, shards):
    def fits(c):
        used, n = 0, 1
        for x in sizes:
            if used + x > c:
                used, n = 0, n + 1
            used += x
        return n <= shards

    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


def test_minimax_cuts_are_the_least_capacity(spark):
    rng = random.Random(1)
    for k in range(12):
        groups = {rng.getrandbits(63) >> rng.choice([0, 0, 50]): rng.choice([1, 5, 30, 400 if k % 3 == 0 else 9]) for _ in range(rng.randint(1, 60))}
        shards = rng.randint(1, 9)
        rows = spark.createDataFrame([(g, 1) for g, n in groups.items() for _ in range(n)], "group long, size long")
        capacity, cuts = sharding.minimax_cuts(rows, shards, first=2, finer=3)
        order = sorted(groups)
        assert capacity == brute_capacity([groups[g] for g in order], shards) and len(cuts) < shards and cuts == sorted(cuts)
        loads = Counter(sum(g >= c for c in cuts) for g in order for _ in range(groups[g]))
        assert max(loads.values()) <= capacity


def test_shards(spark, odd, empty):
    rows = ODD + [(100 + i, prose(i % 60, 5 + i % 9)) for i in range(300)]
    got = sharding.shard_documents(table(spark, rows), shards=8, part=9).toPandas()
    assert len(got) == len(rows) and set(got["shard"]) == set(range(8))
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    by_text = {}
    for r in got.dropna(subset=["doc_id"]).itertuples():
        by_text.setdefault(dict(rows)[int(r.doc_id)] or "", set()).add(r.shard)
        raw = (dict(rows)[int(r.doc_id)] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    assert all(len(s) == 1 for s in by_text.values())
    assert sharding.shard_documents(empty).count() == 0
    assert set(sharding.shard_documents(table(spark, [(i, "one text") for i in range(50)])).toPandas()["shard"]) == {0}


def test_shards_are_near_equal_and_within_the_least_capacity(spark):
    rows = [(i, prose(i if i % 4 else 0, 20 + i * 37 % 90)) for i in range(4000)]
    got = sharding.shard_documents(table(spark, rows), shards=10)
    loads = got.groupBy("shard").agg(sharding.F.sum("size").alias("bytes")).toPandas()["bytes"]
    with_group = table(spark, rows).select("doc_id", sharding.group_hash(sharding.F.col("text")).alias("g")).toPandas().set_index("doc_id")["g"]
    sizes = Counter()
    for i, t in rows:
        sizes[with_group[i]] += len(t.encode()) + 16
    assert max(loads) <= brute_capacity([sizes[g] for g in sorted(sizes)], 10)
    assert max(loads) < 1.02 * loads.mean() and min(loads) > 0.98 * loads.mean()


def brute_least_load(sizes, shards, capacity):
    """The greatest least load of contiguous shards within the capacity, over all ways to cut."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    best = np.where(sums <= capacity, sums, -1)  # by the end of the first shard
    for _ in range(shards - 1):
        loads = sums[None, :] - sums[:, None]
        loads = np.where((loads >= 0) & (loads <= capacity), loads, -1)
        best = np.minimum(best[:, None], loads).max(axis=0)
    return best[-1]


@pytest.mark.parametrize("seed", [0, 1])
def test_forty_shards_of_a_thousand_uneven_texts(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w" * int(rng.lognormvariate(6, 1.1))) if i % 9 else (i, "copy") for i in range(1000)]
    docs = table(spark, rows)
    got = sharding.shard_documents(docs, shards=40)
    loads = got.groupBy("shard").agg(sharding.F.sum("size").alias("bytes")).toPandas()["bytes"]
    hashes = docs.select("doc_id", sharding.group_hash(sharding.F.col("text")).alias("g")).toPandas().set_index("doc_id")["g"]
    sizes = Counter()
    for i, t in rows:
        sizes[hashes[i]] += len(t) + 16
    sizes = [sizes[g] for g in sorted(sizes)]
    capacity = brute_capacity(sizes, 40)
    assert len(loads) == 40 and max(loads) <= capacity and min(loads) >= 0.9 * brute_least_load(sizes, 40, capacity)


# --- op8


def test_packing_fills_sequences_without_overlap(spark, empty):
    rows = ODD + [(200 + i, prose(i, 3 + i * 7 % 90)) for i in range(150)]
    pieces = packing.token_pieces(table(spark, rows), capacity=64).cache()
    got = packing.pack(pieces, capacity=64, part=7).toPandas()
    assert len(got) == pieces.count() and got["length"].between(1, 64).all()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 64
    least = -(-got["length"].sum() // 64)
    assert got["sequence_id"].nunique() <= least * 1.03 + 1
    assert packing.packed_documents(empty).count() == 0


def test_packing_of_clashing_columns_and_one_length(spark):
    rows = [(i % 50, 0, 0, 4, i, i, i, "x") for i in range(1000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, rank long, part long, salt long, offsets string")
    got = packing.pack(pieces, capacity=8, part=10).toPandas()
    assert len(got) == 1000 and sorted(got["rank"]) == list(range(1000)) and got["sequence_id"].nunique() == 500
    assert all(sorted(g["offset"]) == [0, 4] for _, g in got.groupby("sequence_id"))


def test_pieces_are_the_documents_ids(spark):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    texts = {1: prose(1, 500), 2: None, 3: "ab\ncd  ef\n"}
    got = packing.token_pieces(table(spark, list(texts.items())), capacity=100, keep_ids=True).collect()
    for i, t in texts.items():
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        ids = b"".join(bytes(r["ids"]) for r in mine)
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert all(r["length"] == 100 for r in mine[1:]) and all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in mine)


def test_reduction_only_fixes_dominating_sets():
    """Against the exact least number of sequences for small instances."""
    from functools import lru_cache

    def exact(items, room):
        items = tuple(sorted(items, reverse=True))

        @lru_cache(None)
        def best(left, rooms):
            if not left:
                return 0
            options = [1 + best(left[1:], tuple(sorted((*rooms, room - left[0]))))]
            options += [best(left[1:], tuple(sorted((*rooms[:k], r - left[0], *rooms[k + 1 :])))) for k, r in enumerate(rooms) if r >= left[0]]
            return min(options)

        return best(items, ())

    rng = random.Random(7)
    for _ in range(80):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 8))]
        p = packing.Packing(dict(Counter(items)), 20)
        fixed = p.reduce()
        rest = [n for n, k in p.left.items() for _ in range(k)]
        assert fixed + exact(rest, 20) == exact(items, 20)


# --- op9


def test_urls(spark):
    urls = ["http://Example.COM/en/x", "https://www.example.com/en/?q", "http://a.b.net/es/1", "http://net/fr/", "ftp://x.org/en/", None, "nothing", "http://com", "http://xcom/", "http://example.com#/en/", "a://b://com/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert got[0] == ("example.com", "/en/x", "example.com/en/", "block") and got[1] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[2][2:] == ("net/es/", "block") and got[3][2:] == ("net/fr/", "block") and got[4][2:] == (None, "allow")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7][2] is None and got[8][2] is None and got[9] == ("example.com", "", None, "allow") and got[10][0] == "b:"
    assert url_filter.filter_urls(df.filter("page_id < 0")).count() == 0


def test_colliding_digests_do_not_decide(tmp_path):
    weak = lambda b: len(b) % 3
    index = url_filter.open_index(url_filter.build_index(url_filter.RULES, str(tmp_path), weak))
    urls = ["http://a.com/x", "http://example.com/en/", "http://b.net/es/x", "http://q.org/fr/"]
    assert url_filter.judge(urls, index, "allow", weak)["rule"] == ["com/", "example.com/en/", "net/es/", None]
    assert url_filter.judge(urls, url_filter.open_index(url_filter.build_index([], str(tmp_path))), "allow")["rule"] == [None] * 4


def test_urls_repeated_rows_and_no_ids(spark):
    df = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, "http://b.net/es/"), (None, None)], "page_id long, url string")
    got = sorted(map(tuple, url_filter.filter_urls(df).select("page_id", "rule", "verdict").collect()), key=str)
    assert got == sorted([(1, "com/", "allow")] * 2 + [(None, "net/es/", "block"), (None, None, "allow")], key=str)


# --- op10


def brute_classes(fps, bits):
    named = {int(x): int(x) for x in fps}

    def root(x):
        while named[x] != x:
            x = named[x]
        return x

    whole = np.array(list(named), np.int64).view(np.uint64)
    for i, x in enumerate(whole):
        for j in np.flatnonzero(np.bitwise_count(whole ^ x) <= bits):
            a, b = root(int(whole.view(np.int64)[i])), root(int(whole.view(np.int64)[j]))
            named[max(a, b)] = min(a, b)
    return {x: root(x) for x in named}


@pytest.mark.parametrize(("bits", "limit"), [(2, 4096), (2, 12), (3, 4096)])
def test_links_equal_brute_force(spark, bits, limit):
    rng = np.random.default_rng(bits)
    fps = []
    for base in rng.integers(0, 1 << 63, 4, dtype=np.uint64):
        for _ in range(60):
            x = int(base)
            for k in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(k)
            fps.append(x)
    fps = np.unique(np.array(fps + rng.integers(0, 1 << 63, 100, dtype=np.uint64).tolist(), np.uint64)).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    got = {r["node"]: r["component"] for r in components.components(simhash.links(df, bits, limit)).collect()}
    assert {x: got.get(x, x) for x in fps.tolist()} == brute_classes(fps, bits)


@pytest.mark.parametrize("limit", [12, 4096])
def test_wide_links_equal_brute_force(spark, limit):
    """All pairs with a band in common and at most ``most`` differing bits are connected, however full the bands are."""
    rng = np.random.default_rng(5)
    rows, wide = [], []
    for c in range(3):
        base = rng.integers(0, 2, 512)
        for k in range(70):
            flip = rng.random(512) < rng.choice([0.01, 0.04, 0.09, 0.2])
            words = np.packbits(base ^ flip).view(">u8").astype(np.uint64).view(np.int64)
            wide.append(words.view(np.uint64))
            rows.append((100 * c + k, words.tolist(), [c, 7 if k % 5 else 100 * c + k]))
    wide = np.array(wide)
    named = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if any(x == y for x, y in zip(rows[i][2], rows[j][2], strict=True)) and np.bitwise_count(wide[i] ^ wide[j]).sum() <= 60:
                a, b = sorted((named[i], named[j]))
                named = [a if n == b else n for n in named]
    df = spark.createDataFrame(rows, "fp long, wide array<long>, bands array<long>")
    got = {r["node"]: r["component"] for r in components.components(simhash.wide_links(df, limit, 60)).collect()}
    assert [got.get(r[0], r[0]) for r in rows] == [rows[n][0] for n in named]
    assert 3 < len(set(named)) < 150


def test_similar_documents_recall(spark):
    """Pairs by the similarity of their sets of five-word shingles: nearly all from 0.8 on, none far below."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, pairs = [], []
    for k in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(80, 300))]
        rate = rng.choice([0.004, 0.008, 0.012, 0.016, 0.02, 0.06, 0.1])
        other = [rng.choice(vocabulary) if rng.random() < rate else w for w in words]
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, other))
        pairs.append(len(x & y) / len(x | y))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {r["doc_id"]: r["first_id"] for r in simhash.similar_documents(table(spark, rows)).collect()}
    linked = np.array([got[2 * k] == got[2 * k + 1] for k in range(300)])
    pairs = np.array(pairs)
    assert linked[pairs >= 0.8].mean() >= 0.9 and linked[pairs >= 0.85].mean() >= 0.98 and not linked[pairs < 0.6].any()
    assert all(got[2 * k] in (2 * k, 2 * k + 1) or pairs[k] >= 0 and got[2 * k] is not None for k in range(300))


def test_similar_documents_odd_rows(spark, odd, empty):
    got = simhash.similar_documents(odd).collect()
    assert len(got) == len(ODD) and simhash.similar_documents(empty).count() == 0
    assert {r["first_id"] for r in got if r["doc_id"] in (1, 2, 10)} == {1} and {r["first_id"] for r in got if r["doc_id"] in (4, 5)} == {4}


def test_whole_query_equals_brute_force(spark):
    import xxhash

    rng = random.Random(6)
    texts = [prose(k, rng.randint(0, 40)) for k in range(60)]
    texts += [t + rng.choice(["", " x", "\n", " THE"]) for t in texts for _ in range(3)]
    rows = list(enumerate(texts))
    fps = []
    for t in texts:
        words = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(max(1, len(words) - 2))] if words else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    classes = brute_classes(np.array(fps, np.uint64).view(np.int64), 2)
    of = [classes[x] for x in np.array(fps, np.uint64).view(np.int64).tolist()]
    least = {}
    for i, c in enumerate(of):
        least.setdefault(c, i)
    got = sorted(map(tuple, simhash.near_duplicate_rows(table(spark, rows)).collect()))
    assert got == [(i, f"{fps[i]:016x}", least[of[i]]) for i in range(len(texts))]


def test_simhash_rows(spark, odd, empty):
    import xxhash

    got = simhash.near_duplicate_rows(odd).collect()
    assert len(got) == len(ODD)
    for r in got:
        if r["doc_id"] in (4, 9):
            words = dict(ODD)[r["doc_id"]].encode().lower().split()
            h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(max(1, len(words) - 2))]
            bits = sum((1 << b) for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
            assert r["fingerprint"] == f"{bits:016x}"
    zero = {r["doc_id"]: r["component_id"] for r in got if r["fingerprint"] == "0" * 16}
    assert zero[1] == zero[2] == zero[10] == 1
    assert {r["component_id"] for r in got if r["doc_id"] in (4, 5)} == {4}
    assert simhash.near_duplicate_rows(empty).count() == 0


def test_joined_units_get_the_ids_of_the_library():
    from tokenizers import Tokenizer

    content = bpe.read_vocabulary(None)
    library, cache = Tokenizer.from_str(content), packing._tokenizer(content)
    library.no_truncation()
    library.no_padding()
    signs, draw = [" ", " ", " ", "\n", "  ", " \n", "\t", "a", "é", "漢字", "'s", "12", "-", "<|endoftext|>", "\x1c", "\x85", "𝒳"], random.Random(3)
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    for _ in range(2):  # the second time from the cache
        for i in range(0, len(texts), 500):
            part = texts[i : i + 500]
            assert [np.frombuffer(x, "<u4").tolist() for x in cache.encode_batch(part)] == [library.encode(t, add_special_tokens=False).ids for t in part]
