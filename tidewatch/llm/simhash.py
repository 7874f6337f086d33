"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are 64-bit majorities over the shingles' hashes. Two that differ in at most ``bits`` places, cut into m
segments on a ring, must have a start from which every chain of k consecutive segments holds at most floor(bits * k / m)
differences. With m = 2 * bits + 1, the first two segments of such a chain are equal, so (start, both segments) is a join
key (26 bits for 2 differing bits); longer chains then prune candidates before the full Hamming check.

Only distinct fingerprints are linked, and inside a key's group a task emits a spanning forest of the links it finds,
never all pairs. Groups over ``limit`` are never gathered: their members get finer keys, by the same ring argument on
the bits the key leaves open, until those bits are so few that a group is small by arithmetic. A pair that links there
agrees with itself on every level, so no link is lost.

64 bits tell texts of 0.8 similarity, some ten differing bits, too badly apart, and keys for so many bits filter nothing.
So ``similar_documents`` adds a second kind of link: candidates share one of ``BANDS`` bands of ``ROWS`` least hashes
(MinHash) and count if their wide fingerprints, 512 further SimHash bits, differ in ``WIDE`` bits at most. Over-full bands
are compared with one pivot first, and only what the pivot does not link meets the others, block against block; so
whether two documents link never depends on how many share their band.

Defined results: a null text is the empty text and has fingerprint zero; texts without words likewise, and zero links
like any other; fewer words than a shingle are one shingle; null ids get a fingerprint and a component too, but never
name one while the component has another id; repeated rows and ties don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_batches, plain, stored, with_group
from tidewatch.llm.components import components

SEED = 42
#: Bands and least hashes of each; 64-bit words of a wide fingerprint, and differing bits up to which it links. Similarity
#: 0.8 of the shingle sets is a cosine of 8/9, an angle of 0.152 half turns, 77.6 bits of 512 in the mean, 8.1 the deviation.
BANDS, ROWS, WORDS, WIDE = 14, 6, 8, 90
FULL = 16_384  # members of a band that one task compares, 1.5 MB
_MIX = np.random.default_rng(17).integers(1, 1 << 63, (3, BANDS * ROWS + WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, size: int) -> list[int]:
    """XXH64 of every shingle, repeats included; A-Z lower-cased, words between blanks and bytes 9 to 13."""
    words = text.encode().lower().split()
    if not words:
        return []
    whole, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [h(whole, SEED)]
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[: len(words) - size])]
    return [h(whole[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """A bit is one if it is set in over half of the hashes."""
    if not hashes:
        return 0
    raw = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 8192):
        ones += np.unpackbits(raw[at : at + 8192], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` 64-bit words: SimHash bits of further hashes, each made of the shingle's hash by multiplying and shifting."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 4096):
        x = hashes[at : at + 4096, None] * _MIX[0, :WORDS]
        x ^= x >> np.uint64(31)
        x *= _MIX[1, :WORDS]
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.astype(">u8").view(np.uint8), axis=1).sum(0, dtype=np.uint32)
    return np.packbits(2 * ones > len(hashes)).view(">u8").astype(np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band: a digest of its least hashes."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 4096):
        x = hashes[at : at + 4096, None] * _MIX[2, WORDS:]
        np.minimum(least, x.min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(part.tobytes(), k) for k, part in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def fingerprints(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            fps = [fingerprint(shingle_hashes(t, size)) for t in b["text"].to_pylist()]
            yield {"doc_id": b["doc_id"], "fp": np.array(fps, np.uint64).view(np.int64)}

    rows = docs.select(docs[id_col].alias("doc_id"), plain(text_col).alias("text"))
    return map_batches(rows, f"doc_id {dict(docs.dtypes)[id_col]}, fp long", work)


def ring(places: list[int], bits: int) -> list[list[int]]:
    """The bit places cut into 2 * bits + 1 consecutive segments."""
    m = 2 * bits + 1
    cut = [round(k * len(places) / m) for k in range(m + 1)]
    return [places[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def mask(places: list[int]) -> int:
    m = sum(1 << p for p in places)
    return m - (1 << 64) if m >> 63 else m


def ring_keys(places: list[int], bits: int) -> list[tuple[int, list[int]]]:
    """(mask of the two equal segments, places left open) for each start on the ring."""
    parts, out = ring(places, bits), []
    for start in range(len(parts)):
        held = parts[start] + parts[(start + 1) % len(parts)]
        out.append((mask(held), [p for p in places if p not in set(held)]))
    return out


def chain_masks(start: int, bits: int) -> list[tuple[int, int]]:
    """(mask, most differences) of the chains from a start of the first ring that prune, shortest first."""
    parts = ring(list(range(64)), bits)
    chains = [([p for k in range(n) for p in parts[(start + k) % len(parts)]], bits * n // len(parts)) for n in range(1, len(parts) + 1)]
    return [(sum(1 << p for p in held), most) for held, most in chains if most]


def forest(values: np.ndarray, chains: list[tuple[int, int]], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints (indices): rows are compared one against all others."""
    n = len(values)
    if n <= 128 and not np.triu(np.bitwise_count(values[:, None] ^ values) <= bits, 1).any():
        return np.zeros(0, int), np.zeros(0, int)
    todo = np.ones(n, bool)
    left, right = [], []
    tests = [*chains, ((1 << 64) - 1, bits)]
    for root in range(n):  # breadth first: each member is compared once with all that no tree has yet
        if not todo[root]:
            continue
        todo[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(todo)
            if not len(rest):
                break
            differ = values[rest] ^ values[at]
            for m, most in tests:
                if not len(rest):
                    break
                near = np.bitwise_count(differ & np.uint64(m)) <= most
                rest, differ = rest[near], differ[near]
            todo[rest] = False
            left += [at] * len(rest)
            right += rest.tolist()
            queue += rest.tolist()
    return np.array(left, int), np.array(right, int)


def wide_forest(values: np.ndarray, most: int = WIDE) -> tuple[np.ndarray, np.ndarray]:
    """As ``forest``, for rows of ``WORDS`` words and without chains."""
    n = len(values)
    todo, left, right = np.ones(n, bool), [], []
    for root in range(n):
        if not todo[root]:
            continue
        todo[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(todo)
            if not len(rest):
                break
            rest = rest[np.bitwise_count(values[rest] ^ values[at]).sum(1, dtype=np.int64) <= most]
            todo[rest] = False
            left += [at] * len(rest)
            right += rest.tolist()
            queue += rest.tolist()
    return np.array(left, int), np.array(right, int)


def _group_links(groups: DataFrame, bits: int) -> DataFrame:
    """(u, v) links inside groups (start, fps), as forests."""

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            us, vs = [], []
            flat, offsets = b["fps"].flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *b["fps"].value_lengths().to_pylist()])
            for k, start in enumerate(b["start"].to_pylist()):
                values = np.sort(flat[offsets[k] : offsets[k + 1]])
                left, right = forest(values.view(np.uint64), chain_masks(start, bits), bits)
                us.append(values[left])
                vs.append(values[right])
            if us:
                yield {"u": np.concatenate(us), "v": np.concatenate(vs)}

    return map_batches(groups.select("start", "fps"), "u long, v long", work)


def links(distinct: DataFrame, bits: int = 2, limit: int = 4096) -> DataFrame:
    """(u, v) long pairs of a table of distinct fingerprints (fp) that connect all of at most ``bits`` differing bits."""

    def level(rows: DataFrame, keys: list[tuple[int, list[int]]], above: list[str], depth: int) -> DataFrame:
        """Links of ``rows`` (fp, keys above) under each of ``keys``; groups over the limit go a level down.

        Each level leaves fewer bits open; a group with at most 14 open bits holds at most 2 ** 14 fingerprints.
        """
        held = [F.struct(F.lit(k).alias("s"), F.col("fp").bitwiseAND(F.lit(m)).alias("h")) for k, (m, _) in enumerate(keys)]
        names = [*above, f"s{depth}", f"h{depth}"]
        spread = rows.select("fp", *above, F.explode(F.array(*held)).alias("key")).select("fp", *above, F.col("key.s").alias(names[-2]), F.col("key.h").alias(names[-1]))
        sizes = stored(spread.groupBy(*names).agg(F.count("*").alias("n")).filter("n > 1"), "ring-sizes")
        last = max(len(free) for _, free in keys) <= 14
        fits = sizes if last else sizes.filter(F.col("n") <= limit)
        groups = spread.join(fits.drop("n"), names).groupBy(*names).agg(F.collect_list("fp").alias("fps"))
        got = _group_links(groups.select(F.col("s0").alias("start"), "fps"), bits)
        if not last and sizes.filter(F.col("n") > limit).take(1):
            rest = stored(with_group(spread, names, {"n": (F.count("*"), F.sum)}, ["fp"]).filter(F.col("n") > limit).drop("n"), "ring-rest")
            for k, (_, free) in enumerate(keys):
                got = got.union(level(rest.filter(F.col(names[-2]) == k), ring_keys(free, bits), names, depth + 1))
        return got

    return level(distinct.select("fp"), ring_keys(list(range(64)), bits), [], 0)


def wide_links(distinct: DataFrame, limit: int = FULL, most: int = WIDE) -> DataFrame:
    """(u, v) pairs of fp that connect all rows (fp, wide array<long>, bands array<long>) with a common band and at most
    ``most`` differing wide bits. ``distinct`` is read several times: pass a stored table."""

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            us, vs = [], []
            offsets = np.cumsum([0, *b["members"].value_lengths().to_pylist()])
            flat = b["members"].flatten()
            fps = flat.field("fp").to_numpy()
            wide = flat.field("wide").flatten().to_numpy().reshape(-1, WORDS).view(np.uint64)
            for k in range(len(offsets) - 1):
                part = slice(offsets[k], offsets[k + 1])
                order = np.argsort(fps[part], kind="stable")
                left, right = wide_forest(wide[part][order], most)
                us.append(fps[part][order][left])
                vs.append(fps[part][order][right])
            if us:
                yield {"u": np.concatenate(us), "v": np.concatenate(vs)}

    def forests(groups: DataFrame) -> DataFrame:
        return map_batches(groups.select("members"), "u long, v long", work, rows=64)

    names, member = ["band", "key"], F.struct("fp", "wide")
    spread = distinct.select("fp", "wide", F.posexplode("bands").alias("band", "key"))
    sizes = stored(spread.groupBy(*names).agg(F.count("*").alias("n")).filter("n > 1"), "band-sizes")
    fits = spread.join(sizes.filter(F.col("n") <= limit).drop("n"), names)
    got = forests(fits.groupBy(*names).agg(F.collect_list(member).alias("members")))
    if not sizes.filter(F.col("n") > limit).take(1):
        return got
    full = with_group(spread, names, {"n": (F.count("*"), F.sum), "pivot": (F.min(member), F.min)}, ["fp"]).filter(F.col("n") > limit)
    apart = F.aggregate(F.zip_with("wide", "pivot.wide", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda x, y: x + y)
    full = stored(full.select("fp", "wide", *names, "n", F.col("pivot.fp").alias("pivot"), (apart <= most).alias("near")), "band-full")
    got = got.union(full.filter("near and fp <> pivot").select(F.col("fp").alias("u"), F.col("pivot").alias("v")))
    sides = stored(with_group(full, names, {"far": (F.count_if(~F.col("near")), F.sum)}, ["fp"]).filter("far > 0"), "band-sides")
    block = lambda n: F.ceil(F.col(n) / limit)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), block(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("fp"), block(n))
    far = sides.filter("not near").select(*names, "fp", "wide", mine("far").alias("a"), every("n").alias("b"))
    all_of = sides.select(*names, "fp", "wide", every("far").alias("a"), mine("n").alias("b"))
    return got.union(forests(far.union(all_of).groupBy(*names, "a", "b").agg(F.collect_list(member).alias("members"))))


def _with_components(marked: DataFrame, pairs: DataFrame) -> DataFrame:
    """``marked`` (doc_id, fp, ..) with ``class``, the least fingerprint that its own one is linked to."""
    group = components(pairs).select(F.col("node").alias("fp"), "component")
    return marked.join(stored(group, "groups"), "fp", "left").withColumn("class", F.coalesce("component", "fp")).drop("component")


def near_duplicates(docs: DataFrame, size: int = 3, bits: int = 2, limit: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id that can be reached over links, for every row of ``docs``."""
    marked = stored(fingerprints(docs, size), "fingerprints")
    named = _with_components(marked, links(stored(marked.select("fp").distinct(), "distinct"), bits, limit))
    return with_group(named, ["class"], {"component_id": (F.min("doc_id"), F.min)}, ["doc_id", "fp"]).select("doc_id", "fp", "component_id")


def similar_documents(docs: DataFrame, size: int = 5, bits: int = 4, limit: int = 4096) -> DataFrame:
    """(doc_id, digest, first_id, first_digest) of every row: groups of documents of about 0.8 similarity and more.

    Links are fingerprints of at most ``bits`` differing bits, all of which are found, and wide links. A group's first
    document has the least doc_id and, of that, the least digest (16 bytes of SHA-256 of the text); null in a group without ids.
    """
    id_kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {"fp": [], "wide": [], "bands": []}
            for text in b["text"].to_pylist():
                found = shingle_hashes(text, size)
                hashes = np.array(found, np.uint64)
                out["fp"].append(fingerprint(found))
                out["wide"].append(wide_fingerprint(hashes).view(np.int64).tolist())
                out["bands"].append(band_keys(hashes).view(np.int64).tolist() if found else [])
            yield {"doc_id": b["doc_id"], "digest": b["digest"], "fp": np.array(out["fp"], np.uint64).view(np.int64), "wide": out["wide"], "bands": out["bands"]}

    text = plain("text")
    rows = docs.select("doc_id", F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("digest"), text.alias("text"))
    marked = stored(map_batches(rows, f"doc_id {id_kind}, digest binary, fp long, wide array<long>, bands array<long>", work), "fingerprints")
    distinct = stored(marked.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("fp", "wide", "bands")]).drop("digest"), "distinct")
    pairs = links(distinct.select("fp").distinct(), bits, limit).union(wide_links(distinct))
    named = _with_components(marked.select("doc_id", "digest", "fp"), pairs)
    who = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "digest")))
    return with_group(named, ["class"], {"who": (who, F.min)}, ["doc_id", "digest"]).select("doc_id", "digest", F.col("who.doc_id").alias("first_id"), F.col("who.digest").alias("first_digest"))


def near_duplicate_rows(docs: DataFrame) -> DataFrame:
    """The query's columns: fingerprint as 16 lowercase hex digits."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
