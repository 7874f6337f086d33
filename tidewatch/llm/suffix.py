"""Suffix-array deduplication: remove every byte of a string of ``length`` bytes that also starts anywhere else.

Only suffixes that can matter are sorted. Every string of ``length`` bytes holds an anchor, the least of its ``gram``-byte
hashes, and equal strings hold equal anchors at equal places. So the occurrences of each repeated anchor form a small
suffix array of their own: their right contexts are sorted from the anchor on, and their left contexts backwards, by
deep-shallow sorting (multikey quicksort, eight bytes a symbol, to a shallow depth; blind tries for the groups that still
tie). Adjacent common prefixes then tell, for each number o of bytes taken to the left, which occurrences agree in
[-o, length - o): those whose left class at depth o and right class at depth length - o are both shared.

Texts are compared once for each distinct text: copies of a text of ``length`` bytes or more are covered whole. What
repeats within a text with the same bytes all around is covered there, and one occurrence goes on. Anchors
with more than ``many`` occurrences are first collapsed: occurrences with the same bytes all around repeat each other, so they
are covered, and one of them goes on. Where more than ``cap`` different ones remain, they are never gathered: every window over
them becomes a row keyed by its own digest, and a count over keys takes the place of the sort. Both counts deal hot keys
into parts.

The unit is a byte or, with ``words``, a word: then a text is the row of its words' 32-bit checksums, strings are runs of
words, and white space doesn't matter.

Defined results: a null text is the empty text; shorter texts lose nothing; repeated rows are copies of each other; an
empty table gives no rows; a text may have any length.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import delete_path, map_batches, plain, remember, shared_folder, stored, with_group

LENGTH, GRAM, MANY, CAP = 400, 64, 30_000, 30_000  # 30,000 contexts are 22 MB
#: Words of a gram, and bytes of a word's checksum.
GRAM_WORDS, SYMBOL = 16, 4
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
CHUNK = 1 << 19
SHALLOW = 12  # symbols of eight bytes
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    held = next((v for k, v in _tables.items() if k >= n), None)
    if held is None:
        size = max(n, CHUNK + 4096)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        _tables.clear()
        held = _tables[size] = both[0], both[1]
    return held


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place on."""
    n = len(b)
    power, inverse = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[b] * power[:n], out=sums[1:])
    h = sums[gram:] - sums[: n - gram + 1]
    h *= inverse[: len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by running minima in both directions within blocks."""
    n = len(values) - width + 1
    full = -(-len(values) // width) * width
    padded = np.full(full, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def word_symbols(text: str) -> bytes:
    """Four bytes for each word."""
    return np.fromiter(map(zlib.crc32, text.encode().split()), ">u4").tobytes()


def word_places(raw: bytes) -> list[int]:
    """Where each word starts, and the end of the text."""
    return [*(m.start() for m in WORD.finditer(raw)), len(raw)]


def anchors(raws: list[bytes], length: int, gram: int, step: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the places and hashes of its anchors. Texts are read in chunks, so memory is bounded."""
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in raws]
    parts: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        b = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        if len(b) >= length:
            h = gram_hashes(b, gram)[::step]
            low = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
            flag = np.zeros(len(b), bool)
            flag[(window_minima(low, (length - gram) // step + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64) * step] = True
            places = np.flatnonzero(flag)
            ends = np.cumsum([len(p) for _, _, p in parts])
            part = np.searchsorted(ends, places, "right")
            inside = places + gram <= ends[part]
            places, part = places[inside], part[inside]
            cut = np.searchsorted(part, np.arange(len(parts) + 1))
            for k, (i, offset, p) in enumerate(parts):
                mine = places[cut[k] : cut[k + 1]]
                if len(mine) and len(p) >= length:
                    found[i].append((mine - (ends[k] - len(p)) + offset, h[mine // step]))
        parts.clear()

    held = 0
    for i, raw in enumerate(raws):
        if len(raw) < length:
            continue
        for at in range(0, max(1, len(raw) - length + 1), CHUNK):
            piece = raw[at : at + CHUNK + length - step]
            if held + len(piece) > CHUNK + length:
                flush()
                held = 0
            parts.append((i, at, piece))
            held += len(piece)
    flush()
    out = []
    for got in found:
        places = np.concatenate([p for p, _ in got]) if got else np.zeros(0, np.int64)
        hashes = np.concatenate([h for _, h in got]) if got else np.zeros(0, np.uint64)
        places, first = np.unique(places, return_index=True)
        out.append((places, hashes[first]))
    return out


def within_text(raw: bytes, places: np.ndarray, hashes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Occurrences to look for elsewhere, and the pieces that repeat within the text itself.

    Occurrences of one anchor with the same bytes all around repeat each other in every window over them; so they are
    covered, and the first speaks for all. Periodic texts, which have an anchor in each period, come down to a few.
    """
    reach = length - gram
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return places, hashes, []
    repeated = np.zeros(len(places), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    keep, spans, first = np.ones(len(places), bool), [], {}
    for i in np.flatnonzero(repeated):
        p = int(places[i])
        if p < reach or p + length > len(raw):
            continue
        whole = raw[p - reach : p + length]
        if whole in first:
            keep[i] = False
            spans += [(p - reach, p + length), (first[whole] - reach, first[whole] + length)]
        else:
            first[whole] = p
    return places[keep], hashes[keep], merge(spans)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Indices in sorted order. Inner nodes are [depth, {symbol: child}], leaves lists of equal strings' indices.

    A descent looks at one symbol a node; the common prefix with whatever leaf it meets then tells where the string
    really leaves the trie.
    """
    root: list | None = None
    inner = lambda node: len(node) == 2 and isinstance(node[1], dict)
    symbol = lambda s, d: s[d] if d < len(s) else -1
    for i, s in enumerate(strings):
        if root is None:
            root = [i]
            continue
        node = root
        while inner(node):
            node = node[1].get(symbol(s, node[0])) or next(iter(node[1].values()))
        other = strings[node[0]]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            node.append(i)
            continue
        above, node = None, root
        while inner(node) and node[0] < depth:
            above, node = node, node[1][symbol(s, node[0])]
        if inner(node) and node[0] == depth:
            node[1][symbol(s, depth)] = [i]
            continue
        branch = [depth, {symbol(other, depth): node, symbol(s, depth): [i]}]
        if above is None:
            root = branch
        else:
            above[1][symbol(s, above[0])] = branch
    out, stack = [], [root] if root else []
    while stack:
        node = stack.pop()
        if inner(node):
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow(rows: np.ndarray, sizes: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sort byte rows within groups: (order, common prefix with the row before, -1 at a group's start)."""
    n, width = rows.shape
    order = np.argsort(group, kind="stable")
    starts = np.ones(n, bool)
    starts[1:] = group[order][1:] != group[order][:-1]
    first_of_group = starts.copy()
    symbols = np.ascontiguousarray(rows[:, : width // 8 * 8]).view(">u8")

    def tied() -> np.ndarray:
        alone = starts & np.append(starts[1:], True)
        return np.flatnonzero(~alone)

    for depth in range(min(shallow, symbols.shape[1])):
        at = tied()
        if not len(at):
            break
        key = symbols[order[at], depth].astype(np.uint64)
        segment = np.cumsum(starts)[at]
        again = np.lexsort((key, segment))
        order[at] = order[at][again]
        key = key[again]
        starts[at[1:]] |= key[1:] != key[:-1]
    at = tied()
    if len(at):
        edge = np.flatnonzero(starts[at])
        for a, b in zip(edge, np.append(edge[1:], len(at)), strict=True):
            part = order[at[a:b]]
            order[at[a:b]] = part[blind_trie_order([rows[r, : sizes[r]].tobytes() for r in part])]
    common = np.full(n, -1, np.int64)
    for a in range(1, n, 16384):
        b = min(n, a + 16384)
        x, y = order[a - 1 : b - 1], order[a:b]
        differ = rows[x] != rows[y]
        prefix = np.where(differ.any(1), differ.argmax(1), width)
        common[a:b] = np.minimum(prefix, np.minimum(sizes[x], sizes[y]))
    common[first_of_group] = -1
    return order, common


def covered(group: np.ndarray, left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray, length: int, gram: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence the least and the greatest o for which [-o, length - o) is repeated in its group; -1: none."""
    n = len(group)
    least, greatest = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    r_order, r_common = deep_shallow(right, right_size, group)
    l_order, l_common = deep_shallow(left, left_size, group)

    def best(order: np.ndarray, common: np.ndarray) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[order] = np.maximum(common, np.append(common[1:], -1))
        return out

    hope = best(r_order, r_common) + best(l_order, l_common) >= length
    if not hope.any():
        return least, greatest
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    hopeful = np.flatnonzero(hope)
    for o in range(0, length - gram + 1, step):
        r_class[r_order] = np.cumsum(r_common < length - o)
        l_class[l_order] = np.cumsum(l_common < o)
        key = l_class[hopeful] * (n + 1) + r_class[hopeful]
        again = np.argsort(key)
        same = key[again[1:]] == key[again[:-1]]
        shared = np.zeros(len(key), bool)
        shared[again[1:][same]] = True
        shared[again[:-1][same]] = True
        got = hopeful[shared]
        greatest[got] = o
        least[got[least[got] < 0]] = o
    return least, greatest


def _matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    wide = -(-width // 8) * 8
    out = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in parts), np.uint8).reshape(-1, wide)
    return out, np.array([len(p) for p in parts])


def _spans_of(rows: list[tuple[int, bytes, int, int, bytes]], length: int, gram: int, step: int) -> dict:
    """Rows (hash, text key, place, bytes to the left, context) of whole groups to (key, start, end) columns."""
    reach = length - gram
    _, group = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)
    left, left_size = _matrix([r[4][: r[3]][::-1] for r in rows], reach)
    right, right_size = _matrix([r[4][r[3] :] for r in rows], length)
    least, greatest = covered(group, left, left_size, right, right_size, length, gram, step)
    got = np.flatnonzero(greatest >= 0)
    place = np.array([r[2] for r in rows], np.int64)[got]
    return {"key": pa.array([rows[i][1] for i in got], pa.binary()), "start": place - greatest[got], "end": place - least[got] + length}


def repeat_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, cap: int = CAP, many: int = MANY, chunk: int = 25_000, words: bool = False) -> DataFrame:
    """(key, start, end): overlapping pieces whose union is all that repeats. ``texts``: stored (key, text), keys distinct.

    With ``words``, length, gram, start and end count bytes of ``word_symbols``.
    """
    reach, step = length - gram, SYMBOL if words else 1
    read = word_symbols if words else str.encode
    span = "array<struct<start: bigint, end: bigint>>"

    def find(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            raws = [read(t) for t in b["text"].to_pylist()]
            got = [within_text(raw, p, h, length, gram) for raw, (p, h) in zip(raws, anchors(raws, length, gram, step), strict=True)]
            yield {
                "key": b["key"], "place": pa.array([p.tolist() for p, _, _ in got], pa.list_(pa.int64())), "hash": pa.array([h.view(np.int64).tolist() for _, h, _ in got], pa.list_(pa.int64())),
                "own": pa.array([[{"start": a, "end": z} for a, z in own] for _, _, own in got], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }

    found = stored(map_batches(texts.select("key", "text"), f"key binary, place array<long>, hash array<long>, own {span}", find), "anchors")
    own = found.filter(F.size("own") > 0).select("key", F.inline("own"))
    each = found.select("key", F.explode(F.arrays_zip("place", "hash")).alias("a")).select("key", F.col("a.place").alias("place"), F.col("a.hash").alias("hash"))
    repeated = stored(each.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1"), "repeated")
    kept = each.join(repeated, "hash")

    def at(rows: DataFrame) -> DataFrame:
        """``texts`` with the places asked for."""
        return texts.join(rows.groupBy("key").agg(F.collect_list(F.struct("place", "hash")).alias("at")).hint("shuffle_hash"), "key").select("key", "text", "at")

    def contexts(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {"hash": [], "key": [], "place": [], "before": [], "context": []}
            for key, text, places in zip(b["key"].to_pylist(), b["text"].to_pylist(), b["at"].to_pylist(), strict=True):
                raw = read(text)
                for x in places:
                    p = x["place"]
                    low = max(0, p - reach)
                    for k, v in zip(out, (x["hash"], key, p, p - low, raw[low : p + length]), strict=True):
                        out[k].append(v)
                    if len(out["hash"]) > 5000:
                        yield out
                        out = {k: [] for k in out}
            yield out

    def sort_groups(batches: Iterator[dict]) -> Iterator[dict]:
        held: list[tuple] = []
        for b in batches:
            held += zip(*(b[k].to_pylist() for k in ("hash", "key", "place", "before", "context")), strict=True)
            if len(held) >= chunk:
                last = next((i for i in range(len(held) - 1, 0, -1) if held[i][0] != held[i - 1][0]), 0)
                if last:
                    yield _spans_of(held[:last], length, gram, step)
                    held = held[last:]
        if held:
            yield _spans_of(held, length, gram, step)

    def sorted_spans(places: DataFrame) -> DataFrame:
        rows = map_batches(at(places), "hash long, key binary, place long, before long, context binary", contexts)
        return map_batches(rows.repartition("hash").sortWithinPartitions("hash"), "key binary, start long, end long", sort_groups)

    spans = own.unionByName(sorted_spans(kept.filter(F.col("n") <= many)))
    if not repeated.filter(F.col("n") > many).take(1):
        return spans

    def digests(batches: Iterator[dict]) -> Iterator[dict]:
        for c in contexts(batches):
            parts = zip(c["hash"], c["before"], c["context"], strict=True)
            yield {"hash": c["hash"], "key": c["key"], "place": c["place"], "low": [p - b for p, b in zip(c["place"], c["before"], strict=True)], "size": [len(x) for x in c["context"]], "around": [hashlib.blake2b(x, digest_size=16, salt=h.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little")).digest() for h, b, x in parts]}

    occurrences = stored(map_batches(at(kept.filter(F.col("n") > many)), "hash long, key binary, place long, low long, size long, around binary", digests), "occurrences")
    who = F.struct("key", "place")
    seen = stored(with_group(occurrences, ["around"], {"copies": (F.count("*"), F.sum), "first": (F.min(who), F.min)}, ["key", "place"]), "collapsed")
    spans = spans.union(seen.filter((F.col("copies") > 1) & (F.col("size") >= length)).select("key", F.col("low").alias("start"), (F.col("low") + F.col("size")).alias("end")))
    left = stored(with_group(seen.filter(F.col("first") == who).select("key", "place", "hash"), ["hash"], {"n": (F.count("*"), F.sum)}, ["key", "place"]), "distinct-contexts")
    spans = spans.union(sorted_spans(left.filter(F.col("n").between(2, cap))))
    if not left.filter(F.col("n") > cap).take(1):
        return spans

    def all_windows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for key, text, places in zip(b["key"].to_pylist(), b["text"].to_pylist(), b["at"].to_pylist(), strict=True):
                raw = read(text)
                starts = sorted({s for x in places for s in range(max(0, x["place"] - reach), min(x["place"], len(raw) - length) + 1, step)})
                for k in range(0, len(starts), 20_000):
                    part = starts[k : k + 20_000]
                    yield {"window": pa.array([hashlib.blake2b(raw[s : s + length], digest_size=16).digest() for s in part], pa.binary()), "key": pa.array([key] * len(part), pa.binary()), "start": part}

    every = stored(map_batches(at(left.filter(F.col("n") > cap)), "window binary, key binary, start long", all_windows), "windows")
    twice = with_group(every, ["window"], {"n": (F.count("*"), F.sum)}, ["key", "start"]).filter("n > 1")
    return spans.union(twice.select("key", "start", (F.col("start") + length).alias("end")))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _distinct_texts(rows: DataFrame, least: int) -> DataFrame:
    """(key, text, copies) of the distinct texts of at least so many bytes, as a table bucketed by key.

    Joins on the key then move only their other side.
    """
    spark = rows.sparkSession
    name = f"texts_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    found = rows.filter(F.octet_length("text") >= least).groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def drop() -> None:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        finally:
            delete_path(spark, path)

    remember(path, drop)
    found.write.bucketBy(parts, "key").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, cap: int = CAP, keep: list[str] | None = None, text_col: str = "text", with_text: bool = False, words: bool = False, many: int = MANY
) -> DataFrame:
    """``keep`` columns, n_bytes, spans (array of start, end), kept_sha256 of every row; with_text: kept_text as well.

    ``kept_text`` leaves out the broken characters that a cut inside a character may leave. With ``words``, length and gram
    are numbers of words, and a span reaches from a word to the start of the first word that stays.
    """
    keep = keep or ["doc_id"]
    text = plain(text_col)
    digest = F.unhex(F.sha2(text, 256))
    rows = docs.select(F.substring(digest, 1, 16).alias("key"), text.alias("text"))
    texts = _distinct_texts(rows, 2 * length - 1 if words else length)
    spans = repeat_spans(texts.select("key", "text"), length * SYMBOL if words else length, gram * SYMBOL if words else gram, cap, many, words=words)
    gathered = spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("pieces"))
    kind = "key binary, spans array<struct<start: bigint, end: bigint>>, kept_sha256 string" + ", kept_text string" * with_text

    def cut(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {"key": [], "spans": [], "kept_sha256": []} | ({"kept_text": []} if with_text else {})
            for key, value, copies, pieces in zip(b["key"].to_pylist(), b["text"].to_pylist(), b["copies"].to_pylist(), b["pieces"].to_pylist(), strict=True):
                if copies == 1 and not pieces:
                    continue
                raw = value.encode()
                gone = merge([(p["start"], p["end"]) for p in pieces or []])
                if words:
                    places = word_places(raw)
                    gone = [(places[a // SYMBOL], places[z // SYMBOL]) for a, z in gone]
                if copies > 1 and (not words or len(places) > length):
                    gone = [(0, len(raw))]
                if not gone:
                    continue
                edges = [0, *(x for g in gone for x in g), len(raw)]
                left = b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                out["key"].append(key)
                out["spans"].append([{"start": a, "end": z} for a, z in gone])
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                if with_text:
                    out["kept_text"].append(left.decode("utf-8", "ignore"))
            if out["key"]:
                yield out

    found = map_batches(texts.join(gathered.hint("shuffle_hash"), "key", "left").select("key", "text", "copies", "pieces"), kind, cut)
    mine = docs.select(*keep, F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("__digest"), F.substring(digest, 1, 16).alias("__key"), *([text.alias("__text")] if with_text else []))
    out = mine.join(stored(found, "cuts").withColumnRenamed("key", "__key"), "__key", "left")
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    extra = [F.coalesce("kept_text", "__text").alias("kept_text")] if with_text else []
    return out.select(*keep, "n_bytes", F.coalesce("spans", none).alias("spans"), F.coalesce("kept_sha256", F.lower(F.hex("__digest"))).alias("kept_sha256"), *extra)


def repeat_rows(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return remove_repeats(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
