"""Best-fit packing of tokenized documents into sequences, after a dominance reduction.

A piece matters to packing only by its length, so the instance is the histogram of lengths: at most ``capacity`` counts,
whatever the corpus. On it the driver runs the Martello-Toth reduction (permanently fix small sets that dominate every
other sequence their largest piece could be in) and best-fit decreasing on the rest, both on whole runs of equal
lengths. The outcome is a short list of placements ("pieces of length l with ranks r to s go to sequences q.., at offset
o"), which every piece looks up by its length and its rank among its equals. Ranks are counted within (length, salt),
so a length that most pieces share is no hot group.

Defined results: a null text is the empty text, whose one piece is the closing id; repeated rows are packed each for
itself; an empty table gives no pieces; only documents longer than the capacity are cut, the remainder first.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, compress, pairwise

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.bpe import UnitCache, read_vocabulary
from tidewatch.llm.common import map_batches, plain, stored

CAPACITY = 2048
PART = 20_000
#: Units in one call of the encoder.
TOGETHER = 512
#: (length, first rank, pieces a sequence, sequences, first sequence, offset)
Placement = tuple[int, int, int, int, int, int]


@lru_cache(1)
def _tokenizer(content: str) -> UnitCache:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(content)
    tok.no_truncation()
    tok.no_padding()
    special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    cuts = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    width = np.zeros(tok.get_vocab_size(), np.int64)  # bytes of each token: its byte-level spelling has one sign a byte
    for name, i in tok.get_vocab().items():
        width[i] = len(name)
    apart = any(c.isspace() for s in special for c in s)  # such a token might arise where two units meet

    def encode(texts: list[str]) -> tuple[np.ndarray, list[int]]:
        ids = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), "<u4"), [0, *accumulate(map(len, ids))]

    def cut(ids: np.ndarray, ends: list[int]) -> list[bytes]:
        flat = ids.tobytes()
        return [flat[4 * a : 4 * b] for a, b in pairwise(ends)]

    def joined(units: list[str]) -> list[bytes]:
        """Units are encoded many at a time; where each one's ids end follows from the bytes of the tokens."""
        ids, _ = encode(["".join(units[i : i + TOGETHER]) for i in range(0, len(units), TOGETHER)])
        have, want = np.cumsum(width[ids]), np.cumsum([len(u) if u.isascii() else len(u.encode()) for u in units])
        at = np.searchsorted(have, want) + 1
        if len(ids) and at[-1] == len(ids) and (have[at - 1] == want).all():
            return cut(ids, [0, *at.tolist()])
        return cut(*encode(units))  # another vocabulary, whose tokens don't end where units do

    def spans(texts: list[str]) -> list[bytes]:
        if apart:
            return cut(*encode(texts))
        is_unit = [len(t) <= UnitCache.LARGEST and t[0] in " \n" and not t[1:2].isspace() and not t[-1].isspace() for t in texts]
        units, others = list(compress(texts, is_unit)), [t for t, u in zip(texts, is_unit, strict=True) if not u]
        of_units, of_others = iter(joined(units) if units else ()), iter(cut(*encode(others)))
        return [next(of_units if u else of_others) for u in is_unit]

    cache = UnitCache(spans, special, cuts)
    cache.top = max([*tok.get_vocab().values(), 0])
    return cache


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids binary]): each document's ids and a closing 0, cut where needed."""
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        cache = _tokenizer(content.value)
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []))}
            for doc_id, raw in zip(b["doc_id"].to_pylist(), cache.encode_batch(b["text"].to_pylist()), strict=True):
                raw += b"\0\0\0\0"
                n = len(raw) // 4
                first = n if n <= capacity else n % capacity or capacity
                for piece, start in enumerate([0, *range(first, n, capacity)]):
                    end = first if not piece else start + capacity
                    part = raw[4 * start : 4 * end]
                    for k, v in zip(out, (doc_id, piece, start, end - start, zlib.crc32(part), part), strict=False):
                        out[k].append(v)
            yield out

    rows = docs.select("doc_id", plain("text").alias("text"))
    return map_batches(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids, work)


class Packing:
    """A histogram of lengths, and the placements made so far."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.left = {n: k for n, k in histogram.items() if k}
        self.capacity, self.sequences = capacity, 0
        self.rank = dict.fromkeys(self.left, 0)
        self.placements: list[Placement] = []

    def put(self, length: int, each: int, sequences: int, first: int, offset: int) -> None:
        self.placements.append((length, self.rank[length], each, sequences, first, offset))
        self.rank[length] += each * sequences
        self.left[length] -= each * sequences
        if not self.left[length]:
            del self.left[length]

    def fix(self, lengths: list[int], times: int) -> None:
        """Close ``times`` sequences that hold just these lengths."""
        offset = 0
        for n in lengths:
            self.put(n, 1, times, self.sequences, offset)
            offset += n
        self.sequences += times

    def reduce(self) -> int:
        """Fix dominating sets until none is found; returns the number of sequences fixed."""
        before, changed = self.sequences, True
        while changed and self.left:
            changed = False
            for large in sorted(self.left, reverse=True):
                while large in self.left and (found := self.dominating(large)):
                    self.fix(*found)
                    changed = True
        return self.sequences - before

    def dominating(self, large: int) -> tuple[list[int], int] | None:
        left, room = self.left, self.capacity - large
        count = lambda n: left[n] - (n == large)  # noqa: E731  of the others
        others = sorted(n for n in left if n <= room and count(n))
        if not others:
            return [large], left[large] if large > room else 1
        # what follows stays true while copies of the two are left, since taking pieces away only narrows the choice
        best = others[-1]
        times = left[large] // 2 if best == large else min(left[large], left[best])
        if best == room:  # a perfect pair: whatever else shares a sequence with the large one fits in its partner's place
            return [large, best], times
        least: list[int] = []
        for n in others:
            least += [n] * min(3, count(n))
            if len(least) >= 3:
                break
        if len(least) < 2 or least[0] + least[1] > room:  # one partner at most: the largest dominates
            return [large, best], times
        if len(least) < 3 or sum(least[:3]) > room:  # two partners at most: if none weighs more than the best one
            low, high, most = 0, len(others) - 1, 0
            while low <= high:
                pair = others[low] + others[high]
                if pair > room:
                    high -= 1
                else:
                    if low < high or count(others[low]) > 1:
                        most = max(most, pair)
                    low += 1
            if most <= best:
                return [large, best], times
        return None

    def best_fit(self) -> None:
        """Best-fit decreasing: each piece goes to the fullest sequence that still has room for it."""
        open_runs: dict[int, list[tuple[int, int]]] = {}  # room left: [(first sequence, sequences)]
        rooms: list[int] = []

        def add(room: int, first: int, sequences: int) -> None:
            if room and sequences:
                if room not in open_runs:
                    bisect.insort(rooms, room)
                open_runs.setdefault(room, []).append((first, sequences))

        for length in sorted(self.left, reverse=True):
            while n := self.left.get(length, 0):
                at = bisect.bisect_left(rooms, length)
                if at == len(rooms):
                    room, need = self.capacity, -(-n // (self.capacity // length))
                    first, sequences = self.sequences, need
                    self.sequences += need
                else:
                    room = rooms[at]
                    first, sequences = open_runs[room].pop()
                    if not open_runs[room]:
                        del open_runs[room], rooms[at]
                each, offset = room // length, self.capacity - room
                full = min(sequences, n // each)
                if full:
                    self.put(length, each, full, first, offset)
                    add(room - each * length, first, full)
                rest = self.left.get(length, 0)
                if full < sequences and rest:
                    self.put(length, rest, 1, first + full, offset)
                    add(room - rest * length, first + full, 1)
                    full += 1
                add(room, first + full, sequences - full)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Packing:
    packing = Packing(histogram, capacity)
    packing.reduce()
    packing.best_fit()
    return packing


def pack(pieces: DataFrame, capacity: int = CAPACITY, part: int = PART) -> DataFrame:
    """Add (sequence_id, offset) to rows with (doc_id, piece, start, length). ``pieces`` is read twice: pass a stored table.

    The histogram, ``capacity`` rows at most, is all that reaches the driver; what it sends back are its placements, runs of
    equal lengths, whose number depends on the lengths that occur and not on the pieces. Columns named ``__*`` are our own.
    """
    spark = pieces.sparkSession
    histogram = {r["__length"]: r["n"] for r in pieces.groupBy(F.col("length").alias("__length")).agg(F.count("*").alias("n")).collect()}
    runs = plan(histogram, capacity).placements
    parts = spark.createDataFrame([(n, -(-k // part)) for n, k in histogram.items()], "__length long, __parts long")  # capacity rows at most
    mine = pieces.withColumn("__length", F.col("length").cast("long")).join(F.broadcast(parts), "__length")
    mine = mine.withColumn("__part", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.col("__parts"))).drop("__parts")
    group = ["__length", "__part"]
    sizes = mine.groupBy(*group).agg(F.count("*").alias("__n"))
    end = F.sum("__n").over(Window.partitionBy("__length").orderBy("__part"))
    ranges = sizes.select(*group, (end - F.col("__n")).alias("__before"), end.alias("__end"))
    placed = spark.createDataFrame(runs, "__length long, __first long, __each long, __sequences long, __sequence long, __at long")
    last = F.col("__first") + F.col("__each") * F.col("__sequences") - 1
    meeting = ranges.join(placed, "__length").filter((F.col("__first") < F.col("__end")) & (last >= F.col("__before")))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("doc_id", "piece", "start")) - 1
    found = mine.withColumn("__rank", rank).join(meeting, group).withColumn("__in", F.col("__before") + F.col("__rank") - F.col("__first"))
    found = found.filter(F.col("__in").between(0, F.col("__each") * F.col("__sequences") - 1))
    return found.select(
        *[pieces[c] for c in pieces.columns],
        (F.col("__sequence") + F.floor(F.col("__in") / F.col("__each"))).alias("sequence_id"),
        (F.col("__at") + F.pmod("__in", "__each") * F.col("__length")).alias("offset"),
    )


def packed_documents(docs: DataFrame) -> DataFrame:
    """The pieces of every document with their places; the pieces are stored first, so texts are tokenized once."""
    out = pack(stored(token_pieces(docs), "pieces"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
