"""Token files: the ids of documents in ascending order of doc_id, with Elias-Fano encoded boundaries.

A file holds one concatenated array of ids (16 bits each where the vocabulary allows, else 32) and two Elias-Fano
sequences: where each document ends in the array, and the documents' ids. A sequence of n ascending numbers below u takes
about 2 + log2(u / n) bits a number: the low bits as they are, the high bits in unary, and a 32-bit select sample every 256
numbers. ``select`` goes to the sample and counts ones from there, so any document is found without decoding the others
and without a table of 64-bit offsets.

Spark orders the rows by ranges of (doc_id, digest of the text, place in the input), so an id that many rows share is spread; each task
encodes its range in order and writes files of at most ``ids_in_file`` ids (one document at least). A repeated or lost task
writes files of other names; the manifest, a stored table of one row a file, names those that count. Reading deals the
files to tasks, which read them in blocks of documents. The driver sees one number for each range.

Files go to the cluster's shared folder through Arrow's file systems (local, HDFS, object stores).

Defined results: a null text is the empty text, of which only the closing id is stored; rows without doc_id come first;
rows with equal doc_id are ordered by the text's digest, equal rows are stored each; an empty table gives no file and no
rows. ``doc_id`` is a whole number; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.bpe import read_vocabulary
from tidewatch.llm.common import delete_path, map_batches, plain, remember, shared_folder, stored
from tidewatch.llm.packing import _tokenizer

END_ID = 2
IDS_IN_FILE, DOCS_IN_FILE = 1 << 24, 1 << 20
#: Ids and documents of a block when files are read.
BLOCK_IDS, BLOCK_DOCS = 1 << 20, 1 << 12
#: Name and version; width of an id in bytes; documents; ids; documents without doc_id; least doc_id; bytes of both sequences.
HEADER = struct.Struct("<8sQQQQqQQ")
MAGIC = b"TWTOKEN1"


class EliasFano:
    """An ascending sequence of numbers below 2^63, read from a buffer that ``encode`` made."""

    HEAD, SAMPLE, PART = struct.Struct("<QQQ"), 256, 1 << 16

    def __init__(self, data: memoryview) -> None:
        self.n, self.low_bits, low_bytes = self.HEAD.unpack_from(data)
        samples = -(-self.n // self.SAMPLE)
        at = self.HEAD.size
        self.low = np.frombuffer(data, np.uint8, low_bytes, at)
        self.samples = np.frombuffer(data, "<u4", samples, at + low_bytes)
        self.high = np.frombuffer(data, np.uint8, -1, at + low_bytes + 4 * samples)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        n = len(values)
        if not n:
            return cls.HEAD.pack(0, 0, 0)
        values = values.astype("<u8")
        bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        low = [np.packbits(np.unpackbits(values[i : i + cls.PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little") for i in range(0, n, cls.PART)]
        low = b"".join(p.tobytes() for p in low)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1, np.uint8)
        unary[places] = 1
        return cls.HEAD.pack(n, bits, len(low)) + low + places[:: cls.SAMPLE].astype("<u4").tobytes() + np.packbits(unary, bitorder="little").tobytes()

    def values(self, first: int, count: int) -> np.ndarray:
        """Numbers first to first + count, by selecting the ones in the stretch of the unary part that holds them."""
        count = min(count, self.n - first)
        if count <= 0:
            return np.zeros(0, np.int64)
        sample, after = first // self.SAMPLE, -(-(first + count) // self.SAMPLE)
        start = int(self.samples[sample])
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[start // 8 : end // 8 + 1], bitorder="little")) + start // 8 * 8
        ones = ones[np.searchsorted(ones, start) :][first - sample * self.SAMPLE :][:count]
        high = ones - np.arange(first, first + count)
        bits = self.low_bits
        if not bits:
            return high
        a, b = first * bits, (first + count) * bits
        own = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 :][: count * bits].reshape(count, bits)
        wide = np.zeros((count, 64), np.uint8)
        wide[:, :bits] = own
        return (high << bits) | np.packbits(wide, axis=1, bitorder="little").view("<i8").ravel()

    def select(self, i: int) -> int:
        return int(self.values(i, 1)[0])

    def first_at_least(self, value: int) -> int:
        """Index of the first number that isn't less; n if there is none. Two numbers a step are decoded."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.select(middle) < value else (low, middle)
        return low


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[len("file:") :]
    return fs.FileSystem.from_uri(path)


def write_file(path: str, doc_ids: list[int | None], ends: np.ndarray, ids: list[bytes], width: int) -> int:
    """Write one file; ``ids`` are little-endian arrays of ``width`` bytes an id. Returns its size in bytes."""
    known = [i for i in doc_ids if i is not None]
    base = known[0] if known else 0
    bounds = EliasFano.encode(ends)
    names = EliasFano.encode(np.array([i - base for i in known], np.uint64))
    head = HEADER.pack(MAGIC, width, len(doc_ids), int(ends[-1]), len(doc_ids) - len(known), base, len(bounds), len(names))
    where, name = _open(path)
    with where.open_output_stream(name) as out:
        out.write(head)
        for part in ids:
            out.write(part)
        out.write(bounds)
        out.write(names)
    return len(head) + width * int(ends[-1]) + len(bounds) + len(names)


class TokenFile:
    """Random access to one file: its boundary sequences are in memory, ids are read where they stand."""

    def __init__(self, path: str) -> None:
        where, name = _open(path)
        self.file = where.open_input_file(name)
        magic, self.width, self.docs, self.ids, self.nulls, self.base, bounds, names = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        tail = memoryview(self.file.read_at(bounds + names, HEADER.size + self.width * self.ids))
        self.ends, self.names = EliasFano(tail[:bounds]), EliasFano(tail[bounds:])

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def bounds(self, first: int, count: int) -> np.ndarray:
        """Where documents first to first + count begin, and where the last one ends."""
        before = self.ends.select(first - 1) if first else 0
        return np.concatenate([[before], self.ends.values(first, count)])

    def doc_ids(self, first: int, count: int) -> list[int | None]:
        none = max(0, min(self.nulls - first, count))
        named = self.names.values(max(0, first - self.nulls), count - none)
        return [None] * none + (named + np.int64(self.base)).tolist()

    def read_ids(self, start: int, end: int) -> np.ndarray:
        """Ids of the places start to end, as little-endian unsigned 32-bit integers."""
        return np.frombuffer(self.file.read_at(self.width * (end - start), HEADER.size + self.width * start), f"<u{self.width}").astype("<u4")

    def document(self, index: int) -> np.ndarray:
        start, end = self.bounds(index, 1).tolist()
        return self.read_ids(start, end)

    def find(self, doc_id: int) -> int | None:
        """Index of the first document with this doc_id."""
        i = self.names.first_at_least(doc_id - self.base) if doc_id >= self.base else self.names.n
        return self.nulls + i if i < self.names.n and self.names.select(i) == doc_id - self.base else None


def write_token_files(docs: DataFrame, end_id: int = END_ID, vocabulary: str | None = None, ids_in_file: int = IDS_IN_FILE, folder: str | None = None) -> DataFrame:
    """Write all documents; returns the manifest (part, file, path, docs, ids, bytes, before): ``before`` counts the ids of earlier files of the part."""
    spark = docs.sparkSession
    if folder is None:
        folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
        remember(folder, lambda: delete_path(spark, folder))
    content = spark.sparkContext.broadcast(read_vocabulary(vocabulary))  # one vocabulary file

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        from pyspark import TaskContext

        cache, part, made = _tokenizer(content.value), TaskContext.get().partitionId(), 0
        width = 2 if max(cache.top, end_id) < 1 << 16 else 4
        closing = np.array([end_id], "<u4").tobytes()
        names: list[int | None] = []
        sizes: list[int] = []
        held: list[bytes] = []
        count = before = 0
        where, name = _open(folder)
        where.create_dir(name, recursive=True)

        def flush() -> dict:
            nonlocal names, sizes, held, count, before, made
            path = f"{folder}/{part:06d}-{made:05d}-{uuid.uuid4().hex}.tok"
            size = write_file(path, names, np.array(sizes).cumsum(), held, width)
            row = {"part": [part], "file": [made], "path": [path], "docs": [len(names)], "ids": [count], "bytes": [size], "before": [before]}
            names, sizes, held, before, made, count = [], [], [], before + count, made + 1, 0
            return row

        for b in batches:
            for doc_id, raw in zip(b["doc_id"].to_pylist(), cache.encode_batch(b["text"].to_pylist()), strict=True):
                n = len(raw) // 4 + 1
                if names and (count + n > ids_in_file or len(names) == DOCS_IN_FILE):
                    yield flush()
                held.append(np.frombuffer(raw + closing, "<u4").astype(f"<u{width}").tobytes())
                names.append(doc_id)
                sizes.append(n)
                count += n
        if names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain("text").alias("text"))
    order = [F.asc_nulls_first("doc_id"), "__digest", "__place"]
    rows = rows.withColumns({"__digest": F.xxhash64("text"), "__place": F.monotonically_increasing_id()}).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return stored(map_batches(rows.select("doc_id", "text"), "part int, file int, path string, docs long, ids long, bytes long, before long", work), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a stored manifest.

    ``start`` counts over all files. The ids of each range, one number a partition of the writer, are added up on the driver.
    """
    spark = manifest.sparkSession
    parts = sorted(map(tuple, manifest.groupBy("part").agg(F.sum("ids"), F.count("*")).collect()))
    starts = dict(zip([p[0] for p in parts], accumulate([0, *[p[1] for p in parts]]), strict=False))
    files = sum(p[2] for p in parts)

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for path, part, before in zip(b["path"].to_pylist(), b["part"].to_pylist(), b["before"].to_pylist(), strict=True):
                with TokenFile(path) as f:
                    yield from _documents(f, starts[part] + before)

    dealt = manifest.select("path", "part", "before").repartition(max(1, min(files, 10_000)))
    return map_batches(dealt, "doc_id long, start long, n_tokens long, ids_crc32 long", work)


def _documents(f: TokenFile, start: int) -> Iterator[dict]:
    """The documents of a file in blocks; a long document's ids are read in pieces."""
    for first in range(0, f.docs, BLOCK_DOCS):
        count = min(BLOCK_DOCS, f.docs - first)
        bounds = f.bounds(first, count)
        sums: list[int] = []
        at = 0
        while at < count:
            upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK_IDS, "right")) - 1)
            if bounds[upto] - bounds[at] > BLOCK_IDS:  # one long document
                crc = 0
                for a in range(int(bounds[at]), int(bounds[upto]), BLOCK_IDS):
                    crc = zlib.crc32(f.read_ids(a, min(a + BLOCK_IDS, int(bounds[upto]))), crc)
                sums.append(crc)
            else:
                ids = memoryview(f.read_ids(int(bounds[at]), int(bounds[upto])))
                own = (bounds[at : upto + 1] - bounds[at]).tolist()
                sums += [zlib.crc32(ids[a:b]) for a, b in zip(own, own[1:], strict=False)]
            at = upto
        yield {"doc_id": pa.array(f.doc_ids(first, count), pa.int64()), "start": bounds[:-1] + start, "n_tokens": np.diff(bounds), "ids_crc32": sums}


def token_file_rows(docs: DataFrame) -> DataFrame:
    return read_token_files(write_token_files(docs))
