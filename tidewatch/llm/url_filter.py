"""URL filters by a sorted digest array.

A rule is (host, path, verdict). Its key is the 64-bit xxhash of ``host + path``. The sorted keys, with the row of each
rule's strings, are one array file that Spark ships to every executor (``addFile``) and each worker memory-maps, so all
workers of a host share its pages. A url gives one probe for each pair of (host suffix at a label border, prefix of the
path as long as some rule's path); a whole batch is probed at once with a vectorised binary search, and every hit is
confirmed against the stored strings, so colliding digests never decide.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; a url that no rule fits
gets ``default``; equal rules: the last stated one holds; an empty rule list is allowed; repeated rows and extra
columns don't matter, since each row is judged alone.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from tidewatch.llm.common import map_batches

#: The production rules: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
ENTRY = np.dtype([("key", "<u8"), ("start", "<i8"), ("host", "<i4"), ("path", "<i4"), ("block", "?")])
_UPPER = {i: i + 32 for i in range(65, 91)}
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_open: dict[str, tuple] = {}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, both empty without ``://``."""
    m = _PARTS.search(url) if url else None
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def build_index(rules: Iterable[tuple[str, str, str]], folder: str | None = None, digest=xxhash.xxh64_intdigest) -> str:
    """Write the sorted digest array and its strings; returns the file's path. Equal digests stay side by side."""
    held = {(h.translate(_UPPER), p): v for h, p, v in rules}
    rows, blob = [], bytearray()
    for (host, path), verdict in held.items():
        h, p = host.encode(), path.encode()
        rows.append((digest(h + p), len(blob), len(h), len(p), verdict == "block"))
        blob += h + p
    table = np.sort(np.array(rows, ENTRY), order=["key", "start"])
    name = os.path.join(folder or tempfile.mkdtemp(prefix="url-rules-"), f"url-rules-{uuid.uuid4().hex}.bin")
    with open(name, "wb") as f:
        f.write(np.array([len(table)], "<i8").tobytes() + table.tobytes() + bytes(blob))
    return name


def open_index(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries, strings, distinct path lengths), memory-mapped once a worker."""
    if name not in _open:
        raw = np.memmap(name, np.uint8, "r")
        n = int(raw[:8].view("<i8")[0])
        table = raw[8 : 8 + n * ENTRY.itemsize].view(ENTRY)
        _open[name] = table, raw[8 + n * ENTRY.itemsize :], np.unique(table["path"])
    return _open[name]


def judge(urls: list[str | None], index: tuple, default: str, digest=xxhash.xxh64_intdigest) -> dict[str, list]:
    """Host, path, rule and verdict of each url of a batch."""
    table, strings, lengths = index
    parts = [split_url(u) for u in urls]
    keys, owner, probes = [], [], []
    for i, (host, path) in enumerate(parts):
        p, h, at = path.encode(), host.encode(), 0
        while True:
            for n in lengths:
                if n <= len(p):
                    keys.append(digest(h[at:] + p[:n]))
                    owner.append(i)
                    probes.append((h[at:], p[:n]))
            at = h.find(b".", at) + 1
            if not at:
                break
    rule: list[str | None] = [None] * len(urls)
    verdict = [default] * len(urls)
    longest = [-1] * len(urls)
    if keys and len(table):
        want = np.array(keys, np.uint64)
        lo = np.searchsorted(table["key"], want, "left")
        hi = np.searchsorted(table["key"], want, "right")
        for j in np.flatnonzero(hi > lo):
            i, (h, p) = owner[j], probes[j]
            for e in table[lo[j] : hi[j]]:
                size = int(e["host"]) + int(e["path"])
                kept = strings[int(e["start"]) : int(e["start"]) + size].tobytes()
                if int(e["host"]) == len(h) and kept == h + p and size > longest[i]:
                    longest[i], rule[i], verdict[i] = size, kept.decode(), "block" if e["block"] else "allow"
    return {"host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": rule, "verdict": verdict}


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``."""
    name = build_index(rules)
    pages.sparkSession.sparkContext.addFile(name)
    base = os.path.basename(name)

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        index = open_index(SparkFiles.get(base))
        for b in batches:
            yield {"page_id": b["page_id"]} | judge(b["url"].to_pylist(), index, default)

    kind = dict(pages.dtypes)[id_col]
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"))
    return map_batches(rows, f"page_id {kind}, host string, path string, rule string, verdict string", work)


SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT page_id, host, path, h || p AS rule, v,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC) AS k
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits WHERE k = 1
"""
