"""BPE encoding and decoding by a tokenization automaton.

The automaton starts as one state that every byte label leads back to. Each merge ``(a, b) -> c``, in order, adds a gadget:

* the state after ``a`` loses its arc ``b``;
* a new state, for words that end in ``c``: a copy of the state after ``b``, as it is now;
* arcs ``c`` wherever arcs ``a`` are open just then, leading to the new state.

All arcs with one label lead to one state, so a state is named by its label, and in the finished automaton exactly one path
spells any word: its BPE tokens. Copies form two trees: a state under the one it was copied from, a label under the one whose
arcs it took over. Number both in depth-first order, younger children first; then what inherits the loss of an arc is a
range of states and a range of labels, so each gadget clears one rectangle of the transition table. States and labels
between the same rectangle edges share a row or a column, which leaves some 17,000 by 11,000 bits for 50,000 merges.
The driver compiles this table once and broadcasts it (some megabytes, whatever the corpus).

Encoding goes over the words from left to right, many words side by side: the labels that end at a place come from a table
of the labels' prefixes, and of them just the one stays whose arc is open in the state it starts from. Decoding emits the
labels of the arcs. A cache of units is on top, bounded in bytes.

Defined results: a null text is the empty text and has no tokens; special tokens in a text are matched first, as the
tokenizers library does; equal texts give equal ids; words have no length limit.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from tidewatch.llm.common import map_batches, plain

#: Fixed value: the published byte-level pre-splitting pattern.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words over LONG bytes are encoded one by one; shorter ones side by side, CHUNK bytes at once.
LONG, CHUNK = 4096, 1 << 18


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 itself, the others from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _tree(made: list[tuple[int, int]], n: int) -> tuple[np.ndarray, list[list[int]], list[list[int]]]:
    """For (child, parent) pairs in order of time: depth-first places with younger children first, and for each node its
    children's times and where each one's part ends, oldest first; the last entry is the end of the node itself."""
    size, times, kids = [1] * n, [[] for _ in range(n)], [[] for _ in range(n)]
    for time, (child, parent) in enumerate(made):
        times[parent].append(time)
        kids[parent].append(child)
    for child, parent in reversed(made):
        size[parent] += size[child]
    place, ends, at = [0] * n, [[] for _ in range(n)], 0
    children = {c for c, _ in made}
    todo = []
    for root in (r for r in range(n) if r not in children):
        place[root] = at
        at += size[root]
        todo.append(root)
    while todo:
        node = todo.pop()
        at = place[node] + 1
        ends[node] = [at]
        for child in reversed(kids[node]):
            place[child] = at
            at += size[child]
            ends[node].append(at)
            todo.append(child)
        ends[node].reverse()
    return np.array(place), times, ends


def compile_automaton(content: str) -> dict:
    """The tables of a byte-level BPE vocabulary file, as arrays that can be sent to workers."""
    spec = json.loads(content)
    letters = byte_letters()
    names = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    label = {i: bytes(letters[c] for c in name) for name, i in names.items() if name not in special}
    pairs = [tuple(names[x] for x in (m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
    ids = {w: i for i, w in label.items()}
    made = [ids[label[a] + label[b]] for a, b in pairs]
    n = max([*label, *special.values()], default=0) + 1
    rows, row_times, row_ends = _tree([(c, b) for c, (_, b) in zip(made, pairs, strict=True)], n)
    cols, col_times, col_ends = _tree([(c, a) for c, (a, _) in zip(made, pairs, strict=True)], n)
    gadget = np.zeros((len(pairs), 4), np.int64)
    for time, (a, b) in enumerate(pairs):  # cleared for the state and its later copies, for the label and all that open with or after it
        gadget[time] = rows[a], row_ends[a][bisect_right(row_times[a], time)], cols[b], col_ends[b][bisect_left(col_times[b], time)]
    row_edge, col_edge = np.unique([0, *gadget[:, :2].ravel()]), np.unique([0, *gadget[:, 2:].ravel()])
    low, high = np.searchsorted(row_edge, gadget[:, :2]).T
    left, right = np.searchsorted(col_edge, gadget[:, 2:]).T
    closed = np.zeros((len(row_edge), len(col_edge)), bool)
    for time in range(len(pairs)):
        closed[low[time] : high[time], left[time] : right[time]] = True
    nodes, edges, ends = {b"": 0}, [], [-1]  # prefixes of labels
    for word, token in ids.items():
        for k in range(1, len(word) + 1):
            if word[:k] not in nodes:
                nodes[word[:k]] = len(ends)
                edges.append((nodes[word[: k - 1]] << 8 | word[k - 1], len(ends)))
                ends.append(-1)
        ends[nodes[word]] = token
    edges.sort()
    return {
        "special": special, "labels": [label.get(i, b"") for i in range(n)], "row": np.searchsorted(row_edge, rows, "right") - 1, "col": np.searchsorted(col_edge, cols, "right") - 1,
        "closed": zlib.compress(np.packbits(closed, axis=1).tobytes(), 1), "shape": closed.shape, "edges": np.array(edges, np.int64).reshape(-1, 2), "ends": np.array(ends, np.int64),
    }


class Automaton:
    """Encodes and decodes by the tables of ``compile_automaton``."""

    def __init__(self, tables: dict) -> None:
        self.special = tables["special"]
        self.labels = list(tables["labels"])
        for s, i in self.special.items():
            self.labels[i] = s.encode()
        self.row, self.col, self.ends = tables["row"], tables["col"], tables["ends"]
        rows, cols = tables["shape"]
        self.closed = np.frombuffer(zlib.decompress(tables["closed"]), np.uint8).reshape(rows, -(-cols // 8))
        self.step_key, self.step_to = np.ascontiguousarray(tables["edges"][:, 0]), np.ascontiguousarray(tables["edges"][:, 1])
        self.cuts = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def open_arcs(self, states: np.ndarray, arcs: np.ndarray) -> np.ndarray:
        c = self.col[arcs]
        return self.closed[self.row[states], c >> 3] >> (7 - (c & 7)) & 1 == 0

    def matches(self, data: np.ndarray, starts: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, label) of all labels that stand in ``data`` from ``starts`` on, each within its limit."""
        found, node, size = [], np.zeros(len(starts), np.int64), 0
        while len(starts):
            key = node << 8 | data[starts + size]
            at = np.minimum(np.searchsorted(self.step_key, key), len(self.step_key) - 1)
            on = self.step_key[at] == key
            starts, limit, node, size = starts[on], limit[on], self.step_to[at[on]], size + 1
            token = self.ends[node]
            hit = token >= 0
            found.append((starts[hit], starts[hit] + size, token[hit]))
            more = starts + size < limit
            starts, limit, node = starts[more], limit[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        out, part, held = [b""] * len(words), [], 0
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self.encode_long(w)
                continue
            part.append(k)
            held += len(w)
            if held >= CHUNK:
                self._side_by_side(words, part, out)
                part, held = [], 0
        if part:
            self._side_by_side(words, part, out)
        return out

    def _side_by_side(self, words: list[bytes], part: list[int], out: list[bytes]) -> None:
        data = np.frombuffer(b"".join([words[k] for k in part]), np.uint8)
        if not len(data):
            return
        ends = np.cumsum([len(words[k]) for k in part])
        sizes = np.diff(ends, prepend=0)
        first, limit = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)  # of the word that each byte is in
        start, end, token = self.matches(data, np.arange(len(data)), limit)
        depth = end - first[start]
        order = np.argsort(depth, kind="stable")
        start, end, token, depth = start[order], end[order], token[order], depth[order]
        edge = np.searchsorted(depth, np.arange(1, int(depth[-1]) + 2))
        state, back = np.full(len(data) + 1, -1, np.int64), np.zeros(len(data) + 1, np.int64)
        opening = start == first[start]
        for a, b in zip(edge, edge[1:], strict=False):
            s, t = start[a:b], token[a:b]
            before = state[s]
            # no state at a place inside a word: no path spells the word so far (bytes without a label)
            ok = opening[a:b] | (before >= 0) & self.open_arcs(np.maximum(before, 0), t)
            state[end[a:b][ok]], back[end[a:b][ok]] = t[ok], s[ok]
        path, at, who = [], ends[sizes > 0], np.flatnonzero(sizes)
        begin = (ends - sizes)[who]
        while len(at):
            path.append((who, state[at]))
            at = back[at]
            on = at > begin
            at, who, begin = at[on], who[on], begin[on]
        who, ids = np.concatenate([w for w, _ in path])[::-1], np.concatenate([t for _, t in path])[::-1]
        order = np.argsort(who, kind="stable")
        raw, cut = ids[order].astype("<u4").tobytes(), 4 * np.searchsorted(who[order], np.arange(len(part) + 1))
        for i, k in enumerate(part):
            out[k] = raw[cut[i] : cut[i + 1]]

    def encode_long(self, word: bytes) -> bytes:
        """One word of any length, block by block; two integers a byte are kept for the way back."""
        data, n, widest = np.frombuffer(word, np.uint8), len(word), max(map(len, self.labels))
        state, back = np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int64)
        for low in range(0, n, LONG):
            high = min(n, low + LONG)
            starts = np.arange(max(0, low - widest), high)
            start, end, token = self.matches(data, starts, np.full(len(starts), high))
            mine = end > low
            start, end, token = start[mine], end[mine], token[mine]
            order = np.argsort(end, kind="stable")
            for s, e, t in zip(start[order].tolist(), end[order].tolist(), token[order].tolist(), strict=True):
                before = int(state[s])
                c = int(self.col[t])
                if not s or before >= 0 and not self.closed[self.row[before], c >> 3] >> (7 - (c & 7)) & 1:
                    state[e], back[e] = t, s
        path, at = [], n
        while at:
            path.append(state[at])
            at = int(back[at])
        return np.array(path[::-1], "<u4").tobytes()

    def encode_spans(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens; each distinct word is encoded once."""
        split = [SPLIT.findall(t) for t in texts]
        words = list(dict.fromkeys(w for s in split for w in s))
        ids = dict(zip(words, self.encode_words([w.encode() for w in words]), strict=True))
        return [b"".join([ids[w] for w in s]) for s in split]

    def decode(self, ids: Iterable[int]) -> str:
        label = self.labels
        return b"".join([label[i] for i in ids]).decode("utf-8", "replace")


class UnitCache:
    """Encode texts unit by unit, keeping the ids of units seen before.

    A unit is a run between single blanks with its leading blank, or a line break with the run behind it. Pre-splitting
    never joins across the border of two such units, so their ids can be put together. Texts with other white space
    between runs go to the encoder whole. ``room`` bounds the cache in bytes.
    """

    #: Bytes of the objects that hold a unit and its ids.
    OVERHEAD, LARGEST = 170, 256

    def __init__(self, spans: Callable[[list[str]], list[bytes]], special: dict[str, int], cuts: regex.Pattern | None, room: int = 64 << 20) -> None:
        self.spans, self.special, self.cuts, self.room = spans, special, cuts, room
        self.units: dict[str, bytes] = {}
        self.top = 0  # largest id, where the encoder tells it

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str], chars: int = 1 << 20) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers; ``chars`` of text at once."""
        out, part, held = [], [], 0
        for t in texts:
            part.append(t)
            held += len(t)
            if held >= chars:
                out += self._batch(part)
                part, held = [], 0
        return out + self._batch(part)

    def _batch(self, texts: list[str]) -> list[bytes]:
        units, fresh = self.units, {}
        whole: dict[str, bytes] = {}
        plans: list[list] = []
        for text in texts:
            marked = self.cuts and any(s in text for s in self.special)
            plans.append(plan := [])
            for k, p in enumerate(self.cuts.split(text) if marked else [text]):
                if k % 2:
                    plan.append(np.array([self.special[p]], "<u4").tobytes())
                elif p:
                    plan.append(found := self.split(p, fresh) or p)
                    whole[found if found is p else found[0]] = b""
        names = [u if u[0] == "\n" else " " + u for u in fresh]
        ids = self.spans([*whole, *names])
        whole = dict(zip(whole, ids, strict=False))
        units.update(zip(fresh, ids[len(whole) :], strict=True))
        join = units.__getitem__
        out = [b"".join([p if isinstance(p, bytes) else whole[p] if isinstance(p, str) else whole[p[0]] + b"".join(map(join, p[1])) for p in plan]) for plan in plans]
        for u in fresh:
            cost = self.OVERHEAD + len(u) + len(units[u])
            if cost > self.room or len(u) > self.LARGEST:
                del units[u]
            else:
                self.room -= cost
        return out

    def split(self, text: str, fresh: dict[str, None]) -> tuple[str, list[str]] | None:
        """The first run and the units after it, the unknown of them added to ``fresh``; None: not to be taken apart."""
        if " \n" in text:
            return None
        first, *rest = text.replace("\n", " \n").split(" ")
        if not first or first[0].isspace() or first[-1].isspace():
            return None
        units = self.units
        new = set(rest).difference(units).difference(fresh)
        for u in new:
            body = u[1:] if u[:1] == "\n" else u
            if not body or body[0].isspace() or body[-1].isspace():
                return None
        fresh.update(dict.fromkeys(new))
        return first, rest


@lru_cache(1)
def compiled(content: str) -> dict:
    return compile_automaton(content)


_held: dict[str, tuple[Automaton, UnitCache]] = {}


def automaton(tables: dict, mark: str = "") -> tuple[Automaton, UnitCache]:
    """One a worker and vocabulary."""
    if mark not in _held:
        _held.clear()
        a = Automaton(tables)
        _held[mark] = a, UnitCache(a.encode_spans, a.special, a.cuts)
    return _held[mark]


def read_vocabulary(path: str | None) -> str:
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return f.read()


def _shared(docs: DataFrame, vocabulary: str | None) -> tuple:
    """The compiled tables as a broadcast, and a mark that tells vocabularies apart."""
    content = read_vocabulary(vocabulary)
    return docs.sparkSession.sparkContext.broadcast(compiled(content)), hashlib.sha256(content.encode()).hexdigest()


def encode_documents(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every row."""
    tables, mark = _shared(docs, vocabulary)

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        a, cache = automaton(tables.value, mark)
        for b in batches:
            ids = [np.frombuffer(x, "<u4").tolist() for x in cache.encode_batch(b["text"].to_pylist())]
            yield {"id": b["id"], "ids": ids, "decoded": [a.decode(x) for x in ids]}

    rows = docs.select(docs[id_col].alias("id"), plain(text_col).alias("text"))
    return map_batches(rows, f"id {dict(docs.dtypes)[id_col]}, ids array<int>, decoded string", work)


def token_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the digests are made where the ids are, so no ids are moved."""
    tables, mark = _shared(docs, vocabulary)

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        a, cache = automaton(tables.value, mark)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for raw in cache.encode_batch(b["text"].to_pylist()):
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(a.decode(np.frombuffer(raw, "<u4").tolist()).encode()).hexdigest())
            yield {"doc_id": b["doc_id"], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    rows = docs.select("doc_id", plain("text").alias("text"))
    return map_batches(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string", work)
