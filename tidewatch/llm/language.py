"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Two gated recurrent layers read windows of ``WINDOW`` bytes in opposite directions; their states label every position,
and a document's probabilities are the mean over all its positions. The gates are piecewise linear, so a step is a table
look-up, one small matrix product and clips. Training is backpropagation through time with Adam on a bounded sample of
labelled documents (``sample`` for each language, found by a hash of the id); prediction reads whole texts, window by
window, with thousands of windows side by side.

Defined results: ``und`` with score 0 for a null text or one without a letter; no labelled document at all: every other
text is ``und`` too; ties go to the language first in order; equal texts get equal results; texts have no length limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_batches

WINDOW, HIDDEN, SIDE = 64, 8, 1024
_LETTER = re.compile(r"[^\W\d_]")


def clip(x: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.minimum(np.maximum(x, low, out=x), high, out=x)


class Network:
    """Parameters: input tables ``I`` (3H, 256), recurrent ``U`` (3H, H), for each direction; output ``W`` (L, 2H), ``b``.

    Rows of a 3H block: update gate, reset gate, candidate.
    """

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.classes, self.hidden = classes, hidden
        self.p = {}
        for d in "fb":
            self.p["I" + d] = rng.normal(0, 0.3, (3 * hidden, 256)).astype("f4")
            self.p["U" + d] = rng.normal(0, 0.5 / np.sqrt(hidden), (3 * hidden, hidden)).astype("f4")
        self.p["W"] = rng.normal(0, 0.3, (len(classes), 2 * hidden)).astype("f4")
        self.p["b"] = np.zeros((len(classes), 1), "f4")

    def states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """(T, H, B) states for bytes x (T, B); ``keep`` gathers what the backward pass needs."""
        H, I, U = self.hidden, self.p["I" + d], self.p["U" + d]  # noqa: E741
        T, B = x.shape
        out = np.empty((T, H, B), "f4")
        h = np.zeros((H, B), "f4")
        g = np.empty((3 * H, B), "f4")
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            np.take(I, x[t], axis=1, out=g, mode="clip")
            u = U @ h
            gates = g[: 2 * H] + u[: 2 * H]
            gates *= 0.25
            gates += 0.5
            clip(gates, 0, 1)
            c = gates[H:] * u[2 * H :]
            c += g[2 * H :]
            clip(c, -1, 1)
            if keep is not None:
                keep.append((t, h, u[2 * H :], gates, c))
            h = h - c
            h *= gates[:H]
            h += c
            out[t] = h
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(L, T, B): the label probabilities of every position."""
        T, B = x.shape
        both = np.concatenate([self.states(x, "f"), self.states(x, "b")], 1)
        o = np.matmul(self.p["W"], both)
        o += self.p["b"]
        o -= o.max(1, keepdims=True)
        np.exp(o, out=o)
        o /= o.sum(1, keepdims=True)
        return o.transpose(1, 0, 2)

    def gradients(self, x: np.ndarray, y: np.ndarray, live: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for windows x (T, B) with labels y (B) and positions that count, live (T, B)."""
        H = self.hidden
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self.states(x, d, kept[d]) for d in "fb"], 1)
        o = np.matmul(self.p["W"], both) + self.p["b"]
        o -= o.max(1, keepdims=True)
        q = np.exp(o)
        q /= q.sum(1, keepdims=True)
        columns = np.arange(x.shape[1])
        n = live.sum()
        loss = -(np.log(q[:, y, columns] + 1e-9) * live).sum() / n
        q[:, y, columns] -= 1
        q *= (live / n)[:, None]
        grads = {"W": np.einsum("tlb,thb->lh", q, both), "b": q.sum((0, 2))[:, None]}
        down = np.matmul(self.p["W"].T, q)
        for k, d in enumerate("fb"):
            U = self.p["U" + d]
            gI, gU = np.zeros_like(self.p["I" + d]), np.zeros_like(U)
            carry = np.zeros((H, x.shape[1]), "f4")
            for t, h, uc, gates, c in reversed(kept[d]):
                dh = down[t, k * H : (k + 1) * H] + carry
                z, r = gates[:H], gates[H:]
                dz = dh * (h - c) * ((z > 0) & (z < 1)) * 0.25
                dc = dh * (1 - z) * (np.abs(c) < 1)
                dr = dc * uc * ((r > 0) & (r < 1)) * 0.25
                step = np.concatenate([dz, dr, dc])
                order = np.argsort(x[t], kind="stable")
                found, first = np.unique(x[t][order], return_index=True)
                gI[:, found] += np.add.reduceat(step[:, order], first, axis=1)
                rec = np.concatenate([dz, dr, dc * r])
                gU += rec @ h.T
                carry = dh * z + U.T @ rec
            grads["I" + d], grads["U" + d] = gI, gU
        return float(loss), grads


def windows(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts: bytes (N, WINDOW), the owner of each, and how many of its bytes are text."""
    sizes = np.array([len(r) for r in raw])
    count = -(-sizes // WINDOW)
    flat = np.frombuffer(b"".join(r.ljust(int(n) * WINDOW, b"\0") for r, n in zip(raw, count, strict=True)), np.uint8)
    owner = np.repeat(np.arange(len(raw)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return flat.reshape(-1, WINDOW), owner, np.minimum(sizes[owner] - place * WINDOW, WINDOW)


def train(texts: list[str], labels: list[str], steps: int = 300, side: int = 256, rate: float = 0.03, seed: int = 7) -> Network | None:
    """Fit on windows drawn evenly from the languages; None without labelled text."""
    held = [(t.encode(), y) for t, y in zip(texts, labels, strict=True) if t]
    classes = sorted({y for _, y in held})
    if not classes:
        return None
    net, rng = Network(classes), np.random.default_rng(seed)
    x, owner, live = windows([t for t, _ in held])
    y = np.array([classes.index(v) for _, v in held])[owner]
    of = [np.flatnonzero(y == k) for k in range(len(classes))]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        at = np.concatenate([rng.choice(w, -(-side // len(classes))) for w in of])
        _, grads = net.gradients(np.ascontiguousarray(x[at].T).astype(np.intp), y[at], (np.arange(WINDOW)[:, None] < live[at]).astype("f4"))
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        pace = rate * min(1, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1, 1 / (size + 1e-9))
            m[k] += 0.1 * (g - m[k])
            v2[k] += 0.01 * (g * g - v2[k])
            net.p[k] -= (pace * m[k] / (1 - 0.9**step) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype("f4")
    return net


def classify(net: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and probability of each text."""
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    ask = [i for i, t in enumerate(texts) if t and net and _LETTER.search(t)]
    for at in range(0, len(ask), 2048):
        part = ask[at : at + 2048]
        x, owner, live = windows([texts[i].encode() for i in part])
        total = np.zeros((len(part), len(net.classes)))
        for k in range(0, len(x), SIDE):
            block = np.ascontiguousarray(x[k : k + SIDE].T).astype(np.intp)
            p = net.probabilities(block)
            n = live[k : k + SIDE]
            if n.min() < WINDOW:
                p = p * (np.arange(WINDOW)[:, None] < n)
            s = p.sum(1)
            for c in range(len(net.classes)):
                total[:, c] += np.bincount(owner[k : k + SIDE], s[c], len(part))
        total /= total.sum(1, keepdims=True)
        for i, row in zip(part, total, strict=True):
            best = int(row.argmax())
            lang[i], score[i] = net.classes[best], float(min(1, row[best]))
    return lang, score


def labelled_sample(docs: DataFrame, sample: int, fold: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[str]]:
    """About ``sample`` documents a language outside the held-out fold, at most twice that, spread by a hash of the id."""
    rows = docs.select(docs[id_col].cast("string").alias("i"), docs[text_col].cast("string").alias("t"), docs[lang_col].cast("string").alias("l"))
    rows = rows.filter(F.col("l").isNotNull() & F.col("t").isNotNull() & (F.pmod(F.crc32(F.coalesce("i", F.lit("")).cast("binary")), F.lit(fold)) != 0))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n))])
    dice = F.pmod(F.xxhash64(F.lit("sample"), "i"), F.lit(1 << 30)) / float(1 << 30)
    got = rows.filter(dice < F.element_at(share, F.col("l"))).select("t", "l").limit(2 * sample * len(counts)).collect()
    got.sort(key=lambda r: (r["l"], r["t"]))
    return [r["t"] for r in got], [r["l"] for r in got]


def predict(docs: DataFrame, net: Network | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of every row, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kinds = dict(docs.dtypes)

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            lang, score = classify(shared.value, b["__text"].to_pylist())
            yield {k: b[k] for k in keep} | {"lang_pred": pa.array(lang, pa.string()), "score": score}

    rows = docs.select(*keep, docs[text_col].cast("string").alias("__text"))
    return map_batches(rows, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", lang_pred string, score double", work)


def identify(docs: DataFrame, sample: int = 300, keep: list[str] | None = None) -> DataFrame:
    """Train on a sample of ``docs`` and predict all of them."""
    return predict(docs, train(*labelled_sample(docs, sample)), keep or ["doc_id"])


def language_rows(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    out = identify(docs)
    return out.select("doc_id", (F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0).alias("held_out"), "lang_pred", "score")
