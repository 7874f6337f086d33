"""LM scoring by a gated recurrent language model, in numpy.

The corpus gives exact counts of all training words. The most frequent ``shortlist`` words get outputs of their own,
factored into frequency classes; every other word belongs to one of 16 tail classes by a rule on its bytes, and its share
of that class is its smoothed corpus count. The network predicts the class (and the word within a shortlist class) from a
recurrent state; so any word has a probability, and what the model knows of the corpus grows with the corpus.

The network is trained by truncated backpropagation, with the state carried across windows, in two steps. The driver starts
it on a bounded number of training documents (``sample``). Then every task of a scan goes over *all* training texts of its
partition from there, and the tasks' weights are averaged by their numbers of tokens, some at a time in a tree of jobs; so
what is learned of word order grows with the corpus as the counts do. Scoring carries the state across windows as well: a
document is scored whole, from a zero state to its end token, with documents of like length side by side.

Counts of the most frequent words, ``known`` at most, are broadcast. A document's other words become
rows that meet their counts in a join; they are rare by construction, so no key is hot.

Defined results: a null text is the empty text, whose one token is the end; without training documents every count is
zero and the model is the untrained one; an empty table gives no rows; repeated rows are scored each for itself; null ids are training rows.
"""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_batches, plain, stored

SHORTLIST, CLASSES, TAILS, HIDDEN, KNOWN, WINDOW = 1024, 32, 16, 16, 200_000, 32
#: The pass over all training texts: texts side by side, step size, tokens laid out at once, vectors averaged by one task.
STREAMS, RATE, LAID, FAN = 512, 0.004, 400_000, 32
#: Tokens that a task scores at once, and a batch more.
SCORED = 3_000_000
END = b""  # no word is empty
FLUSH = 300_000


def _last_byte_kinds() -> bytes:
    """Eight kinds of a word's last byte: common endings by letter, other letters, digits, everything else."""
    kinds = bytearray([7] * 256)
    for byte in range(97, 123):
        kinds[byte] = 5
    for byte in range(48, 58):
        kinds[byte] = 6
    for kind, letters in enumerate((b"e", b"n", b"s", b"tdr", b"hgz")):
        for byte in letters:
            kinds[byte] = kind
    return bytes(kinds)


KINDS = _last_byte_kinds()


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased; words are runs without blanks and bytes 9 to 13."""
    return text.encode().lower().split()


def tail_class(word: bytes) -> int:
    return KINDS[word[-1]] + (0 if word.isascii() else 8) if word else 7


def held_out(id_col: str, fold: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(fold)) == part, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, tail, n) of a table (text): words are counted in each task first."""

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        held: Counter = Counter()

        def out() -> dict:
            kinds = [tail_class(w) for w in held]
            return {"word": pa.array(list(held), pa.binary()), "tail": kinds, "n": list(held.values())}

        for b in batches:
            for text in b["text"].to_pylist():
                held.update(words_of(text))
                held[END] += 1
                if len(held) > FLUSH:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return map_batches(texts, "word binary, tail int, n long", count).groupBy("word", "tail").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Known words with their counts, the shortlist, and the sums over the tail classes."""

    def __init__(self, known: list[tuple[bytes, int]], tails: dict[int, tuple[int, int]], shortlist: int = SHORTLIST, classes: int = CLASSES) -> None:
        known = sorted(known, key=lambda x: (x[0] != END, -x[1], x[0])) if known else []
        if not known or known[0][0] != END:
            known.insert(0, (END, 0))
        self.index = {w: i for i, (w, _) in enumerate(known)}
        n = np.array([c for _, c in known], float)
        self.log_n = np.log10(n + 1)
        self.size = min(shortlist, len(known))
        total, kinds = np.zeros(TAILS), np.zeros(TAILS)
        for k, (count, words) in tails.items():
            total[k], kinds[k] = count, words
        tail = np.array([tail_class(w) for w, _ in known])
        for i in range(self.size):
            if n[i]:
                total[tail[i]] -= n[i]
                kinds[tail[i]] -= 1
        self.tail_weight = np.maximum(total, 0) + np.maximum(kinds, 0) + 1
        self.log_tail = np.log10(self.tail_weight)
        #: The network's number of each known word: its place in the shortlist, or the shortlist's size and its tail.
        self.unit = np.where(np.arange(len(known)) < self.size, np.arange(len(known)), self.size + tail).astype(np.int64)
        mass = np.cumsum(np.sqrt(n[: self.size] + 1))
        self.word_class = np.minimum((mass / mass[-1] * classes).astype(int), classes - 1)
        _, self.word_class = np.unique(self.word_class, return_inverse=True)
        self.classes = int(self.word_class[-1]) + 1
        self.unit_class = np.concatenate([self.word_class, self.classes + np.arange(TAILS)])
        self.first = np.searchsorted(self.word_class, np.arange(self.classes + 1))
        self.weight = np.concatenate([n[: self.size] + 1, self.tail_weight])


def _log_shares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logarithms of the softmax of each column of scores x at its target y. x (outputs, N) is overwritten: with the tokens side by side,
    sums and maxima over the outputs run along whole rows."""
    x -= x.max(0)
    target = x[y, np.arange(len(y))]
    np.exp(x, out=x)
    return target - np.log(x.sum(0))


def _picked(a: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Columns of a matrix; ``mode`` spares numpy a pass over them."""
    return np.take(a, columns, axis=1, mode="clip")


def _softmax_loss(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed loss of the targets, and the gradient at the scores x (outputs, N), which are overwritten."""
    columns = np.arange(len(y))
    x -= x.max(0)
    target = x[y, columns]
    np.exp(x, out=x)
    total = x.sum(0)
    loss = float((np.log(total) - target).sum())
    x *= 1 / total
    x[y, columns] -= 1
    return loss, x


class Model:
    """Gated recurrent layer, class outputs, and word outputs within each shortlist class."""

    def __init__(self, vocabulary: Vocabulary, hidden: int = HIDDEN, seed: int = 5) -> None:
        rng, v = np.random.default_rng(seed), vocabulary
        self.v, self.hidden = v, hidden
        share = v.weight / v.weight.sum()
        of_class = np.bincount(v.unit_class, share)
        self.p = {
            "I": rng.normal(0, 0.3, (3 * hidden, v.size + TAILS)).astype("f4"),
            "U": rng.normal(0, 0.5 / np.sqrt(hidden), (3 * hidden, hidden)).astype("f4"),
            "C": rng.normal(0, 0.1, (v.classes + TAILS, hidden)).astype("f4"),
            "c": np.log(of_class).astype("f4"),
            "W": rng.normal(0, 0.1, (v.size, hidden)).astype("f4"),
            "w": np.log(share[: v.size] / of_class[v.word_class]).astype("f4"),
        }

    def step(self, h: np.ndarray, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """One step from states h (H, B) on inputs x (B); gates are piecewise linear."""
        H = self.hidden
        g = np.take(self.p["I"], x, axis=1, mode="clip")
        u = self.p["U"] @ h
        gates = g[: 2 * H]
        gates += u[: 2 * H]
        gates *= 0.25
        gates += 0.5
        np.minimum(np.maximum(gates, 0, out=gates), 1, out=gates)
        c = gates[H:] * u[2 * H :]
        c += g[2 * H :]
        np.minimum(np.maximum(c, -1, out=c), 1, out=c)
        if keep is not None:
            keep.append((x, h, u[2 * H :], gates, c))
        out = h - c
        out *= gates[:H]
        out += c
        return out

    def log_probabilities(self, states: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logarithms for targets y (N) at states (N, H): class, and word within a shortlist class."""
        v, side = self.v, states.T
        kind = v.unit_class[y]
        out = _log_shares(self.p["C"] @ side + self.p["c"][:, None], kind)
        order, edge = self._by_class(kind)
        side, y = _picked(side, order[: edge[-1]]), y[order]
        for k in range(v.classes):
            part, a, b = slice(edge[k], edge[k + 1]), v.first[k], v.first[k + 1]
            if edge[k + 1] > edge[k] and b - a > 1:
                out[order[part]] += _log_shares(self.p["W"][a:b] @ side[:, part] + self.p["w"][a:b, None], y[part] - a)
        return out

    def _by_class(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens in order of their classes, and where each class of the shortlist begins; tails come last."""
        order = np.argsort(kind.astype(np.uint16), kind="stable")
        return order, np.searchsorted(kind[order], np.arange(self.v.classes + 1))

    def score(self, documents: list[np.ndarray], side: int = 1024) -> np.ndarray:
        """log10 of the network's probability of each document (arrays of units, end token last)."""
        out = np.zeros(len(documents))
        sizes = np.array([len(d) for d in documents])
        order = np.argsort(-sizes, kind="stable")
        for at in range(0, len(order), side):
            mine = order[at : at + side]
            live = sizes[mine]
            h = np.zeros((self.hidden, len(mine)), "f4")
            before = np.zeros(len(mine), np.int64)  # the end token's unit
            for t0 in range(0, int(live[0]), WINDOW):
                n = int((live > t0).sum())
                h, before = h[:, :n], before[:n]
                span = min(WINDOW, int(live[0]) - t0)
                y = np.zeros((span, n), np.int64)
                for j in range(n):
                    part = documents[mine[j]][t0 : t0 + span]
                    y[: len(part), j] = part
                states = np.empty((self.hidden, span, n), "f4")
                for t in range(span):
                    h = self.step(h, before)
                    states[:, t] = h
                    before = y[t]
                real = np.arange(t0, t0 + span)[:, None] < live[:n]
                logs = np.zeros((span, n))
                logs[real] = self.log_probabilities(_picked(states.reshape(self.hidden, -1), np.flatnonzero(real)).T, y[real])
                out[mine[:n]] += logs.sum(0)
        return out / np.log(10)

    def gradients(self, h: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, dict[str, np.ndarray]]:
        """State after the window, loss a token, gradients cut off at the window's start. x, y: (T, B)."""
        H, v, kind_of = self.hidden, self.v, self.p["U"].dtype
        T, B = x.shape
        kept: list = []
        live = (x != 0).astype(kind_of)  # an end token closes a document
        states, befores = np.empty((H, T, B), kind_of), np.empty((H, T, B), kind_of)
        for t in range(T):
            befores[:, t] = h * live[t]
            h = self.step(befores[:, t], x[t], kept)
            states[:, t] = h
        s, target = states.reshape(H, -1), y.reshape(-1)
        n = len(target)
        kind = v.unit_class[target]
        loss, d = _softmax_loss(self.p["C"] @ s + self.p["c"][:, None], kind)
        grads = {"C": d @ s.T, "c": d.sum(1), "W": np.zeros_like(self.p["W"]), "w": np.zeros_like(self.p["w"])}
        down = self.p["C"].T @ d
        order, edge = self._by_class(kind)
        s, target = _picked(s, order), target[order]
        inner = np.zeros_like(s)
        for k in range(v.classes):
            part, a, b = slice(edge[k], edge[k + 1]), v.first[k], v.first[k + 1]
            if edge[k + 1] > edge[k] and b - a > 1:
                more, e = _softmax_loss(self.p["W"][a:b] @ s[:, part] + self.p["w"][a:b, None], target[part] - a)
                loss += more
                grads["W"][a:b], grads["w"][a:b] = e @ s[:, part].T, e.sum(1)
                inner[:, part] = self.p["W"][a:b].T @ e
        back_again = np.empty_like(order)
        back_again[order] = np.arange(n)
        down = (down + _picked(inner, back_again)).reshape(H, T, B)
        into, back, carry = np.empty((3 * H, T, B), kind_of), np.empty((3 * H, T, B), kind_of), np.zeros((H, B), kind_of)
        for t in range(T - 1, -1, -1):
            _, before, uc, gates, c = kept[t]
            dh = down[:, t] + carry
            z, r = gates[:H], gates[H:]
            open_gates = ((gates > 0) & (gates < 1)) * kind_of.type(0.25)
            dc = dh * (1 - z)
            dc *= np.abs(c) < 1
            rec = np.concatenate([dh * (before - c), dc * uc, dc * r])
            rec[: 2 * H] *= open_gates
            back[:, t] = rec
            into[2 * H :, t] = dc
            carry = self.p["U"].T @ rec
            carry += dh * z
            carry *= live[t]
        into[: 2 * H] = back[: 2 * H]
        token = x.reshape(-1)
        by = np.argsort(token.astype(np.uint16), kind="stable")
        found, first = np.unique(token[by], return_index=True)
        gI = np.zeros_like(self.p["I"])
        gI[:, found] = np.add.reduceat(_picked(into.reshape(3 * H, -1), by), first, axis=1)
        grads["I"], grads["U"] = gI, back.reshape(3 * H, -1) @ befores.reshape(H, -1).T
        return h, float(loss / n), {k: g / n for k, g in grads.items()}

    def update(self, grads: dict[str, np.ndarray], pace: float) -> None:
        """One Adam step; gradients are clipped to norm 1."""
        if not hasattr(self, "moments"):
            self.moments, self.steps = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in self.p.items()}, 0
        self.steps += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            m, q = self.moments[k]
            g = g * min(1.0, 1 / (norm + 1e-9))
            m += 0.1 * (g - m)
            q += 0.01 * (g * g - q)
            self.p[k] -= (pace * m / (1 - 0.9**self.steps) / (np.sqrt(q / (1 - 0.99**self.steps)) + 1e-8)).astype("f4")

    def fit(self, documents: list[np.ndarray], updates: int = 500, streams: int = 96, rate: float = 0.02) -> list[float]:
        """Truncated backpropagation over the documents, laid end to end in parallel streams; the losses."""
        line = np.concatenate([np.zeros(0, np.int64), *documents])
        length = len(line) // streams
        if length < 2:
            return []
        y = line[: length * streams].reshape(streams, length).T
        x = np.vstack([np.zeros((1, streams), np.int64), y[:-1]])
        h, at, losses = np.zeros((self.hidden, streams), "f4"), 0, []
        for step in range(1, updates + 1):
            if at >= length:
                h, at = np.zeros_like(h), 0
            h, loss, grads = self.gradients(h, x[at : at + WINDOW], y[at : at + WINDOW])
            at += WINDOW
            losses.append(loss)
            self.update(grads, rate * min(1.0, 2 * (1 - step / (updates + 1))))
        del self.moments
        return losses

    def read(self, documents: list[np.ndarray], streams: int = STREAMS, rate: float = RATE) -> None:
        """One pass of truncated backpropagation over all of the documents."""
        line = np.concatenate(documents)
        streams = max(1, min(streams, len(line) // WINDOW))
        length = -(-len(line) // streams)
        y = np.append(line, np.zeros(length * streams - len(line), np.int64)).reshape(streams, length).T  # filled up with end tokens
        x = np.vstack([np.zeros((1, streams), np.int64), y[:-1]])
        h = np.zeros((self.hidden, streams), "f4")
        for at in range(0, length, WINDOW):
            h, _, grads = self.gradients(h, x[at : at + WINDOW], y[at : at + WINDOW])
            self.update(grads, rate)

    def apart(self) -> Model:
        """A model with weights of its own and the same vocabulary."""
        out = copy.copy(self)
        out.p = {k: a.copy() for k, a in self.p.items()}
        return out

    def weights(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.p.values()])

    def take(self, weights: np.ndarray) -> None:
        at = 0
        for k, a in self.p.items():
            self.p[k] = weights[at : at + a.size].reshape(a.shape).astype("f4")
            at += a.size


def units_of(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Known indices (-1: not known) and units of the words and the end token, and the words not known."""
    at = np.fromiter(map(v.index.get, words, repeat(-1)), np.int64, len(words))
    at = np.append(at, 0)
    units = v.unit[at]
    missing = np.flatnonzero(at < 0)
    rare = [words[i] for i in missing]
    if rare:
        units[missing] = v.size + np.array([tail_class(w) for w in rare])
    return at, units, rare


def learn(train: DataFrame, counts: DataFrame, sample: int, known: int) -> Model:
    """A first model from the counts (word, tail, n) and about ``sample`` training texts, twice that at most."""
    size = F.floor(F.log2("n") * 16)  # some hundred sizes at most, whatever the corpus
    sizes = sorted(((r["size"], r["k"]) for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, least = 0, float("inf")
    for at, k in sizes:
        total += k
        if total > known:
            break
        least = at
    top = [(bytes(r["word"]), r["n"]) for r in counts.filter(size >= F.lit(float(least))).select("word", "n").collect()]
    if END not in dict(top) and (end := counts.filter(F.col("word") == F.lit(END)).first()):
        top.append((END, end["n"]))
    tails = {r["tail"]: (r["n"], r["words"]) for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()}
    model = Model(Vocabulary(top, tails))
    rows = train.count()
    if rows:
        dice = F.pmod(F.xxhash64(F.lit("lm"), "text"), F.lit(1 << 30)) / float(1 << 30)
        texts = sorted(r["text"] for r in train.filter(dice < min(1.0, sample / rows)).limit(2 * sample).collect())
        order = np.random.default_rng(3).permutation(len(texts))
        model.fit([units_of(words_of(texts[i]), model.v)[1] for i in order])
    return model


def read_all(train: DataFrame, model: Model) -> Model:
    """The model after a pass over all training texts: each task starts from ``model``, and their weights are averaged."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[dict]) -> Iterator[dict]:
        mine, held, tokens, laid = shared.value.apart(), [], 0, 0
        for b in batches:
            for text in b["text"].to_pylist():
                held.append(units_of(words_of(text), mine.v)[1])
                laid += len(held[-1])
                if laid >= LAID:
                    mine.read(held)
                    tokens, held, laid = tokens + laid, [], 0
        if held:
            mine.read(held)
        if tokens + laid:
            yield {"tokens": [tokens + laid], "weights": [mine.weights().tobytes()]}

    def average(batches: Iterator[dict]) -> Iterator[dict]:
        total, tokens = 0.0, 0
        for b in batches:
            for n, raw in zip(b["tokens"].to_pylist(), b["weights"].to_pylist(), strict=True):
                total, tokens = total + n * np.frombuffer(raw, "f4").astype("f8"), tokens + n
        if tokens:
            yield {"tokens": [tokens], "weights": [(total / tokens).astype("f4").tobytes()]}

    kind = "tokens long, weights binary"
    vectors = stored(map_batches(train, kind, read), "lm-weights")
    while (n := vectors.count()) > FAN:
        vectors = stored(map_batches(vectors.repartition(-(-n // FAN)), kind, average, rows=8), "lm-weights")
    found = vectors.collect()
    if found:
        total = sum(r["tokens"] for r in found)
        model.take(sum(r["tokens"] / total * np.frombuffer(r["weights"], "f4").astype("f8") for r in found))
    return model


def score_documents(docs: DataFrame, sample: int = 1500, known: int = KNOWN, keep: str = "doc_id", text_col: str = "text", together: int = SCORED) -> DataFrame:
    """Whole-document log10 likelihoods under the model and under smoothed unigram counts, for every row. Batches of ``together`` tokens are scored
    at once: the longest document of a batch takes a step for each token, however few go with it."""
    rows = docs.select(F.col(keep).alias("doc_id"), plain(text_col).alias("text"), held_out(keep).alias("held_out"))
    train = rows.filter(~F.col("held_out")).select("text")
    counts = stored(word_counts(train), "word-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shared = docs.sparkSession.sparkContext.broadcast(read_all(train, learn(train, counts, sample, known)))

    def scored(model: Model, batches: list[dict], units: list[np.ndarray], found: dict[str, list]) -> dict:
        ids = {k: pa.concat_arrays([b[k] for b in batches]) for k in ("row", "doc_id", "held_out")}
        return ids | {"n_tokens": found["n"], "seen": found["seen"], "logs": found["logs"], "net": model.score(units) + np.array(found["inside"]), "rare": pa.array(found["rare"], pa.list_(pa.binary()))}

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        model = shared.value
        v = model.v
        mine, units, tokens, out = [], [], 0, {k: [] for k in ("n", "seen", "logs", "inside", "rare")}
        for b in batches:
            for text in b["text"].to_pylist():
                at, unit, rare = units_of(words_of(text), v)
                held = at >= 0
                log_n = v.log_n[at[held]]
                tail = unit >= v.size
                inside = float(v.log_n[at[tail & held]].sum() - v.log_tail[unit[tail] - v.size].sum())
                for name, value in zip(out, (len(at), int((log_n > 0).sum()), float(log_n.sum()), inside, rare), strict=True):
                    out[name].append(value)
                units.append(unit)
                tokens += len(at)
            mine.append(b)
            if tokens >= together:
                yield scored(model, mine, units, out)
                mine, units, tokens, out = [], [], 0, {k: [] for k in out}
        if mine:
            yield scored(model, mine, units, out)

    kind = dict(rows.dtypes)["doc_id"]
    parts = stored(map_batches(rows.withColumn("row", F.monotonically_increasing_id()), f"row long, doc_id {kind}, held_out boolean, n_tokens long, seen long, logs double, net double, rare array<binary>", work), "lm-parts")
    rare = parts.select("row", F.explode("rare").alias("word")).join(counts.select("word", "n"), "word")
    sums = rare.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("rare_logs"), F.count("*").alias("rare_seen"))
    out = parts.drop("rare").join(sums, "row", "left")
    extra = F.coalesce("rare_logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("rare_seen", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + extra - F.col("n_tokens") * F.log10(F.lit(float(total + kinds + 1)))).alias("base_score"),
        (F.col("net") + extra).alias("score"),
    )
