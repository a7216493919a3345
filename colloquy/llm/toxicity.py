"""Operator 3: toxicity by a bidirectional gated recurrent network, trained in numpy.

A word enters as the sum of what is known of it as a word (hashed embedding) and of its
characters (mean of hashed 3-character embeddings), side by side. Windows of ``WINDOW``
words, each half over the next, are read by a GRU in either direction; attention over the
states pools them, and a logistic output scores the window. A text's score is that of its
worst window, and all windows of the whole text are scored.

The network is fitted on the driver on a bounded sample of labelled texts: at most
``TRAIN_TEXTS`` of at most ``TRAIN_BYTES`` bytes, drawn for each label by a hash of the
id; the output's bias is corrected for the shares drawn. Labels sit on
texts, so the windows to learn from are chosen by the state of the network: the worst of
each toxic text, the worst and another of each clean one. Scoring needs no shuffle.

Texts without words (null, empty) score 0. Repeated rows score alike; without labels of
both kinds every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm import texts
from colloquy.session import materialize

#: Bounds of the training sample.
TRAIN_TEXTS = 4_000
TRAIN_BYTES = 16_000

WINDOW = 32
STRIDE = WINDOW // 2
HIDDEN = 8
EMBEDDING = 8
WORD_ROWS = 1 << 15
CHAR_ROWS = 1 << 14
KEPT_WORDS = 1 << 18
#: Steps of training, at least.
LEAST_STEPS = 240
#: Windows scored at a time.
BATCH = 1024

_STRIP = b".,;:!?\"'()[]{}*$%&#|<>-"


def words_of(text: str) -> list[bytes]:
    return [w for w in (x.strip(_STRIP) for x in text.lower().encode("utf-8", "replace").split()) if w]


def word_rows(words: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(w) % WORD_ROWS for w in words], np.int64)


def char_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of every 3-gram of ``<word>``, and where each word's begin."""
    x = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint32)
    sizes = np.array([len(w) for w in words])  # a word of n bytes has n 3-grams
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = np.arange(sizes.sum()) + np.repeat(2 * np.arange(len(words)), sizes)
    code = (x[at] << 16 | x[at + 1] << 8 | x[at + 2]) * np.uint32(2654435761)
    return (code >> np.uint32(32 - 14)).astype(np.int64), starts


def windows_of(n: int) -> np.ndarray:
    """First words of all windows of a text of ``n`` words."""
    return np.arange(0, max(1, n - STRIDE), STRIDE) if n else np.arange(0)


class Network:
    """Parameters by name; ``f`` and ``b`` are the directions."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        put = lambda *shape: (r.standard_normal(shape) * 0.3).astype(np.float32)
        h = HIDDEN
        self.p = {
            "words": put(WORD_ROWS, EMBEDDING) * 0.1, "chars": put(CHAR_ROWS, EMBEDDING) * 0.1,
            "attend": put(2 * h, h), "attend_b": np.zeros(h, np.float32), "attend_v": put(h),
            "out": put(2 * h), "out_b": np.zeros(1, np.float32),
        }
        for d in "fb":
            self.p |= {
                f"x_{d}": put(2 * EMBEDDING, 3 * h), f"xb_{d}": np.zeros(3 * h, np.float32),
                f"h_{d}": put(h, 3 * h), f"hb_{d}": np.zeros(h, np.float32),
            }

    def inputs(self, words: list[bytes]) -> np.ndarray:
        chars, starts = char_rows(words)
        sizes = np.diff(np.append(starts, len(chars)))[:, None]
        out = np.empty((len(words), 2 * EMBEDDING), np.float32)
        out[:, :EMBEDDING] = self.p["words"][word_rows(words)]
        for i in range(0, len(words), 20_000):
            j = min(len(words), i + 20_000)
            end = starts[j] if j < len(words) else len(chars)
            out[i:j, EMBEDDING:] = np.add.reduceat(self.p["chars"][chars[starts[i] : end]], starts[i:j] - starts[i], axis=0)
        out[:, EMBEDDING:] /= sizes
        return out

    def project(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        """Gate inputs per word and direction."""
        return {d: inputs @ self.p[f"x_{d}"] + self.p[f"xb_{d}"] for d in "fb"}

    def forward(self, gates: dict[str, np.ndarray], ids: np.ndarray, keep: bool = False):
        """Logits of windows (rows of word numbers, 0: no word). ``gates`` row 0 is no word."""
        n, h = len(ids), HIDDEN
        steps = ids.shape[1]
        states = np.empty((steps, n, 2 * h), np.float32)
        kept: dict[str, list] = {"f": [], "b": []}
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            u, ub = self.p[f"h_{d}"], self.p[f"hb_{d}"]
            state = np.zeros((n, h), np.float32)
            at = slice(0, h) if d == "f" else slice(h, 2 * h)
            for t in order:
                x = gates[d][ids[:, t]]
                g = state @ u
                zr = x[:, : 2 * h] + g[:, : 2 * h]
                zr *= 0.5
                np.tanh(zr, zr)
                zr += 1
                zr *= 0.5
                z, r = zr[:, :h], zr[:, h:]
                inner = g[:, 2 * h :] + ub
                cand = np.tanh(x[:, 2 * h :] + r * inner)
                new = cand + z * (state - cand)
                if keep:
                    kept[d].append((t, state, z, r, inner, cand))
                state = new
                states[t, :, at] = new
        energy = np.tanh(states @ self.p["attend"] + self.p["attend_b"])
        score = energy @ self.p["attend_v"] + np.where(ids.T > 0, 0, -1e4).astype(np.float32)
        score = np.exp(score - score.max(0))
        weight = score / score.sum(0)
        pooled = (weight[:, :, None] * states).sum(0)
        logits = pooled @ self.p["out"] + self.p["out_b"]
        return (logits, (kept, states, energy, weight, pooled)) if keep else logits

    def logits(self, gates: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
        """As ``forward``, for scoring: units by windows, so that every step works on
        contiguous rows, and nothing is kept but the states."""
        h, p, (n, steps) = HIDDEN, self.p, ids.shape
        states = np.empty((steps, 2 * h, n), np.float32)
        zr, g = np.empty((2 * h, n), np.float32), np.empty((3 * h, n), np.float32)
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            u, ub = np.ascontiguousarray(p[f"h_{d}"].T), p[f"hb_{d}"][:, None]
            at = slice(0, h) if d == "f" else slice(h, 2 * h)
            state = np.zeros((h, n), np.float32)
            for t in order:
                x = np.ascontiguousarray(gates[d].take(ids[:, t], axis=0).T)
                np.matmul(u, state, out=g)
                np.add(x[: 2 * h], g[: 2 * h], out=zr)
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr += 1
                zr *= 0.5
                cand = g[2 * h :]
                cand += ub
                cand *= zr[h:]
                cand += x[2 * h :]
                np.tanh(cand, out=cand)
                new = states[t, at]
                np.subtract(state, cand, out=new)
                new *= zr[:h]
                new += cand
                state = new
        energy = np.tanh(np.matmul(p["attend"].T, states) + p["attend_b"][:, None])
        score = np.matmul(p["attend_v"], energy) + np.where(ids.T > 0, 0, -1e4).astype(np.float32)
        score = np.exp(score - score.max(0))
        told = np.matmul(p["out"], states)
        return (score * told).sum(0) / score.sum(0) + p["out_b"]

    def gradients(self, inputs: np.ndarray, ids: np.ndarray, label: np.ndarray):
        """Gradients of the mean logistic loss; those of the inputs under ``inputs``."""
        gates, h, p = self.project(inputs), HIDDEN, self.p
        logits, (kept, states, energy, weight, pooled) = self.forward(gates, ids, True)
        dl = ((1 / (1 + np.exp(-np.clip(logits, -30, 30))) - label) / len(ids)).astype(np.float32)
        g = {"out": pooled.T @ dl, "out_b": dl.sum(keepdims=True)}
        dp = dl[:, None] * p["out"]
        dw = (states * dp).sum(2)
        ds = weight[:, :, None] * dp
        de = weight * (dw - (weight * dw).sum(0))
        g["attend_v"] = np.einsum("tnk,tn->k", energy, de)
        da = de[:, :, None] * p["attend_v"] * (1 - energy**2)
        g["attend"] = np.einsum("tni,tnk->ik", states, da)
        g["attend_b"] = da.sum((0, 1))
        ds = ds + da @ p["attend"].T
        dx_all = np.zeros_like(inputs)
        for d in "fb":
            at = slice(0, h) if d == "f" else slice(h, 2 * h)
            u = p[f"h_{d}"]
            du, dub = np.zeros_like(u), np.zeros(h, np.float32)
            dgates = np.zeros_like(gates[d])
            carry = np.zeros((len(ids), h), np.float32)
            for t, state, z, r, inner, cand in reversed(kept[d]):
                dh = ds[t, :, at] + carry
                dcand = dh * (1 - z) * (1 - cand**2)
                dz = dh * (state - cand) * z * (1 - z)
                dr = dcand * inner * r * (1 - r)
                dinner = dcand * r
                dg = np.concatenate([dz, dr, dinner], 1)
                np.add.at(dgates, ids[:, t], np.concatenate([dz, dr, dcand], 1))
                du += state.T @ dg
                dub += dinner.sum(0)
                carry = dh * z + dg @ u.T
            g[f"h_{d}"], g[f"hb_{d}"] = du, dub
            g[f"x_{d}"], g[f"xb_{d}"] = inputs.T @ dgates, dgates.sum(0)
            dx_all += dgates @ p[f"x_{d}"].T
        g["inputs"] = dx_all
        return g, float(np.mean(np.logaddexp(0, logits) - label * logits))


def _log_odds(rows_of_text: list[np.ndarray], label: np.ndarray, size: int) -> np.ndarray:
    """Per row of an embedding: smoothed log odds of the texts that have it."""
    seen = np.zeros((2, size))
    for rows, kind in zip(rows_of_text, label):
        seen[int(kind), rows] += 1  # a row counts once for a text
    n_good, n_bad = (label == 0).sum(), (label == 1).sum()
    ratio = n_good / n_bad
    return np.log((seen[1] + 1) / (n_bad + 2)) - np.log((seen[0] + ratio) / (n_good + 2 * ratio))


def train(docs: list[str], labels: list[int], seed: int = 0, rounds: int = 4) -> Network | None:
    """A network fitted to texts labelled 0 or 1; None if a kind is missing."""
    label = np.array(labels, np.float64)
    if not len(label) or label.min() == label.max():
        return None
    net, r = Network(seed), np.random.default_rng(seed)
    number: dict[bytes, int] = {b"": 0}
    of_doc = [np.array([number.setdefault(w, len(number)) for w in words_of(d)], np.int32) for d in docs]
    vocabulary = list(number)
    vocabulary[0] = b" "  # stands for no word; its inputs are set to zero
    chars, starts = char_rows(vocabulary)
    sizes = np.diff(np.append(starts, len(chars)))
    rows = word_rows(vocabulary)
    # The first dimension of either embedding starts as log odds.
    own = [np.unique(x) for x in of_doc]
    by_word = _log_odds([rows[x] for x in own], label, WORD_ROWS)
    by_char = _log_odds(
        [np.concatenate([chars[i:j] for i, j in zip(starts[x], starts[x] + sizes[x])] or [chars[:0]]) for x in own],
        label, CHAR_ROWS,
    )
    net.p["words"][:, 0] = np.clip(by_word, -2, 4) / 2
    net.p["chars"][:, 0] = np.clip(by_char, -2, 4) / 2

    spans, of_span = [], []
    for k, x in enumerate(of_doc):
        padded = np.concatenate([x, np.zeros(WINDOW, np.int32)])
        for s in windows_of(len(x)):
            spans.append(padded[s : s + WINDOW])
            of_span.append(k)
    spans, of_span = np.array(spans), np.array(of_span)

    def inputs() -> np.ndarray:
        out = net.inputs(vocabulary)
        out[0] = 0
        return out

    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    whole = inputs()
    # At first the window with the most telling words; later the network's own worst.
    worst = (whole[:, 0] + whole[:, EMBEDDING])[spans].max(1)
    for turn in range(rounds):
        order = np.lexsort((-worst, of_span))
        top = order[np.diff(of_span[order], prepend=-1) != 0]
        clean = np.flatnonzero(label[of_span] == 0)
        other = r.choice(clean, min(len(clean), len(docs) // 2), replace=False)
        use = np.concatenate([top, other])
        # Small samples are gone through several times, in smaller batches.
        size = min(192, max(32, len(use) // 8))
        passes = max(1, LEAST_STEPS * size // (rounds * len(use)))
        for pick in (x[i : i + size] for x in (r.permutation(use) for _ in range(passes)) for i in range(0, len(x), size)):
            mine, ids = np.unique(spans[pick], return_inverse=True)
            ids = ids.reshape(len(pick), WINDOW)
            if mine[0] != 0:
                mine, ids = np.concatenate([[0], mine]), ids + 1
            x = net.inputs([vocabulary[i] for i in mine])
            x[0] = 0
            g, _ = net.gradients(x, ids, label[of_span[pick]])
            dx = g.pop("inputs")
            dx[0] = 0
            g["words"] = np.zeros_like(net.p["words"])
            np.add.at(g["words"], rows[mine], dx[:, :EMBEDDING])
            g["chars"] = np.zeros_like(net.p["chars"])
            each = np.repeat(np.arange(len(mine)), sizes[mine])
            inner = np.arange(len(each)) - np.repeat(np.cumsum(sizes[mine]) - sizes[mine], sizes[mine])
            np.add.at(g["chars"], chars[starts[mine[each]] + inner],
                      (dx[:, EMBEDDING:] / sizes[mine][:, None])[each])
            step += 1
            for k, v in g.items():
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                net.p[k] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if turn + 1 < rounds:
            gates = net.project(inputs())
            worst = np.concatenate([net.logits(gates, spans[i : i + BATCH]) for i in range(0, len(spans), BATCH)])
    return net


class Scorer:
    """Scores texts; gate inputs of words are kept from batch to batch."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        zero = self.net.project(np.zeros((1, 2 * EMBEDDING), np.float32))
        self.number: dict[bytes, int] = {}
        self.gates = {d: np.concatenate([zero[d], np.empty((4095, 3 * HIDDEN), np.float32)]) for d in "fb"}

    def numbers(self, words: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.number) > KEPT_WORDS:
            self.clear()
        number = self.number
        new = list(set().union(*words).difference(number)) if words else []
        if new:
            first = len(number) + 1
            number.update(zip(new, range(first, first + len(new))))
            gates = self.net.project(self.net.inputs(new))
            for d in "fb":
                while len(self.gates[d]) < first + len(new):
                    self.gates[d] = np.concatenate([self.gates[d], np.empty_like(self.gates[d])])
                self.gates[d][first : first + len(new)] = gates[d]
        return [np.array([number[w] for w in x], np.int32) for x in words]

    def score(self, docs: list[str]) -> np.ndarray:
        of_doc = self.numbers([words_of(d) for d in docs])
        sizes = np.array([len(x) for x in of_doc], np.int64)
        out = np.zeros(len(docs))
        # Each text is followed by a window of no words; windows never reach the next.
        flat = np.concatenate([y for x in of_doc for y in (x, np.zeros(WINDOW, np.int32))] or [np.empty(0, np.int32)])
        begin = np.cumsum(sizes + WINDOW) - sizes - WINDOW
        starts = [windows_of(n) for n in sizes.tolist()]
        owner = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
        if not len(owner):
            return out
        starts = np.concatenate(starts) + begin[owner]
        reach = np.arange(WINDOW)
        for i in range(0, len(starts), BATCH):
            logits = self.net.logits(self.gates, flat[starts[i : i + BATCH, None] + reach])
            np.maximum.at(out, owner[i : i + BATCH], 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -30, 30))))
        return out


def held_out(id_column: str) -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1


def fit(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
        label_column: str = "toxic") -> Network | None:
    """A network from labelled rows that are not held out: half of the texts of either
    label, more of one if the other has fewer; the output's bias is set for their shares."""
    given = labels.select(id_column, label_column).dropna().where(~held_out(id_column)).groupBy(id_column).agg(
        (F.max(F.col(label_column).cast("int")) > 0).cast("int").alias("label")
    )
    fitting = df.select(id_column, text_column).where(F.octet_length(text_column) <= TRAIN_BYTES)
    candidates = materialize(fitting.select(id_column).distinct().join(given, id_column), "toxic-labels")
    there = {r.label: r.n for r in candidates.groupBy("label").agg(F.count("*").alias("n")).collect()}
    most = {k: max(TRAIN_TEXTS // 2, TRAIN_TEXTS - there.get(1 - k, 0)) for k in (0, 1)}
    drawn = [candidates.where(F.col("label") == k).orderBy(F.xxhash64(id_column), id_column).limit(n) for k, n in most.items()]
    rows = (
        fitting.join(F.broadcast(drawn[0].union(drawn[1])), id_column)
        .orderBy(F.xxhash64(id_column), id_column, text_column)
        .limit(TRAIN_TEXTS).select(text_column, "label").collect()
    )
    net = train([r[0] for r in rows], [int(r[1]) for r in rows])
    if net is not None:
        net.p["out_b"] += np.log(there[1] / there[0] * min(most[0], there[0]) / min(most[1], there[1]))
    return net


_scorers: dict[int, Scorer] = {}


def score_documents(df: DataFrame, net: Network | None, threshold: float = 0.7, id_column: str = "doc_id",
                    text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, held_out, score, predicted, and the columns of ``carry``."""
    whole = list(dict.fromkeys([id_column, *carry]))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in whole)
    shared = df.sparkSession.sparkContext.broadcast(net)  # a few MB, whatever the input
    key = id(shared)

    def make(batch: pa.RecordBatch) -> dict:
        given = texts.strings(batch, text_column)
        if shared.value is None:
            scores = np.zeros(len(given))
        else:
            if key not in _scorers:
                _scorers.clear()
                _scorers[key] = Scorer(shared.value)
            scores = _scorers[key].score(given)
        return {c: batch.column(c) for c in whole} | {"score": scores}

    scored = texts.map_slices(
        df.select(*dict.fromkeys([*whole, text_column])), text_column, make, schema + ", score double"
    )
    return scored.select(
        *whole, held_out(id_column).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = texts.documents(spark, sf_dir)
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
