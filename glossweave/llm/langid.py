"""Operator 4: language ID by a bidirectional gated recurrent network over bytes.

Training: a bounded sample of labelled texts (windows of SNIPPET characters drawn by hash: PER_LANG for each language, or a
share of SNIPPETS where there are many languages, one at least) goes to the driver, where numpy trains the network by
backpropagation through time (Adam, cross-entropy at every position). Every label of the training part is learned.
Prediction: every byte of every text, in windows of SPAN bytes that start from a zero state in both directions, gets a
probability for each language; the document's are the normalised exponentials of the summed log-probabilities, tempered by
1 / POOL since neighbouring positions say much the same. Ties go to the language that comes first by name.

Null text and texts without a letter (Unicode's categories L) get "und" and score 0; so does every text when nothing was
learned. Labels that are null are not learned. Rows that repeat are each predicted. A very long text is read whole, in runs
of windows. An empty table gives no rows. Other columns are kept by identify() and ignored by language_id(), whatever their
names: identify() puts underscores before the names of its own columns where the table has such columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from glossweave.llm.common import fresh, released

PER_LANG, SNIPPET, SNIPPETS, PARTS = 500, 110, 32_000, 64
HIDDEN, SPAN, POOL, EPOCHS, BATCH, RATE, SEED = 8, 160, 8.0, 6, 100, 0.02, 5
LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    """Weights of both directions: W (256, 3 h) by byte, U (h, 3 h), b (3 h); gates in order update, reset, candidate."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.h, self.k = hidden, classes
        f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"W{d}": f(256, 3 * hidden, scale=0.3), f"U{d}": f(hidden, 3 * hidden, scale=0.3), f"b{d}": np.zeros(3 * hidden, np.float32)}
        self.p |= {"V": f(2 * hidden, classes, scale=0.3), "c": np.zeros(classes, np.float32)}

    def run(self, x: np.ndarray, d: str, keep: bool = False):
        """Hidden states (time, rows, h) of bytes x (time, rows), in d's own order of time."""
        h, W, U = self.h, self.p[f"W{d}"] + self.p[f"b{d}"], self.p[f"U{d}"]
        T, B = x.shape
        out, s = np.empty((T, B, h), np.float32), np.zeros((B, h), np.float32)
        held = []
        for t in range(T):
            g, a = W[x[t]], s @ U
            zr = _sigmoid(g[:, : 2 * h] + a[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(g[:, 2 * h :] + r * a[:, 2 * h :])
            new = n + z * (s - n)
            if keep:
                held.append((s, z, r, n, a[:, 2 * h :]))
            s = out[t] = new
        return (out, held) if keep else out

    def back(self, x: np.ndarray, d: str, held: list, grad: np.ndarray, g: dict) -> None:
        """Adds the gradients of direction d, given those of its hidden states."""
        h, U = self.h, self.p[f"U{d}"]
        gW, gU, ds = g[f"W{d}"], g[f"U{d}"], np.zeros_like(grad[0])
        for t in range(len(x) - 1, -1, -1):
            s, z, r, n, an = held[t]
            ds = ds + grad[t]
            dn = ds * (1 - z) * (1 - n * n)
            da = np.concatenate([ds * (s - n) * z * (1 - z), dn * an * r * (1 - r), dn * r], axis=1)
            dx = np.concatenate([da[:, : 2 * h], dn], axis=1)
            np.add.at(gW, x[t], dx)
            g[f"b{d}"] += dx.sum(0)
            gU += s.T @ da
            ds = ds * z + da @ U.T

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities (time, rows, classes) at every position."""
        f, b = self.run(x, "f"), self.run(x[::-1], "b")[::-1]
        y = f @ self.p["V"][: self.h]
        y += b @ self.p["V"][self.h :]
        y += self.p["c"]
        y -= y.max(2, keepdims=True)
        return y - np.log(np.exp(y).sum(2, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over positions in mask (time, rows) for labels y (rows), and its gradients."""
        (f, hf), (b, hb) = self.run(x, "f", True), self.run(x[::-1], "b", True)
        s = np.concatenate([f, b[::-1]], axis=2)
        o = s @ self.p["V"] + self.p["c"]
        o -= o.max(2, keepdims=True)
        q = np.exp(o)
        q /= q.sum(2, keepdims=True)
        rows, total = np.arange(x.shape[1]), mask.sum()
        loss = float(-(np.log(q[:, rows, y] + 1e-12) * mask).sum() / total)
        q[:, rows, y] -= 1
        q *= mask[:, :, None] / total
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["V"], g["c"] = np.tensordot(s, q, ([0, 1], [0, 1])), q.sum((0, 1))
        ds = q @ self.p["V"].T
        self.back(x, "f", hf, ds[:, :, : self.h], g)
        self.back(x[::-1], "b", hb, ds[::-1, :, self.h :], g)
        return loss, g


def windows(raws: list[bytes], span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (span, windows), true positions, and each window's text; every byte lies in one window."""
    counts = np.array([-(-len(r) // span) for r in raws], np.int64)
    flat = np.frombuffer(b"".join(r + bytes(-len(r) % span) for r in raws), np.uint8).reshape(-1, span)
    sizes = np.array([len(r) for r in raws], np.int64)
    owner = np.repeat(np.arange(len(raws)), counts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(raws) else counts
    begin = (np.arange(len(owner)) - first[owner]) * span
    mask = np.arange(span)[:, None] < (sizes[owner] - begin)[None, :]
    return np.ascontiguousarray(flat.T), mask, owner


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = SEED) -> tuple[list[str], Network | None]:
    names = sorted(set(labels))
    if not names:
        return names, None
    x, mask, owner = windows([t.encode() for t in texts])
    y = np.array([names.index(v) for v in labels])[owner]
    net, rng = Network(len(names), seed=seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, total = 0, epochs * -(-len(y) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            i = order[lo : lo + BATCH]
            _, g = net.gradients(x[:, i], y[i], mask[:, i].astype(np.float32))
            step += 1
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            rate = RATE * (1 - step / (total + 1)) * min(1.0, 1.0 / (norm + 1e-9))
            for k, a in g.items():
                m[k] = 0.9 * m[k] + 0.1 * a
                v2[k] = 0.99 * v2[k] + 0.01 * a * a
                net.p[k] -= (rate / (1 - 0.9**step) * m[k] / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return names, net


def predict(net: Network, raws: list[bytes], rows: int = 2048) -> np.ndarray:
    """Probabilities (texts, classes)."""
    x, mask, owner = windows(raws)
    sums = np.zeros((len(raws), net.k))
    for lo in range(0, x.shape[1], rows):
        p = net.log_probs(x[:, lo : lo + rows])
        np.add.at(sums, owner[lo : lo + rows], np.einsum("trk,tr->rk", p, mask[:, lo : lo + rows].astype(np.float32)))
    sums = sums / POOL
    sums = np.exp(sums - sums.max(1, keepdims=True))
    return sums / sums.sum(1, keepdims=True)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def sample(labelled: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """lang, h and a window of text: per_lang for each language, by hash, at most SNIPPETS and one for each language in all.
    Each task hands on no more than that of a language."""
    d = labelled.filter(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    most = max(1, min(per_lang, SNIPPETS // max(1, d.select("lang").distinct().count())))
    d = d.select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    at = F.pmod("h", F.greatest(F.length("text") - SNIPPET, F.lit(1)).cast("long")).cast("int") + 1
    d = d.select("lang", "h", F.substring("text", at, F.lit(SNIPPET)).alias("text"))
    # first among PARTS shares of a language, so that no task gets more than PARTS times what is kept
    for by in (["lang", F.pmod(F.xxhash64("h"), F.lit(PARTS))], ["lang"]):
        w = Window.partitionBy(*by).orderBy("h", "text")
        d = d.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).select("lang", "text", "h")
    return d


def identify(docs: DataFrame, labelled: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """docs (doc_id, text, ...) with lang_pred and score, learned from labelled (doc_id, text, lang)."""
    rows = sorted((r["lang"], r["h"], r["text"]) for r in sample(labelled, per_lang).collect())  # SNIPPETS, or one for each language
    names, net = train([r[2] for r in rows], [r[0] for r in rows])
    text, own = docs.columns.index("text"), own_names(docs)

    def run(batches):
        for b in batches:
            texts = b.column(text).to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if net else []
            at = 0
            while at < len(known):
                size, to = 0, at
                while to < len(known) and size < 1_000_000:
                    size += len(texts[known[to]])
                    to += 1
                p = predict(net, [texts[i].encode() for i in known[at:to]])
                for i, k, s in zip(known[at:to], p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                    langs[i], scores[i] = names[k], min(1.0, s)
                at = to
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, *own])

    return docs.mapInArrow(released(run), StructType([*docs.schema.fields, StructField(own[0], StringType()), StructField(own[1], DoubleType())]))


def own_names(docs: DataFrame) -> tuple[str, str]:
    """The names of identify()'s columns beside those of docs."""
    return fresh(docs, "lang_pred"), fresh(docs, "score")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of documents, learned from those that are not held out."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return identify(d.select("doc_id", "text"), d.filter(~held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
