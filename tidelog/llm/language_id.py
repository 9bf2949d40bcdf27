"""Language ID with a convolutional network over bytes.

Bytes are embedded, filters of several widths run along a window, each filter keeps its largest response, and a
softmax over these gives the language. The network is trained in numpy on labelled windows. A text is cut into windows
of fixed length that cover all of it; its languages' probabilities are the means over its windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, map_texts

WINDOW, WIDTHS, EMBED, FILTERS, BATCH = 256, (2, 3, 4), 8, 12, 64
OVERLAP = max(WIDTHS) - 1


@dataclass
class ByteNet:
    """Parameters: embed (256, EMBED), filters and shifts by width, out (features, languages), bias."""

    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    shifts: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and place in the filter: the response to each byte value, so that a convolution is a sum of look-ups."""
        return [[np.ascontiguousarray(self.embed @ w.reshape(k, EMBED, FILTERS)[i]) for i in range(k)] for k, w in zip(WIDTHS, self.filters, strict=True)]

    def predict(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """(windows, languages) probabilities."""
        out = []
        for i in range(0, len(windows), BATCH):
            x, pooled = windows[i : i + BATCH], []
            for k, table, shift in zip(WIDTHS, tables, self.shifts, strict=True):
                m = WINDOW - k + 1
                z = table[0][x[:, :m]]
                for j in range(1, k):
                    z += table[j][x[:, j : j + m]]
                pooled.append(np.maximum(z.max(axis=1) + shift, 0))
            out.append(softmax(np.concatenate(pooled, axis=1) @ self.out + self.bias))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, text of each): windows of fixed length over all bytes of each text, padded with zeros, overlapping by the widest filter less one."""
    step, parts, owner = WINDOW - OVERLAP, [], []
    for i, t in enumerate(texts):
        n = max(1, -(-(len(t) - OVERLAP) // step))
        padded = np.zeros(n * step + OVERLAP, np.uint8)
        padded[: len(t)] = np.frombuffer(t, np.uint8)
        parts.append(sliding_window_view(padded, WINDOW)[::step])
        owner.append(np.full(n, i))
    return np.concatenate(parts), np.concatenate(owner)


def gradients(net: ByteNet, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """(mean cross-entropy, its gradients by embed, filters, shifts, out and bias) of windows x with languages y; through max pooling they reach the windows' strongest places."""
    n, at, emb, pooled = np.arange(len(x))[:, None], [], net.embed[x], []
    for w, s, k in zip(net.filters, net.shifts, WIDTHS, strict=True):
        patches = np.concatenate([emb[:, j : WINDOW - k + 1 + j] for j in range(k)], axis=2)
        z = patches @ w + s
        best = z.argmax(axis=1)
        at.append((best, patches[n, best]))
        pooled.append(np.take_along_axis(z, best[:, None], axis=1)[:, 0])
    raw = np.concatenate(pooled, axis=1)
    features = np.maximum(raw, 0)
    d = softmax(features @ net.out + net.bias)
    loss = float(-np.log(np.maximum(d[np.arange(len(y)), y], 1e-30)).mean())
    d[np.arange(len(y)), y] -= 1
    d /= len(y)
    back = (d @ net.out.T) * (raw > 0)
    d_embed, d_filters, d_shifts = np.zeros_like(net.embed), [], []
    for j, (k, w, (best, patches)) in enumerate(zip(WIDTHS, net.filters, at, strict=True)):
        b = back[:, j * FILTERS : (j + 1) * FILTERS]
        d_filters.append(np.einsum("nf,nfp->pf", b, patches))
        d_shifts.append(b.sum(axis=0))
        to_patch = b[:, :, None] * w.T[None]
        for place in range(k):
            np.add.at(d_embed, x[n, best + place], to_patch[:, :, place * EMBED : (place + 1) * EMBED])
    return loss, [d_embed, *d_filters, *d_shifts, features.T @ d, d.sum(axis=0)]


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 320, rate: float = 3e-3, seed: int = 5) -> ByteNet:
    """Adam on the cross-entropy, so many steps of 128 windows; each language gives the same share of a step's windows."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.3, (256, EMBED)).astype(np.float32)
    filters = [rng.normal(0, 1 / np.sqrt(k * EMBED), (k * EMBED, FILTERS)).astype(np.float32) for k in WIDTHS]
    shifts = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out, bias = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    net = ByteNet(languages, embed, filters, shifts, out, bias)
    params = [embed, *filters, *shifts, out, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    places = [np.flatnonzero(labels == i) for i in range(len(languages))]
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(p, -(-128 // len(languages))) for p in places if len(p)])
        _, grads = gradients(net, windows[chosen], labels[chosen])
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, texts_each: int = 150, most_texts: int = 10_000, most_bytes: int = 64 << 20) -> ByteNet | None:
    """The network of labelled texts that aren't held out, all windows of each; None without any. All languages are learned.

    A language gives at most ``texts_each`` texts, chosen by a hash of doc_id; with very many languages fewer, so that
    all together give ``most_texts`` texts and ``most_bytes`` bytes at most. Texts are taken whole: those that fit into
    a language's share of the bytes first. One text of each language is always taken.
    """
    known = docs.select("doc_id", "lang", "text").filter(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    sizes = known.groupBy("lang").count()
    n_langs = sizes.count()
    if not n_langs:
        return None
    texts_each, share = max(1, min(texts_each, most_texts // n_langs)), most_bytes // n_langs
    # Each language's own part of the hashes holds about twice the texts wanted, so that the sort behind it is small.
    order, size = F.xxhash64("doc_id"), F.octet_length("text")
    part = F.least(F.lit(1.0), (2 * texts_each + 20) / F.col("count"))
    known = known.join(F.broadcast(sizes) if n_langs <= MOST_BROADCAST else sizes, "lang").filter(F.pmod(order, F.lit(1 << 40)) < part * (1 << 40))
    ids = known.groupBy("lang", "doc_id").agg(F.sum(size).alias("size")).withColumn("order", order)
    w = Window.partitionBy("lang").orderBy(F.col("size") > share, "order", "doc_id")
    ids = ids.withColumn("n", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    ids = ids.filter((F.col("n") == 1) | ((F.col("n") <= texts_each) & (F.col("before") <= share)))
    rows = known.join(F.broadcast(ids.select("lang", "doc_id")), ["lang", "doc_id"]).select("lang", "text", order.alias("order")).orderBy("order", F.xxhash64("text")).limit(texts_each * n_langs).collect()
    languages = sorted({r["lang"] for r in rows})
    windows, owner = cut([r["text"].encode() for r in rows])
    return train(windows, np.array([languages.index(r["lang"]) for r in rows])[owner], languages)


def language_id(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """``docs`` (doc_id, text, more) to one row per row: doc_id, held_out, lang_pred, score.

    Only the text decides. lang_pred is ``und`` with score 0 if the text is null or has no letter, or without a
    network. held_out is false for a null doc_id; repeated rows get equal results. Of languages that are equally likely
    the first in the order of their names is taken. Other columns are not read. An empty table gives an empty table.
    """

    def run(rows: dict) -> dict:
        import regex

        letter = regex.compile(r"\p{L}")
        use = [i for i, t in enumerate(rows["text"]) if net is not None and letter.search(t)]
        pred, score = ["und"] * len(rows["text"]), [0.0] * len(rows["text"])
        if use:
            tables = net.tables()
            windows, owner = cut([rows["text"][i].encode() for i in use])
            sums = np.zeros((len(use), len(net.languages)))
            np.add.at(sums, owner, net.predict(windows, tables))
            means = sums / np.bincount(owner, minlength=len(use))[:, None]
            for i, m in zip(use, means, strict=True):
                best = int(m.argmax())
                pred[i], score[i] = net.languages[best], min(float(m[best]), 1.0)
        return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "lang_pred": pred, "score": score}

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", "text", held_out().alias("held_out"))
    return map_texts(read, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double", ("doc_id", "text", "held_out"))
