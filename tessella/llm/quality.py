"""Text quality by attention-based multiple-instance learning.

A document is a bag of passages, a label belongs to the whole bag. Each passage is encoded by what it is made of, shares
of kinds of bytes and words, and by its words, which have learnt vectors by hash; a hidden layer embeds both; a gated unit, tanh times sigmoid, gives it a weight, and the weights of a bag sum to
one. The document's score is read off the weighted passage representation, so training finds on its own which passages
speak for a label. Training runs on the driver, in numpy, on a sample of bounded size; scoring encodes every passage of
every text in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._shared import fresh, mapped, named, ship
from tessella.llm.toxicity import MAX_BYTES, sample

PASSAGE = 64  # words
MAX_BAGS = 4000  # documents of the training sample
HIDDEN, GATE = 24, 12
BUCKETS, WORD = 4096, 8  # words of one hash share a vector of so many numbers

Bag = tuple[np.ndarray, np.ndarray]  # of each passage its shares, and its words' hashes, 0 where it has fewer

#: Classes of bytes that are counted, one feature each.
CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:", b"!", b"?", b"*", b"#$%&",
    b"|", b"\"'", b"()[]{}<>", b"/\\_=+~^`@", b"-", bytes(range(128, 256)), bytes([*range(9), *range(11, 32), 127]), b"\xef\xbf\xbd",
)
MASK = np.zeros((256, len(CLASSES)), np.float32)
for _i, _c in enumerate(CLASSES):
    MASK[list(_c), _i] = 1
WIDTH = len(CLASSES) + 8


def encode(data: bytes | None, size: int = PASSAGE) -> Bag:
    """A row for each passage of ``size`` words; a text without words is one passage."""
    words = (data or b"").split()
    hashes = np.zeros((max(1, -(-len(words) // size)), size), np.int16)
    hashes.ravel()[: len(words)] = np.fromiter(map(crc32, map(bytes.lower, words)), np.int64, len(words)) % BUCKETS + 1
    out = []
    for at in range(0, max(len(words), 1), size):
        part = words[at : at + size]
        n = len(part)
        joined = b" ".join(part)
        row = np.zeros(WIDTH, np.float32)
        if n:
            count = np.bincount(np.frombuffer(joined, np.uint8), minlength=256)
            row[: len(CLASSES)] = (count @ MASK) / len(joined)
            kinds = len(set(part))
            same = sum(map(bytes.__eq__, part, part[1:])) if n > 1 else 0
            sizes = np.fromiter(map(len, part), np.float32, n)
            row[len(CLASSES) :] = (
                kinds / n, same / n, min(float(sizes.mean()), 40) / 10, min(float(sizes.std()), 40) / 10, n / size,
                sum(map(bytes.istitle, part)) / n, sum(map(bytes.isupper, part)) / n, (sizes == 1).mean(),
            )
        else:
            row[-1] = -1
        out.append(row)
    return np.stack(out), hashes


def _joined(bags: list[Bag]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages of bags side by side, and where each bag starts."""
    return np.concatenate([x for x, _ in bags]), np.concatenate([w for _, w in bags]), np.cumsum([0, *(len(x) for x, _ in bags[:-1])])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, words: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        """Of bags that lie side by side, the bag ``i`` from ``start[i]`` on."""
        p = self.p
        said = np.zeros((len(x), WORD))
        for column in words.T:  # one after the other: a long bag has no large table of all its words' vectors
            said += p["E"][column]
        said /= np.maximum((words > 0).sum(1), 1)[:, None]
        x = np.concatenate([(x - self.mean) / self.scale, said], axis=1)
        h = np.tanh(x @ p["We"] + p["be"])
        t, s = np.tanh(h @ p["V"] + p["bv"]), _sigmoid(h @ p["U"] + p["bu"])
        e = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(x)]))
        e = np.exp(e - np.maximum.reduceat(e, start)[bag])
        a = e / np.add.reduceat(e, start)[bag]
        z = np.add.reduceat(a[:, None] * h, start)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "bag": bag, "z": z, "y": _sigmoid(z @ p["c"] + p["b"])}

    def score(self, bags: list[Bag]) -> np.ndarray:
        return self.forward(*_joined(bags))["y"]

    def gradient(self, bags: list[Bag], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the cross-entropy of bags with labels ``y``, each with its ``weight``, through attention and words."""
        p = self.p
        x, words, start = _joined(bags)
        f = self.forward(x, words, start)
        d = weight * (f["y"] - y)
        g = {"c": f["z"].T @ d, "b": np.array([d.sum()])}
        dz = d[:, None] * p["c"]
        dh = f["a"][:, None] * dz[f["bag"]]
        da = (f["h"] * dz[f["bag"]]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, start)[f["bag"]])
        g["w"] = (f["t"] * f["s"]).T @ de
        dts = de[:, None] * p["w"]
        dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
        g["V"], g["bv"], g["U"], g["bu"] = f["h"].T @ dt, dt.sum(0), f["h"].T @ ds, ds.sum(0)
        dx = (dh + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        g["We"], g["be"] = f["x"].T @ dx, dx.sum(0)
        said = (dx @ p["We"][WIDTH:].T) / np.maximum((words > 0).sum(1), 1)[:, None]
        each = np.repeat(np.arange(len(words)), words.shape[1])
        g["E"] = np.stack([np.bincount(words.ravel(), weights=said[each, k], minlength=BUCKETS + 1) for k in range(WORD)], axis=1)
        g["E"][0] = 0  # no word
        return g


def train(bags: list[Bag], labels: list[int], rounds: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> Model:
    """Cross-entropy over document labels, by Adam over batches of bags; the gradient goes through the attention."""
    y = np.array(labels, float)
    rng = np.random.default_rng(seed)
    p = {
        "E": np.r_[np.zeros((1, WORD)), rng.normal(0, 0.1, (BUCKETS, WORD))], "We": rng.normal(0, 0.3, (WIDTH + WORD, HIDDEN)), "be": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "bv": np.zeros(GATE),
        "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "bu": np.zeros(GATE), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "b": np.zeros(1),
    }
    if not bags:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), {k: v * 0 for k, v in p.items()})
    every = _joined(bags)[0]
    model = Model(every.mean(0), every.std(0) + 0.02, p)
    share = np.clip(y.mean(), 0.02, 0.98)
    p["b"][:] = np.log(share / (1 - share))
    m, v, t = {k: 0 * x for k, x in p.items()}, {k: 0 * x for k, x in p.items()}, 0
    for _ in range(rounds):
        order = rng.permutation(len(bags))
        for at in range(0, len(bags), 128):
            pick = order[at : at + 128]
            weight = np.where(y[pick] == 1, 0.5 / share, 0.5 / (1 - share)) / len(pick)
            g = model.gradient([bags[i] for i in pick], y[pick], weight)
            t += 1
            for k in p:
                grad = g[k] + decay * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, in_training: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", bags: int = MAX_BAGS, max_bytes: int = MAX_BYTES) -> Model:
    """Train on labelled documents for whose id ``in_training`` holds.

    The sample has at most ``bags`` documents, half of them at most of each label, which have at most ``max_bytes`` bytes
    together for each label; texts in it are whole. A document with labels of both kinds, null ids, null texts and null
    labels take no part, repeated rows count once. Without labelled texts, as with empty tables, all scores are equal.
    """
    mine = labels.where(in_training & named(label).isin(0, 1)).groupBy(named(doc_id).alias(doc_id)).agg(F.min(named(label)).alias("lo"), F.max(named(label)).alias("hi")).where("lo = hi")
    rows = sorted((t, k) for k in (0, 1) for t in sample(docs, mine.where(F.col("lo") == k), bags // 2, doc_id, text, max_bytes))
    return train([encode(t) for t, _ in rows], [k for _, k in rows])


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with ``column``, 0 to 1. A null, empty or wordless text is a bag of one empty passage; of a very long one
    all passages count, in one task. Rows, repeated ones too, and other columns stay as they are, whatever their names; a
    column named like ``column`` is replaced. An empty table stays empty."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != column.lower()]
    (own,) = fresh(docs.columns, "own")
    src = docs.select(*map(named, kept), named(text).cast("binary").alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                y = model.score([encode(t) for t in part.column(own).to_pylist()]) if part.num_rows else np.zeros(0)
                cols = [part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(y.astype(float))], [*kept, column])

    return mapped(src, run, T.StructType([*(docs.schema[c] for c in kept), T.StructField(column, T.DoubleType())]))
