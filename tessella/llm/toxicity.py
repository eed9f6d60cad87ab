"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are positives; all other training text is unlabelled, a mixture that holds toxic texts too, in the
share ``prior``. The risk of calling unlabelled text harmless is corrected by the part that toxic texts have in it, and
the corrected part is kept from falling below zero: where it would, the step goes the other way. The classifier is
linear over the different words of a text and their first bytes, as far as these tell the two kinds of text apart. Training runs on the driver, in numpy, on samples of bounded size; scoring sees every text
whole and is one pass without a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._shared import fresh, mapped, named, ship

#: Fixed value: letters (ASCII in lower case, all bytes beyond it) stay, everything else parts words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 or b == 39 else 32 for b in range(256))
PREFIXES = (4, 5, 6, 7)  # bytes of a word's beginning that are features of their own

# Bounds of the training sample, defaults: texts of each kind, and bytes of all texts of a kind together.
MAX_POSITIVE, MAX_UNLABELLED, MAX_BYTES = 2000, 5000, 32 << 20


# What a feature must have: rows and share of the positives, times its share in harmless text, standard deviations.
LEAST_DF, LEAST_SHARE, LEAST_LIFT, LEAST_SIGMA = 3, 0.015, 10.0, 5.0


@dataclass
class Model:
    bias: float
    words: dict[bytes, float]
    starts: dict[bytes, float]

    def raw(self, text: bytes | None) -> float:
        found = set((text or b"").translate(TABLE).split())
        s = sum(self.words[w] for w in self.words.keys() & found)
        known = self.starts.keys()
        for n in PREFIXES:
            s += sum(self.starts[w] for w in known & {w[:n] for w in found if len(w) > n})
        return self.bias + s


def features(text: bytes | None) -> set[bytes]:
    """A text's different words, marked =, and beginnings of words, marked ^."""
    words = set((text or b"").translate(TABLE).split())
    return {b"=" + w for w in words} | {b"^" + w[:n] for n in PREFIXES for w in words if len(w) > n}


def telling(positive: list[bytes], unlabelled: list[bytes], prior: float) -> list[bytes]:
    """Features that toxic texts have clearly more often than harmless ones; the share that harmless texts have is the
    unlabelled share less what toxic texts among them account for. Counts by hash come first, so that only features
    that may be frequent enough are held in memory by name."""
    n_p, n_u = len(positive), len(unlabelled)
    least = max(LEAST_DF, LEAST_SHARE * n_p)
    rough = np.zeros(1 << 22, np.int32)
    code = lambda f: zlib.crc32(f) & ((1 << 22) - 1)
    for t in positive:
        rough[np.unique(np.fromiter(map(code, features(t)), np.int64))] += 1
    in_p = Counter(f for t in positive for f in features(t) if rough[code(f)] >= least)
    in_p = {f: n for f, n in in_p.items() if n >= least}
    in_u = Counter(f for t in unlabelled for f in in_p.keys() & features(t))
    out = []
    for f, n in in_p.items():
        share_u = (in_u[f] + 0.5) / (n_u + 1)
        harmless = (max(in_u[f] / n_u - prior * n / n_p, 0) * n_u + 0.5) / ((1 - prior) * n_u + 1)
        if n / n_p >= LEAST_LIFT * harmless and n / n_p - share_u >= LEAST_SIGMA * math.sqrt(share_u * (1 - share_u) / n_p):
            out.append(f)
    return sorted(out)


def different(texts: list[bytes]) -> list[bytes]:
    """Without texts that share half of their 16 least word hashes with an earlier one, so that a group of copies does
    not pass its words off as common."""
    seen: dict[int, list[int]] = {}
    out = []
    for t in texts:
        sketch = sorted({zlib.crc32(w) for w in t.translate(TABLE).split()})[:16]
        met = Counter(i for h in sketch for i in seen.get(h, ()))
        if sketch and max(met.values(), default=0) * 2 >= len(sketch):
            continue
        for h in sketch:
            seen.setdefault(h, []).append(len(out))
        out.append(t)
    return out


def train(positive: list[bytes], unlabelled: list[bytes], prior: float, rounds: int = 400, rate: float = 0.1, decay: float = 3e-5) -> Model:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with logistic loss, by Adam."""
    positive, unlabelled = different(positive), different(unlabelled)
    n_p, n_u = len(positive), len(unlabelled)
    if not n_p or not n_u:
        return Model(-5.0, {}, {})
    names = telling(positive, unlabelled, prior)
    at = {f: i for i, f in enumerate(names)}
    rows = [sorted(at[f] for f in at.keys() & features(t)) for t in positive + unlabelled]
    idx = np.array([i for r in rows for i in r], dtype=np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    is_p = np.arange(len(rows)) < n_p
    w = np.zeros(len(names) + 1)  # the last is the bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=w[idx], minlength=len(rows)) + w[-1]
        harmless = np.logaddexp(0, z)  # loss of the label "harmless"
        rest = harmless[~is_p].mean() - prior * harmless[is_p].mean()
        corrected = np.where(is_p, -prior * sigmoid(z) / n_p, sigmoid(z) / n_u)
        g = corrected + np.where(is_p, -prior * sigmoid(-z) / n_p, 0) if rest >= 0 else -corrected
        grad = np.append(np.bincount(idx, weights=g[row], minlength=len(names)), g.sum()) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weight = dict(zip(names, w[:-1].tolist(), strict=True))
    return Model(float(w[-1]), {f[1:]: x for f, x in weight.items() if f[:1] == b"="}, {f[1:]: x for f, x in weight.items() if f[:1] == b"^"})


def sample(docs: DataFrame, ids: DataFrame, n: int, doc_id: str, text: str, max_bytes: int) -> list[bytes]:
    """Texts of ``n`` of the ids, drawn by a hash of the id, whole and of any length: in the order of that hash, as many
    as have ``max_bytes`` bytes together. Repeated rows count once, an id with several texts has them all."""
    few = ids.select(named(doc_id).alias("id")).where("id is not null").distinct().orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(n)
    rows = docs.select(named(doc_id).alias("id"), named(text).cast("binary").alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(few), "id").select("id", F.xxhash64("text").alias("th"), "text")  # few has n rows at most
    sizes = rows.groupBy("id", "th").agg(F.min(F.octet_length("text")).alias("size")).orderBy(F.xxhash64(F.col("id").cast("string")), "id", "th").limit(n).collect()
    left, chosen = max_bytes, []
    for r in sizes:
        if r["size"] <= left:
            left -= r["size"]
            chosen.append((r["id"], r["th"]))
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame(chosen, T.StructType([few.schema["id"], T.StructField("th", T.LongType())]))
    return [bytes(r["text"]) for r in rows.join(F.broadcast(wanted), ["id", "th"]).dropDuplicates(["id", "th"]).select("text").collect()]


def fit(docs: DataFrame, labels: DataFrame, in_training: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = MAX_POSITIVE, unlabelled: int = MAX_UNLABELLED, max_bytes: int = MAX_BYTES) -> Model:
    """Train on documents for whose id ``in_training`` holds. Only ``label`` = 1 is believed; other labels serve for the
    share of toxic texts alone.

    The sample has at most ``positives`` confirmed toxic and ``unlabelled`` other texts, each kind at most ``max_bytes``
    bytes together; texts in it are whole. Null ids, null texts and null labels take no part, repeated rows count once.
    Without toxic texts, as with empty tables, the model calls every text harmless.
    """
    mine = labels.where(in_training)
    share = mine.where(named(label).isNotNull()).agg(F.avg((named(label) == 1).cast("double"))).first()[0]
    toxic = sample(docs, mine.where(named(label) == 1), positives, doc_id, text, max_bytes)
    other = sample(docs, docs.where(in_training), unlabelled, doc_id, text, max_bytes)
    return train(sorted(toxic), sorted(other), min(max(share or 0.0, 1e-3), 0.9))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with ``column``, 0 to 1. A null or empty text has the score of a text without known words; a very long
    one is read whole, in one task. Rows, repeated ones too, and other columns stay as they are, whatever their names; a
    column named like ``column`` is replaced. An empty table stays empty."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != column.lower()]
    (own,) = fresh(docs.columns, "own")
    src = docs.select(*map(named, kept), named(text).cast("binary").alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                z = np.array([model.raw(t) for t in part.column(own).to_pylist()])
                cols = [part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], [*kept, column])

    return mapped(src, run, T.StructType([*(docs.schema[c] for c in kept), T.StructField(column, T.DoubleType())]))
