"""Benchmark passages in documents, by a prefix-filtered set join.

An item is cut into windows of ``window`` consecutive words (an item with fewer words is one window). A window occurs in
a document only if each of its shingles does, so its rarest shingle over all documents is a prefix that any match must
have: only it is looked up. Each place where a document has it gives one candidate place for the window; the window must
lie within the document (length and positional bound), and then its words are compared one by one.

The benchmark is cut into blocks of bounded size, and documents are read once per block to count shingles and once to
match, so memory does not grow with the benchmark. No document is shuffled; of a document go out one row, or one row per
block if there are several.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._shared import lean, named, ship, stored

#: Fixed value: bytes that words are made of, digits, lower-case letters and all beyond ASCII; A-Z count as a-z.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK_WORDS = 2_000_000  # words of a block of benchmark items
SHINGLE = 3
SLICE_BYTES = 3 << 20


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(TABLE).split() if data else []


class Index:
    """Windows of a block of items, and the shingles that documents are searched for."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items = [k for k, _ in items]
        found: dict[tuple[int, ...], set[int]] = {}
        for i, (_, text) in enumerate(items):
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words_of(text)]
            for at in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(tuple(w[at : at + window]), set()).add(i)
        self.windows = [np.array(w, np.int64) for w in found]
        self.owners = [sorted(x) for x in found.values()]
        self.base = len(self.vocabulary) + 1
        if self.base ** SHINGLE >= 1 << 63:
            raise ValueError("a block of benchmark items has too many different words")
        #: Per shingle width (short windows have one shingle of all they have, up to SHINGLE words).
        self.width = np.array([min(SHINGLE, len(w)) for w in self.windows])
        self.codes = {k: np.unique(np.concatenate([self.shingles(w, k) for w in self.windows if min(SHINGLE, len(w)) == k])) for k in sorted(set(self.width.tolist()))}

    def shingles(self, ids: np.ndarray, k: int) -> np.ndarray:
        code = ids[: len(ids) - k + 1].copy()
        for j in range(1, k):
            code = code * self.base + ids[j : len(ids) - k + 1 + j]
        return code

    def places(self, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where ``ids`` has a known shingle of ``k`` known words, and the shingle's number."""
        known = ids > 0
        at = known[: len(ids) - k + 1].copy() if len(ids) >= k else np.zeros(0, bool)
        for j in range(1, k):
            at &= known[j : len(ids) - k + 1 + j]
        at = np.flatnonzero(at)
        code = ids[at]
        for j in range(1, k):
            code = code * self.base + ids[at + j]
        number = np.searchsorted(self.codes[k], code)
        number[number == len(self.codes[k])] = 0
        hit = self.codes[k][number] == code
        return at[hit], number[hit]

    def choose(self, counts: dict[tuple[int, int], int]) -> None:
        """Give each window its rarest shingle; of equal ones the one met first."""
        self.prefix: dict[int, dict[int, list[tuple[int, int]]]] = {k: {} for k in self.codes}
        for i, w in enumerate(self.windows):
            k = int(self.width[i])
            numbers = np.searchsorted(self.codes[k], self.shingles(w, k)).tolist()
            offset = min(range(len(numbers)), key=lambda j: (counts.get((k, numbers[j]), 0), j))
            if counts.get((k, numbers[offset]), 0):  # a shingle that no document has: nor has any the window
                self.prefix[k].setdefault(numbers[offset], []).append((i, offset))
        self.wanted = {k: np.isin(np.arange(len(self.codes[k])), list(p)) for k, p in self.prefix.items()}


def _flat(texts: list[bytes | None], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of the texts side by side (0: not in the benchmark), and the number of words of each."""
    get = vocabulary.get
    parts, sizes = [], []
    for t in texts:
        w = words_of(t)
        sizes.append(len(w))
        parts.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.array(sizes, np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _counter(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(c), np.int64) for k, c in index.codes.items()}
        for part in _slices(batches):
            ids, sizes = _flat(part.column("text").to_pylist(), index.vocabulary)
            border = np.cumsum(sizes)
            for k in index.codes:
                at, number = index.places(ids, k)
                inside = np.searchsorted(border, at, side="right") == np.searchsorted(border, at + k - 1, side="right")
                total[k] += np.bincount(number[inside], minlength=len(total[k]))
        for k, n in total.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k)), pa.array(seen), pa.array(n[seen])], ["k", "number", "n"])

    return run


def _matcher(index: Index, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            ids, sizes = _flat(part.column("text").to_pylist(), index.vocabulary)
            end = np.cumsum(sizes)
            start = end - sizes
            cover = np.zeros(len(ids) + 1, np.int64)
            owners: dict[int, set[int]] = {}
            for k, prefix in index.prefix.items():
                at, number = index.places(ids, k)
                keep = index.wanted[k][number]
                at, number = at[keep], number[keep]
                order = np.argsort(number, kind="stable")
                at, number = at[order], number[order]
                cut = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True]) if len(number) else np.zeros(1, np.int64)
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    for i, offset in prefix[int(number[a])]:
                        w = index.windows[i]
                        first = at[a:b] - offset
                        doc = np.searchsorted(end, at[a:b], side="right")
                        inside = (first >= start[doc]) & (first + len(w) <= end[doc])
                        first, doc = first[inside], doc[inside]
                        for j in range(len(w)):
                            same = ids[first + j] == w[j]
                            first, doc = first[same], doc[same]
                        np.add.at(cover, first, 1)
                        np.add.at(cover, first + len(w), -1)
                        for d in np.unique(doc).tolist():
                            owners.setdefault(d, set()).update(index.owners[i])
            hit = np.cumsum(cover[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
            rows: dict[int, list[int]] = {}
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                while a < b:  # a run may go on over the border of two texts
                    d = int(np.searchsorted(end, a, side="right"))
                    rows.setdefault(d, []).extend((a - int(start[d]), min(b, int(end[d])) - int(start[d])))
                    a = min(b, int(end[d]))
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in keys),
                    pa.array(sizes, pa.int64()),
                    pa.array([rows.get(d, []) for d in range(len(sizes))], pa.list_(pa.int64())),
                    pa.array([[index.items[i] for i in sorted(owners.get(d, ()))] for d in range(len(sizes))], pa.list_(pa.string())),
                ],
                [*keys, "n_words", "spans", "items"],
            )

    return run


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and items of a row, maybe found over several blocks, to counts and a digest."""
    for part in batches:
        hits, runs, kept, digests = [], [], [], []
        for spans, items in zip(part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True):
            n, begin, reach, run = 0, 0, 0, 0
            for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
                n += max(0, b - max(a, reach))
                begin = a if a > reach else begin
                reach = max(reach, b)
                run = max(run, reach - begin)
            hits.append(n)
            runs.append(run)
            items = sorted(set(items))
            kept.append(items)
            digests.append(hashlib.sha256(",".join(items).encode("utf-8", "surrogatepass")).hexdigest())
        names = [c for c in part.schema.names if c not in ("spans", "items")]
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in names), pa.array(hits, pa.int64()), pa.array(runs, pa.int64()), pa.array([len(x) for x in kept], pa.int64()), pa.array(digests), pa.array(kept, pa.list_(pa.string()))],
            [*names, "n_hit", "longest_hit", "n_items", "items_sha256", "items"],
        )


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> list[DataFrame]:
    """The benchmark in parts of bounded size, dealt by a hash of the item's text."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("binary").alias("text")).where("item is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // (4 * BLOCK_WORDS)))
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``th`` (a hash of the text), ``n_words``, ``n_hit`` (words inside an occurrence of a window),
    ``longest_hit`` (the longest run of such words), ``n_items``, ``items_sha256``, ``items`` (ids, sorted as strings) and ``contaminated`` (a hit word in ``share`` or fewer words).

    Null, empty and wordless texts have no words and are clean; a very long one is read whole, in one task. Items that are null or have a null id are not searched
    for; repeated items count once, two ids with one text count as two items. An empty benchmark leaves all clean.
    Repeated documents keep their rows. Only the named columns are read, so other columns cannot clash.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    src = docs.select(named(doc_id).alias("doc_id"), named(text).cast("binary").alias("text")).withColumn("th", F.xxhash64("text"))
    found = []
    blocks = _blocks(benchmark, item_id, item_text)
    several = len(blocks) > 1
    if several:
        src = stored(src.withColumn("row", F.monotonically_increasing_id()), "documents")
    keys = ["doc_id", "th", "row"] if several else ["doc_id", "th"]
    for block in blocks:
        index = Index(sorted((r.item, bytes(r.text)) for r in block.collect()), window)  # bounded: one block
        counts = src.select("text").mapInArrow(lean(_counter(index)), "k long, number long, n long").groupBy("k", "number").agg(F.sum("n").alias("n"))
        index.choose({(r.k, r.number): r.n for r in counts.collect()})  # bounded: shingles of one block
        ddl = f"doc_id {kind}, th long, " + ("row long, " if several else "") + "n_words long, spans array<long>, items array<string>"
        found.append(src.mapInArrow(lean(_matcher(index, keys)), ddl))
    one = found[0]
    if several:
        for more in found[1:]:
            one = one.unionByName(more)
        one = one.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("th").alias("th"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")).drop("row")
    out = one.mapInArrow(lean(_summary), f"doc_id {kind}, th long, n_words long, n_hit long, longest_hit long, n_items long, items_sha256 string, items array<string>")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))
