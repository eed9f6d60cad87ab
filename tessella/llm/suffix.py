"""Removal of long repeated strings by a distributed difference-cover suffix sort.

Suffixes are those that start at anchors: places that the text itself fixes, since each window of ``window - GRAM + 1``
neighbouring GRAM-byte strings elects the one with the least hash. Equal strings of ``window`` bytes elect the same
anchor at the same offset, so none is missed, and there is one anchor in about a hundred bytes. The text from one anchor
to the end of the next one's string is a phrase; a document is the sequence of its phrases' names.

Sequences are sorted by the difference-cover algorithm: triples of names at two of three positions are sorted and named,
undecided ones recurse on the sequence of these names, and the remaining suffixes, which are a name followed by a sorted
suffix, are merged in. Then every suffix is compared with its neighbours: a common prefix of ``window`` bytes or more is
a repeated string. Each step is a sort, join or aggregate over the cluster, no step needs a text in one place.

Common strings also reach a little past their first and last anchors. Windows there belong to an anchor whose string is
repeated; for those that are not covered yet, the texts around anchors with the same string are compared window by
window. The windows of groups too large for a task are dealt to buckets by their hash and compared there.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._shared import BROADCAST_BYTES, release, ship, stored

GROUP = 256  # different surroundings of one string that a task compares; windows of larger groups are dealt by hash
BUCKET = 64  # surroundings of a large group for each bucket that its windows are dealt to
SLICE_BYTES = 2 << 20
MAX_ROUNDS = 40
MULT = 0xD1342543DE82EF95  # odd, for polynomial hashes modulo 2 ** 64
STARTS = bytes([*range(128), *range(192, 256)])  # bytes that a character of UTF-8 may start with
#: One row of letters' values for each of two hashes that do not depend on one another.
LETTER = np.random.default_rng(20240229).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Hashes:
    """Hash of any stretch of a byte string in constant time; ``kind`` 0 and 1 are two different hashes."""

    _power = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray, kind: int = 0) -> None:
        n = len(data) + 1
        if len(Hashes._power) < n:
            size = 1 << (n - 1).bit_length()
            for name, m in (("_power", MULT), ("_inverse", pow(MULT, -1, 1 << 64))):
                steps = np.full(size, m, np.uint64)
                steps[0] = 1
                setattr(Hashes, name, np.cumprod(steps, dtype=np.uint64))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(LETTER[kind][data] * Hashes._power[: n - 1], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * Hashes._inverse[start]
        h ^= (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h


def anchors(texts: list[bytes], window: int, gram: int) -> dict[str, np.ndarray]:
    """Per stretch of windows that elect one anchor: the text's number, the anchor ``p``, first and last window start
    ``lo`` and ``hi``, hash ``g`` of the anchor's string, hash ``c`` of all that the windows cover, and the phrase that
    starts here (``name``, 0 if no anchor follows, and a second hash of it, ``check``) with its length to the next anchor."""
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    empty = np.zeros(0, np.int64)
    if len(data) < window:
        return {k: empty for k in ("text", "p", "lo", "hi", "g", "c", "name", "check", "length")}
    end = np.cumsum(size)
    h = Hashes(data)
    at = np.arange(len(data) - gram + 1)
    least = (h.of(at, at + gram) >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)  # of equal ones the leftmost
    span, width = 1, window - gram + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    start = np.arange(len(least))
    text = np.searchsorted(end, start, side="right")
    ok = start + window <= end[text]
    start, text, p = start[ok], text[ok], (least[ok] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(start):
        return {k: empty for k in ("text", "p", "lo", "hi", "g", "c", "name", "check", "length")}
    new = np.r_[True, (p[1:] != p[:-1]) | (text[1:] != text[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(p)] - 1
    text, p, lo, hi = text[first], p[first], start[first], start[last]
    follows = np.r_[text[1:] == text[:-1], False]
    nxt = np.where(follows, np.r_[p[1:], 0], p)
    name = np.where(follows, h.of(p, nxt + gram) | np.uint64(1), np.uint64(0))
    check = Hashes(data, 1).of(p, nxt + gram)
    base = (end - size)[text]
    return {
        "text": text, "p": p - base, "lo": lo - base, "hi": hi - base, "g": h.of(p, p + gram).view(np.int64), "c": (h.of(lo, hi + window) ^ (p - lo).astype(np.uint64)).view(np.int64),
        "name": (name >> np.uint64(1)).view(np.int64), "check": check.view(np.int64), "length": np.where(follows, nxt - p, 0),
    }


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _scan(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for part in _slices(batches):
            a = anchors([t or b"" for t in part.column("text").to_pylist()], window, gram)
            took = pa.array(a["text"])
            first = np.flatnonzero(np.r_[True, a["text"][1:] != a["text"][:-1]]) if len(a["text"]) else np.zeros(0, np.int64)
            j = np.arange(len(a["text"])) - np.repeat(first, np.diff(np.r_[first, len(a["text"])]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc").take(took), part.column("th").take(took), pa.array(a["text"] + row), pa.array(j.astype(np.int32)), *(pa.array(a[k].astype(np.int32)) for k in ("p", "lo", "hi")), *(pa.array(a[k]) for k in ("g", "c", "name", "check")), pa.array(a["length"].astype(np.int32))],
                ["doc", "th", "row", "j", "p", "lo", "hi", "g", "c", "name", "check", "length"],
            )
            row += part.num_rows

    return run


def settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are done; it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _ordered(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """``df`` in the global order of ``keys`` with ``part`` and ``at``, which rise with the order, written down. Keys
    that end in a row's own place let many equal rows spread over parts."""
    return stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), name)


def _before(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """For each unsampled suffix of ``df`` the rank ``(a, b)`` of the last sampled one before it in the order of
    ``keys``. Sampled ranks rise along the order, so that is their running maximum."""
    df = _ordered(df, name, *keys)
    none = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    own = F.when(F.col("ra").isNotNull(), F.struct(F.col("ra").alias("a"), F.col("rb").alias("b")))
    tops = df.groupBy("part").agg(F.max(own).alias("top"))  # one row for each partition
    carried = tops.select("part", F.max("top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    here = F.max(own).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    got = df.withColumn("here", here).where("ra is null").join(F.broadcast(carried), "part")
    got = stored(got.select("seq", "j", F.coalesce(F.greatest("here", "carried"), none).alias(name)), "before")
    release(df)
    return got


def _next(column: str, step: int) -> Column:
    """The value ``step`` positions on in the same sequence, 0 behind its end or a gap."""
    by = Window.partitionBy("seq").orderBy("j")
    # positions rise, so a place that many rows on has no gap before it
    return F.coalesce(F.when(F.lead("j", step).over(by) == F.col("j") + step, F.lead(column, step).over(by)), F.lit(0).cast("long"))


def suffix_ranks(names: DataFrame, enough: int, depth: int = 0) -> DataFrame:
    """``(seq, j, rank)`` for ``names(seq, j, name, cover)``: ranks rise with the order of the suffixes that start at
    ``j``. Suffixes that agree over ``enough`` in covered bytes may have any order among themselves."""
    spark = names.sparkSession
    long0 = F.lit(0).cast("long")
    all_ = names.withColumns({"n2": _next("name", 1), "n3": _next("name", 2)})
    all_ = all_.withColumn("cover3", F.col("cover") + _next("cover", 1) + _next("cover", 2))
    all_ = stored(all_, f"triples{depth}")
    sampled = all_.where("j % 3 <> 0")
    triples = sampled.groupBy("name", "n2", "n3").agg(F.count("*").alias("n"), F.min("cover3").alias("least"))
    order = _ordered(triples, f"named{depth}", "name", "n2", "n3")
    named = order.select("name", "n2", "n3", "n", "least", (F.col("at") + 1).alias("ra"))
    known = decided = stored(sampled.join(named, ["name", "n2", "n3"]).select("seq", "j", "cover3", "ra", ((F.col("n") > 1) & (F.col("least") < enough) & (F.col("n3") > 0)).alias("open")), f"sampled{depth}")
    release(order)
    if not depth:
        settle(spark)
    if known.where("open").head(1):
        if depth >= MAX_ROUNDS:  # each round triples what a name covers
            raise RuntimeError(f"suffixes are not told apart after {depth} rounds")
        # the sequences of names at positions 1 and 2 modulo 3; of decided names only those that follow open ones matter
        deep = known.withColumns({"s2": F.xxhash64("seq", F.col("j") % 3), "j2": F.floor(F.col("j") / 3).cast("int")})
        chain = deep.select(F.col("s2").alias("seq"), F.col("j2").alias("j"), F.col("ra").alias("name"), F.col("cover3").alias("cover"), "open")
        by = Window.partitionBy("seq").orderBy("j")
        follows = F.coalesce((F.lag("j").over(by) == F.col("j") - 1) & F.lag("open").over(by), F.lit(False))
        chain = chain.withColumn("wanted", F.col("open") | follows).where("wanted").select("seq", "j", "name", "cover")
        chain = stored(chain, f"chain{depth}")
        deeper = suffix_ranks(chain, enough, depth + 1)
        deeper = deep.join(deeper.select(F.col("seq").alias("s2"), F.col("j").alias("j2"), F.col("rank").alias("rb")), ["s2", "j2"]).select("seq", "j", "rb")
        known = known.join(deeper, ["seq", "j"], "left").select("seq", "j", "ra", F.when(F.col("open"), F.coalesce("rb", long0)).otherwise(long0).alias("rb"))
    else:
        known = known.select("seq", "j", "ra", long0.alias("rb"))
    both = all_.join(known, ["seq", "j"], "left").select("seq", "j", "name", "n2", "ra", "rb")
    for k in (1, 2):
        both = both.withColumns({f"a{k}": _next("ra", k), f"b{k}": _next("rb", k)})
    both = stored(both, f"merge{depth}")
    release(all_, decided)
    if not depth:
        settle(spark)
    one = _before(both.where("j % 3 <> 2"), f"one{depth}", "name", "a1", "b1", "seq", "j")
    two = _before(both.where("j % 3 <> 1"), f"two{depth}", "name", "n2", "a2", "b2", "seq", "j")
    rest = both.where("ra is null").join(one, ["seq", "j"]).join(two, ["seq", "j"])
    last = F.greatest(f"one{depth}", f"two{depth}")
    rest = rest.select("seq", "j", last["a"].alias("ra"), last["b"].alias("rb"), F.lit(1).alias("behind"), "name", "a1", "b1")
    merged = both.where("ra is not null").select("seq", "j", "ra", "rb", F.lit(0).alias("behind"), long0.alias("name"), long0.alias("a1"), long0.alias("b1")).unionByName(rest)
    out = _ordered(merged, f"ranks{depth}", "ra", "rb", "behind", "name", "a1", "b1", "seq", "j").select("seq", "j", (F.col("at") + 1).alias("rank"))
    release(both, one, two)
    if not depth:
        settle(spark)
    return out


def _cut(window: int):
    """The texts that listed anchors' windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            out = [(w["g"], w["c"], w["n"], w["p"] - w["lo"], t[w["lo"] : w["hi"] + window]) for t, ws in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist(), strict=True) for w in ws]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["g", "c", "n", "offset", "around"])

    return run


def _windows(around: list[bytes], offset: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each window of each text, the first with its distance to the anchor; the text's number and the
    window's start."""
    size = np.array([len(t) for t in around], np.int64)
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(around), np.uint8)
    count = size - window + 1
    text = np.repeat(np.arange(len(around)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = begin[text] + at
    first, second = (Hashes(data, kind).of(start, start + window) for kind in (0, 1))
    return first ^ ((offset[text] - at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), second, text, at


def _runs(text: np.ndarray, at: np.ndarray, hit: np.ndarray, total: int) -> list[list[int]]:
    """Runs of window starts that are hit, as flat lists of first and last, by text."""
    out: list[list[int]] = [[] for _ in range(total)]
    text, at = text[hit], at[hit]
    if len(text):
        new = np.r_[True, (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(text)] - 1
        for t, a, b in zip(text[first].tolist(), at[first].tolist(), at[last].tolist(), strict=True):
            out[t] += [a, b]
    return out


def _compare(window: int):
    """Windows that occur twice around anchors with one string; rows come sorted by ``g``, whole groups together."""

    def work(cols):
        g, c, n, offset, around = cols
        key, check, text, at = _windows(around, offset, window)
        key ^= g.view(np.uint64)[text] * np.uint64(0xBF58476D1CE4E5B9)
        order = np.argsort(key)
        new = np.r_[True, (key[order[1:]] != key[order[:-1]]) | (check[order[1:]] != check[order[:-1]])]
        kind = np.empty(len(key), np.int64)
        kind[order] = np.cumsum(new) - 1
        hit = np.bincount(kind, weights=n[text])[kind] > 1
        return pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), pa.array(_runs(text, at, hit, len(g)), pa.list_(pa.int32()))], ["g", "c", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                cols = [part.column(k).to_numpy(zero_copy_only=False) for k in ("g", "c", "n", "offset")] + [part.column("around").to_pylist()]
                if held is not None:
                    cols = [np.concatenate([a, b]) for a, b in zip(held[:4], cols[:4], strict=True)] + [held[4] + cols[4]]
                if not len(cols[0]):
                    continue
                cut = int(np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])[-1])
                if cut:
                    yield work([c[:cut] for c in cols])
                held = [c[cut:] for c in cols]
        if held is not None and len(held[0]):
            yield work(held)

    return run


def _kinds(*by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows that puts equal ones side by side, and the number of each row's kind in that order."""
    order = np.lexsort(by)
    new = np.zeros(len(order), bool)
    for x in by:
        x = x[order]
        new[1:] |= x[1:] != x[:-1]
    return order, np.cumsum(new)


def _deal(window: int):
    """Of large groups' surroundings, windows dealt by hash to as many buckets as the group's size asks for. Windows that
    repeat among the rows at hand are decided: they come out as ``runs``, and go to their bucket once, as repeated
    (``at`` -1); the others go with their place."""
    ddl = ["g", "c", "runs", "bucket", "keys", "checks", "cs", "ats"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                g, c, n, offset, buckets = (part.column(k).to_numpy(zero_copy_only=False) for k in ("g", "c", "n", "offset", "buckets"))
                key, check, text, at = _windows(part.column("around").to_pylist(), offset, window)
                order, kind = _kinds(check, key, g[text])
                total = np.bincount(kind, weights=n[text][order])
                hit = np.empty(len(key), bool)
                hit[order] = total[kind] > 1
                first = np.zeros(len(key), bool)
                first[order[np.r_[True, kind[1:] != kind[:-1]][: len(kind)]]] = True
                out = [[x, y, r, None, None, None, None, None] for x, y, r in zip(g.tolist(), c.tolist(), _runs(text, at, hit, len(g)), strict=True) if r]
                send = np.flatnonzero(first)  # a window that is not repeated here is its kind's first
                bucket = (key[send] % buckets[text[send]].astype(np.uint64)).astype(np.int64)
                by = np.lexsort((bucket, g[text[send]]))
                send, bucket = send[by], bucket[by]
                own = g[text[send]]
                cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (bucket[1:] != bucket[:-1]), True]) if len(send) else []
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    w = send[a:b]
                    out.append([int(own[a]), None, None, int(bucket[a]), key[w].view(np.int64), check[w].view(np.int64), c[text[w]], np.where(hit[w], -1, at[w]).astype(np.int32)])
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ddl)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of a bucket that occur in it twice, or once as repeated: the starts of each surrounding's; rows come sorted
    by group and bucket."""

    def work(rows: list[dict]) -> list[tuple[int, int, list[int]]]:
        key, check, c, at = (np.concatenate([r[k] for r in rows]) for k in ("keys", "checks", "cs", "ats"))
        order, kind = _kinds(check, key)
        c, at = c[order], at[order]
        hit = (np.bincount(kind)[kind] > 1) & (at >= 0)
        c, at = c[hit], at[hit]
        by = np.argsort(c, kind="stable")
        c, at = c[by], at[by]
        cut = np.flatnonzero(np.r_[True, c[1:] != c[:-1], True]) if len(c) else []
        return [(rows[0]["g"], int(c[a]), at[a:b].tolist()) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def batch_of(found: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["g", "c", "starts"])

    held: list[dict] = []
    for batch in batches:
        found = []
        for i in range(batch.num_rows):
            row = {k: batch.column(k)[i].as_py() for k in ("g", "bucket")} | {k: batch.column(k)[i].values.to_numpy() for k in ("keys", "checks", "cs", "ats")}
            if held and (held[0]["g"], held[0]["bucket"]) != (row["g"], row["bucket"]):
                found += work(held)
                held = []
            held.append(row)
        held = [r | {k: r[k].copy() for k in ("keys", "checks", "cs", "ats")} for r in held]
        yield batch_of(found)
    if held:
        yield batch_of(work(held))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of window starts to runs."""
    for part in batches:
        starts = [sorted(x) for x in part.column("starts").to_pylist()]
        text = np.repeat(np.arange(len(starts)), [len(x) for x in starts])
        at = np.array([i for x in starts for i in x], np.int64)
        yield pa.RecordBatch.from_arrays([part.column("g"), part.column("c"), pa.array(_runs(text, at, np.ones(len(at), bool), len(starts)), pa.list_(pa.int32()))], ["g", "c", "runs"])


def _with_lists(docs: DataFrame, lists: DataFrame, how: str, column: str, width: int) -> DataFrame:
    """``docs`` with their row of ``lists``, whose ``column`` has elements of ``width`` bytes."""
    few = (lists.agg(F.sum(F.size(column).cast("long") * width + 64)).first()[0] or 0) <= BROADCAST_BYTES
    right = lists.withColumnsRenamed({"doc": "doc_", "th": "th_"})
    return docs.join(F.broadcast(right) if few else right, docs.doc.eqNullSafe(right.doc_) & docs.th.eqNullSafe(right.th_), how).drop("doc_", "th_")


def _ahead(enough: int):
    """Of each phrase, the second hashes and lengths from it on until they cover ``enough`` bytes; rows come sorted by
    sequence and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int32, np.int64)]

        def out(cols):
            seq, j, cover, p, check = cols
            n = len(seq)
            new = np.r_[True, (seq[1:] != seq[:-1]) | (j[1:] != j[:-1] + 1)][:n]
            first = np.flatnonzero(new)
            stop = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n])) if n else first  # where the run ends
            upto = np.cumsum(cover)
            end = np.minimum(np.searchsorted(upto, upto - cover + enough) + 1, stop)
            ends = np.r_[0, np.cumsum(end - np.arange(n))]
            at = np.repeat(np.arange(n) - ends[:-1], np.diff(ends)) + np.arange(ends[-1])
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v[at])) for v in (check, cover.astype(np.int32))]
            return pa.RecordBatch.from_arrays([pa.array(seq), pa.array(j), pa.array(p), *lists], ["seq", "j", "p", "checks", "sizes"])

        for batch in batches:
            cols = [np.concatenate([a, batch.column(k).to_numpy(zero_copy_only=False)]) for a, k in zip(held, ("seq", "j", "cover", "p", "check"), strict=True)]
            if len(cols[0]):
                cut = int(np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])[-1])  # the last sequence may go on
                yield out([c[:cut] for c in cols])
                held = [c[cut:] for c in cols]
        yield out(held)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each sequence joined where they meet, a row for each."""
    for part in batches:
        lists = part.column("spans")
        n = np.diff(lists.offsets.to_numpy())
        at = np.repeat(np.arange(part.num_rows), n)
        s, e = (lists.flatten().field(k).to_numpy().astype(np.int64) for k in ("s", "e"))
        order = np.lexsort((s, at))
        at, s, e = at[order], s[order], e[order]
        lift = at << np.int64(40)  # keeps sequences apart in the running maximum
        reach = np.maximum.accumulate(e + lift) if len(e) else e
        first = np.flatnonzero(np.r_[True, s[1:] + lift[1:] > reach[:-1]][: len(s)])
        last = np.r_[first[1:], len(s)][: len(first)] - 1
        yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(at[first])), pa.array(s[first]), pa.array((reach - lift)[last])], ["row", "s", "e"])


def repeated_spans(src: DataFrame, window: int) -> DataFrame:
    """``(doc, th, start, end)`` of bytes of ``src(doc, th, text)`` that repeated strings of ``window`` bytes cover."""
    spark = src.sparkSession
    gram = window // 4
    doc = src.schema["doc"].dataType.simpleString()
    key = f"doc {doc}, th long"
    places = stored(src.mapInArrow(_scan(window, gram), f"{key}, row long, j int, p int, lo int, hi int, g long, c long, name long, check long, length int"), "anchors")
    often = places.groupBy("g").agg(F.count("*").alias("times")).where("times > 1").select("g")
    often = stored(often, "often")  # a plain table, so that Spark may split this join where a string is very common
    found = places
    places = stored(found.join(often, "g"), "repeated")
    release(found, often)
    settle(spark)

    # Suffix sort of the phrases that occur twice; a phrase that occurs once ends what any suffix can share.
    twice = places.where("name <> 0").groupBy("name").agg(F.count("*").alias("times")).where("times > 1").select("name")
    twice = stored(twice, "twice")
    phrases = stored(places.where("name <> 0").join(twice, "name").select(F.col("row").alias("seq"), "j", "name", "check", F.col("length").cast("long").alias("cover"), "p"), "phrases")
    ranks = suffix_ranks(phrases.select("seq", "j", "name", "cover"), window - gram)
    ahead = phrases.repartition("seq").sortWithinPartitions("seq", "j").mapInArrow(_ahead(window - gram), "seq long, j int, p int, checks array<bigint>, sizes array<int>")
    order = _ordered(ahead.join(ranks, ["seq", "j"]).select(F.col("seq").alias("row"), "p", "checks", "sizes", "rank"), "order", "rank")
    own = F.struct("row", "p", "checks", "sizes")
    pairs = order.select(own.alias("x"), F.lag(own).over(Window.partitionBy("part").orderBy("at")).alias("y"))
    ends = order.groupBy("part").agg(F.min_by(own, "at").alias("x"), F.max_by(own, "at").alias("l"))  # one row for each part
    ends = ends.select("x", F.lag("l").over(Window.orderBy("part")).alias("y"))
    pairs = pairs.unionByName(ends).where(F.col("x.checks")[0] == F.col("y.checks")[0])
    # What two neighbours share: phrases up to the first that differs, and the string at the anchor behind them. One hash
    # has put them side by side; what counts is whether the other one, which does not depend on it, agrees.
    same = F.zip_with("x.checks", "y.checks", lambda a, b: a.eqNullSafe(b))
    equal = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")
    size = F.aggregate(F.slice("x.sizes", F.lit(1), equal), F.lit(0), lambda a, n: a + n) + gram
    pairs = pairs.withColumn("size", size).where(F.col("size") >= window)
    found = pairs.select(F.explode(F.array("x", "y")).alias("z"), "size").select("z.row", "z.p", "size")
    spans = F.collect_set(F.struct(F.col("p").alias("s"), (F.col("p") + F.col("size")).alias("e")))
    marked = stored(found.groupBy("row").agg(spans.alias("spans")).mapInArrow(_merged, "row long, s long, e long"), "marked")
    release(phrases, order)
    settle(spark)

    # Anchors with windows that no such span covers: of a text's spans, which do not meet, the last that starts before
    # an anchor's first window must reach to the end of its last one.
    none = {c: F.lit(None).cast(places.schema[c].dataType) for c in ("doc", "th", "p", "hi", "g", "c")}
    starts = marked.select("row", F.col("s").alias("lo"), F.col("e"), F.lit(0).alias("kind")).withColumns(none)
    both = starts.unionByName(places.select("row", F.col("lo").cast("long").alias("lo"), F.lit(None).cast("long").alias("e"), F.lit(1).alias("kind"), *none))
    reach = F.max("e").over(Window.partitionBy("row").orderBy("lo", "kind").rowsBetween(Window.unboundedPreceding, 0))
    left = both.withColumn("reach", reach).where("kind = 1").withColumn("covered", F.coalesce(F.col("reach") >= F.col("hi") + window, F.lit(False)))
    left = stored(left.select("doc", "th", "p", "lo", "hi", "g", "c", "covered"), "left")
    groups = left.groupBy("g").agg(F.bool_or(~F.col("covered")).alias("open")).where("open").select("g")
    groups = stored(groups, "groups")
    kinds = left.join(groups, "g").groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc", "th", "p", "lo", "hi")).alias("one"))
    kinds = stored(kinds.select("g", "c", "n", "one.*"), "kinds")
    wanted = kinds.groupBy("doc", "th").agg(F.collect_list(F.struct("g", "c", "n", "p", "lo", "hi")).alias("wanted"))
    texts = _with_lists(src, stored(wanted, "wanted"), "inner", "wanted", 48).select("text", "wanted")
    texts = stored(texts.mapInArrow(_cut(window), "g long, c long, n long, offset int, around binary").dropDuplicates(["g", "c"]), "around")
    big = texts.groupBy("g").agg(F.count("*").alias("kinds")).where(F.col("kinds") > GROUP)
    big = stored(big, "big")
    small = texts.join(big.select("g"), "g", "left_anti").repartition("g").sortWithinPartitions("g")
    runs = small.mapInArrow(_compare(window), "g long, c long, runs array<int>")
    if big.head(1):
        dealt = texts.join(big.select("g", F.ceil(F.col("kinds") / BUCKET).alias("buckets")), "g").mapInArrow(_deal(window), "g long, c long, runs array<int>, bucket long, keys array<bigint>, checks array<bigint>, cs array<bigint>, ats array<int>")
        dealt = stored(dealt, "dealt")
        met = dealt.where("bucket is not null").select("g", "bucket", "keys", "checks", "cs", "ats").repartition("g", "bucket").sortWithinPartitions("g", "bucket").mapInArrow(_meet, "g long, c long, starts array<int>")
        met = met.groupBy("g", "c").agg(F.flatten(F.collect_list("starts")).alias("starts"))  # windows of one surrounding, a bounded number
        runs = runs.unionByName(dealt.where("runs is not null").select("g", "c", "runs")).unionByName(met.mapInArrow(_gathered, "g long, c long, runs array<int>"))
    runs = runs.select("g", "c", F.explode(F.expr("transform(sequence(0, greatest(size(runs), 1) - 1, 2), i -> struct(get(runs, i) as a, get(runs, i + 1) as b))")).alias("r")).where("r.a is not null").select("g", "c", "r.a", "r.b")
    more = left.where("not covered").join(stored(runs, "runs"), ["g", "c"]).select("doc", "th", (F.col("lo") + F.col("a")).alias("start"), (F.col("lo") + F.col("b") + window).alias("end"))
    first = places.select("doc", "th", "row").distinct().join(marked, "row").select("doc", "th", F.col("s").alias("start"), F.col("e").alias("end"))
    return first.unionByName(more)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 400) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``n_chars``, the
    characters whose first byte is left, and ``kept``, the bytes that are left. A byte goes if a string of ``window`` bytes that covers it also starts anywhere else.

    Null texts are empty. Rows that repeat, id and text, are places of their own: all their windows are repeated. Null
    ids are ids like others. Texts below ``window`` bytes and empty tables pass through. Only the two named columns are
    read, so other columns cannot clash.
    """
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).select("doc", F.xxhash64("text").alias("th"), "text")
    spans = stored(repeated_spans(src, window), "spans")
    lists = stored(spans.groupBy("doc", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "lists")
    settle(spark)
    whole = _with_lists(src, lists, "left", "spans", 40).select("doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            sizes, gone, count, digest, chars, kept = [], [], [], [], [], []
            for t, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                at, runs, left = 0, 0, []
                for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
                    if a > at or not runs:
                        left.append(t[at:a])
                        runs += 1
                    at = max(at, b)
                left.append(t[at:])
                rest = b"".join(left)
                sizes.append(len(t))
                gone.append(len(t) - len(rest))
                count.append(runs)
                digest.append(hashlib.sha256(rest).hexdigest())
                chars.append(len(rest) - len(rest.translate(None, STARTS)))
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([part.column("doc"), *(pa.array(x, pa.int64()) for x in (sizes, gone, count)), pa.array(digest), pa.array(chars, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_chars", "kept"])

    return whole.mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("kept", T.BinaryType())]))
