"""Line dedup by a deletion-neighbourhood join.

Two lines are the same if their words are, and near if one word inserted, dropped or changed makes them so. Each line
that may have a partner emits itself and every variant with one word left out as hashed keys; a changed word leaves equal
variants at one place, a dropped word leaves a variant equal to the other line. Equal keys are joined through the
earliest line that has them, never pair by pair; the words of line and partner are then compared, and the earliest
stays.

Lines may have a partner only if another line has the same first or last half, since one edit leaves a half as it is.
Halves are compared by hash first, so only lines that pass are read again and emit variants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._shared import BROADCAST_BYTES, fresh, lean, mapped, named, ship, stored

LEAST_BYTES = 10  # of the words of a line, default: shorter lines stay as they are
LEAST_WORDS = 8  # default: shorter lines are only compared whole
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 3 << 20
WHOLE, LEFT_OUT, PLACED = 0, 1, 2  # kinds of keys


def words_of(line: bytes) -> list[bytes]:
    return line.lower().split()


def half(n: int) -> int:
    """Words at either end that an edit on the other side cannot touch; in steps, so that lines of nearly one length
    have a size in common."""
    return max(2 * ((n - 1) // 4), int(n > 1))


def half_keys(words: list[bytes]) -> list[int]:
    """Hashes of first and last halves, of each size that a line one word longer or shorter may use."""
    n = len(words)
    out = []
    for h in sorted({half(n - 1), half(n), half(n + 1)}):
        if 0 < h <= n - 1:
            out.append(xxhash.xxh64_intdigest(b" ".join(words[:h]), 2 * h))
            out.append(xxhash.xxh64_intdigest(b" ".join(words[n - h :]), 2 * h + 1))
    return out


def variant_keys(words: list[bytes]) -> np.ndarray:
    """Two hashes for each key: the line itself; each variant with a word left out, once with the place (a changed word)
    and once without (a word that the other line has not got)."""
    n = len(words)
    out = []
    with np.errstate(over="ignore"):
        for seed in (1, 2):
            w = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in words), np.uint64, n)
            power = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)], dtype=np.uint64)[:-1]
            sums = np.r_[np.uint64(0), np.cumsum(w * power, dtype=np.uint64)]
            left_out = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(INVERSE)
            place = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            out.append(np.r_[sums[-1:], left_out, left_out ^ place ^ (left_out >> np.uint64(31))])
    return np.stack(out).view(np.int64)


def near(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word edit at most leads from one to the other."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    front = next((i for i in range(n) if a[i] != b[i]), n)
    back = next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)
    return front + back >= max(len(a), len(b)) - 1


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _lines(least_bytes: int, least_words: int):
    """Per line of at least ``least_bytes``: its hash and half keys; ``again`` if the document has had it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            doc, no, again, h1, h2, keys = [], [], [], [], [], []
            for at, text in enumerate(part.column("text").to_pylist()):
                seen = set()
                for i, line in enumerate((text or b"").split(b"\n")):
                    words = words_of(line)
                    flat = b" ".join(words)
                    if not flat or len(flat) < least_bytes:
                        continue
                    h = xxhash.xxh3_128_intdigest(flat)
                    doc.append(at)
                    no.append(i)
                    again.append(h in seen)
                    h1.append(h >> 64)
                    h2.append(h & (1 << 64) - 1)
                    keys.append(half_keys(words) if len(words) >= least_words and h not in seen else [])
                    seen.add(h)
            flat = np.array([k for ks in keys for k in ks], np.uint64).view(np.int64)
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            took = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc").take(took), part.column("th").take(took), pa.array(no, pa.int32()), pa.array(again, pa.bool_()),
                    pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(np.array(h2, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                ["doc", "th", "line", "again", "h1", "h2", "keys"],
            )

    return run


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of listed lines."""
    for part in _slices(batches):
        doc, no, out = [], [], []
        for at, (text, picked) in enumerate(zip(part.column("text").to_pylist(), part.column("picked").to_pylist(), strict=True)):
            each = (text or b"").split(b"\n")
            for i in picked:
                doc.append(at)
                no.append(i)
                out.append(b" ".join(words_of(each[i])))
        took = pa.array(doc, pa.int64())
        yield pa.RecordBatch.from_arrays([part.column("doc").take(took), part.column("th").take(took), pa.array(no, pa.int32()), pa.array(out, pa.binary())], ["doc", "th", "line", "flat"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            keys = [variant_keys(t.split(b" ")) for t in part.column("flat").to_pylist()]
            if not keys:
                continue
            row = pa.array(np.repeat(np.arange(len(keys)), [k.shape[1] for k in keys]))
            both = np.concatenate(keys, 1)
            kind = np.concatenate([np.repeat([WHOLE, LEFT_OUT, PLACED], [1, k.shape[1] // 2, k.shape[1] // 2]) for k in keys]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(kind), *(part.column(c).take(row) for c in ("doc", "th", "line"))], ["k1", "k2", "kind", "doc", "th", "line"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        ok = [near(a.split(b" "), b.split(b" ")) for a, b in zip(part.column("flat").to_pylist(), part.column("other").to_pylist(), strict=True)]
        rows = pa.array(np.flatnonzero(ok))
        yield pa.RecordBatch.from_arrays([part.column(c).take(rows) for c in ("doc", "th", "line")], ["doc", "th", "line"])


def _with_lists(docs: DataFrame, lists: DataFrame, how: str, column: str, on: list[str]) -> DataFrame:
    """Documents with their list of line numbers; the lists are broadcast only if they are small."""
    lists = stored(lists, "lists")
    few = (lists.agg(F.sum(F.size(column).cast("long") * 8 + 64)).first()[0] or 0) <= BROADCAST_BYTES
    return docs.join(F.broadcast(lists) if few else lists, on, how)


def _flipped(*names: str) -> list:
    return [F.bitwise_not(c).alias(f"k{i}") for i, c in enumerate(names, 1)]


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_bytes: int = LEAST_BYTES, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc, th, line)``: lines, counted from 0, that an earlier one equals but for one word; earlier by ``doc_id``, then
    by ``th``, the text's hash, then by place in the text."""
    if least_words < 2:
        raise ValueError("all lines of one word are one edit apart")
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    src = docs.select(named(doc_id).alias("doc"), named(text).cast("binary").alias("text")).where("doc is not null").select("doc", F.xxhash64("text").alias("th"), "text")
    lines = stored(src.mapInArrow(lean(_lines(least_bytes, least_words)), f"doc {kind}, th long, line int, again boolean, h1 long, h2 long, keys array<bigint>"), "lines")
    n = lines.count()
    firsts = lines.where("not again")
    row = F.struct("doc", "th")
    several = firsts.groupBy("h1", "h2").agg(F.min(row).alias("m"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "m")
    # The join is on other values than the aggregate, so that both sides are dealt anew and Spark may split the rows of a
    # very common line.
    several = several.select(*_flipped("h1", "h2"), "m")
    told = firsts.withColumns({"k1": F.bitwise_not("h1"), "k2": F.bitwise_not("h2")}).join(several, ["k1", "k2"], "left")
    told = stored(told.select("doc", "th", "line", "keys", "h1", F.coalesce(row > F.col("m"), F.lit(False)).alias("copy")), "told", n)
    copies = lines.where("again").select("doc", "th", "line").unionByName(told.where("copy").select("doc", "th", "line"))

    halves = told.where("not copy").select("doc", "th", "line", "h1", F.explode("keys").alias("key"))
    shared = halves.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select(F.bitwise_not("key").alias("k1"))
    picked = halves.withColumn("k1", F.bitwise_not("key")).join(shared, "k1").select("doc", "th", "line").distinct()
    lists = picked.groupBy("doc", "th").agg(F.sort_array(F.collect_list("line")).alias("picked"))
    texts = _with_lists(src, lists, "inner", "picked", ["doc", "th"]).select("doc", "th", "text", "picked")
    texts = stored(texts.mapInArrow(lean(_pick), f"doc {kind}, th long, line int, flat binary").dropDuplicates(["doc", "th", "line"]), "texts", 2 * n)
    variants = texts.mapInArrow(lean(_variants), f"k1 long, k2 long, kind byte, doc {kind}, th long, line int")
    own = F.struct("doc", "th", "line")
    # A whole line is near every line that becomes it with a word left out, but those are not all near one another; lines
    # that are equal but for the word at one place are.
    of = lambda k: F.min(F.when(F.col("kind") == k, own))
    first = variants.groupBy("k1", "k2").agg(F.count("*").alias("n"), of(WHOLE).alias("w"), of(LEFT_OUT).alias("d"), of(PLACED).alias("p")).where("n > 1 and (p is not null or w is not null and d is not null)")
    partner = F.when(F.col("kind") == WHOLE, F.col("d")).when(F.col("kind") == LEFT_OUT, F.col("w")).otherwise(F.col("p"))
    pairs = variants.join(first, ["k1", "k2"]).withColumn("e", partner).where(F.col("e") < own).select("doc", "th", "line", F.col("e.doc").alias("doc2"), F.col("e.th").alias("th2"), F.col("e.line").alias("line2")).distinct()
    other = texts.select(F.col("doc").alias("doc2"), F.col("th").alias("th2"), F.col("line").alias("line2"), F.col("flat").alias("other"))
    near_ones = pairs.join(texts, ["doc", "th", "line"]).join(other, ["doc2", "th2", "line2"]).select("doc", "th", "line", "flat", "other").mapInArrow(lean(_verified), f"doc {kind}, th long, line int")
    return copies.unionByName(near_ones).distinct()


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_bytes: int = LEAST_BYTES, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without repeated lines, with ``n_lines`` (before) and ``n_removed``.

    Words are runs without ASCII white space, with A-Z as a-z. Lines of under ``least_bytes`` bytes stay, and so do lines
    without words; lines of under ``least_words`` words go only if equal to an earlier one. Texts are read whole, a very
    long one is one task's work. Null texts stay null and have no lines, empty ones have one line, which stays.

    A document is an id with a text: rows with one id and different texts are documents of their own, rows that repeat
    both are one, a line has one place in them and they all lose the same lines. Rows with a null id stay as they are and
    count for no other. No row goes, also if all its lines do; an empty table gives an empty one. Other columns stay as
    they are, whatever their names; columns named ``n_lines`` and ``n_removed`` are replaced.
    """
    made = ("n_lines", "n_removed")
    kept = [c for c in docs.columns if c.lower() not in made]
    doc, th, lost = fresh(docs.columns, "doc", "th", "lost")
    gone = repeated_lines(docs, doc_id, text, least_bytes, least_words).groupBy(F.col("doc").alias(doc), F.col("th").alias(th)).agg(F.collect_list("line").alias(lost))
    src = docs.select(*map(named, kept), named(doc_id).alias(doc), F.xxhash64(named(text).cast("binary")).alias(th))
    whole = _with_lists(src, gone, "left", lost, [doc, th]).select(*map(named, kept), lost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            texts, before, removed = [], [], []
            for t, out in zip(part.column(text).to_pylist(), part.column(lost).to_pylist(), strict=True):
                each = t.split("\n") if t is not None else []
                drop = set(out or ())
                before.append(len(each))
                removed.append(len(drop))
                texts.append("\n".join(x for i, x in enumerate(each) if i not in drop) if t is not None else None)
            cols = [pa.array(texts, pa.string()) if c == text else part.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(before, pa.int64()), pa.array(removed, pa.int64())], [*kept, *made])

    return mapped(whole, run, T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]))
