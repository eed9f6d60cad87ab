"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints that differ in at most ``k`` bits agree on at least one of the masks that leave out ``k`` of ``m`` bit
blocks. For each mask the bits under it are the root that its members share. Below it members stand in the order of their
Gray rank, where neighbours share long bit patterns, and form a tree of nodes of ``FAN`` children; a node keeps the bits
that all of its members share. Pairs of nodes are followed from the root down. The differences of two nodes' shared bits
are a lower bound for every pair below them; a pair of children only adds the differences in bits that its parents did
not share yet, and where the sum exceeds ``k`` both groups are skipped whole. At the leaves, single codes, the sum is
their distance. Groups of all sizes are searched so. In those of over ``NODE`` members the upper levels are tables, and
each pair of nodes of that size that is left is a task. A task returns links to one member of each group it found, never
all pairs.

Few bits alone find little more than copies: texts of which 80 % of the shingles are the same differ in about 10 of 64
bits, and radii that cover this do not part unlike texts any more. With a ``share``, fingerprints are ``WORDS`` words wide,
masks keep a block of their bits each, as many as it takes for texts that alike to agree on one, and a group's members
stand in the same trees; pairs that these leave are candidates, and links are verified on the shingles themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._shared import BROADCAST_BYTES, ROW_BYTES, components, lean, named, ship, stored

BITS = 64
SEED = 42  # fixed value
NODE = 2048  # members of a node that one task compares with another's
FAN = 4  # children of a node within a task
UPPER = 64  # children of a node above
PAIRS = 1 << 17  # pairs of nodes that are followed at once
CHUNK = 1 << 16
CERTAIN = 3  # differing bits up to which texts are taken as alike without a look at their shingles
SHARE = 0.8  # common shingles of all that two texts have, from which on they are alike
WORDS = 8  # words of a wide fingerprint
BLOCK = 9  # least bits of it that a mask keeps
MISS = 1 / 56_000  # of pairs with no more than the share in common, those that agree on no block
FIRST = 4  # masks that are searched before the others
CHECK = 3  # words of it in which a candidate's differences are counted
WIDE = tuple(f"w{i}" for i in range(CHECK))
AT_ONCE = 1 << 13  # pairs of nodes followed at once where radii are wide and few are skipped


def hashes(words: list[bytes], width: int) -> list[int]:
    """XXH64 of each shingle of ``words``, or of all words if they are no more than one."""
    n = len(words)
    joined = b" ".join(words)
    hash64 = xxhash.xxh64_intdigest
    if n <= width:
        return [hash64(joined, SEED)]
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    return [hash64(joined[a:b], SEED) for a, b in zip((end - size)[: n - width + 1].tolist(), end[width - 1 :].tolist(), strict=True)]


def fingerprint(data: bytes, width: int) -> int:
    """Bits set in over half of the XXH64 of the text's word shingles; ASCII letters in lower case; no words: zero."""
    words = data.lower().split()
    return majority(hashes(words, width)) if words else 0


def majority(h: list[int]) -> int:
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(h), CHUNK):
        part = np.array(h[at : at + CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, th, fp)`` for each row, all but the id long; ``th`` is a hash of the text; null and wordless texts have
    fingerprint zero."""
    ship(df.sparkSession)
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                fps = np.array([fingerprint(t or b"", width) for t in part.column("text").to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(fps.view(np.int64))], ["doc_id", "th", "fp"])

    return _source(df, doc_id, text).mapInArrow(lean(run), f"doc_id {kind}, th long, fp long")


def _source(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(named(doc_id).alias("doc_id"), named(text).cast("binary").alias("text")).withColumn("th", F.xxhash64("text"))


def masks(n: int, k: int) -> list[int]:
    """Bit masks of which two values that differ in at most ``k`` bits share one: all but ``k`` of ``m`` blocks. ``m``
    grows with the number of values, so that a mask's groups stay small on average."""
    for m in range(k + 1, 4 * (k + 1)):
        kept = BITS * (m - k) // m
        if n <= (NODE // 8) << min(kept, 60):
            break
    cuts = [BITS * i // m for i in range(m + 1)]
    blocks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(m)]
    return [sum(blocks[i] for i in keep) for keep in combinations(range(m), m - k)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def gray_rank(c: Column) -> Column:
    """Rank of a code in Gray order, shifted so that signed comparison orders it."""
    for step in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, step))
    return c.bitwiseXOR(F.lit(-(1 << 63)))


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def tree(codes: np.ndarray, size: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Levels of the trees over groups that lie side by side, ``size`` codes each, in Gray order; from single codes up to
    one node a group. Of each node: a member (``low``), the bits that all members share (``same``), and its first child
    and number of children on the level below."""
    start = np.cumsum(size) - size
    levels = [{"low": codes, "high": codes, "same": np.full(len(codes), ~np.uint64(0))}]
    while size.max(initial=1) > 1:
        up = -(-size // FAN)
        node = np.arange(up.sum())
        first = np.repeat(start, up) + FAN * (node - np.repeat(np.cumsum(up) - up, up))
        last = levels[-1]
        low, high = np.bitwise_and.reduceat(last["low"], first), np.bitwise_or.reduceat(last["high"], first)
        levels.append({"low": low, "high": high, "same": ~(low ^ high), "first": first, "count": np.diff(np.r_[first, len(last["low"])])})
        size, start = up, np.cumsum(up) - up
    return levels


def follow(levels: list[dict[str, np.ndarray]], i: np.ndarray, j: np.ndarray, k: int, at_once: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of codes below pairs ``(i, j)`` of top nodes that differ in at most ``k`` bits; below a pair of a node
    with itself each pair comes once."""
    both = levels[-1]["same"][i] & levels[-1]["same"][j]
    sums = _bits((levels[-1]["low"][i] ^ levels[-1]["low"][j]) & both)
    todo = [(len(levels) - 1, i, j, both, sums)]
    while todo:
        level, i, j, both, sums = todo.pop()
        if level == 0:
            pair = i != j
            yield i[pair], j[pair]
            continue
        if len(i) > at_once:
            for at in range(0, len(i), at_once):
                todo.append((level, *(x[at : at + at_once] for x in (i, j, both, sums))))
            continue
        here, below = levels[level], levels[level - 1]
        child = np.arange(FAN)[:, None]  # children come first, so that loops run along the pairs
        x, y = (np.minimum(here["first"][own] + child, len(below["low"]) - 1) for own in (i, j))
        all_ = lambda op, c: op(c[x][:, None], c[y][None, :])
        differ, shared = all_(np.bitwise_xor, below["low"]), None
        if level > 1:
            shared = all_(np.bitwise_and, below["same"])
            differ &= shared
        differ &= ~both  # only what the parents did not count
        total = _bits(differ) + sums
        live = total <= k
        live &= (child < here["count"][i])[:, None] & (child < here["count"][j])
        at = np.flatnonzero(live)
        u, v, pair = at // len(i) // FAN, at // len(i) % FAN, at % len(i)
        x, y = x[u, pair], y[v, pair]
        fits = (i[pair] != j[pair]) | (x <= y)
        at = at[fits]
        if len(at):
            todo.append((level - 1, x[fits], y[fits], None if shared is None else shared.ravel()[at], total.ravel()[at]))


def close_pairs(a: np.ndarray, b: np.ndarray | None, k: int, at_once: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of codes in Gray order that differ in at most ``k`` bits: of ``a`` with ``b``, or within ``a``."""
    if b is None:
        yield from follow(tree(a, np.array([len(a)])), np.zeros(1, np.int64), np.zeros(1, np.int64), k, at_once)
        return
    levels = tree(np.concatenate([a, b]), np.array([len(a), len(b)]))
    for x, y in follow(levels, np.zeros(1, np.int64), np.ones(1, np.int64), k, at_once):
        yield x, y - len(a)


def roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least member of the component of each of ``n`` members."""
    root = np.arange(n)
    for x, y in pairs:
        while len(x):
            rx, ry = root[x], root[y]
            differ = rx != ry
            x, y, rx, ry = x[differ], y[differ], rx[differ], ry[differ]
            np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def _link(k: int, far: int | None = None):
    """Links within groups; rows come sorted by group, side and Gray rank; a group spans few batches and has two nodes
    at most. With ``far`` rows have a name, which the links are between, and more words, in which no more than ``far``
    bits differ either. Rows of one name are linked already; groups of nothing else are passed over."""
    at_once = PAIRS if far is None else AT_ONCE

    def near(pairs: Iterator[tuple[np.ndarray, np.ndarray]], words: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for x, y in pairs:
            if words:
                fits = sum(_bits(w[x] ^ w[y]).astype(np.int64) for w in words) <= far
                x, y = x[fits], y[fits]
            yield x, y

    def work(grp: np.ndarray, side: np.ndarray, fp: np.ndarray, *more: np.ndarray) -> Iterator[np.ndarray]:
        name, words = (more[0], more[1:]) if more else (fp, ())

        def joined(own: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
            names, at = np.unique(name[own], return_inverse=True)
            root = roots(len(names), ((at[x], at[y]) for x, y in near(pairs, [w[own] for w in words])))
            hit = np.flatnonzero(root != np.arange(len(names)))
            return np.stack([names[hit], names[root[hit]]])

        start = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]])
        size = np.diff(np.r_[start, len(grp)])
        whole = np.maximum.reduceat(side, start) < 2
        open_ = np.minimum.reduceat(name, start) != np.maximum.reduceat(name, start)
        several = whole & open_
        span = 1
        while span < size[several].max(initial=1):  # trees of one height are followed together
            span, least = span * FAN, span
            pick = np.flatnonzero(several & (size > least) & (size <= span))
            for at in range(0, len(pick), max(1, CHUNK // span)):
                some = pick[at : at + max(1, CHUNK // span)]
                own = np.repeat(start[some] - np.cumsum(size[some]) + size[some], size[some]) + np.arange(size[some].sum())
                codes, top = fp[own], np.arange(len(some))
                yield joined(own, follow(tree(codes, size[some]), top, top, k, at_once))
        for s, n in zip(start[~whole & open_], size[~whole & open_], strict=True):
            codes, cut = fp[s : s + n], int((side[s : s + n] < 2).sum())
            yield joined(np.arange(s, s + n), ((x, y + cut) for x, y in close_pairs(codes[:cut], codes[cut:], k, at_once)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None

        def out(cols):
            for found in work(*cols):
                if found.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in found], ["a", "b"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols[2:] = [c.view(np.uint64) for c in cols[2:]]
            if left is not None:
                cols = [np.concatenate(x) for x in zip(left, cols, strict=True)]
            if not len(cols[0]):
                continue
            cut = int(np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])[-1])  # the last group may go on
            left = [c[cut:] for c in cols]
            if cut:
                yield from out([c[:cut] for c in cols])
        if left is not None and len(left[0]):
            yield from out(left)

    return run


def links(codes: DataFrame, k: int = 3) -> DataFrame:
    """``(a, b)`` codes of distinct ``codes(fp)``: pairs whose components are those of "differ in at most k bits"."""
    ship(codes.sparkSession)
    n = codes.count()
    kept = masks(n, k)
    member = codes.select(
        "fp",
        gray_rank(F.col("fp")).alias("gray"),
        F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in kept))).alias("mask", "shared"),
    )
    sizes = member.groupBy("mask", "shared").agg(F.count("*").alias("n"))
    return _searched(member, sizes, n * len(kept), k)


def _searched(member: DataFrame, sizes: DataFrame, members: int, k: int, more: tuple[str, ...] = (), far: int | None = None) -> DataFrame:
    """``(a, b)`` links within the groups of ``member(mask, shared, fp, gray)``, which ``sizes`` counts; ``more`` columns
    are a name and words for ``_link``."""
    found, mine = _inner(member, sizes, members, k, more, far)
    if mine is None:
        return found
    name = more[0] if more else "fp"
    if more:
        # Radii are wide and nodes alike: what is linked by now goes by one name, and nodes of one name do not meet.
        found = components(found, rows=members)
        to = found.select(F.col("node").alias("was"), F.col("root").alias("now"))
        own = [F.coalesce("now", name).alias(name) if c == name else F.col(c) for c in ("mask", "shared", "fp", "gray", *more)]
        mine = _nodes(mine.join(to, mine[name] == to.was, "left").select(*own), ["mask", "shared", name, "gray"], members)
    bounds = [F.bit_and("fp").alias("low"), F.bit_or("fp").alias("high"), F.min(name).alias("least"), F.max(name).alias("most")]
    pair = _node_pairs(mine.groupBy("mask", "shared", "node").agg(*bounds), k)
    pair = stored(pair if more else pair.where("p < q"), "pairs")
    ends = pair.select(
        "mask", "shared", F.xxhash64("mask", "shared", "p", "q").alias("grp"),
        F.explode(F.when(F.col("p") == F.col("q"), F.array(F.struct(F.col("p").alias("node"), F.lit(1).alias("side")))).otherwise(F.array(F.struct(F.col("p").alias("node"), F.lit(1).alias("side")), F.struct(F.col("q").alias("node"), F.lit(2).alias("side"))))).alias("e"),
    ).select("mask", "shared", "grp", "e.node", "e.side")
    large = mine.join(ends, ["mask", "shared", "node"]).select("grp", "side", "fp", "gray", *more)
    return found.toDF("a", "b").union(_grouped(large, k, more, far))


def _inner(member: DataFrame, sizes: DataFrame, members: int, k: int, more: tuple[str, ...], far: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Links within groups of up to ``NODE`` members and within the nodes of larger ones; the members of the latter."""
    hot = stored(sizes.where(F.col("n") > NODE).select("mask", "shared"), "hot", members // NODE)
    row = [F.lit(0).alias("side"), "fp", "gray", *more]
    grp = F.xxhash64("mask", "shared").alias("grp")
    if not hot.head(1):
        return _grouped(member.select(grp, *row), k, more, far), None
    # Large groups: stretches of the Gray order are nodes, whatever their number.
    mine = _nodes(member.join(hot, ["mask", "shared"]).select("mask", "shared", "fp", "gray", *more), ["mask", "shared", "gray"], members)
    little = member.join(hot, ["mask", "shared"], "left_anti").select(grp, *row)
    return _grouped(little.unionByName(mine.select(F.xxhash64("mask", "shared", "node").alias("grp"), *row)), k, more, far), mine


def _nodes(mine: DataFrame, order: list[str], members: int) -> DataFrame:
    """Members of large groups with the node that they are in: stretches of ``NODE`` rows in this order."""
    mine = mine.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stored(mine.withColumn("node", F.spark_partition_id().cast("long") * F.lit(1 << 32) + F.floor(at / NODE)), "nodes", members)


def _node_pairs(node: DataFrame, k: int) -> DataFrame:
    """``(mask, shared, p, q)``: pairs of nodes of one group whose shared bits differ in at most ``k`` places, found from
    the top down; pairs with one name in all, from ``least`` to ``most``, are left out. Upper nodes have ``UPPER`` children; only the topmost, ``UPPER`` in a group at most, meet all."""
    keys = ["mask", "shared"]
    same = F.bitwise_not(F.col("low").bitwiseXOR(F.col("high")))
    levels = [stored(node.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("node")).cast("long") - 1), "level")]
    most = levels[0].agg(F.max("rank")).first()[0] + 1
    while most > UPPER:
        up = levels[-1].groupBy(*keys, F.floor(F.col("rank") / UPPER).alias("up")).agg(F.bit_and("low").alias("low"), F.bit_or("high").alias("high"), F.min("least").alias("least"), F.max("most").alias("most"))
        levels.append(stored(up.withColumnRenamed("up", "rank"), "level"))
        most = -(-most // UPPER)
    side = lambda level, c: levels[level].select(*keys, F.col("rank").alias(c), F.floor(F.col("rank") / UPPER).alias(f"{c}_up"), F.col("low").alias(f"{c}_low"), same.alias(f"{c}_same"), F.col("least").alias(f"{c}_least"), F.col("most").alias(f"{c}_most"))
    both = F.col("p_same").bitwiseAND(F.col("q_same"))
    differ = F.col("p_low").bitwiseXOR(F.col("q_low")).bitwiseAND(both)
    several = F.least("p_least", "q_least") < F.greatest("p_most", "q_most")
    top = len(levels) - 1
    pairs = side(top, "p").join(side(top, "q"), keys).where("p <= q").where(several).select(*keys, "p", "q", both.alias("both"), F.bit_count(differ).alias("sum")).where(F.col("sum") <= k)
    for level in range(top - 1, -1, -1):
        pairs = stored(pairs, "pairs").select(*keys, F.col("p").alias("p_up"), F.col("q").alias("q_up"), F.col("both").alias("known"), F.col("sum").alias("before"))
        pairs = pairs.join(side(level, "p"), [*keys, "p_up"]).join(side(level, "q"), [*keys, "q_up"]).where("p <= q").where(several)
        total = F.col("before") + F.bit_count(differ.bitwiseAND(F.bitwise_not("known")))
        pairs = pairs.select(*keys, "p", "q", both.alias("both"), total.alias("sum")).where(F.col("sum") <= k)
    name = levels[0].select(*keys, "rank", "node")
    named_ = lambda c: name.select(*keys, F.col("rank").alias(c), F.col("node").alias(f"{c}_node"))
    return pairs.join(named_("p"), [*keys, "p"]).join(named_("q"), [*keys, "q"]).select(*keys, F.col("p_node").alias("p"), F.col("q_node").alias("q"))


def _grouped(rows: DataFrame, k: int, more: tuple[str, ...] = (), far: int | None = None) -> DataFrame:
    return rows.repartition("grp").sortWithinPartitions("grp", "side", "gray").select("grp", "side", "fp", *more).mapInArrow(lean(_link(k, far)), "a long, b long")


def wide(own: np.ndarray) -> np.ndarray:
    """The ``WORDS`` words whose bits are set in over half of as many hashes of each of a set's members."""
    salt = np.random.default_rng(SEED).integers(1 << 63, size=WORDS, dtype=np.uint64)
    count = np.zeros(BITS * WORDS, np.int64)
    for at in range(0, len(own), 1024):
        x = own[at : at + 1024, None] ^ salt
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        count += np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * count > len(own), bitorder="little").view("<u8").astype(np.uint64)


def differing(share: float) -> float:
    """The part of a wide fingerprint's bits that is likely to differ where ``share`` of all shingles are common."""
    return math.acos(2 * share / (1 + share)) / math.pi


def blocks(n: int, share: float) -> list[np.ndarray]:
    """For each mask the bits of a wide fingerprint that it keeps. Two texts with ``share`` in common agree on none of
    them at a rate of ``MISS`` at most. Bits grow with the number ``n`` of values, so that groups stay below ``NODE`` on average."""
    size = max(BLOCK, (2 * n // NODE).bit_length())
    apart = BITS * WORDS // size  # blocks that have no bit in common
    number = max(apart, math.ceil(math.log(MISS) / math.log1p(-((1 - differing(share)) ** size))))
    rng = np.random.default_rng(SEED)
    found: list[np.ndarray] = []
    while len(found) < number:
        order = rng.permutation(BITS * WORDS)
        found += [order[at : at + size] for at in range(0, apart * size, size)]
    return found[:number]


def _dealt(kept: list[np.ndarray], count: bool):
    """A row of each code and mask, or only how many rows each group has of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                words = part.column("list").flatten().to_numpy().reshape(-1, WORDS)
                bits = np.unpackbits(words.astype("<i8").view(np.uint8), axis=1, bitorder="little")
                shared = np.stack([bits[:, b].astype(np.int64) @ (np.int64(1) << np.arange(len(b))) for b in kept], axis=1)
                mask = np.broadcast_to(np.arange(len(kept), dtype=np.int32), shared.shape)
                if count:
                    key, n = np.unique(mask.astype(np.int64) << 32 | shared, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array(key & 0xFFFFFFFF), pa.array(n)], ["mask", "shared", "n"])
                    continue
                each = lambda c: pa.array(np.repeat(c, len(kept)))
                own = [each(part.column(c).to_numpy()) for c in ("fp", "name")] + [each(words[:, w]) for w in range(CHECK)]
                yield pa.RecordBatch.from_arrays([pa.array(mask.ravel()), pa.array(shared.ravel()), *own], ["mask", "shared", "fp", "name", *WIDE])

    return run


def candidates(codes: DataFrame, n: int, k: int, share: float) -> DataFrame:
    """``(a, b)`` codes of ``n`` rows ``codes(code, fp, list)``, lists being wide fingerprints: pairs whose components hold
    every two codes of at most ``k`` differing bits that may have ``share`` in common."""
    ship(codes.sparkSession)
    kept = blocks(n, share)
    total, part = BITS * CHECK, 1.25 * differing(share)  # texts of few shingles differ in more bits
    far = int(total * part + 4.5 * math.sqrt(total * part * (1 - part)))

    def dealt(named_: DataFrame, some: list[np.ndarray]) -> tuple[DataFrame, DataFrame, int]:
        sizes = codes.mapInArrow(lean(_dealt(some, True)), "mask int, shared long, n long").groupBy("mask", "shared").agg(F.sum("n").alias("n"))
        member = named_.mapInArrow(lean(_dealt(some, False)), f"mask int, shared long, fp long, name long, {', '.join(f'{w} long' for w in WIDE)}")
        return member.withColumn("gray", gray_rank(F.col("fp"))), sizes, n * len(some)

    # A group of near copies is linked anew under every mask. A few masks join most of it; the others link what is left.
    more = ("name", *WIDE)
    found, _ = _inner(*dealt(codes.withColumn("name", F.col("code")), kept[:FIRST]), k, more, far)
    tree = components(found, rows=n * FIRST)
    named_ = codes.join(tree, codes.code == tree.node, "left").select("fp", "list", F.coalesce("root", "code").alias("name"))
    return tree.toDF("a", "b").union(_searched(*dealt(named_, kept), k, more, far))


def _sketch(width: int, sets: bool):
    """Per text its fingerprint, a hash of its set of shingles, and the set itself or else its wide fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                fp, code, lists = [], [], []
                for text in part.column("text").to_pylist():
                    words = (text or b"").lower().split()
                    h = hashes(words, width) if words else []
                    own = np.unique(np.array(h, np.uint64))
                    fp.append(majority(h) if h else 0)
                    code.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                    lists.append(own if sets else wide(own))
                ends = pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
                flat = np.concatenate(lists).view(np.int64) if lists else np.empty(0, np.int64)
                longs = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (fp, code)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), *longs, pa.ListArray.from_arrays(ends, pa.array(flat))], ["doc_id", "th", "fp", "code", "list"])

    return run


def alike(sets: list[np.ndarray], fp: np.ndarray, k: int, share: float) -> Iterator[tuple[int, int]]:
    """Links among sorted sets: pairs whose components are those of "at most k bits differ and ``share`` is common". Pairs
    that earlier links have joined are not looked at, so a group of near copies is no square of them."""
    size = np.array([len(s) for s in sets])
    comp = np.arange(len(sets))
    for i in range(1, len(sets)):
        fits = np.minimum(size[:i], size[i]) >= share * np.maximum(size[:i], size[i]) - 1e-9
        left = np.flatnonzero(fits & (comp[:i] != comp[i]) & (_bits(fp[:i] ^ fp[i]) <= k))
        while len(left):
            j = int(left[0])
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= share * (size[i] + size[j] - both) - 1e-9:
                yield i, j
                comp[comp == comp[i]] = comp[j]
            left = left[1:]
            left = left[comp[left] != comp[i]]


def _verified(k: int, share: float):
    """Links within groups; rows come sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def out():
            found = list(alike([r[2] for r in rows], np.array([r[1] for r in rows], np.int64).view(np.uint64), k, share))
            yield pa.RecordBatch.from_arrays([pa.array([rows[p[x]][0] for p in found], pa.int64()) for x in (0, 1)], ["a", "b"])

        for batch in batches:
            cols = [batch.column(x).to_pylist() for x in range(3)]
            for at, (grp, code, fp) in enumerate(zip(*cols, strict=True)):
                if grp != now and rows:
                    yield from out()
                    rows = []
                now = grp
                rows.append((code, fp, batch.column(3)[at].values.to_numpy().view(np.uint64).copy()))
        if rows:
            yield from out()

    return run


def _alike_duplicates(df: DataFrame, doc_id: str, text: str, width: int, k: int, share: float) -> DataFrame:
    """``near_duplicates`` with a ``share``. Texts with one set of shingles are one code. The index links ``candidates``;
    only their texts are read again, and each group that candidates form is compared in one task."""
    ship(df.sparkSession)
    kind = df.schema[doc_id].dataType.simpleString()
    src = _source(df, doc_id, text)
    ddl = f"doc_id {kind}, th long, fp long, code long, list array<bigint>"
    rows = stored(src.mapInArrow(lean(_sketch(width, False)), ddl), "sketches")
    n = rows.count()
    codes = stored(rows.groupBy("code").agg(F.min("doc_id").alias("first")), "codes", n)
    # texts of one set may repeat shingles, and so differ in bits
    several = stored(rows.groupBy("code", "fp").agg(F.first("list").alias("list")), "several", n)
    m = several.count()
    tree = components(candidates(several, m, k, share), rows=m * len(blocks(m, share)))
    members = stored(tree.union(tree.select("root", "root")).distinct().toDF("code", "grp"), "members", n)
    ids = stored(codes.join(members, "code").select(F.col("first").alias("id")).distinct(), "ids", n)
    few = F.broadcast(ids) if ids.count() * ROW_BYTES <= BROADCAST_BYTES else ids
    again = src.join(few, src.doc_id.eqNullSafe(ids.id), "left_semi").mapInArrow(lean(_sketch(width, True)), ddl)
    sets = again.join(members, "code").dropDuplicates(["code"]).select("grp", "code", "list")
    sets = sets.join(several.select("code", "fp"), "code").select("grp", "code", "fp", "list")
    links = sets.repartition("grp").sortWithinPartitions("grp", "code").mapInArrow(lean(_verified(k, share)), "a long, b long")
    return _rooted(rows, codes, components(links, rows=n), "code", n)


def _rooted(rows: DataFrame, codes: DataFrame, tree: DataFrame, key: str, n: int) -> DataFrame:
    rooted = codes.join(tree, codes[key] == tree.node, "left").select(key, "first", F.coalesce("root", key).alias("root"))
    rooted = stored(rooted, "rooted", n)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    final = rooted.join(least, "root").select(key, "component_id", "root")
    return rows.join(final, key).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "th")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, k: int = 3, share: float | None = None) -> DataFrame:
    """Per row of ``df``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``, the least id that is reachable
    over links of at most ``k`` differing bits, that also have ``share`` of their different shingles in common; ``root``,
    a number of the component, since rows of one id may be in several; ``th``, a hash of the row's text. By default a share
    is asked, ``SHARE``, where ``k`` is over ``CERTAIN``; zero asks for bits alone.

    Null, empty and wordless texts have fingerprint zero and link like any other. A very long text is one task's work. Repeated ids keep their rows. A null
    id has a row, and is the component's id only where no other is there. An empty table gives an empty result. Only
    ``doc_id`` and ``text`` are read, so other columns cannot clash. Copies are one code from the start; the rows of a
    code meet their component in a join that Spark may split, so a code that a third of the rows share is no hot task.
    """
    if share is None:
        share = SHARE if k > CERTAIN else 0.0
    if share:
        return _alike_duplicates(df, doc_id, text, width, k, share)
    fps = stored(fingerprints(df, doc_id, text, width), "fingerprints")
    n = fps.count()
    codes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "codes", n)
    return _rooted(fps, codes, components(links(codes.select("fp"), k), rows=n * len(masks(n, k))), "fp", n)
