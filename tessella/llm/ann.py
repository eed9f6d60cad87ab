"""Approximate nearest neighbours by cosine, over robust-pruned directed graphs.

Different vectors are dealt to shards of bounded size, and each shard gets a graph: points come in batches, a greedy
search from the middle point proposes their neighbours, relaxed distance pruning keeps those that lead in different
directions, and edges back are pruned the same way. A search walks each shard's graph with a beam; the scores of what it
finds are computed again in double precision on the original vectors. Equal vectors are one point with their least ids:
a search for ``k`` neighbours can never need more than ``k + 1`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._shared import lean, named, ship, stored

SHARD = 4096  # points of a shard, on average
QUERY_BLOCK = 1024
DEGREE, BEAM, RELAX = 32, 128, 1.2
ENTRIES, FIRST_BATCH, LAST_BATCH = 32, 64, 512


def _prune(x: np.ndarray, points: np.ndarray, found: np.ndarray, degree: int) -> np.ndarray:
    """Of each point's candidates (rows of ``found``, -1: none), nearest first, those that no kept one is RELAX times
    nearer to; ``degree`` at most."""
    size = len(found)
    found = np.sort(np.where(found == points[:, None], -1, found), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    v = x[found]
    d = np.where(found >= 0, 2 - 2 * np.einsum("bcd,bd->bc", v, x[points]), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    found, d = np.take_along_axis(found, order, 1), np.take_along_axis(d, order, 1)
    v = x[found]
    between = 2 - 2 * v @ v.transpose(0, 2, 1)
    alive, rows = np.isfinite(d), np.arange(size)
    out = np.full((size, degree), -1, np.int32)
    for i in range(degree):
        pick = alive.argmax(1)
        some = alive[rows, pick]
        if not some.any():
            break
        out[some, i] = found[rows, pick][some]
        alive &= ~(RELAX * RELAX * between[rows, pick] <= d)
        alive[rows, pick] = False
    return out


def search(x: np.ndarray, graph: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int) -> np.ndarray:
    """The ``beam`` nearest points that a walk along edges meets, nearest first, -1 where there are fewer."""
    size, rows = len(queries), np.arange(len(queries))
    seen = np.zeros((size, len(x) + 1), bool)  # the last stands for no point
    seen[:, [*entry, -1]] = True
    ids = np.full((size, beam), -1, np.int32)
    d = np.full((size, beam), np.inf)
    done = np.zeros((size, beam), bool)
    entry = entry[:beam]
    ids[:, : len(entry)], d[:, : len(entry)] = entry, 2 - 2 * queries @ x[entry].T
    while True:
        open_d = np.where(done, np.inf, d)
        pick = open_d.argmin(1)
        go = np.flatnonzero(np.isfinite(open_d[rows, pick]))
        if not len(go):
            return ids
        done[go, pick[go]] = True
        near = graph[ids[go, pick[go]]]
        new = ~seen[go[:, None], near]
        seen[go[:, None], near] = True
        nd = np.where(new, 2 - 2 * np.einsum("brd,bd->br", x[near], queries[go]), np.inf)
        all_d = np.concatenate([d[go], nd], 1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        d[go] = np.take_along_axis(all_d, order, 1)
        ids[go] = np.take_along_axis(np.concatenate([ids[go], np.where(new, near, -1)], 1), order, 1)
        done[go] = np.take_along_axis(np.concatenate([done[go], ~new], 1), order, 1)


def _entries(x: np.ndarray, count: int) -> np.ndarray:
    """The point nearest to the middle, then always the point farthest from those before: walks begin on all sides, so a
    dense cluster around the middle cannot hold them."""
    out = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[out[0]]
    while len(out) < min(count, len(x)):
        out.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[out[-1]])
    return np.array(list(dict.fromkeys(out)), np.int32)


def build(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Graph and entries of unit vectors."""
    n = len(x)
    graph = np.full((n, DEGREE), -1, np.int32)
    entry = _entries(x, ENTRIES)
    order = np.random.default_rng(seed).permutation(n)
    order = np.r_[entry, order[~np.isin(order, entry)]].astype(np.int32)
    at = min(FIRST_BATCH, n)
    first = order[:at]
    graph[first] = _prune(x, first, np.tile(first, (at, 1)), DEGREE)
    while at < n:
        new = order[at : at + min(LAST_BATCH, at)]
        at += len(new)
        near = search(x, graph, entry, x[new], BEAM // 2)
        among = x[new] @ x[new].T
        np.fill_diagonal(among, -np.inf)
        few = min(8, len(new) - 1)
        if few:
            near = np.concatenate([near, new[np.argpartition(-among, few - 1, axis=1)[:, :few]]], 1)
        graph[new] = _prune(x, new, near, DEGREE)
        # edges back
        src = np.repeat(new, DEGREE)
        dst = graph[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        cut = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
        count = np.diff(np.r_[cut, len(dst)])
        heads = dst[cut]
        for lo in range(0, len(heads), 512):
            part = slice(lo, lo + 512)
            wide = np.full((len(heads[part]), int(count[part].max())), -1, np.int32)
            inner = np.arange(wide.shape[1]) < count[part][:, None]
            wide[inner] = src[cut[lo] : cut[lo] + int(count[part].sum())]
            graph[heads[part]] = _prune(x, heads[part], np.concatenate([graph[heads[part]], wide], 1), DEGREE)
    return graph, entry


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("least")
    v = np.stack(rows["v"].to_numpy()).astype(np.float64)
    graph, entry = build(_unit(v))
    ids = [np.asarray(i, np.int64) for i in rows["ids"]]
    return pd.DataFrame([{
        "dim": int(rows["dim"].iloc[0]), "shard": int(rows["shard"].iloc[0]), "entry": entry.tobytes(), "v": v.tobytes(), "graph": graph.tobytes(),
        "ids": np.concatenate(ids).tobytes(), "sizes": np.array([len(i) for i in ids], np.int64).tobytes(),
    }])


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    v = np.stack(rows["v"].to_numpy()).astype(np.float64)
    return pd.DataFrame([{"dim": int(rows["dim"].iloc[0]), "block": int(rows["block"].iloc[0]), "q_ids": rows["vec_id"].to_numpy(np.int64).tobytes(), "q": v.tobytes()}])


def _searcher(k: int):
    """Searches of blocks of queries; rows come sorted by shard, its index first, so one index is held at a time."""

    def found(index: dict, unit: np.ndarray, asked: dict) -> pa.RecordBatch:
        dim = index["dim"]
        v = np.frombuffer(index["v"]).reshape(-1, dim)
        graph = np.frombuffer(index["graph"], np.int32).reshape(-1, DEGREE)
        ids, sizes = np.frombuffer(index["ids"], np.int64), np.frombuffer(index["sizes"], np.int64)
        begin = np.cumsum(sizes) - sizes
        norm = np.linalg.norm(v, axis=1)
        q_ids, q = np.frombuffer(asked["q_ids"], np.int64), np.frombuffer(asked["q"]).reshape(-1, dim)
        out = {"query_id": [], "vec_id": [], "score": []}
        for i, row in enumerate(search(unit, graph, np.frombuffer(index["entry"], np.int32), _unit(q), BEAM)):
            row = row[row >= 0]
            score = (v[row] @ q[i]) / (norm[row] * np.linalg.norm(q[i]))
            each = np.repeat(np.arange(len(row)), sizes[row])
            inner = np.arange(len(each)) - np.repeat(np.cumsum(sizes[row]) - sizes[row], sizes[row])
            got, score = ids[begin[row][each] + inner], score[each]
            keep = got != q_ids[i]
            got, score = got[keep], score[keep]
            top = np.lexsort((got, -score))[:k]
            out["query_id"].append(np.full(len(top), q_ids[i]))
            out["vec_id"].append(got[top])
            out["score"].append(score[top])
        kinds = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, t), *out[c]])) for c, t in kinds.items()], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, unit = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["v"] is not None:
                    index, unit = row, _unit(np.frombuffer(row["v"]).reshape(-1, row["dim"]))
                elif index is not None and (index["dim"], index["shard"]) == (row["dim"], row["shard"]):
                    yield found(index, unit, row)

    return run


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``(vec_id, v)`` of rows whose vector has neither nulls nor non-finite components and is not zero."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(named(vec_id).cast("long").alias("vec_id"), named(vector).alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))


def index(df: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per shard: its vectors, ids and graph. Every row of ``df`` is in it, as a point or by an equal vector."""
    ship(df.sparkSession)
    rows = usable(df, vec_id, vector).groupBy("v", "vec_id").agg(F.lit(1).alias("one"))
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))  # limited before the shuffle too
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    points = stored(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "points")
    shards = max(1, -(-points.count() // SHARD))
    points = points.select("v", "ids", F.col("ids")[0].alias("least"), F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"))
    out = "dim int, shard int, entry binary, v binary, graph binary, ids binary, sizes binary"
    return stored(points.groupBy("dim", "shard").applyInPandas(_index, out), "index")


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of ``df`` nearest to each row of ``queries``, which has the
    same columns, without rows of the query's own id.

    Nearest first, ties to the smaller id; repeated rows count once. A null id, and a vector that is null, zero or has
    null or non-finite components, takes no part; vectors of another length are no candidates. Fewer candidates give
    fewer rows, an empty table none. Only the two named columns are read, so others cannot clash.
    """
    shards = index(df, k, vec_id, vector)
    asked = usable(queries, vec_id, vector).groupBy("v", "vec_id").agg(F.lit(1).alias("one"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    packed = stored(asked.groupBy("dim", "block").applyInPandas(_pack, "dim int, block int, q_ids binary, q binary"), "queries")
    most = (shards.agg(F.max("shard")).first()[0] or 0) + 1
    # every block of queries is sent to every shard, and passes by the index there
    blank = lambda *names: {c: F.lit(None).cast("binary") for c in names}
    left = shards.withColumns({"block": F.lit(-1), **blank("q_ids", "q")})
    right = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumns(blank("entry", "v", "graph", "ids", "sizes"))
    rows = left.unionByName(right).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "block")
    found = rows.mapInArrow(lean(_searcher(k)), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
