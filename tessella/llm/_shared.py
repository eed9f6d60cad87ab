"""What several text operators need: shared scratch tables, shipping of the package, components of a graph."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
ROWS_PER_FILE = 250_000
BROADCAST_BYTES = 48 << 20  # tables that may be as large as the input are broadcast up to here, shuffled beyond
ROW_BYTES = 64  # of a row of two numbers or a short id, as it is broadcast
BATCH, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"
_made: dict[str, list[str]] = {}


def named(name: str) -> Column:
    """The column of this very name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names`` with as many underscores in front as it takes to differ from all that are ``taken``."""
    lower = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in lower:
            n = "_" + n
        out.append(n)
        lower.add(n.lower())
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that have not got it on their path, and keep what a task hands to Python
    at once small where the session has not been told otherwise: rows may be long."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH) == BATCH_DEFAULT:
        spark.conf.set(BATCH, BATCH_BYTES)
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in on_path or os.getcwd() == str(ROOT) or getattr(sc, "_tessella_shipped", False):
        return
    to = Path(tempfile.mkdtemp(), "tessella.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted((ROOT / "tessella").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(to))
    sc._tessella_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one is chosen only where it is unset and the executor is
    the driver's own process, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="tessella-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def stored(df: DataFrame, name: str = "step", rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: later steps start from files, so a lost
    executor costs a task and not the whole lineage. The files go when the application ends. ``rows``, if a bound is known, keeps
    small tables from being many files: one for each ``ROWS_PER_FILE`` rows."""
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    spark = df.sparkSession
    sc = spark.sparkContext
    top = f"{shared_dir(spark)}/tessella-{sc.applicationId}"
    at = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    if top not in _made:
        _made[top] = []
        atexit.register(_drop, sc, top)
    _made[top].append(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._stored_at = at
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once all that was made of them is written itself."""
    for df in tables:
        _delete(df.sparkSession.sparkContext, df._stored_at)


def _delete(sc, at: str) -> None:
    path = sc._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _drop(sc, top: str) -> None:
    if sc._jsc is not None:  # else the session has ended before
        try:
            _delete(sc, top)
        except OSError:  # the gateway has gone
            pass


def give_back(spark: SparkSession) -> None:
    """Have executors collect their garbage, in a task for each core: their heaps, which grow with what earlier steps have
    left and do not shrink by themselves, go back to what is in use. Results do not depend on it."""
    n = max(1, spark.sparkContext.defaultParallelism)
    call = F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("done")
    spark.range(0, n, 1, n).select(call).write.format("noop").mode("overwrite").save()


def without(docs: DataFrame, rows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without rows whose id and text hash are in ``rows(doc_id, th)``; null ids are ids like others."""
    gone, th = fresh(docs.columns, "gone", "th")
    rows = stored(rows.select(F.col("doc_id").alias(gone), F.col("th").alias(th)).distinct(), "gone")
    few = F.broadcast(rows) if rows.count() * ROW_BYTES <= BROADCAST_BYTES else rows
    return docs.join(few, named(doc_id).eqNullSafe(F.col(gone)) & (F.xxhash64(named(text).cast("binary")) == F.col(th)), "left_anti")


def lean(run):
    """``run`` over batches that gives memory back when its input ends: workers live on and serve other operators, and
    what the allocator keeps would add up."""

    def wrapped(batches):
        yield from run(batches)
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not the C library that has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for columns of any name: Spark itself takes a dot in one for a field of a struct."""
    names = df.columns

    def renamed(batches):
        yield from run(b.rename_columns(names) for b in batches)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(lean(renamed), schema)


def fold_of(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def components(edges: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``; root is the component's least node; ``rows`` is a
    bound on the edges, if one is known.

    Alternating large-star and small-star rounds. Each round is joins on a node with that node's minimum, which is
    pre-aggregated map-side, and no node's neighbours are gathered in one row. Rounds end when the edges stay the same.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e, "edges", rows)
    mark = None
    if not e.head(1):
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("p")
        )
        last, e = e, stored(small.select("p.a", "p.b").where("a <> b").distinct(), "edges", rows)
        release(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        rows = now[0]  # rounds do not make edges
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
