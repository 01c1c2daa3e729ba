"""What the operators share: reading a table, work tables in the shared folder, slices of Arrow batches, numbering and copying rows."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_WORK: dict[str, str] = {}
_LEFT: set[str] = set()  # work tables that are still there
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)
COPIES = 1 << 16  # copies of a row that one task makes
FEW = 1 << 20  # rows of two numbers that are broadcast at most
CACHES: list[dict] = []  # what operators keep in a worker from task to task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, may go without the setting.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_WORK:
        _LOCAL_WORK[app] = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, _LOCAL_WORK[app], ignore_errors=True)
    return _LOCAL_WORK[app]


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh place in the shared folder, deleted with its scope or at the end of the program."""
    path = f"{work_dir(spark)}/lectern-{label}-{uuid.uuid4().hex}"
    if not _LEFT:
        atexit.register(clear)
    _LEFT.add(path)
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    The same rows then serve every later use, also where a recomputation would deal them out differently.
    """
    path = work_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return written(df.sparkSession, path, df.schema)


def written(spark: SparkSession, path: str, schema) -> DataFrame:
    found = spark.read.schema(schema).parquet(path)
    found._work_path = path
    return found


@contextmanager
def scratch(spark: SparkSession):
    """Work tables written inside are deleted on leaving, but for those given to ``keep``, which a lazy result still reads;
    they belong to the scope around this one, or stay until the program ends."""
    outer, own, kept = _SCOPE.get(), [], set()
    token = _SCOPE.set(own)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._work_path)
        return df

    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        for path in own:
            if path not in kept:
                drop_path(spark, path)
            elif outer is not None:
                outer.append(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder, whatever file system it is in."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    _LEFT.discard(path)


def clear() -> None:
    """Delete the work tables that are left, while there is a session to do it with."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        for path in list(_LEFT):
            drop_path(spark, path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows. Spark bounds the bytes of a batch, this what Python makes of it at a time, and what it leaves of one."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        trim()


def settle(own: dict | None = None) -> None:
    """At the start of a task: a worker serves all operators, so what others keep in it goes, and freed memory back to the system."""
    for cache in CACHES:
        if cache is not own:
            cache.clear()
    trim()


def trim() -> None:
    """Freed memory goes back to the system: a worker lives on beside others and the executor's JVM."""
    pa.default_memory_pool().release_unused()
    back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if back:
        back(0)


def few(rows: DataFrame, most: int = FEW) -> DataFrame:
    """Written rows of two numbers or less, marked for a broadcast if they are few: what they are joined with stays where it is then."""
    return F.broadcast(rows) if rows.count() <= most else rows


def ship(spark: SparkSession, path: str) -> str:
    """Give a file of the driver's machine to all executors; the name that ``shipped`` finds it by."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def shipped(name: str) -> str:
    return SparkFiles.get(name)


def buckets_for(rows: int, per_bucket: int = 256, most: int = 65536) -> int:
    """How many hash ranges to cut a hot group into; more rows than ``most`` buckets hold only make buckets longer."""
    return max(1, min(most, rows // per_bucket))


def unit_range(hash64: Column, buckets: int) -> Column:
    """Bucket of a 64-bit hash by equal ranges: its order is that of the unsigned hash."""
    return ((F.shiftrightunsigned(hash64, 32) * F.lit(buckets)) / F.lit(2**32)).cast("long")


def copies(df: DataFrame, n: str) -> DataFrame:
    """Each row ``n`` times, with ``copy`` from 0; the copies of one row are made by several tasks if they are many."""
    few = df.filter(F.col(n).between(1, COPIES)).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    many = df.filter(F.col(n) > COPIES).withColumn("copy", F.explode(F.expr(f"sequence(0L, (`{n}` - 1) div {COPIES})"))).repartition("copy")
    ends = F.least(F.col(n), (F.col("copy") + 1) * COPIES) - 1
    return few.unionByName(many.withColumn("copy", F.explode(F.sequence(F.col("copy") * COPIES, ends))))


def numbered(df: DataFrame, keys: list[str], order: Column, into: str, sub: int = 256) -> DataFrame:
    """``into``: 0, 1, … within the (null-safe) keys, in two levels, so that no group meets in one task. ``order`` is a long
    that tells rows of a group apart; numbers follow its hash. ``df`` is read twice and has to be written."""
    named = df.withColumn("__o", order).withColumn("__sub", F.pmod(F.xxhash64("__o"), F.lit(sub)))
    count = named.groupBy(*keys, "__sub").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    count = count.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__sub").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    same = F.col("__sub") == F.col("__s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inner = F.row_number().over(Window.partitionBy(*keys, "__sub").orderBy("__o")) - 1
    joined = named.withColumn("__inner", inner).join(count, same)
    return joined.withColumn(into, F.col("__base") + F.col("__inner")).select(*df.columns, into)
