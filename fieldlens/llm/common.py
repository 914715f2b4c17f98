"""What the operators of this subpackage share: scratch tables in the shared folder, ranks without one big task."""

from __future__ import annotations

import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the data contracts define it.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]+"

#: Stands for a null doc_id inside joins.
NO_ID = -(2**63)

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session gets a
    temporary one; on a cluster it is an error, as executors would not see the driver's folder."""
    global _own_dir
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="fieldlens-")
    return _own_dir


_held: dict[str, object] = {}


def claim(owner: str, forget=None) -> None:
    """Called where an operator begins in a Python worker: what other operators remember there is forgotten.

    Workers outlive tasks and stages, so what one operator keeps would add to the memory of the next.
    """
    for other in [o for o in _held if o != owner]:
        _held.pop(other)()
    if forget is not None:
        _held[owner] = forget
    _give_back()


def _give_back() -> None:
    """Memory that is free in this process goes back to the system, as far as the platform lets it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def rest(spark: SparkSession) -> None:
    """Called between steps: memory that is free in the driver's Python and JVM goes back to the system.

    A driver plans hundreds of jobs here, whose garbage would else grow its heap up to the limit, beside what Python has
    left from earlier steps. Shuffles that nothing needs any more are found by the same collection and deleted.
    """
    gc.collect()
    _give_back()
    jvm = spark._jvm
    jvm.System.gc()
    try:  # the JVM's own malloc_trim, where it has one
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        pass


def rest_executors(spark: SparkSession) -> None:
    """rest(), for the executors' JVMs: one task for each of their cores collects garbage.

    A heap that one step's sorts have grown stays that large beside the next step's Python workers, though nearly all of
    it is garbage. A full collection gives it back; it takes each JVM some tenths of a second.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


class Scratch:
    """Intermediate tables, written as Parquet to the shared folder, so that lost executors cost no recomputation.

    Tables that a returned DataFrame still reads must stay; the others go with drop().
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        rest(spark)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        self.names.add(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, *names: str) -> None:
        """Drop every table but these."""
        self.drop(*(self.names - set(names)))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            self.names.discard(name)
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        rest(self.spark)


#: Hash buckets by which rows that a join cannot touch are told before a shuffle: at most so many numbers are broadcast.
FILTER = 1 << 20


def marked(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """rows whose key's hash bucket holds (left_semi), or does not hold (left_anti), a key of ids."""
    def bucket(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(FILTER))

    wanted = ids.select(bucket(F.col(key)).alias("_bucket_of_ids")).distinct()
    # a null key has a bucket, too, so that no row is lost between the two
    return rows.join(F.broadcast(wanted), bucket(rows[key]) == wanted["_bucket_of_ids"], how)


def fetched(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is in ids; only rows whose key's hash bucket is wanted are shuffled."""
    return marked(rows, ids, key, "left_semi").join(ids, key, "left_semi").select(*rows.columns)


def without(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is not in ids (null keys stay); only rows whose key's hash bucket is listed are shuffled."""
    listed = marked(rows, ids, key, "left_semi").join(ids, key, "left_anti")
    return marked(rows, ids, key, "left_anti").unionByName(listed.select(*rows.columns))


def buckets(total: int, per_bucket: int) -> int:
    """How many buckets hold about per_bucket rows each, at least one."""
    return max(1, -(-total // per_bucket))


def hash_bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("long")


def group_slots(keys: DataFrame, rows: DataFrame, group: list[str], order: list[str], out: str, total: int, per_bucket: int = 50_000) -> DataFrame:
    """rows with a gapless number from 0 within each group, in no task more than about per_bucket rows of it.

    Rows of a group are dealt into hash buckets of their order columns; bucket counts (from keys, which has group and
    order columns of the same rows but may be a narrower plan) give each bucket its first number. Rows equal in all order
    columns have one bucket: the order columns should tell most rows apart.
    """
    n = buckets(total, per_bucket)
    at = hash_bucket(F.struct(*order), n)
    counted = keys.select(*group, at.alias("_b")).groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    first = counted.select(
        *group, "_b", (F.sum("_n").over(Window.partitionBy(*group).orderBy("_b")) - F.col("_n")).alias("_first")
    )
    first = first.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_b").alias("_gb"), "_first")
    placed = rows.withColumn("_b", at)
    on = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)] + [F.col("_b") == F.col("_gb")]
    joined = placed.join(first, on)
    rank = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order)) - 1
    return joined.withColumn(out, (F.col("_first") + rank).cast("long")).drop("_b", "_gb", "_first", *[f"_g{i}" for i in range(len(group))])
