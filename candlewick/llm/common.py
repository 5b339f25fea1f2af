"""What the operators of this subpackage share: the shared folder, staging, and small helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Broadcasts happen only below this many rows of a counted side; above it the join is a shuffled one.
BROADCAST_ROWS = 200_000

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder the cluster names in spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder; any other master is refused,
    because its executors would not see such a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _OWN.get(spark.sparkContext.applicationId)
        if root is None:
            root = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="candlewick-")
    return f"{root.rstrip('/')}/llm/{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "part") -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there and survives lost executors.

    The folder is deleted when the driver's process ends, or before by forget().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    at_end(spark, path)
    return out


def at_end(spark: SparkSession, path: str) -> None:
    """Has the folder that holds a path of shared_folder() deleted when the driver's process ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def forget(*frames: DataFrame) -> None:
    """Deletes what stage() wrote for these frames; nothing may read them afterwards."""
    for df in frames:
        path = getattr(df, "_staged", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where.getParent(), True)


#: Rows of one Arrow batch, at most: whole texts and sets are long, and both the JVM and the worker hold a batch.
ARROW_ROWS = 1_000


def arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow where executors have this package's sources, in batches of at most ARROW_ROWS rows. run imports pyarrow by itself."""
    spark = ship(df.sparkSession)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return df.mapInArrow(run, schema)


#: Bits of a Bloom filter, at most (8 MB): beyond some millions of keys it lets more through, and results stay exact.
BLOOM_BITS = 1 << 26


def bloom(keys: DataFrame):
    """A function from a column to whether its value may be among the first column of `keys`: false only where it isn't; null where the value is null.

    The filter is an array of 64-bit words, built by one aggregation and handed to the scan as a scalar subquery,
    so rows that it rules out are never shuffled. Its size follows the number of keys up to BLOOM_BITS.
    """
    (name,) = keys.columns
    bits = 1 << 10
    n = keys.count()
    while bits < min(16 * n, BLOOM_BITS):
        bits *= 2
    places = lambda c: [F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(bits)) for seed in (3, 5, 7)]
    set_ = keys.where(F.col(name).isNotNull()).select(F.explode(F.array(*places(F.col(name)))).alias("p"))
    held = set_.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("b"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    filled = held.unionAll(every).groupBy("w").agg(F.max_by("b", F.col("b") != 0).alias("b"))
    array = stage(filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("a")), "bloom")

    def may_hold(column):
        words = array.scalar()
        test = None
        for p in places(column):
            bit = F.call_function("shiftright", F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
            test = bit if test is None else test & bit
        return F.when(column.isNotNull(), test)

    return may_hold


def plainly_named(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with columns named c0, c1, ..., and those names: names may hold dots and quotes, which references to them don't bear."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), names


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks(df: DataFrame, each: int = 64 << 20) -> int:
    """Partitions to shuffle what is about as large as df into: the session's number, or one for each so many bytes if those are more."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(df.sparkSession), min(size, 1 << 47) // each if size < 1 << 60 else 0)


_HELD: dict[str, tuple] = {}


def held(name: str, key, build):
    """The worker process's one object of tables: that of the last operator that ran in it.

    A worker outlives a stage, so an operator's tables go when another operator begins, and their memory
    is given back.
    """
    if _HELD.get("now", (None, None))[0] != (name, key):
        if _HELD.pop("now", None) is not None:
            import ctypes
            import gc

            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass
        _HELD["now"] = (name, key), build()
    return _HELD["now"][1]


def text_pieces(batches, limit: int = 4_000_000):
    """Arrow batches cut to slices of about `limit` bytes of memory, so that a worker's memory is bounded by the longest row."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * min(1.0, limit / max(1, batch.nbytes))))
        if step == rows:
            yield batch
            continue
        start = 0
        while start < rows:
            n = min(step, rows - start)
            while n > 1 and batch.slice(start, n).nbytes > 2 * limit:
                n = max(1, n // 2)
            yield batch.slice(start, n)
            start += n
