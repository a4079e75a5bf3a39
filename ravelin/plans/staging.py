"""Staging in the shared folder, joins with measured tables, distributed prefix sums.

Intermediate tables are Parquet files below the folder that the session names in
``spark.checkpoint.dir``; all executors see that folder, so a lost executor
costs only the tasks that it ran.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a measured table may be broadcast.
BROADCAST_ROWS = 200_000

_own_dirs: dict[str, str] = {}
#: Folders named while the `settled` that runs in this thread builds its rows.
_inner: ContextVar[list[str] | None] = ContextVar("inner", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; one of our own only where it is unset and all tasks run on this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them see")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="ravelin-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def file_store(folder: str):
    """(file system, path in it) of a folder or file, for formats that Spark lacks."""
    from pyarrow import fs

    # The names by which Hadoop and Arrow know one kind of store.
    for hadoop, arrow in (("s3a://", "s3://"), ("s3n://", "s3://"), ("file:/", "/")):
        if folder.startswith(hadoop) and not folder.startswith("file://"):
            folder = arrow + folder.removeprefix(hadoop)
    return fs.FileSystem.from_uri(folder)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # the session has ended before the interpreter
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/ravelin/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop_at_exit, spark, path)
    if (inner := _inner.get()) is not None:
        inner.append(path)
    return path


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` written as Parquet in the shared folder and read again, and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    return staged(df, name)[0]


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """`build()` staged, without the tables that were staged on the way to it.

    For results that are small beside those tables: what reads the result later
    needs none of them. Only folders named by this call are removed, so other
    threads, and results that are not written yet, keep theirs.
    """
    outer, mine = _inner.get(), []
    token = _inner.set(mine)
    try:
        out, path = staged(build(), name)
    finally:
        _inner.reset(token)
    for other in mine:
        if other != path:
            drop_path(out.sparkSession, other)
    if outer is not None:
        outer.append(path)
    return out


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", narrow: bool = True) -> DataFrame:
    """Join `small`, a staged table, to `big`.

    Rows of a `narrow` table are numbers and short names; it is counted first
    and broadcast up to BROADCAST_ROWS rows. Beyond that, and where rows may be
    long, Spark decides by measured bytes, and adaptive execution splits hot
    keys of a shuffled join.
    """
    if narrow and small.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, on, how)


def shuffle_width(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of a table for which another task is added.
ROWS_A_TASK = 500_000


def tasks_for(table: DataFrame) -> int:
    """Partitions for rows that grow with those of `table`: the session's width, or one for each ROWS_A_TASK, so that a task's share is bounded."""
    return max(shuffle_width(table.sparkSession), -(-table.count() // ROWS_A_TASK))


def running_before(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, name: str = "ranged") -> DataFrame:
    """Add `out`: the sum of `value` over earlier rows of the same group.

    Rows are range-partitioned by (group, order) and staged, so that no group,
    however large, meets in one task; the totals of (partition, group) give
    each partition its start, and a window inside the partition gives the rest.
    `order` must order rows totally, up to rows that are alike in every column;
    nulls come first. `group` columns must not be null.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    ranged = stage(
        df.withColumn("_value", value)
        .repartitionByRange(shuffle_width(spark), *keys)
        .withColumn("_part", F.spark_partition_id())
        .sortWithinPartitions(*keys),
        name,
    )
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part", *group).agg(F.sum("_value").alias("_total"))
    base = totals.withColumn("_base", F.coalesce(F.sum("_total").over(before(Window.partitionBy(*group).orderBy("_part"))), F.lit(0))).drop("_total")
    inside = F.coalesce(F.sum("_value").over(before(Window.partitionBy("_part", *group).orderBy(*keys[len(group) :]))), F.lit(0))
    return attach(ranged.withColumn("_inside", inside), stage(base, f"{name}-base"), ["_part", *group], "inner").withColumn(out, F.col("_base") + F.col("_inside")).drop("_part", "_base", "_inside", "_value")
