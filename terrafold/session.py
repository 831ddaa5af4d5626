"""Things a query needs of its session: the package on the workers, a shared folder, sizes."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_BYTES = 4 << 20
_ARROW_LIMIT, _ARROW_DEFAULTS = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64MB", "64m", "9223372036854775807b")
_SHIPPED: set[str] = set()
_MADE: list[str] = []


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors; done once per application.

    Arrow batches between the JVM and Python are limited to ARROW_BYTES unless the session sets a limit of its own:
    each task holds a batch twice outside the heap.
    """
    if str(spark.conf.get(_ARROW_LIMIT)) in _ARROW_DEFAULTS:
        spark.conf.set(_ARROW_LIMIT, ARROW_BYTES)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="terrafold-"), "terrafold_src.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """df's rows over all cores: a small file is one task, however much work its rows are.

    Three tasks a core at least, and as many as the scan has if those are more. Choose columns first: all that df has is shuffled.
    """
    return df.repartition(max(3 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def shrink_heaps(spark: SparkSession) -> None:
    """Have the executors collect their heaps, which gives memory that holds garbage only back to the system.

    A heap that sorts and aggregates have grown stays large while Python workers do the work; both count as the
    executor's memory. A task for each core: where other work has the cores, an executor may be left out.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("done")).collect()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; local sessions without one get a temporary folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="terrafold-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/terrafold/{tag}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def made(since: int = 0) -> list[str]:
    """What this session's queries have put into the shared folder, from a place in that list on."""
    return _MADE[since:]


def discard(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete tables and files that queries have put into the shared folder, all of them unless paths are given; their number.

    Call it once the results that read them are written: a DataFrame that an operator returned still needs its tables.
    """
    n = 0
    for path in list(_MADE if paths is None else paths):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        n += bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))
        if path in _MADE:
            _MADE.remove(path)
    return n


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate for df, which for a file scan is the size of its files; where it has none, by partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 57 else df.rdd.getNumPartitions() * (64 << 20)
