"""Table loading, spreading of badly split inputs, and materialised intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of all executors, once a session.

    The driver's file server hands the archive out, so nothing has to be installed on the executors.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tessera-py-")
    archive = shutil.make_archive(os.path.join(folder, "tessera_package"), "zip", os.path.dirname(root), os.path.basename(root))
    sc.addPyFile(archive)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (a file or a directory of part files)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute ``df`` by ``keys`` when it comes from fewer files than the cluster has cores.

    One parquet file with a single row group is one task however large the cluster is, which is
    fatal ahead of a Python stage. Inputs made of many files are returned as they are.
    """
    ship(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if len(df.inputFiles()) >= sc.defaultParallelism:
        return df
    n = max(2 * sc.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``, else (tests) a local folder set once."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(known)
        return known
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        current = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(current)
        current = spark.sparkContext.getCheckpointDir()
    return current


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Cuts the lineage (a lost executor loses nothing) and lets several readers prune columns instead
    of running an expensive stage again. The files are removed when the driver process ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone already
        pass


def rounded(col, digits: int = 6):
    """Doubles depend on summation order; results are published rounded."""
    return F.round(col, digits)
