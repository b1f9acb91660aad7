"""What operators need from the cluster: a shared folder to cut lineage in, and this package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session in one JVM may name none, as in tests, and gets a local one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    jsc = sc._jsc.sc()
    if not found and jsc.getCheckpointDir().isDefined():
        found = jsc.getCheckpointDir().get()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
    if not jsc.getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder; Spark drops the files when nothing refers to them. For small rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Exchanges of the jobs inside are deleted as each job ends: what it wrote is all that is read later."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def hadoop_path(spark: SparkSession, path: str):
    """path and its file system, as objects of the JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read again: for wide rows, of which later steps read a few columns each.

    All tables of an application lie in one folder of its own, which is deleted as the driver's JVM ends.
    """
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    at, files = hadoop_path(spark, own)
    files.mkdirs(at)
    files.deleteOnExit(at)
    path = f"{own}/{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table from written() that no later step reads."""
    at, files = hadoop_path(df.sparkSession, df._written_at)
    files.delete(at, True)


def ship(spark: SparkSession) -> None:
    """Give executors this package, so that functions of its modules can be found there by name."""
    sc = spark.sparkContext
    if getattr(sc, "_package_sent", False):
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="code-")) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, os.path.join(top.name, p.relative_to(top)))
    sc.addPyFile(str(target))
    sc._package_sent = True
