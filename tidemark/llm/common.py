"""What the operators share: the cluster's shared folder, written intermediate tables, words and table reading."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space between words.
SPACE = r"[\x20\x09-\x0D]+"

_roots: set[str] = set()
_paths: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset in local mode (tests) one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def delete(spark_context: SparkContext, path: str) -> None:
    jvm = spark_context._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark_context._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    """What is left of the intermediate tables goes with the application: results may read them until then."""
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None:
        for path in sorted(_roots):
            delete(context, path)


def new_path(spark: SparkSession, name: str) -> str:
    base = shared_dir(spark)
    _roots.add(base)
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def store(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it again: it cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables that store() made and that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_stored", None)
        if path in _paths:
            _paths.remove(path)
            delete(t.sparkSession.sparkContext, path)


def held() -> list[str]:
    """The intermediate tables that are there, oldest first."""
    return list(_paths)


def release_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        if path in _paths:
            _paths.remove(path)
            delete(spark.sparkContext, path)


def words(text: Column) -> Column:
    """The words of a text, null as no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
