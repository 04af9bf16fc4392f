"""Written intermediate tables in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets a temporary folder of its own; on a cluster, whose
    executors could not read that, it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage, is not repeated when an executor is lost, and lets every later read take
    only the columns it needs. The planner knows the written size, so a small table is broadcast on its merits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is None:
        return
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended
        pass


def drop_stage(df: DataFrame) -> None:
    """Delete the table of one result of :func:`stage` that nothing reads any more."""
    _delete(getattr(df, "_staged_at", ""))


def drop_stages() -> None:
    """Delete all tables that :func:`stage` wrote; call it once their results are stored."""
    for path in list(_written):
        _delete(path)


atexit.register(drop_stages)
