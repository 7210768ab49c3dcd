"""Tables written to the cluster's shared folder, to cut lineage or to read one result twice.

A staged table survives lost executors: it lies where ``spark.checkpoint.dir`` says, never on one
machine's disk. Only where that setting is absent (tests, a laptop) a temporary folder stands in.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, set up once per application."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="pagewright-")
        sc.setCheckpointDir(base)
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def stage(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and return the table that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    note(out)
    return out


#: Tables staged by the operators that are running, innermost last.
_RUNNING: list[list[DataFrame]] = []


def note(df: DataFrame) -> None:
    """Remember a staged table for the operator that is running."""
    if _RUNNING:
        _RUNNING[-1].append(df)


def cleaned(operator: Callable) -> Callable:
    """An operator whose results are staged, and whose other staged tables are deleted once they are."""
    @functools.wraps(operator)
    def run(*args, **kwargs):
        _RUNNING.append([])
        try:
            told = operator(*args, **kwargs)
            results = [df if hasattr(df, "_staged_path") else stage(df, operator.__name__) for df in (told if isinstance(told, tuple) else (told,))]
        finally:
            made = _RUNNING.pop()
        kept = {df._staged_path for df in results}
        for df in made:
            if df._staged_path not in kept:
                discard(df)
        for df in results:
            note(df)
        return tuple(results) if isinstance(told, tuple) else results[0]

    return run


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame | None) -> None:
    """Delete a staged table that no later plan reads."""
    path = getattr(df, "_staged_path", None)
    if path is None:
        return
    if name := getattr(df, "_staged_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS `{name}`")
    remove(df.sparkSession, path)
