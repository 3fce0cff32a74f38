"""Tables written to the shared folder: they cut a lineage, survive lost executors and can be swapped as versions."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the cluster names one; a temporary folder on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty() and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if held.isEmpty():
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="kgloom-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def placed(df: DataFrame, label: str = "step") -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path: for ``remove`` when it has been read."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` as a table in the shared folder."""
    return placed(df, label)[0]


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def staged(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a function like ``written`` whose tables go at the end. Each use has its own: others in the session keep theirs."""
    paths: list[str] = []

    def put(df: DataFrame, label: str = "step") -> DataFrame:
        paths.append(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield put
    finally:
        for path in paths:
            remove(spark, path)


def swap(df: DataFrame, table: str) -> None:
    """A new version of a catalog table: written whole beside the old one, then named. Readers see the old or the new one."""
    spark, new = df.sparkSession, f"{table}_{uuid.uuid4().hex[:12]}"
    df.write.format("parquet").saveAsTable(new)
    spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM {new}")
