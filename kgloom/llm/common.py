"""Shared helpers of the training-data operators: shared scratch tables, checked broadcasts, fixed digests."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

_scratch: list = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Where it is unset a temporary folder is made and set on the context, but only on one machine: executors elsewhere would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="kgloom-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_left_over() -> None:
    for spark, path in _scratch:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by then
            pass


atexit.register(_remove_left_over)


class Stored:
    """A table written to the shared folder: it survives lost executors and cuts the lineage. ``drop()`` removes it."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/kgloom-{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        _scratch.append((self.spark, self.path))
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _remove(self.spark, self.path)
        _scratch.remove((self.spark, self.path))


def stored(df: DataFrame, label: str) -> DataFrame:
    return Stored(df, label).df


@contextlib.contextmanager
def scratch():
    """Removes, at the end, the tables that were stored meanwhile. A result that still reads them is written first, by the function given: it stays."""
    held, result = len(_scratch), []

    def keep(df: DataFrame, label: str) -> DataFrame:
        result.append(Stored(df, label))
        return result[-1].df

    try:
        yield keep
    finally:
        stay = {r.path for r in result}
        for spark, path in [x for x in _scratch[held:] if x[1] not in stay]:
            _remove(spark, path)
            _scratch.remove((spark, path))


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps that are over: it does so as soon as the driver's JVM has collected their plans."""
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(text: Column | str) -> Column:
    """The UTF-8 bytes of a text; null: none."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit("")).cast("binary")


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """CRC-32 of the id written as decimal text: the folds of the labelled tasks rest on it."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))
