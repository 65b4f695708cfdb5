"""Session helpers: the shared working folder and written stage boundaries."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []
_stages: list[str] = []
#: The stages written within ``staged``.
_inner: ContextVar[list[str] | None] = ContextVar("_inner", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named in ``spark.checkpoint.dir``.

    Only where that setting is missing and the session runs within this process
    (``local`` masters: tests, one machine) a temporary folder is used instead;
    on a cluster a folder of one machine would be no use, so ``RuntimeError``.
    """
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="cairn-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return "file://" + _local[0]


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, kind: str = "stage") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    This cuts the lineage: what follows reads the files, also after the loss
    of an executor, and sees their true size. ``clear_stages`` deletes them.
    """
    path = shared_path(df.sparkSession, kind)
    inner = _inner.get()
    (_stages if inner is None else inner).append(path)
    df.write.parquet(path)
    if inner is not None:
        release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession, make: Callable[[], DataFrame], kind: str = "stage") -> DataFrame:
    """Writes what ``make`` returns, as ``materialize`` does, and deletes the
    stages that ``make`` wrote on the way: nothing else may read them."""
    token = _inner.set(inner := [])
    try:
        df = make()
    finally:
        _inner.reset(token)
        if (outer := _inner.get()) is None:
            _stages.extend(inner)
        else:
            outer.extend(inner)
    out = materialize(df, kind)
    kept = _stages if outer is None else outer
    for path in inner:
        delete(spark, path)
        kept.remove(path)
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Lets go of what finished queries have left: their plans in the driver's
    heap, which else grows to its limit, and their shuffle files, which Spark
    deletes only once the driver has collected its garbage."""
    spark._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder of any file system that Spark knows; False if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True))


def clear_stages(spark: SparkSession) -> int:
    """Deletes the written stages of this process, once no result that reads them
    is needed any more; their number."""
    n = 0
    while _stages:
        n += delete(spark, _stages.pop())
    return n


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df``, written already and of a few short columns, to be broadcast if it
    is counted to have at most so many rows; else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, to be joined by shuffle and merge. What grows with the input would,
    while it is just below Spark's limit, be gathered and hashed on the driver, at
    many times its size in files and several tables at a time."""
    return df.hint("merge")


def parallelism(spark: SparkSession) -> int:
    """Partitions for small rows that are much work: by their size alone they
    would be put into one task."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def require(df: DataFrame, *columns: str) -> None:
    """Raises ``ValueError`` when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
