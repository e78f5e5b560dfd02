"""What the corpus operators share: tables, staged results and text conventions."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator
from tempfile import gettempdir

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters that count as white space everywhere in this package.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``; Spark's reader resolves the scheme."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own in a single JVM, where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or f"file://{gettempdir()}/checkpoints").rstrip("/")


#: Drops the shuffle files of a query at its end; what it wrote is read back from the shared folder.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Written intermediate tables of one operator run in the shared folder.

    A staged table cuts lineage: a lost executor costs a reread of replicated
    files and never a recomputation of the whole chain. Its files go when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        app = spark.sparkContext.applicationId
        self.root = f"{shared_dir(spark)}/tessera/{app}/{name}-{uuid.uuid4().hex[:12]}"
        path = self._path("")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def stage(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path, before = f"{self.root}/{name}", self.spark.conf.get(_DROP_SHUFFLES, "false")
        self.spark.conf.set(_DROP_SHUFFLES, "true")
        try:
            df.write.mode("overwrite").option("compression", compression).parquet(path)
        finally:
            self.spark.conf.set(_DROP_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self._path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few numbers each that may be broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, a staged table of short rows, to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of runs of characters outside SPACES, without building an array of words."""
    spaces = r"[ \t\n\x0B\x0C\r]"
    marks = F.regexp_replace(F.concat(F.lit(" "), text), rf"{spaces}++[^ \t\n\x0B\x0C\r]++", "x")
    return F.length(F.translate(marks, SPACES, "")).cast("long")


#: In a Python worker: operators that have kept a model there, and how each is forgotten.
_models: dict[str, Callable[[], None]] = {}


def _give_back() -> None:
    """Returns freed memory of this process to the system, which the allocators would hold for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _enter(owner: str, forget: Callable[[], None] | None) -> None:
    others = [name for name in _models if name != owner]
    for name in others:
        _models.pop(name)()
    if forget:
        _models[owner] = forget
    if others:
        _give_back()


def lean(owner: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] | None = None):
    """``run`` for mapInArrow, in workers that Spark reuses for one operator after another.

    A worker has the model of one operator at a time: those of others are forgotten before ``run`` begins; ``forget`` does
    that for ``owner``. Memory that a task has freed goes back when it ends, as idle workers count for their executor too.
    """

    def guarded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _enter(owner, forget)
        yield from run(batches)
        _give_back()

    return guarded
