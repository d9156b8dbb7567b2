"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: space, and U+0009 to U+000D.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACES_RX = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where that is unset and Spark is local
    (tests).  On a cluster an unset folder is an error, as executors can't see one of the driver's."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _local_dir()
    return found


@functools.cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lanternlake-")


#: The scratch() blocks that are open in this context, innermost last: paths to delete, most files of a table, paths written within.
_open: contextvars.ContextVar[tuple[tuple[list[str], int | None, list[str]], ...]] = contextvars.ContextVar("scratch", default=())


def materialize(df: DataFrame, name: str, keep: bool = False, by: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage, and lost executors only cost a re-read.

    The innermost scratch() block deletes it at its end; keep: the next outer one does, if there is any.  by: a column whose values
    have folders of their own, so that reading or dropping one doesn't touch the others.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lanternlake/{name}-{uuid.uuid4().hex}"
    blocks = _open.get()
    most = blocks[-1][1] if blocks else None
    (df.coalesce(most) if most else df).write.parquet(path, partitionBy=by)
    if blocks:
        blocks[-1][2].append(path)
    if blocks := blocks[: -1 if keep else None]:
        blocks[-1][0].append(path)
    found = spark.read.schema(df.schema).parquet(path)
    return found.select(*df.columns) if by else found


def file_count(docs: DataFrame) -> int:
    """Files of a table that is derived from docs: one for 8 MB of what docs reads, and at least one a core of the cluster, so
    that a small input isn't scattered over many tiny files however many shuffle partitions there are."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(1 << 30, max(docs.sparkSession.sparkContext.defaultParallelism, size >> 23))


@contextlib.contextmanager
def scratch(spark: SparkSession, files: int | None = None) -> Iterator[Callable[..., None]]:
    """What materialize() writes within the block is deleted at its end, and nothing else: for work whose result is written
    (keep=True) before the block ends.  files: the most files that a table within is written as.

    Yields drop(name, part=""), which deletes before that what was written as name (kept or not), or only its folder part, and
    the shuffle files that nobody needs any more.
    """
    paths: list[str] = []
    written: list[str] = []
    token = _open.set((*_open.get(), (paths, files, written)))

    def delete(some: list[str]) -> None:
        for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, some):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        clean_shuffles(spark)

    def drop(name: str, part: str = "") -> None:
        delete([f"{x}/{part}" if part else x for x in written if x.rpartition("/")[2].rpartition("-")[0] == name])

    try:
        yield drop
    finally:
        _open.reset(token)
        delete(paths)


def clean_shuffles(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of DataFrames that nobody holds any more; it does so as the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, even where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text: maximal runs of characters outside SPACES. Null text: no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES_RX), lambda w: w != "")


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo n. Null id: as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
