"""Shared plumbing: reading tables, cutting lineage in the shared folder, sizing."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters that separate words in every contract here: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: One word, as a Java and RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Spark's setting to remove a query's shuffle files when it ends; after a cut nothing can need them again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and all runs in one JVM (tests) a folder of our own is made; on a cluster its
    absence raises, since executors would write to their own disks.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="quillspark-shared-")
    return f"file://{shared_dir.own}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Hadoop can reach it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def lean(end: bool = False) -> None:
    """For Python workers, at the begin and end of a task: what is freed goes back to the system.

    Spark keeps idle workers, and without this each of them keeps the memory of its largest task. Where the C library
    has no such calls nothing happens.
    """
    try:
        libc = ctypes.CDLL(None)
        libc.malloc_trim(0) if end else libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):
        pass


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting for the time of a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut(df: DataFrame, keep_path: bool = False):
    """Write ``df`` to a table in the shared folder and return it read back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation. The table is removed when the
    driver's Python ends; call ``remove`` on the path (``keep_path=True``) to free it sooner.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark-cut/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    atexit.register(_remove_quietly, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    return (out, path) if keep_path else out


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended before us
        pass


#: A key with over HOT_ROWS rows and over 1 / HOT_KEYS of all meets them by broadcast: fewer than HOT_KEYS keys.
HOT_KEYS, HOT_ROWS = 65_536, 1_000


def hot_keys(facts: DataFrame, held: str = "held") -> DataFrame:
    """The rows of ``facts`` whose keys hold the most rows, by ``held``: fewer than HOT_KEYS, so they may be broadcast."""
    share = (facts.agg(F.sum(held).alias("all")).first()["all"] or 0) // HOT_KEYS
    return facts.where(F.col(held) > max(share, HOT_ROWS))


def meet(rows: DataFrame, facts: DataFrame, on: list[str], held: str = "held") -> DataFrame:
    """``rows`` joined with ``facts``, a row for each key, whose column ``held`` says how many rows have that key.

    The few keys that hold many rows are broadcast, so that their rows stay where they are; the others meet in a
    shuffle, in which no key has over 1 / HOT_KEYS of the rows (or HOT_ROWS).
    """
    few = hot_keys(facts, held)
    hot = F.broadcast(few.select(*on))
    return rows.join(F.broadcast(few), on).unionByName(rows.join(hot, on, "left_anti").join(facts.join(hot, on, "left_anti"), on))


def crc_mod(column, n: int):
    """crc32 of a column's text form, modulo ``n`` (a null id counts as remainder -1: in no fold)."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n)), F.lit(-1))


def parallelism(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)
