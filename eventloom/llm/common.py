"""What several operators of this subpackage share: scratch folders, row keys, skew-safe group facts, lean Python workers."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager, suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: The white space of all text contracts here: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Paths that scratch() has named and that are not deleted yet.
_NAMED: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names; a local folder only on one machine where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="eventloom-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _NAMED.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _NAMED:
        _NAMED.remove(path)


def discard(table: DataFrame) -> None:
    """Deletes a table of written() from which nothing is read any more."""
    _delete(table.sparkSession, table.scratch_path)


def release(spark: SparkSession) -> None:
    """Has the shuffle files of finished steps deleted: Spark does so once the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keep(table: DataFrame) -> None:
    """Keeps a table of written() beyond the end of disposable()."""
    _NAMED.remove(table.scratch_path)


@contextmanager
def disposable(spark: SparkSession):
    """Deletes at its end, an early one too, what scratch() has named within: for steps whose results are written elsewhere by then."""
    before = set(_NAMED)
    try:
        yield
    finally:
        for path in [p for p in _NAMED if p not in before]:
            _delete(spark, path)


#: In a Python worker: what empties the caches that an operator's tasks have left there, by operator.
_LEFT: dict[str, Callable[[], None]] = {}


def trim() -> None:
    """Gives a Python worker's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def enter(operator: str, forget: Callable[[], None] | None = None) -> None:
    """A task of an operator begins in this worker: caches of other operators go, its own stay."""
    others = [k for k in _LEFT if k != operator]
    for k in others:
        _LEFT.pop(k)()
    if others:
        trim()
    if forget:
        _LEFT[operator] = forget


def lean(operator: str, forget: Callable[[], None] | None = None):
    """For functions of mapInArrow. Spark reuses Python workers, so what one step leaves there would add to every later step's memory, in native ones too."""

    def wrap(run):
        @wraps(run)
        def task(batches):
            enter(operator, forget)
            yield from run(batches)
            trim()

        return task

    return wrap


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def stripped(text: Column) -> Column:
    """text without SPACE at both ends. By trimming, which is linear in runs of white space and knows no other line ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def row_key(*columns: Column) -> Column:
    """64 bits that tell rows of one id apart; rows that agree in every column share it."""
    return F.xxhash64(*columns)


def group_facts(rows: DataFrame, keys: list[str], spread: list[Column], partial: list[Column], final: list[Column], only: Column | None = None, salts: int = 64) -> DataFrame:
    """rows (left outer) with facts of the group that shares their non-null keys.

    Skew-safe: rows are reduced per (keys, salt) and then per key; the facts go back through the at
    most `salts` rows of each key, so a group with a third of all rows is met by `salts` tasks.
    spread: what the salt is hashed from. partial and final: aggregates of the two steps. only: a
    filter on the final facts; rows of other groups get nulls.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    some = salted.groupBy(*keys, "_salt").agg(*partial)
    facts = some.groupBy(*keys).agg(*final)
    if only is not None:
        facts = facts.filter(only)
    return salted.join(some.select(*keys, "_salt").join(facts, keys), [*keys, "_salt"], "left").drop("_salt")


def widened(df: DataFrame, **columns: str) -> StructType:
    """df's schema and further columns (name=type)."""
    out = StructType(list(df.schema.fields))
    for name, kind in columns.items():
        out = out.add(name, DataType.fromDDL(kind))
    return out
