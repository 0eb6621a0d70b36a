"""Clock alignment of calls and chunks, and lookups by experiment id ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import small

#: Fixed value: the playback channel of experiments that aren't listed.
PLAYBACK_DEFAULT = 6


def chunk_starts(sync: DataFrame, order: str = "row_pos") -> DataFrame:
    """One row per (exp, file_num) of a sync table (start_us, end_us): the last of repeated numbers, and its
    offset_us from the first chunk of the experiment."""
    last = sync.filter("file_num is not null and start_us is not null").groupBy("exp", "file_num").agg(F.max_by(F.struct("start_us", "end_us"), order).alias("c"))
    rows = last.select("exp", "file_num", "c.start_us", "c.end_us")
    origin = rows.groupBy("exp").agg(F.min("start_us").alias("origin_us"))
    return rows.join(origin, "exp").withColumn("offset_us", F.col("start_us") - F.col("origin_us"))


def align(calls: DataFrame, chunks: DataFrame, start: str = "start_file_us", stop: str = "stop_file_us") -> DataFrame:
    """calls (file clock) with experiment and wall clocks: start_exp_us, stop_exp_us, start_us, stop_us.

    Calls of files that chunks lacks are dropped; missing_files reports them.
    """
    c = chunks.select("exp", "file_num", F.col("start_us").alias("_chunk"), F.col("offset_us").alias("_offset"))
    out = calls.join(c, ["exp", "file_num"])
    clocks = {f"{n}_exp_us": F.col("_offset") + F.col(x) for n, x in (("start", start), ("stop", stop))} | {f"{n}_us": F.col("_chunk") + F.col(x) for n, x in (("start", start), ("stop", stop))}
    return out.withColumns(clocks).drop("_chunk", "_offset")


def missing_files(calls: DataFrame, chunks: DataFrame) -> DataFrame:
    """(exp, file_num, n_calls) of calls whose file isn't in chunks."""
    return calls.join(chunks, ["exp", "file_num"], "left_anti").groupBy("exp", "file_num").agg(F.count("*").alias("n_calls"))


def align_some(calls: DataFrame, chunks: DataFrame, **columns: str) -> DataFrame:
    """align, but an error where there are calls and all of them are dropped."""
    out = align(calls, chunks, **columns)
    if out.isEmpty() and not calls.isEmpty():
        raise ValueError("no call's file is in the sync table")
    return out


def by_position(sync: DataFrame, order: str = "row_pos") -> DataFrame:
    """sync with file_num replaced by its 0-based place within the experiment."""
    return sync.withColumn("file_num", (F.row_number().over(Window.partitionBy("exp").orderBy(order)) - 1).cast("long"))


def in_range(rows: DataFrame, ranges: DataFrame, id_col: str = "exp") -> tuple[DataFrame, DataFrame]:
    """rows with the columns of the range (lo, hi inclusive) that holds their id, and the rows that are in none.

    ranges is a configuration table; one of over 10,000 rows is an error.
    """
    r = small(ranges)
    inside = F.col(id_col).between(F.col("lo"), F.col("hi"))
    return rows.join(r, inside).drop("lo", "hi"), rows.join(r, inside, "left_anti")


def without_skipped(rows: DataFrame, skip: Sequence[int], id_col: str = "exp") -> DataFrame:
    """rows whose id isn't on the skip list."""
    listed = rows.sparkSession.createDataFrame([(int(i),) for i in skip], f"{id_col} long")
    return rows.join(listed, id_col, "left_anti")


def expanded(selection: DataFrame, column: str = "sel") -> DataFrame:
    """Ids of selectors: a number, or 'lo:hi' with both ends."""
    ends = F.transform(F.split(column, ":"), lambda x: F.trim(x).cast("long"))
    return selection.select(F.explode(F.sequence(ends[0], F.element_at(ends, -1))).alias("exp"))


def playback_channel(rows: DataFrame, table: DataFrame, default: int = PLAYBACK_DEFAULT) -> DataFrame:
    """rows with the playback channel of their experiment, or the default."""
    return rows.join(table.select("exp", F.col("channel").alias("_c")), "exp", "left").withColumn("playback_channel", F.coalesce("_c", F.lit(default))).drop("_c")


def with_channel(calls: DataFrame) -> DataFrame:
    """assigned_channel under the name channel, unless there is a channel already."""
    return calls if "channel" in calls.columns else calls.withColumnRenamed("assigned_channel", "channel")
