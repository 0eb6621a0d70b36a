"""Neighbours and running sums in long sequences, without one task for a whole sequence.

A window over (exp, channel) sorts all rows of a key in one task. Here a sequence is cut at multiples of
a step of its order (a day, by default), windows run within the pieces, and a table with one row a
piece carries what goes over the cuts.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
#: Piece of rows without a place in the order; they come first, as nulls do.
FIRST = -(2**62)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names, or in a local one on one machine where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="eventloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small(table: DataFrame, most: int = 10_000) -> DataFrame:
    """A configuration table, marked for broadcast; more than `most` rows are an error."""
    if table.limit(most + 1).count() > most:
        raise ValueError(f"a configuration table of more than {most} rows")
    return F.broadcast(table)


def overlapping(df: DataFrame, by: str, before: int, behind: int, step: int) -> DataFrame:
    """df cut into pieces (_piece) of step values of by; rows near a cut also go to the other side (_own: false there)."""
    if max(before, behind) > step:
        raise ValueError("a window wider than a piece")
    piece = F.floor(F.col(by) / step).cast("long")
    place = F.pmod(F.col(by), F.lit(step))
    copies = F.array_compact(F.array(piece, F.when(place < behind, piece - 1), F.when(place >= step - before, piece + 1)))
    return df.select("*", F.explode(copies).alias("_piece")).withColumn("_own", F.col("_piece") == piece)


def pieces(df: DataFrame, keys: Sequence[str], by: str, step: int) -> DataFrame:
    """df with _seq: the sequence and the piece of it that a row belongs to.

    One struct, never null itself, so that the window's partitioning also serves the join: rows are shuffled once.
    """
    piece = F.coalesce(F.floor(F.col(by) / step).cast("long"), F.lit(FIRST))
    return df.withColumn("_seq", F.struct(*keys, piece.alias("_piece")))


def _over_cuts(ends: DataFrame, keys: Sequence[str], carried: dict[str, Column]) -> DataFrame:
    """(_seq, carried): window columns over the pieces of each sequence."""
    flat = ends.select("*", *[F.col(f"_seq.{k}").alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_seq._piece").alias("_piece"))
    return flat.select("_seq", *[c.alias(n) for n, c in carried.items()])


def neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], *, after: bool = True, step: int = DAY_US) -> DataFrame:
    """df with _next (or, not after, _prev): a struct of the columns of the row behind (before) in the sequence, null at its end.

    order begins with the time column that pieces are cut by.
    """
    name, row = "_next" if after else "_prev", F.struct(*columns)
    cut = pieces(df, keys, order[0], step)
    inner = cut.withColumn("_in", (F.lead if after else F.lag)(row).over(Window.partitionBy("_seq").orderBy(*order)))
    if list(columns) == [order[0]]:
        # a piece's end is a minimum or maximum, which hashes before the shuffle
        ends = cut.groupBy("_seq").agg((F.min if after else F.max)(order[0]).alias("_t")).select("_seq", F.struct(F.col("_t").alias(order[0])).alias("_end"))
    else:
        key = F.struct(*[F.struct(F.col(c).isNotNull().alias("known"), F.col(c).alias("v")).alias(f"o{i}") for i, c in enumerate(order)])
        ends = cut.groupBy("_seq").agg((F.min_by if after else F.max_by)(row, key).alias("_end"))
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_piece")
    ends = _over_cuts(ends, keys, {"_over": (F.lead if after else F.lag)("_end").over(w)})
    return inner.join(ends, "_seq", "left").select(*df.columns, F.coalesce("_in", "_over").alias(name))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], *, step: int = DAY_US) -> DataFrame:
    """df with running sums (name: summed column), the row itself included."""
    cut = pieces(df, keys, order[0], step).withColumns({f"_x_{n}": c.cast("long") for n, c in sums.items()})
    w = Window.partitionBy("_seq").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = cut.withColumns({f"_in_{n}": F.sum(f"_x_{n}").over(w) for n in sums})
    totals = cut.groupBy("_seq").agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = _over_cuts(totals, keys, {f"_b_{n}": F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)) for n in sums})
    return inner.join(totals, "_seq", "left").select(*df.columns, *[(F.col(f"_in_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])
