"""Bouts: chains of events with short intervals, their numbers, positions and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import neighbour, running_sum

ORDER = ("start_us", "stop_us", "call_id")


def bouts(calls: DataFrame, *, gap_us: int = 10_000_000, min_events: int = 5, keys: Sequence[str] = ("exp",), order: Sequence[str] = ORDER) -> DataFrame:
    """calls with bout_id and position_in_bout, both null outside of bouts.

    Events of a key chain while the interval between starts is below gap_us (strictly). Chains of
    min_events or more are numbered 1, 2, ... in time order within the key; order ends in a
    unique column so that ties can't change the result.
    """
    rows = neighbour(calls, keys, order, ["start_us"], after=False)
    new = F.when(F.col("start_us") - F.col("_prev.start_us") < gap_us, 0).otherwise(1)
    rows = running_sum(rows.withColumn("_new", new).drop("_prev"), keys, order, {"_chain": F.col("_new"), "_at": F.lit(1)}).drop("_new")
    chains = rows.groupBy(*keys, "_chain").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).filter(F.col("_n") >= min_events)
    # numbers count the chains that are long enough, again piece by piece
    numbered = running_sum(chains, keys, ["_chain"], {"bout_id": F.lit(1)}, step=1_000_000).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_chain").alias("_c"), "_first", "bout_id")
    same = rows["_chain"] == numbered["_c"]
    for k in keys:
        same = same & rows[k].eqNullSafe(numbered[f"_k_{k}"])
    return rows.join(numbered, same, "left").select(*calls.columns, "bout_id", (F.col("_at") - F.col("_first") + 1).alias("position_in_bout"))


def with_bouts(calls: DataFrame, bouts_: DataFrame, on: Sequence[str] = ("call_id",)) -> DataFrame:
    """All calls with the bout columns of those that are in `bouts_`. The float pair of the source is a
    possible key too: on=("start_time_experiment_sec", "file_num"), where equal keys fan out."""
    return calls.join(bouts_.select(*on, "bout_id", "position_in_bout"), list(on), "left")


def bout_summary(bouts_: DataFrame, keys: Sequence[str] = ("exp",), first: Sequence[str] = ("channel",)) -> DataFrame:
    """Per bout of over one call: values of its first call, least start, greatest stop, calls, duration."""
    order = F.struct(*ORDER)
    sums = bouts_.filter("bout_id is not null").groupBy(*keys, "bout_id").agg(*[F.min_by(c, order).alias(c) for c in first], F.min("start_us").alias("start_us"), F.max("stop_us").alias("stop_us"), F.count("*").alias("n_calls"))
    return sums.filter("n_calls > 1").withColumn("duration_sec", (F.col("stop_us") - F.col("start_us")) / 1e6)


def bout_counts(bouts_: DataFrame, keys: Sequence[str] = ("exp",)) -> DataFrame:
    """Calls in bouts and distinct bouts of each experiment."""
    return bouts_.groupBy(*keys).agg(F.count("bout_id").alias("in_bouts"), F.countDistinct("bout_id").alias("n_bouts"))


def global_bout_ids(bouts_: DataFrame, keys: Sequence[str] = ("exp",)) -> DataFrame:
    """bouts_ with global_bout_id: 1, 2, ... over all experiments in the order (keys, bout_id).

    Only the number of bouts of each experiment is summed in one place: a table with a row an
    experiment; local numbers are already contiguous, or are ranked within the experiment first.
    """
    local = bouts_.filter("bout_id is not null").select(*keys, "bout_id").distinct().withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("bout_id")))
    per = local.groupBy(*keys).agg(F.count("*").alias("_n"))
    offset = per.withColumn("_before", F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    ids = local.join(offset.drop("_n"), list(keys)).select(*keys, "bout_id", (F.col("_before") + F.col("_rank")).alias("global_bout_id"))
    return bouts_.join(ids, [*keys, "bout_id"], "left")


def bout_key(n: str = "bout_id", row: str = "call_id"):
    """Synthetic key: bout_<n>, or no_bout_row<i> outside of bouts."""
    return F.when(F.col(n).isNotNull(), F.concat(F.lit("bout_"), F.col(n).cast("string"))).otherwise(F.concat(F.lit("no_bout_row"), F.col(row).cast("string")))


def global_origin(calls: DataFrame) -> DataFrame:
    """calls with start_time_experiment_sec counted from the start of the first experiment (the least id)."""
    first = calls.groupBy("exp").agg(F.min("start_us").alias("s")).agg(F.min_by("s", "exp").alias("origin_us"))
    return calls.join(F.broadcast(first)).withColumn("start_time_experiment_sec", (F.col("start_us") - F.col("origin_us")) / 1e6).drop("origin_us")
