"""Event rates per experiment, group and type, with zero back-fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import ALIASES, canonical


def call_counts(calls: DataFrame, aliases=ALIASES) -> DataFrame:
    """(exp, event_type, n) by canonical type; a missing type counts as 'nan'."""
    return calls.groupBy("exp", canonical(F.col("event_type"), aliases, null_as="nan").alias("event_type")).agg(F.count("*").alias("n"))


def recorded_minutes(sync: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exp, minutes) of the positive chunk lengths, and the experiments rejected for having none."""
    length = F.col("end_us") - F.col("start_us")
    sums = sync.groupBy("exp").agg(F.sum(F.when(length > 0, length)).alias("us"))
    return sums.filter("us is not null").select("exp", (F.col("us") / 60e6).alias("minutes")), sums.filter("us is null").select("exp", F.lit("no positive chunk length").alias("reason"))


def rate(n: Column, minutes: Column, animals: Column) -> Column:
    return n / minutes / animals


def pooled_rates(counts: DataFrame, minutes: DataFrame, dims: DataFrame) -> DataFrame:
    """(folder, exp, n, minutes, rate) of every experiment with minutes; dims: exp, folder, animals."""
    totals = counts.groupBy("exp").agg(F.sum("n").alias("n"))
    rows = minutes.join(dims, "exp").join(totals, "exp", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return rows.select("folder", "exp", "n", "minutes", rate(F.col("n"), F.col("minutes"), F.col("animals")).alias("rate"))


def rates_by_type(counts: DataFrame, minutes: DataFrame, dims: DataFrame) -> DataFrame:
    """(folder, exp, event_type, n, rate) over experiments x observed types; missing counts are 0.

    The grid is as large as its result; types are distinct labels.
    """
    types = counts.select("event_type").distinct()
    grid = minutes.join(dims, "exp").join(types)
    rows = grid.join(counts, ["exp", "event_type"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return rows.select("folder", "exp", "event_type", "n", "minutes", rate(F.col("n"), F.col("minutes"), F.col("animals")).alias("rate"))


def summary(rates: DataFrame, by: Sequence[str], folders: Sequence[str]) -> DataFrame:
    """n, calls, minutes, mean and sample deviation of rates; a configured folder without rows has one of nulls."""
    sums = rates.groupBy(*by).agg(F.count("*").alias("n_exp"), F.sum("n").alias("calls"), F.sum("minutes").alias("minutes"), F.avg("rate").alias("mean"), F.stddev_samp("rate").alias("std"))
    place = rates.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(f) for f in folders])).alias("ord", "folder"))
    return place.join(sums, "folder", "left")


def wide(by_type: DataFrame, folders: Sequence[str]) -> DataFrame:
    """One row a type with <folder>_mean and <folder>_std in the configured order."""
    return by_type.filter("event_type is not null").groupBy("event_type").pivot("folder", list(folders)).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))


def ranking(by_type: DataFrame) -> DataFrame:
    """Types by the mean of their folder means, highest first."""
    return by_type.filter("event_type is not null").groupBy("event_type").agg(F.avg("mean").alias("mean")).orderBy(F.desc("mean"), "event_type")
