"""Distributions of gaps: log-spaced histograms, empirical CDFs, thresholds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of tied values that are spread at once.
RANKS = 10_000


def log_edges(low: float, high: float, n: int) -> list[float]:
    """n edges from low to high, evenly spaced by ratio."""
    step = math.log(high / low) / (n - 1)
    return [low, *[low * math.exp(step * i) for i in range(1, n - 1)], high]


def bin_of(x: Column, edges: Sequence[float]) -> Column:
    """0-based bin of x; bins are half-open but for the last, which is closed; null outside."""
    table = F.array(*[F.lit(float(e)) for e in edges])
    at = F.size(F.filter(table, lambda e: e <= x)) - 1
    return F.when((x >= edges[0]) & (x <= edges[-1]), F.least(at, F.lit(len(edges) - 2)))


def histogram(values: DataFrame, column: str, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, low, high, n) of the bins that have values."""
    table = F.array(*[F.lit(float(e)) for e in edges])
    counts = values.withColumn("bin", bin_of(F.col(column), edges)).filter("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"))
    return counts.select(*by, "bin", F.element_at(table, F.col("bin") + 1).alias("low"), F.element_at(table, F.col("bin") + 2).alias("high"), "n")


def peak(histograms: DataFrame) -> DataFrame:
    return histograms.agg(F.max("n").alias("peak"))


def full_range(values: DataFrame, column: str) -> tuple[float, float]:
    """Bounds of the full histogram: max(0.001, least) and min(greatest, 1000) of the positive values."""
    low, high = values.filter(F.col(column) > 0).agg(F.min(column), F.max(column)).first()
    return (1e-3, 1e3) if low is None else (max(1e-3, low), min(high, 1e3))


def ranks(values: DataFrame, column: str, by: Sequence[str], parts: int = 64) -> DataFrame:
    """(by, column, n, first_rank, last_rank, total): the places, from 1, of each distinct non-null value in its group.

    Equal values are counted first. Counts are then summed within pieces between `parts` quantiles of
    all distinct values; a table with a row a group and piece carries sums over the cuts. So neither a hot
    group nor a hot value is one task, and what is shuffled twice is counts.
    """
    counts = values.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    # n is named so that all three readers of the counts share one exchange
    cuts = counts.agg(F.percentile_approx(F.when(F.col("n") > 0, F.col(column)), [i / parts for i in range(1, parts)], 1000).alias("_cuts"))
    place = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(column))), F.lit(0))
    cut = counts.crossJoin(F.broadcast(cuts)).withColumn("_seq", F.struct(*by, place.alias("_piece"))).drop("_cuts")
    inner = cut.withColumn("_in", F.sum("n").over(Window.partitionBy("_seq").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)))
    sums = cut.groupBy("_seq").agg(F.sum("n").alias("_n")).select("*", *[F.col(f"_seq.{k}").alias(f"_k{i}") for i, k in enumerate(by)])
    over = Window.partitionBy(*[f"_k{i}" for i in range(len(by))]) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(over.orderBy("_seq._piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_seq", before.alias("_before"), F.sum("_n").over(over).alias("total"))
    last = F.col("_before") + F.col("_in")
    return inner.join(sums, "_seq").select(*by, column, "n", (last - F.col("n") + 1).alias("first_rank"), last.alias("last_rank"), "total")


def quantiles(values: DataFrame, column: str, by: Sequence[str], shares: dict[str, float], parts: int = 64) -> DataFrame:
    """(by, a column for each share): exact quantiles, linear between neighbours, of the non-null values; by ranks, so that no group is held in one buffer."""
    rows = ranks(values, column, by, parts)
    x = F.col(column).cast("double")
    found = {}
    for name, share in shares.items():
        at = share * (F.col("total") - 1) + 1
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            found[f"_{name}_{side}"] = F.max(F.when(rank.between(F.col("first_rank"), F.col("last_rank")), x))
        found[f"_{name}_part"] = F.max(at - F.floor(at))
    sums = rows.groupBy(*by).agg(*[c.alias(n) for n, c in found.items()])
    return sums.select(*by, *[((1 - F.col(f"_{n}_part")) * F.col(f"_{n}_lo") + F.col(f"_{n}_part") * F.col(f"_{n}_hi")).alias(n) for n in shares])


def empirical_cdf(values: DataFrame, column: str, by: Sequence[str], parts: int = 64) -> DataFrame:
    """i / n over the sorted positive values; ties have ranks of their own. ranks() has the compact form, a row a value."""
    rows = ranks(values.filter(F.col(column) > 0), column, by, parts)
    first = F.explode(F.sequence("first_rank", "last_rank", F.lit(RANKS)))
    rows = rows.select(*by, column, "total", "last_rank", first.alias("_first"))
    rows = rows.select(*by, column, "total", F.explode(F.sequence("_first", F.least("last_rank", F.col("_first") + RANKS - 1))).alias("_rank"))
    return rows.select(*by, column, (F.col("_rank") / F.col("total")).alias("cdf"))


def threshold_fractions(values: DataFrame, column: str, thresholds: Sequence[float], cap: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, fraction, beyond): share of positive values up to each threshold, and how many exceed cap."""
    rows = values.filter(F.col(column) > 0)
    sums = rows.groupBy(*by).agg(F.count_if(F.col(column) > cap).alias("beyond"), *[F.avg((F.col(column) <= t).cast("int")).alias(f"_t{i}") for i, t in enumerate(thresholds)])
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_t{i}").alias("fraction")) for i, t in enumerate(thresholds)])).alias("t")
    return sums.select(*by, "beyond", each).select(*by, "t.threshold", "t.fraction", "beyond")
