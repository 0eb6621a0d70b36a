"""Day and night: variants of calls, and hours of recording within the light window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import DAY, HOUR, day_of, hour_of, is_daytime

VARIANTS = ("all", "day", "night")


def with_variants(calls: DataFrame, light: tuple[int, int], variants: Sequence[str] = VARIANTS) -> DataFrame:
    """Each call once per variant it belongs to; calls without a time belong to `all` only."""
    if set(variants) - set(VARIANTS):
        raise ValueError(f"unknown variants: {set(variants) - set(VARIANTS)}")
    when = F.when(is_daytime(hour_of(F.col("start_us")), *light), "day").when(F.col("start_us").isNotNull(), "night")
    of = F.array_compact(F.array(F.lit("all"), when))
    return calls.withColumn("variant", F.explode(F.array_intersect(of, F.array(*[F.lit(v) for v in variants]))))


def spans(calls: DataFrame, by: Sequence[str] = ("exp",)) -> DataFrame:
    """First start and last stop of each experiment."""
    return calls.groupBy(*by).agg(F.min("start_us").alias("span_start"), F.max("stop_us").alias("span_end"))


def day_micros(start: Column, end: Column, light: tuple[int, int]) -> Column:
    """Microseconds of [start, end] within the light windows of the days it touches."""
    a, b = light[0] % 24, light[1] % 24
    if a == b:
        return F.lit(0).cast("long")
    windows = [(a, b)] if a < b else [(0, b), (a, 24)]
    days = F.sequence(day_of(start), day_of(end))

    def lit_on(day: Column) -> Column:
        return sum((F.greatest(F.lit(0).cast("long"), F.least(end, day * DAY + y * HOUR) - F.greatest(start, day * DAY + x * HOUR)) for x, y in windows), F.lit(0).cast("long"))

    return F.when(end > start, F.aggregate(days, F.lit(0).cast("long"), lambda acc, d: acc + lit_on(d))).otherwise(F.lit(0).cast("long"))


def hours_in_window(spans_: DataFrame, light: tuple[int, int]) -> DataFrame:
    """(exp, variant, hours) for all, day and night; an empty or invalid span has 0."""
    whole = F.when(F.col("span_end") > F.col("span_start"), F.col("span_end") - F.col("span_start")).otherwise(F.lit(0).cast("long"))
    day = day_micros(F.col("span_start"), F.col("span_end"), light)
    rows = spans_.withColumn("w", whole).withColumn("d", day)
    rows = rows.withColumn("v", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), u.alias("us")) for n, u in (("all", F.col("w")), ("day", F.col("d")), ("night", F.col("w") - F.col("d")))])))
    return rows.select("exp", F.col("v.variant").alias("variant"), (F.coalesce("v.us", F.lit(0)) / HOUR).alias("hours"))


def total_hours(hours: DataFrame) -> DataFrame:
    return hours.groupBy("variant").agg(F.sum("hours").alias("hours"))
