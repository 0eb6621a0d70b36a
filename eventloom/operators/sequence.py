"""Consecutive events: gaps, transitions and the matrices made of them.

Calls have exp, channel, event_type, start_us, stop_us; ties in start are ordered by stop, type and id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import signed_log
from .ordered import neighbour

#: Bands of gaps in seconds, (name, lower strict or None for >= 0, upper inclusive).
BANDS = (("right", None, 0.05), ("mid", 0.05, 2.0), ("left", 2.0, 300.0))
SEQUENCE = ("exp", "channel")


#: Order of a sequence: time first, ties by stop, type and id.
ORDER = ("start_us", "stop_us", "event_type", "call_id")


def drop_noise(calls: DataFrame, label: str = "noise") -> DataFrame:
    return calls.filter(F.col("event_type") != label)


def in_domain(calls: DataFrame, order: Sequence[str], *, some: bool = False) -> DataFrame:
    """Calls of the listed types only; with `some`, none at all is an error."""
    out = calls.filter(F.col("event_type").isin(list(order)))
    if some and out.isEmpty():
        raise ValueError("no calls of the listed types")
    return out


def complete(calls: DataFrame, columns: Sequence[str] = ("event_type", "start_us", "stop_us")) -> DataFrame:
    """Calls without a null in the columns."""
    return calls.na.drop(subset=list(columns))


def pooled(gaps_: DataFrame) -> DataFrame:
    """Gaps of all variants as one: each counts once for every variant that it is in."""
    return gaps_.drop("variant")


def gaps(calls: DataFrame, keys: Sequence[str] = SEQUENCE) -> DataFrame:
    """Microseconds from each call's stop to the next start of its sequence, where not negative.

    With event_type among the keys these are the gaps within one type, whatever comes between.
    """
    rows = neighbour(calls, keys, ORDER, ["start_us"])
    return rows.withColumn("gap_us", F.col("_next.start_us") - F.col("stop_us")).drop("_next").filter("gap_us >= 0")


def start_intervals(calls: DataFrame, keys: Sequence[str] = SEQUENCE) -> DataFrame:
    """Microseconds from each start to the next; null at a sequence's end."""
    return neighbour(calls, keys, ORDER, ["start_us"]).withColumn("interval_us", F.col("_next.start_us") - F.col("start_us")).drop("_next")


def pairs(calls: DataFrame, keys: Sequence[str] = SEQUENCE) -> DataFrame:
    """(keys, from_type, to_type, gap_us) of consecutive calls; filters go before this. A null stop makes no pair."""
    rows = neighbour(calls, keys, ORDER, ["event_type", "start_us"])
    out = rows.select(*calls.columns, F.col("event_type").alias("from_type"), F.col("_next.event_type").alias("to_type"), (F.col("_next.start_us") - F.col("stop_us")).alias("gap_us"))
    return out.filter("to_type is not null and gap_us is not null")


def band_of(gap_us: Column, bands=BANDS) -> Column:
    """Name of the gap's band, null outside of all."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(bands):
        above = gap_us >= 0 if low is None else gap_us > round(low * 1e6)
        out = F.when(above & (gap_us <= round(high * 1e6)), name).otherwise(out)
    return out


def grid(spark, **values: Sequence) -> DataFrame:
    """All combinations of configured values; a literal table as small as the configuration."""
    out = spark.range(1).select()
    for name, of in values.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in of])))
    return out


def transition_counts(calls: DataFrame, *, order: Sequence[str], places: dict[int, str], bands=BANDS, variants: Sequence[str] = ("all",)) -> DataFrame:
    """(variant, band, location, from_type, to_type, n), zero-filled over the configured types and places.

    calls has a variant column; one window serves all variants, bands and places.
    """
    from ..functions.labels import location

    found = pairs(calls, ("variant", *SEQUENCE)).withColumn("band", band_of(F.col("gap_us"), bands)).withColumn("location", location(F.col("channel"), places))
    counts = found.filter("band is not null and location is not null").groupBy("variant", "band", "location", "from_type", "to_type").agg(F.count("*").alias("n"))
    full = grid(calls.sparkSession, variant=variants, band=[b[0] for b in bands], location=list(dict.fromkeys(places.values())), from_type=order, to_type=order)
    return full.join(counts, full.columns, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def type_counts(calls: DataFrame, *, order: Sequence[str], places: dict[int, str], variants: Sequence[str] = ("all",)) -> DataFrame:
    """(variant, location, event_type, n) of all cleaned calls, paired or not, zero-filled."""
    from ..functions.labels import location

    counts = calls.withColumn("location", location(F.col("channel"), places)).groupBy("variant", "location", "event_type").agg(F.count("*").alias("n"))
    full = grid(calls.sparkSession, variant=variants, location=list(dict.fromkeys(places.values())), event_type=order)
    return full.join(counts, full.columns, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def _share(n: str, *by: str) -> Column:
    total = F.sum(n).over(Window.partitionBy(*by))
    return F.coalesce(F.try_divide(F.col(n).cast("double"), total), F.lit(0.0))


def row_probabilities(counts: DataFrame) -> DataFrame:
    """Probability of each next type; 0 in rows without any transition."""
    return counts.withColumn("p", _share("n", "variant", "band", "location", "from_type"))


def joint_probabilities(counts: DataFrame) -> DataFrame:
    """Share of each pair among all pairs of a matrix; 0 in an empty one."""
    return counts.withColumn("joint", _share("n", "variant", "band", "location"))


def proportions(counts: DataFrame) -> DataFrame:
    """Share of each type within its location and among all, and the location's percentage."""
    all_n = F.sum("n").over(Window.partitionBy("variant"))
    here = F.sum("n").over(Window.partitionBy("variant", "location"))
    return counts.withColumn("within", _share("n", "variant", "location")).withColumn("overall", _share("n", "variant")).withColumn("location_pct", F.coalesce(100 * F.try_divide(here.cast("double"), all_n), F.lit(0.0)))


def location_difference(counts: DataFrame, first: str, second: str) -> DataFrame:
    """Per (variant, band, from, to): first minus second of counts, row and joint probabilities, the signed log of
    the difference of counts, and the largest absolute difference of the variant over its bands (1 if there is none)."""
    both = joint_probabilities(row_probabilities(counts))

    def diff(c: str) -> Column:
        one = lambda place: F.sum(F.when(F.col("location") == place, F.col(c)).otherwise(0))
        return one(first) - one(second)

    out = both.groupBy("variant", "band", "from_type", "to_type").agg(diff("n").alias("n_diff"), diff("p").alias("p_diff"), diff("joint").alias("joint_diff"))
    top = F.max(F.abs("n_diff")).over(Window.partitionBy("variant"))
    return out.withColumn("n_diff_log", signed_log(F.col("n_diff").cast("double"))).withColumn("limit", F.when(top > 0, top).otherwise(1).cast("long"))


def shared_log_max(counts: DataFrame) -> DataFrame:
    """Largest log1p(count) of all matrices, for one scale."""
    return counts.agg(F.max(F.log1p("n")).alias("log_max"))
