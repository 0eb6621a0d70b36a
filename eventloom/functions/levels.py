"""Columns over arrays of samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def slice_bounds(onset: Column, offset: Column, rate: Column, size: Column | None = None) -> tuple[Column, Column]:
    """[from, to) sample indices of an interval in seconds: truncated, clamped to the signal."""
    a = F.greatest(F.lit(0), F.floor(onset * rate).cast("int"))
    b = F.greatest(a, F.floor(offset * rate).cast("int"))
    return (a, b) if size is None else (F.least(a, size), F.least(b, size))


def rounded_bounds(onset: Column, offset: Column, rate: Column, size: Column) -> tuple[Column, Column]:
    """[from, to) with indices rounded half-even, as features use them."""
    a = F.least(size, F.greatest(F.lit(0), F.bround(onset * rate, 0).cast("int")))
    return a, F.least(size, F.greatest(a, F.bround(offset * rate, 0).cast("int")))


def level_db(samples: Column) -> Column:
    """20 log10(sqrt(mean square) + 1e-12); null for no samples."""
    power = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(samples)
    return F.when(F.size(samples) > 0, db(power))


def db(power: Column) -> Column:
    return 20 * F.log10(F.sqrt(power) + F.lit(EPS))


def pair_mean(a: Column, b: Column) -> Column:
    """Element-wise mean of two arrays of one length, in single precision."""
    return F.zip_with(a, b, lambda x, y: ((x.cast("float") + y.cast("float")) / F.lit(2).cast("float")).cast("float"))


def loudest(levels: dict[str, Column]) -> Column:
    """Name of the highest level; the first name wins ties; null if all are null."""
    of = F.array(*[F.struct(v.alias("level"), F.lit(-i).alias("place"), F.lit(k).alias("name")) for i, (k, v) in enumerate(levels.items())])
    return F.array_max(F.filter(of, lambda x: x["level"].isNotNull()))["name"]


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))
