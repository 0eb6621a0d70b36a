"""Sampled signals as long tables (keys, idx, value) or as arrays per chunk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import db, pair_mean
from .ordered import overlapping, pieces

RATE = 125_000
#: Samples of a piece of a long signal.
STEP = 1_000_000


def rolling_mean(samples: DataFrame, width: int, *, centred: bool, keys: Sequence[str] = ("file",), value: str = "value", out: str = "mean", step: int = STEP) -> DataFrame:
    """Mean over a window of width samples, null where the window isn't full. A centred even window has one sample fewer behind.

    idx counts a key's samples without gaps: windows run in pieces of step samples that overlap by width.
    """
    cut = overlapping(samples, "idx", width, width, step)
    w = Window.partitionBy(*keys, "_piece").orderBy("idx")
    w = w.rowsBetween(-(width // 2), width - width // 2 - 1) if centred else w.rowsBetween(-(width - 1), 0)
    mean = F.when(F.count("idx").over(w) == width, F.when(F.count(value).over(w) == width, F.avg(value).over(w)))
    return cut.withColumn(out, mean).filter("_own").drop("_own", "_piece")


def activated(samples: DataFrame, *, level: float = 1.5, keys: Sequence[str] = ("file",), mean: str = "mean", compat: bool = False) -> DataFrame:
    """Samples from the first whose trailing mean exceeds level; keys that never do have none.

    idx stays the file's; with compat it restarts at 0 from the activation.
    """
    first = samples.filter(F.col(mean) > level).groupBy(*keys).agg(F.min("idx").alias("_first"))
    rows = samples.join(first, list(keys)).filter("idx >= _first")
    return (rows.withColumn("idx", F.col("idx") - F.col("_first")) if compat else rows).select(*samples.columns)


def _runs(samples: DataFrame, flag: Column, top: Column, keys: Sequence[str], step: int) -> DataFrame:
    """(keys, run, is_on, first_idx, last_idx, before, n, runs, top): stretches of equal flags in order of idx.

    before is the idx of the sample before the first one, runs and top are the key's number of runs and
    its highest value of top. Samples are shuffled and sorted once, by piece; a piece's runs leave it as a
    compact table. Of these, pieces are summed up by first run, last run and number of runs, which tells
    where a run goes on over a cut and how many are before; runs that go on are then added up.
    """
    rows = pieces(samples.select(*keys, "idx", flag.alias("is_on"), top.alias("_top")), keys, "idx", step)
    w = Window.partitionBy("_seq").orderBy("idx")
    rows = rows.withColumn("_last", F.lag(F.struct("idx", "is_on")).over(w))
    rows = rows.withColumn("_new", F.when(F.col("_last").isNotNull() & F.col("_last.is_on").eqNullSafe(F.col("is_on")), 0).otherwise(1))
    rows = rows.withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    some = rows.groupBy("_seq", "_no").agg(F.first("is_on").alias("is_on"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min(F.when(F.col("_new") == 1, F.col("_last.idx"))).alias("before"), F.count("*").alias("n"), F.max("_top").alias("top"))
    # both the summaries and the runs read this exchange, whose keys aren't _seq itself so that Spark keeps it
    some = some.select("_seq", F.struct("_no", "is_on", "first_idx", "last_idx", "before", "n", "top").alias("r")).repartition(*[F.col(f"_seq.{k}") for k in (*keys, "_piece")])
    # inline keeps r whole in both, as one exchange serves only readers of the same columns
    each = some.select("_seq", "r", F.inline(F.array("r")))
    ends = each.groupBy("_seq").agg(F.min("r").alias("_first"), F.max("r").alias("_last"), F.max("top").alias("_top"))
    over = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))])
    ends = ends.select("*", *[F.col(f"_seq.{k}").alias(f"_k{i}") for i, k in enumerate(keys)]).withColumn("_prev", F.lag("_last").over(over.orderBy("_seq._piece")))
    ends = ends.withColumn("_on", (F.col("_prev").isNotNull() & F.col("_prev.is_on").eqNullSafe(F.col("_first.is_on"))).cast("int")).withColumn("_own", F.col("_last._no") - F.col("_on"))
    before = F.coalesce(F.sum("_own").over(over.orderBy("_seq._piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("_seq", (before - F.col("_on")).alias("_before"), F.col("_prev.last_idx").alias("_last_idx"), F.sum("_own").over(over).alias("runs"), F.max("_top").over(over).alias("top"))
    each = each.drop("r", "top").join(ends, "_seq", "left")
    each = each.select(*[F.col(f"_seq.{k}").alias(k) for k in keys], (F.col("_no") + F.col("_before")).alias("run"), "is_on", "first_idx", "last_idx", F.coalesce("before", "_last_idx").alias("before"), "n", "runs", "top")
    return each.groupBy(*keys, "run").agg(F.bool_or("is_on").alias("is_on"), F.min("first_idx").alias("first_idx"), F.max("last_idx").alias("last_idx"), F.min_by("before", "first_idx").alias("before"), F.sum("n").alias("n"), F.max("runs").alias("runs"), F.max("top").alias("top"))


def dips(samples: DataFrame, *, low: float = 0.5, least_samples: int = 1, gate: float = 1.0, keys: Sequence[str] = ("file",), value: str = "value", step: int = STEP) -> DataFrame:
    """(keys, start_idx, end_idx, n) of stretches below low of least_samples or more, in keys whose maximum reaches gate.

    A dip starts at its last high sample and ends at its last low one; a stretch already low at the
    start and one that never rises again are left out. Null values count as high.
    """
    found = _runs(samples, F.coalesce(F.col(value) < low, F.lit(False)), F.col(value), keys, step).filter((F.col("top") >= gate) & F.col("is_on") & (F.col("run") > 1) & (F.col("run") < F.col("runs")))
    return found.select(*keys, F.col("before").alias("start_idx"), F.col("last_idx").alias("end_idx"), (F.col("last_idx") - F.col("before")).alias("n")).filter(F.col("n") >= least_samples)


def runs(samples: DataFrame, flag: Column, keys: Sequence[str] = ("file",), step: int = STEP) -> DataFrame:
    """(keys, run, is_on, first_idx, n): run-length encoding of a Boolean column."""
    return _runs(samples, flag, F.lit(None).cast("double"), keys, step).select(*keys, "run", "is_on", "first_idx", "n")


def first_run_code(runs_: DataFrame, rate: int, keys: Sequence[str] = ("file",)) -> DataFrame:
    """(keys, code) of each key's first run: 1 for 8 to 12 ms, 2 for 48 to 52 ms, else 0."""
    ms = F.col("n") * 1000.0 / rate
    code = F.when(ms.between(8, 12), 1).when(ms.between(48, 52), 2).otherwise(0)
    return runs_.withColumn("code", code).groupBy(*keys).agg(F.min_by("code", "run").alias("code"))


def _blocks(chunks: DataFrame) -> DataFrame:
    """Decodable chunks with block, first_idx and n_samples; files are one row, block 0, where they have no blocks."""
    for c, kind in (("block", "int"), ("first_idx", "long")):
        if c not in chunks.columns:
            chunks = chunks.withColumn(c, F.lit(0).cast(kind))
    if "n_samples" not in chunks.columns:
        chunks = chunks.withColumn("n_samples", F.size("samples").cast("long"))
    return chunks.filter("samples is not null")


def _files(blocks: DataFrame) -> DataFrame:
    """(exp, file_num, channel, rate, n, blocks, per_block) of the files: samples, blocks, samples of a block but the last. No samples are read if their numbers are stored."""
    per = F.max(F.when(F.col("block") > 0, F.floor(F.col("first_idx") / F.col("block"))))
    return blocks.groupBy("exp", "file_num", "channel").agg(F.first("rate").alias("rate"), F.sum("n_samples").alias("n"), (F.max("block") + 1).alias("blocks"), F.coalesce(per, F.sum("n_samples")).alias("per_block"))


def save_blocks(chunks: DataFrame, name: str, buckets: int) -> DataFrame:
    """chunks as a table bucketed by (exp, file_num, block): pairing microphones in it moves no samples."""
    _blocks(chunks).write.mode("overwrite").bucketBy(buckets, "exp", "file_num", "block").saveAsTable(name)
    return chunks.sparkSession.table(name)


def pair_average(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(exp, virtual_ch, file_num, outcome, rate, block, first_idx, samples): mean of two microphones' samples per virtual channel.

    Outcomes are looked for in this order: missing, rate (rates differ), shape (lengths differ), saved.
    They are those of whole files; another outcome than saved is a row without samples. The
    microphones' arrays of a block are brought together once, by (exp, file_num, block), whatever number
    of virtual channels they serve; over a table of save_blocks they stay where they are. Of a
    microphone's repeated blocks one is used.
    """
    c = _blocks(chunks)
    files = _files(c)
    wanted = files.select("exp", "file_num").distinct().join(pairs, "exp")
    side = lambda k: files.select("exp", "file_num", F.col("channel").alias(f"ch{k}"), F.col("rate").alias(f"r{k}"), F.col("n").alias(f"n{k}"), F.col("blocks").alias(f"b{k}"))
    both = wanted.join(side(1), ["exp", "file_num", "ch1"], "left").join(side(2), ["exp", "file_num", "ch2"], "left")
    outcome = F.when(F.col("n1").isNull() | F.col("n2").isNull(), "missing").when(F.col("r1") != F.col("r2"), "rate").when(F.col("n1") != F.col("n2"), "shape").otherwise("saved")
    rows = both.withColumn("outcome", outcome)
    numbers = F.when(F.col("outcome") == "saved", F.sequence(F.lit(0), F.col("b1") - 1))
    rows = rows.select("exp", "virtual_ch", "file_num", "ch1", "ch2", "outcome", F.when(F.col("outcome") == "saved", F.col("r1")).alias("rate"), F.explode_outer(numbers).alias("block"))
    at = c.groupBy("exp", "file_num", "block").agg(F.first("first_idx").alias("first_idx"), F.collect_list(F.struct("channel", "samples")).alias("_mics"))
    of = lambda k: F.try_element_at(F.filter("_mics", lambda m: m["channel"] == F.col(f"ch{k}")), F.lit(1))["samples"]
    out = rows.join(at, ["exp", "file_num", "block"], "left")
    return out.select("exp", "virtual_ch", "file_num", "outcome", "rate", "block", "first_idx", pair_mean(of(1), of(2)).alias("samples"))


def outcome_counts(paired: DataFrame) -> DataFrame:
    """(exp, n_saved, n_missing, n_rate, n_shape): files of each outcome."""
    return paired.filter("coalesce(block, 0) = 0").groupBy("exp").agg(*[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("saved", "missing", "rate", "shape")])


def call_blocks(calls: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(met, all): rows (call columns, source_channel, _rate, _a, _b, block) of the blocks that each call meets; and a row for each call and channel of its file.

    [_a, _b) is the call's slice in samples of the file. A call in a file without any decodable chunk has
    a row in `all` with a null channel. Work grows with the blocks that calls meet: they follow from
    rate and block length, which a table with a row a file holds.
    """
    files = _files(_blocks(chunks)).withColumnRenamed("channel", "source_channel").withColumnRenamed("rate", "_rate")
    zero = F.lit(0).cast("long")
    each = calls.join(files, ["exp", "file_num"], "left")
    place = lambda t: F.when(F.col(t).isNotNull(), F.least(F.col("n"), F.greatest(zero, F.floor(F.col(t) * F.col("_rate")))))
    each = each.withColumns({"_a": place("onset_s"), "_b": place("offset_s")})
    held = each.filter("_b > _a").withColumn("block", F.explode(F.sequence(F.floor(F.col("_a") / F.col("per_block")).cast("int"), F.floor((F.col("_b") - 1) / F.col("per_block")).cast("int"))))
    columns = [*calls.columns, "source_channel", "_rate"]
    return held.select(*columns, "_a", "_b", "block"), each.select(*columns)


def call_levels(calls: DataFrame, chunks: DataFrame, rate: int | None = None) -> DataFrame:
    """calls with level_db of their slice of each channel of the same file: (call columns, source_channel, level_db).

    An empty slice, a null onset or offset, and with `rate` a chunk of another rate, has a null level; a call in a file without a
    decodable chunk has one row without channel and level. A call is met with the blocks it reaches, by
    number; each adds what it holds of the slice to a sum and a count. Repeated calls stay. A file's
    block k begins at sample k times the length of its blocks.
    """
    once = calls.groupBy(*calls.columns).agg(F.count("*").alias("_copies"))
    met, every = call_blocks(once, chunks)
    c = _blocks(chunks).select("exp", "file_num", F.col("channel").alias("source_channel"), "block", "first_idx", "samples")
    parts = met.join(c, ["exp", "file_num", "source_channel", "block"])
    within = lambda x: F.least(F.greatest(x - F.col("first_idx"), F.lit(0).cast("long")), F.size("samples").cast("long")).cast("int")
    parts = parts.withColumns({"_a": within(F.col("_a")), "_b": within(F.col("_b"))})
    power = F.aggregate(F.slice("samples", F.col("_a") + 1, F.col("_b") - F.col("_a")), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    keys = [*calls.columns, "source_channel", "_rate", "_copies"]
    parts = parts.select(*keys, power.alias("_power"), (F.col("_b") - F.col("_a")).alias("_n"))
    none = every.select(*keys, F.lit(None).cast("double").alias("_power"), F.lit(0).alias("_n"))
    sums = parts.unionByName(none).groupBy(*keys).agg(F.sum("_power").alias("_power"), F.sum("_n").alias("_n"))
    level = db(F.try_divide(F.col("_power"), F.col("_n")))
    if rate is not None:
        level = F.when(F.col("_rate") == rate, level)
    return sums.select(*calls.columns, "source_channel", level.alias("level_db"), F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))).alias("_i")).drop("_i")


def silent_files(calls: DataFrame, chunks: DataFrame) -> DataFrame:
    """(exp, file_num, n_calls) of the files that calls name and that have no decodable chunk."""
    heard = _blocks(chunks).select("exp", "file_num").distinct()
    return calls.groupBy("exp", "file_num").agg(F.count("*").alias("n_calls")).join(heard, ["exp", "file_num"], "left_anti")


def long_levels(segments: DataFrame, samples: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Levels of (keys, call_id, start_idx, end_idx) over the long table: samples of [start_idx, end_idx)."""
    inside = (F.col("idx") >= F.col("start_idx")) & (F.col("idx") < F.col("end_idx"))
    return segments.join(samples, list(keys)).filter(inside).groupBy(*keys, "call_id").agg(db(F.avg(F.col("value") * F.col("value"))).alias("level_db"))
