"""Spectra in long form (seg_id, frame, bin, freq_hz, mag), tracks over frames, and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .distribution import quantiles
from .ordered import neighbour, overlapping, pieces, running_sum

#: Samples of a window and from one window to the next; taper of the window at both ends.
WIDTH, HOP, TAPER = 512, 256, 0.25
EPS = 1e-12
#: Frames of a piece of a long track.
FRAMES = 200_000


def taper(n: int, alpha: float = TAPER) -> np.ndarray:
    """A tapered cosine window for spectra (periodic)."""
    x = np.arange(n) / n
    edge = np.minimum(x, 1 - x) * 2 / alpha
    return np.where(edge < 1, 0.5 * (1 - np.cos(np.pi * np.minimum(edge, 1))), 1.0)


def _in_blocks(segments: DataFrame) -> DataFrame:
    """segments with block and first_idx, 0 where a segment is one row; rows without samples are left out."""
    for c, kind in (("block", "int"), ("first_idx", "long")):
        if c not in segments.columns:
            segments = segments.withColumn(c, F.lit(0).cast(kind))
    return segments.filter("samples is not null and size(samples) > 0")


def spectrogram(segments: DataFrame, *, width: int = WIDTH, hop: int = HOP) -> DataFrame:
    """(seg_id, frame, bin, freq_hz, mag) of segments (seg_id, rate, samples).

    Magnitudes of the spectrum of each window less its mean, scaled by the window's sum. Short input is
    padded with zeros to one window; a null or empty one has no frames. A long recording is rows of
    (seg_id, rate, block, first_idx, samples), as audio_chunks has them: a block gets the first
    width - 1 samples of the next one and has the frames that begin in it, so frames are those of the
    whole signal and no row holds more than a block. All blocks but a segment's last have width - 1
    samples or more; shorter ones are an error.
    """
    blocks = _in_blocks(segments).select(F.col("seg_id").cast("string").alias("seg_id"), F.col("rate").cast("double").alias("rate"), "block", "first_idx", F.col("samples").cast("array<double>").alias("samples"))
    if "block" in segments.columns:
        heads = blocks.select("seg_id", (F.col("block") - 1).alias("block"), F.slice("samples", 1, width - 1).alias("head"))
        blocks = blocks.join(heads, ["seg_id", "block"], "left")
    else:
        blocks = blocks.withColumn("head", F.lit(None).cast("array<double>"))

    def run(batches):
        window = taper(width)
        for b in batches:
            for seg, rate, first, own, head in zip(b["seg_id"].to_pylist(), b["rate"].to_pylist(), b["first_idx"].to_pylist(), b["samples"], b["head"], strict=True):
                y = np.asarray(own.values, dtype=np.float64)
                n = len(y)
                if head.is_valid:
                    if n < width - 1:
                        raise ValueError(f"a block of {n} samples that isn't its segment's last, {width - 1} are needed")
                    y = np.concatenate([y, np.asarray(head.values, dtype=np.float64)])
                elif not first:
                    y = np.pad(y, (0, max(0, width - n)))
                begin = -first % hop
                if begin >= n or len(y) - begin < width:
                    continue
                # windows that begin in the block's own samples
                views = np.lib.stride_tricks.sliding_window_view(y[begin:], width)[: n - begin : hop]
                for at in range(0, len(views), 256):
                    part = views[at : at + 256]
                    mag = np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * window, axis=1)) / window.sum()
                    frames, bins = mag.shape
                    numbers = np.arange(frames, dtype=np.int32) + (first + begin) // hop + at
                    yield pa.record_batch([pa.array([seg] * mag.size), pa.array(np.repeat(numbers, bins).astype(np.int32)), pa.array(np.tile(np.arange(bins, dtype=np.int32), frames)), pa.array(np.tile(np.arange(bins) * rate / width, frames)), pa.array(mag.ravel())], names=["seg_id", "frame", "bin", "freq_hz", "mag"])

    return blocks.select("seg_id", "rate", "first_idx", "samples", "head").mapInArrow(run, "seg_id string, frame int, bin int, freq_hz double, mag double")


def display(mag: Column) -> Column:
    """ln magnitude between -8 and -5 as 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log(mag + EPS) + 8) / 3))


def frame_entropy(frames: DataFrame, weight: str = "mag") -> DataFrame:
    """(seg_id, frame, entropy): -sum p log2 p over log2(bins), p the frame's shares."""
    total = F.sum(weight).over(Window.partitionBy("seg_id", "frame"))
    p = F.try_divide(F.col(weight), total)
    rows = frames.withColumn("_h", F.when(p > 0, -p * F.log2(p)).otherwise(0.0))
    return rows.groupBy("seg_id", "frame").agg((F.sum("_h") / F.log2(F.count("*"))).alias("entropy"))


def frame_flatness(frames: DataFrame, power: float = 2.0, weight: str = "mag") -> DataFrame:
    """(seg_id, frame, flatness): geometric over arithmetic mean of magnitude ** power."""
    p = F.greatest(F.pow(F.col(weight), F.lit(power)), F.lit(1e-10))
    return frames.groupBy("seg_id", "frame").agg((F.exp(F.avg(F.log(p))) / F.avg(p)).alias("flatness"))


def frame_shape(frames: DataFrame, share: float = 0.85) -> DataFrame:
    """(seg_id, frame, centroid, bandwidth, rolloff) of each frame's magnitudes over frequency."""
    f, m = F.col("freq_hz"), F.col("mag")
    centroid = F.sum(f * m).over(Window.partitionBy("seg_id", "frame")) / F.sum(m).over(Window.partitionBy("seg_id", "frame"))
    so_far = F.sum(m).over(Window.partitionBy("seg_id", "frame").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(m).over(Window.partitionBy("seg_id", "frame"))
    rows = frames.withColumn("_c", centroid).withColumn("_reached", so_far >= share * total)
    return rows.groupBy("seg_id", "frame").agg(F.first("_c").alias("centroid"), F.sqrt(F.sum(F.pow(f - F.col("_c"), 2) * m) / F.sum(m)).alias("bandwidth"), F.min(F.when(F.col("_reached"), f)).alias("rolloff"))


def frame_power(frames: DataFrame) -> DataFrame:
    """(seg_id, frame, rms) from squared magnitudes."""
    return frames.groupBy("seg_id", "frame").agg(F.sqrt(F.avg(F.pow("mag", F.lit(2.0)))).alias("rms"))


def zero_crossings(samples: DataFrame, keys: Sequence[str] = ("seg_id",), step: int = 1_000_000) -> DataFrame:
    """(keys, zcr): share of samples whose sign bit differs from the one before; in pieces of step samples."""
    rows = neighbour(samples.select(*keys, "idx", "value"), keys, ["idx"], ["idx", "value"], after=False, step=step)
    crossed = F.coalesce(((F.col("value") < 0) != (F.col("_prev.value") < 0)).cast("int"), F.lit(0))
    return rows.groupBy(*keys).agg(F.avg(crossed).alias("zcr"))


def frame_zcr(segments: DataFrame, *, width: int = 2048, hop: int = 512) -> DataFrame:
    """(seg_id, frame, zcr) of segments (seg_id, samples): crossings of zero in width samples around each hop, over width.

    Values within 1e-10 of zero count as positive; beyond a segment's ends its last values go on. Long
    recordings are rows of (seg_id, block, first_idx, samples); signs at the ends of blocks are compared
    in a table with a row a block.
    """
    half = width // 2
    known = _in_blocks(segments).select("seg_id", "block", F.col("first_idx").cast("long").alias("first_idx"), F.size("samples").alias("_n"), F.transform("samples", lambda x: x < -1e-10).alias("_neg"))
    lengths = known.groupBy("seg_id").agg(F.floor(F.sum("_n") / hop).cast("int").alias("_last"))
    frames = lengths.select("seg_id", F.explode(F.sequence(F.lit(0), "_last")).alias("frame"))
    flips = F.when(F.col("_n") > 1, F.filter(F.sequence(F.lit(1), F.col("_n") - 1), lambda i: F.element_at("_neg", i + 1) != F.element_at("_neg", i))).otherwise(F.array().cast("array<int>"))
    inner = known.select("seg_id", "first_idx", F.explode(flips).alias("i")).select("seg_id", (F.col("first_idx") + F.col("i")).alias("i"))
    ends = known.select("seg_id", "first_idx", F.element_at("_neg", 1).alias("_a"), F.lag(F.element_at("_neg", -1)).over(Window.partitionBy("seg_id").orderBy("block")).alias("_b"))
    at = inner.unionByName(ends.filter("_a <> _b").select("seg_id", F.col("first_idx").alias("i"))).join(lengths, "seg_id")
    first, last = F.greatest(F.lit(0), F.ceil((F.col("i") - half + 1) / hop).cast("int")), F.least(F.col("_last"), F.floor((F.col("i") + half - 1) / hop).cast("int"))
    counts = at.select("seg_id", F.explode(F.when(first <= last, F.sequence(first, last))).alias("frame")).groupBy("seg_id", "frame").agg(F.count("*").alias("_c"))
    return frames.join(counts, ["seg_id", "frame"], "left").select("seg_id", "frame", (F.coalesce("_c", F.lit(0)) / width).alias("zcr"))


def _decibels(rows: DataFrame, powers: dict[str, Column], floor: float = 80.0) -> DataFrame:
    """rows with dB of powers by name, at least 1e-10, and not more than floor under the segment's highest, which a table with a row a segment holds."""
    rows = rows.withColumns({n: 10 * F.log10(F.greatest(p, F.lit(1e-10))) for n, p in powers.items()})
    tops = rows.groupBy("seg_id").agg(*[F.max(n).alias(f"_top{n}") for n in powers])
    return _joined(rows, tops, ["seg_id"]).withColumns({n: F.greatest(F.col(n), F.col(f"_top{n}") - floor) for n in powers}).drop(*[f"_top{n}" for n in powers])


def contrast(frames: DataFrame, bands: int = 6, lowest: float = 200.0, part: float = 0.02) -> DataFrame:
    """(seg_id, frame, band, contrast): dB between the mean top and mean bottom part of the magnitudes of octave bands.

    Band 0 reaches up to lowest, each next one an octave on, the last to the end; bands above the first
    begin one bin early, and all but the last leave out their highest bin. A band without bins has no row.
    """
    rows = frames.groupBy("seg_id", "frame").agg(F.array_sort(F.collect_list(F.struct("bin", "freq_hz", "mag"))).alias("_s"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(bands))).alias("band"))
    high = lowest * F.pow(F.lit(2.0), F.col("band"))
    low = F.when(F.col("band") == 0, 0.0).otherwise(high / 2)
    below = F.size(F.filter("_s", lambda x: x["freq_hz"] < F.col("_low")))
    upto = F.when(F.col("band") == bands, F.size("_s")).otherwise(F.size(F.filter("_s", lambda x: x["freq_hz"] <= F.col("_high"))))
    rows = rows.withColumns({"_low": low, "_high": high}).withColumns({"_from": below, "_to": upto}).filter("_to > _from")
    start = F.when(F.col("band") == 0, F.col("_from")).otherwise(F.greatest(F.col("_from") - 1, F.lit(0)))
    rows = rows.withColumn("_start", start).withColumn("_n", F.col("_to") - F.col("_start"))
    own = F.slice("_s", F.col("_start") + 1, F.col("_n") - F.when(F.col("band") == bands, 0).otherwise(1))
    rows = rows.withColumns({"_m": F.array_sort(F.transform(own, lambda x: x["mag"])), "_k": F.greatest(F.lit(1), F.rint(part * F.col("_n")).cast("int"))}).filter("size(_m) > 0")
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    ends = rows.select("seg_id", "frame", "band", mean(F.slice("_m", F.lit(1), F.col("_k"))).alias("_valley"), mean(F.slice("_m", -F.least("_k", F.size("_m")), F.col("_k"))).alias("_peak"))
    ends = _decibels(ends, {"_p": F.col("_peak"), "_v": F.col("_valley")})
    return ends.select("seg_id", "frame", "band", (F.col("_p") - F.col("_v")).alias("contrast"))


def cepstrum(frames: DataFrame, n: int = 5) -> DataFrame:
    """(seg_id, frame, k, coefficient): the first n orthonormal cosine coefficients of the dB spectrum."""
    size = F.count("*").over(Window.partitionBy("seg_id", "frame"))
    rows = _decibels(frames.withColumn("_n", size), {"_db": F.col("mag") * F.col("mag") + 1e-12})
    each = rows.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(n)])))
    term = F.col("_db") * F.cos(F.lit(np.pi) * F.col("k") * (F.col("bin") + 0.5) / F.col("_n"))
    scale = F.sqrt(F.when(F.col("k") == 0, 1.0).otherwise(2.0) / F.first("_n"))
    return each.groupBy("seg_id", "frame", "k").agg((F.sum(term) * scale).alias("coefficient"))


def finite(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns are all finite numbers."""
    for c in columns:
        rows = rows.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")))
    return rows


def _joined(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """left with the columns of right, a row a group, of the same group; null keys are groups too."""
    other = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(by)], *[c for c in right.columns if c not in by])
    if not by:
        return left.crossJoin(other)
    same = F.lit(True)
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return left.join(other, same, "left").drop(*[f"_r{i}" for i in range(len(by))])


def series_summary(rows: DataFrame, column: str, by: Sequence[str], prefix: str) -> DataFrame:
    """Mean, population deviation, median and interquartile range of the finite values; nulls if there are none.

    Quantiles are exact, by ranks over pieces of the values: a group with most of the rows is many tasks.
    """
    x = rows.select(*by, F.when(~F.isnan(column) & (F.abs(column) < float("inf")), F.col(column)).alias("_x"))
    out = x.groupBy(*by).agg(F.avg("_x").alias(f"{prefix}_mean"), F.stddev_pop("_x").alias(f"{prefix}_std"))
    out = _joined(out, quantiles(x, "_x", by, {"q1": 0.25, "q2": 0.5, "q3": 0.75}), by)
    return out.select(*by, f"{prefix}_mean", f"{prefix}_std", F.col("q2").alias(f"{prefix}_median"), (F.col("q3") - F.col("q1")).alias(f"{prefix}_iqr"))


def features(frames: DataFrame, meta: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """One row a segment: meta (seg_id, ...) and summaries of entropy, flatness, centroid, bandwidth, rolloff and rms,
    of the contrast of seven bands (contrast_b0 to contrast_b6) and five cepstral coefficients (mfcc1 to mfcc5), and with
    segments (seg_id, samples) of the rate of zero crossings (zcr). All series are one table (seg_id, name, value), summed up once."""
    shape = frame_shape(frames)
    series = [(frame_entropy(frames), "entropy"), (frame_flatness(frames), "flatness"), (frame_power(frames), "rms"), *([(frame_zcr(segments), "zcr")] if segments is not None else [])]
    tables = [t.select("seg_id", F.lit(c).alias("name"), F.col(c).alias("value")) for t, c in series]
    tables.append(shape.select("seg_id", F.stack(F.lit(3), *[x for c in ("centroid", "bandwidth", "rolloff") for x in (F.lit(c), F.col(c))]).alias("name", "value")))
    tables.append(contrast(frames).select("seg_id", F.concat(F.lit("contrast_b"), F.col("band").cast("string")).alias("name"), F.col("contrast").alias("value")))
    tables.append(cepstrum(frames).select("seg_id", F.concat(F.lit("mfcc"), (F.col("k") + 1).cast("string")).alias("name"), F.col("coefficient").alias("value")))
    long = tables[0]
    for t in tables[1:]:
        long = long.unionByName(t)
    summed = series_summary(long, "value", ["seg_id", "name"], "v")
    names = ["entropy", "flatness", "centroid", "bandwidth", "rolloff", "rms", *(["zcr"] if segments is not None else []), *[f"contrast_b{k}" for k in range(7)], *[f"mfcc{k}" for k in range(1, 6)]]
    wide = summed.groupBy("seg_id").agg(*[F.max(F.when(F.col("name") == n, F.col(f"v_{x}"))).alias(f"{n}_{x}") for n in names for x in ("mean", "std", "median", "iqr")])
    return meta.join(wide, "seg_id", "left")


def band_normalised(frames: DataFrame, low: float = 500.0, high: float = 30_000.0, value: str = "mag") -> DataFrame:
    """Frames within the band, with norm: min-max over the segment; constant segments have no rows."""
    w = Window.partitionBy("seg_id")
    rows = frames.filter(F.col("freq_hz").between(low, high)).withColumn("_lo", F.min(value).over(w)).withColumn("_hi", F.max(value).over(w)).filter("_hi > _lo")
    return rows.withColumn("norm", (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def best_candidate(pixels: DataFrame) -> DataFrame:
    """(seg_id, component, score): the best component of each segment of pixels (seg_id, component, frame, freq_hz, amp).

    score = mean amp + .22 frames + .003 Hz of span - .02 lowest kHz, less 6 if the span is under
    300 Hz; components of under 4 frames are out; the smaller component wins ties.
    """
    span = F.max("freq_hz") - F.min("freq_hz")
    frames = F.max("frame") - F.min("frame") + 1
    score = F.avg("amp") + 0.22 * frames + 0.003 * span - 0.02 * F.min("freq_hz") / 1000 - F.when(span < 300, 6.0).otherwise(0.0)
    of = pixels.groupBy("seg_id", "component").agg(score.alias("score"), frames.alias("_t")).filter("_t >= 4")
    first = F.row_number().over(Window.partitionBy("seg_id").orderBy(F.desc("score"), "component"))
    return of.withColumn("_r", first).filter("_r = 1").select("seg_id", "component", "score")


def centre_track(pixels: DataFrame, chosen: DataFrame) -> DataFrame:
    """(seg_id, frame, centre_hz): mean frequency of the chosen component per frame, weights exp(log_amp - the frame's most)."""
    rows = pixels.join(chosen.select("seg_id", "component"), ["seg_id", "component"])
    w = F.exp(F.col("log_amp") - F.max("log_amp").over(Window.partitionBy("seg_id", "frame")))
    return rows.withColumn("_w", w).groupBy("seg_id", "frame").agg((F.sum(F.col("_w") * F.col("freq_hz")) / F.sum("_w")).alias("centre_hz"))


def interpolated(track: DataFrame, value: str, keys: Sequence[str] = ("seg_id",), at: str = "frame", step: int = FRAMES) -> DataFrame:
    """track with missing values filled: linear between neighbours, flat beyond the ends; unchanged below 2 values.

    Windows run in pieces of `step` frames; a table with a row a piece carries the last known value
    behind each cut and the next one ahead of it.
    """
    rows = pieces(track, keys, at, step)
    w = Window.partitionBy("_seq").orderBy(at)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    ends = rows.groupBy("_seq").agg(F.min(known).alias("_first"), F.max(known).alias("_last"), F.count(value).alias("_c")).select("*", *[F.col(f"_seq.{k}").alias(f"_k{i}") for i, k in enumerate(keys)])
    over = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))])
    along = over.orderBy("_seq._piece")
    ends = ends.select("_seq", F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_behind"), F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_ahead"), F.sum("_c").over(over).alias("_n"))
    rows = rows.withColumn("_a", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.join(ends, "_seq", "left").withColumns({"_a": F.coalesce("_a", "_behind"), "_b": F.coalesce("_b", "_ahead")})
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(at) - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    filled = F.when(F.col(value).isNotNull() | (F.col("_n") < 2), F.col(value)).when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull(), F.col("_a.v")).otherwise(line)
    return rows.select(*[filled.alias(c) if c == value else c for c in track.columns])


def running_median(track: DataFrame, value: str, width: int, out: str, keys: Sequence[str] = ("seg_id",), at: str = "frame", step: int = FRAMES) -> DataFrame:
    """Median of the known values in a centred window of rows, which shrinks at the ends; an even width counts one more.

    Rows are numbered and cut into pieces of `step` rows that overlap by half a window; a piece is one
    pass with a window that keeps its values in order, so a row takes the logarithm of the width.
    Infinite values and NaN count as missing.
    """
    r = (width + (width % 2 == 0)) // 2
    rows = overlapping(running_sum(track.drop(out), keys, [at], {"_place": F.lit(1)}, step=step), "_place", r, r, max(step, r))
    own = [c for c in track.columns if c != out]

    def medians(piece: pa.Table) -> pa.Table:
        x = piece[value].cast(pa.float64()).to_pandas().rolling(2 * r + 1, center=True, min_periods=1).median()
        return piece.select(own).append_column(out, pa.Array.from_pandas(x, type=pa.float64())).filter(piece["_own"])

    def run(batches):
        key, held = None, []
        for b in batches:
            at = list(zip(*(b[c].to_pylist() for c in (*keys, "_piece")), strict=True))
            cuts = [0, *[i for i in range(1, len(at)) if at[i] != at[i - 1]], len(at)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if at[lo] != key and held:
                    yield from medians(pa.Table.from_batches(held)).to_batches()
                    held = []
                key = at[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from medians(pa.Table.from_batches(held)).to_batches()

    dealt = rows.repartition(*keys, "_piece").sortWithinPartitions(*keys, "_piece", "_place")
    return dealt.mapInArrow(run, StructType([f for f in track.schema.fields if f.name != out]).add(out, "double")).select(*[c for c in track.columns if c != out], out)


def track_summary(track: DataFrame, value: str, time: str, by: Sequence[str] = ("seg_id",)) -> DataFrame:
    """Median, min, max, range and least-squares slope over time; no slope below 2 points or without a time span. The median as in series_summary."""
    ok = F.col(value).isNotNull()
    t = F.when(ok, F.col(time))
    slope = F.when((F.count(value) >= 2) & (F.max(t) > F.min(t)), F.regr_slope(F.col(value), F.col(time)))
    out = track.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), (F.max(value) - F.min(value)).alias("range"), slope.alias("slope"))
    return _joined(out, quantiles(track, value, by, {"median": 0.5}), by).select(*by, "median", "min", "max", "range", "slope")


def valid_tracks(track: DataFrame, value: str, least: float = 0.05, keys: Sequence[str] = ("seg_id",)) -> DataFrame:
    """track whose values are null where under `least` of the key's frames have one."""
    shares = track.groupBy(*keys).agg(F.avg(F.col(value).isNotNull().cast("int")).alias("_share"))
    rows = _joined(track, shares, keys)
    return rows.select(*[F.when(F.col("_share") >= least, F.col(value)).alias(c) if c == value else c for c in track.columns])


def call_summaries(tracks: DataFrame, meta: DataFrame, third: tuple[str, float, str] = ("duration_sec", 1000.0, "duration_ms")) -> DataFrame:
    """(label, audio, median_khz, range_khz, duration_ms) of finite rows; tracks as in track_summary, meta: seg_id, label, audio, duration_sec.

    third: a column of meta, a factor and the name of the result, such as ("entropy_mean", 1.0, "entropy") instead of the duration.
    """
    column, factor, name = third
    rows = meta.join(tracks, "seg_id").select("label", "audio", (F.col("median") / 1000).alias("median_khz"), (F.col("range") / 1000).alias("range_khz"), (F.col(column) * factor).alias(name))
    return finite(rows, ["median_khz", "range_khz", name])
