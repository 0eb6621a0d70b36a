"""Whole analyses: transitions, rates, source assignment and bouts, each as one plan over its tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import audit, clocks, daynight, overlap, rates, sequence, sessions, signal


def transition_analysis(calls: DataFrame, sync: DataFrame, *, order: Sequence[str], places: dict[int, str], bands=sequence.BANDS, light=(8, 20), variants=daynight.VARIANTS, groups: dict[str, str] | None = None, aliases=labels.ALIASES) -> dict[str, DataFrame]:
    """Calls on file clocks to matrices by variant, band and place, gaps, type counts, hours and missing files.

    Labels are cleaned and filtered before events become neighbours. Each result reads the calls when it
    is used; persist calls and sync to read them once. Calls of which none is in the sync table, or none
    of a listed type, are an error. missing_files lists the files without sync, failed the experiments
    that have calls but none with sync.
    """
    chunks = clocks.chunk_starts(sync)
    aligned = clocks.align_some(clocks.with_channel(calls), chunks)
    timed = aligned.filter("event_type is not null and start_us is not null")
    order = labels.effective_order(order, groups or {})
    clean = timed.withColumn("event_type", labels.grouped(labels.canonical(F.col("event_type"), aliases), groups or {}))
    clean = daynight.with_variants(sequence.in_domain(sequence.drop_noise(clean), order, some=True), light, variants)
    counts = sequence.transition_counts(clean, order=order, places=places, bands=bands, variants=variants)
    return {
        "transitions": sequence.joint_probabilities(sequence.row_probabilities(counts)),
        "types": sequence.proportions(sequence.type_counts(clean, order=order, places=places, variants=variants)),
        "gaps": sequence.gaps(sequence.drop_noise(timed)),
        "self_gaps": sequence.gaps(clean, ("variant", *sequence.SEQUENCE, "event_type")),
        "hours": daynight.hours_in_window(daynight.spans(timed), light),
        "missing_files": clocks.missing_files(calls, chunks),
        "failed": calls.select("exp").distinct().join(aligned.select("exp").distinct(), "exp", "left_anti").withColumn("reason", F.lit("no call's file is in the sync table")),
    }


def rate_analysis(calls: DataFrame, sync: DataFrame, dims: DataFrame, folders: Sequence[str], aliases=labels.ALIASES) -> dict[str, DataFrame]:
    """Pooled and per-type rates, their summaries, the wide table and the experiments left out."""
    counts = rates.call_counts(calls, aliases)
    minutes, rejects = rates.recorded_minutes(sync)
    pooled, by_type = rates.pooled_rates(counts, minutes, dims), rates.rates_by_type(counts, minutes, dims)
    summary = rates.summary(by_type, ["folder", "event_type"], folders)
    return {"per_experiment": pooled, "summary": rates.summary(pooled, ["folder"], folders), "by_type": by_type, "summary_by_type": summary, "wide": rates.wide(summary, folders), "ranking": rates.ranking(summary), "rejects": rejects}


def source_assignment(detections: DataFrame, chunks: DataFrame, sources: dict[str, int], places: dict[int, str], *, window_us: int = 15_000, rate: int | None = None) -> dict[str, DataFrame]:
    """Detections (exp, file_num, call_id, onset_s, offset_s, ...) to the call table: levels of every source, the
    loudest of overlapping detections, its place. `log` has all members of groups of over one with is_chosen.

    Groups without any level in a file that has audio are left out. Detections in a file without a
    decodable chunk stay, the first of each group, without place; `silent_files` lists these files."""
    wide = signal.call_levels(detections, chunks, rate)
    keys = ["exp", "file_num", "call_id"]
    of = wide.groupBy(*keys).agg(*[F.max(F.when(F.col("source_channel") == c, F.col("level_db"))).alias(f"RMS_{n}") for n, c in sources.items()])
    silent = signal.silent_files(detections, chunks)
    mark = silent.select(F.col("exp").alias("_e"), F.col("file_num").alias("_f"), F.lit(True).alias("_silent"))
    rows = detections.join(of, keys, "left").join(mark, F.col("exp").eqNullSafe(F.col("_e")) & F.col("file_num").eqNullSafe(F.col("_f")), "left").drop("_e", "_f").withColumn("onset_us", F.round(F.col("onset_s") * 1e6).cast("long"))
    levels = [f"RMS_{n}" for n in sources]
    chosen = overlap.choose_loudest(overlap.overlap_groups(rows, window_us=window_us), levels, keep=F.col("_silent")).drop("_silent")
    kept = overlap.assign_location(chosen.filter("is_chosen"), dict(zip(sources, levels, strict=True)))
    numbered = kept.withColumn("file_number", F.col("file_num").cast("string"))
    return {"calls": overlap.call_table(overlap.sort_calls(numbered), places), "log": chosen.filter("group_size > 1"), "levels": wide, "silent_files": silent}


def bout_analysis(calls: DataFrame, alarm: str = "alarm", **options) -> dict[str, DataFrame]:
    """Bouts of alarm calls joined to all calls, numbered over experiments, with summaries."""
    found = sessions.global_bout_ids(sessions.bouts(calls.filter(F.col("event_type") == alarm), **options))
    return {"calls": sessions.with_bouts(calls, found), "bouts": sessions.bout_summary(found), "counts": sessions.bout_counts(found), "labels": audit.distinct_labels(calls)}
