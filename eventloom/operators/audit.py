"""Audits of expected against actual data, completion, logs and experiment times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def naming_schemes(manifest: DataFrame) -> DataFrame:
    """(exp, scheme, reason): modern, legacy, modern if both have the same chunk ids, else an error."""
    ids = {s: F.array_sort(F.collect_set(F.when(F.col("scheme") == s, F.col("file_num")))) for s in ("modern", "legacy")}
    sets = manifest.groupBy("exp").agg(*[v.alias(k) for k, v in ids.items()])
    has = {s: F.size(s) > 0 for s in ids}
    scheme = F.when(has["modern"] & (~has["legacy"] | (F.col("modern") == F.col("legacy"))), "modern").when(has["legacy"] & ~has["modern"], "legacy")
    reason = F.when(has["modern"] & has["legacy"] & (F.col("modern") != F.col("legacy")), "schemes differ").when(~has["modern"] & ~has["legacy"], "no chunks")
    return sets.select("exp", scheme.alias("scheme"), reason.alias("reason"))


def expected_vs_actual(expected: DataFrame, actual: DataFrame, keys: tuple[str, ...] = ("exp",), item: str = "file_num") -> DataFrame:
    """Per key: numbers of expected and actual items, and the sorted missing and extra ones."""
    both = expected.select(*keys, item).distinct().withColumn("e", F.lit(1)).join(actual.select(*keys, item).distinct().withColumn("a", F.lit(1)), [*keys, item], "full")

    def listed(where):
        return F.array_sort(F.collect_list(F.when(where, F.col(item))))

    return both.groupBy(*keys).agg(F.count("e").alias("n_expected"), F.count("a").alias("n_actual"), listed(F.col("a").isNull()).alias("missing"), listed(F.col("e").isNull()).alias("extra"))


def pairs_present(manifest: DataFrame, pairs: DataFrame) -> DataFrame:
    """(exp, virtual_ch, file_num) of chunks that both microphones of a virtual channel have."""
    rows = manifest.select("exp", "channel", "file_num").distinct()
    each = pairs.select("exp", "virtual_ch", F.explode(F.array("ch1", "ch2")).alias("channel")).distinct()
    n = pairs.select("exp", "virtual_ch", F.when(F.col("ch1") == F.col("ch2"), 1).otherwise(2).alias("need"))
    have = rows.join(each, ["exp", "channel"]).groupBy("exp", "virtual_ch", "file_num").agg(F.countDistinct("channel").alias("have"))
    return have.join(n, ["exp", "virtual_ch"]).filter("have = need").select("exp", "virtual_ch", "file_num")


def completion(items: DataFrame, results: DataFrame, key: str = "exp") -> DataFrame:
    """items with is_done: whether results has the key."""
    done = results.select(key).distinct().withColumn("_d", F.lit(True))
    return items.join(done, key, "left").withColumn("is_done", F.coalesce("_d", F.lit(False))).drop("_d")


def log_presence(experiments: DataFrame, raw: DataFrame, copied: DataFrame) -> DataFrame:
    """(exp, status): already_present, copied (a raw log awaits copying), or no_raw_log_found."""
    has_raw = completion(experiments.select("exp").distinct(), raw).withColumnRenamed("is_done", "raw")
    both = completion(has_raw, copied)
    return both.select("exp", F.when(F.col("is_done"), "already_present").when(F.col("raw"), "copied").otherwise("no_raw_log_found").alias("status"))


def roll_up(audit: DataFrame) -> DataFrame:
    """Counts over an audit: experiments, those with missing or extra items, and matching ones."""
    bad = (F.size("missing") > 0) | (F.size("extra") > 0)
    return audit.agg(F.count("*").alias("n_exp"), F.count_if(F.size("missing") > 0).alias("n_missing"), F.count_if(F.size("extra") > 0).alias("n_extra"), F.count_if(~bad).alias("n_ok"))


def experiment_times(experiments: DataFrame, sync: DataFrame, chunks: DataFrame) -> DataFrame:
    """(exp, start_us, end_us, hours, n_chunks): first row's start and last row's end; experiments without sync keep nulls."""
    ends = sync.groupBy("exp").agg(F.min_by("start_us", "row_pos").alias("start_us"), F.max_by("end_us", "row_pos").alias("end_us"))
    n = chunks.groupBy("exp").agg(F.countDistinct("file_num").alias("n_chunks"))
    rows = experiments.select("exp").distinct().join(ends, "exp", "left").join(n, "exp", "left")
    return rows.withColumn("hours", (F.col("end_us") - F.col("start_us")) / 3.6e9).withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0).cast("long")))


def month_roll_up(times: DataFrame, months: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(month, n_exp, n_with_times) of experiments; months: exp, month. With log lines (exp, source_log_file): n_rows and n_log_files too."""
    out = times.join(months, "exp").groupBy("month").agg(F.countDistinct("exp").alias("n_exp"), F.count("start_us").alias("n_with_times"))
    if lines is None:
        return out
    logs = lines.join(months.distinct(), "exp").groupBy("month").agg(F.count("*").alias("n_rows"), F.countDistinct("source_log_file").alias("n_log_files"))
    zero = F.lit(0).cast("long")
    return out.join(logs, "month", "left").withColumns({c: F.coalesce(c, zero) for c in ("n_rows", "n_log_files")})


def failures(items: DataFrame, *checks: tuple[str, object]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check, and (row, reason) of the others with the first check that fails; checks: (reason, column true if well)."""
    reason = F.lit(None).cast("string")
    for text, ok in reversed(checks):
        reason = F.when(F.coalesce(ok, F.lit(False)), reason).otherwise(text)
    marked = items.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def single_run(manifest: DataFrame, configured: str | None = None) -> DataFrame:
    """(exp, run_id, reason): the result folder of each experiment, or why there is none.

    manifest: exp, run_id, null where an experiment has no result folder. The only folder counts, or the configured one, which then must be there.
    """
    runs = manifest.groupBy("exp").agg(F.array_sort(F.collect_set("run_id")).alias("runs"))
    if configured is not None:
        there = F.array_contains("runs", configured)
        return runs.select("exp", F.when(there, configured).alias("run_id"), F.when(~there, "configured folder not found").alias("reason"))
    return runs.select("exp", F.when(F.size("runs") == 1, F.col("runs")[0]).alias("run_id"), F.when(F.size("runs") == 0, "not found").when(F.size("runs") > 1, F.concat(F.lit("several: "), F.array_join("runs", ", "))).alias("reason"))


def terminal_chunks(chunks: DataFrame, most: int = 2**32 - 1) -> DataFrame:
    """chunks with status: oversized ones (size > most) are excluded if last of their experiment, else an error."""
    last = chunks.groupBy("exp").agg(F.max("file_num").alias("_last"))
    big = F.col("size") > most
    return chunks.join(last, "exp").withColumn("status", F.when(~big, "ok").when(F.col("file_num") == F.col("_last"), "excluded").otherwise("error")).drop("_last")


def inventory(calls: DataFrame, places: dict[int, str]) -> DataFrame:
    """(event_type, n, n_channels, n_unmapped): calls of each label, its channels, and calls whose channel has no place."""
    from ..functions.labels import location

    return calls.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("channel").alias("n_channels"), F.count_if(location(F.col("channel"), places).isNull()).alias("n_unmapped"))


def distinct_labels(calls: DataFrame, label: str = "event_type") -> DataFrame:
    """Sorted distinct labels."""
    return calls.select(label).filter(F.col(label).isNotNull()).distinct().orderBy(label)


def examples(calls: DataFrame, k: int, by: str = "event_type", order: tuple = ("call_id",)) -> DataFrame:
    """At most k rows of each label."""
    return calls.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def all_ids(*tables: DataFrame, key: str = "exp") -> DataFrame:
    """Sorted distinct ids of several tables."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.union(t.select(key))
    return out.distinct().orderBy(key)
