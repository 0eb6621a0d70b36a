"""The registered queries of the event-sequence operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock, labels, levels
from ..operators import audit, clocks, daynight, distribution, overlap, rates, sequence, sessions, signal, spectral
from ..operators.ordered import shared_path
from ..sources import audio, tables
from .views import BANDS, FOLDERS, LIGHT, ORDER, PLACES, calls, chunks, file_calls, frames, samples, sync, table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: CTEs that the SQL of several queries begins with.
CTE = {
    "c": "c AS (SELECT event_id AS call_id, user_id % 10 AS exp, 10 * (1 + event_id % 3) AS channel, event_type, epoch_us(ts) AS start_us, epoch_us(ts) + CAST(round(value * 1e6) AS BIGINT) AS stop_us, value, user_id FROM events)",
    "v": "v AS (SELECT *, 'all' AS variant FROM c UNION ALL SELECT *, CASE WHEN (start_us // 3600000000) % 24 >= 8 AND (start_us // 3600000000) % 24 < 20 THEN 'day' ELSE 'night' END FROM c)",
    "p": "p AS (SELECT variant, exp, channel, event_type AS from_type, lead(event_type) OVER w AS to_type, lead(start_us) OVER w - stop_us AS gap FROM v WINDOW w AS (PARTITION BY variant, exp, channel ORDER BY start_us, stop_us, event_type, call_id))",
    "b": "b AS (SELECT *, CASE WHEN gap >= 0 AND gap <= 600000000 THEN 'right' WHEN gap > 600000000 AND gap <= 7200000000 THEN 'mid' WHEN gap > 7200000000 AND gap <= 86400000000 THEN 'left' END AS band, CASE WHEN channel = 30 THEN 'underground' ELSE 'arena' END AS location FROM p WHERE to_type IS NOT NULL AND gap IS NOT NULL)",
    "t": "t AS (SELECT unnest(['click','error','purchase','signup','view']) AS ty)",
    "g": "g AS (SELECT variant, band, location, f.ty AS from_type, u.ty AS to_type FROM (SELECT unnest(['all','day','night']) AS variant), (SELECT unnest(['right','mid','left']) AS band), (SELECT unnest(['arena','underground']) AS location), t f, t u)",
    "n": "n AS (SELECT g.*, coalesce(x.n, 0) AS n FROM g LEFT JOIN (SELECT variant, band, location, from_type, to_type, count(*) AS n FROM b WHERE band IS NOT NULL GROUP BY ALL) x USING (variant, band, location, from_type, to_type))",
    "q": "q AS (SELECT *, CASE WHEN sum(n) OVER r = 0 THEN 0.0 ELSE n / CAST(sum(n) OVER r AS DOUBLE) END AS p, CASE WHEN sum(n) OVER m = 0 THEN 0.0 ELSE n / CAST(sum(n) OVER m AS DOUBLE) END AS joint FROM n WINDOW r AS (PARTITION BY variant, band, location, from_type), m AS (PARTITION BY variant, band, location))",
    "tc": "tc AS (SELECT k.*, coalesce(x.n, 0) AS n FROM (SELECT variant, location, ty AS event_type FROM (SELECT unnest(['all','day','night']) AS variant), (SELECT unnest(['arena','underground']) AS location), t) k LEFT JOIN (SELECT variant, CASE WHEN channel = 30 THEN 'underground' ELSE 'arena' END AS location, event_type, count(*) AS n FROM v GROUP BY ALL) x USING (variant, location, event_type))",
    "gp": "gp AS (SELECT * FROM (SELECT *, lead(start_us) OVER (PARTITION BY exp, channel ORDER BY start_us, stop_us, event_type, call_id) - stop_us AS gap_us FROM c) WHERE gap_us >= 0)",
    "sy": "sy AS (SELECT o_orderkey % 10 AS exp, o_orderkey AS row_pos, o_orderkey AS file_num, epoch_us(o_orderdate) AS start_us, epoch_us(o_orderdate) + (o_orderkey % 7 - 1) * 60000000 AS end_us FROM orders)",
    "mi": "mi AS (SELECT exp, sum(end_us - start_us) / 60e6 AS minutes FROM sy WHERE end_us > start_us GROUP BY exp)",
    "di": "di AS (SELECT DISTINCT exp, 'f' || (exp % 3) AS folder, 1 + exp % 2 AS animals FROM sy)",
    "cc": "cc AS (SELECT exp, event_type, count(*) AS n FROM c GROUP BY ALL)",
    "rp": "rp AS (SELECT folder, exp, CAST(coalesce(n, 0) AS BIGINT) AS n, minutes, coalesce(n, 0) / minutes / animals AS rate FROM mi JOIN di USING (exp) LEFT JOIN (SELECT exp, sum(n) AS n FROM cc GROUP BY exp) USING (exp))",
    "rt": "rt AS (SELECT folder, exp, event_type, CAST(coalesce(n, 0) AS BIGINT) AS n, minutes, coalesce(n, 0) / minutes / animals AS rate FROM (SELECT * FROM mi JOIN di USING (exp), (SELECT DISTINCT event_type FROM cc) ty) k LEFT JOIN cc USING (exp, event_type))",
    "st": "st AS (SELECT fo.folder, x.* EXCLUDE (folder) FROM (SELECT unnest(['f0','f1','f2','f3']) AS folder) fo LEFT JOIN (SELECT folder, event_type, count(*) AS n_exp, sum(n) AS calls, avg(rate) AS mean, stddev_samp(rate) AS std FROM rt GROUP BY ALL) x ON fo.folder = x.folder)",
    "bo": """e0 AS (SELECT *, CASE WHEN start_us - lag(start_us) OVER w < 3600000000 THEN 0 ELSE 1 END AS fresh FROM c WHERE event_type = 'error' WINDOW w AS (PARTITION BY exp ORDER BY start_us, stop_us, call_id)),
        e1 AS (SELECT *, sum(fresh) OVER (PARTITION BY exp ORDER BY start_us, stop_us, call_id ROWS UNBOUNDED PRECEDING) AS chain FROM e0),
        e2 AS (SELECT *, count(*) OVER (PARTITION BY exp, chain) AS size, row_number() OVER (PARTITION BY exp, chain ORDER BY start_us, stop_us, call_id) AS pos FROM e1),
        bo AS (SELECT call_id, exp, channel, start_us, stop_us,
                 CASE WHEN size >= 3 THEN CAST(sum(CASE WHEN size >= 3 AND pos = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY exp ORDER BY start_us, stop_us, call_id ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS bout_id,
                 CASE WHEN size >= 3 THEN pos END AS position_in_bout FROM e2)""",
    "fc": "fc AS (SELECT l_orderkey % 10 AS exp, CASE WHEN l_linenumber = 7 THEN -l_orderkey ELSE l_orderkey END AS file_num, l_linenumber, l_partkey, l_linenumber * 1000000 AS start_file_us, l_linenumber * 1000000 + CAST(round(l_quantity * 1e6) AS BIGINT) AS stop_file_us FROM lineitem)",
    "ch": "ch AS (SELECT *, start_us - min(start_us) OVER (PARTITION BY exp) AS offset_us FROM sy)",
    "sa": "sa AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value FROM events)",
    "fr": "fr AS (SELECT CAST(label AS VARCHAR) AS seg_id, vec_id AS frame, i - 1 AS bin, (i - 1) * 100.0::DOUBLE AS freq_hz, abs(CAST(embedding[i] AS DOUBLE)) AS mag FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings))",
    "ck": "ck AS (SELECT (vec_id // 2) % 5 AS exp, CASE WHEN (vec_id // 2) % 17 = 3 THEN 2 * (vec_id % 2) + 1 ELSE vec_id % 2 + 1 END AS channel, vec_id // 2 AS file_num, CASE WHEN vec_id % 11 = 0 THEN 100 ELSE 64 END AS rate, embedding AS samples FROM embeddings)",
}


def _sql(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {', '.join(CTE[c] for c in ctes.split())} {select}" if ctes else select


def query(ctes: str | None = None, select: str = ""):
    """Registers a query under its function's name, with SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if ctes is not None:
            ORACLES[f.__name__] = _sql(ctes, select)
        return f

    return add


def r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _variants(spark, d):
    return daynight.with_variants(calls(spark, d), LIGHT)


def _counts(spark, d):
    return sequence.transition_counts(sequence.in_domain(_variants(spark, d), ORDER), order=ORDER, places=PLACES, bands=BANDS, variants=daynight.VARIANTS)


def _types(spark, d):
    return sequence.type_counts(sequence.in_domain(_variants(spark, d), ORDER), order=ORDER, places=PLACES, variants=daynight.VARIANTS)


@query("c gp", "SELECT call_id, exp, channel, gap_us FROM gp")
def inter_event_gaps(spark, d) -> DataFrame:
    return sequence.gaps(sequence.drop_noise(calls(spark, d))).select("call_id", "exp", "channel", "gap_us")


@query("c", "SELECT * FROM (SELECT call_id, exp, channel, event_type, lead(start_us) OVER (PARTITION BY exp, channel, event_type ORDER BY start_us, stop_us, call_id) - stop_us AS gap_us FROM c) WHERE gap_us >= 0")
def self_gaps(spark, d) -> DataFrame:
    return sequence.gaps(calls(spark, d), (*sequence.SEQUENCE, "event_type")).select("call_id", "exp", "channel", "event_type", "gap_us")


@query("c", "SELECT call_id, lead(start_us) OVER (PARTITION BY exp, channel ORDER BY start_us, stop_us, event_type, call_id) - start_us AS interval_us FROM c")
def start_intervals(spark, d) -> DataFrame:
    return sequence.start_intervals(calls(spark, d)).select("call_id", "interval_us")


@query("c v p b t g n", "SELECT * FROM n")
def transition_counts(spark, d) -> DataFrame:
    return _counts(spark, d)


@query("c v p b t g n q", "SELECT variant, band, location, from_type, to_type, n, round(p, 6) AS p FROM q")
def transition_probabilities(spark, d) -> DataFrame:
    return sequence.row_probabilities(_counts(spark, d)).withColumn("p", r("p"))


@query("c v p b t g n q", "SELECT variant, band, location, from_type, to_type, n, round(joint, 6) AS joint FROM q")
def joint_probabilities(spark, d) -> DataFrame:
    return sequence.joint_probabilities(_counts(spark, d)).withColumn("joint", r("joint"))


@query("c v t tc", "SELECT *, round(n / CAST(sum(n) OVER (PARTITION BY variant, location) AS DOUBLE), 6) AS within, round(n / CAST(sum(n) OVER (PARTITION BY variant) AS DOUBLE), 6) AS overall, round(100.0 * (sum(n) OVER (PARTITION BY variant, location))::DOUBLE / sum(n) OVER (PARTITION BY variant), 6) AS location_pct FROM tc")
def type_proportions(spark, d) -> DataFrame:
    out = sequence.proportions(_types(spark, d))
    return out.withColumns({c: r(c) for c in ("within", "overall", "location_pct")})


@query("c v p b t g n q", """, x AS (SELECT variant, band, from_type, to_type,
    CAST(sum(CASE WHEN location = 'arena' THEN n ELSE -n END) AS BIGINT) AS n_diff, sum(CASE WHEN location = 'arena' THEN p ELSE -p END) AS p_diff, sum(CASE WHEN location = 'arena' THEN joint ELSE -joint END) AS joint_diff FROM q GROUP BY ALL)
    SELECT variant, band, from_type, to_type, n_diff, round(p_diff, 6) + 0.0 AS p_diff, round(joint_diff, 6) + 0.0 AS joint_diff, round(sign(n_diff) * ln(1 + abs(n_diff)), 6) + 0.0 AS n_diff_log, CAST(CASE WHEN max(abs(n_diff)) OVER (PARTITION BY variant) > 0 THEN max(abs(n_diff)) OVER (PARTITION BY variant) ELSE 1 END AS BIGINT) AS "limit" FROM x""")  # fmt: skip
def location_diff(spark, d) -> DataFrame:
    out = sequence.location_difference(_counts(spark, d), "arena", "underground")
    return out.withColumns({c: r(c) + F.lit(0.0) for c in ("p_diff", "joint_diff", "n_diff_log")})


@query("c v p b t g n", "SELECT round(max(ln(1 + n)), 6) AS log_max FROM n")
def shared_log_max(spark, d) -> DataFrame:
    return sequence.shared_log_max(_counts(spark, d)).select(r("log_max").alias("log_max"))


@query("c v", "SELECT variant, exp, event_type, count(*) AS n FROM v GROUP BY ALL")
def daynight_variants(spark, d) -> DataFrame:
    return _variants(spark, d).groupBy("variant", "exp", "event_type").agg(F.count("*").alias("n"))


_HOURS = """, s AS (SELECT exp, min(start_us) AS a, max(stop_us) AS z FROM c GROUP BY exp),
    y AS (SELECT exp, a, z, unnest(range(a // 86400000000, z // 86400000000 + 1)) AS day FROM s),
    w AS (SELECT exp, any_value(z - a) AS whole, CAST(sum(greatest(0, least(z, day * 86400000000 + 72000000000) - greatest(a, day * 86400000000 + 28800000000))) AS BIGINT) AS lit FROM y GROUP BY exp),
    h AS (SELECT exp, 'all' AS variant, whole / 3.6e9 AS hours FROM w UNION ALL SELECT exp, 'day', lit / 3.6e9 FROM w UNION ALL SELECT exp, 'night', (whole - lit) / 3.6e9 FROM w)"""


@query("c", _HOURS + " SELECT exp, variant, round(hours, 6) AS hours FROM h")
def hours_in_window(spark, d) -> DataFrame:
    return daynight.hours_in_window(daynight.spans(calls(spark, d)), LIGHT).withColumn("hours", r("hours"))


@query("c", _HOURS + " SELECT variant, round(sum(hours), 4) AS hours FROM h GROUP BY variant")
def total_hours(spark, d) -> DataFrame:
    return daynight.total_hours(daynight.hours_in_window(daynight.spans(calls(spark, d)), LIGHT)).withColumn("hours", r("hours", 4))


EDGES = (1.0, 10.0, 60.0, 300.0, 600.0, 1800.0, 3600.0, 7200.0, 14400.0, 43200.0, 86400.0)
_BINS = f", x AS (SELECT event_type, gap_us / 1e6 AS gap FROM gp), e AS (SELECT [{', '.join(f'{e}::DOUBLE' for e in EDGES)}] AS e), h AS (SELECT event_type, CAST(least(len(list_filter(e, lambda y: y <= gap)) - 1, {len(EDGES) - 2}) AS INTEGER) AS bin, any_value(e) AS e, count(*) AS n FROM x, e WHERE gap >= {EDGES[0]} AND gap <= {EDGES[-1]} GROUP BY ALL)"


def _gap_seconds(spark, d):
    return sequence.gaps(calls(spark, d)).withColumn("gap", F.col("gap_us") / 1e6)


@query("c gp", _BINS.replace("count(*) AS n FROM x, e WHERE", "count(*) AS n FROM x, e WHERE") + " SELECT event_type, bin, e[bin + 1] AS low, e[bin + 2] AS high, n FROM h")
def gap_histogram(spark, d) -> DataFrame:
    return distribution.histogram(_gap_seconds(spark, d), "gap", EDGES, ["event_type"])


@query("c gp", _BINS + " SELECT max(n) AS peak FROM h")
def histogram_peak(spark, d) -> DataFrame:
    return distribution.peak(distribution.histogram(_gap_seconds(spark, d), "gap", EDGES, ["event_type"]))


@query("c gp", ", x AS (SELECT exp, gap_us FROM gp WHERE gap_us > 0) SELECT exp, gap_us, round(row_number() OVER (PARTITION BY exp ORDER BY gap_us) / CAST(count(*) OVER (PARTITION BY exp) AS DOUBLE), 9) AS cdf FROM x")
def gap_cdf(spark, d) -> DataFrame:
    return distribution.empirical_cdf(sequence.gaps(calls(spark, d)), "gap_us", ["exp"]).withColumn("cdf", r("cdf", 9))


@query("c gp", ", x AS (SELECT event_type, gap_us / 1e6 AS gap FROM gp WHERE gap_us > 0) SELECT event_type, threshold, round(avg(CASE WHEN gap <= threshold THEN 1.0 ELSE 0.0 END), 9) AS fraction, count(*) FILTER (WHERE gap > 86400) AS beyond FROM x, (SELECT unnest([60.0::DOUBLE, 600.0, 7200.0]) AS threshold) GROUP BY ALL")
def gap_threshold_fraction(spark, d) -> DataFrame:
    return distribution.threshold_fractions(_gap_seconds(spark, d), "gap", (60.0, 600.0, 7200.0), 86400.0, ["event_type"]).withColumn("fraction", r("fraction", 9))


def _rate_inputs(spark, d):
    chunks_ = sync(spark, d)
    dims = chunks_.select("exp").distinct().select("exp", F.concat(F.lit("f"), (F.col("exp") % 3).cast("string")).alias("folder"), (1 + F.col("exp") % 2).alias("animals"))
    return rates.call_counts(calls(spark, d)), rates.recorded_minutes(chunks_)[0], dims


@query("c", "SELECT exp, coalesce(lower(trim(event_type)), 'nan') AS event_type, count(*) AS n FROM c GROUP BY ALL")
def call_counts(spark, d) -> DataFrame:
    return rates.call_counts(calls(spark, d))


@query("sy mi", "SELECT exp, round(minutes, 6) AS minutes FROM mi")
def recorded_minutes(spark, d) -> DataFrame:
    return rates.recorded_minutes(sync(spark, d))[0].withColumn("minutes", r("minutes"))


@query("c sy mi di cc rp", "SELECT folder, exp, n, round(minutes, 6) AS minutes, round(rate, 9) AS rate FROM rp")
def event_rates(spark, d) -> DataFrame:
    return rates.pooled_rates(*_rate_inputs(spark, d)).withColumns({"minutes": r("minutes"), "rate": r("rate", 9)})


@query("c sy mi di cc rt", "SELECT folder, exp, event_type, n, round(rate, 9) AS rate FROM rt")
def rates_by_type(spark, d) -> DataFrame:
    return rates.rates_by_type(*_rate_inputs(spark, d)).drop("minutes").withColumn("rate", r("rate", 9))


@query("c sy mi di cc rp", "SELECT fo.folder, n_exp, calls, round(minutes, 4) AS minutes, round(mean, 9) AS mean, round(std, 9) AS std FROM (SELECT unnest(['f0','f1','f2','f3']) AS folder) fo LEFT JOIN (SELECT folder, count(*) AS n_exp, CAST(sum(n) AS BIGINT) AS calls, sum(minutes) AS minutes, avg(rate) AS mean, stddev_samp(rate) AS std FROM rp GROUP BY folder) USING (folder)")
def rate_summary(spark, d) -> DataFrame:
    out = rates.summary(rates.pooled_rates(*_rate_inputs(spark, d)), ["folder"], FOLDERS).drop("ord")
    return out.withColumns({"minutes": r("minutes", 4), "mean": r("mean", 9), "std": r("std", 9)})


def _by_type(spark, d):
    return rates.summary(rates.rates_by_type(*_rate_inputs(spark, d)), ["folder", "event_type"], FOLDERS)


@query("c sy mi di cc rt st", "SELECT folder, event_type, n_exp, CAST(calls AS BIGINT) AS calls, round(mean, 9) AS mean, round(std, 9) AS std FROM st")
def rate_summary_by_type(spark, d) -> DataFrame:
    return _by_type(spark, d).select("folder", "event_type", "n_exp", "calls", r("mean", 9).alias("mean"), r("std", 9).alias("std"))


@query("c sy mi di cc rt st", "SELECT event_type, " + ", ".join(f"round(max(mean) FILTER (WHERE folder = '{f}'), 9) AS {f}_mean, round(max(std) FILTER (WHERE folder = '{f}'), 9) AS {f}_std" for f in FOLDERS) + " FROM st WHERE event_type IS NOT NULL GROUP BY event_type")
def rate_pivot(spark, d) -> DataFrame:
    out = rates.wide(_by_type(spark, d), FOLDERS)
    return out.select("event_type", *[r(c, 9).alias(c) for c in out.columns[1:]])


@query("c sy mi di cc rt st", ", m AS (SELECT event_type, round(avg(mean), 9) AS mean FROM st WHERE event_type IS NOT NULL GROUP BY event_type) SELECT * FROM m")
def type_ranking(spark, d) -> DataFrame:
    return rates.ranking(_by_type(spark, d)).withColumn("mean", r("mean", 9))


def _bouts(spark, d):
    return sessions.bouts(calls(spark, d).filter("event_type = 'error'"), gap_us=3_600_000_000, min_events=3)


@query("c bo", "SELECT call_id, exp, bout_id, position_in_bout FROM bo")
def bouts(spark, d) -> DataFrame:
    return _bouts(spark, d).select("call_id", "exp", "bout_id", "position_in_bout")


@query("c bo", "SELECT c.call_id, bout_id, CASE WHEN bout_id IS NOT NULL THEN 'bout_' || bout_id ELSE 'no_bout_row' || c.call_id END AS bout_key FROM c LEFT JOIN bo ON c.call_id = bo.call_id")
def bout_back_join(spark, d) -> DataFrame:
    return sessions.with_bouts(calls(spark, d), _bouts(spark, d)).select("call_id", "bout_id", sessions.bout_key().alias("bout_key"))


@query("c bo", "SELECT exp, bout_id, arg_min(channel, (start_us, stop_us, call_id)) AS channel, min(start_us) AS start_us, max(stop_us) AS stop_us, count(*) AS n_calls, round((max(stop_us) - min(start_us)) / 1e6, 6) AS duration_sec FROM bo WHERE bout_id IS NOT NULL GROUP BY exp, bout_id HAVING count(*) > 1")
def bout_summary(spark, d) -> DataFrame:
    return sessions.bout_summary(_bouts(spark, d)).withColumn("duration_sec", r("duration_sec"))


@query("c bo", "SELECT exp, count(bout_id) AS in_bouts, count(DISTINCT bout_id) AS n_bouts FROM bo GROUP BY exp")
def bout_counts(spark, d) -> DataFrame:
    return sessions.bout_counts(_bouts(spark, d))


@query("c bo", ", i AS (SELECT exp, bout_id, row_number() OVER (ORDER BY exp, bout_id) AS global_bout_id FROM (SELECT DISTINCT exp, bout_id FROM bo WHERE bout_id IS NOT NULL)) SELECT call_id, exp, bo.bout_id, global_bout_id FROM bo LEFT JOIN i USING (exp, bout_id)")
def global_bout_ids(spark, d) -> DataFrame:
    return sessions.global_bout_ids(_bouts(spark, d)).select("call_id", "exp", "bout_id", "global_bout_id")


@query("c", "SELECT call_id, exp, round((start_us - (SELECT min(start_us) FROM c WHERE exp = (SELECT min(exp) FROM c))) / 1e6, 6) AS start_time_experiment_sec FROM c")
def global_origin(spark, d) -> DataFrame:
    return sessions.global_origin(calls(spark, d)).select("call_id", "exp", r("start_time_experiment_sec").alias("start_time_experiment_sec"))


@query("c", """, k AS (SELECT exp, min(start_us) AS a, 1::BIGINT AS g FROM c GROUP BY exp
      UNION ALL SELECT k.exp, (SELECT min(start_us) FROM c WHERE c.exp = k.exp AND c.start_us > k.a + 600000000), k.g + 1 FROM k
      WHERE EXISTS (SELECT 1 FROM c WHERE c.exp = k.exp AND c.start_us > k.a + 600000000)),
    m AS (SELECT c.call_id, c.exp, c.start_us, c.value, k.g AS group_no FROM c ASOF JOIN k ON c.exp = k.exp AND c.start_us >= k.a)
    SELECT call_id, exp, group_no, row_number() OVER (PARTITION BY exp, group_no ORDER BY value DESC, start_us, call_id) = 1 AS is_chosen, count(*) OVER (PARTITION BY exp, group_no) AS group_size FROM m""")  # fmt: skip
def greedy_overlap(spark, d) -> DataFrame:
    rows = calls(spark, d).withColumnRenamed("start_us", "onset_us")
    grouped = overlap.overlap_groups(rows, window_us=600_000_000, keys=("exp",))
    return overlap.choose_loudest(grouped, ["value"], keys=("exp",)).select("call_id", "exp", "group_no", "is_chosen", "group_size")


@query("", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= l_extendedprice / 1000 AND l_quantity >= l_tax * 500 THEN 'arena_1' WHEN l_extendedprice / 1000 >= l_tax * 500 THEN 'arena_2' ELSE 'underground' END AS assigned_location FROM lineitem")
def loudest_source(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumns({"RMS_arena_1": F.col("l_quantity"), "RMS_arena_2": F.col("l_extendedprice") / 1000, "RMS_underground": F.col("l_tax") * 500})
    return overlap.assign_location(rows, {n: f"RMS_{n}" for n in ("arena_1", "arena_2", "underground")}).select("l_orderkey", "l_linenumber", "assigned_location")


def _chunk_starts(spark, d):
    return clocks.chunk_starts(sync(spark, d))


@query("sy fc ch", "SELECT fc.exp, fc.file_num, l_linenumber, l_partkey, offset_us + start_file_us AS start_exp_us, offset_us + stop_file_us AS stop_exp_us, start_us + start_file_us AS start_us, start_us + stop_file_us AS stop_us FROM fc JOIN ch ON fc.exp = ch.exp AND fc.file_num = ch.file_num")
def clock_alignment(spark, d) -> DataFrame:
    return clocks.align(file_calls(spark, d), _chunk_starts(spark, d)).drop("start_file_us", "stop_file_us")


@query("sy fc ch", "SELECT exp, file_num, count(*) AS n_calls FROM fc WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.exp = fc.exp AND ch.file_num = fc.file_num) GROUP BY ALL")
def missing_files_report(spark, d) -> DataFrame:
    return clocks.missing_files(file_calls(spark, d), _chunk_starts(spark, d))


@query("sy", "SELECT exp, row_number() OVER (PARTITION BY exp ORDER BY row_pos) - 1 AS file_num, start_us FROM sy")
def positional_sync(spark, d) -> DataFrame:
    return clocks.by_position(sync(spark, d)).select("exp", "file_num", "start_us")


@query("", "SELECT o_orderkey, CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN 'urgent' WHEN '2-high' THEN 'urgent' WHEN '5-low' THEN 'low' ELSE lower(trim(o_orderpriority)) END AS label FROM orders")
def label_canonical(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", labels.canonical(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ")), {"1-urgent": "urgent", "2-high": "urgent", "5-low": "low"}).alias("label"))


_GROUPS = {"click": "passive", "view": "passive", "signup": "account"}


@query("c", "SELECT g AS event_type, CAST(list_position(['passive','error','purchase','account'], g) AS INTEGER) AS ord, count(*) AS n FROM (SELECT CASE WHEN event_type IN ('click','view') THEN 'passive' WHEN event_type = 'signup' THEN 'account' ELSE event_type END AS g FROM c) GROUP BY g")
def label_group(spark, d) -> DataFrame:
    order = labels.effective_order(ORDER, _GROUPS)
    rows = calls(spark, d).select(labels.grouped(F.col("event_type"), _GROUPS).alias("event_type")).groupBy("event_type").agg(F.count("*").alias("n"))
    place = spark.range(1).select(F.posexplode(F.array(*[F.lit(o) for o in order])).alias("ord", "event_type"))
    return place.join(rows, "event_type").select("event_type", (F.col("ord") + 1).alias("ord"), "n")


@query("", "SELECT c_custkey, month FROM (SELECT c_custkey, CASE WHEN c_custkey BETWEEN 0 AND 299 THEN 'm1' WHEN c_custkey BETWEEN 300 AND 899 THEN 'm2' WHEN c_custkey BETWEEN 1000 AND 9999 THEN 'm3' END AS month FROM customer) WHERE month IS NOT NULL AND c_custkey NOT IN (7, 305, 1001)")
def exp_month_dim(spark, d) -> DataFrame:
    months = spark.createDataFrame([(0, 299, "m1"), (300, 899, "m2"), (1000, 9999, "m3")], "lo long, hi long, month string")
    rows = clocks.without_skipped(table(spark, d, "customer").select(F.col("c_custkey").alias("exp")), (7, 305, 1001))
    return clocks.in_range(rows, months)[0].select(F.col("exp").alias("c_custkey"), "month")


@query("", "SELECT c_custkey, v AS virtual_ch, CASE WHEN c_custkey <= 271 THEN v * 10 + 1 ELSE v * 10 + 2 END AS ch1, CASE WHEN c_custkey <= 271 THEN v * 10 + 3 ELSE v * 10 + 4 END AS ch2 FROM customer, (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS v)")
def channel_pairs(spark, d) -> DataFrame:
    dim = spark.createDataFrame([(lo, hi, v, v * 10 + s, v * 10 + s + 2) for lo, hi, s in ((0, 271, 1), (272, 10**9, 2)) for v in (1, 2, 3)], "lo long, hi long, virtual_ch long, ch1 long, ch2 long")
    return clocks.in_range(table(spark, d, "customer").select(F.col("c_custkey").alias("exp")), dim)[0].withColumnRenamed("exp", "c_custkey")


@query("", "SELECT n_nationkey, unnest(range(n_nationkey, n_nationkey + n_regionkey + 1)) AS exp FROM nation")
def selector_expansion(spark, d) -> DataFrame:
    rows = table(spark, d, "nation").withColumn("sel", F.concat_ws(":", F.col("n_nationkey").cast("string"), (F.col("n_nationkey") + F.col("n_regionkey")).cast("string")))
    return rows.select("n_nationkey", F.explode(F.sequence(*(F.element_at(F.transform(F.split("sel", ":"), lambda x: x.cast("long")), i) for i in (1, -1)))).alias("exp"))


@query("", "SELECT c_custkey, CASE WHEN c_custkey BETWEEN 270 AND 277 THEN 4 ELSE 6 END AS playback_channel FROM customer")
def playback_channels(spark, d) -> DataFrame:
    listed = spark.createDataFrame([(i, 4) for i in range(270, 278)], "exp long, channel int")
    return clocks.playback_channel(table(spark, d, "customer").select(F.col("c_custkey").alias("exp")), listed).select(F.col("exp").alias("c_custkey"), "playback_channel")


def _audit(spark, d):
    have = table(spark, d, "lineitem").select((F.col("l_orderkey") % 10).alias("exp"), F.when(F.col("l_orderkey") % 97 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("file_num"))
    want = table(spark, d, "orders").select((F.col("o_orderkey") % 10).alias("exp"), F.col("o_orderkey").alias("file_num"))
    return audit.expected_vs_actual(want, have)


_AUDIT = """WITH a AS (SELECT DISTINCT l_orderkey % 10 AS exp, CASE WHEN l_orderkey % 97 = 0 THEN -l_orderkey ELSE l_orderkey END AS f, 1 AS a FROM lineitem),
    e AS (SELECT o_orderkey % 10 AS exp, o_orderkey AS f, 1 AS e FROM orders),
    x AS (SELECT exp, count(e) AS n_expected, count(a) AS n_actual, coalesce(list(f ORDER BY f) FILTER (WHERE a IS NULL), []) AS missing, coalesce(list(f ORDER BY f) FILTER (WHERE e IS NULL), []) AS extra FROM e FULL JOIN a USING (exp, f) GROUP BY exp)"""


@query("", _AUDIT + " SELECT exp, n_expected, n_actual, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra FROM x")
def expected_vs_actual(spark, d) -> DataFrame:
    text = lambda c: F.array_join(F.transform(F.col(c), lambda i: i.cast("string")), ",").alias(c)
    return _audit(spark, d).select("exp", "n_expected", "n_actual", text("missing"), text("extra"))


@query("", _AUDIT + " SELECT count(*) AS n_exp, count(*) FILTER (WHERE len(missing) > 0) AS n_missing, count(*) FILTER (WHERE len(extra) > 0) AS n_extra, count(*) FILTER (WHERE len(missing) = 0 AND len(extra) = 0) AS n_ok FROM x")
def audit_roll_up(spark, d) -> DataFrame:
    return audit.roll_up(_audit(spark, d))


@query("", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS is_done FROM customer")
def completion_split(spark, d) -> DataFrame:
    return audit.completion(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("", "SELECT c_custkey AS exp, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 'already_present' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'copied' ELSE 'no_raw_log_found' END AS status FROM customer")
def log_presence(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("exp"), "o_orderstatus")
    return audit.log_presence(table(spark, d, "customer").select(F.col("c_custkey").alias("exp")), o, o.filter("o_orderstatus = 'F'"))


@query("", """WITH m AS (SELECT l_suppkey AS exp, CASE WHEN (CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey // 3 ELSE l_partkey END) % 2 = 0 THEN 'modern' ELSE 'legacy' END AS scheme, l_linenumber AS f FROM lineitem),
    s AS (SELECT exp, coalesce(list_sort(list(DISTINCT f) FILTER (WHERE scheme = 'modern')), []) AS mo, coalesce(list_sort(list(DISTINCT f) FILTER (WHERE scheme = 'legacy')), []) AS le FROM m GROUP BY exp)
    SELECT exp, CASE WHEN len(mo) > 0 AND (len(le) = 0 OR mo = le) THEN 'modern' WHEN len(le) > 0 AND len(mo) = 0 THEN 'legacy' END AS scheme, CASE WHEN len(mo) > 0 AND len(le) > 0 AND mo <> le THEN 'schemes differ' WHEN len(mo) = 0 AND len(le) = 0 THEN 'no chunks' END AS reason FROM s""")  # fmt: skip
def naming_schemes(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("_of", F.when(F.col("l_suppkey") % 3 == 0, F.floor(F.col("l_suppkey") / 3)).otherwise(F.col("l_partkey")))
    return audit.naming_schemes(rows.select(F.col("l_suppkey").alias("exp"), F.when(F.col("_of") % 2 == 0, "modern").otherwise("legacy").alias("scheme"), F.col("l_linenumber").alias("file_num")))


@query("sy", "SELECT c_custkey AS exp, arg_min(start_us, row_pos) AS start_us, arg_max(end_us, row_pos) AS end_us, round((arg_max(end_us, row_pos) - arg_min(start_us, row_pos)) / 3.6e9, 6) AS hours, count(DISTINCT file_num) AS n_chunks FROM customer LEFT JOIN sy ON c_custkey = exp GROUP BY c_custkey")
def experiment_times(spark, d) -> DataFrame:
    s = sync(spark, d)
    return audit.experiment_times(table(spark, d, "customer").select(F.col("c_custkey").alias("exp")), s, s).withColumn("hours", r("hours"))


@query("", "SELECT 'm' || (c_custkey % 4) AS month, count(DISTINCT c_custkey) AS n_exp, count(*) FILTER (WHERE c_custkey < 10) AS n_with_times FROM customer GROUP BY ALL")
def month_roll_up(spark, d) -> DataFrame:
    s, c = sync(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("exp"))
    return audit.month_roll_up(audit.experiment_times(c, s, s), c.select("exp", F.concat(F.lit("m"), (F.col("exp") % 4).cast("string")).alias("month")))


@query("", "SELECT o_custkey AS exp, o_orderkey AS file_num, CASE WHEN o_totalprice <= 200000 THEN 'ok' WHEN o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) THEN 'excluded' ELSE 'error' END AS status FROM orders")
def terminal_chunks(spark, d) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("exp"), F.col("o_orderkey").alias("file_num"), F.col("o_totalprice").alias("size"))
    return audit.terminal_chunks(rows, 200_000).select("exp", "file_num", "status")


_LINES = r"""l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn) AS copy, unnest(string_split(CASE turn % 4 WHEN 0 THEN '2025-07-0' || (conv_id % 12) || '_12-00-05>' || coalesce(text, '') WHEN 1 THEN '2025-07-01_10-00-00>x_' || role ELSE coalesce(text, '') END, chr(10))) AS line FROM conversations)"""
_STAMP = r"CASE WHEN regexp_full_match(trim(regexp_extract(line, '^([^>]+)>(.*)$', 1)), '\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}') THEN epoch_us(try_strptime(trim(regexp_extract(line, '^([^>]+)>(.*)$', 1)), '%Y-%m-%d_%H-%M-%S')) END"


def _log_text(spark, d):
    c, text = table(spark, d, "conversations"), F.coalesce(F.col("text"), F.lit(""))
    value = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("2025-07-0"), (F.col("conv_id") % 12).cast("string"), F.lit("_12-00-05>"), text)).when(F.col("turn") % 4 == 1, F.concat(F.lit("2025-07-01_10-00-00>x_"), F.col("role"))).otherwise(text)
    return c.select("conv_id", "turn", value.alias("value"))


@query("", f"WITH {_LINES} SELECT conv_id, turn, CASE WHEN regexp_matches(line, '^([^>]+)>(.*)$') THEN 'parsed' ELSE 'unparsed' END AS parse_status, count(*) AS n, count({_STAMP}) AS n_timed, CAST(min({_STAMP}) AS BIGINT) AS first_us FROM l WHERE trim(line) <> '' GROUP BY ALL")
def log_parse(spark, d) -> DataFrame:
    rows = tables.log_lines(_log_text(spark, d), keep=("conv_id", "turn"))
    return rows.groupBy("conv_id", "turn", "parse_status").agg(F.count("*").alias("n"), F.count("log_us").alias("n_timed"), F.min("log_us").alias("first_us"))


@query("", f"WITH v AS (SELECT conv_id, turn, string_split(CASE turn % 4 WHEN 0 THEN '2025-07-0' || (conv_id % 12) || '_12-00-05>' || coalesce(text, '') WHEN 1 THEN '2025-07-01_10-00-00>x_' || role ELSE coalesce(text, '') END, chr(10)) AS ls FROM conversations), o AS (SELECT conv_id, turn, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) AS BIGINT) AS line_number FROM v) SELECT conv_id, turn, line_number, {_STAMP} AS log_us, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, {_STAMP} NULLS LAST, line_number) AS BIGINT) AS place FROM o WHERE trim(line) <> ''")
def log_order(spark, d) -> DataFrame:
    """The place of each line in its conversation's log."""
    rows = tables.log_lines(_log_text(spark, d), keep=("conv_id", "turn"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(*tables.log_order("turn"))).cast("long")
    return rows.select("conv_id", "turn", "line_number", "log_us", place.alias("place"))


@query("", f"WITH {_LINES} SELECT * FROM (SELECT conv_id, turn, {_STAMP} AS start_us, 'log' AS event_type, trim(regexp_extract(line, '^([^>]+)>(.*)$', 2)) AS note FROM l WHERE contains(line, '>') AND contains(line, '_')) WHERE start_us IS NOT NULL")
def log_events(spark, d) -> DataFrame:
    return tables.log_events(_log_text(spark, d).select("conv_id", "turn", F.explode(F.split("value", "\n", -1)).alias("line")))


@query("c", "SELECT exp, call_id, event_type, start_us, CAST(NULL AS VARCHAR) AS note FROM c UNION ALL SELECT o_custkey % 10, NULL, 'order', epoch_us(o_orderdate), o_orderpriority FROM orders")
def union_events(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("exp"), F.lit("order").alias("event_type"), clock.micros(F.col("o_orderdate")).alias("start_us"), F.col("o_orderpriority").alias("note"))
    both = tables.union_by_name([calls(spark, d).select("exp", "call_id", "event_type", "start_us"), o])
    return tables.aligned(both, [("exp", "long"), ("call_id", "long"), ("event_type", "string"), ("start_us", "long"), ("note", "string")], rest=False).orderBy("exp", "start_us")


@query("sa", "SELECT file, idx, CASE WHEN count(*) OVER c = 4 THEN round(avg(value) OVER c, 6) END AS centred, CASE WHEN count(*) OVER t = 5 THEN round(avg(value) OVER t, 6) END AS trailing FROM sa WINDOW c AS (PARTITION BY file ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), t AS (PARTITION BY file ORDER BY idx ROWS 4 PRECEDING)")
def rolling_mean(spark, d) -> DataFrame:
    one = signal.rolling_mean(samples(spark, d), 4, centred=True, out="centred")
    return signal.rolling_mean(one, 5, centred=False, out="trailing").select("file", "idx", r("centred").alias("centred"), r("trailing").alias("trailing"))


@query("sa", """, e AS (SELECT *, value < 30 AS low, lag(value < 30) OVER w AS was, lag(idx) OVER w AS before, max(value) OVER (PARTITION BY file) AS top FROM sa WINDOW w AS (PARTITION BY file ORDER BY idx)),
    p AS (SELECT *, lead(before) OVER (PARTITION BY file ORDER BY idx) AS end_idx FROM e WHERE top >= 100 AND was IS NOT NULL AND was <> low)
    SELECT file, before AS start_idx, end_idx, end_idx - before AS n FROM p WHERE low AND end_idx IS NOT NULL AND end_idx - before >= 3""")  # fmt: skip
def dip_intervals(spark, d) -> DataFrame:
    return signal.dips(samples(spark, d), low=30.0, least_samples=3, gate=100.0)


@query("sa", ", m AS (SELECT *, CASE WHEN count(*) OVER t = 5 THEN avg(value) OVER t END AS mean FROM sa WINDOW t AS (PARTITION BY file ORDER BY idx ROWS 4 PRECEDING)), f AS (SELECT file, min(idx) AS first FROM m WHERE mean > 70 GROUP BY file) SELECT file, idx, idx - first AS since FROM m JOIN f USING (file) WHERE idx >= first")
def activation_gate(spark, d) -> DataFrame:
    rows = signal.rolling_mean(samples(spark, d), 5, centred=False)
    file_clock, own_clock = (signal.activated(rows, level=70.0, compat=c) for c in (False, True))
    first = file_clock.groupBy("file").agg(F.min("idx").alias("first"))
    return own_clock.join(first, "file").select("file", (F.col("idx") + F.col("first")).alias("idx"), F.col("idx").alias("since"))


_RUNS = ", a AS (SELECT *, CASE WHEN (value > 35) = lag(value > 35) OVER w THEN 0 ELSE 1 END AS fresh FROM sa WINDOW w AS (PARTITION BY file ORDER BY idx)), u AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY file ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM a), ru AS (SELECT file, run, any_value(value > 35) AS is_on, min(idx) AS first_idx, count(*) AS n FROM u GROUP BY file, run)"


@query("sa", _RUNS + " SELECT * FROM ru")
def run_lengths(spark, d) -> DataFrame:
    return signal.runs(samples(spark, d), F.col("value") > 35)


@query("sa", _RUNS + " SELECT file, CASE WHEN n * 10.0 BETWEEN 8 AND 12 THEN 1 WHEN n * 10.0 BETWEEN 48 AND 52 THEN 2 ELSE 0 END AS code FROM ru WHERE run = 1")
def first_run_code(spark, d) -> DataFrame:
    return signal.first_run_code(signal.runs(samples(spark, d), F.col("value") > 35), 100)


@query("", "SELECT vec_id, round(20 * log10(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / len(embedding)) + 1e-12), 6) AS level_db FROM embeddings")
def rms_db(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", r(levels.level_db(F.col("embedding"))).alias("level_db"))


_PAIR = ", w AS (SELECT DISTINCT exp, file_num FROM ck), j AS (SELECT w.exp, w.file_num, a.rate AS r1, b.rate AS r2, a.samples AS s1, b.samples AS s2, CASE WHEN a.samples IS NULL OR b.samples IS NULL THEN 'missing' WHEN a.rate <> b.rate THEN 'rate' WHEN len(a.samples) <> len(b.samples) THEN 'shape' ELSE 'saved' END AS outcome FROM w LEFT JOIN ck a ON w.exp = a.exp AND w.file_num = a.file_num AND a.channel = 1 LEFT JOIN ck b ON w.exp = b.exp AND w.file_num = b.file_num AND b.channel = 2)"


def _paired(spark, d):
    pairs = spark.createDataFrame([(e, "10", 1, 2) for e in range(5)], "exp long, virtual_ch string, ch1 int, ch2 int")
    return signal.pair_average(chunks(spark, d), pairs)


@query("ck", _PAIR + " SELECT exp, '10' AS virtual_ch, file_num, outcome, CASE WHEN outcome = 'saved' THEN round(list_sum(list_transform(list_zip(s1, s2), lambda z: (CAST(z[1] AS DOUBLE) + CAST(z[2] AS DOUBLE)) / 2)), 4) + 0.0 END AS total FROM j")
def pair_average(spark, d) -> DataFrame:
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return _paired(spark, d).select("exp", "virtual_ch", "file_num", "outcome", (r(total, 4) + F.lit(0.0)).alias("total"))


@query("ck", _PAIR + " SELECT exp, " + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS n_{o}" for o in ("saved", "missing", "rate", "shape")) + " FROM j GROUP BY exp")
def pair_outcomes(spark, d) -> DataFrame:
    return signal.outcome_counts(_paired(spark, d))


@query("ck", ", x AS (SELECT exp, file_num, channel AS source_channel, samples[5 + CAST(file_num % 3 AS INTEGER):24] AS s FROM ck WHERE rate = 64) SELECT k.exp, k.file_num, k.channel AS source_channel, CASE WHEN s IS NOT NULL THEN round(20 * log10(sqrt(list_sum(list_transform(s, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / len(s)) + 1e-12), 6) END AS level_db FROM ck k LEFT JOIN x ON k.exp = x.exp AND k.file_num = x.file_num AND k.channel = x.source_channel UNION ALL SELECT DISTINCT exp, -file_num - 1, NULL, NULL FROM ck")
def call_levels(spark, d) -> DataFrame:
    c = chunks(spark, d)
    there = c.select("exp", "file_num").distinct()
    calls_ = there.unionByName(there.withColumn("file_num", -F.col("file_num") - 1)).select("exp", "file_num", ((4 + F.col("file_num") % 3) / 64.0).alias("onset_s"), F.lit(24 / 64.0).alias("offset_s"))
    return signal.call_levels(calls_, c, rate=64).select("exp", "file_num", "source_channel", r("level_db").alias("level_db"))


@query("fr", ", p AS (SELECT seg_id, frame, mag / sum(mag) OVER (PARTITION BY seg_id, frame) AS p FROM fr) SELECT seg_id, frame, round(sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END) / log2(count(*)), 6) AS entropy FROM p GROUP BY seg_id, frame")
def spectral_entropy(spark, d) -> DataFrame:
    return spectral.frame_entropy(frames(spark, d)).withColumn("entropy", r("entropy"))


@query("fr", "SELECT seg_id, frame, round(exp(avg(ln(greatest(mag * mag, 1e-10)))) / avg(greatest(mag * mag, 1e-10)), 6) AS flatness FROM fr GROUP BY seg_id, frame")
def spectral_flatness(spark, d) -> DataFrame:
    return spectral.frame_flatness(frames(spark, d)).withColumn("flatness", r("flatness"))


@query("fr", ", k AS (SELECT *, sum(freq_hz * mag) OVER w / sum(mag) OVER w AS c, sum(mag) OVER (PARTITION BY seg_id, frame ORDER BY bin ROWS UNBOUNDED PRECEDING) AS upto, sum(mag) OVER w AS tot FROM fr WINDOW w AS (PARTITION BY seg_id, frame)) SELECT seg_id, frame, round(any_value(c), 4) AS centroid, round(sqrt(sum((freq_hz - c) * (freq_hz - c) * mag) / sum(mag)), 4) AS bandwidth, min(CASE WHEN upto >= 0.85 * tot THEN freq_hz END) AS rolloff FROM k GROUP BY seg_id, frame")
def spectral_shape(spark, d) -> DataFrame:
    return spectral.frame_shape(frames(spark, d)).withColumns({"centroid": r("centroid", 4), "bandwidth": r("bandwidth", 4)})


@query("fr", "SELECT seg_id, frame, round(sqrt(avg(mag * mag)), 6) AS rms FROM fr GROUP BY seg_id, frame")
def frame_power(spark, d) -> DataFrame:
    return spectral.frame_power(frames(spark, d)).withColumn("rms", r("rms"))


_CONTRAST = """, s AS (SELECT seg_id, frame, list(mag ORDER BY bin) AS m, list(freq_hz ORDER BY bin) AS f FROM fr GROUP BY ALL),
    k AS (SELECT *, 200.0::DOUBLE * pow(2, band) AS hi, CASE WHEN band = 0 THEN 0.0 ELSE 100.0 * pow(2, band) END AS lo FROM (SELECT *, unnest(range(0, 7)) AS band FROM s)),
    e AS (SELECT *, len(list_filter(f, lambda x: x < lo)) AS a, CASE WHEN band = 6 THEN len(f) ELSE len(list_filter(f, lambda x: x <= hi)) END AS z FROM k),
    g AS (SELECT *, CASE WHEN band = 0 THEN a ELSE greatest(a - 1, 0) END AS st FROM e WHERE z > a),
    h AS (SELECT seg_id, frame, band, list_sort(m[st + 1 : z - CASE WHEN band = 6 THEN 0 ELSE 1 END]) AS m, CAST(greatest(1, round_even(0.02 * (z - st), 0)) AS INTEGER) AS n FROM g),
    v AS (SELECT seg_id, frame, band, 10 * log10(greatest(1e-10, list_avg(m[len(m) - n + 1 :]))) AS p, 10 * log10(greatest(1e-10, list_avg(m[1 : n]))) AS q FROM h WHERE len(m) > 0)
    SELECT seg_id, frame, CAST(band AS INTEGER) AS band, round(greatest(p, max(p) OVER w - 80) - greatest(q, max(q) OVER w - 80), 4) + 0.0 AS contrast FROM v WINDOW w AS (PARTITION BY seg_id)"""


@query("fr", _CONTRAST)
def spectral_contrast(spark, d) -> DataFrame:
    return spectral.contrast(frames(spark, d)).withColumn("contrast", r("contrast", 4) + F.lit(0.0))


@query("fr", ", x AS (SELECT *, 10 * log10(greatest(1e-10, mag * mag + 1e-12)) AS db0 FROM fr), y AS (SELECT *, greatest(db0, max(db0) OVER (PARTITION BY seg_id) - 80) AS db FROM x) SELECT seg_id, frame, k, round(sum(db * cos(pi() * k * (bin + 0.5) / 64)) * sqrt(CASE WHEN k = 0 THEN 1.0 ELSE 2.0 END / 64), 4) + 0.0 AS coefficient FROM y, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY seg_id, frame, k")
def cepstrum(spark, d) -> DataFrame:
    return spectral.cepstrum(frames(spark, d)).withColumn("coefficient", r("coefficient", 4) + F.lit(0.0))


@query("", """WITH v AS (SELECT vec_id AS seg_id, i, (embedding[i] < -1e-10) <> (embedding[i - 1] < -1e-10) AS flip FROM (SELECT *, unnest(range(2, 65)) AS i FROM embeddings)),
    f AS (SELECT vec_id AS seg_id, unnest(range(0, 9)) AS frame FROM embeddings)
    SELECT f.seg_id, CAST(f.frame AS INTEGER) AS frame, round(count(*) FILTER (WHERE v.flip AND v.i - 1 BETWEEN f.frame * 8 - 15 AND f.frame * 8 + 15) / 32.0, 6) AS zcr FROM f JOIN v ON f.seg_id = v.seg_id GROUP BY f.seg_id, f.frame""")  # fmt: skip
def frame_crossings(spark, d) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("seg_id"), F.col("embedding").alias("samples"))
    return spectral.frame_zcr(rows, width=32, hop=8).withColumn("zcr", r("zcr"))


@query("fr", "SELECT seg_id, round(avg(mag), 6) AS mag_mean, round(stddev_pop(mag), 6) AS mag_std, round(quantile_cont(mag, 0.5), 6) AS mag_median, round(quantile_cont(mag, 0.75) - quantile_cont(mag, 0.25), 6) AS mag_iqr FROM fr GROUP BY seg_id")
def series_summary(spark, d) -> DataFrame:
    out = spectral.series_summary(frames(spark, d), "mag", ["seg_id"], "mag")
    return out.select("seg_id", *[r(c).alias(c) for c in out.columns[1:]])


@query("fr", ", x AS (SELECT *, min(mag) OVER w AS lo, max(mag) OVER w AS hi FROM fr WHERE freq_hz BETWEEN 500 AND 30000 WINDOW w AS (PARTITION BY seg_id)) SELECT seg_id, frame, bin, round((mag - lo) / (hi - lo), 6) AS norm FROM x WHERE hi > lo")
def band_normalised(spark, d) -> DataFrame:
    return spectral.band_normalised(frames(spark, d)).select("seg_id", "frame", "bin", r("norm").alias("norm"))


def _track(spark, d):
    return samples(spark, d).select(F.col("file").alias("seg_id"), F.col("idx").alias("frame"), F.when(F.col("value") < 60, F.col("value")).alias("y"))


@query("sa", ", t AS (SELECT file AS seg_id, idx AS frame, CASE WHEN value < 60 THEN value END AS y FROM sa) SELECT seg_id, frame, round(quantile_cont(y, 0.5) OVER (PARTITION BY seg_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM t")
def running_median(spark, d) -> DataFrame:
    return spectral.running_median(_track(spark, d), "y", 5, "smooth").select("seg_id", "frame", r("smooth").alias("smooth"))


@query("sa", """, t AS (SELECT file AS seg_id, idx AS frame, CASE WHEN value < 60 THEN value END AS y FROM sa),
    x AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS ta, last_value(y IGNORE NULLS) OVER b AS va, first_value(CASE WHEN y IS NOT NULL THEN frame END IGNORE NULLS) OVER f AS tb, first_value(y IGNORE NULLS) OVER f AS vb, count(y) OVER (PARTITION BY seg_id) AS n FROM t
          WINDOW b AS (PARTITION BY seg_id ORDER BY frame ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY seg_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT seg_id, frame, round(CASE WHEN y IS NOT NULL OR n < 2 THEN y WHEN ta IS NULL THEN vb WHEN tb IS NULL THEN va ELSE va + (vb - va) * (frame - ta) / (tb - ta) END, 6) AS y FROM x""")  # fmt: skip
def interpolate_gaps(spark, d) -> DataFrame:
    return spectral.interpolated(_track(spark, d), "y").withColumn("y", r("y"))


@query("sa", ", t AS (SELECT file AS seg_id, idx AS frame, CASE WHEN value < 60 THEN value END AS y FROM sa) SELECT seg_id, round(quantile_cont(y, 0.5), 6) AS median, min(y) AS min, max(y) AS max, round(max(y) - min(y), 6) AS range, round(CASE WHEN count(y) >= 2 THEN regr_slope(y, frame) END, 6) + 0.0 AS slope FROM t GROUP BY seg_id")
def track_summary(spark, d) -> DataFrame:
    out = spectral.track_summary(_track(spark, d), "y", "frame")
    return out.withColumns({"median": r("median"), "range": r("range"), "slope": r("slope") + F.lit(0.0)})


@query("sa", ", t AS (SELECT file AS seg_id, idx AS frame, CASE WHEN value > 250 THEN value END AS y FROM sa) SELECT seg_id, frame, CASE WHEN avg(CASE WHEN y IS NULL THEN 0.0 ELSE 1.0 END) OVER (PARTITION BY seg_id) >= 0.02 THEN y END AS y FROM t")
def valid_tracks(spark, d) -> DataFrame:
    rows = samples(spark, d).select(F.col("file").alias("seg_id"), F.col("idx").alias("frame"), F.when(F.col("value") > 250, F.col("value")).alias("y"))
    return spectral.valid_tracks(rows, "y", 0.02)


_PIXELS = ", px AS (SELECT seg_id, bin // 8 AS component, frame // 50 AS frame, freq_hz, mag AS amp, ln(mag + 1e-12) AS log_amp FROM fr WHERE mag > 0.1), s1 AS (SELECT seg_id, component, avg(amp) + 0.22 * (max(frame) - min(frame) + 1) + 0.003 * (max(freq_hz) - min(freq_hz)) - 0.02 * min(freq_hz) / 1000 - CASE WHEN max(freq_hz) - min(freq_hz) < 300 THEN 6.0 ELSE 0.0 END AS score, max(frame) - min(frame) + 1 AS t FROM px GROUP BY ALL), be AS (SELECT seg_id, component, score FROM s1 WHERE t >= 4 QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY score DESC, component) = 1)"


def _pixels(spark, d):
    return frames(spark, d).filter("mag > 0.1").select("seg_id", F.floor(F.col("bin") / 8).alias("component"), F.floor(F.col("frame") / 50).alias("frame"), "freq_hz", F.col("mag").alias("amp"), F.log(F.col("mag") + 1e-12).alias("log_amp"))


@query("fr", _PIXELS + " SELECT seg_id, component, round(score, 6) AS score FROM be")
def best_candidate(spark, d) -> DataFrame:
    return spectral.best_candidate(_pixels(spark, d)).withColumn("score", r("score"))


@query("fr", _PIXELS + ", w AS (SELECT px.*, exp(log_amp - max(log_amp) OVER (PARTITION BY seg_id, frame)) AS w FROM px JOIN be USING (seg_id, component)) SELECT seg_id, frame, round(sum(w * freq_hz) / sum(w), 4) AS centre_hz FROM w GROUP BY seg_id, frame")
def centre_track(spark, d) -> DataFrame:
    rows = _pixels(spark, d)
    return spectral.centre_track(rows, spectral.best_candidate(rows)).withColumn("centre_hz", r("centre_hz", 4))


@query("", "SELECT vec_id, round(avg(CASE WHEN i > 1 AND (embedding[i] < 0) <> (embedding[i - 1] < 0) THEN 1.0 ELSE 0.0 END), 6) AS zcr FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY vec_id")
def zero_crossings(spark, d) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("idx", "value"))
    return spectral.zero_crossings(rows, ["vec_id"]).withColumn("zcr", r("zcr"))


def _segments(spark, d):
    e = table(spark, d, "embeddings")
    return e.groupBy(F.col("label").alias("seg_id"), F.floor(F.col("vec_id") / 100).alias("part")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"])).alias("samples")).select(F.concat_ws("-", F.col("seg_id").cast("string"), F.col("part").cast("string")).alias("seg_id"), F.lit(125_000).alias("rate"), "samples")


@query()
def spectrogram(spark, d) -> DataFrame:
    return spectral.spectrogram(_segments(spark, d))


@query()
def spectral_features(spark, d) -> DataFrame:
    seg = _segments(spark, d)
    return spectral.features(spectral.spectrogram(seg), seg.select("seg_id", (F.size("samples") / F.col("rate")).alias("duration_sec")), seg.select("seg_id", "samples"))


_SUMS = ", t AS (SELECT file AS seg_id, idx AS frame, CASE WHEN value < 60 THEN value END AS y FROM sa), u AS (SELECT seg_id, 'l' || (seg_id % 5) AS label, 'a' || seg_id AS audio, quantile_cont(y, 0.5) / 1000 AS median_khz, (max(y) - min(y)) / 1000 AS range_khz, count(*) * 0.5 AS n, CASE WHEN count(y) > 1 THEN ln(count(y)) END AS h FROM t GROUP BY seg_id)"


def _call_meta(spark, d):
    t = _track(spark, d).groupBy("seg_id").agg(F.count("*").alias("n"), F.count("y").alias("k"))
    text = F.col("seg_id").cast("string")
    return t.select("seg_id", F.concat(F.lit("l"), (F.col("seg_id") % 5).cast("string")).alias("label"), F.concat(F.lit("a"), text).alias("audio"), (F.col("n") * 0.5).alias("duration_sec"), F.when(F.col("k") > 1, F.log("k")).alias("entropy_mean"))


@query("sa", _SUMS + " SELECT label, audio, round(median_khz, 9) AS median_khz, round(range_khz, 9) AS range_khz, CAST(n * 1000 AS DOUBLE) AS duration_ms FROM u WHERE median_khz IS NOT NULL AND range_khz IS NOT NULL")
def call_summaries(spark, d) -> DataFrame:
    out = spectral.call_summaries(spectral.track_summary(_track(spark, d), "y", "frame"), _call_meta(spark, d))
    return out.withColumns({c: r(c, 9) for c in ("median_khz", "range_khz")})


@query("sa", _SUMS + " SELECT label, audio, round(median_khz, 9) AS median_khz, round(range_khz, 9) AS range_khz, round(h, 9) AS entropy FROM u WHERE median_khz IS NOT NULL AND range_khz IS NOT NULL AND h IS NOT NULL")
def call_entropies(spark, d) -> DataFrame:
    out = spectral.call_summaries(spectral.track_summary(_track(spark, d), "y", "frame"), _call_meta(spark, d), ("entropy_mean", 1.0, "entropy"))
    return out.withColumns({c: r(c, 9) for c in ("median_khz", "range_khz", "entropy")})


@query("c v", "SELECT 'all' AS pool, round(sum(gap_us) / 1e6, 3) AS seconds, count(*) AS n FROM (SELECT *, lead(start_us) OVER (PARTITION BY variant, exp, channel ORDER BY start_us, stop_us, event_type, call_id) - stop_us AS gap_us FROM v) WHERE gap_us >= 0")
def pooled_gaps(spark, d) -> DataFrame:
    rows = sequence.pooled(sequence.gaps(_variants(spark, d), ("variant", *sequence.SEQUENCE)))
    return rows.agg(F.lit("all").alias("pool"), F.round(F.sum("gap_us") / 1e6, 3).alias("seconds"), F.count("*").alias("n"))


@query("", "SELECT conv_id, turn, role FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL")
def complete_rows(spark, d) -> DataFrame:
    return sequence.complete(table(spark, d, "conversations"), ["role", "text"]).select("conv_id", "turn", "role")


@query("", "SELECT o_orderkey, CASE WHEN o_totalprice <= 1000 THEN 'too cheap' WHEN o_orderstatus = 'P' THEN 'not final' END AS reason FROM orders")
def failure_report(spark, d) -> DataFrame:
    good, bad = audit.failures(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ("too cheap", F.col("o_totalprice") > 1000), ("not final", F.col("o_orderstatus") != "P"))
    return tables.union_by_name([good.select("o_orderkey"), bad.select("o_orderkey", "reason")])


@query("", "SELECT c_custkey AS exp, CASE WHEN n = 1 THEN lo END AS run_id, CASE WHEN n = 0 THEN 'not found' WHEN n > 1 THEN 'several: ' || names END AS reason FROM (SELECT c_custkey, count(DISTINCT o_orderstatus) AS n, min(o_orderstatus) AS lo, string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS names FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def result_folders(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("exp"), F.col("o_orderstatus").alias("run_id"))
    return audit.single_run(table(spark, d, "customer").select(F.col("c_custkey").alias("exp")).join(o, "exp", "left"))


@query("", "SELECT c_custkey AS exp, CASE WHEN ok THEN 'F' END AS run_id, CASE WHEN NOT ok THEN 'configured folder not found' END AS reason FROM (SELECT c_custkey, coalesce(bool_or(o_orderstatus = 'F'), false) AS ok FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def configured_folders(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("exp"), F.col("o_orderstatus").alias("run_id"))
    return audit.single_run(table(spark, d, "customer").select(F.col("c_custkey").alias("exp")).join(o, "exp", "left"), "F")


def _csv_folder(spark, rows: DataFrame, name: str) -> str:
    """rows as headered CSV files under the shared folder, named by Spark."""
    path = shared_path(spark, name)
    tables.write_csv(rows, path)
    return path


@query("", "SELECT l_orderkey, l_linenumber, l_shipdate::DATE::VARCHAR AS day, l_quantity, CAST(NULL AS VARCHAR) AS missing, 'line ' || l_linenumber || chr(10) || '\"of\", ' || l_orderkey AS \"two, words\" FROM lineitem")
def csv_by_name(spark, d) -> DataFrame:
    """lineitem written as CSV with its columns in another order, with line ends and quotes in values and a comma in a header, and read by name."""
    x = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_quantity", F.lit("a, b").alias("unread"), F.concat(F.lit("line "), "l_linenumber", F.lit('\n"of", '), "l_orderkey").alias("two, words"), "l_linenumber", "l_orderkey")
    return tables.csv_table(spark, _csv_folder(spark, x, "csv"), "l_orderkey long, l_linenumber int, day string, l_quantity double, missing string, `two, words` string")


@query("c", "SELECT event_type || chr(10) || '\"new\", line' AS event_type, count(*) AS n, sum(call_id)::BIGINT AS ids, round(sum(CASE WHEN call_id % 2 = 0 THEN value END), 4) AS meanprob_a FROM c GROUP BY ALL")
def gathered_files(spark, d) -> DataFrame:
    """Calls written as two sets of feature files of different columns, labels of two lines, and gathered as one table."""
    rows, path = calls(spark, d).withColumn("event_type", F.concat("event_type", F.lit('\n"new", line'))), shared_path(spark, "features")
    tables.write_csv(rows.filter("call_id % 2 = 0").select("call_id", "event_type", F.col("value").alias("meanprob_a")), f"{path}/even")
    tables.write_csv(rows.filter("call_id % 2 = 1").select("event_type", "call_id"), f"{path}/odd")
    found = tables.gathered(spark, path, "call_id long, event_type string", others=(("meanprob_", "double"),))
    return found.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("call_id").alias("ids"), F.round(F.sum("meanprob_a"), 4).alias("meanprob_a"))


@query("c", "SELECT event_type, count(*) FILTER (WHERE value > 10 AND event_type IN ('click', 'view')) AS n_target, count(*) FILTER (WHERE stop_us > start_us AND value > 0) AS n_real FROM c GROUP BY event_type")
def annotation_filters(spark, d) -> DataFrame:
    rows = calls(spark, d).select(F.col("event_type").alias("name"), "channel", F.lit(1.0).alias("start_seconds"), (1 + F.col("value")).alias("stop_seconds"), F.when(F.col("value") > 10, F.col("value")).otherwise(0.0).alias("v"))
    target = tables.target_annotations(rows.select("name", F.col("v").alias("start_seconds"), F.col("v").alias("stop_seconds")), ["click", "view"]).groupBy("name").agg(F.count("*").alias("n_target"))
    real = tables.real_events(rows).groupBy("name").agg(F.count("*").alias("n_real"))
    none = F.lit(0).cast("long")
    return rows.select("name").distinct().join(target, "name", "left").join(real, "name", "left").select(F.col("name").alias("event_type"), F.coalesce("n_target", none).alias("n_target"), F.coalesce("n_real", none).alias("n_real"))


@query("c", "SELECT call_id, -1 AS channel FROM c WHERE event_type = 'error'")
def clean_annotations(spark, d) -> DataFrame:
    return tables.clean_annotations(calls(spark, d).withColumnRenamed("event_type", "name"), "error").select("call_id", "channel")


@query("", "SELECT 'm' || (c_custkey % 4) AS month, count(DISTINCT c_custkey) AS n_exp, count(DISTINCT CASE WHEN c_custkey < 10 THEN c_custkey END) AS n_with_times, count(o_orderkey) AS n_rows, count(DISTINCT o_orderpriority) AS n_log_files FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def month_log_roll_up(spark, d) -> DataFrame:
    s, c = sync(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("exp"))
    lines = table(spark, d, "orders").select(F.col("o_custkey").alias("exp"), F.col("o_orderpriority").alias("source_log_file"))
    return audit.month_roll_up(audit.experiment_times(c, s, s), c.select("exp", F.concat(F.lit("m"), (F.col("exp") % 4).cast("string")).alias("month")), lines)


@query("c", "SELECT event_type, call_id, value FROM c QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, call_id) <= 3")
def top_examples(spark, d) -> DataFrame:
    return audit.examples(calls(spark, d), 3, order=(F.desc("value"), "call_id")).select("event_type", "call_id", "value")


@query("c", "SELECT event_type, count(*) AS n, count(DISTINCT channel) AS n_channels, count(*) FILTER (WHERE channel = 30) AS n_unmapped FROM c GROUP BY event_type")
def label_inventory(spark, d) -> DataFrame:
    return audit.inventory(calls(spark, d), {10: "arena_1", 20: "arena_2"})


@query("c", "SELECT DISTINCT event_type FROM c")
def distinct_labels(spark, d) -> DataFrame:
    return audit.distinct_labels(calls(spark, d))


@query("c", "SELECT DISTINCT exp FROM (SELECT exp FROM c UNION SELECT o_custkey AS exp FROM orders)")
def all_experiments(spark, d) -> DataFrame:
    return audit.all_ids(calls(spark, d), table(spark, d, "orders").select(F.col("o_custkey").alias("exp")))


@query("c", "SELECT call_id, round_even(value / 7, 3) AS value FROM c")
def half_even(spark, d) -> DataFrame:
    return calls(spark, d).select("call_id", clock.rounded(F.col("value") / 7).alias("value"))


@query("", """SELECT l_orderkey AS file_num, l_returnflag AS event_type, CAST(l_linenumber AS DOUBLE) AS start_time_file_sec, l_linenumber + l_quantity AS stop_time_file_sec, round(l_quantity, 6) AS duration_sec,
    CASE l_linestatus WHEN 'F' THEN 'arena_1' ELSE 'underground' END AS assigned_location, CAST(CASE l_linestatus WHEN 'F' THEN 10 ELSE 30 END AS BIGINT) AS assigned_channel, l_discount AS meanprob_a FROM lineitem""")  # fmt: skip
def call_table(spark, d) -> DataFrame:
    x = table(spark, d, "lineitem")
    rows = x.select(F.col("l_orderkey").cast("string").alias("file_number"), F.col("l_returnflag").alias("label"), F.col("l_linenumber").cast("double").alias("onset_s"), (F.col("l_linenumber") + F.col("l_quantity")).alias("offset_s"), F.when(F.col("l_linestatus") == "F", "arena_1").otherwise("underground").alias("assigned_location"), F.col("l_discount").alias("meanprob_a"))
    return overlap.call_table(rows, {10: "arena_1", 20: "arena_2", 30: "underground"}).withColumn("duration_sec", r("duration_sec"))


@query("", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey % 100 ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem")
def sorted_calls(spark, d) -> DataFrame:
    x = table(spark, d, "lineitem")
    rows = x.withColumns({"file_number": F.concat(F.lit("file_"), (F.col("l_orderkey") % 100).cast("string")), "onset_s": F.col("l_quantity")})
    source = ("l_orderkey", "l_linenumber", "l_partkey")
    number = clock.trailing_digits(F.col("file_number"))
    placed = rows.withColumn("file_number", number.cast("string")).withColumn("place", F.row_number().over(Window.partitionBy("file_number").orderBy("onset_s", *source)).cast("long"))
    return overlap.sort_calls(placed, source_order=source).select(*source, "place")


@query("c", "SELECT call_id, printf('%02d:%02d:%02d.%03d', (value * 100000)::BIGINT // 3600000, ((value * 100000)::BIGINT // 60000) % 60, ((value * 100000)::BIGINT // 1000) % 60, (value * 100000)::BIGINT % 1000) AS duration FROM c")
def duration_text(spark, d) -> DataFrame:
    return calls(spark, d).select("call_id", clock.duration_text(F.round(F.col("value") * 100000).cast("long") / 1000).alias("duration"))


@query("", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN epoch_us(o_orderdate) END AS start_us, epoch_us(o_orderdate) + 600000000 AS end_us, CAST(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 1000 END AS BIGINT) AS file_num FROM orders")
def sync_literals(spark, d) -> DataFrame:
    """Chunk clocks of sync rows: list and tuple literals of times and videos, of which some don't parse."""
    at = clock.micros(F.col("o_orderdate"))
    text = lambda us: F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss")
    times = F.concat(F.lit("['"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("unknown")).otherwise(text(at)), F.lit("', '"), text(at + 600_000_000), F.lit("']"))
    videos = F.concat(F.lit("('first', 'top_"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("none")).otherwise((F.col("o_orderkey") % 1000).cast("string")), F.lit("', 'top_x')"))
    return table(spark, d, "orders").select("o_orderkey", *tables.sync_columns(times, videos))


def _paths(spark, d):
    """Paths of files of either naming scheme, and of others, under folders named by experiment or otherwise."""
    number = F.col("o_orderkey").cast("string")
    folder = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("x"), F.col("o_custkey").cast("string"))).otherwise((F.col("o_custkey") % 100).cast("string"))
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("channel_02_file_"), number, F.lit(".wav"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("channel_2_"), number, F.lit(".wav"))).otherwise(F.concat(F.lit("notes_"), number, F.lit(".txt")))
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("file:///data/"), folder, F.lit("/raw/"), name).alias("path"))


@query("", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey % 100 AS INTEGER) END AS exp, CASE WHEN o_orderkey % 3 < 2 THEN 2 END AS channel, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderkey AS INTEGER) END AS file_num, CASE o_orderkey % 3 WHEN 0 THEN 'modern' WHEN 1 THEN 'legacy' END AS scheme FROM orders")
def file_listing(spark, d) -> DataFrame:
    return _paths(spark, d).select("o_orderkey", *tables.manifest_columns(F.col("path"))).drop("name")


@query("", "SELECT DISTINCT CAST(o_custkey % 100 AS INTEGER) AS exp FROM orders WHERE o_orderkey % 4 <> 0")
def experiment_ids(spark, d) -> DataFrame:
    return tables.experiments(_paths(spark, d).select(*tables.manifest_columns(F.col("path"))))


@query("", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS INTEGER) END AS exp, CASE WHEN o_orderkey % 3 = 0 THEN epoch_us(o_orderdate) END AS experiment_start_us FROM orders")
def log_names(spark, d) -> DataFrame:
    """Experiment and start time from names of log files."""
    name = F.concat(F.when(F.col("o_orderkey") % 3 == 0, F.lit("experiment_")).otherwise(F.lit("run_")), F.col("o_custkey").cast("string"), F.lit("_log_"), F.date_format("o_orderdate", "yyyy-MM-dd_HH-mm-ss"), F.lit(".txt"))
    return table(spark, d, "orders").select("o_orderkey", *tables.log_name_columns(name))


@query("", "SELECT 'c_' || c_custkey || '_annotations.csv' AS name, '/audio/c_' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '.wav' ELSE '.npz' END AS audio_path FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def audio_match(spark, d) -> DataFrame:
    """Annotation files with the audio of their stem, .wav before .npz."""
    stem = F.concat(F.lit("c_"), F.col("c_custkey").cast("string"))
    c = table(spark, d, "customer").select("c_custkey", stem.alias("s"))
    audio = c.filter("c_custkey % 2 = 0").select(F.concat("s", F.lit(".wav")).alias("name")).unionByName(c.filter("c_custkey % 3 = 0").select(F.concat("s", F.lit(".npz")).alias("name")))
    audio = audio.unionByName(c.select(F.concat("s", F.lit(".mp3")).alias("name"))).withColumn("path", F.concat(F.lit("/audio/"), "name"))
    return tables.match_audio(c.select(F.concat("s", F.lit("_annotations.csv")).alias("name")), audio).select("name", "audio_path")


@query("c", """SELECT call_id, event_type AS label, value AS onset_s, CAST(channel AS VARCHAR) AS channel, lpad(CAST(exp AS VARCHAR), 3, '0') AS file_number,
    CASE WHEN exp % 2 = 0 THEN value END AS meanprob_a, CASE WHEN exp % 2 = 1 THEN event_type || ', "new"' END AS note FROM c""")  # fmt: skip
def detection_files(spark, d) -> DataFrame:
    """Calls as detection files named by channel and file, of two sets of columns, and read back as one table."""
    path, name = shared_path(spark, "detections"), F.concat(F.lit("channel_"), "channel", F.lit("_file_"), F.lpad(F.col("exp").cast("string"), 3, "0"), F.lit("_accepted_calls"))
    rows = calls(spark, d).select("call_id", "exp", F.col("event_type").alias("label"), F.col("value").alias("onset_s"), name.alias("name"))
    tables.write_named(rows.filter("exp % 2 = 0").withColumn("meanprob_a", F.col("onset_s")).drop("exp"), path, "name")
    tables.write_named(rows.filter("exp % 2 = 1").select(F.concat("label", F.lit(', "new"')).alias("note"), "label", "onset_s", "call_id", "name"), path, "name")
    return tables.detections(spark, path, "call_id long, label string, onset_s double")


@query("c", "SELECT event_type AS name, channel, exp AS file_num, value AS start_seconds, value + 1 AS stop_seconds, 'exp_' || exp || '_channel_' || channel || '_file_' || lpad(CAST(exp AS VARCHAR), 3, '0') || '_annotations.csv' AS source_file FROM c WHERE exp NOT IN (3, 4)")
def annotation_files(spark, d) -> DataFrame:
    """Calls as annotation files; those of one experiment have names of another kind and those of one lack a column, so both are skipped."""
    path = shared_path(spark, "annotations")
    number = F.lpad(F.col("exp").cast("string"), 3, "0")
    file = F.when(F.col("exp") == 3, F.concat(F.lit("exp_3_channel_"), "channel", F.lit("_annotations"))).otherwise(F.concat(F.lit("exp_"), "exp", F.lit("_channel_"), "channel", F.lit("_file_"), number, F.lit("_annotations")))
    rows = calls(spark, d).select("exp", F.col("event_type").alias("name"), F.col("value").alias("start_seconds"), (F.col("value") + 1).alias("stop_seconds"), file.alias("file"))
    tables.write_named(rows.filter("exp <> 4").drop("exp"), path, "file")
    tables.write_named(rows.filter("exp = 4").drop("exp", "stop_seconds"), path, "file")
    return tables.annotations(spark, path)


@query("", "SELECT CAST(o_orderkey % 10 AS INTEGER) AS exp, row_number() OVER (PARTITION BY o_orderkey % 10 ORDER BY o_orderkey) AS row_pos, epoch_us(o_orderdate) AS start_us, epoch_us(o_orderdate) + 600000000 AS end_us, o_orderkey AS file_num FROM orders")
def sync_files(spark, d) -> DataFrame:
    """Chunk clocks as sync files, one an experiment's folder, and read back."""
    path, at = shared_path(spark, "sync"), clock.micros(F.col("o_orderdate"))
    text = lambda us: F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss")
    times = F.concat(F.lit("['"), text(at), F.lit("', '"), text(at + 600_000_000), F.lit("']"))
    videos = F.concat(F.lit("['first', 'top_"), F.col("o_orderkey").cast("string"), F.lit("']"))
    rows = table(spark, d, "orders").select("o_orderkey", times.alias("timestamp"), videos.alias("video"), F.concat((F.col("o_orderkey") % 10).cast("string"), F.lit("/sync")).alias("name"))
    tables.write_named(rows.select("timestamp", "video", "o_orderkey", "name"), path, "name", order=["o_orderkey"])
    return tables.sync(spark, path)


@query("", "SELECT CAST(label AS INTEGER) AS exp, 1 AS channel, CAST(label AS INTEGER) AS file_num, 125000 AS rate, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS block, len(embedding) AS n_samples, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings")
def wav_files(spark, d) -> DataFrame:
    """embeddings as WAV files, one a label, of a block a vector, written by a task a file and read by ranges of bytes."""
    path = shared_path(spark, "wav")
    e = table(spark, d, "embeddings")
    audio.write_wav(e.select(F.col("label").alias("exp"), F.lit(1).alias("channel"), F.col("label").alias("file_num"), F.lit(125_000).alias("rate"), F.col("vec_id").alias("block"), F.col("embedding").alias("samples")), path)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return audio.audio_chunks(spark, path, block=64, split=1 << 20).select("exp", "channel", "file_num", "rate", "block", "n_samples", r(total, 5).alias("total"))


@query("c v", "SELECT variant, exp, count(*) AS n, sum(call_id)::BIGINT AS ids FROM v GROUP BY ALL")
def partitioned_inputs(spark, d) -> DataFrame:
    """Calls by variant and experiment in folders of their own; what an earlier run left there goes."""
    path, rows = shared_path(spark, "inputs"), _variants(spark, d).select("variant", "exp", "call_id")
    tables.write_partitioned(rows.filter("exp = 1").withColumn("variant", F.lit("old")), path)
    tables.write_partitioned(rows, path)
    return spark.read.schema("call_id long, variant string, exp long").parquet(path).groupBy("variant", "exp").agg(F.count("*").alias("n"), F.sum("call_id").alias("ids"))


@query("c", "SELECT call_id, channel FROM c")
def assigned_channels(spark, d) -> DataFrame:
    """Channels of calls that have assigned ones only, and of calls that have both."""
    rows = calls(spark, d).select("call_id", "channel")
    assigned = clocks.with_channel(rows.filter("call_id % 2 = 0").withColumnRenamed("channel", "assigned_channel"))
    return assigned.unionByName(clocks.with_channel(rows.filter("call_id % 2 = 1").withColumn("assigned_channel", F.lit(-1))).drop("assigned_channel"))


@query("c", "SELECT call_id, value FROM c WHERE call_id % 7 <> 0 AND call_id % 11 <> 0 AND call_id % 13 <> 0 AND call_id % 17 <> 0")
def finite_rows(spark, d) -> DataFrame:
    """Calls whose value is a finite number, of some that are infinite, no number or null."""
    odd = F.when(F.col("call_id") % 7 == 0, F.lit(float("inf"))).when(F.col("call_id") % 11 == 0, F.lit(float("nan"))).when(F.col("call_id") % 13 == 0, F.lit(float("-inf"))).when(F.col("call_id") % 17 == 0, F.lit(None).cast("double"))
    rows = calls(spark, d).select("call_id", odd.alias("odd"), "value")
    return spectral.finite(rows.select("call_id", F.when((F.col("call_id") % 7 == 0) | (F.col("call_id") % 11 == 0) | (F.col("call_id") % 13 == 0) | (F.col("call_id") % 17 == 0), F.col("odd")).otherwise(F.col("value")).alias("value")), ["call_id", "value"])


@query("", "SELECT column_name, count(v) AS n, round(sum(v), 2) AS total FROM (SELECT unnest(['l_discount', 'l_extendedprice', 'l_linenumber', 'l_partkey', 'l_quantity', 'l_suppkey', 'l_tax']) AS column_name, unnest([l_discount, l_extendedprice, l_linenumber, l_partkey, l_quantity, l_suppkey, l_tax]::DOUBLE[]) AS v FROM lineitem) GROUP BY ALL")
def numeric_totals(spark, d) -> DataFrame:
    """Sums of the numeric columns that are found in a table, but for its key."""
    x = table(spark, d, "lineitem")
    found = tables.numeric_columns(x, without=("l_orderkey",))
    sums = x.agg(*[F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n"), F.round(F.sum(F.col(c).cast("double")), 2).alias("total")).alias(c) for c in found])
    return sums.select(F.inline(F.array(*found)))
