"""Event-sequence operators on hand-made rows: boundaries, ties, missing values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from eventloom.functions import clock, labels, levels
from eventloom.operators import audit, clocks, daynight, distribution, overlap, rates, sequence, sessions, signal, spectral
from eventloom.sources import tables

CALL = "call_id long, exp int, channel int, event_type string, start_us long, stop_us long"
S = 1_000_000


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("gap", "band"), [(-0.01, None), (0, "right"), (0.05, "right"), (0.0501, "mid"), (2, "mid"), (2.001, "left"), (300, "left"), (300.001, None)])
def test_bands(spark, gap, band):
    assert one(spark, sequence.band_of(F.lit(round(gap * 1e6)).cast("long"))) == band


def test_filters_go_before_adjacency(spark):
    calls = spark.createDataFrame([(1, 1, 10, "A", 0, S), (2, 1, 10, "noise", 2 * S, 3 * S), (3, 1, 10, "B", 4 * S, 5 * S), (4, 1, 20, "C", 6 * S, 7 * S), (5, 2, 10, "D", 8 * S, None), (6, 2, 10, "E", 9 * S, 9 * S)], CALL)
    got = sequence.pairs(sequence.drop_noise(calls))
    assert rows(got, "from_type", "to_type", "gap_us") == [("A", "B", 3 * S)]
    counts = sequence.type_counts(calls.withColumn("variant", F.lit("all")), order=["D", "Z"], places={10: "arena"})
    assert rows(counts, "event_type", "n") == [("D", 1), ("Z", 0)]


def test_matrices(spark):
    calls = spark.createDataFrame([(i, 1, 10, t, i * S, i * S) for i, t in enumerate("ABAB")], CALL).withColumn("variant", F.lit("all"))
    counts = sequence.transition_counts(calls, order=["A", "B"], places={10: "arena", 30: "underground"}, bands=(("x", None, 10.0),))
    p = {(r["location"], r["from_type"], r["to_type"]): (r["n"], r["p"], r["joint"]) for r in sequence.joint_probabilities(sequence.row_probabilities(counts)).collect()}
    assert p["arena", "A", "B"] == (2, 1.0, 2 / 3) and p["arena", "B", "A"] == (1, 1.0, 1 / 3) and p["underground", "A", "A"] == (0, 0.0, 0.0)
    diff = sequence.location_difference(counts, "arena", "underground").filter("n_diff <> 0")
    assert rows(diff, "from_type", "to_type", "n_diff", "limit") == [("A", "B", 2, 2), ("B", "A", 1, 2)]


def test_labels(spark):
    df = spark.createDataFrame([(" Tild ",), ("half_mnt",), ("DFM_stack_dense_stack",), ("Other",), (None,)], "x string")
    assert [r[0] for r in df.select(labels.canonical(F.col("x"), null_as="nan")).collect()] == ["tilda", "half-mnt", "dfm-stack", "other", "nan"]
    assert labels.effective_order(["a", "b", "c"], {"a": "g", "c": "g"}) == ["g", "b"]
    assert one(spark, labels.channel_of(F.lit("arena_2"), {10: "arena_1", 20: "arena_2"})) == 20 and one(spark, labels.location(F.lit(5), {10: "a"})) is None


@pytest.mark.parametrize(("light", "hours"), [((8, 20), [False, True, True, False]), ((20, 8), [True, False, False, True]), ((8, 8), [False] * 4), ((8, 24 + 20), [False, True, True, False])])
def test_daytime(spark, light, hours):
    times = [7 * 3600 + 59 * 60, 8 * 3600, 19 * 3600 + 59 * 60, 20 * 3600]
    df = spark.createDataFrame([(t * S,) for t in times], "t long")
    assert [r[0] for r in df.select(clock.is_daytime(clock.hour_of(F.col("t")), *light)).collect()] == hours


def test_day_window_hours(spark):
    h = 3600 * S
    spans = spark.createDataFrame([(1, 22 * h, 33 * h), (2, 5 * h, 5 * h), (3, 9 * h, 4 * h), (4, None, None)], "exp int, span_start long, span_end long")
    got = {(r["exp"], r["variant"]): r["hours"] for r in daynight.hours_in_window(spans, (20, 8)).collect()}
    assert (got[1, "all"], got[1, "day"], got[1, "night"]) == (11, 10, 1)
    assert all(got[e, v] == 0 for e in (2, 3, 4) for v in ("all", "day", "night"))
    assert {r["hours"] for r in daynight.hours_in_window(spans, (8, 8)).filter("variant = 'day'").collect()} == {0}


def test_variants(spark):
    calls = spark.createDataFrame([(1, 9 * 3600 * S), (2, 0), (3, None)], "call_id int, start_us long")
    assert rows(daynight.with_variants(calls, (8, 20)), "call_id", "variant") == [(1, "all"), (1, "day"), (2, "all"), (2, "night"), (3, "all")]
    with pytest.raises(ValueError, match="unknown"):
        daynight.with_variants(calls, (8, 20), ["dusk"])


def test_bouts(spark):
    starts = {1: [round(9.999 * i * S) for i in range(5)], 2: [10 * i * S for i in range(5)], 3: [i * S for i in range(4)], 4: [0, S, 2 * S, 3 * S, 4 * S, 100 * S, 200 * S, 201 * S, 202 * S, 203 * S, 204 * S]}
    calls = spark.createDataFrame([(100 * e + i, e, 10, "alarm", t, t + S) for e, ts in starts.items() for i, t in enumerate(ts)], CALL)
    got = sessions.bouts(calls)
    assert {(r["exp"], r["bout_id"]) for r in got.collect()} == {(1, 1), (2, None), (3, None), (4, 1), (4, None), (4, 2)}
    assert rows(got.filter("exp = 4 and bout_id = 2"), "position_in_bout") == [(i,) for i in range(1, 6)]
    assert {(r["exp"], r["bout_id"], r["global_bout_id"]) for r in sessions.global_bout_ids(got).filter("bout_id is not null").collect()} == {(1, 1, 1), (4, 1, 2), (4, 2, 3)}
    assert rows(sessions.bout_summary(got), "exp", "bout_id", "n_calls", "duration_sec") == [(1, 1, 5, 40.996), (4, 1, 5, 5.0), (4, 2, 5, 5.0)]
    gapped = spark.createDataFrame([(1, 1), (1, 3), (2, 1)], "exp int, bout_id long")
    assert rows(sessions.global_bout_ids(gapped), "exp", "bout_id", "global_bout_id") == [(1, 1, 1), (1, 3, 2), (2, 1, 3)]
    single = spark.createDataFrame([(1, 1, 10, "a", 0, S, 1)], CALL + ", bout_id long")
    assert sessions.bout_summary(single).collect() == []


def test_bouts_model(spark):
    rng = random.Random(9)
    ts = sorted(rng.randint(0, 4000) * S // 4 for _ in range(400))
    calls = spark.createDataFrame([(i, 1, 10, "a", t, t) for i, t in enumerate(ts)], CALL)
    want, chain, n = {}, [], 0
    for i in range(len(ts) + 1):
        if i < len(ts) and chain and ts[i] - ts[chain[-1]] < 3 * S:
            chain.append(i)
            continue
        if len(chain) >= 4:
            n += 1
        want.update(dict.fromkeys(chain, n if len(chain) >= 4 else None))
        chain = [i]
    assert {r["call_id"]: r["bout_id"] for r in sessions.bouts(calls, gap_us=3 * S, min_events=4).collect()} == want


def test_greedy_overlap(spark):
    df = spark.createDataFrame([(i, 1, 1, round(t * S)) for i, t in enumerate([0, 0.010, 0.015, 0.020, 0.030, 0.040])], "call_id long, exp int, file_num int, onset_us long")
    assert [r["group_no"] for r in overlap.overlap_groups(df).orderBy("call_id").collect()] == [1, 1, 1, 2, 2, 3]
    rng = random.Random(1)
    ts = sorted(rng.randint(0, 500_000) for _ in range(300))
    want, anchor, g = [], None, 0
    for t in ts:
        if anchor is None or t - anchor > 15_000:
            anchor, g = t, g + 1
        want.append(g)
    df = spark.createDataFrame([(i, 1, 1, t) for i, t in enumerate(ts)], "call_id long, exp int, file_num int, onset_us long")
    assert [r["group_no"] for r in overlap.overlap_groups(df).orderBy("call_id").collect()] == want


def test_greedy_overlap_dense(spark):
    """One run without a gap, over many pieces: anchors go over cuts, and no group is collected into a row."""
    rng = random.Random(2)
    data = [(i, k, 1, None if i % 97 == 5 else rng.randint(0, 400_000)) for k in (1, 2) for i in range(k * 1000, k * 1000 + 300)]
    want = {}
    for k in (1, 2):
        anchor, g = None, 0
        for i, _, _, t in sorted((r for r in data if r[1] == k), key=lambda r: (r[3] is not None, r[3] or 0, r[0])):
            if t is None or anchor is None or t - anchor > 15_000:
                anchor, g = t, g + 1
            want[i] = g
    df = spark.createDataFrame(data, "call_id long, exp int, file_num int, onset_us long")
    for got in (overlap.overlap_groups(df), overlap.overlap_groups(df, step=20_000)):
        assert {r["call_id"]: r["group_no"] for r in got.collect()} == want
        assert "collect_list" not in got._jdf.queryExecution().toString()


def test_choose_loudest(spark):
    data = [(1, 1, -10.0, -20.0), (2, 1, -20.0, -10.0), (3, 2, None, None), (4, 3, None, None), (5, 3, -5.0, None)]
    df = spark.createDataFrame([(i, 1, 1, i, g, a, b) for i, g, a, b in data], "call_id long, exp int, file_num int, onset_us long, group_no long, RMS_a double, RMS_b double")
    got = overlap.choose_loudest(df, ["RMS_a", "RMS_b"])
    assert rows(got, "call_id", "is_chosen") == [(1, True), (2, False), (4, False), (5, True)]
    assert rows(overlap.choose_loudest(df, ["RMS_a", "RMS_b"], compat=True).filter("group_no = 3"), "call_id", "is_chosen") == [(4, True), (5, False)]
    ties = spark.createDataFrame([(1, -3.0, -9.0, -3.0), (2, None, None, None), (3, None, -1.0, -2.0)], "id int, a double, b double, c double")
    assert [r["assigned_location"] for r in overlap.assign_location(ties, {"arena_1": "a", "arena_2": "b", "underground": "c"}).orderBy("id").collect()] == ["arena_1", None, "arena_2"]


def test_call_table_and_sort(spark):
    df = spark.createDataFrame([(1, "x", 1.0, 1.5, "10", "arena_1", 0.5), (2, "y", 0.5, 1.0, "9", None, 0.1), (3, "z", 0.1, 0.2, "bad", "arena_1", 0.2)], "call_id long, label string, onset_s double, offset_s double, file_number string, assigned_location string, meanprob_a double")
    assert [r["call_id"] for r in overlap.sort_calls(df).collect()] == [2, 1, 3]
    got = {r["event_type"]: r for r in overlap.call_table(df, {10: "arena_1"}).collect()}
    assert (got["x"]["file_num"], got["x"]["duration_sec"], got["x"]["assigned_channel"], got["z"]["file_num"]) == (10, 0.5, 10, None) and "meanprob_a" in got["x"].asDict()


def test_rates(spark):
    sync = spark.createDataFrame([(1, 0, 60 * S), (1, 5, 5), (2, 9, 3), (3, 0, 120 * S)], "exp int, start_us long, end_us long")
    minutes, rejected = rates.recorded_minutes(sync)
    assert rows(minutes, "exp", "minutes") == [(1, 1.0), (3, 2.0)] and rows(rejected, "exp") == [(2,)]
    calls = spark.createDataFrame([(1, " A "), (1, None), (1, "b")], "exp int, event_type string")
    counts = rates.call_counts(calls)
    assert rows(counts, "event_type", "n") == [("a", 1), ("b", 1), ("nan", 1)]
    dims = spark.createDataFrame([(1, "f", 1), (3, "f", 2)], "exp int, folder string, animals int")
    by = rates.summary(rates.rates_by_type(counts, minutes, dims), ["folder", "event_type"], ["f", "none"])
    assert ("f", "a", 2, 0.5) in rows(by, "folder", "event_type", "n_exp", "mean")
    pooled = rates.summary(rates.pooled_rates(counts, minutes, dims).filter("exp = 1"), ["folder"], ["f", "none"])
    assert rows(pooled, "folder", "n_exp", "mean", "std") == [("f", 1, 3.0, None), ("none", None, None, None)]


def test_clocks(spark):
    sync = spark.createDataFrame([(1, 0, 1, 0, 5), (1, 1, 2, 100, 200), (1, 2, 2, 150, 200), (1, 3, None, 9, 9)], "exp int, row_pos int, file_num long, start_us long, end_us long")
    chunks = clocks.chunk_starts(sync)
    assert rows(chunks, "file_num", "start_us", "offset_us") == [(1, 0, 0), (2, 150, 150)]
    calls = spark.createDataFrame([(1, 2, 7, 9), (1, 3, 0, 1)], "exp int, file_num long, start_file_us long, stop_file_us long")
    assert rows(clocks.align(calls, chunks), "start_exp_us", "stop_us") == [(157, 159)]
    assert rows(clocks.missing_files(calls, chunks), "file_num", "n_calls") == [(3, 1)]
    assert rows(clocks.expanded(spark.createDataFrame([("511:513",), ("7",)], "sel string")), "exp") == [(511,), (512,), (513,), (7,)]
    inside, outside = clocks.in_range(spark.createDataFrame([(1,), (5,), (20,)], "exp int"), spark.createDataFrame([(0, 4, "a"), (5, 9, "b")], "lo int, hi int, month string"))
    assert rows(inside, "exp", "month") == [(1, "a"), (5, "b")] and rows(outside, "exp") == [(20,)]


def test_scalars(spark):
    assert one(spark, clock.duration_text(F.lit(97503.5))) == "27:05:03.500"
    number = lambda *x: one(spark, clock.trailing_number(F.array(*[F.lit(v) for v in x])))
    assert number("x", "video_007") == 7 and number("x") is None
    assert one(spark, clock.list_literal(F.lit("('a', 'b')"))) == ["a", "b"] and one(spark, clock.list_literal(F.lit("oops"))) is None
    assert one(spark, clock.trailing_digits(F.lit("file_012"))) == 12 and one(spark, clock.trailing_digits(F.lit("none"))) is None
    level = lambda *x: one(spark, levels.level_db(F.array(*[F.lit(float(v)) for v in x]).cast("array<double>")))
    assert level() is None and level(0, 0) == pytest.approx(-240) and level(1, -1) == pytest.approx(0, abs=1e-6)
    assert one(spark, levels.pair_mean(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(2.0)))) == [2.0, 2.0]
    assert one(spark, clock.micros(F.lit("1970-01-02 03:04:05.678901"))) == 86_400_000_000 + 11_045_678_901


def test_audits(spark):
    ids = lambda *x: spark.createDataFrame([(1, i) for i in x], "exp int, file_num int")
    got = audit.expected_vs_actual(ids(1, 2, 3), ids(2, 3, 4)).first()
    assert (got["missing"], got["extra"]) == ([1], [4])
    m = spark.createDataFrame([(1, "modern", 1), (1, "legacy", 1), (2, "modern", 1), (2, "legacy", 2), (3, "legacy", 1), (4, None, 1)], "exp int, scheme string, file_num int")
    assert rows(audit.naming_schemes(m), "exp", "scheme", "reason") == [(1, "modern", None), (2, None, "schemes differ"), (3, "legacy", None), (4, None, "no chunks")]
    c = spark.createDataFrame([(1, 1, 10), (1, 2, 99), (2, 1, 99), (2, 2, 5)], "exp int, file_num int, size long")
    assert rows(audit.terminal_chunks(c, 50), "exp", "file_num", "status") == [(1, 1, "ok"), (1, 2, "excluded"), (2, 1, "error"), (2, 2, "ok")]
    runs = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, None)], "exp int, run_id string")
    assert rows(audit.single_run(runs), "exp", "run_id", "reason") == [(1, "a", None), (2, None, "several: a, b"), (3, None, "not found")]
    pairs = spark.createDataFrame([(1, "10", 1, 2)], "exp int, virtual_ch string, ch1 int, ch2 int")
    have = spark.createDataFrame([(1, 1, 7), (1, 2, 7), (1, 1, 8)], "exp int, channel int, file_num int")
    assert rows(audit.pairs_present(have, pairs), "file_num") == [(7,)]
    ok, bad = audit.failures(ids(1, 2), ("small", F.col("file_num") > 1), ("large", F.col("file_num") < 9))
    assert rows(ok, "file_num") == [(2,)] and rows(bad, "file_num", "reason") == [(1, "small")]


def test_pair_average(spark):
    c = [(1, 1, 1, 8, [1.0, 3.0]), (1, 2, 1, 8, [3.0, 5.0]), (1, 1, 2, 8, [1.0]), (1, 1, 3, 8, [1.0]), (1, 2, 3, 9, [1.0]), (1, 1, 4, 8, [1.0]), (1, 2, 4, 8, [1.0, 2.0])]
    chunks = spark.createDataFrame(c, "exp int, channel int, file_num int, rate int, samples array<float>")
    got = signal.pair_average(chunks, spark.createDataFrame([(1, "10", 1, 2)], "exp int, virtual_ch string, ch1 int, ch2 int"))
    assert rows(got, "file_num", "outcome", "samples") == [(1, "saved", [2.0, 4.0]), (2, "missing", None), (3, "rate", None), (4, "shape", None)]
    assert signal.outcome_counts(got).first().asDict() == {"exp": 1, "n_saved": 1, "n_missing": 1, "n_rate": 1, "n_shape": 1}


def _signal(spark, *values):
    return spark.createDataFrame([("f", i, float(v)) for i, v in enumerate(values)], "file string, idx long, value double")


def test_signals(spark):
    x = _signal(spark, 0, 0, 2, 2, 0, 0, 0, 2, 0, 2, 0)
    assert rows(signal.dips(x), "start_idx", "end_idx", "n") == [(3, 6, 3), (7, 8, 1)]
    assert rows(signal.dips(x, least_samples=2), "n") == [(3,)] and signal.dips(x, gate=5.0).collect() == []
    mean = signal.rolling_mean(_signal(spark, 1, 2, 3, 4), 2, centred=True).orderBy("idx")
    assert [r["mean"] for r in mean.collect()] == [None, 1.5, 2.5, 3.5]
    gated = signal.rolling_mean(_signal(spark, 0, 0, 4, 4, 0), 2, centred=False)
    assert rows(signal.activated(gated), "idx") == [(2,), (3,), (4,)] and rows(signal.activated(gated, compat=True), "idx") == [(0,), (1,), (2,)]
    runs = signal.runs(_signal(spark, 1, 1, 0, 1), F.col("value") > 0)
    assert rows(runs, "run", "is_on", "first_idx", "n") == [(1, True, 0, 2), (2, False, 2, 1), (3, True, 3, 1)]
    assert rows(signal.first_run_code(runs, 200), "code") == [(1,)]
    seg = spark.createDataFrame([("f", 1, 0, 2), ("f", 2, 2, 3)], "file string, call_id int, start_idx int, end_idx int")
    assert rows(signal.long_levels(seg, _signal(spark, 1, -1, 0, 5)), "call_id", "level_db")[0] == (1, pytest.approx(0, abs=1e-6))


def test_tracks(spark):
    t = lambda *v: spark.createDataFrame([("s", i, x) for i, x in enumerate(v)], "seg_id string, frame int, y double")
    med = spectral.running_median(t(1.0, None, 9.0), "y", 3, "m").orderBy("frame")
    assert [r["m"] for r in med.collect()] == [1, 5, 9]
    fill = spectral.interpolated(t(None, 2.0, None, 6.0, None), "y").orderBy("frame")
    # between neighbours a straight line, flat beyond them
    assert [r["y"] for r in fill.collect()] == [2, 2, 4, 6, 6]
    assert [r["y"] for r in spectral.interpolated(t(None, 2.0), "y").orderBy("frame").collect()] == [None, 2]
    got = spectral.track_summary(t(1.0, 3.0, None, 7.0), "y", "frame").first()
    assert (got["median"], got["range"], got["slope"]) == (3, 6, pytest.approx(2))
    assert spectral.track_summary(t(None, 3.0), "y", "frame").first()["slope"] is None
    assert {r["y"] for r in spectral.valid_tracks(t(1.0, None, None), "y", 0.5).collect()} == {None}
    s = spectral.series_summary(t(1.0, 2.0, 3.0, 10.0, float("nan")), "y", ["seg_id"], "y").first()
    assert (s["y_mean"], s["y_median"], s["y_iqr"]) == (4.0, 2.5, 3.0)


def test_best_candidate(spark):
    px = [("s", c, f, hz, 1.0) for c, hzs in ((1, [1000, 1400, 1800, 2000]), (2, [1000, 1000, 1000, 1000]), (3, [1000, 9000, 9000])) for f, hz in enumerate(hzs)]
    df = spark.createDataFrame([(s, c, f, float(h), a) for s, c, f, h, a in px], "seg_id string, component int, frame int, freq_hz double, amp double")
    assert rows(spectral.best_candidate(df), "component", "score") == [(1, pytest.approx(1 + 0.88 + 3 - 0.02))]


def test_spectrogram(spark):
    import numpy as np

    rate, x = 8000, np.sin(2 * np.pi * 1000 * np.arange(2048) / 8000)
    df = spark.createDataFrame([("a", rate, x.tolist()), ("short", rate, [1.0, 2.0]), ("none", rate, None), ("empty", rate, [])], "seg_id string, rate int, samples array<double>")
    frames = spectral.spectrogram(df)
    assert {(r["seg_id"], r["n"]) for r in frames.groupBy("seg_id").agg(F.countDistinct("frame").alias("n")).collect()} == {("a", 7), ("short", 1)}
    top = frames.filter("seg_id = 'a'").groupBy("frame").agg(F.max_by("freq_hz", "mag").alias("f"), F.max("mag").alias("m"))
    assert {r["f"] for r in top.collect()} == {1000.0} and all(abs(r["m"] - 0.5) < 0.01 for r in top.collect())
    shape = spectral.frame_shape(frames.filter("seg_id = 'a'")).first()
    assert shape["centroid"] == pytest.approx(1000, abs=20)
    feats = spectral.features(frames, df.select("seg_id"))
    assert feats.count() == 4 and feats.filter("seg_id = 'none'").first()["entropy_mean"] is None


def test_histograms(spark):
    edges = distribution.log_edges(0.05, 3.0, 30)
    assert len(edges) == 30 and edges[0] == 0.05 and edges[-1] == 3.0
    df = spark.createDataFrame([(0.05,), (3.0,), (3.1,), (0.01,), (edges[3],)], "x double")
    assert rows(distribution.histogram(df, "x", edges), "bin", "n") == [(0, 1), (28, 1), (3, 1)]
    rng = random.Random(2)
    xs = [rng.uniform(0.01, 4) for _ in range(500)]
    want = {}
    for x in xs:
        for i in range(29):
            if edges[i] <= x < edges[i + 1] or (i == 28 and x == edges[-1]):
                want[i] = want.get(i, 0) + 1
    got = distribution.histogram(spark.createDataFrame([(x,) for x in xs], "x double"), "x", edges)
    assert {r["bin"]: r["n"] for r in got.collect()} == want
    cdf = distribution.empirical_cdf(spark.createDataFrame([("k", 1.0), ("k", 1.0), ("k", 0.0)], "k string, x double"), "x", ["k"])
    assert rows(cdf, "cdf") == [(0.5,), (1.0,)]


def test_logs(spark):
    text = "Time>Log for experiment number 272\n2025-07-01_12-00-05>lights checked\nfree text without separator\n2025-13-01_00-00-00>bad time\n"
    got = tables.log_lines(spark.createDataFrame([(text,)], "value string"))
    assert [(r["line_number"], r["parse_status"], r["log_us"] is None) for r in got.collect()] == [(2, "parsed", False), (3, "unparsed", True), (4, "parsed", True)]


def test_invariants(spark, sf):
    from eventloom.plans.queries import QUERIES

    joint = QUERIES["joint_probabilities"](spark, sf).groupBy("variant", "band", "location").agg(F.sum("joint").alias("s"))
    assert all(abs(r["s"] - 1) < 1e-4 or r["s"] == 0 for r in joint.collect())
    p = QUERIES["transition_probabilities"](spark, sf).groupBy("variant", "band", "location", "from_type").agg(F.sum("p").alias("s"))
    assert all(abs(r["s"] - 1) < 1e-4 or r["s"] == 0 for r in p.collect())
    hours = {r["variant"]: r["hours"] for r in QUERIES["total_hours"](spark, sf).collect()}
    assert hours["day"] + hours["night"] == pytest.approx(hours["all"], abs=1e-3)


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_long_sequences_in_pieces(spark, step):
    """Neighbours and running sums over cuts are those of one window."""
    from pyspark.sql import Window

    from eventloom.operators import ordered

    rng = random.Random(step)
    data = [(rng.choice([1, 2, None]), rng.choice([None, rng.randint(0, 60)]), i) for i in range(200)]
    df = spark.createDataFrame(data, "k int, t long, id long")
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select("id", F.lead("id").over(w).alias("next"), F.lag("id").over(w).alias("prev"), F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    got = ordered.neighbour(df, ["k"], ["t", "id"], ["id"], step=step)
    got = ordered.neighbour(got, ["k"], ["t", "id"], ["id"], after=False, step=step)
    got = ordered.running_sum(got, ["k"], ["t", "id"], {"s": F.col("id")}, step=step).select("id", F.col("_next.id").alias("next"), F.col("_prev.id").alias("prev"), "s")
    assert rows(got, "id", "next", "prev", "s") == rows(want, "id", "next", "prev", "s")


def test_analyses(spark):
    from eventloom.plans import analyses

    sync = spark.createDataFrame([(1, 0, 1, 9 * 3600 * S, 9 * 3600 * S + 60 * S)], "exp int, row_pos int, file_num long, start_us long, end_us long")
    calls = spark.createDataFrame([(1, 1, 1, 10, " Tild ", 0, S // 100), (2, 1, 1, 10, "noise", S // 50, S // 40), (3, 1, 1, 10, "tilda", S // 25, S), (4, 1, 9, 10, "x", 0, 1)], "call_id long, exp int, file_num long, assigned_channel int, event_type string, start_file_us long, stop_file_us long")
    out = analyses.transition_analysis(calls, sync, order=["tilda"], places={10: "arena"})
    assert rows(out["transitions"].filter("n > 0"), "variant", "band", "n") == [("all", "right", 1), ("day", "right", 1)]
    assert rows(out["missing_files"], "file_num") == [(9,)] and out["gaps"].count() == 1 and out["hours"].count() == 3 and out["self_gaps"].count() == 2
    r = analyses.rate_analysis(calls, sync, spark.createDataFrame([(1, "f", 2)], "exp int, folder string, animals int"), ["f"])
    assert rows(r["per_experiment"], "n", "rate") == [(4, 2.0)] and r["wide"].columns == ["event_type", "f_mean", "f_std"] and r["rejects"].count() == 0
    chunks = spark.createDataFrame([(1, 1, c, 100, [float(v)] * 200) for c, v in ((10, 0.1), (20, 0.9))], "exp int, file_num long, channel int, rate int, samples array<float>")
    det = spark.createDataFrame([(1, 1, 1, "a", 0.1, 0.2), (1, 1, 2, "a", 0.11, 0.3), (1, 1, 3, "b", 1.0, 1.5)], "exp int, file_num long, call_id long, label string, onset_s double, offset_s double")
    s = analyses.source_assignment(det, chunks, {"arena_1": 10, "arena_2": 20}, {10: "arena_1", 20: "arena_2"})
    assert rows(s["calls"], "event_type", "start_time_file_sec", "assigned_channel") == [("a", 0.1, 20), ("b", 1.0, 20)] and s["log"].count() == 2
    b = analyses.bout_analysis(spark.createDataFrame([(i, 1, 10, "alarm", i * S, i * S) for i in range(6)] + [(9, 1, 10, "other", 0, 0)], CALL))
    assert b["calls"].count() == 7 and rows(b["bouts"], "n_calls") == [(6,)]


@pytest.mark.parametrize("step", [3, 7, 1000])
def test_signals_in_pieces(spark, step):
    """Pieces give what whole sequences do."""
    from itertools import groupby

    rng = random.Random(step)
    x = [None if rng.random() < 0.05 else rng.choice([0.0, 0.2, 0.9, 1.4]) for _ in range(60)]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(x)], "file string, idx long, value double").repartition(4)
    got = [r["mean"] for r in signal.rolling_mean(df, 3, centred=False, step=step).orderBy("idx").collect()]
    part = [x[max(0, i - 2) : i + 1] for i in range(60)]
    assert got == [pytest.approx(sum(p) / 3) if len(p) == 3 and None not in p else None for p in part]
    flags = [v is not None and v < 0.5 for v in x]
    want, at = [], 0
    for on, g in groupby(flags):
        n = len(list(g))
        if on and at and at + n < 60:
            want.append((at - 1, at + n - 1, n))
        at += n
    assert set(rows(signal.dips(df, step=step), "start_idx", "end_idx", "n")) == set(want)
    lengths = [(on, len(list(g))) for on, g in groupby(flags)]
    assert [(r["is_on"], r["n"]) for r in signal.runs(df, F.coalesce(F.col("value") < 0.5, F.lit(False)), step=step).orderBy("run").collect()] == lengths


def test_cdf_of_ties(spark):
    rng = random.Random(1)
    x = [("k", float(rng.choice([1, 1, 1, 2, 3, 50]))) for _ in range(500)] + [("l", -1.0), ("m", 4.0)]
    df = spark.createDataFrame(x, "k string, x double")
    got = [(r["x"], r["cdf"]) for r in distribution.empirical_cdf(df, "x", ["k"], parts=4).filter("k = 'k'").orderBy("cdf").collect()]
    v = sorted(b for a, b in x if a == "k")
    assert got == [(b, (i + 1) / len(v)) for i, b in enumerate(v)]


def final_plan(df):
    """The plan that adaptive execution ended with."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[: text.index("== Initial Plan")] if "== Initial Plan" in text else text


def test_samples_are_sorted_once(spark):
    """Summaries of pieces and runs read one exchange; a long key is as many groups as it has pieces; gaps in idx are no cuts."""
    df = spark.createDataFrame([("f", 3 * i, float(i // 4 % 2)) for i in range(400)] + [("g", 0, None)], "file string, idx long, value double").repartition(3)
    found = signal.runs(df, F.col("value") > 0.5, step=50)
    plan = final_plan(found)
    assert len([x for x in plan.split("\n") if "Sort [_seq" in x and "idx" in x]) == 1 and "ReusedExchange" in plan
    got = sorted((r["run"], r["is_on"], r["first_idx"], r["n"]) for r in found.filter("file = 'f'").collect())
    assert got == [(k + 1, k % 2 == 1, 12 * k, 4) for k in range(100)] and found.filter("file = 'g'").count() == 1
    dips = signal.dips(df, step=50).filter("file = 'f'").collect()
    assert sorted((r["start_idx"], r["end_idx"], r["n"]) for r in dips) == [(12 * k - 3, 12 * k + 9, 12) for k in range(2, 100, 2)]


def test_ranks_and_quantiles(spark):
    import numpy as np

    from eventloom.operators import distribution

    rng = random.Random(4)
    x = [("k", float(rng.choice([1, 1, 1, 2, 3, 50, -7]))) for _ in range(300)] + [("k", rng.random()) for _ in range(300)] + [("l", -1.0), ("m", None)]
    df = spark.createDataFrame(x, "k string, x double")
    v = sorted(b for a, b in x if a == "k")
    got = {r["x"]: (r["n"], r["first_rank"], r["last_rank"], r["total"]) for r in distribution.ranks(df, "x", ["k"], parts=5).filter("k = 'k'").collect()}
    assert got == {b: (v.count(b), v.index(b) + 1, v.index(b) + v.count(b), len(v)) for b in set(v)}
    q = {r["k"]: (r["a"], r["b"], r["c"]) for r in distribution.quantiles(df, "x", ["k"], {"a": 0.25, "b": 0.5, "c": 0.9}).collect()}
    assert q["k"] == pytest.approx(np.percentile(v, [25, 50, 90])) and q["l"] == (-1.0, -1.0, -1.0) and "m" not in q
    assert distribution.quantiles(df, "x", [], {"a": 0.5}).first()["a"] == pytest.approx(np.median([b for _, b in x if b is not None]))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    try:
        distribution.empirical_cdf(df, "x", ["k"])
        assert not jobs.getJobIdsForGroup("building")
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def follow(onsets, anchor, w):
    """The last anchor and the number of groups begun."""
    n = 0
    for t in onsets:
        if anchor is None or t - anchor > w:
            anchor, n = t, n + 1
    return anchor, n


def test_steps_are_what_pieces_do():
    """Step functions of random, dense and even onsets, against following each carried anchor."""
    from bisect import bisect_right

    rng = random.Random(9)
    for case in range(400):
        w = rng.choice([1, 5, 40])
        onsets = sorted(rng.randrange(rng.choice([10, 60, 300])) for _ in range(rng.randrange(1, 60))) if case % 3 else list(range(0, 120, rng.choice([1, 2, 3])))
        steps = overlap.Steps(w)
        for t in onsets:
            steps.add(t)
        bounds, anchors, groups, _ = steps.table()
        assert bounds == sorted(set(bounds)) and len(bounds) <= len({t for t in onsets if t <= onsets[0] + w}) + 1
        for a in (None, *range(-3 * w - 3, onsets[0] + 1)):
            at = 0 if a is None else bisect_right(bounds, a)
            got = (anchors[at], groups[at]) if at < len(bounds) else (a, 0)
            assert got == follow(onsets, a, w)


@pytest.mark.parametrize("step", [7, 50, 1000])
def test_dense_chains(spark, step):
    """Anchors that depend on all rows before them, over many pieces, in one plan without jobs of its own."""
    rng = random.Random(step)
    rows_ = [(1, i, 3 * i) for i in range(150)] + [(2, i, t) for i, t in enumerate(sorted(rng.randrange(700) for _ in range(150)))] + [(3, 0, None), (3, 1, None), (3, 2, 5), (None, 0, 1)]
    df = spark.createDataFrame(rows_, "exp int, call_id int, onset_us long").repartition(4)
    spark.sparkContext.setJobGroup("grouping", "")
    try:
        found = overlap.overlap_groups(df, window_us=10, keys=("exp",), step=step)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("grouping")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    got = {(r["exp"], r["call_id"]): r["group_no"] for r in found.collect()}
    for exp in (1, 2):
        anchor, n = None, 0
        for e, i, t in rows_:
            if e == exp:
                if anchor is None or t - anchor > 10:
                    anchor, n = t, n + 1
                assert got[e, i] == n
    assert sorted(got[3, i] for i in range(3)) == [1, 2, 3] and got[3, 2] == 3 and got[None, 0] == 1


@pytest.mark.parametrize("step", [6, 25, 10_000])
def test_tracks_in_pieces(spark, step):
    """Running medians and filled gaps are those of whole tracks, whatever the pieces; other columns stay."""
    import statistics

    rng = random.Random(step)
    tracks = {k: [None if rng.random() < part else float(rng.randrange(50)) for _ in range(120)] for k, part in (("a", 0.3), ("b", 0.9), ("c", 1.0), ("d", 0.0))} | {"e": [None] * 60 + [4.0] + [None] * 59}
    df = spark.createDataFrame([(k, 5 * i, v, f"{k}{i}") for k, vs in tracks.items() for i, v in enumerate(vs)], "seg_id string, frame int, y double, note string").repartition(4)
    for width in (1, 4, 9):
        r = (width + (width % 2 == 0)) // 2
        got = spectral.running_median(df, "y", width, "m", step=step).collect()
        assert len(got) == len({(x["seg_id"], x["frame"]) for x in got}) == 600
        for x in got:
            i, vs = x["frame"] // 5, tracks[x["seg_id"]]
            known = [v for v in vs[max(0, i - r) : i + r + 1] if v is not None]
            assert x["m"] == (statistics.median(known) if known else None) and x["y"] == vs[i] and x["note"] == f"{x['seg_id']}{i}"
    for x in spectral.interpolated(df, "y", step=5 * step).collect():
        i, vs = x["frame"] // 5, tracks[x["seg_id"]]
        at = [k for k, v in enumerate(vs) if v is not None]
        if vs[i] is not None or len(at) < 2:
            want = vs[i]
        else:
            a, b = max((k for k in at if k < i), default=None), min((k for k in at if k > i), default=None)
            want = vs[b] if a is None else vs[a] if b is None else vs[a] + (vs[b] - vs[a]) * (i - a) / (b - a)
        assert x["y"] == (None if want is None else pytest.approx(want)) and x["note"] == f"{x['seg_id']}{i}"


def _cut(spark, signals, block):
    rows_ = [(k, 1000, i // block, i, x[i : i + block]) for k, x in signals.items() for i in range(0, max(1, len(x)), block)]
    return spark.createDataFrame(rows_, "seg_id string, rate int, block int, first_idx long, samples array<double>").repartition(3)


@pytest.mark.parametrize("block", [15, 16, 17, 40, 1000])
def test_frames_over_blocks(spark, block):
    """Spectra and crossings of a recording in blocks are those of the whole signal."""
    rng = random.Random(block)
    signals = {k: [rng.gauss(0, 1) for _ in range(n)] for k, n in (("a", 200), ("b", 16), ("c", 9), ("d", 0), ("e", block), ("f", block + 1), ("g", 3 * block))}
    whole = spark.createDataFrame([(k, 1000, x) for k, x in signals.items()], "seg_id string, rate int, samples array<double>")
    for hop in (4, 16, 23):
        key = lambda r: (r["seg_id"], r["frame"], r["bin"])
        want = {key(r): (r["freq_hz"], r["mag"]) for r in spectral.spectrogram(whole, width=16, hop=hop).collect()}
        got = spectral.spectrogram(_cut(spark, signals, block), width=16, hop=hop).collect()
        assert len(got) == len(want) and all(want[key(r)] == pytest.approx((r["freq_hz"], r["mag"])) for r in got)
    want = rows(spectral.frame_zcr(whole, width=16, hop=4), "seg_id", "frame", "zcr")
    assert rows(spectral.frame_zcr(_cut(spark, signals, block), width=16, hop=4), "seg_id", "frame", "zcr") == want


def test_blocks_too_short_for_frames(spark):
    with pytest.raises(Exception, match="isn't its segment's last"):
        spectral.spectrogram(_cut(spark, {"a": [0.0] * 40}, 5), width=16, hop=4).count()


def test_errors(spark):
    calls = spark.createDataFrame([(1, 1, "a", 0, 1)], "exp int, file_num int, event_type string, start_file_us long, stop_file_us long")
    none = spark.createDataFrame([], "exp int, file_num int, start_us long, offset_us long")
    with pytest.raises(ValueError):
        clocks.align_some(calls, none)
    assert clocks.align_some(calls.limit(0), none).count() == 0
    with pytest.raises(ValueError):
        sequence.in_domain(calls, ["b"], some=True)
    assert sequence.in_domain(calls, ["a"], some=True).count() == 1
