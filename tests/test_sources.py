"""Readers on files written to a temporary folder."""

from __future__ import annotations

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.sources import audio, tables

from test_events import rows


def wav(rate, x, tag=1, bits=16):
    data = np.asarray(x).astype({(1, 8): "u1", (1, 16): "<i2", (1, 32): "<i4", (3, 32): "<f4", (3, 64): "<f8"}[tag, bits])
    channels = 1 if data.ndim == 1 else data.shape[1]
    body = data.tobytes()
    fmt = struct.pack("<HHIIHH", tag, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body


def npz(**arrays):
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def test_detections(spark, tmp_path):
    (tmp_path / "channel_10_file_001_accepted_calls.csv").write_text("label,onset_s,offset_s\na,0.5,1\n")
    (tmp_path / "odd_accepted_calls.csv").write_text("label,onset_s,offset_s\nb,2,3\n")
    (tmp_path / "other.csv").write_text("x\n1\n")
    got = tables.detections(spark, f"file://{tmp_path}", "label string, onset_s double, offset_s double")
    assert rows(got, "label", "channel", "file_number") == [("a", "10", "001"), ("b", "accepted", "")]


def test_columns_go_by_name(spark, tmp_path):
    """Other orders, missing and further columns, quotes, empty lines; foreign files of the same name pattern are skipped."""
    (tmp_path / "channel_10_file_001_accepted_calls.csv").write_text('onset_s,label,offset_s,meanprob_b\n0.5,"a, b",1,0.25\n\n')
    (tmp_path / "channel_20_file_002_accepted_calls.csv").write_text('"label","offset_s","meanprob_a"\r\nb,x,0.75\r\n')
    got = tables.detections(spark, f"file://{tmp_path}", "label string, onset_s double, offset_s double")
    assert rows(got, "label", "onset_s", "offset_s", "meanprob_a", "meanprob_b", "channel") == [("a, b", 0.5, 1.0, None, 0.25, "10"), ("b", None, None, 0.75, None, "20")]
    whole = tables.gathered(spark, f"file://{tmp_path}", "offset_s double, label string, none int", others=(("", "string"),))
    assert set(whole.columns) == {"offset_s", "label", "none", "onset_s", "meanprob_a", "meanprob_b"} and whole.count() == 2
    assert tables.csv_table(spark, f"file://{tmp_path}/channel_10_file_001_accepted_calls.csv", "offset_s double, label string").collect() == [(1.0, "a, b")]
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "channel_30_file_063_annotations.csv").write_text("stop_seconds,name,start_seconds\n2,vox,1\n")
    (tmp_path / "n" / "channel_30_file_064_annotations.csv").write_text("a,b\n1,2\n")
    assert rows(tables.annotations(spark, f"file://{tmp_path}/n"), "name", "start_seconds", "stop_seconds", "file_num") == [("vox", 1.0, 2.0, 63)]


def test_single_file(spark, tmp_path):
    """Parts are written in parallel and joined behind one header; a failed write leaves the old file."""
    import pytest

    at = f"file://{tmp_path}/one"
    df = spark.range(100).repartition(5).select("id", F.concat(F.lit('a "q",\nb '), "id").alias("some, text"))
    tables.write_csv(df, at, one_file=True)
    (file,) = (tmp_path / "one").glob("part-*.csv")
    first = file.read_text()
    assert first.startswith('id,"some, text"\n') and first.count("some, text") == 1
    back = tables.csv_table(spark, at, "id long, `some, text` string")
    assert sorted(back.collect()) == [(i, f'a "q",\nb {i}') for i in range(100)]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        tables.write_csv(spark.range(9).select((1 / (F.col("id") - 5)).alias("x")), at, one_file=True)
    assert file.read_text() == first
    tables.write_csv(spark.range(3), at, one_file=True)
    (file,) = (tmp_path / "one").glob("part-*.csv")
    assert sorted(file.read_text().split()) == ["0", "1", "2", "id"] and [p.name for p in tmp_path.iterdir()] == ["one"]
    tables.write_csv(spark.range(0), at, one_file=True)
    assert next((tmp_path / "one").glob("part-*.csv")).read_text() == "id\n"


def test_quoted_records(spark, tmp_path):
    """Doubled quotes, line ends and commas in fields and headers, rows like the header, repeated names, a byte order mark, empty files; all columns come."""
    (tmp_path / "channel_10_file_001_accepted_calls.csv").write_text('label,onset_s,offset_s,"note, long"\n"two\nlines",1,2,"x ""q"" y"\nlabel,3,4,label\nlabel,onset_s,offset_s,"note, long"\n"",5,nan,plain\n')
    (tmp_path / "channel_20_file_002_accepted_calls.csv").write_bytes(b"\xef\xbb\xbfoffset_s,label,label\r\n2,a,b\r\n")
    (tmp_path / "channel_20_file_003_accepted_calls.csv").write_text("")
    (tmp_path / "channel_20_file_004_accepted_calls.csv").write_text('"a head\nof two lines",label\n1,c\n')
    (tmp_path / "channel_20_file_005_accepted_calls.csv").write_text('"' + "long " * 20_000 + '",label\n1,d\n')
    got = tables.detections(spark, f"file://{tmp_path}", "label string, onset_s double, offset_s double")
    assert set(got.columns) == {"label", "onset_s", "offset_s", "note, long", "label.1", "a head\nof two lines", ("long " * 20_000).strip(), "channel", "file_number"}
    assert set(rows(got, "label", "onset_s", "offset_s", "note, long", "label.1", "file_number")) == {
        ("two\nlines", 1.0, 2.0, 'x "q" y', None, "001"), ("label", 3.0, 4.0, "label", None, "001"), ("label", None, None, "note, long", None, "001"), (None, 5.0, None, "plain", None, "001"),
        ("a", None, 2.0, None, "b", "002"), ("c", None, None, None, None, "004"), ("d", None, None, None, None, "005"),
    }
    none = tables.detections(spark, f"file://{tmp_path}", "label string", suffix="_nothing.csv")
    assert none.count() == 0 and none.columns == ["label", "channel", "file_number"]
    # files of one header are one scan, and nothing is joined
    for i in range(6, 30):
        (tmp_path / f"channel_20_file_{i:03d}_accepted_calls.csv").write_text("label,onset_s,offset_s\ne,1,2\n")
    more = tables.detections(spark, f"file://{tmp_path}", "label string, onset_s double, offset_s double")
    plan = more._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan csv") == 5 and more.count() == 31


def test_blocks(spark, tmp_path):
    """Averages and levels of files that are several blocks, equal to those of whole signals, calls over block ends too."""
    from eventloom.operators import signal

    rng = np.random.default_rng(1)
    whole = {c: rng.normal(size=25).astype(np.float32) for c in (1, 2)}
    (tmp_path / "7").mkdir()
    for c, x in whole.items():
        (tmp_path / "7" / f"channel_{c}_1.wav").write_bytes(wav(10, x, 3, 32))
    (tmp_path / "7" / "channel_3_1.wav").write_bytes(wav(10, whole[1][:20], 3, 32))
    chunks = audio.audio_chunks(spark, f"file://{tmp_path}", block=6)
    pairs = spark.createDataFrame([(7, "v", 1, 2), (7, "w", 1, 3), (7, "x", 1, 4)], "exp int, virtual_ch string, ch1 int, ch2 int")
    paired = signal.pair_average(chunks, pairs)
    mean = [x for r in paired.filter("virtual_ch = 'v'").orderBy("block").collect() for x in r["samples"]]
    assert np.allclose(mean, (whole[1] + whole[2]) / 2)
    assert rows(paired.filter("virtual_ch <> 'v'"), "virtual_ch", "outcome", "samples") == [("w", "shape", None), ("x", "missing", None)]
    assert rows(signal.outcome_counts(paired), "n_saved", "n_missing", "n_rate", "n_shape") == [(1, 1, 0, 1)]
    spans = [(0.0, 0.5), (0.4, 2.0), (1.2, 1.3), (2.3, 9.0), (1.0, 1.0), (-1.0, 0.7), (0.4, 2.0)]
    calls = spark.createDataFrame([(7, 1, a, b) for a, b in spans], "exp int, file_num int, onset_s double, offset_s double")
    got = signal.call_levels(calls, chunks.filter("channel < 3")).collect()
    assert len(got) == 2 * len(spans)
    for r in got:
        x = whole[r["source_channel"]][max(0, int(r["onset_s"] * 10)) : max(0, int(r["offset_s"] * 10))].astype(float)
        assert (r["level_db"] is None) == (len(x) == 0)
        if len(x):
            assert abs(r["level_db"] - 20 * np.log10(np.sqrt(np.mean(x * x)) + 1e-12)) < 1e-6


def test_wide_samples(spark, tmp_path):
    x = np.array([-(2**23), -1, 0, 1, 2**23 - 1])
    data = b"".join(int(v).to_bytes(3, "little", signed=True) for v in x)
    head = wav(8000, [0] * 5)
    fmt = struct.pack("<HHIIHH", 1, 1, 8000, 24000, 3, 24)
    (tmp_path / "channel_1_1.wav").write_bytes(head[:20] + fmt + b"data" + struct.pack("<I", len(data)) + data)
    assert audio.audio_chunks(spark, f"file://{tmp_path}").first()["samples"] == x.tolist()


def extensible(rate, x, tag, bits):
    """A WAV file whose format is of the extensible kind, with the code in its sub-format."""
    plain = wav(rate, x, tag, bits)
    fmt = struct.pack("<H", 0xFFFE) + plain[22:36] + struct.pack("<HHIH", 22, bits, 0, tag) + bytes.fromhex("000000001000800000AA00389B71")
    return plain[:16] + struct.pack("<I", len(fmt)) + fmt + plain[36:]


def test_extensible_formats(spark, tmp_path):
    """The sub-format tells float from integer samples; without one it's an error."""
    x = np.array([0.5, -0.25, 1.0])
    (tmp_path / "channel_1_1.wav").write_bytes(extensible(8000, x, 3, 32))
    (tmp_path / "channel_1_2.wav").write_bytes(extensible(8000, x, 3, 64))
    (tmp_path / "channel_1_3.wav").write_bytes(extensible(8000, np.array([5, -6, 7]), 1, 32))
    (tmp_path / "channel_1_4.wav").write_bytes(extensible(8000, np.array([5, 6, 7]), 1, 8))
    (tmp_path / "channel_1_5.wav").write_bytes(wav(8000, [1, 2], 1)[:20] + struct.pack("<H", 0xFFFE) + wav(8000, [1, 2], 1)[22:])
    (tmp_path / "channel_1_6.wav").write_bytes(extensible(8000, x, 3, 32).replace(bytes.fromhex("030000000000"), bytes.fromhex("070000000000")))
    got = {r["file_num"]: (r["samples"], r["error"]) for r in audio.audio_chunks(spark, f"file://{tmp_path}").collect()}
    assert got[1] == got[2] == ([0.5, -0.25, 1.0], None) and got[3] == ([5.0, -6.0, 7.0], None) and got[4] == ([5.0, 6.0, 7.0], None)
    assert got[5][0] is None and "code" in got[5][1] and got[6][0] is None and "format 7" in got[6][1]


def test_ranges_of_files(spark, tmp_path):
    """Blocks are the same however a file is split, with odd chunks before the data, a cut file and a damaged one."""
    rng = np.random.default_rng(2)
    x = rng.integers(-9000, 9000, (1001, 2))
    one = wav(10, x)
    junk = b"LIST" + struct.pack("<I", 301) + bytes(302)
    (tmp_path / "channel_1_1.wav").write_bytes(one[:12] + junk + one[12:] + b"LIST" + struct.pack("<I", 4) + bytes(4))
    (tmp_path / "channel_1_2.wav").write_bytes(one[: 44 + 403])
    (tmp_path / "channel_1_3.wav").write_bytes(b"RIFF" + bytes(700))
    (tmp_path / "channel_1_4.wav").write_bytes(wav(10, x[:0]))
    (tmp_path / "channel_1_5.wav").write_bytes(one[:40] + struct.pack("<I", 0xFFFFFFFF) + one[44:])
    for split in (1, 64, 100, 333, 1 << 20):
        chunks = audio.audio_chunks(spark, f"file://{tmp_path}", block=37, split=split) if split > 1 else audio.audio_chunks(spark, str(tmp_path), block=400, split=200)
        rows_ = chunks.orderBy("file_num", "block").collect()
        of = {n: [r for r in rows_ if r["file_num"] == n] for n in range(1, 6)}
        for n, want in ((1, x[:, 0]), (2, x[:100, 0]), (5, x[:, 0])):
            assert [v for r in of[n] for v in r["samples"]] == want.tolist() and [r["block"] for r in of[n]] == list(range(len(of[n])))
        assert len(of[3]) == 1 and of[3][0]["error"] and [r["samples"] for r in of[4]] == [[]]


def test_file_of_three_gigabytes(spark, tmp_path):
    """A sparse file beyond what Spark reads as a whole: several tasks, a task reads its range only."""
    size, rate, marks = 3 << 30, 125_000, {0: 1, 700_000_001: -2, 1_610_000_000: 3}
    with (tmp_path / "channel_1_1.wav").open("wb") as f:
        f.write(wav(rate, [])[:40] + struct.pack("<I", size))
        f.truncate(44 + size)
        for i, v in marks.items():
            f.seek(44 + 2 * i)
            f.write(struct.pack("<h", v))
    chunks = audio.audio_chunks(spark, f"file://{tmp_path}", block=4_000_000, split=256 << 20)
    found = chunks.select("first_idx", "n_samples", F.array_max("samples").alias("top"), F.array_min("samples").alias("low"), "samples", F.spark_partition_id().alias("task"))
    value = F.when(F.col("top") > 0, F.col("top")).otherwise(F.col("low"))
    got = found.select("n_samples", "task", value.alias("v"), F.when(value != 0, F.col("first_idx") + F.array_position("samples", value) - 1).alias("idx")).collect()
    assert {r["idx"]: r["v"] for r in got if r["v"]} == {i: float(v) for i, v in marks.items()}
    assert len({r["task"] for r in got}) == 12 and sum(r["n_samples"] for r in got) == size // 2


def test_annotations(spark, tmp_path):
    (tmp_path / "exp_272_channel_30_file_063_annotations.csv").write_text("name,channel,start_seconds,stop_seconds\nvox,1,0.5,1\nvox,1,0,0\nalarm,1,NaN,2\nalarm,2,3,2\n")
    (tmp_path / "x_annotations.csv").write_text("name,channel,start_seconds,stop_seconds\nvox,1,1,2\n")
    got = tables.annotations(spark, f"file://{tmp_path}")
    assert {(r["channel"], r["file_num"]) for r in got.collect()} <= {(30, 63), (272, 63)} and got.count() == 4
    assert tables.target_annotations(got, ["vox"]).count() == 1 and tables.real_events(got).count() == 1
    assert {r["channel"] for r in tables.clean_annotations(got).collect()} == {-1}


def test_sync(spark, tmp_path):
    (tmp_path / "272").mkdir()
    (tmp_path / "272" / "sync.csv").write_text("timestamp,video\n\"['2025-07-01 12:00:00', '2025-07-01 12:10:00']\",\"['x', 'video_nest_top_001']\"\n\"oops\",\"['video_002']\"\n")
    got = tables.sync(spark, f"file://{tmp_path}").orderBy("row_pos").collect()
    assert [(r["exp"], r["file_num"]) for r in got] == [(272, 1), (272, 2)]
    assert got[0]["end_us"] - got[0]["start_us"] == 600_000_000 and got[1]["start_us"] is None


def test_logs_and_manifest(spark, tmp_path):
    (tmp_path / "experiment_272_log_2025-07-01_11-58-00.txt").write_text("Time>Log for experiment number 272\n\n2025-07-01_12-00-05>lights\n")
    got = tables.log_files(spark, f"file://{tmp_path}").collect()
    assert [(r["exp"], r["line_number"], r["log_text"]) for r in got] == [(272, 3, "lights")]
    (tmp_path / "300" / "raw").mkdir(parents=True)
    for n in ("channel_02_file_001.wav", "channel_2_7.wav", "notes.txt"):
        (tmp_path / "300" / "raw" / n).write_bytes(b"x")
    m = tables.manifest(spark, f"file://{tmp_path}/300")
    assert rows(m, "exp", "channel", "file_num", "scheme") == [(300, 2, 1, "modern"), (300, 2, 7, "legacy"), (300, None, None, None)]
    assert [r["exp"] for r in tables.experiments(m).collect()] == [300]
    assert rows(tables.match_audio(m.selectExpr("'channel_2_7_annotations.csv' AS name"), m), "name") [0] == ("channel_2_7_annotations.csv",)


def test_audio(spark, tmp_path):
    x = np.arange(-5, 5)
    files = {"channel_1_1.wav": wav(8000, x), "channel_1_2.wav": wav(8000, np.stack([x, -x], 1)), "channel_1_3.wav": wav(8000, x / 8, 3, 32), "channel_1_4.npz": npz(wav=x * 1.0, sr=[125000]), "channel_1_5.wav": b"no", "channel_1_6.npz": b"no", "channel_1_7.npz": npz(other=x)}
    for n, content in files.items():
        (tmp_path / n).write_bytes(content)
    got = {(r["file_num"], r["block"]): r for r in audio.audio_chunks(spark, f"file://{tmp_path}", block=6).collect()}
    for i, want in ((1, x), (2, x), (3, x / 8), (4, x)):
        assert np.allclose(got[i, 0]["samples"] + got[i, 1]["samples"], want) and got[i, 0]["error"] is None
    assert got[4, 0]["rate"] == 125000 and all(got[i, 0]["error"] for i in (5, 6, 7))
    checked = {r["path"][-5]: r for r in audio.archive_audit(spark, f"file://{tmp_path}", "sr").collect()}
    assert (checked["4"]["ok"], checked["4"]["has_key"], checked["4"]["keys"]) == (True, True, ["sr", "wav"])
    assert not checked["6"]["ok"] and checked["7"]["ok"] and not checked["7"]["has_key"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("day", 1, 2.0), ("all", 2, 3.0)], "variant string, exp int, x double")
    tables.write_partitioned(df, f"file://{tmp_path}/p")
    tables.write_csv(df, f"file://{tmp_path}/c")
    assert rows(spark.read.parquet(f"file://{tmp_path}/p"), "variant", "exp", "x") == [("all", 2, 3.0), ("day", 1, 2.0)]
    assert tables.gathered(spark, f"file://{tmp_path}/c", "variant string, exp int, x double").count() == 2
    assert tables.aligned(df, [("x", "double"), ("new", "int")]).columns == ["x", "new", "variant", "exp"]
    assert tables.union_by_name([df.select("exp"), df.select("x")]).count() == 4
    assert tables.numeric_columns(df, least=2) == ["exp", "x"]


def test_named_files(spark, tmp_path):
    """A file a value, rows in order, values with folders; files of the name are replaced, others stay, nothing else is left."""
    top = tmp_path / "n"
    df = spark.createDataFrame([("a/x", 2, 'q "v"'), ("a/x", 1, None), ("b=c", 3, "two\nlines"), (None, 4, "lost")], "name string, i int, v string")
    tables.write_named(df.repartition(3), f"file://{top}", "name", order=["i"])
    assert (top / "a" / "x.csv").read_text() == 'i,v\n1,\n2,"q ""v"""\n' and (top / "b=c.csv").exists()
    tables.write_named(df.filter("i = 1"), f"file://{top}", "name")
    assert (top / "a" / "x.csv").read_text() == "i,v\n1,\n" and (top / "b=c.csv").exists()
    tables.write_named(df.filter("i > 9"), f"file://{top}", "name")
    assert sorted(x.name for x in tmp_path.iterdir()) == ["n"]


def test_wav_round_trip(spark, tmp_path):
    """Blocks in any order come back as one file; null samples are left out, two rates are an error."""
    given = [(7, 1, 2, 1000, 1, [0.5, 0.25]), (7, 1, 2, 1000, 0, [1.0, -1.0, 2.0]), (7, 2, 2, 500, 0, []), (8, 12, 1234, 500, 0, [3.0]), (8, 3, 1, None, 0, [1.0]), (8, 3, 1, 500, 0, None)]
    df = spark.createDataFrame(given, "exp int, channel int, file_num int, rate int, block int, samples array<double>")
    assert audio.write_wav(df.repartition(4), f"file://{tmp_path}") == 3
    assert sorted(str(x.relative_to(tmp_path)) for x in tmp_path.rglob("*.*")) == ["7/channel_01_file_002.wav", "7/channel_02_file_002.wav", "8/channel_12_file_1234.wav"]
    got = audio.audio_chunks(spark, f"file://{tmp_path}")
    assert rows(got.select("exp", "channel", "file_num", "rate", "samples"), "exp", "channel", "file_num", "rate", "samples") == [(7, 1, 2, 1000, [1.0, -1.0, 2.0, 0.5, 0.25]), (7, 2, 2, 500, []), (8, 12, 1234, 500, [3.0])]
    assert audio.decode_wav((tmp_path / "7" / "channel_01_file_002.wav").read_bytes())[1].tolist() == [1.0, -1.0, 2.0, 0.5, 0.25]
    assert audio.write_wav(df.filter("exp > 8"), f"file://{tmp_path}") == 0
    with pytest.raises(Exception, match="several rates"):
        audio.write_wav(df.filter("exp = 7").withColumn("rate", df["block"] + 1), f"file://{tmp_path}")


def test_levels_over_blocks(spark, tmp_path):
    """Calls meet only the blocks they reach; calls without audio, with broken files and null times stay, with null levels."""
    from eventloom.operators import signal

    rng = np.random.default_rng(3)
    whole = {(f, c): rng.normal(size=40 + 7 * f).astype(np.float32) for f in (1, 2) for c in (1, 2)}
    (tmp_path / "7").mkdir()
    for (f, c), x in whole.items():
        (tmp_path / "7" / f"channel_{c}_{f}.wav").write_bytes(wav(10, x, 3, 32))
    (tmp_path / "7" / "channel_1_3.wav").write_bytes(b"broken")
    (tmp_path / "7" / "channel_3_2.wav").write_bytes(b"broken")
    spans = [(f, float(a), float(b)) for f in (1, 2) for a, b in rng.uniform(-0.5, 6, (12, 2))] + [(1, 0.6, 1.2), (1, 0.6, 1.2), (1, 0.5999, 1.2001), (3, 0.0, 1.0), (4, 0.0, 1.0), (1, None, 1.0), (None, 0.0, 1.0)]
    calls = spark.createDataFrame([(7, f, a, b) for f, a, b in spans], "exp int, file_num int, onset_s double, offset_s double")
    for block in (6, 1000):
        chunks = audio.audio_chunks(spark, f"file://{tmp_path}", block=block)
        got = signal.call_levels(calls, chunks).collect()
        assert len(got) == 2 * sum(f in (1, 2) for f, *_ in spans) + 3
        for r in got:
            if r["file_num"] not in (1, 2):
                assert r["source_channel"] is None and r["level_db"] is None
                continue
            x = whole[r["file_num"], r["source_channel"]]
            a, b = (None if t is None else max(0, int(np.floor(t * 10))) for t in (r["onset_s"], r["offset_s"]))
            x = x[:0] if a is None else x[a:b].astype(float)
            assert (r["level_db"] is None) == (len(x) == 0)
            if len(x):
                assert abs(r["level_db"] - 20 * np.log10(np.sqrt(np.mean(x * x)) + 1e-12)) < 1e-6
        met, every = signal.call_blocks(calls, chunks)
        due = 0
        for f, a, b in spans:
            if f in (1, 2) and a is not None:
                a, b = (min(40 + 7 * f, max(0, int(np.floor(t * 10)))) for t in (a, b))
                due += 2 * ((b - 1) // block - a // block + 1) if b > a else 0
        assert met.count() == due and every.count() == len(got)
    assert set(rows(signal.silent_files(calls, chunks), "file_num", "n_calls")) == {(None, 1), (3, 1), (4, 1)}


def test_calls_without_audio_are_reported(spark):
    from eventloom.plans import analyses

    chunks = spark.createDataFrame([(1, 10, 1, 10, [1.0] * 20)], "exp int, channel int, file_num int, rate int, samples array<float>")
    det = spark.createDataFrame([(1, 1, 1, "a", 0.1, 0.5), (1, 2, 2, "b", 0.1, 0.5), (1, 2, 3, "c", 0.11, 0.5), (1, 1, 4, "d", 9.0, 9.5), (1, None, 5, "e", 1.0, 2.0)], "exp int, file_num int, call_id int, label string, onset_s double, offset_s double")
    out = analyses.source_assignment(det, chunks, {"arena_1": 10}, {10: "arena_1"})
    assert rows(out["calls"], "event_type", "assigned_location") == [("a", "arena_1"), ("b", None), ("e", None)]
    assert set(rows(out["silent_files"], "exp", "file_num", "n_calls")) == {(1, 2, 2), (1, None, 1)}


def _array_exchanges(df):
    """Shuffles of a plan that move arrays."""
    import re

    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [b for b in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", text) if re.search("samples|_mics|buf", b)]


def test_pairing_moves_samples_once(spark, tmp_path):
    """One exchange of arrays, none over a bucketed table, with the same result."""
    from eventloom.operators import signal

    data = [(e, c, f, 10, b, 5 * b, [float(c + i) for i in range(5)]) for e in (1, 2) for c in (1, 2, 3) for f in (1, 2) for b in range(3)]
    chunks = spark.createDataFrame(data, "exp int, channel int, file_num int, rate int, block int, first_idx long, samples array<float>")
    pairs = spark.createDataFrame([(1, "v", 1, 2), (1, "w", 1, 3), (2, "v", 2, 3), (2, "x", 2, 9)], "exp int, virtual_ch string, ch1 int, ch2 int")
    plain = signal.pair_average(chunks, pairs)
    spark.sql("DROP TABLE IF EXISTS blocks_of_test")
    try:
        stored = signal.pair_average(signal.save_blocks(chunks, "blocks_of_test", 4), pairs)
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            assert len(_array_exchanges(plain)) == 1 and len(_array_exchanges(stored)) == 0
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        got = sorted(map(tuple, plain.collect()), key=repr)
        assert got == sorted(map(tuple, stored.collect()), key=repr) and len(got) == 3 * 2 * 3 + 2
    finally:
        spark.sql("DROP TABLE IF EXISTS blocks_of_test")
