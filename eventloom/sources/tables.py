"""Readers of headered CSV tables, logs and file listings, with explicit schemas."""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.clock import list_literal, parsed_micros, trailing_number

SYNC = "timestamp string, video string"
#: File name patterns.
ANNOTATION_NAME = r"^.*?_(\d+)_file_(\d+)_annotations\.csv$"
MODERN_NAME, LEGACY_NAME = r"^channel_(\d+)_file_(\d+)\.\w+$", r"^channel_(\d+)_(\d+)\.\w+$"
LOG_NAME = r"^experiment_(\d+)_log_(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})\.txt$"
LOG_TIME, LOG_LINE = "yyyy-MM-dd_HH-mm-ss", r"^([^>]+)>(.*)$"
LOG_HEADER = "Time>Log for experiment number"


def _name() -> Column:
    return F.col("_metadata.file_name")


def _named(schema: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(schema)]


#: Bytes of a CSV file that are first read for its header.
HEAD_BYTES = 4096


def _header(read, size: int) -> tuple[str, ...]:
    """The names in the first record of a file; read(n) gives its first n bytes. Repeated names get .1, .2 behind them."""
    n, record = min(HEAD_BYTES, size), []
    while n:
        text = read(n).decode("utf-8-sig", errors="replace")
        records = csv.reader(io.StringIO(text, newline=""))
        record = next((r for r in records if r), [])
        # the record is whole if another one, or the end of the file, is behind it
        if n == size or next(records, None) is not None:
            break
        n = min(16 * n, size)
    names, seen = [], {}
    for name in (x.strip() for x in record):
        seen[name] = seen.get(name, -1) + 1
        names.append(f"{name}.{seen[name]}" if seen[name] else name)
    return tuple(names)


def headers(spark: SparkSession, path, glob: str = "*.csv", names: str | None = None) -> dict[tuple[str, ...], list[str]]:
    """The files under path by the names in their headers.

    As in listing, the driver does this: it opens each file by Spark's own file systems and reads its
    first bytes, several files at a time; nothing else of a file is read.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path).inputFiles()

    def head(uri: str):
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
        system = at.getFileSystem(conf)

        def read(n: int) -> bytes:
            stream = system.open(at)
            try:
                return jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)
            finally:
                stream.close()

        return at.toString(), _header(read, system.getFileStatus(at).getLen())

    wanted = [u for u in found if names is None or re.search(names, unquote(u.rsplit("/", 1)[-1]))]
    out: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(8) as pool:
        for file, header in pool.map(head, sorted(wanted)):
            if header:
                out.setdefault(header, []).append(file)
    return out


def csv_by_name(spark: SparkSession, path, schema: str, *, glob: str = "*.csv", required: Sequence[str] = (), names: str | None = None, others: Sequence[tuple[str, str]] = (), multi_line: bool = True) -> DataFrame:
    """Headered CSV files under path as one table: each file's columns go by its own header, in whatever order.

    schema lists names and types; a column that a file lacks is null there, and so is a value that isn't
    of the type, an empty one, and NaN. Files that lack a required column are left out whole, files of a name unlike
    the pattern `names` and empty ones too. others: (prefix, type) of further columns that headers may
    hold, '' for all. Records are those of RFC 4180: quoted values may hold commas, line ends and
    doubled quotes. Empty lines are skipped. Files of one header are one scan. A file with line ends in
    values can't be split, so a file is one task; multi_line=False splits files without such values.
    _path and _file tell where a row is from.
    """
    groups = {h: files for h, files in headers(spark, path, glob, names).items() if set(required) <= set(h)}
    known = _named(schema)
    further = sorted({n for h in groups for n in h} - set(dict(known)))
    known += [(n, next(t for p, t in others if n.startswith(p))) for n in further if any(n.startswith(p) for p, _ in others)]
    out = spark.createDataFrame([], StructType().add("_path", "string").add("_file", "string")).select(*[F.lit(None).cast(t).alias(n) for n, t in known], "_path", "_file")
    for header, files in groups.items():
        place = {n: i for i, n in enumerate(header)}
        scan = spark.read.schema(", ".join(f"c{i} string" for i in range(len(header)))).options(header=True, multiLine=multi_line, quote='"', escape='"', emptyValue="", nullValue="")
        rows = scan.csv([re.sub(r"([\\{}\[\]*?])", r"\\\1", f) for f in files])

        def cell(n: str, t: str) -> Column:
            if n not in place:
                return F.lit(None).cast(t)
            value = F.nullif(F.col(f"c{place[n]}"), F.lit("")).try_cast(t)
            return F.nanvl(value, F.lit(None).cast(t)) if t in ("double", "float") else value

        out = out.unionByName(rows.select(*[cell(n, t).alias(n) for n, t in known], F.col("_metadata.file_path").alias("_path"), _name().alias("_file")))
    return out


def csv_table(spark: SparkSession, path, schema: str, **options) -> DataFrame:
    """A headered CSV table with the columns of schema, which go by header name."""
    return csv_by_name(spark, path, schema, glob="*", **options).drop("_path", "_file")


def detections(spark: SparkSession, folder: str, columns: str, suffix: str = "_accepted_calls.csv", others: Sequence[tuple[str, str]] = (("meanprob_", "double"), ("mean_entropy", "double"), ("", "string"))) -> DataFrame:
    """All detection files of a folder with channel and file_number, the 2nd and 4th _-part of a file's stem ('' if missing).

    The table has the union of all files' columns: those of `columns`, and others by prefix and type; all others are strings.
    """
    rows = csv_by_name(spark, folder, columns, glob=f"*{suffix}", others=others)
    parts = F.split(F.regexp_replace("_file", r"\.csv$", ""), "_")
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in ("_path", "_file", "channel", "file_number")], F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("channel"), F.coalesce(F.try_element_at(parts, F.lit(4)), F.lit("")).alias("file_number"))


def union_by_name(tables: list[DataFrame]) -> DataFrame:
    """One table of several with different columns; missing ones are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Annotation files named by channel and file; other names, and files without name, start_seconds and stop_seconds, are skipped."""
    rows = csv_by_name(spark, folder, "name string, start_seconds double, stop_seconds double", glob="*_annotations.csv", required=("name", "start_seconds", "stop_seconds"), names=ANNOTATION_NAME)
    num = lambda g: F.regexp_extract("_file", ANNOTATION_NAME, g).cast("long")
    return rows.select("name", num(1).alias("channel"), num(2).alias("file_num"), "start_seconds", "stop_seconds", F.col("_file").alias("source_file"))


def target_annotations(rows: DataFrame, types: list[str]) -> DataFrame:
    """Annotations of the types with start and stop that are neither null nor 0."""
    return rows.filter(F.col("name").isin(types) & (F.col("start_seconds") != 0) & (F.col("stop_seconds") != 0))


def clean_annotations(rows: DataFrame, label: str = "vox") -> DataFrame:
    """Annotations of one label, channel set to -1; the columns name and channel are required."""
    if missing := {"name", "channel"} - set(rows.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return rows.filter(F.col("name") == label).withColumn("channel", F.lit(-1))


def real_events(rows: DataFrame, start: str = "start_seconds", stop: str = "stop_seconds") -> DataFrame:
    """Rows whose start and stop are numbers with stop > start > 0."""
    a, b = (F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")) for c in (start, stop))
    return rows.filter((b > a) & (a > 0))


def sync_columns(timestamp: Column, video: Column) -> list[Column]:
    """start_us, end_us and file_num of a sync row's two list literals."""
    times = list_literal(timestamp)
    return [parsed_micros(F.try_element_at(times, F.lit(1))).alias("start_us"), parsed_micros(F.try_element_at(times, F.lit(2))).alias("end_us"), trailing_number(list_literal(video)).cast("long").alias("file_num")]


def sync(spark: SparkSession, path: str) -> DataFrame:
    """(exp, row_pos, start_us, end_us, file_num) of sync files under folders named by experiment; row_pos is the line's place in its file."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path, wholetext=True)
    each = lines.select(F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)/[^/]*$", 1).try_cast("int").alias("exp"), F.posexplode(F.split("value", "\r?\n")).alias("row_pos", "line"))
    rows = each.filter((F.col("row_pos") > 0) & (F.trim("line") != "")).withColumn("c", F.from_csv("line", F.lit("timestamp string, video string"), {"quote": '"'}))
    return rows.select("exp", F.col("row_pos").cast("long").alias("row_pos"), *sync_columns(F.col("c.timestamp"), F.col("c.video")))


def log_columns(line: Column) -> tuple[Column, Column, Column]:
    """(log_us, log_text, parse_status) of a line; a matched line with a bad time is parsed with a null time."""
    ok = F.rlike(line, F.lit(LOG_LINE))
    return parsed_micros(F.when(ok, F.trim(F.regexp_extract(line, LOG_LINE, 1))), LOG_TIME), F.when(ok, F.trim(F.regexp_extract(line, LOG_LINE, 2))).otherwise(line), F.when(ok, "parsed").otherwise("unparsed")


def log_lines(text: DataFrame, text_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, line_number, log_us, log_text, parse_status) of whole log texts; blank and header lines are left out but counted."""
    each = text.select(*keep, F.posexplode(F.split(text_col, "\r?\n")).alias("_i", "line"))
    each = each.filter((F.trim("line") != "") & ~F.startswith("line", F.lit(LOG_HEADER)))
    at, said, status = log_columns(F.col("line"))
    return each.select(*keep, (F.col("_i") + 1).cast("long").alias("line_number"), at.alias("log_us"), said.alias("log_text"), status.alias("parse_status"))


def log_name_columns(name: Column) -> list[Column]:
    """exp and experiment_start_us of a log file's name; null for other names."""
    ok = F.rlike(name, F.lit(LOG_NAME))
    return [F.when(ok, F.regexp_extract(name, LOG_NAME, 1)).try_cast("int").alias("exp"), parsed_micros(F.when(ok, F.regexp_extract(name, LOG_NAME, 2)), LOG_TIME).alias("experiment_start_us")]


def log_order(*begin: str) -> list[Column]:
    """Order of log lines: by the columns that tell their file, by time with unknown times last, by line."""
    return [*[F.col(c) for c in begin], F.col("log_us").asc_nulls_last(), F.col("line_number")]


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """log_lines of all log files of a month folder, with exp and the start time of their names."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True).withColumn("source_log_file", _name())
    files = files.filter(F.rlike("source_log_file", F.lit(LOG_NAME)))
    rows = log_lines(files, keep=("source_log_file",))
    return rows.select("*", *log_name_columns(F.col("source_log_file"))).orderBy(*log_order("exp", "experiment_start_us"))


def log_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """(start_us, event_type 'log', note) of lines that hold both > and _; others and those with a bad time are dropped."""
    at, said, _ = log_columns(F.col(line))
    return lines.filter(F.contains(line, F.lit(">")) & F.contains(line, F.lit("_"))).select(*[c for c in lines.columns if c != line], at.alias("start_us"), F.lit("log").alias("event_type"), said.alias("note")).filter("start_us is not null")


def manifest_columns(path: Column) -> list[Column]:
    """name, exp (the folder), channel, file_num and scheme of a path; scheme is null for other names."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    pick = lambda g: F.coalesce(F.regexp_extract(name, MODERN_NAME, g).try_cast("int"), F.regexp_extract(name, LEGACY_NAME, g).try_cast("int"))
    scheme = F.when(F.rlike(name, F.lit(MODERN_NAME)), "modern").when(F.rlike(name, F.lit(LEGACY_NAME)), "legacy")
    return [name.alias("name"), F.regexp_extract(path, r"/(\d+)/(?:[^/]+/)*[^/]+$", 1).try_cast("int").alias("exp"), pick(1).alias("channel"), pick(2).alias("file_num"), scheme.alias("scheme")]


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("size"), *manifest_columns(F.col("path")))


def experiments(manifest_: DataFrame) -> DataFrame:
    """Distinct experiment ids of a listing, sorted."""
    return manifest_.filter("exp is not null").select("exp").distinct().orderBy("exp")


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Headered CSV under path, quotes doubled; one_file: a single file in that folder.

    Its parts are written in parallel beside the folder, then joined behind one header by the file
    system, in the order of the rows, and moved to their place: a write that fails leaves the old file.
    """
    options = {"quote": '"', "escape": '"', "quoteAll": False}
    if not one_file:
        df.write.mode("overwrite").options(header=True, **options).csv(path)
        return
    spark, mark = df.sparkSession, uuid.uuid4().hex
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    target = place(path)
    system = target.getFileSystem(conf)
    parts, new, old = (place(f"{path.rstrip('/')}.{kind}-{mark}") for kind in ("parts", "new", "old"))
    try:
        df.write.options(header=False, **options).csv(parts.toString())
        head = io.StringIO()
        csv.writer(head, lineterminator="\n").writerow(df.columns)
        out = system.create(place(new, "part-00000.csv"))
        try:
            out.write(bytearray(head.getvalue().encode()))
            for name in sorted(s.getPath().getName() for s in system.listStatus(parts) if s.getPath().getName().startswith("part-")):
                piece = system.open(place(parts, name))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(piece, out, 1 << 20, False)
                finally:
                    piece.close()
        finally:
            out.close()
        if system.exists(target):
            system.rename(target, old)
        if not system.rename(new, target):
            system.rename(old, target)
            raise OSError(f"{path} couldn't be replaced")
    finally:
        for leftover in (parts, new, old):
            system.delete(leftover, True)


def write_named(df: DataFrame, folder: str, name: str, order: Sequence[str] = ()) -> None:
    """A headered CSV file for each value of the column `name`, at <value>.csv under folder; a value may hold folders.

    The files are written in parallel, each by one task in the given order of rows, beside the folder,
    and then moved to their places, where files of their names are replaced; other files stay. Rows
    without a name are left out. The driver renames the files one by one, as it lists them.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path
    parts = place(f"{folder.rstrip('/')}.parts-{uuid.uuid4().hex}")
    system = parts.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = df.filter(F.col(name).isNotNull()).repartition(name).sortWithinPartitions(name, *order)
    try:
        rows.withColumnRenamed(name, "_name").write.partitionBy("_name").options(header=True, quote='"', escape='"').csv(parts.toString())
        for value in system.listStatus(parts):
            if value.isDirectory():
                target = place(place(folder), unquote(value.getPath().getName().removeprefix("_name=")) + ".csv")
                system.mkdirs(target.getParent())
                system.delete(target, False)
                system.rename(next(f.getPath() for f in system.listStatus(value.getPath())), target)
    finally:
        system.delete(parts, True)


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("variant", "exp")) -> None:
    """Parquet by partition columns; earlier contents go."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def gathered(spark: SparkSession, path: str, schema: str, glob: str = "*.csv", others: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """All feature files under a path as one table with the union of their columns, by name."""
    return csv_by_name(spark, path, schema, glob=glob, others=others).drop("_path", "_file")


def aligned(df: DataFrame, order: list[tuple[str, str]], rest: bool = True) -> DataFrame:
    """Columns in the given order of (name, type), missing ones null, the others behind or dropped."""
    have = set(df.columns)
    first = [F.col(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in order]
    return df.select(*first, *([F.col(c) for c in df.columns if c not in dict(order)] if rest else []))


def numeric_columns(df: DataFrame, without: tuple[str, ...] = (), least: int = 3) -> list[str]:
    """Sorted names of the numeric columns besides metadata."""
    from pyspark.sql.types import NumericType

    out = sorted(f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in without)
    if len(out) < least:
        raise ValueError(f"{len(out)} numeric columns, {least} are needed")
    return out


def match_audio(csvs: DataFrame, audio: DataFrame, preference: tuple[str, ...] = ("wav", "npz")) -> DataFrame:
    """csvs (name) with the path of the audio file of the same stem (without _annotations), by preference of extension; unmatched names are dropped."""
    stem = lambda c: F.regexp_replace(F.regexp_replace(c, r"\.\w+$", ""), r"_annotations$", "")
    ext = F.lower(F.regexp_extract("name", r"\.(\w+)$", 1))
    place = F.array_position(F.array(*[F.lit(p) for p in preference]), ext)
    best = audio.withColumn("stem", stem(F.col("name"))).withColumn("_p", place).filter("_p > 0").groupBy("stem").agg(F.min_by("path", F.struct("_p", "path")).alias("audio_path"))
    return csvs.withColumn("stem", stem(F.col("name"))).join(best, "stem")
