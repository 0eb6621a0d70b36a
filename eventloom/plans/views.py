"""How the star-schema tables are viewed as calls, chunks, signals and spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import micros
from ..operators.ordered import DAY_US, running_sum

ORDER = ("click", "error", "purchase", "signup", "view")
PLACES = {10: "arena", 20: "arena", 30: "underground"}
BANDS = (("right", None, 600.0), ("mid", 600.0, 7200.0), ("left", 7200.0, 86400.0))
LIGHT = (8, 20)
FOLDERS = ("f0", "f1", "f2", "f3")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as calls: exp = user_id % 10, channel 10, 20 or 30, length value seconds."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("call_id"), (F.col("user_id") % 10).alias("exp"), (10 * (1 + F.col("event_id") % 3)).alias("channel"), "event_type", micros(F.col("ts")).alias("start_us"), "value", "user_id")
    return rows.withColumn("stop_us", F.col("start_us") + F.round(F.col("value") * 1e6).cast("long"))


def sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as chunks: exp = key % 10, -1 to 5 minutes long, so that some lengths aren't positive."""
    o = table(spark, sf_dir, "orders")
    rows = o.select((F.col("o_orderkey") % 10).alias("exp"), F.col("o_orderkey").alias("row_pos"), F.col("o_orderkey").alias("file_num"), micros(F.col("o_orderdate")).alias("start_us"))
    return rows.withColumn("end_us", F.col("start_us") + (F.col("row_pos") % 7 - 1) * 60_000_000)


def file_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as calls on a file clock: file = order (seventh lines: a file that isn't there), start = line number, length = quantity, in seconds."""
    x = table(spark, sf_dir, "lineitem")
    start = F.col("l_linenumber").cast("long") * 1_000_000
    return x.select((F.col("l_orderkey") % 10).alias("exp"), F.when(F.col("l_linenumber") == 7, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("file_num"), "l_linenumber", "l_partkey", start.alias("start_file_us"), (start + F.round(F.col("l_quantity") * 1e6).cast("long")).alias("stop_file_us"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.value as one signal a user: (file, idx, value)."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), micros(F.col("ts")).alias("_t"), "event_id", "value")
    rows = running_sum(e, ["file"], ["_t", "event_id"], {"_no": F.lit(1)}, step=30 * DAY_US)
    return rows.select("file", (F.col("_no") - 1).alias("idx"), "value")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as spectra: a vector is a frame of its label, bins 100 Hz apart, magnitudes absolute values."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("label").cast("string").alias("seg_id"), F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("bin", "x"))
    return rows.select("seg_id", "frame", "bin", (F.col("bin") * 100.0).alias("freq_hz"), F.abs(F.col("x").cast("double")).alias("mag"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as audio chunks of two microphones: (exp, channel, file_num, rate, samples); every 11th is of another rate, every 17th second microphone has another number."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(((F.col("vec_id") / 2).cast("long") % 5).alias("exp"), F.when((F.col("vec_id") / 2).cast("long") % 17 != 3, F.col("vec_id") % 2 + 1).otherwise(2 * (F.col("vec_id") % 2) + 1).cast("int").alias("channel"), (F.col("vec_id") / 2).cast("long").alias("file_num"), F.when(F.col("vec_id") % 11 == 0, 100).otherwise(64).alias("rate"), F.col("embedding").alias("samples"))
