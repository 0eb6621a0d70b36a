"""A corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing to target weights, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as
the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, langid, lines, mixing, simhash
from eventloom.llm.common import discard, disposable, keep, row_key, written
from eventloom.llm.queries import tokenizer_path
from eventloom.session import ship

#: A document is rejected by language ID if no language is found in it, or if its score is under this part of what its language's documents usually have.
LEAST_SHARE = 0.3
#: Near duplicates: word shingles, and the least share of them in common.
SHINGLE, SIMILARITY = 5, 0.8


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and lang of docs, and all other columns in one, _rest: no stage meets names that it uses itself."""
    own = [c for c in ("doc_id", "text", "lang") if c in docs.columns]
    return docs.select(*own, F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in own]).alias("_rest"))


def unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of docs, in order, of rows that came from packed(); new ones of some."""
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) if c in ("doc_id", "text", "lang") else F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; und and such of a score under LEAST_SHARE of the language's usual one go.

    The model is trained on docs' own labels. What scores are usual is told by a quarter of docs, judged
    by a model of the other three, so that it doesn't depend on what a model has seen.
    Null and empty texts are und; documents without a label are judged like any other; an empty table
    gives no rows; all columns stay.
    """
    ship(spark)
    model = langid.train(docs)
    seen = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    usual = langid.usual_scores(docs.filter(langid.held_out(F.col("doc_id"))), seen)
    least = F.lit(LEAST_SHARE)
    for name, score in usual.items():
        least = F.when(F.col("lang_pred") == name, F.lit(LEAST_SHARE * score)).otherwise(least)
    return unpacked(langid.identify(packed(docs), model).filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= least)), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that ten documents or more share, the first occurrence stays; documents of which nothing but white space is left go.

    Documents that lose no line stay as they are, null and empty texts too; rows that agree in id and
    text lose the same lines; an empty table gives no rows; all columns stay, n_chars is brought up to date.
    """
    ship(spark)
    kept = lines.drop_lines(packed(docs), min_docs=10, min_chars=1, keep_first=True)
    rest = kept.filter((F.col("n_dropped") == 0) | F.rlike("kept", F.lit(r"[^\x20\x09-\x0D]")))
    return unpacked(rest, docs.columns, text=F.col("kept"), n_chars=F.char_length("kept").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by id, of each group of near duplicates; rows that agree in id and text are one document, null ids come last.

    Null, empty and blank texts are one group. An empty table gives no rows; all columns stay.
    """
    ship(spark)
    groups = simhash.similar_groups(docs.select("doc_id", "text"), words=SHINGLE, similarity=SIMILARITY)
    gone = groups.filter("not stays").select(F.col("doc_id").alias("_d"), F.col("rk").alias("_k")).distinct()
    rows = packed(docs)
    return unpacked(rows.join(gone, (row_key(rows["doc_id"], rows["text"]) == gone["_k"]) & rows["doc_id"].eqNullSafe(gone["_d"]), "left_anti"), docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes as often as the mix reads it, rounded to whole documents.

    Documents without words stay once; a null source is a source; repeated rows are documents of their
    own; an empty table gives no rows; all columns stay, whatever their names.
    """
    # names that differ by case only would be ambiguous as fields
    rows = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_row"))
    taken = mixing.mix(rows, keep=("_row",))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int")
    return taken.select("_row", copies.alias("n")).filter("n > 0").select(F.explode(F.array_repeat("_row", F.col("n"))).alias("_row")).select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the encoded and decoded texts, a row a document as mixed; null texts are empty, an empty table gives no rows."""
    ship(spark)
    return bpe.digests(docs, tokenizer_path())


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("mixing", mixed), ("BPE", tokens)]

#: SQL can't express fingerprints, trained filters or merges; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again, its own scratch tables deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with disposable(spark):
            before, docs = docs, written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
            keep(docs)
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
