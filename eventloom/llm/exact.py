"""Exact dedup by deterministic block naming: equal texts get one integer identity, without hashing."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, group_facts, row_key, scratch, written

#: Characters of a block.
BLOCK = 8192
PART = 33


def named(rows: DataFrame, key: list[str], ids: list[str], first: list[str] | None = None) -> DataFrame:
    """(ids, name): name is a long that rows share if and only if they agree in every key column.

    A global sort by (key, ids): a key's rows may fill several partitions, so no task holds a hot key.
    Each task numbers the runs of equal keys it streams over. A key that goes on from one partition to
    the next would get two numbers there, so each task also gives the first and the last key it saw;
    there are two such rows a partition, from which later partitions learn their true first number.

    first: short columns that follow from the key, to deal the ranges by instead of a long key, whose
    samples would fill the driver. Rows are still told apart by the key itself.
    """
    spark = rows.sparkSession
    n_ids = len(ids)

    def number(batches):
        part = TaskContext.get().partitionId()
        run, before, edge = -1, None, None
        for b in batches:
            cols = [c.to_pylist() for c in b.columns[n_ids:]]
            names = []
            for k in zip(*cols, strict=True):
                if k != before:
                    if edge is None:
                        edge = k
                    run, before = run + 1, k
                names.append(part << PART | run)
            nulls = [pa.nulls(b.num_rows, b.schema.field(n_ids + i).type) for i in range(len(key))]
            yield pa.record_batch([*b.columns[:n_ids], pa.array(names, pa.int64()), *nulls, pa.nulls(b.num_rows, pa.int32())], names=[*ids, "name", *key, "edge"])
        if edge is not None:
            ends = list(zip(edge, before, strict=True))
            yield pa.record_batch([*[pa.nulls(2, kinds[i]) for i in ids], pa.array([part << PART, part << PART | run], pa.int64()), *[pa.array(v, kinds[c]) for c, v in zip(key, ends, strict=True)], pa.array([0, 1], pa.int32())], names=[*ids, "name", *key, "edge"])

    from pyspark.sql.pandas.types import to_arrow_schema

    first = first or key
    kinds = {f.name: f.type for f in to_arrow_schema(rows.schema)}
    spec = ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in ids], "name long", *[f"{c} {rows.schema[c].dataType.simpleString()}" for c in key], "edge int"])
    path = scratch(spark, "names")
    order = list(dict.fromkeys([*first, *key, *ids]))
    rows.repartitionByRange(*first, *ids).sortWithinPartitions(*order).select(*ids, *key).mapInArrow(number, spec).write.parquet(path)
    table = spark.read.schema(spec).parquet(path)
    # two rows a partition: bounded by the number of partitions
    ends = sorted(table.filter("edge is not null").select("name", "edge", *key).collect(), key=lambda r: (r["name"] >> PART, r["edge"]))
    moved: dict[int, int] = {}
    for (_, last), (head, _) in zip(zip(ends[::2], ends[1::2], strict=True), zip(ends[2::2], ends[3::2], strict=True), strict=False):
        if tuple(last[2:]) == tuple(head[2:]):
            moved[head["name"]] = moved.get(last["name"], last["name"])
    own = table.filter("edge is null").select(*ids, "name")
    if not moved:
        return own
    fix = F.broadcast(spark.createDataFrame(list(moved.items()), "name long, true_name long"))
    return own.join(fix, "name", "left").select(*ids, F.coalesce("true_name", "name").alias("name"))


def identities(docs: DataFrame, *, id_col: str, text_col: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, rk, chars, blocks, text_sha256), and (doc_id, rk, blocks, name) of each distinct row.

    A normalised text is cut into blocks of `block` characters; equal blocks get one integer by
    sorting (by two hashes of a block, then the block: unequal blocks never share an integer), then adjacent pairs of integers, level by level, until one is left. Texts of as many
    blocks go through the same levels, so (blocks, name) is equal exactly for equal texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("rk"), F.char_length(text).cast("long").alias("chars"), F.regexp_replace(text, f"{SPACE}+", "").alias("t"))
    blocks = F.greatest(F.lit(1), F.ceil(F.char_length("t") / block)).cast("int")
    meta = written(rows.select("doc_id", "rk", "chars", blocks.alias("blocks"), F.sha2("t", 256).alias("text_sha256")), "texts")
    ids = ["doc_id", "rk", "blocks", "at"]
    cut = rows.select("doc_id", "rk", blocks.alias("blocks"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("at"), "t")
    cut = cut.select(*ids, F.substring("t", F.col("at") * block + 1, F.lit(block)).alias("b"))
    names = named(cut.withColumns({"h1": F.xxhash64("b"), "h2": F.xxhash64(F.lit(1), "b")}), ["b"], ids, ["h1", "h2"])
    most = meta.agg(F.max("blocks")).first()[0] or 1
    done = names.filter("blocks = 1").select("doc_id", "rk", "blocks", "name")
    width = 1
    while width < most:
        left, right = (F.max(F.when(F.col("at") % 2 == i, F.col("name"))).alias(c) for i, c in enumerate("lr"))
        pairs = names.filter(F.col("blocks") > width).groupBy("doc_id", "rk", "blocks", F.floor(F.col("at") / 2).cast("int").alias("at")).agg(left, right)
        names = named(pairs, ["l", "r"], ids)
        width *= 2
        done = done.unionByName(names.filter((F.col("blocks") > width // 2) & (F.col("blocks") <= width)).select("doc_id", "rk", "blocks", "name"))
    return meta, done.distinct()


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Texts are equal when they are once all white space (space, \\t to \\r) is deleted; null counts as
    empty, so null, empty and blank texts are one group. Of a group the row with the most code
    points stays, then the smallest id (a null id only in a group that has no other). Rows
    that repeat the id of the kept row and its length are kept too and counted each. Ids are of any type that has an order. An empty table gives no
    rows; other columns are ignored.
    """
    meta, done = identities(docs, id_col=id_col, text_col=text_col, block=block)
    same = meta["doc_id"].eqNullSafe(done["doc_id"]) & (meta["rk"] == done["rk"])
    rows = meta.join(done, same).select(meta["doc_id"], meta["rk"], "chars", meta["blocks"], "name", "text_sha256")
    best = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"))
    out = group_facts(rows, ["blocks", "name"], [F.col("doc_id"), F.col("rk")], [F.count("*").alias("n"), F.min(best).alias("best")], [F.sum("n").alias("group_size"), F.min("best").alias("best")])
    keep = F.col("best.id")
    return out.select("doc_id", keep.alias("keep_id"), "group_size", (F.col("doc_id").eqNullSafe(keep) & (F.col("chars") == -F.col("best.less"))).alias("kept"), "text_sha256")
