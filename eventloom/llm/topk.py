"""Exact top-k search by inner product: tiled matrix products, selection per tile, tree merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one tile's sides. With 64 components a side is 8 MB as 64-bit integers.
QUERY_ROWS, SHARD_ROWS = 32768, 8192
#: Product cells held at once, and lists that one merge step reads for a query.
CELLS, FAN_IN = 4_000_000, 64
TILE = "query_id long, shard int, vec_id long, score long"
LONG = np.iinfo(np.int64)


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, or null if the vector is null or a component isn't finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = pa.concat_arrays(column.chunks)
    ends, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))), dtype=np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat[ends[0] : ends[-1]]
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows; beyond 64 bits a score stops at the limit of a long."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    top = width * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if top < 2**53:
        kind = np.float32 if top < 2**24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -LONG.max, LONG.max).astype(np.int64)


def _tile(k: int):
    def best(queries: pa.Table, shard: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and shard.num_rows:
            ids = np.asarray(shard["vec_id"].combine_chunks())
            by_id = np.argsort(ids, kind="stable")
            ids, right = ids[by_id], _matrix(shard["v"])[by_id]
            qids, left = np.asarray(queries["query_id"].combine_chunks()), _matrix(queries["v"])
            step = max(1, CELLS // len(ids))
            for at in range(0, len(qids), step):
                q = qids[at : at + step]
                score = _products(left[at : at + step], right)
                own = q[:, None] == ids[None, :]
                # the k-th best score of the row; everything above it and, by id, of its ties
                spare = score.copy()
                spare[own] = LONG.min
                n = min(k, len(ids))
                floor_ = np.partition(spare, len(ids) - n, axis=1)[:, len(ids) - n]
                row, col = np.nonzero((spare >= floor_[:, None]) & ~own)
                order = np.lexsort((ids[col], -score[row, col], row))
                row, col = row[order], col[order]
                first = np.searchsorted(row, row)
                keep = np.arange(len(row)) - first < k
                row, col = row[keep], col[keep]
                found.append((q[row], ids[col], score[row, col]))
        q, c, s = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3))
        n = shard["shard"][0].as_py() if shard.num_rows else 0
        return pa.table({"query_id": q, "shard": pa.array(np.full(len(q), n), pa.int32()), "vec_id": c, "score": s})

    return best


def top_k(vectors: DataFrame, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", is_query: Column | None = None, query_rows: int = QUERY_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k candidates with the highest integer inner product for each query vector.

    Components become floor(256 * x). Queries are the rows that is_query selects (by default ids
    divisible by 50); candidates are all rows but the query's own. Both sides are dealt into blocks
    of bounded size by a hash of the id, each pair of blocks is one matrix product in one task, a tile
    returns at most k rows a query, and lists are merged FAN_IN at a time.

    Null ids, null vectors and vectors holding null or non-finite components take no part. Shorter
    vectors count as padded with zeros. Rows repeating an id are candidates each, never of their own
    id; a repeated query id asks once, with its smallest vector. Ties go to the smaller id. An empty
    table gives no rows; columns besides id and vector are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("v")).filter("vec_id is not null and v is not null")
    chosen = is_query if is_query is not None else F.pmod(F.col("vec_id"), F.lit(50)) == 0
    asked = rows.filter(chosen).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    n_rows, n_asked = rows.agg(F.count("*"), F.count_if(chosen)).first()
    shards, blocks = max(1, -(-n_rows // shard_rows)), max(1, -(-n_asked // query_rows))
    right = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    left = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "v")
    tiles = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_tile(k), TILE)
    best, lists = tiles, shards
    while True:
        lists = -(-lists // FAN_IN)
        best = best.withColumn("shard", (F.col("shard") / FAN_IN).cast("int"))
        w = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
        best = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        if lists == 1:
            return best.select("query_id", "rank", "vec_id", "score")
        best = best.drop("rank")
