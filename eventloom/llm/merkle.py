"""Merkle manifest of a dataset: digest trees in aligned blocks, each in van Emde Boas order.

Leaves are ordered rows; blocks of 2**height leaves become one subtree each, its nodes laid out by
splitting the subtree at half its height again and again. The roots of blocks are the leaves of the
next round, until a group has one node; the groups' roots make one more tree in the same way.
"""

from __future__ import annotations

import binascii
import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Levels from the leaves of a block to its root.
HEIGHT = 10
#: Groups and range partitions up to which their table is broadcast; it is counted before.
BROADCAST_ROWS = 100_000
#: Sides of a proof's steps: a node without a sibling, a sibling to the right, a sibling to the left.
ALONE, RIGHT, LEFT = 0, 1, 2


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Hex SHA-256 of the columns: '-' for null, else byte count, ':' and the value as text."""
    def one(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(one, columns)), 256)


def parent(children: Sequence[bytes]) -> bytes:
    """Digest of one or two nodes' digests as hex text."""
    return hashlib.sha256(b"".join(map(binascii.hexlify, children))).digest()


def levels_of(n: int, height: int) -> int:
    """Levels of the blocks of a sequence of n nodes, leaves included."""
    return 1 + min(height, (n - 1).bit_length())


def address(levels: int, depth: int, index):
    """Place of the index-th node (a number or an array) at a depth of a tree of so many levels.

    The upper half of the levels comes first, then the subtrees below it from left to right, each laid
    out in the same way.
    """
    base = 0 * index
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below = index >> (depth - top)
        base = base + (1 << top) - 1 + below * ((1 << (levels - top)) - 1)
        index = index - (below << (depth - top))
        depth, levels = depth - top, levels - top
    return base


def fill(nodes: bytearray, leaves: Sequence[bytes], levels: int, base: int = 0) -> bytes:
    """Writes the tree over the leaves into nodes from place base on; its root."""
    if levels == 1:
        nodes[32 * base : 32 * base + 32] = leaves[0]
        return leaves[0]
    top = levels // 2
    width, below = 1 << (levels - top - 1), (1 << (levels - top)) - 1
    at = base + (1 << top) - 1
    roots = [fill(nodes, leaves[i : i + width], levels - top, at + i // width * below) for i in range(0, len(leaves), width)]
    return fill(nodes, [parent(roots[i : i + 2]) for i in range(0, len(roots), 2)], top, base)


def siblings(nodes, n: int, levels: int, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sides, digests) of the siblings of leaves of a block of n leaves, from the bottom up: arrays of a row a leaf."""
    table = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
    sides, digests = np.zeros((len(index), levels - 1), np.int8), np.zeros((len(index), levels - 1, 32), np.uint8)
    for k in range(levels - 1):
        other, there = (index >> k) ^ 1, -(-n >> k)
        has = other < there
        sides[:, k] = np.where(has, np.where(other & 1, RIGHT, LEFT), ALONE)
        digests[has, k] = table[address(levels, levels - 1 - k, other[has])]
    return sides, digests


@dataclass
class Manifest:
    """Tables of a dataset's digest trees.

    leaves: (gid, pos, n, leaf, row): a group's number, the place in it, the group's size, the digest
    and the kept columns. rounds and top: block tables (gid, block, n, nodes, root), from the leaves
    up, of the groups' trees and of the tree over their roots (gid 0, a leaf for each group by its gid).
    """

    leaves: DataFrame
    rounds: list[DataFrame]
    top: list[DataFrame]
    height: int


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def ranked(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """rows, written, with _pos: the place in the order of by, from 0.

    Rows are range-partitioned and sorted; a table with a row a partition carries the places over.
    """
    placed = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), name)
    parts = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = written(parts.select("_part", before.alias("_before")), name + "-parts")
    both = placed.join(_few(parts), F.shiftright("_at", 33) == F.col("_part"))
    return both.withColumn("_pos", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """(gid, block, n, nodes, root) of (gid, pos, n, digest)."""

    def run(batches):
        key, size, held = None, 0, []

        def block():
            levels = levels_of(size, height)
            nodes = bytearray(32 * ((1 << levels) - 1))
            root = fill(nodes, held, levels)
            return pa.record_batch([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([size], pa.int64()), pa.array([bytes(nodes)], pa.binary()), pa.array([root], pa.binary())], names=["gid", "block", "n", "nodes", "root"])

        for b in batches:
            for gid, at, n, digest in zip(*(b[c].to_pylist() for c in ("gid", "block", "n", "digest")), strict=True):
                if (gid, at) != key:
                    if held:
                        yield block()
                    key, size, held = (gid, at), n, []
                held.append(digest)
        if held:
            yield block()

    dealt = nodes.withColumn("block", F.shiftright("pos", height)).repartition("gid", "block").sortWithinPartitions("gid", "block", "pos")
    return dealt.select("gid", "block", "n", "digest").mapInArrow(run, "gid long, block long, n long, nodes binary, root binary")


def _trees(nodes: DataFrame, height: int, name: str) -> list[DataFrame]:
    """Block tables from the bottom up, until every group has a single node."""
    rounds = []
    while True:
        rounds.append(written(_blocks(nodes, height), name))
        nodes = rounds[-1].filter(F.col("n") > 1 << height).select("gid", F.col("block").alias("pos"), F.ceil(F.col("n") / (1 << height)).alias("n"), F.col("root").alias("digest"))
        if nodes.isEmpty():
            return rounds


def build(docs: DataFrame, *, fields: Sequence[str | Column], group_col: str = "lang", id_col: str = "doc_id", keep: dict[str, Column] | None = None, height: int = HEIGHT) -> Manifest:
    """Digest trees of docs: a leaf a row over the fields, a tree for each group by ascending id, a tree over the groups' roots.

    Groups ascend, null first (strings by their UTF-8 bytes). In a group null ids come first, and rows of
    one id go by their digests, so repeated rows are leaves of their own and reruns agree. keep: columns
    that the leaves table carries. An empty table has no leaves and no root. Other columns, whatever
    their names, are not read. A group with most of the rows is as many tasks as its blocks.
    """
    leaf = F.unhex(leaf_digest([F.col(f) if isinstance(f, str) else f for f in fields]))
    row = F.struct(*[c.alias(k) for k, c in (keep or {id_col: F.col(id_col)}).items()])
    hashed = written(docs.select(F.col(group_col).alias("_group"), F.col(id_col).alias("_id"), leaf.alias("_leaf"), row.alias("_row")), "leaves")
    rows = ranked(hashed, ["_group", "_id", "_leaf"], "leaves-ranked")
    groups = rows.groupBy("_group").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    groups = ranked(written(groups, "groups"), ["_first"], "groups-ranked").select(F.col("_group").alias("_g"), "_first", "_n", F.col("_pos").alias("_gid"))
    leaves = rows.join(_few(groups), F.col("_group").eqNullSafe(F.col("_g")))
    leaves = written(leaves.select(F.col("_gid").alias("gid"), (F.col("_pos") - F.col("_first")).alias("pos"), F.col("_n").alias("n"), F.col("_leaf").alias("leaf"), F.col("_row").alias("row")), "leaves-placed")
    rounds = _trees(leaves.select("gid", "pos", "n", F.col("leaf").alias("digest")), height, "blocks")
    roots = subroots(rounds, height)
    top = _trees(roots.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("pos"), F.lit(roots.count()).cast("long").alias("n"), F.col("subroot").alias("digest")), height, "top-blocks")
    return Manifest(leaves, rounds, top, height)


def save(manifest: Manifest, path: str) -> None:
    """Writes a manifest's tables under path; nothing may be there yet."""
    tables = {"leaves": manifest.leaves} | {f"round-{i}": t for i, t in enumerate(manifest.rounds)} | {f"top-{i}": t for i, t in enumerate(manifest.top)}
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
    facts = manifest.leaves.sparkSession.createDataFrame([(manifest.height, len(manifest.rounds), len(manifest.top))], "height int, rounds int, top int")
    facts.coalesce(1).write.json(f"{path}/facts")  # one row, written last: with it the manifest is whole


def load(spark: SparkSession, path: str) -> Manifest:
    """A manifest that save() has written."""
    height, rounds, top = spark.read.schema("height int, rounds int, top int").json(f"{path}/facts").first()
    return Manifest(spark.read.parquet(f"{path}/leaves"), [spark.read.parquet(f"{path}/round-{i}") for i in range(rounds)], [spark.read.parquet(f"{path}/top-{i}") for i in range(top)], height)


def subroots(rounds: Sequence[DataFrame], height: int) -> DataFrame:
    """(gid, subroot) of the groups whose trees these blocks are."""
    done = [b.filter(F.col("n") <= 1 << height).select("gid", F.col("root").alias("subroot")) for b in rounds]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _steps(blocks: DataFrame, requests: DataFrame | None, height: int, out: str) -> DataFrame:
    """Proofs of leaves of blocks (gid, block, n, nodes, above, subroot, root).

    requests: (gid, block, pos, row); without any, all leaves of each block. A block comes before its
    requests, which stream; above is what the block's own root has on its way to the top.
    """
    step = pa.list_(pa.struct([("side", pa.int8()), ("sibling", pa.string())]))

    def proofs(block, index):
        n, nodes, (sides_above, digests_above) = block
        levels = levels_of(n, height)
        here = min(1 << height, n - (int(index[0]) >> height << height)) if len(index) else 0
        sides, digests = siblings(nodes, here, levels, index & ((1 << height) - 1))
        k = len(index)
        sides = np.concatenate([sides, np.repeat(sides_above[None], k, 0)], axis=1)
        digests = np.concatenate([digests, np.repeat(digests_above[None], k, 0)], axis=1)
        text, size = binascii.hexlify(digests.tobytes()), sides.shape[1]
        values = pa.StringArray.from_buffers(k * size, pa.py_buffer(np.arange(k * size + 1, dtype=np.int32) * 64), pa.py_buffer(text))
        steps = pa.StructArray.from_arrays([pa.array(sides.ravel()), values], ["side", "sibling"])
        return pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * size), steps).cast(step)

    def read(b, i):
        raw = b["above"][i].as_py()
        sides = np.array([s["side"] for s in raw], np.int8)
        digests = np.frombuffer(binascii.unhexlify("".join(s["sibling"] for s in raw)), np.uint8).reshape(-1, 32)
        return b["n"][i].as_py(), b["nodes"][i].as_py(), (sides, digests)

    def lay(gid, pos, proof, subroot, root, row=None):
        n = len(pos)
        return pa.record_batch([pa.array(np.full(n, gid), pa.int64()), pa.array(pos, pa.int64()), proof, pa.array([subroot] * n, pa.binary()), pa.array([root] * n, pa.binary()), *([row] if row is not None else [])], names=["gid", "pos", "proof", "subroot", "root", *(["row"] if row is not None else [])])

    def every(batches):
        for b in batches:
            for i in range(b.num_rows):
                block = read(b, i)
                first = b["block"][i].as_py() << height
                pos = np.arange(first, min(first + (1 << height), block[0]))
                yield lay(b["gid"][i].as_py(), pos, proofs(block, pos), b["subroot"][i].as_py(), b["root"][i].as_py())

    def asked(batches):
        block = gid = subroot = root = None
        for b in batches:
            starts = np.flatnonzero(b["nodes"].is_valid().to_numpy(zero_copy_only=False))
            for start, end in zip([-1, *starts], [*starts, b.num_rows], strict=True):
                if start >= 0:
                    block, gid, subroot, root = read(b, start), *(b[c][start].as_py() for c in ("gid", "subroot", "root"))
                if start + 1 < end:
                    some = b.slice(start + 1, end - start - 1)
                    pos = some["pos"].to_numpy()
                    yield lay(gid, pos, proofs(block, pos), subroot, root, some["row"])

    if requests is None:
        return blocks.mapInArrow(every, out)
    both = blocks.unionByName(requests, allowMissingColumns=True)
    dealt = both.repartition("gid", "block").sortWithinPartitions("gid", "block", F.col("nodes").isNull(), "pos")
    return dealt.mapInArrow(asked, out)


_PROOF = "array<struct<side: tinyint, sibling: string>>"
_STEPS = f"gid long, pos long, proof {_PROOF}, subroot binary, root binary"


def prove(manifest: Manifest) -> DataFrame:
    """(gid, pos, leaf, row columns, proof, subroot, root) of every leaf: the steps from the leaf to the root.

    From the top down, each block learns the steps of its own root; then its leaves' steps follow from
    its nodes by address arithmetic. Digests are hex text. A step's side is ALONE (no sibling: 64
    zeros stand there), RIGHT or LEFT. Repeated rows have proofs of their own; no leaves, no rows.
    """
    h = manifest.height

    def descend(rounds: list[DataFrame], begin: DataFrame) -> DataFrame:
        """Lowest blocks with above, subroot and root; begin: (gid, proof, subroot, root) of the trees' roots."""
        above = None
        for r in reversed(range(len(rounds))):
            start = rounds[r].filter(F.col("n") <= 1 << h).select("gid", "block").join(begin, "gid").select("gid", "block", "proof", "subroot", "root")
            above = start if above is None else start.unionByName(above.select("gid", F.col("pos").alias("block"), "proof", "subroot", "root"))
            blocks = rounds[r].select("gid", "block", "n", "nodes").join(above.withColumnRenamed("proof", "above"), ["gid", "block"])
            if r:
                above = written(_steps(blocks, None, h, _STEPS), "proofs")
        return blocks

    none = F.array().cast(_PROOF)
    root = subroots(manifest.top, h).select("gid", none.alias("proof"), F.lit(None).cast("binary").alias("subroot"), F.col("subroot").alias("root"))
    tops = _steps(descend(manifest.top, root), None, h, _STEPS).select(F.col("pos").alias("gid"), "proof", "root")
    tops = written(tops.join(subroots(manifest.rounds, h), "gid"), "proofs")
    row = manifest.leaves.schema["row"].dataType
    requests = manifest.leaves.select("gid", F.shiftright("pos", h).alias("block"), "pos", F.struct("leaf", "row").alias("row"))
    proved = _steps(descend(manifest.rounds, tops), requests, h, f"{_STEPS}, row struct<leaf: binary, row: {row.simpleString()}>")
    hexed = lambda c: F.lower(F.hex(c)).alias(c.split(".")[-1])
    return proved.select("gid", "pos", hexed("row.leaf"), "row.row.*", "proof", hexed("subroot"), hexed("root"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest (hex) and the steps of a proof lead to."""
    def step(digest: Column, s: Column) -> Column:
        return F.sha2(F.when(s["side"] == RIGHT, F.concat(digest, s["sibling"])).when(s["side"] == LEFT, F.concat(s["sibling"], digest)).otherwise(digest), 256)

    return F.aggregate(proof, leaf, step)


def proof_digest(proof: Column) -> Column:
    """Hex SHA-256 of a proof's siblings from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(F.filter(proof, lambda s: s["side"] != ALONE), lambda s: s["sibling"]), ""), 256)
