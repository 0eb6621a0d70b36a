"""Detections of one sound on several channels: greedy overlap groups, the loudest member, its place."""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions.levels import loudest
from .ordered import DAY_US, pieces


def _follow(window_us: int):
    """Rows sorted by (_seq, onset), each with its anchor, whether it starts a group, and the groups started in its piece so far."""

    def run(batches):
        piece = anchor = None
        no = 0
        for b in batches:
            out = []
            for p, carried, t in zip(b["_seq"].to_pylist(), b["_carried"].to_pylist(), b["_o"].to_pylist(), strict=True):
                if p != piece:
                    piece, anchor, no = p, carried, 0
                new = t is None or anchor is None or t - anchor > window_us
                no += new
                anchor = t if new and t is not None else anchor
                out.append((anchor, int(new), no))
            added = [pa.array([x[i] for x in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, "_anchor", "_start", "_no"])

    return run


def _followed(rows: DataFrame, order: Sequence[str], window_us: int) -> DataFrame:
    schema = StructType(list(rows.schema.fields))
    for c in ("_anchor", "_start", "_no"):
        schema = schema.add(c, "long")
    return rows.repartition("_seq").sortWithinPartitions("_seq", *order).mapInArrow(_follow(window_us), schema)


class Steps:
    """What a piece does to the anchor that is carried into it: a step function, built while onsets stream by in order.

    An anchor before the piece is passed by the first onset more than the window behind it, so all
    anchors between two such bounds go one way. Ways that meet in one anchor go on as one; each member
    keeps what its own count of groups differs by. An anchor that no onset passes stays. Bounds are
    as many as onsets lie within a window of the piece's first one.
    """

    def __init__(self, window_us: int):
        self.window, self.bounds, self.nulls, self.first = window_us, [], 0, None
        #: [anchor, groups, [(member, difference)]] of ways, by anchor
        self.ways: deque[list] = deque()

    def add(self, t: int | None) -> None:
        if t is None:
            self.nulls += 1
            return
        self.first = t if self.first is None else self.first
        moved, bound = [], t - self.window
        while self.ways and self.ways[0][0] < bound:
            moved.append(self.ways.popleft())
            moved[-1][1] += 1
        if not self.bounds or self.bounds[-1] < bound and self.bounds[-1] <= self.first:
            moved.append([t, 1, [(len(self.bounds), 0)]])
            self.bounds.append(bound)
        if moved:
            whole = max(moved, key=lambda way: len(way[2]))
            for way in moved:
                if way is not whole:
                    whole[2].extend((m, d + way[1] - whole[1]) for m, d in way[2])
            whole[0] = t
            self.ways.append(whole)

    def table(self) -> tuple[list[int], list[int], list[int], int]:
        """(bounds, last anchors, groups, nulls): the way of an anchor below the first bound, between bounds, and so on."""
        anchors, groups = [0] * len(self.bounds), [0] * len(self.bounds)
        for anchor, n, members in self.ways:
            for m, d in members:
                anchors[m], groups[m] = anchor, n + d + self.nulls
        keep = [i for i in range(len(anchors)) if i + 1 == len(anchors) or (anchors[i], groups[i]) != (anchors[i + 1], groups[i + 1])]
        return [self.bounds[i] for i in keep], [anchors[i] for i in keep], [groups[i] for i in keep], self.nulls


def _steps(window_us: int):
    """(_seq, bounds, anchors, groups, nulls) of each piece of rows sorted by (_seq, onset)."""

    def run(batches):
        def row(piece, steps, kind):
            values = (piece, *steps.table())
            kinds = (kind, *[pa.list_(pa.int64())] * 3, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["_seq", "_bounds", "_anchors", "_groups", "_nulls"])

        piece = steps = kind = None
        for b in batches:
            kind = b.schema.field("_seq").type
            for p, t in zip(b["_seq"].to_pylist(), b["_o"].to_pylist(), strict=True):
                if p != piece:
                    if steps:
                        yield row(piece, steps, kind)
                    piece, steps = p, Steps(window_us)
                steps.add(t)
        if steps:
            yield row(piece, steps, kind)

    return run


def _fold(keys: Sequence[str]):
    """(_seq, _carried, _before): the anchor carried into each piece and the groups before it, of step functions sorted by (keys, piece)."""

    def run(batches):
        key, anchor, before = None, None, 0
        for b in batches:
            out = []
            for p, bounds, anchors, groups, nulls in zip(*(b[c].to_pylist() for c in ("_seq", "_bounds", "_anchors", "_groups", "_nulls")), strict=True):
                own = tuple(p[k] for k in keys)
                if own != key:
                    key, anchor, before = own, None, 0
                out.append((anchor, before))
                at = 0 if anchor is None else bisect_right(bounds, anchor)
                if at < len(bounds):
                    anchor, nulls = anchors[at], groups[at]
                before += nulls
            yield pa.RecordBatch.from_arrays([b["_seq"], pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["_seq", "_carried", "_before"])

    return run


def overlap_groups(calls: DataFrame, *, window_us: int = 15_000, keys: Sequence[str] = ("exp", "file_num"), onset: str = "onset_us", ties: Sequence[str] = ("call_id",), step: int = DAY_US) -> DataFrame:
    """calls with group_no: in onset order the first free row is an anchor and takes every later row within window_us.

    Anchored, not chained. Sequences are cut into pieces of `step`. A first pass over the onsets makes
    of each piece a step function from the anchor carried in to the one carried out; these, a row a
    piece, are applied one after the other; a second pass streams rows through their piece with the
    anchor as only state. So an anchor may depend on all rows before it, and no pass is repeated.
    """
    cut = pieces(calls, keys, onset, step).withColumn("_o", F.col(onset).cast("long"))
    seq = StructType().add("_seq", cut.schema["_seq"].dataType)
    narrow = cut.select("_seq", "_o").repartition("_seq").sortWithinPartitions("_seq", "_o")
    ways = narrow.mapInArrow(_steps(window_us), StructType([*seq.fields, *[StructField(c, ArrayType(LongType())) for c in ("_bounds", "_anchors", "_groups")], StructField("_nulls", LongType())]))
    ways = ways.repartition(*[F.col(f"_seq.{k}") for k in keys]).sortWithinPartitions("_seq")
    carry = ways.mapInArrow(_fold(keys), StructType(list(seq.fields)).add("_carried", "long").add("_before", "long"))
    rows = _followed(cut.join(carry, "_seq", "left"), [onset, *ties], window_us)
    return rows.select(*calls.columns, (F.col("_before") + F.col("_no")).alias("group_no"))


def choose_loudest(grouped: DataFrame, levels: Sequence[str], *, keys: Sequence[str] = ("exp", "file_num"), order: Sequence[str] = ("onset_us", "call_id"), compat: bool = False, keep: Column | None = None) -> DataFrame:
    """grouped with is_chosen: the row with the highest sum of levels of its group, the first on ties.

    Groups whose levels are all null are dropped, but for rows for which keep holds. A row without any level can't win; with
    compat it counts as 0 and beats negative levels.
    """
    by = Window.partitionBy(*keys, "group_no")
    any_level = F.coalesce(*[F.col(c) for c in levels]).isNotNull()
    score = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in levels), F.lit(0.0))
    score = score if compat else F.when(any_level, score)
    ranked = grouped.withColumn("_score", score).withColumn("_any", F.max(any_level.cast("int")).over(by)).filter((F.col("_any") == 1) | F.coalesce(F.lit(False) if keep is None else keep, F.lit(False)))
    first = F.row_number().over(by.orderBy(F.col("_score").desc_nulls_last(), *order))
    return ranked.withColumn("is_chosen", first == 1).withColumn("group_size", F.count("*").over(by)).drop("_score", "_any")


def assign_location(calls: DataFrame, sources: dict[str, str]) -> DataFrame:
    """calls with assigned_location: the name of the loudest of its level columns {name: column}."""
    return calls.withColumn("assigned_location", loudest({k: F.col(c) for k, c in sources.items()}))


def sort_calls(calls: DataFrame, number: str = "file_number", onset: str = "onset_s", source_order: Sequence[str] = ("call_id",)) -> DataFrame:
    """Calls by numeric file number and onset, both nulls last, stable by the source's order."""
    return calls.orderBy(F.col(number).try_cast("long").asc_nulls_last(), F.col(onset).try_cast("double").asc_nulls_last(), *source_order)


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)


def call_table(calls: DataFrame, places: dict[int, str]) -> DataFrame:
    """The canonical call table of detections: renamed columns, duration where missing, probabilities and entropies passed on."""
    from ..functions.labels import channel_of

    length = F.col("offset_s").try_cast("double") - F.col("onset_s").try_cast("double")
    passed = [c for c in calls.columns if c.startswith("meanprob_") or c in ("mean_entropy", "mean_entropy_norm")]
    return calls.select(
        F.col("file_number").try_cast("long").alias("file_num"), F.col("label").alias("event_type"), F.col("onset_s").try_cast("double").alias("start_time_file_sec"), F.col("offset_s").try_cast("double").alias("stop_time_file_sec"),
        F.coalesce(_or_null(calls, "duration_s", "double"), length).alias("duration_sec"), F.col("assigned_location"), channel_of(F.col("assigned_location"), places).alias("assigned_channel"), *passed,
    )
