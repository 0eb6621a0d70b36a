"""Mixing sources to target weights: membership patterns, a min-cost flow, seeded selection."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: Bound on what reaches the driver: rows of (membership pattern, words, documents).
MAX_PATTERNS = 100_000


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, total_share: float, ceiling: int) -> dict:
    """Words that each source is due: shares by weight, cut at ceiling * size, the excess shared again.

    Sources in the order of cap / weight fill up first; the rest get one common level times their weight.
    """
    caps = {s: ceiling * n for s, n in sizes.items()}
    due, weight = total_share * sum(sizes.values()), sum(weights[s] for s in sizes)
    full, level = 0, 0.0
    for s in sorted(sizes, key=lambda s: (caps[s] / weights[s], str(s))):
        level = (due - full) / weight
        if caps[s] / weights[s] > level:
            break
        full, weight = full + caps[s], weight - weights[s]
        level = float("inf") if not weight else level
    return {s: float(min(caps[s], level * weights[s])) for s in sizes}


def _place(name) -> tuple:
    return name is None, name or ""


def route(patterns: dict, quotas: dict, ceiling: int) -> dict:
    """Min-cost flow of words from patterns to sources: {(pattern, source): words}.

    The r-th copy of a pattern's words costs r: repetition costs are convex, so words are read once
    before any is read again. Only these edges cost anything, so a cost level is a maximum flow over
    what the levels before it left: for each copy, shortest augmenting paths are blocked a whole
    distance at a time. Patterns are taken in the order of their sources, so that reruns agree.
    """
    order = sorted(patterns, key=lambda p: [_place(s) for s in p])
    names = list(quotas)
    at = {s: i for i, s in enumerate(names)}
    to = [[at[s] for s in p if s in at] for p in order]
    flow = [[0] * len(t) for t in to]
    back: list[list[tuple[int, int]]] = [[] for _ in names]
    for i, t in enumerate(to):
        for k, s in enumerate(t):
            back[s].append((i, k))
    left, due = [0] * len(order), [quotas[s] for s in names]

    def distances() -> tuple[list[int], list[int]] | None:
        """Steps from patterns with words left to patterns and to sources; None if no source with room is reached."""
        of_p, of_s = [-1 if not n else 0 for n in left], [-1] * len(names)
        front = [i for i, n in enumerate(left) if n]
        step = 0
        while front:
            reached = []
            for i in front:
                for s in to[i]:
                    if of_s[s] < 0:
                        of_s[s] = step + 1
                        reached.append(s)
            if any(due[s] for s in reached):
                return of_p, of_s
            front, step = [], step + 2
            for s in reached:
                for i, k in back[s]:
                    if of_p[i] < 0 and flow[i][k]:
                        of_p[i] = step
                        front.append(i)
        return None

    def block(of_p: list[int], of_s: list[int]) -> None:
        """Fills shortest paths until none of their length is left; every edge is given up once."""
        edge, turn = [0] * len(order), [0] * len(names)
        for root in range(len(order)):
            path = [(root, 0)]
            while left[root] and path:
                i, _ = path[-1]
                while edge[i] < len(to[i]):
                    s = to[i][edge[i]]
                    if of_s[s] == of_p[i] + 1:
                        if due[s]:
                            most = min([left[root], due[s], *[flow[x][k] for x, k in path[1:]]])
                            for n, (x, k) in enumerate(path):
                                flow[x][edge[x]] += most
                                flow[x][k] -= most if n else 0
                            left[root], due[s] = left[root] - most, due[s] - most
                            path = [(root, 0)]
                            break
                        while turn[s] < len(back[s]):
                            x, k = back[s][turn[s]]
                            if flow[x][k] and of_p[x] == of_s[s] + 1:
                                break
                            turn[s] += 1
                        if turn[s] < len(back[s]):
                            path.append(back[s][turn[s]])
                            break
                    edge[i] += 1
                else:
                    path.pop()
                    if path:
                        turn[to[path[-1][0]][edge[path[-1][0]]]] += 1

    for _ in range(ceiling):
        for i, p in enumerate(order):
            left[i] += patterns[p]
        while any(due) and (found := distances()):
            block(*found)
    return {(p, names[s]): flow[i][k] for i, p in enumerate(order) for k, s in enumerate(to[i])}


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), total_share: float = 1.5, ceiling: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """What a mix takes of each document: doc_id, size, pattern, source_size, target, taken (and keep).

    A document may belong to several sources (`sources`: an array; by default the one in `source`).
    Documents are counted by membership pattern; a source's size is all words of its documents;
    sources sorted by code point, null last, weigh weights[0], weights[1], ..., repeating. Their
    targets share total_share of all words and stop at ceiling times a source's size. A min-cost
    flow routes each pattern's words, up to ceiling copies, to the quotas of its sources. Within a
    pattern all documents are read floor(flow / words) times, and once more in a seeded order (md5
    of seed and id, then id, then size) until the flow is used up; the last of these may be
    cut, so a pattern yields its flow to the word, and no document more than ceiling times its size.

    source_size and target of a document of several sources are the sums over these. Null, empty and
    blank texts have size 0 and yield 0. A null or empty array, like a null source, is the pattern
    of the null source. Repeated rows are documents of their own. An empty table gives no rows.
    Reruns agree: the order depends on seed and ids alone. Patterns reach the driver, at most
    MAX_PATTERNS of them (more raise an error); documents never do.
    """
    spark = docs.sparkSession
    belongs = sources if sources is not None else F.array(F.col("source"))
    belongs = F.when(F.size(F.coalesce(belongs, F.array().cast("array<string>"))) > 0, F.array_sort(F.array_distinct(belongs))).otherwise(F.array(F.lit(None).cast("string")))
    sized = docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), belongs.alias("pattern"), *keep)
    sized = sized.withColumn("place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))).withColumn("cell", F.substring("place", 1, 3))
    cells = sized.groupBy("pattern", "cell").agg(F.sum("size").alias("words"))
    totals = cells.groupBy("pattern").agg(F.sum("words").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["pattern"]): r["words"] for r in totals}
    sizes: dict = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    order = sorted(sizes, key=_place)
    due = targets({s: sizes[s] for s in order}, {s: weights[i % len(weights)] for i, s in enumerate(order)}, total_share, ceiling)
    flow = route(patterns, {s: int(t) for s, t in due.items()}, ceiling)
    routed: dict = defaultdict(int)
    for (p, _), n in flow.items():
        routed[p] += n
    plan = [(list(p), sum(sizes[s] for s in p), float(sum(due[s] for s in p)), routed[p] // n if n else 0, routed[p] % n if n else 0) for p, n in patterns.items()]
    schema = "pattern array<string>, source_size long, target double, copies long, rest long"
    # The seeded order goes by cell (the first 12 bits of place): running sums over cells, then within
    # one cell, so that no task sums a whole pattern.
    before = F.sum("words").over(Window.partitionBy("pattern").orderBy("cell")) - F.col("words")
    known = cells.withColumn("before", before).join(F.broadcast(spark.createDataFrame(plan, schema)) if len(plan) <= 10_000 else spark.createDataFrame(plan, schema), "pattern")
    known = known.select("pattern", "cell", "source_size", "target", "copies", (F.col("rest") - F.col("before")).alias("left"))
    w = Window.partitionBy("pattern", "cell").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - (F.sum("size").over(w) - F.col("size"))))
    taken = (F.col("copies") * F.col("size") + part).alias("taken")
    return sized.join(known, ["pattern", "cell"]).select("doc_id", "size", "pattern", "source_size", "target", taken, *keep)
