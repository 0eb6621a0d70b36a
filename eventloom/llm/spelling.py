"""Grouping of spelling variants: k-d trees over letter counts find the words one edit away.

One inserted or deleted character changes one count by one, a replaced one lowers one count and raises
another: words one edit apart are at most 2 apart in the sum of absolute differences. Searches for words
of length L look among words of length L (two steps) and of L + 1 (one step up), and leave out boxes
that these steps don't reach. What is found is compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Maximal runs of these letters are words' raw forms.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: Coordinates: length, a to z, and the other letters dealt into a few.
OTHERS = 6
DIMENSIONS = 1 + 26 + OTHERS
#: Words that a cell of the upper tree is meant to hold; a cell of over twice as many is searched in blocks of this size.
CELL = 8192
#: Words that the upper tree's cuts are fitted on. Every word is indexed.
SAMPLE = 20_000
#: Words of a leaf of a cell's own tree.
LEAF = 32
#: What a row sent to a cell is there: one of its words, or a query for words of the same length from another cell, one longer, of the same length from this cell.
WORD, SAME, LONGER, OWN = 0, 1, 2, 3
#: Elements of arrays that are compared at once.
SPAN = 1 << 22


# --- words


def corrupted(run: Column, doc_id: Column, every: int = 97) -> Column:
    """A run of which, where `every` divides the CRC-32 of 'id:run', the character at CRC modulo length is deleted."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, *, min_chars: int = 5, min_count: int = 3, corrupt_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of RUN with A-Z in lower case, of min_chars or more, found min_count times or more over all texts.

    Words are counted before the shuffle, so that frequent ones are no hot keys. corrupt_every deletes
    characters as corrupted() says, in texts with an id. Null texts have no words; repeated rows count
    again; an empty table has no words.
    """
    # shorter runs can't become words
    least = RUN.replace("+", f"{{{min_chars},}}")
    runs = docs.select(F.col(id_col).alias("_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(least), F.lit(0))).alias("_run"))
    run = ascii_lower(F.col("_run"))
    word = run if corrupt_every is None else F.coalesce(corrupted(run, F.col("_id"), corrupt_every), run)
    words = runs.select(word.alias("word")).filter(F.char_length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


# --- trees


def vectors(words: list[str]) -> np.ndarray:
    """A row of DIMENSIONS coordinates for each word."""
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    place = np.where((codes >= 97) & (codes <= 122), codes - 96, 27 + codes % OTHERS)
    out = np.bincount(np.repeat(np.arange(len(words)), sizes) * DIMENSIONS + place, minlength=len(words) * DIMENSIONS).reshape(-1, DIMENSIONS)
    out[:, 0] = sizes
    return out.astype(np.int32)


class Tree:
    """A k-d tree: inner nodes (dimension, cut, left, right), where left has coordinates up to the cut; leaves -1 - number."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.nodes: list[tuple[int, int, int, int]] = []
        self.leaves: list[np.ndarray] = []
        self.root = self._grow(points, np.arange(len(points)), leaf)

    def _grow(self, points: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        some = points[rows]
        if len(rows) > leaf:
            middle = np.floor(np.median(some, axis=0)).astype(np.int32)
            left = np.stack([(some < middle).sum(axis=0), (some <= middle).sum(axis=0)])
            balance = np.minimum(left, len(rows) - left)
            which, d = np.unravel_index(int(balance.argmax()), balance.shape)
            if balance[which, d]:
                cut = int(middle[d]) - (which == 0)
                low = some[:, d] <= cut
                at = len(self.nodes)
                self.nodes.append((0, 0, 0, 0))
                self.nodes[at] = (int(d), int(cut), self._grow(points, rows[low], leaf), self._grow(points, rows[~low], leaf))
                return at
        self.leaves.append(rows)
        return -len(self.leaves)

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                d, cut, left, right = self.nodes[node]
                low = points[rows, d] <= cut
                todo += [(left, rows[low]), (right, rows[~low])]
        return out

    def search(self, queries: np.ndarray, longer: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of queries) where a word one edit away, of the same length or one longer, may be.

        Such a word has one count higher and, at the same length, one lower: up and down are the steps
        that a box takes from the query, added up over its dimensions.
        """
        rows = np.arange(len(queries))
        zero = np.zeros(len(queries), np.int32)
        todo = [(self.root, rows, zero, zero, {}, {})]
        while todo:
            node, rows, up, down, lows, highs = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows
                continue
            d, cut, left, right = self.nodes[node]
            x = queries[rows, d] + (longer if d == 0 else 0)
            if d == 0:  # lengths are exact
                low = x <= cut
                todo += [(left, rows[low], up[low], down[low], lows, highs), (right, rows[~low], up[~low], down[~low], lows, highs)]
                continue
            down_left = down + np.maximum(0, x - cut) - (np.maximum(0, x - highs[d]) if d in highs else 0)
            up_right = up + np.maximum(0, cut + 1 - x) - (np.maximum(0, lows[d] - x) if d in lows else 0)
            go = down_left <= 1 - longer
            todo.append((left, rows[go], up[go], down_left[go], lows, highs | {d: cut}))
            go = up_right <= 1
            todo.append((right, rows[go], up_right[go], down[go], lows | {d: cut + 1}, highs))


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of character codes are one replacement apart, or one insertion where long has one column more."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    head = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= short.shape[1]


class Words:
    """Words of one length under a tree."""

    def __init__(self, words: list[str]):
        self.words = words
        self.points = vectors(words)
        self.codes = _codes(words, len(words[0]))
        self.tree = Tree(self.points[:, 1:], LEAF)
        # search() takes coordinates with the length first
        self.tree.nodes = [(d + 1, *rest) for d, *rest in self.tree.nodes]
        # sums of differences stay within the two words' lengths
        self.kind = np.int8 if self.codes.shape[1] <= 60 else np.int32
        self.boxes = [np.ascontiguousarray(self.points[rows, 1:].T, dtype=self.kind) for rows in self.tree.leaves]

    def near(self, queries: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query rows, word rows) of pairs one edit apart; queries are of one length, this one or one less."""
        longer = self.codes.shape[1] - len(queries[0])
        points, codes = vectors(queries), _codes(queries, len(queries[0]))
        counts = np.ascontiguousarray(points[:, 1:].T, dtype=self.kind)
        for leaf, rows in self.tree.search(points, longer):
            mine = self.tree.leaves[leaf]
            step = max(1, SPAN // (len(mine) * max(DIMENSIONS, codes.shape[1])))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                apart = np.abs(counts[:, some, None] - self.boxes[leaf][:, None, :]).sum(axis=0, dtype=self.kind)
                q, p = np.nonzero(apart <= 2 - longer)
                q, p = some[q], mine[p]
                for k in range(0, len(q), step):
                    ok = one_edit(codes[q[k : k + step]], self.codes[p[k : k + step]])
                    if ok.any():
                        yield q[k : k + step][ok], p[k : k + step][ok]


# --- tables


def upper_tree(words: DataFrame) -> Tree | None:
    """Cuts of all words into cells of about CELL, fitted on SAMPLE of them by hash order; None for a single cell."""
    n = words.count()
    if n <= CELL:
        return None
    some = words.select("word").orderBy(F.xxhash64("word")).limit(SAMPLE).mapInArrow(lambda bs: (pa.record_batch([pa.array(list(vectors(b["word"].to_pylist())), pa.list_(pa.int32()))], names=["v"]) for b in bs if b.num_rows), "v array<int>")
    points = np.array([r["v"] for r in some.collect()], np.int32)
    return Tree(points, max(1, CELL * len(points) // n))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of different words that are one edit apart, in both directions. words: (word, n), distinct.

    Words are dealt to the cells of an upper tree, whose cuts come from a bounded sample, and sent as
    queries to each cell that an edit can reach; cells that hold over twice CELL, as anagrams may, are
    cut into blocks that all their queries meet. In a task a cell's words come first and are put under a
    tree for each length; queries stream past. A pair of one length is found once: from the word of the
    cell with the lower number or, within a cell, from the word that comes first.
    """
    tree = upper_tree(words)

    def cells(batches):
        for b in batches:
            if b.num_rows:
                at = tree.place(vectors(b["word"].to_pylist())) if tree else np.zeros(b.num_rows, np.int64)
                yield pa.record_batch([*b.columns, pa.array(at)], names=[*b.schema.names, "cell"])

    placed = written(words.select("word", "n").mapInArrow(cells, "word string, n long, cell long"), "spelling-cells")
    # a row a cell, whose number is that of the upper tree's leaves
    blocks = {r["cell"]: -(-r["k"] // CELL) for r in placed.groupBy("cell").agg(F.count("*").alias("k")).filter(F.col("k") > 2 * CELL).collect()}

    def sent(batches):
        def lay(words, ns, cell, block, role):
            return pa.record_batch([words, ns, pa.array(cell, pa.int64()), pa.array(block, pa.int64()), pa.array(role, pa.int8())], names=["word", "n", "cell", "block", "role"])

        for b in batches:
            if not b.num_rows:
                continue
            cell, h = b["cell"].to_numpy(), b["h"].to_numpy()
            n_blocks = np.array([blocks.get(c, 1) for c in cell.tolist()])
            yield lay(b["word"], b["n"], cell, h % n_blocks, np.full(len(cell), WORD))
            points = vectors(b["word"].to_pylist())
            for longer in (0, 1):
                for leaf, rows in tree.search(points, longer) if tree else [(0, np.arange(len(cell)))]:
                    rows = rows if longer else rows[cell[rows] <= leaf]
                    role = np.where(cell[rows] == leaf, OWN, SAME) if not longer else np.full(len(rows), LONGER)
                    some = pa.array(rows)
                    for block in range(blocks.get(leaf, 1)):
                        yield lay(b["word"].take(some), b["n"].take(some), np.full(len(rows), leaf), np.full(len(rows), block), role)

    def found(batches):
        key, held, own = None, [], None
        for b in batches:
            out = ([], [], [])
            cell, block, role = (b[c].to_numpy() for c in ("cell", "block", "role"))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(role) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if lo == hi:
                    continue
                if (cell[lo], block[lo]) != key:
                    key, held, own = (cell[lo], block[lo]), [], None
                words, ns = b["word"][lo:hi].to_pylist(), b["n"][lo:hi].to_numpy()
                if role[lo] == WORD:
                    held += zip(words, ns.tolist(), strict=True)
                    continue
                if own is None:
                    by_length: dict[int, list[tuple[str, int]]] = {}
                    for w, n in held:
                        by_length.setdefault(len(w), []).append((w, n))
                    own = {k: (Words([w for w, _ in ws]), np.array([n for _, n in ws])) for k, ws in by_length.items()}
                sizes = np.array([len(w) for w in words])
                for size in np.unique(sizes):
                    there = own.get(int(size) + int(role[lo] == LONGER))
                    if there is None:
                        continue
                    rows = np.flatnonzero(sizes == size)
                    queries = [words[i] for i in rows]
                    for q, p in there[0].near(queries):
                        if role[lo] == OWN:
                            first = np.array([queries[i] < there[0].words[k] for i, k in zip(q, p, strict=True)])
                            q, p = q[first], p[first]
                        a, a_n = [queries[i] for i in q], ns[rows[q]]
                        z, z_n = [there[0].words[i] for i in p], there[1][p]
                        for column, more in zip(out, (a + z, z + a, [*z_n, *a_n]), strict=True):
                            column.extend(more)
            if out[0]:
                yield pa.record_batch([pa.array(out[0]), pa.array(out[1]), pa.array(out[2], pa.int64())], names=["word", "near", "near_n"])

    queries = placed.select("word", "n", "cell", F.pmod(F.xxhash64("word"), F.lit(1 << 30)).alias("h")).mapInArrow(sent, "word string, n long, cell long, block long, role byte")
    dealt = queries.repartition("cell", "block").sortWithinPartitions("cell", "block", "role")
    return dealt.mapInArrow(found, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word on the way from each word (word, form) along forms; forms lead to larger counts, so there are no circles.

    Ways are doubled a round, so rounds are the logarithm of the longest way, itself at most the
    logarithm of the largest count. Words whose way has ended don't join again; each round is written.
    """
    steps = written(forms.select("word", F.col("form").alias("root")), "forms")
    done, moving = [], steps
    while True:
        far = steps.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        joined = written(moving.join(far, moving["root"] == far["_w"], "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        done.append(joined.filter("not moved").select("word", "root"))
        moving = joined.filter("moved").select("word", "root")
        if moving.isEmpty():
            break
        ended = done[0]
        for d in done[1:]:
            ended = ended.unionByName(d)
        steps = written(ended.unionByName(moving), "ways")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def variants(words: DataFrame, *, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n), which are distinct.

    form: of the words one edit away that with the largest n (ties: smallest in code-point order), if
    its n is at least ratio times the word's. root: where forms lead to. No words, no rows.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    own = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    pairs = near_pairs(words).select("word", F.lit(None).cast("long").alias("n"), "near", "near_n")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    facts = own.unionByName(pairs).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    has = -F.col("best.less") >= ratio * F.col("n")
    facts = written(facts.select("word", "n", "n_near", F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "spelling-facts")
    ends = roots(facts.filter("form is not null")).withColumnRenamed("word", "_w")
    both = facts.join(ends, facts["word"] == ends["_w"], "left")
    return both.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
