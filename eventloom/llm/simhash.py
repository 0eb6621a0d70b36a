"""SimHash near-dedup: fingerprints, a byte-position inverted index with count filtering, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import discard, group_facts, lean, release, row_key, written

SEED = 42
BYTES = 8
#: Rows of one tile side of a hot posting, rows of postings whose pairs are compared all at once, and shingles hashed at once.
TILE_ROWS, SMALL, CHUNK = 2048, 16, 1 << 16
#: Tables of edges are written in FILES files and one more for each FILE_ROWS edges, at most.
FILES, FILE_ROWS = 8, 100_000


def _chunks(text: bytes, words: int):
    """Hashes of the text's shingles, CHUNK at a time, so that a very long text needs little memory."""
    tokens = text.lower().split()
    if 0 < len(tokens) < words:
        yield [xxhash.xxh64_intdigest(b" ".join(tokens), SEED)]
        return
    for at in range(0, len(tokens) - words + 1, CHUNK):
        some = tokens[at : at + CHUNK + words - 1]
        joined, ends, end = b" ".join(some), [], -1
        for t in some:
            end += len(t) + 1
            ends.append(end)
        starts = [0, *[e + 1 for e in ends]]
        yield [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)]


def _simhash(chunks) -> int:
    total, bits = 0, np.zeros(64, dtype=np.int64)
    for some in chunks:
        hashes = np.array(some, dtype=np.uint64)
        total += len(hashes)
        bits += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > total).view(np.int64)[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash (signed): a bit is 1 if set in over half the shingles' hashes; 0 without any word."""
    return _simhash(_chunks((text or "").encode("utf-8", "surrogatepass"), words))


def fingerprints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, rk, fp): rk tells rows of one id apart."""

    @lean("simhash")
    def run(batches):
        for b in batches:
            yield pa.record_batch([b["doc_id"], b["rk"], pa.array([fingerprint(t.as_py(), words) for t in b["text"]], pa.int64())], names=["doc_id", "rk", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("rk"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, rk long, fp long")


def positions(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions, one of which two fingerprints within max_bits must share whole.

    max_bits differing bits leave g = 8 - max_bits whole bytes equal (the guaranteed count). The 8
    positions are dealt into m groups, so some group holds g / m of them or more: all subsets of
    that size of every group are a complete family, of 8 triples for 3 bits.
    """
    g = BYTES - max_bits
    if g < 1:
        raise ValueError("7 differing bits at most: beyond, no byte need be equal")
    size, m = (3, 2) if g >= 5 else (2, g - 1) if g >= 2 else (1, 1)
    groups = [range(i, BYTES, m) for i in range(m)]
    return [c for group in groups for c in combinations(group, size)]


def _forest(rows: np.ndarray, max_bits: int, shared: int) -> list[tuple[int, int]]:
    """Links that connect what is linked among the rows (node, fp) of a posting: a spanning forest.

    Count filter first: the shared bytes of a pair are tallied over all positions, and only pairs that
    reach `shared`, the guaranteed minimum, are verified bit by bit. A row is linked to the nearest of
    those that reach it first.
    """
    rest, links, fps = np.arange(len(rows)), [], rows[:, 1]
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            least = np.full(len(rest), 65)
            by = np.zeros(len(rest), dtype=np.int64)
            step = max(1, 1_000_000 // len(rest))
            for at in range(0, len(front), step):
                some = front[at : at + step]
                apart = fps[some, None] ^ fps[rest][None, :]
                tally = (apart.view(np.uint8).reshape(*apart.shape, BYTES) == 0).sum(axis=2)
                far = np.full(apart.shape, 65)
                x, y = np.nonzero(tally >= shared)
                bits = np.bitwise_count(apart[x, y]).astype(np.int64)
                far[x, y] = np.where(bits <= max_bits, bits, 65)
                best = far.argmin(axis=0)
                value = far[best, np.arange(len(rest))]
                better = value < least
                by[better], least[better] = some[best[better]], value[better]
            near = least < 65
            links += zip(rows[by[near], 0].tolist(), rows[rest[near], 0].tolist(), strict=True)
            front, rest = rest[near], rest[~near]
    return links


def _small_links(rows: np.ndarray, run: np.ndarray, small: np.ndarray, max_bits: int, shared: int) -> np.ndarray:
    """Links of all postings of up to SMALL rows in a batch, compared at one distance in the batch after the other."""
    found = [np.empty((0, 2), dtype=np.uint64)]
    for d in range(1, SMALL):
        i = np.flatnonzero((run[:-d] == run[d:]) & small[:-d])
        if not len(i):
            break
        apart = rows[i, 1] ^ rows[i + d, 1]
        tally = (apart.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        i, apart = i[tally >= shared], apart[tally >= shared]
        i = i[np.bitwise_count(apart) <= max_bits]
        found.append(np.stack([rows[i, 0], rows[i + d, 0]], axis=1))
    return np.concatenate(found)


def _linker(*limits: int):
    @lean("simhash")
    def run(batches):
        key, held = None, []

        def batch(links):
            a = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.record_batch([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([np.asarray(b[c]) for c in ("slot", "bytes", "i", "j")], axis=1)
            rows = np.stack([np.asarray(b[c]) for c in ("node", "fp")], axis=1).view(np.uint64)
            starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
            sizes = np.diff(np.append(starts, len(rows)))
            # the first posting may go on from the batch before, the last one into the next
            inner = (sizes <= SMALL) & (np.arange(len(sizes)) > 0) & (np.arange(len(sizes)) < len(sizes) - 1)
            links = [_small_links(rows, np.repeat(np.arange(len(sizes)), sizes), np.repeat(inner, sizes), *limits)]
            for k in np.flatnonzero(~inner).tolist():
                part = rows[starts[k] : starts[k] + sizes[k]]
                if key is not None and (keys[starts[k]] == key).all():
                    held.append(part)
                    continue
                if sum(map(len, held)) > 1:
                    links.append(_forest(np.concatenate(held), *limits))
                key, held = keys[starts[k]], [part]
            yield from (batch(x) for x in links if len(x))
        if held:
            yield batch(_forest(np.concatenate(held), *limits))

    return run


def links(nodes: DataFrame, max_bits: int, *, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) between nodes (node, fp) that connect all within max_bits of fp.

    Postings list the nodes that share the bytes at one set of positions. A posting of n rows is
    dealt into ceil(n / tile_rows) blocks and linked block against block, so that no task holds a hot
    posting; each tile returns a spanning forest, at most as many links as it has rows, and a posting
    of up to SMALL rows all its links.
    """
    slots = positions(max_bits)
    parts = [F.struct(F.lit(k).alias("slot"), sum((F.shiftleft(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)), 8 * i) for i, p in enumerate(slot)), F.lit(0).cast("long")).alias("bytes")) for k, slot in enumerate(slots)]
    postings = nodes.select("node", "fp", F.explode(F.array(*parts)).alias("k")).select("k.slot", "k.bytes", "node", "fp")
    counts = postings.groupBy("slot", "bytes").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / tile_rows).cast("int")
    dealt = postings.join(counts, ["slot", "bytes"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("slot", "bytes", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "fp")
    tiles = tiles.repartition("slot", "bytes", "i", "j").sortWithinPartitions("slot", "bytes", "i", "j", "node")
    return tiles.mapInArrow(_linker(max_bits, BYTES - max_bits), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of undirected edges (a, b), the smallest node reachable.

    Alternates large-star and small-star steps, each a minimum per node (combined before the
    shuffle) joined back, until the edges are stars; every step is written to the shared folder, in
    files of about FILE_ROWS edges. Edges that are stars already, such as single pairs, take no step.
    """

    def state_of(table) -> tuple[bool, int]:
        """Are these stars: no node under two others, and none above others under another? And a bound of the rows of the next step."""
        under = F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("above")), F.struct(F.col("v").alias("n"), F.lit(None).cast("long").alias("above")))
        places = table.select(F.explode(under).alias("e")).groupBy("e.n").agg(F.min("e.above").alias("lo"), F.max("e.above").alias("hi"), F.count("e.above").alias("under"), F.count("*").alias("all"))
        bad, rows = places.agg(F.count_if(F.expr("lo <> hi or (under > 0 and under < all)")), F.coalesce(F.sum("all"), F.lit(0))).first()
        return bad == 0, rows

    stars = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    done, rows = state_of(stars)
    if done:
        return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()
    while not done:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        before, stars = stars, written(small.filter("u <> v").distinct().coalesce(FILES + rows // FILE_ROWS), "edges")
        discard(before)
        done, rows = state_of(stars)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _joined(comps: DataFrame, more: DataFrame) -> DataFrame:
    """Components of comps (node, root) and the edges `more` (a, b): a step over roots only, so that what is joined by now takes no rounds again."""
    of = comps.select("node", "root")
    ends = more.join(of.toDF("a", "_a"), "a", "left").join(of.toDF("b", "_b"), "b", "left")
    over = components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    moved = of.join(over.toDF("root", "_r"), "root", "left").select("node", F.coalesce("_r", "root").alias("root"))
    return written(moved.unionByName(over), "components")


def near_groups(docs: DataFrame, *, words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rk, fingerprint (16 hex digits), component_id: the smallest id reachable over links.

    Texts are lower-cased (A-Z), split at white space and shingled by `words` words; fingerprints link
    at max_bits or fewer differing bits. Equal fingerprints are one node, so copies cost no links.

    Null, empty and blank texts have fingerprint zero and link like any other. A null id is no
    component id unless all of a component's ids are null. Repeated rows come out as often as they
    went in. An empty table gives no rows. Other columns are ignored; join on (doc_id, rk) for them.
    """
    rows = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    joined = components(links(nodes.select(F.col("fp").alias("node"), "fp"), max_bits))
    found = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = found.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")).filter("n > 1")
    merged = found.join(least, "root").select("fp", "component_id")
    # A node's own smallest id goes to its rows by salted steps; the few merged nodes overrule it.
    out = group_facts(rows, ["fp"], [F.col("doc_id"), F.col("rk")], [F.min("doc_id").alias("m")], [F.min("m").alias("own")])
    out = out.join(merged, "fp", "left")
    return out.select("doc_id", "rk", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "own").alias("component_id"))


#: Differing bits of the fingerprints of first candidates; keys (a numeric id, two longs) that are broadcast at most.
FIRST_BITS, BROADCAST_ROWS = 3, 100_000
#: One text in SAMPLE is read for the common shingles, of which at most COMMON are ordered last; distances within postings at which rounds end.
SAMPLE, COMMON, ROUNDS = 16, 16_384, (16, 256)


def _distinct(chunks: list) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(np.concatenate([np.array(c, dtype=np.uint64) for c in chunks] or [np.empty(0, np.uint64)]))


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, set): sorted distinct shingle hashes of docs (node, text)."""

    @lean("simhash")
    def run(batches):
        for b in batches:
            sets = [_distinct(list(_chunks((t.as_py() or "").encode("utf-8", "surrogatepass"), words))).view(np.int64) for t in b["text"]]
            yield pa.record_batch([b["node"], pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    return docs.mapInArrow(run, "node long, set array<long>")


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) of the shingles that very many texts have, and their ranks by frequency: from a sample, as they only order shingles."""
    sample = texts.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select(F.lit(0).cast("long").alias("node"), "text")
    counts = _shingle_sets(sample, words).select(F.explode("set").alias("h")).groupBy("h").count().filter(F.col("count") > SAMPLE)
    top = [r["h"] for r in counts.orderBy(F.col("count").desc(), "h").limit(COMMON).collect()]
    hashes = np.array(top, dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (len(top) - order).astype(np.int64)


def _prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of a text's shingles, common ones last: two texts of that similarity share one of these."""
    n = len(hashes)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], hashes), len(common[0]) - 1)
        hot = common[0][at] == hashes
        hashes = np.concatenate([hashes[~hot], hashes[hot][np.argsort(common[1][at[hot]])]])
    return hashes[: n - int(np.ceil(similarity * n - 1e-9)) + 1]


def _profiles(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, rk, fp, same0, same1, size, least, counts): what similar_groups knows of a text.

    same is 128 bits of its shingle set, size the set's, least its prefix, counts how many hashes end in each byte (255: or more).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("rk"), F.col(text_col).alias("text"))
    common = _common(rows, words)
    names = ["fp", "same0", "same1", "size"]

    @lean("simhash")
    def run(batches):
        for b in batches:
            found, least, counts = [], [], []
            for t in b["text"]:
                chunks = list(_chunks((t.as_py() or "").encode("utf-8", "surrogatepass"), words))
                hashes = _distinct(chunks)
                same = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes(), SEED), dtype=np.int64)
                found.append((_simhash(chunks), *same.tolist(), len(hashes)))
                least.append(_prefix(hashes, common, similarity).view(np.int64))
                counts.append(np.minimum(np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes())
            yield pa.record_batch([b["doc_id"], b["rk"], *[pa.array([f[i] for f in found], pa.int64()) for i in range(len(names))], pa.array(least, pa.list_(pa.int64())), pa.array(counts, pa.binary())], names=["doc_id", "rk", *names, "least", "counts"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, rk long, " + ", ".join(f"{n} long" for n in names) + ", least array<long>, counts binary")


def _candidates(similarity: float, low: int, high: int | None):
    """Pairs (a, b) of the rows of each tile (h, i, j) that can reach that similarity and are in different components.

    In a tile of a block with itself, rows at a distance of low to under high (null: any) in order of
    size; in a tile of two blocks, all pairs between them. Sizes must fit, and so must the places of the
    shingle: what follows it bounds what can be in common. A tile goes on over Arrow batches.
    """

    def pairs(rows):
        run = np.cumsum(np.append(0, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))
        inner, own, node, comp, size, pos = rows[:, 1] == rows[:, 2], *rows[:, 3:].T
        at, found, n, d = np.arange(len(rows)), [], 0, 0
        while high is None or d + 1 < high:
            d += 1
            at = at[at + d < len(rows)]
            at = at[run[at] == run[at + d]]
            at = at[size[at] >= similarity * size[at + d] - 1e-9]
            if not len(at):
                break
            x = at[np.where(inner[at], d >= low, own[at] != own[at + d])]
            y = x + d
            need = np.ceil(similarity / (1 + similarity) * (size[x] + size[y]) - 1e-9)
            ok = (comp[x] != comp[y]) & (np.minimum(size[x] - pos[x], size[y] - pos[y]) >= need)
            a, b = node[x[ok]], node[y[ok]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
            n += len(a)
            if n > 1 << 16:
                yield found
                found, n = [], 0
        if n:
            yield found

    def batch(found):
        u = np.unique(np.concatenate(found), axis=0)
        return pa.record_batch([pa.array(u[:, 0]), pa.array(u[:, 1])], names=["a", "b"])

    @lean("simhash")
    def run(batches):
        held = np.empty((0, 8), dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.concatenate([held, np.stack([np.asarray(b[c]) for c in ("h", "i", "j", "own", "node", "comp", "size", "pos")], axis=1)])
            last = len(rows) - int(np.argmin(np.append((rows[::-1, :3] == rows[-1, :3]).all(axis=1), False)))
            held = rows[last:]
            for found in pairs(rows[:last]):
                yield batch(found)
        for found in pairs(held):
            yield batch(found)

    return run


def _postings(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """(h, node, comp, size, pos, n) of nodes (node, size, least): the shingles that several nodes share in their prefixes.

    comps: (node, root) of what is linked by now.
    """
    rows = nodes.select("node", F.posexplode("least").alias("pos", "h"))
    # most shingles are in one text only: counts and rows stay narrow until these are gone
    shared = rows.select("h").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(shared, "h").join(nodes.select("node", "size"), "node").join(comps, "node", "left")
    return rows.select("h", "node", F.coalesce("root", "node").alias("comp"), "size", F.col("pos").cast("long").alias("pos"), "n")


def _left_open(postings: DataFrame, comps: DataFrame, least: int) -> DataFrame:
    """Postings of more than `least` nodes with the components of comps (node, root), where these are still several."""
    rows = postings.filter(F.col("n") > least).drop("comp").join(comps, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    open_ = rows.groupBy("h").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo <> _hi").select("h")
    return rows.join(open_, "h")


def _exact_candidates(rows: DataFrame, similarity: float, low: int, high: int | None, tile_rows: int) -> DataFrame:
    """Pairs (a, b) of a round over postings (h, node, comp, size, pos, n)."""
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / tile_rows).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long"))
    other = F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1) if high is None else F.array("own")
    tiles = rows.withColumn("other", F.explode(other)).select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "size", "pos")
    tiles = tiles.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "size", "node")
    return tiles.mapInArrow(_candidates(similarity, low, high), "a long, b long").distinct()


def _reachable(pairs: DataFrame, counts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that can reach that similarity by counts (node, size, counts): differing counts bound what is in common from above."""

    @lean("simhash")
    def run(batches):
        for b in batches:
            if b.num_rows:
                left, right = (np.frombuffer(b"".join(b[c].to_pylist()), dtype=np.uint8).reshape(-1, 256).astype(np.int16) for c in ("x", "y"))
                sizes = np.asarray(b["m"]) + np.asarray(b["n"])
                most = (sizes - np.abs(left - right).sum(axis=1, dtype=np.int64)) // 2
                yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(most >= np.ceil(similarity / (1 + similarity) * sizes - 1e-9)))

    both = pairs.join(counts.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("counts").alias("x")), "a").join(counts.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("counts").alias("y")), "b")
    return both.select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", tile_rows: int = TILE_ROWS, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """doc_id, rk, component_id, stays: documents linked, directly or over others, at a Jaccard similarity of word shingles.

    First candidates come from SimHash: fingerprints of the shingles, indexed by byte positions, that
    differ in FIRST_BITS or less. That finds the closest copies cheaply, but not all links. The rest comes from an
    exact index: two texts of the similarity share a shingle of their prefixes (the first
    1 - similarity of their shingles, common ones last), so all pairs of a posting that sizes, places
    and counts of hashes allow are candidates unless one component has both by now. A posting's close
    rows are compared first (rounds: distances in order of size), then all of its tiles, so that a
    group of near copies is one component before all its pairs would be. Every candidate is held
    against the shingle sets themselves, and only links that hold join. Texts with equal shingle sets
    (128 bits of the sorted distinct hashes) are one node.

    A row is known by its id and rk, the hash of id and text: rows that agree in both are one
    document, texts of their own under one id are documents of their own, and null ids are ids like any other, behind
    all others. component_id is the smallest id of the group; `stays` marks the rows of its first document (by id,
    then rk). Ids may be of any type that has an order. Texts of fewer words are one
    shingle; null, empty and blank ones are equal. An empty table gives no rows; other columns are ignored.
    """
    profiles = written(_profiles(docs, words, similarity, id_col, text_col), "fingerprints")
    me = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("rk"))
    # a row a set and task before the shuffle, as a third of all rows may share a set; numbered as written, so that the numbers stay
    same = ["same0", "same1"]
    once = profiles.groupBy(*same).agg(F.min(me).alias("first"), F.min("fp").alias("fp"), *[F.first(c).alias(c) for c in ("size", "least", "counts")])
    nodes = written(once.select(*same, "first.doc_id", "first.rk", "fp", "size", "least", "counts").withColumn("node", F.monotonically_increasing_id()), "nodes")
    known = written(profiles.select("doc_id", "rk", *same), "sets")
    discard(profiles)
    release(docs.sparkSession)
    asked = nodes.select("node", F.col("doc_id").alias("_d"), F.col("rk").alias("_k"))

    def of_nodes(table: DataFrame, wanted: DataFrame) -> DataFrame:
        """The rows (doc_id, rk, ...) of table that stand for the wanted nodes."""
        return table.join(wanted, (table["rk"] == wanted["_k"]) & table["doc_id"].eqNullSafe(wanted["_d"])).drop("doc_id", "rk", "_d", "_k")

    texts = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("rk"), F.col(text_col).alias("text"))

    def held(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose shingle sets are as similar."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = written(asked.join(ends, "node"), "wanted")
        # few keys go to the texts, instead of all texts to the keys
        small = isinstance(wanted.schema["_d"].dataType, NumericType) and wanted.count() <= BROADCAST_ROWS
        few = F.broadcast(wanted) if small else wanted
        sets = written(_shingle_sets(of_nodes(texts, few), words).groupBy("node").agg(F.first("set").alias("set")), "shingles")
        # every b has a few links, an a may have very many: b's set goes along to where a's is
        both = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("t")), "b").join(sets.select(F.col("node").alias("a"), "set"), "a")
        common = F.size(F.array_intersect("set", "t"))
        found = written(both.filter(common >= F.lit(similarity) * (F.size("set") + F.size("t") - common)).select("a", "b"), "held")
        discard(sets)
        discard(wanted)
        return found

    first = written(links(nodes.select("node", "fp"), FIRST_BITS, tile_rows=tile_rows), "links")
    joined = components(held(first))
    discard(first)
    counts = nodes.select("node", "size", "counts")
    postings = written(_postings(nodes.select("node", "size", "least"), joined), "postings")
    release(docs.sparkSession)
    most = postings.agg(F.max("n")).first()[0] or 0
    for low, high in zip((1, *rounds), (*rounds, None), strict=True):
        if most > (low if high else min(low, tile_rows)):
            rows = postings if low == 1 else _left_open(postings, joined, low if high else min(low, tile_rows))
            found = written(_reachable(_exact_candidates(rows, similarity, low, high, tile_rows), counts, similarity), "candidates")
            true = held(found)
            discard(found)
            if not true.isEmpty():
                joined = _joined(joined, true)
            release(docs.sparkSession)
    discard(postings)

    placed = nodes.join(joined, "node", "left").select(me.alias("me"), *same, F.coalesce("root", "node").alias("root"))
    best = group_facts(placed, ["root"], [F.col("me")], [F.min("me").alias("m")], [F.min("m").alias("best")]).select(*same, "best")
    # to the rows of a set by salted steps
    salted = known.select("doc_id", "rk", *same, F.pmod(F.xxhash64("doc_id", "rk"), F.lit(64)).cast("int").alias("_salt"))
    out = salted.join(salted.select(*same, "_salt").distinct().join(best, same), [*same, "_salt"])
    return out.select("doc_id", "rk", F.col("best.doc_id").alias("component_id"), (me == F.col("best")).alias("stays"))
