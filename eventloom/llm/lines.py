"""Line dedup: line hashes by document, first occurrences, compressed per-document keep bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, row_key, stripped, written

WORD_BITS = 64
#: Common line keys up to which their table is broadcast; they are counted before.
BROADCAST_ROWS = 100_000
#: Beyond that, keys with more than this part of all occurrences are broadcast: there are fewer than its inverse.
HOT_PART = 1000


def line_key(line: Column) -> Column:
    """What makes lines equal: the line without white space at its ends, A-Z in lower case."""
    return ascii_lower(stripped(line))


def _id(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    # 64 bits, as all rows without an id share one
    return [F.col(id_col).alias("_doc"), row_key(F.col(id_col), F.col(text_col)).alias("_rk")]


def occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(_doc, _rk, h1, h2, at): the positions of each distinct line key in each document.

    Keys shorter than min_chars code points are left out. Two hashes, 96 bits, stand for a key. Rows are
    dealt by ranges of (hash, document), so that a line found in very many documents fills several
    ranges, and sorted by position within these: the first of a document's positions is the line's
    first occurrence there.
    """
    lines = docs.select(*_id(docs, id_col, text_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    # written, so that texts are split and hashed once: ranges are sampled before rows are dealt
    hashed = written(keyed.select("_doc", "_rk", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "pos"), "lines")
    ranged = hashed.repartitionByRange("h1", "h2", "_doc", "_rk").sortWithinPartitions("h1", "h2", "_doc", "_rk", "pos")
    return ranged.groupBy("h1", "h2", "_doc", "_rk").agg(F.array_sort(F.collect_list("pos")).alias("at"))


def _occurrences_of(found: DataFrame, common: DataFrame) -> DataFrame:
    """found with the facts of its key, for the common keys only, wherever a key's rows are: a hot key isn't brought to one task.

    Few keys go to every task. Of many, only those that are hot do, the others are joined by key.
    """
    if common.count() <= BROADCAST_ROWS:
        return found.join(F.broadcast(common), ["h1", "h2"])
    hot = F.col("n") > found.count() // HOT_PART
    return found.join(F.broadcast(common.filter(hot)), ["h1", "h2"]).unionByName(found.join(common.filter(~hot), ["h1", "h2"]))


def keep_bitmaps(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_doc, _rk, dropped): a bitmap of the lines that each document loses; only documents that lose any.

    Lines whose key is found in min_docs documents or more lose all their occurrences or, with
    keep_first, all but the first one by document id (nulls first) and position. A bitmap is compressed: a map
    from word number to 64 bits, without the words that drop nothing.
    """
    found = written(occurrences(docs, id_col, text_col, min_chars), "occurrences")
    # a range's rows are reduced to one per key before the shuffle, so that only the ends of ranges meet in it
    facts = [F.count("*").alias("n"), *([F.min(F.struct("_doc", "_rk", F.col("at")[0].alias("pos"))).alias("first")] if keep_first else [])]
    common = written(found.groupBy("h1", "h2").agg(*facts).filter(F.col("n") >= min_docs), "common-lines")
    lost = _occurrences_of(found, common)
    if keep_first:
        is_first = F.col("_doc").eqNullSafe(F.col("first._doc")) & (F.col("_rk") == F.col("first._rk"))
        lost = lost.withColumn("at", F.when(is_first, F.filter("at", lambda p: p != F.col("first.pos"))).otherwise(F.col("at")))
    bits = lost.select("_doc", "_rk", F.explode("at").alias("pos"))
    # documents are dealt once, for both the words of a bitmap and the bitmap
    words = bits.repartition("_doc", "_rk").groupBy("_doc", "_rk", F.floor(F.col("pos") / WORD_BITS).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("_doc", "_rk").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def without_lines(text: Column, dropped: Column) -> Column:
    """text without the lines of the bitmap, the rest joined by line ends."""
    def kept(line: Column, i: Column) -> Column:
        word = F.coalesce(F.try_element_at(dropped, F.floor(i / WORD_BITS).cast("int")), F.lit(0).cast("long"))
        return F.getbit(word, F.pmod(i, F.lit(WORD_BITS))) == 0

    return F.array_join(F.filter(F.split(text, "\n", -1), kept), "\n")


def drop_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_lines, n_dropped and kept: the text without the lines that keep_bitmaps names.

    A text is split at every \\n, so null and empty texts have one (empty) line; blank lines have an
    empty key and stay under min_chars >= 1. Null texts come out as empty `kept`. Rows that agree in id
    and text count as one document and lose the same lines. Null ids are ids like any other. An empty table gives no rows. Columns named n_lines,
    n_dropped or kept are replaced, all others stay.
    """
    maps = keep_bitmaps(docs, min_docs=min_docs, min_chars=min_chars, keep_first=keep_first, id_col=id_col, text_col=text_col)
    rows = docs.drop("n_lines", "n_dropped", "kept", "_doc", "_rk").select("*", *_id(docs, id_col, text_col))
    maps = maps.select(F.col("_doc").alias("_d"), F.col("_rk").alias("_k"), "dropped")
    both = rows.join(maps, (rows["_rk"] == maps["_k"]) & rows["_doc"].eqNullSafe(maps["_d"]), "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_dropped = F.aggregate(F.map_values("dropped"), F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x))
    return both.select(
        *[c for c in rows.columns if c not in ("_doc", "_rk")],
        F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(n_dropped, F.lit(0).cast("long")).alias("n_dropped"),
        F.when(F.col("dropped").isNull(), text).otherwise(without_lines(text, F.col("dropped"))).alias("kept"),
    )
