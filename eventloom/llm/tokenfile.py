"""Token ids in binary files: patched frame-of-reference blocks with an index of block starts.

A file holds the ids of consecutive documents as one stream, cut into blocks of BLOCK ids. A block is
its minimum, a width, the low bits of the differences from the minimum at that width, and a list of
exceptions: places and high bits of the differences that need more. Parts of a file, little-endian:

    head      MAGIC, then 64-bit part, seq, documents, ids, blocks, bytes of blocks, bytes of names
    blocks    each: minimum (4 bytes), width (1), exceptions (1), packed low bits, places (1 each), high bits (4 each)
    starts    the byte at which each block begins (8 bytes each)
    lengths   ids of each document (8 bytes each)
    names     bytes of each document's id as text (4 bytes each; NULL for null), then the texts

(part, seq) orders the files of a table. The last byte is a line end, which Spark's text writer adds.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .bpe import byte_letters
from .common import row_key, scratch, written

MAGIC = b"PFORIDS1"
HEAD = struct.Struct("<8s7Q")
BLOCK = 128
#: The share of a block's differences that its width must hold; the others are exceptions.
PERCENTILE = 0.9
NULL = 0xFFFFFFFF
#: Ids at which a file is ended with the document that reaches it.
FILE_IDS = 1 << 24
#: Blocks that are packed or unpacked at once.
CHUNK = 1 << 13
#: Words whose ids a worker keeps; when full they are forgotten and encoded again on demand.
MEMO = 500_000
#: Characters of a text that are cut into words at once.
SPAN = 1 << 21
#: Files up to which the table of their first ids is broadcast; they are counted before.
BROADCAST_ROWS = 100_000


# --- blocks


def widths(diffs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits that each difference needs, width of each block) of rows of differences."""
    need = np.frexp(diffs.astype(np.float64))[1].astype(np.uint8)
    last = int(np.ceil(PERCENTILE * BLOCK)) - 1
    return need, np.partition(need, last, axis=1)[:, last]


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bytes of the blocks, their starts) of a stream of ids; the last block is filled up with its last id."""
    parts, starts, at = [], [], 0
    for first in range(0, len(ids), CHUNK * BLOCK):
        some = ids[first : first + CHUNK * BLOCK].astype(np.uint32)
        table = np.pad(some, (0, -len(some) % BLOCK), mode="edge").reshape(-1, BLOCK)
        low = table.min(axis=1)
        diffs = table - low[:, None]
        need, width = widths(diffs)
        over = need > width[:, None]
        n_over = over.sum(axis=1)
        size = 6 + width.astype(np.int64) * (BLOCK // 8) + 5 * n_over
        ends = np.cumsum(size)
        begin = ends - size
        out = np.zeros(int(ends[-1]), np.uint8)
        head = np.concatenate([low.astype("<u4").view(np.uint8).reshape(-1, 4), width[:, None], n_over.astype(np.uint8)[:, None]], axis=1)
        out[begin[:, None] + np.arange(6)] = head
        for w in np.unique(width):
            if w:
                rows = np.flatnonzero(width == w)
                bits = np.unpackbits(diffs[rows].astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4)[:, :, : -(-int(w) // 8)], axis=2, count=int(w), bitorder="little")
                packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
                out[begin[rows][:, None] + 6 + np.arange(packed.shape[1])] = packed
        row, place = np.nonzero(over)
        if len(row):
            order = np.arange(len(row)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
            base = begin[row] + 6 + width[row].astype(np.int64) * (BLOCK // 8)
            out[base + order] = place
            high = diffs[row, place] >> width[row].astype(np.uint32)
            out[(base + n_over[row] + 4 * order)[:, None] + np.arange(4)] = high.astype("<u4").view(np.uint8).reshape(-1, 4)
        parts.append(out.tobytes())
        starts.append(begin + at)
        at += len(out)
    return b"".join(parts), np.concatenate(starts) if starts else np.zeros(0, np.int64)


def unpack(blocks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ids of whole blocks that begin at starts of the bytes."""
    parts = []
    for first in range(0, len(starts), CHUNK):
        begin = starts[first : first + CHUNK].astype(np.int64)
        head = blocks[begin[:, None] + np.arange(6)]
        low, width, n_over = head[:, :4].copy().view("<u4").ravel(), head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
        diffs = np.zeros((len(begin), BLOCK), np.uint32)
        for w in np.unique(width):
            if w:
                rows = np.flatnonzero(width == w)
                bits = np.unpackbits(blocks[begin[rows][:, None] + 6 + np.arange(w * BLOCK // 8)], axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
                whole = np.packbits(bits, axis=2, bitorder="little")
                wide = np.zeros((len(rows), BLOCK, 4), np.uint8)
                wide[:, :, : whole.shape[2]] = whole
                diffs[rows] = wide.view("<u4")[:, :, 0]
        row = np.repeat(np.arange(len(begin)), n_over)
        if len(row):
            order = np.arange(len(row)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
            base = begin[row] + 6 + width[row] * (BLOCK // 8)
            high = blocks[(base + n_over[row] + 4 * order)[:, None] + np.arange(4)].copy().view("<u4").ravel()
            diffs[row, blocks[base + order]] |= high << width[row].astype(np.uint32)
        parts.append((diffs + low[:, None]).ravel())
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


class TokenFile:
    """A file's documents and ids; ids are unpacked from the blocks that a range meets."""

    def __init__(self, content):
        data = np.frombuffer(content, np.uint8)
        magic, self.part, self.seq, docs, self.n_ids, n_blocks, n_bytes, n_names = HEAD.unpack(data[: HEAD.size].tobytes())
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        self.blocks = data[at : at + n_bytes]
        self.starts = data[at + n_bytes : (at := at + n_bytes + 8 * n_blocks)].copy().view("<u8")
        self.lengths = data[at : (at := at + 8 * docs)].copy().view("<u8").astype(np.int64)
        sizes = data[at : (at := at + 4 * docs)].copy().view("<u4")
        if len(data) < at + n_names:
            raise ValueError("a token file ends too soon")
        ends = np.cumsum(np.where(sizes == NULL, 0, sizes).astype(np.int64))
        text = data[at : at + n_names].tobytes()
        self.names = [None if s == NULL else text[e - s : e].decode("utf-8", "surrogatepass") for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        self.firsts = np.cumsum(self.lengths) - self.lengths

    def ids(self, first: int, n: int) -> np.ndarray:
        """n ids from place first on, fewer at the file's end."""
        n = min(n, self.n_ids - first)
        if n <= 0:
            return np.zeros(0, np.uint32)
        block = first // BLOCK
        return unpack(self.blocks, self.starts[block : -(-(first + n) // BLOCK)])[first - block * BLOCK :][:n]


def packed_file(part: int, seq: int, names: list[str | None], ids: list[np.ndarray]) -> bytes:
    """The bytes of a file, without the line end."""
    blocks, starts = pack(np.concatenate(ids) if ids else np.zeros(0, np.uint32))
    raw = [None if n is None else n.encode("utf-8", "surrogatepass") for n in names]
    text = b"".join(r or b"" for r in raw)
    lengths = np.array([len(i) for i in ids], "<u8")
    head = HEAD.pack(MAGIC, part, seq, len(ids), int(lengths.sum()), len(starts), len(blocks), len(text))
    return b"".join([head, blocks, starts.astype("<u8").tobytes(), lengths.tobytes(), np.array([NULL if r is None else len(r) for r in raw], "<u4").tobytes(), text])


# --- encoding


class Encoder:
    """Ids of texts by the tokenizers library, whose model gets each distinct word once while it is remembered.

    The library's normalizer and pre-tokenizer do nothing to Latin-1 words but to lower them and to write
    bytes as letters; so texts of such words are cut here, by the file's own pattern, and go to the
    library's model word by word. Other pieces of texts, between spaces, go through the whole library.
    """

    #: The normalizer and the pattern of the files for which that holds.
    FOLDED = ["NFC", "Replace", "Lowercase"]
    SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    #: The letters and numbers of Latin-1 in lower case, for the same pattern.
    LETTERS, NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
    #: Beyond Latin-1, or white space that only one of the two pattern languages knows.
    FOREIGN = "[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\xff]"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile(f"{self.FOREIGN}|(?i:{'|'.join(special)})" if special else self.FOREIGN).search
        # letters are tried first: of the alternatives only those from an apostrophe and the last one may begin alike
        short, letters, number, other = self.SPLIT.replace("\\p{L}", self.LETTERS).replace("\\p{N}", self.NUMBERS).rsplit("|", 3)
        self.words = re.compile("|".join([letters, number, short, other])).findall
        self.by_words = self._splits(path)
        self.letters = {b: c for c, b in byte_letters().items()}
        self.memo: dict[str, bytes] = {}

    @classmethod
    def _splits(cls, path: str) -> bool:
        """Whether the file normalizes and cuts texts so; other files' texts go to the library whole."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        folds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kept = [c.get("pattern", {}).get("Regex") for c in cuts] == [cls.SPLIT, None] and cuts[1]["type"] == "ByteLevel" and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
        return folds == cls.FOLDED and kept and plain and not spec.get("post_processor")

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        """Ids of words in lower case."""
        if len(self.memo) + len(words) > MEMO:
            self.memo.clear()
        for w in words.difference(self.memo):
            raw = w if w.isascii() and w.isprintable() else "".join(map(self.letters.__getitem__, w.encode()))
            ids = [t.id for t in self.model.tokenize(raw)]
            self.memo[w] = struct.pack(f"<{len(ids)}I", *ids)

    def _joined(self, words: list[str]) -> bytes:
        parts = []
        for at in range(0, len(words), MEMO // 2):
            some = words[at : at + MEMO // 2]
            new = set(some).difference(self.memo)
            if new:
                self.learn(set(some) if len(self.memo) + len(new) > MEMO else new)
            parts.append(b"".join(map(self.memo.__getitem__, some)))
        return b"".join(parts)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, as the library gives them without special tokens around."""
        if not self.by_words:
            return [np.frombuffer(i, "<u4") for i in self.library(texts)]
        return [np.frombuffer(b"".join(part for span in _spans(text) for part in self._parts(span)), "<u4") for text in texts]

    def _parts(self, text: str) -> Iterator[bytes]:
        if not self.odd(text):
            yield self._joined(self.words(text.lower()))
            return
        plain: list[str] = []
        for piece in text.replace("\n", " ").split(" "):
            if self.odd(piece):
                yield self._joined(self.words(" ".join(plain).lower()))
                yield from self.library([piece])
                plain = []
            else:
                plain.append(piece)
        yield self._joined(self.words(" ".join(plain).lower()))


def _spans(text: str) -> Iterator[str]:
    """A text in parts of about SPAN characters, cut before spaces, over which no token reaches."""
    at = 0
    while len(text) - at > SPAN and (cut := text.find(" ", at + SPAN)) >= 0:
        yield text[at:cut]
        at = cut
    yield text[at:]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# --- tables


def encoded(docs: DataFrame, vocab_path: str, *, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, ids) of each whole text: little-endian 32-bit ids as binary, end_id behind; null texts are empty.

    key tells rows of one id apart. vocab_path is a file that every executor can read.
    """

    def run(batches):
        by = encoder(vocab_path)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [i.tobytes() + end for i in by.encode([t or "" for t in part["text"].to_pylist()])]
                yield pa.record_batch([part["id"], part["key"], pa.array(ids, pa.binary())], names=["id", "key", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key long, ids binary")


def _write(rows: DataFrame, ids_of, path: str, limit: int) -> None:
    """Files of rows (id, key, value) in order; ids_of returns the ids of some rows' values."""

    def run(batches):
        part, seq, names, held, size = TaskContext.get().partitionId(), 0, [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                for name, ids in zip(some["id"].to_pylist(), ids_of(some["value"]), strict=True):
                    names.append(name)
                    held.append(ids)
                    size += len(ids)
                    if size >= limit:
                        yield pa.record_batch([pa.array([packed_file(part, seq, names, held)], pa.binary())], names=["file"])
                        seq, names, held, size = seq + 1, [], [], 0
        if held:
            yield pa.record_batch([pa.array([packed_file(part, seq, names, held)], pa.binary())], names=["file"])

    dealt = rows.repartitionByRange("id", "key").sortWithinPartitions("id", "key", "value")
    files = dealt.select(F.col("id").cast("string").alias("id"), "value").mapInArrow(run, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def write_files(tokens: DataFrame, path: str, *, limit: int = FILE_IDS) -> None:
    """Writes the ids of (id, key, ids) under path, documents by ascending id, nulls first.

    Rows are range-partitioned by (id, key) and sorted within; a task's files are numbered (part, seq).
    A file ends with the document that brings it to limit ids: documents aren't cut, so a longer one
    has a file of its own. Rows of one id go by key, repeated rows follow one another. Files go through
    Spark's text writer, hence its commit protocol and any file system. An empty table writes no file.
    """
    _write(tokens.select("id", "key", F.col("ids").alias("value")), lambda values: [np.frombuffer(v.as_buffer(), "<u4") for v in values], path, limit)


def write_texts(docs: DataFrame, path: str, vocab_path: str, *, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = FILE_IDS) -> None:
    """write_files of the ids of docs' texts. Texts are dealt, which take less room than ids, and encoded where they are written."""
    end = np.array([] if end_id is None else [end_id], "<u4")

    def ids_of(values):
        return [np.concatenate([i, end]) for i in encoder(vocab_path).encode([t or "" for t in values.to_pylist()])]

    _write(docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("value")), ids_of, path, limit)


def read_files(spark: SparkSession, path: str, id_type: str = "long", *, with_ids: bool = True) -> DataFrame:
    """(doc_id, part, seq, at, n_tokens, ids_crc32, ids) of the files under path, a row a document.

    at is a document's place in its file; ids, an array of longs, only with_ids. Files that are no token
    files or end too soon are errors.
    """
    kinds = {"doc_id": pa.string(), "part": pa.int64(), "seq": pa.int64(), "at": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int64())} if with_ids else {})

    def batch(rows):
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))

    def run(batches):
        for b in batches:
            for content in b["content"]:
                f = TokenFile(content.as_buffer())
                rows, size = [], 0
                for first in range(0, len(f.names), 4096):
                    last = min(first + 4096, len(f.names))
                    low = int(f.firsts[first])
                    some = f.ids(low, int(f.firsts[last - 1] + f.lengths[last - 1]) - low)
                    for i in range(first, last):
                        at, n = int(f.firsts[i]), int(f.lengths[i])
                        ids = some[at - low : at - low + n]
                        rows.append((f.names[i], f.part, f.seq, at, n, zlib.crc32(ids.astype("<u4", copy=False)), ids.astype(np.int64) if with_ids else None))
                        size += n if with_ids else 1
                        if size > 1 << 18:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = files.mapInArrow(run, f"doc_id string, part long, seq long, at long, n_tokens long, ids_crc32 long{', ids array<long>' if with_ids else ''}")
    return rows.withColumn("doc_id", F.col("doc_id").cast(DataType.fromDDL(id_type)))


def with_starts(rows: DataFrame) -> DataFrame:
    """rows of read_files with start, the ids of all documents before: files are summed in parts, parts in order."""
    files = written(rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n")), "token-files")
    in_part = F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")
    # one row a range partition
    parts = files.groupBy("part").agg(F.sum("n").alias("n")).select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    firsts = files.select("part", "seq", in_part.alias("in_part")).join(parts, F.col("part") == F.col("p")).select("part", "seq", (F.col("before") + F.col("in_part")).alias("first"))
    few = files.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(firsts) if few else firsts, ["part", "seq"]).withColumn("start", F.col("first") + F.col("at")).drop("first")


def stored(docs: DataFrame, vocab_path: str, *, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = FILE_IDS) -> DataFrame:
    """Encodes docs, writes token files into the shared folder and reads them back: (doc_id, start, n_tokens, ids_crc32).

    Null and empty texts have only the end id (none without one); null ids come first; repeated rows are
    documents of their own; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    path = scratch(spark, "token-files")
    write_texts(docs, path, vocab_path, end_id=end_id, id_col=id_col, text_col=text_col, limit=limit)
    rows = written(read_files(spark, path, docs.schema[id_col].dataType.simpleString(), with_ids=False), "token-rows")
    return with_starts(rows).select(F.col("doc_id").alias(id_col), "start", "n_tokens", "ids_crc32")
