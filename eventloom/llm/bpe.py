"""BPE encoding and decoding by a prefix-sharing trie of distinct words."""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, widened

#: How byte-level BPE splits a text into words before merging (the public pattern of this family).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose encodings a worker keeps; when full they are forgotten and encoded again on demand.
MEMO = 600_000
#: Characters of text that are split and encoded at once.
SPAN = 1 << 20


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file: encoding of words by trie traversal, decoding of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in spec["model"]["vocab"]}
        self.id = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        table = {i: b for b, i in self.id.items()} | {i: t.encode() for t, i in self.special.items()}
        self.bytes = [table.get(i, b"") for i in range(max(table) + 1)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(self.id[raw[a]], self.id[raw[b]]): (r, self.id[raw[a + b]]) for r, (a, b) in enumerate(pairs)}
        self.single = [self.id[bytes([b])] for b in range(256)]
        self.longest = max(map(len, self.id))
        self.whole: dict[bytes, bool] = {}
        self.fits: dict[int, bool] = {}
        self.split = regex.compile(WORDS)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo: dict[str, bytes] = {}
        self.decode_table = _table(self.bytes)
        self.decimal_table = _table([b"%d," % i for i in range(len(self.bytes))])

    def merged(self, text: bytes) -> list[int]:
        """Plain merging by rank; only for strings of one or two tokens."""
        ids = [self.single[b] for b in text]
        while len(ids) > 1:
            best = min((self.rank.get(p, (1 << 30, 0))[0] for p in zip(ids, ids[1:], strict=False)), default=1 << 30)
            if best == 1 << 30:
                break
            out, i = [], 0
            while i < len(ids):
                hit = self.rank.get((ids[i], ids[i + 1])) if i + 1 < len(ids) else None
                if hit and hit[0] == best:
                    out.append(hit[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _whole(self, token: bytes) -> bool:
        """Whether merging the token's bytes gives the token."""
        ok = self.whole.get(token)
        if ok is None:
            ok = self.whole[token] = self.merged(token) == [self.id[token]]
        return ok

    def _fits(self, a: int, b: int) -> bool:
        """Whether the tokens a, b stay apart when their joined bytes are merged."""
        ok = self.fits.get(a << 20 | b)
        if ok is None:
            if len(self.fits) > 4 * MEMO:
                self.fits.clear()
            ok = self.fits[a << 20 | b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return ok

    def traverse(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each of the sorted distinct words.

        Sorted order is the depth-first order of the words' trie: the path from the root is the stack
        `last`, whose entry d is the last token of the encoding of the first d bytes. Going from one
        word to the next keeps the states of their common prefix. A state follows from those above:
        the last token is the suffix t for which the prefix before t ends in a token that fits t
        (any two neighbours of an encoding fit, and only one sequence of fitting tokens exists).
        The ids are read back along the path, last token first.
        """
        vocab, last, before, out = self.id, [-1], b"", []
        for word in words:
            keep, top = 0, min(len(word), len(before))
            while keep < top and word[keep] == before[keep]:
                keep += 1
            del last[keep + 1 :]
            for d in range(keep + 1, len(word) + 1):
                for a in range(max(0, d - self.longest), d):
                    t = vocab.get(word[a:d])
                    if t is not None and (self._whole(word[a:d]) if a == 0 else self._fits(last[a], t)):
                        break
                last.append(t)
            ids, d = [], len(word)
            while d:
                ids.append(last[d])
                d -= len(self.bytes[last[d]])
            out.append(ids[::-1])
            before = word
        return out

    def learn(self, words: set[str]) -> None:
        """Encodes what isn't in the memo."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = words - self.memo.keys()
        raw = sorted((w.encode("utf-8"), w) for w in new)
        for (_, w), ids in zip(raw, self.traverse([b for b, _ in raw]), strict=True):
            self.memo[w] = np.array(ids, dtype="<i4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts. Strings of special tokens in a text become these tokens."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        room = SPAN

        def flush():
            self.learn({w for _, ws in held for w in ws})
            for i, ws in held:
                out[i].append(b"".join(map(self.memo.__getitem__, ws)))
            held.clear()

        for i, text in enumerate(texts):
            for part in self.special_split.split(text) if self.special_split and any(s in text for s in self.special) else [text]:
                if part in self.special:
                    flush()
                    out[i].append(np.array([self.special[part]], dtype="<i4").tobytes())
                    continue
                some: list[str] = []
                for w in self.split.findall(part) if len(part) <= SPAN else (m[0] for m in self.split.finditer(part)):
                    some.append(w)
                    if len(some) >= SPAN // 4:
                        held.append((i, some))
                        flush()
                        some, room = [], SPAN
                held.append((i, some))
                room -= len(part)
                if room < 0:
                    flush()
                    room = SPAN
        flush()
        return [np.frombuffer(b"".join(x), dtype="<i4") for x in out]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return _gather(self.decode_table, ids).decode("utf-8", errors="replace")

    def decimals(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return _gather(self.decimal_table, ids)[:-1]


def _table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    return np.frombuffer(b"".join(strings), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def _gather(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
    """The strings of ids one after the other, a bounded number at a time."""
    flat, starts, sizes = table
    parts = []
    for at in range(0, len(ids), SPAN):
        some = ids[at : at + SPAN]
        n = sizes[some]
        ends = np.cumsum(n)
        parts.append(flat[np.repeat(starts[some] - (ends - n), n) + np.arange(ends[-1])].tobytes())
    return b"".join(parts)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, vocab_path: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the token ids of each whole text (array<int>; null: an empty array).

    A task splits the texts of a batch into words, encodes the distinct words it hasn't met in one
    trie traversal and looks the rest up. Nothing is shuffled. vocab_path is a byte-level BPE file
    that every executor can read. Repeated rows are encoded alike; an empty table gives no rows; a
    column named like ids_col is replaced, all others are kept.
    """

    @lean("bpe", vocabulary.cache_clear)
    def run(batches):
        vocab = vocabulary(vocab_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = vocab.encode_batch([t or "" for t in part[text_col].to_pylist()])
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
                yield pa.record_batch([*part.columns, lists], names=[*part.schema.names, ids_col])

    rows = docs.drop(ids_col)
    return rows.mapInArrow(run, widened(rows, **{ids_col: "array<int>"}))


def decode(tokens: DataFrame, vocab_path: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """tokens with the text of each row's ids (null: an empty text). Inverse of encode; other columns are kept."""

    @lean("bpe", vocabulary.cache_clear)
    def run(batches):
        vocab = vocabulary(vocab_path)
        for b in batches:
            texts = [vocab.decode(np.asarray(i.values, dtype=np.int64)) if i.is_valid else "" for i in b[ids_col]]
            yield pa.record_batch([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, text_col])

    rows = tokens.drop(text_col)
    return rows.mapInArrow(run, widened(rows, **{text_col: "string"}))


def digests(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encoding and decoding each whole text.

    One task does for a slice of documents what encode and then decode do, and returns digests
    only: ids of a large corpus needn't leave the worker.
    """

    @lean("bpe", vocabulary.cache_clear)
    def run(batches):
        vocab = vocabulary(vocab_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = vocab.encode_batch([t or "" for t in part["text"].to_pylist()])
                yield pa.record_batch(
                    [part["id"], pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(vocab.decimals(i)).hexdigest() for i in ids]), pa.array([hashlib.sha256(vocab.decode(i).encode()).hexdigest() for i in ids])],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"{id_col} {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
