"""Merkle manifests, token files and spelling variants against brute force and on awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventloom.llm import merkle, queries, spelling, tokenfile

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null and empty values, repeated rows, two texts under one id, null ids, a very long text.
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "One twoo three", "en", "b", 14), (4, "One twoo three", "en", "b", 14), (5, "other text", None, None, 10),
    (6, "yet another", "de", "c", None), (6, "and another", "de", "c", 11), (None, "without an id", "en", "c", 13), (None, None, "", None, None), (7, "été \U0001f600 12 \x00 <|endoftext|> don't", "es", "a", 9), (8, "words " * 50_000, "en", "a", 300_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    extra = {c: F.lit("x") for c in ("gid", "pos", "n", "leaf", "row", "block", "root", "proof", "key", "id", "ids", "part", "seq", "word", "_id", "_leaf", "_group", "cell")}
    return spark.createDataFrame(ODD, DOCS).withColumns(extra)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


# --- 11


def leaf_of(row):
    doc_id, text, lang, source, n = row
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)])


def way(leaves):
    """(root, per leaf the siblings on its way up) of a list of digests."""
    ways, nodes, members = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        for a in range(0, len(nodes), 2):
            for i in (a, a + 1):
                if i < len(nodes) and i ^ 1 < len(nodes):
                    for m in members[i]:
                        ways[m].append((i & 1, nodes[i ^ 1]))
                elif i < len(nodes):
                    for m in members[i]:
                        ways[m].append((None, ""))
        members = [sum(members[a : a + 2], []) for a in range(0, len(nodes), 2)]
        nodes = [sha(*nodes[a : a + 2]) for a in range(0, len(nodes), 2)]
    return nodes[0], ways


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(((r[0] is not None, r[0] or 0), leaf_of(r), r))
    ordered = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: way([x[1] for x in sorted(groups[g], key=lambda x: x[:2])]) for g in ordered}
    root, tops = way([trees[g][0] for g in ordered])
    out = []
    for g, top in zip(ordered, tops, strict=True):
        for (_, leaf, r), inner in zip(sorted(groups[g], key=lambda x: x[:2]), trees[g][1], strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            digest = leaf_of((*r[:4], r[4] + 1)) if tampered else leaf
            for side, sibling in inner + top:
                digest = sha(digest, sibling) if side != 1 else sha(sibling, digest)
            out.append((r[0], leaf, trees[g][0], root, sha(*[s for _, s in inner + top]), digest, digest == root))
    return Counter(out)


def run_manifest(spark, docs, monkeypatch=None, height=None):
    if height:
        build = merkle.build
        monkeypatch.setattr(merkle, "build", lambda *a, **k: build(*a, **k, height=height))
    monkeypatch.setattr(queries, "_table", lambda *a: docs)
    return Counter(map(tuple, queries.op11_merkle(spark, "").collect()))


@pytest.mark.parametrize("levels", range(1, 12))
def test_addresses_are_places(levels):
    places = [merkle.address(levels, d, i) for d in range(levels) for i in range(1 << d)]
    assert sorted(places) == list(range((1 << levels) - 1))
    assert merkle.address(levels, levels - 1, np.arange(1 << (levels - 1))).tolist() == places[(1 << (levels - 1)) - 1 :]
    # the upper half of the levels comes first, subtrees below it lie together
    top = max(1, levels // 2)
    assert sorted(places[: (1 << top) - 1]) == list(range((1 << top) - 1))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 11])
def test_subtree_and_siblings(n):
    leaves = [hashlib.sha256(b"%d" % i).digest() for i in range(n)]
    levels = merkle.levels_of(n, 10)
    nodes = bytearray(32 * ((1 << levels) - 1))
    root, ways = way([x.hex() for x in leaves])
    assert merkle.fill(nodes, leaves, levels).hex() == root
    sides, digests = merkle.siblings(nodes, n, levels, np.arange(n))
    for i, w in enumerate(ways):
        assert [(None if s == merkle.ALONE else int(s == merkle.LEFT), d.tobytes().hex() if s else "") for s, d in zip(sides[i], digests[i], strict=True)] == w


def test_manifest_of_odd_rows(spark, odd, monkeypatch):
    assert run_manifest(spark, odd, monkeypatch) == brute_manifest(ODD)


@pytest.mark.parametrize("height", [1, 3])
def test_manifest_over_rounds_of_blocks(spark, monkeypatch, height):
    rng = random.Random(height)
    rows = [(i * 3, f"text {i % 9}", rng.choice([None, "", "a", "a", "a", "é", "z\U0001f600", "zz"]), rng.choice([None, "s"]), rng.choice([None, i])) for i in range(90)]
    rows += rows[:7]
    got = run_manifest(spark, spark.createDataFrame(rows, DOCS).repartition(5), monkeypatch, height)
    assert got == brute_manifest(rows) and {r[-1] for r in got} == {True, False}


def test_manifest_of_one_and_none(spark, none, monkeypatch):
    assert run_manifest(spark, none, monkeypatch) == Counter()
    assert run_manifest(spark, spark.createDataFrame(ODD[3:4], DOCS), monkeypatch) == brute_manifest(ODD[3:4])


def test_manifest_is_kept(spark, odd, tmp_path):
    """A saved manifest proves what the built one does."""
    built = merkle.build(odd, fields=["doc_id", "text"], height=2)
    merkle.save(built, str(tmp_path / "m"))
    back = merkle.load(spark, str(tmp_path / "m"))
    got = sorted(map(repr, merkle.prove(back).collect()))
    assert got == sorted(map(repr, merkle.prove(built).collect())) and len(got) == len(ODD)
    assert merkle.prove(back).filter(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


# --- 12


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["small", "constant", "outliers", "wide", "rising"])
@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_blocks_round_trip(kind, n):
    rng = np.random.default_rng(n)
    ids = {"small": rng.integers(0, 9, n), "constant": np.full(n, 7), "outliers": np.where(rng.random(n) < 0.08, rng.integers(0, 1 << 32, n), rng.integers(100, 130, n)), "wide": rng.integers(0, 1 << 32, n), "rising": np.arange(n) * 50_021 % (1 << 32)}[kind].astype(np.uint32)
    blocks, starts = tokenfile.pack(ids)
    assert len(starts) == -(-n // tokenfile.BLOCK)
    assert tokenfile.unpack(np.frombuffer(blocks, np.uint8), starts)[:n].tolist() == ids.tolist()
    if kind == "outliers" and n == 1000:  # outliers don't widen their blocks
        assert len(blocks) < 2 * n


def test_file_reads_ranges():
    rng = np.random.default_rng(5)
    ids = [rng.integers(0, 49_408, n).astype("<u4") for n in (0, 1, 300, 128, 0, 5000)]
    f = tokenfile.TokenFile(tokenfile.packed_file(3, 4, ["a", None, "é", "", "e", "f"], ids) + b"\n")
    assert (f.part, f.seq, f.names, f.lengths.tolist()) == (3, 4, ["a", None, "é", "", "e", "f"], [len(i) for i in ids])
    whole = np.concatenate(ids)
    for first, n in itertools.product((0, 1, 127, 128, 400, 5428), (0, 1, 129)):
        assert f.ids(first, n).tolist() == whole[first : first + n].tolist()
    with pytest.raises(ValueError):
        tokenfile.TokenFile(b"WRONGMAG" + bytes(64))


def test_encoder_is_the_library():
    path, rng = queries.tokenizer_path(queries.WORD_TOKENIZER), random.Random(3)
    parts = list("aA'sStTreve mlld0129²½ é É ß İ Σσ́̌J K!?.,<|>-_\t\n\r\x0b\x0c\x1c\x1f\x85\xa0   ªº­日\U0001f600‍") + ["<|endoftext|>", "<|startoftext|>", "'s", "'re", "<|ENDOFTEXT|>", "<|endof", "text|>", "word" * 40]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(20_000)]
    own, want = tokenfile.Encoder(path), library(path)
    assert own.by_words
    for at in range(0, len(texts), 3000):
        assert [i.tolist() for i in own.encode(texts[at : at + 3000])] == [want(t) for t in texts[at : at + 3000]]
    other = queries.tokenizer_path()
    plain, want = tokenfile.Encoder(other), library(other)
    assert not plain.by_words and [i.tolist() for i in plain.encode(texts[:200])] == [want(t) for t in texts[:200]]


def test_long_texts_are_encoded_in_spans(monkeypatch):
    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    own, want = tokenfile.Encoder(path), library(path)
    monkeypatch.setattr(tokenfile, "SPAN", 7)
    monkeypatch.setattr(tokenfile, "MEMO", 9)
    texts = ["don't stop  the words\nof café 日本 it's <|endoftext|> 'sab 12 34 " * 5, " " * 30, "x" * 40, "a b c d e f g h i j k l m n o p", ""]
    assert [i.tolist() for i in own.encode(texts)] == [want(t) for t in texts]


def brute_tokens(rows, path):
    encode, at, out = library(path), 0, []
    for r in rows:
        ids = [*encode(r[1]), 1]
        out.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("limit", [5, 1 << 24])
def test_token_files(spark, odd, limit):
    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    got = sorted(map(tuple, tokenfile.stored(odd, path, end_id=1, limit=limit).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in ODD), key=lambda i: (i is not None, i or 0))
    assert Counter((i, n, c) for i, _, n, c in got) == Counter((i, n, c) for i, _, n, c in brute_tokens(ODD, path))
    assert [r[1] for r in got] == [0, *itertools.accumulate(r[2] for r in got)][:-1]


def test_token_files_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert sorted(map(tuple, queries.op12_tokenfile(spark, sf).collect())) == brute_tokens(rows, path)


def test_token_ids_come_back(spark, odd, none, tmp_path):
    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    tokenfile.write_files(tokenfile.encoded(odd, path), str(tmp_path / "t"), limit=50)
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in tokenfile.read_files(spark, str(tmp_path / "t")).collect())
    assert got == Counter((r[0], tuple(library(path)(r[1]))) for r in ODD)
    assert tokenfile.stored(none, path, end_id=1).count() == 0
    words = odd.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r[0] for r in tokenfile.stored(words, path).collect()} == {None if r[0] is None else f"d{r[0]}" for r in ODD}


# --- 13


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio=2):
    near = defaultdict(list)
    for a, b in itertools.combinations(counts, 2):
        if edits(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("sizes", [(4096, 24, 20_000), (8, 2, 40), (3, 1, 3)])
def test_variants(spark, monkeypatch, sizes):
    for name, size in zip(("CELL", "LEAF", "SAMPLE"), sizes, strict=True):
        monkeypatch.setattr(spelling, name, size)
    rng = random.Random(sizes[0])
    counts = {"".join(rng.choices("abcéï\U0001f600", k=rng.randint(1, 6))): 3 * 2 ** rng.randint(0, 12) for _ in range(150)}
    # anagrams share their letter counts: a cell that no cut divides
    counts |= {"".join(p): rng.randint(3, 40) for p in itertools.permutations("aabbc")}
    counts["word" * 500] = 3
    counts["word" * 499 + "wor"] = 50
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert len(got) == len(counts) and set(map(tuple, got)) == brute_variants(counts)


def test_roots_of_long_ways(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w5"), ("y", "z")]
    got = {r[0]: r[1] for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {f"w{i}": "w37" for i in range(37)} | {"x": "w37", "y": "z"}


def brute_words(rows, every, chars, least):
    counts = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{r[0]}:{run}".encode())
            if r[0] is not None and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= chars:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least}


@pytest.mark.parametrize("every", [1, 3, 97])
def test_vocabulary(spark, odd, sf, every):
    extra = [(20 + i, "Étés ÷×abc twoo TWOO words" * 3, None, None, None) for i in range(4)]
    docs = odd.select(*DOCS.replace(" long", "").replace(" string", "").split(", ")).unionByName(spark.createDataFrame(extra, DOCS))
    got = spelling.vocabulary(docs, min_chars=4, min_count=2, corrupt_every=every).collect()
    assert dict(map(tuple, got)) == brute_words(ODD + extra, every, 4, 2) and len(got) == len(set(r[0] for r in got))


def test_no_words(spark, none):
    assert spelling.variants(spelling.vocabulary(none)).count() == 0
