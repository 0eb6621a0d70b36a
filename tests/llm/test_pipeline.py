"""The pipeline's stages, each against a brute-force version of its decisions."""

from __future__ import annotations

from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    from eventloom.llm.common import written

    docs, sizes = spark.read.parquet(f"{sf}/documents.parquet"), []
    assert 4 <= len(pipeline.STAGES) <= 5
    for name, stage in pipeline.STAGES:
        out = written(stage(spark, docs, sf), "test")
        before, after = docs.collect(), out.collect()
        if name != "BPE":
            assert out.columns == docs.columns
        if name == "language ID":
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} <= {r["doc_id"] for r in before if sum(c.isalpha() for c in r["text"] or "") < 20}
        if name == "SimHash near-dedup":
            sets = {r["doc_id"]: shingles(r["text"]) for r in before}
            stay = {r["doc_id"] for r in after}
            for i, s in sets.items():
                close = [j for j, t in sets.items() if j != i and len(s & t) >= 0.8 * len(s | t)]
                assert close if i not in stay else not [j for j in close if j in stay]
        if name == "line dedup":
            assert {r["doc_id"]: r["text"] for r in after} == first_lines({r["doc_id"]: r["text"] for r in before})
        if name == "mixing":
            times = Counter(r["doc_id"] for r in after)
            assert max(times.values()) <= 2 and set(times) <= {r["doc_id"] for r in before}
            size, of = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in before}, {r["doc_id"]: r["source"] for r in before}
            sources = sorted(set(of.values()))
            sizes_of = {s: sum(size[i] for i in of if of[i] == s) for s in sources}
            due = level(sizes_of, {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)})
            for s in sources:
                got = sum(size[i] * n for i, n in times.items() if of[i] == s)
                assert abs(got - due[s]) <= max(size[i] for i in of if of[i] == s)
        sizes.append(len(after))
        docs = out
    assert sizes[0] >= 0.98 * 200 and sizes[3] == sizes[4]
    assert pipeline.run(spark, sf).count() == sizes[-1]


def first_lines(texts):
    """Of lines in ten documents or more the first occurrence stays; documents left blank by that go."""
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    of, first, out = {}, {}, {}
    for i in sorted(texts):
        for k, line in enumerate((texts[i] or "").split("\n")):
            of.setdefault(key(line), set()).add(i)
            first.setdefault(key(line), (i, k))
    for i in texts:
        lines = (texts[i] or "").split("\n")
        kept = [x for k, x in enumerate(lines) if not key(x) or len(of[key(x)]) < 10 or first[key(x)] == (i, k)]
        if len(kept) == len(lines) or "".join(kept).strip(" \t\n\x0b\x0c\r"):
            out[i] = "\n".join(kept)
    return out


def level(sizes, weights):
    """Shares of 1.5 times all words by weight, at most twice a source's size each: by repeated sharing."""
    due, left, active = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
    while active:
        unit = left / sum(weights[s] for s in active)
        over = {s for s in active if unit * weights[s] > 2 * sizes[s]}
        for s in over or active:
            due[s] = min(unit * weights[s], 2.0 * sizes[s])
        if not over:
            return due
        left -= sum(due[s] for s in over)
        active -= over
    return due


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_odd_rows(spark):
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, "the words of a text in a language", "en", "a", 33), (3, "the words of a text in a language", "en", "a", 33), (None, "le texte sans aucun nom de ligne", "fr", None, 30), (5, "12 34", "en", "b", 5)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size string, taken int")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() >= 0 and stage(spark, docs.limit(0), "").count() == 0
        if name != "BPE":
            assert out.columns == docs.columns


#: Names that operators add or use themselves, of another type than theirs.
OWN_NAMES = (
    "kept n_lines n_dropped score lang_pred _doc _rk _d _k _rest _row rk dropped size taken target source_size pattern stays keep_id fp fingerprint component_id ids n_tokens decoded n h1 h2 at pos line key word bits first "
    "held_out c0 c1 _ n_copies copies rank id row"
).split()


def test_columns_of_clashing_names_stay(spark, sf):
    """Every value of every other column comes out as it went in, with its type and place."""
    from pyspark.sql import functions as F

    from eventloom.llm.common import written

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.lit(":"), "doc_id") for c in OWN_NAMES})
    docs = docs.select(*OWN_NAMES[:9], "text", "doc_id", *OWN_NAMES[9:], "n_chars", "source", "lang")
    for name, stage in pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf), "test")
        assert out.schema.simpleString() == docs.schema.simpleString()
        rows = out.collect()
        assert rows and all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in OWN_NAMES)
        docs = out
