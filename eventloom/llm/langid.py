"""Language ID: bit-sliced Bloom filters of character trigrams, popcounts per language."""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, widened, written

#: Slots of the filter (a power of two), probes per n-gram, languages of a word of a slot, and words of a slot at most.
SLOTS, PROBES, LANGUAGES, WORDS = 1 << 18, 3, 63, 16
#: A trigram is put into a language's filter if its rate there is at least this share of its highest rate ...
SHARE = 0.3
#: ... and if it makes up at least this part of the language's trigrams.
LEAST = 2e-6
#: Characters whose trigrams are counted at once.
SPAN = 1 << 20
UND = "und"
PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """For each code point the lower-case letter's code point, or 0 if it is no letter."""
    table = np.zeros(0x110000, dtype=np.int64)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def trigrams(text: str, at: int = 0, end: int | None = None) -> np.ndarray:
    """Codes of the trigrams around the text's letters from place at to before end: 21 bits a character.

    Runs of letters have one gap (0) before and after, so trigrams across a gap between words aren't
    formed; empty if there is no letter. Spans that cut a text give the trigrams of the whole, each once.
    """
    end = len(text) if end is None else min(end, len(text))
    chars = folding()[np.frombuffer(text[max(0, at - 1) : end + 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    chars = np.concatenate([[0] * (at == 0), chars, [0] * (end == len(text))]).astype(np.int64)
    codes = chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:]
    return codes[chars[1:-1] != 0]


def slots(codes: np.ndarray, n: int = SLOTS) -> np.ndarray:
    """The PROBES slots of each code, one row a probe."""
    mixed = codes.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * PRIMES[0]
    out = [((mixed ^ (mixed >> np.uint64(31))) * p) >> np.uint64(64 - n.bit_length() + 1) for p in PRIMES[:PROBES]]
    return np.stack(out).astype(np.int64)


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) over all docs; each task counts its text before anything is shuffled, a span at a time."""

    @lean("langid", folding.cache_clear)
    def run(batches):
        sums, held, room = {}, {}, SPAN

        def count():
            """Moves the trigrams held into the sums, so that a worker holds a span and distinct trigrams only."""
            for lang, parts in held.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                if lang in sums:
                    grams, at = np.unique(np.concatenate([sums[lang][0], grams]), return_inverse=True)
                    both, n = np.concatenate([sums[lang][1], n]), np.zeros(len(grams), dtype=np.int64)
                    np.add.at(n, at, both)
                sums[lang] = grams, n
            held.clear()

        def counted():
            for lang, (grams, n) in sums.items():
                yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
            sums.clear()

        for b in batches:
            for text, lang in zip(b["text"], b["lang"], strict=True):
                s = text.as_py()
                for at in range(0, len(s), SPAN):
                    held.setdefault(lang.as_py(), []).append(trigrams(s, at, at + SPAN))
                    room -= SPAN if len(s) > SPAN else len(s)
                    if room < 0:
                        count()
                        room = SPAN
                        if sum(len(g) for g, _ in sums.values()) > SPAN:
                            yield from counted()
        count()
        yield from counted()

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model: languages, the bit-sliced filter and, per language, its false positive rate.

    All texts with a language count. A trigram enters the filters of the languages for which it is
    characteristic (SHARE, LEAST): in each of its PROBES slots the bits of these languages are set.
    A slot has a word for each LANGUAGES languages, up to WORDS of them (more languages raise an
    error). The driver gets the filter only, SLOTS longs a word, whatever the corpus.
    """
    counts = written(gram_counts(docs, text_col, lang_col), "trigrams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(WORDS * LANGUAGES + 1).collect()}
    if len(totals) > WORDS * LANGUAGES:
        raise ValueError(f"more than {WORDS * LANGUAGES} languages")
    names = sorted(totals)
    words = max(1, -(-len(names) // LANGUAGES))
    filter_ = np.zeros((words, SLOTS), dtype=np.int64)
    if names:
        spark = docs.sparkSession
        known = spark.createDataFrame([(n, i // LANGUAGES, i % LANGUAGES, float(totals[n])) for i, n in enumerate(names)], "lang string, word int, bit int, total double")
        rates = counts.join(F.broadcast(known), "lang").withColumn("rate", F.col("n") / F.col("total")).filter(F.col("rate") >= LEAST)
        # a trigram has one row a language; the largest rates go first
        grams = rates.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("rate", "word", "bit")).alias("of"))

        def mask(word: int) -> Column:
            own = F.filter("of", lambda x: (x["rate"] >= SHARE * F.col("top")) & (x["word"] == word))
            return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["bit"])))

        masked = grams.select("gram", F.posexplode(F.array(*[mask(w) for w in range(words)])).alias("word", "mask")).filter("mask <> 0")

        @lean("langid", folding.cache_clear)
        def spread(batches):
            for b in batches:
                at = slots(np.asarray(b["gram"]))
                yield pa.record_batch([pa.array(at.ravel()), pa.array(np.tile(np.asarray(b["word"]), PROBES)), pa.array(np.tile(np.asarray(b["mask"]), PROBES))], names=["slot", "word", "mask"])

        bits = masked.mapInArrow(spread, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
        filter_[np.asarray(bits["word"].combine_chunks()), np.asarray(bits["slot"].combine_chunks())] = np.asarray(bits["mask"].combine_chunks())
    discard(counts)
    fill = [float(((filter_[i // LANGUAGES] >> (i % LANGUAGES)) & 1).mean()) for i in range(len(names))]
    return {"names": names, "filter": filter_, "false": np.array([f**PROBES for f in fill]), "common": max(totals, key=lambda n: (totals[n], n)) if totals else UND}


def decide(text: str | None, model: dict) -> tuple[str, float]:
    """(language, score): the most popcounts after correction; score: the corrected part of trigrams found."""
    counts, total = np.zeros(len(model["names"])), 0
    for at in range(0, len(text or ""), SPAN):
        codes = trigrams(text, at, at + SPAN)
        total += len(codes)
        if len(codes) and len(counts):
            probes = slots(codes)
            for w, own in enumerate(model["filter"]):
                masks = own[probes[0]] & own[probes[1]] & own[probes[2]]
                some = range(w * LANGUAGES, min(len(counts), (w + 1) * LANGUAGES))
                counts[some] += [np.count_nonzero(masks & (1 << (i % LANGUAGES))) for i in some]
    if not total or not len(counts):
        return UND, 0.0
    fair = np.clip((counts - total * model["false"]) / np.maximum(1e-9, 1 - model["false"]), 0, total)
    best = int(fair.argmax())
    return (model["names"][best], float(fair[best] / total)) if fair[best] > 0 else (model["common"], 0.0)


def identify(docs: DataFrame, model: dict, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1).

    und and 0 if the text is null or has no letter, or if the model knows no language. A text
    without any known trigram gets the language with most training text and score 0. Repeated rows are
    judged alike; an empty table gives no rows; columns named lang_pred or score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    rows = docs.drop("lang_pred", "score")

    @lean("langid", folding.cache_clear)
    def run(batches):
        own = pickle.loads(shared.value)
        for b in batches:
            found = [decide(t.as_py(), own) for t in b[text_col]]
            yield pa.record_batch([*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(run, widened(rows, lang_pred="string", score="double"))


def usual_scores(docs: DataFrame, model: dict, *, text_col: str = "text", lang_col: str = "lang") -> dict[str, float]:
    """The median score of each language's documents that the model gives their own language.

    Of documents that the model was not trained on, these tell which scores a language's texts have,
    whatever the size of the corpus and however many trigrams the language has. Documents without text
    or language don't count; a language without any is left out. The driver gets a number a language.
    """
    found = identify(docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), model)
    right = found.filter(F.col("lang") == F.col("lang_pred")).groupBy("lang").agg(F.percentile_approx("score", 0.5).alias("usual"))
    return {r["lang"]: r["usual"] for r in right.collect()}


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
