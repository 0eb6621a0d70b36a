"""Secret scans: a trigram inverted index picks the documents in which each rule is tried."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, discard, row_key, written

#: Alternatives of a rule beyond which its query is given up (the rule then scans all documents).
MOST_CLAUSES = 64
#: Letters that prose is full of. They only order the trigrams of a clause.
FREQUENT = " etaoinshrdlu"


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose `group` has fewer than `least` characters are dropped. any_case: A-Z as a-z."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False
    base: bool = False


#: The three base rules, in the order of their kinds, and further rules of well-known credential formats.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, False, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, False, True),
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |)PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}"),
)


def _runs(tree) -> list[list[str]] | None:
    """Alternatives of a parsed pattern, each a list of literal runs that a match must hold; a '' parts runs."""
    out: list[list[str]] = [[""]]
    for op, arg in tree:
        if op is ops.LITERAL:
            some = [[chr(arg)]]
        elif op is ops.IN and len(arg) <= 8 and all(o is ops.LITERAL for o, _ in arg):
            some = [[chr(a)] for _, a in arg]
        elif op is ops.SUBPATTERN:
            some = _runs(arg[3])
        elif op is ops.BRANCH:
            parts = [_runs(a) for a in arg[1]]
            some = None if any(p is None for p in parts) else [x for p in parts for x in p]
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            low, high, inner = arg
            inner = _runs(inner)
            if inner is None:
                return None
            if low == high == 1 or (low, high) == (0, 1):
                some = inner + ([[""]] if low == 0 else [])
            elif low:
                some = [[*x, "", ""] for x in inner]
            else:
                some = [["", "", ""]]
        else:
            some = [["", "", ""]]
        if some is None or len(out) * len(some) > MOST_CLAUSES * 8:
            return None
        out = [[*a[:-1], a[-1] + b[0], *b[1:]] for a, b in product(out, some)]
    return out


def trigram_query(rule: Rule) -> list[frozenset[str]] | None:
    """The rule's Boolean query: one of the sets of trigrams must be there whole. None: scan fully.

    Trigrams are those of the text with A-Z in lower case, whatever the rule's case.
    """
    runs = _runs(parser.parse(rule.pattern))
    if runs is None:
        return None
    clauses = {frozenset(run[i : i + 3] for r in alt if (run := r.lower()) for i in range(len(run) - 2)) for alt in runs}
    clauses = {c for c in clauses if not any(d < c for d in clauses)}
    return None if frozenset() in clauses or len(clauses) > MOST_CLAUSES else sorted(clauses, key=sorted)


def java_pattern(rule: Rule) -> str:
    """The rule for Spark's regular expressions. A lone repeated class takes its least length: its matches are whole runs."""
    tree = parser.parse(rule.pattern)
    lone = len(tree) == 1 and tree[0][0] is ops.MAX_REPEAT and tree[0][1][0] == 1 and tree[0][1][2][0][0] is ops.IN and rule.pattern.endswith("+")
    pattern = f"{rule.pattern[:-1]}{{{rule.least},}}" if lone and not rule.group else rule.pattern
    return ("(?i)" if rule.any_case else "") + pattern


def _rarest(gram: str) -> tuple[int, str]:
    return sum(c in FREQUENT for c in gram), gram


def candidate(low: Column, rule: Rule) -> Column:
    """Whether a single text (low: with A-Z in lower case) fits the rule's query, told without an index; true for rules that scan fully.

    For texts in hand, and to hold candidates() against; scan() goes by the index.
    """
    query = trigram_query(rule)
    if query is None:
        return F.lit(True)

    def intersected(grams) -> Column:
        return reduce(Column.__and__, [F.contains(low, F.lit(g)) for g in sorted(grams, key=_rarest)], F.lit(True))

    shared = frozenset.intersection(*query)
    return intersected(shared) & reduce(Column.__or__, [intersected(c - shared) for c in query])


def index(rows: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index of rows (_doc, _rk, _low): a posting (gram, _doc, _rk) for each row that holds grams[gram].

    Written to the shared folder; each file is a segment, in which a trigram's list is in one piece,
    so that readers of a few lists skip the rest. Texts aren't moved.
    """
    held = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return written(rows.select(F.explode(held).alias("gram"), "_doc", "_rk").sortWithinPartitions("gram"), "postings")


def rarest_first(clauses: list[frozenset[str]], sizes: dict[str, int]) -> list[list[str]]:
    """Each clause's trigrams by the lengths of their lists, shortest first; a clause with an empty list has no candidates and goes."""
    return [sorted(c, key=lambda g: (sizes[g], g)) for c in clauses if all(sizes.get(g) for g in c)]


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, list[str]] | None:
    """(_doc, _rk, tried) of the rows (_doc, _rk, _low) in some rule's postings, and the trigrams whose lists were read first.

    tried lists the rules (places) with such a clause: a clause is the intersection of its trigrams'
    posting lists, a query the union of its clauses. Lists are met rarest first, by their lengths: the
    shortest list of each clause says which rows can be candidates at all, and of all other lists
    only these rows' postings are read on and intersected. None: no rule is indexed, or no row can be a
    candidate. The driver gets the lists' lengths, a number a trigram of the rules.
    """
    queries = [(i, c) for i, r in enumerate(rules) for c in trigram_query(r) or ()]
    grams = sorted({g for _, c in queries for g in c})
    if not grams:
        return None
    postings = index(rows, grams)
    sizes = {grams[r["gram"]]: r["count"] for r in postings.groupBy("gram").count().collect()}
    place = {g: i for i, g in enumerate(grams)}
    left = [(i, c[0]) for i, q in queries for c in [rarest_first([q], sizes)] if c]
    if not left:
        discard(postings)
        return None
    first = sorted({c[0] for _, c in left})
    seeds = postings.filter(F.col("gram").isin([place[g] for g in first])).select(F.col("_doc").alias("_d"), F.col("_rk").alias("_k")).distinct()
    rest = postings.filter(F.col("gram").isin(sorted({place[g] for _, c in left for g in c})))
    # repeated rows have repeated postings
    met = rest.join(seeds, (rest["_rk"] == seeds["_k"]) & rest["_doc"].eqNullSafe(seeds["_d"]), "left_semi").groupBy("_doc", "_rk").agg(F.collect_set("gram").alias("held"))
    whole = [F.when(F.size(F.array_except(F.array(*[F.lit(place[g]) for g in c]), "held")) == 0, F.lit(i)) for i, c in left]
    few = written(met.select("_doc", "_rk", F.array_distinct(F.array_compact(F.array(*whole))).alias("tried")).filter(F.size("tried") > 0), "candidates")
    discard(postings)
    return few, first


def matches(text: Column, rule: Rule) -> Column:
    """Lengths of the gap before, of the whole and of the judged group of all leftmost non-overlapping matches."""
    pattern = java_pattern(rule)
    found = [F.split(text, pattern, -1), *[F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(g)) for g in (1, rule.group + 1)]]
    return F.arrays_zip(*[F.transform(x, F.char_length) for x in found]).cast("array<struct<gap:int,hit:int,part:int>>")


def _tries(rules: tuple[Rule, ...], due) -> Column:
    """(rank, found) of each rule that is due for a row."""
    return F.array_compact(F.array(*[F.when(due(i, r), F.struct(F.lit(i).alias("rank"), matches(F.col("_text"), r).alias("found"))) for i, r in enumerate(rules)]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans of each row: an array of (start, rank, kind, end, base), in this order.

    start and end count code points, end exclusive; rank is the rule's place. Rules whose query has
    mandatory trigrams are tried in the candidates of the index only (index and candidates are written as scan is
    called), others in all documents. Of texts, only those in a clause's rarest list go to where their
    candidates are, and none if there are so few candidates that Spark broadcasts them. Null and empty
    texts have no spans. Repeated rows have the same spans each; an empty table gives no rows; other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_doc"), row_key(F.col(id_col), F.col(text_col)).alias("_rk"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_low", ascii_lower(F.col("_text")))
    full = [trigram_query(r) is None for r in rules]
    some = rows.select("_doc", "_rk", F.explode_outer(_tries(rules, lambda i, r: F.rlike("_text", F.lit(java_pattern(r))) if full[i] else F.lit(False))).alias("t"))
    if found := candidates(rows, rules):
        few, first = found
        texts = rows.filter(reduce(Column.__or__, [F.contains("_low", F.lit(g)) for g in first])).drop("_low")
        few = few.select(F.col("_doc").alias("_d"), F.col("_rk").alias("_k"), "tried")
        both = texts.join(few, (texts["_rk"] == few["_k"]) & texts["_doc"].eqNullSafe(few["_d"]))
        tries = _tries(rules, lambda i, r: F.lit(False) if full[i] else F.array_contains("tried", i))
        some = some.unionByName(written(both.select("_doc", "_rk", F.explode(tries).alias("t")), "tries"))
        discard(found[0])
    # rows that agree in id and text are one from here on, and n again at the end
    once = some.repartition("_doc", "_rk").groupBy("_doc", "_rk", "t.rank").agg(F.count("*").alias("n"), F.first("t.found").alias("found"))
    each = once.select("_doc", "_rk", "n", "rank", F.posexplode_outer("found").alias("i", "m"))
    w = Window.partitionBy("_doc", "_rk", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap").cast("long") + F.coalesce(F.col("m.hit"), F.lit(0))).over(w)
    table = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"), F.lit(r.base).alias("base")) for r in rules])
    placed = each.withColumn("end", end).withColumn("rule", F.try_element_at(table, F.col("rank") + 1))
    span = F.struct((F.col("end") - F.col("m.hit")).alias("start"), "rank", F.col("rule.kind").alias("kind"), "end", F.col("rule.base").alias("base"))
    ok = F.col("m.part") >= F.col("rule.least")  # null behind the last match, and in rows without any
    out = placed.groupBy("_doc", "_rk").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.when(ok, span))).alias("spans"))
    return out.select(F.col("_doc").alias("doc_id"), "spans", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("_copy")).drop("_copy")
