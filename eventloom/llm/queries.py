"""The registered queries of the ten operators, and SQL for those that SQL can express.

Each reads its whole table, applies its operator with production parameters and derives the columns
of its contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, langid, lines, merkle, mixing, secrets, simhash, spelling, tokenfile, topk, urls, warc

TOKENIZER, WORD_TOKENIZER = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), 5)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("pattern")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"), words=3, max_bits=3).drop("rk")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held_out"))
    model = langid.train(docs.filter("not held_out"))
    return langid.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.train(urls.labelled_table(spark))
    return urls.filter_urls(_table(spark, sf_dir, "pages"), model).select("page_id", "host", "path", "rule", "verdict")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    def counted(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(kind) for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = merkle.leaf_digest([F.col(f) + 1 if f == "n_chars" else F.col(f) for f in fields])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    manifest = merkle.build(docs, fields=fields, group_col="lang", id_col="doc_id", keep={"doc_id": F.col("doc_id"), "tampered": F.when(chosen, F.unhex(tampered))})
    folded = merkle.folded(F.coalesce(F.lower(F.hex("tampered")), "leaf"), F.col("proof"))
    out = merkle.prove(manifest).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.stored(_table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER), end_id=1)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(_table(spark, sf_dir, "documents"), min_chars=5, min_count=3, corrupt_every=97)
    return spelling.variants(words, ratio=2)


QUERIES = {f.__name__: f for f in (op1_topk, op2_mixing, op3_simhash, op4_bpe, op5_lines, op6_langid, op7_exact, op8_warc, op9_urls, op10_secrets, op11_merkle, op12_tokenfile, op13_spelling)}

_TRIM = r"'^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$'"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"



def _crc(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text of Latin-1 characters as UTF-8."""
    codes = f"flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)] END))"
    byte = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}::BIGINT[]), lambda c, b: {byte}), 4294967295)"


def _hashed(n_chars: str) -> str:
    parts = [f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(parts)})"


ORACLES = {
    "op1_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings),
        s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
              FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
    "op2_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, 2 * CAST(sum(size) AS BIGINT) AS cap,
                     CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
              FROM d GROUP BY source),
        o AS (SELECT *, row_number() OVER (ORDER BY cap / CAST(w AS DOUBLE), source NULLS LAST) AS k FROM s),
        l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(n) FROM s) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / CAST(sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM o),
        e AS (SELECT arg_min(level, k) AS level FROM l WHERE cap / CAST(w AS DOUBLE) > level),
        t AS (SELECT source, n, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM e), 'inf'::DOUBLE) * w) AS target FROM s),
        f AS (SELECT source, n, target, CAST(floor(target) AS BIGINT) AS flow FROM t),
        c AS (SELECT d.*, f.n AS source_size, f.target, f.flow,
                     sum(size) OVER (PARTITION BY d.source ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
              FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
        SELECT doc_id, size, source_size, target,
               CAST(CASE WHEN source_size = 0 THEN 0 ELSE (flow // source_size) * size
                    + greatest(0, least(size, (flow % source_size) - (upto - size))) END AS BIGINT) AS taken
        FROM c""",
    "op5_lines": rf"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, translate(regexp_replace(line, {_TRIM}, '', 'g'), {_LOWER}) AS key FROM l),
        f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN f USING (key) GROUP BY doc_id""",
    "op7_exact": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
        g AS (SELECT *, count(*) OVER (PARTITION BY t) AS group_size,
                     first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
    "op8_warc": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS newest FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
        FROM m""",
    "op11_merkle": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, lang, {_hashed("n_chars")} AS leaf,
                   CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_hashed("(n_chars + 1)")} ELSE {_hashed("n_chars")} END AS given
            FROM documents),
        g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS gid FROM (SELECT DISTINCT lang FROM d)),
        p AS (SELECT d.doc_id, d.leaf, d.given, g.gid, row_number() OVER (PARTITION BY g.gid ORDER BY d.doc_id) - 1 AS pos FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang),
        t AS (SELECT gid, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY gid) AS n FROM p
              UNION ALL SELECT gid, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY gid, level, pos // 2),
        s AS (SELECT gid, h AS subroot, level FROM t WHERE n = 1),
        u AS (SELECT 0 AS level, gid AS pos, subroot AS h, count(*) OVER () AS n FROM s
              UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY level, pos // 2),
        w AS (SELECT h AS root, level FROM u WHERE n = 1),
        f AS (SELECT p.doc_id, p.gid, p.pos, s.level AS inner_levels, s.level + w.level AS levels, 0 AS step, p.given AS h, '' AS proof
              FROM p JOIN s USING (gid) CROSS JOIN w
              UNION ALL
              SELECT doc_id, gid, pos, inner_levels, levels, step + 1,
                     sha256(CASE WHEN sibling IS NULL THEN h WHEN place % 2 = 0 THEN h || sibling ELSE sibling || h END), proof || coalesce(sibling, '')
              FROM (SELECT f.*, CASE WHEN f.step < inner_levels THEN f.pos >> f.step ELSE f.gid >> (f.step - inner_levels) END AS place, coalesce(a.h, b.h) AS sibling
                    FROM f LEFT JOIN t a ON f.step < inner_levels AND a.gid = f.gid AND a.level = f.step AND a.pos = xor(f.pos >> f.step, 1)
                           LEFT JOIN u b ON f.step >= inner_levels AND b.level = f.step - inner_levels AND b.pos = xor(f.gid >> greatest(0, f.step - inner_levels), 1)
                    WHERE f.step < levels))
        SELECT f.doc_id, p.leaf, s.subroot, w.root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = w.root AS verified
        FROM f JOIN p USING (doc_id) JOIN s ON s.gid = f.gid CROSS JOIN w WHERE f.step = f.levels""",
    "op13_spelling": rf"""
        WITH RECURSIVE r AS (
            SELECT doc_id, translate(run, {_LOWER}) AS run, count(*) AS k
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
        h AS (SELECT run, k, CASE WHEN doc_id IS NULL THEN 1 ELSE {_crc("CAST(doc_id AS VARCHAR) || ':' || run")} END AS h FROM r WHERE length(run) >= 5),
        c AS (SELECT CASE WHEN doc.h % 97 = 0 THEN substr(run, 1, CAST(doc.h % length(run) AS INTEGER)) || substr(run, CAST(doc.h % length(run) AS INTEGER) + 2) ELSE run END AS word, k FROM h doc),
        w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
        e AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(generate_series(1, length(word))) AS i FROM w)),
        near AS (
            SELECT DISTINCT a.word AS a, b.word AS b FROM e a JOIN e b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT DISTINCT e.word, w.word FROM e JOIN w ON e.rest = w.word
            UNION SELECT DISTINCT w.word, e.word FROM e JOIN w ON e.rest = w.word),
        m AS (SELECT a AS word, count(*) AS n_near, max(n) AS top, arg_min(b, (-n, b)) AS best FROM near JOIN w ON w.word = near.b GROUP BY a),
        f AS (SELECT w.word, w.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN m.top >= 2 * w.n THEN m.best END AS form, CASE WHEN m.top >= 2 * w.n THEN m.top END AS form_n
              FROM w LEFT JOIN m USING (word)),
        way AS (SELECT word, word AS cur FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.cur WHERE f.form IS NOT NULL),
        ends AS (SELECT way.word, way.cur AS root FROM way JOIN f ON f.word = way.cur WHERE f.form IS NULL)
        SELECT f.word, f.form, ends.root, f.n, f.n_near, f.form_n FROM f JOIN ends USING (word)""",
}
