"""Queries that apply the subpackage's operators to whole tables, and SQL for those that it can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespark.llm import alignment, language_id, licenses, line_dedup, ngram_join, packing, quality, quality_rules, sentencepiece_files, spelling, token_files, topk, warc
from pagespark.llm.store import row_key, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORD = r"[^\x20\x09-\x0D]+"
TOKENIZER, PIECES, BYTES = "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"
QUERY_EVERY, BEST = 50, 5
#: Threads of a task that encodes; more where a task has more CPUs.
THREADS = 2


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
        FROM documents),
    p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM p),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 75 * (a.n + b.n - common)),
    reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) AS component_id
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY x) m USING (doc_id)
    """
)
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query(
    r"""
    WITH p AS (
        SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS h,
            min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS first
        FROM pages),
    b AS (
        SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr(
            '0000000100100011010001010110011110001001101010111100110111101111',
            4 * strpos('0123456789abcdef', substr(h, i, 1)) - 3, 4)), '') AS bits
        FROM p)
    SELECT page_id, size AS payload_bytes,
        array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + 16 * CAST(substr(bits, 5 * j + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * j + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * j + 3, 1) AS INT)
            + 2 * CAST(substr(bits, 5 * j + 4, 1) AS INT) + CAST(substr(bits, 5 * j + 5, 1) AS INT), 1)), '') AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> first THEN first END AS refers_to
    FROM b
    """
)
def op2_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_members(warc.normalise(warc.write_monolithic(table(spark, sf_dir, "pages"))))


@query(
    f"""
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
        FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0)
    SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s
    WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {BEST}
    """
)
def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0, BEST)


@query()
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "content_score", "metadata_score", "quality_score", "kept")


@query()
def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(token_files.write(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER)))


@query()
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads = max(THREADS, int(spark.conf.get("spark.task.cpus", "1")))
    return sentencepiece_files.encode(table(spark, sf_dir, "documents"), tokenizer_path(PIECES), threads)


@query(
    r"""
    WITH w AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
        FROM documents),
    p AS (SELECT doc_id, i, array_to_string(ws[i : i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
    r AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
    t2 AS (SELECT doc_id, max(k) AS top FROM (SELECT doc_id, g, count(*) AS k FROM (
        SELECT doc_id, array_to_string(ws[i : i + 1], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w)) GROUP BY ALL) GROUP BY doc_id),
    t1 AS (SELECT doc_id, sum(k) AS chars, sum(k * k) AS same FROM (SELECT doc_id, c, count(*) AS k FROM (
        SELECT doc_id, unnest(regexp_extract_all(t, '(?s).')) AS c FROM w) GROUP BY ALL) GROUP BY doc_id),
    f AS (
        SELECT coalesce(t2.top, 0) AS top, coalesce(t1.chars, 0) AS chars, coalesce(t1.same, 0) AS same, w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
            CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
            coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines,
            length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower
        FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t2 USING (doc_id) LEFT JOIN t1 USING (doc_id)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR n_upper > n_lower OR 100 * n_dup_lines > 50 * n_lines OR 10 * top > n_words OR 4 * same > chars * chars) AS kept
    FROM b
    """
)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = quality_rules.cascade(table(spark, sf_dir, "documents").select("doc_id", "text"), figures=figures)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", *figures, base.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


@query()
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.Join(table(spark, sf_dir, "documents"), carry="source")
    return packing.pack(clustered(found), row="row", rows=found.profile.count())


@query(
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    k AS (SELECT doc_id, i, array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ') AS g FROM l),
    d AS (
        SELECT doc_id, i, [g, lead(g, 1) OVER w, lead(g, 2) OVER w] AS win, lead(i, 2) OVER w AS last
        FROM k WHERE g <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    n AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM d WHERE last IS NOT NULL),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, last + 1)) AS i FROM n WHERE nth > 1),
    out AS (
        SELECT l.doc_id, string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i) AS text, count(*) AS n_lines, count(g.i) AS n_removed
        FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
    SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(out.text, '') END AS text
    FROM documents d LEFT JOIN out USING (doc_id)
    """
)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", language_id.held_out().alias("held_out"))
    return language_id.predict(rows, language_id.fit(docs)).select("doc_id", "held_out", "lang_pred", "score", "lang_rejected")


@query()
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(BYTES), tokenizer_path(PIECES))


@query(licenses.oracle())
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def sized(docs: DataFrame) -> DataFrame:
    """What packing needs of each text by itself: length in words and an end mark, and source. No cluster."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) + 1
    return docs.select("doc_id", row_key().alias("row"), words.alias("length"), "source", F.lit(None).cast("string").alias("cluster"))


def clustered(found: ngram_join.Join) -> DataFrame:
    """What ``sized`` gives, with the near-duplicate component of each text as its cluster, null for texts without words.

    All of it comes from the join's own pass over the texts; ``found`` carries the source.
    """
    length = (F.col("words") + 1).alias("length")
    return found.documents().select("doc_id", "row", length, F.col("carried").alias("source"), F.hex("group").alias("cluster"))
