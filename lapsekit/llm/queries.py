"""Registered queries of the training-data operators: thin, over whole tables, with production parameters.

``QUERIES[name](spark, sf_dir)`` runs the operator and derives the digest columns of its contract;
``ORACLE[name]`` is the same result as DuckDB SQL where SQL can express it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@register("op1_minhash_dedup")
def op1_minhash_dedup(spark, sf_dir):
    from lapsekit.llm.op1_minhash import near_duplicates
    return near_duplicates(read(spark, sf_dir, "documents"))


@register("op2_decontamination")
def op2_decontamination(spark, sf_dir):
    from lapsekit.llm.op2_decontaminate import find_leaks
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register("op3_substring_dedup")
def op3_substring_dedup(spark, sf_dir):
    from lapsekit.llm.op3_substring import mark_repeats
    return (mark_repeats(read(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))


@register("op4_best_fit_packing")
def op4_best_fit_packing(spark, sf_dir):
    from lapsekit.llm.op4_packing import pack_documents
    return pack_documents(read(spark, sf_dir, "documents"))


@register("op5_html_text")
def op5_html_text(spark, sf_dir):
    from lapsekit.llm.op5_html import extract
    return (extract(read(spark, sf_dir, "pages"))
            .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")))


@register("op6_chat_format")
def op6_chat_format(spark, sf_dir):
    from lapsekit.llm.op6_chat import format_conversations, read_back
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return read_back(format_conversations(rows.unionByName(more)))


def _quality_sql() -> str:
    from lapsekit.llm.op7_quality import judge_sql
    return judge_sql()


@register("op7_quality_rules", _quality_sql())
def op7_quality_rules(spark, sf_dir):
    from lapsekit.llm.op7_quality import judge
    return judge(read(spark, sf_dir, "documents"))


@register("op8_suffix_dedup")
def op8_suffix_dedup(spark, sf_dir):
    from lapsekit.llm.op8_suffix import drop_repeats
    return (drop_repeats(read(spark, sf_dir, "documents"))
            .select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))


@register("op9_secret_scan")
def op9_secret_scan(spark, sf_dir):
    from lapsekit.llm.op9_secrets import KINDS, find_secrets

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    def count(k):
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return (find_secrets(read(spark, sf_dir, "documents"))
            .select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")))


@register("op10_lm_scoring")
def op10_lm_scoring(spark, sf_dir):
    from lapsekit.llm.op10_lm import score_texts
    return score_texts(read(spark, sf_dir, "documents"))


NEGATIVES_SQL = """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
           list_transform(embedding, lambda v: floor(256 * CAST(v AS DOUBLE))) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
    FROM vectors a JOIN vectors r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""


@register("op13_hard_negatives", NEGATIVES_SQL)
def op13_hard_negatives(spark, sf_dir):
    from lapsekit.llm.op13_negatives import hard_negatives
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


# crc32 byte by byte over a table made from its polynomial; near words are equal without letter i of both, or of one
VARIANTS_SQL = """
WITH RECURSIVE crc_table AS (
    SELECT list(c ORDER BY b) AS t FROM (
        SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM range(256) r(b))),
runs AS (
    SELECT CAST(doc_id AS VARCHAR) AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents WHERE text IS NOT NULL),
coded AS (
    SELECT run, hex(encode(coalesce(id, '') || ':' || run)) AS code FROM runs),
hashed AS (
    SELECT run, xor(4294967295, list_reduce(list_transform(range(CAST(length(code) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(code, 2 * i + 1, 2) AS BIGINT)),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS h
    FROM coded, crc_table),
words AS (
    SELECT word, count(*) AS n FROM (
        SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
    GROUP BY word HAVING count(*) >= 3 AND length(word) >= 5),
cuts AS (
    SELECT word, n, i, CASE WHEN i = 0 THEN word ELSE left(word, i - 1) || substr(word, i + 1) END AS part
    FROM (SELECT word, n, CAST(unnest(range(0, length(word) + 1)) AS BIGINT) AS i FROM words)),
near AS (
    SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.part = b.part AND a.word <> b.word
    WHERE a.i = b.i OR a.i = 0 OR b.i = 0),
best AS (
    SELECT word, n, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
    QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) = 1),
formed AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
    SELECT word, word AS at, form AS next FROM formed
    UNION ALL
    SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.at AS root FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""


@register("op12_spelling_variants", VARIANTS_SQL)
def op12_spelling_variants(spark, sf_dir):
    from lapsekit.llm.op12_spelling import spelling_variants
    return spelling_variants(read(spark, sf_dir, "documents"))


NEIGHBOURS_SQL = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
      AND len(list_filter(embedding, lambda v: v <> 0)) > 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, c.vec_id, list_dot_product(q.x, c.x) AS score
FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_dot_product(q.x, c.x) DESC, c.vec_id)
QUALIFY row_number() OVER w <= 20
"""


@register("op11_nearest_neighbours", NEIGHBOURS_SQL)
def op11_nearest_neighbours(spark, sf_dir):
    from lapsekit.llm.op11_neighbours import nearest
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
