"""Quality rules with adaptive thresholds, in DataFrame operations only.

Every text gets counts (``text_counts``) and from them four ratios in whole steps: symbols, repeated
lines and words equal to the one before in thousandths (the first ``FEW`` of each don't count: in a short text they say nothing),
mean word length in hundredths. Per language, source and size (texts are alike in spread only at like length) a
mergeable quantile sketch of each ratio - a histogram on that grid, so merging is adding and a quantile is
off by less than one step - gives the bounds; fixed cutoffs are left only in the base rule:

    low, mid, high = 0.1, 0.5 and 0.75 quantile;  spread = the larger of mid - low and high - mid, two steps at least
    a text fails if ratio > mid + 6 * spread                (all four)
                 or ratio < mid - 6 * spread                (mean word length)

No quantile over 0.75 enters, so up to a quarter of a group may be junk. A group of
fewer than ``MIN_DOCS`` texts takes the merged sketch of its language and source, then that of its language, then that of all texts. Sketches are
summed on the map side; a source with a third of all rows is a few thousand counts per task.

Defined cases: a null text has no words and fails the base rule; null languages and sources are groups of
their own; equal rows count and are judged one by one; an empty table gives no rows; extra columns, also
named like the ones made here, are kept out of ``judge`` and kept unchanged by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapsekit.session import cut_lineage

FEATURES = ("symbols", "lines", "twins", "length")
FEW = 4                     # events of a kind that don't count yet
SIZES = (32, 128)           # words from which on a text is of the next size
SPREADS, LEAST = 6, 2     # a spread is LEAST steps at least
MIN_DOCS = 50
BROADCAST_GROUPS = 20_000   # rows of four small numbers: under 2 MB
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _as_spaces(text: Column) -> Column:
    return F.translate(text, "\t\n\x0b\x0c\r", "     ")


def _words(text: Column) -> Column:
    return F.filter(F.split(_as_spaces(text), " "), lambda w: w != "")


def _covered(at: Column) -> Column:
    """Words inside windows that start at the sorted places ``at``."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(at, zero, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"),
                                                         p.alias("last")), lambda acc: acc["n"])


def text_counts(docs: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_twin_words and row (names get ``prefix``).

    ``row`` is there for filters on the counts to name (``counted``): the optimiser then keeps such a filter above the
    counts, instead of writing their whole expressions into it, once for each mention.
    """
    c = lambda n: F.col(f"`{prefix}{n}`")
    name = lambda n: f"{prefix}{n}"
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumns({
        name("words"): _words(body),
        name("full_lines"): F.filter(F.split(body, "\n", -1), lambda x: F.trim(_as_spaces(x)) != ""),
        name("word_chars"): F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long"),
        name("n_symbols"): (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long")})
    n = F.size(c("words"))
    window = lambda i: F.xxhash64(*[F.get(c("words"), i + j) for j in range(WINDOW)])
    df = df.withColumn(name("windows"), F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window))
                       .otherwise(F.array().cast(T.ArrayType(T.LongType()))))
    # only texts that repeat a window sort their windows
    some = F.size(F.array_distinct(c("windows"))) < F.size(c("windows"))
    pair = F.transform(c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn(name("sorted"), F.when(some, F.sort_array(pair)))
    s = c("sorted")
    same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
    twice = F.filter(s, lambda x, j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
    repeated = _covered(F.sort_array(F.transform(twice, lambda x: x["i"])))
    df = df.withColumns({
        name("n_twin_words"): F.size(F.filter(c("words"), lambda w, i: (i > 0) & (w == F.get(c("words"), i - 1)))).cast("long"),
        name("n_words"): n.cast("long"), name("n_lines"): F.size(c("full_lines")).cast("long"),
        name("n_dup_lines"): (F.size(c("full_lines")) - F.size(F.array_distinct(c("full_lines")))).cast("long"),
        name("n_repeat_words"): F.when(s.isNotNull(), repeated).otherwise(F.lit(0)).cast("long"),
        name("row"): F.monotonically_increasing_id()})
    return df.drop(*(name(x) for x in ("words", "full_lines", "windows", "sorted")))


def base_failed(c) -> Column:
    return (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))


def counted(c) -> Column:
    return c("row") >= 0


def _steps(c) -> dict[str, Column]:
    """The ratios in whole steps; integer division, so every engine gets the same bucket."""
    def ratio(n: Column, of: str, step: int) -> Column:
        return F.floor(n * step / F.greatest(c(of), F.lit(1).cast("long"))).cast("long")
    def past(n: str) -> Column:
        return F.greatest(c(n) - FEW, F.lit(0).cast("long"))
    return {"symbols": ratio(past("n_symbols"), "word_chars", 1000), "lines": ratio(past("n_dup_lines"), "n_lines", 1000),
            "twins": ratio(past("n_twin_words"), "n_words", 1000), "length": ratio(c("word_chars"), "n_words", 100)}


def _size(c) -> Column:
    return sum(((c("n_words") >= n).cast("int") for n in SIZES), F.lit(0))


def bounds(features: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "") -> DataFrame:
    """One row per (lang, source, size): (g_lang, g_source, g_size, <feature>_high, length_low)."""
    c = lambda n: F.col(f"`{prefix}{n}`")
    kinds = F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("bucket")) for k, v in _steps(c).items()])
    sketch = (features.filter(counted(c) & ~base_failed(c))
              .select(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), _size(c).alias("g_size"), F.inline(kinds))
              .groupBy("g_lang", "g_source", "g_size", "feature", "bucket").agg(F.count(F.lit(1)).alias("n")))
    sketch = cut_lineage(sketch)  # a few thousand counts per group; every level below merges these
    groups = features.select(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), _size(c).alias("g_size")).distinct()
    return _bounds_of(sketch, groups)


def _bounds_of(sketch: DataFrame, groups: DataFrame) -> DataFrame:
    return sketch.sparkSession.sql(BOUNDS_SQL.format(min_docs=MIN_DOCS, pick=_picked()), sketch=sketch, groups=groups)


def _picked() -> str:
    spread = f"{SPREADS} * greatest(mid - low, high - mid, {LEAST})"
    marks = [(k, "high", f"mid + {spread}") for k in FEATURES] + [("length", "low", f"mid - {spread}")]
    return ", ".join(f"max(CASE WHEN feature = '{k}' THEN {e} END) AS {k}_{side}" for k, side, e in marks)


#: {{sketch}} and {{groups}} are tables; also the tail of the DuckDB twin.
BOUNDS_SQL = """
WITH levels AS (
  SELECT 0 AS level, g_lang, g_source, g_size, feature, bucket, n FROM {{sketch}}
  UNION ALL SELECT 1, g_lang, g_source, NULL, feature, bucket, sum(n) FROM {{sketch}} GROUP BY g_lang, g_source, feature, bucket
  UNION ALL SELECT 2, g_lang, NULL, NULL, feature, bucket, sum(n) FROM {{sketch}} GROUP BY g_lang, feature, bucket
  UNION ALL SELECT 3, NULL, NULL, NULL, feature, bucket, sum(n) FROM {{sketch}} GROUP BY feature, bucket),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, g_lang, g_source, g_size, feature ORDER BY bucket) AS upto,
         sum(n) OVER (PARTITION BY level, g_lang, g_source, g_size, feature) AS total FROM levels),
marks AS (
  SELECT level, g_lang, g_source, g_size, feature, max(total) AS total, min(CASE WHEN 10 * upto >= total THEN bucket END) AS low,
         min(CASE WHEN 2 * upto >= total THEN bucket END) AS mid, min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) AS high
  FROM ranked GROUP BY level, g_lang, g_source, g_size, feature),
limits AS (
  SELECT level, g_lang, g_source, g_size, max(total) AS total, {pick} FROM marks GROUP BY level, g_lang, g_source, g_size),
chosen AS (
  SELECT g.g_lang, g.g_source, g.g_size,
         CASE WHEN a.total >= {min_docs} THEN 0 WHEN b.total >= {min_docs} THEN 1 WHEN c.total >= {min_docs} THEN 2 ELSE 3 END AS level
  FROM {{groups}} g
  LEFT JOIN limits a ON a.level = 0 AND a.g_size = g.g_size AND a.g_lang IS NOT DISTINCT FROM g.g_lang AND a.g_source IS NOT DISTINCT FROM g.g_source
  LEFT JOIN limits b ON b.level = 1 AND b.g_lang IS NOT DISTINCT FROM g.g_lang AND b.g_source IS NOT DISTINCT FROM g.g_source
  LEFT JOIN limits c ON c.level = 2 AND c.g_lang IS NOT DISTINCT FROM g.g_lang)
SELECT c.g_lang, c.g_source, c.g_size, symbols_high, lines_high, twins_high, length_high, length_low
FROM chosen c LEFT JOIN limits l ON l.level = c.level AND (c.level = 3 OR l.g_lang IS NOT DISTINCT FROM c.g_lang)
 AND (c.level > 1 OR l.g_source IS NOT DISTINCT FROM c.g_source) AND (c.level > 0 OR l.g_size = c.g_size)
"""


def _verdict(df: DataFrame, limits: DataFrame, lang: str, source: str, prefix: str) -> tuple[DataFrame, Column]:
    """``df`` joined with its bounds, and whether a row passes."""
    limits = cut_lineage(limits)
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    limits = limits.toDF(*(f"{prefix}_{x}" for x in limits.columns))
    c = lambda n: F.col(f"`{prefix}{n}`")
    joined = df.join(limits, F.col(lang).eqNullSafe(F.col(f"{prefix}_g_lang"))
                     & F.col(source).eqNullSafe(F.col(f"{prefix}_g_source")) & (_size(c) == F.col(f"{prefix}_g_size")), "left")
    lim = lambda n: F.col(f"{prefix}_{n}")
    steps = _steps(c)
    ok = F.lit(True)
    for k, v in steps.items():
        ok = ok & (v <= lim(f"{k}_high"))
    ok = ok & (steps["length"] >= lim("length_low"))
    return joined, ~base_failed(c) & F.coalesce(ok, F.lit(True))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: its counts, ``base_failed`` and ``kept``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("_text"))
    counts = cut_lineage(text_counts(rows, "_text").drop("_text"))  # read twice below: sketches and verdicts
    joined, good = _verdict(counts, bounds(counts), "lang", "source", "")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         base_failed(F.col).alias("base_failed"), good.alias("kept"), "n_twin_words")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    p = "_q_"
    while any(x.startswith(p) for x in docs.columns):
        p = "_" + p
    counts = cut_lineage(text_counts(docs, text, p))   # the counts cost more than writing the rows once
    joined, good = _verdict(counts, bounds(counts, lang, source, p), lang, source, p)
    return joined.filter(counted(lambda n: F.col(f"`{p}{n}`")) & good).select(*(F.col(f"`{x}`") for x in docs.columns))


#: DuckDB twin of ``judge`` over the table ``documents``.
JUDGE_SQL = """
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS full_lines,
         row_number() OVER () AS rid FROM documents),
windows AS (
  SELECT rid, i, words[i:i + 4] AS win FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
places AS (
  SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1),
rep AS (SELECT rid, sum(least(5, coalesce(i - before, 5))) AS n FROM places GROUP BY rid),
counts AS (
  SELECT w.rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(full_lines) AS BIGINT) AS n_lines, CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(words, lambda x, i: i > 1 AND x = words[i - 1])) AS BIGINT) AS n_twin_words
  FROM w LEFT JOIN rep ON rep.rid = w.rid),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         1000 * greatest(n_symbols - __FEW__, 0) // greatest(word_chars, 1) AS symbols, 1000 * greatest(n_dup_lines - __FEW__, 0) // greatest(n_lines, 1) AS lines,
         1000 * greatest(n_twin_words - __FEW__, 0) // greatest(n_words, 1) AS twins, 100 * word_chars // greatest(n_words, 1) AS length, __SIZE__ AS size
  FROM counts),
sketch AS (
  SELECT lang AS g_lang, source AS g_source, size AS g_size, feature, bucket, count(*) AS n
  FROM (SELECT lang, source, size, unnest(['symbols', 'lines', 'twins', 'length']) AS feature,
               unnest([symbols, lines, twins, length]) AS bucket FROM f WHERE NOT base_failed)
  GROUP BY ALL),
groups AS (SELECT DISTINCT lang AS g_lang, source AS g_source, size AS g_size FROM f),
b AS (__BOUNDS__)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(symbols <= symbols_high AND lines <= lines_high
                                    AND twins <= twins_high AND length <= length_high AND length >= length_low, TRUE) AS kept, n_twin_words
FROM f LEFT JOIN b ON f.lang IS NOT DISTINCT FROM b.g_lang AND f.source IS NOT DISTINCT FROM b.g_source AND f.size = b.g_size
"""


def judge_sql() -> str:
    tail = BOUNDS_SQL.format(min_docs=MIN_DOCS, pick=_picked()).replace("{sketch}", "sketch").replace("{groups}", "groups")
    size = " + ".join(f"CAST(n_words >= {n} AS INTEGER)" for n in SIZES)
    return JUDGE_SQL.replace("__BOUNDS__", tail).replace("__FEW__", str(FEW)).replace("__SIZE__", size)
