"""Spelling variants by PartEnum signatures.

A word's letters, as a multiset, are a binary vector with one dimension for each (letter, occurrence). One inserted or deleted
letter changes one dimension, a replaced letter two: near words have vectors with a Hamming distance of at most two.

* *Partition*: the letters are dealt into ``PARTS`` groups (``letter_parts``), so the dimensions are too. Two vectors that differ in two
  dimensions differ in at most two groups.
* *Enumerate*: for each choice of ``PARTS`` - 2 groups, a signature is the exact projection of the vector on them, as a 64-bit
  hash. Near words share a signature at least. It also carries the word's length, and one half of the word: an edit leaves
  the letters before or behind the middle of the shorter word as they are. A word takes part with its own length and, as
  the longer one of a pair, with one less.
* *Equi-join* on the signatures, *verify* by edit distance. Hash collisions only add candidates.

A signature with more than ``CROWD`` words goes on with its words' one-deletion variants behind it: near words share one, and at most
length x alphabet words have the same, so no bucket is compared as all pairs. Nothing is capped: this is exact.

A word's *form* is its near word of largest count (ties: smallest in code-point order) where that is at least ``RATIO`` times its own; its
*root* is where the forms lead (``follow``, by pointer doubling: counts at least double along a chain, so it ends).

Defined cases: null and empty texts have no words; a run whose deleted letter leaves it short counts with its new length; equal counts choose
the smaller form; repeated rows count as often as they occur; a null id reads as an empty string in ``<doc_id>:<run>``; very long runs are words like any others; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsekit.llm.textwords import mix
from lapsekit.session import cut_lineage

RUN = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
DROP = 97                             #: one run in so many loses a letter
PARTS, CROWD = 4, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BATCH = 1 << 15
_SEED = np.random.default_rng(1202).integers(1, 2 ** 63, 8, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): lower-cased letter runs, with the letters that the hash of id and run takes out, of the given length and count."""
    runs = docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"),
                       F.explode(F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % DROP == 0, cut).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter((F.col("n") >= MIN_COUNT) & (F.char_length("word") >= MIN_LENGTH)))


def letter_parts(words: DataFrame) -> dict[str, int]:
    """The group of each letter: by falling frequency into the lightest group. The alphabet bounds this table."""
    seen = (words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''")
            .groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect())
    load, part = [0] * PARTS, {}
    for c, n in sorted(((r["c"], r["n"]) for r in seen), key=lambda x: (-x[1], x[0])):
        part[c] = load.index(min(load))
        load[part[c]] += n
    return part


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a column of words, and the n + 1 places where words begin."""
    texts = words.to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    return points, np.cumsum([0, *map(len, texts)])


def _slices(batch: pa.RecordBatch, words: int):
    """The batch in slices with a bounded number of letters in column ``words``, or one word."""
    size = np.cumsum([0, *(len(w) for w in batch.column(words).to_pylist())])
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(size, size[i] + _BATCH, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def signatures(points: np.ndarray, first: np.ndarray, part_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, role, signature): role 0 has the word's length, role 1 one less (the longer word of a pair)."""
    n, length = len(first) - 1, np.diff(first)
    word = np.repeat(np.arange(n), length)
    # the k-th occurrence of a letter in its word is a dimension; a group's projection is the sum of the hashes of its dimensions
    order = np.lexsort((points, word))
    w, c = word[order], points[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1])
    nth = np.arange(len(w)) - np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
    dim = mix((c.astype(np.uint64) << np.uint64(32)) + nth.astype(np.uint64) + _SEED[0])
    group = np.zeros((n, PARTS), np.uint64)
    np.add.at(group, (w, part_of[c]), dim)
    # prefix sums of a polynomial over the word give a hash of either half
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(length.max(initial=0)), _BASE, np.uint64)]), dtype=np.uint64)
    place = np.arange(len(points)) - first[word]
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(points.astype(np.uint64) + _SEED[1]) * power[place], dtype=np.uint64)])
    # a hash from position i must not depend on i: divide by BASE^i
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(length.max(initial=0)), _BACK, np.uint64)]), dtype=np.uint64)
    names, roles, keys = [], [], []
    every = np.arange(n)
    for role in (0, 1):
        short = length - role
        front = short // 2
        behind = length - (short - front)
        halves = (mix(total[first[:-1] + front] - total[first[:-1]] + _SEED[2]),
                  mix((total[first[1:]] - total[first[:-1] + behind]) * back[behind] + _SEED[3]))
        for number, kept in enumerate(itertools.combinations(range(PARTS), PARTS - 2)):
            projection = mix(mix(group[:, list(kept)].sum(1, dtype=np.uint64)) + (_SEED[4] ^ np.uint64(number)))
            for half in halves:
                names.append(every)
                roles.append(np.full(n, role, np.int8))
                keys.append(mix(projection * _BASE + half + short.astype(np.uint64) * _SEED[5]))
    return np.concatenate(names), np.concatenate(roles), np.concatenate(keys)


def signed(words: DataFrame, part: dict[str, int]) -> DataFrame:
    """(sig, role, word, n) rows."""
    part_of = np.zeros(0x110000, np.int8) if any(ord(c) > 0xFF for c in part) else np.zeros(0x100, np.int8)
    for c, p in part.items():
        part_of[ord(c)] = p

    def run(batches):
        for whole in batches:
            for batch in _slices(whole, 0):
                name, role, key = signatures(*code_points(batch.column(0)), part_of)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(role), batch.column(0).take(pa.array(name)), batch.column(1).take(pa.array(name))],
                                                 names=["sig", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "sig long, role byte, word string, n long")


def deletion_keys(points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, key) of each word and of all its variants with one letter less; linear in the letters."""
    n, length = len(first) - 1, np.diff(first)
    word = np.repeat(np.arange(n), length)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(length.max(initial=0)), _BASE, np.uint64)]), dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(points.astype(np.uint64) + _SEED[6]) * power[np.arange(len(points)) - first[word]], dtype=np.uint64)])
    whole = total[first[1:]] - total[first[:-1]]
    # what follows the letter moves up by one place
    cut = total[:-1] - total[first[word]] + (total[first[1:]][word] - total[1:]) * _BACK
    other = np.ones(len(points), bool)                  # taking either of two equal letters side by side gives one variant
    other[1:] = (points[1:] != points[:-1]) | (word[1:] != word[:-1])
    return np.concatenate([np.arange(n), word[other]]), np.concatenate([whole, cut[other]])


def refined(crowded: DataFrame) -> DataFrame:
    """The rows of crowded signatures, once for each one-deletion variant, under a key of both."""
    def run(batches):
        for whole in batches:
            for batch in _slices(whole, 2):
                at, keys = deletion_keys(*code_points(batch.column(2)))
                keys = mix(keys * _BASE + batch.column(0).to_numpy().view(np.uint64)[at])
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(batch.column(j).take(at) for j in (1, 2, 3))], names=["sig", "role", "word", "n"])

    return crowded.select("sig", "role", "word", "n").mapInArrow(run, "sig long, role byte, word string, n long")


def _joined(rows: DataFrame) -> DataFrame:
    """Verified near pairs (a, a_n, b, b_n) of rows that share a signature; b is longer, or comes later."""
    left = rows.filter("role = 0").select("sig", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = rows.select("sig", "role", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = left.join(right, "sig").filter((F.col("role") == 1) | (F.col("a") < F.col("b")))
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words that differ by exactly one letter, once."""
    rows = signed(words, letter_parts(words)).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("sig")))
    rows = cut_lineage(rows.filter("size > 1"))
    more = cut_lineage(refined(rows.filter(F.col("size") > crowd)))
    pairs = _joined(rows.filter(F.col("size") <= crowd)).unionByName(_joined(more))
    return pairs.distinct()


def follow(links: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: the last word that (word, form) links lead to."""
    known = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        known = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return known


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    words = cut_lineage(word_counts(docs, doc_id, text))
    pairs = near_words(words, crowd)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                                          F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    out = cut_lineage(words.join(best, "word", "left")
                      .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                              F.when(-F.col("best.less") >= RATIO * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f"))
                      .select("word", "n", "n_near", "f.form", "f.form_n"))
    roots = follow(out.filter("form IS NOT NULL"))
    return out.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
