"""Language-model scoring by deleted interpolation.

Bigram, unigram and uniform estimates are mixed with weights that depend on how often the context was
seen (buckets of powers of two). The weights are learned by expectation-maximisation on *deleted*
counts: each training token is predicted from the counts without itself, (c(u,v)-1)/(c(u)-1) and
(c(v)-1)/(N-1), so every training token is held out once. The EM input is a table of sufficient
sums per (bucket, half-octave of both estimates): bounded by the counters' range, not by the corpus.

``p(v|u) = l2[b] c(u,v)/c(u) + l1[b] c(v)/N + l0[b] / (V+1)``, ``b`` the bucket of c(u). The uniform
share covers the V known tokens and one unknown. Unigram keys are 64 bits; bigram keys keep 18 bits
more than the corpus's size has, so a false match has a chance of about 1e-6.

Defined cases: null or empty text is the end token alone; a null id counts as the text '' for the
split; equal rows count and score twice; with no training token N = V = 0 and every token is unknown;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsekit.llm import batched as B
from lapsekit.llm.textwords import Words, mix

OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_END, _START = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5)
_MUL = np.uint64(0xC2B2AE3D27D4EB4F)
SMOOTH = 1.0   # pseudo-count of each mixture part in EM: no weight becomes zero
ROUNDS = 60


def held_out_mod7(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


class _Tokens:
    """Token and bigram keys of a batch."""

    def __init__(self, table: pa.Table, held_out: Callable, shift: int):
        words = Words(table.column("text"), lower=True)
        n = words.counts
        self.ids = table.column("doc_id").to_pylist()
        self.held = np.array([held_out(x) for x in self.ids], bool)
        self.count = n + 1
        ends = np.cumsum(self.count) - 1
        total = int(self.count.sum())
        tok = np.empty(total, np.uint64)
        is_word = np.ones(total, bool)
        is_word[ends] = False
        tok[is_word] = words.keys()
        tok[ends] = _END
        prev = np.empty(total, np.uint64)
        prev[1:] = tok[:-1]
        self.begin = ends - n
        prev[self.begin] = _START
        self.pair = mix(prev * _MUL + tok) >> np.uint64(shift)
        self.tok, self.train = tok, np.repeat(~self.held, self.count)

    def counted(self, keys):
        """Sorted distinct keys, where each token is in them, and their training counts."""
        u, at = np.unique(keys, return_inverse=True)
        return u, at, np.bincount(at, weights=self.train, minlength=len(u)).astype(np.int64)


def score_texts(docs: DataFrame, held_out: Callable[[int | None], bool] = held_out_mod7,
                doc_id: str = "doc_id", text: str = "text", **sizes) -> DataFrame:
    """Score each text under the model learned from the texts that ``held_out`` leaves."""
    batches = B.Batches(docs, doc_id, text, **sizes)
    parts = batches.parts
    bits = max(40, min(64, int(batches.n * B.BATCH_BYTES).bit_length() + 18))
    shift = 64 - bits

    def cuts(t):
        """The batch's keys by partition: unigrams by their own bits, bigrams by theirs."""
        uni, pair = t.counted(t.tok), t.counted(t.pair)
        u = {p: (a, b) for p, a, b in B.by_partition(uni[0], parts)}
        w = {p: (a, b) for p, a, b in B.by_partition(pair[0] << np.uint64(shift), parts)}
        return uni, pair, {p: (u.get(p, (0, 0)), w.get(p, (0, 0))) for p in sorted(u.keys() | w.keys())}

    def count(table):
        t = _Tokens(table, held_out, shift)
        uni, pair, by = cuts(t)
        for p, ((a, b), (c, d)) in by.items():
            yield (p, B.pack_sorted(uni[0][a:b]), B.pack_blobs(B.pack_counts(uni[2][a:b]), B.pack_counts(pair[2][c:d])),
                   B.pack_sorted(pair[0][c:d]), None)

    def add_up(asked):
        uni = [B.unpack_sorted(r["keys"]) for r in asked]
        pair = [B.unpack_sorted(r["more"]) for r in asked]
        n = [[B.unpack_counts(x) for x in B.unpack_blobs(r["vals"])] for r in asked]
        uk, uc = B.sum_by_key(uni, [x[0] for x in n])
        pk, pc = B.sum_by_key(pair, [x[1] for x in n])
        return [(B.pack_blobs(B.pack_counts(uc[np.searchsorted(uk, a)]), B.pack_counts(pc[np.searchsorted(pk, b)])), None)
                for a, b in zip(uni, pair)]

    def totals(table: pa.Table) -> pa.Table:
        """Training tokens and distinct training tokens of one key partition."""
        asked = table.select(["keys", "vals"]).to_pylist()
        keys, n = B.sum_by_key([B.unpack_sorted(r["keys"]) for r in asked],
                               [B.unpack_counts(B.unpack_blobs(r["vals"])[0]) for r in asked])
        return pa.table({"tokens": pa.array([int(n.sum())], pa.int64()), "types": pa.array([int((n > 0).sum())], pa.int64())})

    def corpus_counts(table, answers):
        """Per token: c(v), c(u, v) and c(u), over the whole training corpus."""
        t = _Tokens(table, held_out, shift)
        uni, pair, by = cuts(t)
        got = [[B.unpack_counts(x) for x in B.unpack_blobs(answers[p][0])] for p in by]
        c1 = np.concatenate([x[0] for x in got])[uni[1]]
        c2 = np.concatenate([x[1] for x in got])[pair[1]]
        cu = np.empty_like(c1)
        cu[1:] = c1[:-1]
        at = np.searchsorted(uni[0], _END)
        cu[t.begin] = np.concatenate([x[0] for x in got])[at]   # texts begun = texts ended
        return t, c1, c2, cu

    def deleted(table, answers):
        t, c1, c2, cu = corpus_counts(table, answers)
        c1, c2, cu = (x[t.train] - 1 for x in (c1, c2, cu))
        ratio = c2 / np.maximum(cu, 1)
        cell = (_bucket(cu) * 256 + _half_octave(ratio)) * 256 + _half_octave(c1)
        cells, at = np.unique(cell, return_inverse=True)
        return pa.table({"cell": pa.array(cells, pa.int64()), "n": pa.array(np.bincount(at, minlength=len(cells)), pa.int64()),
                         "ratio": np.bincount(at, ratio, len(cells)).astype(float),
                         "seen": np.bincount(at, c1, len(cells)).astype(float)})

    def score(table, answers):
        model = _Model.read(answers.pop(-1)[2])
        t, c1, c2, cu = corpus_counts(table, answers)
        base = np.log10((c1 + 1.0) / (model.tokens + model.types + 1.0))
        prob = np.log10(model.probability(c1, c2, cu))
        n = len(t.ids)
        return pa.table({
            "doc_id": pa.array(t.ids, pa.int64()), "held_out": pa.array(t.held),
            "n_tokens": pa.array(t.count, pa.int64()),
            "n_known": pa.array(np.add.reduceat((c1 > 0).astype(np.int64), t.begin), pa.int64()),
            "train_tokens": pa.array(np.full(n, model.tokens), pa.int64()),
            "base_score": np.add.reduceat(base, t.begin), "score": np.add.reduceat(prob, t.begin)})

    asked = batches.ask(count)
    counts = B.answer(asked, add_up)
    sums = (batches.read(counts, deleted, "cell long, n long, ratio double, seen double")
            .groupBy("cell").agg(F.sum("n").alias("n"), F.sum("ratio").alias("ratio"), F.sum("seen").alias("seen")))
    size = (asked.groupBy("part").applyInArrow(totals, "tokens long, types long")
            .agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")))
    model = (sums.unionByName(size.select(F.lit(-1).cast("long").alias("cell"), F.col("tokens").alias("n"),
                                          F.col("types").cast("double").alias("ratio"), F.lit(0.0).alias("seen")))
             .groupBy(F.lit(0).alias("k")).applyInArrow(_learn, "k int, note binary"))
    # the model is one row of a few hundred bytes: each batch gets it as one more answer
    model_row = F.broadcast(model)
    spark = docs.sparkSession
    to_each = (spark.range(batches.n).select(F.col("id").alias("batch"), F.pmod("id", F.lit(1)).cast("int").alias("k")).join(model_row, "k")
               .select("batch", F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("vals"),
                       F.lit(None).cast("binary").alias("more"), "note"))
    return batches.read(counts.unionByName(to_each), score_or_nothing(score), OUT)


def score_or_nothing(score):
    """A batch number that no text fell into still meets its copy of the model."""
    def run(table, answers):
        if not len(table):
            return pa.table({n: pa.array([], t) for n, t in _OUT_TYPES})
        return score(table, answers)
    return run


_OUT_TYPES = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
              ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, 1 + np.floor(np.log2(np.maximum(c, 1))).astype(np.int64), 0)


def _half_octave(x: np.ndarray) -> np.ndarray:
    """0 for zero, else a code of floor(2 log2 x) that fits a byte."""
    return np.where(x > 0, np.clip(np.floor(2 * np.log2(np.maximum(x, 1e-30))) + 100, 1, 255), 0).astype(np.int64)


def _learn(table: pa.Table) -> pa.Table:
    cells = table.column("cell").to_numpy()
    n, ratio, seen = (table.column(c).to_numpy().astype(float) for c in ("n", "ratio", "seen"))
    head = cells == -1
    tokens, types = (int(n[head][0]), int(ratio[head][0])) if head.any() else (0, 0)
    cells, n, ratio, seen = (x[~head] for x in (cells, n, ratio, seen))
    bucket = (cells >> 16).astype(int)
    p = np.stack([ratio / np.maximum(n, 1), seen / np.maximum(n, 1) / max(tokens - 1, 1), np.full(len(n), 1.0 / (types + 1))])
    weights = np.full((64, 3), 1 / 3)
    for _ in range(ROUNDS):
        share = weights[bucket].T * p
        share *= n / np.maximum(share.sum(0), 1e-300)
        got = np.stack([np.bincount(bucket, s, 64) for s in share], 1) + SMOOTH
        weights = got / got.sum(1, keepdims=True)
    known = np.unique(bucket)
    if len(known):  # a bucket without training contexts takes the weights of the nearest one below
        weights = weights[known[np.maximum(np.searchsorted(known, np.arange(64), "right") - 1, 0)]]
    return pa.table({"k": pa.array([0], pa.int32()),
                     "note": pa.array([np.array([tokens, types], "<i8").tobytes() + weights.astype("<f8").tobytes()], pa.binary())})


class _Model:
    def __init__(self, tokens: int, types: int, weights: np.ndarray):
        self.tokens, self.types, self.weights = tokens, types, weights

    @classmethod
    def read(cls, note: bytes) -> _Model:
        tokens, types = np.frombuffer(note, "<i8", 2)
        return cls(int(tokens), int(types), np.frombuffer(note, "<f8", offset=16).reshape(64, 3))

    def probability(self, c1, c2, cu):
        w = self.weights[_bucket(cu)]
        parts = np.stack([c2 / np.maximum(cu, 1), c1 / max(self.tokens, 1), np.full(len(c1), 1.0 / (self.types + 1))], 1)
        # an unseen context has no bigram estimate (and an empty corpus no unigram one): the others share its weight
        live = np.stack([cu > 0, np.full(len(c1), self.tokens > 0), np.ones(len(c1), bool)], 1)
        return (w * parts).sum(1) / (w * live).sum(1)
