"""Substring dedup by fixed-block anchors.

A repeat of ``window`` words anywhere must contain one whole aligned block of ``block`` words of its
own document if ``2 * block - 1 <= window`` (block = 18 for window = 35). So

1. *index and probe*: every document's non-overlapping aligned blocks form the index; every rolling
   window of ``block`` words probes it (32-bit fingerprints per key partition; a false hit only costs
   a later check). A block is an anchor if some other window of the corpus has its key.
2. *extend*: only the ``window``-word runs around anchors are compared, by 64-bit keys over the whole
   run. Overlapping confirmed runs join up to the maximal exact repeat around the anchors.
3. each document drops the words inside repeats. All windows are judged on the input.

Defined cases: null or empty text has no words; a document shorter than ``window`` loses nothing;
equal rows (also with equal or null ids) are different documents and repeat each other, so *both*
copies of a repeat go; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lapsekit.llm import batched as B
from lapsekit.llm.textwords import Words, covered, inside, ngram_keys

WINDOW = 35
OUT = "doc_id long, n_words long, n_removed long, kept string"


def _print32(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _pack32(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Fingerprints of the keys seen once and of those seen more often, both sorted."""
    prints, multi = _print32(keys).astype(np.uint64), n > 1
    return B.pack_blobs(B.pack_sorted(np.sort(prints[~multi])), B.pack_sorted(np.sort(prints[multi])))


class _Text:
    """Keys of one batch that all three steps derive again from the same texts."""

    def __init__(self, table: pa.Table, block: int, parts: int):
        self.words = Words(table.column("text"))
        self.keys = self.words.keys()
        self.total = len(self.keys)
        first = self.words.first
        rolling = ngram_keys(self.keys, block)
        self.ok = inside(first, block, self.total)
        m = len(rolling)
        within = np.arange(m) - np.repeat(first[:-1], self.words.counts)[:m]
        self.block_at = np.flatnonzero(self.ok & (within % block == 0))
        self.block_keys = rolling[self.block_at]
        self.rolling = rolling[self.ok]
        self.parts = parts

    def blocks_by_part(self):
        blocks = np.unique(self.block_keys)
        yield from ((p, blocks[a:b]) for p, a, b in B.by_partition(blocks, self.parts))

    def candidates(self, answers: dict, block: int, window: int, which: int):
        """Starts of the runs around anchors, and their keys."""
        hit = [blocks[B.unpack_bits(answers[p][which], len(blocks))]
               for p, blocks in self.blocks_by_part() if p in answers and answers[p][which] is not None]
        anchors = np.concatenate(hit) if hit else np.zeros(0, np.uint64)
        at = self.block_at[B.among(self.block_keys, anchors)]
        m = self.total - window + 1
        if m <= 0 or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        d = np.zeros(self.total + 1, np.int32)
        np.add.at(d, np.maximum(at - (window - block), 0), 1)
        d[at + 1] -= 1
        near = (np.cumsum(d)[:m] > 0) & inside(self.words.first, window, self.total)
        starts = np.flatnonzero(near)
        return starts, ngram_keys(self.keys, window)[starts]


def mark_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
                 **sizes) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` = the words outside repeats, joined by one space."""
    block = (window + 1) // 2
    batches = B.Batches(docs, doc_id, text, **sizes)
    parts = batches.parts

    def probe(table):
        t = _Text(table, block, parts)
        probes, n = B.unique_counts(t.rolling)
        blocks = dict(t.blocks_by_part())
        for p, a, b in B.by_partition(probes, parts):
            own = blocks.get(p, np.zeros(0, np.uint64))
            yield p, _pack32(probes[a:b], n[a:b]), None, _print32(own).tobytes(), None

    def match_blocks(asked):
        once, often = zip(*(map(B.unpack_sorted, B.unpack_blobs(r["keys"])) for r in asked))
        twice = B.repeated([*once, *often], [np.zeros(len(k), bool) for k in once] + [np.ones(len(k), bool) for k in often])
        return [(B.pack_bits(B.among(np.frombuffer(r["more"], np.uint32), twice)), None) for r in asked]

    def extend(table, answers):
        t = _Text(table, block, parts)
        runs, n = B.unique_counts(t.candidates(answers, block, window, 0)[1])
        sent = set()
        for p, a, b in B.by_partition(runs, parts):
            sent.add(p)
            yield p, B.pack_sorted(runs[a:b]), B.pack_bits(n[a:b] > 1), None, answers[p][0] if p in answers else None
        for p in answers:  # anchors whose runs all lie in other partitions
            if p not in sent:
                yield p, b"", b"", None, answers[p][0]

    def match_runs(asked):
        keys = [B.unpack_sorted(r["keys"]) for r in asked]
        twice = B.repeated(keys, [B.unpack_bits(r["vals"], len(k)) for r, k in zip(asked, keys)])
        return [(B.pack_bits(B.among(k, twice)), None) for k in keys]

    def remove(table, answers):
        t = _Text(table, block, parts)
        starts, keys = t.candidates(answers, block, window, 2)
        runs = np.unique(keys)
        twice = [runs[a:b][B.unpack_bits(answers[p][0], b - a)] for p, a, b in B.by_partition(runs, parts)]
        flags = np.zeros(max(0, t.total - window + 1), bool)
        if twice:
            flags[starts[B.among(keys, np.concatenate(twice))]] = True
        gone = covered(flags, window, t.total)
        n = t.words.counts
        lost = np.add.reduceat(np.append(gone, 0).astype(np.int64), t.words.first[:-1]) * (n > 0) if len(n) else n
        kept = []
        for x, a, b, k in zip(table.column("text").to_pylist(), t.words.first, t.words.first[1:], lost):
            w = (x or "").encode().split()
            kept.append(b" ".join(compress(w, ~gone[a:b]) if k else w))
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(n, pa.int64()),
                         "n_removed": pa.array(lost, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    anchors = B.answer(batches.ask(probe), match_blocks)
    repeats = B.answer(batches.ask_again(anchors, extend), match_runs)
    return batches.read(repeats, remove, OUT)
