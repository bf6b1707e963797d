"""Benchmark decontamination by latent semantic retrieval.

Texts are read in blocks of ``BLOCK`` words (lower-cased, ASCII punctuation apart); a passage is two neighbouring
blocks. Terms are the benchmark's words, weighted by TF-IDF over all passages of the corpus. A term in more than
``MAX_DF`` of the blocks says little and weighs nothing, unless it is among the ``OWN`` rarest of an item (the words of
an item that has leaked everywhere are all frequent).

1. *Weights*: one pass counts the blocks that hold each term.
2. *Latent space*: one pass multiplies the passage-term matrix A with a random matrix and its transpose with the
   product, A'(A R); tasks add up their share and the shares are summed in two levels of groups. The Nystrom form of
   the randomised SVD gives the leading right singular vectors and values; texts are folded in as a V / S. Sizes depend on the benchmark, not on the corpus.
3. *Search and check*: one pass projects every passage and takes the items with a cosine of ``COSINE`` or more.
   Around each such passage the longest common subsequence with the item's words is found. A leak covers
   ``OVERLAP`` of the item; a paraphrase covers ``PARAPHRASE`` of it and ``ANSWER`` of its answer (the last sentence).
4. *Probe*: the cosine misses some leaks, so the same pass also takes every passage that can hold one by count. A leak
   covers m = ``PARAPHRASE`` of an item's n words, so at least k of its n - m + k rarest words are around the passage
   (k = n / ``PROBE``), and of all its words, those around it and those that the item repeats make m. Passages with
   fewer hold no leak: nothing that step 3 would accept is lost.
   The passages of steps 3 and 4 are compared with their items together, in arrays: those around which too few of the
   item's words stand go first, then those where too few stand in order. What is left is scored one by one.

Documents are never shuffled: each pass reads them once. Benchmarks of any size are taken in blocks of ``ITEMS``
items, one set of passes for each.

Defined cases: null or empty texts and items match nothing; items under ``MIN_WORDS`` words match only where a text has
them whole, word for word, and items under ``LEAST_WORDS`` match nothing (one or two words prove nothing); equal rows are judged one by one; items with equal ids are separate items; an empty
corpus or benchmark gives no hits; extra columns are kept by ``add_hits``.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsekit.llm.textwords import SPACE_OR_MARK, Words, ngram_keys

BLOCK, MAX_DF, LEAST_DF, OWN, RANK, EXTRA = 16, 0.002, 50, 6, 96, 16
COSINE, OVERLAP, PARAPHRASE, ANSWER, MIN_WORDS, LEAST_WORDS = 0.5, 0.7, 0.5, 0.6, 8, 3
PROBE, GROUP = 5, 64      # a group of items is probed at a time: its hits in a slice bound the memory
ITEMS = 4096
_SLICE_BYTES = 1 << 19
_SLICE_TERMS = 512
_ROWS = 1 << 9            # vectors added up at once: they stay in a core's cache
_WINDOWS = 1 << 18        # words of the windows compared at once
HITS = "array<struct<item_id: long, overlap: double, answer: double>>"
HITS_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("overlap", pa.float64()), ("answer", pa.float64())]))
SENTENCE = re.compile(r"[.!?\n]+\s*")


def _slices(col: pa.Array):
    """Runs of texts of about half a MB."""
    if not isinstance(col, pa.Array):
        col = pa.array(col, pa.large_string())
    size = np.cumsum([0, *(len(x.as_buffer()) if x.is_valid else 0 for x in col.cast(pa.large_binary()))]) if len(col) else np.zeros(1)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(size, size[i] + _SLICE_BYTES, "right")) - 1)
        yield i, col.slice(i, j - i)
        i = j


class _Terms:
    """Finds known words: by their leading bits, then among the few known words that share them."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(16, len(keys).bit_length() + 4)
        self.shift = np.uint64(64 - bits)
        bucket = (keys >> self.shift).view(np.int64)
        self.first = np.full(1 << bits, -1, np.int32)
        self.first[bucket[::-1]] = np.arange(len(keys))[::-1]
        self.most = int(np.unique(bucket, return_counts=True)[1].max(initial=1))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``keys`` of known words, their terms)."""
        term = self.first[(keys >> self.shift).view(np.int64)]
        at = np.flatnonzero(term >= 0)
        term, own = term[at].astype(np.int64), keys[at]
        left = np.flatnonzero(self.keys[term] != own)
        for _ in range(self.most - 1):
            term[left] = np.minimum(term[left] + 1, len(self.keys) - 1)
            left = left[self.keys[term[left]] != own[left]]
        ok = np.ones(len(at), bool)
        ok[left] = False
        return at[ok], term[ok]


class _Blocks:
    """Blocks of a run of texts: ``block`` of each word, ``text`` of each block."""

    def __init__(self, col: pa.Array):
        w = Words(col, lower=True, breaks=SPACE_OR_MARK)
        self.keys, self.first = w.keys(), w.first
        n = w.counts
        blocks = -(-n // BLOCK)
        self.base = np.concatenate([[0], np.cumsum(blocks)])
        self.total = int(self.base[-1])
        self.text = np.repeat(np.arange(len(n)), blocks)
        within = np.arange(len(self.keys)) - np.repeat(w.first[:-1], n)
        self.block = np.repeat(self.base[:-1], n) + within // BLOCK
        self.joined = np.zeros(self.total, bool)      # a block with a next one in its text
        self.joined[:-1] = self.text[1:] == self.text[:-1]

    def project(self, at, term, weighted) -> np.ndarray:
        """Sum of weighted term vectors in each block."""
        out = np.zeros((self.total, weighted.shape[1]), np.float32)
        block = self.block[at]
        for a in range(0, len(at), _ROWS):
            _add(out, block[a:a + _ROWS], weighted[term[a:a + _ROWS]])
        return out

    def passages(self, y: np.ndarray) -> np.ndarray:
        p = y.copy()
        p[:-1][self.joined[:-1]] += y[1:][self.joined[:-1]]
        return p


def _add(out: np.ndarray, to: np.ndarray, rows: np.ndarray):
    """Adds ``rows`` to the rows ``to`` (ascending) of ``out``."""
    new = np.flatnonzero(np.diff(to, prepend=-1))
    out[to[new]] += np.add.reduceat(rows, new, axis=0)


def _order(values: np.ndarray, below: int) -> np.ndarray:
    """A stable order of whole numbers from 0; small ones are sorted by their digits."""
    return np.argsort(values.astype(np.uint16) if below <= 1 << 16 else values, kind="stable")


def _words(texts: list[str]) -> list[np.ndarray]:
    w = Words(pa.array(texts, pa.large_string()), lower=True, breaks=SPACE_OR_MARK)
    k = w.keys()
    return [k[a:b] for a, b in zip(w.first, w.first[1:])]


class Item:
    def __init__(self, item_id: int, text: str):
        self.id = item_id
        parts = [p for p in SENTENCE.split(text or "") if p.strip()]
        self.words = _words([text or ""])[0]
        answer = _words([parts[-1]])[0] if parts else self.words[:0]
        self.answer = answer if len(answer) >= 3 else self.words
        self.masks, self.answer_masks = _masks(self.words), _masks(self.answer)


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, k in enumerate(words.tolist()):
        out[k] = out.get(k, 0) | 1 << i
    return out


def common_words(masks: dict[int, int], size: int, words: list[int], least: float = 0) -> int:
    """Length of the longest common subsequence, bit-parallel; 0 if it can't reach ``least``."""
    known = [m for m in map(masks.get, words) if m]
    if len(known) < least:
        return 0
    every = (1 << size) - 1
    row = every
    for m in known:
        x = row & m
        row = (row + x | row - x) & every
    return size - row.bit_count()


def common_counts(masks: np.ndarray, every: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of many items and windows, bit-parallel in 64-bit limbs: ``masks`` (limbs, items, words)
    as flat rows for each limb, ``every`` (limbs, pairs) with an item's bits set, ``words`` (width, pairs) places in a limb's row."""
    row = every.copy()
    for w in words:
        carry = None
        for limb in range(len(row)):
            m, old = masks[limb].take(w), row[limb]
            x = old & m
            new = old + x
            over = new < x
            if carry is not None:
                new = new + carry
                over |= new < carry
            carry = over.astype(np.uint64)
            row[limb] = (new | (old ^ x)) & every[limb]
    return np.bitwise_count(every ^ row).sum(0, dtype=np.int64)


class Model:
    """Terms, weights and latent vectors of a block of items."""

    def __init__(self, items: list[Item]):
        self.items = [x for x in items if len(x.words) >= MIN_WORDS]
        self.short = [x for x in items if LEAST_WORDS <= len(x.words) < MIN_WORDS]
        self.keys = np.unique(np.concatenate([x.words for x in self.items])) if self.items else np.zeros(0, np.uint64)

    def index(self, df: np.ndarray):
        """The probe's words: per group of items (first item, starts, items of each word, hits needed, words
        around a passage, words of each item, words needed, where each word stands in an item, bits of an item)."""
        self.words, self.probes = self.keys, []
        for g in range(0, len(self.items), GROUP):
            group = self.items[g:g + GROUP]
            pairs, need, room, size = [], [], [], np.array([len(x.words) for x in group])
            own = [np.unique(np.searchsorted(self.keys, x.words), return_inverse=True, return_counts=True) for x in group]
            most = max(len(distinct) for distinct, _, _ in own) + 1
            # a word's place among an item's distinct words, from 1 (0: not in it; the last column: other words)
            place = np.zeros((len(group), len(self.keys) + 1), np.uint8 if most <= 256 else np.uint16 if most <= 1 << 16 else np.uint32)
            times = np.zeros((len(group), most), np.int32)
            limbs = -(-int(size.max()) // 64)
            masks, every = np.zeros((limbs, len(group), most), np.uint64), np.zeros((limbs, len(group)), np.uint64)
            for i, (distinct, at, n) in enumerate(own):
                enough = math.ceil(PARAPHRASE * size[i])
                need.append(min(enough, -(-int(size[i]) // PROBE)))
                room.append(_room(int(size[i])))
                place[i, distinct] = np.arange(1, len(distinct) + 1)
                times[i, 1:len(n) + 1] = n
                where = np.arange(size[i])
                bit = np.uint64(1) << (where % 64).astype(np.uint64)
                np.bitwise_or.at(masks, (where // 64, i, at + 1), bit)
                np.bitwise_or.at(every, (where // 64, i), bit)
                rare = distinct[at]
                rare = rare[np.argsort(df[rare], kind="stable")][:size[i] - enough + need[-1]]
                pairs.append(np.unique(rare) * GROUP + i)
            pairs = np.sort(np.concatenate(pairs))
            starts = np.searchsorted(pairs, np.arange(len(self.keys) + 1) * GROUP)
            self.probes.append((g, starts, (pairs % GROUP).astype(np.uint8), np.array(need), np.array(room), size, place, times, masks, every))

    def probe(self, b: _Blocks, at: np.ndarray, term: np.ndarray, also: np.ndarray) -> np.ndarray:
        """passage * items + item of all passages around which an item's words stand in their order, as many as a paraphrase needs:
        of those with enough of its rare words and of the pairs ``also``."""
        text_of = np.repeat(np.arange(len(b.first) - 1), np.diff(b.first))
        other = len(self.words)
        word = np.full(len(b.keys), other, np.int32)
        word[at] = term
        before = np.full(len(b.keys), -1, np.int32)       # where the word stands the time before
        order = _order(term, other)
        again = np.flatnonzero(term[order[1:]] == term[order[:-1]])
        before[at[order[again + 1]]] = at[order[again]]
        of = also % len(self.items) // GROUP
        found = [np.zeros(0, np.int64)]
        for g, starts, lists, need, room, size, place, times, masks, every in self.probes:
            count = starts[term + 1] - starts[term]
            hit = np.repeat(np.arange(len(term)), count)
            item = lists[np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count) + starts[term[hit]]]
            order = np.argsort(item, kind="stable")
            item, pos = item[order].astype(np.int64), at[hit[order]]
            text = text_of[pos]
            # hits that have enough others of their text within a passage's width
            last = np.arange(len(item)) + need[item] - 1
            ok = last < len(item)
            last = np.where(ok, last, 0)
            ok &= (item[last] == item) & (text[last] == text) & (pos[last] - pos < 2 * BLOCK + 2 * room[item])
            cover = np.zeros(len(item) + 1, np.int64)
            np.add.at(cover, np.flatnonzero(ok), 1)
            np.add.at(cover, last[ok] + 1, -1)
            live = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            item, pos, text = item[live], pos[live], text[live]
            # the passages around each of them
            x = pos - b.first[text]
            low = np.maximum((x - 2 * BLOCK - room[item]) // BLOCK + 1, 0)
            high = np.minimum((x + room[item]) // BLOCK, b.base[text + 1] - b.base[text] - 1)
            n = high - low + 1
            near = np.repeat(b.base[text] + low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            key, n = np.unique(near * len(self.items) + np.repeat(item + g, n), return_counts=True)
            key = np.union1d(key[n >= need[key % len(self.items) - g]], also[of == g // GROUP])
            # the item's words around the passage: first how many, then how many in their order
            p, i = key // len(self.items), key % len(self.items) - g
            key, p, i = (v[np.argsort(room[i], kind="stable")] for v in (key, p, i))
            text = b.text[p]
            begin = b.first[text] + (p - b.base[text]) * BLOCK
            end = np.minimum(begin + 2 * BLOCK + room[i], b.first[text + 1])
            begin = np.maximum(begin - room[i], b.first[text])
            a = 0
            while a < len(key):
                c = slice(a, a + max(1, _WINDOWS // (2 * BLOCK + 2 * int(room[i[min(len(i) - 1, a + _WINDOWS // (4 * BLOCK))]]))))
                a = c.stop
                width = 2 * BLOCK + 2 * int(room[i[c]].max())
                first = begin[c].astype(np.int32)[:, None]
                near = first + np.arange(width, dtype=np.int32)
                inside = near < end[c].astype(np.int32)[:, None]
                near = np.minimum(near, np.int32(len(word) - 1))
                stands = place.ravel().take(word.take(near) + i[c][:, None] * place.shape[1])
                stands *= inside
                seen = times.ravel().take(stands + i[c][:, None] * times.shape[1])
                seen *= before.take(near) < first
                own = np.flatnonzero(seen.sum(axis=1) >= PARAPHRASE * size[i[c]])
                if not len(own):
                    continue
                j = i[c][own]
                length = common_counts(masks.reshape(len(masks), -1), every[:, j], stands[own].T + j * masks.shape[2])
                found.append(key[c][own[length / size[j] >= PARAPHRASE]])
        return np.sort(np.concatenate(found))

    def whole(self, b: _Blocks, found: list[dict]):
        """Short items that a text has word for word."""
        ends = np.repeat(b.first[1:], np.diff(b.first))
        for n in {len(x.words) for x in self.short}:
            own = [(i, x) for i, x in enumerate(self.short, len(self.items)) if len(x.words) == n]
            if len(b.keys) < n:
                continue
            grams = ngram_keys(b.keys, n)
            names = np.array([ngram_keys(x.words, n)[0] for _, x in own])
            order = np.argsort(names, kind="stable")
            names = names[order]
            left, right = np.searchsorted(names, grams, "left"), np.searchsorted(names, grams, "right")
            for p in np.flatnonzero(right > left).tolist():
                for k in order[left[p]:right[p]].tolist():
                    i, x = own[k]
                    if p + n <= ends[p] and (b.keys[p:p + n] == x.words).all():
                        found[int(np.searchsorted(b.first, p, "right")) - 1][i] = (1.0, 1.0)

    def weigh(self, df: np.ndarray, blocks: int):
        self.index(df)
        live = df <= max(MAX_DF * blocks, LEAST_DF)
        for x in self.items:
            own = np.searchsorted(self.keys, np.unique(x.words))
            live[own[np.argsort(df[own], kind="stable")[:OWN]]] = True
        idf = np.log((1.0 + blocks) / (1.0 + df)) + 1.0
        self.place = np.where(live, np.cumsum(live) - 1, -1)      # of each word among the terms
        self.keys, self.weight = self.keys[live], idf[live].astype(np.float32)

    def random(self) -> np.ndarray:
        k = min(len(self.keys), RANK + EXTRA)
        return np.random.default_rng(7).standard_normal((len(self.keys), k)).astype(np.float32)

    def learn(self, sketch: np.ndarray):
        """Right singular vectors from A'(A R): the Nystrom form, with a small shift for a stable root."""
        r = self.random().astype(np.float64)
        shift = 1e-6 * (np.linalg.norm(sketch) + 1e-30)
        sketch = sketch + shift * r
        core = r.T @ sketch
        w, q = np.linalg.eigh((core + core.T) / 2)
        keep = w > w.max() * 1e-9
        u, s, _ = np.linalg.svd(sketch @ (q[:, keep] / np.sqrt(w[keep])), full_matrices=False)
        rank = min(RANK, int((s > s[0] * 1e-6).sum()))
        self.vectors = (self.weight[:, None] * u[:, :rank] / s[:rank]).astype(np.float32)    # term -> weighted latent vector
        terms = _Terms(self.keys)
        rows = []
        for x in self.items:
            _, t = terms.find(x.words)
            rows.append(self.vectors[t].sum(0) if len(t) else np.zeros(self.vectors.shape[1], np.float32))
        self.item_vectors = _unit(np.array(rows, np.float32).reshape(len(self.items), -1))

    def hits(self, col: pa.Array) -> list[list[dict]]:
        out: list[list[dict]] = []
        words = _Terms(self.words)
        items = self.items + self.short
        for _, part in _slices(col):
            found: list[dict[int, tuple[float, float]]] = [{} for _ in range(len(part))]
            b = _Blocks(part)
            if self.items:
                at, word = words.find(b.keys)
                term = self.place[word]
                y = _unit(b.passages(b.project(at[term >= 0], term[term >= 0], self.vectors)))
                some = np.flatnonzero(y.any(1))
                p, i = np.divmod(np.flatnonzero(y[some] @ self.item_vectors.T >= COSINE), len(self.items))
                near = self.probe(b, at, word, some[p] * len(self.items) + i)
                for p, i in zip((near // len(self.items)).tolist(), (near % len(self.items)).tolist()):
                    self._check(b, p, i, found[b.text[p]])
            if self.short:
                self.whole(b, found)
            out += [[{"item_id": items[i].id, "overlap": o, "answer": a} for i, (o, a) in sorted(f.items())] for f in found]
        return out

    def _check(self, b: _Blocks, p: int, i: int, found: dict):
        item, text = self.items[i], b.text[p]
        if i in found and found[i][0] == 1.0:
            return
        n = len(item.words)
        begin = b.first[text] + (p - b.base[text]) * BLOCK
        room = _room(n)
        words = b.keys[max(b.first[text], begin - room): min(b.first[text + 1], begin + 2 * BLOCK + room)].tolist()
        overlap = common_words(item.masks, n, words, PARAPHRASE * n) / n
        if overlap < PARAPHRASE:
            return
        answer = common_words(item.answer_masks, len(item.answer), words) / len(item.answer)
        if (overlap >= OVERLAP or answer >= ANSWER) and overlap > found.get(i, (0.0, 0.0))[0]:
            found[i] = (overlap, answer)


def _room(n: int) -> int:
    """Words on each side of a passage that an item of ``n`` words is compared with."""
    return max(BLOCK, n)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12).astype(np.float32)


def _count_terms(texts: DataFrame, model: Model) -> tuple[np.ndarray, int]:
    """Blocks that hold each term, and all blocks."""
    keys = model.keys

    def count(batches):
        terms, df, blocks = _Terms(keys), np.zeros(len(keys), np.int64), 0
        for batch in batches:
            for _, part in _slices(batch.column(0)):
                b = _Blocks(part)
                at, term = terms.find(b.keys)
                order = _order(term, len(keys))
                block, term = b.block[at[order]], term[order]
                new = (np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0)
                df += np.bincount(term[new], minlength=len(keys))
                blocks += b.total
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(df[some], blocks), pa.int64())],
                                         names=["term", "n"])

    df, blocks = np.zeros(len(keys), np.int64), 0
    for r in texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["term"] < 0:
            blocks = r["n"]
        else:
            df[r["term"]] = r["n"]
    return df, blocks


def _sketch(texts: DataFrame, model: Model) -> np.ndarray:
    """A'(A R) over all passages, summed over tasks in two levels."""
    keys, weight = model.keys, model.weight
    n, k = len(keys), min(len(keys), RANK + EXTRA)
    random = model.random()

    def share(batches):
        terms, weighted, z = _Terms(keys), weight[:, None] * random, np.zeros((n, k), np.float32)
        for batch in batches:
            for _, part in _slices(batch.column(0)):
                b = _Blocks(part)
                at, term = terms.find(b.keys)
                if not len(at):
                    continue
                y = b.passages(b.project(at, term, weighted))
                back = y.copy()                           # a block's words are in its passage and in the one before
                back[1:][b.joined[:-1]] += y[:-1][b.joined[:-1]]
                order = _order(term, n)
                term, block = term[order], b.block[at[order]]
                for a in range(0, len(term), _ROWS):
                    _add(z, term[a:a + _ROWS], back[block[a:a + _ROWS]])
        z *= weight[:, None]
        for i in range(0, n, _SLICE_TERMS):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([z[i:i + _SLICE_TERMS].astype("<f4").tobytes()])], names=["slice", "z"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), "<f4").astype(np.float64) for x in table.column("z"))
        return pa.table({"slice": table.column("slice").slice(0, 1), "salt": table.column("salt").slice(0, 1),
                         "z": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    shares = (texts.mapInArrow(share, "slice long, z binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))))
    kind = "slice long, salt int, z binary"
    once = shares.groupBy("slice", "salt").applyInArrow(add, kind).withColumn("salt", F.lit(0))
    out = np.zeros((n, k), np.float64)
    for r in once.groupBy("slice").applyInArrow(add, kind).toLocalIterator():
        out[r["slice"]: r["slice"] + _SLICE_TERMS] = np.frombuffer(r["z"], "<f4").reshape(-1, k)
    return out


def models(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> list[Model]:
    """A fitted model for each block of items."""
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    rows = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
    blocks = -(-rows.count() // ITEMS)
    out = []
    for i in range(blocks):
        own = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i)
        model = Model([Item(r["id"], r["text"]) for r in own.toLocalIterator()])
        df, n = _count_terms(texts, model) if model.items else (np.zeros(0, np.int64), 0)
        model.weigh(df, n)
        if model.items:
            model.learn(_sketch(texts, model))
        if model.items or model.short:
            out.append(model)
    return out


def add_hits(docs: DataFrame, items: DataFrame, name: str, text: str = "text", **columns) -> DataFrame:
    """``docs`` plus a column of the items that leak into each text: (item_id, overlap, answer)."""
    sc = docs.sparkSession.sparkContext
    out = docs.withColumn(name, F.array().cast(HITS))
    for model in models(docs, items, text, **columns):
        shared = sc.broadcast(model)      # a block of items: a few MB

        @F.arrow_udf(HITS)
        def search(texts: pa.Array) -> pa.Array:
            return pa.array(shared.value.hits(texts), HITS_TYPE)

        out = out.withColumn(name, F.concat(name, search(F.col(f"`{text}`"))))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **columns) -> DataFrame:
    """One row per (document, benchmark item) whose text leaks: (doc_id, item_id, overlap, answer)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return add_hits(rows, items, "hits", "text", **columns).select("doc_id", F.inline("hits"))


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", **columns) -> DataFrame:
    """The rows of ``docs`` without a leak, with their own columns only."""
    name = "_hits"
    while name in docs.columns:
        name = "_" + name
    return add_hits(docs, items, name, text, **columns).filter(F.size(name) == 0).drop(name)
