"""Suffix dedup: remove bytes inside a ``length``-byte string that starts in an earlier document.

1. *Filter.* Each ``length``-byte window is represented by its anchor: the k-byte string in it with the
   smallest hash (leftmost on ties), a choice that depends on the window's content alone. So two equal
   windows have equal anchors, and an anchor that the corpus has once rules out all its windows. As in
   communication-efficient string sorting, only fingerprints travel for this. Whole copies of an earlier
   document are found by digest; they are removed whole and do not take part further (the earlier one
   holds all their strings).
2. *Sort.* The suffixes at the remaining anchors, cut where their last window ends, are sorted in each
   batch and sent as front-coded runs (common prefix with the one before + rest). Each partition merges
   its runs with a loser tree that carries common-prefix lengths: two heads with different known
   prefixes are ordered without reading a byte, equal ones are compared only behind the known prefix.
   All suffixes with the same first k bytes meet in one partition.
3. *Extend.* The merged order and its common-prefix lengths give, for each length, the classes of equal
   suffix heads; with the bytes left of the anchor that names each window exactly once. A window goes if
   the smallest document id of its class is smaller than its own.

A batch sends equal contexts once, with the smallest id: a passage that a third of all documents share is
one entry per batch. Defined cases: null text = empty; texts under ``length`` bytes lose nothing; rows with
the same id are one document for the comparison; a null id counts as later than every other; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lapsekit.llm import batched as B
from lapsekit.llm.textwords import _BYTE, covered, mix, ngram_keys, text_bytes

LENGTH, K = 50, 24
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
_LAST = np.iinfo(np.int64).max
_RUN = 1 << 18
_STEP = np.uint64(0x9FB21C651E98DF25)


class _Suffixes:
    """Anchors of a batch: ``at`` their place, windows start at ``lo..hi``, ``key`` of the k bytes."""

    def __init__(self, table: pa.Table, length: int, k: int, parts: int):
        self.data, self.offsets = text_bytes(table.column("text"))
        self.raw = self.data.tobytes()
        self.length, self.k, self.parts = length, k, parts
        ids = table.column("doc_id").combine_chunks()
        self.doc = np.asarray(ids.fill_null(_LAST) if ids.null_count else ids).astype(np.int64)
        found = [self._anchors_in(a, b) for a, b in self._runs()]
        self.at, self.lo, self.hi, self.key = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        self.of = np.searchsorted(self.offsets, self.at, "right") - 1

    def _runs(self):
        """(first, last + 1) of neighbouring texts of together about ``_RUN`` bytes: bounds the work arrays."""
        i, n = 0, len(self.offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + _RUN, "right")) - 1)
            yield i, j
            i = j

    def _anchors_in(self, i: int, j: int):
        length, k, base = self.length, self.k, self.offsets[i]
        offsets = self.offsets[i:j + 1] - base
        n = int(offsets[-1])
        keys = ngram_keys(_BYTE[self.data[base:base + n]], k)
        span = length - k + 1
        packed = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(keys), dtype=np.uint64)
        size = 1
        while size * 2 <= span:
            packed = np.minimum(packed[:-size], packed[size:])
            size *= 2
        if size < span and len(packed) > span - size:
            packed = np.minimum(packed[:-(span - size)], packed[span - size:])
        ok = np.zeros(n + 1, np.int32)
        long = np.diff(offsets) >= length
        np.add.at(ok, offsets[:-1][long], 1)
        np.add.at(ok, offsets[1:][long] - length + 1, -1)
        starts = np.flatnonzero(np.cumsum(ok[:n]) > 0)
        anchor = (packed[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64) if len(starts) else starts
        new = np.flatnonzero(np.diff(anchor, prepend=-1))
        at, lo = anchor[new], starts[new]
        hi = starts[np.append(new[1:], len(starts)) - 1] if len(new) else at
        # anchors have the smallest hashes: mixed anew, their keys fill the partitions evenly
        return at + base, lo + base, hi + base, mix(keys[at] ^ _STEP) if len(new) else np.zeros(0, np.uint64)

    def anchors(self):
        """(part, prints seen once in the batch, prints seen more often) of the distinct anchor keys."""
        keys, n = B.unique_counts(self.key)
        for p, a, b in B.by_partition(keys, self.parts):
            prints, multi = keys[a:b] & np.uint64(0xFFFFFFFF), n[a:b] > 1
            yield p, np.sort(prints[~multi]), np.sort(prints[multi])

    def digests(self) -> dict[int, dict[bytes, int]]:
        """Smallest id of each whole text, by partition."""
        by: dict[int, dict[bytes, int]] = {}
        self.digest = []
        for d, (a, b) in enumerate(zip(self.offsets.tolist(), self.offsets[1:].tolist())):
            if b - a >= self.length:
                x = hashlib.blake2b(self.raw[a:b], digest_size=16).digest()
                p = int.from_bytes(x[:4], "big") * self.parts >> 32
                own = by.setdefault(p, {})
                own[x] = min(own.get(x, _LAST), int(self.doc[d]))
                self.digest.append((p, x))
            else:
                self.digest.append(None)
        return {p: dict(sorted(own.items())) for p, own in by.items()}   # rows may come in another order next time

    def settle(self, notes: dict[int, tuple[bytes, bytes]]):
        """Read the answers of the first exchange: whole copies, and the anchors left."""
        by = self.digests()
        first: dict[bytes, int] = {}
        for p, own in by.items():
            first.update(zip(own, np.frombuffer(notes[p][1], np.int64).tolist()))
        self.copy = np.array([x is not None and first[x[1]] < d for x, d in zip(self.digest, self.doc.tolist())], bool)
        live = np.zeros(len(self.key), bool)
        order = np.argsort(self.key, kind="stable")
        part = B.part_of(self.key[order], self.parts)
        for p, once, multi in self.anchors():
            twice = np.concatenate([once[B.unpack_bits(notes[p][0], len(once))], multi])
            twice.sort()
            a, b = np.searchsorted(part, [p, p + 1])
            live[order[a:b]] = B.among(self.key[order[a:b]] & np.uint64(0xFFFFFFFF), twice)
        live &= ~self.copy[self.of] if len(live) else live
        self.live = np.flatnonzero(live)

    def entries(self):
        """By partition: sorted (suffix, left context reversed, smallest id), and the anchors of each entry."""
        by: dict[int, dict[tuple[bytes, bytes], list[int]]] = {}
        live = self.live
        part = B.part_of(self.key[live], self.parts).tolist()
        raw, length = self.raw, self.length
        for i, p, a, lo, hi in zip(live.tolist(), part, self.at[live].tolist(), self.lo[live].tolist(), self.hi[live].tolist()):
            by.setdefault(p, {}).setdefault((raw[a:hi + length], raw[lo:a][::-1]), []).append(i)
        doc = self.doc
        for p in sorted(by):
            found = sorted(by[p].items())
            yield p, [(s, left, min(int(doc[self.of[i]]) for i in who)) for (s, left), who in found], [who for _, who in found]


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, given that ``known`` bytes are equal."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    i = known
    while a[i] == b[i]:
        i += 1
    return i


def front_code(entries: list[tuple[bytes, bytes, int]]) -> bytes:
    """A sorted run: per entry common prefix with the one before, rest and left context; then the ids."""
    heads, tails, before = [], [], b""
    for s, left, _ in entries:
        n = common(before, s)
        heads += (n, len(s) - n, len(left))
        tails += (s[n:], left)
        before = s
    ids = np.array([e[2] for e in entries], "<i8").tobytes()
    return B.pack_blobs(np.array(heads, "<u2").tobytes(), b"".join(tails), ids)


def read_run(b: bytes) -> tuple[list[bytes], list[int], list[bytes], np.ndarray]:
    heads, tails, ids = B.unpack_blobs(b)
    heads = np.frombuffer(heads, "<u2").tolist()
    strings, lcps, lefts, s, i = [], [], [], b"", 0
    for j in range(0, len(heads), 3):
        n, rest, left = heads[j], heads[j + 1], heads[j + 2]
        s = s[:n] + tails[i:i + rest]
        i += rest
        strings.append(s)
        lcps.append(n)
        lefts.append(tails[i:i + left])
        i += left
    return strings, lcps, lefts, np.frombuffer(ids, "<i8")


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs with their common-prefix lengths: (run, place in run, prefix shared with the one before).

    ``known[r]`` is what the head of run r shares with the last string put out. Of two heads the one
    that shares more is smaller; only if they share equally much are bytes read, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    lcps = [r[1] for r in runs] + [[]] * (k - len(runs))
    head = [s[0] if s else None for s in strings]
    known, place = [0] * k, [0] * k
    loser = [0] * k

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); sets what the loser shares with the winner."""
        if head[x] is None:
            return y, x
        if head[y] is None or known[x] > known[y]:
            return x, y
        if known[x] < known[y]:
            return y, x
        a, b = head[x], head[y]
        n = common(a, b, known[x])
        if n == len(a) and (n < len(b) or x < y) or n < len(a) and n < len(b) and a[n] < b[n]:
            known[y] = n
            return x, y
        known[x] = n
        return y, x

    level = list(range(k))
    width = k
    while width > 1:
        width //= 2
        nxt = []
        for i in range(width):
            w, lo = play(level[2 * i], level[2 * i + 1])
            loser[width + i] = lo
            nxt.append(w)
        level = nxt
    winner = level[0]
    out_run, out_place, out_lcp = [], [], []
    for _ in range(sum(map(len, strings))):
        out_run.append(winner)
        at = place[winner]
        out_place.append(at)
        out_lcp.append(known[winner])
        at += 1
        place[winner] = at
        if at < len(strings[winner]):
            head[winner] = strings[winner][at]
            known[winner] = lcps[winner][at]
        else:
            head[winner] = None
        node = (winner + k) // 2
        while node:
            other = loser[node]
            hw, ho = head[winner], head[other]
            if ho is not None and (hw is None or known[other] > known[winner]):
                loser[node], winner = winner, other
            elif ho is not None and known[other] == known[winner]:
                winner, loser[node] = play(winner, other)
            node //= 2
    return out_run, out_place, out_lcp


def earlier_masks(lcp: np.ndarray, size: np.ndarray, lefts: list[bytes], ids: np.ndarray, length: int, k: int) -> np.ndarray:
    """For each suffix in sorted order: bit o is set if its window that starts o bytes before the anchor
    also starts in a document with a smaller id."""
    n, span = len(lcp), length - k + 1
    mask = np.zeros(n, np.uint32)
    left_size = np.array([len(x) for x in lefts], np.int64)
    left = np.frombuffer(b"".join(x.ljust(span, b"\0") for x in lefts), np.uint8).reshape(n, span)
    hashed = np.zeros(n, np.uint64)
    for o in range(span):
        if o:
            hashed = hashed * _STEP + _BYTE[left[:, o - 1]]
        sel = np.flatnonzero((left_size >= o) & (size >= length - o))
        if len(sel) < 2:
            continue
        group = np.cumsum(lcp < length - o).astype(np.uint64)
        name = group[sel] * np.uint64(0xBF58476D1CE4E5B9) ^ hashed[sel] * np.uint64(0x94D049BB133111EB)
        name ^= name >> np.uint64(29)
        order = np.argsort(name, kind="stable")
        s = name[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        first = np.minimum.reduceat(ids[sel[order]], np.flatnonzero(new))
        hit = np.zeros(len(sel), bool)
        hit[order] = first[np.cumsum(new) - 1] < ids[sel[order]]
        mask[sel[hit]] |= np.uint32(1 << o)
    return mask


def drop_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, doc_id: str = "doc_id", text: str = "text",
                 **sizes) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` = the remaining UTF-8 bytes in order."""
    if not 0 <= length - k < 32 or length >= 1 << 15:
        raise ValueError("length - k must be under 32, length under 32768")
    batches = B.Batches(docs, doc_id, text, **sizes)
    parts = batches.parts

    def suffixes(table):
        return _Suffixes(table, length, k, parts)

    def fingerprint(table):
        t = suffixes(table)
        whole, prints = t.digests(), {p: (once, multi) for p, once, multi in t.anchors()}
        none = np.zeros(0, np.uint64)
        for p in sorted(whole.keys() | prints.keys()):
            own = whole.get(p, {})
            yield (p, B.pack_blobs(*map(B.pack_sorted, prints.get(p, (none, none)))),
                   np.array(list(own.values()), "<i8").tobytes(), b"".join(own), None)

    def match(asked):
        once, often = zip(*(map(B.unpack_sorted, B.unpack_blobs(r["keys"])) for r in asked))
        twice = B.repeated([*once, *often], [np.zeros(len(x), bool) for x in once] + [np.ones(len(x), bool) for x in often])
        first: dict[bytes, int] = {}
        whole = [[r["more"][i:i + 16] for i in range(0, len(r["more"]), 16)] for r in asked]
        for r, own in zip(asked, whole):
            for x, d in zip(own, np.frombuffer(r["vals"], "<i8").tolist()):
                first[x] = min(first.get(x, _LAST), d)
        return [(B.pack_bits(B.among(x, twice)), np.array([first[y] for y in own], "<i8").tobytes())
                for x, own in zip(once, whole)]

    def send_runs(table, answers):
        t = suffixes(table)
        t.settle({p: (a[0], a[1]) for p, a in answers.items()})
        runs = {p: front_code(e) for p, e, _ in t.entries()}
        for p, a in answers.items():
            yield p, runs.get(p, b""), None, None, B.pack_blobs(a[0], a[1])

    def merge(asked):
        runs = [read_run(r["keys"]) if r["keys"] else ([], [], [], np.zeros(0, np.int64)) for r in asked]
        run, place, lcp = merge_runs([r[:2] for r in runs])
        if not run:
            return [(b"", None) for _ in asked]
        size = np.array([len(runs[r][0][i]) for r, i in zip(run, place)])
        ids = np.array([runs[r][3][i] for r, i in zip(run, place)], np.int64)
        mask = earlier_masks(np.array(lcp), size, [runs[r][2][i] for r, i in zip(run, place)], ids, length, k)
        back = [np.zeros(len(r[0]), "<u4") for r in runs]
        for r, i, m in zip(run, place, mask.tolist()):
            back[r][i] = m
        return [(b.tobytes(), None) for b in back]

    def remove(table, answers):
        t = suffixes(table)
        notes = {p: B.unpack_blobs(a[2]) for p, a in answers.items()}
        t.settle(notes)
        mask = np.zeros(len(t.at), np.uint32)
        every = ((np.uint64(1) << (t.at - t.lo + 1).astype(np.uint64)) - (np.uint64(1) << (t.at - t.hi).astype(np.uint64))).astype(np.uint32)
        for p, entries, who in t.entries():
            for (_, _, first), m, own in zip(entries, np.frombuffer(answers[p][0], "<u4").tolist(), who):
                for i in own:
                    mask[i] = m if t.doc[t.of[i]] == first else every[i]
        n = len(t.data)
        flags = np.zeros(max(0, n - length + 1), bool)
        for o in range(length - k + 1):
            flags[t.at[(mask >> np.uint32(o)) & np.uint32(1) == 1] - o] = True
        gone = covered(flags, length, n)
        bounds = list(zip(t.offsets.tolist(), t.offsets[1:].tolist()))
        for d in np.flatnonzero(t.copy):
            gone[bounds[d][0]:bounds[d][1]] = True
        removed, spans, kept = [], [], []
        for a, b in bounds:
            g = gone[a:b]
            c = int(g.sum())
            removed.append(c)
            spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if c else 0)
            kept.append(t.data[a:b][~g].tobytes() if c else t.raw[a:b])
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(t.offsets), pa.int64()),
                         "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
                         "kept": pa.array(kept, pa.binary())})

    found = B.answer(batches.ask(fingerprint), match)
    merged = B.answer(batches.ask_again(found, send_runs), merge)
    return batches.read(merged, remove, OUT)
