"""Ask a corpus-wide question about many keys without one shuffled row per key.

Three operators here need, for every n-gram of every text, something the whole corpus knows about it
(does it occur elsewhere? how often?). Exploding n-grams into rows would shuffle tens of bytes per
input byte. Instead texts are dealt into *batches* of a few MB and the exchange runs batch by batch:

1. ``ask``: each batch sorts its keys, keeps each once (with its count: the map-side combine) and
   sends one packed row per key partition.
2. ``answer``: each key partition merges the packed rows of all batches and sends back one packed
   row per batch, in the order of the keys that the batch asked for.
3. ``read``: each batch meets its answers and goes through its texts again.

A key that occurs in a third of all texts is one entry per batch, however hot. Batches and key
partitions are counts derived from the corpus's bytes, so the size of every group stays the same as
the corpus grows. The texts are shuffled once: Spark reuses that exchange in every later step, and
anything lost with an executor is recomputed from the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 2 << 20     # text in a batch
PART_BYTES = 8 << 20      # text whose keys make up a key partition

ASK = "part int, batch long, keys binary, vals binary, more binary, note binary"
ANSWER = "batch long, part int, vals binary, more binary, note binary"


def text_size(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts (one long to the driver); sizes batches and partitions."""
    return docs.agg(F.sum(F.octet_length(F.col(text)) + F.lit(8)).alias("n")).first()["n"] or 0


class Batches:
    """The texts of a corpus in batches of about ``batch_bytes``, each row in one batch."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES):
        size = text_size(docs, text)
        self.n = max(1, -(-size // batch_bytes))
        self.parts = max(1, -(-size // part_bytes))
        key = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(self.n))
        self.texts = docs.select(key.alias("batch"), F.col(doc_id).cast("long").alias("doc_id"),
                                 F.col(text).cast("string").alias("text"))

    def ask(self, fn: Callable[[pa.Table], Iterator[tuple]]) -> DataFrame:
        """``fn(texts of a batch)`` yields rows of ``ASK`` without the batch."""
        def run(table: pa.Table) -> pa.Table:
            return rows(((p, batch_of(table), *x) for p, *x in fn(table)), ASK_TYPE)
        return self.texts.groupBy("batch").applyInArrow(run, ASK)

    def ask_again(self, answers: DataFrame, fn: Callable[[pa.Table, dict], Iterator[tuple]]) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return rows(((p, batch_of(left), *x) for p, *x in fn(left, by_part(right))), ASK_TYPE)
        return self._with(answers).applyInArrow(run, ASK)

    def read(self, answers: DataFrame, fn: Callable[[pa.Table, dict], pa.Table], schema: str) -> DataFrame:
        """``fn(texts, {part: (vals, more, note)})`` gives the rows of a batch."""
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return fn(left, by_part(right))
        return self._with(answers).applyInArrow(run, schema)

    def _with(self, answers: DataFrame):
        return self.texts.groupBy("batch").cogroup(answers.groupBy("batch"))


def answer(asked: DataFrame, fn: Callable[[list[dict]], list[tuple]]) -> DataFrame:
    """``fn(rows of a key partition)`` gives (vals, more) for each of its rows; the note is sent back as it came."""
    def run(table: pa.Table) -> pa.Table:
        asked_rows = table.to_pylist()
        got = fn(asked_rows)
        return rows(((r["batch"], r["part"], v, m, r["note"]) for r, (v, m) in zip(asked_rows, got)), ANSWER_TYPE)
    return asked.groupBy("part").applyInArrow(run, ANSWER)


ASK_TYPE = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary()),
                      ("more", pa.binary()), ("note", pa.binary())])
ANSWER_TYPE = pa.schema([("batch", pa.int64()), ("part", pa.int32()), ("vals", pa.binary()), ("more", pa.binary()),
                         ("note", pa.binary())])


def rows(it, schema: pa.Schema) -> pa.Table:
    cols = list(zip(*it)) or [[] for _ in schema]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)


def batch_of(table: pa.Table) -> int:
    return table.column("batch")[0].as_py()


def by_part(table: pa.Table) -> dict:
    return {r["part"]: (r["vals"], r["more"], r["note"]) for r in table.to_pylist()}


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Key partition from the upper 32 bits: a monotone map, so sorted keys stay in partition order."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def by_partition(sorted_keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) for the partitions that have keys."""
    part = part_of(sorted_keys, parts)
    cuts = np.flatnonzero(np.diff(part)) + 1
    begin = np.concatenate([[0], cuts]) if len(part) else []
    end = np.concatenate([cuts, [len(part)]]) if len(part) else []
    for a, b in zip(begin, end):
        yield int(part[a]), int(a), int(b)


def pack_counts(x: np.ndarray) -> bytes:
    """Non-negative integers, one byte each; those from 255 on follow in eight. Most counts are small."""
    large = x >= 255
    return len(x).to_bytes(4, "little") + np.where(large, 255, x).astype(np.uint8).tobytes() + x[large].astype("<i8").tobytes()


def unpack_counts(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    small = np.frombuffer(b, np.uint8, n, 4)
    out = small.astype(np.int64)
    out[small == 255] = np.frombuffer(b, "<i8", offset=4 + n)
    return out


def pack_bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def unpack_bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)


def repeated(keys: list[np.ndarray], often: list[np.ndarray]) -> np.ndarray:
    """Sorted keys that occur twice or more over all lists; ``often`` marks those that one list holds repeatedly."""
    if not keys:
        return np.zeros(0, np.uint64)
    every = np.concatenate(keys)
    multi = np.concatenate(often)
    order = np.argsort(every, kind="stable")
    every, multi = every[order], multi[order]
    same = every[1:] == every[:-1]
    hit = multi.copy()
    hit[1:] |= same
    hit[:-1] |= same
    return np.unique(every[hit])


def among(keys: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_set, keys)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == keys


def unique_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    s = np.sort(keys)
    if not len(s):
        return s, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[at], np.diff(np.append(at, len(s)))


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned integers as fixed-width gaps; a gap too wide is walked in steps of the escape value."""
    if not len(keys):
        return b""
    gaps = np.diff(keys, prepend=np.zeros(1, keys.dtype)).astype(np.uint64)
    best = None
    for width in (2, 3, 4, 5, 6, 7):
        steps = int((gaps // np.uint64((1 << 8 * width) - 1)).sum())
        if best is None or (len(keys) + steps) * width < best[0]:
            best = ((len(keys) + steps) * width, width, steps)
        if steps == 0:
            break
    if best[0] >= 8 * len(keys):
        return b"\x08" + keys.astype("<u8").tobytes()
    _, width, steps = best
    escape = np.uint64((1 << 8 * width) - 1)
    if steps:
        more = (gaps // escape).astype(np.int64)
        out = np.full(len(keys) + steps, escape, np.uint64)
        out[np.cumsum(more + 1) - 1] = gaps - more.astype(np.uint64) * escape
    else:
        out = gaps
    return bytes([width]) + out.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    width = b[0]
    if width == 8:
        return np.frombuffer(b, "<u8", offset=1).astype(np.uint64)
    raw = np.frombuffer(b, np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    gaps = wide.reshape(-1).view("<u8").astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)[gaps != np.uint64((1 << 8 * width) - 1)]


def pack_blobs(*blobs: bytes) -> bytes:
    return b"".join(len(x).to_bytes(4, "little") + x for x in blobs)


def unpack_blobs(b: bytes) -> list[bytes]:
    out, i = [], 0
    while i < len(b):
        n = int.from_bytes(b[i:i + 4], "little")
        out.append(b[i + 4:i + 4 + n])
        i += 4 + n
    return out


def sum_by_key(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys over all lists and their summed counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    every, n = np.concatenate(keys), np.concatenate(counts)
    if not len(every):
        return every, n
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[at], np.add.reduceat(n, at)
