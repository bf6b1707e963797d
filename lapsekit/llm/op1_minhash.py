"""Near-duplicate groups by HyperMinHash signatures.

1. *Signature* (one pass, no shuffle of texts): each 5-word shingle goes by its hash into one of ``BUCKETS`` buckets; a
   bucket keeps the smallest hash seen, as a register of 6 bits of leading zeros and 10 bits of mantissa.
2. *Exact copies*: documents with the same shingle set (128-bit digest) are one class, named by a hash of the digest; only its smallest id goes on.
3. *Banding*: bands of as many registers as the threshold allows (``band_rows``); classes with an equal band meet in a bucket. A bucket is read as a
   stream against its *leaders*: by estimates from 8-bit registers, corrected for chance agreement, a class is tied to
   leaders that may be as near as the threshold less (1 - ``ABSORB``) and becomes a leader itself unless one is nearer than ``ABSORB``. By the
   triangle inequality of 1 - Jaccard, two classes over the threshold are tied to a common leader (or to each other).
   Only ties that join something are put out, so a bucket of n classes gives fewer than n rows. Tied classes are *families*.
4. *Estimate and verify*: families are cut into blocks of at most ``BLOCK`` classes, and each pair of blocks is a task.
   It estimates Jaccard for its pairs from the registers, corrected for registers that agree by chance, and
   drops pairs more than ``SIGMAS`` deviations under the threshold. The others are compared on full
   shingle sets, most similar first, unless they are already connected within the task. It returns the links
   that join something: at most one per class.
5. *Components* of the links, by label contraction.

The threshold is in hundredths, ``THRESHOLD`` by default. A pair at the threshold shares no band with a chance under ``MISS`` and fails the estimate with about 1e-9. An empty band
(no register set in either) says nothing and is left out. Blocks bound a task's memory in a hot group of near copies; the
block pairs of one family still grow with the square of its *different* texts (copies are one).

Defined cases: null or blank text has no shingles and links with nothing; under 5 words, the whole sequence is the
one shingle; rows with one id and equal texts count as one, rows with one id and different texts are linked each by its
own text; a row with a null id links with nothing and its component is null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsekit.llm.textwords import Words, mix, ngram_keys
from lapsekit.session import cut_lineage

SHINGLE, THRESHOLD = 5, 85
BUCKETS, MISS = 320, 5e-6
MANTISSA = 10
SIGMAS = 6.0
ABSORB, TIE_SIGMAS = 0.8, 4.0
BLOCK = 1024
EMPTY = 0xFFFF
_SLICE_BYTES = 1 << 20
SIGNATURES = "doc_id long, mark string, n_shingles long, digest binary, small binary, bands array<long>"


def shingle_sets(col: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle keys of each text."""
    w = Words(col, lower=True)
    keys, out = w.keys(), []
    grams = ngram_keys(keys, SHINGLE)
    for a, b in zip(w.first.tolist(), w.first[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a:b - SHINGLE + 1]))
        else:
            out.append(mix(ngram_keys(keys[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def digest_of(s: np.ndarray) -> bytes:
    """128 bits that name a shingle set, and its size."""
    return b"".join(int(x).to_bytes(8, "little") for x in (s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64), len(s)))


def registers_of(s: np.ndarray) -> np.ndarray:
    """HyperMinHash registers: (leading zeros + 1) << MANTISSA | mantissa of each bucket's smallest hash; EMPTY if unused."""
    out = np.full(BUCKETS, EMPTY, np.uint16)
    if not len(s):
        return out
    h = mix(s ^ np.uint64(0xA0761D6478BD642F))
    bucket = ((h >> np.uint64(48)) * np.uint64(BUCKETS) >> np.uint64(16)).astype(np.int64)
    rest = h & np.uint64((1 << 48) - 1)
    order = np.argsort(bucket * (1 << 48) + rest.astype(np.int64))
    bucket, rest = bucket[order], rest[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    low = np.maximum(rest[first].astype(np.int64), 1)
    top = np.frexp(low.astype(np.float64))[1].astype(np.int64) - 1     # place of the leading one; exact under 2^53
    zeros = 47 - top
    mantissa = np.where(top >= MANTISSA, low >> np.maximum(top - MANTISSA, 0), low << np.maximum(MANTISSA - top, 0)) & ((1 << MANTISSA) - 1)
    out[bucket[first]] = ((zeros + 1) << MANTISSA | mantissa).astype(np.uint16)
    return out


def band_rows(threshold: int) -> int:
    """Most registers in a band with which a pair at the threshold shares none of the bands with a chance under ``MISS``."""
    return max((r for r in range(1, 17) if (1 - (threshold / 100) ** r) ** (BUCKETS // r) <= MISS), default=1)


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band (rows of ``registers`` are documents); 0 for a band without any register."""
    bands = BUCKETS // rows
    r = registers[:, :bands * rows].reshape(-1, bands, rows).astype(np.uint64)
    key = np.zeros(r.shape[:2], np.uint64)
    for j in range(rows):
        key = key * np.uint64(0x9E3779B97F4A7C15) + r[:, :, j] + np.uint64(1)
    key = mix(key + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    key[(r == EMPTY).all(2)] = 0
    return key


def compressed(registers: np.ndarray) -> np.ndarray:
    """Registers in 8 bits: 0 if unused, else a hash of leading zeros and mantissa."""
    out = (mix(registers.astype(np.uint64) + np.uint64(1)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    out[registers == EMPTY] = 0
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard, buckets it rests on) for all rows of ``a`` against all of ``b``.

    The agreeing share of the used buckets, less what agrees by chance: two different minima share a register if
    they have the same leading zeros (a third of the time, summed over 4^-z) and the same mantissa; in 8 bits, 1 in 255.
    """
    empty, chance = (0, 1 / 255) if a.dtype == np.uint8 else (EMPTY, 2.0 ** -MANTISSA / 3)
    none_a, none_b = (a == empty), (b == empty)
    unused = none_a.astype(np.float32) @ none_b.T.astype(np.float32)
    agree = (np.stack([(row == b).sum(1) for row in a]) if len(a) <= len(b) else np.stack([(a == row).sum(1) for row in b], 1)) - unused
    n = np.maximum(a.shape[1] - unused, 1)
    return np.clip((agree / n - chance) / (1 - chance), 0, 1), n


class _Bucket:
    """Leaders of one band bucket."""

    def __init__(self, threshold: int):
        self.tie = threshold / 100 - (1 - ABSORB)
        self.leaders, self.regs, self.up = [], np.zeros((0, BUCKETS), np.uint8), {}

    def find(self, i: int) -> int:
        while self.up.setdefault(i, i) != i:
            i = self.up[i]
        return i

    def add(self, ids: list[int], regs: np.ndarray):
        """Take in classes in order; yields the ties that join something."""
        new = 0                                   # leaders from here on are still to be met
        while ids:
            if new < len(self.leaders):
                j, n = estimate(regs, self.regs[new:])
                tied = j >= self.tie - TIE_SIGMAS * np.sqrt(self.tie * (1 - self.tie) / n)
                for row, leader in zip(*(x.tolist() for x in np.nonzero(tied))):
                    a, b = self.find(ids[row]), self.find(self.leaders[new + leader])
                    if a != b:
                        self.up[max(a, b)] = min(a, b)
                        yield a, b
                left = np.flatnonzero(~(j >= ABSORB).any(1))
                ids, regs, new = [ids[i] for i in left.tolist()], regs[left], len(self.leaders)
            if ids:                               # the first one left leads the others
                self.leaders.append(ids[0])
                self.regs = np.concatenate([self.regs, regs[:1]])
                ids, regs = ids[1:], regs[1:]


def ties(members: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(band, class, small) rows -> (a, b) ties; each partition is a stream sorted by band."""
    def run(batches):
        band, bucket, out = None, None, []
        for batch in batches:
            bands = batch.column(0).to_numpy()
            if not len(bands):
                continue
            ids = batch.column(1).to_pylist()
            regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(ids), BUCKETS)
            cuts = [0, *(np.flatnonzero(np.diff(bands)) + 1).tolist(), len(bands)]
            for a, b in zip(cuts, cuts[1:]):
                if band != bands[a]:
                    band, bucket = bands[a], _Bucket(threshold)
                out += bucket.add(ids[a:b], regs[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
            out = []

    return members.select("band", "class", "small").repartition("band").sortWithinPartitions("band", "class").mapInArrow(run, "a long, b long")


def signatures(docs: DataFrame, doc_id: str, text: str, threshold: int = THRESHOLD) -> DataFrame:
    rows = band_rows(threshold)

    def run(batches):
        for batch in batches:
            size = np.cumsum([0, *(len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1).cast(pa.large_binary()))])
            i = 0
            while i < len(batch):
                j = max(i + 1, int(np.searchsorted(size, size[i] + _SLICE_BYTES, "right")) - 1)
                part = batch.slice(i, j - i)
                sets = shingle_sets(part.column(1))
                regs = np.stack([registers_of(s) for s in sets])
                bands = band_keys(regs, rows)
                digest = [digest_of(s) for s in sets]
                keys = [np.unique(k[k != 0]).view(np.int64) for k in bands]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()),
                     pa.array([r.tobytes() for r in compressed(regs)], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "mark", "n_shingles", "digest", "small", "bands"])
                i = j

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                        F.md5(F.col(text).cast("string")).alias("mark")).mapInArrow(run, SIGNATURES))


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def verified_links(ids: np.ndarray, registers: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None,
                   threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links of full-set similarity >= the threshold that connect the rows of a task (a spanning forest)."""
    t = threshold / 100
    size = np.array([len(s) for s in sets])
    found = []
    step = max(1, (1 << 16) // max(len(ids), 1))
    for x in range(0, len(ids), step):
        j, n = estimate(registers[x:x + step], registers)
        ok = (j >= t - SIGMAS * np.sqrt(t * (1 - t) / n)) & (np.minimum(size[x:x + step, None], size) >= t * np.maximum(size[x:x + step, None], size) - 1e-9)
        ok &= np.arange(x, min(x + step, len(ids)))[:, None] < np.arange(len(ids))
        if side is not None:
            ok &= side[x:x + step, None] != side
        a, b = np.nonzero(ok)
        if len(a):
            found.append((a + x, b, j[a, b]))
    if not found:
        return []
    a, b, j = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(-j, kind="stable")
    union, links = _Union(len(ids)), []
    for x, y in zip(a[order].tolist(), b[order].tolist()):
        if union.find(x) != union.find(y):
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both >= threshold * (len(sets[x]) + len(sets[y]) - both):
                union.join(x, y)
                links.append((int(ids[x]), int(ids[y])))
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node connected with each node of (a, b) links, by label contraction."""
    pairs = cut_lineage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    label = None
    while True:
        # each node looks at its smallest neighbour; looking twice shortens chains before the contraction
        both = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).toDF("node", "near")
        step = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("to"))
        after = step.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        step = cut_lineage(step.join(after, "to", "left").select("node", F.coalesce("to2", "to").alias("to")))
        if label is None:
            label = step.withColumnRenamed("to", "component")
        else:
            label = (label.join(step.select(F.col("node").alias("component"), "to"), "component", "left")
                     .select("node", F.coalesce("to", "component").alias("component")))
        label = cut_lineage(label)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        pairs = cut_lineage(pairs.join(left, "a").join(right, "b")
                            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).filter("a <> b").distinct())
        if pairs.isEmpty():
            return label


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    return _judged(docs, doc_id, text, block, threshold).drop("mark")


def _judged(docs: DataFrame, doc_id: str, text: str, block: int, threshold: int) -> DataFrame:
    """``near_duplicates`` with each row's ``mark``, the MD5 of its text."""
    signed = cut_lineage(signatures(docs, doc_id, text, threshold))
    linkable = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # exact copies: they have one signature, so any of them stands for it; combined before the shuffle, however many they are
    reps = cut_lineage(linkable.groupBy("digest").agg(F.min("doc_id").alias("least"), F.any_value("small").alias("small"), F.any_value("bands").alias("bands"))
                       .withColumn("class", F.xxhash64("digest")))
    classes = reps.select("digest", "least", "class")
    named = reps.select("class", "least", "digest")
    banded = reps.select("class", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    met = banded.join(shared, "band").join(reps.select("class", "small"), "class")
    family = components(ties(met, threshold))
    # blocks of families: (family, place) -> class; a family of up to ``block`` classes is one task
    sized = family.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    member = (family.join(sized, "component")
              .select(F.col("node").alias("class"), F.col("component").alias("family"),
                      F.ceil(F.col("n") / block).cast("int").alias("blocks"))
              .withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")))
    tasks = member.select("class", "family", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("class", "family", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    texts = docs.select(F.col(doc_id).cast("long").alias("least"), F.col(text).cast("string").alias("text"))
    wanted = tasks.join(named, "class").join(texts, "least")

    def verify(table: pa.Table) -> pa.Table:
        sets = shingle_sets(table.column("text").combine_chunks())
        # rows that share an id may have other texts, or the same: the digest tells which one stands for the class
        at = list({d: i for i, (d, s) in enumerate(zip(table.column("digest").to_pylist(), sets)) if digest_of(s) == d}.values())
        ids, own = table.column("class").to_numpy()[at], table.column("own").to_numpy()[at]
        sets = [sets[i] for i in at]
        regs = np.stack([registers_of(s) for s in sets])
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        links = verified_links(ids, regs, sets, None if low == high else own, threshold)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    links = wanted.groupBy("family", "low", "high").applyInArrow(verify, "a long, b long")
    linked = cut_lineage(components(links).select(F.col("node").alias("class"), "component").join(reps.select("class", "least"), "class"))
    first = linked.groupBy("component").agg(F.min("least").alias("first"))
    own = classes.join(linked.join(first, "component").select("class", "first"), "class", "left")
    rows = linkable.join(own, "digest").select("doc_id", "mark", "n_shingles", F.coalesce("first", "least").alias("component_id"))
    # rows that are linked with nothing (blank texts may be many) meet no join
    alone = signed.filter(~((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())).select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"))
    rows = rows.unionByName(alone)
    return rows.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text stays (at the smallest id of its group), repeated rows once."""
    name = "_key"
    while any(c.startswith(name) for c in docs.columns):
        name = "_" + name
    gone = (_judged(docs, doc_id, text, BLOCK, threshold).filter(~F.col("kept"))
            .select(F.col("doc_id").alias(f"{name}_gone"), F.col("mark").alias(f"{name}_mark")).distinct())
    left = docs.join(gone, (F.col(doc_id).cast("long") == F.col(f"{name}_gone"))
                     & (F.md5(F.col(f"`{text}`").cast("string")) == F.col(f"{name}_mark")), "left_anti")
    return left.withColumn(name, F.md5(F.col(f"`{text}`"))).dropDuplicates([doc_id, name]).drop(name)
