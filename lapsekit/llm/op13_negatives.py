"""Hard negatives by segment summaries.

Each vector is cut into segments. A segment's *summary* is its mean and its deviation (the norm of what is left without
the mean). For two vectors, the product of a segment's means, times its length, plus or minus the product of the
deviations bounds the segment's part of the inner product (Cauchy-Schwarz); the sums over segments bound the score. A row
stores the summaries of its finest segments, and coarser ones follow from them: the parent's mean is the weighted mean of its
children, and its squared deviation adds what the children's means differ by.

Anchors, in blocks, meet all rows, in slices (``_meet``: two cogrouped tables of bounded groups). For an anchor, a task looks for the
``k`` best rows in each of its score windows: level by level it bounds the rows that are still open, scores a few promising
ones exactly, and closes every row whose upper bound is under the k-th exact score of all windows, or whose lower bound is over
them. Rows still open after the finest level are scored exactly. Two passes do the work: each anchor's positives
(same label, one window without limits), then the negatives in the window that each positive opens. A slice returns at most k rows for
an anchor and window, and a ranked window over these merges the slices. Results are exact.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no part, nor do rows with
a component of ``LIMIT`` or more after scaling (a long could not hold their scores); vectors of different lengths count as
padded with zeros; an id that occurs more than once is its row with the smallest (vector, label); an empty vector scores 0; equal
scores go to the smaller id; extra columns are ignored; an empty table gives no rows; a label that holds a third of all rows, or many equal vectors,
are dealt over all slices like other rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsekit.session import cut_lineage

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90                    #: percent of the positive's score
LIMIT = 1 << 25                       #: of a scaled component; exact in double precision up to 2^53, in long beyond
SEGMENT = 2                           #: components in a finest segment
LEVELS = (16, 4, 1)                   #: finest segments in a segment, coarse to fine
SLICE, BLOCK = 8192, 1024             #: rows and anchors in a task, about
PROBES = 24                           #: rows scored exactly after each level
ROWS = "vec_id long, label long, comps binary, means binary, devs binary"


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each finest segment of each row (the last one is padded with zeros)."""
    parts = np.pad(x, ((0, 0), (0, -x.shape[1] % SEGMENT))).reshape(len(x), -1, SEGMENT).astype(np.float64)
    mean = parts.mean(2)
    return mean, np.sqrt(((parts - mean[:, :, None]) ** 2).sum(2))


def coarser(mean: np.ndarray, dev: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Summaries of segments of ``step`` finest ones each, from those alone."""
    if step == 1:
        return mean, dev
    fill = ((0, 0), (0, -mean.shape[1] % step))
    mean, dev = (np.pad(a, fill).reshape(len(a), -1, step) for a in (mean, dev))
    top = mean.mean(2)
    return top, np.sqrt((dev ** 2).sum(2) + SEGMENT * ((mean - top[:, :, None]) ** 2).sum(2))


def prepared(vectors: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """(vec_id, label, scaled components, finest summaries) of the rows that take part, one for each id."""
    x = F.col(f"`{vector}`").cast("array<double>")
    fits = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float(LIMIT) / SCALE))      # a NaN is over every bound
    rows = (vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))
            .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()))
    rows = rows.select("vec_id", "label", F.when(fits, F.transform("x", lambda v: F.floor(v * SCALE))).alias("x")).filter("x is not null")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("x", "label")).alias("r")).select("vec_id", "r.label", "r.x")

    def run(batches):
        for batch in batches:
            comps, means, devs = [], [], []
            for row in batch.column(2):
                v = np.asarray(row.values.to_numpy(zero_copy_only=False), np.int64)
                m, d = summaries(v[None])
                comps.append(v.astype(np.int32).tobytes())
                means.append(m.tobytes())
                devs.append(d.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(a, pa.binary()) for a in (comps, means, devs))],
                                             names=["vec_id", "label", "comps", "means", "devs"])

    return rows.mapInArrow(run, ROWS)


def _stack(col: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    out = np.zeros((len(col), width), kind)
    for i, b in enumerate(col.to_pylist()):
        v = np.frombuffer(b, kind)
        out[i, :len(v)] = v
    return out


class _Slice:
    """Rows of a task, with their summaries at every level."""

    def __init__(self, table: pa.Table, width: int):
        self.ids, self.label = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        self.comps = _stack(table.column("comps"), np.int32, width).astype(np.int64)
        size = -(-width // SEGMENT)
        fine = _stack(table.column("means"), np.float64, size), _stack(table.column("devs"), np.float64, size)
        self.levels = [coarser(*fine, step) for step in LEVELS]
        self.norm = np.sqrt((self.comps.astype(np.float64) ** 2).sum(1))
        self.exact = np.float64 if width * float(np.abs(self.comps).max(initial=0)) ** 2 < 2 ** 52 else np.int64
        self.wide = self.comps.astype(self.exact)


def _bounds(a: _Slice, i: int, rows: _Slice, at: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, how far the score may be from it) of the rows ``at`` for anchor ``i``."""
    (m, d), (ma, da) = rows.levels[level], a.levels[level]
    slack = 1 + 1e-9 * a.norm[i] * rows.norm[at]
    return SEGMENT * LEVELS[level] * (m[at] @ ma[i]), d[at] @ da[i] + slack


def best_in_windows(a: _Slice, i: int, rows: _Slice, at: np.ndarray, windows: list[tuple[float, float]], k: int,
                    count: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (low, high): places and scores of the first ``k`` rows of ``at`` by (score, smaller id) within it."""
    place, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.array([w[0] for w in windows], np.float64)          # the k-th exact score, as soon as a window has k
    most = np.array([w[1] for w in windows], np.float64)

    def take(more: np.ndarray):
        nonlocal place, score
        found = (rows.wide[more] @ a.wide[i].astype(rows.exact)).astype(np.int64) if rows.exact is a.exact else rows.comps[more] @ a.comps[i]
        place, score = np.append(place, more), np.append(score, found)
        for w, (low, high) in enumerate(windows):
            inside = score[(score >= low) & (score <= high)]
            if len(inside) >= k:
                least[w] = np.partition(inside, len(inside) - k)[len(inside) - k]

    for level in range(len(LEVELS)):
        if not len(at):
            break
        mid, reach = _bounds(a, i, rows, at, level)
        # the rows whose estimates come first under each window's upper end
        seeds = [np.argpartition(x := np.where(mid <= high, -mid, np.inf), min(PROBES, len(x) - 1))[:PROBES] for high in set(most.tolist())]
        probe = np.zeros(len(at), bool)
        probe[np.concatenate(seeds)] = True
        take(at[probe])
        open_ = ((mid + reach)[:, None] >= least) & ((mid - reach)[:, None] <= most)
        at = at[open_.any(1) & ~probe]
    take(at)
    if count is not None:
        count.append(len(place))
    out = []
    for low, high in windows:
        ok = np.flatnonzero((score >= low) & (score <= high))
        ok = ok[np.lexsort((rows.ids[place[ok]], -score[ok]))[:k]]
        out.append((place[ok], score[ok]))
    return out


def _meet(anchors: DataFrame, rows: DataFrame, find, schema: str) -> DataFrame:
    """``find(anchors, rows)`` for every block of ``anchors`` and slice of ``rows`` (all of both)."""
    n_slices = max(1, -(-rows.count() // SLICE))
    n_blocks = max(1, -(-anchors.count() // BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n_blocks)).cast("int")).withColumn("slice", every(n_slices))
    right = rows.withColumn("slice", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(n_slices)).cast("int")).withColumn("block", every(n_blocks))
    return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(find, schema)


def _both(left: pa.Table, right: pa.Table) -> tuple[_Slice, _Slice]:
    width = max([len(b) // 4 for t in (left, right) for b in t.column("comps").to_pylist()], default=0)
    return _Slice(left, max(width, 1)), _Slice(right, max(width, 1))


def _find_positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        if left.num_rows and right.num_rows:
            a, rows = _both(left, right)
            for i in range(len(a.ids)):
                at = np.flatnonzero((rows.label == a.label[i]) & (rows.ids != a.ids[i]))
                (place, score), = best_in_windows(a, i, rows, at, [(-np.inf, np.inf)], k)
                out[0] += [a.ids[i]] * len(place)
                out[1] += rows.ids[place].tolist()
                out[2] += score.tolist()
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["anchor_id", "positive_id", "positive_score"])
    return run


def _find_negatives(k: int, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            a, rows = _both(left, right)
            ids, scores = left.column("positive_ids").to_pylist(), left.column("positive_scores").to_pylist()
            for i in range(len(a.ids)):
                # whole scores s with low * p <= 100 * s <= high * p
                open_ = [(p, s, -(-low * s // 100), high * s // 100) for p, s in zip(ids[i], scores[i]) if low * s <= high * s]
                if not open_:
                    continue
                at = np.flatnonzero(rows.label != a.label[i])
                for (p, s, _, _), (place, score) in zip(open_, best_in_windows(a, i, rows, at, [w[2:] for w in open_], k)):
                    out[0] += [a.ids[i]] * len(place)
                    out[1] += [p] * len(place)
                    out[2] += [s] * len(place)
                    out[3] += rows.ids[place].tolist()
                    out[4] += score.tolist()
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
    return run


def hard_negatives(vectors: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchors`` is a condition on ``vec_id``."""
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = cut_lineage(prepared(vectors, vec_id, vector, label))
    asked = rows.filter(anchors)
    by_score = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = (_meet(asked, rows, _find_positives(positives), "anchor_id long, positive_id long, positive_score long")
            .withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= positives))
    best = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    armed = cut_lineage(asked.join(best, asked["vec_id"] == best["anchor_id"])
                        .select(*asked.columns, F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores")))
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    of_pair = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (_meet(armed, rows, _find_negatives(negatives, low, high), schema)
            .withColumn("rank", F.row_number().over(of_pair)).filter(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
