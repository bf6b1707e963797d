"""Exact k nearest neighbours by pivots and the triangle inequality (for J3).

Rows belong to the cell of their nearest pivot (a seeded choice of ``PIVOTS`` rows) and lie in it at a distance from it. Each
cell is cut, in the order of that distance, into blocks of at most ``BLOCK`` rows, so a block is a ring of its cell. A row first looks into its own block,
which gives a radius that holds k rows. A block is visited only if it can hold a nearer row: if its ring meets the row's radius around the
pivot, and the row's radius reaches over the plane between the two pivots. Visitors of a block come in groups of at most about ``VISITORS``, each
with a copy of the block. What a block returns is at most k rows a visitor; a ranked window merges them.

Equal rows are one point with its first k + 1 keys, so a point that a third of all rows share is looked up once. No task holds more than a
block and a group of visitors, and no plan compares all rows with all rows, unless the data is such that every ring reaches every row.

Defined cases: rows with a null key, or a null or NaN in any column, take no part; equal distances go to the smaller key; a key must be unique; fewer
rows than k + 1 give all others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsekit.operators.rank import running_totals
from lapsekit.session import cut_lineage

PIVOTS, BLOCK, VISITORS = 64, 2048, 8192
_SLACK = 1e-9                         #: relative, for rounding in the bounds
_CHUNK = 1 << 21


def _stack(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))


def _near(x: np.ndarray, own: np.ndarray, y: np.ndarray, names: np.ndarray, k: int):
    """(rows, places, distances) of the ``k`` nearest of ``y`` (by distance, then name) for each row of ``x``, itself left out."""
    step = max(1, _CHUNK // max(1, y.size))
    for i in range(0, len(x), step):
        d = distances(x[i:i + step], y)
        d[own[i:i + step, None] == names] = np.inf
        m = min(k, len(y))
        last = np.partition(d, m - 1, axis=1)[:, m - 1:m]
        row, at = np.nonzero((d <= last) & np.isfinite(d))
        order = np.lexsort((names[at], d[row, at], row))
        row, at = row[order], at[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        ok = place < k
        yield row[ok] + i, at[ok], d[row[ok], at[ok]]


def _placed(points: DataFrame, pivots: np.ndarray, block: int) -> DataFrame:
    """(node, x, cell, dist, block) of each point."""
    def run(batches):
        for b in batches:
            x = _stack(b.column(1))
            cells, dists = [np.zeros(0, np.int64)], [np.zeros(0)]
            for i in range(0, len(x), 4096):
                d = distances(x[i:i + 4096], pivots)
                cells.append(d.argmin(1))
                dists.append(d.min(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(dists), pa.float64())],
                                             names=["node", "x", "cell", "dist"])

    kind = points.schema["node"].dataType.simpleString()
    rows = points.select("node", "x").mapInArrow(run, f"node {kind}, x array<double>, cell int, dist double")
    return (running_totals(rows, ["cell", "dist", "node"], {"at": (None, True)})
            .withColumn("block", F.floor((F.col("at") - 1) / block)).drop("at"))


def _first_radius(k: int):
    def run(t: pa.Table) -> pa.Table:
        x, names = _stack(t.column("x")), np.arange(t.num_rows)
        radius = np.full(t.num_rows, np.inf)
        for row, _, d in _near(x, names, x, names, k):
            full = np.bincount(row, minlength=t.num_rows) >= k
            far = np.zeros(t.num_rows)
            np.maximum.at(far, row, d)
            radius[full] = far[full]
        return t.append_column("radius", pa.array(radius))
    return run


def _reaching(pivots: np.ndarray):
    """(node, x, radius, to, low, high): the cells whose plane a row's radius reaches, and the ring of them that it meets."""
    between = distances(pivots, pivots)

    def run(batches):
        for b in batches:
            x, cell, own, radius = _stack(b.column(1)), b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(5).to_numpy()
            for i in range(0, len(x), 4096):
                d = distances(x[i:i + 4096], pivots)
                c, o, r = cell[i:i + 4096], own[i:i + 4096], radius[i:i + 4096]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.where(between[c] > 0, (d ** 2 - o[:, None] ** 2) / (2 * between[c]), 0)
                slack = _SLACK * (1 + d + np.where(np.isfinite(r), r, 0)[:, None])
                row, to = np.nonzero(plane <= r[:, None] + slack)
                at = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(r[row]), pa.array(to.astype(np.int32)),
                                                  pa.array((d - r[:, None] - slack)[row, to]), pa.array((d + r[:, None] + slack)[row, to])],
                                                 names=["node", "x", "radius", "to", "low", "high"])
    return run


def _visit(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list = [[], [], []]
        if left.num_rows and right.num_rows:
            who, names = left.column("node").combine_chunks(), right.column("node").combine_chunks()
            radius = left.column("radius").to_numpy()
            # both sides in one numbering, in the order of their names
            every = pa.concat_arrays([who, names]).dictionary_encode()
            order = np.argsort(np.array(every.dictionary.to_pylist(), dtype=object))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            code = rank[every.indices.to_numpy()]
            for row, at, d in _near(_stack(left.column("x")), code[:len(who)], _stack(right.column("x")), code[len(who):], k):
                ok = d <= radius[row]
                found[0].append(who.take(pa.array(row[ok])))
                found[1].append(names.take(pa.array(at[ok])))
                found[2].append(pa.array(d[ok]))
        kind = (left if left.num_rows else right).column("node").type
        return pa.table([pa.chunked_array(found[0], kind), pa.chunked_array(found[1], kind), pa.chunked_array(found[2], pa.float64())], names=["node", "near", "d"])
    return run


def exact_neighbours(df: DataFrame, key: str, cols: Sequence[str], k: int, pivots: int = PIVOTS, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """(a, b, d, place): the ``k`` nearest other rows b of each row a, by Euclidean distance d over ``cols``; place from 1."""
    x = F.array(*[F.col(f"`{c}`").cast("double") + F.lit(0.0) for c in cols])
    rows = (df.select(F.col(f"`{key}`").alias("key"), x.alias("x"))
            .filter(F.col("key").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))))
    nodes = cut_lineage(rows.groupBy("x").agg(F.min("key").alias("node")))
    rows = cut_lineage(rows.join(nodes, "x").select("key", "node"))
    keys = rows.withColumn("i", F.row_number().over(Window.partitionBy("node").orderBy("key"))).filter(F.col("i") <= k + 1).select("node", "key")
    chosen = nodes.orderBy(F.xxhash64("x", F.lit(seed)), "node").limit(pivots).collect()        # at most ``pivots`` rows
    kind = nodes.schema["node"].dataType.simpleString()
    if not chosen:
        return rows.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(0.0).alias("d"), F.lit(1).alias("place")).limit(0)
    at = np.array([r["x"] for r in chosen], float)
    placed = cut_lineage(_placed(nodes, at, block))
    reach = cut_lineage(placed.groupBy("cell", "block").applyInArrow(_first_radius(k), f"node {kind}, x array<double>, cell int, dist double, block long, radius double"))
    rings = placed.select(F.col("cell").alias("to"), F.col("block").alias("ring"), "dist").groupBy("to", "ring").agg(F.min("dist").alias("inner"), F.max("dist").alias("outer"))
    calls = reach.select("node", "x", "cell", "dist", "block", "radius").mapInArrow(_reaching(at), f"node {kind}, x array<double>, radius double, to int, low double, high double")
    visits = cut_lineage(calls.join(rings, "to").filter("inner <= high AND outer >= low")
                         .select("node", "x", "radius", F.col("to").alias("cell"), F.col("ring").alias("block")))
    groups = visits.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("groups"))
    left = visits.join(groups, ["cell", "block"]).withColumn("group", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int")).drop("groups")
    right = (placed.join(groups, ["cell", "block"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
             .select("node", "x", "cell", "block", "group"))
    found = (left.groupBy("cell", "block", "group").cogroup(right.groupBy("cell", "block", "group"))
             .applyInArrow(_visit(k), f"node {kind}, near {kind}, d double"))
    best = found.withColumn("i", F.row_number().over(Window.partitionBy("node").orderBy("d", "near"))).filter(F.col("i") <= k).select("node", "near", "d")
    best = best.unionByName(nodes.select("node", F.col("node").alias("near"), F.lit(0.0).alias("d")))
    # back from points to rows: a point's list of k + 1 serves all rows on it
    listed = best.join(keys.withColumnRenamed("node", "near"), "near").withColumn("i", F.row_number().over(Window.partitionBy("node").orderBy("d", "key")))
    listed = listed.filter(F.col("i") <= k + 1).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("i", "key", "d"))).alias("list"))
    own = F.slice(F.filter("list", lambda n: n["key"] != F.col("a")), 1, k)
    return (rows.select(F.col("key").alias("a"), "node").join(listed, "node").select("a", F.posexplode(own).alias("place", "n"))
            .select("a", F.col("n.key").alias("b"), F.col("n.d").alias("d"), (F.col("place") + 1).alias("place")))
