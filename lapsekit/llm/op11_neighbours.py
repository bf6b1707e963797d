"""Approximate nearest neighbours by largest inner product: a neighbour graph by NN-descent, then greedy graph search.

*Points* (``points``): equal vectors are one point, named by its smallest id. Within a *band* of norms (a factor of two) a vector is divided
by the band's upper norm and gets one more component that brings it to length one; the largest inner product is then also the
nearest point, so the graph is one of distances. Points travel as one byte a component; what is returned is scored on the original vectors.

*Graph* (``neighbour_graph``): ``TREES`` orders by the signs of random projections are cut into runs of ``LEAF`` points, which give the first
neighbours. Each NN-descent round is a join of neighbours of neighbours: every point sends its vector to its neighbours and to
those it is a neighbour of, each point compares what it has got (pairs with a new neighbour only), and proposals better than the
receiver's last neighbour are merged into its ``K`` best. Popular points are sent a random share of their many senders. Rounds end when under
``SETTLED`` of the neighbours are new, or after ``ROUNDS``. At last a point's row holds its neighbours, some of those
it is a neighbour of, and their vectors.

*Search* (``search``): a query starts from the points beside it in the projection orders, and expands the best points of its beam of ``BEAM`` in rounds of
joins between expanded points and graph rows, until every point of the beam is expanded. All queries move in the same rounds, so their number
does not grow with the table. Each band is searched by itself and the results are merged.

*Tasks*: a round is many short stages, so what a keyed shuffle has dealt out is taken by as many tasks as its points or queries need (``tasks``), at
most one for each of the session's shuffle partitions; keys stay whole, and a large table has all partitions at work.

The index holds every row. The recall depends on ``K``, ``ROUNDS`` and ``BEAM``, and is measured in the tests and the README.

Defined cases: rows with a null id, or whose vector is null, zero, empty or holds a null or non-finite component take no part; vectors of
different lengths count as padded with zeros; an id that occurs more than once is its row with the smallest vector;
equal scores go to the smaller id; fewer candidates than asked for are all returned; extra columns are ignored; an empty table gives no rows. Copies of one
vector are searched once: a point keeps the ids of its first k + 1 copies, more can't be among the k best.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsekit.llm.textwords import mix
from lapsekit.session import cut_lineage

TOP = 20
K, REVERSE, BACK = 32, 16, 8          #: neighbours kept; senders to a point in a round; reverse edges in the finished graph
TREES, LEAF, SIGNS = 6, 256, 24
ROUNDS, SETTLED, PROPOSALS = 5, 0.08, 4
BEAM, ENTRIES, KEEP = 352, 2, 64      #: points in a query's beam; orders it starts from; points scored exactly
WIDTHS = (16, 32, 64, 96)             #: points that a query expands in the first rounds, the last one in all others
BANDS = 8                             #: bands of norms; all smaller vectors share the last
POINTS, ASKED = 2048, 128             #: points of the graph, or queries of the search, that make a task
_SHIFT = 0.37                         #: band limits are off the powers of two, where unit vectors lie
POINT = "node long, band int, point binary, keys array<long>, mixed array<long>"
LISTS = "node long, ids array<long>, sims array<float>, fresh array<tinyint>"      # a node's best first; fresh: new in this round, or not expanded
_CHUNK = 1 << 21                      #: products held at once


def encode(v: np.ndarray, limit: float, dim: int) -> bytes:
    """Scale, the added component and a byte for each of ``dim`` components of ``v / limit``."""
    v = np.pad(v[:dim], (0, max(0, dim - len(v)))) / limit
    scale = max(float(np.abs(v).max(initial=0)), 1e-30) / 127
    rest = math.sqrt(max(0.0, 1 - float(v @ v)))
    return np.array([scale, rest], np.float32).tobytes() + np.round(v / scale).astype(np.int8).tobytes()


def decode(blobs: list[bytes]) -> np.ndarray:
    """Rows of components, the added one last."""
    size = len(blobs[0]) if blobs else 8
    return decoded(np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), size))


def decoded(raw: np.ndarray) -> np.ndarray:
    out = np.empty((len(raw), raw.shape[1] - 7), np.float32)
    head = np.ascontiguousarray(raw[:, :8]).view(np.float32)
    out[:, :-1] = raw[:, 8:].view(np.int8)
    out[:, :-1] *= head[:, :1]
    out[:, -1] = head[:, 1]
    return out


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, v in double precision, one for each id."""
    x = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda c: c + F.lit(0.0))       # -0.0 becomes 0.0
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), x.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def norm(v) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, c: s + c * c))


def octave(v) -> Column:
    return F.greatest(F.floor(F.log2(norm(v)) - _SHIFT), F.lit(-1000)).cast("int")


def limit(band: int) -> float:
    """The upper norm of a band."""
    return 2.0 ** (band + 1 + _SHIFT)


def tasks(rows: DataFrame, n: int, each: int) -> int:
    """Tasks for ``n`` points or queries: two a core at least, then one for ``each`` of them."""
    return max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-n // each))


class Index:
    """``copies`` (node, vec_id, v) of the first k + 1 equal vectors of each node, ``nodes`` (node, band, point), ``graph`` (node, ids, near);
    ``parts``: the tasks for them."""

    def __init__(self, rows: DataFrame, parts: int, k: int = TOP, rounds: int = ROUNDS):
        same = Window.partitionBy("h", "v").orderBy("vec_id")
        self.k, self.parts = k, parts
        numbered = rows.withColumn("h", F.xxhash64("v")).withColumn("place", F.row_number().over(same))
        self.copies = cut_lineage(numbered.filter(F.col("place") <= k + 1).withColumn("node", F.min("vec_id").over(Window.partitionBy("h", "v"))).coalesce(parts))
        first = self.copies.filter("place = 1")
        top, dim = first.agg(F.max(octave("v")), F.max(F.size("v"))).first()
        self.dim, self.top = dim or 0, top or 0
        self.nodes = cut_lineage(_coded(first.select("node", F.greatest(octave("v"), F.lit(self.top - BANDS + 1)).alias("band"), "v"), self.dim))
        self.sizes = {r["band"]: r["n"] for r in self.nodes.groupBy("band").agg(F.count(F.lit(1)).alias("n")).coalesce(parts).collect()}     # at most BANDS rows
        self.lists = neighbour_graph(self.nodes, parts, rounds)
        self.graph = cut_lineage(packed(self.lists, self.nodes, parts))


def _coded(rows: DataFrame, dim: int, asked: bool = False) -> DataFrame:
    """POINT rows of (node, band, v) rows, with the places in each projection order: the signs of random projections, and a number that mixes
    equal ones; a query is brought to length one instead."""
    def run(batches):
        planes = [np.random.default_rng(100 + tree).standard_normal((dim, SIGNS)).astype(np.float32) for tree in range(TREES)]
        for batch in batches:
            if not batch.num_rows:
                continue
            blobs = []
            for v, band in zip(batch.column(2), batch.column(1).to_pylist()):
                v = np.asarray(v.values.to_numpy(zero_copy_only=False))
                blobs.append(encode(v, float(np.linalg.norm(v / np.abs(v).max()) * np.abs(v).max()) if asked else limit(band), dim))
            x, node = decode(blobs)[:, :-1], batch.column(0).to_numpy().astype(np.uint64)
            keys = np.stack([((x @ p) > 0) @ (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)) for p in planes], axis=1)
            mixed = np.stack([mix(node + np.uint64(tree)).view(np.int64) for tree in range(TREES)], axis=1)
            starts = np.arange(len(x) + 1) * TREES
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary()), _listed(keys.ravel(), starts), _listed(mixed.ravel(), starts)],
                                             names=["node", "band", "point", "keys", "mixed"])

    return rows.select("node", "band", "v").mapInArrow(run, POINT)


def _pieces(batches, key: int = 0, rows: int = 1 << 14):
    """Whole groups of a stream sorted by its column ``key``, as tables of about ``rows`` rows or more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column(key).to_numpy()
        cut = int(np.searchsorted(ids, ids[-1]))
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            size = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _binary(parts: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One binary value for each run of ``parts`` between ``starts``."""
    data = np.ascontiguousarray(parts)
    offsets = (starts * data.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _listed(parts: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One list for each run of ``parts`` between ``starts``."""
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(parts))


def _flat(col) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and how many each row has."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks)
    return col.flatten().to_numpy(zero_copy_only=False), col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def best_lists(node: np.ndarray, ids: np.ndarray, sims: np.ndarray, fresh: np.ndarray, k: int) -> pa.RecordBatch:
    """The best ``k`` different ids of each node, best first; of equal entries an old one counts."""
    order = np.lexsort((fresh, ids, node))
    node, ids, sims, fresh = node[order], ids[order], sims[order], fresh[order]
    one = np.ones(len(node), bool)
    one[1:] = (node[1:] != node[:-1]) | (ids[1:] != ids[:-1])
    node, ids, sims, fresh = node[one], ids[one], sims[one], fresh[one]
    order = np.lexsort((ids, -sims, node))
    node, ids, sims, fresh = node[order], ids[order], sims[order], fresh[order]
    begin = np.flatnonzero(np.diff(node, prepend=node[:1] - 1))
    place = np.arange(len(node)) - np.repeat(begin, np.diff(np.append(begin, len(node))))
    ok = place < k
    node, ids, sims, fresh = node[ok], ids[ok], sims[ok], fresh[ok]
    begin = np.flatnonzero(np.diff(node, prepend=node[:1] - 1))
    starts = np.append(begin, len(node))
    return pa.RecordBatch.from_arrays([pa.array(node[begin]), _listed(ids, starts), _listed(sims.astype(np.float32), starts), _listed(fresh.astype(np.int8), starts)],
                                      names=["node", "ids", "sims", "fresh"])


def merged(lists: DataFrame, k: int, parts: int) -> DataFrame:
    """The lists of each node (rows of LISTS) as one list of its ``k`` best."""
    def run(batches):
        for t in _pieces(batches):
            ids, n = _flat(t.column("ids"))
            yield best_lists(np.repeat(t.column("node").to_numpy(), n), ids, _flat(t.column("sims"))[0], _flat(t.column("fresh"))[0], k)

    return lists.repartition("node").coalesce(parts).sortWithinPartitions("node").mapInArrow(run, LISTS)


def _keyed(rows: DataFrame, trees: int) -> DataFrame:
    """(tree, band, key, mixed, node, query, point) for each projection order."""
    places = F.posexplode(F.slice(F.arrays_zip("keys", "mixed"), 1, trees)).alias("tree", "x")
    return rows.select("band", "node", "query", "point", places).select("tree", "band", F.col("x.keys").alias("key"), "x.mixed", "node", "query", "point")


def _spans(table: pa.Table, leaf: int) -> list[np.ndarray]:
    """Rows of each run: one tree and band, about ``leaf`` points (and the queries between them)."""
    where = table.column("tree").to_numpy().astype(np.int64) << 32 | (table.column("band").to_numpy().astype(np.int64) & 0xFFFFFFFF)
    cuts = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(where)]
    real = ~table.column("query").to_numpy()
    out = []
    for a, b in zip(cuts, cuts[1:]):
        seen = np.cumsum(real[a:b])
        n = max(1, round(int(seen[-1]) / leaf)) if b > a else 1
        inner = np.searchsorted(seen, seen[-1] * np.arange(1, n) / n, "right") if b > a else []
        out += np.split(np.arange(a, b), inner)
    return out


def beside(rows: DataFrame, trees: int, k: int, n: int, parts: int, asked: bool = False) -> DataFrame:
    """LISTS of the ``k`` best points that each point (or, if ``asked``, each query) among the (node, band, query, point) rows meets
    in a run of each projection order; ``n``: about how many rows there are."""
    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for at in _spans(t, LEAF):
                part = t.slice(at[0], len(at)) if len(at) else None
                if part is None:
                    continue
                x, node, query = decode(part.column("point").to_pylist()), part.column("node").to_numpy(), part.column("query").to_numpy()
                real = np.flatnonzero(~query)
                seek = np.flatnonzero(query) if asked else real
                if not len(real) or not len(seek):
                    continue
                for i in range(0, len(seek), 4 * LEAF):
                    own = seek[i:i + 4 * LEAF]
                    sims = x[own] @ x[real].T
                    if not asked:
                        sims[node[own][:, None] == node[real]] = -np.inf
                    m = min(k, len(real))
                    best = np.argpartition(-sims, m - 1, axis=1)[:, :m]
                    got = np.take_along_axis(sims, best, 1)
                    ok = np.isfinite(got).ravel()
                    if ok.any():
                        yield best_lists(np.repeat(node[own], m)[ok], node[real][best].ravel()[ok], got.ravel()[ok], np.ones(int(ok.sum()), np.uint8), m)

    ranges = max(1, n * trees // (64 * LEAF))
    dealt = _keyed(rows, trees).repartitionByRange(ranges, "tree", "band", "key", "mixed").coalesce(parts)
    return dealt.sortWithinPartitions("tree", "band", "key", "mixed").mapInArrow(run, LISTS)


def _edges(lists: DataFrame) -> DataFrame:
    """(src, dst, fresh) rows of lists."""
    each = lists.select(F.col("node").alias("src"), F.explode(F.arrays_zip("ids", "fresh")).alias("x"))
    return each.select("src", F.col("x.ids").alias("dst"), F.col("x.fresh").cast("int").alias("fresh"))


def thinned(edges: DataFrame, most: int, salt: int, parts: int) -> DataFrame:
    """Edges of which a ``dst`` has about ``most`` at the most: a random share of a popular one's."""
    popular = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    share = F.pmod(F.xxhash64("src", "dst", F.lit(salt)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    kept = edges.join(popular.hint("merge"), "dst", "left").filter(F.col("n").isNull() | (share < F.lit(float(most)) / F.col("n")))
    return kept.select("src", "dst", "fresh").coalesce(parts)


def _introduced(batches):
    """(to, node, fresh, point, least) rows sorted by ``to`` -> proposals to the nodes that met at one point."""
    for t in _pieces(batches):
        to, node = t.column("to").to_numpy(), t.column("node").to_numpy()
        order = np.lexsort((-t.column("fresh").to_numpy(), node, to))
        to, node = to[order], node[order]
        one = np.ones(len(to), bool)
        one[1:] = (to[1:] != to[:-1]) | (node[1:] != node[:-1])
        order, to, node = order[one], to[one], node[one]
        x = decode(t.column("point").take(pa.array(order)).to_pylist())
        fresh, least = t.column("fresh").to_numpy()[order] > 0, t.column("least").to_numpy()[order]
        begin = np.append(np.flatnonzero(np.diff(to, prepend=to[0] - 1)), len(to))
        size = np.diff(begin)
        found: list = [[], [], []]
        g = 0
        while g < len(size):
            width = int(size[g])
            h = g + 1                                   # groups go together while their products fit
            while h < len(size) and (w := max(width, int(size[h]))) ** 2 * (h + 1 - g) <= _CHUNK:
                width, h = w, h + 1
            at = begin[g:h, None] + np.arange(width)
            none = at >= begin[g + 1:h + 1, None]
            at[none] = 0
            v = x[at]
            sims = v @ v.transpose(0, 2, 1)
            sims[none[:, :, None] | none[:, None, :]] = -np.inf
            sims[~(fresh[at][:, :, None] | fresh[at][:, None, :])] = -np.inf
            sims[:, np.arange(width), np.arange(width)] = -np.inf
            sims[sims <= least[at][:, :, None]] = -np.inf
            m = min(PROPOSALS, width)
            best = np.argpartition(-sims, m - 1, axis=2)[:, :, :m]
            got = np.take_along_axis(sims, best, 2)
            ok = np.isfinite(got)
            found[0].append(np.broadcast_to(node[at][:, :, None], got.shape)[ok])
            found[1].append(np.take_along_axis(np.broadcast_to(node[at][:, None, :], sims.shape), best, 2)[ok])
            found[2].append(got[ok])
            g = h
        src, ids, sims = (np.concatenate(f) for f in found)
        if len(src):
            yield best_lists(src, ids, sims, np.ones(len(src), np.uint8), K)


def _worst(col: str, k: int) -> Column:
    """The last similarity of a full list of ``k``; below all others if it isn't full."""
    return F.when(F.size(col) >= k, F.element_at(col, -1)).otherwise(F.lit(-9.0)).cast("float")


def descended(lists: DataFrame, nodes: DataFrame, salt: int, parts: int) -> DataFrame:
    """One round: neighbours of neighbours are joined at the point between them."""
    edges = _edges(lists)
    forth = edges.select(F.col("src").alias("to"), F.col("dst").alias("node"), "fresh")
    back = thinned(edges, REVERSE, salt, parts).select(F.col("dst").alias("to"), F.col("src").alias("node"), "fresh")
    known = nodes.select("node", "point").join(lists.select("node", _worst("sims", K).alias("least")).hint("merge"), "node").coalesce(parts)
    sent = forth.unionByName(back).join(known, "node").coalesce(parts).select("to", "node", "fresh", "point", "least")     # a coalesce right under repartition() would go
    proposals = sent.repartition("to").coalesce(parts).sortWithinPartitions("to").mapInArrow(_introduced, LISTS)
    return merged(_stale(lists).unionByName(proposals), K, parts)


def _stale(lists: DataFrame) -> DataFrame:
    """The lists with no entry new."""
    return lists.withColumn("fresh", F.transform("fresh", lambda x: F.lit(0).cast("tinyint")))


def neighbour_graph(nodes: DataFrame, parts: int, rounds: int = ROUNDS) -> DataFrame:
    """LISTS of each point's ``K`` nearest, approximately."""
    n = nodes.count()
    lists = cut_lineage(merged(beside(nodes.withColumn("query", F.lit(False)), TREES, K, n, parts), K, parts))
    for number in range(rounds):
        lists = cut_lineage(descended(lists, nodes, number, parts))
        new, all_ = lists.agg(F.sum(F.size(F.filter("fresh", lambda x: x == 1))), F.sum(F.size("fresh"))).first()
        if not all_ or new < SETTLED * all_:
            break
    return lists


def packed(lists: DataFrame, nodes: DataFrame, parts: int) -> DataFrame:
    """(node, ids, near) of every point: its neighbours and some of those it is a neighbour of, with their vectors one after another."""
    edges = _edges(lists)
    both = edges.select(F.col("src").alias("at"), F.col("dst").alias("node")).union(
        thinned(edges, BACK, 97, parts).select(F.col("dst").alias("at"), F.col("src").alias("node"))).distinct().coalesce(parts)

    def run(batches):
        for t in _pieces(batches):
            at = t.column("at").to_numpy()
            begin = np.append(np.flatnonzero(np.diff(at, prepend=at[0] - 1)), len(at))
            data = np.frombuffer(b"".join(t.column("point").to_pylist()), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(at[begin[:-1]]), _listed(t.column("node").to_numpy(), begin), _binary(data, begin * (len(data) // len(at)))], names=["node", "ids", "near"])

    sent = both.join(nodes.select("node", "point"), "node").coalesce(parts).select("at", "node", "point")
    return sent.repartition("at").coalesce(parts).sortWithinPartitions("at").mapInArrow(run, "node long, ids array<long>, near binary")


def _found(lists: DataFrame) -> DataFrame:
    """(node, id, sim, fresh) rows of lists."""
    each = lists.select("node", F.explode(F.arrays_zip("ids", "sims", "fresh")).alias("x"))
    return each.select("node", F.col("x.ids").alias("id"), F.col("x.sims").alias("sim"), F.col("x.fresh").alias("fresh"))


def _moved(found: DataFrame, width: int, beam: int) -> DataFrame:
    """The beams, a row for each point: (node, id, sim, place, least, fresh) of the ``beam`` best points found by each node; the next ``width``
    to expand have a 2 in ``fresh``, ``least`` is the last similarity of a full beam. Of equal points an old one counts."""
    best = Window.partitionBy("node").orderBy(F.desc("sim"), "id")
    all_ = Window.partitionBy("node")
    one = found.repartition("node").groupBy("node", "id").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    kept = one.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= beam)
    ahead = F.sum("fresh").over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    full = F.when(F.count(F.lit(1)).over(all_) >= beam, F.min("sim").over(all_)).otherwise(F.lit(-9.0)).cast("float")
    marked = kept.withColumn("ahead", ahead).withColumn("least", full)
    return marked.select("node", "id", "sim", "place", "least", F.when((F.col("fresh") == 1) & (F.col("ahead") <= width), 2).otherwise(F.col("fresh")).cast("tinyint").alias("fresh"))


def _expanded(beams: DataFrame, asked: DataFrame, graph: DataFrame, beam: int, parts: int) -> DataFrame:
    """What the marked points of each beam lead to, as far as it is better than the beam's last."""
    def scored(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                ids, n = _flat(part.column(3))
                if not len(ids):
                    continue
                q = decode(part.column(1).to_pylist())
                row = np.repeat(np.arange(len(q)), n)
                x = decoded(np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8).reshape(len(ids), -1))
                sims = np.einsum("ij,ij->i", x, q[row])
                ok = sims > part.column(2).to_numpy()[row]
                if ok.any():
                    yield best_lists(part.column(0).to_numpy()[row[ok]], ids[ok], sims[ok], np.ones(int(ok.sum()), np.int8), beam)

    calls = beams.filter("fresh = 2").select("node", "least", F.col("id").alias("at")).join(asked.select("node", "point"), "node").coalesce(parts)
    met = calls.join(graph.select(F.col("node").alias("at"), F.col("ids").alias("to"), "near"), "at").select("node", "point", "least", "to", "near")
    return _found(met.coalesce(parts).mapInArrow(scored, LISTS))


def search(index: Index, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """(query, node, score) of the ``KEEP`` best nodes found for each (query, v) row, in every band; the score is exact."""
    keep = max(KEEP, 2 * index.k)
    spread = queries.withColumn("band", F.explode(F.array(*(F.lit(b) for b in sorted(index.sizes)) or [F.lit(0)])))
    slots = cut_lineage(spread.withColumn("node", F.monotonically_increasing_id()))
    asked = cut_lineage(_coded(slots, index.dim, asked=True))
    parts = tasks(asked, asked.count(), ASKED)
    n = sum(index.sizes.values())
    rows = index.nodes.withColumn("query", F.lit(False)).unionByName(asked.withColumn("query", F.lit(True)))
    beams = cut_lineage(_moved(_found(beside(rows, ENTRIES, K, n, index.parts, asked=True)), WIDTHS[0], beam).coalesce(parts))
    graph = index.graph.repartition("node").persist(StorageLevel.DISK_ONLY)     # every round joins it; a lost part is made anew
    number = 0
    while not beams.filter("fresh = 2").isEmpty():
        number += 1
        old = beams.select("node", "id", "sim", F.when(F.col("fresh") == 2, 0).otherwise(F.col("fresh")).cast("tinyint").alias("fresh"))
        met = old.unionByName(_expanded(beams, asked, graph, beam, parts))
        beams = cut_lineage(_moved(met, WIDTHS[min(number, len(WIDTHS) - 1)], beam).coalesce(parts))
    graph.unpersist()
    pairs = beams.filter(F.col("place") <= keep).select(F.col("node").alias("slot"), F.col("id").alias("node"))
    own = index.copies.filter("place = 1").select("node", F.col("v").alias("w"))
    score = F.aggregate(F.zip_with("v", "w", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    asking = pairs.join(slots.select(F.col("node").alias("slot"), "query", "v"), "slot").coalesce(parts)
    return asking.join(own, "node").select("query", "node", score.alias("score")).coalesce(parts)


def nearest(vectors: DataFrame, queries: Column, k: int = TOP, vec_id: str = "vec_id", vector: str = "embedding", beam: int = BEAM, rounds: int = ROUNDS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of the rows that the condition ``queries`` on ``vec_id`` names, among all other rows."""
    parts = tasks(vectors, vectors.count(), POINTS)
    rows = cut_lineage(usable(vectors, vec_id, vector).coalesce(parts))
    index = Index(rows, parts, k, rounds)
    wanted = rows.filter(queries).withColumn("h", F.xxhash64("v"))
    asked = cut_lineage(wanted.join(index.copies.filter("place = 1").select("h", "v", "node"), ["h", "v"]).select("vec_id", "node").coalesce(parts))
    once = asked.select(F.col("node").alias("query")).distinct().join(index.copies.filter("place = 1").select(F.col("node").alias("query"), "v"), "query")
    found = search(index, once.coalesce(parts), beam).join(index.copies.select("node", "vec_id"), "node").coalesce(parts)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = (found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
             .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near")))
    each = (asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).join(lists, "query")
            .select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("rank", "x")))
    return each.select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score").coalesce(parts)
