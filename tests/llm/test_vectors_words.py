"""Nearest neighbours, spelling variants and hard negatives against brute force."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int, note string, node string, rank string, sig string, block int"


def rows_of(ids, x, labels):
    return [(int(i), None if v is None else [None if c is None else float(c) for c in v], None if k is None else int(k), "n", "n", "r", "s", 1) for i, v, k in zip(ids, x, labels)]


@pytest.fixture(scope="module")
def vectors():
    """Clusters, copies (a third of all rows), near copies, ties, norms over several bands and rows that take no part."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((5, 16))
    x = centres[rng.integers(0, 5, 700)] + rng.standard_normal((700, 16))
    x[200:420] = x[3]
    x[420:460] = x[5] + rng.standard_normal((40, 16)) * 1e-4
    x[460:500] *= 20
    x[500:520] *= 1e-3
    x[520] *= 1e4
    rows = rows_of(range(700), x.astype(np.float32), rng.integers(0, 3, 700))
    odd = [(700, None, 1), (720, [0.0] * 16, 1), (740, [math.nan] + [1.0] * 15, 1), (760, [math.inf] + [1.0] * 15, 2), (780, [None] + [1.0] * 15, 0),
           (800, [1.0, 2.0], 1), (820, [], 1), (840, x[3].tolist(), None), (None, x[3].tolist(), 1)]
    return rows + [(i, v, k, "n", "n", "r", "s", 1) for i, v, k in odd] + rows[:3]


def brute_nearest(rows, every, k):
    seen = {}
    for r in rows:
        v = r[1]
        if r[0] is None or v is None or not len(v) or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            continue
        v = np.pad(np.float32(v).astype(float), (0, 16 - len(v)))
        seen[r[0]] = v
    ids = np.array(sorted(seen))
    x = np.stack([seen[i] for i in ids])
    out = {}
    for q in ids[ids % every == 0].tolist():
        s = x @ seen[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_nearest_neighbours_against_brute_force(spark, vectors):
    from lapsekit.llm.op11_neighbours import nearest
    got = collections.defaultdict(list)
    for r in nearest(spark.createDataFrame(vectors, VECTORS).repartition(4), F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(vectors, 20, 20)
    assert set(got) == set(want)
    hits = total = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and q not in [i for _, i, _ in mine] and len({i for _, i, _ in mine}) == 20
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(mine, mine[1:]))
        least = near[-1][1]
        hits += sum(s >= least - 1e-9 * abs(least) for _, _, s in mine)
        total += 20
    assert hits / total >= 0.97


def test_recall_on_hard_vectors(spark):
    """Random directions in 48 dimensions: the index never sees all pairs, the recall stays over 0.9."""
    from lapsekit.llm.op11_neighbours import nearest
    x = np.random.default_rng(9).standard_normal((6000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = rows_of(range(6000), x.astype(np.float32), [0] * 6000)
    found = nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0).select("query_id", "vec_id").collect()
    x = x.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 6000, 100):
        s = x @ x[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:20].tolist()) & {r["vec_id"] for r in found if r["query_id"] == q})
    assert hits / 1200 >= 0.9


def test_lists_and_beams_are_handled_by_spark(spark):
    """Between the Python steps of a round, lists are read and beams are kept without Python tasks."""
    from lapsekit.llm import op11_neighbours as N
    lists = spark.createDataFrame([(1, [5, 3], [0.75, 0.5], [1, 0]), (2, [1], [0.25], [1])], N.LISTS)
    edges, worst, stale = N._edges(lists), lists.select("node", N._worst("sims", 2).alias("w")), N._stale(lists)
    assert {tuple(r) for r in edges.collect()} == {(1, 5, 1), (1, 3, 0), (2, 1, 1)}
    assert {tuple(r) for r in worst.collect()} == {(1, 0.5), (2, -9.0)}
    assert {(r["node"], tuple(r["fresh"])) for r in stale.collect()} == {(1, (0, 0)), (2, (0,))}
    found = [(1, 7, 0.5, 1), (1, 7, 0.5, 0), (1, 4, 0.5, 1), (1, 9, 0.75, 1), (1, 8, 0.25, 1), (2, 7, 0.5, 1), (2, 6, 0.25, 1), (2, 5, 0.125, 1)]
    beams = N._moved(spark.createDataFrame(found, "node long, id long, sim float, fresh tinyint").repartition(3), 2, 3)
    assert sorted((r["node"], r["place"], r["id"], r["sim"], r["least"], r["fresh"]) for r in beams.collect()) == [
        (1, 1, 9, 0.75, 0.5, 2), (1, 2, 4, 0.5, 0.5, 2), (1, 3, 7, 0.5, 0.5, 0),
        (2, 1, 7, 0.5, 0.125, 2), (2, 2, 6, 0.25, 0.125, 2), (2, 3, 5, 0.125, 0.125, 1)]
    for df in (edges, worst, stale, beams):
        plan = df._jdf.queryExecution().toString()
        assert "MapInArrow" not in plan and "ArrowEvalPython" not in plan


def test_tasks_follow_the_points_and_queries(spark):
    """With many shuffle partitions that nothing merges, the stages of a small table stay few tasks; nothing is lost."""
    from lapsekit.llm import op11_neighbours as N
    x = np.random.default_rng(6).standard_normal((300, 8)).astype(np.float32)
    df = spark.createDataFrame(rows_of(range(300), x, [0] * 300), VECTORS)
    parts = N.tasks(df, 300, N.POINTS)
    assert parts == 2 * spark.sparkContext.defaultParallelism < 211
    assert N.tasks(df, 10 ** 9, N.POINTS) == -(-10 ** 9 // N.POINTS)                  # a large table takes all partitions
    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        out = N.nearest(df, F.col("vec_id") % 20 == 0)
        assert out.rdd.getNumPartitions() <= parts
        got = collections.defaultdict(list)
        for r in out.collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"]))
        lists = spark.createDataFrame([(i, [(i + 1) % 50], [0.5], [1]) for i in range(50)], N.LISTS)
        for df in (N.merged(lists, N.K, 4), N.thinned(N._edges(lists), 1, 0, 4)):
            assert df.rdd.getNumPartitions() <= 4
            assert df.count() == 50
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    want = brute_nearest([(i, v.tolist()) for i, v in enumerate(np.pad(x, ((0, 0), (0, 8))))], 20, 20)
    assert {q: sorted(near) for q, near in got.items()} == {q: [(n + 1, i) for n, (i, _) in enumerate(near)] for q, near in want.items()}


def test_few_or_no_vectors(spark):
    from lapsekit.llm.op11_neighbours import nearest
    few = rows_of([0, 1, 2], [[1, 0], [0.5, 0.5], [1, 0]], [0, 0, 0])
    got = [tuple(r) for r in nearest(spark.createDataFrame(few, VECTORS), F.col("vec_id") % 2 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 1, 0.5), (2, 1, 0, 1.0), (2, 2, 1, 0.5)]
    assert nearest(spark.createDataFrame([], VECTORS), F.col("vec_id") % 2 == 0).count() == 0
    assert nearest(spark.createDataFrame(few[:1], VECTORS), F.col("vec_id") % 2 == 0).count() == 0


def brute_negatives(rows, every):
    seen = {}
    for r in rows:
        if r[0] is None or r[1] is None or r[2] is None or any(c is None or not math.isfinite(c) for c in r[1]):
            continue
        seen[r[0]] = ([math.floor(256 * float(np.float32(c))) for c in r[1]], r[2])
    score = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = set()
    for a in [i for i in seen if i % every == 0]:
        all_ = [(score(seen[a][0], v), i, k) for i, (v, k) in seen.items() if i != a]
        for s, p, _ in sorted([x for x in all_ if x[2] == seen[a][1]], key=lambda x: (-x[0], x[1]))[:5]:
            left = sorted([x for x in all_ if x[2] != seen[a][1] and 30 * s <= 100 * x[0] <= 90 * s], key=lambda x: (-x[0], x[1]))[:10]
            out |= {(a, p, n + 1, i, s, x) for n, (x, i, _) in enumerate(left)}
    return out


def test_hard_negatives_against_brute_force(spark, vectors, monkeypatch):
    from lapsekit.llm import op13_negatives as op
    monkeypatch.setattr(op, "SLICE", 200)
    monkeypatch.setattr(op, "BLOCK", 10)
    df = spark.createDataFrame(vectors, VECTORS).repartition(3)
    got = {tuple(r) for r in op.hard_negatives(df, F.col("vec_id") % 20 == 0).collect()}
    assert got == brute_negatives(vectors, 20) and len(got) > 500


def test_segment_bounds_hold_and_close_rows():
    from lapsekit.llm import op13_negatives as op
    import pyarrow as pa
    rng = np.random.default_rng(3)
    smooth = np.repeat(rng.integers(-40, 40, (3000, 8)), 8, axis=1) + rng.integers(-6, 7, (3000, 64))
    mean, dev = op.summaries(smooth)
    binary = lambda a, kind: pa.array([r.astype(kind).tobytes() for r in a], pa.binary())
    table = pa.table({"vec_id": np.arange(3000), "label": np.zeros(3000, np.int64), "comps": binary(smooth, np.int32), "means": binary(mean, float), "devs": binary(dev, float)})
    rows = op._Slice(table, 64)
    scores = smooth @ smooth[:20].T
    scored: list = []
    for i in range(20):
        widths = []
        for level in range(len(op.LEVELS)):
            mid, reach = op._bounds(rows, i, rows, np.arange(3000), level)
            assert (np.abs(scores[:, i] - mid) <= reach).all()
            widths.append(reach.mean())
        assert widths == sorted(widths, reverse=True)
        (place, score), = op.best_in_windows(rows, i, rows, np.arange(3000), [(-math.inf, math.inf)], 5, scored)
        assert score.tolist() == np.sort(scores[:, i])[::-1][:5].tolist()
    assert np.mean(scored) < 300                       # of 3,000 rows, few are scored exactly


def test_no_anchors_no_rows(spark):
    from lapsekit.llm.op13_negatives import hard_negatives
    assert hard_negatives(spark.createDataFrame([], VECTORS), F.col("vec_id") % 2 == 0).count() == 0
    one = rows_of([0], [[1.0, 2.0]], [1])
    assert hard_negatives(spark.createDataFrame(one, VECTORS), F.col("vec_id") % 2 == 0).count() == 0


def brute_variants(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = collections.Counter()
    for r in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    cuts = collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            cuts[i, w[:i] + w[i + 1:]].add(w)
    near = collections.defaultdict(set)
    for (_, part), same in cuts.items():
        for w in same:
            near[w] |= same - {w}
            if part in n:
                near[w].add(part)
                near[part].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n}


@pytest.fixture(scope="module")
def wordy(corpus):
    """Families of near words, long chains of forms, words that differ in two places, transposed letters, letters beyond ASCII."""
    words, grown = [], "abcdefgh"
    for i in range(6):
        words += [grown] * (3 * 2 ** i)
        grown = grown[:-1] + "qrstuvwx"[i] if i % 2 else grown + "z"
    words += ["groß" + c for c in "abcdeéüß"] * 4 + ["gross" + c for c in "abc"] * 9 + ["étude", "etude", "étudé", "ÉTUDE"] * 3 + ["abdce", "abcde", "aabbcc", "abbacc"] * 5
    words += [a + b + "lmnop" for a in "abcdefghijk" for b in "qrstuv"] * 3 + ["y" * 300] * 4 + ["y" * 301] * 9
    return [*corpus, (None, " ".join(words), None, None, 0), (-5, "x".join(words), None, None, 0), *[(i, " ".join(words[::3]) + " Abcdefgh", "en", "s", 0) for i in range(900, 930)]]


@pytest.mark.parametrize("crowd", [64, 1])
def test_spelling_variants_against_brute_force(spark, wordy, crowd):
    from lapsekit.llm.op12_spelling import spelling_variants
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(wordy, columns)
    docs = docs.select("*", *(F.lit("x").alias(c) for c in ("word", "n", "sig", "role", "form", "root", "run", "h", "id"))).repartition(3)
    got = [tuple(r) for r in spelling_variants(docs, crowd=crowd).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants(wordy)
    assert sum(r[3] is not None for r in got) > 50


def test_no_words(spark, nothing):
    from lapsekit.llm.op12_spelling import spelling_variants
    assert spelling_variants(nothing).count() == 0
