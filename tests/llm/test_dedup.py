"""Dedup operators against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lapsekit.llm import op1_minhash as M
from lapsekit.llm.batched import pack_counts, pack_sorted, unpack_counts, unpack_sorted
from lapsekit.llm.op3_substring import mark_repeats
from lapsekit.llm.op8_suffix import common, drop_repeats, merge_runs
from lapsekit.llm.textwords import Words, inside, ngram_keys

SMALL = {"batch_bytes": 20_000, "part_bytes": 30_000}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def removed_words(rows, window=35):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[j:j + window]) for _, w in split for j in range(len(w) - window + 1))
    out = Counter()
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j:j + window])] > 1:
                gone[j:j + window] = [True] * window
        out[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    return out


def removed_bytes(rows, length=50):
    last = 1 << 62
    raw = [(i, (t or "").encode()) for i, t in rows]
    first = defaultdict(lambda: last)
    for i, b in raw:
        for j in range(len(b) - length + 1):
            first[b[j:j + length]] = min(first[b[j:j + length]], last if i is None else i)
    out = Counter()
    for i, b in raw:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if first[b[j:j + length]] < (last if i is None else i):
                gone[j:j + length] = b"\1" * length
        spans = sum(1 for x in range(len(b)) if gone[x] and (x == 0 or not gone[x - 1]))
        out[i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)] += 1
    return out


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def plain(rows):
    return [(r[0], r[1]) for r in rows]


def test_words_and_ngrams(corpus):
    import pyarrow as pa
    texts = [r[1] for r in corpus]
    w = Words(pa.array(texts))
    flat = [WORD.findall(t or "") for t in texts]
    assert w.counts.tolist() == [len(x) for x in flat]
    keys, by = w.keys(), {}
    for x, k in zip([y for f in flat for y in f], keys.tolist()):
        assert by.setdefault(x, k) == k
    assert len(set(by.values())) == len(by)
    doc = np.repeat(np.arange(len(flat)), w.counts)
    for n in (1, 2, 5, 18):
        assert (inside(w.first, n, len(keys)) == (doc[: len(doc) - n + 1] == doc[n - 1:])).all()
        grams, seen = ngram_keys(keys[:500], n), {}
        for i, k in enumerate(grams.tolist()):
            assert seen.setdefault(tuple(keys[i:i + n].tolist()), k) == k
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("top", [300, 1 << 16, 1 << 40, (1 << 64) - 1])
def test_packed_keys_round_trip(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 7, 3000):
        k = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        assert (unpack_sorted(pack_sorted(k)) == k).all()


def test_packed_counts_round_trip():
    for x in ([], [0], [254, 255, 256, 1 << 40, 3], [255] * 5):
        assert unpack_counts(pack_counts(np.array(x, np.int64))).tolist() == x


def test_substring_dedup(documents, odd, nothing, corpus):
    for df in (documents, odd):
        want = removed_words([tuple(r) for r in df.select("doc_id", "text").collect()])
        assert Counter(tuple(r) for r in mark_repeats(df, **SMALL).collect()) == want
        assert sum(n * k[2] for k, n in want.items()) > 200
    assert mark_repeats(nothing).collect() == []


def test_suffix_dedup(documents, odd, nothing):
    for df in (documents, odd):
        want = removed_bytes([tuple(r) for r in df.select("doc_id", "text").collect()])
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in drop_repeats(df, **SMALL).collect())
        assert got == want
    assert drop_repeats(nothing).collect() == []


def test_loser_tree_merges_and_knows_prefixes():
    import random
    rng = random.Random(3)
    for _ in range(100):
        runs, every = [], []
        for _ in range(rng.randint(1, 7)):
            s = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 8)))
            runs.append((s, [common(a, b) for a, b in zip([b"", *s], s)]))
            every += s
        run, place, lcp = merge_runs(runs)
        out = [runs[r][0][i] for r, i in zip(run, place)]
        assert out == sorted(every)
        assert lcp == [common(a, b) for a, b in zip([b"", *out], out)]


@pytest.mark.parametrize("block", [4, 1024])
def test_near_duplicates(documents, corpus, block):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(documents, block=block).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in groups(plain(corpus)).items()}


def test_near_duplicates_odd_rows(odd, nothing):
    rows = M.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    want = groups([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert M.near_duplicates(nothing).collect() == []


def test_near_copies_form_one_hot_family(spark):
    """A chain of near copies over several blocks: links between blocks must survive."""
    words = [f"w{i}" for i in range(200)]
    rows, now = [], words[:]
    for i in range(60):
        rows.append((i, " ".join(now)))
        now[(i * 7) % 200] = f"n{i}"
    got = {r.doc_id: r.component_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=8).collect()}
    assert got == {i: c for i, (_, c) in groups(rows).items()}


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85, 1.0):
        both = rng.integers(0, 2**63, int(4000 * share), dtype=np.uint64)
        own = [rng.integers(0, 2**63, (4000 - len(both)) // 2, dtype=np.uint64) for _ in range(2)]
        a, b = (M.registers_of(np.unique(np.concatenate([both, x]))) for x in own)
        j, _ = M.estimate(a[None], b[None])
        assert abs(j[0, 0] - share) < 0.1


def test_keep_one_keeps_one_of_each_group(odd):
    kept = M.keep_one(odd)
    assert kept.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == len(set(rows))
    want = {i for i, (_, c) in groups([(r.doc_id, r.text) for r in odd.collect()]).items() if i == c}
    assert {i for i, _ in rows if i is not None} == want


def test_threshold_of_the_pipeline_stage(spark):
    """Pairs between 0.80 and 0.85 are linked by the stage and not by the operator's default."""
    assert (M.band_rows(85), M.band_rows(80)) == (8, 6)
    rows = []
    for i in range(60):
        words = [f"d{i}x{j}" for j in range(200 + i)]
        rows.append((2 * i, " ".join(words)))
        for j in range(10, 10 + 6 * (3 + i % 3), 6):      # each change takes five shingles
            words[j] = "new"
        rows.append((2 * i + 1, " ".join(words)))
    sets = [shingles(t) for _, t in rows]
    near = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert sum(0.8 <= j < 0.85 for j in near) >= 15 and min(near) < 0.8 and max(near) >= 0.85
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for kept, least in ((M.keep_one(df), 0.85), (corpus_pipeline.near_dedup(spark, df, ""), 0.8)):
        assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows if i % 2 == 0 or near[i // 2] < least}


def test_keep_one_judges_texts_that_share_an_id(spark):
    """Only the copied text of an id goes; another text of the same id stays, also if a near copy ties the first one."""
    text = lambda x: " ".join(f"{x}{j}" for j in range(120))
    a, b, c, d = map(text, "abcd")
    rows = [(3, a), (5, a), (5, b), (7, c), (8, c + " end"), (8, d), (9, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in M.keep_one(df).collect()) == sorted([(3, a), (5, b), (7, c), (8, d)])
    got = Counter((r.doc_id, r.component_id, r.kept) for r in M.near_duplicates(df).collect())
    assert got == Counter([(3, 3, True), (5, 3, False), (5, 5, True), (7, 7, True), (8, 7, False), (8, 8, True), (9, 8, False)])


def test_suffix_dedup_of_long_windows(spark, prose):
    from lapsekit.llm.op8_suffix import drop_repeats
    shared = prose(120, 61)[:400]
    texts = ["start " + shared + " end", "other " + shared + " tail", shared[:250] + " short", "alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in drop_repeats(df, length=300, k=280).collect()}
    assert got == {0: 0, 1: len(f" {shared} ".encode()), 2: 0, 3: 0}
