"""Operators over many rows: joins, searches, groups and the schedule, against brute force."""

import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from candlewick.llm import jaccard, mixing, multi_index, pii, queries, topk, toxicity
from candlewick.llm.graph import components


def union_find(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == union_find({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def word_sets(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_jaccard(rows, n, num, den):
    sets = [word_sets(t, n) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    root = union_find(range(len(rows)), links)
    least = {}
    for i, r in root.items():
        if rows[i][0] is not None:
            least[r] = min(least.get(r, 1 << 60), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), least.get(root[i]) if sets[i] else rows[i][0]) for i in range(len(rows)) if rows[i][0] is not None)


def near_texts(seed=6):
    """Groups of near copies of several sizes and likeness, shared passages, short texts, ties, repeats and nulls."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("klmnopqr")
    passage = [word() for _ in range(30)]
    out = [None, "", " \n", "one", "One", "one two", "ONE two", "a b c", "a b c", "É b c", "é b c"]
    for size, edits in ((40, 1), (25, 2), (12, 3), (3, 1), (2, 0), (2, 2)):
        base = [word() for _ in range(rng.randint(50, 90))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = word()
            out.append(rng.choice([" ", "\t", " \n"]).join(own).replace("a", rng.choice("aA"), 1))
    out += [" ".join([word() for _ in range(rng.randint(5, 60))] + (passage if rng.random() < 0.5 else [])) for _ in range(120)]
    rng.shuffle(out)
    return [(i * 3 % 401, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("n,num,den,group", [(3, 90, 100, 4_000_000), (5, 80, 100, 4_000_000), (3, 90, 100, 200), (2, 60, 100, 500)])
def test_jaccard_components(spark, n, num, den, group):
    rows = near_texts()
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, node string, n int, rep string").repartition(5)
    got = sorted(map(tuple, jaccard.jaccard_components(docs, n, num, den, group=group, block=8).collect()))
    assert got == brute_jaccard(rows, n, num, den)


def test_jaccard_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    rows = near_texts(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_components(docs, group=300, block=8).collect())) == brute_jaccard(rows, 3, 90, 100)


def test_jaccard_holders_of_hot_shingles_meet(spark):
    """A shingle that occurs often is dealt out by node; few or many holders, all of them still meet."""
    rows = near_texts(12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (2, 5):
        assert sorted(map(tuple, jaccard.jaccard_components(docs, hot=hot).collect())) == brute_jaccard(rows, 3, 90, 100)


def test_shared_gives_the_last_holder_of_a_large_shingle(spark):
    """Batches have 1,000 rows: of shingle 1 all but one row are out when its last ends, and nothing or the same node follows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for more in ([], [4999] * 7):
            rows = [(1, x, 0, 0) for x in [*range(5000), *more]] + [(2, 1, 0, 0), (2, 2, 0, 0), (3, 9, 0, 0), (4, 1, 0, 0), (4, 2, 0, 0)]
            got = sorted((r.token, r.node) for r in jaccard._shared(spark.createDataFrame(rows, "token long, node long, meta long, salt int"), 1, 90, 100).collect())
            assert got == [(1, x) for x in range(5000)] + [(2, 1), (2, 2), (4, 1), (4, 2)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("group", [4_000_000, 300])
def test_jaccard_counts_links(spark, group):
    rows = near_texts(14) + [(900 + i, "the very same words again and again") for i in range(3)]
    sets = [word_sets(t, 3) for _, t in rows]
    linked = lambda a, b: a and 100 * len(a & b) >= 90 * len(a | b)
    want = sorted((rows[i][0], sum(bool(linked(sets[i], sets[j])) for j in range(len(rows)) if j != i)) for i in range(len(rows)))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), links=True, group=group, block=8)
    assert sorted((r.doc_id, r.n_links) for r in got.collect()) == want
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_jaccard(rows, 3, 90, 100)


def test_jaccard_empty_and_repeated(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (9, "A b c d"), (8, None), (8, None), (None, "a b c d"), (None, "z")], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(7, 2, 7), (7, 2, 7), (9, 2, 7), (8, 0, 8), (8, 0, 8), (None, 2, 7), (None, 1, None)], key=str)


def test_keep_first(spark):
    rows = near_texts(11)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows] + [(rows[20][0], rows[20][1], "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    want = sorted(i for i, n, c in brute_jaccard(rows, 5, 80, 100) if c == i)
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_shared_by_size_equals_a_plain_grouping(spark):
    """Batches that end anywhere: rows go out if another holder of their shingle is alike in size, or if holders are very many."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    rng = random.Random(2)
    try:
        for many in (4_090, 4_096, 4_097, 4_100, 4_999, 5_000, 5_100):
            sizes = {x: rng.choice([10, 12, 100, 105, 120, 2_000]) for x in range(6_000)}
            rows = [(1, x) for x in range(many)]
            for token in range(2, 900):
                rows += [(token, x) for x in rng.sample(range(6_000), rng.randint(1, 4))]
            got = {(r.token, r.node) for r in jaccard._shared(spark.createDataFrame([(t, x, sizes[x] << 16, 0) for t, x in rows] + [(2, rows[many][1], sizes[rows[many][1]] << 16, 0)], "token long, node long, meta long, salt int"), 1, 90, 100).collect()}
            holders = {}
            for t, x in rows:
                holders.setdefault(t, []).append(x)
            want = {(t, x) for t, own in holders.items() for x in own if any(y != x and 100 * min(sizes[x], sizes[y]) >= 90 * max(sizes[x], sizes[y]) for y in own)}
            assert want <= got and {g for g in got if g[0] > 1} == {w for w in want if w[0] > 1}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def odd_columns(spark, rows):
    """rows of (id, text) with columns whose names and types don't bear to be referred to plainly."""
    return spark.createDataFrame([(i, t, "s", {"k": i or 0}, [(1, "x")], 5, "z") for i, t in rows], "doc_id long, text string, source string, `a.b` map<string,long>, `c ``d` array<struct<e:int,f:string>>, n_chars long, root string")


@pytest.mark.parametrize("stage", [jaccard.keep_first, pii.redact, lambda d: toxicity.keep_clean(d, toxicity.Field({}, fitted=False)), mixing.mix])
def test_stages_bear_odd_columns_repeats_nulls_and_empty_tables(spark, stage):
    rows = [(i, f"text {i} of its own words {i * i} {i * 7}") for i in range(40)] + [(3, "text 3 of its own words 9 21"), (None, "no id at all here"), (None, None), (7, ""), (7, "x " * 200_000)]
    docs = odd_columns(spark, rows)
    got = stage(docs)
    assert got.columns == docs.columns and [k for _, k in got.dtypes] == [k for _, k in docs.dtypes]
    n = len(got.collect())
    assert n == len(rows) - (1 if stage is jaccard.keep_first else 0)
    assert stage(docs.limit(0)).count() == 0


def test_keep_first_judges_rows_of_one_id_by_their_texts(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight", "red green blue white black brown pink grey")
    rows = [(5, a), (5, b), (6, a), (7, b), (2, c), (5, c), (5, c), (None, c), (None, "none else has these very words of mine"), (None, "none else has these very words of mine"), (5, ""), (5, None)]
    got = sorted(map(tuple, jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, a), (5, b), (2, c), (None, rows[8][1]), (5, ""), (5, None)], key=str)


def test_histograms_bound_overlaps():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, n, replace=False), rng.integers(0, 1 << 63, n // 3).astype(np.uint64)])) for n in (40, 190, 193, 200, 700, 800, 1500, 2500)]
    own = jaccard.Histograms([jaccard.histogram(s) for s in sets])
    for i, x in enumerate(sets):
        bound = own.bound(i, np.arange(len(sets)))
        assert all(len(np.intersect1d(x, y)) <= b <= min(len(x), len(y)) for y, b in zip(sets, bound))


def test_prefixes_share_enough():
    """Any two sets that link share the smaller l of shingles within the l-prefixes."""
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, jaccard.SKETCH).astype(np.int32)
    for _ in range(300):
        base = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 60)).astype(np.uint64))
        x = base
        y = np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], rng.integers(0, 1 << 62, rng.integers(0, 3)).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if not len(y) or 100 * both < 90 * (len(x) + len(y) - both):
            continue
        (p, a, l), (q, b, m) = (jaccard.prefix(s, counts, 1.0, 90, 100) for s in (x, y))
        need = min(l, m)
        assert len(set(p[a <= need].tolist()) & set(q[b <= need].tolist())) >= need


def vectors(n=600, dim=24, seed=2):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    for i in range(0, n // 3, 4):
        v[i + 1] = v[i] + rng.normal(size=dim) * 0.03
        v[i + 2] = v[i] + rng.normal(size=dim) * 0.2
    v[100:160] = v[100] + rng.normal(size=(60, dim)) * 0.05
    return v.astype(np.float32)


def vector_frame(spark, v):
    odd = [None, [], [0.0] * v.shape[1], [None] + [1.0] * (v.shape[1] - 1), [float("nan")] + [1.0] * (v.shape[1] - 1), [float("inf")] + [1.0] * (v.shape[1] - 1), [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, [float(c) for c in x], 1, "a", "b") for i, x in enumerate(v)] + [(10_000 + i, x, 1, "a", "b") for i, x in enumerate(odd)] + [(None, [1.0] * v.shape[1], 1, "a", "b")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, row string, cells string").repartition(4)


def test_top_k(spark):
    v = vectors()
    x = np.floor(256 * v.astype(float)).astype(np.int64)
    x = np.vstack([x, np.zeros((1, x.shape[1]), np.int64)])
    ids = [*range(len(v)), 10_002]
    want = []
    for q in (i for i in ids if i % 50 == 0):
        s = x @ x[ids.index(q)]
        best = sorted((-int(s[k]), j) for k, j in enumerate(ids) if j != q)[:5]
        want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    frame = vector_frame(spark, v)
    got = topk.top_k(frame, query_block=5, candidate_block=100).collect()

    assert sorted(tuple(r) for r in got if r.query_id < 10_000) == want
    assert topk.top_k(frame.limit(0)).count() == 0


def test_top_k_with_ties_and_repeats(spark):
    """Equal scores go to the smaller id; rows that repeat an id are one candidate; several blocks to a cell."""
    rng = np.random.default_rng(8)
    v = rng.integers(-1, 2, size=(400, 6)).astype(float)
    ids = [int(i) for i in rng.integers(0, 350, 400)]
    rows = list(zip(ids, v.tolist())) + [(0, [1.0] * 6), (50, [0.0] * 6)]
    x = [(i, np.floor(256 * np.array(e)).astype(np.int64)) for i, e in rows]
    want = []
    for q in sorted({i for i, _ in x if i % 50 == 0}):
        best: dict[int, int] = {}
        for i, e in x:
            if i == q:
                for j, f in x:
                    if j != q:
                        best[j] = max(best.get(j, -(1 << 60)), int(e @ f))
        want += [(q, r + 1, j, s) for r, (j, s) in enumerate(sorted(best.items(), key=lambda p: (-p[1], p[0]))[:5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (16, 16_384):
        assert sorted(map(tuple, topk.top_k(frame, candidate_block=block).collect())) == want


def test_cells_are_ruled_out_before_the_shuffle(spark, monkeypatch):
    """On vectors in clusters queries ask few blocks, and the result is exact."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 8))
    v = centres[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 8)) * 0.01
    v /= np.linalg.norm(v, axis=1)[:, None]
    asked, meet = [], topk._meet

    def counting(asks, *more):
        asked.append(asks.count())
        return meet(asks, *more)

    monkeypatch.setattr(topk, "_meet", counting)
    monkeypatch.setattr(topk, "ANCHOR_ROWS", 60)
    frame = spark.createDataFrame([(i, [float(c) for c in e]) for i, e in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(frame, candidate_block=100).collect()))
    x = np.floor(256 * v).astype(np.int64)
    want = []
    for q in range(0, 6000, 50):
        s = x @ x[q]
        s[q] = -(1 << 60)
        want += [(q, r + 1, int(j), int(s[j])) for r, j in enumerate(np.lexsort((np.arange(6000), -s))[:5])]
    assert got == want
    assert asked[0] == 120 and asked[1] < 0.3 * 120 * 100


def test_top_k_eliminates():
    """On vectors with structure most candidates are never evaluated, and the result is exact."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 300
    x = np.floor(centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16)) * 5)
    norm = float(np.sqrt((x * x).sum(1).max()))
    pad = np.sqrt(np.maximum(0, norm**2 - (x * x).sum(1)))[:, None]
    stats = {}
    q, c, s = topk.search_block(np.arange(20), x[:20], np.arange(8000), x, topk.choose_pivots(np.hstack([x, pad])[:2000]), norm, 5, stats)
    for i in range(20):
        full = x @ x[i]
        full[i] = -np.inf
        order = np.lexsort((np.arange(8000), -full))[:5]
        assert c[q == i].tolist() == order.tolist() and s[q == i].tolist() == full[order].astype(int).tolist()
    assert stats["evaluated"] < 0.5 * stats["pairs"]


def test_near_duplicate_vectors(spark):
    v = vectors(900, 32)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    got = {r.vec_id: r for r in multi_index.near_duplicates(vector_frame(spark, v), cell=64).collect()}
    found = sum(got[i].n_links for i in range(len(v)))
    assert found >= 0.98 * close.sum()
    assert all(got[i].n_links <= close[i].sum() for i in range(len(v)))
    if found == close.sum():
        root = union_find(range(len(v)), [tuple(p) for p in np.argwhere(close)])
        assert all(got[i].component_id == root[i] and got[i].kept == (root[i] == i) for i in range(len(v)))
    for i in range(10_000, 10_006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[10_006].n_links == got[10_007].n_links == 1 and got[10_007].component_id == 10_006
    assert got[None].n_links == 0 and len(got) == len(v) + 9
    assert multi_index.near_duplicates(vector_frame(spark, v).limit(0)).count() == 0


def test_equal_vectors_are_one_row(spark):
    """A hundred thousand rows of one vector, near and far ones, and ids of several rows."""
    n = 100_000
    one = spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[F.lit(float(k + 1)) for k in range(8)]).alias("embedding"))
    near = [float(k + 1) for k in range(7)] + [8.3]
    more = spark.createDataFrame([(n, near), (n + 1, [-c for c in near]), (n + 2, [-2 * c for c in near]), (n + 3, [1.0] + [0.0] * 7), (n + 4, [0.0, 1.0] + [0.0] * 6), (n + 4, [0.0, 0.0, 1.0] + [0.0] * 5), (n + 5, [0.0, 2.0] + [0.0] * 6), (n + 6, [0.0, 0.0, 3.0] + [0.0] * 5)], "vec_id long, embedding array<double>")
    got = multi_index.near_duplicates(one.unionAll(more)).groupBy("n_links", "component_id").agg(F.count("*").alias("rows"), F.sum(F.col("kept").cast("int")).alias("kept"), F.min("vec_id").alias("least")).collect()
    assert sorted(map(tuple, got)) == sorted([(n, 0, n + 1, 1, 0), (1, n + 1, 2, 1, n + 1), (0, n + 3, 1, 1, n + 3), (2, n + 4, 2, 2, n + 4), (1, n + 4, 2, 0, n + 5)])


def test_codebooks_get_coarser_until_the_recall_is_reached(monkeypatch):
    rng = np.random.default_rng(5)
    sample = multi_index._unit(rng.normal(size=(800, 16)))
    monkeypatch.setattr(multi_index, "MOST_CELLS", 2)
    one, two, n = multi_index.fit_index(sample, 64, 0.6, 0.99)
    assert len(one) < 64 and multi_index.settle_visits(sample, one, two, 0.6, 0.99) == n <= 2
    assert multi_index.settle_visits(sample, *multi_index.fit_index(sample, 64, 0.6, 0.99)[:2], 0.6, 0.99) is not None
    assert multi_index.settle_visits(sample, multi_index.fit_codebook(sample[:, :8], 64), multi_index.fit_codebook(sample[:, 8:], 64), 0.6, 0.99) is None


def test_cells_are_visited_nearest_first():
    rng = np.random.default_rng(4)
    one, two, v = rng.normal(size=(9, 4)), rng.normal(size=(7, 4)), rng.normal(size=(50, 8))
    d = ((v[:, None, :4] - one[None]) ** 2).sum(2)[:, :, None] + ((v[:, None, 4:] - two[None]) ** 2).sum(2)[:, None, :]
    assert (multi_index.visits(v, one, two, 20) == np.argsort(d.reshape(50, -1), axis=1, kind="stable")[:, :20]).all()


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {f"s{i}": 1.0 + i for i in range(30)}, {"x": 999.0, "y": 1.0}])
def test_schedule_deviates_by_less_than_a_block(weights):
    parts = mixing.shares(weights)
    table = mixing.edf(parts)
    period = sum(parts.values())
    had = dict.fromkeys(parts, 0)
    for t, (s, i, slot, release, due) in enumerate(table):
        assert slot == t and release <= slot < due
        had[s] += 1
        assert had[s] == i
        assert all(abs(had[x] * period - parts[x] * (t + 1)) < period for x in parts)
    assert had == parts


@pytest.mark.parametrize("counts", [[100_000, 1, 1, 1], [5_000_000, 2_000_000, 3_000_000] + [20] * 6, [1] * 1_000 + [1_000] * 500])
def test_each_source_has_a_share(counts):
    weights = mixing.default_weights({f"s{i}": n for i, n in enumerate(counts)})
    parts = mixing.shares(weights)
    period = sum(parts.values())
    assert min(parts.values()) > 0
    assert all(abs(parts[s] - w * period / sum(weights.values())) < 1 for s, w in weights.items())


def test_mixing_a_hot_source_with_tiny_ones(spark):
    rows = [(i, "a") for i in range(3000)] + [(5000 + i, f"t{i}") for i in range(3)]
    got = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string"), {"a": 1e4, "t0": 1.0, "t1": 1.0, "t2": 1.0}, block=100).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    slots = {r.slot for r in got}
    assert len(slots) == 33 and all(r.release <= r.slot < r.deadline for r in got)


@pytest.mark.parametrize("weights", [mixing.default_weights({f"s{i}": n for i, n in enumerate((5_000_000, 2_000_000, 1_700_000, 900_000, 400_000))}), {"a": 1.0, "b": 0.7, "c": 0.0003}])
def test_long_schedule_keeps_to_the_given_weights(weights):
    own = mixing.whole(weights)
    total, had = sum(own.values()), dict.fromkeys(own, 0)
    for t, (s, i, slot, release, due) in enumerate(mixing.plan(dict.fromkeys(own, 100_000), weights)):
        assert slot == t and i == had[s] and release <= slot < due
        had[s] += 1
        if t % 101 == 0:
            assert all(abs(had[x] * total - w * (t + 1)) < total for x, w in own.items())
        if had[s] == 100_000:
            break


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_mixing_over_several_chunks(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "PLAN_BLOCKS", most)
    rows = [(i, "a" if i % 3 else "b") for i in range(4000)]
    counts = {"a": sum(1 for r in rows if r[1] == "a"), "b": sum(1 for r in rows if r[1] == "b")}
    got = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string"), block=1).collect()
    assert sorted((r.source, r.block, r.slot, r.release, r.deadline) for r in got) == sorted(mixing.plan(counts, mixing.default_weights(counts)))
    assert sorted(r.doc_id for r in got) == list(range(4000))


@pytest.mark.parametrize("weights", [{"a": 0.12345, "b": 0.0004, "c": 0.87615}, {f"s{i}": random.Random(i).random() + 1e-4 for i in range(40)}])
def test_deviation_from_given_weights_in_every_slot(weights):
    """Less than one block, in each of 100,000 slots, from the weights as they are given."""
    own = mixing.whole(weights)
    total, had = sum(own.values()), dict.fromkeys(own, 0)
    watched = sorted(own, key=own.get)[:2] + sorted(own, key=own.get)[-2:]
    for t, (s, i, slot, release, due) in enumerate(mixing.plan(dict.fromkeys(own, 200_000), weights)):
        had[s] += 1
        assert slot == t and release <= t < due and abs(had[s] * total - own[s] * (t + 1)) < total
        assert all(abs(had[x] * total - own[x] * (t + 1)) < total for x in watched)
        if t == 100_000:
            break


def test_schedule_by_a_plain_version(spark):
    """The registered query's rows: ranks by hash within each source, blocks of 64, slots of the plan."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", F.coalesce("source", F.lit("")), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(17))).collect()]
    of: dict[str, list] = {}
    for i, s, h in rows:
        of.setdefault(s, []).append((h % (1 << 64) >> 32, h, i))
    counts = {s: len(x) for s, x in of.items()}
    slots = {(s, b): place for s, b, *place in mixing.plan({s: -(-n // 64) for s, n in counts.items()}, mixing.default_weights(counts))}
    want = sorted((i, s, k // 64, *slots[s, k // 64]) for s, x in of.items() for k, (_, _, i) in enumerate(sorted(x)))
    got = queries.QUERIES["op3_mixing"](spark, folder).collect()
    assert sorted((r.doc_id, r.source or "", r.block, r.slot, r.release, r.deadline) for r in got) == want


@pytest.mark.parametrize("twice", [False, True])
def test_mix_moves_whole_rows_once(spark, tmp_path, twice):
    """Files in the order of the schedule's slots, by one shuffle of whole rows; by two where rows of one id stand at a border."""
    rng = random.Random(9)
    rows = [(i, rng.choice("aaaaaabbc"), f"text {i}") for i in range(9000)] + ([(5, "a", "text 5")] * 3000 if twice else [])
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = mixing.mix(docs, block=8)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert ("shufflepartitionidpassthrough" in plan) == (not twice)
    path = f"file://{tmp_path}/mixed"
    mixed.write.parquet(path)
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select("doc_id", "source", "text").collect())) == sorted(rows)
    order = back.selectExpr("doc_id", "source", "_metadata.file_name f", "_metadata.row_index i").orderBy("f", "i").collect()
    slots = {}
    for r in mixing.schedule(docs, block=8).collect():
        slots.setdefault((r.doc_id, r.source), []).append(r.slot)
    for own in slots.values():
        own.sort(reverse=True)
    seen = [slots[r.doc_id, r.source].pop() for r in order]
    assert seen == sorted(seen)


def test_many_sources(spark):
    """Thousands of sources are counted and planned off the driver."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 3000).cast("string").alias("source"))
    got = mixing.schedule(docs, block=1)
    assert got.count() == 6000 and got.select("slot").distinct().count() == 6000


def test_mixing_keeps_all_rows_in_schedule_order(spark, tmp_path):
    rng = random.Random(3)
    sizes = {"a": 4000, "b": 500, "": 60, "d": 1}
    rows = [(i, f"t{i}", s or None, i) for i, s in enumerate(x for s, n in sizes.items() for x in [s] * n)]
    rows += [(None, "null id", "a", 1), (5, "t5", "a", 5)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot long").repartition(6)
    weights = {"a": 0.4, "b": 0.3, "": 0.2, "d": 0.1}
    got = mixing.schedule(docs.drop("slot"), weights, block=10).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        assert r.release <= r.slot < r.deadline
        slots.setdefault(r.slot, set()).add((r.source, r.block))
    assert all(len(x) == 1 for x in slots.values()) and sorted(slots) == list(range(len(slots)))
    had = dict.fromkeys(sizes, 0)
    for t in range(40):
        (s, _), = slots[t]
        had[s or ""] += 1
        if had["d"] < 1 and had[""] < 6:
            assert all(abs(had[x] - weights[x] * (t + 1)) < 1 for x in sizes)
    mixed = mixing.mix(docs, weights, block=10)
    assert mixed.columns == docs.columns
    path = f"file://{tmp_path}/mixed"
    mixed.write.parquet(path)
    assert sorted(map(str, spark.read.parquet(path).collect())) == sorted(map(str, docs.collect()))
    at = {(r.doc_id, r.source): r.slot for r in got}
    order = spark.read.parquet(path).selectExpr("doc_id", "source", "_metadata.file_name f", "_metadata.row_index i").orderBy("f", "i").collect()
    seen = [at[r.doc_id, r.source] for r in order]
    assert seen == sorted(seen)
    assert mixing.schedule(docs.limit(0)).count() == 0
