import importlib
import random
from collections import defaultdict

import numpy as np
from aerolytics.llm import registry
from aerolytics.llm.components import components
from aerolytics.llm.ngram_join import CLASSES, Join, _classes, _signed, adapt_join, candidates, join_documents, one_of_each, search, signatures, sketch
from pyspark.sql import functions as F

import fixtures as fx

SF = "/root/testdata/sf0.01"


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute(docs, k, num, den):
    """{id: (set size, least id reachable)} by all pairs that share a shingle."""
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    post = defaultdict(list)
    for d, s in sorted(sets.items()):
        met = defaultdict(int)
        for t in s:
            for o in post[t]:
                met[o] += 1
            post[t].append(d)
        for o, n in met.items():
            if den * n >= num * (len(s) + len(sets[o]) - n):
                a, b = sorted((find(d), find(o)))
                root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def family(seed, n, words=120, edits=6):
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w[: r.randrange(words - 8, words + 1)]))
    return out


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registry.op8_ngram_join(spark, SF).collect()}
    assert got == brute(docs, 3, 90, 100)


def test_families_of_near_copies_in_blocks(spark):
    docs = list(enumerate(family(1, 60) + family(2, 40, 30, 2) + family(1, 5) + ["a b c", "A b\tc", "a b", "a b", "z"]))
    for join in (Join(), Join(budget=900), Join(k=5, num=80), Join(k=1, num=60)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in join_documents(fx.texts(spark, *docs), join).collect()}
        assert got == brute(docs, join.k, join.num, join.den)


def test_prefix_join_loses_no_link():
    for seed in range(6):
        docs = family(seed, 50, 40 + 20 * seed, 5)
        sets = [np.array(sorted(hash(x) & (2**63 - 1) for x in shingles(t, 3)), np.uint64) for t in docs]
        want = brute(list(enumerate(docs)), 3, 90, 100)
        root = list(range(len(docs)))
        for i, j in adapt_join(sets, Join()):
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
        assert root == [want[i][1] for i in range(len(docs))]


def test_signatures_meet(spark):
    """Sets within the threshold share a signature."""
    r = np.random.default_rng(0)
    for join in (Join(), Join(num=80)):
        for n in (10, 11, 25, 64, 65, 300, 2000):
            for _ in range(40):
                a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
                both = -(-2 * n * join.num // (join.num + join.den))
                drop = int((len(a) - min(both, len(a))))
                b = np.unique(np.concatenate([a[r.permutation(len(a))[drop:]], r.integers(0, 2**63, drop).astype(np.uint64)]))
                inter = len(np.intersect1d(a, b))
                if join.linked(len(a), len(b), inter):
                    x, y = signatures(a, join), signatures(b, join)
                    met = np.intersect1d(x >> np.uint64(1), y >> np.uint64(1))
                    smaller = np.concatenate([s[s & np.uint64(1) == 0] >> np.uint64(1) for s in (x, y)])
                    assert np.isin(met, smaller).any()


def test_awkward_rows(spark):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in join_documents(fx.awkward(spark, extra=True)).collect()}
    assert got[4, 0] == 4 and got[5, 0] == 5 and got[6, 0] == 6
    assert {got[k] for k in got if k[0] in (1, 2, 11)} == {1} and [v for k, v in got.items() if k[0] == 3] == [1]
    assert [v for k, v in got.items() if k[0] is None] == [None]
    assert join_documents(fx.empty(spark)).count() == 0
    kept = one_of_each(fx.awkward(spark, extra=True))
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.collect())
    assert ids == sorted((x is None, x) for x in (-5, 1, 4, 5, 6, 7, 9, 10, 12, None)) and "component_id" in kept.columns
    assert one_of_each(fx.empty(spark)).count() == 0


def test_components(spark):
    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 70)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(500, i) for i in range(300, 360)] + [(7, 7)]
    got = {x.id: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}
    for a, b in pairs:
        if a != b:
            root.setdefault(a, a), root.setdefault(b, b)
            lo, hi = sorted((root[a], root[b]))
            root = {k: lo if v == hi else v for k, v in root.items()}
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_take_time_in_proportion():
    """Twenty thousand near-copies in a block: pairs within the family are not compared."""
    import time

    import pyarrow as pa
    from aerolytics.llm.words import shingle_sets

    sets = shingle_sets(pa.array(family(1, 20_000, 120, 1)), 3)
    began = time.time()
    assert len(adapt_join(sets, Join())) == 19_999 and time.time() - began < 60


def test_digests_leave_out_no_partner():
    from aerolytics.llm.ngram_join import _digests

    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 2**63, 200).astype(np.uint64))
    sets = []
    for n in range(40):
        s = np.unique(np.concatenate([base[r.permutation(len(base))[n:]], r.integers(0, 2**63, n).astype(np.uint64)]))
        sets.append(s)
    for differ in (0, 5, 20, 500):
        d = _digests(sets, np.array([len(s) for s in sets]), differ)
        for i in range(40):
            for j in range(40):
                assert (d[:, i] != d[:, j]).sum() <= len(np.setxor1d(sets[i], sets[j]))


def test_sketches_of_linked_sets_differ_little():
    r, join = np.random.default_rng(3), Join(k=5, num=80, den=100)
    most = 0
    for n in (3, 20, 90, 400, 3000):
        for _ in range(60):
            both = r.integers(0, 2**63, n, np.int64).astype(np.uint64)
            own = lambda k: np.unique(np.append(both, r.integers(0, 2**63, k, np.int64).astype(np.uint64)))  # noqa: E731, B023
            a, b = own(n // 8), own(n // 8)
            assert join.linked(len(a), len(b), n)
            apart = int((sketch(a).view(np.uint8) != sketch(b).view(np.uint8)).sum())
            assert apart <= min(join.most_apart(), 20 * (len(a) + len(b)) // 180)
            most = max(most, apart)
            c = r.integers(0, 2**63, n, np.int64).astype(np.uint64)
            assert n < 20 or (sketch(a).view(np.uint8) != sketch(c).view(np.uint8)).sum() > min(join.most_apart(), 20 * (len(a) + n) // 180)
    assert most > 5


def test_shared_passages_do_not_chain_into_one_cluster(spark):
    # each document shares words with the next alone, far below the threshold; they were one cluster of nearly all
    join = Join(k=5, num=80, den=100)
    texts = [" ".join(f"w{i + j}" for j in range(6)) for i in range(400)] + family(5, 40, words=60, edits=2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = docs.withColumn("x", F.xxhash64("text")).select("doc_id", "text", "x").mapInArrow(_classes(join), CLASSES)
    signed = docs.mapInArrow(_signed(join, 4, np.empty(0, np.uint64)), "part int, sigs binary, names binary").repartition(4, "part")
    edges = [(r.a, r.b) for r in candidates(signed, known.filter("kind = 0 and n > 0"), join, 4).collect()]
    assert edges and all(min(e) >= 400 for e in edges)
    got = {r.doc_id: r.component_id for r in join_documents(docs, join).collect()}
    assert got == {d: c for d, (_, c) in brute(list(enumerate(texts)), 5, 80, 100).items()}


def test_pairs_and_stars_keep_every_link(spark):
    # families below and above PAIRED under one signature, and copies in other partitions
    texts = [t for seed, n in ((1, 3), (2, 12), (3, 16), (4, 17), (5, 60)) for t in family(seed, n, words=80, edits=4)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join_documents(docs, Join(k=3, num=80, den=100)).collect()}
    assert got == brute(list(enumerate(texts)), 3, 80, 100)


def test_search_among_many():
    r, join = np.random.default_rng(4), Join(k=5, num=80, den=100)
    new = lambda n: r.integers(0, 2**63, n, np.int64).astype(np.uint64)
    passage, bases = new(30), [new(300) for _ in range(3)]
    sets = [np.unique(np.concatenate([passage, b[: -int(r.integers(1, 20))], new(5)])) for b in bases for _ in range(40)] + [np.append(passage, new(300)) for _ in range(80)]
    size, sketches, ids = np.array([len(s) for s in sets]), np.array([sketch(s) for s in sets]).view(np.uint8), np.arange(len(sets)) + 7
    edges = np.concatenate(search(ids, size, sketches, join)) - 7
    assert {(a // 40, b // 40) for a, b in edges.tolist()} == {(0, 0), (1, 1), (2, 2)} and len(edges) == 3 * 39
    some = np.concatenate(search(ids, size, sketches, join, most=500)) - 7  # the rest is linked unseen, and nothing is left out
    root = np.arange(len(sets))
    for a, b in some:
        root[root == root[b]] = root[a]
    assert all(len(set(root[40 * k : 40 * k + 40])) == 1 for k in range(3)) and len(set(root)) < 10


def test_components_alike_in_one_task_and_in_rounds(spark, monkeypatch):
    module = importlib.import_module("aerolytics.llm.components")
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 300)] + [(r.randrange(1000, 3000), r.randrange(1000, 3000)) for _ in range(900)] + [(-5, 7000), (7000, 7000), (8000, 8000)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = []
    for most in (1 << 20, 0):
        monkeypatch.setattr(module, "LOCAL_EDGES", most)
        got.append(sorted(map(tuple, components(df).collect())))
    assert got[0] == got[1] and dict(got[0])[300] == 0 and dict(got[0])[7000] == -5 and 8000 not in dict(got[0])
    assert components(df.filter("a = b")).count() == 0
    monkeypatch.setattr(module, "LOCAL_EDGES", 1 << 20)
    assert components(df.filter("a = b")).count() == 0
    # few jobs: an edge list in one task takes no rounds
    spark.sparkContext.setJobGroup("rounds", "")
    components(df)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")) <= 6
