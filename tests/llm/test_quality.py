import math

import numpy as np
import pyarrow as pa
from aerolytics.llm import registry
from aerolytics.llm.words import words as hashed_words
from aerolytics.llm.quality import BITS, LABELLERS, _KIND, _patterns, _unpack, expectation_maximisation, scored, train, votes

import fixtures as fx

SF = "/root/testdata/sf0.1"


def test_agrees_with_labels_it_never_saw(spark):
    got = registry.op9_quality(spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None]).mean() > 0.97
    assert good.keep.mean() > 0.95 and bad.keep.mean() < 0.1


def test_em_recovers_accuracies():
    r = np.random.default_rng(0)
    n, truth = 40_000, None
    truth = r.random(n) < 0.8
    right = np.linspace(0.65, 0.95, len(LABELLERS))
    v = np.where(r.random((n, len(LABELLERS))) < right, truth[:, None] * 2, 2 - truth[:, None] * 2)
    v[r.random(v.shape) < 0.2] = 1
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    model = expectation_maximisation(patterns, counts.astype(float))
    assert abs(model.share - 0.8) < 0.02
    assert np.abs(np.array(list(model.accuracies.values())) - right).max() < 0.03
    assert ((model.posterior(v) > 0.5) == truth).mean() > 0.97


def test_pattern_counts_cover_all_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = _patterns(d).toPandas()
    v = votes(pa.array([r.text for r in d.select("text").collect()]))
    want = {tuple(k): int(n) for k, n in zip(*np.unique(v, axis=0, return_counts=True), strict=True)}
    assert {tuple(k): int(n) for k, n in zip(_unpack(rows.pattern.to_numpy()), rows.n, strict=True)} == want


def test_awkward_rows(spark):
    d = fx.awkward(spark, extra=True)
    got = scored(d, train(d)).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 2}) == 1
    assert scored(fx.empty(spark), train(fx.empty(spark))).count() == 0


def test_query_equals_brute_force(spark):
    """EM document by document, and scores word by word from the weights."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    v = {d: votes(pa.array([t]))[0].tolist() for d, t in texts.items()}
    table = [[[0.5, 0.35, 0.15], [0.04, 0.3, 0.66]] for _ in LABELLERS]
    share = 0.85

    def posterior(x):
        good, bad = share, 1 - share
        for j, vote in enumerate(x):
            good, bad = good * table[j][1][vote], bad * table[j][0][vote]
        return good / (good + bad)

    for _ in range(200):
        q = {d: posterior(x) for d, x in v.items()}
        share = min(0.98, max(0.02, sum(q.values()) / len(q)))
        new = [[[0.5] * 3, [0.5] * 3] for _ in LABELLERS]
        for d, x in v.items():
            for j, vote in enumerate(x):
                new[j][0][vote] += 1 - q[d]
                new[j][1][vote] += q[d]
        new = [[[n / sum(row) for n in row] for row in both] for both in new]
        done = max(abs(a - b) for x, y in zip(new, table, strict=True) for r, s in zip(x, y, strict=True) for a, b in zip(r, s, strict=True)) < 1e-7
        table = new
        if done:
            break
    model = train(docs)
    got = {r.doc_id: r for r in registry.op9_quality(spark, sf).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        assert abs(got[d].posterior - posterior(v[d])) < 1e-6
        raw, z, last = text.encode(), 0.0, None
        found = raw.split()
        for _, h in zip(found, hashed_words(pa.array([text]))[0].tolist(), strict=True):
            z += float(model.scorer.weights[h % (1 << BITS)]) + float(model.scorer.weights[(1 << BITS) + 8192 + (h == last)])
            last = h
        h, first, starts, ends = hashed_words(pa.array([text]), True)
        data = np.frombuffer(raw, np.uint8)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            shape = ((_KIND[data[a]] * 8 + _KIND[data[b - 1]]) * 16 + min(b - a, 15)) * 8 + _KIND[data[(a + b) // 2]]
            z += float(model.scorer.weights[(1 << BITS) + shape])
        assert abs(got[d].score - 1 / (1 + math.exp(-(z / max(1, len(found)) + model.scorer.bias)))) < 1e-6
        assert got[d].keep == (got[d].score >= 0.5)
