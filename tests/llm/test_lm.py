import math
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from aerolytics.llm import registry
from aerolytics.llm.lm import LM, VOCABULARY, Attention, Coded, Read, Subwords, alike, group_sizes, score_documents, train
from pyspark.sql import functions as F

import fixtures as fx

SF = "/root/testdata/sf0.01"
SMALL = LM(start_rows=40, start_ids=20_000)


@pytest.fixture(scope="module")
def subwords():
    return Subwords(Path(VOCABULARY).read_bytes())


def brute(docs):
    """(held_out, n_tokens, n_known, train_tokens, base_score) of each text, in order."""
    count = Counter()
    for d, t in docs:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            count.update([*(t or "").encode().lower().split(), None])
    n, kinds = sum(count.values()), len(count)
    out = []
    for d, t in docs:
        w = [*(t or "").encode().lower().split(), None]
        out.append((zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + kinds + 1)) for x in w)))
    return out


def same(rows, docs):
    got = sorted((r.doc_id is None, r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows)
    want = sorted((d is None, d, h, n, k, t, round(b, 5)) for (d, _), (h, n, k, t, b) in zip(docs, brute(docs), strict=True))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:6] == b[:6] and abs(a[6] - b[6]) <= 1e-6 * abs(b[6]) + 1e-4
    assert all(r.score <= 0 and math.isfinite(r.score) for r in rows)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same(registry.op1_lm(spark, SF).collect(), docs)


def test_rare_words_come_by_the_join(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 200")
    docs = [(r.doc_id, r.text) for r in d.collect()]
    for top in (1, 300):
        same(score_documents(d, LM(start_rows=40, start_ids=20_000, top_words=top)).collect(), docs)


def test_beats_the_base_on_held_out_texts(spark):
    rows = [r for r in registry.op1_lm(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_subwords_and_sequences(subwords):
    texts = ["Hello  wörld\t 漢字!", None, "a\xa0b \x1c x y", "", "hello " * 50]
    r = Read(pa.array(texts), subwords)
    table = dict((i, t) for t, i in subwords._parse())
    for t, a, b in zip(texts, r.id_first[:-1], r.id_first[1:], strict=True):
        ids = r.ids[a:b].tolist()
        assert ids[-1] == subwords.end and ids.count(subwords.end) == 1
        assert b"".join(table[i] for i in ids[:-1]) == b"".join(b" " + w for w in (t or "").encode().lower().split())
    assert np.allclose(r.so_far()[r.word_first[4] : r.word_first[5]], [*([0] + [1] * 49), 0])


def test_attention_is_a_distribution_and_each_id_is_scored_once():
    p = LM(width=8, context=2, stride=3, frequent=5, buckets=2)
    a = Attention(p, np.zeros(p.outputs), seed=1)
    r = np.random.default_rng(0)
    classes, first = r.integers(0, p.outputs, 40), np.array([0, 1, 8, 8, 21, 40])
    base = a.score(classes, first, chunk=4)
    assert np.allclose(base, a.score(classes, first, chunk=1000), atol=1e-5)
    for at in (0, 3, 20, 39):  # sums to one over the next class, and later ids change nothing
        total = 0
        for c in range(p.outputs):
            other = classes.copy()
            other[at] = c
            s = a.score(other, first)
            total += math.exp(s[at])
            assert np.allclose(s[:at], base[:at], atol=1e-5)
        assert abs(total - 1) < 1e-4


def test_scores_are_finite_up_to_the_bound_of_the_weights():
    p = LM(frequent=20, buckets=3)
    r = np.random.default_rng(0)
    classes, first = r.integers(0, p.outputs, 500), np.array([0, 120, 121, 500])
    for size in (0.1, 1, 2, 12):
        a = Attention(p, np.zeros(p.outputs), seed=3)
        for k in a.NAMES:
            setattr(a, k, (size * np.sign(r.normal(size=getattr(a, k).shape)) if size == 12 else r.normal(0, size, getattr(a, k).shape)).astype(np.float32))
        s = a.score(classes, first)
        assert np.isfinite(s).all() and (s <= 1e-6).all()
        loss, grads = a.step(classes, *a.windows(first))
        assert math.isfinite(loss) and all(np.isfinite(g).all() for g in grads)


def test_gradients():
    p = LM(width=4, context=2, stride=3, frequent=4, buckets=1)
    r = np.random.default_rng(0)
    a = Attention(p, np.zeros(p.outputs), seed=2)
    for k in a.NAMES:
        setattr(a, k, getattr(a, k).astype(np.float64))
    classes, first = r.integers(0, p.outputs, 30), np.array([0, 11, 30])
    w = a.windows(first)
    _, grads = a.step(classes, *w)
    for k, g in zip(a.NAMES, grads, strict=True):
        weight = getattr(a, k)
        for _ in range(4):
            i = tuple(r.integers(0, n) for n in weight.shape)
            old, eps = weight[i], 1e-4
            weight[i] = old + eps
            up = a.step(classes, *w)[0]
            weight[i] = old - eps
            down = a.step(classes, *w)[0]
            weight[i] = old
            assert abs((up - down) / (2 * eps) - g[i]) < 2e-3, k


def test_training_lowers_the_loss():
    p = LM(frequent=8, buckets=1)
    r = np.random.default_rng(0)
    classes = np.tile([0, 1, 2, 3, 4, 5], 400)
    classes[r.random(len(classes)) < 0.05] = 7
    first = np.arange(0, len(classes) + 1, 60)
    a = Attention(p, np.zeros(p.outputs))
    before = a.score(classes, first).mean()
    assert a.train(classes, first, 60, 0.03).score(classes, first).mean() > before + 1


def test_awkward_rows(spark):
    d = fx.awkward(spark, extra=True)
    same(score_documents(d, SMALL).collect(), [(r.doc_id, r.text) for r in d.collect()])
    assert score_documents(fx.empty(spark), SMALL).count() == 0
    held = fx.texts(spark, *[(i, "some words here") for i in range(200)]).filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7) == 2)
    rows = score_documents(held, SMALL).collect()  # nothing to learn from
    assert rows and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in rows)
    assert train(held, SMALL)[0].ends == 0


def test_attention_is_trained_on_all_training_documents_but_those_of_the_mixture(spark, subwords):
    d = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 300")
    docs = [r.text for r in d.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7) != 2).collect()]
    size = [len(Read(pa.array([t]), subwords).ids) for t in docs]
    assert sum(size) - sum(sorted(size)[-8:]) <= train(d, SMALL)[0].trained < sum(size)


def test_averaged_weights_are_kept_whatever_they_score(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 100")
    start, worse = (train(d, LM(start_rows=80, start_ids=200_000, rate=r))[0] for r in (1e-12, 0.25))
    assert worse.held_out[1] < worse.held_out[0] == start.held_out[0]
    assert np.abs(worse.attention.weights() - start.attention.weights()).max() > 0.05


def test_scores_do_not_depend_on_the_table_of_frequent_words(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 200").unionByName(fx.awkward(spark))
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens, r.score)
    whole, *cut = (sorted(score_documents(d, LM(start_rows=40, start_ids=20_000, top_words=top)).collect(), key=key) for top in (1 << 20, 1, 300))
    for rows in cut:
        assert all(a[:6] == b[:6] and abs(a.score - b.score) <= 1e-3 + 1e-5 * abs(a.score) for a, b in zip(whole, rows, strict=True))


def plain(a, classes, first):
    """The model's log probabilities, one class at a time."""
    p, d, g, out = a.p, a.p.width, a.groups, []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        for i in range(lo, hi):
            start = lo + (i - lo) // p.stride * p.stride
            at = np.arange(max(lo, start - p.context), i + 1)
            x = a.E[[a.n if j == lo else classes[j - 1] for j in at]] + a.P[at - start + p.context]
            q, k, v = x[-1] @ a.A[:, :d], x @ a.A[:, d : 2 * d], x @ a.A[:, 2 * d :]
            w = np.exp(k @ q / math.sqrt(d))
            logits = (x[-1] + w @ v / w.sum() @ a.B) @ a.O + a.c
            logits[:g] += a.D[a.n if i == lo else classes[i - 1]]
            of = int(classes[i]) // a.size
            own = logits[g + of * a.size : min(g + (of + 1) * a.size, g + a.n)]
            out.append(logits[of] + own[classes[i] - of * a.size] - math.log(np.exp(logits[:g]).sum()) - math.log(np.exp(own).sum()))
    return np.array(out)


def test_scores_equal_brute_force():
    for frequent in (1, 6, 17):  # whole groups, and a last group with free places
        p = LM(width=8, context=3, stride=4, frequent=frequent, buckets=2)
        r = np.random.default_rng(frequent)
        a = Attention(p, np.log(r.dirichlet(np.ones(p.outputs))), seed=1)
        for k in a.NAMES:
            setattr(a, k, r.normal(0, 0.7, getattr(a, k).shape).astype(np.float32))
        classes, first = r.integers(0, p.outputs, 60), np.array([0, 1, 12, 12, 40, 60])
        assert np.allclose(a.score(classes, first, chunk=5), plain(a, classes, first), atol=1e-4)


def test_classes_that_follow_alike_share_a_group():
    n = 16
    r = np.random.default_rng(0)
    kind = r.permutation(n) % 4
    classes = r.integers(0, n, 1)
    for _ in range(6000):  # a class of the next kind follows
        classes = np.append(classes, r.choice(np.flatnonzero(kind == (kind[classes[-1]] + 1) % 4)))
    number = alike(classes, np.array([0, len(classes)]), n)
    assert sorted(number) == list(range(n)) and all(len(set(number[kind == k] // group_sizes(n)[0])) == 1 for k in range(4))


def test_a_step_costs_far_less_than_all_outputs():
    def seconds(frequent):
        p = LM(frequent=frequent)
        r = np.random.default_rng(0)
        a, classes = Attention(p, np.zeros(p.outputs)), r.integers(0, p.outputs, 96 * p.stride)
        w, best = a.windows(np.array([0, len(classes)])), math.inf
        for _ in range(8):
            t = time.process_time()
            a.step(classes, *w)
            best = min(best, time.process_time() - t)
        return best

    assert seconds(4032) < 5 * seconds(192)  # 16 times the classes


def test_a_process_encodes_a_word_once(subwords, monkeypatch):
    asked, encode = [], Subwords.encode
    monkeypatch.setattr(Subwords, "encode", lambda self, many: asked.append(len(many)) or encode(self, many))
    parts = [pa.array(x) for x in (["Hello wörld 漢字!", None, "a\xa0b \x1c x y"], ["", "hello more words of wörld"], ["hello " * 9 + "x"])]
    whole = {}
    for limit in (1 << 20, 4, 0):  # room for all words, for some batches, for none
        monkeypatch.setattr(Coded, "kept", Coded(subwords, limit))
        for again in range(2):
            for i, part in enumerate(parts):
                r = Read(part, subwords)
                assert np.array_equal(r.ids, whole.setdefault(i, r.ids)) and r.ids.dtype == np.int64
                assert not (again and limit > 4) or asked[-1] == 0
        assert len(Coded.kept.words) <= limit
    fresh = pa.array(["more wörld", "漢字!"])
    monkeypatch.setattr(Coded, "kept", None)
    assert Read(fresh, subwords).ids.tolist() == [i for t in ("more wörld", "漢字!") for i in [*Coded.kept.encoding.encode_ordinary(" " + t), subwords.end]]
