import hashlib

import numpy as np
from aerolytics.llm import registry
from aerolytics.llm.suffix_dedup import Repeats, remove_repeats, segments, sorted_suffixes
from hypothesis import given, settings
from hypothesis import strategies as st

import fixtures as fx

SF = "/root/testdata/sf0.001"


def brute(docs, length=50):
    low = {}
    for d, t in docs:
        for i in range(len(t) - length + 1):
            low[t[i : i + length]] = min(d, low.get(t[i : i + length], d))
    out = []
    for d, t in docs:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if low[t[i : i + length]] < d:
                gone[i : i + length] = True
        gone = gone[: len(t)]
        spans = int((gone & ~np.append(False, gone)[:-1]).sum()) if len(t) else 0
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows(registry.op4_suffix_dedup(spark, SF)) == brute(docs)


def test_planted_passages(spark):
    r = np.random.default_rng(5)
    noise = lambda n: "".join(r.choice(list("abcdefgh ÄÉ"), n))
    p, q = noise(120), noise(49)
    loop = "abc " * 100
    texts = [noise(80) + p + noise(80), p, noise(30) + p[10:70] + noise(9) + p[40:100], p[:49], noise(60) + q + noise(5), q + noise(100), loop, loop + noise(20), "x" + loop[5:300], noise(200), noise(10) + p + p + noise(3)] * 2
    texts += [noise(int(r.integers(0, 90))) + p[int(r.integers(0, 40)) : int(r.integers(60, 120))] + noise(int(r.integers(0, 40))) for _ in range(60)]
    docs = list(enumerate(texts))
    want = brute([(d, t.encode()) for d, t in docs])
    assert rows(remove_repeats(fx.texts(spark, *docs))) == want
    assert rows(remove_repeats(fx.texts(spark, *docs), Repeats(block=500, flush=100))) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=12), min_size=1, max_size=12), st.integers(1, 40), st.sampled_from([0, 1 << 20]))
def test_suffixes_are_sorted(texts, block, in_memory):
    docs = [t.encode() for t in texts]
    cuts = np.append(0, np.cumsum([len(d) for d in docs]))
    starts = sorted_suffixes(np.frombuffer(b"".join(docs), np.uint8), cuts, block, in_memory)
    of = np.searchsorted(cuts, starts, side="right") - 1
    got = [docs[i][s - cuts[i] :] for i, s in zip(of, starts, strict=True)]
    assert got == sorted(d[i:] for d in docs for i in range(len(d)))


def test_segments_cover_every_window_once():
    body = np.random.default_rng(1).integers(97, 100, 900).astype(np.uint8)
    offsets = np.array([0, 20, 20, 69, 119, 400, 900])
    _, text, at, n = segments(body, offsets, Repeats())
    got = sorted(x for a, k in zip(at, n, strict=True) for x in range(a, a + k))
    assert got == [i for a, b in zip(offsets[:-1], offsets[1:], strict=True) for i in range(a, b - 49)]


def test_awkward_rows(spark):
    d = fx.awkward(spark, extra=True)
    docs = [(2**63 - 1 if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in d.collect()]
    got = sorted((2**63 - 1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(d).collect())
    assert got == brute(docs)
    assert remove_repeats(fx.empty(spark)).count() == 0
