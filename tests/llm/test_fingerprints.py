import hashlib

from aerolytics.llm import registry
from aerolytics.llm.fingerprints import Syncmers, anchors, fingerprint_documents, sketch, with_next

import fixtures as fx

SF = "/root/testdata/sf0.01"


def xx(spark, values):
    """Spark's hash of strings, which brute() takes as given."""
    from pyspark.sql import functions as F

    values = sorted(set(values))
    return dict(zip(values, (r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(F.xxhash64("v")).collect()), strict=True))


def pieces(text, p=Syncmers()):
    """Tokens, character by character."""
    unspaced = lambda c: any(a <= ord(c) <= b for a, b in ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF)))
    out, now = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r" or unspaced(c) or len(now) == p.piece:
            out += [now] if now else []
            now = ""
        if unspaced(c):
            out.append(c)
        elif c not in " \t\n\x0b\x0c\r":
            now += c
    return out


def brute_anchors(spark, texts, p=Syncmers()):
    """[(place, s-mers of the k-mer)] of each text, by Spark's hashes of tokens and of pairs of these."""
    from pyspark.sql import functions as F

    tokens = [pieces(t, p) for t in texts]
    h = xx(spark, [t for x in tokens for t in x] or ["x"])
    pairs = sorted({(h[a], h[b]) for x in tokens for a, b in zip(x, x[1:], strict=False)})
    two = dict(zip(pairs, (r[0] for r in spark.createDataFrame(pairs or [(0, 0)], "a long, b long").select(F.xxhash64("a", "b")).collect()), strict=False))
    out = []
    for x in tokens:
        m = [two[h[a], h[b]] for a, b in zip(x, x[1:], strict=False)]
        out.append([(i, tuple(m[i : i + 4])) for i in range(len(m) - 3) if min(m[i], m[i + 3]) <= min(m[i + 1 : i + 3])])
    return out


def test_fingerprints_and_likeness_equal_brute_force(spark):
    from pyspark.sql import functions as F

    p = Syncmers()
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60").collect()), reverse=True)
    docs += [(-1, "漢字かな交じり文の長い文章がここに続きます and more 漢字"), (-2, "a"), (-3, ""), (-4, "unbroken" * 400), (-5, "tiny text")]
    texts = [t for _, t in docs]
    edited = [t[: len(t) - len(t) // 3] + texts[(i + 1) % len(texts)][: len(t) // 3] for i, t in enumerate(texts)]
    chosen = brute_anchors(spark, texts + edited, p)
    grams = sorted({g for x in chosen for _, g in x})
    code = dict(zip(grams, ((r[0] & (2**64 - 1)) >> 32 for r in spark.createDataFrame(grams, "a long, b long, c long, d long").select(F.xxhash64("a", "b", "c", "d")).collect()), strict=True))
    whole = dict(zip(texts + edited, ((r[0] & (2**64 - 1)) >> 32 for r in spark.createDataFrame([(t,) for t in texts + edited], "t string").select(F.xxhash64(F.lit("whole"), "t")).collect()), strict=True))
    prints = []
    for t, x in zip(texts + edited, chosen, strict=True):
        first = {}
        for i, g in x:
            first.setdefault(code[g], i)
        prints.append(sorted(first.items())[: p.keep] or [(whole[t], 0)])

    def like(a, b):
        x, y = dict(a), dict(b)
        both = sorted(x.keys() | y.keys())[: p.keep]
        far = sorted(y[h] - x[h] for h in both if h in x and h in y)
        off = p.drift + max([*x.values(), *y.values()]) // p.part
        return sum(abs(o - far[(len(far) - 1) // 2]) <= off for o in far) / len(both)

    n = len(docs)
    got = {r.doc_id: r for r in fingerprint_documents(fx.texts(spark, *docs)).collect()}
    as_hex = lambda x: "".join(f"{h << 31 | i:016x}" for h, i in x)
    for i, (d, _) in enumerate(docs):
        r = got[d]
        assert (r.fingerprint, r.edited_fingerprint) == (as_hex(prints[i]), as_hex(prints[n + i])), d
        assert abs(r.near_edited - like(prints[i], prints[n + i])) < 1e-12 and abs(r.near_next - like(prints[i], prints[(i + 1) % n])) < 1e-12


def test_null_and_repeated_ids_follow_by_their_texts(spark):
    """Whatever the number of parts; rows of one id make a chain, and all rows one circle."""
    rows = [(None, f"text {i % 40}") for i in range(120)] + [(7, f"seven {i}") for i in range(150)] + [(i, f"own {i}") for i in range(10, 60)]
    d = fx.texts(spark, *rows).select("doc_id", "text")
    want = None
    for ranges in (1, 4, 40):
        got = [(r.doc_id, r.text, r.next_text) for r in with_next(d, ["text"], ranges).collect()]
        assert len(got) == len(rows) and sorted(x[2] for x in got) == sorted(t for _, t in rows)
        assert want is None or sorted(map(str, got)) == want
        want = sorted(map(str, got))
    parts = with_next(d, ["text"], 40)
    assert {t for i, _, t in got if i == 60 - 1} == {"own 58"} and sum(t.startswith("seven") for i, _, t in got if i == 7) == 149 and parts.count() == len(rows)


def test_likeness_goes_by_place_and_is_steady_in_length(spark):
    """Equal anchors at scattered places are no likeness; texts a little longer or shorter are as alike."""
    import random

    r = random.Random(5)
    words = [f"w{r.randrange(10**6)}" for _ in range(1500)]
    blocks = [words[i : i + 5] for i in range(0, 1500, 5)]
    mixed = [w for b in r.sample(blocks, len(blocks)) for w in b]
    shifted = [f"new{i}" for i in range(20)] + words
    rows = fx.texts(spark, (3, " ".join(mixed)), (2, " ".join(words)), (1, " ".join(shifted)))
    got = {x.doc_id: x.near_next for x in fingerprint_documents(rows).collect()}
    assert got[2] > 0.85 and got[3] < 0.35  # the same words, moved about
    base = " ".join(words)
    lengths = list(range(400, 900, 20))
    near = [x.near_edited for x in fingerprint_documents(fx.texts(spark, *[(i, base[:n]) for i, n in enumerate(lengths)])).orderBy("doc_id").collect()]
    assert max(near[1:]) - min(near[1:]) < 0.45 and min(near[1:]) > 0.3


def check(rows, docs):
    """docs: (doc_id, text) with distinct ids, by descending id."""
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(docs)
    prints = {}
    for i, (d, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        cut = len(t) // 3
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_query_equals_brute_force_and_tells_near_from_far(spark):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    rows = registry.op10_fingerprint(spark, SF).collect()
    check(rows, docs)
    near, far = sorted(r.near_edited for r in rows), sorted(r.near_next for r in rows)
    assert near[len(near) // 20] > 0.3 and far[len(far) * 19 // 20] < 0.1


def test_awkward_rows_in_any_number_of_ranges(spark):
    d = fx.awkward(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    docs = sorted(((r.doc_id, r.text or "") for r in d.collect()), reverse=True)
    for ranges in (1, 3, 50):
        rows = with_next(d.select("doc_id", "text").na.fill(""), ["text"], ranges).collect()
        assert {r.doc_id: r.next_text for r in rows} == {x: docs[(i + 1) % len(docs)][1] for i, (x, _) in enumerate(docs)}
    check(fingerprint_documents(d).collect(), docs)
    assert fingerprint_documents(fx.awkward(spark, extra=True)).count() == fx.awkward(spark).count()
    assert fingerprint_documents(fx.empty(spark)).count() == 0
    one = fingerprint_documents(fx.texts(spark, (1, "only one text here to look at"))).first()
    assert one.near_next == 1.0


def test_closed_syncmers_are_context_free(spark):
    """A k-mer is an anchor wherever it stands."""
    words = [f"w{i * 7919 % 1000}" for i in range(60)]
    a, b = " ".join(words), " ".join(["other", "begin", *words, "other", "end"])
    rows = anchors(fx.texts(spark, (1, a), (2, b))).collect()
    first = {(r.pos, r.hash) for r in rows if r.doc_id == 1}
    second = {(r.pos - len(pieces("other begin")), r.hash) for r in rows if r.doc_id == 2}
    n = len(pieces(a))
    assert first <= second and n / 4 <= len(first) <= n * 3 / 4
    d = sketch(fx.texts(spark, (1, a), (2, a), (3, "漢字かな交じり文の長い文章がここに続きます")), {"f": "text"}, Syncmers()).collect()
    assert d[0].f == d[1].f and len(d[2].f) > 1


def test_plan_runs_no_python(spark):
    plan = registry.op10_fingerprint(spark, SF)._jdf.queryExecution().toString()
    assert "Exchange" in plan
    assert "Python" not in plan and "ArrowEval" not in plan and "InPandas" not in plan


def test_near_copies_of_any_length_are_alike(spark):
    """Also across 600 characters, from which on characters once did not count."""
    rows = []
    for i, n in enumerate((200, 590, 598, 1200, 5000)):
        text = ""
        for j in range(n):
            text = (text + f" w{(i * 131 + j * 7919) % 9973}")[: n - 1] if len(text) < n - 1 else text
        rows += [(2 * i, text), (2 * i + 1, text + " and ten more"[:20])]
    got = {r.doc_id: r.near_next for r in fingerprint_documents(fx.texts(spark, *rows)).collect()}
    assert all(got[2 * i + 1] > 0.75 for i in range(5)) and all(got[2 * i] < 0.4 for i in range(1, 5))
