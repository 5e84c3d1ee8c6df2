import random

import numpy as np
import pyarrow as pa
from aerolytics.llm import registry
from aerolytics.llm.decontaminate import Decontaminate, Index, Multi, matches, without_matches
from aerolytics.llm.words import words as hashed

import fixtures as fx

SF = "/root/testdata/sf0.01"
ITEM = "item_id long, text string, n long"


def test_query_finds_the_planted_items(spark):
    docs = {r.doc_id: r.text.lower().split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    whole = {(d, i) for d, w in docs.items() for i, x in items.items() if any(w[a : a + len(x)] == x for a in range(len(w) - len(x) + 1) if w[a] == x[0])}
    rows = registry.op6_decontaminate(spark, SF).collect()
    got = {(r.doc_id, r.item_id): r for r in rows}
    assert whole <= set(got) and len(got) == len(rows)
    for (d, i), r in got.items():  # what is reported is similar by the shingles of the stretch
        stretch = docs[d][r.first_word : r.first_word + r.n_words]
        a, b = (set(zip(*[x[j:] for j in range(5)], strict=False)) for x in (stretch, items[i]))
        assert r.similarity >= 0.8 and len(a & b) / len(a | b) > 0.7


def test_multi_index_search_is_exhaustive():
    r = np.random.default_rng(0)
    entries = r.integers(0, 2**63, 300).astype(np.uint64)
    queries = []
    for _ in range(2000):
        q = int(entries[r.integers(300)])
        for b in r.permutation(64)[: r.integers(0, 12)]:
            q ^= 1 << int(b)
        queries.append(q)
    queries = np.array(queries, np.uint64)
    near = np.bitwise_count(queries[:, None] ^ entries[None]) <= 7
    q, e = Multi(entries, 7, 4).search(queries)
    assert sorted(zip(q.tolist(), e.tolist(), strict=True)) == sorted(map(tuple, np.argwhere(near).tolist()))


def test_planted_passages_and_clean_documents(spark):
    r = random.Random(4)
    noise = lambda n: " ".join(f"n{r.randrange(3000)}" for _ in range(n))
    items = [(i, noise(r.randrange(9, 90)), 0) for i in range(60)] + [(60, "one two three", 0), (61, None, 0), (62, "", 0), (63, " ".join(["lorem"] * 600), 0)]
    docs, want = [], set()
    for i, t, _ in items[:61]:
        docs.append((len(docs), f"{noise(r.randrange(0, 50))} {t.upper()}\n{noise(r.randrange(0, 50))}"))
        want.add((len(docs) - 1, i))
        words = t.split()
        if len(words) > 60:  # one word of many changed
            words[len(words) // 2] = "changed"
            docs.append((len(docs), noise(20) + " " + " ".join(words) + " " + noise(20)))
            want.add((len(docs) - 1, i))
        docs.append((len(docs), noise(60) + " " + " ".join(t.split()[: max(2, len(t.split()) // 2)]) + " " + noise(60)))  # half an item
    frame, bench = fx.texts(spark, *docs, (9000, None), (9001, ""), (9002, noise(5000))), spark.createDataFrame(items, ITEM)
    for p in (Decontaminate(), Decontaminate(items_a_pass=10)):
        assert {(x.doc_id, x.item_id) for x in matches(frame, bench, p).collect()} == want
    bad = {d for d, _ in want}
    assert {x.doc_id for x in without_matches(frame, bench).collect()} == {x.doc_id for x in frame.collect()} - bad


def test_weights_are_those_of_the_whole_benchmark(spark):
    """However the items are dealt to passes, the same stretches are found with the same similarity."""
    r = random.Random(8)
    word = lambda n: " ".join(r.choice(["the", "of", "and", f"v{r.randrange(10**5)}", f"v{r.randrange(10**5)}"]) for _ in range(n))
    items = [(i, word(r.randrange(60, 100)), 0) for i in range(100)]
    docs = []
    for i, t, _ in items:
        w = t.split()
        w[len(w) // 3] = "changed"
        docs.append((i, f"{word(20)} {' '.join(w)} {word(20)}"))
    frame, bench = fx.texts(spark, *docs), spark.createDataFrame(items, ITEM)
    whole, *split = (sorted(tuple(x) for x in matches(frame, bench, Decontaminate(items_a_pass=n)).collect()) for n in (4000, 30, 9))
    assert len(whole) > 40 and all(x == whole for x in split)


def test_equals_an_exhaustive_search():
    """Every stretch of every document against every item, by sets of shingles and their weights."""
    r = random.Random(9)
    p = Decontaminate()
    for _ in range(6):
        pool = [f"w{i}" for i in range(60)]
        items = [[r.choice(pool) for _ in range(r.randrange(8, 30))] for _ in range(30)]
        docs = []
        for x in items:
            y = list(x)
            for _ in range(r.randrange(3)):
                y[r.randrange(len(y))] = r.choice(pool)
            docs.append([r.choice(pool) for _ in range(r.randrange(9))] + y[r.randrange(2) :] + [r.choice(pool) for _ in range(r.randrange(9))])
        held = [set(x) for x in items]
        weight = {w: 1 if sum(w in x for x in held) >= max(2, len(items) / 20) else 4 for w in {*pool}}
        grams = lambda x: [tuple(x[i : i + p.shingle]) for i in range(len(x) - p.shingle + 1)]
        mass = lambda s: sum(sum(weight[w] for w in g) for g in s)  # noqa: B023, E731
        want = {}
        for t, d in enumerate(docs):
            g = grams(d)
            for i, x in enumerate(items):
                own = set(grams(x))
                for a in range(len(g)):
                    if g[a] not in own:
                        continue
                    for b in range(a + 1, min(len(g), a + 2 * len(x)) + 1):
                        if g[b - 1] in own and 2 * (b - a + p.shingle - 1) >= len(x):
                            s = set(g[a:b])
                            value = mass(s & own) / mass(s | own)
                            if value >= p.similarity - 1e-12 and value > want.get((t, i), 0) + 1e-12:
                                want[t, i] = value
        got = {k: v[0] for k, v in _found(items, docs).items()}
        assert set(got) == set(want) and len(want) >= 5 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_items_and_texts_without_a_bound():
    """An item of 20,000 words, and a megabyte without white space."""
    r = random.Random(10)
    long = [f"v{r.randrange(10**6)}" for _ in range(20_000)]
    edited = list(long)
    edited[7000] = "changed"
    got = _found([long, ["one", "two", "three", "four", "five", "six"]], [edited, ["x" * 1_000_000], ["!" * 1_000_000, "one", "two", "three", "four", "five", "six"]])
    assert set(got) == {(0, 0), (2, 1)} and got[0, 0][0] > 0.99


def test_awkward_rows(spark):
    d, none = fx.awkward(spark, extra=True), spark.createDataFrame([], ITEM)
    assert matches(d, none).count() == 0 and without_matches(d, none).count() == d.count()
    bench = spark.createDataFrame([(1, fx.BASE, 0), (1, fx.BASE, 0), (2, None, 0), (None, "漢字かな交じり文 🎉 Ñandú", 0)], ITEM)
    got = {(r.doc_id, r.item_id) for r in matches(d, bench).collect()}
    assert {(1, 1), (2, 1), (3, 1), (11, 1)} <= got and {x for x, _ in got} <= {1, 2, 3, 10, 11}
    assert without_matches(d, bench).columns == d.columns
    assert matches(fx.empty(spark), bench).count() == 0 and without_matches(fx.empty(spark), bench).count() == 0
    assert Index([], [], Decontaminate()).search(np.array([1, 2], np.uint64), np.array([0, 2])) == []


def _found(items, docs):
    index = Index(list(range(len(items))), [" ".join(x) for x in items], Decontaminate())
    return {(t, i): v for t, i, *v in index.search(*hashed(pa.array([" ".join(x) for x in docs])))}


def test_edits_at_head_middle_and_tail_are_found_up_to_the_similarity():
    r = random.Random(6)
    word = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    sets = lambda x: set(zip(*[x[j:] for j in range(5)], strict=False))
    items = [word(n) for n in (20, 40, 60, 80, 100, 150) for _ in range(20)]
    docs, likely = [], {}
    for i, x in enumerate(items):
        n = max(1, len(x) * 9 // 100)
        middle = len(x) // 2
        for y in (x[n:], x[:-n], word(n) + x[n:], x[:-n] + word(n), x[:middle] + word(n) + x[middle + n :], x[: len(x) // 2], x[n:-n]):
            likely[len(docs), i] = len(sets(x) & sets(y)) / len(sets(x) | sets(y))
            docs.append(word(30) + y + (word(30) if len(docs) % 2 else []))
    got = _found(items, docs)
    assert {p for p, s in likely.items() if s >= 0.8} <= set(got) and sum(s >= 0.8 for s in likely.values()) > 400
    for (t, i), (s, a, n) in got.items():
        y = docs[t][a : a + n]
        assert s >= 0.8 and abs(s - len(sets(items[i]) & sets(y)) / len(sets(items[i]) | sets(y))) < 1e-9
        assert s >= likely[t, i] - 1e-9


def test_exact_copies_of_short_items_are_found():
    r = random.Random(7)
    word = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    items = [word(n) for n in range(1, 11) for _ in range(40)]
    got = _found(items, [word(20) + x + word(20) for x in items])
    assert {(t, i) for t, i in got if t == i} == {(i, i) for i in range(len(items))}
    assert all(got[i, i] == [1.0, 20, len(x)] for i, x in enumerate(items))
    assert not {(t, i) for t, i in got if t != i and len(items[i]) > 1}
