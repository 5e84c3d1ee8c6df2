import re
from collections import Counter, defaultdict
from fractions import Fraction

from aerolytics.llm import mixing, registry
from aerolytics.llm.mixing import Mix

import fixtures as fx

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """The water filling, step by step, on exact fractions."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: Fraction(left * w[s], sum(w[f] for f in free)) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**full, **share}
        full |= {s: most * sizes[s] for s in over}


def brute_seats(votes, n):
    """Seats one by one by the highest quotient."""
    got, order = Counter(), []
    for _ in range(n):
        best = max(votes, key=lambda s: (votes[s] / (2 * got[s] + 1), -s))
        got[best] += 1
        order.append(best)
    return got, order


def test_query(spark):
    docs = {r.doc_id: (len(WORD.findall(r.text or "")), r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.op5_mix(spark, SF).collect()
    sizes = defaultdict(int)
    for n, s in docs.values():
        sizes[s] += n
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        n, s = docs[r.doc_id]
        assert r.size == n and r.source_size == sizes[s] and abs(r.target - float(want[s])) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * n
        taken[s] += r.taken
    assert len(rows) == len(docs)
    assert all(abs(taken[s] - float(want[s])) <= 0.01 * float(want[s]) + 40 for s in sizes)
    again = registry.op5_mix(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_seats_are_sainte_lague_and_blocks_give_what_is_taken(spark):
    mix = Mix(blocks=500, least_block=1)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.sized(docs, mix)
    by = mixing.targets(rows, mix).cache()
    votes = {r["rank"]: r.target for r in by.collect()}
    seats = mixing.seats(by, mix).collect()
    got, order = brute_seats(votes, 500)
    assert Counter(r["rank"] for r in seats) == got
    per = Counter((s, i % mix.shards) for i, s in enumerate(order))
    assert {(r["rank"], r["shard"]): r["blocks"] for r in mixing.quotas(mixing.seats(by, mix)).collect()} == dict(per)
    # taken, word by word, from the blocks and the documents' places on the line
    times = Counter((r["rank"], r["block"]) for r in mixing.selection(by, mix).collect())
    blocks = {(r["rank"], r["block"]): (r["begin"], r["words"]) for r in mixing.blocks(by, mix).collect()}
    words = defaultdict(dict)
    for (rank, block), (begin, n) in blocks.items():
        for w in range(begin, begin + n):
            words[rank][w] = times[rank, block]
    placed = {r.doc_id: r for r in mixing.on_lines(rows, by, mix).collect()}
    for r in mixing.mix_documents(docs, mix).collect():
        p = placed[r.doc_id]
        assert r.taken == sum(words[p["rank"]][w] for w in range(p.a, p.a + p.size))


def test_copies_come_near_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = mixing.mixed_copies(docs)
    assert out.columns == docs.columns
    sizes, got = defaultdict(int), defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text))
    copies = Counter()
    for r in out.collect():
        got[r.source] += len(WORD.findall(r.text))
        copies[r.doc_id] += 1
    want = brute_targets(sizes)
    assert all(abs(got[s] / float(want[s]) - 1) < 0.1 for s in sizes) and max(copies.values()) <= 3


def test_awkward_rows(spark):
    d = fx.awkward(spark, extra=True)
    rows = mixing.mix_documents(d).collect()
    assert len(rows) == d.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert mixing.mix_documents(fx.empty(spark)).count() == 0
    assert mixing.mixed_copies(fx.awkward(spark)).count() > 0
    assert mixing.mixed_copies(fx.empty(spark)).count() == 0
    only = fx.texts(spark, (1, None), (2, ""))
    assert [r.taken for r in mixing.mix_documents(only).collect()] == [0, 0] and mixing.mixed_copies(only).count() == 2


def test_small_sources_beside_a_hot_one_come_to_their_targets(spark):
    sizes = {"a": 40_000, "b": 3, "c": 30, "d": 400, "e": 9_000, None: 50}
    rows = [(i, " ".join(["w"] * n), source) for source, whole in sizes.items() for i, n in enumerate([whole // 3] * 3 + [whole % 3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix, want = Mix(blocks=400), brute_targets(sizes)
    taken = Counter()
    for r in mixing.mix_rows(mixing.sized(docs, mix), mix).collect():
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, n in sizes.items():
        assert taken[s] == 3 * n if want[s] == 3 * n else abs(taken[s] / float(want[s]) - 1) < 0.05
    copies = Counter(r.source for r in mixing.mixed_copies(docs, mix).collect() if r.text)
    assert copies["b"] == copies["c"] == 9 and copies["d"] == copies[None] == 12
