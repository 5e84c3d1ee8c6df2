import math
import zlib
from collections import Counter, defaultdict

import xxhash
from aerolytics.llm import registry
from aerolytics.llm.sharding import ShardTree, shard_documents, shard_of, with_shards
from pyspark.sql import functions as F

import fixtures as fx

SF = "/root/testdata/sf0.01"


def draw(name, key, weight):
    h = xxhash.xxh64(key.encode(), seed=xxhash.xxh64(name.encode(), seed=42).intdigest()).intdigest()
    return -math.log(((h >> 11) + 0.5) / 2**53) / weight


def brute(key, tree):
    weight = lambda rack: sum(w for _, w in rack)
    i = min(range(len(tree.regions)), key=lambda i: draw(f"{i}", key, sum(map(weight, tree.regions[i]))) if len(tree.regions) > 1 else 0)
    racks = tree.regions[i]
    j = min(range(len(racks)), key=lambda j: draw(f"{i}/{j}", key, weight(racks[j])) if len(racks) > 1 else 0)
    return min(racks[j], key=lambda s: draw(f"{i}/{j}/{s[0]}", key, s[1]) if len(racks[j]) > 1 else 0)[0]


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.op2_shard(spark, SF).collect()
    assert len(rows) == len(docs)
    tree, slots = ShardTree.of(24), defaultdict(set)
    for r in rows:
        body = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(body) + 8, zlib.crc32(body), "key")
        assert r.shard == brute(str(r.doc_id), tree) and r.grown_shard == brute(str(r.doc_id), tree.grown())
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].add(r.slot)
    assert all(s == set(range(len(s))) for s in slots.values())
    assert sum(map(len, slots.values())) == len(rows)


def test_weights_share_out_and_confine_movement(spark):
    tree = ShardTree.of(24)
    heavy = tree.weighted(5, 4.0)
    rows = spark.range(40_000).select(shard_of(F.col("id"), tree).alias("a"), shard_of(F.col("id"), heavy).alias("b")).collect()
    count = Counter(r.a for r in rows)
    assert all(abs(n - 40_000 / 24) < 250 for n in count.values())
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    # whole regions and racks that kept their weight: nothing moves between them
    assert all(a // 8 == 0 or b // 8 == 0 for a, b in moved)
    assert abs(sum(r.b == 5 for r in rows) / 40_000 - 4 / 27) < 0.01


def test_awkward_rows(spark):
    rows = shard_documents(fx.awkward(spark, extra=True), ShardTree.of(24), buckets=4).collect()
    assert len(rows) == fx.awkward(spark).count()
    assert {r.size for r in rows if r.doc_id == 4} == {8}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert shard_documents(fx.empty(spark), ShardTree.of(24)).count() == 0
    assert with_shards(fx.awkward(spark), ShardTree.of(3)).columns[-1] == "shard"


def test_plan_runs_no_python(spark):
    plan = registry.op2_shard(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
