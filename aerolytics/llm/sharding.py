"""Shards by a hierarchical weighted hash tree, in DataFrame functions only.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight with u hashed from the row's
key and the child's name; the least draw wins, so a child gets a share in proportion to its weight. A child's draw
depends on nothing but the key, its name and its weight: when a weight changes, rows move only into or out of the
subtrees whose weight changed. `grown()` adds a shard as a new subtree at the top and leaves the other weights as
they are, so one more shard takes rows only into itself.

Defined cases: a null key is a key of its own; a null text has no bytes; equal keys share a shard; an empty table
gives no rows. Columns other than the key and the text are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Rack = tuple[tuple[int, float], ...]


@dataclass(frozen=True)
class ShardTree:
    """regions[i][j] is a rack: ((shard, weight), ...)."""

    regions: tuple[tuple[Rack, ...], ...]

    @classmethod
    def of(cls, shards: int, racks: int = 2, per_rack: int = 4) -> ShardTree:
        """Equal weights, filled rack by rack."""
        ids, regions = list(range(shards)), []
        for a in range(0, shards, racks * per_rack):
            region = ids[a : a + racks * per_rack]
            regions.append(tuple(tuple((s, 1.0) for s in region[b : b + per_rack]) for b in range(0, len(region), per_rack)))
        return cls(tuple(regions))

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grown(self, weight: float = 1.0) -> ShardTree:
        new = 1 + max(s for region in self.regions for rack in region for s, _ in rack)
        return ShardTree((*self.regions, ((((new, weight)),),)))

    def weighted(self, shard: int, weight: float) -> ShardTree:
        return ShardTree(tuple(tuple(tuple((s, weight if s == shard else w) for s, w in rack) for rack in region) for region in self.regions))


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / weight


def _winner(key: Column, children: list[tuple[str, float, int]]) -> Column:
    """children: (name, weight, value); the value of the least draw, the first named on a tie."""
    children = [c for c in children if c[1] > 0]
    if len(children) == 1:
        return F.lit(children[0][2])
    return F.array_min(F.array(*[F.struct(_draw(key, name, w).alias("d"), F.lit(v).alias("v")) for name, w, v in children]))["v"]


def shard_of(key: Column, tree: ShardTree) -> Column:
    """The shard (int) of a key column."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    weight = lambda rack: sum(w for _, w in rack)
    region = _winner(key, [(f"{i}", sum(map(weight, racks)), i) for i, racks in enumerate(tree.regions)])
    out = None
    for i, racks in enumerate(tree.regions):
        rack = _winner(key, [(f"{i}/{j}", weight(r), j) for j, r in enumerate(racks)])
        leaf = None
        for j, r in enumerate(racks):
            one = _winner(key, [(f"{i}/{j}/{s}", w, s) for s, w in r]) if weight(r) > 0 else F.lit(None).cast("int")
            leaf = F.when(rack == j, one) if leaf is None else leaf.when(rack == j, one)
        out = F.when(region == i, leaf) if out is None else out.when(region == i, leaf)
    return out.cast("int")


def numbered(rows: DataFrame, group: str, slot: str = "slot", buckets: int = 256) -> DataFrame:
    """rows with a number, gapless from 0 in each group, and no task that holds a whole group.

    Equal rows are counted first. Rows are numbered within (group, hash bucket) and start at the sum of the buckets
    before; that sum runs over one row a bucket. `buckets` bounds a task to its share of a group."""
    cols = rows.columns
    counted = rows.groupBy(*cols).agg(F.count("*").alias("_k")).withColumn("_b", F.pmod(F.xxhash64(*cols), F.lit(buckets)))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    starts = counted.groupBy(group, "_b").agg(F.sum("_k").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(before(W.partitionBy(group).orderBy("_b"))), F.lit(0))
    starts = starts.select(F.col(group).alias("_g"), F.col("_b").alias("_c"), offset.alias("_o"))
    own = F.coalesce(F.sum("_k").over(before(W.partitionBy(group, "_b").orderBy(*cols))), F.lit(0))
    placed = counted.withColumn("_w", own).join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_c")))
    first = F.col("_o") + F.col("_w")
    return placed.select(*cols, F.explode(F.sequence(first, first + F.col("_k") - 1)).alias(slot))


def shard_documents(docs: DataFrame, tree: ShardTree, key: str = "doc_id", text: str = "text", buckets: int = 256) -> DataFrame:
    """doc_id, size (bytes of the text plus 8), text_crc32, law, shard, slot, grown_shard (with one shard more)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(F.col(key), tree).alias("shard"), shard_of(F.col(key), tree.grown()).alias("grown_shard"),
    )
    return numbered(rows, "shard", "slot", buckets).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def with_shards(docs: DataFrame, tree: ShardTree, key: str = "doc_id") -> DataFrame:
    """docs with their shard (a column of that name is replaced): a projection, without any shuffle."""
    return docs.withColumn("shard", shard_of(F.col(key), tree))
