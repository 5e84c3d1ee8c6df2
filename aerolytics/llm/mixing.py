"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

1. Targets: sources in code-point order (null last) share all words by weight; a target stops at `most` times its
   source's size and the excess goes to the others by weight, until none is above.
2. Blocks: each source's documents lie on a line in seeded order; the line is cut into blocks of equal word counts.
   A source whose target is `most` times its size takes all its blocks `most` times. Seats, as many as blocks fill the
   other targets, go to the other sources one by one by the highest quotient target / (2 k + 1). The seat of rank r
   belongs to shard r mod shards: a whole-number quota for each source and shard.
3. Selection: a source's j-th seat takes the j-th block of its line in seeded order, round after round.
4. A document takes the words of it that lie in selected blocks, each as often as the block was selected.

The number of blocks is a parameter, raised where the least of the other targets would be under `least_seats` blocks; it
grows with the number of sources, not with the documents. Only positions on the lines are computed over documents, by hash bucket, so that no task holds a whole source.

Defined cases: null text has size 0 and takes 0; null source is a source of its own; repeated rows are separate
documents, and share what their key takes; a very long text lies over several blocks and takes of each; ties in the
seeded order go by doc_id, size and text; an empty table gives no rows; columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, packed, written

#: Keys of repeated rows above this many are joined by a shuffle and not broadcast.
BROADCAST_KEYS = 1_000_000


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    most: int = 3  # times a source may be repeated
    blocks: int = 24_000
    least_block: int = 16  # words; small tables get fewer blocks
    least_seats: int = 8  # blocks that the least target below `most` times its source comes to
    shards: int = 24
    seed: int = 17
    buckets: int = 512


def sized(docs: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, source, size, text_hash and the seeded place in the source's order; one light row a document."""
    place = F.xxhash64(F.lit(mix.seed), F.col("doc_id").cast("string"), F.col("text"))
    return docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), place.alias("place"))


def targets(rows: DataFrame, mix: Mix) -> DataFrame:
    """source, rank (from 0), weight, source_size, target, total. One row a source, by water filling over sources sorted by cap / weight."""
    n = len(mix.weights)
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.col("rank") % n + 1).cast("int"))
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1).withColumn("weight", weight)
    s = s.withColumns({"total": F.sum("source_size").over(W.partitionBy()), "cap": F.col("source_size") * mix.most})
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    s = s.withColumns({
        "caps": F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "left": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
    })
    s = s.withColumn("full", F.col("cap") * F.col("left") <= F.col("weight") * (F.col("total") - F.col("caps")))
    level = (F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(W.partitionBy())) / F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(W.partitionBy())
    s = s.withColumn("level", F.when(~F.col("full"), level))
    return s.select("source", "rank", "weight", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"), "total")


def _repeated_whole(mix: Mix) -> Column:
    """Whether a source's target is `most` times its size."""
    return F.col("target") >= F.col("source_size") * mix.most


def _block_words(mix: Mix) -> Column:
    sources = F.count("*").over(W.partitionBy())
    least = F.min(F.when(~_repeated_whole(mix), F.col("target"))).over(W.partitionBy())
    fine = F.least(F.col("total"), F.ceil(mix.least_seats * F.col("total") / least))
    wanted = F.greatest(4 * sources, F.least(F.lit(mix.blocks), F.floor(F.col("total") / mix.least_block)), fine)
    return F.col("total") / wanted


def _n_blocks() -> Column:
    return F.greatest(F.lit(1), F.least(F.col("source_size"), F.round(F.col("source_size") / F.col("unit")).cast("long")))


def seats(by_source: DataFrame, mix: Mix) -> DataFrame:
    """rank (of the source), j (its seat, from 0) and shard: the apportionment, one row a seat."""
    s = by_source.withColumn("unit", _block_words(mix)).filter(F.col("target") > 0)
    whole = s.filter(_repeated_whole(mix)).select("rank", F.explode(F.sequence(F.lit(0), (mix.most * _n_blocks()).cast("int") - 1)).alias("j"))
    whole = whole.withColumn("shard", ((F.col("rank") + F.col("j")) % mix.shards).cast("int"))
    s = s.filter(~_repeated_whole(mix))
    s = s.withColumns({"share": F.col("target") / F.col("unit"), "seats": F.round(F.sum("target").over(W.partitionBy()) / F.col("unit"))})
    s = s.select("rank", "target", "seats", F.explode(F.sequence(F.lit(0), F.ceil(2 * F.col("share")).cast("int") + 2)).alias("k"))
    s = s.withColumn("place", F.row_number().over(W.orderBy(F.desc(F.col("target") / (2 * F.col("k") + 1)), "rank", "k")) - 1).filter(F.col("place") < F.col("seats"))
    return s.select("rank", F.col("k").alias("j"), (F.col("place") % mix.shards).cast("int").alias("shard")).unionByName(whole)


def quotas(chosen: DataFrame) -> DataFrame:
    """Whole blocks for each source and shard."""
    return chosen.groupBy("rank", "shard").agg(F.count("*").alias("blocks"))


def blocks(by_source: DataFrame, mix: Mix) -> DataFrame:
    """rank, block, begin and words (of the block; lengths differ by one at most), o (its place in seeded order), n (blocks of the source)."""
    s = by_source.withColumn("unit", _block_words(mix)).filter(F.col("source_size") > 0)
    s = s.withColumn("n", _n_blocks()).select("rank", "source_size", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"))
    s = s.withColumns({"begin": F.expr("(block * source_size) div n"), "words": F.expr("((block + 1) * source_size) div n - (block * source_size) div n")})
    seeded = W.partitionBy("rank").orderBy(F.xxhash64(F.lit(mix.seed), "rank", "block"), "block")
    return s.withColumn("o", F.row_number().over(seeded) - 1)


def selection(by_source: DataFrame, mix: Mix) -> DataFrame:
    """rank, block, shard: a row for each time that a block is taken."""
    b = blocks(by_source, mix)
    picked = seats(by_source, mix).join(by_source.select("rank", "source_size"), "rank")
    picked = picked.join(b.groupBy("rank").agg(F.max("n").alias("n")), "rank").filter(F.col("j") < mix.most * F.col("n")).withColumn("o", F.col("j") % F.col("n"))
    return picked.join(b.select("rank", "o", "block"), ["rank", "o"]).select("rank", "block", "shard")


def _times(by_source: DataFrame, mix: Mix) -> DataFrame:
    """rank, block, begin, n, times, start (words taken from the blocks before)."""
    taken = selection(by_source, mix).groupBy("rank", "block").agg(F.count("*").alias("times"))
    b = blocks(by_source, mix).join(taken, ["rank", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    before = F.sum(F.col("times") * F.col("words")).over(W.partitionBy("rank").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    return b.select("rank", "block", "begin", "n", "times", F.coalesce(before, F.lit(0)).alias("start"))


def running(rows: DataFrame, group: str, bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of `value` over the rows before in (bucket, order) of the group; a task holds one bucket at most."""
    r = rows.withColumn("_b", bucket)
    before = lambda *by: W.partitionBy(group, *by[:-1]).orderBy(*by[-1]).rowsBetween(W.unboundedPreceding, -1)
    sums = r.groupBy(group, "_b").agg(F.sum(value).alias("_n"))
    sums = sums.select(F.col(group).alias("_g"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before(["_b"])), F.lit(0)).alias("_o"))
    own = F.coalesce(F.sum(value).over(before("_b", order)), F.lit(0))
    r = r.withColumn("_w", own).join(sums, (F.col(group) == F.col("_g")) & (F.col("_b") == F.col("_c")))
    return r.withColumn(name, F.col("_o") + F.col("_w")).drop("_b", "_c", "_g", "_o", "_w")


def on_lines(rows: DataFrame, by_source: DataFrame, mix: Mix) -> DataFrame:
    """rows with rank, source_size, target and `a`, the words of their source that lie before them."""
    r = rows.join(by_source.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return running(r, "rank", F.pmod("place", F.lit(mix.buckets)), ["place", "doc_id", "size", "text_hash"], "size", "a")


def mix_rows(rows: DataFrame, mix: Mix) -> DataFrame:
    """rows (of sized(), best as a written table) with rank, source_size, target and taken."""
    by_source = written(targets(rows, mix), "mix-targets")
    times = written(_times(by_source, mix), "mix-blocks")
    r = on_lines(rows, by_source, mix)
    r = r.join(times.groupBy("rank").agg(F.max("n").alias("n")), "rank", "left")
    edge = lambda x: F.least(F.expr(f"(({x} + 1) * n - 1) div source_size"), F.col("n") - 1)
    r = r.withColumn("b", F.col("a") + F.col("size"))
    r = r.withColumns({"ea": F.when(F.col("size") > 0, edge("a")), "eb": F.when(F.col("size") > 0, edge("b"))})

    def upto(x: str) -> DataFrame:
        return times.select(F.col("rank").alias(f"_r{x}"), F.col("block").alias(f"_k{x}"), (F.col("start") - F.col("begin") * F.col("times")).alias(f"s{x}"), F.col("times").alias(f"t{x}"))

    for x in "ab":
        r = r.join(upto(x), (F.col("rank") == F.col(f"_r{x}")) & (F.col(f"e{x}") == F.col(f"_k{x}")), "left")
    at = lambda x: F.col(f"s{x}") + F.col(x) * F.col(f"t{x}")
    taken = at("b") - at("a")
    return r.select(*rows.columns, "rank", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    """doc_id, size, source_size, target, taken."""
    rows = written(sized(docs, mix), "mix-sizes")
    return mix_rows(rows, mix).select("doc_id", "size", "source_size", "target", "taken")


def mixed_copies(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    """The mix as whole documents: each row as often as taken / size; documents without words stay as they are. Columns
    of any name are kept as they are.

    The rests, below one copy, are rounded along each source's documents in order of size: a copy more whenever
    their running sum passes a whole number, so that a source's total is off by about one document."""
    rows = written(sized(docs, mix), "mix-sizes")
    key = ["doc_id", "source", "text_hash"]
    total = mix_rows(rows, mix).groupBy(*key, "rank", "place", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("n"))
    total = total.withColumn("rest", F.when(F.col("size") > 0, F.col("taken") % F.col("size") * 1_000_000 / F.col("size")).otherwise(0).cast("long"))
    bucket = F.floor(F.log2(F.col("size") + 1) * 8) * 64 + F.pmod("place", F.lit(64))
    total = running(total, "rank", bucket, ["place", "doc_id", "text_hash"], "rest", "before")
    step = lambda c: F.floor((c + 500_000) / 1_000_000)
    copies = F.floor(F.col("taken") / F.col("size")) + step(F.col("before") + F.col("rest")) - step(F.col("before"))
    total = total.select(*key, F.when(F.col("size") > 0, copies).otherwise(F.col("n")).cast("int").alias("copies"), "n").filter("copies > 0")
    total = written(total, "mix-copies").select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("text_hash").alias("h"), "copies", "n")
    on = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("text_hash") == F.col("h"))
    d = packed(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").cast("string").alias("source"), F.xxhash64("row.text").alias("text_hash"))
    repeat = lambda rows, k: rows.filter(k > 0).select("row", F.explode(F.sequence(F.lit(1), k))).select("row.*")
    out = repeat(d.join(total.filter("n = 1"), on), F.col("copies"))
    again = total.filter("n > 1")
    if again.isEmpty():
        return out
    # rows with one doc_id, source and text share the copies: numbered within the partitions that hold them, then over these
    again = F.broadcast(again) if again.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else again
    r = d.withColumn("part", F.spark_partition_id()).join(again, on)
    here = ["d", "s", "h", "part"]
    before = F.coalesce(F.sum("k").over(W.partitionBy("d", "s", "h").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offset = r.groupBy(*here).agg(F.count("*").alias("k")).select(*[F.col(c).alias(f"o_{c}") for c in here], before.alias("offset"))
    r = r.withColumn("place", F.row_number().over(W.partitionBy(*here).orderBy(F.lit(0))))
    r = r.join(offset, F.col("d").eqNullSafe(F.col("o_d")) & F.col("s").eqNullSafe(F.col("o_s")) & (F.col("h") == F.col("o_h")) & (F.col("part") == F.col("o_part")))
    mine = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("offset") + F.col("place") <= F.col("copies") % F.col("n"), 1).otherwise(0)
    return out.unionAll(repeat(r, mine.cast("int")))
