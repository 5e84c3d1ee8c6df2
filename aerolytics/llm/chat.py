"""Cumulative-snapshot collapse of logged conversations, then rendering, in DataFrame functions only.

A chat log often holds a conversation once per turn, each time with all turns so far. Turn k of a conversation gets
a rolling hash of turns 1..k (the xor of two 64-bit hashes of position, role and text of each, so 128 bits). Equal
conversations share their last hash: the smallest conv_id of them stays. A conversation whose last hash occurs as
the hash at the same length inside a longer one is a prefix of it and goes by an anti-join. What stays is maximal
and is rendered turn by turn.

Turns are ordered by (turn, role, text), null first, and numbered from 1. Positions and hashes are computed by
(conv_id, block of turn numbers) and joined to block totals, so that a conversation with any number of turns does
not meet in one task; no list of turns is ever collected.

Defined cases: repeated rows (same conv_id, turn, role, text) count once; null role or text is an empty one; rows
without conv_id belong to no conversation and are left out; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

BLOCK = 1024


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, h1, h2 (of role and text), once for repeated rows; no text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2"))
    return rows.distinct()


def prefixes(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, turn, role, h1, h2, pos, p1, p2: the rolling hashes of every turn.

    Turns that share a turn number are ordered by role and then by the hashes of their texts."""
    t = _turns(conversations).withColumn("b", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 60))))
    order = ["turn", "role", "h1", "h2"]
    here = W.partitionBy("conv_id", "b").orderBy(*order)
    counts = t.groupBy("conv_id", "b").agg(F.count("*").alias("n"))
    before = W.partitionBy("conv_id").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("w", F.row_number().over(here)).join(counts.select("conv_id", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o")), ["conv_id", "b"])
    t = t.withColumn("pos", F.col("o") + F.col("w"))
    t = t.withColumns({f"x{i}": F.xxhash64(F.lit(i), "pos", "role", "h1", "h2") for i in (1, 2)})
    sums = t.groupBy("conv_id", "b").agg(*[F.bit_xor(f"x{i}").alias(f"s{i}") for i in (1, 2)])
    sums = sums.select("conv_id", "b", *[F.coalesce(F.bit_xor(f"s{i}").over(before), F.lit(0)).alias(f"o{i}") for i in (1, 2)])
    run = here.rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumns({f"w{i}": F.bit_xor(f"x{i}").over(run) for i in (1, 2)}).join(sums, ["conv_id", "b"])
    return t.select("conv_id", *order, "pos", *[F.col(f"o{i}").bitwiseXOR(F.col(f"w{i}")).alias(f"p{i}") for i in (1, 2)])


def maximal(rolling: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies: the conversations that are no prefix of a longer one, the smallest conv_id of equal ones."""
    last = rolling.groupBy("conv_id").agg(F.max(F.struct("pos", "p1", "p2")).alias("l")).select("conv_id", "l.*")
    classes = last.groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    ends = last.select("conv_id", F.col("pos").alias("n"))
    inner = rolling.join(ends, "conv_id").filter("pos < n").select("pos", "p1", "p2").distinct()
    return classes.join(inner, ["pos", "p1", "p2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "copies")


def collapse(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, n_turns, copies and, a row for each turn, pos, role and the text rendered as
    <|im_start|>role, a line end, the text, <|im_end|> and a line end."""
    rolling = written(prefixes(conversations, block), "chat-prefixes")  # read three times
    kept = maximal(rolling)
    keep = rolling.join(kept, "conv_id").select("conv_id", "turn", "role", "h1", "h2", "pos", "n_turns", "copies")
    text = F.coalesce("text", F.lit(""))
    bodies = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2"), text.alias("text"))
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("turn",)] + [F.col(f"k.{c}") == F.col(f"b.{c}") for c in ("conv_id", "role", "h1", "h2")]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    joined = keep.alias("k").join(bodies.dropDuplicates(["conv_id", "turn", "role", "h1", "h2"]).alias("b"), cond)
    rendered = F.concat(F.lit("<|im_start|>"), F.col("k.role"), F.lit("\n"), F.col("b.text"), F.lit("<|im_end|>\n"))
    return joined.select(F.col("k.conv_id").alias("conv_id"), F.col("k.pos").cast("long").alias("pos"), F.col("n_turns").cast("long").alias("n_turns"), F.col("copies").cast("long").alias("copies"), F.col("k.role").alias("role"), rendered.alias("rendered"))


def snapshots(conversations: DataFrame, stride: int = 1 << 32) -> DataFrame:
    """The log that cumulative logging makes of conversations: each once for each of its turn numbers, with all turns up to it.

    The snapshot at a turn is named conv_id + stride * turn. Rows grow with the square of a conversation's turns, as such logs do."""
    c = conversations.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    at = c.select("conv_id", F.col("turn").alias("at")).distinct()
    return c.join(at, "conv_id").filter("turn <= at").select((F.col("conv_id") + stride * F.col("at")).alias("conv_id"), "turn", "role", "text")


#: The same rows in DuckDB; ties on a turn number do not occur in the generated table.
ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER w AS pos, string_agg(concat(length(role), ':', role, length(text), ':', text), '') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS so_far
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
l AS (SELECT conv_id, max(pos) AS n_turns, arg_max(so_far, pos) AS whole FROM p GROUP BY conv_id),
c AS (SELECT whole, n_turns, min(conv_id) AS conv_id, count(*) AS copies FROM l GROUP BY whole, n_turns),
i AS (SELECT DISTINCT so_far FROM p JOIN l USING (conv_id) WHERE pos < n_turns),
k AS (SELECT * FROM c WHERE whole NOT IN (SELECT so_far FROM i))
SELECT p.conv_id, CAST(p.pos AS BIGINT) AS pos, CAST(k.n_turns AS BIGINT) AS n_turns, CAST(k.copies AS BIGINT) AS copies, p.role, concat('<|im_start|>', p.role, chr(10), p.text, '<|im_end|>', chr(10)) AS rendered
FROM p JOIN k ON p.conv_id = k.conv_id
"""

#: The same of snapshots().
SNAPSHOTS_ORACLE = ORACLE.replace("FROM conversations WHERE conv_id IS NOT NULL", "FROM (SELECT c.conv_id + 4294967296 * a.turn AS conv_id, c.turn, c.role, c.text FROM conversations c JOIN (SELECT DISTINCT conv_id, turn FROM conversations) a ON c.conv_id = a.conv_id AND c.turn <= a.turn)")
