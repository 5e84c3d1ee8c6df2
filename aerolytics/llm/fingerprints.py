"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is read as tokens: pieces of at most `piece` code points, counted from where a run without ASCII white space
begins, and single characters of scripts that do not put spaces between words. A k-mer of tokens is chosen when the least
hash among its inner s-mers stands at its first or last place (a closed syncmer). Whether a k-mer is chosen depends on that
k-mer alone, so an edit moves no choice beyond the k-mers that hold it (in a long run without spaces: beyond the run),
and chosen k-mers are anchors for positional matching: equal ones of two texts are a match where they stand as far apart
as most others do.

The fingerprint is a sketch, the `keep` least distinct hashes of the anchors, each with its first place, sixteen hex digits
an anchor, in order. The likeness of two fingerprints estimates the Jaccard similarity of the texts' anchors, by place: of
the `keep` least hashes of both together, the share that both hold at places whose distance is the median distance of
those that both hold, give or take `drift` tokens and a part of the longer text. One rule holds at every length.

Defined cases: a null text is an empty one; a text without a chosen k-mer has the one hash of its whole text; equal texts,
empty ones included, have equal fingerprints and likeness 1; anchors with one hash count once, at the first place; a null
doc_id comes last, and rows of one doc_id (repeated ones, or null) follow each other by the hash of their texts; an empty
table gives no rows. Everything is linear in the text, however long it or a word is. Columns other than doc_id and text
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Thai, Lao, Myanmar, Khmer, kana and Han, which put no spaces between words.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF"
_SPACE = r"\x20\x09-\x0D"
_PLACE = 31  # bits of a packed anchor that say its place


@dataclass(frozen=True)
class Syncmers:
    k: int = 5
    s: int = 2
    keep: int = 64
    piece: int = 2
    drift: int = 16
    part: int = 8  # a place may be off by 1 / part of the longer text


#: Each of these reads columns of the projection below, so that no array is worked out twice.
def _tokens(text: Column, p: Syncmers) -> Column:
    """Both patterns give the same where no character of unspaced scripts occurs; the first is faster."""
    cut = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces, single = rf"[^{_SPACE}]{{1,{p.piece}}}", rf"[{UNSPACED}]|[^{_SPACE}{UNSPACED}]{{1,{p.piece}}}"
    return F.transform(F.when(F.rlike(text, F.lit(f"[{UNSPACED}]")), cut(single)).otherwise(cut(pieces)), lambda t: F.xxhash64(t))


def _smers(tokens: str, p: Syncmers) -> Column:
    """Hashes of s tokens in a row; null where the array ends."""
    t = F.col(tokens)
    return F.transform(t, lambda x, i: F.when(i + (p.s - 1) < F.size(t), F.xxhash64(x, *[F.get(t, i + j) for j in range(1, p.s)])))


def _chosen(smers: str, p: Syncmers, pack: bool) -> Column:
    """For each k-mer its hash (which its s-mers determine), or null where it is not a closed syncmer. pack: the first 32 bits of it, then its place."""
    m, w = F.col(smers), p.k - p.s + 1

    def one(x: Column, i: Column) -> Column:
        rest = [F.get(m, i + j) for j in range(1, w)]
        inner = rest[:-1]
        code = F.xxhash64(x, *rest)
        closed = F.lit(True) if not inner else F.least(x, rest[-1]) <= (F.least(*inner) if len(inner) > 1 else inner[0])
        return F.when(closed & rest[-1].isNotNull(), F.shiftleft(F.shiftrightunsigned(code, 32), _PLACE).bitwiseOR(i.cast("long")) if pack else code)

    return F.transform(m, one)


def _hash(anchor: Column) -> Column:
    return F.shiftright(anchor, _PLACE)


def _place(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit((1 << _PLACE) - 1))


def sketch(docs: DataFrame, texts: dict[str, str], p: Syncmers = Syncmers()) -> DataFrame:  # noqa: B008
    """docs with, for each name -> text column in `texts`, the array of the least anchors, hash and place packed in a long."""
    d = docs
    for n, c in texts.items():
        body = F.coalesce(F.col(c), F.lit(""))
        d = d.withColumn(n, _tokens(body, p)).withColumn(n, _smers(n, p)).withColumn(n, F.sort_array(F.array_compact(_chosen(n, p, True))))
        m = F.col(n)
        d = d.withColumn(n, F.slice(F.filter(m, lambda x, i: (i == 0) | (_hash(x) != _hash(F.get(m, i - 1)))), 1, p.keep))
        whole = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.lit("whole"), body), 32), _PLACE)
        d = d.withColumn(n, F.when(F.size(n) > 0, F.col(n)).otherwise(F.array(whole)))
    return d


def anchors(docs: DataFrame, text: str = "text", p: Syncmers = Syncmers()) -> DataFrame:  # noqa: B008
    """doc_id and, for each anchor, pos (of its first token, from 0) and hash: for positional matching by joins on hash."""
    d = docs.select("doc_id", _tokens(F.coalesce(F.col(text), F.lit("")), p).alias("m"))
    d = d.withColumn("m", _smers("m", p)).withColumn("m", _chosen("m", p, False))
    return d.select("doc_id", F.posexplode("m").alias("pos", "hash")).filter("hash IS NOT NULL")


def as_text(anchors: Column) -> Column:
    return F.array_join(F.transform(anchors, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(d: DataFrame, a: str, b: str, name: str, p: Syncmers = Syncmers()) -> DataFrame:  # noqa: B008
    """d with `name`, the likeness of the sketches in columns a and b."""
    hashes = {f"{name}_{x}": F.transform(F.col(c), _hash) for x, c in (("x", a), ("y", b))}
    x, y = (F.col(c) for c in hashes)
    d = d.withColumns(hashes).withColumn(f"{name}_both", F.slice(F.sort_array(F.array_union(x, y)), 1, p.keep))
    at = lambda c, own, h: _place(F.get(F.col(c), (F.array_position(own, h) - 1).cast("int")))
    shared = F.array_intersect(F.array_intersect(F.col(f"{name}_both"), x), y)
    longer = F.greatest(*[F.array_max(F.transform(F.col(c), _place)) for c in (a, b)])
    d = d.withColumns({f"{name}_far": F.sort_array(F.transform(shared, lambda h: at(b, y, h) - at(a, x, h))), f"{name}_off": p.drift + F.floor(longer / p.part)})
    far = F.col(f"{name}_far")
    median = F.get(far, F.floor((F.size(far) - 1) / 2).cast("int"))
    d = d.withColumn(f"{name}_median", median)
    matched = F.size(F.filter(far, lambda o: F.abs(o - F.col(f"{name}_median")) <= F.col(f"{name}_off")))
    return d.withColumn(name, matched / F.size(f"{name}_both")).drop(*hashes, *[f"{name}_{x}" for x in ("both", "far", "off", "median")])


def _bounds(docs: DataFrame, most: int) -> list[int]:
    """At most `most` doc_ids that cut the table into ranges of about equal counts."""
    got = docs.select(F.percentile_approx("doc_id", [i / most for i in range(1, most)], 100 * most).alias("q")).first()["q"]
    return sorted(set(got or []))


def _range_of(column: Column, bounds: list[int]) -> Column:
    """How many bounds are <= the value, by binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    top = 1 << (len(bounds).bit_length() - 1)
    steps = [top >> i for i in range(top.bit_length())]
    array = F.array(*[F.lit(b) for b in bounds])
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(array, at + step - 1) <= column), at + step).otherwise(at))


#: Parts that a doc_id with very many rows may be cut into.
_SUB = 1 << 12


def with_next(rows: DataFrame, carry: list[str], ranges: int | None = None) -> DataFrame:
    """rows (doc_id and the columns to carry) with next_<c>: the next document's by descending doc_id (null last; equal
    ids by a hash of the first carried column, then by all), after the last the first's.

    Rows are dealt by ranges of doc_id (bounds from a quantile sketch: one number a range), and ranges of one doc_id that
    has many rows, or of null, by ranges of that hash. They are sorted within these; the first document of the
    range that follows is added to each as a sentinel, so no row crosses over."""
    spark = rows.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(29), carry[0]), 1)
    wide = F.when(F.col("doc_id").isNull(), -1).otherwise(_range_of(F.col("doc_id"), _bounds(rows, ranges))).cast("long")
    light = rows.select("doc_id", place.alias("place"), wide.alias("wide"))
    sizes = light.groupBy("wide").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("top")).collect()  # one row a range
    if not sizes:
        return rows.withColumns({f"next_{c}": F.col(c) for c in carry})
    share = max(1, sum(r["n"] for r in sizes) // ranges)
    subs = {r["wide"]: min(_SUB, -(-r["n"] // share)) for r in sizes if r["low"] == r["top"] and r["n"] > 2 * share}
    count = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in subs.items() for x in kv]), F.col("wide")), F.lit(1)) if subs else F.lit(1)
    sub = F.shiftright(F.shiftright("place", 31) * count, 32)
    part = F.col("wide") * _SUB - sub  # falls in order
    heads = {r["part"]: r for r in light.withColumn("part", part).groupBy("part").agg(F.max("doc_id").alias("top"), F.min("place").alias("place")).collect()}  # one row a part
    order = sorted(heads, reverse=True)
    ends = dict(zip(order, [order[-1], *order[:-1]], strict=True))  # first document of a part -> part that it follows
    dealt = rows.withColumns({"place": place, "wide": wide}).withColumn("part", part).drop("wide")
    cut = {k: r for k, r in heads.items() if -(-k // _SUB) in subs}  # parts of one doc_id: their first row by its hash
    tops = [r["top"] for k, r in heads.items() if k not in cut and r["top"] is not None]
    test = (F.col("doc_id").isin(*tops) if tops else F.lit(False)) | (F.col("doc_id").isNull() if any(r["top"] is None for k, r in heads.items() if k not in cut) else F.lit(False))
    if cut:
        test = F.coalesce(test, F.lit(False)) | F.col("place").isin(*[r["place"] for r in cut.values()])
    first = dealt.filter(test).select("part", F.struct((-F.col("doc_id")).alias("i"), "place", *carry, "doc_id").alias("r")).groupBy("part").agg(F.min("r").alias("r"))
    target = F.create_map(*[F.lit(x) for kv in ends.items() for x in kv])
    sentinels = first.select("r.*", F.element_at(target, F.col("part")).alias("part")).drop("i").withColumn("tail", F.lit(1))
    dealt = dealt.withColumn("tail", F.lit(0)).unionByName(sentinels, allowMissingColumns=True)
    after = W.partitionBy("part").orderBy("tail", F.desc_nulls_last("doc_id"), "place", *carry)
    out = dealt.withColumn("n", F.lead(F.struct(*carry)).over(after)).filter("tail = 0")
    return out.select(*rows.columns, *[F.col("n")[c].alias(f"next_{c}") for c in carry])


def fingerprint_documents(docs: DataFrame, p: Syncmers = Syncmers()) -> DataFrame:  # noqa: B008
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n/3) code points replaced by the first as many of the next document."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(sketch(d, {"f": "text"}, p), ["text", "f"])
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    d = sketch(d.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "f", "next_f"), {"e": "edited"}, p)
    d = d.withColumn("edited", F.sha2(F.col("edited").cast("binary"), 256))
    d = likeness(likeness(d, "f", "e", "near_edited", p), "f", "next_f", "near_next", p)
    return d.select("doc_id", "n_chars", F.col("edited").alias("edited_sha256"), as_text(F.col("f")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"), "near_edited", "near_next")
