"""Small frames for the operators: every kind of awkward row."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])

LONG = " ".join(f"word{i % 997} tail{i % 31}" for i in range(6000))
BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly judge my vow near the old stone bridge at dawn and nobody else knows why"


def awkward(spark, extra=False):
    """Nulls in any column, empty and very long texts, ties and repeated rows, one hot source."""
    rows = [
        (1, BASE, "en", "a", 10), (2, BASE, "en", "a", 10), (2, BASE, "en", "a", 10), (3, BASE + " indeed", "en", None, None), (4, None, None, "b", None), (5, "", "en", "a", 0),
        (6, "   \n\t ", None, "a", 6), (7, LONG, "en", "a", len(LONG)), (8, LONG + " end", "en", "a", 1), (None, "no id at all but a text", "en", "a", 1), (9, "x", "en", "b", 1),
        (10, "Ünïcode é 漢字かな交じり文 🎉 Ñandú", "es", "c", 3), (11, BASE.upper(), "en", "c", 3), (12, "Und " * 400, "de", "a", 3), (-5, "minus five is an id too", "en", "ä", 3),
    ]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("size", "shard", "slot", "taken", "target", "score", "rank", "a", "b", "n", "x", "id", "key", "block", "keep", "component_id", "f1", "part", "cluster", "text_hash", "place", "predicted", "_id", "_x", "_row", "_n", "_th", "_i", "_k", "_copies", "_mine", "_toxic_text", "_benchmark_text", "text_", "row", "copies", "h", "s", "d", "kx", "k"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("extra"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts(spark, *rows):
    return spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
