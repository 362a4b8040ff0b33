"""Small tables with the cases that every operator must take."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # columns that clash with names the operators give
    T.StructField("k", T.StringType()), T.StructField("size", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("shard", T.StringType()),
])


def make(spark, rows):
    """documents from (doc_id, text, lang, source)."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", "y", "z", "s") for i, t, lang, src in rows], SCHEMA)


LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
ODD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, "   \n\t ", None, None), (None, "some text without an id here", "en", "a"),
    (5, "the same row twice, the same row twice", "en", "b"), (5, "the same row twice, the same row twice", "en", "b"),
    (6, "another text with the id of the next", "fr", "b"), (6, "a wholly different text under this id", "fr", "b"),
    (7, LONG, "en", "a"), (8, "Été naïve 你好 \U0001f600 İstanbul", "fr", "c"), (9, "1234 %% $$", "de", "c"), (10, "a" * 5000, "de", "c"),
]
