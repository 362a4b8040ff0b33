"""What the operators of this package share: tables, shared storage, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its files are at most this large.
BROADCAST_BYTES = 16 << 20

#: Separators of words, as a Java / RE2 character class.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table."""
    return table(spark, sf_dir, "documents")


#: Rows reach Python in batches of at most so many bytes: a worker and its JVM hold a few at a time.
ARROW_BYTES, _ARROW_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

_CLEAN_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def in_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of bounded size."""
    df.sparkSession.conf.set(_ARROW_CONF, str(ARROW_BYTES))
    return df.mapInArrow(function, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="inkflow-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(_remove, spark, found)
    return found


def _path(spark: SparkSession, name: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, name: str) -> None:
    try:
        path, fs = _path(spark, name)
        fs.delete(path, True)
    except Exception:  # the session may be gone at exit; the folder then stays
        return


class Stored:
    """A DataFrame written to the shared folder, and the bytes of its files."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/inkflow/{uuid.uuid4().hex}"
        # the shuffle files behind a written table aren't read again
        before = spark.conf.get(_CLEAN_CONF)
        spark.conf.set(_CLEAN_CONF, "true")
        try:
            df.write.option("compression", "zstd").parquet(self.path)
        finally:
            spark.conf.set(_CLEAN_CONF, before)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        path, fs = _path(spark, self.path)
        self.bytes = fs.getContentSummary(path).getLength()
        self._spark = spark
        atexit.register(_remove, spark, self.path)

    def drop(self) -> None:
        """Delete the files; only when no later plan reads them."""
        _remove(self._spark, self.path)

    @property
    def is_small(self) -> bool:
        """Whether the files are small enough to broadcast."""
        return self.bytes <= BROADCAST_BYTES

    def small(self) -> DataFrame:
        """The rows, with a broadcast hint if the files are small enough; else the planner's joins."""
        return F.broadcast(self.df) if self.is_small else self.df


class Scratch:
    """Stored tables that are deleted together at the end of a ``with`` block; what outlives it is stored outside."""

    def __init__(self):
        self._held = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for x in self._held:
            x.drop()

    def stored(self, df: DataFrame) -> Stored:
        self._held.append(Stored(df))
        return self._held[-1]

    def store(self, df: DataFrame) -> DataFrame:
        return self.stored(df).df


def store(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: this cuts the lineage and survives lost executors."""
    return Stored(df).df


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions as the session configures them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(doc_id: str = "doc_id"):
    """crc32 of the decimal text of an id; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """Hash of id and text: rows with equal ids but other texts differ, repeated rows agree."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def words(text: str = "text") -> str:
    """SQL for the array of white-space separated words; a null text has none."""
    return f"filter(split(coalesce({text}, ''), '{_sql(SPACE)}+'), w -> w <> '')"


def _sql(pattern: str) -> str:
    """A regular expression inside a Spark SQL string literal."""
    return pattern.replace("\\", "\\\\")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, k, text): k is 0, but a hash of the text where several rows share the id."""
    again = Stored(docs.groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("again"))).small()
    return docs.select("doc_id", "text").join(again, F.expr("doc_id <=> id"), "left").select("doc_id", F.expr("if(again, xxhash64(doc_id, text), 0L)").alias("k"), "text")


def rows_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row of ``docs`` for each (id, key, m, ...) of ``wanted``, with its other columns.

    ``key`` is the row's ``row_key`` and m how often the row is there. Only rows that are there
    several times are grouped; the others' texts are not shuffled if ``wanted`` is small."""
    keyed_docs = docs.withColumn("__key", row_key())
    found = keyed_docs.join(Stored(wanted).small(), F.expr("__key = key and doc_id <=> id")).drop("id", "key")
    return found.where("m = 1").union(found.where("m > 1").dropDuplicates(["doc_id", "__key"])).drop("__key", "m")


#: A key's rows are dealt over so many salts; so many rows of partial results meet again by key.
SALTS = 200


def with_minimum(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the least ``value`` among all rows of its ``key``.

    No task gets a key's rows together: they are dealt by key and a salt, and only one row of each
    salt goes on to the key. So a key may hold any share of the rows."""
    dealt = df.withColumn("__salt", F.expr(f"cast(pmod(xxhash64({value}), {SALTS}) as int)"))
    part = dealt.groupBy(key, "__salt").agg(F.min(value).alias("__low"))
    least = part.groupBy(key).agg(F.min("__low").alias(name))
    return dealt.join(part.select(key, "__salt").join(least, key), [key, "__salt"]).drop("__salt")


def dealt_join(df: DataFrame, key: str, other: str, side: DataFrame) -> DataFrame:
    """``df`` joined with ``side``, which has one row for each ``key``; ``other`` tells a key's rows apart.

    A key's rows are dealt over ``SALTS`` salts, each of which gets the side's row, so a key may hold
    any share of the rows."""
    dealt = df.withColumn("__salt", F.expr(f"cast(pmod(xxhash64({other}), {SALTS}) as int)"))
    parts = dealt.select(key, "__salt").distinct().join(side, key)
    return dealt.join(parts, [key, "__salt"]).drop("__salt")
