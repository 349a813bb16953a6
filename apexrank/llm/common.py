"""What the operators share: tables, the shared folder, word splitting, and joins whose small side is checked."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join of narrow rows (a few dozen bytes) is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 400_000
#: The white space of the word rule [^\x20\x09-\x0D]+.
BLANK_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new local one, with a local master only."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="apexrank-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str = "part") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reclaim(spark: SparkSession) -> None:
    """Has every executor collect the whole of its heap, by a task for each core.

    A heap grows to its limit under what a step throws away, and stays there though most of it is free, beside the Python workers of the
    next step. A full collection returns what is free to the system."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def fresh(name: str, taken) -> str:
    """name, with as many underscores behind it as make it differ from those taken."""
    while name in taken:
        name += "_"
    return name


def checked(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows allow; otherwise left for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, even where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text in order; none for null."""
    return F.coalesce(F.array_remove(F.split(text, BLANK_RE), ""), F.array().cast("array<string>"))


def plain_words(text: Column) -> Column:
    """The lower-cased runs of letters and digits of a text, so that case and punctuation don't matter; none for null."""
    return F.coalesce(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), F.array().cast("array<string>"))


def shingles(tokens: Column, k: int) -> Column:
    """64-bit hashes of the runs of k tokens, in order, repeats included; none if there are fewer than k."""

    def runs(t: Column) -> Column:
        last = F.size(t) - k
        hashes = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(t, i + j) for j in range(k)]))
        return F.when(last >= 0, hashes).otherwise(F.array().cast("array<bigint>"))

    return let(tokens, runs)
