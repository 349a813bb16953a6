"""Relations over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..relation import Relation


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_items(spark: SparkSession, sf_dir: str) -> Relation:
    """Four attributes with many ties; five key columns, of which the price tells apart rows that share the others."""
    t = table(spark, sf_dir, "lineitem")
    names = {"k0": "l_orderkey", "k1": "l_partkey", "k2": "l_suppkey", "k3": "l_linenumber", "k4": "l_extendedprice", "a0": "l_quantity", "a1": "l_extendedprice", "a2": "l_discount", "a3": "l_tax"}
    rows = t.select(*[F.col(c).alias(n) for n, c in names.items()])
    return Relation.of(rows, [f"k{i}" for i in range(5)], [f"a{i}" for i in range(4)])


def vectors(spark: SparkSession, sf_dir: str, d: int = 8) -> Relation:
    """The first d elements of each embedding; negative values, no ties."""
    t = table(spark, sf_dir, "embeddings")
    return Relation.of(t.select(F.col("vec_id").alias("tid"), *[F.col("embedding")[i].cast("double").alias(f"a{i}") for i in range(d)]), ["tid"], [f"a{i}" for i in range(d)])


def parts(spark: SparkSession, sf_dir: str) -> Relation:
    t = table(spark, sf_dir, "part")
    return Relation.of(t.select(F.col("p_partkey").alias("tid"), F.col("p_size").alias("a0"), F.col("p_retailprice").alias("a1")), ["tid"], ["a0", "a1"])


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, seq.., value): event values by user in the order of time and id."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id", "event_type", "value")
