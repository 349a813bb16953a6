"""Synthetic relations. Each value is a function of (seed, row, attribute), so a lost partition comes back the same."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *at: Column) -> Column:
    """In (0, 1), by hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *at), 11).cast("double") + 0.5) / float(1 << 53)


def normal(seed: int, *at: Column) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, *at))) * F.cos(2 * math.pi * uniform(seed + 7919, *at))


def _table(spark: SparkSession, n: int, d: int, value) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("tid"), *[value(F.lit(m)).alias(f"a{m}") for m in range(d)])


def independent(spark: SparkSession, n: int, d: int, seed: int = 1) -> DataFrame:
    return _table(spark, n, d, lambda m: uniform(seed, F.col("id"), m))


def correlated(spark: SparkSession, n: int, d: int, seed: int = 1, spread: float = 0.05) -> DataFrame:
    """All attributes of a row near a level of its own, peaked at one half."""
    level = (uniform(seed, F.col("id"), F.lit(-1)) + uniform(seed, F.col("id"), F.lit(-2)) + uniform(seed, F.col("id"), F.lit(-3))) / 3
    return _table(spark, n, d, lambda m: F.greatest(F.lit(0.0), F.least(F.lit(1.0), level + spread * normal(seed + 1, F.col("id"), m))))


def anticorrelated(spark: SparkSession, n: int, d: int, seed: int = 1, spread: float = 0.05) -> DataFrame:
    """Rows near a plane of constant sum, the parts far apart: good in one attribute is bad in others."""
    total = F.lit(d / 2.0) + spread * d * normal(seed, F.col("id"), F.lit(-1))
    raw = [-F.log(uniform(seed + 1, F.col("id"), F.lit(m))) for m in range(d)]
    everything = sum(raw[1:], raw[0])
    return spark.range(n).select(F.col("id").alias("tid"), *[F.greatest(F.lit(0.0), F.least(F.lit(1.0), total * r / everything)).alias(f"a{m}") for m, r in enumerate(raw)])


def _scaled(df: DataFrame, d: int, by_max: bool = False) -> DataFrame:
    """Min-max scaled over all values, or divided by the largest."""
    names = [f"a{m}" for m in range(d)]
    low = F.least(*[F.min(c) for c in names]) if d > 1 else F.min(names[0])
    high = F.greatest(*[F.max(c) for c in names]) if d > 1 else F.max(names[0])
    edge = df.agg(low.alias("low"), high.alias("high")).first()
    low = 0.0 if by_max else edge.low or 0.0
    width = (edge.high or 1.0) - low or 1.0
    return df.withColumns({c: (F.col(c) - low) / width for c in names})


def lognormal(spark: SparkSession, n: int, d: int, seed: int = 1) -> DataFrame:
    return _scaled(_table(spark, n, d, lambda m: F.exp(normal(seed, F.col("id"), m))), d)


def pareto(spark: SparkSession, n: int, d: int, seed: int = 1, alpha: float = 10.0) -> DataFrame:
    return _scaled(_table(spark, n, d, lambda m: F.pow(uniform(seed, F.col("id"), m), F.lit(-1 / alpha)) - 1), d)


def zipf(spark: SparkSession, n: int, d: int, seed: int = 1, alpha: float = 1.8) -> DataFrame:
    return _scaled(_table(spark, n, d, lambda m: F.floor(F.pow(uniform(seed, F.col("id"), m), F.lit(-1 / (alpha - 1)))).cast("double")), d, True)


def block_scaled(spark: SparkSession, n: int, d: int, seed: int = 1, block: int = 1024) -> DataFrame:
    """Uniform values times a factor that rows of a block share."""
    factor = F.abs(normal(seed, F.floor(F.col("id") / block), F.lit(-1)))
    return _scaled(_table(spark, n, d, lambda m: factor * uniform(seed + 1, F.col("id"), m)), d)


def told_apart(df: DataFrame, keys, attrs, seed: int = 1) -> DataFrame:
    """Attributes times a random factor just above 1, so that equal values differ."""
    return df.withColumns({a: F.col(a) * (1 + uniform(seed, *[F.col(k) for k in keys], F.lit(i)) / 1e6) for i, a in enumerate(attrs)})
