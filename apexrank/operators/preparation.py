"""Real-data preparation, statistics and result checks."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..relation import Relation, checked, settle
from .ranking import ranks


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns by name, cast to numbers."""
    return df.select(*[F.col(c).cast("double").alias(n) for c, n in columns.items()])


def union_project(frames, columns: dict[str, str]) -> DataFrame:
    """The same projection of several inputs, one after the other."""
    return reduce(DataFrame.unionByName, [project(f, columns) for f in frames])


def only(df: DataFrame, column: str, values) -> DataFrame:
    return df.where(F.col(column).isin(*values))


def within(df: DataFrame, column: str, low: float, high: float, scale: float = 1.0) -> DataFrame:
    """Rows whose value, divided by scale, is in [low, high); the column holds the quotient."""
    return df.withColumn(column, F.col(column) / scale).where((F.col(column) >= low) & (F.col(column) < high))


def window_pivot(df: DataFrame, key: str, order, value: str, d: int) -> DataFrame:
    """(key, g, a0..): each key's values in order, d at a time as one row; an incomplete last row is dropped."""
    rows = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
    cells = [F.max(F.when(F.col("_n") % d == m, F.col(value))).alias(f"a{m}") for m in range(d)]
    full = rows.groupBy(key, F.floor(F.col("_n") / d).cast("bigint").alias("g")).agg(*cells, F.count("*").alias("_size"))
    return full.where(F.col("_size") == d).drop("_size")


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    """(bin, n) of values in bins of a width."""
    return df.groupBy(F.floor(F.col(column) / width).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def spearman(r: Relation, digits: int = 6) -> DataFrame:
    """(i, j, rho) of every pair of attributes: the correlation of average ranks. A value's average rank is the mean of the places
    of its rows; places count from the largest in every list, which leaves correlations as they are. The table of values is
    broadcast if its counted rows allow, so a hot value meets its rows without a shuffle."""
    df = settle(ranks(r))
    for m, a in enumerate(r.attrs):
        mean = settle(df.groupBy(a).agg(F.avg(f"r{m}").alias(f"_q{m}")))
        df = df.join(checked(mean, mean.count()), a)
    pairs = list(combinations(range(len(r.attrs)), 2))
    row = df.agg(*[F.corr(f"_q{i}", f"_q{j}").alias(f"c{i}_{j}") for i, j in pairs])
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.round(f"c{i}_{j}", digits).alias("rho")) for i, j in pairs])
    return row.select(F.explode(each).alias("e")).select("e.*")


def missing(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Rows of result a whose keys result b lacks."""
    return a.join(b.select(*keys), list(keys), "left_anti")


def differences(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """(side, keys..) of rows that only one of two results has, whatever their order; a repeated key counts as often as it occurs."""
    a, b = a.select(*keys), b.select(*keys)
    return a.exceptAll(b).select(F.lit("a").alias("side"), *keys).unionByName(b.exceptAll(a).select(F.lit("b").alias("side"), *keys))


def same_threshold(a: DataFrame, b: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """One row: both k-th scores, and whether they agree."""
    one = a.agg(F.min("score").alias("a")).crossJoin(F.broadcast(b.agg(F.min("score").alias("b"))))
    return one.withColumn("same", F.abs(F.col("a") - F.col("b")) <= tolerance)
