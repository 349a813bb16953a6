"""Scalar expressions and column-wise preparation of a relation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..relation import Relation


def score(attrs, weights=None) -> Column:
    """The weighted sum, added from the left."""
    weights = weights or [1.0] * len(attrs)
    return reduce(lambda a, b: a + b, [F.col(a) * F.lit(float(w)) for a, w in zip(attrs, weights, strict=True)])


def score_array(values: Column, weights) -> Column:
    """The same over an array column."""
    products = F.zip_with(values, F.array(*[F.lit(float(w)) for w in weights]), lambda v, w: v * w)
    return F.aggregate(products, F.lit(0.0), lambda a, b: a + b)


def running_mean(attrs) -> Column:
    """(..((0 + x0) / q + x1) / q ..) / q: a mean taken inside the loop, which depends on the order."""
    q = float(len(attrs))
    return reduce(lambda a, b: (a + F.col(b)) / q, attrs, F.lit(0.0))


def limits(r: Relation) -> tuple[list[float], list[float]]:
    """Least and largest value of each attribute."""
    row = r.df.agg(*[f(a).alias(f"{f.__name__}_{a}") for a in r.attrs for f in (F.min, F.max)]).first()
    return [row[f"min_{a}"] for a in r.attrs], [row[f"max_{a}"] for a in r.attrs]


def normalized(r: Relation) -> Relation:
    """Attributes min-max scaled to [0, 1]; a constant one becomes 0. The limits are one aggregation, joined as a single row,
    so nothing waits for the driver."""
    edge = r.df.agg(*[f(a).alias(f"_{n}_{a}") for a in r.attrs for n, f in (("low", F.min), ("high", F.max))])
    rows = r.df.crossJoin(F.broadcast(edge))  # one row
    scaled = {a: F.coalesce(F.try_divide(F.col(a) - F.col(f"_low_{a}"), F.col(f"_high_{a}") - F.col(f"_low_{a}")), F.lit(0.0)) for a in r.attrs}
    return r.using(rows.withColumns(scaled).select(*r.df.columns))


def inverted(r: Relation) -> Relation:
    return r.using(r.df.withColumns({a: F.lit(1.0) - F.col(a) for a in r.attrs}))


def descending(attrs) -> Column:
    """A row's values from the largest to the least."""
    return F.sort_array(F.array(*attrs), asc=False)


def out_of_order(df: DataFrame, values: str) -> DataFrame:
    """Rows whose array is not in descending order."""
    v = F.col(values)
    return df.where(F.exists(F.sequence(F.lit(1), F.size(v) - 1), lambda i: F.get(v, i) > F.get(v, i - 1)) & (F.size(v) > 1))


def angles(attrs, shift: float = 1.1) -> list[Column]:
    """Hyperspherical coordinates of the shifted point, in degrees: one less than attributes."""
    x = [F.col(a) - F.lit(shift) for a in attrs]
    out, rest = [], None
    for m in reversed(range(len(x) - 1)):
        rest = x[m + 1] * x[m + 1] if rest is None else rest + x[m + 1] * x[m + 1]
        out.append(F.abs(F.degrees(F.atan(F.try_divide(F.sqrt(rest), x[m])))))
    return out[::-1]


def float_bits(value: Column) -> Column:
    """The 32 bits of a value as single precision, as an unsigned number: for values that are not negative, in the order of the values.
    No built-in function gives them, so an Arrow batch is viewed as integers."""

    @F.pandas_udf("bigint")
    def bits(values: pd.Series) -> pd.Series:
        return pd.Series(values.to_numpy(np.float32).view(np.uint32).astype(np.int64))

    return bits(value.cast("float"))


def value_range(attrs) -> Column:
    return F.greatest(*attrs) - F.least(*attrs)
