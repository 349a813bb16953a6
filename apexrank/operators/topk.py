"""Top-k by weighted score: full scans, threshold and pruning operators, batches. Ties go by key."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import score, score_array
from ..relation import Relation, checked, settle
from .ranking import positions

#: Share of the rows whose k-th score is the floor that pruning operators and batches start from.
SHARE = 0.01


@dataclass(frozen=True)
class TopKQuery:
    """The k best rows by the sum of weights times attributes. k is 1 or more; weights are finite and not negative, one an attribute."""

    k: int
    attrs: tuple[str, ...]
    weights: tuple[float, ...]

    def __post_init__(self):
        if self.k < 1:
            raise ValueError(f"k is {self.k}, less than 1")
        if not self.attrs or len(set(self.attrs)) != len(self.attrs) or len(self.attrs) != len(self.weights):
            raise ValueError(f"{len(self.weights)} weights for the attributes {self.attrs}")
        if not all(math.isfinite(w) and w >= 0 for w in self.weights):
            raise ValueError(f"a weight of {self.weights} is negative or not finite")

    def check(self, r: Relation) -> None:
        unknown = [a for a in self.attrs if a not in r.attrs]
        if unknown:
            raise ValueError(f"unknown attributes {unknown}; the relation has {list(r.attrs)}")


def top(df: DataFrame, keys, k: int, by: str = "score") -> DataFrame:
    """The k best rows; a heap in each task and one merge."""
    return df.orderBy(F.desc(by), *keys).limit(k)


def scan(r: Relation, q: TopKQuery) -> DataFrame:
    """Full scan of the queried columns."""
    q.check(r)
    return top(r.df.select(*r.keys, score(q.attrs, q.weights).alias("score")), r.keys, q.k)


def scan_array(r: Relation, q: TopKQuery) -> DataFrame:
    """Full scan over an array of attributes."""
    q.check(r)
    rows = r.df.select(*r.keys, F.array(*q.attrs).alias("values"))
    return top(rows.select(*r.keys, score_array(F.col("values"), q.weights).alias("score")), r.keys, q.k)


def by_score(r: Relation, value: Column, k: int) -> DataFrame:
    """Full scan by any score."""
    return top(r.df.select(*r.keys, value.alias("score")), r.keys, k)


def kth(df: DataFrame, by: str, k: int) -> DataFrame:
    """One row: the k-th largest value (the least, if there are fewer)."""
    return df.select(by).orderBy(F.desc(by)).limit(k).agg(F.min(by).alias("threshold"))


def kth_approx(df: DataFrame, by: str, k: int, accuracy: int = 10_000) -> DataFrame:
    """The k-th largest value by a quantile sketch."""
    n = df.count()
    return df.agg(F.percentile_approx(by, max(0.0, 1 - k / max(n, 1)), accuracy).alias("threshold"))


def two_stage(r: Relation, q: TopKQuery, groups: int = 64) -> DataFrame:
    """The k best of each group of rows, then of those."""
    q.check(r)
    rows = r.df.select(*r.keys, score(q.attrs, q.weights).alias("score"), F.pmod(F.xxhash64(*r.keys), F.lit(groups)).alias("g"))
    best = rows.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), *r.keys))).where(F.col("rn") <= q.k)
    return top(best.select(*r.keys, "score"), r.keys, q.k)


def kth_of_groups(r: Relation, q: TopKQuery, groups: int = 64) -> DataFrame:
    """The k-th score of all, from the k best of each group."""
    return two_stage(r, q, groups).agg(F.min("score").alias("threshold"))


def _value(df: DataFrame, k: int, by: str) -> float:
    """The k-th largest, or minus infinity if there are fewer than k."""
    row = df.select(by).orderBy(F.desc(by)).limit(k).agg(F.count("*").alias("n"), F.min(by).alias("t")).first()
    return row.t if row.n >= k else float("-inf")


def floor(r: Relation, q: TopKQuery, share: float = SHARE) -> float:
    """A score that no answer is below: the k-th of a sample's rows, or minus infinity if the sample has fewer."""
    return _value(r.df.sample(share, seed=7).select(score(q.attrs, q.weights).alias("score")), q.k, "score")


@dataclass(frozen=True)
class Depth:
    rows: DataFrame
    depth: int | None
    evaluated: int


def ranked_lists(r: Relation) -> DataFrame:
    """Keys, attributes and their places, written: several queries may search it."""
    return settle(positions(r).select(*r.columns(), *[f"r{m}" for m in range(len(r.attrs))]))


def threshold_depth(r: Relation, q: TopKQuery, lists=None, ranked: DataFrame | None = None) -> Depth:
    """Sorted access in step over the lists of the queried attributes: the least depth at which the k-th score among the rows seen
    reaches the score of the values read last. lists: attributes whose values are added up for that instead, those that are not
    queried with a weight of 1. Depths are tried in doublings over the ranked table, then bisected within the last. ranked:
    ranked_lists(r), if it is there already."""
    q.check(r)
    every = lists or q.attrs
    r = r.over(r.attrs if ranked is not None else dict.fromkeys([*q.attrs, *every]))
    at = {a: f"r{r.attrs.index(a)}" for a in r.attrs}
    weight = dict(zip(q.attrs, q.weights, strict=True))
    seen_at = [F.col(at[a]) for a in q.attrs]
    ranked = ranked_lists(r) if ranked is None else ranked
    ranked = ranked.withColumns({"minpos": F.least(*seen_at) if len(seen_at) > 1 else seen_at[0], "score": score(q.attrs, q.weights)})
    n = ranked.count()

    def stops(rows: DataFrame, depth: int) -> bool:
        values = ranked.where(reduce(lambda a, b: a | b, [F.col(at[a]) == depth for a in every])).agg(*[F.max(F.when(F.col(at[a]) == depth, F.col(a))).alias(a) for a in every])
        row = values.first()
        limit = reduce(lambda x, y: x + y, [weight.get(a, 1.0) * row[a] for a in every])
        return rows.where(F.col("minpos") <= depth).where(F.col("score") >= limit).limit(q.k).count() >= q.k

    low, high = -1, max(q.k - 1, 0)
    while high < n - 1 and not stops(ranked, high):
        low, high = high, 2 * high + 1
    if high >= n - 1:
        high = n - 1
        if n == 0 or not stops(ranked, high):
            return Depth(ranked, None, n)
    near = settle(ranked.where(F.col("minpos") <= high))
    while high - low > 1:
        mid = (low + high) // 2
        if stops(near, mid):
            high = mid
        else:
            low = mid
    seen = near.where(F.col("minpos") <= high)
    return Depth(seen, high, seen.count())


def subspace_accesses(r: Relation, k: int, size: int) -> DataFrame:
    """(subspaces, mean, least): rows that the threshold operator sees, over all subspaces of so many attributes. Lists are ranked once."""
    ranked = ranked_lists(r)
    found = [threshold_depth(r, TopKQuery(k, c, (1.0,) * size), ranked=ranked).evaluated for c in combinations(r.attrs, size)]
    return r.df.sparkSession.createDataFrame([(len(found), sum(found) / len(found), min(found))], "subspaces bigint, mean double, least bigint")


def threshold(r: Relation, q: TopKQuery) -> DataFrame:
    return top(threshold_depth(r, q).rows.select(*r.keys, "score"), r.keys, q.k)


def seen_depth(r: Relation, q: TopKQuery) -> Depth:
    """The least depth at which k rows have been seen in every list; the k best rows were all seen in some list by then."""
    q.check(r)
    ranked = settle(positions(r.over(q.attrs)).select(*r.keys, "minpos", "maxpos", score(q.attrs, q.weights).alias("score")))
    full = ranked.select("maxpos").orderBy("maxpos").limit(q.k).agg(F.max("maxpos").alias("d"), F.count("*").alias("n")).first()
    depth = full.d if full.n >= q.k else None
    seen = ranked if depth is None else ranked.where(F.col("minpos") <= depth)
    return Depth(seen, depth, seen.count())


def seen(r: Relation, q: TopKQuery) -> DataFrame:
    return top(seen_depth(r, q).rows.select(*r.keys, "score"), r.keys, q.k)


def by_largest_attribute(r: Relation, q: TopKQuery) -> DataFrame:
    """Attributes in the order of their largest weighted value; after each, rows whose partial score cannot reach the floor with all the
    rest at their largest are dropped. The floor and the largest values come first, then one pass tests all bounds."""
    q.check(r)
    row = r.df.agg(*[F.max(a).alias(a) for a in q.attrs]).first()
    weight = dict(zip(q.attrs, q.weights, strict=True))
    peak = {a: weight[a] * (row[a] or 0.0) for a in q.attrs}
    order = sorted(q.attrs, key=lambda a: (-peak[a], a))
    least = floor(r, q)
    rows, partial = r.df, F.lit(0.0)
    if least > float("-inf"):
        for i, a in enumerate(order[:-1]):
            partial = partial + F.col(a) * weight[a]
            rest = sum(peak[b] for b in order[i + 1 :])
            slack = 1e-12 * sum(abs(p) for p in peak.values())  # other sums than the score's, so other rounding
            rows = rows.where(partial + F.lit(rest + slack + 1e-12 * abs(least)) >= F.lit(least))
    return top(rows.select(*r.keys, score(q.attrs, q.weights).alias("score")), r.keys, q.k)


def by_suffix(r: Relation, q: TopKQuery, early: bool = False) -> DataFrame:
    """A row's weighted values from the largest down; after each, the partial score and the last value added, taken for all the rest,
    bound the score, and rows below the floor are dropped. early: no more rounds than the first, after which few rows are left."""
    q.check(r)
    least, n = floor(r, q), len(q.attrs)
    rows = r.df
    if least > float("-inf"):
        slack = F.lit(1e-12 * abs(least))
        own = [F.col(a) * F.lit(float(w)) for a, w in zip(q.attrs, q.weights, strict=True)]
        best = F.greatest(*own) if n > 1 else own[0]
        rows = rows.where(best * float(n) + F.abs(best) * 1e-12 * n + slack >= F.lit(least))
        if not early and n > 2:

            def reaches(v: Column) -> Column:  # v: the values from the least up
                at = lambda i: F.get(v, F.lit(n - 1 - i))
                partial, held = at(0), F.lit(True)
                for i in range(1, n - 1):
                    partial = partial + at(i)
                    held = held & (partial + at(i) * float(n - 1 - i) + F.abs(at(0)) * 1e-12 * n + slack >= F.lit(least))
                return held

            rows = rows.where(F.transform(F.array(F.sort_array(F.array(*own))), reaches)[0])  # sorted once a row
    return top(rows.select(*r.keys, score(q.attrs, q.weights).alias("score")), r.keys, q.k)


def prune_step(r: Relation, q: TopKQuery) -> DataFrame:
    """One round of the suffix bound: the rows that survive the first two values."""
    rows = r.df.withColumn("_v", F.sort_array(F.array(*q.attrs), asc=False)).select(*r.keys, F.get("_v", F.lit(0)).alias("partial"), F.get("_v", F.lit(1)).alias("next"))
    cut = F.broadcast(kth(rows, "partial", q.k))
    return rows.crossJoin(cut).where(F.col("partial") + F.col("next") * float(len(q.attrs) - 1) >= F.col("threshold")).select(*r.keys, (F.col("partial") + F.col("next")).alias("partial"))


# Batches.


def query_table(spark, queries: dict[int, TopKQuery]) -> DataFrame:
    return spark.createDataFrame([(i, q.k, list(q.attrs), [float(w) for w in q.weights]) for i, q in queries.items()], "qid int, k int, attrs array<string>, weights array<double>")


def distinct_queries(queries: dict[int, TopKQuery]) -> tuple[dict[int, TopKQuery], dict[int, int]]:
    """The unlike queries of a batch by the least qid that asks them, and each qid's."""
    first: dict[TopKQuery, int] = {}
    for i in sorted(queries):
        first.setdefault(queries[i], i)
    return {i: q for q, i in first.items()}, {i: first[q] for i, q in queries.items()}


def _best(r: Relation, queries: dict[int, TopKQuery], floor: dict[int, float]) -> DataFrame:
    """(qid, k, rank, keys.., score) in one scan. Rows below every floor go while scores are plain columns; of others, only the scores
    that reach their floor become rows, and the per-query limit is applied before the shuffle."""
    ids = list(queries)
    least = [floor.get(i, float("-inf")) for i in ids]
    scores = F.array(*[score(q.attrs, q.weights) for q in queries.values()])
    rows = r.df.select(*r.keys, F.posexplode(scores).alias("at", "score"))
    of = lambda values: F.get(F.lit(values), F.col("at"))
    rows = rows.where(F.col("score") >= of(least)).select(*r.keys, of(ids).alias("qid"), of([q.k for q in queries.values()]).alias("k"), "score")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), *r.keys)))
    most = max((q.k for q in queries.values()), default=0)
    return ranked.where(F.col("rank") <= most).where(F.col("rank") <= F.col("k")).select("qid", "k", "rank", *r.keys, "score")


def floors(r: Relation, queries: dict[int, TopKQuery], share: float | None = SHARE) -> dict[int, float]:
    """For each query a score that no answer of it is below: the k-th of a sample's rows (share None: of all rows of r), or minus
    infinity if there are fewer."""
    sample = r if share is None else r.using(r.df.sample(share, seed=7))
    found = _best(sample, queries, {}).groupBy("qid", "k").agg(F.count("*").alias("n"), F.min("score").alias("score")).where("n = k")
    held = {x.qid: x.score for x in found.collect()}  # a row a query
    return {i: held.get(i, float("-inf")) for i in queries}


def batch(r: Relation, queries: dict[int, TopKQuery], floor: dict[int, float] | None = None) -> DataFrame:
    """(qid, rank, keys.., score) of all queries (of a number the caller sets) in one shared scan, behind a scan of a sample for their
    floors. Equal queries are answered once."""
    for q in queries.values():
        q.check(r)
    if not queries:
        return r.df.select(F.lit(0).alias("qid"), F.lit(0).alias("rank"), *r.keys, F.lit(0.0).alias("score")).limit(0)
    own, of = distinct_queries(queries)
    found = _best(r, own, floors(r, own) if floor is None else floor).drop("k")
    if len(own) < len(queries):
        names = pa.table({"qid": pa.array(list(of.values()), pa.int32()), "asked": pa.array(list(of), pa.int32())})
        found = found.join(checked(r.df.sparkSession.createDataFrame(names), len(of)), "qid").drop("qid").withColumnRenamed("asked", "qid")
    return found.select("qid", "rank", *r.keys, "score")


def workload(attrs, n: int, k: int, size: int | None = None, weights=None, seed: int = 1) -> dict[int, TopKQuery]:
    """n queries over suffixes of the attributes: of a random number of them from 2 on, or of `size`."""
    rng = random.Random(seed)
    weights = dict(zip(attrs, weights or (1.0,) * len(attrs), strict=True))
    out = {}
    for i in range(n):
        own = tuple(attrs[-(size or rng.randint(2, len(attrs))) :])
        out[i] = TopKQuery(k, own, tuple(weights[a] for a in own))
    return out


def all_subspaces(attrs, k: int) -> dict[int, TopKQuery]:
    """Every subset of two attributes or more."""
    subsets = [c for q in range(2, len(attrs) + 1) for c in combinations(attrs, q)]
    return {i: TopKQuery(k, c, (1.0,) * len(c)) for i, c in enumerate(subsets)}


def nested_sweep(attrs, ks, prefix: bool = False, step: int = 1) -> dict[int, TopKQuery]:
    """Suffixes (or prefixes) of two attributes or more, for each k."""
    out = {}
    for k in ks:
        for q in range(2, len(attrs) + 1, step):
            own = tuple(attrs[:q] if prefix else attrs[-q:])
            out[len(out)] = TopKQuery(k, own, (1.0,) * q)
    return out


def partitioned(r: Relation, q: TopKQuery, parted: DataFrame) -> DataFrame:
    """The k best of each partition (column part), merged. A row below the floor is no answer of any partition's that counts."""
    q.check(r)
    least = floor(r.using(parted), q)
    rows = parted.select("part", *r.keys, score(q.attrs, q.weights).alias("score")).where(F.col("score") >= F.lit(least))
    best = rows.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("score"), *r.keys))).where(F.col("rn") <= q.k)
    return top(best.select(*r.keys, "score"), r.keys, q.k)
