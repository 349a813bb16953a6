"""A block index and the two-phase plan that reads only blocks whose score bound reaches the k-th score of the leading ones."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import score
from ..operators.ranking import along, angle_parts, block_bounds, in_blocks, place, positions, starts
from ..operators.topk import TopKQuery, _value, batch, distinct_queries, floors, top
from ..relation import Relation, settle

#: Rows of each partition that the first phase scores at least.
LEADING = 1024
#: Partitions up to which the stretches to read are literals of the scan's filter; beyond, they are joined.
LITERAL = 512


@dataclass(frozen=True)
class BlockIndex:
    """data(part, at, keys.., a..), in files sorted by at, and bounds(part, block, n, first, last, t0..), a row a block: its first
    and last at, and the values that bound the blocks after it."""

    data: DataFrame
    bounds: DataFrame
    relation: Relation
    size: int

    def write(self, path: str) -> None:
        self.data.repartitionByRange("at").sortWithinPartitions("at").write.parquet(f"{path}/data")
        self.bounds.write.parquet(f"{path}/bounds")

    @classmethod
    def read(cls, spark, path: str, keys, attrs, size: int) -> BlockIndex:
        data = spark.read.parquet(f"{path}/data")
        return cls(data, spark.read.parquet(f"{path}/bounds"), Relation(data, tuple(keys), tuple(attrs)), size)


def build(r: Relation, size: int, layout: str = "range", layers: DataFrame | None = None) -> BlockIndex:
    """layout `range`: one partition, even blocks; `angle`: a partition for each combination of angle halves; `layer`: for each
    skyline layer, rows with it given as layers. Both tables are written, the data in the order of blocks, so that the
    statistics of files, row groups and pages tell which of them a query needs."""
    part = None
    if layout != "range":
        r = r.using(angle_parts(r) if layout == "angle" else layers.withColumn("part", F.col("layer").cast("int")))
        part = F.col("part")
    rows = positions(r, part).select("part", *r.columns(), "minpos", *[f"r{m}" for m in range(len(r.attrs))])
    table = settle(along(rows, ["part", "minpos", *r.keys], "at"))
    blocked = in_blocks(place(table, "at", starts(table, ["at"], "part")[0], "seq", "part"), size, layout == "range")
    bounds = settle(block_bounds(blocked, r, F.min("at").alias("first"), F.max("at").alias("last")))
    return BlockIndex(table.select("part", "at", *r.columns()), bounds, r, size)


def _stretches(index: BlockIndex, kept: DataFrame) -> DataFrame:
    """The rows of the blocks in kept (part, first, last), which are the leading ones of each partition. A stretch a partition is
    pushed down to the scan."""
    cuts = kept.groupBy("part").agg(F.min("first").alias("low"), F.max("last").alias("high"))
    rows = cuts.limit(LITERAL + 1).collect()
    if len(rows) <= LITERAL:
        return index.data.where(reduce(lambda a, b: a | b, [F.col("at").between(c.low, c.high) for c in rows], F.lit(False)))
    return index.data.join(cuts, "part").where("at between low and high").drop("low", "high")


def _leading(index: BlockIndex) -> DataFrame:
    return index.bounds.where(F.col("block") < -(-LEADING // index.size))


def _limits(index: BlockIndex, queries: dict[int, TopKQuery], floor: dict[int, float]) -> DataFrame:
    """The bounds of the blocks to read for any of the queries: the leading ones, and those whose predecessor's bound reaches the k-th
    leading score. The bound is added in the order of the score, so rounding can't put it below a score of its block."""
    places = {a: m for m, a in enumerate(index.relation.attrs)}
    reached = [score([f"t{places[a]}" for a in q.attrs], q.weights) >= F.lit(floor[i]) for i, q in queries.items()]
    after = index.bounds.select("part", (F.col("block") + 1).alias("block"), reduce(lambda a, b: a | b, reached).alias("reached"))
    kept = index.bounds.join(after, ["part", "block"], "left")
    return kept.where((F.col("block") < -(-LEADING // index.size)) | F.col("reached")).drop("reached")


def survivors(index: BlockIndex, q: TopKQuery) -> DataFrame:
    """(part, block, n, first, last, t0..) of the blocks to read."""
    q.check(index.relation)
    floor = _value(_stretches(index, _leading(index)).select(score(q.attrs, q.weights).alias("score")), q.k, "score")
    return _limits(index, {0: q}, {0: floor})


def read_rows(index: BlockIndex, q: TopKQuery, max_part: int | None = None) -> DataFrame:
    kept = survivors(index, q)
    return _stretches(index, kept if max_part is None else kept.where(F.col("part") < max_part))


def topk(index: BlockIndex, q: TopKQuery, max_part: int | None = None) -> DataFrame:
    """The same rows as a full scan. max_part: with the layer layout, k layers hold every answer."""
    rows = read_rows(index, q, max_part).select(*index.relation.keys, score(q.attrs, q.weights).alias("score"))
    return top(rows, index.relation.keys, q.k)


def topk_batch(index: BlockIndex, queries: dict[int, TopKQuery]) -> DataFrame:
    """(qid, rank, keys.., score) of all queries: one pass over the leading blocks for their floors, one over the blocks that any needs."""
    for q in queries.values():
        q.check(index.relation)
    if not queries:
        return batch(index.relation, queries)
    own, _ = distinct_queries(queries)
    floor = floors(index.relation.using(_stretches(index, _leading(index))), own, None)
    return batch(index.relation.using(_stretches(index, _limits(index, own, floor))), queries, floor)


def report(index: BlockIndex, q: TopKQuery) -> DataFrame:
    """(blocks, evaluated, rows, threshold): blocks and rows that the query reads, of how many, and its k-th score."""
    held = survivors(index, q).agg(F.count("*").alias("blocks"), F.sum("n").alias("evaluated"))
    every = index.bounds.agg(F.sum("n").alias("rows"))
    return held.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(topk(index, q).agg(F.min("score").alias("threshold"))))  # one row each
