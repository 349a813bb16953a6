"""Dominance and skylines. A row dominates another if it is no worse in any attribute and better in one; equal rows don't."""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..relation import Relation, checked, settle
from .ranking import median_parts

#: Candidates up to which the last comparison is a broadcast; above that, blocks of so many meet in pairs.
LAST = 50_000
#: Rows that a kernel compares with the confirmed ones at once, and bytes of one comparison.
CHUNK, CELLS = 512, 1 << 22
#: Rows of the best sums that every task starts from.
PRUNERS = 64


def dominates(a: str, b: str, attrs, largest: bool = True) -> Column:
    """Whether alias a dominates alias b."""
    pairs = [(F.col(f"{a}.{x}"), F.col(f"{b}.{x}")) for x in attrs]
    if not largest:
        pairs = [(y, x) for x, y in pairs]
    return reduce(lambda p, q: p & q, [x >= y for x, y in pairs]) & reduce(lambda p, q: p | q, [x > y for x, y in pairs])


def beaten(values: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Which rows (larger is better) some row of window dominates. The window is read from its front, in pieces that double; rows that
    are beaten drop out."""
    out = np.zeros(len(values), bool)
    left, at, piece = np.arange(len(values)), 0, 64
    while at < len(window) and len(left):
        piece = max(1, min(piece, CELLS // max(1, len(left))))
        w, v = window[at : at + piece], values[left]
        ge = np.ones((len(v), len(w)), bool)
        gt = np.zeros((len(v), len(w)), bool)
        for m in range(values.shape[1]):
            a, b = w[None, :, m], v[:, None, m]
            ge &= a >= b
            gt |= a > b
        hit = (ge & gt).any(1)
        out[left[hit]] = True
        left, at, piece = left[~hit], at + piece, piece * 2
    return out


def local_rows(values: np.ndarray, pruners: np.ndarray | None = None) -> np.ndarray:
    """Which rows (larger is better) neither another row nor a pruner dominates. Rows come in the order of their sums, a block at a
    time: against the confirmed ones, then against the block's own."""
    order = np.argsort(-values.sum(1), kind="stable")
    if pruners is not None and len(pruners):
        order = order[~beaten(values[order], pruners)]
    kept = np.empty(0, order.dtype)
    window = np.empty((0, values.shape[1]))
    for at in range(0, len(order), CHUNK):
        part = order[at : at + CHUNK]
        part = part[~beaten(values[part], window)]
        part = part[~beaten(values[part], values[part])]
        kept = np.concatenate((kept, part))
        window = np.concatenate((window, values[part]))
    # Equal sums by rounding can hide a dominator that came later.
    sums = values[kept].sum(1)
    near = np.zeros(len(kept), bool)
    if len(kept) > 1:
        near[1:] = sums[:-1] - sums[1:] <= 1e-12 * np.abs(values[kept]).sum(1).max()
        near[:-1] |= near[1:]
    if near.any():
        kept = np.concatenate((kept[~near], kept[near][~beaten(values[kept[near]], values[kept[near]])]))
    out = np.zeros(len(values), bool)
    out[kept] = True
    return out


def _matrix(table, attrs, sign: float) -> np.ndarray:
    return sign * np.column_stack([table.column(a).to_numpy() for a in attrs])


def _local(names: list[str], attrs, sign: float, pruners: np.ndarray | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def reduced():
            table = pa.concat_tables(held)
            return table.filter(pa.array(local_rows(_matrix(table, attrs, sign), pruners))) if table.num_rows else table

        kept = 0
        for batch in batches:  # memory holds the skyline so far and about as many rows more
            own = pa.Table.from_batches([batch])
            if own.num_rows:
                values = _matrix(own, attrs, sign)
                own = own.filter(pa.array(~beaten(values, pruners) if pruners is not None and len(pruners) else np.ones(len(values), bool)))
            held.append(own)
            rows += own.num_rows
            if rows > max(1 << 15, 2 * kept):
                held = [reduced()]
                rows = kept = held[0].num_rows
        if held:
            yield from reduced().select(names).combine_chunks().to_batches()

    return run


def _pair(attrs, sign: float):
    """applyInArrow of two cogroups: the rows of the first that a row of the second dominates."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.select(["_id"]).slice(0, 0)
        window = _matrix(right, attrs, sign)
        window = window[np.argsort(-window.sum(1))]
        return left.select(["_id"]).filter(pa.array(beaten(_matrix(left, attrs, sign), window)))

    return run


def _among(found: DataFrame, n: int, attrs, sign: float) -> DataFrame:
    """Rows of found that no other row of it dominates. The rows are dealt to blocks and every pair of blocks is a task, so that none
    holds more than two blocks whatever their number."""
    blocks = -(-n // LAST)
    rows = settle(found.withColumn("_id", F.monotonically_increasing_id()).withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.select("_id", *attrs, F.col("_block").alias("_i"), other.alias("_j"))
    right = rows.select(*attrs, F.col("_block").alias("_j"), other.alias("_i"))
    lost = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(_pair(attrs, sign), "_id bigint")
    lost = settle(lost.distinct())
    return rows.join(checked(lost, lost.count()), "_id", "left_anti").drop("_id", "_block")


def pruning_rows(r: Relation, n: int = PRUNERS, largest: bool = True) -> DataFrame:
    """The n rows of the best sums."""
    total = reduce(lambda a, b: a + b, [F.col(a) for a in r.attrs])
    return r.df.withColumn("_sum", total).orderBy(F.desc("_sum") if largest else F.asc("_sum"), *r.keys).limit(n).drop("_sum")


def skyline(r: Relation, largest: bool = True, phases: list | None = None) -> DataFrame:
    """Rows that no other row dominates: rows that some of the best sums dominate go first, each task finds its own skyline, then tasks
    are merged as long as that helps, and the candidates left are compared, by broadcast or block by block.

    phases, if given, takes (phase, seconds, rows left) of each."""
    names, sign = r.columns(), 1.0 if largest else -1.0
    rows = r.df.select(*names)
    began = time.perf_counter()

    def done(phase: str, n: int) -> None:
        nonlocal began
        if phases is not None:
            phases.append((phase, time.perf_counter() - began, n))
        began = time.perf_counter()

    best = pruning_rows(r, largest=largest).select(*r.attrs).toArrow()
    pruners = _matrix(best, r.attrs, sign) if best.num_rows else None
    done("prefilter", best.num_rows)
    found = settle(rows.mapInArrow(_local(names, r.attrs, sign, pruners), rows.schema))
    n, before, tasks = found.count(), None, 64
    done("local", n)
    while n > LAST and tasks > 4 and (before is None or n < 0.8 * before):
        before, tasks = n, tasks // 2
        found = settle(found.repartition(tasks).mapInArrow(_local(names, r.attrs, sign), rows.schema))
        n = found.count()
        done("merge", n)
    if n > LAST:
        found = settle(_among(found, n, r.attrs, sign))
        done("pairs", n)
        return found
    return found.alias("b").join(F.broadcast(found.alias("a")), dominates("a", "b", r.attrs, largest), "left_anti")


def prefilter(r: Relation, pruners: int = 8, largest: bool = True) -> DataFrame:
    """Rows that none of the rows of the best sums dominates: a superset of the skyline, by a constant-size broadcast."""
    best = pruning_rows(r, pruners, largest)
    return r.df.alias("b").join(F.broadcast(best.alias("a")), dominates("a", "b", r.attrs, largest), "left_anti")


def dominance_pairs(r: Relation, masked: bool = False) -> DataFrame:
    """(better, worse) by key. masked: rows meet only where the bits of the median partition allow it (a dominator has every bit that
    the dominated row has), by a join on the masks that are compatible, of which there are 3^d at most."""
    test = dominates("a", "b", r.attrs)
    out = [F.col(f"a.{r.keys[0]}").alias("better"), F.col(f"b.{r.keys[0]}").alias("worse")]
    if not masked:
        return r.df.alias("a").join(r.df.alias("b"), test).select(*out)
    rows = settle(median_parts(r))
    held = rows.select("mask").distinct()
    fits = held.select(F.col("mask").alias("over")).crossJoin(F.broadcast(held.select(F.col("mask").alias("under")))).where("(over & under) = under")  # masks only
    above = rows.join(F.broadcast(fits), F.col("mask") == F.col("over"))
    return above.alias("a").join(rows.alias("b"), (F.col("a.under") == F.col("b.mask")) & test).select(*out)


def dominance_class(r: Relation, pivot: dict) -> DataFrame:
    """How each row relates to a pivot row: dominates, dominated, equal or neither."""
    ge = reduce(lambda p, q: p & q, [F.col(a) >= F.lit(float(pivot[a])) for a in r.attrs])
    le = reduce(lambda p, q: p & q, [F.col(a) <= F.lit(float(pivot[a])) for a in r.attrs])
    return r.df.select(*r.keys, F.when(ge & le, "equal").when(ge, "dominates").when(le, "dominated").otherwise("neither").alias("relation"))


def _peel(names: list[str], attrs, most: int | None, number: bool):
    """mapInArrow: the rows of a task's own first `most` layers, with their number as `layer` if number is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, kept = [], 0, 0

        def peeled() -> pa.Table:
            table = pa.concat_tables(held)
            values = _matrix(table, attrs, 1.0)
            layer = np.full(table.num_rows, -1)
            left, n = np.arange(table.num_rows), 0
            while len(left) and n != most:
                top = local_rows(values[left])
                layer[left[top]] = n
                left, n = left[~top], n + 1
            return table.append_column("layer", pa.array(layer, pa.int32())).filter(pa.array(layer >= 0))

        for batch in batches:  # memory holds the layers so far and about as many rows more
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if most is not None and rows > max(1 << 15, 2 * kept):
                held = [peeled().select(names)]
                rows = kept = held[0].num_rows
        if held:
            out = peeled()
            yield from (out if number else out.select(names)).combine_chunks().to_batches()

    return run


def layers(r: Relation, most: int | None = None) -> DataFrame:
    """Rows with layer: 0 for the skyline, then that of the rest, and so on; with most, rows beyond so many layers have the last
    number, and one pass leaves the rows that are in the first layers of their task, which hold those of all. What is left is
    layered in one task if it is few rows, else layer by layer, each written before the next is looked for."""
    names = [*r.columns(), "_row"]
    rows = settle(r.df.select(*r.columns()).withColumn("_row", F.monotonically_increasing_id()))
    left = rows if most is None else settle(rows.mapInArrow(_peel(names, r.attrs, most, False), rows.schema))
    if left.count() <= LAST:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema) + ", layer int"
        found = settle(left.repartition(1).mapInArrow(_peel(names, r.attrs, most, True), schema))
    else:
        out, n = [], 0
        while n != most and not left.isEmpty():
            top = settle(skyline(Relation(left, ("_row",), r.attrs)).select("_row"))
            out.append(settle(left.join(checked(top, top.count()), "_row", "left_semi").withColumn("layer", F.lit(n))))
            left = settle(left.join(checked(top, top.count()), "_row", "left_anti"))
            n += 1
        found = reduce(DataFrame.unionByName, out)
    if most is not None:
        done = found.select("_row")
        found = found.unionByName(rows.join(checked(done, done.count()), "_row", "left_anti").withColumn("layer", F.lit(most)))
    return found.drop("_row")


def dominance_tests(r: Relation, largest: bool = True) -> DataFrame:
    """(phase, rows, tests): the rows that each phase of the skyline leaves, and the comparisons that finding them among themselves
    takes at most."""
    phases: list = []
    final = skyline(r, largest, phases).count()
    rows = [(name, n, n * max(0, n - 1)) for name, _, n in phases] + [("skyline", final, final * max(0, final - 1))]
    return r.df.sparkSession.createDataFrame(rows, "phase string, rows bigint, tests bigint")
