"""Sorted lists, ranks, first-seen order, blocks and partitions of a relation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import angles
from ..relation import Relation, checked, settle

#: The low bits of a place along a sorted table: the row within its range; the range's number is above them.
ROW_BITS = 33


def along(df: DataFrame, order, name: str) -> DataFrame:
    """df in the order of these columns, range by range, with name: a number that grows along it.

    Ranges come from a sample of whole sort keys, so any type of key will do, rows of one hot value are parted by the keys behind it,
    and no range is more than its share. Their number is spark.sql.shuffle.partitions, less what adaptive execution merges."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())


def _range(at) -> Column:
    return F.shiftright(F.col(at), ROW_BITS)


def _row(at) -> Column:
    return F.col(at).bitwiseAND(F.lit((1 << ROW_BITS) - 1))


def starts(df: DataFrame, ats: list[str], part: str) -> list[DataFrame]:
    """For each column of along(): (part, range, start), which added to a row's number in its range gives its place (from 0) within its
    part. A row a range and part; the driver adds the counts up."""
    each = F.array(*[F.struct(F.lit(m).alias("m"), _range(at).alias("range"), _row(at).alias("row")) for m, at in enumerate(ats)])
    held = df.select(F.col(part).alias("part"), F.explode(each).alias("e")).groupBy("part", "e.m", "e.range").agg(F.min("e.row").alias("low"), F.count("*").alias("n"))
    rows = sorted(map(tuple, held.collect()), key=lambda x: (x[1], x[0], x[2]))
    out: list[list[tuple]] = [[] for _ in ats]
    before, last = 0, None
    for p, m, n_range, low, n in rows:
        before = before if last == (m, p) else 0
        out[m].append((p, n_range, before - low))
        before, last = before + n, (m, p)
    names = ("part", "range", "start")
    kinds = (pa.int64(), pa.int64(), pa.int64())
    tables = [pa.table({n: pa.array([x[i] for x in own], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))}) for own in out]
    return [checked(df.sparkSession.createDataFrame(t), t.num_rows) for t in tables]


def place(df: DataFrame, at: str, start: DataFrame, name: str, part: str) -> DataFrame:
    """df with name: its place, by the table that starts() gives for the column at."""
    own = start.select(F.col("part").alias("_part"), F.col("range").alias("_range"), "start")
    same = (F.col(part) == F.col("_part")) & (_range(at) == F.col("_range"))
    return df.join(own, same).withColumn(name, _row(at) + F.col("start")).drop("_part", "_range", "start")


def placed(df: DataFrame, orders: dict[str, list], part: str = "part") -> DataFrame:
    """df with a gapless place (from 0) within its part for each of the orders {name: columns}. A distributed sort an order; the rows,
    sorted by the last, are written once."""
    ats = {name: f"_at_{name}" for name in orders}
    for name, order in orders.items():
        df = along(df, [part, *order], ats[name])
    df = settle(df)
    for (name, at), start in zip(ats.items(), starts(df, list(ats.values()), part), strict=True):
        df = place(df, at, start, name, part).drop(at)
    return df


def ranks(r: Relation, part: Column | None = None, prefix: str = "r") -> DataFrame:
    """r.df with r0.. added: a row's place (from 0) in the list of each attribute, largest first, keys breaking ties; with part,
    within its partition (column `part`)."""
    df = r.df.withColumn("part", part.cast("int") if part is not None else F.lit(0))
    return placed(df, {f"{prefix}{m}": [F.desc(a), *r.keys] for m, a in enumerate(r.attrs)})


def rank_columns(r: Relation) -> list[str]:
    return [f"r{m}" for m in range(len(r.attrs))]


def sorted_lists(r: Relation) -> DataFrame:
    """(m, rank, keys.., value): every list in long form."""
    names = rank_columns(r)
    each = F.array(*[F.struct(F.lit(m).alias("m"), F.col(n).alias("rank"), F.col(a).alias("value")) for m, (n, a) in enumerate(zip(names, r.attrs, strict=True))])
    return ranks(r).select(*r.keys, F.explode(each).alias("e")).select("e.m", "e.rank", *r.keys, "e.value")


def positions(r: Relation, part: Column | None = None) -> DataFrame:
    """Ranks, and minpos and maxpos: the first and the last list position of a row."""
    names = rank_columns(r)
    pick = (lambda f: f(*names)) if len(names) > 1 else (lambda f: F.col(names[0]))
    return ranks(r, part).withColumns({"minpos": pick(F.least), "maxpos": pick(F.greatest)})


def position_order(r: Relation) -> DataFrame:
    """Each row's attributes by its position in their lists, the first of ties first."""
    names = rank_columns(r)
    pairs = F.array(*[F.struct(F.col(n).alias("r"), F.lit(m).alias("m")) for m, n in enumerate(names)])
    return ranks(r).select(*r.keys, F.transform(F.sort_array(pairs), lambda p: p["m"]).alias("order"))


def first_seen(r: Relation) -> DataFrame:
    """Rows with seq, their place when lists are read in turn, one row of all lists after the other."""
    names = rank_columns(r)
    who = F.array_position(F.array(*names), F.col("minpos")) - 1
    seen = positions(r).withColumn("first_list", who.cast("int"))
    return placed(seen, {"seq": ["minpos", "first_list", *r.keys]})


def in_blocks(df: DataFrame, size: int, even: bool) -> DataFrame:
    """Rows with seq (a place within its part) with block added, of at most `size` rows; even: blocks of a part differ by as little as
    ceilings allow."""
    if not even:
        return df.withColumn("block", F.floor(F.col("seq") / size).cast("int"))
    total = df.groupBy("part").agg(F.count("*").alias("_n"))
    each = F.ceil(F.col("_n") / F.ceil(F.col("_n") / size))
    return df.join(checked(total, total.count()), "part").withColumn("block", F.floor(F.col("seq") / each).cast("int")).drop("_n")


def blocks(r: Relation, size: int, part: Column | None = None, even: bool = False) -> DataFrame:
    """Rows with part, minpos, seq (place by minpos within the part) and block; see in_blocks()."""
    return in_blocks(placed(positions(r, part), {"seq": ["minpos", *r.keys]}), size, even)


def block_bounds(blocked: DataFrame, r: Relation, *more: Column) -> DataFrame:
    """(part, block, n, t0.., more): the value in each list at the block's largest minpos. Any row of a later block has no larger value."""
    edge = settle(blocked.groupBy("part", "block").agg(F.count("*").alias("n"), F.max("minpos").alias("p"), *more))
    each = F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"r{m}").alias("p"), F.col(a).alias("v")) for m, a in enumerate(r.attrs)])
    held = blocked.select("part", F.explode(each).alias("e")).select("part", "e.*").join(checked(edge.select("part", "p", "block"), edge.count()), ["part", "p"])
    found = held.groupBy("part", "block").agg(*[F.max(F.when(F.col("m") == m, F.col("v"))).alias(f"t{m}") for m in range(len(r.attrs))])
    return edge.drop("p").join(found, ["part", "block"])


# Partitions.


def _key_order(r: Relation) -> DataFrame:
    return placed(r.df.withColumn("part", F.lit(0)), {"seq": list(r.keys)})


def range_parts(r: Relation, parts: int) -> DataFrame:
    """Rows with part: contiguous ranges of near-equal rows in key order."""
    rows = _key_order(r)
    return rows.withColumn("part", F.floor(F.col("seq") * parts / F.lit(max(1, rows.count()))).cast("int")).drop("seq")


def round_robin_parts(r: Relation, parts: int) -> DataFrame:
    """Rows with part: dealt in turn, in key order."""
    return _key_order(r).withColumn("part", F.pmod("seq", F.lit(parts)).cast("int")).drop("seq")


def dealt_parts(r: Relation, parts: int) -> DataFrame:
    """Rows with part: dealt in turn as they are read, without a sort."""
    return r.df.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int"))


def tree_part(attrs) -> Column:
    """Bit i-1 is set if attribute i is below the one before."""
    total = F.lit(0)
    for i in range(1, len(attrs)):
        total = total + F.when(F.col(attrs[i]) < F.col(attrs[i - 1]), 1 << (i - 1)).otherwise(0)
    return total


def _angle_ranks(r: Relation, shift: float) -> tuple[DataFrame, int]:
    """Rows with _q0..: the place of each angle (rounded, so that engines agree), least first; and the rows."""
    names = [f"_phi{i}" for i in range(len(r.attrs) - 1)]
    df = r.df.withColumns({n: -F.round(c, 6) for n, c in zip(names, angles(r.attrs, shift), strict=True)})
    found = ranks(Relation(df, r.keys, tuple(names)), prefix="_q")
    return found, found.count()


def angle_parts(r: Relation, shift: float = 1.1) -> DataFrame:
    """Rows with part: each hyperspherical angle is cut in halves by rank, least first; an odd row more goes to the upper half."""
    found, n = _angle_ranks(r, shift)
    half, part = max(n // 2, 1), F.lit(0)
    for i in range(len(r.attrs) - 1):
        part = part + F.least(F.floor(F.col(f"_q{i}") / half), F.lit(1)) * (1 << i)
    return found.withColumn("part", part.cast("int")).select(*r.df.columns, "part")


def angle_grid(r: Relation, splits: int, shift: float = 1.1) -> DataFrame:
    """Rows with part: each angle in `splits` equal widths of 90 degrees, least significant first."""
    part = F.lit(0)
    for i, c in enumerate(angles(r.attrs, shift)):
        part = part + F.greatest(F.least(F.floor(F.round(c, 6) * splits / 90.0), F.lit(splits - 1)), F.lit(0)) * splits**i
    return r.df.withColumn("part", part.cast("int"))


def angle_depths(r: Relation, splits: int, shift: float = 1.1) -> DataFrame:
    """Rows with part: each angle in `splits` ranges of near-equal rows."""
    found, n = _angle_ranks(r, shift)
    part = F.lit(0)
    for i in range(len(r.attrs) - 1):
        part = part + F.floor(F.col(f"_q{i}") * splits / F.lit(max(1, n))) * splits**i
    return found.withColumn("part", part.cast("int")).select(*r.df.columns, "part")


def median_parts(r: Relation) -> DataFrame:
    """Rows with mask (bit m: attribute m above its upper median) and level (bits set)."""
    ranked = ranks(r)
    n = ranked.count()
    at = n // 2 + 1
    edge = ranked.agg(*[F.max(F.when(F.col(f"r{m}") == n - at, F.col(a))).alias(f"_m{m}") for m, a in enumerate(r.attrs)])
    mask = F.lit(0)
    for m, a in enumerate(r.attrs):
        mask = mask + F.when(F.col(a) > F.col(f"_m{m}"), 1 << m).otherwise(0)
    return r.df.crossJoin(F.broadcast(edge)).withColumn("mask", mask).withColumn("level", F.bit_count("mask")).select(*r.df.columns, "mask", "level")  # one row
