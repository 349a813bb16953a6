"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitions, overfull ranges subdivided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checked, fresh, settle

#: Ranges: so many a shard at least, one for so many rows, and so many at most. DRAWN keys a range are sampled; ranges and samples are
#: what reaches the driver, and so bounded.
SHARD_RANGES, RANGE_ROWS, MOST_RANGES, DRAWN = 128, 1_000_000, 16_384, 16
#: A range over so many times its share of the bytes is subdivided.
OVERFULL = 2
#: A row's key: digests of its text, so that copies lie together, then what tells copies apart.
KEY = ("k1", "k2", "k3", "k4")
LAST = (1 << 63) - 1


def _splitters(keys: DataFrame, total: int, ranges: int, of: tuple[str, ...]) -> list[tuple[int, ...]]:
    """Boundaries between ranges of about equal bytes: a row is drawn with a chance in proportion to its size (by hash, so a task
    that runs again draws the same), rows above the sampling step with as much weight more, and the quantiles of the drawn keys
    are taken. A boundary is the last key of its range; with of (k1, k2) it is the end of a whole group of copies."""
    step = max(1.0, total / (ranges * DRAWN))
    u = F.shiftrightunsigned(F.xxhash64(*KEY, F.lit(11)), 11).cast("double") / float(1 << 53) * step
    drawn = keys.where(u < F.col("size")).select(*of, F.greatest(F.col("size") / step, F.lit(1.0)).alias("weight"))
    drawn = drawn.groupBy(*of).agg(F.sum("weight").alias("weight")).collect()  # a key sampled often is one row
    drawn.sort(key=lambda r: tuple(r[k] for k in of))
    mass, out, seen, target = sum(r.weight for r in drawn), [], 0.0, 1
    for r in drawn:
        seen += r.weight
        if seen >= mass * target / ranges:
            out.append(tuple(r[k] for k in of) + (LAST,) * (len(KEY) - len(of)))
            target = int(seen * ranges / mass) + 1
    return out


def _range_of(bounds: list[tuple[int, ...]]) -> Column:
    """The number of a key's range, by binary search: range i holds keys after bound i-1 up to bound i."""
    if not bounds:
        return F.lit(0)
    tables = [F.expr(f"array({','.join(f'{b[i]}BD' for b in bounds)})").cast("array<bigint>") for i in range(len(KEY))]
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def move(low: Column, step: Column) -> Column:
        at = low + step - 1
        above = F.lit(False)
        for key, table in reversed(list(zip(KEY, tables, strict=True))):
            above = (F.col(key) > F.get(table, at)) | ((F.col(key) == F.get(table, at)) & above)
        return F.when((low + step <= len(bounds)) & above, low + step).otherwise(low)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), move)


def _ranges(keys: DataFrame, total: int, rows: int, shards: int) -> tuple[list[tuple[int, ...]], dict[int, tuple[int, int]]]:
    """(bounds, {range: (bytes, rows)}): the sample's ranges; those overfull are subdivided by samples of their own, now by the whole key,
    until none is that can be."""
    ranges = min(MOST_RANGES, max(SHARD_RANGES * shards, rows // RANGE_ROWS))
    bounds, share = _splitters(keys, total, ranges, KEY[:2]), OVERFULL * total / ranges
    most = keys.agg(F.max("size")).first()[0] or 0
    tried = set()
    while True:
        held = {x.r: (x.bytes, x.n) for x in keys.groupBy(_range_of(bounds).alias("r")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        ends = [*bounds, (LAST,) * len(KEY)]
        over = [r for r, (size, n) in held.items() if size > share + most and n > 1 and (r and ends[r - 1], ends[r], size) not in tried]
        if not over or len(bounds) >= 2 * MOST_RANGES:
            return bounds, held
        tried |= {(r and ends[r - 1], ends[r], held[r][0]) for r in over}
        part = settle(keys.withColumn("r", _range_of(bounds)).where(F.col("r").isin(over)), "overfull")
        more = set(bounds)
        for r in over:
            more.update(_splitters(part.where(F.col("r") == r), held[r][0], max(2, int(OVERFULL * held[r][0] / share)), KEY))
        bounds = sorted(more)


def assign_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs (doc_id, text): shards 0.. of near-equal bytes.

    size is the text's UTF-8 bytes (null: none) plus 1, text_crc32 its CRC-32 (null: that of no bytes). Rows are ordered by the
    digests of the text, then doc_id (null first), and cut into ranges at the quantiles of a size-weighted sample, many to a
    shard; a boundary never parts copies of a text, but in a range that is overfull, and only that is subdivided inside a
    group. A shard is a run of whole ranges: each goes where the middle of its bytes falls, so a shard is off its share by
    about a range, or a row if rows are larger. Slots number a shard's rows in the order of keys from 0. Rows that agree in
    text and doc_id come in any order, with equal outcome but for the slot. A very long text is its size; other columns are
    ignored; an empty table gives none.

    Only the narrow key table is shuffled, once, by range; exact sums over the ranges, one row each, place every range.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text.cast("binary")).alias("k1"), F.xxhash64(text).alias("k2"))
    keys = settle(keys.withColumns({"k3": F.coalesce("doc_id", F.lit(-(1 << 63))), "k4": F.monotonically_increasing_id()}), "keys")
    sums = keys.agg(F.sum("size").alias("total"), F.count("*").alias("rows")).first()
    total = sums.total or 0
    bounds, held = _ranges(keys, total, sums.rows, shards)

    places, at_byte, at_row, first = [], 0, 0, {}
    for r in sorted(held):
        size, n = held[r]
        shard = min(shards - 1, (2 * at_byte + size) * shards // (2 * total))
        first.setdefault(shard, at_row)
        places.append((r, shard, at_row - first[shard]))
        at_byte, at_row = at_byte + size, at_row + n
    where = docs.sparkSession.createDataFrame(places, "r int, shard int, before bigint")  # a row a range
    inside = Window.partitionBy("r").orderBy(*KEY)
    placed = keys.withColumn("r", _range_of(bounds)).withColumn("nth", F.row_number().over(inside) - 1).join(checked(where, len(places)), "r")
    return placed.select("doc_id", "size", F.col("k1").alias("text_crc32"), "shard", (F.col("before") + F.col("nth")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Writes whole rows of docs (doc_id unique) to shard=0.. below path, in the order of slots. A column of docs called shard is
    replaced by the folder's number."""
    own, slot = fresh("own_id", docs.columns), fresh("slot", docs.columns)
    placed = assign_shards(docs, shards).select(F.col("doc_id").alias(own), "shard", F.col("slot").alias(slot))
    rows = docs.drop("shard").join(placed, F.col("doc_id").eqNullSafe(F.col(own))).drop(own)
    rows.repartitionByRange(shards, "shard", slot).sortWithinPartitions("shard", slot).drop(slot).write.partitionBy("shard").parquet(path)
