"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, fresh, let, settle
from .windows import references, sizes_present, windows

#: Similarity from which a window counts as a copy of an item.
THRESHOLD = 0.8
#: Radius of the fingerprints. At similarity 0.8 a bit differs with probability 0.15, so 64 bits differ by 10 on average and by
#: over 23 once in a million; RADIUS + 1 blocks guarantee a block in common to all pairs within the radius. With a share of 0.15 of
#: the bits unlike, no guarantee can be had from blocks of more than 1 / 0.15 = 6 bits, however long the fingerprint, and so many
#: blocks as short as that are met by chance: blocks can't pick the item, so they are matched within the item that a shared
#: shingle names. A shingle that repeats itself moves bits by its whole weight, so pairs with one are compared exactly whatever
#: their fingerprints.
BITS, RADIUS = 64, 23
BLOCKS = RADIUS + 1


def simhash(shingles: Column) -> Column:
    """64 bits; each is the sign of the sum, over all shingles with repeats, of that bit as +1 or -1."""

    def of(items: Column) -> Column:
        def bit(i: Column) -> Column:
            total = F.aggregate(items, F.lit(0), lambda a, x: a + F.call_function("shiftright", x, i).bitwiseAND(F.lit(1)).cast("int"))
            return F.when(2 * total > F.size(items), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), bit), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))

    return let(shingles, of)


def blocks(fingerprint: Column) -> Column:
    """The fingerprint's bits in BLOCKS blocks, each with its number."""
    edges = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def common_weight(a: Column, b: Column) -> Column:
    """Shingles in common, each as often as in the array that has it less often."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    count = lambda items, x: F.size(F.filter(items, lambda y: y == x))
    slow = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(slow)


def repeats(shingles: Column) -> Column:
    return F.size(F.array_distinct(shingles)) < F.size(shingles)


def _least(k: int, threshold: float):
    """See windows(): the shingles in common from which two texts are `threshold` similar."""
    return lambda words, n, distinct: F.ceil((F.least(words, n) + n - 2 * k + 2) * threshold / (1 + threshold) - 1e-6).cast("int")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, item_id, start_word, similarity: the best window of each row of docs (doc_id, text) for each item of items
    (item_id, text) that it holds a copy of, in words of letters and digits, case aside.

    similarity is the weighted Jaccard similarity of the shingles of five words of a window and of the item (of as many words; the
    window can start anywhere, and the whole text is the window of a shorter text), a shingle's weight being how often it occurs; from `threshold` a window is a copy. Items with fewer than five words are one
    shingle. Null and wordless texts hold nothing; very long ones are looked at whole; of ties the first window is given, those first that have a shingle where
    the item first has it; rows with one doc_id are looked at each,
    and equal results of theirs are given once. Other columns are ignored; an empty table on either side gives none.
    """
    refs = references(items.select(F.col("item_id").alias("ref_id"), "text").dropDuplicates())
    found = []
    for k in sizes_present(refs):
        own = refs.where(F.col("k") == k).select("ref_id", F.col("shingles").alias("item"), simhash(F.col("shingles")).alias("item_print"), repeats(F.col("shingles")).alias("item_repeats"))
        own = settle(own, "prints")
        rows = own.count()
        seen = settle(windows(docs, refs, k, _least(k, threshold)).withColumn("print", simhash(F.col("shingles"))), "windows")
        left = seen.select("key", "ref_id", "start", F.explode(blocks(F.col("print"))).alias("b")).select("key", "ref_id", "start", "b.*")
        right = own.select("ref_id", F.explode(blocks(F.col("item_print"))).alias("b")).select("ref_id", "b.*")
        near = left.join(checked(right, rows * BLOCKS), ["ref_id", "block", "bits"]).select("key", "ref_id", "start", F.lit(True).alias("met")).distinct()
        near = seen.join(near, ["key", "ref_id", "start"], "left").join(checked(own, rows, 20_000), "ref_id")
        within = F.col("met") & (F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
        near = near.where(within | F.col("item_repeats") | repeats(F.col("shingles")))
        inner = common_weight(F.col("shingles"), F.col("item"))
        scored = near.select("doc_id", "text_hash", "ref_id", "start", "lined", F.size("shingles").alias("a"), F.size("item").alias("b"), inner.alias("c"))
        scored = scored.withColumn("similarity", F.col("c") / (F.col("a") + F.col("b") - F.col("c"))).where(F.col("similarity") >= threshold)
        found.append(scored.groupBy("doc_id", "text_hash", "ref_id").agg(F.max(F.struct("similarity", "lined", (-F.col("start")).alias("before"))).alias("best")))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, text_hash bigint, item_id bigint, start_word int, similarity double")
    every = reduce(DataFrame.unionByName, found)
    return every.select("doc_id", "text_hash", F.col("ref_id").alias("item_id"), (-F.col("best.before")).alias("start_word"), "best.similarity")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, ..) that hold no copy of an item, columns unchanged, whatever their names. Null and empty texts stay,
    as do texts of any length without a copy; repeated rows share their fate, rows that only share a doc_id don't. Without items all
    rows stay; an empty table gives none."""
    who, what = fresh("leak_doc", docs.columns), fresh("leak_hash", docs.columns)
    held = settle(contaminated(docs, items).select(F.col("doc_id").alias(who), F.col("text_hash").alias(what)).distinct(), "leaks")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(who)) & (F.xxhash64(F.col("text").cast("string")) == F.col(what))
    return docs.join(checked(held, held.count()), same, "left_anti")
