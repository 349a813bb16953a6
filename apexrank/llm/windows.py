"""Windows of documents that can hold the most of a reference text's shingles. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, let, plain_words, settle, shingles

#: Words of a shingle; a reference with fewer words is one shingle of its own length.
SHINGLE = 5
#: Reference shingles are looked up inside the row: so many as a literal set, more in a bit filter, of so many bits a shingle, at least and
#: at most (a power of two; 4 MB), of which a shingle sets PROBES.
INLINE = 20_000
BITS_EACH, LEAST_BITS, MOST_BITS, PROBES = 64, 1 << 16, 1 << 25, 4


def references(refs: DataFrame) -> DataFrame:
    """ref_id, n (words), k (words a shingle), shingles for each row of refs (ref_id, text) with a word; written."""
    split = refs.where("text is not null").select("ref_id", plain_words(F.col("text").cast("string")).alias("tokens")).where("size(tokens) > 0")
    sized = split.select("ref_id", F.size("tokens").alias("n"), F.least(F.size("tokens"), F.lit(SHINGLE)).alias("k"), "tokens")
    pick = None
    for k in range(1, SHINGLE + 1):
        own = shingles(F.col("tokens"), k)
        pick = F.when(F.col("k") == k, own) if pick is None else pick.when(F.col("k") == k, own)
    return settle(sized.select("ref_id", "n", "k", pick.alias("shingles")), "references")


def _probes(h: Column, bits: int) -> list[Column]:
    low, step = h.bitwiseAND(F.lit((1 << 25) - 1)), F.shiftrightunsigned(h, 32)
    return [h.bitwiseAND(F.lit(bits - 1)), *[(low + i * step).bitwiseAND(F.lit(bits - 1)) for i in range(1, PROBES)]]


def known(hashes: DataFrame) -> Callable[[Column], Column]:
    """A test whether a hash can be one of those in hashes (h, each once): always true for one of them, and for others never or, with
    the bit filter, rarely, as long as its bits are many enough; it never grows beyond its most."""
    few = [r.h for r in hashes.limit(INLINE + 1).collect()]
    if len(few) <= INLINE:
        return lambda h: h.isin(few)
    n = hashes.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n).bit_length()))
    set_ = hashes.select(F.explode(F.array(*_probes(F.col("h"), bits))).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    cells = set_.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()  # bits / 64 rows at most
    table = [0] * (bits // 64)
    for at, value in zip(cells.column("at").to_pylist(), cells.column("bits").to_pylist(), strict=True):
        table[at] = value
    words = F.from_json(F.lit(str(table)), "array<bigint>")  # folded to one literal

    def test(h: Column) -> Column:
        out = None
        for p in _probes(h, bits):
            hit = F.call_function("shiftright", F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
            out = hit if out is None else out & hit
        return out

    return test


def windows(docs: DataFrame, refs: DataFrame, k: int, least: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """key, doc_id, text_hash, ref_id, start, n, lined, shingles: windows of docs (doc_id, text) of as many words as a reference. key
    numbers the rows of docs; start counts words from 0; lined tells that some shingle of k words stands where the reference first has
    it (its first place only, so that a shingle which repeats itself on both sides doesn't meet itself in all ways).

    least(words, n, distinct) gives the shingles of the reference that a window holds at least, to be of use, by the words of the
    text and of the reference and the reference's distinct shingles. From one start to the next, what a window holds grows only
    where a shingle of the reference comes in at its end. So the first of the best windows ends with one or starts at 0, and these
    are given besides the lined ones, if the reference's shingles in them are that many. Where none is, no window of the text is."""
    own = refs.where(F.col("k") == k)
    marks = own.select("ref_id", "n", F.size(F.array_distinct("shingles")).alias("distinct"), F.posexplode("shingles").alias("j", "h"))
    marks = settle(marks.groupBy("ref_id", "n", "distinct", "h").agg(F.min("j").alias("j")), "marks")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    split = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    can_be = known(marks.select("h").distinct())

    def seeded(t):
        hits = F.filter(F.transform(shingles(t, k), lambda x, i: F.struct(x.alias("h"), i.alias("i"))), lambda s: can_be(s["h"]))
        return F.struct(t.alias("tokens"), hits.alias("seeds"))

    # One expression to the end: a filter on its result would be pushed down and evaluate it again.
    one = F.filter(F.array(let(plain_words(F.col("text")), seeded)), lambda s: F.size(s["seeds"]) > 0)
    held = split.select("doc_id", "text_hash", F.explode_outer(one).alias("s")).where("s is not null").select("doc_id", "text_hash", "s.*")
    held = settle(held.withColumn("key", F.monotonically_increasing_id()), "seeded")
    hits = held.select("key", F.size("tokens").alias("words"), F.explode("seeds").alias("s")).select("key", "words", "s.h", "s.i")
    rows = marks.count()
    start = F.greatest(F.least(F.col("i") - F.col("j"), F.col("words") - F.col("n")), F.lit(0))
    places = hits.join(checked(marks, rows), "h").groupBy("key", "ref_id", "n", "distinct", "words")
    places = places.agg(F.collect_set(start).alias("lined"), F.sort_array(F.collect_set("i")).alias("hits"))
    places = places.withColumn("least", F.greatest(least(F.col("words"), F.col("n"), F.col("distinct")), F.lit(1)))
    # The window that ends with hit t holds so many if hit t - least + 1 is in it.
    full = F.filter("hits", lambda i, t: F.get("hits", t - F.col("least") + 1) >= i - F.col("n") + k)
    places = places.withColumn("full", F.transform(full, lambda i: F.greatest(i - F.col("n") + k, F.lit(0)))).where("size(full) > 0")
    places = places.withColumn("starts", F.array_union("lined", "full"))
    at = F.struct("ref_id", "n", F.transform("starts", lambda s: F.struct(s.alias("start"), F.array_contains("lined", s).alias("lined"))).alias("starts"))
    gathered = settle(places.select("key", at.alias("at")).groupBy("key").agg(F.collect_list("at").alias("places")), "places")  # of one document each
    found = held.select("key", "doc_id", "text_hash", "tokens").join(gathered, "key")
    spread = found.select("key", "doc_id", "text_hash", "tokens", F.explode("places").alias("at"))
    spread = spread.select("key", "doc_id", "text_hash", "tokens", "at.ref_id", "at.n", F.explode("at.starts").alias("s"))
    return spread.select("key", "doc_id", "text_hash", "ref_id", "s.start", "n", "s.lined", shingles(F.slice("tokens", F.col("s.start") + 1, F.col("n")), k).alias("shingles"))


def sizes_present(refs: DataFrame) -> list[int]:
    return sorted(r.k for r in refs.select("k").distinct().collect())
