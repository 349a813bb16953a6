"""MinHash near-duplicates by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import checked, settle
from .graph import connected_components

U = np.uint64
#: Words of 64 bits of a set's parities.
PARITY_WORDS = 8


def band_shape(percent: int, most: int = 30, miss: float = 1e-5) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which at most `most` bands miss a pair at the threshold with probability `miss`."""
    best = (most, 1)
    for rows in range(1, 17):
        bands = math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))
        if bands <= most:
            best = (bands, rows)
    return best


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches (one row of t coordinates a set): in round i each element offers the value (i, hash) to one
    bin; rounds t to 2t-1 offer every element to bin i-t. A set drops out once each of its bins is filled, which happens by
    round 2t-1 for certain; earlier rounds have smaller values, so later ones can't change a filled bin."""
    out = np.full((len(sets), t), np.iinfo(U).max, U)
    alive = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    for i in range(2 * t):
        if not len(alive):
            break
        lengths = np.array([len(sets[a]) for a in alive])
        owner = np.repeat(alive, lengths)
        h = kernels.mix(np.concatenate([sets[a] for a in alive]) + U((i + 1) * 0xA0761D6478BD642F & (1 << 64) - 1))
        bins = (h >> U(32)) * U(t) >> U(32) if i < t else np.full(len(h), i - t, U)
        value = (U(i) << U(48)) | (kernels.mix(h) >> U(16))
        np.minimum.at(out.reshape(-1), owner * t + bins.astype(np.int64), value)
        alive = alive[(out[alive] == np.iinfo(U).max).any(1)]
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band, with the band's number mixed in."""
    cells = sketches.reshape(len(sketches), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * kernels.BASE, cells.shape[:2])
    for j in range(rows):
        key = kernels.mix(key * U(0x2545F4914F6CDD1D) + cells[:, :, j])
    return key.view(np.int64)


def _sums(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set. Equal sets have equal sums, unequal ones differ in one of them but for a chance of 2**-128."""
    if not len(s):
        return 0, 0
    return int(kernels.mix(s + U(1)).sum(dtype=U).view(np.int64)), int(kernels.mix(s * U(3)).sum(dtype=U).view(np.int64))


def _shingled(k: int, column: pa.Array):
    """Yields (first row, the shingle sets of so many rows)."""
    for row, hashes, starts in kernels.text_words(column):
        yield row, [kernels.shingle_set(hashes[a:b], k) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def _signatures(k: int, bands: int, rows: int):
    """mapInArrow: (doc_id, text) to (doc_id, n_shingles, sum_a, sum_b, band keys)."""

    def run(batches):
        for batch in batches:
            for row, sets in _shingled(k, batch.column("text")):
                sums = [_sums(s) for s in sets]
                keys = band_keys(sketch(sets, bands * rows), bands, rows)
                full = [keys[i] if len(s) else [] for i, s in enumerate(sets)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([x[0] for x in sums], pa.int64()),
                        pa.array([x[1] for x in sums], pa.int64()),
                        pa.array(full, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "sum_a", "sum_b", "keys"],
                )
        batch = sets = None  # else the last one stays
        kernels.release()

    return run


def _sets(k: int):
    """mapInArrow: (text) to (n_shingles, sum_a, sum_b, sorted shingle hashes as bytes)."""

    def run(batches):
        for batch in batches:
            for _, sets in _shingled(k, batch.column("text")):
                sums = [_sums(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([x[0] for x in sums], pa.int64()),
                        pa.array([x[1] for x in sums], pa.int64()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    names=["n_shingles", "sum_a", "sum_b", "body"],
                )
        batch = sets = None
        kernels.release()

    return run


def _linked(percent: int):
    """mapInArrow: (a, b, body_a, body_b) to the pairs (a, b) with 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("body_a"), batch.column("body_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def parities(s: np.ndarray) -> np.ndarray:
    """The shingles of a set that fall into each of 64 * PARITY_WORDS cells, as an odd or even number. Two sets differ in as many shingles at
    least as they differ in cells."""
    cells = (kernels.mix(s) >> U(32)) * U(64 * PARITY_WORDS) >> U(32)
    odd = np.bincount(cells.astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _parities(batches):
    """mapInArrow: (id, body) to (id, parity)."""
    for batch in batches:
        sets = [parities(np.frombuffer(x.as_buffer(), U)) for x in batch.column("body")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "parity"])


def _shingles(batches):
    """mapInArrow: (id, body) to a row for each shingle."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("body")]
            ids = np.repeat(part.column("id").to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets))], names=["id", "shingle"])


def _rare_pairs(body: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb) of documents of different components that may be linked, by their rarest shingles; see near_duplicates()."""
    each = settle(body.mapInArrow(_shingles, "id bigint, shingle bigint"), "shingles")
    often = settle(each.groupBy("shingle").agg(F.count("*").alias("docs")), "often")
    listed = each.join(often, "shingle").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("docs", "shingle"))).alias("s"))  # of one document each
    n = F.size("s")
    rarest = F.slice("s", 1, (n - F.ceil(n * percent / 100) + 1).cast("int"))
    posts = listed.select("id", n.alias("n"), F.posexplode(rarest).alias("at", "x")).select("id", "n", "at", "x.shingle")
    told = settle(labels.join(body.mapInArrow(_parities, "id bigint, parity array<bigint>"), "id"), "parities")
    posts = posts.join(checked(told, told.count()), "id")
    posts = settle(posts, "posts")
    counts = posts.groupBy("shingle", "component").agg(F.count("*").alias("docs"))
    main = settle(counts.groupBy("shingle").agg(F.max_by("component", "docs").alias("main"), F.count("*").alias("many")).where("many > 1").drop("many"), "main")
    held = settle(posts.join(main, "shingle"), "held")
    others = held.where("component <> main").select("shingle", F.col("id").alias("o"), F.col("n").alias("no"), F.col("at").alias("ato"), F.col("component").alias("co"), F.col("parity").alias("po"))
    most = "least(n - at, no - ato)"
    unlike = reduce(add, [F.bit_count(F.get("parity", F.lit(i)).bitwiseXOR(F.get("po", F.lit(i)))) for i in range(PARITY_WORDS)])
    pairs = held.join(others, "shingle").where(f"component <> co and 100 * {most} >= {percent} * (n + no - {most})")
    pairs = pairs.where((100 + percent) * unlike <= (100 - percent) * (F.col("n") + F.col("no")))  # what linked sets may differ in
    low = F.col("id") < F.col("o")
    return pairs.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b"), F.when(low, F.col("n")).otherwise(F.col("no")).alias("na"), F.when(low, F.col("no")).otherwise(F.col("n")).alias("nb"))


CLASS = ["n_shingles", "sum_a", "sum_b"]


def _same_document(signed: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (a, b) between the classes of rows that share a doc_id, or None where no doc_id has two."""
    named = signed.where("doc_id is not null and n_shingles > 0").select("doc_id", *CLASS)
    unlike = named.groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in CLASS for f in (F.min, F.max)])
    unlike = settle(unlike.where(" or ".join(f"min_{c} < max_{c}" for c in CLASS)).select("doc_id"), "repeated")
    if unlike.isEmpty():
        return None
    own = named.join(checked(unlike, unlike.count()), "doc_id", "left_semi").distinct().join(classes.select(*CLASS, "id"), CLASS)
    own = settle(own.select("doc_id", "id"), "repeated")
    least = own.groupBy("doc_id").agg(F.min("id").alias("a"))
    return settle(own.join(least, "doc_id").where("id <> a").select("a", F.col("id").alias("b")), "same")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct runs of k words (A-Z lower-cased,
    fewer words: the whole sequence); component_id is the least doc_id that links reach. Null and empty texts have no shingle
    and no link. Very long texts are hashed slab by slab, whole. Rows with one doc_id count as one document: what is linked
    to one of their texts is linked to the others too. Rows whose doc_id is null link nothing and are returned with null component
    and kept true. Other columns are ignored. An empty table gives an empty result.

    Texts with equal sets are folded into one class first. A bucket of a band, which may be very large, never meets itself: its least
    member is verified against all of it. Members of buckets that are then of more than one component are compared by the rarest of
    their shingles: two sets of the wanted similarity share one among their first n - ceil(percent * n / 100) + 1 in an order
    common to all, rarest first, and the places of the first one that they share bound what they can have in common, as do the
    parities of their shingles in cells. So pairs are spared only where documents are already connected or can't be linked, and
    a large component never meets itself.
    """
    bands, rows = band_shape(percent)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = settle(texts.mapInArrow(_signatures(k, bands, rows), "doc_id bigint, n_shingles bigint, sum_a bigint, sum_b bigint, keys array<bigint>"), "signed")
    named = signed.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy(*CLASS).agg(F.min("doc_id").alias("doc"), F.first("keys").alias("keys"))
    classes = settle(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    cells = classes.select("id", "doc", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    # The least doc_id, which leads the same way in all its buckets, is also the likeliest origin of the others.
    buckets = settle(cells.groupBy("key").agg(F.min_by("id", "doc").alias("leader"), F.count("*").alias("size")).where("size > 1"), "buckets")
    members = settle(cells.join(buckets, "key").select("key", "leader", "id", "n"), "members")
    wanted = settle(classes.select("id", "doc", *CLASS).join(members.select("id").distinct(), "id", "left_semi"), "wanted")
    many = wanted.count()
    found = texts.join(checked(wanted.select(F.col("doc").alias("doc_id")).distinct(), many), "doc_id", "left_semi").select("text")
    found = found.mapInArrow(_sets(k), "n_shingles bigint, sum_a bigint, sum_b bigint, body binary")
    body = settle(found.join(checked(wanted.select("id", *CLASS), many), CLASS).select("id", "body").dropDuplicates(["id"]), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b").distinct()
        # A leader may have very many pairs: they meet its set while they are narrow.
        both = pairs.join(body.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a").join(body.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b")
        return settle(both.select("a", "b", "body_a", "body_b").mapInArrow(_linked(percent), "a bigint, b bigint"), "verified")

    sizes = members.where("id = leader").select("key", F.col("n").alias("na"))
    links = verified(members.where("id <> leader").join(sizes, "key").select(F.col("leader").alias("a"), F.col("id").alias("b"), "na", F.col("n").alias("nb")))
    same = _same_document(signed, classes)
    labels = settle(connected_components(links if same is None else links.unionByName(same)), "components")

    labelled = members.where("id <> leader").select("key", "id").join(checked(labels, labels.count()), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    unsettled = settle(labelled.join(settle(open_keys, "open"), "key", "left_semi").select("id", "component").distinct(), "unsettled")
    if not unsettled.isEmpty():
        fresh = verified(_rare_pairs(body.join(unsettled.select("id"), "id", "left_semi"), unsettled, percent))
        if not fresh.isEmpty():
            labels = settle(connected_components(fresh.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))), "components")

    known = labels.join(classes.select("id", "doc"), "id")
    least = known.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = settle(labels.join(checked(settle(least, "least"), labels.count()), "component").select("id", "component_id"), "named")
    tops = classes.join(checked(named, named.count()), "id", "left").select(*CLASS, F.coalesce("component_id", "doc").alias("component_id"))
    return _attach(signed, settle(tops, "tops"))


def _attach(signed: DataFrame, tops: DataFrame) -> DataFrame:
    """Each document with its class's component. A class may hold a third of all rows; the side of the classes is written, so
    the skewed side of the join can be split."""
    out = signed.drop("keys").join(tops, CLASS, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
