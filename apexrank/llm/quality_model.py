"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged per document, softmax output, numpy SGD."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels

#: Labelled documents that the vectors are fitted on at most (those with the least hash of doc_id).
TRAIN_ROWS = 3000
BUCKETS, WIDTH = 1 << 15, 8
#: Bytes of a character n-gram; the white space around words counts as characters.
GRAMS = (3, 4)
EPOCHS = 12

U = np.uint64


def _bucket(codes: np.ndarray, kind: int) -> np.ndarray:
    return (kernels.mix(codes + U(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & U(BUCKETS - 1)).astype(np.int64)


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    code = data[: len(data) - n + 1].astype(U)
    for j in range(1, n):
        code |= data[j : len(data) - n + 1 + j].astype(U) << U(8 * j)
    return code


def _segments(starts: np.ndarray, drop: int) -> tuple[np.ndarray, np.ndarray]:
    """For runs of drop+1 items within rows of the given starts: which of all runs lie within a row, and the rows' new starts."""
    lengths = np.maximum(np.diff(starts) - drop, 0)
    new = np.concatenate(([0], np.cumsum(lengths)))
    return np.arange(new[-1]) + np.repeat(starts[:-1] - new[:-1], lengths), new


def features(column: pa.Array) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Yields (first row, [(buckets, starts of each row's) ..]) for slabs of whole rows: words, pairs of words, and n-grams. A
    text longer than a slab comes alone and in several parts, each with its row and one segment."""
    data, offsets = kernels.buffers(column)
    for row, hashes, starts in kernels.text_words(column, lower=False):
        n = len(starts) - 1
        own = [(_bucket(hashes, 1), starts)]
        if len(hashes) > 1:
            at, pairs = _segments(starts, 1)
            own.append((_bucket(hashes[at] * kernels.BASE + hashes[at + 1], 2), pairs))
        part, edges = data[offsets[row] : offsets[row + n]], offsets[row : row + n + 1] - offsets[row]
        if n == 1 and len(part) > kernels.SLAB:
            yield row, own
            for g in GRAMS:
                for low in range(0, len(part) - g + 1, kernels.SLAB):
                    code = _grams(part[low : low + kernels.SLAB + g - 1], g)
                    yield row, [(_bucket(code, g), np.array([0, len(code)]))]
            continue
        for g in GRAMS:
            if len(part) >= g:
                at, runs = _segments(edges, g - 1)
                own.append((_bucket(_grams(part, g)[at], g), runs))
        yield row, own


@dataclass
class Model:
    vectors: np.ndarray  # BUCKETS x WIDTH
    output: np.ndarray  # WIDTH x 2
    bias: np.ndarray

    def scores(self, mean: np.ndarray) -> np.ndarray:
        """The softmax probability of label 1 for averaged vectors, one row a document."""
        z = mean @ self.output + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z[:, 1] / z.sum(1)


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = 6.0, seed: int = 1) -> Model:
    """Softmax regression on averaged vectors, vectors and output learned together, a document at a time."""
    rng = np.random.default_rng(seed)
    v = (rng.random((BUCKETS, WIDTH), np.float32) - 0.5) / WIDTH
    out, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    docs = [(b, (n / n.sum()).astype(np.float32), y) for b, n, y in docs if len(b)]
    total = epochs * max(1, len(docs))
    step = 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            buckets, share, y = docs[i]
            now = rate * (1 - step / total)
            step += 1
            hidden = share @ v[buckets]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= (0.1 * now) * np.outer(hidden, p)
            bias -= (0.01 * now) * p
            v[buckets] -= (now * share)[:, None] * back
    return Model(v, out, bias)


def _counted(batches):
    """mapInArrow: (h, quality, text) to (h, quality, buckets, times)."""
    for batch in batches:
        counts: dict[int, np.ndarray] = {}

        def flush(before: int, batch=batch, counts=counts):
            for i in [i for i in counts if i < before]:
                tally = counts.pop(i)
                hit = np.flatnonzero(tally)
                cells = [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (hit, tally[hit])]
                yield pa.RecordBatch.from_arrays([batch.column("h").slice(i, 1), batch.column("quality").slice(i, 1), *cells], names=["h", "quality", "buckets", "times"])

        for row, kinds in features(batch.column("text")):
            yield from flush(row)
            for buckets, starts in kinds:
                for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                    if b > a:
                        counts[row + i] = counts.get(row + i, 0) + np.bincount(buckets[a:b], minlength=BUCKETS)
        yield from flush(batch.num_rows)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """A model of docs (doc_id, text) joined to labels (doc_id, quality 0 or 1); rows with nulls teach nothing. At most `most`
    documents are used: those labels with the least hash of doc_id, so only their texts are looked up."""
    usable = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    total = usable.count()
    h = F.xxhash64("doc_id")
    if total > 2 * most:
        usable = usable.where(F.pmod(h, F.lit(1 << 20)) < int((1 << 20) * 2 * most / total))
    drawn = F.broadcast(usable.withColumn("h", h).orderBy("h", "quality").limit(most))  # at most `most` narrow rows
    rows = docs.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(drawn, "doc_id")
    found = rows.select("h", "quality", "text").mapInArrow(_counted, "h bigint, quality int, buckets binary, times binary").collect()
    found.sort(key=lambda r: (r.h, r.quality, bytes(r.buckets)))
    return fit([(np.frombuffer(r.buckets, np.int32), np.frombuffer(r.times, np.int32), r.quality) for r in found])


def _scored(model: Model):
    """mapInArrow: (doc_id, text) to (doc_id, score)."""

    def run(batches):
        for batch in batches:
            total, times = np.zeros((batch.num_rows, WIDTH)), np.zeros((batch.num_rows, 1))
            for row, kinds in features(batch.column("text")):
                for buckets, starts in kinds:
                    full = np.flatnonzero(np.diff(starts))
                    if len(full):
                        total[row + full] += np.add.reduceat(model.vectors[buckets], starts[full], axis=0)
                        times[row + full, 0] += np.diff(starts)[full]
            means = (total / np.maximum(times, 1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(means).astype(float), pa.float64())], names=["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text), as labels (doc_id, quality) mark quality.

    Vectors are learned from labelled rows that are not held out (crc32 of doc_id as text, mod 5, is not 0; a null doc_id is not
    held out). score is the probability of label 1, from the text alone; null and empty texts have the score of an average of
    nothing, the output's bias; predicted is 1 from a score of 0.3. Without labelled rows every score is 0.5. Very long texts are
    averaged whole, slab by slab; repeated rows are scored each; other columns are ignored; an empty table gives none."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(texts.where(~is_held_out(F.col("doc_id"))), labels.where(~is_held_out(F.col("doc_id"))))
    scored = texts.mapInArrow(_scored(model), "doc_id bigint, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
