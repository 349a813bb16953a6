"""Language identification by error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels
from .common import fresh

#: Labelled rows that the classifiers are fitted on at most, dealt evenly to the languages (drawn by the hash of doc_id), and the
#: languages at most, the most frequent ones.
TRAIN_ROWS, TRAIN_LANGS = 1200, 400
#: Buckets for pairs and for triples of bytes.
PAIRS, TRIPLES = 2048, 4096
WIDTH = PAIRS + TRIPLES
#: Bytes and rows whose counts are held at once.
SLAB, SLAB_ROWS = 1 << 18, 128
#: Two best languages whose losses differ by less count as ambiguous, as does a text whose nearest codeword is farther than that of
#: any held-back training text by FAR times, and than LOST times that of a text of which every bit is undecided.
GAP, FAR, LOST = 0.1, 1.25, 0.75


def codewords(classes: int, seed: int = 5) -> np.ndarray:
    """A row of +1 and -1 for each class: every split of the classes for up to five, else the most distant of random codes."""
    if classes <= 1:
        return np.ones((classes, 1), np.float32)
    if classes <= 5:
        splits = np.arange(1, 1 << (classes - 1))
        bits = np.array([[0] + [int(s >> i & 1) for i in range(classes - 1)] for s in splits]).T
        return (2 * bits - 1).astype(np.float32)
    rng, best, far = np.random.default_rng(seed), None, -1
    length = int(np.ceil(10 * np.log2(classes)))
    for _ in range(200):
        code = rng.integers(0, 2, (classes, length)) * 2 - 1
        spread = code[:, (code != code[0]).any(0)]
        apart = (len(spread[0]) - spread @ spread.T) // 2 + np.eye(classes, dtype=int) * length
        if apart.min() > far:
            best, far = spread, apart.min()
    return best.astype(np.float32)


def _add(counts: np.ndarray, data: np.ndarray, owner: np.ndarray) -> None:
    """Counts the pairs and triples of bytes of each owner's stretch of data."""
    low = kernels.LOWER[data]
    accent = np.zeros(len(low), bool)  # capital Latin-1 letters in UTF-8
    accent[1:] = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E)
    wide = (low + accent * np.uint8(32)).astype(np.uint32)
    for n, buckets, base in ((2, PAIRS, 0), (3, TRIPLES, PAIRS)):
        if len(wide) < n:
            continue
        code = wide[: len(wide) - n + 1].copy()
        for j in range(1, n):
            code |= wide[j : len(wide) - n + 1 + j] << np.uint32(8 * j)
        whole = owner[: len(code)] == owner[n - 1 :]
        cell = (code * np.uint32(0x9E3779B1) >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)
        cell += owner[: len(code)] * WIDTH + base
        counts += np.bincount(cell[whole], minlength=counts.size)


def features(column: pa.Array):
    """Yields (first row, matrix) of the square roots of n-gram frequencies, each row of length 1 (0 without n-grams)."""
    data, offsets = kernels.buffers(column)
    row, n = 0, len(column)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLAB, "right")) - 1)
        stop = min(stop, row + SLAB_ROWS)
        counts = np.zeros((stop - row) * WIDTH, np.int64)
        if stop == row + 1:  # a long text in slabs that share their edges
            part = data[offsets[row] : offsets[stop]]
            for at in range(0, max(1, len(part)), SLAB):
                piece = part[at : at + SLAB]
                if len(piece):
                    _add(counts, piece, np.zeros(len(piece), np.int64))
                seam = part[max(0, at - 2) : at + 2] if at else part[:0]
                for n_, buckets, base in ((2, PAIRS, 0), (3, TRIPLES, PAIRS)) if len(seam) else ():
                    seam_ = seam[2 - n_ + 1 : 2 + n_ - 1]
                    only = np.zeros(WIDTH, np.int64)
                    _add(only, seam_, np.zeros(len(seam_), np.int64))
                    counts[base : base + buckets] += only[base : base + buckets]
        else:
            lengths = np.diff(offsets[row : stop + 1])
            _add(counts, data[offsets[row] : offsets[stop]], np.repeat(np.arange(stop - row), lengths))
        x = np.sqrt(counts.reshape(stop - row, WIDTH).astype(np.float32))
        yield row, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        row = stop


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray  # a row a class: how far each bit's classifier is to be trusted with it, 1 on average
    far: float = float("inf")  # loss of the nearest codeword from which a text is like none of the languages

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss-weighted decoding: the logistic losses of the bits' margins against each codeword, each weighted by the trust in
        that bit for that class, added up."""
        margin = x @ self.weights + self.bias
        return (np.logaddexp(0, -margin[:, None, :] * self.code[None]) * self.trust[None]).sum(2)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, score, unsure): the class of least loss; its share under exp(-loss); whether the next class is nearer than GAP or
        the class itself is too far."""
        loss = self.losses(x)
        share = np.exp(-(loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        ordered = np.sort(loss, 1)
        gap = ordered[:, 1] - ordered[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, share[np.arange(len(best)), best], (gap < GAP) | (ordered[:, 0] > self.far)


def _descend(x: np.ndarray, y: np.ndarray, code: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of one logistic classifier a code bit, by stochastic gradient descent; classes weigh the same whatever their rows."""
    each = (len(y) / (len(code) * np.maximum(np.bincount(y, minlength=len(code)), 1))).astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        rate = 8.0 / (1 + epoch / 8)
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            rows = order[at : at + 64]
            target = code[y[rows]]
            slope = -target / (1 + np.exp(np.clip(target * (x[rows] @ w + b), -30, 30))) * each[y[rows], None]
            w -= rate * (x[rows].T @ slope / len(rows) + 1e-6 * w)
            b -= 0.1 * rate * slope.mean(0)
    return w, b


def fit(x: np.ndarray, langs: list[str], epochs: int = 40, seed: int = 3) -> Model:
    """Classifiers of the bits of the languages' codewords. Each fifth text is first held back from a shorter fit: how often a bit is
    right for a class there (counted with one right and one wrong more) is the trust in it, and the largest loss of a right
    class there, or most of the loss of undecided bits if that is more, bounds the losses of texts that are like one of the languages."""
    names = sorted(set(langs))
    code = codewords(len(names))
    y = np.array([names.index(v) for v in langs])
    back = np.arange(len(y)) % 5 == 4
    trust, far = np.ones(code.shape), np.inf
    if back.sum() >= 5 * len(names) and len(names) > 1:
        w, b = _descend(x[~back], y[~back], code, epochs // 2, seed)
        right = (x[back] @ w + b) * code[y[back]] > 0
        trust = np.stack([(right[y[back] == c].sum(0) + 1) / ((y[back] == c).sum() + 2) for c in range(len(names))])
        trust *= code.shape[1] / trust.sum(1, keepdims=True)
        loss = Model(names, code, w, b, trust).losses(x[back])
        own = loss[np.arange(len(loss)), y[back]][loss.argmin(1) == y[back]]
        far = max(LOST * code.shape[1] * np.log(2), FAR * float(own.max())) if len(own) else np.inf
    return Model(names, code, *_descend(x, y, code, epochs, seed), trust, far)


def quotas(counts: dict[str, int], most: int) -> dict[str, int]:
    """Rows of each language to draw: an even share of `most`, with what a rare language leaves dealt to the others; one at least."""
    out, left = {}, most
    for n, (lang, count) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = max(1, min(count, left // (len(counts) - n)))
        left = max(0, left - out[lang])
    return out


def train(rows: DataFrame, most: int = TRAIN_ROWS) -> Model | None:
    """A model of rows (doc_id, text, lang) with text and lang; None where there is none. Each language has its quota of `most`, the
    rows with the least hash of doc_id; only shares of rows near the quotas are sorted and leave the executors."""
    labelled = rows.where("text is not null and lang is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(TRAIN_LANGS).collect()}
    if not counts:
        return None
    quota = quotas(counts, most)
    bound = {v: (1 << 30 if n <= 2 * quota[v] + 20 else int((1 << 30) * (1.5 * quota[v] + 20) / n)) for v, n in counts.items()}
    of = lambda table: F.try_element_at(F.create_map(*[F.lit(c) for pair in table.items() for c in pair]), F.col("lang"))
    near = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < of(bound))
    first = Window.partitionBy("lang").orderBy("h", "body")
    drawn = near.mapInArrow(_with_hash, "lang string, body binary, h bigint").withColumn("nth", F.row_number().over(first))
    drawn = drawn.where(F.col("nth") <= max(quota.values())).where(F.col("nth") <= of(quota)).collect()
    first = {(r.lang, bytes(r.body)): r.h for r in sorted(drawn, key=lambda r: (r.h, r.lang, bytes(r.body)))}  # copies teach nothing new
    del drawn
    x = np.frombuffer(b"".join(body for _, body in first), np.float16).astype(np.float32).reshape(-1, WIDTH)
    return fit(x, [lang for lang, _ in first])


def _with_hash(batches):
    for batch in batches:
        ids = kernels.mix(np.asarray(batch.column("doc_id").fill_null(-1).to_numpy(), np.int64).view(np.uint64)).view(np.int64)
        for row, x in features(batch.column("text")):
            body = [v.astype(np.float16).tobytes() for v in x]
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(row, len(x)), pa.array(body, pa.binary()), pa.array(ids[row : row + len(x)])], names=["lang", "body", "h"])


def _scored(model: Model | None, letters: str, drop: tuple[str, ...], added: tuple[str, ...]):
    """mapInArrow: appends language, score and doubt, so named, to batches with text and `letters` (whether the text has one), less `drop`."""

    def run(batches):
        for batch in batches:
            langs, scores, unsure = [], [], []
            if model is None:
                langs, scores, unsure = ["und"] * batch.num_rows, [0.0] * batch.num_rows, [True] * batch.num_rows
            else:
                for _, x in features(batch.column("text")):
                    best, share, doubt = model.predict(x)
                    langs += [model.langs[i] for i in best]
                    scores += share.astype(float).tolist()
                    unsure += doubt.tolist()
            for i, has in enumerate(batch.column(letters).to_pylist()):
                if not has:
                    langs[i], scores[i], unsure[i] = "und", 0.0, True
            arrays = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n not in drop]
            names = [n for n in batch.schema.names if n not in drop]
            out = [*arrays, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names=[*names, *added])
        batch = arrays = out = None  # else the last ones stay
        kernels.release()

    return run


def letters(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model | None, keep_text: bool = True, added: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """docs (with a text column) with lang_pred, score (0 to 1) and ambiguous after them, under the names `added`, which replace columns
    so named. A text that is null or has no letter is `und` with score 0 and ambiguous, as is every text without a model. Only
    the whole text is read, of any length (n-grams are counted slab by slab); rows are scored each, repeated ones too; of ties
    the language that sorts first is taken. Other columns are kept. An empty table gives none. keep_text False leaves the text out."""
    mark = fresh("letters", docs.columns)
    rows = docs.drop(*[c for c in added if c in docs.columns]).withColumn(mark, letters(F.col("text")))
    drop = (mark,) if keep_text else (mark, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in drop)
    new = ", ".join(f"`{n}` {t}" for n, t in zip(added, ("string", "double", "boolean"), strict=True))
    return rows.mapInArrow(_scored(model, mark, drop, added), f"{schema}, {new}")


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for each row of docs (doc_id, text, lang); see identify(), also for nulls, empty and
    very long texts, ties, repeated rows and empty tables. Classifiers learn from the rows that are not held out: crc32 of doc_id as
    text, mod 4, is not 2 (a null doc_id is not held out). Other columns are ignored, whatever their names."""
    model = train(docs.where(~is_held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), model, keep_text=False)
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def filter_language(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, lang, ..) whose language is identified without ambiguity, columns unchanged: what is `und`, what lies
    between two languages, and what is like none of those learned goes. Null and letterless texts go; repeated rows share their
    fate; columns of any name stay; an empty table gives none. Without a single labelled row nothing is identified and all go."""
    model = train(docs.where(~is_held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    added = tuple(fresh(n, docs.columns) for n in ("lang_pred", "score", "ambiguous"))
    return identify(docs, model, added=added).where((F.col(added[0]) != "und") & ~F.col(added[2])).select(*docs.columns)
