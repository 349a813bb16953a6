"""SentencePiece encoding and decoding of whole texts; giant ones as a max-plus parallel scan over chunks."""

from __future__ import annotations

import sys
import zlib
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import settle
from .pieces import MINUS, SPACE, Vocabulary, compose

#: Characters of a chunk. Texts of more than two chunks are scanned in parallel.
CHUNK = 16_384
#: Chunks whose matrices one task multiplies, and rows of a record batch of chunks.
GROUP, ROWS = 256, 32
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def load_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _vocabulary(model: bytes) -> Vocabulary:
    """One for each Python worker, kept between its tasks."""
    kept = sys.__dict__.setdefault("_apexrank_vocabularies", {})
    key = zlib.crc32(model)
    if key not in kept:
        kept.clear()
        kept[key] = Vocabulary.parse(model)
    return kept[key]


def _lists(parts: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def _decoded(v: Vocabulary, raw: pa.Array, ids: pa.ListArray) -> list[str]:
    """The text of each list of ids; raw holds the bytes of each piece."""
    joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, raw.take(ids.values)), b"")
    return [v.text(x) for x in joined.to_pylist()]


def _encode_short(model: bytes):
    """mapInArrow: (doc_id, text) to (doc_id, ids, round_trip), a batch of bounded size at a time."""

    def run(batches):
        v = _vocabulary(model)
        raw = pa.array(v.raw, pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = _lists([v.encode(v.normal(t)) for t in texts])
                same = [back == t.replace(SPACE, " ") for back, t in zip(_decoded(v, raw, ids), texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(same, pa.bool_())], names=["doc_id", "ids", "round_trip"])
        batch = part = texts = ids = None  # else the last ones stay
        kernels.release()

    return run


def _batched(rows, schema: pa.Schema):
    rows = iter(rows)
    while part := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_pylist(part, schema)


STATES = [("enter", pa.string()), ("enter_over", pa.int32()), ("leave", pa.string()), ("leave_over", pa.int32())]
ENTRY = pa.struct([("a", pa.string()), ("x", pa.int32()), ("b", pa.string()), ("y", pa.int32()), ("w", pa.float64())])
ENTRIES = "entries array<struct<a:string,x:int,b:string,y:int,w:double>>"


def _packed(matrix: dict) -> list[dict]:
    return [{"a": a, "x": x, "b": b, "y": y, "w": w} for ((a, x), (b, y)), w in matrix.items()]


def _matrices(rows: list[dict]) -> list[dict]:
    return [{((e["a"], e["x"]), (e["b"], e["y"])): e["w"] for e in r["entries"]} for r in rows]


def _chunks(model: bytes, chunk: int):
    """mapInArrow: (key, doc_id, text) to overlapping chunks: body is what pieces can reach from [chunk * n, chunk * (n+1))."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("lead", pa.int32()), ("size", pa.int32()), ("body", pa.string())])

    def run(batches):
        v = _vocabulary(model)

        def rows():
            for batch in batches:
                for key, doc, text in zip(*(batch.column(c) for c in ("key", "doc_id", "text")), strict=True):
                    normal = v.normal(text.as_py())
                    total = max(1, len(normal) // chunk)  # the last one takes the rest
                    for n in range(total):
                        begin, end = n * chunk, len(normal) if n == total - 1 else (n + 1) * chunk
                        low, high = max(0, begin - v.longest), min(len(normal), end + v.longest)
                        yield {"key": key.as_py(), "doc_id": doc.as_py(), "n": n, "lead": begin - low, "size": end - begin, "body": normal[low:high]}

        return _batched(rows(), schema)

    return run


def _transfers(model: bytes):
    """mapInArrow: chunks to the finite entries of their transfer matrices; g numbers groups of chunks."""
    schema = pa.schema([("key", pa.int64()), ("g", pa.int32()), ("n", pa.int32()), ("entries", pa.list_(ENTRY))])

    def run(batches):
        v = _vocabulary(model)

        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    found = v.transfer(r["body"], r["lead"], r["lead"] + r["size"], r["n"] == 0)
                    yield {"key": r["key"], "g": r["n"] // GROUP, "n": r["n"], "entries": _packed({(s, t): w for s, t, w in found})}

        return _batched(rows(), schema)

    return run


def scan(matrices: list[dict], enter: tuple[str, int] = ("", 0), leave: tuple[str, int] | None = None) -> list:
    """The states at the cuts of the best path through all matrices from the entering to the leaving state (default: the best one that
    ends with the text), both included."""
    ahead = [{enter: 0.0}]
    for matrix in matrices:
        out: dict = {}
        for (s, t), w in matrix.items():
            if s in ahead[-1] and ahead[-1][s] + w > out.get(t, MINUS):
                out[t] = ahead[-1][s] + w
        ahead.append(out)
    ends = ahead[-1]
    state = leave or max((t for t in ends if t[1] == 0), key=lambda t: (ends[t], t))
    states = [state]
    for matrix, before in zip(matrices[::-1], ahead[-2::-1], strict=True):
        into = {s: w for (s, t), w in matrix.items() if t == state and s in before}
        state = max(into, key=lambda s: (into[s] + before[s], s))
        states.append(state)
    return states[::-1]


def _product(table: pa.Table) -> pa.Table:
    """applyInArrow: the matrices of a group of chunks to their product, which keeps the states at the group's ends only."""
    rows = sorted(table.to_pylist(), key=lambda r: r["n"])
    schema = pa.schema([("key", pa.int64()), ("g", pa.int32()), ("entries", pa.list_(ENTRY))])
    return pa.Table.from_pylist([{"key": rows[0]["key"], "g": rows[0]["g"], "entries": _packed(reduce(compose, _matrices(rows)))}], schema)


def _choose(number: str, bounded: bool):
    """applyInArrow: matrices in the order of a column to the states at both ends of each; if bounded, between the states in their rows."""
    schema = pa.schema([("key", pa.int64()), (number, pa.int32()), *STATES])

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r[number])
        ends = [(rows[0][a], rows[0][f"{a}_over"]) for a in ("enter", "leave")] if bounded else []
        states = scan(_matrices(rows), *ends)
        out = [{"key": r["key"], number: r[number], "enter": s[0], "enter_over": s[1], "leave": t[0], "leave_over": t[1]} for r, s, t in zip(rows, states, states[1:])]
        return pa.Table.from_pylist(out, schema)

    return run


def _backtrace(model: bytes):
    """mapInArrow: chunks with the states at their ends to their ids, and whether these decode to what they stand for."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("ids", pa.list_(pa.int32())), ("same", pa.bool_())])

    def run(batches):
        v = _vocabulary(model)
        packed = lambda pieces: b"".join(map(v.packed, pieces))

        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    body, begin, end = r["body"], r["lead"], r["lead"] + r["size"]
                    entry, leave = (r["enter"], r["enter_over"]), (r["leave"], r["leave_over"])
                    spots = v.resets(body, begin, end)
                    if spots and spots[0] < spots[1]:
                        ids = packed(v.trace(body, begin, spots[0], entry)) + v.encode(body[spots[0] : spots[1]]) + packed(v.trace(body, spots[1], end, ("", 0), leave))
                    else:
                        ids = packed(v.trace(body, begin, end, entry, leave))
                    ids = np.frombuffer(ids, "<i4")
                    told = b"".join(map(v.raw.__getitem__, ids.tolist()))
                    own = body[begin + r["enter_over"] : end + r["leave_over"]].replace(SPACE, " ").encode()
                    yield {"key": r["key"], "doc_id": r["doc_id"], "n": r["n"], "ids": ids, "same": told == own}

        return _batched(rows(), schema)

    return run


def encode(docs: DataFrame, model: bytes | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids (array of int), round_trip for each row of docs (doc_id, text): the ids that the model gives the whole text.

    A null text is encoded as an empty one, to no ids. round_trip tells whether the ids decode to the text again; the model
    writes spaces as U+2581, so that character decodes to a space, which counts as equal. Repeated rows are encoded each; other
    columns are ignored; an empty table gives none.

    Texts of more than two chunks are cut into chunks of any content. Each chunk's transfer matrix between the states at its
    ends is found on its own; matrices are multiplied in groups, a task each; one short scan over the products gives the states at
    the ends of the groups, and a scan in each group those at the ends of its chunks. Each chunk is traced back on its own.
    """
    model = model or load_model()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    length = F.length(F.coalesce("text", F.lit("")))
    short = texts.where(length <= 2 * chunk).mapInArrow(_encode_short(model), "doc_id bigint, ids array<int>, round_trip boolean")
    long = texts.where(length > 2 * chunk).withColumn("key", F.monotonically_increasing_id())  # settled below, so it never changes
    shape = "key bigint, doc_id bigint, n int, lead int, size int, body string"
    parts = settle(long.select("key", "doc_id", "text").mapInArrow(_chunks(model, chunk), shape).repartition("key", "n"), "chunks")
    moves = settle(parts.select("key", "n", "lead", "size", "body").mapInArrow(_transfers(model), f"key bigint, g int, n int, {ENTRIES}"), "moves")
    ends = "enter string, enter_over int, leave string, leave_over int"
    products = moves.groupBy("key", "g").applyInArrow(_product, f"key bigint, g int, {ENTRIES}")
    groups = products.groupBy("key").applyInArrow(_choose("g", False), f"key bigint, g int, {ends}")
    states = settle(moves.join(groups, ["key", "g"]).groupBy("key", "g").applyInArrow(_choose("n", True), f"key bigint, n int, {ends}"), "states")
    traced = parts.join(states, ["key", "n"]).mapInArrow(_backtrace(model), "key bigint, doc_id bigint, n int, ids array<int>, same boolean")
    whole = traced.groupBy("key", "doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "ids"))).alias("parts"), F.bool_and("same").alias("round_trip"))
    return short.unionByName(whole.select("doc_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), "round_trip"))


def decode(tokens: DataFrame, model: bytes | None = None) -> DataFrame:
    """doc_id, text for each row of tokens (doc_id, ids), of any length; null ids give a null text, no ids an empty one. Repeated rows are
    decoded each; other columns are ignored; an empty table gives none."""
    model = model or load_model()

    def run(batches):
        v = _vocabulary(model)
        for batch in batches:
            texts = [None if not ids.is_valid else v.decode(ids.as_py()) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")
