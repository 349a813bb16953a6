"""A running top-k over a stream of rows: each micro-batch's k best are merged with the k best so far."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.window import Window

from ..functions.scalar import score
from ..operators.topk import TopKQuery, top


class RunningTopK:
    """Use as foreachBatch(running). The state is k rows, written under path/<batch>, so a batch that is run again starts from the
    one before it and gives the same state."""

    def __init__(self, path: str, keys, q: TopKQuery):
        self.path, self.keys, self.q = path, tuple(keys), q

    def __call__(self, rows: DataFrame, batch: int) -> None:
        best = top(rows.select(*self.keys, score(self.q.attrs, self.q.weights).alias("score")), self.keys, self.q.k)
        if batch:
            best = top(best.unionByName(self.state(rows.sparkSession, batch - 1)), self.keys, self.q.k)
        best.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        self.last = batch

    def state(self, spark, batch: int | None = None) -> DataFrame:
        return spark.read.parquet(f"{self.path}/batch={self.last if batch is None else batch}")


def windowed_best(stream: DataFrame, time: str, width: str, late: str, key: str, value: str) -> DataFrame:
    """(window, key, best) of an event stream: the largest value a key has in each tumbling window, closed by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.max(value).alias("best"))


def _keep_best(k: int):
    """The state of a window and salt is its k best (value, key) pairs so far; they are given once the watermark passes the window."""

    def run(group, batches, state: GroupState) -> Iterator[pd.DataFrame]:
        start, end, _ = group
        if state.hasTimedOut:
            values, keys = state.get
            state.remove()
            yield pd.DataFrame({"start": [start] * len(keys), "end": [end] * len(keys), "key": keys, "value": values})
            return
        best = list(zip(*state.get, strict=True)) if state.exists else []
        for rows in batches:
            best = sorted([*best, *zip(rows["value"].tolist(), rows["key"].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
        state.update(([v for v, _ in best], [key for _, key in best]))
        state.setTimeoutTimestamp(max(int(pd.Timestamp(end).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    return run


def windowed_topk(stream: DataFrame, time: str, width: str, late: str, key: str, value: str, k: int, salts: int = 16) -> DataFrame:
    """(start, end, key, value) of an event stream: the k largest values (key a long, value a double) of each of `salts` shares of
    each tumbling window, once the watermark closes it. A share holds k rows of state, and one window's rows are not one task's;
    best_of_windows() merges the shares."""
    rows = stream.withWatermark(time, late).select(F.window(time, width).alias("w"), F.col(time), F.col(key).cast("long").alias("key"), F.col(value).cast("double").alias("value"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("key", "value"), F.lit(salts)).cast("int"))
    edge = lambda c: F.timestamp_micros(F.unix_micros(F.col(c)))  # noqa: E731  only the time column carries the watermark
    rows = rows.withColumns({"start": edge("w.start"), "end": edge("w.end")}).drop("w")
    return rows.groupBy("start", "end", "salt").applyInPandasWithState(
        _keep_best(k), "start timestamp, end timestamp, key long, value double", "values array<double>, keys array<long>", "append", "EventTimeTimeout"
    )


def best_of_windows(shares: DataFrame, k: int) -> DataFrame:
    """(start, end, rank, key, value): the k best of each window of what windowed_topk() gave."""
    ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy("start", "end").orderBy(F.desc("value"), "key")))
    return ranked.where(F.col("rank") <= k).select("start", "end", "rank", "key", "value")
