"""A relation of numeric attributes: its frame, key columns (the tie-break, in order) and attribute columns."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow side of a join is broadcast.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    keys: tuple[str, ...]
    attrs: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame, keys, attrs) -> Relation:
        """Attributes as doubles; rows with a null or NaN attribute are left out."""
        own = df.select(*keys, *[F.col(a).cast("double").alias(a) for a in attrs if a not in keys])
        return cls(own.where(" and ".join(f"{a} is not null and not isnan({a})" for a in attrs)), tuple(keys), tuple(attrs))

    def over(self, attrs) -> Relation:
        return replace(self, attrs=tuple(attrs))

    def using(self, df: DataFrame) -> Relation:
        return replace(self, df=df)

    def columns(self) -> list[str]:
        """Keys, then the attributes that are not keys."""
        return [*self.keys, *[a for a in self.attrs if a not in self.keys]]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new local one, with a local master only."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="apexrank-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, what: str = "table") -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """df written to and read back from the shared folder."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows allow."""
    return F.broadcast(df) if rows <= most else df
