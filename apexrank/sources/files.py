"""Relations as delimited files: schema from a name or a shape, reading, writing, inferring the shape."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def relation_schema(d: int, kind: T.DataType | None = None) -> T.StructType:
    """a0.. of any width."""
    return T.StructType([T.StructField(f"a{i}", kind or T.DoubleType()) for i in range(d)])


def name_shape(path: str) -> tuple[str, int, int]:
    """(name, rows, attributes) of a file called <name>_<n>_<d>."""
    found = re.fullmatch(r"(.+)_(\d+)_(\d+)(?:\.\w+)?", path.rstrip("/").rpartition("/")[2])
    if not found:
        raise ValueError(f"no shape in the name {path!r}")
    return found[1], int(found[2]), int(found[3])


def read_relation(spark: SparkSession, path: str, d: int | None = None, sep: str = ",", header: bool = False, numbered: bool = False) -> DataFrame:
    """A headerless file of numbers; numbered: the first column is a row number and is left out. d defaults to the name's."""
    d = d or name_shape(path)[2]
    shape = T.StructType([T.StructField("row", T.LongType()), *relation_schema(d)]) if numbered else relation_schema(d)
    return spark.read.schema(shape).option("sep", sep).option("header", header).csv(path).select(*[f"a{i}" for i in range(d)])


def infer_shape(spark: SparkSession, path: str, sep: str = ",", header: bool = False) -> tuple[int, int]:
    """(rows, attributes) of a delimited file: its lines with a value are counted, and the first one's columns."""
    lines = spark.read.option("sep", sep).option("header", header).csv(path)
    return lines.count(), len(lines.columns)


def body_lines(spark: SparkSession, paths, skip: int = 0) -> DataFrame:
    """(value) of the lines of text files, less the first `skip` of each file. Rows are numbered as they are read, so the head of a file
    is told from the least number of its first block."""
    at = "file", "start", "id"
    meta = [F.col("_metadata.file_path").alias(at[0]), F.col("_metadata.file_block_start").alias(at[1]), F.monotonically_increasing_id().alias(at[2])]
    lines = spark.read.text(paths).select("value", *meta)
    if not skip:
        return lines.select("value")
    heads = F.broadcast(lines.where("start = 0").groupBy("file").agg(F.min("id").alias("head")))  # a row a file
    return lines.join(heads, "file").where((F.col("start") > 0) | (F.col("id") >= F.col("head") + skip)).select("value")


def read_columns(spark: SparkSession, paths, places, sep: str = ",", skip: int = 0) -> DataFrame:
    """a0..: columns of delimited files by place (from 0), one file after the other, their first `skip` lines left out."""
    cells = F.split("value", re.escape(sep))
    rows = body_lines(spark, paths, skip).where("trim(value) <> ''").select(cells.alias("c"))
    return rows.select(*[F.expr(f"try_cast(trim(get(c, {p})) as double)").alias(f"a{i}") for i, p in enumerate(places)])


def write_relation(df: DataFrame, path: str, attrs, form: str = "csv", sep: str = ",") -> None:
    rows = df.select(*attrs)
    rows.write.option("sep", sep).csv(path) if form == "csv" else rows.write.format(form).save(path)


def shape(df: DataFrame) -> DataFrame:
    """(n, d) of a table."""
    return df.agg(F.count("*").alias("n")).withColumn("d", F.lit(len(df.columns)).cast("bigint"))


def head(df: DataFrame, keys, n: int) -> DataFrame:
    """The first n rows in key order."""
    return df.orderBy(*keys).limit(n)


def quantized(df: DataFrame, attrs, bits: int = 30) -> DataFrame:
    """Attributes in [0, 1] as integers of so many bits."""
    return df.withColumns({a: F.round(F.col(a) * float(1 << bits)).cast("bigint") for a in attrs})


def unquantized(df: DataFrame, attrs, bits: int = 30) -> DataFrame:
    """Integers of so many bits as attributes in [0, 1] again."""
    return df.withColumns({a: F.col(a).cast("double") / float(1 << bits) for a in attrs})


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(metric, value) of the run logs below a path."""
    return run_metrics(spark.read.text(path))


def run_metrics(lines: DataFrame) -> DataFrame:
    """(metric, value) of a run log's lines `name: value` (column value)."""
    pattern = r"^\s*([A-Za-z_ ]+?)\s*:\s*([0-9.eE+-]+)"
    found = lines.select(F.regexp_extract("value", pattern, 1).alias("metric"), F.expr(rf"try_cast(regexp_extract(value, r'{pattern}', 2) as double)").alias("number"))
    return found.where("metric <> '' and number is not null").select("metric", F.col("number").alias("value"))
