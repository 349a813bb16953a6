"""Top-k of a delimited file from the command line: python -m apexrank -f rel_1000_4.csv -d 4 -n 1000 -k 16 -q 2 -a index"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.scalar import normalized
from .operators import topk
from .operators.topk import TopKQuery
from .plans import block_index
from .relation import Relation
from .sources import files

PLANS = {
    "scan": lambda r: lambda q: topk.scan(r, q),
    "threshold": lambda r: lambda q: topk.threshold(r, q),
    "suffix": lambda r: lambda q: topk.by_suffix(r, q),
    "index": lambda r: (lambda index: lambda q: block_index.topk(index, q))(block_index.build(r, 1024)),
    "angle": lambda r: (lambda index: lambda q: block_index.topk(index, q))(block_index.build(r, 1024, "angle")),
}


def options(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="apexrank", description=__doc__)
    p.add_argument("-f", "--file", required=True)
    p.add_argument("-d", "--attrs", type=int, required=True, help="attributes of the file")
    p.add_argument("-n", "--rows", type=int, required=True, help="rows that the file has to have")
    p.add_argument("-k", type=int, default=16)
    p.add_argument("-q", "--queried", type=int, help="attributes to query, the last ones; all by default")
    p.add_argument("-w", "--weights", type=lambda s: [float(x) for x in s.split(",")], help="a weight for each queried attribute")
    p.add_argument("-a", "--plan", choices=sorted(PLANS), default="scan")
    return p.parse_args(argv)


def main(argv=None, spark: SparkSession | None = None) -> dict:
    """Runs the query and prints one JSON line: seconds of init and query, the k-th score, and the rows."""
    o = options(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    df = files.read_relation(spark, o.file, o.attrs).withColumn("tid", F.monotonically_increasing_id())
    r = normalized(Relation.of(df, ["tid"], [f"a{i}" for i in range(o.attrs)]))
    if r.df.count() != o.rows:
        raise SystemExit(f"{o.file} does not have {o.rows} rows of {o.attrs} numbers")
    own = r.attrs[-(o.queried or o.attrs) :]
    q = TopKQuery(o.k, own, tuple(o.weights or (1.0,) * len(own)))
    began = time.perf_counter()
    run = PLANS[o.plan](r)
    ready = time.perf_counter()
    rows = [list(row) for row in run(q).collect()]
    out = {"init": round(ready - began, 4), "query": round(time.perf_counter() - ready, 4), "threshold": rows[-1][-1] if rows else None, "rows": rows}
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
