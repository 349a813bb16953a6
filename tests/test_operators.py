"""Agreement of all top-k operators, index invariants, skylines and edge cases on small relations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from apexrank import __main__ as cli
from apexrank import relation as tables
from apexrank.functions import scalar
from apexrank.operators import preparation as prep
from apexrank.operators import ranking, skyline, topk
from apexrank.operators.topk import TopKQuery
from apexrank.plans import block_index
from apexrank.relation import Relation
from apexrank.sources import files, generators
from apexrank.streaming.running import RunningTopK, best_of_windows, windowed_topk

RUNS = {
    "two_stage": topk.two_stage,
    "threshold": topk.threshold,
    "seen": topk.seen,
    "largest": topk.by_largest_attribute,
    "suffix": topk.by_suffix,
    "early suffix": lambda r, q: topk.by_suffix(r, q, early=True),
    "partitioned": lambda r, q: topk.partitioned(r, q, ranking.dealt_parts(r, 5)),
    "range index": lambda r, q: block_index.topk(block_index.build(r, 64), q),
    "angle index": lambda r, q: block_index.topk(block_index.build(r, 64, "angle"), q),
}


def relation(spark, values) -> Relation:
    d = len(values[0]) if len(values) else 2
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], "tid bigint, " + ", ".join(f"a{m} double" for m in range(d)))
    return Relation.of(df, ["tid"], [f"a{m}" for m in range(d)])


def expected(values, q: TopKQuery):
    scored = [(-sum(w * v[int(a[1:])] for a, w in zip(q.attrs, q.weights)), i) for i, v in enumerate(values)]
    return [i for _, i in sorted((round(s, 9), i) for s, i in scored)[: q.k]]


def ids(df):
    return [r.tid for r in df.collect()]


rng = np.random.default_rng(3)
CASES = {
    "even": rng.random((400, 3)).round(3),
    "ties": rng.integers(0, 4, (400, 3)) / 4,
    "odd": rng.random((7, 3)).round(3),
    "one": np.array([[0.5, 0.25, 1.0]]),
    "constant": np.column_stack((rng.random(50).round(3), np.full(50, 0.5), rng.random(50).round(3))),
}


@pytest.mark.parametrize("run", sorted(RUNS))
@pytest.mark.parametrize("case", sorted(CASES))
def test_operators_agree(spark, run, case):
    values = CASES[case]
    r = relation(spark, values)
    q = TopKQuery(5, ("a0", "a2"), (0.25, 1.0))
    assert ids(RUNS[run](r, q)) == expected(values, q)


def test_k_beyond_the_rows_and_empty_input(spark):
    q = TopKQuery(50, ("a0", "a1", "a2"), (1.0, 0.5, 0.25))
    for name, run in RUNS.items():
        assert ids(run(relation(spark, CASES["odd"]), q)) == expected(CASES["odd"], q), name
    empty = Relation(spark.createDataFrame([], "tid bigint, a0 double, a1 double"), ("tid",), ("a0", "a1"))
    assert ids(topk.scan(empty, TopKQuery(3, ("a0", "a1"), (1.0, 1.0)))) == []
    assert ids(topk.threshold(empty, TopKQuery(3, ("a0", "a1"), (1.0, 1.0)))) == []


PRUNING = {name: RUNS[name] for name in ("largest", "suffix", "early suffix", "partitioned", "range index", "angle index")}


@pytest.mark.parametrize("run", sorted(PRUNING))
def test_pruning_with_unequal_weights_and_negative_values(spark, monkeypatch, run):
    monkeypatch.setattr(topk, "SHARE", 0.3)
    monkeypatch.setattr(topk.floor, "__defaults__", (0.3,))
    for shift in (0.0, -0.6, -2.0):
        values = (CASES["even"] + shift).round(3)
        for q in (TopKQuery(4, ("a0", "a1", "a2"), (0.1, 1.0, 0.0)), TopKQuery(4, ("a2", "a1"), (1.0, 1.0)), TopKQuery(3, ("a1",), (2.0,))):
            if run == "angle index" and shift:
                continue  # angles are taken of normalised values
            assert ids(PRUNING[run](relation(spark, values), q)) == expected(values, q), (shift, q)


def test_floors_prune(spark):
    r = Relation.of(generators.independent(spark, 20_000, 3), ["tid"], ["a0", "a1", "a2"])
    q = TopKQuery(4, ("a0", "a1", "a2"), (1.0, 1.0, 1.0))
    least = topk.floor(r, q)
    assert 0 < r.df.where(scalar.score(q.attrs) >= least).count() < 2000
    assert ids(topk.by_suffix(r, q)) == ids(topk.scan(r, q)) == ids(topk.by_largest_attribute(r, q))


def test_queries_are_checked(spark):
    for k, attrs, weights in ((0, ("a0",), (1.0,)), (1, ("a0",), (-1.0,)), (1, ("a0",), (float("nan"),)), (1, ("a0", "a1"), (1.0,)), (1, (), ()), (1, ("a0", "a0"), (1.0, 1.0))):
        with pytest.raises(ValueError):
            TopKQuery(k, attrs, weights)
    r = relation(spark, CASES["odd"])
    for run in RUNS.values():
        with pytest.raises(ValueError, match="unknown"):
            run(r, TopKQuery(1, ("a9",), (1.0,)))
    with pytest.raises(ValueError, match="unknown"):
        topk.batch(r, {0: TopKQuery(1, ("a9",), (1.0,))})


def test_batches_and_workloads(spark):
    values = CASES["ties"]
    r = relation(spark, values)
    queries = topk.workload(r.attrs, 30, 4, weights=(0.5, 1.0, 0.25)) | {100: TopKQuery(7, ("a0", "a1"), (1.0, 0.0))}
    assert {len(q.attrs) for q in queries.values()} == {2, 3} and len(topk.distinct_queries(queries)[0]) == 3
    index = block_index.build(r, 64)
    for frame in (topk.batch(r, queries), block_index.topk_batch(index, queries)):
        found = {}
        for row in frame.orderBy("qid", "rank").collect():
            found.setdefault(row.qid, []).append(row.tid)
        assert found == {i: expected(values, q) for i, q in queries.items()}
    assert topk.batch(r, {}).collect() == []


@pytest.mark.parametrize("key", ["string", "date", "decimal(20,2)"])
def test_keys_of_any_type(spark, key):
    values = CASES["ties"]
    df = relation(spark, values).df
    name = {"string": F.concat(F.lit("station-"), F.lpad("tid", 5, "0")), "date": F.expr("date_add(date'2020-01-01', cast(tid as int))"), "decimal(20,2)": F.col("tid").cast(key)}[key]
    r = Relation.of(df.withColumn("name", name).drop("tid"), ["name"], ["a0", "a1", "a2"])
    q = TopKQuery(5, ("a0", "a2"), (0.25, 1.0))
    want = [row.name for row in topk.scan(r, q).collect()]
    for run in RUNS.values():
        assert [row.name for row in run(r, q).collect()] == want
    order = [row.name for row in ranking.ranks(r).orderBy("r1").collect()]
    assert order == [row.name for row in r.df.orderBy(F.desc("a1"), "name").collect()]


def test_ranks_equal_windows(spark):
    r = relation(spark, CASES["ties"])
    part = F.pmod("tid", F.lit(3))
    for p in (None, part):
        rows = ranking.positions(r, p).collect()
        for m in range(3):
            lists = {}
            for row in rows:
                lists.setdefault(row.part, []).append((-row[f"a{m}"], row.tid, row[f"r{m}"]))
            assert all([x[2] for x in sorted(own)] == list(range(len(own))) for own in lists.values())
        assert all(row.minpos == min(row.r0, row.r1, row.r2) and row.maxpos == max(row.r0, row.r1, row.r2) for row in rows)
    empty = r.using(r.df.limit(0))
    assert ranking.positions(empty).collect() == [] and ranking.range_parts(empty, 4).collect() == []


def scanned(df) -> int:
    """Rows that the file scans of a collected frame gave."""
    df.collect()
    plan, rows = df._jdf.queryExecution().executedPlan(), 0
    stack = [plan.finalPhysicalPlan() if "Adaptive" in plan.getClass().getName() else plan]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            rows += node.metrics().apply("numOutputRows").value()
        if name.endswith("QueryStageExec"):
            stack.append(node.plan())
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return rows


def test_a_query_reads_few_rows_of_the_index(spark, tmp_path):
    n = 40_000
    r = Relation.of(generators.independent(spark, n, 2), ["tid"], ["a0", "a1"])
    q = TopKQuery(8, ("a0", "a1"), (1.0, 0.5))
    want = ids(topk.scan(r, q))
    spark._jsc.hadoopConfiguration().set("parquet.page.row.count.limit", "500")
    block_index.build(r, 256).write(str(tmp_path / "index"))
    index = block_index.BlockIndex.read(spark, str(tmp_path / "index"), r.keys, r.attrs, 256)
    rows = block_index.read_rows(index, q)
    plan = rows._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(at," in plan and "LessThanOrEqual(at," in plan
    assert scanned(rows) < n / 2 and ids(block_index.topk(index, q)) == want
    told = block_index.report(index, q).first()
    assert told.rows == n and told.evaluated < n / 2 and rows.count() == told.evaluated
    spark._jsc.hadoopConfiguration().unset("parquet.page.row.count.limit")


def test_block_bounds_hold(spark):
    r = relation(spark, CASES["ties"])
    blocked = ranking.blocks(r, 32)
    bounds = {b.block: b for b in ranking.block_bounds(blocked, r).collect()}
    for row in blocked.collect():
        if row.block:
            before = bounds[row.block - 1]
            assert all(row[f"a{m}"] <= before[f"t{m}"] for m in range(3))


def test_the_index_skips_rows(spark):
    r = Relation.of(generators.independent(spark, 20_000, 2), ["tid"], ["a0", "a1"])
    index = block_index.build(r, 256)
    kept = block_index.survivors(index, TopKQuery(8, ("a0", "a1"), (1.0, 1.0))).count()
    assert kept < index.bounds.count() / 2


def test_a_written_index_reads_back(spark, tmp_path):
    r = relation(spark, CASES["even"])
    q = TopKQuery(6, ("a0", "a1"), (1.0, 0.5))
    block_index.build(r, 64, "angle").write(str(tmp_path / "index"))
    index = block_index.BlockIndex.read(spark, str(tmp_path / "index"), r.keys, r.attrs, 64)
    assert ids(block_index.topk(index, q)) == expected(CASES["even"], q)


def brute_skyline(values):
    return sorted(i for i, b in enumerate(values) if not any((a >= b).all() and (a > b).any() for a in values))


@pytest.mark.parametrize("case", sorted(CASES))
def test_skyline_and_layers(spark, case):
    values = CASES[case]
    r = relation(spark, values)
    assert sorted(ids(skyline.skyline(r))) == brute_skyline(values)
    assert set(brute_skyline(values)) <= set(ids(skyline.prefilter(r)))


@pytest.mark.parametrize("d", [1, 2, 4])
def test_kernel_equals_brute_force(monkeypatch, d):
    monkeypatch.setattr(skyline, "CHUNK", 16)
    monkeypatch.setattr(skyline, "CELLS", 64)
    for values in (rng.random((300, d)), rng.integers(0, 3, (200, d)) * 1.0, -rng.random((80, d)), np.empty((0, d)), np.full((5, d), 0.1 + 0.2)):
        assert sorted(np.flatnonzero(skyline.local_rows(values))) == brute_skyline(values)
        assert sorted(np.flatnonzero(skyline.local_rows(values, values[:7]))) == brute_skyline(values)
    hidden = np.array([[1e16, 1.0], [1e16, 0.5], [1.0, 1e16]])  # equal sums by rounding
    assert sorted(np.flatnonzero(skyline.local_rows(hidden))) == [0, 2]


def test_candidates_meet_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(skyline, "LAST", 100)
    r = Relation.of(generators.anticorrelated(spark, 3000, 3), ["tid"], ["a0", "a1", "a2"])
    values = np.array([[row.a0, row.a1, row.a2] for row in r.df.orderBy("tid").collect()])
    phases = []
    assert sorted(ids(skyline.skyline(r, phases=phases))) == brute_skyline(values)
    assert phases[0][0] == "prefilter" and phases[-1][0] == "pairs" and phases[-1][2] > 100
    assert sorted(ids(skyline.skyline(r, largest=False))) == brute_skyline(-values)
    told = {x.phase: x.rows for x in skyline.dominance_tests(r).collect()}
    assert told["skyline"] == len(brute_skyline(values)) <= told["local"]


def test_masked_pairs_are_the_pairs(spark):
    r = relation(spark, CASES["ties"][:120])
    plain, masked = (sorted(map(tuple, skyline.dominance_pairs(r, m).collect())) for m in (False, True))
    assert plain == masked and plain
    assert "Cartesian" not in skyline.dominance_pairs(r, True)._jdf.queryExecution().executedPlan().toString()


def test_layers_stack(spark):
    values = CASES["odd"]
    found = {r.tid: r.layer for r in skyline.layers(relation(spark, values)).collect()}
    for i, b in enumerate(values):
        above = [found[j] for j, a in enumerate(values) if (a >= b).all() and (a > b).any()]
        assert found[i] == (max(above) + 1 if above else 0)


@pytest.mark.parametrize("most", [None, 0, 1, 3, 99])
@pytest.mark.parametrize("last", [10, 50_000])
def test_layers_equal_brute_force(spark, monkeypatch, most, last):
    monkeypatch.setattr(skyline, "LAST", last)
    values = CASES["ties"][:60]
    left, want, n = dict(enumerate(values)), {}, 0
    while left and n != most:
        ids_ = list(left)
        top = [ids_[i] for i in brute_skyline([left[i] for i in ids_])]
        want |= {i: n for i in top}
        left = {i: v for i, v in left.items() if i not in top}
        n += 1
    want |= {i: most for i in left}
    r = relation(spark, values)
    found = skyline.layers(r.using(r.df.repartition(4)), most)
    assert {x.tid: x.layer for x in found.collect()} == want and found.columns == ["tid", "a0", "a1", "a2", "layer"]
    assert skyline.layers(r.using(r.df.limit(0)), most).collect() == []


def test_equal_rows_do_not_dominate_each_other(spark):
    assert sorted(ids(skyline.skyline(relation(spark, [(1, 1), (1, 1), (0, 1)])))) == [0, 1]


def test_nulls_and_constants_in_normalisation(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, None, 5.0), (4, float("nan"), 5.0)], "tid int, a0 double, a1 double")
    rows = {r.tid: (r.a0, r.a1) for r in scalar.normalized(Relation.of(df, ["tid"], ["a0", "a1"])).df.collect()}
    assert rows == {1: (0.0, 0.0), 2: (1.0, 0.0)}


def test_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "rel_3_2")
    files.write_relation(relation(spark, [(0.1, 0.2), (0.3, 0.4), (0.5, 0.6)]).df, path, ["a0", "a1"])
    assert files.name_shape(path) == ("rel", 3, 2)
    assert sorted(map(tuple, files.read_relation(spark, path).collect())) == [(0.1, 0.2), (0.3, 0.4), (0.5, 0.6)]


def test_lines_without_heads_and_shapes(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("vendor,x,y\n\n" + "".join(f"{name},{i},{i}.5\n" for i in range(40)))
    (tmp_path / "c.csv").write_text("vendor,x,y\n")
    paths = [str(tmp_path / f"{n}.csv") for n in "abc"]
    rows = files.read_columns(spark, paths, (2, 1), skip=2).collect()
    assert sorted(map(tuple, rows)) == sorted([(i + 0.5, float(i)) for i in range(40)] * 2)
    assert files.infer_shape(spark, paths[0], header=True) == (40, 3)
    (tmp_path / "run.log").write_text("tt_init: 1.5\nnonsense\ntuple_count: 12\n")
    assert sorted(map(tuple, files.read_metrics(spark, str(tmp_path / "run.log")).collect())) == [("tt_init", 1.5), ("tuple_count", 12.0)]
    path = str(tmp_path / "numbered_2_2")
    spark.createDataFrame([("0,0.5,0.25",), ("1,1.0,0.75",)], "value string").write.text(path)
    assert sorted(map(tuple, files.read_relation(spark, path, numbered=True).collect())) == [(0.5, 0.25), (1.0, 0.75)]


def test_integers_and_back(spark):
    df = spark.createDataFrame([(0.0,), (0.125,), (1.0,), (1 / 3,)], "a0 double")
    back = [r.a0 for r in files.unquantized(files.quantized(df, ["a0"]), ["a0"]).collect()]
    assert np.allclose(back, [0.0, 0.125, 1.0, 1 / 3], atol=2**-30)


def test_float_bits(spark):
    values = [0.0, 0.5, 1.0, 3.25, 1e-30]
    found = spark.createDataFrame([(v,) for v in values], "a0 double").select("a0", scalar.float_bits(F.col("a0")).alias("b")).collect()
    assert all(r.b == int.from_bytes(np.float32(r.a0).tobytes(), "little") for r in found)
    assert [r.a0 for r in sorted(found, key=lambda r: r.b)] == sorted(values)


def test_differences_of_results(spark):
    a, b = (spark.createDataFrame([(i,) for i in own], "tid bigint") for own in ([3, 1, 2, 2], [2, 3, 4]))
    assert sorted(map(tuple, prep.differences(a, b, ["tid"]).collect())) == [("a", 1), ("a", 2), ("b", 4)]


def test_distributions(spark):
    def columns(df):
        return np.array([list(r)[1:] for r in df.collect()])

    corr = lambda x: np.corrcoef(x.T)[0, 1]
    assert abs(corr(columns(generators.independent(spark, 4000, 2)))) < 0.06
    assert corr(columns(generators.correlated(spark, 4000, 2))) > 0.7
    assert corr(columns(generators.anticorrelated(spark, 4000, 2))) < -0.5
    for make in (generators.lognormal, generators.pareto, generators.zipf, generators.block_scaled):
        x = columns(make(spark, 4000, 3))
        assert x.min() >= 0 and abs(x.max() - 1) < 1e-9 and np.mean(x) < 0.4
    z = columns(generators.zipf(spark, 4000, 1))
    assert (z == z.min()).mean() > 0.4  # the least value is by far the commonest
    df = generators.told_apart(spark.range(500).select(F.col("id").alias("tid"), F.lit(0.5).alias("a0")), ["tid"], ["a0"])
    assert len({r.a0 for r in df.collect()}) == 500


def test_topk_of_windows(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(400).select(F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id)").alias("ts"), F.col("id").alias("key"), F.expr("cast(pmod(id * 37, 101) as double)").alias("value"))
    rows.repartitionByRange(4, "ts").write.parquet(source)
    spark.createDataFrame([("2025-01-01 00:00:00", 0, 0.0)], "ts string, key bigint, value double").selectExpr("cast(ts as timestamp) as ts", "key", "value").write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    shares = windowed_topk(stream, "ts", "100 seconds", "500 seconds", "key", "value", 3, salts=2)
    run = shares.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    found = {}
    for r in best_of_windows(spark.read.parquet(out), 3).orderBy("start", "rank").collect():
        found.setdefault(r.start.timestamp(), []).append(r.key)
    want = [sorted(range(w, w + 100), key=lambda i: (-(i * 37 % 101), i))[:3] for w in range(0, 400, 100)]
    first = min(found)
    assert [found[first + w] for w in range(0, 400, 100)] == want


@pytest.mark.parametrize("plan", sorted(cli.PLANS))
def test_command_line(spark, tmp_path, plan):
    path = str(tmp_path / "rel_400_3")
    values = CASES["even"]
    files.write_relation(relation(spark, values).df.coalesce(1), path, ["a0", "a1", "a2"])
    out = cli.main(["-f", path, "-d", "3", "-n", "400", "-k", "4", "-q", "2", "-w", "0.5,1", "-a", plan], spark)
    low, high = values.min(0), values.max(0)
    score = ((values - low) / (high - low)) @ np.array([0, 0.5, 1])
    assert np.allclose([r[-1] for r in out["rows"]], np.sort(score)[::-1][:4]) and out["threshold"] == out["rows"][-1][-1]
    with pytest.raises(SystemExit):
        cli.main(["-f", path, "-d", "3", "-n", "7"], spark)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        tables.shared_dir(Session)


def test_running_topk_over_a_stream(spark, tmp_path):
    source, q = str(tmp_path / "in"), TopKQuery(3, ("a0", "a1"), (1.0, 1.0))
    df = relation(spark, CASES["even"]).df.select("tid", "a0", "a1")
    df.repartition(4).write.parquet(source)
    sink = RunningTopK(str(tmp_path / "state"), ["tid"], q)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert ids(sink.state(spark).orderBy(F.desc("score"), "tid")) == expected(CASES["even"], q)


def test_plans_stay_lean(spark):
    r = relation(spark, CASES["even"])
    plan = topk.scan(r, TopKQuery(3, ("a0",), (1.0,)))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
