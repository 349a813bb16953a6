"""Every query of the engine's own operators, by name, with the equivalent SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .operators import preparation as prep
from .operators import ranking, skyline, topk
from .operators.topk import TopKQuery
from .plans import block_index
from .relation import Relation, scratch
from .sources import files, generators, views

QUERIES: dict = {}
ORACLES: dict = {}

KEYS = "k0, k1, k2, k3, k4"
LI = "lr AS (SELECT l_orderkey AS k0, l_partkey AS k1, l_suppkey AS k2, l_linenumber AS k3, l_extendedprice AS k4, l_quantity AS a0, l_extendedprice AS a1, l_discount AS a2, l_tax AS a3 FROM lineitem)"


def _minmax(source: str, name: str, keys: str, d: int) -> str:
    edges = ", ".join(f"min(a{m}) AS n{m}, max(a{m}) AS x{m}" for m in range(d))
    cells = ", ".join(f"coalesce((a{m} - n{m}) / nullif(x{m} - n{m}, 0), 0) + 0.0 AS a{m}" for m in range(d))
    return f"{name}_e AS (SELECT {edges} FROM {source}), {name} AS (SELECT {keys}, {cells} FROM {source}, {name}_e)"


LN = f"{LI}, {_minmax('lr', 'li', KEYS, 4)}"


def _emb(d: int) -> str:
    return "em AS (SELECT vec_id AS tid, " + ", ".join(f"embedding[{m + 1}]::DOUBLE AS a{m}" for m in range(d)) + " FROM embeddings)"


def _emn(d: int) -> str:
    return f"{_emb(d)}, {_minmax('em', 'en', 'tid', d)}"


PT = "pt AS (SELECT p_partkey AS tid, p_size::DOUBLE AS a0, p_retailprice AS a1 FROM part)"


def _score(attrs, weights=None) -> str:
    weights = weights or [1.0] * len(attrs)
    return " + ".join(f"{a} * {float(w)!r}::DOUBLE" for a, w in zip(attrs, weights, strict=True))


def _ranks(source: str, keys: str, d: int, part: str = "0", name: str = "rk") -> str:
    cells = ", ".join(f"row_number() OVER (PARTITION BY {part} ORDER BY a{m} DESC, {keys}) - 1 AS r{m}" for m in range(d))
    rs = ", ".join(f"r{m}" for m in range(d))
    return f"{name}_0 AS (SELECT *, {part} AS part, {cells} FROM {source}), {name} AS (SELECT *, least({rs}) AS minpos, greatest({rs}) AS maxpos FROM {name}_0)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: The queries that the top-k operators are held against: unequal weights, three attributes.
WIDE = TopKQuery(16, ("a0", "a1", "a2"), (0.5, 0.25, 1.0))
EVEN = TopKQuery(16, ("a0", "a1", "a2", "a3"), (1.0, 1.0, 1.0, 1.0))


def _top_sql(q: TopKQuery, ctes: str = LN, source: str = "li", keys: str = KEYS) -> str:
    return f"WITH {ctes} SELECT {keys}, {_score(q.attrs, q.weights)} AS score FROM {source} ORDER BY score DESC, {keys} LIMIT {q.k}"


def _li(spark: SparkSession, sf_dir: str) -> Relation:
    return scalar.normalized(views.line_items(spark, sf_dir))


def _em(spark: SparkSession, sf_dir: str, d: int) -> Relation:
    return scalar.normalized(views.vectors(spark, sf_dir, d))


# Top-k.

for _name, _run, _q in [
    ("topk_fte", topk.scan, WIDE),
    ("topk_two_stage", topk.two_stage, WIDE),
    ("topk_ta", topk.threshold, WIDE),
    ("topk_cfa", topk.seen, WIDE),
    ("topk_msa", topk.by_largest_attribute, EVEN),
    ("topk_lsa", topk.by_suffix, EVEN),
    ("topk_cba", lambda r, q: topk.by_suffix(r, q, early=True), EVEN),
]:
    query(_name, _top_sql(_q))(lambda spark, sf_dir, run=_run, q=_q: run(_li(spark, sf_dir), q))


@query("topk_fte_array", f"WITH {LN} SELECT {KEYS}, 0.0 + {_score(WIDE.attrs, WIDE.weights)} AS score FROM li ORDER BY score DESC, {KEYS} LIMIT 16")
def topk_fte_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.scan_array(_li(spark, sf_dir), WIDE)


@query("topk_user_score", f"WITH {LN} SELECT {KEYS}, a0 * a1 - a2 AS score FROM li ORDER BY score DESC, {KEYS} LIMIT 16")
def topk_user_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.by_score(_li(spark, sf_dir), F.col("a0") * F.col("a1") - F.col("a2"), 16)


@query("topk_vta", _top_sql(WIDE))
def topk_vta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_index.topk(block_index.build(_li(spark, sf_dir), 1024), WIDE)


@query("topk_pta", _top_sql(EVEN))
def topk_pta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_index.topk(block_index.build(_li(spark, sf_dir), 1024, "angle"), EVEN)


SLA = TopKQuery(5, ("a0", "a1", "a2"), (1.0, 0.5, 0.25))


@query("topk_sla", _top_sql(SLA, _emn(3), "en", "tid"))
def topk_sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _em(spark, sf_dir, 3)
    return block_index.topk(block_index.build(r, 64, "layer", skyline.layers(r, SLA.k)), SLA, SLA.k)


@query("kth_select", "SELECT min(p) AS threshold FROM (SELECT o_totalprice AS p FROM orders ORDER BY p DESC LIMIT 128)")
def kth_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.kth(views.table(spark, sf_dir, "orders"), "o_totalprice", 128)


@query("kth_select_approx")
def kth_select_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.kth_approx(views.table(spark, sf_dir, "orders"), "o_totalprice", 128)


@query("kth_partial", f"SELECT min(score) AS threshold FROM ({_top_sql(WIDE)})")
def kth_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.kth_of_groups(_li(spark, sf_dir), WIDE)


@query(
    "prune_step",
    f"""WITH {LN}, v AS (SELECT {KEYS}, list_sort([a0, a1, a2, a3], 'DESC') AS s FROM li),
t AS (SELECT min(p) AS t FROM (SELECT s[1] AS p FROM v ORDER BY p DESC LIMIT 16))
SELECT {KEYS}, s[1] + s[2] AS partial FROM v, t WHERE s[1] + s[2] * 3.0::DOUBLE >= t""",
)
def prune_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.prune_step(_li(spark, sf_dir), EVEN)


TA = TopKQuery(8, ("a0", "a1", "a2"), (0.5, 0.25, 1.0))
TA2 = TopKQuery(8, ("a0", "a2"), (1.0, 1.0))


def _ta_ctes(q: TopKQuery, lists, name: str) -> str:
    """CTEs to {name}_ok (depth) and {name}_s (mp): sorted access over q's lists of rk, until q's k-th score reaches the sum over `lists`."""
    weight = dict(zip(q.attrs, q.weights, strict=True))
    own = ", ".join("r" + a[1:] for a in q.attrs)
    first, *rest = lists
    bar = " + ".join(f"x{a}.{a} * {weight.get(a, 1.0)!r}::DOUBLE" for a in lists)
    joins = " ".join(f"JOIN rk x{a} ON x{a}.r{a[1:]} = x{first}.r{first[1:]}" for a in rest)
    return f"""{name}_s AS (SELECT least({own}) AS mp, {_score(q.attrs, q.weights)} AS score FROM rk),
{name}_t AS (SELECT x{first}.r{first[1:]} AS depth, {bar} AS bar FROM rk x{first} {joins}),
{name}_ok AS (SELECT min(depth) AS depth FROM {name}_t WHERE (SELECT count(*) FROM {name}_s WHERE mp <= {name}_t.depth AND score >= {name}_t.bar) >= {q.k})"""


def _ta_seen(name: str) -> str:
    return f"SELECT depth, (SELECT count(*) FROM {name}_s WHERE mp <= {name}_ok.depth) AS accesses FROM {name}_ok"


@query("ta_access_count", f"WITH {_emn(3)}, {_ranks('en', 'tid', 3)}, {_ta_ctes(TA, TA.attrs, 'ta')} {_ta_seen('ta')}")
def ta_access_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.threshold_depth(_em(spark, sf_dir, 3), TA)
    return spark.createDataFrame([(found.depth, found.evaluated)], "depth bigint, accesses bigint")


@query("ta2_access_count", f"WITH {_emn(3)}, {_ranks('en', 'tid', 3)}, {_ta_ctes(TA2, ('a0', 'a1', 'a2'), 'ta')} {_ta_seen('ta')}")
def ta2_access_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant that adds the values of all lists up for its threshold, and so stops later."""
    found = topk.threshold_depth(_em(spark, sf_dir, 3), TA2, lists=("a0", "a1", "a2"))
    return spark.createDataFrame([(found.depth, found.evaluated)], "depth bigint, accesses bigint")


_PAIRS3 = [topk.TopKQuery(8, c, (1.0, 1.0)) for c in (("a0", "a1"), ("a0", "a2"), ("a1", "a2"))]


@query(
    "subspace_accesses",
    f"WITH {_emn(3)}, {_ranks('en', 'tid', 3)}, "
    + ", ".join(_ta_ctes(q, q.attrs, f"s{i}") for i, q in enumerate(_PAIRS3))
    + " SELECT count(*) AS subspaces, avg(accesses) AS mean, min(accesses) AS least FROM ("
    + " UNION ALL ".join(_ta_seen(f"s{i}") for i in range(3))
    + ")",
)
def subspace_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.subspace_accesses(_em(spark, sf_dir, 3), 8, 2)


@query(
    "cfa_candidates",
    f"""WITH {_emn(3)}, {_ranks('en', 'tid', 3)}, d AS (SELECT max(maxpos) AS depth FROM (SELECT maxpos FROM rk ORDER BY maxpos LIMIT 8))
SELECT depth, (SELECT count(*) FROM rk WHERE minpos <= depth) AS candidates FROM d""",
)
def cfa_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.seen_depth(_em(spark, sf_dir, 3), TA)
    return spark.createDataFrame([(found.depth, found.evaluated)], "depth bigint, candidates bigint")


def _batch_sql(queries: dict[int, TopKQuery], ctes: str = LN, source: str = "li", keys: str = KEYS) -> str:
    each = " UNION ALL ".join(
        f"(SELECT {i} AS qid, row_number() OVER (ORDER BY {_score(q.attrs, q.weights)} DESC, {keys}) AS rank, {keys}, {_score(q.attrs, q.weights)} AS score FROM {source} QUALIFY rank <= {q.k})"
        for i, q in queries.items()
    )
    return f"WITH {ctes} {each}"


_A = ("a0", "a1", "a2", "a3")
# The weight vectors of the queries.
_W = {0: (1.0, 1.0, 1.0, 1.0), 1: (0.1, 0.2, 0.3, 0.4), 2: (0.4, 0.3, 0.2, 0.1), 3: (0.1, 0.2, 0.4, 0.8), 4: (0.8, 0.4, 0.2, 0.1)}
MULTI = {5 * i + j: TopKQuery(8, _A[-q:], _W[j][-q:]) for i, q in enumerate((2, 3, 4)) for j in _W}
SUBSPACES = topk.all_subspaces(_A, 8)
SWEEP = topk.nested_sweep(_A, (16, 32))

PREFIXES = topk.nested_sweep(_A, (16, 32), prefix=True)

for _name, _queries in [("topk_multi_query", MULTI), ("topk_all_subspaces", SUBSPACES), ("topk_sweep", SWEEP), ("topk_sweep_prefix", PREFIXES)]:
    query(_name, _batch_sql(_queries))(lambda spark, sf_dir, queries=_queries: topk.batch(_li(spark, sf_dir), queries))


#: Workloads of many queries: over a random number of attributes, and over three.
WORK = topk.workload(_A, 64, 8)
WORK_FIXED = topk.workload(_A, 16, 8, 3, (0.1, 0.2, 0.3, 0.4))


def _workload_sql(queries: dict[int, TopKQuery]) -> str:
    own, of = topk.distinct_queries(queries)
    asked = ", ".join(f"({i}, {j})" for i, j in of.items())
    return f"WITH {LN}, b AS ({_batch_sql(own).split(LN, 1)[1].strip()}), w(asked, own) AS (VALUES {asked}) SELECT asked AS qid, rank, {KEYS}, score FROM b JOIN w ON b.qid = own"


for _name, _queries in [("topk_workload", WORK), ("topk_workload_fixed", WORK_FIXED)]:
    query(_name, _workload_sql(_queries))(lambda spark, sf_dir, queries=_queries: topk.batch(_li(spark, sf_dir), queries))


@query("topk_index_batch", _batch_sql(MULTI))
def topk_index_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch on an index that was written and read back, as another session would."""
    r, path = _li(spark, sf_dir), scratch(spark, "index")
    block_index.build(r, 1024).write(path)
    return block_index.topk_batch(block_index.BlockIndex.read(spark, path, r.keys, r.attrs, 1024), MULTI)


@query("topk_partitioned_merge", _top_sql(WIDE))
def topk_partitioned_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _li(spark, sf_dir)
    return topk.partitioned(r, WIDE, ranking.dealt_parts(r, 16))


@query("topk_by_group", "SELECT label, rank, vec_id, score FROM (SELECT label, vec_id, embedding[1]::DOUBLE + embedding[2]::DOUBLE AS score, row_number() OVER (PARTITION BY label ORDER BY embedding[1]::DOUBLE + embedding[2]::DOUBLE DESC, vec_id) AS rank FROM embeddings) WHERE rank <= 3")
def topk_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    t = views.table(spark, sf_dir, "embeddings").select("label", "vec_id", (F.col("embedding")[0].cast("double") + F.col("embedding")[1].cast("double")).alias("score"))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id"))).where("rank <= 3").select("label", "rank", "vec_id", "score")


# Scalars and preparation.


@query("score_project", f"WITH {LN} SELECT {KEYS}, {_score(WIDE.attrs, WIDE.weights)} AS score FROM li")
def score_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _li(spark, sf_dir).df.select(*[f"k{i}" for i in range(5)], scalar.score(WIDE.attrs, WIDE.weights).alias("score"))


@query("normalize_minmax", f"WITH {LN} SELECT {KEYS}, a0, a1, a2, a3 FROM li")
def normalize_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _li(spark, sf_dir).df


@query("score_mean", f"WITH {LN} SELECT {KEYS}, ({_score(_A)}) / 4.0::DOUBLE AS score FROM li")
def score_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _li(spark, sf_dir)
    return r.df.select(*r.keys, (scalar.score(r.attrs) / 4.0).alias("score"))


@query("score_running_mean", f"WITH {LN} SELECT {KEYS}, ((((0.0::DOUBLE + a0) / 4 + a1) / 4 + a2) / 4 + a3) / 4 AS score FROM li")
def score_running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _li(spark, sf_dir)
    return r.df.select(*r.keys, scalar.running_mean(r.attrs).alias("score"))


@query("score_sum_all", f"WITH {_emb(8)} SELECT tid, {_score([f'a{m}' for m in range(8)])} AS score FROM em")
def score_sum_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All attributes of the view of eight that embeddings are read as (views.vectors)."""
    r = views.vectors(spark, sf_dir)
    return r.df.select("tid", scalar.score(r.attrs).alias("score"))


@query("invert_attrs", f"WITH {LN} SELECT {KEYS}, 1.0::DOUBLE - a0 AS a0, 1.0::DOUBLE - a1 AS a1, 1.0::DOUBLE - a2 AS a2, 1.0::DOUBLE - a3 AS a3 FROM li")
def invert_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalar.inverted(_li(spark, sf_dir)).df


@query("attr_max", f"WITH {LN} SELECT {KEYS}, greatest(a0, a1, a2, a3) AS best FROM li")
def attr_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _li(spark, sf_dir)
    return r.df.select(*r.keys, F.greatest(*r.attrs).alias("best"))


@query("norm_range", f"WITH {LN} SELECT {KEYS}, greatest(a0, a1, a2, a3) - least(a0, a1, a2, a3) AS width FROM li")
def norm_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _li(spark, sf_dir)
    return r.df.select(*r.keys, scalar.value_range(r.attrs).alias("width"))


_E8 = ", ".join(f"a{m}" for m in range(8))


@query("reorder_attrs_desc", f"WITH {_emb(8)}, v AS (SELECT tid, list_sort([{_E8}], 'DESC') AS s FROM em) SELECT tid, " + ", ".join(f"s[{m + 1}] AS v{m}" for m in range(8)) + " FROM v")
def reorder_attrs_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.vectors(spark, sf_dir)
    rows = r.df.select("tid", scalar.descending(r.attrs).alias("s"))
    return rows.select("tid", *[F.get("s", F.lit(m)).alias(f"v{m}") for m in range(8)])


@query("check_order", f"WITH {_emb(4)} SELECT tid FROM em WHERE a1 > a0 OR a2 > a1 OR a3 > a2")
def check_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.vectors(spark, sf_dir, 4)
    return scalar.out_of_order(r.df.select("tid", F.array(*r.attrs).alias("v")), "v").select("tid")


def _phi(d: int, digits: int = 6, shift: float = 1.1) -> list[str]:
    x = [f"(a{m} - {shift}::DOUBLE)" for m in range(d)]
    out = []
    for m in range(d - 1):
        rest = " + ".join(f"{x[j]} * {x[j]}" for j in reversed(range(m + 1, d)))
        out.append(f"round(abs(degrees(atan(sqrt({rest}) / nullif({x[m]}, 0)))), {digits})")
    return out


@query("polar_angles", f"WITH {_emn(4)} SELECT tid, " + ", ".join(f"{p} AS phi{m}" for m, p in enumerate(_phi(4))) + " FROM en")
def polar_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _em(spark, sf_dir, 4)
    return r.df.select("tid", *[F.round(c, 6).alias(f"phi{m}") for m, c in enumerate(scalar.angles(r.attrs))])


@query("quantize_scale", f"WITH {LN} SELECT {KEYS}, " + ", ".join(f"round(a{m} * {float(1 << 30)!r}::DOUBLE)::BIGINT AS a{m}" for m in range(4)) + " FROM li")
def quantize_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.quantized(_li(spark, sf_dir).df, _A)


@query("shape_infer", "SELECT count(*) AS n, 11::BIGINT AS d FROM lineitem")
def shape_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.shape(views.table(spark, sf_dir, "lineitem"))


@query("shape_infer_file", "SELECT count(*) AS n, 4::BIGINT AS d FROM lineitem")
def shape_infer_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of a delimited file, from the file alone."""
    r, path = views.line_items(spark, sf_dir), scratch(spark, "lines")
    files.write_relation(r.df, path, r.attrs)
    return spark.createDataFrame([files.infer_shape(spark, path)], "n bigint, d bigint")


@query("dequantize_scale", f"WITH {LN} SELECT {KEYS}, " + ", ".join(f"round(a{m} * {float(1 << 30)!r}::DOUBLE)::BIGINT::DOUBLE / {float(1 << 30)!r}::DOUBLE AS a{m}" for m in range(4)) + " FROM li")
def dequantize_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.unquantized(files.quantized(_li(spark, sf_dir).df, _A), _A)


@query("sample_head", f"WITH {LI} SELECT * FROM lr ORDER BY {KEYS} LIMIT 10")
def sample_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.line_items(spark, sf_dir)
    return files.head(r.df, r.keys, 10)


@query("histogram", f"WITH {_emn(1)} SELECT floor(a0 / 0.01::DOUBLE)::BIGINT AS bin, count(*) AS n FROM en GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.histogram(_em(spark, sf_dir, 1).df, "a0", 0.01)


@query("etl_project", "SELECT l_quantity AS a0, l_extendedprice AS a1, l_discount AS a2 FROM lineitem")
def etl_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.project(views.table(spark, sf_dir, "lineitem"), {"l_quantity": "a0", "l_extendedprice": "a1", "l_discount": "a2"})


@query("etl_union_project", "SELECT acct AS a0, nation::DOUBLE AS a1 FROM (SELECT c_acctbal AS acct, c_nationkey AS nation FROM customer UNION ALL SELECT s_acctbal, s_nationkey FROM supplier)")
def etl_union_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("acct"), F.col("c_nationkey").alias("nation"))
    b = views.table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("acct"), F.col("s_nationkey").alias("nation"))
    return prep.union_project([a, b], {"acct": "a0", "nation": "a1"})


@query("etl_filter_isin", "SELECT event_id, user_id AS key, value FROM events WHERE event_type IN ('view', 'click')")
def etl_filter_isin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.only(views.readings(spark, sf_dir), "event_type", ("view", "click")).select("event_id", "key", "value")


@query(
    "count_window_pivot",
    """WITH n AS (SELECT user_id AS key, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events WHERE event_type IN ('view', 'click'))
SELECT key, p // 4 AS g, max(value) FILTER (p % 4 = 0) AS a0, max(value) FILTER (p % 4 = 1) AS a1, max(value) FILTER (p % 4 = 2) AS a2, max(value) FILTER (p % 4 = 3) AS a3
FROM n GROUP BY 1, 2 HAVING count(*) = 4""",
)
def count_window_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.window_pivot(prep.only(views.readings(spark, sf_dir), "event_type", ("view", "click")), "key", ["ts", "event_id"], "value", 4)


@query(
    "count_window_pivot_range",
    """WITH n AS (SELECT user_id AS key, value / 100.0::DOUBLE AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events WHERE value / 100.0::DOUBLE >= 0 AND value / 100.0::DOUBLE < 1)
SELECT key, p // 2 AS g, max(value) FILTER (p % 2 = 0) AS a0, max(value) FILTER (p % 2 = 1) AS a1 FROM n GROUP BY 1, 2 HAVING count(*) = 2""",
)
def count_window_pivot_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.window_pivot(prep.within(views.readings(spark, sf_dir), "value", 0.0, 1.0, 100.0), "key", ["ts", "event_id"], "value", 2)


@query(
    "spearman_pairs",
    f"""WITH {LI}, q AS (SELECT {", ".join(f"rank() OVER (ORDER BY a{m}) + (count(*) OVER (PARTITION BY a{m}) - 1) / 2.0 AS q{m}" for m in range(4))} FROM lr)
"""
    + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(corr(q{i}, q{j}), 6) + 0.0 AS rho FROM q" for i in range(4) for j in range(i + 1, 4)),
)
def spearman_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.spearman(views.line_items(spark, sf_dir)).withColumn("rho", F.col("rho") + 0.0)


@query("parse_metrics", "SELECT * FROM (VALUES ('tt_init', 12.5::DOUBLE), ('tt_procesing', 3.25::DOUBLE), ('tuple_count', 4096.0::DOUBLE), ('tuples_per_second', 1.5e6::DOUBLE)) v(metric, value)")
def parse_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The line names of the run log.
    lines = ["tt_init: 12.5", "tt_procesing: 3.25", "tuple_count: 4096", "tuples_per_second: 1.5e6", "threshold=[1.2]"]
    path = scratch(spark, "log")
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    return files.read_metrics(spark, path)


# Ranking structures.


@query("sorted_lists", f"WITH {_emn(4)}, {_ranks('en', 'tid', 4)} " + " UNION ALL ".join(f"SELECT {m} AS m, r{m} AS rank, tid, a{m} AS value FROM rk" for m in range(4)))
def sorted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.sorted_lists(_em(spark, sf_dir, 4))


@query("position_matrix", f"WITH {LN}, {_ranks('li', KEYS, 4)} SELECT {KEYS}, r0, r1, r2, r3 FROM rk")
def position_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _li(spark, sf_dir)
    return ranking.ranks(r).select(*r.keys, *ranking.rank_columns(r))


@query("min_position", f"WITH {LN}, {_ranks('li', KEYS, 4)} SELECT {KEYS}, minpos, maxpos FROM rk")
def min_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _li(spark, sf_dir)
    return ranking.positions(r).select(*r.keys, "minpos", "maxpos")


@query("attr_position_order", f"WITH {_emn(4)}, {_ranks('en', 'tid', 4)}, o AS (SELECT tid, list_sort([r0 * 4, r1 * 4 + 1, r2 * 4 + 2, r3 * 4 + 3]) AS s FROM rk) SELECT tid, " + ", ".join(f"(s[{m + 1}] % 4)::INT AS o{m}" for m in range(4)) + " FROM o")
def attr_position_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.position_order(_em(spark, sf_dir, 4))
    return rows.select("tid", *[F.get("order", F.lit(m)).alias(f"o{m}") for m in range(4)])


@query("first_seen_reorder", f"WITH {LN}, {_ranks('li', KEYS, 4)} SELECT {KEYS}, row_number() OVER (ORDER BY minpos, CASE minpos WHEN r0 THEN 0 WHEN r1 THEN 1 WHEN r2 THEN 2 ELSE 3 END, {KEYS}) - 1 AS seq FROM rk")
def first_seen_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _li(spark, sf_dir)
    return ranking.first_seen(r).select(*r.keys, "seq")


_BLOCKS = f"{LN}, {_ranks('li', KEYS, 4)}, bk AS (SELECT *, (row_number() OVER (ORDER BY minpos, {KEYS}) - 1) AS seq FROM rk), bl AS (SELECT *, (seq // 64)::INT AS block FROM bk)"


@query("block_assign", f"WITH {_BLOCKS} SELECT {KEYS}, seq, block FROM bl")
def block_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _li(spark, sf_dir)
    return ranking.blocks(r, 64).select(*r.keys, "seq", "block")


@query(
    "block_thresholds",
    f"WITH {_BLOCKS}, be AS (SELECT block, count(*) AS n, max(minpos) AS p FROM bl GROUP BY 1) SELECT 0 AS part, be.block, n, x.a0 AS t0, y.a1 AS t1, z.a2 AS t2, w.a3 AS t3 FROM be JOIN bl x ON x.r0 = p JOIN bl y ON y.r1 = p JOIN bl z ON z.r2 = p JOIN bl w ON w.r3 = p",
)
def block_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _li(spark, sf_dir)
    return ranking.block_bounds(ranking.blocks(r, 64), r)


@query("range_partition", f"WITH {LI} SELECT {KEYS}, ((row_number() OVER (ORDER BY {KEYS}) - 1) * 16 // (SELECT count(*) FROM lr))::INT AS part FROM lr")
def range_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.line_items(spark, sf_dir)
    return ranking.range_parts(r, 16).select(*r.keys, "part")


@query("rr_partition", f"WITH {LI} SELECT {KEYS}, ((row_number() OVER (ORDER BY {KEYS}) - 1) % 16)::INT AS part FROM lr")
def rr_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.line_items(spark, sf_dir)
    return ranking.round_robin_parts(r, 16).select(*r.keys, "part")


@query("bintree_partition", f"WITH {_emb(8)} SELECT tid, (" + " + ".join(f"CASE WHEN a{m} < a{m - 1} THEN {1 << (m - 1)} ELSE 0 END" for m in range(1, 8)) + ")::INT AS part FROM em")
def bintree_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.vectors(spark, sf_dir)
    return r.df.select("tid", ranking.tree_part(r.attrs).alias("part"))


_ANG = f"{_emn(4)}, ph AS (SELECT tid, " + ", ".join(f"{p} AS p{m}" for m, p in enumerate(_phi(4))) + ", count(*) OVER () AS n FROM en), pr AS (SELECT *, " + ", ".join(f"row_number() OVER (ORDER BY p{m}, tid) - 1 AS q{m}" for m in range(3)) + " FROM ph)"


@query("angle_partition", f"WITH {_ANG} SELECT tid, (" + " + ".join(f"least(q{m} // greatest(n // 2, 1), 1) * {1 << m}" for m in range(3)) + ")::INT AS part FROM pr")
def angle_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.angle_parts(_em(spark, sf_dir, 4)).select("tid", "part")


@query("angle_equiwidth", f"WITH {_ANG} SELECT tid, (" + " + ".join(f"greatest(least(floor(p{m} * 4 / 90.0), 3), 0) * {4**m}" for m in range(3)) + ")::INT AS part FROM pr")
def angle_equiwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.angle_grid(_em(spark, sf_dir, 4), 4).select("tid", "part")


@query("angle_equidepth", f"WITH {_ANG} SELECT tid, (" + " + ".join(f"(q{m} * 4 // n) * {4**m}" for m in range(3)) + ")::INT AS part FROM pr")
def angle_equidepth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.angle_depths(_em(spark, sf_dir, 4), 4).select("tid", "part")


_MED = "md AS (SELECT " + ", ".join(f"(SELECT a{m} FROM (SELECT a{m}, row_number() OVER (ORDER BY a{m}, tid) AS rn, count(*) OVER () AS n FROM em) WHERE rn = n // 2 + 1) AS m{m}" for m in range(4)) + "), mk AS (SELECT em.*, (" + " + ".join(f"CASE WHEN a{m} > m{m} THEN {1 << m} ELSE 0 END" for m in range(4)) + ")::INT AS mask FROM em, md)"


@query("median_partition", f"WITH {_emb(4)}, {_MED} SELECT tid, mask, bit_count(mask)::INT AS level FROM mk")
def median_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.median_parts(views.vectors(spark, sf_dir, 4)).select("tid", "mask", "level")


# Skylines.


def _dom(a: str, b: str, d: int, op: str = ">") -> str:
    return "(" + " AND ".join(f"{a}.a{m} {op}= {b}.a{m}" for m in range(d)) + " AND (" + " OR ".join(f"{a}.a{m} {op} {b}.a{m}" for m in range(d)) + "))"


@query("skyline_max", f"WITH {_emb(4)} SELECT tid, a0, a1, a2, a3 FROM em b WHERE NOT EXISTS (SELECT 1 FROM em a WHERE {_dom('a', 'b', 4)})")
def skyline_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skyline.skyline(views.vectors(spark, sf_dir, 4))


@query("skyline_min", f"WITH {PT} SELECT tid, a0, a1 FROM pt b WHERE NOT EXISTS (SELECT 1 FROM pt a WHERE {_dom('a', 'b', 2, '<')})")
def skyline_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skyline.skyline(views.parts(spark, sf_dir), largest=False)


@query("skyline_prefilter", f"WITH {PT}, f AS (SELECT * FROM pt ORDER BY a0 + a1 DESC, tid LIMIT 8) SELECT tid, a0, a1 FROM pt b WHERE NOT EXISTS (SELECT 1 FROM f a WHERE {_dom('a', 'b', 2)})")
def skyline_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skyline.prefilter(views.parts(spark, sf_dir))


_PAIRS = f"WITH {_emb(4)} SELECT a.tid AS better, b.tid AS worse FROM em a JOIN em b ON {_dom('a', 'b', 4)}"


@query("dominance_pairs", _PAIRS)
def dominance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skyline.dominance_pairs(views.vectors(spark, sf_dir, 4))


@query("dominance_bitmap", _PAIRS)
def dominance_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skyline.dominance_pairs(views.vectors(spark, sf_dir, 4), masked=True)


@query(
    "dominance_class",
    f"WITH {PT} SELECT tid, CASE WHEN a0 = 25 AND a1 = 950 THEN 'equal' WHEN a0 >= 25 AND a1 >= 950 THEN 'dominates' WHEN a0 <= 25 AND a1 <= 950 THEN 'dominated' ELSE 'neither' END AS relation FROM pt",
)
def dominance_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skyline.dominance_class(views.parts(spark, sf_dir), {"a0": 25, "a1": 950})


@query(
    "skyline_layers",
    f"""WITH RECURSIVE {_emb(3)}, dom AS MATERIALIZED (SELECT a.tid AS hi, b.tid AS lo FROM em a JOIN em b ON {_dom("a", "b", 3)}),
ch(tid, l) AS (SELECT tid, 0 FROM em UNION SELECT dom.lo, ch.l + 1 FROM ch JOIN dom ON dom.hi = ch.tid)
SELECT tid, max(l)::INT AS layer FROM ch GROUP BY tid""",
)
def skyline_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skyline.layers(views.vectors(spark, sf_dir, 3)).select("tid", "layer")


# Checks and metrics.


@query("result_compare", f"WITH {LN}, x AS ({_top_sql(WIDE).split(LN)[1]}), y AS (SELECT {KEYS} FROM li ORDER BY {_score(_A)} DESC, {KEYS} LIMIT 16) SELECT {KEYS}, score FROM x WHERE ({KEYS}) NOT IN (SELECT ({KEYS}) FROM y)")
def result_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _li(spark, sf_dir)
    return prep.missing(topk.scan(r, WIDE), topk.scan(r, EVEN), r.keys)


_TOPS = f"x AS (SELECT {KEYS} FROM li ORDER BY {_score(WIDE.attrs, WIDE.weights)} DESC, {KEYS} LIMIT 16), y AS (SELECT {KEYS} FROM li ORDER BY {_score(_A)} DESC, {KEYS} LIMIT 16)"


@query("result_differences", f"WITH {LN}, {_TOPS} SELECT 'a' AS side, * FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y) UNION ALL SELECT 'b' AS side, * FROM (SELECT * FROM y EXCEPT ALL SELECT * FROM x)")
def result_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _li(spark, sf_dir)
    return prep.differences(topk.scan(r, WIDE), topk.scan(r, EVEN), r.keys)


@query("threshold_compare", f"SELECT min(score) AS a, min(score) AS b, true AS same FROM ({_top_sql(WIDE)})")
def threshold_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _li(spark, sf_dir)
    return prep.same_threshold(topk.scan(r, WIDE), topk.two_stage(r, WIDE))


_EVAL = f"""{LN}, {_ranks('li', KEYS, 4)}, o AS (SELECT *, row_number() OVER (ORDER BY minpos, {KEYS}) - 1 AS seq, count(*) OVER () AS n FROM rk),
bl AS (SELECT *, floor(seq / ceil(n / ceil(n / 1024.0)))::INT AS block, {_score(WIDE.attrs, WIDE.weights)} AS score FROM o),
t AS (SELECT min(score) AS t FROM (SELECT score FROM bl WHERE block < 1 ORDER BY score DESC LIMIT 16)),
be AS (SELECT block, count(*) AS n, max(minpos) AS p FROM bl GROUP BY 1),
u AS (SELECT be.block + 1 AS block, x.a0 * 0.5::DOUBLE + y.a1 * 0.25::DOUBLE + z.a2 * 1.0::DOUBLE AS u FROM be JOIN bl x ON x.r0 = p JOIN bl y ON y.r1 = p JOIN bl z ON z.r2 = p)"""
_KEPT = "FROM be LEFT JOIN u USING (block), t WHERE be.block < 1 OR u.u >= t.t"


@query("eval_count", f"WITH {_EVAL} SELECT count(*) AS blocks, sum(be.n)::BIGINT AS evaluated {_KEPT}")
def eval_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_index.survivors(block_index.build(_li(spark, sf_dir), 1024), WIDE).agg(F.count("*").alias("blocks"), F.sum("n").cast("bigint").alias("evaluated"))


@query("index_report", f"WITH {_EVAL} SELECT count(*) AS blocks, sum(be.n)::BIGINT AS evaluated, (SELECT count(*) FROM li) AS rows, (SELECT min(score) FROM (SELECT score FROM bl ORDER BY score DESC LIMIT 16)) AS threshold {_KEPT}")
def index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_index.report(block_index.build(_li(spark, sf_dir), 1024), WIDE)


# Generators.

for _name, _make in [
    ("gen_indep", generators.independent),
    ("gen_corr", generators.correlated),
    ("gen_anti", generators.anticorrelated),
    ("gen_lognormal", generators.lognormal),
    ("gen_zipf", generators.zipf),
    ("gen_pareto", generators.pareto),
    ("gen_block_scaled", generators.block_scaled),
]:
    query(_name)(lambda spark, sf_dir, make=_make: make(spark, 4096, 8))


@query("make_distinct")
def make_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _li(spark, sf_dir)
    return generators.told_apart(r.df, r.keys, r.attrs)


@query("random_shuffle", f"WITH {LI} SELECT * FROM lr")
def random_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in a random order that a seed fixes."""
    r = views.line_items(spark, sf_dir)
    return r.df.orderBy(generators.uniform(5, *[F.col(k) for k in r.keys]))


# The engine takes SQL as well: relations are views.


@query("topk_sql", _top_sql(WIDE))
def topk_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _li(spark, sf_dir)
    return spark.sql(f"SELECT {KEYS}, {_score(WIDE.attrs, WIDE.weights).replace('::DOUBLE', 'D')} AS score FROM {{li}} ORDER BY score DESC, {KEYS} LIMIT 16", li=r.df)
