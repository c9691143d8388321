"""One query for each operator over whole tables, with its SQL where SQL can express it.

``embeddings`` are the vectors. Queries are those whose vec_id is divisible by 50, groups are (0, 0) and
(1, label), deleted are multiples of 7, creation times are a minute apart, and centroids and
codebooks are fixed rows, so that both engines compute the same.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import encode, metrics
from nearfield.operators import graph, ivf, knn, merge, pq, topk, train
from nearfield.operators.scan import Entry, scan
from nearfield.plans import engine
from nearfield.sources import readers
from nearfield.streaming import segments

L2 = metrics.KERNELS["squared_euclidean"]
ASKED = "vec_id % 50 = 0"
NOW, BORN = 1704067200 + 500 * 60, 1704067200
FRAGMENTS, WIDTH, CODES, K = 16, 4, 16, 10
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


class T:
    """The derived tables of a scale."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
        self.queries = self.base.where(ASKED).select(F.col("vec_id").alias("qid"), F.col("label").alias("qlabel"), F.col("v").alias("qv"))
        self.asked = [(r.qid, list(r.qv), r.qlabel) for r in self.queries.orderBy("qid").toLocalIterator()]
        self.deleted = self.base.where("vec_id % 7 = 0").select("vec_id")
        self.centroids = self.base.where("vec_id % 50 = 0").select(F.expr("vec_id div 50").alias("label"), F.col("v").alias("cv"))
        self.created = F.lit(BORN) + F.col("vec_id") * 60

    def codebook(self, vectors: DataFrame | None = None) -> DataFrame:
        """(frag, code, cv): the fragments of the first vectors."""
        first = (self.base if vectors is None else vectors).where(F.col("vec_id") < CODES)
        parts = F.transform(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)), lambda f: F.struct(f.alias("frag"), encode.fragment(F.col("v"), f, WIDTH).alias("cv")))
        return first.select(F.col("vec_id").cast("int").alias("code"), F.explode(parts).alias("p")).select("p.frag", "code", "p.cv")

    @property
    def book(self):
        return pq.book(self.codebook(), FRAGMENTS)

    @property
    def bits(self) -> DataFrame:
        return self.base.select("vec_id", metrics.pack_bits(encode.sign_bits(F.col("v"))).alias("b"))

    def bit_entries(self, k: int = K) -> list[Entry]:
        return [Entry(r.vec_id, list(r.b), k) for r in self.bits.where(ASKED).toLocalIterator()]

    def entries(self, k: int = K) -> list[Entry]:
        return [Entry(qid, v, k) for qid, v, _ in self.asked]

    def top(self, found: DataFrame, k: int = K) -> DataFrame:
        return topk.top_k(found.withColumnRenamed("pool", "qid"), k, ["qid"])

    def scored(self, k: int, rows: DataFrame | None = None) -> DataFrame:
        """(qid, vec_id, dist, rk) of the k nearest."""
        return knn.exact(self.base if rows is None else rows, self.queries, k)

    @property
    def postings(self) -> DataFrame:
        return ivf.postings(self.base, self.centroids)

    def probes(self, n: int = 2) -> DataFrame:
        return ivf.probes(self.queries, self.centroids, n)


def _r(c="dist", digits=6):
    return (F.round(c, digits) + 0.0).alias(c if isinstance(c, str) else "dist")


def _s(expr: str, a: str = "qv", b: str = "v") -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: {expr}))"


def _l2(a: str = "qv", b: str = "v") -> str:
    return _s("(p[1] - p[2]) * (p[1] - p[2])", a, b)


WITH = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
q AS (SELECT vec_id AS qid, label AS qlabel, v AS qv FROM e WHERE vec_id % 50 = 0),
c AS (SELECT vec_id // 50 AS label, v AS cv FROM e WHERE vec_id % 50 = 0)"""
D = f", d AS (SELECT qid, qv, vec_id, label, v, {_l2()} AS dist FROM q, e)"
ASSIGN = f""", a AS (SELECT vec_id, slot, cv FROM (SELECT e.vec_id, c.label AS slot, c.cv, row_number() OVER (PARTITION BY e.vec_id ORDER BY {_l2("cv", "v")}, c.label) AS r FROM e, c) WHERE r = 1)"""
PROBE = f""", p AS (SELECT qid, qv, slot, pd, cv FROM (SELECT qid, qv, cv, c.label AS slot, {_l2("qv", "cv")} AS pd, row_number() OVER (PARTITION BY qid ORDER BY {_l2("qv", "cv")}, c.label) AS r FROM q, c) WHERE r <= 2)"""
CODE = f""", cb AS (SELECT f AS frag, vec_id AS code, v[4 * f + 1 : 4 * f + 4] AS cv FROM e, (SELECT unnest(range({FRAGMENTS})) AS f) WHERE vec_id < {CODES}),
fr AS (SELECT vec_id, f AS frag, v[4 * f + 1 : 4 * f + 4] AS part FROM e, (SELECT unnest(range({FRAGMENTS})) AS f)),
code AS (SELECT vec_id, frag, code FROM (SELECT vec_id, frag, code, row_number() OVER (PARTITION BY vec_id, frag ORDER BY {_l2("cv", "part")}, code) AS r FROM fr JOIN cb USING (frag)) WHERE r = 1),
lut AS (SELECT vec_id AS qid, frag, code, {_l2("part", "cv")} AS d FROM fr JOIN cb USING (frag) WHERE vec_id % 50 = 0)"""
ADC = ", adc AS (SELECT qid, vec_id, sum(d) AS dist FROM code JOIN lut USING (frag, code) GROUP BY qid, vec_id)"


def _top(table: str, k: int = K, by: str = "qid", key: str = "vec_id", extra: str = "", digits: int = 6) -> str:
    return f" SELECT {by}, {key}, round(dist, {digits}) + 0.0 AS dist{extra} FROM {table} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY dist, {key}) <= {k}"


# Exact neighbours by every metric ---------------------------------------------------------

_MEANS = "(list_sum(qv) / len(qv)) AS mq, (list_sum(v) / len(v)) AS mv"
_NORM = "(sqrt(" + _s("p[1] * p[1]", "qv", "qv") + ") * sqrt(" + _s("p[1] * p[1]", "v", "v") + "))"
_CORR = f"1 - {_s('(p[1] - mq) * (p[2] - mv)')} / (sqrt({_s('(p[1] - mq) * (p[1] - mq)')}) * sqrt({_s('(p[2] - mv) * (p[2] - mv)')}))"
_NSQ = f"{_s('((p[1] - mq) - (p[2] - mv)) * ((p[1] - mq) - (p[2] - mv))')} / ({_s('(p[1] - mq) * (p[1] - mq)')} + {_s('(p[2] - mv) * (p[2] - mv)')}) / 2"
_METRICS = {
    "knn_l2": ("squared_euclidean", _l2()),
    "knn_euclid": ("euclidean", f"sqrt({_l2()})"),
    "knn_ip": ("inner_product", "-" + _s("p[1] * p[2]")),
    "knn_cosine": ("cosine", f"1 - {_s('p[1] * p[2]')} / {_NORM}"),
    "knn_manhattan": ("manhattan", _s("abs(p[1] - p[2])")),
    "knn_chebyshev": ("chebyshev", _s("abs(p[1] - p[2])").replace("list_sum", "list_max")),
    "knn_chessboard": ("chessboard", _s("abs(p[1] - p[2])").replace("list_sum", "list_max")),
    "knn_canberra": ("canberra", _s("CASE WHEN abs(p[1]) + abs(p[2]) = 0 THEN 0 ELSE abs(p[1] - p[2]) / (abs(p[1]) + abs(p[2])) END")),
    "knn_braycurtis": ("bray_curtis", f"{_s('abs(p[1] - p[2])')} / {_s('abs(p[1] + p[2])')}"),
    "knn_correlation": ("correlation", _CORR),
    "knn_norm_l2": ("normalized_squared_euclidean", _NSQ),
    "knn_norm_euclid": ("normalized_euclidean", f"sqrt({_NSQ})"),
    "knn_equal": ("equality", "CASE WHEN qv = v THEN 0.0 ELSE 1.0 END::DOUBLE"),
}
for _name, (_metric, _expr) in _METRICS.items():

    @query(_name, f"{WITH}, m AS (SELECT qid, qv, vec_id, v, {_MEANS} FROM q, e), d AS (SELECT qid, vec_id, {_expr} AS dist FROM m){_top('d')}")
    def _(spark, sf_dir, metric=_metric):
        t = T(spark, sf_dir)
        return knn.exact(t.base, t.queries, K, metric).select("qid", "vec_id", _r())


for _name, _metric in (("knn_half_l2", "half_squared_euclidean"), ("knn_half_ip", "half_inner_product")):

    @query(_name)
    def _(spark, sf_dir, metric=_metric):
        t = T(spark, sf_dir)
        return knn.exact(t.base, t.queries, K, metric).select("qid", "vec_id", _r())


_INT = ", i AS (SELECT vec_id, list_transform(v, lambda x: floor(x * {scale} + 0.5)) AS v FROM e), m AS (SELECT qid, qv, vec_id, v, " + _MEANS + " FROM (SELECT vec_id AS qid, v AS qv FROM i WHERE vec_id % 50 = 0), i), d AS (SELECT qid, vec_id, {expr} AS dist FROM m)"
for _kind, _scale in (("int8", 127), ("int16", 32767)):
    for _name, (_metric, _expr) in _METRICS.items():

        @query(_name.replace("knn_", f"knn_{_kind}_"), WITH + _INT.replace("{scale}", str(_scale)).replace("{expr}", _expr) + _top("d", digits=4))
        def _(spark, sf_dir, kind={"int8": "tinyint", "int16": "smallint"}[_kind], scale=_scale, metric=_metric):
            t = T(spark, sf_dir)
            base = t.base.select("vec_id", encode.quantized(F.col("v"), scale, kind).alias("v"))
            return knn.exact(base, base.where(ASKED).select(F.col("vec_id").alias("qid"), F.col("v").alias("qv")), K, metric).select("qid", "vec_id", _r(digits=4))


for _name, _root in (("knn_weighted_l2", False), ("knn_weighted_euclid", True)):

    @query(_name, f"{WITH}, w AS (SELECT v AS w FROM e WHERE vec_id = 5), d AS (SELECT qid, vec_id, {'sqrt' if _root else ''}(list_sum(list_transform(list_zip(qv, v, w), lambda p: abs(p[3]) * (p[1] - p[2]) * (p[1] - p[2])))) AS dist FROM q, e, w){_top('d')}")
    def _(spark, sf_dir, root=_root):
        t = T(spark, sf_dir)
        w = [abs(x) for x in t.base.where("vec_id = 5").first().v]
        return knn.exact(t.base, t.queries, K, kernel=metrics.weighted(w, root)).select("qid", "vec_id", _r())


@query("knn_metric_by_query", f"{WITH}, d AS (SELECT qid, vec_id, CASE WHEN qid % 100 = 0 THEN {_l2()} ELSE {_s('abs(p[1] - p[2])')} END AS dist FROM q, e){_top('d')}")
def _(spark, sf_dir):
    """Each query's own metric in place of the index's."""
    t = T(spark, sf_dir)
    return knn.exact(t.base, t.queries.withColumn("metric", F.when(F.col("qid") % 100 == 0, "squared_euclidean").otherwise("manhattan")), K).select("qid", "vec_id", _r())


@query("exact_topk_sweep", f"{WITH}{D}" + " UNION ALL ".join(f" SELECT {k} AS k, qid, vec_id, round(dist, 6) + 0.0 AS dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS r FROM d) WHERE r <= {k}" for k in (1, 10, 50)))
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    found = knn.exact(t.base, t.queries, 50)
    return found.withColumn("k", F.explode(F.array(F.lit(1), F.lit(10), F.lit(50)))).where("rk <= k").select("k", "qid", "vec_id", _r())


# Binary metrics ---------------------------------------------------------------------------

_BIN = {
    "bin_hamming": ("hamming", "h"),
    "bin_jaccard": ("jaccard", "CASE WHEN n11 + h = 0 THEN 0 ELSE h / (n11 + h) END"),
    "bin_matching": ("matching", "h / 64"),
    "bin_dice": ("dice", "CASE WHEN 2 * n11 + h = 0 THEN 0 ELSE h / (2 * n11 + h) END"),
    "bin_rogers": ("rogers_tanimoto", "2 * h / (64 + h)"),
    "bin_russellrao": ("russell_rao", "(64 - n11) / 64"),
    "bin_sokalmichener": ("sokal_michener", "h / 64"),
    "bin_sokalsneath": ("sokal_sneath", "CASE WHEN n11 + 2 * h = 0 THEN 0 ELSE 2 * h / (n11 + 2 * h) END"),
    "bin_yule": ("yule", "CASE WHEN n11 * n00 + n10 * n01 = 0 THEN 0 ELSE 2 * n10 * n01 / (n11 * n00 + n10 * n01) END"),
}
_CELLS = ", b AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS b FROM e), m AS (SELECT x.vec_id AS qid, y.vec_id, " + ", ".join(f"{_s(f, 'x.b', 'y.b')} AS {n}" for n, f in (("n11", "p[1] * p[2]"), ("n10", "p[1] * (1 - p[2])"), ("n01", "(1 - p[1]) * p[2]"), ("n00", "(1 - p[1]) * (1 - p[2])"), ("h", "abs(p[1] - p[2])"))) + " FROM b x, b y WHERE x.vec_id % 50 = 0)"
for _name, (_metric, _expr) in _BIN.items():

    @query(_name, f"{WITH}{_CELLS}, d AS (SELECT qid, vec_id, ({_expr})::DOUBLE AS dist FROM m){_top('d')}")
    def _(spark, sf_dir, metric=_metric):
        t = T(spark, sf_dir)
        return t.top(scan(t.bits, t.bit_entries(), metrics.binary_kernel(metric, 64), vec="b", kind=np.int64, check=False)).select("qid", "vec_id", _r())


@query("bitmap_ops", f"{WITH}{_CELLS} SELECT qid, sum(n11)::BIGINT AS both_bits, sum(n11 + h)::BIGINT AS either_bits, sum(h)::BIGINT AS differing_bits, sum(n10)::BIGINT AS left_only_bits FROM m GROUP BY qid")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    asked = t.bits.where(ASKED).select(F.col("vec_id").alias("qid"), F.col("b").alias("qb"))
    met = t.bits.select("b").join(F.broadcast(asked), F.size("b") == F.size("qb"))
    count = lambda f: F.sum(F.aggregate(F.zip_with("qb", "b", lambda x, y: F.bit_count(f(x, y))), F.lit(0), lambda s, x: s + x)).cast("long")
    return met.groupBy("qid").agg(count(lambda x, y: x.bitwiseAND(y)).alias("both_bits"), count(lambda x, y: x.bitwiseOR(y)).alias("either_bits"), count(lambda x, y: x.bitwiseXOR(y)).alias("differing_bits"), count(lambda x, y: x.bitwiseAND(F.bitwise_not(y))).alias("left_only_bits"))


# Composite metrics ------------------------------------------------------------------------

_PART = 16
_PERM = "list_sum(list_transform(range(4), lambda i: list_min(list_transform(range(4), lambda j: " + _l2("qv[16 * i + 1 : 16 * i + 16]", "v[16 * j + 1 : 16 * j + 16]") + "))))"
_CT = _l2("qv[1:16]", "v[1:16]") + " * " + _l2("qv[17:32]", "v[17:32]")


@query("m_permutation", f"{WITH}, d AS (SELECT qid, vec_id, {_PERM} AS dist FROM q, e){_top('d')}")
def _(spark, sf_dir):
    return _composite(T(spark, sf_dir), metrics.permutation_kernel(_PART))


@query("m_ctcvr", f"{WITH}, d AS (SELECT qid, vec_id, {_CT} AS dist FROM q, e){_top('d')}")
def _(spark, sf_dir):
    return _composite(T(spark, sf_dir), metrics.product_kernel(_PART))


@query("m_simple", f"{WITH}, d AS (SELECT qid, vec_id, {_l2('qv[1:32]', 'v[1:32]')} AS dist FROM q, e){_top('d')}")
def _(spark, sf_dir):
    return _composite(T(spark, sf_dir), metrics.prefix_kernel(32))


def _composite(t: T, kernel) -> DataFrame:
    """The K best; of a kernel that gives a recall and a rank score the K best by recall, with the rank."""
    found = t.top(scan(t.base, t.entries(), kernel, check=False))
    return found.select("qid", "vec_id", _r("dist"), *([_r("rank")] if "rank" in found.columns else []))


def _rank_sql(recall: str, rank: str) -> str:
    return f"{WITH}, d AS (SELECT qid, vec_id, {recall} AS dist, {rank} AS rank FROM q, e){_top('d', extra=', round(rank, 6) + 0.0 AS rank')}"


@query("m_mobius", _rank_sql(_l2("qv[1:32]", "v[1:32]"), _l2("qv[33:64]", "v[1:32]")))
def _(spark, sf_dir):
    return _composite(T(spark, sf_dir), metrics.mobius_kernel(32, 32))


@query("m_relcvr", _rank_sql(_PERM, _l2("qv[1:16]", "v[1:16]")))
def _(spark, sf_dir):
    return _composite(T(spark, sf_dir), metrics.relevance_kernel(_PART))


@query("m_multi_min", f"{WITH}{D}, m AS (SELECT label, qid, min(dist) AS d FROM d GROUP BY label, qid) SELECT label, round(sum(d), 6) AS dist FROM m GROUP BY label")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    m = knn.group_minima(t.base, t.queries, "label")
    return m.groupBy(F.col("group").cast("int").alias("label")).agg(F.round(F.sum("dist"), 6).alias("dist"))


@query("m_normalizer", f"{WITH}, d AS (SELECT qid, vec_id, 1 - {_s('p[1] * p[2]')} / {_NORM} AS dist FROM q, e) SELECT qid, vec_id, round(1 - dist, 6) + 0.0 AS score FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) <= 10")
def _(spark, sf_dir):
    """Distances turned back into similarities."""
    t = T(spark, sf_dir)
    return knn.exact(t.base, t.queries, K, "cosine").select("qid", "vec_id", (F.round(metrics.normaliser("cosine")(F.col("dist")), 6) + 0.0).alias("score"))


# Filters ----------------------------------------------------------------------------------


@query("f_delete_pre", f"{WITH}{D}, l AS (SELECT * FROM d WHERE vec_id % 7 <> 0){_top('l')}")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    return knn.exact(t.base.join(t.deleted, "vec_id", "left_anti"), t.queries, K).select("qid", "vec_id", _r())


@query("f_delete_post", f"{WITH}{D}, k AS ({_top('d')}) SELECT * FROM k WHERE vec_id % 7 <> 0")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    return knn.exact(t.base, t.queries, K).join(t.deleted, "vec_id", "left_anti").select("qid", "vec_id", _r())


@query("f_filter", f"{WITH}{D}, l AS (SELECT * FROM d WHERE NOT (vec_id % 3 = 1)){_top('l')}")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    reject = F.col("vec_id") % 3 == 1
    return knn.exact(t.base.where(~reject), t.queries, K).select("qid", "vec_id", _r())


@query("f_feeder", f"{WITH}{D}, l AS (SELECT * FROM d WHERE vec_id IN (SELECT DISTINCT o_custkey FROM orders)){_top('l')}")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("vec_id"))
    return knn.exact(t.base.join(keys, "vec_id", "left_semi"), t.queries, K).select("qid", "vec_id", _r())


@query("f_docfeeder", f"{WITH}{D}, l AS (SELECT *, count(*) OVER (PARTITION BY qid) AS visited FROM d WHERE vec_id IN (SELECT s_suppkey FROM supplier)){_top('l', extra=', visited')}")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    ids = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("vec_id")).distinct()
    fed = t.base.join(ids, "vec_id", "left_semi")
    return knn.exact(fed, t.queries, K).select("qid", "vec_id", _r(), F.lit(fed.count()).alias("visited"))


@query("f_category", f"{WITH}{D}, l AS (SELECT * FROM d WHERE label = 3){_top('l')}")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    return knn.exact(t.base.where("label = 3"), t.queries, K).select("qid", "vec_id", _r())


@query("f_visit_limit", f"{WITH}{ASSIGN}, n AS (SELECT slot, count(*) AS n FROM a GROUP BY slot), v AS (SELECT slot, n, sum(n) OVER (ORDER BY slot) AS visited FROM n) SELECT slot, n, visited::BIGINT AS visited FROM v WHERE visited < 300")
def _(spark, sf_dir):
    n = knn.nearest_label(T(spark, sf_dir).base, T(spark, sf_dir).centroids).groupBy("slot").agg(F.count("*").alias("n"))
    return topk.visit_limit(n.withColumn("one", F.lit(1)), ["one"], "slot", "n", 300).select("slot", "n", "visited")


# Quotas -----------------------------------------------------------------------------------

_WANTED = [(0, 0, 0, 4), (1, 3, 1, 3), (1, 7, 2, 5), (9, 9, 3, 2)]


def _groups():
    return F.array(F.struct(F.lit(0).alias("level"), F.lit(0).alias("id")), F.struct(F.lit(1).alias("level"), F.col("label").cast("int").alias("id")))



_WANTED_SQL = ", w(level, id, pool_id, k) AS (VALUES (0, 0, 0, 4), (1, 3, 1, 3), (1, 7, 2, 5), (9, 9, 3, 2)), g AS (SELECT vec_id, v, 0 AS level, 0 AS id FROM e UNION ALL SELECT vec_id, v, 1, label FROM e)"
_QUOTA = f", m AS (SELECT qid, pool_id, vec_id, k, {_l2()} AS dist FROM q, w JOIN g USING (level, id)), h AS (SELECT qid, pool_id, vec_id, dist FROM m QUALIFY row_number() OVER (PARTITION BY qid, pool_id ORDER BY dist, vec_id) <= k)"


def _quota(spark, sf_dir) -> DataFrame:
    t = T(spark, sf_dir)
    return ivf.group_search(ivf.group_entries(t.base, _groups()), _asked(t))


def _asked(t: T) -> list[tuple]:
    return [(qid, v, *w) for qid, v, _ in t.asked for w in _WANTED]


@query("topk_group_quota", f"{WITH}{_WANTED_SQL}{_QUOTA} SELECT qid, pool_id, vec_id, round(dist, 6) + 0.0 AS dist FROM h")
def _(spark, sf_dir):
    return _quota(spark, sf_dir).select("qid", "pool_id", "vec_id", _r())


@query("topk_dedupe", f"{WITH}{_WANTED_SQL}{_QUOTA} SELECT qid, vec_id, round(min(dist), 6) + 0.0 AS dist, min(pool_id) AS pool_id FROM h GROUP BY qid, vec_id")
def _(spark, sf_dir):
    return topk.dedupe(_quota(spark, sf_dir), ["qid"]).select("qid", "vec_id", _r(), "pool_id")


@query("topk_global_quota", f"{WITH}{_WANTED_SQL}, m AS (SELECT qid, pool_id, vec_id, {_l2()} AS dist FROM q, w JOIN g USING (level, id)) SELECT qid, pool_id, vec_id, round(dist, 6) + 0.0 AS dist FROM m QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id, pool_id) <= 8")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    return ivf.global_quota(ivf.group_entries(t.base, _groups()), _asked(t), 8).select("qid", "pool_id", "vec_id", _r())


@query("topk_fill_left", f"{WITH}{D}, h AS ({_top('(SELECT * FROM d WHERE label = 3)', 3)}), r AS (SELECT qid, vec_id, round(dist, 6) + 0.0 AS dist FROM (SELECT d.*, row_number() OVER (PARTITION BY d.qid ORDER BY d.dist, d.vec_id) AS r FROM d ANTI JOIN h USING (qid, vec_id)) WHERE r <= 5) SELECT * FROM h UNION ALL SELECT * FROM r")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    found = t.scored(3, t.base.where("label = 3"))
    return topk.fill_left(found, t.scored(8), 8, ["qid"]).select("qid", "vec_id", _r())


_AGES = [(1800, 3), (3600, 4), (20000, 5)]


@query("topk_age_quota", f"{WITH}{D}, a AS (SELECT *, {NOW} - ({BORN} + vec_id * 60) AS age FROM d), b AS (SELECT *, CASE WHEN age BETWEEN 0 AND 1800 THEN 0 WHEN age BETWEEN 0 AND 5400 THEN 1 WHEN age BETWEEN 0 AND 20000 THEN 2 END AS pool_id FROM a) SELECT qid, pool_id, vec_id, round(dist, 6) + 0.0 AS dist FROM b WHERE pool_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid, pool_id ORDER BY dist, vec_id) <= pool_id + 3")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    entries, pools = topk.age_entries([(qid, v) for qid, v, _ in t.asked], _AGES)
    found = scan(t.base, entries, L2, group=topk.age_bucket(F.lit(NOW) - t.created, [a for a, _ in _AGES]))
    return ivf.labelled(spark, found, pools).select("qid", "pool_id", "vec_id", _r())


@query("multi_query", f"{WITH}, w(i, label, k) AS (VALUES (0, 1, 3), (1, 4, 2), (2, 8, 4)), d AS (SELECT i AS pool_id, k, e.vec_id, {_l2()} AS dist FROM w JOIN q ON q.qid = w.i * 50 JOIN e ON e.label = w.label) SELECT pool_id, vec_id, round(dist, 6) + 0.0 AS dist FROM d QUALIFY row_number() OVER (PARTITION BY pool_id ORDER BY dist, vec_id) <= k")
def _(spark, sf_dir):
    """One request with several vectors, each for a group of its own."""
    t = T(spark, sf_dir)
    vectors = {qid: v for qid, v, _ in t.asked}
    wanted = [(0, vectors[50 * i], 1, label, i, k) for i, label, k in ((0, 1, 3), (1, 4, 2), (2, 8, 4))]
    return ivf.group_search(ivf.group_entries(t.base, _groups()), wanted).select("pool_id", "vec_id", _r())


# Inverted files ---------------------------------------------------------------------------


@query("ivf_assign", f"{WITH}{ASSIGN} SELECT vec_id, slot::BIGINT AS slot FROM a")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    return knn.nearest_label(t.base, t.centroids).select("vec_id", "slot")


_LEVELS = f", ro AS (SELECT label, cv FROM c WHERE label < 5), fi AS (SELECT (vec_id // 20) % 5 AS parent, vec_id // 20 AS label, v AS cv FROM e WHERE vec_id % 20 = 0)"


def _levels(t: T):
    fine = t.base.where("vec_id % 20 = 0").select(F.expr("(vec_id div 20) % 5").alias("parent"), F.expr("vec_id div 20").alias("label"), F.col("v").alias("cv"))
    return t.centroids.where("label < 5"), fine


@query("ivf_assign_2level", f"{WITH}{_LEVELS}, f AS (SELECT vec_id, v, label AS parent FROM (SELECT vec_id, v, ro.label, row_number() OVER (PARTITION BY vec_id ORDER BY {_l2('ro.cv', 'v')}, ro.label) AS r FROM e, ro) WHERE r <= 2) SELECT vec_id, label FROM (SELECT vec_id, fi.label, row_number() OVER (PARTITION BY vec_id ORDER BY {_l2('fi.cv', 'v')}, fi.label) AS r FROM f JOIN fi USING (parent)) WHERE r = 1")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    return ivf.two_level(t.base, *_levels(t), beam=2)


@query("ivf_probe", f"{WITH}{PROBE} SELECT qid, slot::BIGINT AS slot, round(pd, 6) + 0.0 AS dist FROM p")
def _(spark, sf_dir):
    return T(spark, sf_dir).probes().select("qid", "slot", _r(F.col("probe_dist")))


@query("ivf_candidates", f"{WITH}{ASSIGN}{PROBE} SELECT qid, vec_id, 0.0::DOUBLE AS score FROM p JOIN a USING (slot)")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    return ivf.candidates(t.probes(), t.postings).select("qid", "vec_id", F.lit(0.0).alias("score"))


_IVF = f"{WITH}{ASSIGN}{PROBE}, d AS (SELECT qid, vec_id, label, {_l2()} AS dist FROM p JOIN a USING (slot) JOIN e USING (vec_id))"


@query("ivf_flat", f"{_IVF}{_top('d')}")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    return ivf.search(t.probes(), t.postings, K).select("qid", "vec_id", _r())


@query("posting_length", f"{WITH}{ASSIGN} SELECT slot::BIGINT AS slot, count(*) AS n FROM a GROUP BY slot")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    return knn.nearest_label(t.base, t.centroids).groupBy("slot").agg(F.count("*").alias("n"))


@query("group_ivf", f"{_IVF}, l AS (SELECT * FROM d WHERE label IN (3, 7) AND vec_id % 7 <> 0) SELECT qid, label, vec_id, round(dist, 6) + 0.0 AS dist FROM l QUALIFY row_number() OVER (PARTITION BY qid, label ORDER BY dist, vec_id) <= 3")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    probes = [(r.qid, list(r.qv), r.slot, label) for r in t.probes().toLocalIterator() for label in (3, 7)]
    names = sorted({(qid, label, 3) for qid, _, _, label in probes})
    asked = [Entry(names.index((qid, label, 3)), v, 3, ivf.group_key(label, slot)) for qid, v, slot, label in probes]
    live = t.postings.where("label in (3, 7)").join(t.deleted, "vec_id", "left_anti")
    found = scan(live, asked, L2, group=ivf.group_key(F.col("label"), F.col("slot")))
    return ivf.labelled(spark, found, names).select("qid", F.col("pool_id").alias("label"), "vec_id", _r())


@query("group_ivf_two_stage", f"{WITH}{_LEVELS}, rp AS (SELECT qid, qv, label AS parent FROM (SELECT qid, qv, ro.label, row_number() OVER (PARTITION BY qid ORDER BY {_l2('qv', 'ro.cv')}, ro.label) AS r FROM q, ro) WHERE r <= 2), fp AS (SELECT qid, qv, slot FROM (SELECT qid, qv, fi.label AS slot, row_number() OVER (PARTITION BY qid ORDER BY {_l2('qv', 'fi.cv')}, fi.label) AS r, count(*) OVER (PARTITION BY qid) AS n FROM rp JOIN fi USING (parent)) WHERE r <= greatest(floor(n * 0.4 + 1e-9), 1)), fa AS (SELECT vec_id, v, slot FROM (SELECT vec_id, v, fi.label AS slot, row_number() OVER (PARTITION BY vec_id ORDER BY {_l2('fi.cv', 'v')}, fi.label) AS r FROM e, fi) WHERE r = 1), d AS (SELECT qid, vec_id, {_l2()} AS dist FROM fp JOIN fa USING (slot)){_top('d')}")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    rough, fine = _levels(t)
    return ivf.search(ivf.two_stage_entries(t.queries, rough, fine, 2, 0.4, K), ivf.postings(t.base, fine.select("label", "cv")), K).select("qid", "vec_id", _r())


@query("cat_flat", f"{WITH}{D}, l AS (SELECT d.* FROM d JOIN q USING (qid) WHERE d.label = q.qlabel){_top('l')}")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    return knn.in_group(t.base, t.queries, "label", "qlabel", K).select("qid", "vec_id", _r())


@query("cat_ivf", f"{_IVF}, l AS (SELECT * FROM d WHERE label = 3){_top('l', extra=', label AS category')}")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    return ivf.search(t.probes(), t.postings.where("label = 3"), K).select("qid", "vec_id", _r(), F.lit(3).alias("category"))


@query("multi_category", f"{WITH}, g AS (SELECT vec_id, v, label AS cat FROM e UNION ALL SELECT vec_id, v, 100 + vec_id % 4 FROM e), d AS (SELECT qid, cat, vec_id, {_l2()} AS dist FROM q, g WHERE cat IN (2, 101)) SELECT qid, cat, vec_id, round(dist, 6) + 0.0 AS dist FROM d QUALIFY row_number() OVER (PARTITION BY qid, cat ORDER BY dist, vec_id) <= 4")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    cats = t.base.withColumn("cat", F.explode(F.array(F.col("label").cast("long"), F.lit(100) + F.col("vec_id") % 4))).where("cat in (2, 101)")
    names = [(qid, cat, 4) for qid, _, _ in t.asked for cat in (2, 101)]
    asked = [Entry(2 * i + j, v, 4, cat) for i, (_, v, _) in enumerate(t.asked) for j, cat in enumerate((2, 101))]
    return ivf.labelled(spark, scan(cats, asked, L2, group="cat"), names).select("qid", F.col("pool_id").alias("cat"), "vec_id", _r())


# Product quantisation ---------------------------------------------------------------------


@query("pq_encode", f"{WITH}{CODE} SELECT vec_id, string_agg(code::VARCHAR, ',' ORDER BY frag) AS codes FROM code GROUP BY vec_id")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    return pq.codes(t.base.select("vec_id", "v"), t.book).select("vec_id", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


@query("pq_lut", f"{WITH}{CODE} SELECT qid, frag::INT AS frag, code::INT AS code, round(d, 6) + 0.0 AS dist FROM lut")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    return pq.lookup(t.queries, t.book).select("qid", "frag", "code", _r(F.col("d")))


def _coded(t: T, rows: DataFrame | None = None) -> DataFrame:
    """(vec_id, label[, slot], codes)"""
    return pq.codes(t.base if rows is None else rows, t.book)


_ADC_ROUND = ", ar AS (SELECT qid, vec_id, round(dist, 9) AS dist FROM adc)"


def _adc_top(t: T, k: int) -> DataFrame:
    return t.top(pq.adc(_coded(t), t.entries(k), t.book), k)


@query("pq_adc", f"{WITH}{CODE}{ADC}{_ADC_ROUND}{_top('ar')}")
def _(spark, sf_dir):
    return _adc_top(T(spark, sf_dir), K).select("qid", "vec_id", _r())


_PROBED = f"{WITH}{CODE}{ADC}{_ADC_ROUND}{ASSIGN}{PROBE}, l AS (SELECT ar.* FROM ar JOIN a USING (vec_id) JOIN p ON p.qid = ar.qid AND p.slot = a.slot)"


def _probed_adc(t: T, k: int) -> DataFrame:
    """Distances from codes within the probed slots only."""
    return t.top(pq.adc(_coded(t, t.postings), ivf.entries(t.probes(), k), t.book, group="slot"), k)


@query("ivfpq_probe_refine", f"{_PROBED}{D}, k AS ({_top('l', 40)}), r AS (SELECT d.* FROM d JOIN k USING (qid, vec_id)){_top('r')}")
def _(spark, sf_dir):
    """Probe, 40 candidates from codes, exact distances of those."""
    t = T(spark, sf_dir)
    return t.top(pq.refine(_probed_adc(t, 40).withColumnRenamed("qid", "pool"), t.base, t.entries(), K, L2)).select("qid", "vec_id", _r())


@query("cat_ivfpq", f"{_PROBED}{D}, c3 AS (SELECT l.* FROM l JOIN e USING (vec_id) WHERE e.label = 3), k AS ({_top('c3', 40)}), r AS (SELECT d.* FROM d JOIN k USING (qid, vec_id)){_top('r', extra=', label AS category')}")
def _(spark, sf_dir):
    """The same in one category, which is attached."""
    t = T(spark, sf_dir)
    near = t.top(pq.adc(_coded(t, t.postings.where("label = 3")), ivf.entries(t.probes(), 40), t.book, group="slot"), 40)
    found = t.top(pq.refine(near.withColumnRenamed("qid", "pool"), t.base, t.entries(), K, L2))
    return found.join(t.base.select("vec_id", F.col("label").alias("category")), "vec_id").select("qid", "vec_id", _r(), "category")


@query("ivfpq_candidates", f"{WITH}{CODE}{ADC}{_ADC_ROUND}{ASSIGN}{PROBE}, l AS (SELECT ar.* FROM ar JOIN a USING (vec_id) JOIN p ON p.qid = ar.qid AND p.slot = a.slot), k AS ({_top('l', 20)}) SELECT qid, vec_id, 0.0::DOUBLE AS score FROM k")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    return _probed_adc(t, 20).select("qid", "vec_id", F.lit(0.0).alias("score"))


@query("ivfpq_refine", f"{WITH}{CODE}{ADC}{_ADC_ROUND}{D}, k AS ({_top('ar', 40)}), r AS (SELECT d.* FROM d JOIN k USING (qid, vec_id)){_top('r')}")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    return t.top(pq.refine(_adc_top(t, 40).withColumnRenamed("qid", "pool"), t.base, t.entries(), K, L2)).select("qid", "vec_id", _r())


_GROUPED = f"{_PROBED}{D}, g AS (SELECT l.qid, l.vec_id, l.dist, e.label FROM l JOIN e USING (vec_id) WHERE e.label IN (3, 7)), k AS (SELECT qid, vec_id, label FROM g QUALIFY row_number() OVER (PARTITION BY qid, label ORDER BY dist, vec_id) <= 4)"


def _grouped_pq(t: T) -> DataFrame:
    """(qid, label, vec_id, dist): in each of two groups the 4 nearest of the probed slots by codes, with exact distances."""
    probes = [(r.qid, list(r.qv), r.slot, label) for r in t.probes().toLocalIterator() for label in (3, 7)]
    names = sorted({(qid, label, 4) for qid, _, _, label in probes})
    asked = [Entry(names.index((qid, label, 4)), v, 4, ivf.group_key(label, slot)) for qid, v, slot, label in probes]
    near = topk.top_k(pq.adc(_coded(t, t.postings.where("label in (3, 7)")), asked, t.book, group=ivf.group_key(F.col("label"), F.col("slot"))), 4, ["pool"])
    exact = pq.refine(near, t.base, [Entry(i, dict((q, v) for q, v, _ in t.asked)[n[0]], 4) for i, n in enumerate(names)], 4, L2)
    return ivf.labelled(t.spark, exact.drop("rk"), names).select("qid", F.col("pool_id").alias("label"), "vec_id", "dist")


for _name in ("group_ivfpq", "group_ivfpq_small"):

    @query(_name, f"{_GROUPED} SELECT k.qid, k.label, k.vec_id, round(d.dist, 6) + 0.0 AS dist FROM k JOIN d USING (qid, vec_id)")
    def _(spark, sf_dir):
        return _grouped_pq(T(spark, sf_dir)).select("qid", "label", "vec_id", _r())


@query("group_ivfpq_global", f"{_GROUPED}, r AS (SELECT k.qid, k.label, k.vec_id, d.dist FROM k JOIN d USING (qid, vec_id)) SELECT qid, label, vec_id, round(dist, 6) + 0.0 AS dist FROM r QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id, label) <= 5")
def _(spark, sf_dir):
    """One quota over the groups together."""
    found = _grouped_pq(T(spark, sf_dir))
    return topk.top_k(found, 5, ["qid"]).select("qid", "label", "vec_id", _r())


_RES = f""", rb AS (SELECT vec_id, slot, list_transform(list_zip(v, cv), lambda p: p[1] - p[2]) AS rv FROM e JOIN a USING (vec_id)),
rf AS (SELECT vec_id, slot, f AS frag, rv[4 * f + 1 : 4 * f + 4] AS part FROM rb, (SELECT unnest(range(16)) AS f)),
rc AS (SELECT f AS frag, vec_id AS code, rv[4 * f + 1 : 4 * f + 4] AS cv FROM rb, (SELECT unnest(range(16)) AS f) WHERE vec_id < 16),
rk AS (SELECT vec_id, slot, frag, code FROM (SELECT vec_id, slot, frag, code, row_number() OVER (PARTITION BY vec_id, frag ORDER BY {_l2("cv", "part")}, code) AS r FROM rf JOIN rc USING (frag)) WHERE r = 1),
rq AS (SELECT qid, slot, list_transform(list_zip(qv, cv), lambda p: p[1] - p[2]) AS rv FROM p),
rl AS (SELECT qid, slot, frag, code, {_l2("rv[4 * frag + 1 : 4 * frag + 4]", "cv")} AS d FROM rq, rc),
rd AS (SELECT qid, vec_id, round(sum(d), 9) AS dist FROM rk JOIN rl USING (slot, frag, code) GROUP BY qid, vec_id)"""


def _residual(t: T):
    """(postings with codes of residuals, the codebook, the centroids by slot)"""
    posted = t.postings
    book = pq.book(t.codebook(pq.residuals(posted.where(F.col("vec_id") < CODES), t.centroids)), FRAGMENTS)
    centroids = {r.label: list(r.cv) for r in t.centroids.toLocalIterator()}
    return pq.codes(posted.select("vec_id", "slot", "v"), book, centroids=centroids), book, centroids


@query("residual_pq", f"{WITH}{ASSIGN}{PROBE}{_RES}{_top('rd')}")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    codes, book, centroids = _residual(t)
    return t.top(pq.adc(codes, ivf.entries(t.probes(), K), book, "residual", centroids, "slot")).select("qid", "vec_id", _r())


@query("rpq_terms", f"{WITH}{ASSIGN}{PROBE}{_RES}{_top('rd', digits=5)}")
def _(spark, sf_dir):
    """|q - C|^2 + (|y|^2 + 2 C.y) - 2 q.y: the middle term depends on the slot alone."""
    t = T(spark, sf_dir)
    codes, book, centroids = _residual(t)
    found = pq.adc(codes, ivf.entries(t.probes(), 2 * K, offset=True), book, "terms", centroids, "slot", digits=12)
    return t.top(found.withColumn("dist", F.round("dist", 9))).select("qid", "vec_id", _r(digits=5))


_FAST = ", sp AS (SELECT qid, frag, min(d) AS lo, max(d) AS hi FROM lut GROUP BY qid, frag), sc AS (SELECT qid, least(255.0 / max(hi - lo), 65535.0 / sum(hi - lo)) AS a, sum(lo) AS b FROM sp GROUP BY qid), ql AS (SELECT qid, frag, code, floor((d - lo) * a)::INT AS d, a, b FROM lut JOIN sp USING (qid, frag) JOIN sc USING (qid))"


@query("fastscan_lut", f"{WITH}{CODE}{_FAST} SELECT qid, frag::INT AS frag, code::INT AS code, d AS q, round(a, 6) AS a, round(b, 6) AS b FROM ql")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    fast = pq.lookup(t.queries, t.book, fast=True)
    return fast.select("qid", "frag", "code", F.col("d").cast("int").alias("q"), F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("fastscan_scan", f"{WITH}{CODE}{_FAST}, fd AS (SELECT qid, vec_id, round(sum(d) / any_value(a) + any_value(b), 9) AS dist FROM code JOIN ql USING (frag, code) GROUP BY qid, vec_id){_top('fd')}")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    return t.top(pq.adc(_coded(t), t.entries(), t.book, "fast")).select("qid", "vec_id", _r())


@query("fastscan_probe", f"{WITH}{CODE}{_FAST}{ASSIGN}{PROBE}, fd AS (SELECT qid, vec_id, round(sum(d) / any_value(a) + any_value(b), 9) AS dist FROM code JOIN ql USING (frag, code) GROUP BY qid, vec_id), l AS (SELECT fd.* FROM fd JOIN a USING (vec_id) JOIN p ON p.qid = fd.qid AND p.slot = a.slot){_top('l')}")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    return t.top(pq.adc(_coded(t, t.postings), ivf.entries(t.probes(), K), t.book, "fast", group="slot")).select("qid", "vec_id", _r())


_RANGE = ", r AS (SELECT min(list_min(v)) AS lo, max(list_max(v)) AS hi FROM e)"


@query("sq8_range", f"{WITH}{_RANGE} SELECT round(lo, 6) AS lo, round(hi, 6) AS hi FROM r")
def _(spark, sf_dir):
    return T(spark, sf_dir).base.agg(F.round(F.min(F.array_min("v")), 6).alias("lo"), F.round(F.max(F.array_max("v")), 6).alias("hi"))


@query("sq8_roundtrip", f"{WITH}{_RANGE}, s AS (SELECT vec_id, v, list_transform(v, lambda x: floor(least(greatest((x - lo) / (hi - lo), 0), 1) * 255)) AS s, lo, hi FROM e, r) SELECT vec_id, list_sum(s)::BIGINT AS code_sum, round(list_sum(list_transform(s, lambda x: lo + (x + 0.5) / 255 * (hi - lo))), 6) + 0.0 AS decoded_sum FROM s")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    r = t.base.agg(F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi"))
    s = t.base.crossJoin(F.broadcast(r)).withColumn("s", encode.sq8_encode(F.col("v"), F.col("lo"), F.col("hi")))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return s.select("vec_id", total(F.transform("s", lambda x: x.cast("double"))).cast("long").alias("code_sum"), (F.round(total(encode.sq8_decode(F.col("s"), F.col("lo"), F.col("hi"))), 6) + 0.0).alias("decoded_sum"))


# Inner products as distances ---------------------------------------------------------------

_N2 = _s("p[1] * p[1]", "v", "v")
_LONGEST = f", n AS (SELECT max(sqrt({_N2})) AS longest FROM e)"


@query("max_norm", f"{WITH}{_LONGEST} SELECT round(longest, 6) AS longest FROM n")
def _(spark, sf_dir):
    return T(spark, sf_dir).base.agg(F.round(F.max(F.sqrt(encode.norm2(F.col("v")))), 6).alias("longest"))


def _longest(t: T) -> DataFrame:
    return t.base.crossJoin(F.broadcast(t.base.agg(F.max(F.sqrt(encode.norm2(F.col("v")))).alias("longest"))))


@query("mips_transform", f"{WITH}{_LONGEST}, s AS (SELECT vec_id, list_transform(v, lambda x: x * (0.38 / longest)) AS v FROM e, n), m AS (SELECT vec_id, {_N2} AS n2, v FROM s) SELECT vec_id, round(list_sum(v), 6) + 0.0 AS head, round(0.5 - n2, 6) + 0.0 AS t1, round(0.5 - n2 * n2, 6) + 0.0 AS t2, round(0.5 - (n2 * n2) * (n2 * n2), 6) + 0.0 AS t3 FROM m")
def _(spark, sf_dir):
    m = _longest(T(spark, sf_dir)).select("vec_id", encode.mips_document(F.col("v"), F.col("longest"), 3, 0.38).alias("m"))
    head = F.aggregate(F.slice("m", 1, 64), F.lit(0.0), lambda s, x: s + x)
    return m.select("vec_id", (F.round(head, 6) + 0.0).alias("head"), *((F.round(F.get("m", F.lit(63 + i)), 6) + 0.0).alias(f"t{i}") for i in (1, 2, 3)))


@query("mips_extra_dim", f"{WITH}{_LONGEST} SELECT vec_id, round(sqrt(greatest(longest * longest - {_N2}, 0)), 4) + 0.0 AS extra FROM e, n")
def _(spark, sf_dir):
    return _longest(T(spark, sf_dir)).select("vec_id", (F.round(encode.mips_extra(F.col("v"), F.col("longest")), 4) + 0.0).alias("extra"))


@query("rank_score", f"{WITH} SELECT vec_id, round(ln(label + 1) + ln(vec_id % 9 + 1), 6) AS score FROM e")
def _(spark, sf_dir):
    group = lambda level, i: F.struct(F.lit(level).alias("level"), i.cast("int").alias("id"))
    return T(spark, sf_dir).base.select("vec_id", F.round(encode.rank_score(F.array(group(0, F.lit(0)), group(1, F.col("label")), group(1, F.col("vec_id") % 9)), 1), 6).alias("score"))


@query("note_time", f"{WITH}, n AS (SELECT vec_id, printf('%08x', {BORN} + vec_id * 60) || CASE WHEN vec_id % 5 = 0 THEN 'x' ELSE '0123456789abcdef' END AS note FROM e) SELECT vec_id, CASE WHEN length(note) = 24 THEN {BORN} + vec_id * 60 END AS seconds FROM n")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    note = F.concat(F.lower(F.lpad(F.hex(t.created), 8, "0")), F.when(F.col("vec_id") % 5 == 0, "x").otherwise("0123456789abcdef"))
    return t.base.select("vec_id", encode.note_seconds(note).alias("seconds"))


# Aggregates and training --------------------------------------------------------------------

_POS = ", l AS (SELECT label, unnest(range(64)) AS pos, unnest(v) AS x FROM e)"
for _name, _f, _sql, _shift in (("vec_mean", train.mean, "avg(x)", False), ("vec_harmonic", train.harmonic_mean, "count(*) / sum(1 / x)", True), ("vec_geometric", train.geometric_mean, "exp(avg(ln(x)))", True), ("vec_variance", train.variance, "avg(x * x) - avg(x) * avg(x)", False)):

    @query(_name, f"{WITH}{_POS if not _shift else _POS.replace('unnest(v)', 'abs(unnest(v)) + 0.1')} SELECT label, pos::INT AS pos, round({_sql}, 6) + 0.0 AS x FROM l GROUP BY label, pos")
    def _(spark, sf_dir, f=_f, shift=_shift):
        base = T(spark, sf_dir).base
        base = base.withColumn("v", F.transform("v", lambda x: F.abs(x) + 0.1)) if shift else base
        return f(base, "label").select(F.col("label").cast("int").alias("label"), "pos", (F.round("x", 6) + 0.0).alias("x"))


for _name, _f, _sql in (("bin_majority", train.majority, "CASE WHEN sum(x) > count(*) // 2 THEN 1 ELSE 0 END::DOUBLE"), ("bin_variance", train.variance, "round(avg(x * x) - avg(x) * avg(x), 6)")):

    @query(_name, f"{WITH}{_POS.replace('unnest(v)', 'unnest(list_transform(v, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END::DOUBLE))')} SELECT label, pos::INT AS pos, {_sql} + 0.0 AS x FROM l GROUP BY label, pos")
    def _(spark, sf_dir, f=_f):
        bits = T(spark, sf_dir).base.select("label", encode.sign_bits(F.col("v")).alias("bits"))
        return f(bits, "label", "bits").select(F.col("label").cast("int").alias("label"), "pos", (F.round(F.col("x").cast("double"), 6) + 0.0).alias("x"))


@query("medoid", f"{WITH}{_POS}, m AS (SELECT label, list(x ORDER BY pos) AS cv FROM (SELECT label, pos, avg(x) AS x FROM l GROUP BY label, pos) GROUP BY label), d AS (SELECT label, vec_id, {_l2('cv', 'v')} AS dist FROM e JOIN m USING (label)) SELECT label, vec_id, round(dist, 6) AS dist FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) = 1")
def _(spark, sf_dir):
    return train.medoids(T(spark, sf_dir).base, "label").select(F.col("label").cast("int").alias("label"), "vec_id", _r())


def _lloyd_sql(k: int, source: str, vec: str) -> str:
    """CTE s<k+1>(label, cv) from s<k>: one round on table ``source``."""
    return f""", a{k} AS (SELECT id, {vec} AS v, label FROM (SELECT t.id, t.{vec}, s.label, row_number() OVER (PARTITION BY t.id ORDER BY {_l2("s.cv", f"t.{vec}")}, s.label) AS r FROM {source} t, s{k} s) WHERE r = 1),
m{k} AS (SELECT label, list(x ORDER BY pos) AS nv FROM (SELECT label, pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(len(v))) AS pos, unnest(v) AS x FROM a{k}) GROUP BY label, pos) GROUP BY label),
s{k + 1} AS (SELECT label, coalesce(nv, cv) AS cv FROM s{k} LEFT JOIN m{k} USING (label))"""


@query("kmeans_2iter", f"{WITH}, t AS (SELECT vec_id AS id, v FROM e), s0 AS (SELECT * FROM c WHERE label < 10){_lloyd_sql(0, 't', 'v')}{_lloyd_sql(1, 't', 'v')} SELECT label::BIGINT AS label, pos::INT AS pos, round(x, 6) + 0.0 AS x FROM (SELECT label, unnest(range(64)) AS pos, unnest(cv) AS x FROM s2)")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    found = train.kmeans(t.base, t.centroids.where("label < 10"), 2, 0.0, digits=6)
    return found.select("label", F.posexplode("cv").alias("pos", "x")).select("label", "pos", (F.round("x", 6) + 0.0).alias("x"))


_BOOK = ", b0 AS (SELECT f AS frag, vec_id AS label, v[4 * f + 1 : 4 * f + 4] AS cv FROM e, (SELECT unnest(range(16)) AS f) WHERE vec_id < 16), fr AS (SELECT vec_id, f AS frag, v[4 * f + 1 : 4 * f + 4] AS v FROM e, (SELECT unnest(range(16)) AS f))" + "".join(
    f""", n{k} AS (SELECT fr.frag, fr.vec_id, fr.v, b.label, row_number() OVER (PARTITION BY fr.frag, fr.vec_id ORDER BY {_l2("b.cv", "fr.v")}, b.label) AS r FROM fr JOIN b{k} b USING (frag)),
m{k} AS (SELECT frag, label, list(x ORDER BY pos) AS nv FROM (SELECT frag, label, pos, round(avg(x), 6) AS x FROM (SELECT frag, label, unnest(range(4)) AS pos, unnest(v) AS x FROM n{k} WHERE r = 1) GROUP BY frag, label, pos) GROUP BY frag, label),
b{k + 1} AS (SELECT frag, label, coalesce(nv, cv) AS cv FROM b{k} LEFT JOIN m{k} USING (frag, label))"""
    for k in range(2)
)


@query("codebook_2iter", f"{WITH}{_BOOK} SELECT frag::INT AS frag, label::INT AS code, pos::INT AS pos, round(x, 6) + 0.0 AS x FROM (SELECT frag, label, unnest(range(4)) AS pos, unnest(cv) AS x FROM b2)")
def _(spark, sf_dir):
    """All fragments of whole vectors."""
    t = T(spark, sf_dir)
    found = train.codebook(t.base, t.codebook(), FRAGMENTS, WIDTH, 2, digits=6)
    return found.select("frag", "code", F.posexplode("cv").alias("pos", "x")).select("frag", "code", "pos", (F.round("x", 6) + 0.0).alias("x"))


@query("cluster_stats", f"{WITH}, a AS (SELECT vec_id, slot, dist FROM (SELECT vec_id, c.label AS slot, {_l2('cv', 'v')} AS dist, row_number() OVER (PARTITION BY vec_id ORDER BY {_l2('cv', 'v')}, c.label) AS r FROM e, c) WHERE r = 1) SELECT slot::BIGINT AS slot, count(*) AS n, round(sum(dist), 6) AS cost FROM a GROUP BY slot")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    return train.cluster_stats(t.base, t.centroids).select("slot", "n", F.round("cost", 6).alias("cost"))


@query("group_counts", f"{WITH}{_WANTED_SQL} SELECT level, id, count(*) AS n FROM g GROUP BY level, id")
def _(spark, sf_dir):
    return ivf.group_entries(T(spark, sf_dir).base, _groups()).groupBy("level", "id").agg(F.count("*").alias("n"))


@query("reservoir_sample")
def _(spark, sf_dir):
    return train.first_centroids(T(spark, sf_dir).base, 20)


@query("spread_centroids")
def _(spark, sf_dir):
    """Starting centroids drawn far from each other."""
    return train.spread_centroids(T(spark, sf_dir).base, 20)


@query("medoid_update")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    return train.medoid_update(t.base, t.centroids.where("label < 10"))


@query("two_stage_clusters")
def _(spark, sf_dir):
    """(parent, label, cv): 4 clusters, each divided in proportion into 16 in all."""
    return train.staged(T(spark, sf_dir).base, [4, 4], rounds=3)[1]


@query("three_stage_clusters")
def _(spark, sf_dir):
    return train.staged(T(spark, sf_dir).base, [2, 2, 2], rounds=3)[2]


@query("latency_percentiles", "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (25, 50, 75, 90, 95, 99)) + " FROM events GROUP BY event_type")
def _(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy("event_type").agg(*(F.round(F.percentile("value", F.lit(p / 100)), 6).alias(f"p{p}") for p in (25, 50, 75, 90, 95, 99)))


# Merging and recall -------------------------------------------------------------------------


def _two(t: T):
    a = t.base.where("vec_id % 2 = 0").select(F.col("vec_id").alias("pk"), F.expr("vec_id div 2").alias("doc_id"), "v")
    b = t.base.where("vec_id % 2 = 1 or vec_id % 10 = 0").select(F.col("vec_id").alias("pk"), F.col("vec_id").alias("doc_id"), "v")
    return a, b


@query("merge_by_docid", f"{WITH} SELECT vec_id // 2 * 3 AS doc_id, vec_id AS pk, round(v[1], 6) + 0.0 AS x FROM e WHERE vec_id % 2 = 0 AND (vec_id // 2) % 7 <> 0 UNION ALL SELECT vec_id * 3 + 1, vec_id, round(v[1], 6) + 0.0 FROM e WHERE (vec_id % 2 = 1 OR vec_id % 10 = 0) AND vec_id % 5 <> 0")
def _(spark, sf_dir):
    a, b = _two(T(spark, sf_dir))
    ids = a.select(F.lit(0).alias("part"), "doc_id", F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.col("doc_id") * 3).alias("new_id")).union(b.where("doc_id % 5 <> 0").select(F.lit(1), "doc_id", F.col("doc_id") * 3 + 1))
    return merge.by_docid([a, b], ids).select("doc_id", "pk", (F.round(F.get("v", F.lit(0)), 6) + 0.0).alias("x"))


@query("merge_by_pk", f"{WITH} SELECT vec_id + 1000 AS doc_id, vec_id AS pk, round(v[1], 6) + 0.0 AS x FROM e WHERE vec_id % 3 <> 0")
def _(spark, sf_dir):
    a, b = _two(T(spark, sf_dir))
    keys = a.union(b).where("pk % 3 <> 0").select("pk", (F.col("pk") + 1000).alias("new_id")).distinct()
    return merge.by_key([a, b], keys).select("doc_id", "pk", (F.round(F.get("v", F.lit(0)), 6) + 0.0).alias("x"))


@query("groundtruth", f"{WITH}{D} SELECT qid, vec_id, (row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id))::INT AS rk FROM d QUALIFY rk <= 100")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    return knn.exact(t.base, t.queries, 100).select("qid", "vec_id", "rk")


@query("recall_at_k", f"{_IVF}, t AS ({_top('(SELECT qid, vec_id, ' + _l2() + ' AS dist FROM q, e)')}), f AS ({_top('d')}) SELECT t.qid, round(count(f.vec_id) / count(*), 6) AS recall FROM t LEFT JOIN f USING (qid, vec_id) GROUP BY t.qid")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    return merge.recall(ivf.search(t.probes(), t.postings, K), knn.exact(t.base, t.queries, K)).select("qid", F.round("recall", 6).alias("recall"))


@query("split_by_category", f"{WITH}, n AS (SELECT label, count(*) AS n FROM e GROUP BY label) SELECT vec_id, label, CASE WHEN n > 50 THEN 'ivf' ELSE 'flat' END AS kind FROM e JOIN n USING (label)")
def _(spark, sf_dir):
    return merge.by_category_size(T(spark, sf_dir).base, "label", 50).select("vec_id", "label", "kind")


# From strings -------------------------------------------------------------------------------


def _schema(kind: str, **more) -> engine.Schema:
    return engine.Schema(kind, ratio=0.5, pq_scan_num=40, **more)


def _built(t: T, kind: str, **more) -> tuple[str, engine.Schema]:
    """(path, schema) of an index of all vectors, from build strings, with centroids by group."""
    schema = _schema(kind, **more)
    every = t.centroids.select(F.lit(0).alias("level"), F.lit(0).alias("id"), "label", "cv")
    own = t.base.where("vec_id % 5 = 0").select(F.lit(1).alias("level"), F.col("label").alias("id"), F.col("vec_id").alias("label"), F.col("v").alias("cv"))
    text = F.concat(F.lit("0:0;1:"), F.col("label").cast("string"), F.lit("||"), F.array_join(F.transform("v", lambda x: x.cast("string")), " "))
    records = t.base.select("vec_id", (F.col("vec_id") + 1000).alias("pk"), t.created.alias("created"), text.alias("value"))
    path = engine_path(t.spark)
    engine.Builder(schema, every.union(own), t.codebook() if schema.coded else None).build(records, path)
    return path, schema


def engine_path(spark: SparkSession) -> str:
    """A new folder for an index, below the folder that driver and executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder; a cluster needs one that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="nearfield-")
    return f"{where.rstrip('/')}/nearfield/index-{uuid.uuid4().hex}"


def _strings(t: T, groups: str, tail: str = "") -> list[str]:
    return [f"{groups}||{' '.join(repr(x) for x in v)}{tail}" for _, v, _ in t.asked]


_STR = f""", g AS (SELECT vec_id, v, 0 AS level, 0 AS id FROM e UNION ALL SELECT vec_id, v, 1, label FROM e),
gc AS (SELECT 0 AS level, 0 AS id, label, cv FROM c UNION ALL SELECT 1, label, vec_id, v FROM e WHERE vec_id % 5 = 0),
gall AS (SELECT * FROM gc UNION ALL SELECT level, id, 0, v FROM (SELECT g.*, row_number() OVER (PARTITION BY level, id ORDER BY vec_id) AS r FROM g ANTI JOIN gc USING (level, id)) WHERE r = 1),
ga AS (SELECT level, id, vec_id, v, slot FROM (SELECT g.level, g.id, vec_id, v, label AS slot, row_number() OVER (PARTITION BY g.level, g.id, vec_id ORDER BY {_l2('cv', 'v')}, label) AS r FROM g JOIN gall USING (level, id)) WHERE r = 1),
w(level, id, pool_id, k) AS (VALUES (0, 0, 0, 4), (1, 3, 1, 3), (1, 7, 2, 5), (9, 9, 3, 2)),
gp AS (SELECT qid, qv, level, id, pool_id, k, slot FROM (SELECT qid, qv, w.level, w.id, pool_id, k, label AS slot, row_number() OVER (PARTITION BY qid, pool_id ORDER BY {_l2('qv', 'cv')}, label) AS r, count(*) OVER (PARTITION BY qid, pool_id) AS n FROM q, w JOIN gall USING (level, id)) WHERE r <= greatest(floor(n * 0.5 + 1e-9), 1))"""
_NUMBERED = ", qn AS (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS n FROM q)"
_STRING_SQL = f"{WITH}{_STR}{_NUMBERED}, d AS (SELECT gp.qid, pool_id, k, vec_id, {_l2()} AS dist FROM gp JOIN ga USING (level, id, slot)), h AS (SELECT qn.n AS qid, pool_id, vec_id, dist FROM d JOIN qn USING (qid) QUALIFY row_number() OVER (PARTITION BY qn.n, pool_id ORDER BY dist, vec_id) <= k)"


@query("group_ivf_string", f"{_STRING_SQL} SELECT qid::BIGINT AS qid, pool_id, vec_id, vec_id + 1000 AS pk, round(dist, 6) + 0.0 AS dist FROM h")
def _(spark, sf_dir):
    """Build strings to an index of centroids by group, query strings to its results."""
    t = T(spark, sf_dir)
    path, schema = _built(t, "GroupIvf")
    found = engine.Searcher(spark, path, schema).search(_strings(t, "0:0#4;1:3#3,7#5;9:9#2"))
    return found.select("qid", "pool_id", "vec_id", "pk", _r())


@query("group_ivf_string_distinct", f"{_STRING_SQL} SELECT qid::BIGINT AS qid, vec_id, round(min(dist), 6) + 0.0 AS dist FROM h WHERE vec_id % 7 <> 0 GROUP BY qid, vec_id".replace("FROM gp JOIN ga USING (level, id, slot)", "FROM gp JOIN ga USING (level, id, slot) WHERE vec_id % 7 <> 0"))
def _(spark, sf_dir):
    """Without deleted keys, a row of several groups once."""
    t = T(spark, sf_dir)
    path, schema = _built(t, "GroupIvf")
    gone = t.deleted.select((F.col("vec_id") + 1000).alias("pk"))
    found = engine.Searcher(spark, path, schema, deleted=gone).search(_strings(t, "0:0#4;1:3#3,7#5;9:9#2"), distinct=True)
    return found.select("qid", "vec_id", _r())


@query("recall_test_string", f"{WITH}{_NUMBERED}, d AS (SELECT qn.n::BIGINT AS qid, vec_id, {_l2()} AS dist FROM q JOIN qn USING (qid), e){_top('d', 6)}")
def _(spark, sf_dir):
    """A recall test over all slots is exact; a total stands for the only group's quota."""
    t = T(spark, sf_dir)
    path, schema = _built(t, "GroupIvf")
    found = engine.Searcher(spark, path, schema).search(_strings(t, "6&0:0#2", "||coarse_scan_ratio=1"), recall_test=True)
    return found.select("qid", "vec_id", _r())


@query("group_ivfpq_string", f"{WITH}{_STR}{_NUMBERED}{CODE[CODE.index(', cb'):]}{ADC}{_ADC_ROUND}, l AS (SELECT gp.qid, pool_id, k, vec_id, ar.dist FROM gp JOIN ga USING (level, id, slot) JOIN ar USING (qid, vec_id)), n AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY qid, pool_id ORDER BY dist, vec_id) <= 40), x AS (SELECT n.qid, pool_id, k, n.vec_id, {_l2()} AS dist FROM n JOIN q USING (qid) JOIN e USING (vec_id)) SELECT qn.n::BIGINT AS qid, pool_id, vec_id, round(dist, 6) + 0.0 AS dist FROM x JOIN qn USING (qid) QUALIFY row_number() OVER (PARTITION BY qn.n, pool_id ORDER BY dist, vec_id) <= k")
def _(spark, sf_dir):
    """Probes by group, 40 candidates of each pool from codes, exact distances of those."""
    t = T(spark, sf_dir)
    path, schema = _built(t, "GroupIvfPq")
    return engine.Searcher(spark, path, schema).search(_strings(t, "0:0#4;1:3#3,7#5;9:9#2")).select("qid", "pool_id", "vec_id", _r())


@query("merged_index_string", f"{WITH}{_NUMBERED}, d AS (SELECT qn.n::BIGINT AS qid, vec_id * 2 AS vec_id, {_l2()} AS dist FROM q JOIN qn USING (qid), e WHERE vec_id % 7 <> 0){_top('d', 5)}")
def _(spark, sf_dir):
    """Two indexes merged under new ids, some deleted; then an exact search by string."""
    t = T(spark, sf_dir)
    schema, parts = _schema("GroupIvf"), []
    text = F.concat(F.lit("0:0||"), F.array_join(F.transform("v", lambda x: x.cast("string")), " "))
    for half in (0, 1):
        parts.append(engine_path(spark))
        rows = t.base.where(F.col("vec_id") % 2 == half).select("vec_id", F.col("vec_id").alias("pk"), text.alias("value"))
        engine.Builder(schema, t.centroids.select(F.lit(0).alias("level"), F.lit(0).alias("id"), "label", "cv")).build(rows, parts[-1])
    ids = t.base.where("vec_id % 7 <> 0").select((F.col("vec_id") % 2).cast("int").alias("part"), F.col("vec_id").alias("doc_id"), (F.col("vec_id") * 2).alias("new_id"))
    path = engine_path(spark)
    engine.Merger(schema).merge(spark, parts, ids, path)
    return engine.Searcher(spark, path, schema).search(_strings(t, "0:0#5", "||coarse_scan_ratio=1"), recall_test=True).select("qid", "vec_id", _r())


@query("mips_scores", f"{WITH}{_LONGEST}, s AS (SELECT vec_id, list_transform(v, lambda x: x * (0.38 / longest)) AS v, longest FROM e, n), m AS (SELECT vec_id, longest, list_concat(v, [0.5 - n2, 0.5 - n2 * n2, 0.5 - (n2 * n2) * (n2 * n2)]) AS v FROM (SELECT *, {_N2} AS n2 FROM s)), d AS (SELECT qid, vec_id, longest, {_s('p[1] * p[1]', 'qv', 'qv')} AS n2, {_l2('list_concat(qv, [0.0, 0.0, 0.0])', 'm.v')} AS dist FROM q, m) SELECT qid, vec_id, round((n2 + 0 - dist) / 2 * (longest / 0.38), 5) + 0.0 AS score FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) <= 10")
def _(spark, sf_dir):
    """Queries padded, distances turned back into inner products."""
    t = T(spark, sf_dir)
    longest = t.base.agg(F.max(F.sqrt(encode.norm2(F.col("v"))))).first()[0]
    mips = engine.NAMES["mips"](longest)
    asked = t.spark.createDataFrame([(qid, mips.query(v), sum(x * x for x in v)) for qid, v, _ in t.asked], "qid long, qv array<double>, squares double")
    found = knn.exact(t.base.select("vec_id", mips.document(F.col("v")).alias("v")), asked, K)
    score = encode.mips_score(F.col("squares"), F.col("dist"), longest, mips.m, mips.u)
    return found.join(F.broadcast(asked.select("qid", "squares")), "qid").select("qid", "vec_id", (F.round(score, 5) + 0.0).alias("score"))


@query("merge_requantised", f"{WITH}{_RANGE} SELECT vec_id, list_sum(list_transform(v, lambda x: floor(least(greatest((x - lo) / (hi - lo), 0), 1) * 255)))::BIGINT AS code_sum FROM e, r")
def _(spark, sf_dir):
    """Two indexes of 8-bit codes, coded anew by the range of both."""
    t = T(spark, sf_dir)
    rows, _, _ = merge.requantised([t.base.where("vec_id % 2 = 0"), t.base.where("vec_id % 2 = 1")])
    return rows.select("vec_id", F.aggregate("codes", F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"))


@query("first_wins", f"{WITH} SELECT label::INT AS label, min(vec_id) AS vec_id FROM e GROUP BY label")
def _(spark, sf_dir):
    return merge.first_wins(T(spark, sf_dir).base.select("label", "vec_id"), "label", "vec_id")


@query("recall_ties", f"{_IVF}, t AS ({_top('(SELECT qid, vec_id, ' + _l2() + ' AS dist FROM q, e)')}), f AS ({_top('d')}) SELECT f.qid, round(count(t.vec_id) / 10, 6) AS recall FROM f LEFT JOIN t USING (qid, vec_id) GROUP BY f.qid")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    found = merge.recall_with_ties(ivf.search(t.probes(), t.postings, K), knn.exact(t.base, t.queries, 2 * K), K)
    return found.select("qid", F.round("recall", 6).alias("recall"))


@query("delete_full_sort", f"{WITH}{D}, l AS (SELECT *, {NOW} - ({BORN} + vec_id * 60) AS age FROM d WHERE vec_id % 7 <> 0){_top('(SELECT * FROM l WHERE age BETWEEN 0 AND 7200)', 5)}")
def _(spark, sf_dir):
    """A real-time bucket of up to 7200 s: deleted rows don't use up the quota."""
    t = T(spark, sf_dir)
    young = t.base.where((F.lit(NOW) - t.created).between(0, 7200))
    return topk.full_sort_live(knn.exact(young, t.queries, young.count()).drop("rk"), t.deleted, 5, ["qid"]).select("qid", "vec_id", _r())


# Sources ------------------------------------------------------------------------------------


def _text(t: T) -> DataFrame:
    return t.base.select(F.concat_ws(";", F.col("label").cast("string"), F.col("vec_id").cast("string"), F.array_join(F.transform("v", lambda x: F.round(x, 3).cast("decimal(10,3)").cast("string")), ",")).alias("value"))


@query("text_vectors", f"{WITH} SELECT vec_id AS key, label::BIGINT AS cat, round(list_sum(list_transform(v[1:6], lambda x: round(x, 3))), 3) + 0.0 AS total FROM e WHERE vec_id % 11 <> 0")
def _(spark, sf_dir):
    """Lines of vectors, some too short, parsed back."""
    t = T(spark, sf_dir)
    lines = _text(t).withColumn("value", F.when(F.regexp_extract("value", r"^\d+;(\d+);", 1).cast("long") % 11 == 0, F.substring_index("value", ",", 3)).otherwise(F.col("value")))
    rows = readers.parsed_vectors(lines, FRAGMENTS * WIDTH, category=True)
    return rows.select("key", "cat", (F.round(F.aggregate(F.slice("vec", 1, 6), F.lit(0.0), lambda s, x: s + x.cast("double")), 3) + 0.0).alias("total"))


@query("centroid_file", f"{WITH} SELECT label % 3 AS parent, label, round(cv[1], 3) + 0.0 AS x FROM c")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    lines = t.centroids.select(F.concat_ws(" ", (F.col("label") % 3).cast("string"), F.col("label").cast("string"), F.array_join(F.transform("cv", lambda x: F.round(x, 3).cast("decimal(10,3)").cast("string")), ",")).alias("value"))
    return readers.parsed_centroids(lines, fine=True).select("parent", "label", (F.round(F.get("cv", F.lit(0)), 3) + 0.0).alias("x"))


@query("group_meta", "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT 1::BIGINT AS level, label::BIGINT AS id, n AS doc_count, (n // 10)::BIGINT AS centroid_count, coalesce(sum(n // 10) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_slot FROM n")
def _(spark, sf_dir):
    n = T(spark, sf_dir).base.groupBy("label").agg(F.count("*").alias("n"))
    lines = n.select(F.concat_ws(":", F.lit("1"), F.col("label").cast("string"), F.col("n").cast("string"), F.expr("n div 10").cast("string")).alias("value"))
    return readers.parsed_group_meta(lines)


@query("requests", "SELECT event_id::VARCHAR AS request_id, event_type AS request_url FROM events")
def _(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = events.select(F.to_json(F.struct(F.col("event_id").cast("string").alias("request_id"), F.col("event_type").alias("request_url"))).alias("value"))
    return readers.parsed_requests(lines)


@query("records", f"{WITH} SELECT vec_id::VARCHAR AS id, round(v[1], 3) + 0.0 AS x FROM e WHERE vec_id % 2 = 0")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    text = F.concat(F.lit("CMD="), F.when(F.col("vec_id") % 2 == 0, "add").otherwise("del"), F.lit("\nid="), F.col("vec_id").cast("string"), F.lit("\ncate_vec="), F.array_join(F.transform("v", lambda x: F.round(x, 3).cast("decimal(10,3)").cast("string")), " "))
    return readers.parsed_records(t.base.select(text.alias("value"))).select("id", (F.round(F.get("vec", F.lit(0)).cast("double"), 3) + 0.0).alias("x"))


# Graphs -------------------------------------------------------------------------------------


def _recall(t: T, found: DataFrame) -> DataFrame:
    return merge.recall(found, knn.exact(t.base, t.queries, K)).select("qid", "recall")


@query("hnsw_recall")
def _(spark, sf_dir):
    """Each query's recall over several shards."""
    t = T(spark, sf_dir)
    base = graph.sharded(t.base, 250)
    return _recall(t, graph.search(base, graph.build(base, "hnsw"), t.queries, K))


@query("vamana_recall")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    base = graph.sharded(t.base, 250)
    return _recall(t, graph.search(base, graph.build(base), t.queries, K))


@query("sharded_vamana_recall")
def _(spark, sf_dir):
    """Shards by centroids, each vector in two."""
    t = T(spark, sf_dir)
    base = graph.by_centroids(t.base, t.centroids.where("label < 4"), capacity=1000)
    return _recall(t, graph.search(base, graph.build(base), t.queries, K))


@query("merged_vamana_recall")
def _(spark, sf_dir):
    """One merged graph of overlapping shards, walked by product codes, re-ranked by exact distances."""
    t = T(spark, sf_dir)
    base = graph.by_centroids(t.base, t.centroids.where("label < 4"), capacity=1000)
    edges = graph.build(base).persist()
    starts = [r.start for r in edges.select("start").distinct().orderBy("start").toLocalIterator()]
    nodes, coded = graph.nodes(t.base, edges, 64).persist(), _coded(t).persist()
    found = graph.beam_search(nodes, coded, t.entries(), starts, t.book, K, width=200)
    rows = [tuple(r) for r in _recall(t, found).collect()]  # a row a stated query
    for df in (edges, nodes, coded):
        df.unpersist()
    return spark.createDataFrame(rows, "qid long, recall double")


# Streams ------------------------------------------------------------------------------------


@query("rt_union", f"{_IVF}{_top('d')}")
def _(spark, sf_dir):
    t = T(spark, sf_dir)
    rows = t.postings
    return segments.union_search(rows.where("vec_id % 4 <> 0"), rows.where("vec_id % 4 = 0"), t.probes(), K, L2).select("qid", "vec_id", _r())


@query("global_ids", f"{WITH} SELECT vec_id, (label::BIGINT * 4294967296 + vec_id) AS gloid FROM e")
def _(spark, sf_dir):
    return T(spark, sf_dir).base.select("vec_id", segments.global_id(F.col("label"), F.col("vec_id")).alias("gloid"))
