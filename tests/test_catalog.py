"""Queries against their SQL on the smallest scale, and plan checks."""

import math
import os

import duckdb
import numpy as np
import pytest

from nearfield.plans import catalog, query, spec

DIR = "/root/testdata/sf0.001"
NAMES = sorted(catalog.oracle_sql())
RECALLS = ["hnsw_recall", "vamana_recall", "sharded_vamana_recall", "merged_vamana_recall"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(DIR):
        path = f"{DIR}/{t}" if os.path.isfile(f"{DIR}/{t}") else f"{DIR}/{t}/*.parquet"
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{path}')")
    return c


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, DIR)
    r = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(plain(x[names.index(c)]) for c in sorted(names)) for x in r.fetchall()), key=repr)
    assert sorted((tuple(plain(x[c]) for c in sorted(names)) for x in df.collect()), key=repr) == want


def test_kernels_equal_expressions(spark):
    from pyspark.sql import functions as F

    from nearfield.functions import metrics

    rng = np.random.default_rng(1)
    q, v = rng.normal(size=9), rng.normal(size=9)
    df = spark.createDataFrame([(q.tolist(), v.tolist())], "q array<double>, v array<double>")
    got = df.select(*(f(F.col("q"), F.col("v")).alias(n) for n, f in metrics.FLOAT.items())).first()
    for n in metrics.FLOAT:
        assert got[n] == pytest.approx(float(metrics.KERNELS[n](q, v[None])[0]), abs=1e-12), n


def test_query_strings():
    q = query.parse_search("2&1:11#1;2:200#3||1 2;3 4||coarse_scan_ratio=0.5")
    assert (q.total, [g.k for g in q.groups], q.vectors[1]) == (2, [1, 3], (3.0, 4.0))
    assert query.parse_search("0:0#9||1||multi_age_mode=7200#1;3600#2").ages == ((5400, 2), (7200, 1))
    assert query.parse_build("1 2")[0] == ((0, 0),)
    assert q.boosted(2).groups[1].k == 6
    for bad in ("", "a||b||c||d", "1:2||3", "||"):
        with pytest.raises(ValueError):
            query.parse_search(bad)


def test_specs():
    assert spec.VectorSpec(64, "binary", "hamming").element_size == 8
    assert spec.from_factory("IDMap,HNSW32") == "GroupHnsw" and spec.from_factory("IVF10,PQ8") == "IvfPQ"
    assert spec.plan("GroupHnsw", rows=3, threshold=5) == "exact" and spec.plan("IvfPQFlat") == "pq"
    with pytest.raises(ValueError):
        spec.VectorSpec(3, "binary", "hamming")


def test_scans_read_probed_partitions_only(spark, tmp_path):
    from nearfield.operators import ivf

    t = catalog.T(spark, DIR)
    ivf.save(t.postings, str(tmp_path / "p"))
    saved = spark.read.parquet(str(tmp_path / "p"))
    found = ivf.search(t.probes(), saved, 5)
    assert "slot" in found._jdf.queryExecution().toString().split("PartitionFilters")[1][:200]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, ivf.search(t.probes(), t.postings, 5).collect()))


@pytest.mark.parametrize("name", ["knn_l2", "bin_hamming", "bitmap_ops", "m_permutation", "multi_category", "topk_group_quota", "topk_age_quota", "ivf_flat", "ivf_assign_2level", "pq_adc", "ivfpq_probe_refine", "rpq_terms", "fastscan_scan", "group_ivf_two_stage", "rt_union"])
def test_plans_have_no_product(spark, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        plan = catalog.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["pq_encode", "ivf_assign"])
def test_codes_and_slots_need_no_shuffle(spark, name):
    plan = catalog.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


@pytest.mark.parametrize("name", RECALLS)
def test_recall(spark, name):
    rows = catalog.queries()[name](spark, DIR).collect()
    assert len(rows) == 10 and np.mean([r.recall for r in rows]) >= 0.95


def test_half_precision(spark):
    t = catalog.T(spark, DIR)
    ids = [r.vec_id for r in t.base.orderBy("vec_id").collect()]
    x = np.array([r.v for r in t.base.orderBy("vec_id").collect()]).astype(np.float16).astype(float)
    for name, dist in (("knn_half_l2", lambda q: ((q - x) ** 2).sum(axis=1)), ("knn_half_ip", lambda q: -(x @ q))):
        got = {}
        for r in catalog.queries()[name](spark, DIR).collect():
            got.setdefault(r.qid, []).append((r.dist, r.vec_id))
        for qid, found in got.items():
            d = dist(x[ids.index(qid)]).round(6)
            assert np.allclose(sorted(a for a, _ in found), np.sort(d)[:10], atol=1e-5), name


def test_reservoir_and_spread(spark):
    from nearfield.operators import train

    t = catalog.T(spark, DIR)
    a, b = (sorted(map(tuple, ((r.label, tuple(r.cv)) for r in train.first_centroids(df, 20).collect()))) for df in (t.base, t.base.repartition(7)))
    assert a == b and len({v for _, v in a}) == 20
    x = np.array([r.v for r in t.base.collect()])
    at = train.spread(x, 10)
    assert len(set(at.tolist())) == 10 and at[0] == ((x[:, None] - x[None]) ** 2).sum(axis=(1, 2)).argmin()
    assert train.spread(np.zeros((3, 2)), 5).tolist() in ([0, 1, 2], [0, 2, 1])


def test_medoids_of_a_sample(spark):
    from nearfield.operators import train

    rows = [(i, [float(i % 3 == 0) * 10 + i * 0.01, 0.0]) for i in range(30)]
    base = spark.createDataFrame(rows, "vec_id long, v array<double>")
    start = spark.createDataFrame([(0, [0.0, 0.0]), (1, [10.0, 0.0]), (2, [99.0, 0.0])], "label long, cv array<double>")
    got = {r.label: r.cv for r in train.medoid_update(base, start).collect()}
    assert got[2] == [99.0, 0.0]
    for label, keep in ((0, lambda i: i % 3), (1, lambda i: not i % 3)):
        x = np.array([v for i, v in rows if keep(i)])
        y = np.vstack([x, x.mean(axis=0)])
        assert got[label] == pytest.approx(y[((y[:, None] - x[None]) ** 2).sum(axis=(1, 2)).argmin()].tolist())


def test_stages(spark):
    from nearfield.operators import train

    t = catalog.T(spark, DIR)
    first, second = train.staged(t.base, [4, 4], rounds=5)
    labels = [r.label for r in second.collect()]
    assert first.count() == 4 and 16 <= len(labels) <= 20 and len(set(labels)) == len(labels)
    assert train.children(2, 3, {0: 10, 1: 1}) == {0: 6, 1: 1}
    cost = lambda c: train.cluster_stats(t.base, c.select("label", "cv")).agg({"cost": "sum"}).first()[0]
    assert cost(second) < cost(first)
    trained = train.CentroidTrainer([4], fragments=16, codes=8, rounds=2).train(t.base)
    assert trained["codebook"].count() == 128 and trained["centroids0"].count() == 4
    with pytest.raises(ValueError):
        train.CentroidTrainer([4], fragments=7).train(t.base)


def test_null_vectors_and_wrong_dimensions(spark):
    from nearfield.operators import knn

    base = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [1.0, 1.0])], "vec_id long, v array<double>")
    ask = lambda v: spark.createDataFrame([(0, v)], "qid long, qv array<double>")
    assert [r.vec_id for r in knn.exact(base, ask([0.0, 0.0]), 5).orderBy("rk").collect()] == [1, 3]
    assert knn.exact(base.limit(0), ask([0.0, 0.0]), 5).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        knn.exact(base, ask([0.0]), 5).collect()
    double = knn.exact(base, ask([0.0, 0.0]), 5, kernel=lambda q, x: 2 * np.abs(x - q).sum(axis=1)).orderBy("rk").collect()
    assert [r.dist for r in double] == [2.0, 4.0]


def test_searcher(spark, tmp_path):
    from pyspark.sql import functions as F

    from nearfield.plans import engine

    t = catalog.T(spark, DIR)
    path, schema = catalog._built(t, "GroupIvf")
    meta = spark.read.parquet(f"{path}/meta").orderBy("first_slot").collect()
    assert [m.first_slot for m in meta] == [0, *np.cumsum([m.centroid_count for m in meta])[:-1].tolist()]
    s = engine.Searcher(spark, path, schema)
    one = catalog._strings(t, "0:0#5", "||coarse_scan_ratio=1")[:2]
    exact = [r.vec_id for r in s.search(one, recall_test=True).where("qid = 0").orderBy("rk").collect()]
    some = s.search(one, reject=F.col("vec_id") == exact[0]).where("qid = 0").orderBy("rk").collect()
    assert [r.vec_id for r in some][:4] == exact[1:]
    keys = spark.createDataFrame([(exact[2] + 1000,), (7,)], "pk long")
    assert [r.vec_id for r in s.search(one, keys=keys, reject=F.lit(True)).where("qid = 0").collect()] == [exact[2]]
    assert [r.vec_id for r in s.search(one, docids=keys.select((F.col("pk") - 1000).alias("vec_id"))).where("qid = 0").collect()] == [exact[2]]
    gone = engine.Searcher(spark, path, schema, deleted=keys)
    assert exact[2] not in [r.vec_id for r in gone.search(one).collect() if r.qid == 0]
    fresh = s.tables["postings"].where(F.col("vec_id") == exact[0]).select("*").withColumn("vec_id", F.lit(10**6).cast("long")).withColumn("pk", F.lit(5).cast("long"))
    live = engine.Searcher(spark, path, schema, real_time=[fresh])
    assert 5 in [r.pk for r in live.search(one).collect() if r.qid == 0]
    assert live.search(one, visit_limit=1).count() == 0 and live.search(one, visit_limit=10**6).count() == 10
    ages = catalog._strings(t, "0:0#1", "||multi_age_mode=7200#2;20000#3")[:1]
    got = live.search(ages, now=catalog.NOW).collect()
    assert sorted((r.pool_id, r.rk) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (1, 3)]
    with pytest.raises(ValueError):
        s.search(ages)
    found, seen = engine.observed(s.search(one))
    assert found.count() == 10 and seen.get["rows"] == 10


def test_hnsw_by_group_above_a_threshold(spark):
    from nearfield.plans import engine

    t = catalog.T(spark, DIR)
    path, schema = catalog._built(t, "GroupHnsw", threshold=100)
    found = engine.Searcher(spark, path, schema).search(catalog._strings(t, "0:0#5;1:3#4")[:3]).collect()
    own = {(r.qid, r.pool_id): [] for r in found}
    for r in found:
        own[r.qid, r.pool_id].append(r.vec_id)
    label = {r.vec_id: r.label for r in t.base.collect()}
    assert all(len(v) == (5 if p == 0 else 4) for (_, p), v in own.items()) and all(label[i] == 3 for (_, p), v in own.items() if p == 1 for i in v)


def test_registry_and_trained_groups(spark):
    from pyspark.sql import functions as F

    from nearfield.plans import engine

    with pytest.raises(ValueError):
        engine.register("mips")(object)
    t = catalog.T(spark, DIR)
    rows = t.base.select("vec_id", F.lit(1).alias("level"), F.col("label").alias("id"), "v")
    got = engine.train_group_centroids(rows, per=20, rounds=2)
    sizes = {r.label: r["count"] for r in t.base.groupBy("label").count().collect()}
    assert {r.id: r["count"] for r in got.groupBy("id").count().collect()} == {k: max(1, n // 20) for k, n in sizes.items()}


def test_merge_tools(spark):
    from nearfield.operators import merge, topk

    docs = spark.createDataFrame([(1, 1), (1, 2)], "key long, label int")
    with pytest.raises(ValueError):
        merge.by_category_size(docs, "label", 1, "key")
    found = spark.createDataFrame([(0, 1, 0.5, 0), (0, 1, 0.5 + 5e-7, 1), (0, 1, 0.6, 2)], "qid long, vec_id long, dist double, pool_id int")
    assert sorted(r.pool_id for r in topk.dedupe_scores(found, ["qid"]).collect()) == [0, 2]
    assert topk.quota_or_total(0, 9) == 9 and topk.quota_or_total(3, 9) == 3
    truth = spark.createDataFrame([(0, 1, 0.1, 1), (0, 2, 0.2, 2)], "qid long, vec_id long, dist double, rk int")
    other = spark.createDataFrame([(0, 5, 0.1, 1), (0, 6, 0.9, 2)], "qid long, vec_id long, dist double, rk int")
    assert merge.recall_by_score(other, truth).first().recall == 0.5


def test_rules_of_probes():
    from nearfield.operators import ivf

    assert ivf.probe_count(0.01, 50) == 1 and ivf.probe_count(0.5, 7) == 3 and ivf.probe_count(0.5, 8, 0.5) == 2
    assert ivf.probe_ratio(0.1) == 0.1 and ivf.probe_ratio(0.1, 0.3) == 0.3
    assert ivf.probe_ratio(0.1, 0.3, 0.7, True, True) == 0.7 and ivf.probe_ratio(0.1, 0.3, 0.7, True, False) == 0.3


def test_files(spark, tmp_path):
    from nearfield.sources import readers

    (tmp_path / "n").write_text("3.5\n")
    assert readers.read_norm(spark, str(tmp_path / "n")) == 3.5
    bits = ",".join(["1"] + ["0"] * 30 + ["1"])
    (tmp_path / "q").write_text(f"7;{bits}\n8;1,0\n")
    assert [(r.qid, r.qv) for r in readers.read_queries(spark, str(tmp_path / "q"), binary=True).collect()] == [(7, [(1 << 31) + 1])]
    assert [r.qv for r in readers.read_queries(spark, str(tmp_path / "q")).where("qid = 8").collect()] == [[1.0, 0.0]]
    (tmp_path / "integrate_3.dat").write_text("0 1.5,2\n")
    assert [tuple(r) for r in readers.read_codebook(spark, str(tmp_path / "integrate_3.dat")).collect()] == [(3, 0, [1.5, 2.0])]
    lines = spark.createDataFrame([("0 0.4,0.5,2",), ("1 1,2",)], "value string")
    assert [r.cv for r in readers.parsed_centroids(lines, dim=2, mips=True, binary=True).collect()] == [[0.0, 1.0, 1.0]]


def test_stream_appends_once(spark, tmp_path):
    import datetime

    from nearfield.streaming import segments

    now = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(1, now, [1.0]), (1, now, [2.0]), (2, now, [3.0])], "pk long, ts timestamp, v array<double>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pk long, ts timestamp, v array<double>").parquet(str(tmp_path / "in"))
    segments.append(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.pk for r in rows.collect()) == [1, 2]
    assert [r.pk for r in segments.live(rows, rows.where("pk = 1")).collect()] == [2]


def test_binary_sources(spark, tmp_path):
    from nearfield.sources import readers

    x = np.arange(6, dtype="<f4").reshape(2, 3)
    (tmp_path / "v").write_bytes(x.tobytes() + np.array([7, 8], "<i8").tobytes())
    assert [(r.key, r.vec) for r in readers.read_vecs(spark, str(tmp_path / "v"), 3).collect()] == [(7, [0, 1, 2]), (8, [3, 4, 5])]
    (tmp_path / "b").write_bytes(np.array([2, 3], "<u4").tobytes() + x.tobytes())
    assert [r.vec for r in readers.read_bin(spark, str(tmp_path / "b")).collect()][1] == [3, 4, 5]


def test_segments(spark, tmp_path):
    from nearfield.streaming import segments

    rows = spark.createDataFrame([(1, 5), (2, 6), (2, 7), (3, 8)], "pk long, x int")
    change = spark.createDataFrame([(1, 9)], "pk long, x int")
    assert sorted(map(tuple, segments.updated(rows, change).collect())) == [(1, 9), (2, 6), (2, 7), (3, 8)]
    done = segments.compact(rows, rows.where("pk = 3"), str(tmp_path / "c"))
    assert sorted(map(tuple, done.collect())) == [(1, 5), (2, 6)]
    change.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pk long, x int").parquet(str(tmp_path / "in"))
    segments.answered(stream, lambda q: q.selectExpr("pk", "x + 1 as y"), str(tmp_path / "out"), str(tmp_path / "k")).awaitTermination()
    assert [(r.pk, r.y) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 10)]
    segments.tombstones(stream, str(tmp_path / "t"), str(tmp_path / "k2")).awaitTermination()
    assert [r.pk for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [1]


def test_text_of_whole_vectors(spark):
    lines = catalog._text(catalog.T(spark, DIR)).limit(5).collect()
    assert all(len(r.value.split(";")[2].split(",")) == 64 for r in lines)


def test_probes_of_many_slots_are_one_entry(spark):
    from nearfield.operators import ivf
    from nearfield.operators.scan import Entry

    t = catalog.T(spark, DIR)
    rough, fine = catalog._levels(t)
    rows = ivf.postings(t.base, fine.select("label", "cv"))
    asked = ivf.two_stage_entries(t.queries, rough, fine, 2, 0.4, 3)
    assert len(asked) == len(t.asked)
    plain = [Entry(e.pool, e.vector, 3, int(s)) for e in asked for s in e.group.labels[np.unpackbits(e.group.bits, count=len(e.group.labels)).astype(bool)]]
    assert len(plain) > len(asked)
    assert sorted(map(tuple, ivf.search(asked, rows, 3).collect())) == sorted(map(tuple, ivf.search(plain, rows, 3).collect()))


def test_nearest_by_products_is_exact():
    from nearfield.functions import metrics
    from nearfield.operators import knn

    r = np.random.default_rng(3)
    x = r.normal(size=(600, 64))
    c = np.concatenate([r.normal(size=(2100, 64)), x[:50] + 1e-9, x[:100], x[:100]])
    for y, d in ((x, c), (x * 1e-6, c * 1e-6), (x + 1e3, c + 1e3), (x, c * np.nan)):
        at, low = knn.nearest(y, d)
        plain, far = knn.nearest(y, d, metrics.KERNELS["squared_euclidean"])
        assert at.tolist() == plain.tolist() and low.tolist() == far.tolist()


@pytest.mark.parametrize("name, groups", [("group_ivf_string_distinct", 3), ("group_ivf_string", 3), ("group_ivfpq_string", 3), ("recall_test_string", 1)])
def test_searches_state_one_entry_a_group(spark, monkeypatch, name, groups):
    from nearfield.operators import pq
    from nearfield.plans import engine

    seen = []

    def counted(rows, entries, *more, f=engine.scan, **named):
        seen.append(len(entries))
        return f(rows, entries, *more, **named)

    monkeypatch.setattr(engine, "scan", counted)
    monkeypatch.setattr(pq, "scan", counted)
    n = len(catalog.T(spark, DIR).asked)
    catalog.queries()[name](spark, DIR)
    assert seen[0] == n * groups


def test_slots_share_files(spark):
    from nearfield.plans import engine

    t = catalog.T(spark, DIR)
    path, schema = catalog._built(t, "GroupIvf")
    s = engine.Searcher(spark, path, schema)
    assert len(s.tables["postings"].inputFiles()) < sum(m.centroid_count for m in s.meta.values())
    for r in s.tables["postings"].select("group_", "slot", "bin").distinct().collect():
        assert engine.bin_of(r.slot, *s.bins[r.group_]) == r.bin
    assert "bin" in s.search(catalog._strings(t, "0:0#5")[:1])._jdf.queryExecution().toString().split("PartitionFilters")[1][:200]


def test_build_strings_are_parsed_once(spark):
    from pyspark.sql import functions as F

    from nearfield.sources import readers

    lines = spark.range(3).select(F.col("id").alias("vec_id"), F.concat(F.lit("0:0;1:2||0.5 "), F.col("id").cast("string")).alias("value"))
    rows = readers.parsed_builds(lines).where((F.size("v") == 2) & ~F.exists("v", lambda x: x.isNull()))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(") == 1 and plan.count("as double") == 1
    assert [(r.vec_id, [tuple(g) for g in r.groups], r.v) for r in rows.orderBy("vec_id").collect()] == [(i, [(0, 0), (1, 2)], [0.5, float(i)]) for i in range(3)]


def test_a_walk_fetches_in_one_job(spark, monkeypatch):
    from nearfield.operators import graph

    table = spark.createDataFrame([(i, [i, i + 1]) for i in range(40)], "vec_id long, nbrs array<long>").repartition(8, "vec_id").persist()
    rows = graph._Rows(table, "nbrs")
    assert {i: n.tolist() for i, n in rows(list(range(30))).items()} == {i: [i, i + 1] for i in range(30)}
    rows.table = None  # no more is fetched of what is known
    assert rows([3, 5])[5].tolist() == [5, 6]
    monkeypatch.setattr(graph, "KEPT", 4)
    few = graph._Rows(table, "nbrs")
    assert len(few(list(range(30)))) == 30 and len(few.known) == 4 and len(few([7, 99])) == 1
    table.unpersist()


def test_candidates_of_codes_are_not_broadcast(spark):
    from pyspark.sql import functions as F

    from nearfield.functions import metrics
    from nearfield.operators import pq
    from nearfield.operators.scan import Entry
    from nearfield.plans import engine

    t = catalog.T(spark, DIR)
    found = catalog.queries()["group_ivfpq_string"](spark, DIR)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # one pass over the postings' vectors, no candidates sent to them
    assert plan.count("MapInArrow") == 1
    # distances of the second vector are those of a scan of the rows themselves
    coded = pq.codes(t.base.withColumn("x", F.col("v")), t.book, "x")
    asked = [Entry(qid, np.array(v), 7) for qid, v, _ in t.asked]
    kernel = metrics.KERNELS["squared_euclidean"]
    got = pq.adc(coded, asked, t.book, also=("v", kernel)).collect()
    vectors = {r.vec_id: np.array(r.v)[None] for r in t.base.collect()}
    queries = {qid: np.array(v) for qid, v, _ in t.asked}
    assert got and all(r["also"] == kernel(queries[r.pool], vectors[r.vec_id])[0] for r in got)
    plain = pq.adc(coded, asked, t.book).collect()
    assert sorted((r.pool, r.vec_id, r.dist) for r in got) == sorted((r.pool, r.vec_id, r.dist) for r in plain)
    with pytest.raises(Exception, match="queries have 63 dimensions"):
        engine.scan(coded, [Entry(0, np.zeros(63), 1)], lambda q, x: x[:, 0].astype(float), lambda e: e, vec="codes", kind=np.int64, also=("v", kernel)).collect()
