"""Builder, searcher and merger of indexes, driven by strings: build strings make rows by slot, query
strings become the entries of one scan, on the plan that ``spec.plan`` names.

An index is a folder of tables: ``postings`` (partitioned by bin, a run of slots with about ``BIN_ROWS`` rows
together or one larger slot, and sorted by slot: vec_id, pk, created, level, id, group_, slot, score, v and,
for product-quantised kinds, codes), ``centroids`` (group_, label =
slot, cv; the slots of a group follow those of the groups before it), ``meta`` (level, id,
group_, doc_count, centroid_count, first_slot, first_id) and ``codebook``. Probe and assignment
use the squared Euclidean distance whatever the metric of the scores.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions import encode
from nearfield.operators import graph, ivf, merge, pq, topk, train
from nearfield.operators.knn import centroid_sets, nearest_label
from nearfield.operators.scan import LISTED, Chosen, Entry, scan
from nearfield.plans import query, spec
from nearfield.sources import readers

NAMES: dict[str, Callable] = {}  # plug-ins by name: reformers, metrics, trainers
TABLES = ("postings", "centroids", "meta", "codebook")
BIN_ROWS = 20_000  # rows that the slots of a bin have together, if rows are dealt evenly
AGES = 64  # age buckets a query may have


def register(name: str):
    """Make a class or function known by name."""

    def add(thing):
        if name in NAMES:
            raise ValueError(f"{name} is registered already")
        NAMES[name] = thing
        return thing

    return add


def bins(meta: list) -> dict:
    """{group: (rows of the groups before, rows, slots, first slot)}, from which a slot's bin follows."""
    out, before = {}, 0
    for m in sorted(meta, key=lambda m: m.first_slot):
        out[m.group_] = (before, m.doc_count, m.centroid_count, m.first_slot)
        before += m.doc_count
    return out


def bin_of(slots, before, rows, count, first):
    """A slot's bin: of numbers, arrays, or Columns."""
    if isinstance(slots, Column):
        return F.call_function("div", before + F.call_function("div", (slots - first) * rows, count), F.lit(BIN_ROWS))
    return (before + (slots - first) * rows // count) // BIN_ROWS


class Reformer:
    """Changes vectors before they are indexed, and queries before they search. The plain one changes nothing."""

    def document(self, v: Column) -> Column:
        return v

    def query(self, v: list[float]) -> list[float]:
        return v


@register("mips")
class Mips(Reformer):
    """Inner products as distances: documents scaled under norm u with m terms, queries padded with zeros."""

    def __init__(self, longest: float, m: int = 3, u: float = 0.38):
        self.longest, self.m, self.u = longest, m, u

    def document(self, v):
        return encode.mips_document(v, F.lit(self.longest), self.m, self.u)

    def query(self, v):
        return [*v, *[0.0] * self.m]


@dataclass
class Schema:
    kind: str = "GroupIvf"
    vectors: spec.VectorSpec = field(default_factory=lambda: spec.VectorSpec(64))
    ratio: float = 0.01
    real_time_ratio: float | None = None
    threshold: int = 0
    fragments: int = 16
    pq_scan_num: int = 100
    residual: bool = False
    reformer: Reformer = field(default_factory=Reformer)

    @property
    def coded(self) -> bool:
        return spec.index_kind(self.kind) in ("IvfPQ", "PQFlat", "GroupIvfPq", "IvfRpq", "IvfFastScan")


class Builder:
    """Rows of an index from build strings. ``centroids``: (level, id, label, cv); a group without any has one, its first vector."""

    def __init__(self, schema: Schema, centroids: DataFrame | None = None, codebook: DataFrame | None = None):
        self.schema, self.centroids, self.codebook = schema, centroids, codebook

    def _centroids(self, rows: DataFrame, meta: list) -> dict:
        """{group: (labels from 0, matrix)}"""
        given = self.centroids
        sets = centroid_sets(given.withColumn("group_", ivf.group_key(F.col("level"), F.col("id"))), "group_") if given is not None else {}
        missing = [m.group_ for m in meta if m.group_ not in sets]
        if missing:
            first = rows.where(F.col("group_").isin(missing)).groupBy("group_").agg(F.min(F.struct("vec_id", "v")).alias("m"))
            sets |= {r.group_: (np.zeros(1, np.int64), np.array([list(r.m.v)])) for r in first.collect()}
        return {m.group_: sets[m.group_] for m in meta}

    def build(self, records: DataFrame, path: str) -> None:
        """Write the index of ``records`` (vec_id, pk, value: a build string; created: seconds, where there is one). Records
        whose string has no vector of the schema's dimension are left out."""
        s, spark = self.schema, records.sparkSession
        records = records if "created" in records.columns else records.withColumn("created", F.lit(None).cast("long"))
        parsed = readers.parsed_builds(records.select("vec_id", "pk", "created", "value")).where((F.size("v") == s.vectors.dimension) & ~F.exists("v", lambda x: x.isNull()))
        parsed = parsed.withColumn("v", s.reformer.document(F.col("v"))).withColumn("score", encode.rank_score(F.col("groups"), 1))
        rows = ivf.group_entries(parsed, F.col("groups")).drop("groups").withColumn("group_", ivf.group_key(F.col("level"), F.col("id")))
        meta = sorted(rows.groupBy("level", "id", "group_").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id")).collect())
        sets, first, described = self._centroids(rows, meta), 0, []
        slots = {}
        for m in meta:
            labels, c = sets[m.group_]
            slots[m.group_] = (np.arange(first, first + len(labels)), c)
            described.append((m.level, m.id, m.group_, m.n, len(labels), first, m.first_id))
            first += len(labels)
        centroids = train.table_of(spark, slots, "group_")
        out = nearest_label(rows, slots, group="group_").drop("dist")
        if s.coded:
            if self.codebook is None:
                raise ValueError(f"{s.kind} needs a codebook")
            centres = pq.book(self.codebook, s.fragments)
            by_slot = {int(x): v for labels, c in slots.values() for x, v in zip(labels, c, strict=True)} if s.residual else None
            out = pq.codes(out.withColumn("x", F.col("v")), centres, "x", by_slot)
        described = spark.createDataFrame(described, "level long, id long, group_ long, doc_count long, centroid_count long, first_slot long, first_id long")
        places = bins(described.collect())
        places = spark.createDataFrame([(g, *p) for g, p in places.items()], "group_ long, before_ long, rows_ long, count_ long, first_ long")
        out = out.join(F.broadcast(places), "group_").withColumn("bin", bin_of(F.col("slot"), F.col("before_"), F.col("rows_"), F.col("count_"), F.col("first_"))).drop("before_", "rows_", "count_", "first_")
        tables = {"postings": out, "centroids": centroids, "meta": described}
        if self.codebook is not None:
            tables["codebook"] = self.codebook
        readers.save_index(tables, path, by={"postings": ("bin", "slot")})


class Searcher:
    """Searches a saved index, with real-time segments (rows like its postings) and deleted keys."""

    def __init__(self, spark: SparkSession, path: str, schema: Schema, real_time: list[DataFrame] = (), deleted: DataFrame | None = None):
        self.spark, self.schema = spark, schema
        self.tables = readers.load_index(spark, path, [t for t in TABLES if t != "codebook" or schema.coded])
        self.sets = centroid_sets(self.tables["centroids"], "group_")
        self.meta = {r.group_: r for r in self.tables["meta"].toLocalIterator()}
        self.bins, self.labels = bins(list(self.meta.values())), {}
        self.real_time, self.deleted = list(real_time), deleted

    def rows(self) -> DataFrame:
        """Postings; rows of real-time segments have no bin."""
        out = self.tables["postings"]
        own = [c for c in out.columns if c != "bin"]
        for segment in self.real_time:
            out = out.unionByName(segment.select(*own, F.lit(None).cast("int").alias("bin")))
        return out if self.deleted is None else out.join(self.deleted.select("pk").distinct(), "pk", "left_anti")

    def probes(self, q: list[float], group: int, ratio: float) -> np.ndarray:
        """Places among a group's slots to look at, in their order."""
        labels, c = self.sets.get(group, ((), ()))
        n = ivf.probe_count(ratio, len(labels))
        return np.arange(len(labels)) if n >= len(labels) else np.sort(ivf.nearest_places(ivf.L2(np.asarray(q, float), c), labels, n))

    def within(self, places: np.ndarray, group: int, lengths: dict[int, int], limit: int) -> np.ndarray:
        """The first of ``places`` whose slots' postings together stay under ``limit``."""
        labels, _ = self.sets.get(group, ((), ()))
        return places[: int((np.cumsum([lengths.get(int(labels[p]), 0) for p in places]) < limit).sum())]

    def chosen(self, group: int, places: np.ndarray, place: int = 0) -> Chosen:
        """Those slots of a group, in the bucket ``place``."""
        if (group, place) not in self.labels:
            self.labels[group, place] = self.sets[group][0] * AGES + place
        return Chosen.of(self.labels[group, place], places)

    def binned(self, probed: dict[int, np.ndarray]) -> Column:
        """Whether a row may be in the slots at ``probed`` places of groups, given as packed bits, by what prunes files: bin and slot."""
        found = {g: self.sets[g][0][np.unpackbits(bits, count=len(self.sets[g][0])).astype(bool)] for g, bits in probed.items()}
        wanted = sorted({b for g, slots in found.items() for b in np.unique(bin_of(slots, *self.bins[g])).tolist()})
        slots = sorted({x for s in found.values() for x in s.tolist()})
        kept = F.col("bin").isin(wanted) | F.col("bin").isNull() if len(wanted) <= LISTED else F.lit(True)
        return kept & F.col("slot").isin(slots) if len(slots) <= LISTED else kept

    def search(self, strings: list[str], reject: Column | None = None, keys: DataFrame | None = None, docids: DataFrame | None = None, recall_test: bool = False, now: int | None = None, visit_limit: int = 0, distinct: bool = False, metric: str | None = None) -> DataFrame:
        """(qid, pool_id, vec_id, pk, dist, rk). ``keys`` (pk) and ``docids`` (vec_id) feed the rows to look at, ``reject`` takes
        rows out; feeders come before filters. ``distinct``: a row that several groups of a query find counts once, with
        its smallest distance."""
        s = self.schema
        asked = [query.parse_search(text, s.vectors.type == "binary") for text in strings]
        rows = self.rows()
        if keys is not None:
            rows = rows.join(keys.select("pk").distinct(), "pk", "left_semi")
        elif docids is not None:
            rows = rows.join(docids.select("vec_id").distinct(), "vec_id", "left_semi")
        elif reject is not None:
            rows = rows.where(~reject)
        ratios = [float(q.params["coarse_scan_ratio"]) if "coarse_scan_ratio" in q.params else None for q in asked]
        ages = any(q.ages for q in asked)
        if ages and (now is None or len({tuple(a for a, _ in q.ages) for q in asked if q.ages}) > 1 or not all(q.ages for q in asked)):
            raise ValueError("age quotas need now, and the same ages in all queries of a call")
        whole = sum(m.doc_count for m in self.meta.values())
        plan = spec.plan(s.kind, rows=whole, threshold=s.threshold, recall_test=recall_test, coarse_ratio=min((s.ratio if r is None else r for r in ratios), default=0), feeder=keys, doc_feeder=docids, reject=reject)
        pools, entries, probed, wanted = [], [], {}, query.rows(asked)
        lengths = {r.slot: r["count"] for r in rows.groupBy("slot").count().toLocalIterator()} if visit_limit and self.real_time and not recall_test else None
        for qid, v, level, i, pool_id, k in wanted:
            group, v = ivf.group_key(int(level), int(i)), np.array(s.reformer.query(list(v)), float)
            ratio = 1.0 if plan in ("exact", "graph") else ivf.probe_ratio(s.ratio, ratios[qid], s.real_time_ratio, bool(self.real_time), ages)
            places = self.probes(v, group, ratio)
            if lengths is not None:
                places = self.within(places, group, lengths, visit_limit)
            if len(places):
                bits = self.chosen(group, places).bits
                probed[group] = probed[group] | bits if group in probed else bits
            parts = [(j, b, kk) for j, (b, kk) in enumerate(asked[qid].ages)] if ages else [(pool_id, None, k)]
            for place, _, kk in parts:
                pools.append((qid, place, kk, group, v))
                if len(places):
                    entries.append(Entry(len(pools) - 1, v, kk, self.chosen(group, places, place if ages else 0)))
        bucket = topk.age_bucket(F.lit(now) - F.col("created"), [a for a, _ in next(q.ages for q in asked if q.ages)]) if ages else F.lit(0)
        found = self._graph(rows, pools) if plan == "graph" else self._scan(rows.where(bucket.isNotNull() & self.binned(probed)), entries, pools, plan, F.col("slot") * AGES + bucket, metric)
        out = ivf.labelled(self.spark, found, [p[:3] for p in pools])
        if distinct:
            out = topk.dedupe(out, ["qid"]).withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "vec_id")))
        pks = rows.select("vec_id", "pk").distinct()
        return out.join(pks, "vec_id").select("qid", "pool_id", "vec_id", "pk", "dist", "rk")

    def _scan(self, rows, entries, pools, plan, group, metric):
        s = self.schema
        kernel = s.vectors.kernel() if metric is None else spec.metrics.KERNELS[metric]
        if plan != "pq":
            return scan(rows, entries, kernel, group=group, distinct=True, check=False)
        centres = pq.book(self.tables["codebook"], s.fragments)
        wide = [Entry(e.pool, e.vector, max(e.k, s.pq_scan_num), e.group) for e in entries]
        centroids = {slot * AGES: v for labels, c in self.sets.values() for slot, v in zip(labels.tolist(), c, strict=True)} if s.residual else None
        mode = "residual" if s.residual else "fast" if s.kind == "IvfFastScan" else "plain"
        # the rows have their vectors beside the codes: tasks take the exact distances of what they keep, so that candidates
        # neither come to the driver nor are met with the vectors again
        near = pq.adc(rows, wide, centres, mode, centroids, group, distinct=True, also=("v", kernel))
        near = topk.top_k(near, s.pq_scan_num, ["pool"])
        return near.groupBy("pool", "vec_id").agg(F.min("also").alias("dist"))

    def _graph(self, rows, pools):
        """A graph for each group that the queries ask for, built from its rows; groups up to the threshold are scanned."""
        out = None
        for g in sorted({p[3] for p in pools}):
            own = [(n, p) for n, p in enumerate(pools) if p[3] == g]
            part = rows.where(F.col("group_") == g).select("vec_id", "v")
            if g not in self.meta:
                continue
            if self.meta[g].doc_count <= self.schema.threshold:
                found = scan(part, [Entry(n, p[4], p[2]) for n, p in own], self.schema.vectors.kernel())
            else:
                base = graph.sharded(part)
                asked = self.spark.createDataFrame([(n, p[4].tolist()) for n, p in own], "qid long, qv array<double>")
                edges = graph.build(base, "hnsw" if self.schema.kind == "GroupHnsw" else "vamana")
                found = graph.search(base, edges, asked, max(p[2] for _, p in own)).select(F.col("qid").alias("pool"), "vec_id", "dist")
            out = found if out is None else out.union(found)
        return out if out is not None else self.spark.createDataFrame([], "pool long, vec_id long, dist double")


class Merger:
    """One index of several of the same schema: rows under new ids (part, doc_id, new_id), labelled and coded anew."""

    def __init__(self, schema: Schema, centroids: DataFrame | None = None, codebook: DataFrame | None = None):
        self.builder = Builder(schema, centroids, codebook)

    def merge(self, spark: SparkSession, paths: list[str], id_map: DataFrame, path: str) -> None:
        parts = []
        for p in paths:
            rows = spark.read.parquet(f"{p}/postings")
            groups = F.array_sort(F.collect_set(F.struct("level", "id")))
            parts.append(rows.groupBy("vec_id").agg(F.first("pk").alias("pk"), F.first("created").alias("created"), groups.alias("groups"), F.first("v").alias("v")).withColumnRenamed("vec_id", "doc_id"))
        rows = merge.by_docid(parts, id_map)
        text = F.concat_ws("||", F.array_join(F.transform("groups", lambda g: F.concat_ws(":", g["level"].cast("string"), g["id"].cast("string"))), ";"), F.array_join(F.transform("v", lambda x: x.cast("string")), " "))
        plain = self.builder.schema
        self.builder.schema = Schema(**{**plain.__dict__, "reformer": Reformer()})  # vectors are transformed already
        try:
            self.builder.build(rows.select(F.col("doc_id").alias("vec_id"), "pk", "created", text.alias("value")), path)
        finally:
            self.builder.schema = plain


def train_group_centroids(rows: DataFrame, per: int = 1000, most: int = 10_000, rounds: int = 10) -> DataFrame:
    """(level, id, label, cv) for rows (vec_id, level, id, v): one centroid for every ``per`` rows of a group, one at least,
    started from ``most`` sampled vectors a group; all groups in the same passes."""
    keyed = rows.select("vec_id", "v", ivf.group_key(F.col("level"), F.col("id")).alias("group_"))
    sizes = {r.group_: r["count"] for r in keyed.groupBy("group_").count().toLocalIterator()}
    drawn: dict[int, list] = {}
    for r in train.sample(keyed, most, group="group_").orderBy("group_", "vec_id").toLocalIterator():
        drawn.setdefault(r.group_, []).append([float(x) for x in r.v])
    sets = {}
    for g, own in drawn.items():
        x = np.array(own)
        at = train.spread(x, max(1, sizes[g] // per))
        sets[g] = (np.arange(len(at)), x[at])
    found = train.table_of(rows.sparkSession, train.lloyd(keyed, sets, rounds, 1e-6, group="group_"), "group_")
    return found.select(F.shiftright("group_", 32).alias("level"), F.col("group_").bitwiseAND((1 << 32) - 1).alias("id"), "label", "cv")


def observed(found: DataFrame, name: str = "search"):
    """(rows, observation): after an action, ``observation.get`` has the numbers of rows and the largest distance."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return found.observe(seen, F.count(F.lit(1)).alias("rows"), F.max("dist").alias("farthest")), seen
