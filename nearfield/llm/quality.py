"""Quality classification by co-training on two views of a document.

View one is the text: hashed words and measures of its form. View two is the page's
metadata: source, language and length. Each view has a logistic classifier. In each round
both classifiers score every document without a label, in the tasks; the ``EACH`` documents that
a classifier is surest of (by class, in the proportion of the labels), and at least ``SURE`` by its
calibration, become training data of the other, so that a weak view doesn't mislead a strong one. Scores are a table of ids; the surest are found by a distributed top-n, and only their
features come to the driver. At the end each view is calibrated on labelled documents that
it was not trained on (Platt scaling; in each round too), and their mean log-odds score all documents.

Bounds: at most ``LABELLED`` labelled documents, those with the smallest hashes of doc_id, take
part in training, a quarter of them for calibration alone. Fitting goes on until no component of
the gradient is above ``TOLERANCE``. Scoring covers every whole text.

Defined cases: null text counts as empty, null source or language as a value of its own; a
label that is null is none; of several labels of a doc_id the largest counts; of several rows of
a doc_id the one with the smallest hash of its columns trains, and all are scored; equal scores
go by doc_id; rows with a null doc_id are scored and never train; with labels of one class only,
or none, every score is that class's share (0.5 without labels); very long texts are worked on
whole; an empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm import textgrid as tg
from nearfield.llm.storage import map_arrow, written

LABELLED = 4000
ROUNDS, EACH, SURE = 3, 200, 0.9
PENALTY, TOLERANCE, STEPS = 1e-3, 1e-5, 20_000
BITS = 12
FORM = 10
META = 256


def text_features(rows: pa.RecordBatch):
    """(columns, values) of the text view of each row: hashed words by share, and measures of form."""
    data, o = tg.buffers(rows.column("text"))
    h, first = tg.words(data, o, tg.ALNUM)
    bucket = (h & tg.U((1 << BITS) - 1)).astype(np.int64)
    for k in range(len(o) - 1):
        b = data[o[k] : o[k + 1]]
        w = bucket[first[k] : first[k + 1]]
        n, words = max(1, len(b)), max(1, len(w))
        ids, many = np.unique(w, return_counts=True)
        kinds = np.bincount(b, minlength=256)
        lines = bytes(b).split(b"\n")
        form = [1, np.log1p(len(b)) / 10, len(w) / n * 5, kinds[65:91].sum() / n * 5, kinds[48:58].sum() / n * 5, kinds[33:48].sum() / n * 5, kinds[128:].sum() / n, len(ids) / words, 1 - len(set(lines)) / len(lines), kinds[[124, 91, 93, 123, 125, 60, 62]].sum() / n * 5]
        value = np.sqrt(many / words)
        yield np.append(ids, np.arange(FORM) + (1 << BITS)), np.append(value, form)


def meta_features(rows: pa.RecordBatch):
    import zlib

    for source, lang, n in zip(*(rows.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True):
        keys = [f"s{source}", f"l{lang}", f"b{int(np.log2(max(n or 0, 0) + 1))}"]
        cols = [1 + zlib.crc32(k.encode()) % (META - 1) for k in keys]
        yield np.array([0, *cols]), np.ones(4)


VIEWS = {"text": (text_features, (1 << BITS) + FORM), "meta": (meta_features, META)}
COLUMNS = ["doc_id", "text", "source", "lang", "n_chars"]


class Rows:
    """Sparse rows: columns and values, one row after the other. No row is empty."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], size: int):
        self.many = np.array([len(c) for c, _ in rows], np.int64)
        self.starts = np.cumsum(self.many) - self.many
        self.cols = np.concatenate([np.zeros(0, np.int32), *(c for c, _ in rows)]).astype(np.int32)
        self.vals = np.concatenate([np.zeros(0, np.float32), *(v for _, v in rows)]).astype(np.float64)
        self.size = size

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.vals * w[self.cols], self.starts)

    def weighted(self, r: np.ndarray) -> np.ndarray:
        """Sum of the rows, each times its weight."""
        return np.bincount(self.cols, self.vals * np.repeat(r, self.many), self.size)

    def squares(self) -> np.ndarray:
        return np.add.reduceat(self.vals * self.vals, self.starts)


class Logistic:
    """Logistic regression with an L2 penalty, both classes with half the weight, by accelerated gradient
    steps until the gradient is under ``TOLERANCE``."""

    def __init__(self, size: int):
        self.w = np.zeros(size)
        self.a, self.b = 1.0, 0.0

    def fit(self, x: Rows, y: np.ndarray) -> Logistic:
        share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
        rate = 1 / (float(share @ x.squares()) / 4 + PENALTY)
        w, last, t = self.w.copy(), self.w, 1.0
        for _ in range(STEPS):
            g = x.weighted(share * (1 / (1 + np.exp(-np.clip(x.dot(w), -500, 500))) - y)) + PENALTY * w
            new = w - rate * g
            if np.abs(g).max() < TOLERANCE:
                last = w
                break
            if g @ (new - last) > 0:  # the momentum leads uphill: begin it anew
                t = 1.0
            nt = float((1 + np.sqrt(1 + 4 * t * t)) / 2)
            w, last, t = new + (t - 1) / nt * (new - last), new, nt
        self.w = last
        return self

    def calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling of raw scores, with the usual shrunken targets."""
        hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
        target, a, b = np.where(y > 0, hi, lo), 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            r, v = p - target, np.maximum(p * (1 - p), 1e-6)
            m = np.array([[(v * z * z).sum() + 1e-6, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
            da, db = np.linalg.solve(m, [(r * z).sum(), r.sum()])
            a, b = a - da, b - db
        self.a, self.b = max(a, 1e-3), b

    def log_odds(self, z: np.ndarray) -> np.ndarray:
        return np.clip(self.a * z + self.b, -20, 20)


ROW = "row"


def _known_row() -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(*COLUMNS[1:])


def features_of(docs: DataFrame, ids: DataFrame) -> list:
    """(doc_id, y, tc, tv, mc, mv) of the documents in ``ids`` (doc_id, y: a bounded table), one row of each, on the driver."""
    ids = ids.select(F.col("doc_id").alias("id"), "y")
    rows = docs.select(*COLUMNS, _known_row().alias(ROW))
    one = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).groupBy("id", "y").agg(F.min(ROW).alias("least"))
    chosen = rows.join(F.broadcast(one), (F.col("doc_id") == F.col("id")) & (F.col(ROW) == F.col("least"))).select(*COLUMNS, "y")

    def run(batches):
        for batch in batches:
            for rows in tg.blocks(batch, "text", 4 << 20):
                out = []
                for (tc, tv), (mc, mv) in zip(text_features(rows), meta_features(rows), strict=True):
                    out.append((tc.astype("<i4").tobytes(), tv.astype("<f4").tobytes(), mc.astype("<i4").tobytes(), mv.astype("<f4").tobytes()))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("y").cast(pa.int32()), *(pa.array(x, pa.binary()) for x in zip(*out, strict=True))], names=["doc_id", "y", "tc", "tv", "mc", "mv"])

    got = map_arrow(chosen, run, "doc_id long, y int, tc binary, tv binary, mc binary, mv binary").dropDuplicates(["doc_id"]).toLocalIterator()
    return sorted(got, key=lambda r: r.doc_id)


def _vectors(rows: list, view: str) -> list:
    c, v = {"text": ("tc", "tv"), "meta": ("mc", "mv")}[view]
    return [(np.frombuffer(r[c], "<i4"), np.frombuffer(r[v], "<f4")) for r in rows]


def raw_scores(docs: DataFrame, models: dict[str, Logistic]) -> DataFrame:
    """doc_id, row and each view's raw score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast({v: m.w for v, m in models.items()})

    def run(batches):
        w = sent.value
        for batch in batches:
            for rows in tg.blocks(batch, "text", 4 << 20):
                z = [pa.array([float(w[v][c] @ x) for c, x in f(rows)], pa.float64()) for v, (f, _) in VIEWS.items()]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), rows.column(ROW), *z], names=["doc_id", ROW, *VIEWS])

    return map_arrow(docs.select(*COLUMNS, _known_row().alias(ROW)), run, f"doc_id long, {ROW} long, " + ", ".join(f"{v} double" for v in VIEWS))


def surest(free: DataFrame, view: str, model: Logistic, good: int, bad: int) -> list[tuple[int, int]]:
    """(doc_id, label): up to ``good`` with the highest scores, ``bad`` with the lowest, of those that are sure."""
    z, sure = F.col(view), float(np.log(SURE / (1 - SURE)))
    high = free.where(z >= (sure - model.b) / model.a).orderBy(z.desc(), "doc_id").limit(good).select("doc_id").collect()
    low = free.where(z <= (-sure - model.b) / model.a).orderBy(z, "doc_id").limit(bad).select("doc_id").collect()
    return [(r.doc_id, 1) for r in high] + [(r.doc_id, 0) for r in low]


def auc(z: np.ndarray, y: np.ndarray) -> float:
    """The share of (good, bad) pairs in the right order, ties by half."""
    order = np.sort(z[y == 0])
    good = z[y == 1]
    below, upto = np.searchsorted(order, good, "left"), np.searchsorted(order, good, "right")
    return float((below + upto).mean() / 2 / max(1, len(order))) if len(good) and len(order) else float("nan")


class CoTrained(dict):
    """The classifiers by view; ``held_out`` has each view's quality (AUC) on the calibration rows after every round."""

    held_out: list[dict[str, float]]


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, each: int = EACH):
    """The calibrated classifiers, or the share of good labels where there aren't two classes."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    there = docs.select("doc_id").where("doc_id is not null").distinct()
    rows = features_of(docs, known.join(there, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    y = np.array([r.y for r in rows], int)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    fold = tg.mix(np.array([r.doc_id for r in rows], np.int64).view(np.uint64)) % tg.U(4) == 0
    if len(set(y[~fold])) < 2:
        fold[:] = False
    held = {v: [(r, r.y) for r, f in zip(rows, fold, strict=True) if not f] for v in VIEWS}
    calibration = [r for r, f in zip(rows, fold, strict=True) if f]
    share = y[~fold].mean()
    high, low = round(each * share), round(each * (1 - share))
    models, given = CoTrained({v: Logistic(size) for v, (_, size) in VIEWS.items()}), {v: set() for v in VIEWS}
    models.held_out = []
    for k in range(rounds + 1):
        for v, (_, size) in VIEWS.items():
            models[v].fit(Rows(_vectors([r for r, _ in held[v]], v), size), np.array([t for _, t in held[v]], float))
        raw = {v: Rows(_vectors(calibration, v), size).dot(models[v].w) if calibration else np.zeros(0) for v, (_, size) in VIEWS.items()}
        models.held_out.append({v: auc(z, y[fold]) for v, z in raw.items()})
        for v, z in raw.items():
            if len(set(y[fold])) == 2:
                models[v].calibrate(z, y[fold].astype(float))
        if k == rounds:
            break
        scores = written(raw_scores(docs, models), "scores").where("doc_id is not null")
        free = scores.join(known.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.min(F.struct(ROW, *VIEWS)).alias("s")).select("doc_id", "s.*")
        free = written(free, "free")
        chosen = {v: surest(free, v, models[v], high, low) for v in VIEWS}
        ids = sorted({i for c in chosen.values() for i, _ in c})
        found = {r.doc_id: r for r in features_of(docs, spark.createDataFrame([(i, -1) for i in ids], "doc_id long, y int"))}
        for v in VIEWS:
            for other in VIEWS:
                if other != v:
                    fresh = [(i, t) for i, t in chosen[v] if i not in given[other]]
                    held[other] += [(found[i], t) for i, t in fresh]
                    given[other].update(i for i, _ in fresh)
    return models


def scored(docs: DataFrame, model) -> DataFrame:
    """doc_id, quality (0 to 1), each view's own, and whether the document is kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            for rows in tg.blocks(batch, "text", 4 << 20):
                n = rows.num_rows
                if isinstance(m, float):
                    odds = [np.full(n, np.log((m + 1e-6) / (1 - m + 1e-6)))] * 2
                else:
                    odds = [m[v].log_odds(np.array([float(m[v].w[c] @ x) for c, x in f(rows)])) for v, (f, _) in VIEWS.items()]
                p = [1 / (1 + np.exp(-z)) for z in (odds[0], odds[1], (odds[0] + odds[1]) / 2)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), *map(pa.array, (p[2], p[0], p[1])), pa.array(p[2] >= 0.5)], names=["doc_id", "quality", "text_quality", "meta_quality", "keep"])

    return map_arrow(docs.select(COLUMNS), run, "doc_id long, quality double, text_quality double, meta_quality double, keep boolean")


def op7(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, learn(docs, labels))


ORACLE_SQL = None
