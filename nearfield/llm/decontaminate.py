"""Benchmark decontamination by a distributed positional inverted index.

The index is split by documents: every segment (about ``SEGMENT`` bytes of whole texts) is
one row that holds the posting lists of all its words, so building needs no shuffle, a hot term
or source is spread over all segments, a lost task rebuilds only its own, and one index serves
any benchmark. A query looks for windows of consecutive test words: from the window's rarest term
in the segment it takes the posting list, moved back by the term's offset, and intersects it with
the moved lists of the other terms, the next rarest first.

A phrase match has all words of a window at their places. A proximity match has a place s in the
document such that the window's word number i is within ``slop`` words of s + i, for every i.

Terms are 64-bit hashes of lower-cased words; posting lists are differences of 32 bits in byte
planes, which compress well. The tests are searched in blocks of ``block_bytes`` of text, each a
broadcast of its windows; every further block is another pass over the same index.

Defined cases: null text and empty text have no words; a null item_id or an item without
words is ignored; an item of fewer words than a window is one window; items that share an id
count once; rows that share a doc_id stay separate rows; a null doc_id is kept; a text longer
than a segment is one segment; empty tables give no hits. Further columns of either table,
whatever their names, are ignored (``decontaminated`` keeps those of the documents).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm import textgrid as tg
from nearfield.llm.storage import map_arrow, scratch, spare

SEGMENT = 4 << 20
BLOCK = 4 << 20
GAP = 1024  # positions between two documents: no window reaches across
SLOP = 2
AT_ONCE = 2_000_000  # places that are intersected at once

INDEX = "segment long, doc_ids binary, firsts binary, counts binary, terms binary, sizes binary, places binary"
FOUND = "segment long, doc_no int, doc_id long, n_words long, spans array<int>, items array<string>, near_items array<string>"
NO_ID = np.iinfo(np.int64).min


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(NO_ID))


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers under 2**32, plane by plane of their bytes."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for each size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def positional_index(docs: DataFrame, segment_bytes: int = SEGMENT) -> DataFrame:
    """One row per segment: its documents (id, first position, words) and, for each term, a sorted list of positions."""

    def build(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in tg.blocks(batch, "text", segment_bytes):
                h, first = tg.words(*tg.buffers(rows.column("text")), tg.ALNUM)
                counts = np.diff(first)
                at = np.arange(len(h), dtype=np.int64) + np.repeat(np.arange(len(counts), dtype=np.int64) * GAP, counts)
                order = np.argsort(h, kind="stable")
                h, at = h[order], at[order]
                new = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
                steps = np.diff(at, prepend=0)
                steps[new] = at[new]
                values = (_ids(rows.column("doc_id")).tobytes(), _packed(first[:-1] + np.arange(len(counts)) * GAP), _packed(counts), h[new].tobytes(), _packed(np.diff(np.append(new, len(h)))), _packed(steps))
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | k], pa.int64()), *(pa.array([x], pa.binary()) for x in values)], names=[f.split()[0] for f in INDEX.split(", ")])
                k += 1

    return map_arrow(docs.select("doc_id", "text"), build, INDEX)


def saved_index(docs: DataFrame) -> DataFrame:
    """The index as a table in the shared folder."""
    path = scratch(docs.sparkSession, "postings")
    positional_index(docs).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


class Windows:
    """The distinct windows of test items, as flat arrays, and the items that have each."""

    def __init__(self, items: list[tuple[str, str]], size: int, short: bool = True):
        self.names = [i for i, _ in items]
        h, first = tg.word_hashes([t or "" for _, t in items], tg.ALNUM)
        words = np.diff(first)
        many = np.where(words >= size, words - size + 1, (words > 0) & short).astype(np.int64)
        owner = np.repeat(np.arange(len(items)), many)
        start = first[owner] + _ramp(many)
        length = np.minimum(words[owner], size)
        full = tg.windows(h, size)
        same = np.array([full[a] if n == size else tg.U(tg.runs(h[a : a + n])) for a, n in zip(start.tolist(), length.tolist(), strict=True)], np.uint64)
        _, one, of = np.unique(same, return_index=True, return_inverse=True)
        self.length = length[one]
        self.first = np.append(0, np.cumsum(self.length))
        self.terms = h[np.repeat(start[one], self.length) + _ramp(self.length)]
        own = np.unique(np.stack([of.reshape(-1), owner]), axis=1) if len(of) else np.zeros((2, 0), np.int64)
        self.owner, self.owners = own[1], np.searchsorted(own[0], np.arange(len(one) + 1))
        self.vocabulary, self.term_of = np.unique(self.terms, return_inverse=True)


class Segment:
    """A row of the index, with the posting lists of some terms."""

    def __init__(self, row: dict, vocabulary: np.ndarray):
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.firsts, self.counts = _unpacked(row["firsts"]), _unpacked(row["counts"])
        terms, sizes = np.frombuffer(row["terms"], np.uint64), _unpacked(row["sizes"])
        starts = np.append(0, np.cumsum(sizes))
        slot = np.minimum(np.searchsorted(terms, vocabulary), max(len(terms) - 1, 0))
        there = terms[slot] == vocabulary if len(terms) else np.zeros(len(vocabulary), bool)
        self.many = np.where(there, sizes[slot] if len(terms) else 0, 0)
        self.starts = np.append(0, np.cumsum(self.many))
        take = np.repeat(starts[slot], self.many) + _ramp(self.many)
        total = np.cumsum(_unpacked(row["places"]))
        before = np.append(0, total)[starts[slot]]  # differences begin anew with each term
        self.places = total[take] - np.repeat(before, self.many)
        self.key = np.repeat(np.arange(len(vocabulary), dtype=np.int64) << 40, self.many) | self.places


def _match(q: Windows, seg: Segment, slop: int):
    """(window, place of the start, place of its rarest term) of every match in one segment, in parts."""
    if not len(q.length):
        return
    df = seg.many[q.term_of]
    live = np.flatnonzero(np.minimum.reduceat(df, q.first[:-1]) > 0)
    if not len(live):
        return
    # for every live window, its terms from the rarest on
    n = q.length[live]
    flat = np.repeat(q.first[live], n) + _ramp(n)
    order = flat[np.lexsort((flat, df[flat], np.repeat(np.arange(len(live)), n)))]
    lead = np.append(0, np.cumsum(n))
    work = np.cumsum(df[order[lead[:-1]]]) * (2 * slop + 1)
    cuts = np.unique(np.searchsorted(work, np.arange(0, work[-1] if len(work) else 0, AT_ONCE), "left"))
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(live)], strict=True):
        own = np.arange(lo, hi)
        rare = order[lead[own]]
        size = df[rare]
        term = q.term_of[rare]
        w = np.repeat(own, size)
        seen = seg.places[np.repeat(seg.starts[term], size) + _ramp(size)]
        at = seen - np.repeat(rare - q.first[live[own]], size)
        if slop:
            at = (at[:, None] + np.arange(-slop, slop + 1)).ravel()
            w, seen = np.repeat(w, 2 * slop + 1), np.repeat(seen, 2 * slop + 1)
        for r in range(1, int(n[own].max(initial=0))):
            more = n[w] > r
            term = order[np.minimum(lead[w] + r, lead[w + 1] - 1)]
            place = at + (term - q.first[live[w]])
            base = q.term_of[term].astype(np.int64) << 40
            k = np.minimum(np.searchsorted(seg.key, base + np.maximum(place - slop, 0)), len(seg.key) - 1)
            ok = ~more | ((seg.key[k] >= base) & (seg.key[k] <= base + place + slop) & (place + slop >= 0))
            w, at, seen = w[ok], at[ok], seen[ok]
            if not len(w):
                break
        yield live[w], at, seen


def search(index: DataFrame, items: list[tuple[str, str]], size: int = 10, slop: int = SLOP, all_docs: bool = True, short: bool = True) -> DataFrame:
    """Per document: its words, spans of word numbers that lie in phrase matches, the items with phrase
    matches, and the items with proximity matches (phrase matches too)."""
    sent = index.sparkSession.sparkContext.broadcast(Windows(items, size, short))

    def run(batches):
        q = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row, q.vocabulary)
                found: dict[int, tuple] = {}
                for near in (False, True) if slop else (False,):
                    for w, at, seen in _match(q, seg, slop if near else 0):
                        doc = np.searchsorted(seg.firsts, seen, "right") - 1
                        both = np.unique(np.stack([doc, w]), axis=1)
                        for d, x in both.T.tolist():
                            spans, exact, loose = found.setdefault(d, ([], set(), set()))
                            own = q.owner[q.owners[x] : q.owners[x + 1]].tolist()
                            loose.update(own)
                            if not near:
                                exact.update(own)
                        if not near:
                            for d, s, x in zip(doc.tolist(), (at - seg.firsts[doc]).tolist(), w.tolist(), strict=True):
                                found[d][0].append((s, s + int(q.length[x])))
                docs = range(len(seg.ids)) if all_docs else sorted(found)
                got = [found.get(d, ([], (), ())) for d in docs]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["segment"]] * len(got), pa.int64()),
                        pa.array(list(docs), pa.int32()),
                        pa.array([None if seg.ids[d] == NO_ID else int(seg.ids[d]) for d in docs], pa.int64()),
                        pa.array([int(seg.counts[d]) for d in docs], pa.int64()),
                        pa.array([_merged(g[0]) for g in got], pa.list_(pa.int32())),
                        *(pa.array([sorted({q.names[i] for i in g[k]}) for g in got], pa.list_(pa.string())) for k in (1, 2)),
                    ],
                    names=["segment", "doc_no", "doc_id", "n_words", "spans", "items", "near_items"],
                )

    return map_arrow(index, run, FOUND)


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted, disjoint [from, to) pairs, flattened."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _hit(spans):
    """Words in the union of flattened spans that may overlap: a fold over them in order."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size(spans) / 2 - 1).cast("int")), lambda i: F.struct(F.get(spans, i * 2).alias("a"), F.get(spans, i * 2 + 1).alias("b"))))
    fold = F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, p: F.struct((s["n"] + F.greatest(F.lit(0), p["b"] - F.greatest(p["a"], s["end"]))).alias("n"), F.greatest(s["end"], p["b"]).alias("end")), lambda s: s["n"])
    return F.when(F.size(spans) == 0, 0).otherwise(fold).cast("long")


def contamination(docs: DataFrame, tests: DataFrame, size: int = 10, slop: int = SLOP, block_bytes: int = BLOCK, short: bool = True) -> DataFrame:
    """doc_id, n_words, n_hit (words inside phrase matches of ``size``-word windows), items and near_items (sorted ids).
    Without ``short``, items of fewer than ``size`` words don't count."""
    tests = tests.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = tests.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    index = saved_index(docs)
    rows = None
    for i in range(n):
        block = [(r.item_id, r.text) for r in tests.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).toLocalIterator()]
        found = search(index, block, size, slop, i == 0, short)
        rows = found if rows is None else rows.union(found)
    if n > 1:
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near_items")]
        rows = rows.groupBy("segment", "doc_no").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *lists)
    sorted_ids = [F.array_sort(F.array_distinct(c)).alias(c) for c in ("items", "near_items")]
    return rows.select("doc_id", "n_words", _hit(F.col("spans")).alias("n_hit"), *sorted_ids)


def decontaminated(docs: DataFrame, tests: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` without those that hold a whole window of ``size`` words of a test item. Shorter items are no
    evidence (a one-word item would take every document with that word). A null doc_id can't be named and stays."""
    mark = spare(docs.columns, "doc_id_")
    bad = contamination(docs, tests, size, slop=0, short=False).where("n_hit > 0 and doc_id is not null").select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(bad, F.col("doc_id") == F.col(mark), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op10(spark, sf_dir):
    docs, tests = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs, tests)
    listed = [c for name, ids in (("items", "items"), ("near_items", "near_items")) for c in (F.size(ids).cast("long").alias(f"n_{name}"), F.sha2(F.array_join(ids, ","), 256).alias(f"{name}_sha256"))]
    return found.select("doc_id", "n_words", "n_hit", *listed, (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(2, len(w) - 8)), lambda i: array_to_string(w[i : i + 9], ' '))) AS t, least(10, len(w)) AS size FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
starts AS (SELECT d.doc_id, z.size, unnest(range(1, len(d.w) - z.size + 2)) AS i, d.w FROM docs d, sizes z WHERE len(d.w) >= z.size),
spans AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS t FROM starts),
hits AS (SELECT s.doc_id, s.size, s.i, w.item_id FROM spans s JOIN windows w ON w.t = s.t AND w.size = s.size),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id),
places AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM docs),
kinds AS (SELECT t, size, string_split(t, ' ') AS ws FROM (SELECT DISTINCT t, size FROM windows)),
rare AS (
  SELECT t, size, ws, word, o FROM (SELECT t, size, ws, unnest(ws) AS word, unnest(range(0, size)) AS o FROM kinds)
  LEFT JOIN (SELECT t AS word, count(*) AS n FROM places GROUP BY t) USING (word) QUALIFY row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), o) = 1),
tries AS (SELECT DISTINCT r.t, r.size, r.ws, p.doc_id, p.p - r.o + s.s AS a FROM rare r JOIN places p ON p.t = r.word, (SELECT unnest(range(-2, 3)) AS s) s),
near AS (
  SELECT DISTINCT t.doc_id, t.t FROM tries t JOIN docs d USING (doc_id)
  WHERE list_bool_and(list_transform(range(0, t.size), lambda k: list_contains(d.w[greatest(1, t.a + k - 2) : greatest(0, t.a + k + 2)], t.ws[k + 1])))),
near_items AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT n.doc_id, w.item_id::VARCHAR AS id FROM near n JOIN windows w ON w.t = n.t) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(m.n, 0)::BIGINT AS n_near_items, sha256(coalesce(m.ids, '')) AS near_items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id) LEFT JOIN near_items m USING (doc_id)
"""
