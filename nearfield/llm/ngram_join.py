"""N-gram Jaccard self-join by rare-first prefix filtering.

Every document is the set of its distinct word n-grams (64-bit hashes). Documents with the
same set form a class with one representative. The n-grams of a set are ordered rare first,
by a corpus-wide table of counts; two sets with Jaccard similarity t or more share one of
their first ``n - ceil(t n) + 1`` n-grams, so representatives meet on those only. Length,
positional and suffix filters drop pairs that can't reach t, and the rest is verified on the
whole sets, once per pair.

What is linked forms components, and pairs inside a known component need no look: in each
n-gram's list all members are first compared with one pivot (rows stay linear in the list),
components are formed, and only lists that still hold several components go on, with a new
pivot each time, until there are no more than ``FEW`` pairs of different components a list entry.
Where the first pivots leave more (many unlike documents with one n-gram), the members of open lists
are listed anew by parts: sets that can be similar differ in at most d n-grams, so of d + 1 parts into
which the n-grams' hashes divide both, one is equal, and sets meet by equal parts (some eight n-grams
each at 90 per cent) in place of single n-grams, where that leaves fewer pairs. Rows are again linear in
a set's size. What is still
open then gets more pivots a round, one of each component, 16 times as many each time where rounds don't
halve it. No link between components is lost, and a large group of near copies never becomes all pairs.

Hot n-grams: a list's pivot and its components are found by aggregations that combine before the
shuffle, and members meet written pivots, so adaptive execution may split a list over tasks.

Bounds: the table of counts has an entry for every 16 words of the corpus, 2**18 to 2**22 of them
(n-grams share an entry by hash; it orders n-grams and never decides a link). Its 4 bytes an entry
are what is sent to every task.

Defined cases: null or empty text, or text without words, is an empty set linked with
nothing; fewer words than n give one n-gram; a null doc_id gets a null component and no
links; rows that share a doc_id are one node of the graph, linked by any of their texts; equal
rows stay separate rows of one component; very long texts are worked on whole, one at a time;
further columns, whatever their names, are ignored (``one_of_each`` keeps them); an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm import textgrid as tg
from nearfield.llm.graph import components
from nearfield.llm.storage import map_arrow, written

RANK_BITS = 18, 22
RANK_WORDS, WORD_BYTES = 16, 6
CHUNK_BITS = 12
SUFFIX_BITS = 6  # a set is divided into 2**SUFFIX_BITS parts by its hashes
SMALL_IDS = 500_000  # ids, 8 bytes each, that may be sent to every task
FEW = 20  # open pairs per open list entry that may be compared at once


def _sets(rows: pa.RecordBatch, n: int):
    """For each text of the slice its hashes of n-grams, with repeats."""
    h, first = tg.words(*tg.buffers(rows.column("text")), tg.NOT_SPACE)
    grams = tg.windows(h, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            yield grams[a : b - n + 1]
        elif b > a:
            yield np.array([tg.runs(h[a:b])], np.uint64)
        else:
            yield grams[:0]


def rank_bits(docs: DataFrame) -> int:
    """The size of the table of counts, as a power of 2."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least, most = RANK_BITS
    return min(most, max(least, (size // (WORD_BYTES * RANK_WORDS)).bit_length()))


def gram_counts(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """How often n-grams fall into each of 2**bits entries, over all documents."""
    chunk = 1 << min(CHUNK_BITS, bits)

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for rows in tg.blocks(batch, "text"):
                g = np.concatenate([np.zeros(0, np.uint64), *_sets(rows, n)])
                total += np.bincount((g & tg.U((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        parts = total.reshape(-1, chunk)
        narrow = [p.astype(np.min_scalar_type(int(p.max()))) for p in parts]
        for a in range(0, len(parts), 256):
            yield pa.RecordBatch.from_arrays([pa.array(range(a, min(a + 256, len(parts))), pa.int32()), pa.array([p.itemsize for p in narrow[a : a + 256]], pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in narrow[a : a + 256]], pa.binary())], names=["part", "width", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, w, c in zip(*(batch.column(k).to_pylist() for k in ("part", "width", "counts")), strict=True):
                sums[p] = sums.get(p, 0) + np.frombuffer(zlib.decompress(c), f"<u{w}").astype(np.int64)
        most = np.iinfo(np.uint32).max
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(s, most).astype("<u4").tobytes() for s in sums.values()], pa.binary())], names=["part", "counts"])

    tasks = min((1 << bits) // chunk, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = map_arrow(docs.select("text"), count, "part int, width int, counts binary").repartition(tasks, "part")
    out = np.zeros(((1 << bits) // chunk, chunk), np.uint32)
    sums = map_arrow(parts, add, "part int, counts binary").toArrow()  # in one job, where an iterator would run one for each partition
    for part, c in zip(sums.column("part").to_pylist(), sums.column("counts"), strict=True):
        out[part] = np.frombuffer(c.as_buffer(), "<u4")
    return out.reshape(-1)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def signatures(docs: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """Per row: doc_id, the set's size, its 128-bit signature, the n-grams of its prefix, rarest
    first, and the sizes of the parts into which its hashes divide it."""
    table = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        rank = table.value
        low = tg.U(len(rank) - 1)
        for batch in batches:
            for rows in tg.blocks(batch, "text"):
                size, one, two, prefix, parts = [], [], [], [], []
                for g in _sets(rows, n):
                    g = np.unique(g)
                    size.append(len(g))
                    one.append(int(tg.mix(g).sum(dtype=np.uint64)))
                    two.append(int(tg.mix(g ^ tg.U(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)))
                    parts.append(np.bincount((g >> tg.U(64 - SUFFIX_BITS)).astype(np.int64), minlength=1 << SUFFIX_BITS))
                    k = min(len(g), prefix_length(len(g), percent)) if len(g) else 0
                    c = rank[(g & low).astype(np.int64)]
                    if k < len(g):  # nothing above the k-th smallest count can be in the prefix
                        keep = c <= np.partition(c, k - 1)[k - 1]
                        g, c = g[keep], c[keep]
                    prefix.append(g[np.lexsort((g, c))[:k]])
                ends = np.append(0, np.cumsum([len(p) for p in prefix])).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint64), *prefix]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").cast(pa.int64()), pa.array(size, pa.int32()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) << SUFFIX_BITS), pa.array(np.concatenate(parts).astype(np.int32)))],
                    names=["doc_id", "n", "one", "two", "prefix", "parts"],
                )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n int, one long, two long, prefix array<long>, parts array<int>")


def whole_sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for rows in tg.blocks(batch, "text"):
                g = [np.unique(x) for x in _sets(rows, n)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array([x.tobytes() for x in g], pa.binary())], names=["doc_id", "grams"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, grams binary")


def levels(size: int, percent: int, bounds: list[int]) -> list[tuple[int, int]]:
    """(level, parts) under which a set of ``size`` is divided. Level i holds sizes from ``bounds[i]`` to below
    ``bounds[i + 2]``, so two sizes that can link share the level of the smaller one; its parts are one more than
    the n-grams in which two such sets differ at most. ``bounds`` starts as [1] and is continued."""
    while len(bounds) < 2 or bounds[-2] <= size:
        bounds.append(100 * bounds[-1] // percent + 1)
    own = bisect_right(bounds, size) - 1
    return [(i, (bounds[i + 1] + bounds[i + 2] - 2) * (100 - percent) // (100 + percent) + 1) for i in (own, own - 1) if i >= 0]


def part_keys(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row with words: doc_id, the set's size, and a key for each part of its set at both of its levels. Sets that
    link have a key in common."""

    def run(batches):
        bounds = [1]
        for batch in batches:
            for rows in tg.blocks(batch, "text"):
                size, keys = [], []
                for g in _sets(rows, n):
                    g = np.unique(g)
                    sums, of_set = np.append(tg.U(0), np.cumsum(tg.mix(g), dtype=np.uint64)), [np.zeros(0, np.uint64)]
                    for level, parts in levels(len(g), percent, bounds) if len(g) else ():
                        ends = sums[np.searchsorted((g >> tg.U(32)) * tg.U(parts) >> tg.U(32), np.arange(parts + 1, dtype=np.uint64))]
                        of_set.append(tg.mix(np.diff(ends) ^ tg.mix(np.arange(parts, dtype=np.uint64) + tg.U(level << 32))))
                    size.append(len(g))
                    keys.append(np.concatenate(of_set))
                ends = pa.array(np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int32))
                flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(size, pa.int32()), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "n", "keys"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n int, keys array<long>")


def _few(ids: DataFrame) -> DataFrame:
    """``ids``, to be sent to every task if they are counted and few; else they are joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= SMALL_IDS else ids


def _ids(pairs: DataFrame) -> DataFrame:
    return written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")


def suffix_filtered(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets can be similar enough: the parts of two sets differ in size by no more than
    the sets differ."""
    parts = sigs.select("doc_id", "parts").join(_few(_ids(pairs)), "doc_id", "left_semi")
    both = pairs.join(parts.select(F.col("doc_id").alias("a"), F.col("parts").alias("x")), "a").join(parts.select(F.col("doc_id").alias("b"), F.col("parts").alias("y")), "b")
    total = F.aggregate(F.concat("x", "y"), F.lit(0), lambda s, k: s + k)
    apart = F.aggregate(F.zip_with("x", "y", lambda i, j: F.abs(i - j)), F.lit(0), lambda s, k: s + k)
    return both.where((100 + percent) * (total - apart) >= 2 * percent * total).select("a", "b").distinct()


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, shared, total, linked) for each pair of ids, from the whole texts."""
    sets = written(whole_sets(docs.join(_few(_ids(pairs)), "doc_id", "left_semi"), n), "sets").distinct()
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y")), "b")

    def run(batches):
        for batch in batches:
            shared, total = [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared.append(len(np.intersect1d(x, y, assume_unique=True)))
                total.append(len(x) + len(y))
            s, t = np.array(shared, np.int64), np.array(total, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(s), pa.array(t), pa.array((100 + percent) * s >= percent * t)], names=["a", "b", "shared", "total", "linked"])

    return map_arrow(both.select("a", "b", "x", "y"), run, "a long, b long, shared long, total long, linked boolean")


def _can_link(percent: int, na: str, nb: str, pa_: str, pb: str):
    """Length and positional filter of two list entries."""
    a, b, p, q = (F.col(c).cast("long") for c in (na, nb, pa_, pb))
    return (F.least(a, b) * 100 >= percent * F.greatest(a, b)) & ((100 + percent) * (1 + F.least(a - p - 1, b - q - 1)) >= percent * (a + b))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.union(more)
    return out


def _compare(met: DataFrame, done: DataFrame | None, links: list[DataFrame], docs: DataFrame, sigs: DataFrame, n: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Verify the pairs of ``met`` that aren't in ``done``; both tables with what is new."""
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if done is not None:
        pairs = pairs.join(done, ["a", "b"], "left_anti")
    near = written(suffix_filtered(written(pairs, "candidates"), sigs, percent), "near")
    new = written(verified(near, docs, n, percent), "pairs")
    return new.drop("linked") if done is None else done.union(new.drop("linked")), [*links, new.where("linked").select("a", "b").distinct()]


def _pivots(lists: DataFrame, many: int) -> DataFrame:
    """(gram, a, na, pa, ca): of each list the member nearest to the last pivot, or one each of ``many`` components."""
    member = F.struct("away", "rep", "n", "pos", "c")
    if many == 1:
        chosen = lists.groupBy("gram").agg(F.min(member).alias("p"))
    else:
        of_each = lists.groupBy("gram", "c").agg(F.min(member).alias("p"))
        chosen = of_each.withColumn("k", F.row_number().over(Window.partitionBy("gram").orderBy("p"))).where(F.col("k") <= many)
    return written(chosen.select("gram", F.col("p.rep").alias("a"), F.col("p.n").alias("na"), F.col("p.pos").alias("pa"), F.col("p.c").alias("ca")), "pivots")


def _open(lists: DataFrame) -> tuple[int, int, DataFrame]:
    """The entries and the pairs of different components in lists that hold several components, and those lists."""
    counted = lists.groupBy("gram", "c").agg(F.count("*").alias("k")).groupBy("gram")
    mixed = counted.agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs"), F.sum("k").alias("m")).where("pairs > 0")
    mixed = written(mixed, "mixed")
    rows, pairs = mixed.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
    return rows, pairs, written(lists.join(mixed.select("gram"), "gram").select(COLUMNS), "lists") if rows else lists


def _divided(lists: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The members of ``lists`` in lists of equal parts."""
    members = written(lists.groupBy("rep").agg(F.min("c").alias("c")), "open")
    keys = part_keys(docs.join(_few(members.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi"), n, percent)
    entries = members.join(keys, F.col("rep") == F.col("doc_id")).select(F.explode("keys").alias("gram"), "rep", "n", F.lit(0).alias("pos"), "c", F.lit(0.0).alias("away"))
    return written(entries.distinct(), "finer")


COLUMNS = ["gram", "rep", "n", "pos", "c", "away"]


def linked_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: similarity of ``percent`` per cent or more links."""
    docs = docs.select("doc_id", "text")
    sigs = written(signatures(docs, n, percent, gram_counts(docs, n, rank_bits(docs))), "signatures")
    named = sigs.where("n > 0 and doc_id is not null")
    classes = written(named.groupBy("one", "two", "n").agg(F.min("doc_id").alias("rep")), "classes")
    member = written(named.select("doc_id", "one", "two", "n").join(classes, ["one", "two", "n"]).select("doc_id", "rep"), "members")
    # a doc_id with several texts binds their classes together
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("far")).where("a <> far")
    links = [member.join(several, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct()]

    first = classes.select(F.col("rep").alias("doc_id"), "one", "two", "n")
    reps = sigs.join(first, ["doc_id", "one", "two", "n"], "left_semi").select(F.col("doc_id").alias("rep"), "n", "prefix")
    entries = reps.select("rep", "n", F.posexplode("prefix").alias("pos", "gram"))
    shared = written(entries.groupBy("gram").agg(F.min("rep").alias("low"), F.max("rep").alias("far")).where("low <> far").select("gram"), "shared")
    lists = written(entries.join(shared, "gram").select("gram", "rep", "n", "pos", F.col("rep").alias("c"), F.lit(0.0).alias("away")), "lists")
    done, before, many, comp, divided = None, None, 1, None, False
    while True:
        pivot = _pivots(lists, many)
        met = lists.withColumnRenamed("rep", "b").join(pivot, "gram").where("a <> b and ca <> c").where(_can_link(percent, "na", "n", "pa", "pos"))
        done, links = _compare(met, done, links, docs, sigs, n, percent)
        if comp is None or not links[-1].isEmpty():
            comp = written(components(_union(links)), "components")
        # what is left: the lists without the pivots, which have met all others
        if many == 1:
            left = lists.join(pivot.select("gram", "a"), "gram").where("rep <> a").withColumns({"x": F.least("a", "rep"), "y": F.greatest("a", "rep")})
            far = done.groupBy(F.col("a").alias("x"), F.col("b").alias("y")).agg(F.min(1 - F.col("shared") / (F.col("total") - F.col("shared"))).alias("d"))
            left = left.join(far, ["x", "y"], "left").withColumn("away", F.coalesce("d", F.lit(1.0)))
        else:
            left = lists.join(pivot.select("gram", F.col("a").alias("rep")), ["gram", "rep"], "left_anti")
        left = left.select("gram", "rep", "n", "pos", "away").join(comp, F.col("rep") == F.col("node"), "left").select("gram", "rep", "n", "pos", F.coalesce("component", "rep").alias("c"), "away")
        rows, pairs, lists = _open(written(left, "left"))
        if pairs > FEW * rows and not divided:
            finer, divided = _open(_divided(lists, docs, n, percent)), True
            if finer[1] < pairs:
                rows, pairs, lists = finer
            else:
                many *= 16
        if not rows:
            break
        if pairs <= FEW * rows:
            x, y = (lists.select("gram", F.col("rep").alias(i), F.col("n").alias("n" + i), F.col("pos").alias("p" + i), F.col("c").alias("c" + i)) for i in "ab")
            met = x.join(y, "gram").where("a < b and ca <> cb").where(_can_link(percent, "na", "nb", "pa", "pb"))
            done, links = _compare(met, done, links, docs, sigs, n, percent)
            if not links[-1].isEmpty():
                comp = written(components(_union(links)), "components")
            break
        if before is not None and pairs > before / 2:
            many *= 16
        before = pairs
    node = member.join(comp, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("c")).groupBy("doc_id").agg(F.min("c").alias("c"))
    return sigs.select("doc_id", "n").join(node, "doc_id", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with the smallest doc_id of every component only. Rows with a null doc_id stay."""
    gone = linked_components(docs, n, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op9(spark, sf_dir):
    return linked_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM words),
sets AS (SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS k, g FROM grams),
reps AS (SELECT min(doc_id) AS rep, k, n FROM sets WHERE n > 0 GROUP BY k, n),
post AS (SELECT r.rep, r.n, unnest(s.g) AS gram FROM reps r JOIN sets s ON s.doc_id = r.rep),
rare AS (SELECT rep, n, gram FROM (
  SELECT p.rep, p.n, p.gram, row_number() OVER (PARTITION BY p.rep ORDER BY f.c, p.gram) AS pos FROM post p JOIN (SELECT gram, count(*) AS c FROM post GROUP BY gram) f USING (gram))
  WHERE pos <= n - (90 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.rep AS a, b.rep AS b, a.n + b.n AS t FROM rare a JOIN rare b ON a.gram = b.gram AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
links AS (
  SELECT c.a, c.b FROM cand c JOIN post x ON x.rep = c.a JOIN post y ON y.rep = c.b AND y.gram = x.gram
  GROUP BY c.a, c.b, c.t HAVING 100 * count(*) >= 90 * (c.t - count(*))),
twoway AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, to_node) AS (SELECT rep, rep FROM reps UNION SELECT r.node, e.b FROM reach r JOIN twoway e ON e.a = r.to_node),
comp AS (SELECT node, min(to_node) AS c FROM reach GROUP BY node)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, coalesce(c.c, s.doc_id) AS component_id
FROM sets s LEFT JOIN reps r ON r.k = s.k AND r.n = s.n LEFT JOIN comp c ON c.node = r.rep
"""
