"""Near-duplicate lines across documents, by a deletion-neighbourhood join in Spark SQL.

A line, without the spaces around it, is dropped when an earlier one (by doc_id, then row, then
line number) is equal to it or one edit away. In lines of ``WORDS`` words or more an edit is one
word more, less or other (so any change inside a word); in shorter ones it is one character more,
less or other. Blank lines always stay. Equal lines of any length drop; edits count between lines
of ``near_chars`` characters or more (0 takes all), as "12" and "13" are no copies of each other.

Two lines are one edit apart exactly if they share a deletion variant: both without the item
(word or character) at the same place, or one of them whole and the other without an item. So
every line emits the hash of each of its variants with the place, and of itself; lines meet on
equal hashes. Within a group the earliest member alone settles the others, so no pairs are made
inside it: a line's neighbour is the earliest that shares a key, and the edit distance of the two
is verified.

A line has as many variants as items, so lines without any near neighbour are set aside first,
which loses nothing. One edit leaves the first or the last half of a line alone, so only lines
that share such a half with another go on. One edit also lies in one of the line's blocks, 32 at
most, so of those only lines that share all but one block with another emit variants, of that
block alone, hashed together with the rest: the work grows with a line's length and hardly with
its square.

Hot lines: copies are combined before each shuffle, and what remains is one row a distinct
line; joins on hashes are with written tables, open to adaptive splitting.

Defined cases: a null text stays null; empty texts stay; a row is known by its doc_id and its
text, so rows with one doc_id and different texts are told apart (ordered by a hash of the text),
and equal rows get equal results: a line that one of them keeps all of them keep; a document may
end with the empty text; very long texts and lines are worked on whole; an empty table gives an
empty table; further columns are kept, whatever their names, except that columns n_lines and
n_dropped are replaced. Rows with a null doc_id stay whole and are compared with nothing.
Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.storage import spare, written

NEAR_CHARS, WORDS = 20, 5
SMALL_KEYS = 500_000  # hashes that may be sent to every task: 8 or 16 bytes each
LINE = ["doc_id", "row", "no"]


def _row(text: Column) -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(text)


def _lines(docs: DataFrame) -> DataFrame:
    """Lines that aren't blank, with their words."""
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", _row(F.col("text")).alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    return rows.select(*LINE, F.trim("line").alias("line")).where("line <> ''")


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line, F.lit(17)).alias("h"), F.xxhash64(F.lit(29), line).alias("g")]


def _halves(line: str) -> Column:
    """Hashes of the first and last half of the column ``line``: in words, and in characters where it has few words.
    The halves' lengths allow for a neighbour that is an item longer or shorter."""
    n, w = F.char_length(line), F.octet_length(line) - F.octet_length(F.replace(F.col(line), F.lit(" "), F.lit(""))) + 1
    of_8 = F.floor(n / 8).cast("int") * 4

    def chars(c):
        return F.array(F.xxhash64(c, F.substring(line, F.lit(1), c)), F.xxhash64(F.substring(line, -c, c), c))

    def by_word(w, h):
        return F.array(F.xxhash64(F.lit(1), h, F.call_function("substring_index", F.col(line), F.lit(" "), h)), F.xxhash64(F.lit(2), h, F.call_function("substring_index", F.col(line), F.lit(" "), -h)))

    def keys(w):
        low = F.floor((w - 1) / 2).cast("int")
        in_words = F.when(w % 2 == 0, F.concat(by_word(w, low), by_word(w, low + 1))).otherwise(by_word(w, low))
        in_chars = F.when(n % 8 == 7, F.concat(chars(of_8), chars(of_8 + 4))).otherwise(chars(of_8))
        return F.when(w >= WORDS, in_words).otherwise(in_chars)

    return F.get(F.transform(F.array(w), keys), F.lit(0))


def _met(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with a key of ``keys``, a written table that every task gets where its count is small."""
    return rows.join(F.broadcast(keys) if keys.count() <= SMALL_KEYS else keys, by, "left_semi")


def _several(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """The keys that several lines have."""
    return written(rows.groupBy(*by).agg(F.min("at").alias("lo"), F.max("at").alias("hi")).where("lo <> hi").select(*by), name)


def _blocks(items: Column, cut) -> Column:
    """The line's items with one block out, as hashes, with the block: for each block of the
    line as the shorter of two lines, and as one item longer than the other."""
    n = F.size(items) if cut is F.slice else F.char_length(items)

    def without(length):
        size = F.when(length < 16, 2).when(length < 128, 8).otherwise(F.greatest(F.lit(32), F.floor(length / 32).cast("int")))
        last = F.greatest(F.floor(length / size).cast("int") - 1, F.lit(0))

        def block(j):
            after = F.when(j == last, 0).otherwise(length - (j + 1) * size)
            rest = F.xxhash64(length, j, cut(items, F.lit(1), j * size), cut(items, n - after + 1, after))
            return F.struct(rest.alias("rest"), cut(items, j * size + 1, n - after - j * size).alias("block"))

        return F.transform(F.sequence(F.lit(0), last), block)

    return F.concat(without(n), without(n - 1))


def _variants(block: Column, cut) -> Column:
    """(hash, place) of the block whole, at place 0, and without each of its items."""
    n = F.size(block) if cut is F.slice else F.char_length(block)
    places = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    deleted = F.transform(places, lambda i: F.struct(F.xxhash64(F.concat(cut(block, F.lit(1), i - 1), cut(block, i + 1, n - i))).alias("key"), i.alias("place")))
    return F.concat(F.array(F.struct(F.xxhash64(block).alias("key"), F.lit(0).alias("place"))), deleted)


def one_word_apart(a: Column, b: Column) -> Column:
    """Whether all words but one are in the common start and the common end of two lists."""

    def common(x, y):
        first = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(first == 0, F.greatest(F.size(x), F.size(y))).otherwise(first - 1)

    return common(a, b) + common(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1


def _neighbours(near: DataFrame, cut, name: str) -> DataFrame:
    """(at, by): lines and earlier ones one edit away. near: (at, items)."""
    blocks = written(near.select("at", F.explode(_blocks(F.col("items"), cut)).alias("b")).select("at", "b.rest", "b.block"), f"{name}-blocks")
    alike = _met(blocks, _several(blocks, ["rest"], f"{name}-alike"), ["rest"])
    keyed = alike.select("at", "rest", F.explode(_variants(F.col("block"), cut)).alias("v")).select("at", "rest", F.col("v.key").alias("key"), F.col("v.place").alias("place"))
    keyed = written(_met(keyed, _several(keyed, ["rest", "key"], f"{name}-keys"), ["rest", "key"]), f"{name}-keyed")
    cut_, whole = keyed.where("place > 0"), keyed.where("place = 0").drop("place")
    earliest = F.min("at").alias("by")
    # another item: both without the one at the same place
    found = cut_.join(cut_.groupBy("rest", "key", "place").agg(earliest, F.max("at").alias("far")).where("by <> far").drop("far"), ["rest", "key", "place"]).select("at", "by")
    # one item less: the shorter line is the other's variant; each meets the other's earliest
    found = found.union(cut_.join(whole.groupBy("rest", "key").agg(earliest), ["rest", "key"]).select("at", "by"))
    found = found.union(whole.join(cut_.groupBy("rest", "key").agg(earliest), ["rest", "key"]).select("at", "by"))
    pairs = found.where("by < at").distinct()
    both = pairs.join(near, "at").join(near.select(F.col("at").alias("by"), F.col("items").alias("earlier")), "by")
    verified = one_word_apart(F.col("items"), F.col("earlier")) if cut is F.slice else F.levenshtein("items", "earlier", 1) >= 0
    return both.where(verified).select("at", "by")


def kept_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(doc_id, row, no) of every line that isn't blank and stays."""
    lines = _lines(docs)
    at = F.struct(*LINE)
    first = written(lines.select(*LINE, *_hashes(F.col("line"))).groupBy("h", "g").agg(F.min(at).alias("at")), "lines")

    # lines that share a half with another
    long = lines.where(F.char_length("line") >= near_chars)
    halves = long.select(F.explode(_halves("line")).alias("half"), F.xxhash64("line", F.lit(17)).alias("at"))
    with_halves = long.select(*LINE, "line", F.explode(_halves("line")).alias("half"))
    near = _met(with_halves, _several(halves, ["half"], "halves"), ["half"])
    near = written(near.groupBy(*_hashes(F.col("line"))).agg(F.min(at).alias("at"), F.first("line").alias("line")).select("at", "line", F.split("line", " ").alias("words")), "near")

    by_word = _neighbours(near.where(F.size("words") >= WORDS).select("at", F.col("words").alias("items")), F.slice, "words")
    by_char = _neighbours(near.where(F.size("words") < WORDS).select("at", F.col("line").alias("items")), F.substring, "chars")
    gone = by_word.union(by_char).select("at").distinct()
    return first.join(gone, "at", "left_anti").select("at.*")


def line_dedup(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """``docs`` with the columns it has, ``text`` without dropped lines, and n_lines and n_dropped."""
    names = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    row, marks, left = (spare(docs.columns, c) for c in ("row", "marks", "left"))
    kept = kept_lines(docs.select("doc_id", "text"), near_chars).groupBy("doc_id", "row").agg(F.array_sort(F.collect_list("no")).alias("stay"))
    # one mark a line: 1 where it stays
    gap = F.transform("stay", lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.coalesce(F.get("stay", i - 1), F.lit(-1)) - 1), F.lit("1")))
    put = written(kept.select("doc_id", F.col("row").alias(row), F.array_join(gap, "").alias(marks)), "marks")
    n_lines = F.char_length("text") - F.char_length(F.translate("text", "\n", "")) + 1
    # rows that nothing drops from need no join, and would all have one key
    whole = docs.where("doc_id is null or text is null").select(*_quoted(names), "text", F.when(F.col("text").isNull(), 0).otherwise(n_lines).alias("n_lines"), F.lit(0).alias("n_dropped"))
    out = docs.where("doc_id is not null and text is not null").withColumn(row, _row(F.col("text"))).join(put, ["doc_id", row], "left")
    places = F.split(F.coalesce(marks, F.lit("")), "")
    stays = F.filter(F.split("text", "\n", -1), lambda x, i: (F.trim(x) == "") | F.coalesce(F.get(places, i) == "1", F.lit(False)))
    out = out.select(*_quoted(names), "text", n_lines.alias("n_lines"), stays.alias(left))
    dropped = F.col("n_lines") - F.size(left)
    text = F.when(dropped == 0, F.col("text")).otherwise(F.array_join(left, "\n"))
    return out.select(*_quoted(names), text.alias("text"), "n_lines", dropped.alias("n_dropped")).union(whole)


def _quoted(names: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def deduplicated(docs: DataFrame, near_chars: int = NEAR_CHARS, least: float = 0.0) -> DataFrame:
    """``docs`` with shortened texts. Documents go that have only dropped or blank lines, or of whose
    characters less than the share ``least`` is left: most of such a document is in earlier ones."""
    size = spare([*docs.columns, "n_lines", "n_dropped"], "size")
    out = line_dedup(docs.withColumn(size, F.char_length("text")), near_chars)
    stays = (F.col("n_dropped") == 0) | ((F.trim(F.translate("text", "\n", " ")) != "") & (F.char_length("text") >= F.col(size) * least))
    text = [F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.where(stays).select(*text)


def op2(spark, sf_dir):
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), "text")


#: the definition, without halves, blocks or hashes
ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS no, trim(unnest(string_split(text, chr(10))), ' ') AS line, unnest(string_split(text, chr(10))) AS raw
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
firsts AS (SELECT line, min((doc_id, no)) AS spot, string_split(line, ' ') AS words, len(string_split(line, ' ')) AS w FROM lines WHERE line <> '' GROUP BY line),
cut AS (
  SELECT spot, w, i, array_to_string(list_concat(words[1 : i - 1], words[i + 1 : w]), ' ') AS k
  FROM (SELECT spot, w, words, unnest(range(1, w + 1)) AS i FROM firsts WHERE w >= 5 AND length(line) >= 20)),
same AS (SELECT w, i, md5(k) AS k, min(spot) AS spot FROM cut GROUP BY ALL),
gone AS (
  SELECT c.spot FROM cut c JOIN same s ON s.w = c.w AND s.i = c.i AND s.k = md5(c.k) WHERE s.spot < c.spot
  UNION SELECT c.spot FROM cut c JOIN firsts f ON f.line = c.k AND f.w >= 5 AND length(f.line) >= 20 WHERE f.spot < c.spot
  UNION SELECT f.spot FROM cut c JOIN firsts f ON f.line = c.k AND f.w >= 5 AND length(f.line) >= 20 WHERE c.spot < f.spot
  UNION SELECT a.spot FROM firsts a JOIN firsts b ON b.spot < a.spot AND a.w < 5 AND b.w < 5 AND length(a.line) >= 20 AND length(b.line) >= 20
    WHERE abs(length(a.line) - length(b.line)) <= 1 AND levenshtein(a.line, b.line) <= 1),
kept AS (SELECT spot FROM firsts WHERE spot NOT IN (SELECT spot FROM gone)),
marked AS (SELECT doc_id, no, raw, line = '' OR (doc_id, no) IN (SELECT spot FROM kept) AS stays FROM lines)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE m.n END AS n_lines, coalesce(m.n - m.k, 0) AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(m.text, '') END AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE stays) AS k, string_agg(raw, chr(10) ORDER BY no) FILTER (WHERE stays) AS text
  FROM marked GROUP BY doc_id) m USING (doc_id)
"""
