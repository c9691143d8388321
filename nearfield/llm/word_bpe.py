"""BPE encoding and decoding by a table of the corpus's distinct words.

Texts are split at ASCII white space. Each chunk of a partition (about ``CHUNK`` distinct
words) sends its distinct words to the buckets of their hashes; there each distinct word of
the corpus is encoded once, and its ids go back to the chunks that have it, as a table in
the shared folder. A second pass over the texts joins the ids by position, and decoding joins
ids with the id-to-piece table. The words of this vocabulary never reach across white space
and its normaliser works on each word alone, so the ids are those of the whole text.

Texts and occurrences are never shuffled, only words distinct in their chunk; a frequent word
comes once from each chunk. A word that a chunk's table lacks (the second pass found other
rows in the partition) is encoded on the spot: a different layout costs time, never a result.

There is a bucket for every ``BUCKET`` bytes of text (one a shuffle partition at least), so that a
bucket's distinct words stay fewer than the ``wordtable.WORDS`` that its task holds, and each is
encoded once whatever the corpus. The folder has to be in a store that pyarrow opens (file, hdfs,
s3a, gs, abfss), as tasks read their tables in place.

Defined cases: null text counts as empty and has no ids; a null doc_id is kept; special tokens
written in a text get their ids, as the library does; very long texts and words are encoded
whole; rows may repeat; an empty table gives an empty table; further columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm import textgrid as tg
from nearfield.llm.storage import map_arrow, open_fs, scratch
from nearfield.llm.wordtable import WordTable

VOCABULARY = "word_bpe_49k.json"
CHUNK = 400_000  # distinct words at which a chunk ends
BLOCK = 1 << 20
BUCKET = 64 << 20  # bytes of text for which there is a bucket of words


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _texts(rows: pa.RecordBatch):
    data, o = tg.buffers(rows.column("text"))
    data, o = data.tobytes(), o.tolist()
    for a, b in zip(o, o[1:], strict=False):
        yield data[a:b]


def _chunk_words(batches, buckets: int, chunk: int):
    """(at, bucket, words) of the chunks of a partition; ``at`` is the number of text bytes before the chunk."""
    own: set[bytes] = set()
    at = seen = 0

    def packed():
        parts: list[list[bytes]] = [[] for _ in range(buckets)]
        for w in own:
            parts[zlib.crc32(w) % buckets].append(w)
        for k, p in enumerate(parts):
            if p:
                yield at, k, b" ".join(p)

    for batch in batches:
        for rows in tg.blocks(batch, "text", BLOCK):
            if len(own) >= chunk:
                yield from packed()
                own.clear()
                at = seen
            for t in _texts(rows):
                own.update(t.split())
                seen += len(t)
    yield from packed()


def word_tables(docs: DataFrame, path: str, chunk: int = CHUNK) -> str:
    """Write the ids of each chunk's distinct words; the folder, with a table for every partition of ``docs``."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1, -(-size // BUCKET))

    def split(batches):
        part = TaskContext.get().partitionId()
        for at, bucket, words in _chunk_words(batches, buckets, chunk):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([bucket], pa.int32()), pa.array([words], pa.binary())], names=["part", "at", "bucket", "words"])

    def encoded(batches):
        table = WordTable(path)
        for batch in batches:
            ids, counts = [], []
            for words in batch.column("words").to_pylist():
                found = table.each(words.split(b" "))
                ids.append(b"".join(found))
                counts.append((np.fromiter(map(len, found), "<u4", len(found)) // table.type.itemsize).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("at"), batch.column("words"), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())], names=["part", "at", "words", "counts", "ids"])

    words = map_arrow(docs.select("doc_id", "text"), split, "part int, at long, bucket int, words binary").repartition(buckets, "bucket").drop("bucket")
    tables = map_arrow(words, encoded, "part int, at long, words binary, counts binary, ids binary")
    folder = scratch(spark, "words")
    tables.repartition(buckets, "part").sortWithinPartitions("part", "at").write.option("compression", "zstd").partitionBy("part").parquet(folder)
    return folder


def _table_rows(folder: str):
    """(at, words, counts, ids) of this task's partition, by ``at``."""
    fs, base = open_fs(f"{folder}/part={TaskContext.get().partitionId()}")
    for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as source:
                for batch in pq.ParquetFile(source).iter_batches(16, columns=["at", "words", "counts", "ids"]):
                    yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _joined(batches, path: str, folder: str):
    """(rows, the table, packed ids of each row) of blocks of a partition."""
    table = WordTable(path, most=4 * CHUNK)
    rest, current, seen = _table_rows(folder), None, 0
    ahead = next(rest, None)
    for batch in batches:
        for rows in tg.blocks(batch, "text", BLOCK):
            while ahead and ahead[0] <= seen:
                at, words, counts, ids = ahead
                if at != current:
                    table.ids.clear()
                    current = at
                ends = np.append(0, np.cumsum(np.frombuffer(counts, "<u4"), dtype=np.int64) * table.type.itemsize).tolist()
                table.ids.update(zip(words.split(b" "), (ids[a:b] for a, b in zip(ends, ends[1:], strict=False)), strict=True))
                ahead = next(rest, None)
            texts = list(_texts(rows))
            seen += sum(map(len, texts))
            yield rows, table, [table.join(t.split()) for t in texts]


def _id_lists(packed: list[bytes], kind: np.dtype) -> pa.Array:
    ends = np.append(0, np.cumsum([len(p) // kind.itemsize for p in packed])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), kind).astype(np.int32)))


def encode(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    folder = word_tables(docs, path, chunk)

    def run(batches):
        for rows, table, packed in _joined(batches, path, folder):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), _id_lists(packed, table.type)], names=["doc_id", "ids"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and text of every row."""

    def run(batches):
        piece = np.array(WordTable(path).piece, dtype=object)
        for batch in batches:
            ids = batch.column("ids")
            o, flat = ids.offsets.to_pylist(), np.asarray(ids.values)
            text = [" ".join(piece[flat[a:b]]) for a, b in zip(o, o[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(text, pa.string())], names=["doc_id", "ids", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, text string")


def encoded_and_decoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text that the ids decode to."""
    folder = word_tables(docs, path)

    def run(batches):
        for rows, table, packed in _joined(batches, path, folder):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), _id_lists(packed, table.type), pa.array(map(table.decode, packed), pa.string())], names=["doc_id", "ids", "text"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both ways without the ids leaving the task."""
    folder = word_tables(docs, path)

    def run(batches):
        for rows, table, packed in _joined(batches, path, folder):
            n = [len(p) // table.type.itemsize for p in packed]
            ids = [hashlib.sha256(np.frombuffer(p, table.type).astype("<u4").tobytes()).hexdigest() for p in packed]
            text = [hashlib.sha256(table.decode(p).encode()).hexdigest() for p in packed]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5(spark, sf_dir):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(VOCABULARY))


ORACLE_SQL = None
