"""Token ids in Arrow stream files with fixed-size-list batches.

``write`` sorts documents by doc_id (range partitioning: shard i holds the ids below those of
shard i+1), and each task writes its shard as one file in the Arrow stream format. Columns
are fixed-size lists: ``ids`` (``length`` of the narrowest unsigned type that holds the vocabulary)
and ``mask`` (``length / 8`` bytes whose bits, the highest first, are 1 for a token and 0 for the
padding at a shard's end); both are read in place. A second stream file of a shard holds its
documents' ids and numbers of tokens. All record batches but the last have
``batch_rows`` rows, so sequence i is row ``i % batch_rows`` of batch ``i // batch_rows``; with
the file memory-mapped, it is read in place.

A task writes under a name of its own attempt, and the manifest names the files of attempts
that ended well; a lost executor or a repeated task leaves at most files nobody reads.

The folder of the files has to be in a store that pyarrow opens (file, hdfs, s3a, gs, abfss).

Defined cases: null text counts as empty (its ids are the end id alone); a null doc_id comes
first; rows that share a doc_id follow one another by text, equal rows one after the other; a very
long text goes over as many batches as it needs; an empty table gives an empty manifest; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from operator import add
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm import textgrid as tg
from nearfield.llm.storage import map_arrow, open_fs, scratch, written
from nearfield.llm.word_bpe import _texts, vocabulary
from nearfield.llm.wordtable import WIDE_SPACE, WordTable, led, single_spaced, word_table

VOCABULARY = "byte_bpe_50k.json"
LENGTH, BATCH_ROWS = 1024, 256
KEPT = 900_000  # words that a worker process keeps
DOCS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "shard int, ids_path string, docs_path string, n_docs long, n_tokens long"


def _table_ids(table: WordTable, spaced: WordTable, texts: list[bytes]) -> list[bytes]:
    """The packed ids of each text. White space outside ASCII can join a run of spaces that the words are cut at; such
    texts are encoded whole. The words after single spaces are looked up for all texts at once."""
    heads, rests = [], []
    for text in texts:
        rest = []
        if not text.isascii() and WIDE_SPACE.search(text.decode("utf-8", "replace")):
            heads.append(np.array(table.t.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, table.type).tobytes())
        elif single_spaced(text):
            first, *rest = text.split(b" ")
            heads.append(table.join([first]) if first else b"")
        else:
            heads.append(table.join(led(text)))
        rests.append(rest)
    return list(map(add, heads, spaced.join_all(rests)))


class _Sequences:
    """Cuts a stream of ids into batches of equal-length sequences and writes them."""

    def __init__(self, sink, kind: np.dtype, length: int, rows: int):
        if length % 8:
            raise ValueError("the length of a sequence is a multiple of 8, for its mask")
        self.kind, self.length, self.rows = kind, length, rows
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.uint8(), length // 8))])
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.ids, self.held = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= self.length * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([np.zeros(0, self.kind), *self.ids])
        step = self.length * self.rows
        for a in range(0, len(ids) if last else len(ids) - len(ids) % step, step):
            own = ids[a : a + step]
            pad = -len(own) % self.length
            mask = np.packbits(np.append(np.ones(len(own), np.uint8), np.zeros(pad, np.uint8)))
            columns = (np.append(own, np.zeros(pad, self.kind)), self.length), (mask, self.length // 8)
            self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), n) for x, n in columns], schema=self.schema))
        kept = len(ids) - len(ids) % step
        self.ids, self.held = [ids[kept:]], len(ids) - kept

    def close(self) -> None:
        self._flush(True)
        self.out.close()


def write(docs: DataFrame, path: str, vocab: str, end_id: int, length: int = LENGTH, batch_rows: int = BATCH_ROWS, shards: int | None = None) -> DataFrame:
    """Write the files under ``path`` (a URI that all executors share); the manifest, a row a shard with documents."""
    spark = docs.sparkSession
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches):
        table = None
        context = TaskContext.get()
        shard, name = context.partitionId(), uuid.uuid4().hex
        fs, base = open_fs(path)
        total, n_docs = 0, 0
        files = [str(PurePosixPath(base) / f"{kind}-{shard:06d}-{name}.arrow") for kind in ("ids", "docs")]
        for batch in batches:
            for rows in tg.blocks(batch, "text", 2 << 20):
                if table is None:
                    table, spaced = word_table(vocab), word_table(vocab, " ", KEPT)
                    fs.create_dir(base, recursive=True)
                    sinks = [fs.open_output_stream(f) for f in files]
                    sequences = _Sequences(sinks[0], table.type, length, batch_rows)
                    index = pa.ipc.new_stream(sinks[1], DOCS)
                    end = np.array([end_id], table.type).tobytes()
                packed = [p + end for p in _table_ids(table, spaced, list(_texts(rows)))]
                counts = np.array([len(p) // table.type.itemsize for p in packed])
                sequences.add(np.frombuffer(b"".join(packed), table.type))
                index.write_batch(pa.record_batch([rows.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64())], schema=DOCS))
                total, n_docs = total + int(counts.sum()), n_docs + len(counts)
        if table is not None:
            sequences.close()
            index.close()
            for s in sinks:
                s.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([f], pa.string()) for f in files), pa.array([n_docs], pa.int64()), pa.array([total], pa.int64())], names=["shard", "ids_path", "docs_path", "n_docs", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(shards, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    return written(map_arrow(rows, run, MANIFEST), "manifest")


class TokenFile:
    """Random access to the sequences of one file, in place where the file is local. A batch is opened when it is
    asked for: full batches of one schema have one size, so the place of each is known from the first."""

    def __init__(self, uri: str, base: str = ""):
        fs, path = open_fs(base or uri)
        path = uri if base else path
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.source))
        self.start = self.source.tell()
        first = self._message(self.start)
        self.rows = first.num_rows if first else 0
        self.step = self.source.tell() - self.start
        self.size, at = 0, self.start
        if first:
            whole = max(0, (self.source.size() - self.start) // self.step - 1)
            at += whole * self.step
            self.size = whole * self.rows
            while batch := self._message(at):
                at = self.source.tell()
                self.size += batch.num_rows

    def _message(self, at: int) -> pa.RecordBatch | None:
        self.source.seek(at)
        try:
            message = pa.ipc.read_message(self.source)
        except EOFError:  # the end of the stream
            return None
        return pa.ipc.read_record_batch(message, self.schema)

    def __len__(self) -> int:
        return self.size

    def batch(self, k: int) -> pa.RecordBatch:
        return self._message(self.start + k * self.step)

    def batches(self):
        return (self.batch(k) for k in range(-(-self.size // max(1, self.rows))))

    def sequence(self, i: int, column: str = "ids") -> np.ndarray:
        """Entry ``i`` of a column; it shares the file's memory."""
        return self.batch(i // self.rows).column(column)[i % self.rows].values.to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> np.ndarray:
        """The mask of sequence ``i``, a boolean a token."""
        return np.unpackbits(self.sequence(i, "mask")).astype(bool)


def _documents(uri: str, base: str) -> pa.Table:
    fs, _ = open_fs(base)
    with fs.open_input_file(uri) as source:
        return pa.ipc.open_stream(source).read_all()


def read(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("shard", "ids_path", "docs_path", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                f, docs = TokenFile(row["ids_path"], path), _documents(row["docs_path"], path)
                many = docs.column("n_tokens").to_numpy()
                ends = np.cumsum(many)
                sums, crc, k, at = [], 0, 0, 0
                for b in f.batches():
                    flat = b.column("ids").flatten().to_numpy()
                    flat = flat[: int(np.unpackbits(b.column("mask").flatten().to_numpy()).sum())].astype("<u4")
                    a = 0
                    while a < len(flat):
                        e = min(int(ends[k]) - at, len(flat))
                        crc = zlib.crc32(flat[a:e], crc)
                        if at + e == ends[k]:
                            sums.append(crc)
                            crc, k = 0, k + 1
                        a = e
                    at += len(flat)
                if k != len(many):
                    raise ValueError("a file has fewer tokens than its documents")
                starts = row["base"] + ends - many
                for a in range(0, len(many), 10_000):
                    part = slice(a, a + 10_000)
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id").slice(a, 10_000).combine_chunks(), *(pa.array(x[part], pa.int64()) for x in (starts, many, sums))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return map_arrow(based.repartition(n, "shard"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch(spark, "tokens")
    return read(write(docs, path, vocabulary(VOCABULARY), 2), path)


ORACLE_SQL = None
