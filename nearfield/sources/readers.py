"""Text and binary sources of vectors, centroids, codebooks and records."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parsed_vectors(lines: DataFrame, dim: int, category: bool = False, sep1: str = ";", sep2: str = ",", line: str = "value") -> DataFrame:
    """(cat, key, vec) of lines ``[cat;]key;v,v,...``. Lines without separators or with fewer than ``dim`` values are skipped; more values are cut."""
    parts = F.split(line, f"[{sep1}]")
    n = 3 if category else 2
    vec = F.transform(F.split(F.get(parts, F.lit(n - 1)), f"[{sep2}]"), lambda x: F.trim(x).try_cast("float"))
    rows = lines.where(F.size(parts) >= n).select((F.get(parts, F.lit(0)).try_cast("long") if category else F.lit(None).cast("long")).alias("cat"), F.get(parts, F.lit(n - 2)).try_cast("long").alias("key"), F.slice(vec, 1, dim).alias("vec"))
    return rows.where((F.size("vec") == dim) & F.col("key").isNotNull() & ~F.exists("vec", lambda x: x.isNull()))


def read_text_vectors(spark: SparkSession, path: str, dim: int, **options) -> DataFrame:
    return parsed_vectors(spark.read.text(path), dim, **options)


def parsed_bits(values: Column) -> Column:
    """An array of '0' and '1' as packed words."""
    from nearfield.functions.metrics import pack_bits

    return pack_bits(F.transform(values, lambda x: x.try_cast("int")))


def _binary(spark: SparkSession, path: str, decode, kind: str) -> DataFrame:
    names = [f.split()[0] for f in kind.split(", ")]

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                yield pa.RecordBatch.from_arrays(decode(content), names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, kind)


def read_vecs(spark: SparkSession, path: str, dim: int, dtype: str = "<f4", category: bool = False) -> DataFrame:
    """Files of all vectors, then all keys, then (``category``) all categories; a size that doesn't divide evenly is an error."""
    width = np.dtype(dtype).itemsize * dim
    each = width + 8 * (1 + category)

    def decode(data):
        n, rest = divmod(len(data), each)
        if rest:
            raise ValueError("the file's size doesn't fit the dimension")
        x = np.frombuffer(data, dtype, n * dim).astype(np.float32)
        keys = np.frombuffer(data, "<i8", n, n * width)
        cats = np.frombuffer(data, "<i8", n, n * (width + 8)) if category else None
        return [pa.array(cats) if category else pa.nulls(n, pa.int64()), pa.array(keys), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(x))]

    return _binary(spark, path, decode, "cat long, key long, vec array<float>")


def read_bin(spark: SparkSession, path: str, dtype: str = "<f4") -> DataFrame:
    """Files that begin with the number of rows and the dimension (32 bits each); key is the row's number."""

    def decode(data):
        n, dim = struct.unpack_from("<II", data)
        x = np.frombuffer(data, dtype, n * dim, 8).astype(np.float32)
        return [pa.array(np.arange(n)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(x))]

    return _binary(spark, path, decode, "key long, vec array<float>")


def to_text(vectors: DataFrame, sep1: str = ";", sep2: str = ",") -> DataFrame:
    """One text line a vector, the inverse of ``parsed_vectors``."""
    return vectors.select(F.concat_ws(sep1, F.col("key").cast("string"), F.array_join(F.transform("vec", lambda x: x.cast("string")), sep2)).alias("value"))


def parsed_centroids(lines: DataFrame, fine: bool = False, line: str = "value", dim: int | None = None, mips: bool = False, binary: bool = False) -> DataFrame:
    """(parent, label, cv) of ``[parent ]label v,v,...`` lines. With ``dim`` other lengths are left out; centroids of
    ``mips`` indexes have a value more. ``binary``: 1 from 0.5 on, else 0."""
    parts = F.split(line, " ")
    n = 2 + fine
    vec = F.transform(F.split(F.get(parts, F.lit(n - 1)), ","), lambda x: x.cast("double"))
    vec = F.transform(vec, lambda x: F.when(x >= 0.5, 1.0).otherwise(0.0)) if binary else vec
    whole = (F.size(parts) == n) if dim is None else (F.size(parts) == n) & (F.size(vec) == dim + mips)
    return lines.where(whole).select((F.get(parts, F.lit(0)).cast("long") if fine else F.lit(None).cast("long")).alias("parent"), F.get(parts, F.lit(n - 2)).cast("long").alias("label"), vec.alias("cv"))


def parsed_group_meta(lines: DataFrame, line: str = "value") -> DataFrame:
    """(level, id, doc_count, centroid_count, first_slot): slots of a group follow those of the groups before it."""
    from pyspark.sql import Window

    p = F.split(line, ":")
    rows = lines.where(F.size(p) == 4).select(*(F.get(p, F.lit(i)).cast("long").alias(c) for i, c in enumerate(("level", "id", "doc_count", "centroid_count"))))
    w = Window.orderBy("level", "id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("first_slot", F.coalesce(F.sum("centroid_count").over(w), F.lit(0)))


def build_columns(line: str) -> list[Column]:
    """(groups, v) of build strings ``level:id;level:id||v v ...``; without groups the one of level 0."""
    parts = F.split(line, r"\|\|")
    has = F.size(parts) > 1
    pairs = F.transform(F.filter(F.split(F.get(parts, F.lit(0)), ";"), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, ":", 1).try_cast("int").alias("level"), F.substring_index(p, ":", -1).try_cast("int").alias("id")))
    every = F.array(F.struct(F.lit(0).alias("level"), F.lit(0).alias("id")))
    v = F.transform(F.filter(F.split(F.element_at(parts, -1), " "), lambda x: x != ""), lambda x: x.try_cast("double"))
    return [F.when(has, F.array_sort(F.array_distinct(pairs))).otherwise(every).alias("groups"), v.alias("v")]


def parsed_builds(records: DataFrame, line: str = "value") -> DataFrame:
    """``records`` with groups and v of their build strings in place of ``line``. Generators stand between, as Spark would
    otherwise make the string and its parts anew wherever one of them is used."""
    kept = [c for c in records.columns if c != line]
    once = records.select(*kept, F.explode(F.array(line)).alias(line))
    return once.select(*kept, F.inline(F.array(F.struct(*build_columns(line)))))


def read_norm(spark: SparkSession, path: str) -> float:
    """The one number of a norm file."""
    values = [r.value.strip() for r in spark.read.text(path).limit(2).collect()]
    if len(values) != 1:
        raise ValueError("a norm file has one line")
    return float(values[0])


def read_queries(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """(qid, qv) of text lines ``qid;v,v,...``; ``binary``: values of 0 and 1 (a multiple of 32) as packed words."""
    parts = F.split("value", ";")
    values = F.split(F.get(parts, F.lit(1)), ",")
    rows = spark.read.text(path).where(F.size(parts) == 2).select(F.get(parts, F.lit(0)).try_cast("long").alias("qid"), values.alias("x"))
    if binary:
        rows = rows.where((F.size("x") % 32 == 0) & F.forall("x", lambda x: F.trim(x).isin("0", "1")))
        return rows.select("qid", parsed_bits(F.transform("x", lambda x: F.trim(x))).alias("qv"))
    return rows.select("qid", F.transform("x", lambda x: F.trim(x).try_cast("double")).alias("qv"))


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """(frag, code, cv) of files integrate_<frag>.dat with ``code v,v,...`` lines."""
    lines = spark.read.text(path).withColumn("frag", F.regexp_extract(F.input_file_name(), r"integrate_(\d+)", 1).cast("int"))
    p = F.split("value", " ")
    return lines.where(F.size(p) == 2).select("frag", F.get(p, F.lit(0)).cast("int").alias("code"), F.transform(F.split(F.get(p, F.lit(1)), ","), lambda x: x.cast("double")).alias("cv"))


def parsed_records(records: DataFrame, line: str = "value") -> DataFrame:
    """(id, vec) of CMD=add records of key=value lines; one without id or cate_vec is an error."""

    def field(name):
        return F.regexp_extract(line, rf"(?m)^{name}=(.*)$", 1)

    adds = records.where(field("CMD") == "add")
    whole = F.when((field("id") != "") & (field("cate_vec") != ""), field("id")).otherwise(F.raise_error(F.lit("a record without id or cate_vec")).cast("string"))
    return adds.select(whole.alias("id"), F.transform(F.split(field("cate_vec"), "[ ,]"), lambda x: x.cast("float")).alias("vec"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return parsed_records(spark.read.option("lineSep", "\x1e").text(path))


def parsed_requests(lines: DataFrame, line: str = "value") -> DataFrame:
    return lines.select(F.from_json(line, "request_id string, request_url string").alias("r")).select("r.*")


def save_index(tables: dict[str, DataFrame], path: str, by: dict[str, tuple[str, str]] | None = None) -> None:
    """Write an index's tables as Parquet below ``path``, partitioned where ``by`` names a column and sorted by the column
    beside it. Spark divides a partition that is large among tasks."""
    for name, df in tables.items():
        w = df.write
        if by and name in by:
            part, order = by[name]
            w = df.hint("rebalance", F.col(part)).sortWithinPartitions(part, order).write.partitionBy(part)
        w.parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
