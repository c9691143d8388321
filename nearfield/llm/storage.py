"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: fixed values: suffixes of sizes in Spark's settings, as powers of 1024
SIZES = {"": 0, "b": 0, "k": 1, "kb": 1, "m": 2, "mb": 2, "g": 3, "gb": 3, "t": 4, "tb": 4, "p": 5, "pb": 5}
#: fixed values: Hadoop's schemes under the names that pyarrow knows
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs"}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the session names none, a local master gets a
    temporary one; on a cluster it is an error, as executors don't see the driver's folders."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder; a cluster needs one that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="nearfield-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/nearfield/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut and
    a lost executor costs no recomputation. The files stay until ``dropped`` removes them."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    collected(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collected(spark: SparkSession) -> None:
    """Let the driver collect its garbage. Spark removes the shuffles and broadcasts of plans that are done
    only after that, and a driver that plans many tables would fill its heap with them first."""
    gc.collect()
    spark._jvm.System.gc()


def dropped(spark: SparkSession) -> None:
    """Remove all tables that operators have written into the shared folder. Only when no result
    of theirs is read any more: results are lazy and read them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/nearfield")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def size_of(text: str) -> int:
    """Bytes of a setting such as ``64m`` or ``4194304b``; negative and 0 stand for no limit."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-zA-Z]*)\s*", str(text)).groups()
    return int(number) << 10 * SIZES[unit.lower()]


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded size, so that workers stay small whatever the texts'
    lengths. Sets the session's Arrow batch limits where they are larger."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < size_of(conf.get(key)) <= most:
            conf.set(key, str(most))

    def run(batches):
        yield from function(batches)
        returned()

    return df.mapInArrow(run, schema)


def returned() -> None:
    """Give freed memory back to the system: Spark keeps Python workers for other tasks, and with them what
    their allocators hold."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def spare(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column has it (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it, for what executors write and read in place.
    Stores that pyarrow has no driver for raise an error that names the scheme."""
    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    try:
        return pafs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + uri[len(scheme) :])
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"spark.checkpoint.dir is in a {scheme} store, which executors can't open in place; name a folder in a file, hdfs, s3a, gs or abfss store") from e
