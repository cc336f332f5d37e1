"""Shared pieces: materialised tables in the cluster's shared folder, samples, splits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of bytes that are neither space nor \t..\r.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a row group of written tables.
ROW_GROUP = 32 << 20


#: Folders of sessions that have none set, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='terrafold-')}"
        where = _OWN[app]
    return where.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation. The files go
    with `discard`, or when the JVM ends (FileSystem.deleteOnExit).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terrafold/{uuid.uuid4().hex}"
    # A writer holds a row group in memory, with two or more writers in an executor.
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialize` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._table)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def split_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def plain(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, so extra columns with clashing names can't disturb an operator."""
    return df.select(*((F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in columns.items()))


def bounded_sample(df: DataFrame, by: str, key: Column, per_class: int, max_chars: int) -> list:
    """At most per_class rows of each value of `by`, chosen by a hash of `key` and text; collected.

    df has the columns `by` and text. A row longer than max_chars isn't chosen; rows of one key
    and text count once, so a row repeated any number of times is one for each task at most. The
    number of rows asked of the executors is bounded in expectation (1.5 * per_class + 50 a
    class); the rest is cut on the driver in the order of the hash, so reruns agree, whatever the
    partitions.
    """
    df = df.where(F.col(by).isNotNull() & (F.length("text") <= max_chars)).withColumn("_h", F.xxhash64(key, "text", F.lit(17)))
    df = df.withColumn("_u", F.shiftrightunsigned("_h", 11).cast("double") / float(2**53))
    sizes = {r[0]: max(r[1], 1) for r in df.groupBy(by).agg(F.approx_count_distinct("_h", 0.02)).collect()}  # a row for each class
    if not sizes:
        return []
    want = 1.5 * per_class + 50
    limit = F.coalesce(*[F.when(F.col(by) == F.lit(k), F.lit(min(1.0, want / n))) for k, n in sizes.items()])
    once = df.where(F.col("_u") <= limit).groupBy(by, "_h").agg(F.first("_u").alias("_u"), F.first("text").alias("text"))
    rows = sorted(once.collect(), key=lambda r: (r["_u"], str(r[by]), r["_h"]))
    seen: dict = {}
    kept = []
    for r in rows:
        seen[r[by]] = seen.get(r[by], 0) + 1
        if seen[r[by]] <= per_class:
            kept.append(r)
    return kept


def arrow_map(df: DataFrame, f, schema: str) -> DataFrame:
    """mapInArrow over parts of each batch of at most 1000 rows, so that memory stays bounded."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                yield from f(b.slice(at, 1000))

    return df.mapInArrow(run, schema)


def arrow_filter(df: DataFrame, decide, column: str = "text") -> DataFrame:
    """The rows for which decide(texts) holds; df's columns pass unchanged. A null reads as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                yield b.filter(pa.array(decide([x or "" for x in b.column(column).to_pylist()]), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def row_keys(df: DataFrame) -> DataFrame:
    """df with 128 bits (k1, k2) that are the same for rows the same in all columns."""
    every = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*every, F.xxhash64(*every).alias("k1"), F.xxhash64(F.lit(1), *every).alias("k2"))


def copies_of(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """df's rows by row_keys, each key `copies` times in all. chosen: k1, k2, rows, copies.

    rows: how many rows of df have the key; only keys of several rows are reduced to one first.
    """
    joined = row_keys(df).join(chosen.where("copies > 0"), ["k1", "k2"])
    one = joined.where("rows = 1").unionByName(joined.where("rows > 1").dropDuplicates(["k1", "k2"]))
    return one.select(*df.columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def repeated(df: DataFrame, times: str, step: int = 1 << 16) -> DataFrame:
    """Each row as often as its column `times` says, without an array of that length."""
    outer = df.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / step))))
    return outer.withColumn("_k", F.explode(F.sequence(F.col("_s") * step, F.least(F.col(times), (F.col("_s") + 1) * step) - 1))).drop("_s", "_k")


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for every n of lengths, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
