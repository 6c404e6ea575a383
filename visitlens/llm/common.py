"""What the text operators share: table access, the shared folder, label folds, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at; a longer document is a step of its own.
STEP_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named in spark.checkpoint.dir. Only in one local process, where that is unset,
    it is a temporary folder; on a cluster that is an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="visitlens-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def stored(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has (case set aside), for a column that is dropped again."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id's text is a multiple of five. Null ids: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_ids(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y, order) of the labelled ids outside the held-out fold, one row each: the highest label of a repeated id,
    and a hash to put them in order. Null labels and ids are left out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    y = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    return y.withColumn("order", F.xxhash64("doc_id"))


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """ids, a table of few and distinct doc_id, with each one's text; of a repeated id the least text. No text is shuffled
    but those of ids, and a row leaves its task once, however often it stands in docs."""
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return text.join(F.broadcast(ids), "doc_id").groupBy(ids.columns).agg(F.min("text").alias("text"))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, y, order, text) of at most `rows` labelled documents outside the held-out fold, whatever ids repeat.

    They are the ids whose hash is lowest, so a rerun takes the same ones. At most `rows` ids and labels are broadcast.
    """
    return texts_of(docs, labelled_ids(labels, label).orderBy("order", "doc_id").limit(rows))


def steps(sizes: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts rows of the given sizes into runs [a, b) of at most `limit` in sum, one row at least."""
    ends = np.cumsum(sizes, dtype=np.int64)
    a, done = 0, 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield a, b
        a, done = b, int(ends[b - 1])


def in_turn(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, where rows become Python objects."""
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.slice(a, rows)


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column end to end (uint8) and n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every span, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
