"""Packed blocks of rows and messages between blocks and hash buckets.

The Python operators here share one shape: rows are packed once into compressed
blocks of bounded size, each block sends pre-aggregated messages to hash buckets,
buckets reduce them, and answers go back to the blocks they came from. A key that
a third of all rows hold costs one message per block, not one per row, and no
block, bucket or task holds an unbounded group of rows.

Blocks are laid out by block id and checkpointed to the shared folder, so later
passes move only messages, and a lost executor costs a reread of that table.
"""

from __future__ import annotations

import ctypes
import pickle
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
PACKED = "block long, n_rows long, n_bytes long, blob binary"
MESSAGE = "block long, bucket long, payload binary"


def use_checkpoints(spark: SparkSession) -> None:
    """Take the checkpoint folder from the session; where none is named, a temporary one will do on a single machine only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def released(spark: SparkSession) -> None:
    """Has the driver look for plans that nothing refers to any more, so that Spark deletes their shuffle files now."""
    spark._jvm.System.gc()


def saved(df: DataFrame) -> DataFrame:
    """The rows of df, read from a Parquet table in the shared checkpoint folder.

    The table goes when `dropped` is told that nothing reads it any more, or when the
    session's JVM ends.
    """
    spark = df.sparkSession
    use_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/saved-{uuid.uuid4().hex}"
    released(spark)
    df.write.option("compression", "zstd").parquet(folder)
    path, fs = _folder(spark, folder)
    fs.deleteOnExit(path)
    back = spark.read.schema(df.schema).parquet(folder)
    back.saved_in = folder
    return back


def dropped(*frames: DataFrame | None) -> None:
    """Deletes the tables of frames from `saved` that will not be read again; None is passed over."""
    for df in frames:
        if df is not None:
            path, fs = _folder(df.sparkSession, df.saved_in)
            fs.delete(path, True)


def _folder(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def dumps(x) -> bytes:
    return pickle.dumps(x, protocol=5)


loads = pickle.loads


def trim() -> None:
    """Give memory of finished blocks back, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def to_blob(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _pack(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    held, size = [], 0

    def flush():
        nonlocal made, held, size
        table = pa.Table.from_batches(held)
        row = pa.RecordBatch.from_pydict(
            {"block": [(part << 32) + made], "n_rows": [table.num_rows], "n_bytes": [size], "blob": [to_blob(table)]},
            schema=pa.schema([("block", pa.int64()), ("n_rows", pa.int64()), ("n_bytes", pa.int64()), ("blob", pa.binary())]),
        )
        made, held, size = made + 1, [], 0
        return row

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            step = max(1, min(batch.num_rows - at, 256))
            while step > 1 and batch.slice(at, step).get_total_buffer_size() and batch.slice(at, step).nbytes > block_bytes:
                step //= 2
            piece = batch.slice(at, step)
            if held and size + piece.nbytes > block_bytes:
                yield flush()
            held.append(piece)
            size += piece.nbytes
            at += step
    if held:
        yield flush()


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df's rows dealt out by the key, in a checkpoint that keeps the partitioning, so that later joins and groups by the key move only the other side."""
    spark = df.sparkSession
    use_checkpoints(spark)
    released(spark)
    # an adaptive plan does not tell its partitioning
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def pack(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of docs in compressed blocks, dealt out by block id, in a checkpoint."""
    packed = dealt(docs.mapInArrow(lambda it: _pack(it, block_bytes), PACKED), "block")
    released(docs.sparkSession)
    return packed


def bucket_count(blocks: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets in proportion to the raw input, so that each stays of bounded size."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // bucket_bytes + 1)


def scatter(blocks: DataFrame, send: Callable[[int, pa.Table], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """Messages that send(block, rows) makes for buckets."""

    def run(batches):
        for batch in batches:
            for block, blob in zip(batch["block"].to_pylist(), batch["blob"], strict=True):
                out = list(send(block, from_blob(blob.as_py())))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block] * len(out), pa.int64()), pa.array([b for b, _ in out], pa.int64()), pa.array([p for _, p in out], pa.binary())],
                        names=["block", "bucket", "payload"],
                    )
                del out
                trim()

    return blocks.mapInArrow(run, MESSAGE)


def at_buckets(messages: DataFrame, reduce: Callable[[int, list[tuple[int, bytes]]], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """Answers (block, payload) that reduce(bucket, messages) makes; messages come sorted by block."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", kind="stable")
        bucket = int(pdf["bucket"].iloc[0])
        out = list(reduce(bucket, list(zip(pdf["block"].tolist(), pdf["payload"].tolist(), strict=True))))
        return pd.DataFrame({"block": pd.Series([b for b, _ in out], dtype="int64"), "bucket": pd.Series([bucket] * len(out), dtype="int64"), "payload": pd.Series([p for _, p in out], dtype=object)})

    return messages.groupBy("bucket").applyInPandas(run, MESSAGE)


def gather(blocks: DataFrame, answers: DataFrame, finish: Callable[[int, pa.Table, list[bytes]], Iterable[pa.Table | pa.RecordBatch]], schema, every: bool = True) -> DataFrame:
    """Rows that finish(block, rows, payloads) makes of each block and its answers.

    every=False skips blocks without answers.
    """
    per_block = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "payload"))).alias("answers"))
    joined = blocks.select("block", "blob").join(per_block, "block", "left" if every else "inner")
    joined = joined.select("block", "blob", F.col("answers.payload").alias("answers"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                got = batch["answers"][i].as_py() or []
                for out in finish(batch["block"][i].as_py(), from_blob(batch["blob"][i].as_py()), got):
                    yield from out.to_batches(max_chunksize=2000) if isinstance(out, pa.Table) else [out]
                trim()

    return joined.mapInArrow(run, schema)


def texts(table: pa.Table, column: str = "text") -> list[bytes]:
    """The column's values as UTF-8 bytes; null is empty."""
    return [b"" if v is None else v for v in table[column].cast(pa.binary()).to_pylist()]
