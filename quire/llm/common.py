"""Helpers shared by the training-data operators: batches, staging, hashing."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch sent to a Python worker; texts may be long, so batches are small.
BATCH_ROWS = 1000
#: Bytes per Arrow batch, where the Spark version knows that limit.
BATCH_BYTES = 16 << 20
#: Rows whose crc32(id) mod 5 is 0 are held out from learning.
FOLDS = 5
#: Blocks of a fixed-size table that are merged at once.
MERGED = 64
#: A key filter has this many bits for each key, at least and at most so many in all; beyond that every row passes.
FILTER_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts (a session setting; lower values stay)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(spark.conf.get(key))
    except Exception:  # not every value parses as a plain number
        now = 1 << 40
    if now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of spark.checkpoint.dir (eager, survives lost executors)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local session without one gets a temporary folder; a cluster without one is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return sc.getCheckpointDir()


def release(df: DataFrame) -> None:
    """Lets Spark delete the shuffle files and checkpoints of tables that nothing refers to any more.

    The driver otherwise notices that they are unused only when its own garbage happens to be collected.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id's decimal text is divisible by 5 (null ids count as empty text)."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == 0


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """A string column as Python strings, null as empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


@functools.cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


def give_back() -> None:
    """Returns freed memory to the system. Python workers are used again by later stages, and allocators keep what the largest task took."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a mapInArrow that gives memory back when its task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]],
    schema: str,
) -> DataFrame:
    """mapInArrow with state made once per task: ``make()`` returns the function applied to each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    bound_batches(df.sparkSession)
    return df.mapInArrow(tidied(run), schema)


def rows_of(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple[Any, ...]]:
    """Rows as tuples, one batch in memory at a time."""
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


# --------------------------------------------------------------------------- fixed-size tables over all rows
def merge_blocks(blocks: DataFrame, parts: int, combine: np.ufunc, kind: str) -> np.ndarray:
    """Arrays that partitions made in blocks (part, block, data), combined in rounds; the result's size doesn't depend on the rows."""
    schema = "part bigint, block int, data binary"

    def merge(table: pa.Table) -> pa.Table:
        total: np.ndarray | None = None
        for data in table.column("data"):
            own = np.frombuffer(data.as_buffer(), dtype=kind)
            total = own.copy() if total is None else combine(total, own, out=total)
        part = table.column("part")[0].as_py() // MERGED
        return pa.table({"part": pa.array([part], pa.int64()), "block": table.column("block")[:1], "data": pa.array([total.tobytes()], pa.binary())})

    while True:
        blocks = blocks.groupBy("block", F.floor(F.col("part") / MERGED).alias("meet")).applyInArrow(merge, schema)
        parts = -(-parts // MERGED)
        if parts <= 1:
            break
    rows = sorted((r["block"], bytes(r["data"])) for r in blocks.select("block", "data").collect())  # as many as blocks
    return np.frombuffer(b"".join(data for _, data in rows), dtype=kind)


def emit_blocks(part: int, array: np.ndarray, size: int) -> pa.RecordBatch:
    """One row for each block of an array that a partition made."""
    data = [array[i : i + size].tobytes() for i in range(0, len(array), size)]
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * len(data), pa.int64()), pa.array(range(len(data)), pa.int32()), pa.array(data, pa.binary())], names=["part", "block", "data"]
    )


def key_filter(keys: DataFrame) -> Callable[[Column], Column]:
    """A condition that holds for every hash in ``keys`` (one bigint column) and for few others, as a function of a column of hashes.

    Its bits are gathered from all keys in blocks and number FILTER_BITS a key; at most MOST_BITS (32 MB) reach the driver and the executors. Where
    that isn't enough, all rows pass. An exact join has to follow.
    """
    n = keys.count()
    if n == 0:
        return lambda key: F.lit(False)
    bits = max(LEAST_BITS, 1 << (max(1, n * FILTER_BITS) - 1).bit_length())
    if bits > MOST_BITS:
        return lambda key: F.lit(True)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, part = np.zeros(bits // 8, np.uint8), 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column(1)[0].as_py()
                at = batch.column(0).to_numpy() & (bits - 1)
                np.bitwise_or.at(found, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield emit_blocks(part, found, 1 << 17)

    source = keys.select(F.col(keys.columns[0]).alias("key"), F.spark_partition_id().cast("long").alias("part"))
    known = merge_blocks(source.mapInArrow(tidied(mark), "part bigint, block int, data binary"), keys.rdd.getNumPartitions(), np.bitwise_or, "u1")

    @F.arrow_udf("boolean")
    def hit(key: pa.Array) -> pa.Array:
        at = key.to_numpy(zero_copy_only=False) & (bits - 1)
        return pa.array((known[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return hit


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that ``decided`` (id, th, kept; one row for each row that it speaks of) rules out; th is xxhash64 of the text.

    Of repeated rows of a kept key one stays. Only ids and hashes are shuffled, and of whole rows those whose key passes a filter of the
    keys that go; the others stay where they are.
    """
    keys = decided.groupBy(F.col("id").alias("_go_id"), F.col("th").alias("_go_th")).agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    keys = checkpointed(keys.filter("not _kept or _n > 1").select("_go_id", "_go_th", "_kept"))
    hit = key_filter(keys.select(F.xxhash64("_go_id", "_go_th")))
    # The row comes in one struct, so that no column name can clash.
    own = docs.select(F.struct(*(quoted(docs, c) for c in docs.columns)).alias("_doc"), quoted(docs, id_col).cast("long").alias("_id"), F.xxhash64(quoted(docs, text_col)).alias("_th"))
    own = own.withColumn("_hit", hit(F.xxhash64("_id", "_th")))
    sure = own.filter("not _hit").select("_doc.*")
    found = own.filter("_hit").join(keys, F.col("_id").eqNullSafe(F.col("_go_id")) & F.col("_th").eqNullSafe(F.col("_go_th")), "left")
    stay = sure.unionByName(found.filter("_kept is null").select("_doc.*"))
    if keys.filter("_kept").limit(1).count() == 0:
        return stay
    return stay.unionByName(found.filter("_kept").dropDuplicates(["_id", "_th"]).select("_doc.*"))


def quoted(df: DataFrame, name: str) -> Column:
    """A column by its name, whatever characters the name holds."""
    return df["`" + name.replace("`", "``") + "`"]
