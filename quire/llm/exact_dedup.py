"""Exact deduplication: sorted digest runs merged in a tree.

Every partition of the input sorts its digests into runs, one per digest range ("shard"), with equal digests already
combined. Runs then meet in rounds: in round k, the runs whose numbers agree after dividing by fan_in**(k+1)
are merged by a multiway merge, each level keeping the verified smallest identifier (see below) of every digest. After
about log(partitions) rounds each shard is one sorted run. Shards are ranges of a uniform digest and their number grows with the rows,
so no task receives more than about ``shard_rows`` digests, and a group of copies counts once in every run.

A digest is verified by what is merged with it: the length in bytes and a second, independent 64-bit hash of the normalised text
are part of the key, so texts of a colliding digest stay apart.

Defined results: null text counts as empty, and empty texts (or texts of white space) are equal to one another; among equal texts the row
with the most code points stays, then the smallest doc_id (null ids last), then the first row in storage order, so of repeated
rows one stays; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bound_batches, checkpointed, keep_rows, quoted, rows_of, tidied

#: Characters that don't count in the comparison, as a pattern.
IGNORED = r"[\x20\x09-\x0D]+"
#: Digests per shard of the merge tree, and runs merged at once.
SHARD_ROWS, FAN_IN = 50_000, 4

_KEY = ["digest", "norm_bytes", "norm_hash"]
_ENTRY = f"shard int, run int, {'digest binary, norm_bytes int, norm_hash bigint'}, chars int, id bigint, row bigint, n bigint, ties bigint"
_KIND = pa.schema(
    [
        ("shard", pa.int32()), ("run", pa.int32()), ("digest", pa.binary()), ("norm_bytes", pa.int32()), ("norm_hash", pa.int64()),
        ("chars", pa.int32()), ("id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("ties", pa.int64()),
    ]
)
_NAMES = _KIND.names


def with_digest(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds digest, norm_bytes, norm_hash and chars of each text; the text is read once, in the JVM."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.regexp_replace(text, IGNORED, "")
    return (
        docs.withColumn("_norm", norm)
        .withColumns(
            {
                "digest": F.unhex(F.sha2("_norm", 256)),
                "norm_bytes": F.octet_length("_norm"),
                "norm_hash": F.xxhash64("_norm"),
                "chars": F.char_length(text),
            }
        )
        .drop("_norm")
    )


def _rank(entry: tuple[Any, ...]) -> tuple[Any, ...]:
    """Order of an entry in a run: by key, then the row that stays first."""
    _, _, digest, size, check, chars, ident, row, *_ = entry
    return digest, size, check, -chars, ident is None, ident or 0, row


def _merged(entries: Iterator[tuple[Any, ...]], shard: int | None, run: int) -> Iterator[tuple[Any, ...]]:
    """Sorted entries with equal keys combined: the first one's identifier stays, counts are added."""
    held: list[Any] | None = None
    for e in entries:
        if held is not None and tuple(held[2:5]) == e[2:5]:
            held[8] += e[8]
            if held[5] == e[5] and held[6] == e[6]:
                held[9] += e[9]
            continue
        if held is not None:
            yield tuple(held)
        held = [e[0] if shard is None else shard, run, *e[2:]]
    if held is not None:
        yield tuple(held)


def _batch(rows: list[tuple[Any, ...]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _KIND, strict=True)], schema=_KIND)


def _batched(rows: Iterator[tuple[Any, ...]], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple[Any, ...]] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def merge_tree(base: DataFrame, shard_rows: int = SHARD_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """One entry for each distinct text of ``base`` (columns id, row, chars and the digest's): the row that stays, the
    group's size, and how many rows tie with it in length and id."""
    count, parts = base.count(), max(1, base.rdd.getNumPartitions())
    shards = max(1, math.ceil(count / shard_rows))
    source = base.select(F.spark_partition_id().alias("run"), *_KEY, "chars", "id", "row")

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """This partition's runs; flushed as a further set of runs where the partition is long."""

        def flush(rows: list[tuple[Any, ...]]) -> Iterator[pa.RecordBatch]:
            rows.sort(key=_rank)
            yield from _batched(_merged(iter(rows), None, rows[0][1] if rows else 0))

        held: list[tuple[Any, ...]] = []
        for run, digest, size, check, chars, ident, row in rows_of(batches, ["run", *_KEY, "chars", "id", "row"]):
            held.append((int.from_bytes(digest[:4], "big") * shards >> 32, run, digest, size, check, chars, ident, row, 1, 1))
            if len(held) >= 10 * SHARD_ROWS:
                yield from flush(held)
                held = []
        yield from flush(held)

    bound_batches(base.sparkSession)
    runs = source.mapInArrow(tidied(sorted_runs), _ENTRY)

    def merge(table: pa.Table) -> pa.Table:
        """Multiway merge of a shard's runs that meet in this round."""
        by_run: dict[int, list[tuple[Any, ...]]] = {}
        for e in rows_of(table.to_batches(), _NAMES):
            by_run.setdefault(e[1], []).append(e)
        for entries in by_run.values():  # sorted already, unless the shuffle mixed a run's blocks
            entries.sort(key=_rank)
        first = min(by_run)
        rows = _merged(heapq.merge(*by_run.values(), key=_rank), None, first // fan_in)
        return pa.Table.from_batches(list(_batched(rows)), schema=_KIND)

    while True:
        # Every round is a shuffle of the runs' entries alone.
        runs = runs.groupBy("shard", F.floor(F.col("run") / fan_in).alias("meet")).applyInArrow(merge, _ENTRY)
        parts = math.ceil(parts / fan_in)
        if parts <= 1:
            return checkpointed(runs)


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with their digests and th, a hash of the whole text; entries of merge_tree), both cut from their lineage."""
    own = docs.select(quoted(docs, id_col).cast("long").alias("id"), quoted(docs, text_col).alias("text"))
    base = checkpointed(with_digest(own.withColumn("th", F.xxhash64("text")), "text").drop("text").withColumn("row", F.monotonically_increasing_id()))
    return base, merge_tree(base)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    base, entries = decide(docs, id_col, text_col)
    best = entries.select(*_KEY, F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))
    # A large group of copies is split on the documents' side by AQE; the entries' side has one row per text.
    return base.join(best, _KEY).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and no others. Whole rows are shuffled only where they may go (see keep_rows)."""
    base, entries = decide(docs, id_col, text_col)
    best = entries.filter("n > 1").select(*_KEY, F.col("row").alias("keep_row"))
    # A large group of copies is split on the rows' side by AQE; the entries' side has one row per text.
    decided = base.join(best, _KEY).select("id", "th", (F.col("row") == F.col("keep_row")).alias("kept"))
    return keep_rows(docs, decided, id_col, text_col)
