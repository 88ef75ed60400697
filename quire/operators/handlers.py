"""Extension points: callbacks over ordered rows of a group, and external scorers over batches."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

Handler = Callable[[dict[str, Any], dict[str, Any]], None]

#: Requests to an external scorer that run at once in a task.
CONCURRENT = 10


def process(rows: DataFrame, group: str, order: Sequence[str], kind: str, handlers: Mapping[str, Handler], start: Mapping[str, Any], schema: str) -> DataFrame:
    """Calls the handler of each row's kind ('*' for any other) with the group's state; one row (group, state) per group.

    Rows are sorted and streamed, so that a group of any size is never held as a whole.
    """
    columns = rows.columns
    ordered = rows.repartition(group).sortWithinPartitions(group, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (dict(zip(columns, r, strict=True)) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        done: list[dict[str, Any]] = []
        for key, own in itertools.groupby(stream, key=lambda r: r[group]):
            state = dict(start)
            for row in own:
                handler = handlers.get(row[kind]) or handlers.get("*")
                if handler:
                    handler(state, row)
            done.append({group: key, **state})
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return ordered.mapInArrow(run, schema)


def score_batches(rows: DataFrame, id_col: str, value_col: str, scorer: Callable[[Any], int], workers: int = CONCURRENT) -> DataFrame:
    """(id, result, error): a scorer called for every row, a few at once; the order of rows is kept and an error stays with its row."""
    kind = pa.schema([(id_col, pa.int64()), ("result", pa.int64()), ("error", pa.string())])

    def one(value: Any) -> tuple[int | None, str | None]:
        try:
            return scorer(value), None
        except Exception as e:  # kept as the row's result
            return None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                got = list(pool.map(one, batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r for r, _ in got], pa.int64()), pa.array([e for _, e in got], pa.string())], schema=kind)

    return rows.select(id_col, value_col).mapInArrow(run, f"{id_col} bigint, result bigint, error string")
