"""Files written by the executors into a folder that all of them reach."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import checkpointed


def write_files(files: DataFrame, name: str, content: str, folder: str) -> DataFrame:
    """(path, n_bytes) of one file for each row, below ``folder`` (a path or URI); a name's characters other than letters, digits, dots, dashes and
    underscores become underscores.

    A file is written under another name first and then moved, so a task that runs again replaces its own files. The result is checkpointed:
    files are written once. Rows of one name are an error.
    """
    if files.groupBy(name).count().filter("count > 1").limit(1).count():
        raise ValueError("two rows have the same name")
    folder = folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else re.sub(r"^file:/+", "file:///", folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for title, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{base}/{re.sub('[^A-Za-z0-9._-]', '_', title or 'null')}"
                own = f"{path}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(own, compression=None) as out:
                    out.write(data or b"")
                store.move(own, path)
                paths.append(path)
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_pydict({"path": paths, "n_bytes": sizes})

    return checkpointed(files.select(F.col(name).cast("string"), content).mapInArrow(run, "path string, n_bytes bigint"))
