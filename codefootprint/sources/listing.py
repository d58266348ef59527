"""Reading files from a listing.

Spark's file sources leave out names that start with a dot or an underscore, and repositories have many of them
(``.gitlab-ci.yml``, ``__init__.py``). A listing names every file, so they are read here by the executors, a file at a
time, from any file system Arrow can open.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# The reader travels with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BATCH_BYTES = 32 * 1024 * 1024
_SCHEMA = pa.schema([
    ("repo_id", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("content", pa.binary()),
])


def _read_file(uri: str) -> bytes | None:
    try:
        system, name = pafs.FileSystem.from_uri(uri)
        with system.open_input_stream(name) as stream:
            return stream.read()
    except OSError:
        return None


def _read_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for batch in batches:
        for repo_id, path, uri in zip(*(column.to_pylist() for column in batch.columns)):
            content = _read_file(uri)
            rows.append((repo_id, path, None if content is None else len(content), content))
            held += len(content or b"")
            if held >= _BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def files_from_listing(listing: DataFrame) -> DataFrame:
    """A ``files`` table from ``(repo_id, path, uri)`` rows. Partition the listing to spread the reading.

    A file that is gone or can't be read keeps its row, with null length and content; a scan gives it the status
    ``no content``.
    """
    rows = listing.selectExpr("CAST(repo_id AS STRING) AS repo_id", "path", "uri")
    return rows.mapInArrow(_read_listed, "repo_id string, path string, length bigint, content binary")
