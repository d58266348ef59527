"""Reading a tree of repositories: a listing made by tasks, and files dealt to tasks by their bytes.

Spark's file sources list on the driver or by leaf folder, leave out hidden names, and enter every folder. Here the tree is
listed by tasks, some levels at a time, ignored folders are never entered, and what is to be read is packed so that every task
reads about the same number of bytes: a large file is a pack of its own, and thousands of small ones share one.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterable, Iterator
from itertools import accumulate
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import IGNORED_DIRS
from .listing import files_from_listing

# The lister travels with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LISTED = "repo_id string, path string, uri string, length bigint, is_folder boolean"
_SCHEMA = pa.schema([
    ("repo_id", pa.string()), ("path", pa.string()), ("uri", pa.string()), ("length", pa.int64()), ("is_folder", pa.bool_()),
])


def _children(uri: str) -> list[tuple[str, str, int | None, bool]] | None:
    """Name, URI, length and kind of what lies in a folder, or None if it can't be listed. Links to folders are left out, as
    they may lead back."""
    try:
        system, folder = pafs.FileSystem.from_uri(uri)
        infos = system.get_file_info(pafs.FileSelector(folder))
    except OSError:
        return None
    local = isinstance(system, pafs.LocalFileSystem)
    out = []
    for info in infos:
        is_folder = info.type == pafs.FileType.Directory
        if is_folder and local and os.path.islink(info.path):
            continue
        out.append((info.base_name, f"{uri.rstrip('/')}/{quote(info.base_name)}", info.size, is_folder))
    return out


def _list_level(batches: Iterator[pa.RecordBatch], ignored: frozenset[str], descend: int) -> Iterator[pa.RecordBatch]:
    """What lies in the given folders and below them. Of a folder in which ``descend`` names were found, the folders not
    entered by then are rows themselves, and so are those of the root."""
    for batch in batches:
        for start in batch.to_pylist():
            rows, entered, seen = [], [start], 0
            while entered:
                folder = entered.pop()
                found = _children(folder["uri"])
                if found is None:  # kept as a file that can't be read
                    rows.append({**folder, "length": None, "is_folder": False})
                    continue
                top = folder["repo_id"] is None  # the root's folders are the repositories
                for name, uri, size, is_folder in found:
                    if is_folder and not top and (name.startswith(".") or name in ignored):
                        continue
                    repo, below = (name if is_folder else "", "") if top else (folder["repo_id"], folder["path"])
                    path = "" if top and is_folder else f"{below}/{name}" if below else name
                    row = {"repo_id": repo, "path": path, "uri": uri, "length": None if is_folder else size, "is_folder": is_folder}
                    (entered if is_folder and not top else rows).append(row)
                seen += len(found)
                if seen >= descend:
                    break
            rows += entered
            for k in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist(rows[k : k + 10_000], _SCHEMA)


def list_tree(
    spark: SparkSession, root: str, work: str, ignored_dirs: Iterable[str] | None = None, tasks: int | None = None,
    descend: int = 1_000,
) -> DataFrame:
    """``repo_id, path, uri, length`` of every file below ``root``, a URI of a folder that holds one folder per repository.

    Hidden files are listed; folders that are hidden or in ``ignored_dirs`` (empty: the default set) are not entered, the
    repositories' own folders always are. A job lists the folders that the one before found but did not enter; a task goes
    down from each of them until it has seen ``descend`` names, and the folders left are dealt out anew. Each job writes
    below ``work``, a folder that driver and executors share, so a lost executor repeats a part of one job only.
    """
    ignored = frozenset(ignored_dirs or ()) or frozenset(IGNORED_DIRS)
    run = f"{work.rstrip('/')}/listing-{uuid.uuid4().hex}"
    uri = root if "://" in root else f"file://{root}"
    folders = spark.createDataFrame([(None, "", uri, None, True)], _LISTED).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    levels = []
    while True:
        path = f"{run}/{len(levels)}"
        folders.mapInArrow(lambda b: _list_level(b, ignored, descend), _LISTED).write.parquet(path)
        level = spark.read.schema(_LISTED).parquet(path)
        levels.append(path)
        below = level.filter("is_folder")
        left = below.count()
        if not left:
            break
        # a folder is one name here and may hold much, so they are dealt out anew; few are not worth the start of many tasks
        folders = below.repartition(tasks or max(cores, min(cores * 4, left // 1_000)))
    return spark.read.schema(_LISTED).parquet(*levels).filter("NOT is_folder").select("repo_id", "path", "uri", "length")


def packed(listing: DataFrame, pack_bytes: int = 64 << 20, pack_files: int = 5_000, bucket_files: int = 50_000) -> DataFrame:
    """The listing in partitions of about ``pack_bytes`` and at most ``pack_files`` files; a file that is larger is alone or with
    few others.

    Files are hashed into buckets of about ``bucket_files``; within one they are added up in the order of their URIs. So no
    task sees all names, and what is numbered in one task is one row per bucket. The listing should be stored, as it
    is read three times.
    """
    spark = listing.sparkSession
    files = listing.count()
    # a few files are no reason for a few tasks, as long as a bucket fills a pack
    buckets = max(1, files // bucket_files, min(files // pack_files, spark.sparkContext.defaultParallelism))
    own = Window.partitionBy("_bucket").orderBy("uri", "repo_id", "path").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce("length", F.lit(0))
    placed = listing.withColumn("_bucket", F.pmod(F.xxhash64("uri"), F.lit(buckets))).withColumns({
        "_before": F.coalesce(F.sum(size).over(own), F.lit(0)), "_count": F.count(F.lit(1)).over(own)
    })
    # by bytes or by number, whichever has filled more packs
    numbered = placed.withColumn("_pack", F.greatest(F.floor(F.col("_before") / pack_bytes), F.floor(F.col("_count") / pack_files)))
    packs = numbered.groupBy("_bucket").agg((F.max("_pack") + 1).alias("_packs")).orderBy("_bucket").collect()  # a row per bucket
    first = [0, *accumulate(int(row["_packs"]) for row in packs)]
    offsets = spark.createDataFrame([(row["_bucket"], n) for row, n in zip(packs, first)], "_bucket bigint, _first bigint")
    rows = numbered.join(F.broadcast(offsets), "_bucket").withColumn("_pack", (F.col("_first") + F.col("_pack")).cast("int"))
    return rows.repartitionById(max(1, first[-1]), "_pack").select(*listing.columns)


def files_from_tree(
    spark: SparkSession, root: str, work: str, ignored_dirs: Iterable[str] | None = None, pack_bytes: int = 64 << 20
) -> DataFrame:
    """A ``files`` table read from a tree: :func:`list_tree`, then the contents in equal shares."""
    return files_from_listing(packed(list_tree(spark, root, work, ignored_dirs), pack_bytes))
