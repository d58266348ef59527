"""Outputs of several tables that become visible at once.

Every run writes into folders of its own below a root and then adds one small file to ``_commits`` that names the folders
of each table. The file is written under a hidden name and renamed, so it is there whole or not at all. Readers
take the folders of the highest commit: a run that failed half-way, or is still writing, is never seen, and a reader
that began before a commit goes on with the folders it knows.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_COMMIT = re.compile(r"(\d{20})\.json")


class Commits:
    """The committed versions below ``root``, a path of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def folder(self, table: str) -> str:
        """A folder that no other run uses, for one table of the run that asks."""
        return f"{self.root}/{table}/{uuid.uuid4().hex}"

    def versions(self) -> list[int]:
        """Numbers of all commits, ascending."""
        fs, folder = self._files(), self._path(f"{self.root}/_commits")
        if not fs.exists(folder):
            return []
        names = (_COMMIT.fullmatch(s.getPath().getName()) for s in fs.listStatus(folder))
        return sorted(int(m[1]) for m in names if m)

    def read(self, version: int | None = None) -> dict[str, list[str]]:
        """The folders of each table in a commit, by default the last; empty where there is none."""
        tables = self._content(version).get("tables", {})
        return {table: [f"{self.root}/{f}" for f in folders] for table, folders in tables.items()}

    def info(self, version: int | None = None) -> dict:
        """What the run noted in its commit, by default in the last one."""
        return self._content(version).get("info", {})

    def _content(self, version: int | None) -> dict:
        if version is None:
            version = max(self.versions(), default=None)
        if version is None:
            return {}
        stream = self._files().open(self._path(self._file(version)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _file(self, version: int) -> str:
        return f"{self.root}/_commits/{version:020d}.json"

    def commit(self, tables: dict[str, list[str]], info: dict | None = None, version: int | None = None) -> int:
        """Makes these folders the last version, by default one above the highest, with a note. Raises ``FileExistsError`` if
        another run took that number meanwhile."""
        if version is None:
            version = max(self.versions(), default=-1) + 1
        fs, target = self._files(), self._path(self._file(version))
        draft = self._path(f"{self.root}/_commits/.{uuid.uuid4().hex}")
        short = {table: [f.removeprefix(f"{self.root}/") for f in folders] for table, folders in tables.items()}
        out = fs.create(draft)
        try:
            out.write(bytearray(json.dumps({"tables": short, "info": info or {}}).encode()))
        finally:
            out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise FileExistsError(f"version {version} of {self.root} is already committed")
        return version

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes commits before the last ``keep`` and the folders that only they name; a run that failed leaves folders that
        no commit names, which go too once they lie below a table of a commit. Don't run it while another run writes."""
        if keep < 1:
            raise ValueError("the last commit must stay")
        fs, versions = self._files(), self.versions()
        used = {f for v in versions[-keep:] for folders in self.read(v).values() for f in folders}
        tables = {table for v in versions for table in self.read(v)}
        gone = []
        for table in sorted(tables):
            parent = self._path(f"{self.root}/{table}")
            for status in fs.listStatus(parent) if fs.exists(parent) else []:
                folder = f"{self.root}/{table}/{status.getPath().getName()}"
                if folder not in used:
                    fs.delete(status.getPath(), True)
                    gone.append(folder)
        for v in versions[:-keep]:
            fs.delete(self._path(self._file(v)), False)
        return gone


def read_committed(spark: SparkSession, root: str, table: str, version: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A table of the last commit (or of a given one) below ``root``, with the schema noted there: a table without rows has
    no file that could tell it."""
    commits = Commits(spark, root)
    if version is None:
        version = max(commits.versions(), default=None)
    folders = commits.read(version).get(table)
    if not folders:
        raise FileNotFoundError(f"no commit below {root} has a table {table!r}")
    reader = spark.read.format(fmt)
    noted = commits.info(version).get("schemas", {}).get(table)
    if noted:
        reader = reader.schema(StructType.fromJson(noted))
    return reader.load(folders)
