"""The ``files`` table: one row per file with repository, path, length and content."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.layers import with_layers
from ..functions.paths import base_name_sql, extension_sql, is_ignored_path, language_of_name_sql
from ..functions.text import universal_newlines_sql
from ..operators.asset_rules import IS_ASSET
from ..operators.manifest_rules import is_package_json_sql, is_requirements_sql

# Scheme and slashes of a URI, which a path keeps only one slash of.
_SCHEME = r"\A[a-z0-9]+:/{1,3}"
FILES_SCHEMA = "repo_id string, path string, length bigint, content binary"


def read_corpus(spark: SparkSession, table: str) -> DataFrame:
    """A ``files`` table in Parquet (``content`` string or binary)."""
    return spark.read.parquet(table).select("repo_id", "path", "length", "content")


def files_from_binary(spark: SparkSession, paths: list[str], root: str) -> DataFrame:
    """Files read directly. ``root`` is the folder that holds one folder per repository, as a path or URI.

    Spark's recursive listing hides names that start with a dot or an underscore; ``files_from_listing`` reads those
    too.
    """
    loaded = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    )
    below = F.regexp_replace(F.col("path"), _SCHEME, "/")
    prefix = "/" + re.sub(_SCHEME, "/", root).strip("/") + "/"
    inner = F.when(F.startswith(below, F.lit(prefix)), F.substring(below, F.lit(len(prefix) + 1), F.length(below)))
    return loaded.select(
        F.regexp_extract(inner, r"\A([^/]*)/", 1).alias("repo_id"),
        F.regexp_replace(inner, r"\A[^/]*/", "").alias("path"),
        "length",
        "content",
    )


def prune_ignored_dirs(files: DataFrame, ignored_dirs: Iterable[str] | None = None) -> DataFrame:
    return files.filter(~is_ignored_path("path", ignored_dirs))


def requested_files(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Single-file mode for any number of requests ``(repo_id, path)``.

    Each requested file comes with its path relative to its folder (``scanned``), and the folder's manifests come
    along once for the dependency rules. Requests only filter the files (semi joins), so many requests in one folder
    do not multiply its manifests.
    """
    folder = F.regexp_extract("path", r"(?s)\A(.*/)?", 0)
    name = F.expr(base_name_sql("path"))
    wanted = requests.select("repo_id", "path").distinct()
    folders = wanted.select("repo_id", folder.alias("folder")).distinct()
    placed = files.withColumns({"folder": folder, "name": name})
    scanned = placed.join(wanted, ["repo_id", "path"], "left_semi").withColumn("scanned", F.lit(True))
    manifests = (
        placed.filter(f"{is_requirements_sql('name')} OR {is_package_json_sql('name')}")
        .join(folders, ["repo_id", "folder"], "left_semi")
        .join(wanted, ["repo_id", "path"], "left_anti")
        .withColumn("scanned", F.lit(False))
    )
    return scanned.unionByName(manifests).select(
        "repo_id", "folder", F.col("name").alias("path"), "length", "content", "scanned"
    )


def decode_text_sql(content: str) -> str:
    raw = f"CAST({content} AS STRING)"
    return f"IF(is_valid_utf8({raw}), {universal_newlines_sql(raw)}, NULL)"


def decode_text(content: str) -> Column:
    r"""Text of a file, null when it is not UTF-8. Line ends become ``\n``."""
    return F.expr(decode_text_sql(content))


def text_columns(max_text_bytes: int | None = None) -> dict[str, str]:
    """``_text`` and what it needs. Assets and files over the limit, if any, keep a null text; assets have no language."""
    over = "" if max_text_bytes is None else f" OR length > {int(max_text_bytes)}"
    return {
        "_name": f"lower({base_name_sql('path')})",
        "_ext": extension_sql("path"),
        "_is_asset": IS_ASSET,
        "_language": f"IF(_is_asset, NULL, {language_of_name_sql('_name', '_ext')})",
        "_text": f"IF(_is_asset{over}, NULL, {decode_text_sql('content')})",
    }


def with_text(files: DataFrame, max_text_bytes: int | None = None) -> DataFrame:
    """Adds ``language`` and ``_text``."""
    return with_layers(files, text_columns(max_text_bytes)).withColumnRenamed("_language", "language")
