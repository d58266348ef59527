"""What is let in: snippets, repositories within limits, and requests without a repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE

# Usual limits of the admission checks (none applies unless it is passed), languages of snippets.
MAX_SNIPPET_BYTES = 200_000
MAX_REPO_FILES = 6_000
MAX_REPO_BYTES = 200 * 1024 * 1024
MAX_ARCHIVE_BYTES = 30 * 1024 * 1024
SNIPPET_LANGUAGES = (
    "python", "javascript", "typescript", "java", "c", "cpp", "csharp", "go", "ruby", "php", "sql", "css", "html",
)


def admit_snippets(snippets: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """All ``(name, source, language)`` rows with ``admitted`` and, if not, the ``reason``: blank (or null), or larger than
    ``max_bytes`` where given. A language that can't be scanned becomes Python."""
    source, language = F.col("source"), F.btrim(F.coalesce("language", F.lit("python")), F.lit(WHITESPACE))
    reason = F.when(F.btrim(F.coalesce(source, F.lit("")), F.lit(WHITESPACE)) == "", "blank")
    if max_bytes is not None:
        reason = reason.when(F.octet_length(source) > max_bytes, "too large")
    return snippets.withColumns({
        "language": F.when(language.isin(*SNIPPET_LANGUAGES), language).otherwise("python"),
        "admitted": reason.isNull(),
        "reason": reason,
    })


def is_unsafe_path(path: Column) -> Column:
    """Absolute paths and paths with a parent segment."""
    return path.startswith("/") | F.exists(F.split(path, "/"), lambda segment: segment == "..")


def admit_repos(
    files: DataFrame,
    max_files: int | None = None,
    max_bytes: int | None = None,
    max_archive_bytes: int | None = None,
) -> DataFrame:
    """One row per repository: files and bytes of its safe regular files and whether it stays within the limits given.

    Optional columns ``is_regular`` (false for links and devices) and ``archive_bytes`` (compressed size of the
    repository) are used when present.
    """
    safe = ~is_unsafe_path(F.col("path"))
    if "is_regular" in files.columns:
        safe = safe & F.col("is_regular")
    archive = F.max("archive_bytes") if "archive_bytes" in files.columns else F.lit(None).cast("bigint")
    totals = files.groupBy("repo_id").agg(
        F.count_if(safe).alias("files"),
        F.coalesce(F.sum(F.when(safe, F.col("length"))), F.lit(0)).cast("bigint").alias("bytes"),
        archive.alias("_archive"),
    )
    limits = (
        ("_archive", max_archive_bytes, "archive too large"), ("files", max_files, "too many files"),
        ("bytes", max_bytes, "too large"),
    )
    reason = F.coalesce(F.lit(None).cast("string"), *(
        F.when(F.col(name) > limit, text) for name, limit, text in limits if limit is not None
    ))
    return totals.select("repo_id", "files", "bytes", reason.isNull().alias("admitted"), reason.alias("reason"))


def admitted_files(
    files: DataFrame, max_files: int | None = None, max_bytes: int | None = None, max_archive_bytes: int | None = None,
    broadcast_repos: int = 500_000,
) -> DataFrame:
    """The safe regular files of the repositories that :func:`admit_repos` lets in, as rows of ``files``.

    The verdicts come from names and lengths alone. Up to ``broadcast_repos`` admitted repositories are broadcast, so contents
    are read where they lie, those of other repositories not at all, and none is shuffled. Beyond that Spark joins both
    sides; then pass a listing (``list_tree``), whose rows are narrow, and read the files of the result.
    """
    names = [c for c in ("repo_id", "path", "length", "is_regular", "archive_bytes") if c in files.columns]
    verdicts = admit_repos(files.select(*names), max_files, max_bytes, max_archive_bytes)
    admitted = verdicts.filter("admitted").select("repo_id")
    if admitted.limit(broadcast_repos + 1).count() <= broadcast_repos:
        admitted = F.broadcast(admitted)
    safe = ~is_unsafe_path(F.col("path"))
    if "is_regular" in files.columns:
        safe = safe & F.col("is_regular")
    return files.filter(safe).join(admitted, "repo_id", "left_semi").select(*files.columns)


def missing_repo_errors(requested: DataFrame, files: DataFrame) -> DataFrame:
    """An error row per requested repository that has no file.

    The files shrink to one row per repository before the join, so a repository with a huge share of them does
    not weigh on one task.
    """
    present = files.select("repo_id").groupBy("repo_id").agg(F.lit(True).alias("_present"))
    return (
        requested.select("repo_id").distinct().join(present, "repo_id", "left_anti")
        .select("repo_id", F.lit(None).cast("string").alias("path"),
                F.concat(F.lit("No such repository: "), F.col("repo_id").cast("string")).alias("message"))
    )
