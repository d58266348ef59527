"""One pass over the files: statistics, findings and errors of each file in its own row.

Every detector is a projection, so a scan needs no shuffle, runs the same on a stream, and a repository with a
large share of the files is spread over as many tasks as its bytes need. Columns nobody asks for are pruned:
``file_stats`` never starts the Python parser, ``asset`` rules alone never decode a text.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..catalog.rules import DEFAULT_RULES, Rule
from ..functions.layers import with_layers
from ..functions.paths import detect_language
from ..functions.sqltext import quote
from ..functions.text import count_nonblank_sql, plain_line_ends_sql, split_lines_sql
from ..operators.asset_rules import asset_columns
from ..operators.docker_rules import docker_columns
from ..operators.finding import NO_FINDINGS
from ..operators.loops import loop_columns
from ..operators.manifest_rules import manifest_columns
from ..operators.pyfacts import FIELDS, KINDS, syntax_facts
from ..operators.python_rules import python_columns
from ..operators.regex_rules import regex_columns
from ..sources.commits import Commits
from ..sources.corpus import prune_ignored_dirs, with_text


#: Column of a row's enabled rules, as bits in the order of the catalogue; null: all.
ENABLED = "_enabled_rules"


def keep_enabled(findings: str, rules: Sequence[Rule]) -> str:
    """The findings of enabled rules."""
    places = ", ".join(f"{quote(r.id)}, {n}" for n, r in enumerate(rules))
    if not places:
        return findings
    bit = (
        f"transform(array(element_at(map({places}), f.rule_id)), n -> "
        f"(shiftright(x[CAST(floor(n / 64) AS INT)], n % 64) & 1L) = 1L)[0]"
    )
    # the outer transform names the bitmap, so that it is no expression of its own for every finding
    return f"transform(array({ENABLED}), x -> IF(x IS NULL, {findings}, filter({findings}, f -> {bit})))[0]"


def _text_columns(rules: Sequence[Rule], profiled: bool = False) -> dict:
    """The columns of all detectors that read the text: they need ``language`` and ``_text``."""
    place = {r.id: n for n, r in enumerate(rules)}

    def enabled(rule: Rule) -> str:
        n = place[rule.id]
        return f"({ENABLED} IS NULL OR (shiftright({ENABLED}[{n // 64}], {n % 64}) & 1L) = 1L)"

    return {
        "_plain": plain_line_ends_sql("_text"),
        "_lines": split_lines_sql("_text", "_plain"),
        **docker_columns(rules),
        **regex_columns(rules, enabled if profiled else None),
        **loop_columns(any(r.id == "GC001" for r in rules)),
        **python_columns(rules),
    }


_DETECTED = ("_assets", "_docker", "_regex", "_loops", "_python", "_manifest")


def _code_lines():
    return F.expr(f"IF(_lines IS NULL, 0, {count_nonblank_sql('_lines')})")


def _status_sql(marked: bool, max_text_bytes: int | None) -> str:
    cases = ["WHEN NOT scanned THEN 'manifest only'"] if marked else []
    cases.append("WHEN _is_asset THEN 'asset'")
    if max_text_bytes is not None:
        cases.append(f"WHEN length > {int(max_text_bytes)} THEN 'over the limit'")
    cases += [
        "WHEN content IS NULL THEN 'no content'", "WHEN _text IS NULL THEN 'not UTF-8'",
        "WHEN language IS NULL THEN 'unknown language'",
    ]
    return f"CASE {' '.join(cases)} ELSE 'scanned' END"


def scan_files(
    files: DataFrame,
    rules: Iterable[Rule] = DEFAULT_RULES,
    ignored_dirs: Iterable[str] | None = None,
    max_text_bytes: int | None = None,
) -> DataFrame:
    """``repo_id, path, language, code_lines, bytes, findings, error, status`` per file of a ``files`` table.

    ``status`` says what was done with the text: ``scanned``, ``unknown language`` (only rules for any text apply),
    ``asset``, ``over the limit``, ``not UTF-8``, ``no content``, or ``manifest only`` (see below).

    Texts of any size are scanned, unless ``max_text_bytes`` says from where on they are only listed.

    Rows whose optional column ``scanned`` is false (see ``requested_files``) are read by the dependency rules only.
    The columns ``folder``, ``version`` and ``deleted`` are passed through.
    """
    rules = tuple(rules)
    df = with_text(prune_ignored_dirs(files, ignored_dirs), max_text_bytes)
    assets = asset_columns(rules)
    if "scanned" in files.columns:
        df = df.withColumn("_text", F.expr("IF(scanned, _text, NULL)"))
        assets = {"_assets": f"IF(scanned, {assets['_assets']}, {NO_FINDINGS})"}
    profiled = ENABLED in files.columns
    df = with_layers(df, {**assets, **manifest_columns(rules), **_text_columns(rules, profiled)})
    if profiled:
        df = df.withColumn("_found", F.concat(*_DETECTED))
        found = F.expr(keep_enabled("_found", rules))
    else:
        found = F.concat(*_DETECTED)
    return df.select(
        *(name for name in ("repo_id", "folder", "path", "version", "deleted", "scanned", "language") if name in df.columns),
        _code_lines().alias("code_lines"),
        F.col("length").cast("bigint").alias("bytes"),
        found.alias("findings"),
        F.col("_error").alias("error"),
        F.expr(_status_sql("scanned" in files.columns, max_text_bytes)).alias("status"),
    )


def scan_sources(sources: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """The same for texts held in a table ``(repo_id, name, source, language)``.

    No size, asset or manifest rule applies and the text is taken as it is. A null language is detected from the
    name, else Python.
    """
    df = sources.select(
        "repo_id",
        F.col("name").alias("path"),
        F.coalesce(F.col("language"), detect_language("name"), F.lit("python")).alias("language"),
        F.col("source").alias("_text"),
    )
    df = with_layers(df, _text_columns(tuple(rules)))
    return df.select(
        "repo_id",
        "path",
        "language",
        _code_lines().alias("code_lines"),
        F.octet_length("_text").cast("bigint").alias("bytes"),
        F.concat("_docker", "_regex", "_loops", "_python").alias("findings"),
        F.col("_error").alias("error"),
    )


def violations(scanned: DataFrame) -> DataFrame:
    """One row per finding: ``repo_id, rule_id, path, line, column, snippet, message, extra``."""
    # The outer form keeps the optimizer from pushing a size filter, and with it a second copy of every detector,
    # below the projections.
    rows = scanned.select("repo_id", "path", F.explode_outer("findings").alias("f")).filter(F.col("f").isNotNull())
    return rows.select(
        "repo_id", "f.rule_id", "path", "f.line", "f.column", "f.snippet", "f.message", "f.extra"
    )


def file_stats(scanned: DataFrame) -> DataFrame:
    if "scanned" in scanned.columns:
        scanned = scanned.filter("scanned")
    return scanned.select("repo_id", "path", "language", "code_lines", "bytes")


def errors(scanned: DataFrame) -> DataFrame:
    return scanned.filter(F.col("error").isNotNull()).select("repo_id", "path", F.col("error").alias("message"))


def python_nodes(
    files: DataFrame, ignored_dirs: Iterable[str] | None = None, kinds: Iterable[str] = KINDS, fields: Iterable[str] = FIELDS
) -> DataFrame:
    """The syntax facts as a table, one row per node; only the kinds and fields asked for leave the parser."""
    df = with_text(prune_ignored_dirs(files, ignored_dirs)).filter("language = 'python'")
    rows = df.select("repo_id", "path", syntax_facts(kinds, fields).alias("_facts"))
    return rows.select("repo_id", "path", F.explode_outer("_facts.nodes").alias("n")).filter("n IS NOT NULL").select(
        "repo_id", "path", "n.*"
    )


def write_bucketed(rows: DataFrame, path: str, buckets: int = 64, fmt: str = "parquet") -> None:
    """Writes rows in folders by repository bucket, so a reader of one repository opens one folder.

    The rebalance hint gathers each bucket into few files; a bucket with a hot repository is split again.
    """
    rows.withColumn("bucket", repo_bucket(buckets)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy(
        "bucket"
    ).format(fmt).save(path)


def repo_bucket(buckets: int):
    return F.pmod(F.xxhash64(F.col("repo_id").cast("string")), F.lit(buckets)).cast("int")


class Outputs:
    """Tables of one run, each written into a folder of its own and visible only after ``commit``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.commits, self.buckets = spark, Commits(spark, path), buckets
        self._folders: dict[str, list[str]] = {}
        self._schemas: dict[str, dict] = {}

    def _note(self, name: str, schema: StructType) -> str:
        folder = self.commits.folder(name)
        self._folders[name], self._schemas[name] = [folder], schema.jsonValue()
        return folder

    def store(self, name: str, rows: DataFrame) -> DataFrame:
        """Writes rows and reads them back, so what follows doesn't compute them again."""
        folder = self._note(name, rows.schema)
        rows.write.parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def write(self, tables: dict[str, DataFrame], fmt: str = "parquet") -> dict[str, DataFrame]:
        """Writes tables in folders by repository bucket and reads them back."""
        stored = {}
        for name, rows in tables.items():
            schema = StructType([*rows.schema.fields, StructField("bucket", IntegerType())])
            folder = self._note(name, schema)
            write_bucketed(rows, folder, self.buckets, fmt)
            stored[name] = self.spark.read.format(fmt).schema(schema).load(folder).select(*rows.columns)
        return stored

    def commit(self) -> int:
        return self.commits.commit(self._folders, {"schemas": self._schemas})


def scan_tables(stored: DataFrame) -> dict[str, DataFrame]:
    return {"file_stats": file_stats(stored), "violations": violations(stored), "errors": errors(stored)}


def write_tables(scanned: DataFrame, path: str, buckets: int = 64) -> int:
    """Writes ``scanned``, ``file_stats``, ``violations`` and ``errors`` as Parquet below ``path`` and commits them
    together; returns the version. The scan is written first and the tables are taken from it, so the sources are read once.
    Read a table with ``read_committed(spark, path, name)``."""
    outputs = Outputs(scanned.sparkSession, path, buckets)
    outputs.write(scan_tables(outputs.store("scanned", scanned)))
    return outputs.commit()
