"""Scores of a stream in which files arrive again, changed or deleted.

Each batch of a stream scans what arrived and adds two folders: the files it took over, and signed changes to the counts
per repository, language and rule (what the new version adds, less what the replaced one had added). A commit names the
folders that make up the tables, so a batch counts whole or not at all, and one that runs again finds itself
committed and does nothing. Counts are sums over the changes; from time to time both tables are written anew as one folder.

What a batch costs follows what arrived: it looks up only the replaced versions of its own files, in the repository
buckets they lie in, and never the contents of files that stay.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalog.dimensions import rules_df
from ..catalog.rules import CODE_LANGUAGES, DEFAULT_RULES, Rule
from ..functions.values import DEFAULT_K
from ..operators.finding import FINDING
from ..plans.scan import repo_bucket, scan_files, write_bucketed
from ..plans.scoring import finish_scores
from ..sources.commits import Commits

_KEY = ("bucket", "repo_id", "path")
_COUNTS = ("files", "code_lines", "findings")


def _last_versions(rows: DataFrame) -> DataFrame:
    """The last row of each file: the highest version, of equal ones the one that came last, then any fixed one."""
    order = Window.partitionBy("repo_id", "path").orderBy(
        F.desc_nulls_last("version"), F.desc("arrival"), F.desc("deleted"), F.desc("bytes"), F.xxhash64(F.to_json("findings"), "error")
    )
    return rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def _changes(rows: DataFrame, sign: int) -> DataFrame:
    """What files add to the counts (or take from them): a row per file and one per finding, summed by the caller."""
    there = rows.filter("NOT deleted")
    per_file = there.select(
        "repo_id", "language", F.lit(None).cast("string").alias("rule_id"), F.lit(sign).alias("files"),
        (F.col("code_lines") * sign).alias("code_lines"), F.lit(0).alias("findings"),
    )
    per_finding = there.select("repo_id", F.explode("findings.rule_id").alias("rule_id")).select(
        "repo_id", F.lit(None).cast("string").alias("language"), "rule_id", F.lit(0).alias("files"),
        F.lit(0).alias("code_lines"), F.lit(sign).alias("findings"),
    )
    return per_file.unionByName(per_finding)


def _summed(changes: DataFrame) -> DataFrame:
    sums = changes.groupBy("repo_id", "language", "rule_id").agg(*(F.sum(c).cast("bigint").alias(c) for c in _COUNTS))
    return sums.filter(" OR ".join(f"{c} <> 0" for c in _COUNTS))


def _load(spark: SparkSession, folders: list[str], schema) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    parts = [spark.read.schema(schema).parquet(f) for f in folders]  # each folder has bucket folders of its own
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class Revisions:
    """The tables of one output folder. ``files`` keeps every version until it is compacted, ``changes`` sums to the counts."""

    def __init__(self, spark: SparkSession, output: str, buckets: int = 16):
        self.spark = spark
        self.commits = Commits(spark, output)
        # files are looked up by bucket, so the first run's number holds for good
        self.buckets = self._info().get("buckets", buckets)

    def _table(self, name: str, schema: str, tables: dict[str, list[str]] | None = None) -> DataFrame:
        return _load(self.spark, (self.commits.read() if tables is None else tables).get(name, []), schema)

    def files_schema(self, key_type: str) -> str:
        return (
            f"repo_id {key_type}, path string, version bigint, deleted boolean, language string, code_lines int, bytes bigint, "
            f"findings array<{FINDING}>, error string, status string, arrival bigint, bucket int"
        )

    def _info(self) -> dict:
        return self.commits.info()

    def apply(self, batch: DataFrame, rules: Iterable[Rule], source: str, number: int) -> bool:
        """Takes over one batch; False if this batch of this source is already in. ``batch`` has the columns of ``scan_files``'s
        input, ``version`` and, if files can go, ``deleted``."""
        info = self._info()
        if info.get("batches", {}).get(source, -1) >= number:
            return False
        tables = self.commits.read()
        key_type = batch.schema["repo_id"].dataType.simpleString()
        schema = self.files_schema(key_type)
        arrival = info.get("arrival", -1) + 1
        if "deleted" not in batch.columns:
            batch = batch.withColumn("deleted", F.lit(False))
        batch = batch.withColumns({
            "version": F.col("version").cast("bigint"), "deleted": F.coalesce("deleted", F.lit(False))
        })
        scanned = scan_files(batch, rules).withColumn("arrival", F.lit(arrival).cast("bigint"))
        fresh = _last_versions(scanned).withColumn("bucket", repo_bucket(self.buckets))
        before = self._table("files", schema, tables)
        keys = batch.select("repo_id", "path").withColumn("bucket", repo_bucket(self.buckets)).distinct()
        known = before.join(keys, list(_KEY), "left_semi").groupBy(*_KEY).agg(F.max("version").alias("_known"))
        newer = F.col("_known").isNull() | (F.coalesce("version", F.lit(-(1 << 63))) >= F.col("_known"))
        taken = fresh.join(known, list(_KEY), "left").filter(newer)
        folder = self.commits.folder("files")
        write_bucketed(taken.drop("_known", "bucket"), folder, self.buckets)
        stored = _load(self.spark, [folder], schema)
        replaced = _last_versions(before.join(stored.select(*_KEY), list(_KEY), "left_semi"))
        changed = self.commits.folder("changes")
        write_bucketed(_summed(_changes(stored, 1).unionByName(_changes(replaced, -1))), changed, self.buckets)
        self.commits.commit(
            {"files": [*tables.get("files", []), folder], "changes": [*tables.get("changes", []), changed]},
            {"arrival": arrival, "key": key_type, "buckets": self.buckets, "batches": {**info.get("batches", {}), source: number}},
        )
        return True

    def files(self) -> DataFrame:
        """The scan of the last version of every file that was not deleted."""
        return self._all_last().filter("NOT deleted").drop("deleted", "arrival", "bucket")

    def _all_last(self) -> DataFrame:
        return _last_versions(self._table("files", self.files_schema(self._info().get("key", "string"))))

    def counts(self) -> DataFrame:
        """``repo_id, language, rule_id, files, code_lines, findings``: files by language (no rule), findings by rule (no language)."""
        key_type = self._info().get("key", "string")
        return _summed(self._table(
            "changes",
            f"repo_id {key_type}, language string, rule_id string, files bigint, code_lines bigint, findings bigint, bucket int",
        ))

    def compact(self) -> int:
        """Both tables as one folder each: last versions only (deleted ones too, so that an older version that comes late
        stays out) and summed counts. Readers of earlier commits go on; ``commits.vacuum`` deletes what none needs."""
        files, changes = self.commits.folder("files"), self.commits.folder("changes")
        write_bucketed(self._all_last().drop("bucket"), files, self.buckets)
        write_bucketed(self.counts(), changes, self.buckets)
        return self.commits.commit({"files": [files], "changes": [changes]}, self._info())


def start_scores(
    files: DataFrame, output: str, checkpoint: str, rules: Iterable[Rule] = DEFAULT_RULES, compact_every: int = 20,
    buckets: int = 16,
) -> StreamingQuery:
    """Keeps the scans and counts of a stream of files up to date below ``output``.

    A file is known by ``repo_id`` and ``path``; the row with the highest ``version`` holds, whenever it arrives, and of
    equal versions the one that arrives last. A row with ``deleted`` takes the file out. ``buckets`` is that of the first
    run. After ``compact_every`` batches the tables are written anew. Read with :func:`current_scores`,
    :func:`current_counts` and :func:`current_files`.
    """
    rules = tuple(rules)

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        source = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        revisions = Revisions(spark, output, buckets)
        revisions.apply(batch, rules, source, number)
        if len(revisions.commits.read()["files"]) > compact_every:
            revisions.compact()

    return (
        files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_files(spark: SparkSession, output: str) -> DataFrame:
    """The scan of every file as it is now, like that of ``scan_files``."""
    return Revisions(spark, output).files()


def current_counts(spark: SparkSession, output: str) -> DataFrame:
    """Files and lines per repository and language, findings per repository and rule, as they are now."""
    return Revisions(spark, output).counts()


def current_scores(
    spark: SparkSession, output: str, rules: Iterable[Rule] = DEFAULT_RULES, k: float = DEFAULT_K
) -> DataFrame:
    """Scores of the repositories that have files now, from the counts alone; equal to those of a scan of the last versions."""
    severity = F.broadcast(rules_df(spark, rules).select("rule_id", "severity"))  # the catalogue
    counted = current_counts(spark, output).join(severity, "rule_id", "left")
    is_code = F.coalesce(F.col("language").isin(*CODE_LANGUAGES), F.lit(False))
    total = lambda value, name: F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias(name)
    totals = counted.groupBy("repo_id").agg(
        total(F.col("files"), "total_files"), total(F.when(is_code, F.col("files")), "code_files"),
        total(F.when(is_code, F.col("code_lines")), "total_code_lines"), total(F.col("findings"), "total_violations"),
        total(F.col("findings") * F.col("severity"), "penalty"),
    )
    return finish_scores(totals.filter("total_files > 0"), k)
