"""Every registered query: a name and a function of (session, table folder).

Queries read whole tables. Their DuckDB counterparts are in :mod:`workloads.oracles`.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import codefootprint as cf
from codefootprint.catalog import DEFAULT_RULES, HEAVY_DEPENDENCIES, Rule, rules_df, rules_from_table, select_rules
from codefootprint.functions import count_code_lines, detect_language, human_size, mask_code, split_lines, strip_comments
from codefootprint.operators.manifest_rules import package_entries, requirement_entries
from codefootprint.operators.python_rules import PYTHON_RULE_IDS
from codefootprint.operators.regex_rules import regex_rules
from codefootprint.sources.admission import MAX_ARCHIVE_BYTES, MAX_REPO_BYTES, MAX_REPO_FILES, MAX_SNIPPET_BYTES
from codefootprint.streaming import current_totals, start_scan, start_usage_totals, usage_totals

from . import corpora as C

Query = Callable[[SparkSession, str], DataFrame]

MIN_SCORE = 60.0
REGEX_IDS = tuple(r.id for r in regex_rules(DEFAULT_RULES))
DOCKER_IDS = ("GC080", "GC081", "GC082", "GC083", "GC084")
PYTHON_AST_IDS = tuple(i for i in PYTHON_RULE_IDS if i != "GC001")
SUBSET = ("GC001", "GC011", "GC030", "GC082", "GC999")
CUSTOM_RULES = (
    Rule("XX001", "Bare except value", "compute", 5, languages=("python",), pattern=r"\bfor\s+\w+\s+in\b"),
    Rule("XX002", "Anything with a star", "other", 2, pattern=r"\*", require_absent=r"import"),
)
#: Line rules on prose and web pages, with and without a literal in their patterns.
FREE_TEXT_RULES = tuple(
    Rule(f"FT{i:03}", name, "other", 1, languages=("html",), pattern=pattern, require_absent=absent, ignore_case=fold)
    for i, (name, pattern, absent, fold) in enumerate((
        ("Noun in tion", r"[a-z]tion[ .,<]", None, False), ("Link", r"<a +href", None, True), ("Long number", r"[0-9]{3,}", r"http", False),
        ("Run of symbols", r"[#$%&*]{3}", None, False), ("Mail address", r"[a-z0-9.]+@[a-z0-9]+[.][a-z]+", None, True),
        ("Umlaut before e", r"[äöüß]e", None, True), ("Sentence in one word", r"^ *[A-Z][a-z]+[.]", None, False),
    ), 1)
)
PROFILE_CATEGORIES = ("network", "data")
#: Files whose trees are on the disk at once, and the waves from which on trees grow instead, as each reads all keys.
WAVE_FILES, TREE_WAVES = 125_000, 48
PATHS = (
    "Dockerfile", "api.Dockerfile", "Dockerfile.dev", ".env", "prod.env", "a.tar.gz", ".bashrc.py", "MAIN.PY",
    "page.Vue", "style.scss", "notes", "a.b.tsx", "x.", "dockerfile.d/readme", "k.kt", "conf.cfg",
)
SNIPPET_LANGUAGES = ("python", "sql", "cobol", " go ", None)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's checkpoint folder, which the cluster shares. Only where none is configured and
    Spark runs in one process, as in tests, it lies in the working directory."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    shared = shared or "spark-warehouse/checkpoints"
    return f"{shared.rstrip('/')}/codefootprint/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ building blocks
def places(found: DataFrame) -> DataFrame:
    return found.select("repo_id", "rule_id", "path", "line")


def detailed(found: DataFrame) -> DataFrame:
    return found.select("repo_id", "rule_id", "path", "line", F.col("column").alias("col"), "snippet")


def code_findings(rule_ids: tuple[str, ...], shape, spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape(cf.violations(cf.scan_files(C.code(spark, sf_dir), select_rules(rule_ids))))


def docker_findings(rule_ids: tuple[str, ...], spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cf.violations(cf.scan_files(C.dockerfiles(spark, sf_dir), select_rules(rule_ids)))
    return found.select("repo_id", "rule_id", "path", "line", "snippet")


def asset_findings(rule_id: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cf.violations(cf.scan_files(C.assets(spark, sf_dir), select_rules((rule_id,))))
    return found.select("repo_id", "rule_id", "path", "line", "snippet", F.col("extra")["bytes"].alias("bytes"))


def manifest_findings(rule_id: str, name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    files = C.manifests(spark, sf_dir).filter(F.col("path").contains(name))
    found = cf.violations(cf.scan_files(files, select_rules((rule_id,))))
    return found.select("repo_id", "rule_id", "path", "line", "snippet")


def ready(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return C.finding_stats(spark, sf_dir), C.findings(spark, sf_dir)


# ------------------------------------------------------------------ sources
def scan_corpus(spark, sf_dir):
    return cf.file_stats(cf.scan_files(C.text_volume(spark, sf_dir)))


def prune_ignored_dirs(spark, sf_dir):
    return cf.prune_ignored_dirs(C.code(spark, sf_dir)).select("repo_id", "path", "length")


def scan_listing(spark, sf_dir):
    """The code corpus written as a tree of files, hidden and ignored folders included, then listed, read and scanned.

    A file takes a block of the disk however small it is, so the trees of all repositories at once would take many times
    their bytes. Repositories come in waves; what was read of a wave's tree is stored and its files removed before the next.
    Its empty folders are removed while the next is written and read, as that only waits for the file system.
    All that was read is scanned at once, as the plan of a scan takes longer to make than a wave's files to scan.
    """
    folder = work_folder(spark, "tree")
    root = folder if "://" in folder else f"file://{os.path.abspath(folder)}"
    files = C.code(spark, sf_dir)
    waves = min(TREE_WAVES, 1 + files.count() // WAVE_FILES)
    with ThreadPoolExecutor(1) as behind:
        removed = None
        for k in range(waves):
            tree = f"{root}/files/{k}"
            C.write_tree(files.filter(C.wave_of("repo_id", waves) == k), tree)
            read = cf.files_from_tree(spark, tree, f"{root}/work/{k}", pack_bytes=1 << 20)
            read.write.parquet(f"{folder}/read/{k}")
            if k + 1 < waves:
                C.next_root(tree, f"{root}/files/{k + 1}")
            C.remove_files(spark, tree)
            if removed:
                removed.result()  # the folders of two trees at most
            removed = behind.submit(C.remove_folders, tree)
        removed.result()
    read = spark.read.parquet(*(f"{folder}/read/{k}" for k in range(waves)))
    return cf.file_stats(cf.scan_files(read)).withColumn("repo_id", F.col("repo_id").cast("bigint"))


def admitted_files(spark, sf_dir):
    """Members of the repositories within the limits, with their contents."""
    members = C.archives(spark, sf_dir).withColumn("content", F.concat(F.lit("text of "), "path"))
    kept = cf.admitted_files(members, MAX_REPO_FILES, MAX_REPO_BYTES, MAX_ARCHIVE_BYTES)
    return kept.select("repo_id", "path", "length", F.md5("content").alias("digest"))


def scan_single_file(spark, sf_dir):
    files = C.manifests(spark, sf_dir)
    requests = files.filter(F.col("path").contains("package")).select("repo_id", "path")
    scanned = cf.scan_files(cf.requested_files(files, requests), select_rules(("GC051", "GC052")))
    return scanned.select("repo_id", "folder", "path", "scanned", "language", F.size("findings").alias("findings"))


def scan_source_table(spark, sf_dir):
    sources = C.code(spark, sf_dir).select(
        "repo_id", F.col("path").alias("name"), F.col("content").alias("source"), F.lit(None).cast("string").alias("language")
    )
    return places(cf.violations(cf.scan_sources(sources)))


def admit_snippets(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    source = (
        F.when(F.col("doc_id") % 5 == 0, " \n\t ")
        .when(F.col("doc_id") % 7 == 0, F.repeat(F.concat("text", F.lit("è")), 200))
        .otherwise(F.col("text"))
    )
    snippets = docs.select(
        F.col("doc_id").alias("name"), source.alias("source"), C.pick(SNIPPET_LANGUAGES, F.col("doc_id") % 5).alias("language")
    )
    return cf.admit_snippets(snippets, max_bytes=MAX_SNIPPET_BYTES).select(
        "name", "language", F.octet_length("source").cast("bigint").alias("bytes"), "admitted", "reason"
    )


def missing_repo_errors(spark, sf_dir):
    supplier = C.table(spark, sf_dir, "supplier")
    requested = supplier.select((F.col("s_suppkey") * 3).alias("repo_id"))
    return cf.missing_repo_errors(requested, C.assets(spark, sf_dir))


def decode_text(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    windows = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    content = (
        F.when(F.col("doc_id") % 3 == 1, F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("C3"))))
        .when(F.col("doc_id") % 3 == 2, F.encode(windows, "utf-8"))
        .otherwise(F.encode("text", "utf-8"))
    )
    decoded = docs.withColumn("content", content).select("doc_id", cf.decode_text("content").alias("text"))
    return decoded.select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def size_cutoff(spark, sf_dir):
    files = C.assets(spark, sf_dir).withColumn("content", F.lit("a\n\n  \nb\n"))
    return cf.scan_files(files, max_text_bytes=2 * 1024 * 1024).select(
        "repo_id", "path", "language", "code_lines", "bytes", "status"
    )


def admit_repos(spark, sf_dir):
    return cf.admit_repos(C.archives(spark, sf_dir), MAX_REPO_FILES, MAX_REPO_BYTES, MAX_ARCHIVE_BYTES)


def normalize_targets(spark, sf_dir):
    return cf.normalize_targets(C.targets(spark, sf_dir)).select("page_id", "shape", "owner", "repo")


# ------------------------------------------------------------------ scalar functions
def detect_language_query(spark, sf_dir):
    path = F.concat(F.lit("d/"), C.text(F.col("l_orderkey")), F.lit("/"), C.pick(PATHS, F.col("l_partkey") % len(PATHS)))
    return C.table(spark, sf_dir, "lineitem").select(path.alias("path")).withColumn("language", detect_language("path"))


def count_code_lines_query(spark, sf_dir):
    files = C.text_volume(spark, sf_dir)
    return files.select("repo_id", "path", count_code_lines("content").alias("code_lines"))


def explode_lines(spark, sf_dir):
    files = C.text_volume(spark, sf_dir)
    lines = files.select("repo_id", "path", F.posexplode(split_lines("content")).alias("pos", "text"))
    return lines.select("repo_id", "path", (F.col("pos") + 1).alias("line"), "text")


def strip_comments_query(spark, sf_dir):
    return C.code(spark, sf_dir).withColumn("language", detect_language("path")).select("path", strip_comments("content", "language").alias("text"))


def mask_code_query(spark, sf_dir):
    return C.code(spark, sf_dir).withColumn("language", detect_language("path")).select("path", mask_code("content", "language").alias("text"))


def human_size_query(spark, sf_dir):
    length = F.pow(F.col("l_extendedprice") / 100, F.col("l_linenumber") % 4 + 1).cast("bigint")
    return C.table(spark, sf_dir, "lineitem").select(length.alias("length")).withColumn("label", human_size("length"))


def label_violations(spark, sf_dir):
    return cf.label_violations(C.findings(spark, sf_dir)).select(
        "repo_id", "rule_id", "path", "line", "severity_label", "category_label"
    )


def grade_scores(spark, sf_dir):
    scores = C.table(spark, sf_dir, "events").select("event_id", F.col("value").alias("score"))
    return cf.grade_scores(scores)


def impact_estimate(spark, sf_dir):
    penalties = C.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("penalty")
    )
    return cf.impact_estimate(penalties)


# ------------------------------------------------------------------ Python facts
def py_nodes(spark, sf_dir):
    nodes = cf.python_nodes(C.code(spark, sf_dir))
    return nodes.withColumn("decorators", F.array_join("decorators", ","))


def py_node_stats(spark, sf_dir):
    def kinds(*names):
        return F.count_if(F.col("kind").isin(*names))

    return cf.python_nodes(C.code(spark, sf_dir)).groupBy("path").agg(
        kinds("For", "AsyncFor", "While").alias("loops"),
        kinds("Call").alias("calls"),
        kinds("FunctionDef", "AsyncFunctionDef").alias("functions"),
    )


def py_syntax_errors(spark, sf_dir):
    return cf.errors(cf.scan_files(C.code(spark, sf_dir), ())).select(
        "repo_id", "path", F.col("message").startswith("Python syntax error").alias("is_syntax_error")
    )


def gc001(clike: bool, spark, sf_dir):
    found = cf.violations(cf.scan_files(C.code(spark, sf_dir), select_rules(("GC001",))))
    return places(found.filter((detect_language("path") != "python") == F.lit(clike)))


# ------------------------------------------------------------------ manifests
def requirement_entries_query(spark, sf_dir):
    return requirement_entries(C.manifests(spark, sf_dir))


def package_entries_query(spark, sf_dir):
    return package_entries(C.manifests(spark, sf_dir)).select("repo_id", "path", "section", "name", "version")


def dependency_line(spark, sf_dir):
    return package_entries(C.manifests(spark, sf_dir)).select("repo_id", "name", "line", "text")


# ------------------------------------------------------------------ scans as a whole
def all_violations(spark, sf_dir):
    return places(cf.violations(cf.scan_files(C.code(spark, sf_dir))))


def free_text_rules(spark, sf_dir):
    """Line rules over the whole texts of documents and pages."""
    found = cf.violations(cf.scan_files(C.text_volume(spark, sf_dir), FREE_TEXT_RULES))
    return found.select("repo_id", "rule_id", "path", "line", F.col("column").alias("col"))


def code_file_stats(spark, sf_dir):
    return cf.file_stats(cf.scan_files(C.code(spark, sf_dir)))


def scan_scores(spark, sf_dir):
    scores = cf.scan_scores(cf.scan_files(C.code(spark, sf_dir)))
    return scores.select(
        "repo_id", "total_files", "code_files", "total_code_lines", "total_violations", "penalty",
        F.round("density", 6).alias("density"), "score", "grade",
    )


def custom_rules(spark, sf_dir):
    return places(cf.violations(cf.scan_files(C.code(spark, sf_dir), CUSTOM_RULES, ignored_dirs={"src3"})))


def profiles(spark, sf_dir):
    """Rules and weight of the repositories whose owner chose some: all, two categories, own rules only, or none."""
    chosen = [r.id for r in DEFAULT_RULES if r.category in PROFILE_CATEGORIES]
    own = [r.id for r in CUSTOM_RULES]
    ids = lambda names: F.array(*(F.lit(n) for n in names)).cast("array<string>")
    users = C.table(spark, sf_dir, "events").select(F.col("user_id").alias("repo_id")).distinct().filter("repo_id % 5 <> 0")
    rule_ids = F.when(F.col("repo_id") % 4 == 1, ids(chosen)).when(F.col("repo_id") % 4 == 2, ids([*own, "GC999"]))
    return users.select(
        "repo_id", rule_ids.when(F.col("repo_id") % 4 == 3, ids([])).alias("rule_ids"), (1 + F.col("repo_id") % 3 * 0.5).alias("k")
    )


def profile_scan(broadcast: int, spark, sf_dir):
    rules = rules_from_table(rules_df(spark, DEFAULT_RULES + CUSTOM_RULES))
    chosen = profiles(spark, sf_dir)
    return rules, chosen, cf.scan_profiles(C.code(spark, sf_dir), chosen, rules, broadcast_profiles=broadcast)


def profiled_violations(broadcast: int, spark, sf_dir):
    return places(cf.violations(profile_scan(broadcast, spark, sf_dir)[2]))


def profiled_scores(spark, sf_dir):
    rules, chosen, scanned = profile_scan(10_000, spark, sf_dir)
    return cf.profile_scores(scanned, chosen, rules).select(
        "repo_id", "total_files", "total_violations", "penalty", F.round("density", 6).alias("density"), "score", "grade"
    )


def scan_requested(spark, sf_dir):
    """Scores of requested repositories, with and without files."""
    requested = C.table(spark, sf_dir, "events").select((F.col("user_id") * 2).alias("repo_id"))
    code = C.code(spark, sf_dir)
    scores = cf.scan_scores(cf.scan_files(code.join(requested.distinct(), "repo_id", "left_semi")), requested=requested)
    return scores.select("repo_id", "total_files", "penalty", "score", "grade")


# ------------------------------------------------------------------ joins, scores, reports on ready findings
def join_rules_inner(spark, sf_dir):
    from codefootprint.plans.scoring import with_severity

    return with_severity(C.findings(spark, sf_dir)).select("repo_id", "rule_id", "path", "line", "category", "severity")


def join_rules_left(spark, sf_dir):
    from codefootprint.plans.scoring import with_severity

    return with_severity(C.findings(spark, sf_dir), how="left").select(
        "repo_id", "rule_id", "path", "line", "category", "severity"
    )


def violations_with_fix(spark, sf_dir):
    return cf.violations_with_fix(C.findings(spark, sf_dir)).select(
        "repo_id", "rule_id", "path", "line", F.size("steps").alias("steps"), "bad", "good", "language", "has_example"
    )


def catalog_integrity(spark, sf_dir):
    return cf.catalog_integrity(C.findings(spark, sf_dir))


def repo_stats(spark, sf_dir):
    return cf.repo_stats(C.finding_stats(spark, sf_dir))


def language_breakdown(spark, sf_dir):
    return cf.language_breakdown(C.finding_stats(spark, sf_dir))


def repo_scores(k: float, spark, sf_dir):
    stats, found = ready(spark, sf_dir)
    return cf.repo_scores(stats, found, k=k).select(
        "repo_id", "code_files", "total_code_lines", "total_violations", "penalty",
        F.round("density", 6).alias("density"), "score", "grade", "grade_color", "grade_label",
        F.round("kwh", 6).alias("kwh"), F.round("kg_co2", 6).alias("kg_co2"),
    )


def category_scores(spark, sf_dir):
    return cf.category_scores(C.findings(spark, sf_dir)).withColumn(
        "percent_of_penalty", F.round("percent_of_penalty", 6)
    )


def rule_scores(spark, sf_dir):
    return cf.rule_scores(C.findings(spark, sf_dir)).drop("name")


def quality_gate(spark, sf_dir):
    return cf.quality_gate(cf.repo_scores(*ready(spark, sf_dir)), MIN_SCORE).select("repo_id", "score", "grade")


def sorted_violations(spark, sf_dir):
    return cf.sorted_violations(C.findings(spark, sf_dir)).select(
        "repo_id", "severity", "path", "line", F.col("column").alias("col"), "rule_id"
    )


def top_violations(spark, sf_dir):
    return cf.top_violations(C.findings(spark, sf_dir))


def top_rules(k: int, spark, sf_dir):
    return cf.top_rules(C.findings(spark, sf_dir), k=k).drop("name")


def top_per_rule(spark, sf_dir):
    return cf.top_per_rule(C.findings(spark, sf_dir))


def rule_catalog(spark, sf_dir):
    rows = cf.rule_catalog(C.findings(spark, sf_dir))
    return rows.select("ord", "category", F.explode("rules").alias("r")).select(
        "ord", "category", "r.rule_id", "r.severity", "r.severity_label", "r.findings"
    )


def report_json(spark, sf_dir):
    """The report documents, read back field by field."""
    def at(path: str):
        return F.get_json_object("document", path)

    return cf.report_documents(*ready(spark, sf_dir)).select(
        "repo_id",
        at("$.repository").alias("repository"),
        at("$.index.score").cast("double").alias("score"),
        at("$.index.grade").alias("grade"),
        at("$.index.penalty").cast("bigint").alias("penalty"),
        at("$.index.density").cast("double").alias("density"),
        at("$.index.total_violations").cast("bigint").alias("total_violations"),
        at("$.index.illustrative_kwh").cast("double").alias("kwh"),
        at("$.index.categories[0].category").alias("first_category"),
        at("$.index.categories[0].percent_of_penalty").cast("double").alias("first_percent"),
        at("$.index.rules[0].rule_id").alias("first_rule"),
        F.coalesce(F.json_array_length(at("$.index.rules")), F.lit(0)).alias("rules"),
        at("$.stats.total_files").cast("bigint").alias("total_files"),
        F.coalesce(at("$.stats.language_breakdown.go").cast("bigint"), F.lit(0).cast("bigint")).alias("go_lines"),
    )


def report_findings(spark, sf_dir):
    """The finding lines, parsed back."""
    schema = (
        "rule_id string, category string, severity int, path string, line int, `column` int, message string, "
        "snippet string"
    )
    parsed = cf.report_findings(C.findings(spark, sf_dir)).select("repo_id", F.from_json("finding", schema).alias("f"))
    return parsed.select(
        "repo_id", "f.rule_id", "f.category", "f.severity", "f.path", "f.line", F.col("f.column").alias("col"),
        "f.message", "f.snippet",
    )


def tabular_sink(spark, sf_dir):
    """Writes the scan of the code corpus in repository buckets and reads the scores back from the tables."""
    folder = work_folder(spark, "tables")
    cf.write_tables(cf.scan_files(C.code(spark, sf_dir)), folder, buckets=8)
    stats, found = (cf.read_committed(spark, folder, name) for name in ("file_stats", "violations"))
    return cf.repo_scores(stats, found).select("repo_id", "total_files", "total_violations", "penalty", "score", "grade")


def run_outputs(spark, sf_dir):
    """One run over the code corpus with all its outputs, read back from the commit and held against each other."""
    folder = work_folder(spark, "run")
    cf.write_run(cf.scan_files(C.code(spark, sf_dir)), folder, buckets=4)

    def lines(name: str) -> DataFrame:
        rows = cf.read_committed(spark, folder, name, fmt="json")
        return rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name))

    document = cf.read_committed(spark, folder, "repositories", fmt="json")
    table = cf.read_committed(spark, folder, "violations").groupBy("repo_id").agg(F.count(F.lit(1)).alias("violations"))
    joined = document.join(lines("findings"), "repo_id", "left").join(lines("report_errors"), "repo_id", "left")
    return joined.join(table, "repo_id", "left").na.fill(0, ["findings", "report_errors", "violations"]).select(
        "repo_id", F.get_json_object("document", "$.index.score").cast("double").alias("score"),
        F.get_json_object("document", "$.index.total_violations").cast("bigint").alias("total_violations"),
        "violations", "findings", "report_errors",
    )


# ------------------------------------------------------------------ streams
def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = C.table(spark, sf_dir, "events").schema
    # The bracket makes the path a pattern, so a single file and a folder of parts both work.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def usage_totals_query(spark, sf_dir):
    return usage_totals(C.analyses_of(C.table(spark, sf_dir, "events"))).withColumn("kwh", F.round("kwh", 2))


def usage_totals_stream(spark, sf_dir):
    folder = work_folder(spark, "usage")
    query = start_usage_totals(C.analyses_of(event_stream(spark, sf_dir)), f"{folder}/totals", f"{folder}/checkpoint")
    query.awaitTermination()
    return current_totals(spark, f"{folder}/totals").withColumn("kwh", F.round("kwh", 2))


def stream_scan(spark, sf_dir):
    folder = work_folder(spark, "scan")
    query = start_scan(C.code_of(event_stream(spark, sf_dir)), f"{folder}/scanned", f"{folder}/checkpoint")
    query.awaitTermination()
    return places(cf.violations(spark.read.parquet(f"{folder}/scanned")))


def _revised(spark: SparkSession, sf_dir: str) -> str:
    """Output folder of a stream over the changing code corpus: every wave is a batch, the second one comes once more."""
    folder = work_folder(spark, "revisions")
    arrivals = C.arrivals(spark, sf_dir)
    schema = arrivals.drop("wave").schema
    for k, wave in enumerate((0, 1, 2, 1)):
        arrivals.filter(F.col("wave") == wave).drop("wave").write.parquet(f"{folder}/in/{k}")
        files = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        cf.start_scores(files, f"{folder}/out", f"{folder}/checkpoint", compact_every=2, buckets=4).awaitTermination()
    return f"{folder}/out"


def stream_scores(spark, sf_dir):
    return cf.current_scores(spark, _revised(spark, sf_dir)).select(
        "repo_id", "total_files", "code_files", "total_code_lines", "total_violations", "penalty",
        F.round("density", 6).alias("density"), "score", "grade",
    )


def stream_files(spark, sf_dir):
    return places(cf.violations(cf.current_files(spark, _revised(spark, sf_dir))))


QUERIES: dict[str, Query] = {
    "scan_corpus": scan_corpus,
    "prune_ignored_dirs": prune_ignored_dirs,
    "scan_listing": scan_listing,
    "admitted_files": admitted_files,
    "scan_single_file": scan_single_file,
    "scan_source_table": scan_source_table,
    "admit_snippets": admit_snippets,
    "missing_repo_errors": missing_repo_errors,
    "decode_text": decode_text,
    "size_cutoff": size_cutoff,
    "admit_repos": admit_repos,
    "normalize_targets": normalize_targets,
    "detect_language": detect_language_query,
    "count_code_lines": count_code_lines_query,
    "explode_lines": explode_lines,
    "strip_comments": strip_comments_query,
    "mask_code": mask_code_query,
    "human_size": human_size_query,
    "label_violations": label_violations,
    "grade_scores": grade_scores,
    "impact_estimate": impact_estimate,
    "regex_rules": partial(code_findings, REGEX_IDS, detailed),
    **{i.lower(): partial(code_findings, (i,), detailed) for i in REGEX_IDS},
    "gc001_clike": partial(gc001, True),
    "gc001_py": partial(gc001, False),
    "py_nodes": py_nodes,
    "py_node_stats": py_node_stats,
    "py_syntax_errors": py_syntax_errors,
    "python_rules": partial(code_findings, PYTHON_AST_IDS, places),
    **{i.lower(): partial(code_findings, (i,), places) for i in PYTHON_AST_IDS},
    "docker_rules": partial(docker_findings, DOCKER_IDS),
    **{i.lower(): partial(docker_findings, (i,)) for i in DOCKER_IDS},
    "requirement_entries": requirement_entries_query,
    "package_entries": package_entries_query,
    "dependency_line": dependency_line,
    "gc051": partial(manifest_findings, "GC051", ""),
    "gc052_requirements": partial(manifest_findings, "GC052", "requirements"),
    "gc052_package": partial(manifest_findings, "GC052", "package"),
    "gc070": partial(asset_findings, "GC070"),
    "gc072": partial(asset_findings, "GC072"),
    "subset_rules": partial(code_findings, SUBSET, places),
    "custom_rules": custom_rules,
    "free_text_rules": free_text_rules,
    "profiled_violations": partial(profiled_violations, 10_000),
    "profiled_violations_joined": partial(profiled_violations, 0),
    "profiled_scores": profiled_scores,
    "all_violations": all_violations,
    "code_file_stats": code_file_stats,
    "scan_scores": scan_scores,
    "scan_requested": scan_requested,
    "join_rules_inner": join_rules_inner,
    "join_rules_left": join_rules_left,
    "violations_with_fix": violations_with_fix,
    "catalog_integrity": catalog_integrity,
    "repo_stats": repo_stats,
    "language_breakdown": language_breakdown,
    "repo_scores": partial(repo_scores, 1.0),
    "repo_scores_k2": partial(repo_scores, 2.0),
    "category_scores": category_scores,
    "rule_scores": rule_scores,
    "quality_gate": quality_gate,
    "sorted_violations": sorted_violations,
    "top_violations": top_violations,
    "top_rules": partial(top_rules, 8),
    "top_rules_page": partial(top_rules, 10),
    "top_per_rule": top_per_rule,
    "rule_catalog": rule_catalog,
    "report_json": report_json,
    "report_findings": report_findings,
    "tabular_sink": tabular_sink,
    "run_outputs": run_outputs,
    "usage_totals": usage_totals_query,
    "usage_totals_stream": usage_totals_stream,
    "stream_scan": stream_scan,
    "stream_scores": stream_scores,
    "stream_files": stream_files,
}

HEAVY_NAMES = tuple(name for name, _ in HEAVY_DEPENDENCIES)
