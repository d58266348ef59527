"""Corpora built from the shared tables, row by row.

Every corpus is a projection of one table (no grouping, no sampling), so its size follows the table and no key
of the table gathers rows anywhere. DuckDB builds the same rows in :mod:`workloads.oracles`.
"""

from __future__ import annotations

from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codefootprint.catalog import DEFAULT_RULES
from codefootprint.functions.sqltext import quote

from .templates import TEMPLATES

RULE_IDS = tuple(sorted(r.id for r in DEFAULT_RULES))
ASSET_EXTENSIONS = (
    ".png", ".jpg", ".ico", ".mp4", ".zip", ".gz", ".js", ".mjs", ".css", ".min.js", ".ts", ".txt",
)
PACKAGES = ("pandas", "flask", "torch", "requests", "lodash", "numpy")
REQUIREMENT_TAILS = ("", "==1.0", ">=2", "!=3", "  # >= note", "[x]")
PACKAGE_VERSIONS = ("*", "latest", "1.x", "^1.2.0", "x")
DOCKER_LINES = (
    "FROM python:latest", "FROM node:20-slim AS b", "from ubuntu", "FROM reg.io/x/golang:1.22",
    "RUN pip install a", "RUN pip3 install --no-cache-dir a", "RUN apt-get install -y b",
    "RUN apt install --no-install-recommends b", "ADD a.py /a", "ADD a.tar.gz /a", "ADD http://x/y /y", "COPY . .",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of the line items, for corpora whose rows grow from a few keys into files."""
    return _spread(table(spark, sf_dir, "lineitem").select(*columns))


def _spread(rows: DataFrame) -> DataFrame:
    """Narrow rows that grow in the next step, over as many tasks as the session shuffles into. They are dealt by all their
    values: without keys Spark would sort every row first, to deal them alike when a task runs again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *rows.columns)


def pick(values, index: Column) -> Column:
    """The ``index``-th (from 0) of some literal strings."""
    literals = ", ".join("NULL" if v is None else quote(v) for v in values)
    return F.element_at(F.expr(f"array({literals})"), (index + 1).cast("int"))


def text(value: Column) -> Column:
    return value.cast("string")


def text_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages and documents as files."""
    pages = table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("repo_id"),
        F.concat(F.lit("p"), text(F.col("page_id")), F.lit(".html")).alias("path"),
        F.octet_length("html").cast("bigint").alias("length"),
        F.col("html").alias("content"),
    )
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo_id"),
        F.concat(F.lit("d"), text(F.col("doc_id")),
                 pick((".md", ".yml", ".txt", ".html"), F.col("doc_id") % 4)).alias("path"),
        F.octet_length("text").cast("bigint").alias("length"),
        F.col("text").alias("content"),
    )
    return pages.unionByName(docs)


def code_of(events: DataFrame) -> DataFrame:
    """One source file per event, from the template its id selects. Works on a stream as well."""
    t = F.col("event_id") % len(TEMPLATES)
    folder = F.when(F.col("event_id") % 11 == 0, "node_modules/").when(F.col("event_id") % 13 == 0, ".cache/")
    content = pick([x.content for x in TEMPLATES], t)
    return events.select(
        F.col("user_id").alias("repo_id"),
        F.concat(
            F.coalesce(folder, F.lit("")), F.lit("src"), text(F.col("event_id") % 7), F.lit("/f"),
            text(F.col("event_id")), pick([x.ext for x in TEMPLATES], t),
        ).alias("path"),
        F.octet_length(content).cast("bigint").alias("length"),
        content.alias("content"),
    )


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_of(_spread(table(spark, sf_dir, "events").select("event_id", "user_id")))


def revised(template: int, version: int) -> int:
    """The template of a file's later version: the next ones with the same extension."""
    alike = [i for i, x in enumerate(TEMPLATES) if x.ext == TEMPLATES[template].ext]
    return alike[(alike.index(template) + version) % len(alike)]


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code corpus as it changes: a third of the files come twice, a ninth three times, and of these a third is deleted
    at last. wave is when a version arrives; some come in reversed order."""
    last = F.when(F.col("event_id") % 9 == 0, 2).when(F.col("event_id") % 3 == 0, 1).otherwise(0)
    versions = code(spark, sf_dir).withColumn("event_id", F.regexp_extract("path", r"/f(\d+)", 1).cast("bigint"))
    versions = versions.withColumn("version", F.explode(F.sequence(F.lit(0), last)))
    t = F.col("event_id") % len(TEMPLATES)
    content = F.when(F.col("version") == 0, F.col("content"))
    for version in (1, 2):
        later = pick([TEMPLATES[revised(i, version)].content for i in range(len(TEMPLATES))], t)
        content = content.when(F.col("version") == version, later)
    deleted = (F.col("event_id") % 27 == 0) & (F.col("version") == 2)
    late = F.when(F.col("event_id") % 45 == 0, 2 - F.col("version")).otherwise(F.col("version"))
    return versions.withColumn("content", F.when(~deleted, content)).select(
        "repo_id", "path", F.octet_length("content").cast("bigint").alias("length"), "content",
        F.col("version").cast("bigint").alias("version"), deleted.alias("deleted"), late.alias("wave"),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready findings, one per line item. Every 45th part has a rule id outside the catalogue."""
    rule = pick((*RULE_IDS, "GC999"), F.col("l_partkey") % 45)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("repo_id"),
        rule.alias("rule_id"),
        F.concat(F.lit("f"), text(F.col("l_orderkey") % 50), F.lit(".py")).alias("path"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_partkey") % 9).cast("int").alias("column"),
        F.concat(F.lit("order "), text(F.col("l_orderkey"))).alias("snippet"),
        F.concat(F.lit("part "), text(F.col("l_partkey"))).alias("message"),
    )


def finding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File rows for the findings' repositories, plus every supplier again as a repository without findings."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("repo_id"),
        F.concat(F.lit("f"), text(F.col("l_orderkey") % 50), F.lit(".py")).alias("path"),
        pick(("python", "go", "yaml"), F.col("l_orderkey") % 3).alias("language"),
        (F.col("l_quantity").cast("int") * (1 + F.col("l_suppkey") % 9)).cast("int").alias("code_lines"),
        F.col("l_extendedprice").cast("bigint").alias("bytes"),
    )
    clean = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 1_000_000_000).alias("repo_id"),
        F.lit("main.rs").alias("path"),
        F.lit("rust").alias("language"),
        (10 + F.col("s_suppkey") % 90).cast("int").alias("code_lines"),
        F.lit(100).cast("bigint").alias("bytes"),
    )
    return items.unionByName(clean)


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a size and no content worth reading."""
    columns = ("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return items(spark, sf_dir, *columns).select(
        F.col("l_suppkey").alias("repo_id"),
        F.concat(F.lit("a/"), text(F.col("l_orderkey")), F.lit("-"), text(F.col("l_linenumber")),
                 pick(ASSET_EXTENSIONS, F.col("l_partkey") % 12)).alias("path"),
        F.round(F.col("l_extendedprice") * F.col("l_quantity")).cast("bigint").alias("length"),
        F.lit("").alias("content"),
    )


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive members grouped into repositories of different sizes, some with unsafe paths or links."""
    key = F.when(F.col("l_linenumber") <= 3, F.concat(F.lit("big-"), F.col("l_returnflag"))).otherwise(
        F.concat(F.lit("s"), text(F.col("l_suppkey")), F.lit("-"),
                 text(F.col("l_partkey") % (2 + F.col("l_suppkey") % 2)))
    )
    prefix = F.when(F.col("l_partkey") % 17 == 0, "../").when(F.col("l_partkey") % 19 == 0, "/").otherwise("x/")
    return table(spark, sf_dir, "lineitem").select(
        key.alias("repo_id"),
        F.concat(prefix, text(F.col("l_orderkey"))).alias("path"),
        F.round(F.col("l_extendedprice") * F.col("l_quantity")).cast("bigint").alias("length"),
        (F.col("l_partkey") % 23 != 0).alias("is_regular"),
        (F.col("l_suppkey") % 40 * 1_000_000).alias("archive_bytes"),
    )


def _requirements(part: DataFrame) -> DataFrame:
    def entry(offset: int) -> Column:
        return F.concat(
            pick(PACKAGES, (F.col("p_partkey") + offset) % 6), pick(REQUIREMENT_TAILS, (F.col("p_size") + offset) % 6)
        )

    lines = [F.lit("-r base.txt"), entry(0), F.lit(""), F.lit("# pandas"), F.upper(entry(1)), entry(2)]
    return part.select(
        F.col("p_partkey").alias("repo_id"),
        F.concat(F.when(F.col("p_partkey") % 10 == 9, "sub/").otherwise(""),
                 F.lit("requirements"), pick(("", "-dev"), F.col("p_partkey") % 2), F.lit(".txt")).alias("path"),
        F.concat_ws("\n", *lines).alias("content"),
    )


def _package(part: DataFrame) -> DataFrame:
    def pair(offset: int) -> Column:
        return F.concat(
            F.lit('"'), pick(PACKAGES, (F.col("p_partkey") + offset) % 6), F.lit('": "'),
            pick(PACKAGE_VERSIONS, (F.col("p_size") + offset) % 5), F.lit('"'),
        )

    section = pick(("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"),
                   F.col("p_size") % 4)
    tail = F.when(F.col("p_partkey") % 10 == 7, "").otherwise("}")
    listed = F.when(
        F.col("p_partkey") % 10 == 8,
        F.concat(F.lit('{\n"dependencies": ["pandas"],\n"devDependencies": {\n'), pair(1), F.lit("\n}\n")),
    ).otherwise(
        F.concat(F.lit('{\n"name": "n",\n"'), section, F.lit('": {\n'), pair(0), F.lit(",\n"), pair(1), F.lit("\n}\n"))
    )
    return part.select(
        F.col("p_partkey").alias("repo_id"),
        F.concat(F.when(F.col("p_partkey") % 10 == 9, "sub/").otherwise(""), F.lit("package.json")).alias("path"),
        F.concat(listed, tail).alias("content"),
    )


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A requirements file and a package manifest per part; some are broken, some lie below the root."""
    part = table(spark, sf_dir, "part")
    return _requirements(part).unionByName(_package(part)).select(
        "repo_id", "path", F.octet_length("content").cast("bigint").alias("length"), "content"
    )


def dockerfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Dockerfile of four instructions per line item."""
    picks = (F.col("l_partkey") % 12, F.col("l_partkey").cast("bigint") % 7 + F.col("l_linenumber") % 6,
             F.col("l_suppkey") % 12, F.col("l_orderkey") % 12)
    content = F.concat_ws("\n", *(pick(DOCKER_LINES, p) for p in picks))
    return items(spark, sf_dir, "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").select(
        F.col("l_suppkey").alias("repo_id"),
        F.concat(F.lit("svc"), text(F.col("l_orderkey")), F.lit("/"), text(F.col("l_linenumber")),
                 F.lit(".Dockerfile")).alias("path"),
        F.octet_length(content).cast("bigint").alias("length"),
        content.alias("content"),
    )


def write_tree(files: DataFrame, root: str) -> None:
    """Writes a ``files`` table as files, one folder per repository. A folder's files are written by one task, one after the
    other: each folder is made once, and no tasks wait for each other at its lock."""
    import pyarrow.fs as pafs

    def write(batches):
        system, base = pafs.FileSystem.from_uri(root)
        made = None
        for batch in batches:
            for repo, path, content in zip(*(column.to_pylist() for column in batch.columns)):
                folder, _, name = f"{base}/{repo}/{path}".rpartition("/")
                if folder != made:
                    system.create_dir(folder, recursive=True)
                    made = folder
                with system.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content.encode())
            yield batch.slice(0, 0)

    system, base = pafs.FileSystem.from_uri(root)
    system.create_dir(base, recursive=True)  # a tree without files is one too
    narrow = files.select(text(F.col("repo_id")).alias("repo_id"), "path", "content")
    by_folder(narrow).mapInArrow(write, narrow.schema).write.format("noop").mode("overwrite").save()


def by_folder(files: DataFrame) -> DataFrame:
    """The files of a folder in one task, one after the other."""
    folder = F.regexp_replace("path", "[^/]*$", "")
    tasks = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(tasks, "repo_id", folder).sortWithinPartitions("repo_id", folder)


def wave_of(repo: str, waves: int) -> Column:
    """Numbers from 0 that deal repositories to about equal waves, each repository whole."""
    return F.pmod(F.xxhash64(repo), F.lit(waves))


def remove_files(spark: SparkSession, root: str) -> None:
    """Removes the files of a tree and leaves its folders, by tasks that take some of its repositories each."""
    import pyarrow as pa
    import pyarrow.fs as pafs

    def listed(batches):
        system, base = pafs.FileSystem.from_uri(root)
        for _ in batches:
            names = [info.base_name for info in system.get_file_info(pafs.FileSelector(base))]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    def remove(batches):
        system, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            folders = [f"{base}/{name}" for name in batch.column("name").to_pylist()]
            while folders:
                for info in system.get_file_info(pafs.FileSelector(folders.pop())):
                    if info.type == pafs.FileType.Directory:
                        folders.append(info.path)
                    else:
                        with suppress(FileNotFoundError):  # a task may run twice
                            system.delete_file(info.path)
            yield batch.slice(0, 0)

    repos = spark.range(1).coalesce(1).mapInArrow(listed, "name string")
    dealt = repos.repartition(spark.sparkContext.defaultParallelism, "name")
    dealt.mapInArrow(remove, repos.schema).write.format("noop").mode("overwrite").save()


def remove_folders(root: str) -> None:
    """Removes a tree whose files are gone, with one call to its file system."""
    import pyarrow.fs as pafs

    system, base = pafs.FileSystem.from_uri(root)
    system.delete_dir(base)


def next_root(root: str, following: str) -> None:
    """Makes the empty root of the tree that follows this one. It is made inside this one and moved out: file systems lay files
    near their folder, and some search long for room among files that were just removed."""
    import pyarrow.fs as pafs

    system, base = pafs.FileSystem.from_uri(root)
    system.create_dir(f"{base}/.following")
    system.move(f"{base}/.following", pafs.FileSystem.from_uri(following)[1])


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page address as it is and in the shapes users type."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host")
    )
    name = F.concat(F.lit("r"), text(F.col("page_id")))
    shapes = F.array(
        F.col("url"),
        F.concat(F.lit("https://github.com/"), "host", F.lit("/"), name, F.lit(".git")),
        F.concat(F.lit("github.com/"), "host", F.lit("/"), name, F.lit("/tree/main?x=1")),
        F.concat(F.lit("  "), "host", F.lit("/"), name, F.lit(" ")),
        F.concat(F.lit("https://user@WWW.GitHub.com:443/"), "host", F.lit("/"), name, F.lit(";p#top")),
        F.concat(F.lit("http://localhost:8000/"), "host", F.lit("/"), name),
        F.concat("host", F.lit(" "), name),
        F.concat(F.lit("https://github.com/"), "host"),
        F.lit(""),
    )
    return pages.select("page_id", F.posexplode(shapes).alias("shape", "target"))


def analyses_of(events: DataFrame) -> DataFrame:
    """Each event as a finished analysis."""
    kind = F.when(F.col("event_type") == "view", "snippet").otherwise("repository")
    return events.select(kind.alias("kind"), (F.col("value") - 50).alias("kwh"))
