import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(TESTDATA):
        pytest.skip("shared test tables are not here")
    return TESTDATA


@pytest.fixture(scope="session")
def files_of(spark):
    """A files table from ``{path: text or bytes}`` or ``[(repo, path, text or bytes)]``."""

    def build(files):
        rows = [("r", p, c) for p, c in files.items()] if isinstance(files, dict) else files
        rows = [(r, p, c.encode() if isinstance(c, str) else c) for r, p, c in rows]
        return spark.createDataFrame(
            [(r, p, len(c), bytearray(c)) for r, p, c in rows],
            "repo_id string, path string, length bigint, content binary",
        )

    return build


@pytest.fixture(scope="session")
def found_in(files_of):
    """Findings of a set of files as a sorted list of (path, rule, line)."""
    import codefootprint as cf

    def scan(files, **options):
        rows = cf.violations(cf.scan_files(files_of(files), **options)).collect()
        return sorted((r.path, r.rule_id, r.line) for r in rows)

    return scan
