"""Registered queries over larger tables: trees in waves, streams whose input is written and read by many tasks."""

import glob
import os

from pyspark.sql import functions as F

import codefootprint as cf
from codefootprint.plans import reports
from workloads import corpora, registry


def events(spark, tmp_path, rows=400):
    table = spark.range(rows).select(
        F.col("id").alias("event_id"), (F.col("id") % 9).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value")
    )
    table.write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def in_folder(root):
    return sum(len(files) for _, _, files in os.walk(root.removeprefix("file://")))


def test_a_tree_is_on_the_disk_a_wave_at_a_time(spark, tmp_path, monkeypatch):
    seen, write = [], corpora.write_tree

    def counted(files, root):
        write(files, root)
        seen.append((in_folder(root), in_folder(root.rpartition("/")[0]), root.rpartition("/")[0]))

    monkeypatch.setattr(corpora, "write_tree", counted)
    monkeypatch.setattr(registry, "WAVE_FILES", 60, raising=False)
    sf_dir = events(spark, tmp_path)
    found = sorted(map(tuple, registry.scan_listing(spark, sf_dir).collect()), key=str)
    assert found == sorted(map(tuple, registry.code_file_stats(spark, sf_dir).collect()), key=str) and found
    assert len(seen) == 7 and sum(own for own, _, _ in seen) == 400
    assert all(own == there for own, there, _ in seen), "an earlier wave's tree is still there"
    assert in_folder(seen[0][2]) == 0


def test_arriving_files_are_written_by_many_tasks(spark, tmp_path):
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/codefootprint/revisions-*"))
    found = registry.stream_files(spark, events(spark, tmp_path)).collect()
    (folder,) = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/codefootprint/revisions-*")) - before
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [len(glob.glob(f"{folder}/in/{k}/*.parquet")) for k in range(4)] == [parts] * 4
    assert found


def test_rows_that_grow_are_dealt_without_a_sort(spark, tmp_path):
    plan = corpora.code(spark, events(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" not in plan and "Exchange hashpartitioning" in plan


def test_reports_of_a_run_are_made_from_its_flat_tables(spark, files_of, tmp_path, monkeypatch):
    seen, outputs = [], reports._report_outputs

    def noted(*tables):
        seen.extend({f.split("/")[-4] if "/bucket=" in f else f.split("/")[-3] for f in t.inputFiles()} for t in tables[:3])
        return outputs(*tables)

    monkeypatch.setattr(reports, "_report_outputs", noted)
    path = str(tmp_path / "run")
    cf.write_run(cf.scan_files(files_of({"a.py": "print(1)\n", "b.py": "def broken(:\n"})), path, buckets=2)
    assert seen == [{"file_stats"}, {"violations"}, {"errors"}]
    assert cf.read_committed(spark, path, "findings", fmt="json").count() == 1
    assert cf.read_committed(spark, path, "report_errors", fmt="json").count() == 1
