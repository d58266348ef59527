"""Running totals: zeros before the first event, later files added, one row at any time."""

import codefootprint as cf

SCHEMA = "kind string, kwh double"


def run(spark, tmp_path):
    events = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    cf.start_usage_totals(events, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    return [tuple(r) for r in cf.current_totals(spark, str(tmp_path / "out")).collect()]


def test_totals_start_at_zero_and_follow_the_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert run(spark, tmp_path) == [(0, 0.0)]
    (tmp_path / "in" / "a.json").write_text('{"kind": "repository", "kwh": 2.5}\n{"kind": "snippet", "kwh": 9.0}\n')
    assert run(spark, tmp_path) == [(1, 2.5)]
    (tmp_path / "in" / "b.json").write_text('{"kind": "repository", "kwh": -1.0}\n{"kind": "repository", "kwh": 1.0}\n')
    assert run(spark, tmp_path) == [(3, 3.5)]
    assert run(spark, tmp_path) == [(3, 3.5)]
