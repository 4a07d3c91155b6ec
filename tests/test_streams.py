"""Streams that stop and go on: runs end once, index rows are written once, payloads are told by type."""

import datetime as dt

from leafmill.streaming import runs

EVENTS = "run_id long, event_id long, ts timestamp, status string"


def at(minute, day=0):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=day, minutes=minute)


def test_runs_end_across_micro_batches(spark, tmp_path):
    source, path, log = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")
    batches = [
        [(1, 1, at(1), "running"), (1, 3, at(3), "done"), (1, 4, at(3), "running"), (1, 2, at(2), "running"), (2, 1, at(1), "running"), (None, 9, at(1), "done")],
        [(1, 5, at(4), "running"), (2, 2, at(2), "error"), (2, 3, at(1), "running"), (3, 1, at(9), "hitl")],
        [(2, 4, at(9), "running"), (3, 2, at(10), "running"), (4, 1, at(0), "running"), (4, 1, at(0), "running")],
        [(3, 3, at(0, day=30), "running")],
    ]
    got = []
    for batch in batches:
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        got = sorted((r.run_id is None, r.run_id or 0, r.event_id) for r in runs.runs_until_terminal(stream, path=path, log=log).collect())
    # After the horizon a run's end is forgotten.
    assert [x[1:] for x in got] == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 3), (4, 1), (4, 1), (0, 9)]


def test_index_rows_are_written_once(spark, tmp_path):
    source, path, log = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")
    for batch in ([("a", 1), ("a", 1), ("b", 2)], [("b", 2), ("c", 3)], [("a", 1)]):
        spark.createDataFrame(batch, "chunk_id string, n long").coalesce(1).write.mode("append").parquet(source)
        out = runs.index_append(spark.readStream.schema("chunk_id string, n long").parquet(source), path=path, log=log)
        rows = sorted(tuple(r) for r in out.collect())
    assert rows == [("a", 1), ("b", 2), ("c", 3)]


def test_payloads_by_type(spark):
    payload = '{"a": 1, "b": [1, 2, {}], "c": {"x": 1}, "s": "' + "é" * 201 + '", "t": "short", "n": null, "f": -1.5, "y": true, "e": [], "o": {}}'
    rows = [(1, 1, payload), (1, 2, "no json"), (1, 3, None), (1, 4, "[1]"), (1, 5, "{}"), (1, 6, '"text"')]
    got = runs.trace_summary(spark.createDataFrame(rows, "run_id long, event_id long, payload string")).collect()
    assert {r.event_id for r in got} == {1}
    assert {r.key: (r.kind, r.summary) for r in got} == {
        "a": ("number", "1"), "b": ("list", "[3 items]"), "c": ("object", "{1 keys}"), "s": ("text", "é" * 200 + "…"), "t": ("text", "short"), "n": ("null", "null"), "f": ("number", "-1.5"), "y": ("boolean", "true"), "e": ("list", "[0 items]"), "o": ("object", "{0 keys}"),
    }
