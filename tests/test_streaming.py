"""Streaming forms agree with the fixtures: one file per micro-batch, and a restart in between."""

import datetime as dt
import json

from sluicework import streaming
from sluicework.operators.joins import Interval
from sluicework.operators.process import Process
from sluicework.operators.windows import WindowSpec

BASE = dt.datetime(2024, 1, 1)


def files(spark, folder, rows, schema):
    """One parquet file a row, read one a micro-batch in order."""
    for i, row in enumerate(rows):
        path = folder / f"in{i:03d}"
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(str(path))
    return str(folder / "in*"), spark.createDataFrame([], schema).schema


def stream(spark, folder, rows, schema):
    path, kind = files(spark, folder, rows, schema)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def collect(spark, df, folder, name):
    q = df.writeStream.format("parquet").option("path", str(folder / name)).option("checkpointLocation", str(folder / f"{name}-cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.read.parquet(str(folder / name)).collect()


def t(s):
    return BASE + dt.timedelta(seconds=s)


def test_deduplicate_emits_the_earliest_event(spark, tmp_path):
    rows = [("a", t(10), 0, "late-copy"), ("a", t(7), 1, "first"), ("b", t(9), 2, "b"), ("a", t(11), 3, "more"), ("z", t(60), 4, "end"), ("z", t(61), 5, "end")]
    df = stream(spark, tmp_path, rows, "key string, event_time timestamp, sequence long, body string")
    got = collect(spark, streaming.deduplicate(df, disorder=5, lateness=1), tmp_path, "out")
    assert sorted((r.key, r.body) for r in got if r.key != "z") == [("a", "first"), ("b", "b")]


def test_as_of_waits_for_versions(spark, tmp_path):
    schema = "key string, event_time timestamp, sequence long, body string, kind string"
    (tmp_path / "p").mkdir()
    (tmp_path / "v").mkdir()
    probes = stream(spark, tmp_path / "p", [("a", t(10), 0, "p1", "upsert"), ("a", t(14), 1, "p2", "upsert"), ("c", t(13), 2, "p3", "upsert"), ("z", t(100), 8, "end", "upsert"), ("z", t(101), 9, "end", "upsert")], schema)
    versions = stream(spark, tmp_path / "v", [("a", t(12), 3, "v2", "upsert"), ("a", t(5), 4, "v1", "upsert"), ("c", t(11), 5, "v", "delete"), ("y", t(100), 6, "end", "upsert"), ("y", t(101), 7, "end", "upsert")], schema)
    got = collect(spark, streaming.as_of(probes, versions, disorder=10, how="left"), tmp_path, "out")
    assert sorted((r.probe, r.version) for r in got if r.key in "ac") == [("p1", "v1"), ("p2", "v2"), ("p3", None)]


def test_fold_keeps_state_across_restarts(spark, tmp_path):
    def handler(state, record):
        state["n"] = state.get("n", 0) + record["x"]
        return state, state["n"]

    schema = "key string, sequence long, body string"
    folder = tmp_path / "src"
    folder.mkdir()
    df = stream(spark, folder, [("k", 0, '{"x": 1}'), ("k", 1, '{"x": 2}')], schema)
    collect(spark, streaming.fold(df, Process("sum", handler)), tmp_path, "out")
    spark.createDataFrame([("k", 2, '{"x": 4}')], schema).write.parquet(str(folder / "in900"))
    got = collect(spark, streaming.fold(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder / "in*")), Process("sum", handler)), tmp_path, "out")
    assert [json.loads(r.emitted) for r in sorted(got, key=lambda r: r.sequence)] == [1, 3, 7]


def test_maximum_reveals_the_one_before(spark, tmp_path):
    df = stream(spark, tmp_path, [("k", 0, 90.0, 1), ("k", 1, 105.0, 1), ("k", 2, 105.0, -1), ("k", 3, 90.0, -1)], "key string, sequence long, value double, diff int")
    got = sorted(collect(spark, streaming.maximum(df), tmp_path, "out"), key=lambda r: (r.sequence, r.kind != "update_before"))
    assert [(r.kind, r.value) for r in got] == [("insert", 90), ("update_before", 90), ("update_after", 105), ("update_before", 105), ("update_after", 90), ("delete", 90)]


def test_final_windows_fire_once_and_respect_the_origin(spark, tmp_path):
    start = (BASE - dt.datetime(1970, 1, 1)).total_seconds()
    rows = [("a", t(5), 90.0), ("b", t(8), 70.0), ("a", t(15), 105.0), ("b", t(18), 120.0), ("a", t(25), 98.0), ("c", t(50), 50.0), ("z", t(51), 0.0), ("z", t(52), 0.0)]
    df = stream(spark, tmp_path, rows, "key string, event_time timestamp, value double")
    got = collect(spark, streaming.final_windows(df, WindowSpec(30, 10, start), "max", disorder=5, lateness=5), tmp_path, "out")
    assert sorted((r.key, (r.window_start - BASE).total_seconds(), r["max"], r["count"]) for r in got) == [("a", 0, 105, 3), ("a", 10, 105, 2), ("b", 0, 120, 2), ("b", 10, 120, 1)]


def test_interval_join_on_streams(spark, tmp_path):
    schema = "key string, event_time timestamp, body string"
    (tmp_path / "l").mkdir()
    (tmp_path / "r").mkdir()
    left = stream(spark, tmp_path / "l", [("a", t(10), "login-a"), ("b", t(20), "login-b")], schema)
    right = stream(spark, tmp_path / "r", [("a", t(14), "country"), ("a", t(17), "outside"), ("b", t(23), "low")], schema)
    got = collect(spark, streaming.interval_join(left, right, Interval(0, 5), disorder=60), tmp_path, "out")
    assert sorted((r.left, r.right) for r in got) == [("login-a", "country"), ("login-b", "low")]


def test_joined_state_is_dropped_behind_the_watermark(spark, tmp_path):
    schema = "key string, event_time timestamp, body string"
    sides = {}
    for side in ("left", "right"):
        (tmp_path / side).mkdir()
        sides[side] = stream(spark, tmp_path / side, [("a", t(20 * i), f"{side}{i}") for i in range(12)], schema)
    joined = streaming.interval_join(sides["left"], sides["right"], Interval(0, 5), disorder=1)
    q = joined.writeStream.format("memory").queryName("dropped").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("dropped").count() == 12
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6


def test_versions_that_no_probe_needs_are_dropped():
    """Of the versions at or before the frontier the newest stays."""
    from types import SimpleNamespace as N

    from sluicework.streaming.processors import AsOfJoin

    class Held:
        def __init__(self, rows):
            self.rows = rows

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def clear(self):
            self.rows = []

    join = AsOfJoin("left")
    join.probes = Held([(7_000_000, 0, "p1"), (30_000_000, 1, "p2")])
    join.versions = Held([(1_000_000, 0, "v1", False), (5_000_000, 1, "v2", False), (9_000_000, 2, "v3", False), (40_000_000, 3, "v4", False)])
    found = list(join.handleExpiredTimer(("a",), None, N(getExpiryTimeInMs=lambda: 10_000)))
    assert [(r.probe, r.version) for r in found] == [("p1", "v2")]
    assert [v[2] for v in join.versions.rows] == ["v3", "v4"] and [p[2] for p in join.probes.rows] == ["p2"]
