"""Rules of admission, sinks, writers, snapshots and graphs, and operators against record-by-record loops."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from sluicework.functions import group_key
from sluicework.operators import admission, changelog, joins, process, ranking, views, windows
from sluicework.plans.pipeline import Graph
from sluicework.schema import StreamPolicy
from sluicework.sources import tables
from sluicework.sources.feed import events_of, follow
from sluicework.sources.sinks import Outbox, messages
from sluicework.sources.writer import RECORD, StreamWriter


def at(s):
    return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s)


def stream(spark, rows):
    """rows: (partition, time)"""
    data = [(i, p, at(t)) for i, (p, t) in enumerate(rows)]
    return spark.createDataFrame(data, "sequence long, partition int, event_time timestamp_ntz")


def aligned(rows, partitions, drift, bound):
    """The rejected rows, one record after the other."""
    marks, out = [None] * partitions, []
    for i, (p, t) in enumerate(rows):
        mark = t - bound if marks[p] is None else max(t - bound, marks[p])
        others = [m for q, m in enumerate(marks) if q != p]
        if others and None not in others and mark > min(others) + drift:
            out.append(i)
        else:
            marks[p] = mark
    return out


@pytest.mark.parametrize("ranges", [1, 3, 16])
@pytest.mark.parametrize(
    ("partitions", "rows"),
    [
        (2, [(0, 0), (1, 0), (0, 100), (1, 9), (1, 50)]),
        (3, [(0, 0), (1, 50), (1, 60), (2, 5)]),
        (3, [(random.Random(i * 7).randrange(3), i + random.Random(i).randrange(40)) for i in range(120)]),
        (1, [(0, 5), (0, 500)]),
    ],
)
def test_alignment_equals_a_loop_over_records(spark, partitions, rows, ranges):
    found = admission.misaligned(stream(spark, rows), StreamPolicy(partitions=partitions, disorder=0.0, drift=10.0), ranges=ranges, most=7)
    assert sorted(r.sequence for r in found.collect() if r.rejected_alignment) == aligned(rows, partitions, 10, 0)


def progress(rows, partitions, bound, timeout):
    """The combined watermark before each (partition, event time, ingested, sealed), by a loop."""
    marks, seen, ended, mark, out = [None] * partitions, [0.0] * partitions, [False] * partitions, None, []

    def refresh(now):
        nonlocal mark
        live = [marks[p] for p in range(partitions) if not ended[p] and now - seen[p] < timeout]
        if live and None not in live:
            mark = min(live) if mark is None else max(mark, min(live))

    for p, t, now, sealed in rows:
        refresh(now)
        out.append(mark)
        seen[p] = now
        if sealed:
            ended[p] = True
        else:
            marks[p] = t - bound if marks[p] is None else max(marks[p], t - bound)
        refresh(now)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_watermarks_with_idle_and_sealed_partitions_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    rows, now, open_ = [], 0.0, {0, 1, 2}
    for i in range(150):
        now += rng.choice([0.5, 1.0, 3.0, 12.0 if i % 20 == 0 else 1.0])
        p = rng.choice(sorted(open_)) if i % 30 < 20 else min(open_)
        sealed = i in (70, 110) and len(open_) > 1
        rows.append((p, round(now - rng.random() * 8, 3), now, sealed))
        if sealed:
            open_.discard(p)
    data = [(i, p, at(t), at(n), s) for i, (p, t, n, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "sequence long, partition int, event_time timestamp_ntz, came timestamp_ntz, ended boolean")
    policy = StreamPolicy(partitions=3, disorder=2.0, idle_timeout=8.0)
    found = admission.watermarks(df, policy, sealed="ended", ingested="came", created=0.0).orderBy("sequence").collect()
    want = progress(rows, 3, 2.0, 8.0)
    assert [r.watermark_before and round(r.watermark_before / 1e6, 3) for r in found] == [m and round(m, 3) for m in want]


def test_planning_watermarks_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "planning")
    try:
        admission.classify(stream(spark, [(0, 1), (1, 2)]), StreamPolicy(partitions=2))
        assert list(tracker.getJobIdsForGroup("plan")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_declared_watermarks_do_not_fall(spark):
    rows = spark.createDataFrame([(0, 0, 5), (1, 0, 9), (2, 0, 7)], "sequence long, partition int, said long")
    with pytest.raises(Exception, match="fell"):
        admission.monotone(rows, "said").collect()
    assert admission.monotone(rows.filter("sequence < 2"), "said").count() == 2


def test_batches_go_in_whole_or_not_at_all(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", None), ("c", 1)], "batch string, v int")
    got = {(r.batch, r.admitted) for r in admission.whole_batches(rows, "batch", F.col("v") > 0, most=2).collect()}
    assert got == {("a", True), ("b", False), ("c", True)}


def test_frontiers_of_operators_and_forwarded_streams():
    graph = Graph("g").stream("s", StreamPolicy(lateness=5.0)).stream("levels", StreamPolicy(watermark="source_managed", lateness=2.0))
    graph.filter("f", "s", "v", "greater_than", 1).process("p", "f", process.Process("p", lambda s, r: (s, None)))
    graph.connect("f", "levels").window("w", "levels", windows.WindowSpec(10), "count").top_n("t", "f", [("v", "asc")], 3)
    assert graph.frontiers({"s": 100.0}) == {"s": 100.0, "levels": 98.0, "f": 100.0, "p": 100.0, "w": 98.0, "t": None}
    assert graph.frontiers({"s": 100.0}, pending=("p",))["p"] is None
    assert graph.frontiers({"s": math.inf})["t"] == graph.frontiers({"s": math.inf})["w"] == math.inf
    assert graph.frontiers({})["w"] is None and admission.operator_frontier("filter", [3.0, 1.0]) == 1.0


def test_graphs_forward_to_declared_streams(spark):
    rows = spark.createDataFrame([("a", at(1), 0, (5,), "insert"), ("b", at(2), 1, (0,), "insert"), ("a", at(30), 2, (7,), "insert")], "key string, event_time timestamp_ntz, sequence long, value struct<v:int>, kind string")
    graph = Graph("g").stream("s").stream("out", StreamPolicy(watermark="source_managed"))
    graph.filter("large", "s", "v", "greater_than", 1).map("flat", "large", lambda d: d.select("key", "event_time", "sequence", "kind", F.col("value.v").alias("v")))
    graph.connect("flat", "out", value=("v",)).window("w", "out", windows.WindowSpec(10), "sum", "v")
    assert sorted((r.key, r["sum"]) for r in graph.run({"s": rows})["w"].collect()) == [("a", 5.0), ("a", 7.0)]
    assert graph.backfill("large", {"s": rows}).count() == 2
    with pytest.raises(ValueError, match="upstream"):
        graph.connect("large", "out")
    with pytest.raises(ValueError, match="not declared"):
        graph.connect("large", "nowhere")
    with pytest.raises(ValueError, match="source_managed"):
        Graph("g").stream("s").stream("o").filter("f", "s", "v", "equal", 1).connect("f", "o")
    with pytest.raises(ValueError, match="retractions"):
        Graph("g").stream("s").stream("o", StreamPolicy(watermark="source_managed")).normalize("n", "s", ["key"], ["v"]).connect("n", "o").deduplicate("d", "o").validate()
    with pytest.raises(ValueError, match="retract mode"):
        Graph("g").stream("s").stream("o", StreamPolicy(watermark="source_managed")).filter("f", "s", "v", "equal", 1).connect("f", "o").normalize("n", "o", ["key"], ["v"]).validate()
    with pytest.raises(ValueError, match="any lateness"):
        Graph("g").stream("s", StreamPolicy(late_policy="accept")).window("w", "s", windows.WindowSpec(10), "count").validate()


def test_outbox(spark, tmp_path):
    box = Outbox(spark, str(tmp_path / "box"))
    emits = spark.createDataFrame([(2, '{"a":1}'), (10, '{"a":2}'), (3, None)], "sequence long, emitted string")
    box.enqueue(messages(emits, "p"))
    box.enqueue(messages(emits, "p"))
    assert box.all().count() == 2
    with pytest.raises(Exception, match="another payload"):
        box.enqueue(messages(emits.withColumn("emitted", F.lit("other")), "p"))
    assert [r.message_id for r in box.poll()] == ["process:p:2"] and [r.attempts for r in box.poll()] == [1]
    box.ack(["process:p:2"])
    box.ack(["process:p:2"])
    assert [(r.message_id, r.attempts) for r in box.poll(5)] == [("process:p:10", 0)]
    with pytest.raises(ValueError, match="unknown"):
        box.ack(["process:p:99"])
    box.enqueue(messages(spark.createDataFrame([("w1", "done")], "sequence string, emitted string"), "flow", origin="workflow"), batch_id=7)
    box.enqueue(messages(spark.createDataFrame([("w1", "done")], "sequence string, emitted string"), "flow", origin="workflow"), batch_id=7)
    assert box.all().filter("message_id = 'workflow:flow:w1'").count() == 1


def test_outbox_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("m1", "1", "x"), ("m2", "2", "y")], "message_id string, position string, payload string").write.parquet(str(tmp_path / "in"))
    box = Outbox(spark, str(tmp_path / "box"))
    source = tables.table_stream(spark, str(tmp_path / "in"), box.MESSAGES)
    query = box.write_stream(source, str(tmp_path / "checkpoint"))
    query.awaitTermination(60)
    assert query.exception() is None and box.pending().count() == 2


def rows_of(spark, offsets, partition=0):
    data = [(partition, at(o), f"k{o}", "{}", "insert", f"e{partition}-{o}", partition, o) for o in offsets]
    return spark.createDataFrame(data, RECORD)


def test_stream_writer(spark, tmp_path):
    folder = str(tmp_path / "stream")
    with StreamWriter(spark, folder, "src", partitions=2, bounded=True) as out:
        assert out.next_offset() == 0 and out.publish(rows_of(spark, range(3)), "c1") == 3
        assert out.next_offset() == 3 and out.publish(rows_of(spark, range(1, 5))) == 2
        with pytest.raises(ValueError, match="goes on at 5"):
            out.publish(rows_of(spark, [6]))
        with pytest.raises(ValueError, match="1 to 1000"):
            out.publish(rows_of(spark, []))
        with pytest.raises(ValueError, match="4096"):
            out.publish(rows_of(spark, [5]), "x" * 5000)
        out.publish(rows_of(spark, [0], partition=1))
        out.advance_watermark(0, 3.0)
        with pytest.raises(ValueError, match="fall"):
            out.advance_watermark(0, 2.0)
        assert out.cursor() == {0: 5, 1: 0 + 1} and out.checkpoint() == "c1"
    again = StreamWriter(spark, folder, "src", partitions=2)
    assert [(r.records, r.first, r.last, r.checkpoint) for r in again.commits().orderBy("batch").collect()][:2] == [(3, 0, 2, "c1"), (2, 3, 4, None)]
    again.seal()
    assert [r.sequence for r in again.records().orderBy("sequence").collect()] == [0, 1, 2, 3, 4, 5]
    assert again.stored().filter("sealed").count() == 2
    with pytest.raises(ValueError, match="sealed"):
        again.publish(rows_of(spark, [5]))
    query = again.stream().writeStream.format("memory").queryName("writer_out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(60)
    assert spark.table("writer_out").filter("event_id is not null").count() == 6


def test_feeds_are_followed_in_batches(spark, tmp_path):
    lines = [line for i in range(5) for line in (f"id: {i}", "event: change", f'data: {{"user": "u{i % 2}",', f'data: "at": {i}}}', "")] + [": comment", "data: no json", "", "data: [1]", ""]
    writer = StreamWriter(spark, str(tmp_path / "feed"), "sse")
    options = {"key": lambda b: b["user"], "time": lambda b: b["at"], "size": 2}
    assert follow(list(events_of(lines))[:3], writer, **options) == 3 and writer.checkpoint() == "2"
    assert follow(events_of(lines), writer, **options) == 2 and follow(events_of(lines), writer, **options) == 0
    got = writer.records().orderBy("sequence").collect()
    assert [(r.event_id, r.key, r.source_offset) for r in got] == [(str(i), f"u{i % 2}", i) for i in range(5)]
    assert writer.commits().count() == 3 and writer.checkpoint() == "4"


@pytest.mark.parametrize("wrong", [{"partitions": 0}, {"watermark": "x"}, {"late_policy": "x"}, {"disorder": -1.0}, {"lateness": math.nan}, {"drift": -1.0}, {"idle_timeout": math.inf}])
def test_stream_policies_are_checked(wrong):
    with pytest.raises(ValueError):
        StreamPolicy(**wrong)


def test_snapshots_show_one_cut(spark, tmp_path):
    folder = str(tmp_path)
    a, b = spark.range(5).withColumn("count", F.lit(1)), spark.range(3).withColumn("count", F.lit(1))
    cut = views.snapshot(spark, {"a": a, "b": b}, folder, "s1", inputs={"a": ("filter", "s"), "b": ("filter", "s")}, positions=stream(spark, [(0, 1), (1, 2), (0, 3)]))
    assert cut == "shared_input_cut" and views.read(spark, folder, "s1", "b").count() == 3
    assert {(r.partition, r.through) for r in views.read(spark, folder, "s1", "_positions").collect()} == {(0, 2), (1, 1)}
    assert views.snapshot(spark, {"a": a}, folder, "s2", inputs={"a": ("window", "s")}) == "operator_output_cut"
    for inputs in (None, {"a": ("filter", "s"), "b": ("filter", "t")}, {"a": ("filter", "s"), "b": ("window", "s")}):
        with pytest.raises(ValueError, match="filters of one stream"):
            views.snapshot(spark, {"a": a, "b": b}, folder, "s3", inputs=inputs)
    with pytest.raises(ValueError, match="more than 4 rows"):
        views.snapshot(spark, {"a": a}, folder, "s4", limit=4)
    assert not (tmp_path / "s4").exists()
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        views.snapshot(spark, {"a": a}, folder, "s1", inputs={"a": ("filter", "s")})


def test_hot_keys_of_as_of_joins_are_cut_by_time(spark):
    rng = random.Random(1)
    versions = [("hot" if i % 2 else f"k{i % 7}", at(rng.randrange(900)), i, f"v{i}", "delete" if i % 9 == 0 else "upsert") for i in range(300)]
    probes = [("hot" if i % 2 else f"k{i % 7}", at(rng.randrange(900)), 1_000 + i) for i in range(300)]
    v = spark.createDataFrame(versions, "key string, event_time timestamp_ntz, sequence long, level string, kind string")
    p = spark.createDataFrame(probes, "key string, event_time timestamp_ntz, sequence long")
    for how in ("inner", "left"):
        plain = joins.as_of(p, v, how=how, version_columns=["level"])
        cut = joins.as_of(p, v, how=how, version_columns=["level"], hot_rows=20, ranges=11)
        assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, plain.collect()), key=lambda r: r)[: plain.count()] if how == "inner" else {tuple(r) for r in cut.collect()} == {tuple(r) for r in plain.collect()}
    best = {}
    for k, t, s in probes:
        held = max((x for x in versions if x[0] == k and x[1] <= t), key=lambda x: (x[1], x[2]), default=None)
        best[s] = held[3] if held and held[4] != "delete" else None
    assert {r.sequence: r.version_level for r in joins.as_of(p, v, how="left", version_columns=["level"], hot_rows=20).collect()} == best


def test_hot_keys_reach_several_tasks(spark):
    rows = spark.range(4_000).select(F.lit("hot").alias("key"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("event_time"), F.col("id").alias("sequence"))
    found = joins.as_of(rows, rows.withColumn("level", F.col("sequence")), how="left", version_columns=["level"], hot_rows=100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        tasks = found.select("sequence", "version_level", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.task for r in tasks}) >= 8 and len(tasks) == 4_000 and all(r.sequence == r.version_level for r in tasks)


def test_netting_equals_a_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), i, rng.choice(["insert", "insert", "delete"])) for i in range(200)]
    want = dict.fromkeys("abc", 0)
    for key, _, kind in rows:
        want[key] = max(0, want[key] + (1 if kind == "insert" else -1))
    got = joins.netted(spark.createDataFrame(rows, "key string, sequence long, kind string"), ["key"])
    assert {r.key: r["count"] for r in got.collect()} == {k: n for k, n in want.items() if n}


def test_maximum_changelog_equals_a_loop(spark):
    rng = random.Random(9)
    rows, live = [], {"a": [], "b": []}
    for i in range(120):
        key = rng.choice("ab")
        if live[key] and rng.random() < 0.45:
            v, t = live[key].pop(rng.randrange(len(live[key])))
            rows.append((key, at(t), i, float(v), "delete"))
        else:
            v, t = rng.randrange(6), rng.randrange(20)
            live[key].append((v, t))
            rows.append((key, at(t), i, float(v), "insert"))
    df = spark.createDataFrame(rows, "key string, event_time timestamp_ntz, sequence long, v double, kind string")
    held, want = {}, []
    for key, t, i, v, kind in rows:
        w = (key, int((t - at(0)).total_seconds()) // 10)
        bag = held.setdefault(w, [])
        before = (len(bag), max(bag, default=None))
        bag.append(v) if kind == "insert" else bag.remove(v)
        after = (len(bag), max(bag, default=None))
        if before[0]:
            want.append((key, i, *before, "update_before" if after[0] else "delete"))
        if after[0]:
            want.append((key, i, *after, "update_after" if before[0] else "insert"))
    got = windows.max_changes(df, windows.WindowSpec(10), F.col("v")).collect()
    assert sorted((r.key, r.sequence, r["count"], r["max"], r.kind) for r in got) == sorted(want)


def test_input_modes_refuse_what_they_do_not_take(spark):
    rows = spark.createDataFrame([("a", 1, "insert"), ("a", 2, "delete")], "key string, sequence long, kind string")
    with pytest.raises(Exception, match="inserts alone"):
        changelog.checked(rows, "append").collect()
    with pytest.raises(Exception, match="no update_before"):
        changelog.checked(rows.withColumn("kind", F.lit("update_before")), "upsert").collect()
    with pytest.raises(ValueError, match="unknown input mode"):
        changelog.checked(rows, "other")
    table = spark.createDataFrame([("a", at(1), 1, 5, "insert"), ("a", at(2), 2, 6, "delete")], "key string, event_time timestamp_ntz, sequence long, v int, kind string")
    with pytest.raises(Exception, match="does not match"):
        changelog.normalize(table, ["key"], ["v"], mode="retract").collect()
    with pytest.raises(Exception, match="unknown primary key"):
        changelog.normalize(table.filter("kind = 'delete'"), ["key"], ["v"], mode="retract").collect()


def test_group_keys_limits_and_gaps(spark):
    rows = spark.createDataFrame([("a", 1.5, None), ('q"x', None, True)], "s string, d double, b boolean")
    assert [r[0] for r in rows.select(group_key("s", "d", "b")).collect()] == ['["a",1.5,null]', '["q\\"x",null,true]']
    assert rows.select(group_key()).first()[0] == "[]"
    with pytest.raises(ValueError, match="more than 1 rows"):
        ranking.limited(rows, 1)
    assert ranking.limited(rows, 2).count() == 2
    gaps = spark.createDataFrame([("s", 0, 0), ("s", 0, 1), ("s", 0, 4), ("s", 1, 2), (None, None, None)], "source_id string, source_partition int, source_offset long")
    assert sorted((r.source_partition, r.expected, r.found) for r in admission.offset_gaps(gaps).collect()) == [(0, 2, 4), (1, 0, 2)]


def test_reads_types_and_timers(spark):
    rows = spark.createDataFrame([(3, "a", '{"v": 1}'), (1, None, '{"v": null}'), (2, "b", '{"v": 2}')], "sequence long, key string, value string")
    assert [r.sequence for r in tables.scan(rows, after=1).collect()] == [2, 3]
    assert [r.sequence for r in views.rows_of(rows, where={"key": None}).collect()] == [1] and views.rows_of(rows, where={"key": "b"}).count() == 1
    assert ranking.pinned(rows, "v").count() == 3
    with pytest.raises(Exception, match="several types"):
        ranking.pinned(rows.unionByName(spark.createDataFrame([(4, "c", '{"v": "x"}')], rows.schema)), "v").collect()
    for wrong in ({"partition_by": ["key", "key"]}, {"partition_by": [""]}):
        with pytest.raises(ValueError, match="once each"):
            ranking.top_n(rows, [("sequence", "asc")], 1, ties=["key"], **wrong)
    timers = spark.createDataFrame([(1, at(5)), (2, at(9))], "id int, at timestamp_ntz")
    assert [r.id for r in admission.timers_due(timers, 5.0).collect()] == [1] and admission.timers_due(timers, None).count() == 0 and admission.timers_due(timers, None, sealed=True).count() == 2


def handler(state, record):
    state["n"] = state.get("n", 0) + record["v"]
    if record["v"] == 13:
        raise ValueError("unlucky")
    return state, state["n"]


def test_process_gates_and_finality(spark):
    rows = spark.createDataFrame([("a", at(t), t, v, f"e{t}") for t, v in ((1, 1), (2, 13), (3, 3), (9, 5))] + [("z", at(1), 7, 1, "z1")], "key string, event_time timestamp_ntz, sequence long, v int, event_id string")
    p = process.Process("p", handler, max_attempts=2)
    out = process.fold(rows, p, gate="complete", frontier_us=3_000_000, waiting=True, final_keys=rows.filter("key = 'z'").select("key"))
    got = {r.sequence: (r.status, r.emitted) for r in out.collect()}
    assert got == {1: ("COMMITTED", "1"), 2: ("FAILED", None), 3: ("COMMITTED", "4"), 9: ("PENDING", None)}
    assert process.fold(rows, p, gate="complete").count() == 0
    assert {r.sequence for r in process.discarded(rows, process.fold(rows, p)).collect()} == {2}
    assert process.frontier_of([3.0, None]) is None and process.frontier_of([3.0, 2.5]) == 2_500_000 and process.frontier_of([math.inf]) > 0


def test_processes_read_versions(spark):
    rows = spark.createDataFrame([("a", at(t), t) for t in (1, 5, 9)], "key string, event_time timestamp_ntz, sequence long")
    levels = spark.createDataFrame([("a", at(2), 0, 10, "upsert"), ("a", at(8), 1, 0, "delete")], "key string, event_time timestamp_ntz, sequence long, level int, kind string")
    seen = process.fold(process.with_versions(rows, {"now": levels}), process.Process("r", lambda s, r: (s, r["now"] and r["now"]["level"])))
    assert {r.sequence: r.emitted for r in seen.collect()} == {1: None, 5: "10", 9: None}


def test_replay_manifest(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "key string, sequence long, v int")
    states = spark.createDataFrame([("a", '{"n": 4}', 1)], "key string, state string, version int")
    p = process.Process("p", handler)
    given = {"columns": ["key", "v"], "processes": [p], "states": states, "histories": {"levels": rows}}
    made = process.manifest(rows, **given)
    assert made["records"]["count"] == 2 and made["processes"][0]["build"] == p.build and made["records"]["last_sequence"] == 2
    process.verify(made, records=rows.repartition(3), **given)
    with pytest.raises(ValueError, match="records"):
        process.verify(made, records=rows.withColumn("v", F.lit(1)), **given)
    with pytest.raises(ValueError, match="changed"):
        process.verify(made | {"format": 2}, records=rows, **given)
    both = process.compare(rows.withColumn("event_id", F.col("sequence").cast("string")), p, process.Process("q", lambda s, r: ({"n": s.get("n", 0) + r["v"]}, s.get("n", 0) + r["v"])), states=states)
    assert {r.key: (r.new_state, r.matches) for r in both.collect()} == {"a": ('{"n": 9}', True), "b": ('{"n": 6}', True)}


def test_late_records_go_to_a_side_folder(spark, tmp_path):
    from sluicework import streaming

    stream(spark, [(0, 100), (0, 10), (0, 200)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = tables.table_stream(spark, str(tmp_path / "in"), "sequence long, partition int, event_time timestamp_ntz")
    query = streaming.split_late(source, lambda df: admission.classify(df, StreamPolicy(disorder=0.0, lateness=5.0)), str(tmp_path / "ok"), str(tmp_path / "late"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert query.exception() is None
    read = lambda name: [r.sequence for r in spark.read.parquet(str(tmp_path / name)).orderBy("sequence").collect()]
    assert read("ok") == [0, 2] and read("late") == [1]


def test_fired_windows_are_messages(spark):
    rows = spark.createDataFrame([("a", at(t), t, "upsert") for t in (1, 5, 15)], "key string, event_time timestamp_ntz, sequence long, kind string")
    made = windows.aggregate(rows, windows.WindowSpec(10), "count")
    first = windows.fired(made, "s", "events", "count", 12.0).collect()
    assert [(r.id, r["count"], r.finalized) for r in first] == [("window:s:a:0", 2, False)]
    assert windows.fired(made, "s", "events", "count", 12.0, finalized=True).count() == 2
    assert len({r.id for r in itertools.chain(first, windows.fired(made, "s", "events", "count", 99.0).collect())}) == 2
