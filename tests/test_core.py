"""Operators against the worked fixtures of the survey, and randomised against recomputation."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sluicework.operators import admission, changelog, filters, joins, process, ranking, scaling, views, windows
from sluicework.plans.pipeline import Graph
from sluicework.schema import StreamPolicy, weight


def at(s):
    return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s)


def secs(t):
    return (t - dt.datetime(1970, 1, 1)).total_seconds()


def records(spark, rows, value="struct<v:int>"):
    """rows: (key, time, value tuple[, kind])"""
    data = [(r[0], at(r[1]), i, r[2], r[3] if len(r) > 3 else "upsert") for i, r in enumerate(rows)]
    return spark.createDataFrame(data, f"key string, event_time timestamp_ntz, sequence long, value {value}, kind string")


SENSORS = [("a", 5, ("a", 90)), ("b", 8, ("b", 70)), ("a", 15, ("a", 105)), ("b", 18, ("b", 120)), ("a", 25, ("a", 98)), ("c", 50, ("c", 50))]


def test_sensor_filter_and_sliding_max(spark):
    rows = records(spark, SENSORS, "struct<sensor:string,temperature:int>")
    hot = filters.filter_records(rows, "temperature", "greater_than", 100)
    assert sorted(r.value.temperature for r in hot.collect()) == [105, 120]
    spec = windows.WindowSpec(30, 10, 0)
    found = windows.due(windows.aggregate(rows, spec, "max", F.col("value.temperature")), 45, 5)
    assert sorted((r.key, secs(r.window_start), r["max"], r["count"]) for r in found.collect()) == [("a", 0, 105, 3), ("a", 10, 105, 2), ("b", 0, 120, 2), ("b", 10, 120, 1)]


def test_window_max_survives_retraction_and_vanishes_when_empty(spark):
    rows = records(spark, [("a", 1, (90,), "insert"), ("a", 2, (105,), "insert"), ("a", 2, (105,), "delete"), ("b", 1, (5,), "insert"), ("b", 1, (5,), "delete")])
    got = windows.aggregate(rows, windows.WindowSpec(10), "max", F.col("value.v")).collect()
    assert [(r.key, r["max"], r["count"]) for r in got] == [("a", 90, 1)]
    with pytest.raises(Exception, match="retracted more often"):
        windows.aggregate(records(spark, [("a", 1, (1,), "delete")]), windows.WindowSpec(10), "count").collect()


def test_partitioned_watermark_late_side_output_and_windows(spark):
    data = [(0, 12, 12, "s:0:0"), (0, 12, 12, "s:0:0"), (0, 11, 11, "s:0:1"), (1, 4, 4, "s:1:0"), (1, 3, 3, "s:1:1"), (0, 5, 99, "s:0:2")]
    rows = spark.createDataFrame([(p, at(t), i, v, e, None, "upsert", 21_000_000 if i in (2, 4) else None) for i, (p, t, v, e) in enumerate(data)], "partition int, event_time timestamp_ntz, sequence long, value int, event_id string, key string, kind string, mark long")
    rows = admission.idempotent(rows)
    # Both partitions declare 21 before the last record.
    policy = StreamPolicy(partitions=2, watermark="source_managed", lateness=1)
    judged = admission.classify(rows, policy, declared="mark")
    last = {r.value: r.disposition for r in judged.collect()}
    assert last[99] == "side_output"
    kept = admission.accepted(judged.filter("value != 99 or disposition = 'side_output'"))
    sums = windows.aggregate(kept, windows.WindowSpec(10), "sum", F.col("value"))
    got = {secs(r.window_start): r["sum"] for r in sums.filter("count > 0").collect()}
    assert got == {0: 7, 10: 23}


def test_lateness_bounds_are_inclusive(spark):
    rows = records(spark, [("k", 15, (0,)), ("k", 10, (0,)), ("k", 9, (0,)), ("k", 8, (0,)), ("k", 16, (0,))])
    got = admission.classify(rows, StreamPolicy(disorder=5, lateness=2)).orderBy("sequence").collect()
    assert [(r.late, r.too_late) for r in got] == [(False, False), (True, False), (True, False), (True, True), (False, False)]


def test_combined_watermark_idle_and_finality():
    parts = [{"watermark": 15}, {"watermark": 3}]
    assert admission.combined([{"watermark": 15}, {"watermark": 7}]) == 7
    assert admission.combined(parts) == 3
    assert admission.combined([parts[0], parts[1] | {"idle": True}]) == 15
    assert admission.combined([parts[0], {}]) is None
    assert min(admission.frontier(20, 2), admission.frontier(22, 5)) == 17
    policy = StreamPolicy(partitions=2, lateness=2)
    assert admission.finality([{}, {}], policy)["basis"] == "pending"
    assert admission.finality([{"watermark": 15}, {"watermark": 20}], policy)["complete_through"] == 13
    assert admission.finality([{"watermark": 15, "sealed": True}, {"sealed": True}], policy) == {"basis": "sealed_input", "complete_through": math.inf, "idle": [], "accepts_changes": False}


def test_diagnosis_timers_and_declared_completeness():
    policy = StreamPolicy(partitions=2, watermark="source_managed", lateness=1)
    assert admission.diagnose([{"watermark": 5}, {}], policy) == {"blocking": [1], "reason": "no declared watermark"}
    assert admission.diagnose([{"watermark": 5}, {"watermark": 3}], policy)["blocking"] == [1]
    assert admission.timer_due(21, 21) and not admission.timer_due(21, 20.9) and admission.timer_due(21, None, sealed=True)
    done = admission.declare_complete([{"watermark": 5}, {"sealed": True}], 20, policy)
    assert done[0]["watermark"] == 21 and done[1] == {"sealed": True}
    with pytest.raises(ValueError, match="fall"):
        admission.declare_complete(done, 3, policy)


def test_forwarded_changes_keep_kinds_and_partitions(spark):
    from sluicework.functions import fnv1a
    from sluicework.plans.pipeline import forward

    changes = spark.createDataFrame([("a", 1, at(1), 9, "insert"), (None, 2, at(2), 8, "delete")], "key string, sequence long, event_time timestamp_ntz, level int, kind string")
    got = forward(changes, "n", stream="s", value=["level"], partitions=5).orderBy("sequence").collect()
    assert [(r.partition, r.kind, r.event_id) for r in got] == [(fnv1a(b"a") % 5, "insert", "operator:n:1:insert"), (0, "delete", "operator:n:2:delete")]


def test_interval_join_with_retraction(spark):
    left = records(spark, [("a", 10, ("login-a",)), ("b", 20, ("login-b",))], "struct<v:string>")
    right = records(spark, [("a", 12, ("purchase-a",)), ("a", 12, ("purchase-a",), "delete"), ("a", 14, ("purchase-country",)), ("a", 17, ("outside",)), ("b", 23, ("low",))], "struct<v:string>")
    flat = lambda d: d.withColumn("v", F.col("value.v"))
    pairs = joins.interval(joins.netted(flat(left), ["key", "v", "event_time"]), joins.netted(flat(right), ["key", "v", "event_time"]), joins.Interval(0, 5))
    assert sorted((r.left_v, r.right_v, secs(r.event_time)) for r in pairs.collect()) == [("login-a", "purchase-country", 14), ("login-b", "low", 23)]
    diffs = joins.diff_join(flat(left).withColumn("diff", weight()), flat(right).withColumn("diff", weight()), joins.Interval(0, 5))
    assert sorted(r["diff"] for r in diffs.filter("right_v = 'purchase-a'").collect()) == [-1, 1]


@pytest.mark.parametrize("buckets", [True, False])
def test_interval_bounds_are_inclusive(spark, buckets):
    left = records(spark, [("k", 10, (0,))])
    right = records(spark, [("k", 8, (1,)), ("k", 15, (2,)), ("k", 7.9, (3,)), ("k", 15.1, (4,))])
    got = joins.interval(left, right, joins.Interval(-2, 5), buckets=buckets).collect()
    assert sorted(r.right_value.v for r in got) == [1, 2]


def test_self_join_and_left_as_of(spark):
    visits = records(spark, [("u1", 0, ("/home",)), ("u1", 120, ("/products",)), ("u2", 200, ("/home",)), ("u1", 500, ("/checkout",)), ("u2", 900, ("/products",))], "struct<url:string>")
    got = joins.interval_self(visits, joins.Interval(0, 600)).collect()
    assert sorted((r.left_value.url, r.right_value.url) for r in got) == [("/home", "/checkout"), ("/home", "/products"), ("/products", "/checkout")]
    content = records(spark, [("/home", 0, ("Home",)), ("/products", 0, ("Products",))], "struct<title:string>")
    probes = visits.withColumn("key", F.col("value.url"))
    found = joins.as_of(probes, content, how="left").orderBy("sequence").collect()
    assert [r.version_value and r.version_value.title for r in found] == ["Home", "Products", "Home", None, "Products"]


def test_as_of_with_tombstone_and_equal_time(spark):
    versions = records(spark, [("a", 5, ("a-v1",)), ("b", 9, ("b-v1",)), ("a", 12, ("a-v2",)), ("c", 11, ("c",), "delete"), ("a", 12, ("a-v3",))], "struct<v:string>")
    probes = records(spark, [("a", 10, (1,)), ("a", 14, (2,)), ("b", 13, (3,)), ("c", 13, (4,)), ("a", 12, (5,)), ("b", 8, (6,))])
    got = {r.value.v: r.version_value and r.version_value.v for r in joins.as_of(probes, versions, how="left").collect()}
    assert got == {1: "a-v1", 2: "a-v3", 3: "b-v1", 4: None, 5: "a-v3", 6: None}
    assert {r.value.v for r in joins.as_of(probes, versions).collect()} == {1, 2, 3, 5}


def test_as_of_by_ranges_agrees_with_one_range(spark):
    rng = random.Random(5)
    kinds = ["upsert", "upsert", "delete"]
    versions = records(spark, [(rng.choice("aaab"), rng.randrange(200), (i,), rng.choice(kinds)) for i in range(120)])
    probes = records(spark, [(rng.choice("aaabc"), rng.randrange(220), (i,)) for i in range(200)])
    pick = lambda ranges: sorted((r.value.v, r.version_value and r.version_value.v) for r in joins.as_of(probes, versions, how="left", ranges=ranges, hot_rows=1).collect())
    assert pick(1) == pick(7)


def test_deduplicate_by_event_time(spark):
    rows = records(spark, [("a", 10, (0,)), ("a", 7, (1,)), ("b", 9, (2,)), ("a", 11, (3,))])
    assert sorted((r.key, secs(r.event_time)) for r in ranking.deduplicate(rows).collect()) == [("a", 7), ("b", 9)]
    out = ranking.deduplicate_outputs(rows).filter("suppressed").orderBy("sequence").collect()
    assert [(r.sequence, r.canonical) for r in out] == [(0, 1), (3, 1)]
    with pytest.raises(Exception, match="retractions"):
        ranking.deduplicate(records(spark, [("a", 1, (0,), "delete")])).collect()


def test_top_n_counts_nulls_and_order(spark):
    rows = spark.createDataFrame([("a", 100.0, 2), ("b", 90.0, 1), ("c", None, 1)], "id string, score double, count long")
    for n, want in ((1, [("a", 1)]), (2, [("a", 2)]), (3, [("a", 2), ("b", 1)]), (4, [("a", 2), ("b", 1), ("c", 1)])):
        got = ranking.top_n(rows, [("score", "desc")], n, ties=["id"], count="count").collect()
        assert sorted((r.id, r["count"]) for r in got) == want
    assert [r.id for r in ranking.top_n(rows.drop("count"), [("score", "asc")], 3, ties=["id"]).collect()][-1] == "c"
    with pytest.raises(Exception, match="not finite"):
        ranking.top_n(spark.createDataFrame([(float("nan"),)], "x double"), [("x", "asc")], 1, ties=["x"]).collect()


def test_normalize_keeps_first_time_and_original_time_of_old_rows(spark):
    rows = spark.createDataFrame([("a", 1, 9, at(1), "upsert"), ("a", 2, 9, at(5), "upsert"), ("a", 3, -1, at(21), "upsert"), ("a", 4, None, at(30), "delete")], "id string, sequence long, score int, event_time timestamp_ntz, kind string")
    got = changelog.normalize(rows, ["id"], ["score"]).orderBy("sequence", "diff").collect()
    assert [(r.score, secs(r.event_time), r.kind, r["diff"]) for r in got] == [(9, 1, "insert", 1), (9, 1, "delete", -1), (-1, 21, "insert", 1), (-1, 21, "delete", -1)]
    with pytest.raises(Exception, match="unknown primary key"):
        changelog.normalize(rows.filter("sequence = 4"), ["id"], ["score"]).collect()


def test_random_changes_agree_with_recomputation(spark):
    rng = random.Random(741)
    live, rows = {}, []
    for i in range(350):
        k = f"id{rng.randrange(25):02d}"
        if rng.randrange(5) == 0 and k in live:
            del live[k]
            rows.append((k, i, None, None, at(i), "delete"))
        else:
            live[k] = (rng.choice("ab"), rng.randrange(13))
            rows.append((k, i, *live[k], at(i), "upsert"))
    df = spark.createDataFrame(rows, "id string, sequence long, grp string, score int, event_time timestamp_ntz, kind string")
    folded = changelog.fold(changelog.normalize(df, ["id"], ["grp", "score"]), ["id", "grp", "score"])
    assert sorted((r.id, r.grp, r.score) for r in folded.collect()) == sorted((k, *v) for k, v in live.items())
    assert sorted(r.id for r in changelog.current(df, ["id"]).collect()) == sorted(live)
    best = ranking.top_n(folded, [("score", "desc")], 3, partition_by=["grp"], ties=["id"], count="count").collect()
    want = [k for g in "ab" for k in sorted((k for k in live if live[k][0] == g), key=lambda k: (-live[k][1], k))[:3]]
    assert sorted(r.id for r in best) == sorted(want)


def test_view_fold_and_snapshot(spark, tmp_path):
    rows = spark.createDataFrame([("k", 2, 1), ("k", 2, 1), ("k", 1, 1), ("k", 1, -1)], "key string, total int, diff int")
    view = views.materialize(rows, ["key", "total"])
    assert [(r.total, r["count"]) for r in view.collect()] == [(2, 2)]
    views.snapshot(spark, {"v": view}, str(tmp_path), "s1")
    with pytest.raises(Exception):
        views.snapshot(spark, {"v": view}, str(tmp_path), "s1")
    assert views.read(spark, str(tmp_path), "s1", "v").count() == 1
    assert views.delete(spark, str(tmp_path), "s1")
    with pytest.raises(Exception, match="retracted"):
        views.materialize(spark.createDataFrame([("k", 1, -1)], "key string, total int, diff int"), ["key", "total"]).collect()


def add(state, record):
    state["balance"] = state.get("balance", 0) + record["value"]["v"]
    return state, {"balance": state["balance"]}


def add_usd(state, record):
    state, out = add(state, record)
    return state | {"currency": state["currency"]}, out


def fails_on_two(state, record):
    if record["value"]["v"] == 2:
        raise ValueError("two")
    return add(state, record)


def test_process_balance_changelog_upgrade_and_quarantine(spark):
    rows = records(spark, [("a", 10, (5,)), ("a", 12, (7,)), ("b", 11, (3,))])
    out = process.fold(rows, process.Process("balance", add))
    assert {(r.key, r.sequence): json.loads(r.state)["balance"] for r in out.collect()} == {("a", 0): 5, ("a", 1): 12, ("b", 2): 3}
    changes = changelog.running_changes(out.select("key", "sequence", "emitted"), ["key"], "emitted").filter("key = 'a'").orderBy("sequence", "diff").collect()
    assert [(json.loads(r.emitted)["balance"], r.kind) for r in changes] == [(5, "insert"), (5, "update_before"), (12, "update_after")]
    states = process.latest_states(out.filter("sequence = 0"), 1)
    second = process.Process("balance", add_usd, version=2, migrations={1: lambda s: s | {"currency": "USD"}})
    got = process.fold(records(spark, [("a", 12, (7,))]), second, states=states).first()
    assert json.loads(got.state) == {"balance": 12, "currency": "USD"}
    with pytest.raises(ValueError, match="newer"):
        process.Process("x", add).upgraded({}, 2)
    bad = process.fold(records(spark, [("a", 1, (1,)), ("a", 2, (2,)), ("a", 3, (3,))]), process.Process("q", fails_on_two, max_attempts=3)).orderBy("sequence").collect()
    assert [(r.status, r.attempts) for r in bad] == [("COMMITTED", 1), ("FAILED", 3), ("COMMITTED", 1)]
    assert json.loads(bad[2].state) == {"balance": 4} and bad[1].backoff == pytest.approx(0.3)
    assert process.Process("x", add).build != process.Process("x", fails_on_two).build


def test_batched_handler_isolates_the_failing_record(spark):
    def handler(rows):
        if any(r["x"] == 13 for r in rows):
            raise ValueError("unlucky")
        return [{"y": r["x"] * 2.0} for r in rows]

    got = process.batched(spark.range(20).select(F.col("id").alias("x")), handler, "y double", max_size=8).collect()
    assert sorted(r.x for r in got if r.error) == [13] and all(r.y == 2 * r.x for r in got if not r.error)


def test_replay_reports_the_event_that_differs(spark):
    keep = lambda n: lambda s, r: ({"seen": [*s.get("seen", []), r["value"]["v"]][-n:]}, [*s.get("seen", []), r["value"]["v"]][-n:])
    rows = records(spark, [("u", 10, (1,)), ("u", 20, (2,))]).withColumn("event_id", F.concat(F.lit("event-"), (F.col("sequence") + 1).cast("string")))
    got = process.compare(rows, process.Process("v1", keep(9)), process.Process("v2", keep(1))).collect()
    assert {r.event_id: r.matches for r in got} == {"event-1": True, "event-2": False}


def test_missing_and_null_fields_in_json(spark):
    rows = spark.createDataFrame([(1, '{"a":{"b":5}}'), (2, '{"a":{"b":null}}'), (3, '{"a":{}}'), (4, '{"a":{"b":"x"}}'), (5, "not json"), (6, '{"a":{"b":7.5}}')], "id int, value string")
    ids = lambda c, o: sorted(r.id for r in filters.filter_json(rows, "a.b", c, o).collect())
    assert ids("greater_than", 4) == [1, 6]
    assert ids("equal", 5) == [1]
    assert ids("equal", None) == [2]
    assert ids("not_equal", 5) == [2, 4, 6]
    assert ids("less_than", "x") == []


def test_idempotent_admission(spark):
    rows = spark.createDataFrame([(1, "e", "k", 1), (2, "e", "k", 1), (3, None, "k", 9), (4, None, "k", 9)], "sequence long, event_id string, key string, value int")
    assert sorted(r.sequence for r in admission.idempotent(rows).collect()) == [1, 3, 4]
    clash = spark.createDataFrame([(1, "e", "k", 1), (2, "e", "k", 2)], "sequence long, event_id string, key string, value int")
    with pytest.raises(Exception, match="other content"):
        admission.idempotent(clash).collect()


def recommended(spark, before, now, replicas, partitions, targets, spare_for=0.0):
    """before, now: (at, pending, running, completed, oldest age)"""
    rows = [(t, p, r, 0, c, age, replicas, spare_for) for t, p, r, c, age in (before, now)]
    found = scaling.recommend(spark.createDataFrame([tuple(map(float, x[:1])) + x[1:] for x in rows], scaling.SAMPLE), partitions, targets).collect()
    return [(r.replicas_wanted, r.reason) for r in found][0]


def test_scaling_recommendations(spark):
    of = scaling.Targets
    assert recommended(spark, (0, 0, 0, 100, None), (1, 20_000, 100, 5_100, None), 2, 10, of(maximum=10)) == (7, "traffic")
    assert recommended(spark, (0, 0, 0, 100, None), (60, 0, 0, 100, None), 4, 8, of(minimum=1, maximum=8, settle=60.0), 60.0) == (3, "sustained spare capacity")
    assert recommended(spark, (0, 0, 0, 1, None), (10, 0, 0, 1, None), 8, 4, of()) == (4, "partition ceiling")
    assert recommended(spark, (0, 0, 0, 1, None), (10, 1, 0, 1, None), 3, 4, of()) == (3, "scale-down stabilization")
    tight = of(latency=1.0, rate_each=1000.0, headroom=1.0)
    for age, want in ((0.5, 1), (0.96, 3), (1.1, 8)):
        assert recommended(spark, (0, 100, 0, 0, age), (1, 100, 0, 0, age), 1, 8, tight)[0] == want
    assert scaling.shares(10, 3) == ((1, 4, 7, 10), (2, 5, 8), (3, 6, 9)) and scaling.shares(2, 5) == ((1,), (2,))
    for wrong in (of(minimum=3, maximum=1), of(headroom=0.5), of(latency=-1.0)):
        with pytest.raises(ValueError, match="no sense"):
            scaling.checked(wrong)
    with pytest.raises(Exception, match="forward in time"):
        recommended(spark, (5, 0, 0, 100, None), (6, 0, 0, 90, None), 1, 1, of())


def test_graph_is_validated_and_explained(spark):
    graph = Graph("orders").stream("s").filter("large", "s", "v", "greater_than", 1).deduplicate("first", "large")
    assert graph.explain() == (
        "graph orders\n  stream s: bounded watermark, 1 partition(s), disorder 5 s, lateness 0 s, late: side_output\n"
        "  filter large <- s [comparison=greater_than, operand=1, path=v]\n  deduplicate first <- large"
    )
    got = graph.run({"s": records(spark, [("a", 1, (1,)), ("a", 2, (5,)), ("a", 1, (3,))])})["first"].collect()
    assert [r.value.v for r in got] == [3]
    graph.deduplicate("first", "large")
    with pytest.raises(ValueError, match="another meaning"):
        graph.deduplicate("first", "s")
    with pytest.raises(ValueError, match="retractions"):
        Graph("g").stream("s").normalize("n", "s", ["key"], ["sequence"]).deduplicate("d", "n").validate()
    with pytest.raises(ValueError, match="cycle"):
        Graph("g").map("a", "b", lambda d: d).map("b", "a", lambda d: d).validate()
    with pytest.raises(ValueError, match="retract mode"):
        Graph("g").stream("s").normalize("n", "s", ["key"], ["sequence"]).top_n("t", "n", [("sequence", "asc")], 1, mode="append").validate()


def test_window_grid_has_no_window_before_its_origin_and_fills_empty_ones(spark):
    rows = records(spark, [("a", 5, (1,)), ("a", 35, (2,)), ("a", -3, (9,))])
    spec = windows.WindowSpec(10)
    out = windows.with_empty(windows.aggregate(rows, spec, "sum", F.col("value.v")), spec)
    assert sorted((secs(r.window_start), r["count"]) for r in out.collect()) == [(0, 1), (10, 0), (20, 0), (30, 1)]
