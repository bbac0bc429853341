"""Registered queries of the core operators on the driver's tables, each with its SQL.

``events`` is read as a stream keyed by user with ``event_id`` as admission order. Late queries need
disorder, which the table lacks: they admit events in the order of ``event_id + (event_id * 37) % 101``.
Retractions are made by rule: every 7th event deletes what the event itself had added 5 events before,
and so on, as each query says.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import group_key
from .operators import admission, changelog, filters, joins, process, ranking, scaling, views, windows
from .plans.pipeline import Graph, forward
from .schema import StreamPolicy, weight
from .sources import tables

HOUR, DAY = 3600.0, 86400.0
QUERIES: dict = {}
SQL: dict = {}
#: A CTE that the SQL of many queries begins with.
EV = "ev AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS key, event_type, value, props FROM events)"
US = "epoch_us(ts)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    return tables.events(spark, d)


def flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("sequence").alias("event_id"), "key", "event_time", F.col("value.event_type").alias("event_type"), F.col("value.value").alias("value"))


# Filters


@query(f"WITH {EV} SELECT event_id, key, ts AS event_time, event_type, value FROM ev WHERE value > 50")
def filter_greater(spark, d):
    return flat(filters.filter_records(events(spark, d), "value", "greater_than", 50.0))


@query(f"WITH {EV} SELECT event_id, key, ts AS event_time, event_type, value FROM ev WHERE event_type = 'purchase'")
def filter_equal(spark, d):
    return flat(filters.filter_records(events(spark, d), "event_type", "equal", "purchase"))


@query(f"WITH {EV} SELECT event_id, key, ts AS event_time, event_type, value FROM ev WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 50")
def filter_nested_json(spark, d):
    rows = events(spark, d).withColumn("props", F.col("value.props"))
    return flat(filters.filter_json(rows, "k", "greater_than_or_equal", 50, value="props"))


@query(f"WITH {EV}, m AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN event_type END AS t FROM ev) SELECT event_id, key, ts AS event_time, event_type, value FROM m WHERE t IS NOT NULL AND t <> 'click'")
def filter_missing_not_equal(spark, d):
    rows = events(spark, d)
    rows = rows.withColumn("value", F.col("value").withField("maybe", F.when(F.col("sequence") % 3 != 0, F.col("value.event_type"))))
    return flat(filters.filter_records(rows, "maybe", "not_equal", "click"))


@query(f"WITH {EV} SELECT event_id, key, ts AS event_time, event_type, value FROM ev WHERE value < 12.5")
def filter_less(spark, d):
    return flat(filters.filter_records(events(spark, d), "value", "less_than", 12.5))


@query(f"WITH {EV} SELECT event_id, key, ts AS event_time, event_type, value FROM ev WHERE CAST(json_extract(props, '$.k') AS DOUBLE) <= 50")
def filter_less_or_equal_json(spark, d):
    rows = events(spark, d).withColumn("props", F.col("value.props"))
    return flat(filters.filter_json(rows, "k", "less_than_or_equal", 50, value="props"))


# Windows


def day_spec(spark, d):
    return windows.WindowSpec(DAY)


def bounds_sql(inner: str) -> str:
    return f"WITH {EV}, w AS (SELECT *, date_trunc('day', ts) AS window_start FROM ev) {inner}"


WINDOW = "key, window_start, window_start + INTERVAL 1 DAY AS window_end"


@query(bounds_sql(f"SELECT {WINDOW}, count(*) AS count FROM w WHERE value > 10 GROUP BY key, window_start"))
def tumbling_count(spark, d):
    rows = filters.filter_records(events(spark, d), "value", "greater_than", 10.0)
    return windows.aggregate(rows, windows.WindowSpec(DAY), "count", retracting=False)


@query(bounds_sql(f"SELECT {WINDOW}, count(*) AS count, round(sum(value), 6) AS sum FROM w GROUP BY key, window_start"))
def tumbling_sum(spark, d):
    out = windows.aggregate(events(spark, d), windows.WindowSpec(DAY), "sum", F.col("value.value"), retracting=False)
    return out.withColumn("sum", F.round("sum", 6))


@query(bounds_sql(f"SELECT {WINDOW}, count(*) AS count, max(value) AS max FROM w GROUP BY key, window_start"))
def tumbling_max(spark, d):
    return windows.aggregate(events(spark, d), windows.WindowSpec(DAY), "max", F.col("value.value"), retracting=False)


def origin(spark, d) -> float:
    first = tables.table(spark, d, "events").agg(F.min("ts")).first()[0]
    first = first.replace(hour=0, minute=0, second=0, microsecond=0, tzinfo=dt.UTC)
    return first.timestamp() + DAY


SLIDING = f"""WITH {EV}, o AS (SELECT date_trunc('day', min(ts)) + INTERVAL 1 DAY AS origin FROM events),
s AS (SELECT unnest(generate_series((SELECT origin FROM o), (SELECT max(ts) FROM events), INTERVAL 6 HOUR)) AS window_start)
SELECT key, window_start, window_start + INTERVAL 24 HOUR AS window_end, count(*) AS count, {{}} FROM s JOIN ev ON ts >= window_start AND ts < window_start + INTERVAL 24 HOUR GROUP BY key, window_start"""


@query(SLIDING.format("round(sum(value), 6) AS sum"))
def sliding_sum_origin(spark, d):
    spec = windows.WindowSpec(DAY, 6 * HOUR, origin(spark, d))
    return windows.aggregate(events(spark, d), spec, "sum", F.col("value.value"), retracting=False).withColumn("sum", F.round("sum", 6))


@query(SLIDING.format("max(value) AS max"))
def sliding_max_origin(spark, d):
    spec = windows.WindowSpec(DAY, 6 * HOUR, origin(spark, d))
    return windows.aggregate(events(spark, d), spec, "max", F.col("value.value"), retracting=False)


@query(f"""WITH {EV}, o AS (SELECT date_trunc('day', min(ts)) + INTERVAL 1 DAY AS origin FROM events),
w AS (SELECT key, time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, count(*) AS count, round(sum(value), 6) AS sum FROM ev, o WHERE ts >= origin GROUP BY ALL),
s AS (SELECT unnest(generate_series((SELECT origin FROM o), (SELECT max(window_start) FROM w), INTERVAL 10 MINUTE)) AS window_start)
SELECT key, window_start, window_start + INTERVAL 10 MINUTE AS window_end, count, sum FROM w
UNION ALL SELECT NULL, window_start, window_start + INTERVAL 10 MINUTE, 0, 0.0 FROM s WHERE window_start NOT IN (SELECT window_start FROM w)""")
def windows_with_empty(spark, d):
    spec = windows.WindowSpec(600.0, None, origin(spark, d))
    out = windows.aggregate(events(spark, d), spec, "sum", F.col("value.value"), retracting=False).withColumn("sum", F.round("sum", 6))
    return windows.with_empty(out, spec)


def retracting(spark, d) -> DataFrame:
    """Every 7th event comes again at the end as a deletion of itself."""
    rows = events(spark, d)
    gone = rows.filter("sequence % 7 = 0").withColumn("kind", F.lit("delete")).withColumn("sequence", F.col("sequence") + 1_000_000_000)
    return rows.withColumn("kind", F.lit("insert")).unionByName(gone)


RETRACT = f"{EV}, r AS (SELECT *, 1 AS diff, event_id AS sequence FROM ev UNION ALL SELECT *, -1, event_id + 1000000000 FROM ev WHERE event_id % 7 = 0)"


@query(f"""WITH {RETRACT}, n AS (SELECT key, date_trunc('day', ts) AS window_start, value, sum(diff) AS n FROM r GROUP BY ALL)
SELECT {WINDOW}, CAST(sum(n) AS BIGINT) AS count, max(value) FILTER (WHERE n > 0) AS max FROM n GROUP BY key, window_start HAVING sum(n) > 0""")
def window_max_retract(spark, d):
    return windows.aggregate(retracting(spark, d), windows.WindowSpec(DAY), "max", F.col("value.value"))


@query(f"""WITH {RETRACT} SELECT key, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, CAST(sum(diff) AS BIGINT) AS count FROM r GROUP BY ALL HAVING sum(diff) > 0""")
def window_count_retract(spark, d):
    return windows.aggregate(retracting(spark, d), windows.WindowSpec(DAY), "count")


@query(f"""WITH {RETRACT}, a AS (SELECT *, date_trunc('day', ts) AS ws, CAST(sum(diff) OVER w AS BIGINT) AS n, sum(value * diff) OVER w AS s FROM r WINDOW w AS (PARTITION BY key, date_trunc('day', ts) ORDER BY sequence)),
b AS (SELECT *, coalesce(lag(n) OVER w, 0) AS pn, coalesce(lag(s) OVER w, 0) AS ps FROM a WINDOW w AS (PARTITION BY key, ws ORDER BY sequence))
SELECT key, ws AS window_start, ws + INTERVAL 1 DAY AS window_end, ts AS event_time, sequence, n AS count, round(s, 4) + 0.0 AS sum, CASE WHEN pn = 0 THEN 'insert' ELSE 'update_after' END AS kind, CAST(1 AS BIGINT) AS diff FROM b WHERE n > 0
UNION ALL SELECT key, ws, ws + INTERVAL 1 DAY, ts, sequence, pn, round(ps, 4) + 0.0, CASE WHEN n = 0 THEN 'delete' ELSE 'update_before' END, CAST(-1 AS BIGINT) FROM b WHERE pn > 0""")
def window_changelog(spark, d):
    return windows.changes(retracting(spark, d), windows.WindowSpec(DAY), F.col("value.value")).withColumn("sum", F.round("sum", 4) + 0.0)


@query(f"WITH {EV}, w AS (SELECT *, date_trunc('day', ts) AS window_start FROM ev), m AS (SELECT max(ts) AS top FROM events) SELECT {WINDOW}, count(*) AS count FROM w, m GROUP BY key, window_start, top HAVING window_start + INTERVAL 1 DAY + INTERVAL 60 SECOND <= top - INTERVAL 300 SECOND")
def windows_due(spark, d):
    top = tables.table(spark, d, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    out = windows.aggregate(events(spark, d), windows.WindowSpec(DAY), "count", retracting=False)
    return windows.due(out, top / 1e6 - 300.0, 60.0)


@query(f"""WITH {RETRACT}, w AS (SELECT *, date_trunc('day', ts) AS ws FROM r),
a AS (SELECT x.key, x.ws, x.ts, x.sequence, CAST(sum(y.diff) AS BIGINT) AS n, (SELECT max(value) FROM (SELECT z.value, sum(z.diff) AS c FROM w z WHERE z.key = x.key AND z.ws = x.ws AND z.sequence <= x.sequence GROUP BY z.value) WHERE c > 0) AS top
FROM w x JOIN w y ON y.key = x.key AND y.ws = x.ws AND y.sequence <= x.sequence GROUP BY x.key, x.ws, x.ts, x.sequence),
b AS (SELECT *, coalesce(lag(n) OVER v, 0) AS pn, lag(top) OVER v AS pt FROM a WINDOW v AS (PARTITION BY key, ws ORDER BY sequence))
SELECT key, ws AS window_start, ws + INTERVAL 1 DAY AS window_end, ts AS event_time, sequence, n AS count, top AS max, CASE WHEN pn = 0 THEN 'insert' ELSE 'update_after' END AS kind, CAST(1 AS BIGINT) AS diff FROM b WHERE n > 0
UNION ALL SELECT key, ws, ws + INTERVAL 1 DAY, ts, sequence, pn, pt, CASE WHEN n = 0 THEN 'delete' ELSE 'update_before' END, CAST(-1 AS BIGINT) FROM b WHERE pn > 0""")
def window_max_changelog(spark, d):
    return windows.max_changes(retracting(spark, d), windows.WindowSpec(DAY), F.col("value.value"))


@query(f"""WITH {EV}, w AS (SELECT *, date_trunc('day', ts) AS window_start FROM ev), m AS (SELECT epoch_us(max(ts)) / 1000000 - 300.0 AS mark FROM events)
SELECT 'daily' AS schedule, 'events' AS stream, 'count' AS aggregation, {WINDOW}, count(*) AS count, mark AS watermark, false AS finalized, 'window:daily:' || key || ':' || epoch_us(window_start) AS id
FROM w, m GROUP BY key, window_start, mark HAVING epoch_us(window_start + INTERVAL 1 DAY) / 1000000 + 60 <= mark""")
def windows_fired(spark, d):
    top = tables.table(spark, d, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    out = windows.aggregate(events(spark, d), windows.WindowSpec(DAY), "count", retracting=False)
    return windows.fired(out, "daily", "events", "count", top / 1e6 - 300.0, lateness=60.0)


# De-duplication and ranking


@query("""SELECT user_id || ':' || event_type AS key, min(event_id) AS event_id, min(ts) AS event_time FROM (SELECT *, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS f FROM events) WHERE event_id = f GROUP BY ALL""")
def dedup_first(spark, d):
    rows = events(spark, d).withColumn("key", F.concat_ws(":", "key", "value.event_type"))
    return ranking.deduplicate(rows).select("key", F.col("sequence").alias("event_id"), "event_time")


@query("""SELECT user_id || ':' || event_type AS key, event_id, first_value(event_id) OVER w AS canonical, event_id <> first_value(event_id) OVER w AS suppressed FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def dedup_outputs(spark, d):
    rows = events(spark, d).withColumn("key", F.concat_ws(":", "key", "value.event_type"))
    return ranking.deduplicate_outputs(rows).select("key", F.col("sequence").alias("event_id"), "canonical", "suppressed")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def topn_group(spark, d):
    return ranking.top_n(tables.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), [("o_totalprice", "desc")], 3, partition_by=["o_custkey"], ties=["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topn_global(spark, d):
    return ranking.top_n(tables.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", "desc")], 25, ties=["o_orderkey"])


@query("""WITH b AS (SELECT user_id, CAST(round(value) AS BIGINT) AS score, count(*) AS count FROM events GROUP BY ALL),
c AS (SELECT *, coalesce(sum(count) OVER (PARTITION BY user_id ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT user_id, score, CAST(least(count, 10 - before) AS BIGINT) AS count FROM c WHERE before < 10""")
def topn_bag(spark, d):
    rows = tables.table(spark, d, "events").select("user_id", F.expr("cast(round(value) as bigint)").alias("score"), F.lit(1).alias("diff"))
    bag = changelog.fold(rows, ["user_id", "score"])
    return ranking.top_n(bag, [("score", "desc")], 10, partition_by=["user_id"], ties=["score"], count="count")


@query("""WITH a AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderkey % 2 = 0),
b AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice, 'delete' AS kind, CAST(-1 AS BIGINT) AS diff FROM a WHERE r <= 2 AND o_orderkey NOT IN (SELECT o_orderkey FROM b WHERE r <= 2)
UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, 'insert', CAST(1 AS BIGINT) FROM b WHERE r <= 2 AND o_orderkey NOT IN (SELECT o_orderkey FROM a WHERE r <= 2)""")
def topn_changes(spark, d):
    rows = tables.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    best = lambda df: ranking.top_n(df, [("o_totalprice", "desc")], 2, partition_by=["o_custkey"], ties=["o_orderkey"])
    return ranking.winner_changes(best(rows.filter("o_orderkey % 2 = 0")), best(rows))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def collection_rows(spark, d):
    """The rows of one key; more than the limit would be an error."""
    orders = tables.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return views.rows_of(orders, where={"o_custkey": 7}, limit=1_000).drop("o_custkey")


@query("SELECT event_id, user_id FROM events WHERE ts <= (SELECT max(ts) - INTERVAL 3 DAY FROM events)")
def timers_due(spark, d):
    """A timer at every event; those at or before the watermark fire."""
    rows = tables.table(spark, d, "events")
    top = rows.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    return admission.timers_due(rows.withColumnRenamed("ts", "at"), top / 1e6 - 3 * DAY).select("event_id", "user_id")


@query("""SELECT '["' || user_id || '","' || event_type || '"]' AS group_key, count(*) AS n FROM events GROUP BY ALL""")
def group_keys(spark, d):
    rows = events(spark, d).select("key", F.col("value.event_type").alias("event_type"))
    return rows.groupBy(group_key("key", "event_type").alias("group_key")).agg(F.count("*").alias("n"))


# Changelogs


def table_changes(spark, d) -> DataFrame:
    """Per user and type, values rounded to tens as upserts; every 7th event deletes the key."""
    rows = tables.table(spark, d, "events")
    return rows.select(F.col("user_id").cast("string").alias("id"), "event_type", F.floor(F.col("value") / 50).cast("bigint").alias("level"), F.col("event_id").alias("sequence"), F.col("ts").alias("event_time"), F.when(F.col("event_id") % 7 == 0, "delete").otherwise("upsert").alias("kind"))


CHANGES = """c AS (SELECT CAST(user_id AS VARCHAR) AS id, event_type, CAST(floor(value / 50) AS BIGINT) AS level, event_id AS sequence, ts AS event_time, event_id % 7 = 0 AS gone FROM events)"""


@query(f"""WITH {CHANGES}, l AS (SELECT *, row_number() OVER (PARTITION BY id, event_type ORDER BY sequence DESC) AS r FROM c) SELECT id, event_type, level, event_time FROM l WHERE r = 1 AND NOT gone""")
def normalize_current(spark, d):
    return changelog.current(table_changes(spark, d), ["id", "event_type"]).select("id", "event_type", "level", "event_time")


@query(f"""WITH {CHANGES}, a AS (SELECT *, CASE WHEN NOT gone THEN level END AS state FROM c),
b AS (SELECT *, lag(state) OVER (PARTITION BY id, event_type ORDER BY sequence) AS prev FROM a),
m AS (SELECT *, lag(state) OVER w AS old, lag(event_time) OVER w AS old_time FROM b WHERE state IS DISTINCT FROM prev WINDOW w AS (PARTITION BY id, event_type ORDER BY sequence))
SELECT id, event_type, old AS level, old_time AS event_time, 'delete' AS kind, CAST(-1 AS BIGINT) AS diff, sequence FROM m WHERE old IS NOT NULL
UNION ALL SELECT id, event_type, state, event_time, 'insert', CAST(1 AS BIGINT), sequence FROM m WHERE state IS NOT NULL""")
def normalize_changelog(spark, d):
    return changelog.normalize(table_changes(spark, d), ["id", "event_type"], ["level"], strict=False)


MOVES = f"""WITH {CHANGES}, a AS (SELECT *, CASE WHEN NOT gone THEN level END AS state FROM c),
b AS (SELECT *, lag(state) OVER (PARTITION BY id, event_type ORDER BY sequence) AS prev FROM a),
m AS (SELECT *, lag(state) OVER w AS old, lag(event_time) OVER w AS old_time FROM b WHERE state IS DISTINCT FROM prev WINDOW w AS (PARTITION BY id, event_type ORDER BY sequence))"""


@query(f"""{MOVES} SELECT id, event_type, old AS level, old_time AS event_time, 'delete' AS kind, CAST(-1 AS BIGINT) AS diff, sequence * 2 AS sequence FROM m WHERE old IS NOT NULL
UNION ALL SELECT id, event_type, state, event_time, 'insert', CAST(1 AS BIGINT), sequence * 2 + 1 FROM m WHERE state IS NOT NULL""")
def normalize_retract(spark, d):
    """The changes of a normalised table as a retract input: each retraction meets the stored row."""
    changes = changelog.normalize(table_changes(spark, d), ["id", "event_type"], ["level"], strict=False)
    changes = changes.drop("diff").withColumn("sequence", F.col("sequence") * 2 + F.when(F.col("kind") == "insert", 1).otherwise(0))
    return changelog.normalize(changes, ["id", "event_type"], ["level"], mode="retract")


@query(f"WITH {EV} SELECT key, event_type, count(*) AS count FROM ev GROUP BY ALL")
def append_only_view(spark, d):
    rows = changelog.checked(events(spark, d).withColumn("kind", F.lit("insert")), "append")
    return views.materialize(rows.select("key", F.col("value.event_type").alias("event_type"), weight().alias("diff")), ["key", "event_type"])


@query(f"WITH {RETRACT} SELECT key, event_type, CAST(sum(diff) AS BIGINT) AS count FROM r GROUP BY ALL HAVING sum(diff) > 0")
def view_fold(spark, d):
    rows = retracting(spark, d).withColumn("event_type", F.col("value.event_type")).withColumn("diff", F.when(F.col("kind") == "delete", -1).otherwise(1))
    return views.materialize(rows, ["key", "event_type"])


@query(f"WITH {RETRACT} SELECT key, event_id AS item, ts AS event_time, CAST(sum(diff) AS BIGINT) AS count FROM r GROUP BY ALL HAVING sum(diff) > 0")
def bag_net(spark, d):
    rows = retracting(spark, d).withColumn("item", F.col("value.event_id"))
    return changelog.bag(rows, ["key", "item", "event_time"])


@query(f"""WITH {CHANGES}, a AS (SELECT *, CASE WHEN NOT gone THEN level END AS state FROM c), b AS (SELECT *, lag(state) OVER (PARTITION BY id, event_type ORDER BY sequence) AS prev FROM a),
m AS (SELECT *, lag(state) OVER w AS old, lag(event_time) OVER w AS old_time FROM b WHERE state IS DISTINCT FROM prev WINDOW w AS (PARTITION BY id, event_type ORDER BY sequence)),
ch AS (SELECT event_type, old AS level, old_time AS t, -1 AS diff FROM m WHERE old IS NOT NULL UNION ALL SELECT event_type, state, event_time, 1 FROM m WHERE state IS NOT NULL)
SELECT event_type AS key, date_trunc('day', t) AS window_start, date_trunc('day', t) + INTERVAL 1 DAY AS window_end, CAST(sum(diff) AS BIGINT) AS count, CAST(sum(level * diff) AS DOUBLE) AS sum FROM ch GROUP BY ALL HAVING sum(diff) > 0""")
def normalize_to_windows(spark, d):
    """Changes of a normalised table forwarded as records: windows take old rows out at their own time."""
    changes = changelog.normalize(table_changes(spark, d), ["id", "event_type"], ["level"], strict=False)
    return windows.aggregate(forward(changes, "normalize", stream="levels", key="event_type", value=["level"]), windows.WindowSpec(DAY), "sum", F.col("value.level"))


# Joins


def versions(spark, d) -> DataFrame:
    """Orders as versions of their customer, shifted into the time of the events; every 5th deletes."""
    rows = events(spark, d).filter("value.event_type = 'view'")
    return rows.select("key", "event_time", "sequence", F.col("value.value").alias("level"), F.when(F.col("sequence") % 5 == 0, "delete").otherwise("upsert").alias("kind"))


def probes(spark, d) -> DataFrame:
    return events(spark, d).filter("value.event_type = 'purchase'").select("key", "event_time", "sequence", F.col("value.value").alias("amount"))


ASOF = f"""WITH {EV}, v AS (SELECT key, ts, event_id AS vseq, value AS level, event_id % 5 = 0 AS gone FROM ev WHERE event_type = 'view'),
p AS (SELECT key, ts, event_id, value FROM ev WHERE event_type = 'purchase'),
j AS (SELECT p.key, p.ts AS event_time, p.event_id AS sequence, p.value AS amount, v.level, v.vseq, v.gone FROM p ASOF LEFT JOIN v ON p.key = v.key AND p.ts >= v.ts)
SELECT key, event_time, sequence, amount, CASE WHEN NOT gone THEN level END AS version_level, coalesce(CASE WHEN NOT gone THEN vseq END, -1) AS version_sequence FROM j"""


def as_of_query(spark, d, how, kinds=True):
    right = versions(spark, d)
    found = joins.as_of(probes(spark, d), right if kinds else right.drop("kind"), how=how, version_columns=["level", "sequence"])
    return found.withColumn("version_sequence", F.coalesce("version_sequence", F.lit(-1).cast("long")))


@query(ASOF + " WHERE vseq IS NOT NULL AND NOT gone")
def asof_inner(spark, d):
    return as_of_query(spark, d, "inner")


@query(ASOF)
def asof_left(spark, d):
    return as_of_query(spark, d, "left")


@query("SELECT sequence FROM (" + ASOF.replace("SELECT key, event_time, sequence", "SELECT vseq, gone, key, event_time, sequence") + ") WHERE gone")
def asof_tombstone(spark, d):
    """Probes that lose their match to a deletion: matched if deletions were versions, but not by them."""
    any_version = as_of_query(spark, d, "inner", kinds=False).select("sequence")
    return any_version.join(as_of_query(spark, d, "inner").select("sequence"), "sequence", "left_anti")


@query(ASOF.replace("WHERE event_type = 'purchase'", "WHERE event_type = 'purchase' AND event_id % 4 <> 0"))
def asof_probe_retract(spark, d):
    """Every 4th event's probe is taken back before the join."""
    rows = probes(spark, d)
    back = rows.filter("sequence % 4 = 0").withColumn("kind", F.lit("delete")).withColumn("sequence", F.col("sequence") + 1_000_000_000)
    rows = rows.withColumn("kind", F.lit("insert")).unionByName(back).withColumn("id", F.col("sequence") % 1_000_000_000)
    found = joins.as_of(rows, versions(spark, d), how="left", version_columns=["level", "sequence"], retracting=True).drop("id")
    return found.withColumn("version_sequence", F.coalesce("version_sequence", F.lit(-1).cast("long")))


PAIRS = f"""WITH {EV} SELECT l.key AS key, l.event_id AS left_id, r.event_id AS right_id, greatest(l.ts, r.ts) AS event_time FROM ev l JOIN ev r ON l.key = r.key AND r.ts BETWEEN l.ts AND l.ts + INTERVAL 1 DAY"""


def paired(df):
    return df.select(F.col("left_key").alias("key"), F.col("left_sequence").alias("left_id"), F.col("right_sequence").alias("right_id"), "event_time")


@query(PAIRS + " WHERE l.event_type = 'click' AND r.event_type = 'purchase'")
def interval_join(spark, d):
    rows = events(spark, d).select("key", "event_time", "sequence", F.col("value.event_type").alias("t"))
    return paired(joins.interval(rows.filter("t = 'click'").drop("t"), rows.filter("t = 'purchase'").drop("t"), joins.Interval(0, DAY)))


@query(PAIRS + " WHERE l.ts < r.ts AND l.event_id < r.event_id AND l.event_type = 'purchase' AND r.event_type = 'purchase'")
def interval_self(spark, d):
    rows = events(spark, d).filter("value.event_type = 'purchase'").select("key", "event_time", "sequence")
    return paired(joins.interval_self(rows, joins.Interval(0, DAY)))


@query(f"""WITH {RETRACT}, n AS (SELECT key, event_id, ts, event_type FROM r GROUP BY ALL HAVING sum(diff) > 0)
SELECT l.key AS key, l.event_id AS left_id, r.event_id AS right_id FROM n l JOIN n r ON l.key = r.key AND r.ts BETWEEN l.ts AND l.ts + INTERVAL 1 DAY WHERE l.event_type = 'click' AND r.event_type = 'purchase'""")
def interval_join_retract(spark, d):
    rows = retracting(spark, d).withColumn("item", F.col("value.event_id")).withColumn("t", F.col("value.event_type"))
    open_ = joins.netted(rows, ["key", "item", "event_time", "t"])
    left, right = open_.filter("t = 'click'"), open_.filter("t = 'purchase'")
    pairs = joins.interval(left, right, joins.Interval(0, DAY))
    return pairs.select(F.col("left_key").alias("key"), F.col("left_item").alias("left_id"), F.col("right_item").alias("right_id"))


# Admission

POLICY = StreamPolicy(disorder=600.0, lateness=1200.0)
TWO = StreamPolicy(partitions=2, disorder=600.0, lateness=1200.0, drift=1800.0)


def disordered(spark, d) -> DataFrame:
    rows = events(spark, d).withColumn("partition", F.when(F.col("sequence") % 2 == 0, 0).otherwise(1))
    shuffled = F.col("sequence") + (F.col("sequence") * 37) % 101
    return rows.withColumn("event_id", F.col("sequence")).withColumn("sequence", shuffled * 1000 + F.col("sequence") % 1000)


ADMIT = """a AS (SELECT event_id, ts, event_id % 2 AS p, (event_id + (event_id * 37) % 101) * 1000 + event_id % 1000 AS sequence FROM events)"""
ONE_MARK = f"{ADMIT}, m AS (SELECT *, max(epoch_us(ts) - 600000000) OVER (ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS watermark_before FROM a)"
TWO_MARK = f"""{ADMIT}, m0 AS (SELECT *, max(CASE WHEN p = 0 THEN epoch_us(ts) - 600000000 END) OVER w AS a0, max(CASE WHEN p = 1 THEN epoch_us(ts) - 600000000 END) OVER w AS a1 FROM a WINDOW w AS (ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, CASE WHEN a0 IS NOT NULL AND a1 IS NOT NULL THEN least(a0, a1) END AS watermark_before FROM m0)"""
JUDGE = "coalesce(epoch_us(ts) <= watermark_before, false) AS late, coalesce(epoch_us(ts) <= watermark_before - 1200000000, false) AS too_late"
DISPOSE = f"SELECT event_id, sequence, coalesce(watermark_before, -1) AS watermark_before, late, too_late, CASE WHEN too_late THEN 'side_output' WHEN late THEN 'accepted_late' ELSE 'accepted' END AS disposition FROM (SELECT *, {JUDGE} FROM m)"


def shown(df):
    return df.select(F.col("event_id").cast("long").alias("event_id"), "sequence", F.coalesce("watermark_before", F.lit(-1)).alias("watermark_before"), "late", "too_late", "disposition")


@query(f"WITH {ONE_MARK} {DISPOSE}")
def late_classify(spark, d):
    return shown(admission.classify(disordered(spark, d), POLICY))


@query(f"WITH {TWO_MARK} {DISPOSE}")
def watermark_multi_partition(spark, d):
    return shown(admission.classify(disordered(spark, d), TWO))


@query(f"WITH {ONE_MARK} SELECT event_id, sequence FROM ({DISPOSE}) WHERE disposition = 'side_output'")
def late_side_output(spark, d):
    return admission.side_output(admission.classify(disordered(spark, d), POLICY)).select(F.col("event_id").cast("long").alias("event_id"), "sequence")


@query(f"WITH {ONE_MARK} SELECT sequence, coalesce(watermark_before, -1) AS watermark_before FROM m")
def watermark_trace(spark, d):
    return admission.watermarks(disordered(spark, d), POLICY).select("sequence", F.coalesce("watermark_before", F.lit(-1)).alias("watermark_before"))


#: A fold record by record: the watermarks of three partitions, moved by the records that are let in.
THREE = StreamPolicy(partitions=3, disorder=600.0, drift=7200.0)
FOLD = """WITH RECURSIVE a AS MATERIALIZED (SELECT event_id, event_id % 3 AS p, epoch_us(ts) - 600000000 AS own, row_number() OVER (ORDER BY (event_id + (event_id * 37) % 101) * 1000 + event_id % 1000) AS n FROM events),
f AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS w0, NULL::BIGINT AS w1, NULL::BIGINT AS w2, false AS rejected
UNION ALL SELECT n, event_id, CASE WHEN p = 0 AND NOT bad THEN moved ELSE w0 END, CASE WHEN p = 1 AND NOT bad THEN moved ELSE w1 END, CASE WHEN p = 2 AND NOT bad THEN moved ELSE w2 END, bad
FROM (SELECT *, coalesce(moved > CASE p WHEN 0 THEN CASE WHEN w1 IS NOT NULL AND w2 IS NOT NULL THEN least(w1, w2) END WHEN 1 THEN CASE WHEN w0 IS NOT NULL AND w2 IS NOT NULL THEN least(w0, w2) END ELSE CASE WHEN w0 IS NOT NULL AND w1 IS NOT NULL THEN least(w0, w1) END END + 7200000000, false) AS bad
FROM (SELECT a.n, a.event_id, p, own, w0, w1, w2, greatest(own, CASE p WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END) AS moved FROM f JOIN a ON a.n = f.n + 1)))"""


@query(FOLD + " SELECT event_id, rejected AS rejected_alignment FROM f WHERE n > 0")
def watermark_alignment(spark, d):
    rows = disordered(spark, d).withColumn("partition", (F.col("event_id").cast("long") % 3).cast("int"))
    return admission.misaligned(rows, THREE).select(F.col("event_id").cast("long").alias("event_id"), "rejected_alignment")


@query(f"""WITH {ONE_MARK}, j AS (SELECT *, {JUDGE} FROM m) SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, user_id_key AS key, count(*) AS count FROM (SELECT j.*, CAST(e.user_id AS VARCHAR) AS user_id_key FROM j JOIN events e USING (event_id)) WHERE NOT too_late GROUP BY ALL""")
def accepted_windows(spark, d):
    return windows.aggregate(admission.accepted(admission.classify(disordered(spark, d), POLICY)), windows.WindowSpec(DAY), "count", retracting=False).select("window_start", "window_end", "key", "count")


@query("SELECT min(event_id) AS event_id, user_id || ':' || event_type || ':' || CAST(date_trunc('hour', ts) AS VARCHAR) AS name FROM events GROUP BY name")
def event_id_dedup(spark, d):
    rows = events(spark, d)
    name = F.concat_ws(":", "key", "value.event_type", F.date_trunc("hour", "event_time").cast("timestamp_ntz").cast("string"))
    first = admission.idempotent(rows.withColumn("event_id", name), strict=False)
    return first.select(F.col("sequence").alias("event_id"), F.col("event_id").alias("name"))


@query(f"WITH {ONE_MARK} SELECT event_id, sequence FROM ({DISPOSE}) WHERE disposition <> 'side_output'")
def late_drop(spark, d):
    policy = StreamPolicy(disorder=600.0, lateness=1200.0, late_policy="drop")
    return admission.accepted(admission.classify(disordered(spark, d), policy)).select(F.col("event_id").cast("long").alias("event_id"), "sequence")


@query(f"WITH {ONE_MARK} SELECT event_id, sequence, disposition = 'side_output' AS beyond FROM ({DISPOSE})")
def late_accept(spark, d):
    policy = StreamPolicy(disorder=600.0, lateness=1200.0, late_policy="accept")
    rows = admission.accepted(admission.classify(disordered(spark, d), policy))
    return rows.select(F.col("event_id").cast("long").alias("event_id"), "sequence", (F.col("disposition") == "accepted_too_late").alias("beyond"))


@query(f"WITH {ADMIT} SELECT sequence, coalesce(max(epoch_us(ts)) OVER (ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS watermark_before FROM a")
def watermark_monotonic(spark, d):
    """Monotonic streams allow for no disorder, whatever the policy says of it."""
    found = admission.watermarks(disordered(spark, d), StreamPolicy(watermark="monotonic", disorder=600.0))
    return found.select("sequence", F.coalesce("watermark_before", F.lit(-1)).alias("watermark_before"))


@query(f"""WITH {ADMIT}, s AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN epoch_us(ts) END AS said FROM a),
m AS (SELECT *, max(CASE WHEN p = 0 THEN said END) OVER w AS a0, max(CASE WHEN p = 1 THEN said END) OVER w AS a1 FROM s WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, CASE WHEN a0 IS NOT NULL AND a1 IS NOT NULL THEN least(a0, a1) ELSE -1 END AS watermark_before FROM m""".replace("event_id % 50 = 0", "event_id % 50 < 2"))
def watermark_source_managed(spark, d):
    """Only what sources declare counts: here two of fifty records of either partition."""
    rows = events(spark, d).withColumn("partition", (F.col("sequence") % 2).cast("int"))
    rows = rows.withColumn("said", F.when(F.col("sequence") % 50 < 2, F.unix_micros(F.col("event_time").cast("timestamp"))))
    rows = admission.monotone(rows.filter("said is not null"), "said").unionByName(rows.filter("said is null"))
    found = admission.watermarks(rows, StreamPolicy(partitions=2, watermark="source_managed"), declared="said")
    return found.select(F.col("sequence").alias("event_id"), F.coalesce("watermark_before", F.lit(-1)).alias("watermark_before"))


#: Three partitions: the second is silent for long stretches, the third ends early.
QUIET = StreamPolicy(partitions=3, disorder=600.0, idle_timeout=3600.0)
QUIET_SQL = """q AS (SELECT event_id, ts, epoch_us(ts) AS came, CASE WHEN event_id % 3 = 2 AND event_id > 900 THEN 0 WHEN event_id % 3 = 1 AND event_id // 400 % 2 = 1 THEN 0 ELSE event_id % 3 END AS p, event_id = 899 AS sealed FROM events),
v AS (SELECT *, CASE WHEN NOT sealed THEN came - 600000000 END AS own FROM q),
""" + "".join(
    f"w{p} AS (SELECT event_id, max(CASE WHEN p = {p} THEN own END) OVER o AS w{p}, coalesce(max(CASE WHEN p = {p} THEN came END) OVER o, first_value(came) OVER (ORDER BY event_id)) AS l{p}, coalesce(bool_or(p = {p} AND sealed) OVER o, false) AS s{p} FROM v WINDOW o AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    for p in range(3)
)
QUIET_SQL += "g AS (SELECT v.*, " + ", ".join(f"w{p}, NOT s{p} AND v.came - l{p} < 3600000000 AS n{p}, CASE WHEN v.p = {p} THEN NOT sealed ELSE NOT s{p} AND v.came - l{p} < 3600000000 END AS b{p}, CASE WHEN v.p = {p} AND NOT sealed THEN greatest(w{p}, own) ELSE w{p} END AS x{p}" for p in range(3))
QUIET_SQL += " FROM v JOIN w0 USING (event_id) JOIN w1 USING (event_id) JOIN w2 USING (event_id)), "
QUIET_SQL += "c AS (SELECT *, " + ", ".join(f"CASE WHEN {' AND '.join(f'(NOT {on}{p} OR {mark}{p} IS NOT NULL)' for p in range(3))} THEN least({', '.join(f'CASE WHEN {on}{p} THEN {mark}{p} END' for p in range(3))}) END AS {name}" for on, mark, name in (("n", "w", "now"), ("b", "x", "after"))) + " FROM g)"


@query(f"WITH {QUIET_SQL} SELECT event_id, coalesce(greatest(now, max(greatest(now, after)) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), -1) AS watermark_before FROM c")
def watermark_idle_and_sealed(spark, d):
    """Partitions that are silent for an hour, or have ended, hold the combined watermark no longer."""
    e = F.col("sequence")
    rows = events(spark, d).withColumn("partition", F.when((e % 3 == 2) & (e > 900), 0).when((e % 3 == 1) & (F.floor(e / 400) % 2 == 1), 0).otherwise(e % 3).cast("int"))
    rows = rows.withColumn("sealed", e == 899).withColumn("ingested", F.col("event_time"))
    first = tables.table(spark, d, "events").agg(F.min_by(F.unix_micros(F.col("ts").cast("timestamp")), "event_id")).first()[0]
    found = admission.watermarks(rows, QUIET, sealed="sealed", ingested="ingested", created=first / 1e6)
    return found.select(e.alias("event_id"), F.coalesce("watermark_before", F.lit(-1)).alias("watermark_before"))


@query("""SELECT event_id, user_id // 10 AS batch, count(*) OVER w <= 250 AND min(value) OVER w >= 0.5 AS admitted FROM events WINDOW w AS (PARTITION BY user_id // 10)""")
def whole_batches(spark, d):
    rows = tables.table(spark, d, "events").select("event_id", F.floor(F.col("user_id") / 10).cast("long").alias("batch"), "value")
    return admission.whole_batches(rows, "batch", F.col("value") >= 0.5, most=250).select("event_id", "batch", "admitted")


@query("SELECT min(event_id) AS event_id, CAST(user_id AS VARCHAR) AS key, event_type AS name FROM events GROUP BY user_id, event_type")
def event_id_per_key(spark, d):
    """Records that go to a process directly: an id counts within its key."""
    first = admission.idempotent(events(spark, d).withColumn("event_id", F.col("value.event_type")), scope=("key",), strict=False)
    return first.select(F.col("sequence").alias("event_id"), "key", F.col("event_id").alias("name"))


# Processes


def balance(state, record):
    state["balance"] = round(state.get("balance", 0) + record["amount"], 6)
    state["events"] = state.get("events", 0) + 1
    return state, {"balance": state["balance"]}


def amounts(spark, d):
    return events(spark, d).select("key", "sequence", "event_time", F.col("event_id"), F.expr("cast(round(value.value) as bigint)").alias("amount"))


RUNNING = f"WITH {EV}, b AS (SELECT key, event_id AS sequence, CAST(sum(CAST(round(value) AS BIGINT)) OVER w AS BIGINT) AS balance, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY key ORDER BY event_id))"


@query(RUNNING + " SELECT key, sequence, balance, n AS events, 'COMMITTED' AS status FROM b")
def process_balance(spark, d):
    out = process.fold(amounts(spark, d), process.Process("balance", balance))
    state = F.from_json("state", "balance bigint, events bigint")
    return out.select("key", "sequence", state["balance"].alias("balance"), state["events"].alias("events"), "status")


@query(RUNNING + """, c AS (SELECT *, lag(balance) OVER (PARTITION BY key ORDER BY sequence) AS old FROM b)
SELECT key, sequence, balance AS emitted, CASE WHEN old IS NULL THEN 'insert' ELSE 'update_after' END AS kind, CAST(1 AS BIGINT) AS diff FROM c UNION ALL SELECT key, sequence, old, 'update_before', CAST(-1 AS BIGINT) FROM c WHERE old IS NOT NULL""")
def process_changelog(spark, d):
    out = process.fold(amounts(spark, d), process.Process("balance", balance))
    rows = out.select("key", "sequence", F.get_json_object("emitted", "$.balance").cast("long").alias("balance"))
    return changelog.running_changes(rows, ["key"], "balance")


@query(f"WITH {EV}, t AS (SELECT max(ts) - INTERVAL 3 DAY AS through FROM events) SELECT key, event_id AS sequence, CASE WHEN ts <= through THEN 'COMMITTED' ELSE 'PENDING' END AS status FROM ev, t")
def process_pending(spark, d):
    """Records beyond the frontier wait."""
    top = tables.table(spark, d, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    out = process.fold(amounts(spark, d), process.Process("balance", balance), gate="complete", frontier_us=top - 3 * 86_400_000_000, waiting=True)
    return out.select("key", "sequence", "status")


def refuse_elevens(state, record):
    if record["amount"] % 11 == 0:
        raise ValueError("an eleven")
    return balance(state, record)


@query(f"WITH {EV} SELECT key, event_id AS sequence FROM ev WHERE CAST(round(value) AS BIGINT) % 11 = 0")
def process_discard(spark, d):
    """Input that stays when it is discarded on success."""
    rows = amounts(spark, d)
    out = process.fold(rows, process.Process("careful", refuse_elevens, max_attempts=1))
    return process.discarded(rows, out).select("key", "sequence")


@query(f"""WITH {EV}, v AS (SELECT key, ts, event_id AS vseq, value AS level, event_id % 5 = 0 AS gone FROM ev WHERE event_type = 'view'),
p AS (SELECT key, ts, event_id, value FROM ev WHERE event_type = 'purchase'),
j AS (SELECT p.key, p.ts, p.event_id, CASE WHEN NOT gone THEN level END AS level FROM p ASOF LEFT JOIN v ON p.key = v.key AND p.ts >= v.ts)
SELECT key, event_id AS sequence, round(coalesce(sum(level) OVER (PARTITION BY key ORDER BY event_id), 0), 4) + 0.0 AS seen FROM j WHERE ts <= (SELECT max(ts) FROM ev WHERE event_type = 'view')""")
def process_versioned_lookup(spark, d):
    """A process that reads the version of a table at its record's time, once that table is complete."""
    versioned = process.with_versions(probes(spark, d), {"levels": versions(spark, d)})
    through = versions(spark, d).agg(F.max(F.unix_micros(F.col("event_time").cast("timestamp")))).first()[0]
    out = process.fold(versioned, process.Process("seen", add_level), gate="complete", frontier_us=process.frontier_of([through / 1e6]))
    return out.select("key", "sequence", (F.round(F.get_json_object("state", "$.seen").cast("double"), 4) + 0.0).alias("seen"))


def add_level(state, record):
    level = record["levels"]["level"] if record["levels"] else None
    state["seen"] = state.get("seen", 0.0) + (level or 0.0)
    return state, None


@query(f"""WITH {EV}, s AS (SELECT key, event_id AS sequence, event_type, value, row_number() OVER w AS views, list(event_type) OVER (PARTITION BY key ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent FROM ev WINDOW w AS (PARTITION BY key ORDER BY event_id))
SELECT key, sequence, views, round(value * (1 + CAST(len(list_filter(recent, lambda x: x = event_type)) AS DOUBLE) / len(recent)), 6) AS score FROM s WHERE views % 5 = 0""")
def shopping_session(spark, d):
    rows = events(spark, d).select("key", "sequence", F.col("value.event_type").alias("category"), F.col("value.value").alias("affinity"))
    out = process.fold(rows, process.Process("shopping", browse)).filter("emitted is not null")
    said = F.from_json("emitted", "views bigint, score double")
    return out.select("key", "sequence", said["views"].alias("views"), F.round(said["score"], 6).alias("score"))


def browse(state, record):
    """The published workload's fold: the last five categories, and every fifth view scores."""
    recent = [*state.get("recent", []), record["category"]][-5:]
    views = state.get("views", 0) + 1
    score = record["affinity"] * (1 + recent.count(record["category"]) / len(recent))
    return {"recent": recent, "views": views}, {"views": views, "score": score} if views % 5 == 0 else None


@query(f"""WITH {EV}, b AS (SELECT key, event_id AS sequence, CAST(round(value) AS BIGINT) AS amount, row_number() OVER (PARTITION BY key ORDER BY event_id) AS n FROM ev)
SELECT key, CAST(sequence AS VARCHAR) AS event_id, amount % 2 <> 0 OR n < 3 AS matches FROM b""")
def replay_diff(spark, d):
    small = amounts(spark, d)
    return process.compare(small, process.Process("a", keep_all_short), process.Process("b", keep_two_short)).select("key", "event_id", "matches")


def keep_all_short(state, record):
    state["seen"] = [*state.get("seen", []), record["amount"]][-3:]
    return state, state["seen"]


def keep_two_short(state, record):
    state["seen"] = [*state.get("seen", []), record["amount"]][-3:]
    return state, state["seen"] if record["amount"] % 2 else state["seen"][-2:]


# Several stages


@query(f"""WITH {EV}, c AS (SELECT * FROM ev WHERE value > 20), f AS (SELECT key || ':' || event_type AS k, arg_min(event_id, (ts, event_id)) AS id FROM c GROUP BY ALL),
p AS (SELECT c.* FROM c JOIN f ON f.id = c.event_id), v AS (SELECT key, ts, value AS level FROM ev WHERE event_type = 'view'),
j AS (SELECT p.key, p.ts, v.level FROM p ASOF JOIN v ON p.key = v.key AND p.ts >= v.ts)
SELECT key, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS count, round(sum(level), 6) AS sum FROM j GROUP BY ALL""")
def pipeline_multi(spark, d):
    def by_type(df):
        return df.withColumn("user", F.col("key")).withColumn("key", F.concat_ws(":", "key", "value.event_type"))

    def by_user(df):
        return df.withColumn("key", F.col("user")).select("key", "event_time", "sequence", "kind")

    def as_records(df):
        return df.select("key", "event_time", "sequence", F.lit("insert").alias("kind"), F.struct(F.col("version_level").alias("level")).alias("value"))

    graph = Graph("multi").stream("events").stream("levels")
    graph.filter("large", "events", "value", "greater_than", 20.0).map("typed", "large", by_type).deduplicate("first", "typed").map("user", "first", by_user)
    graph.temporal_join("levelled", "user", "levels").map("records", "levelled", as_records).window("daily", "records", windows.WindowSpec(DAY), "sum", "level")
    levels = versions(spark, d).withColumn("kind", F.lit("upsert")).select("key", "event_time", "sequence", "level", "kind")
    return graph.run({"events": events(spark, d), "levels": levels})["daily"].withColumn("sum", F.round("sum", 6))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_latency, max(value) AS max_latency, count(*) FILTER (WHERE value > 100) AS overdue FROM events GROUP BY event_type")
def latency_summary(spark, d):
    """Outcomes of which the event's value is the latency."""
    found = process.latency_summary(tables.table(spark, d, "events"), F.col("value"), target=100.0, by=["event_type"])
    return found.withColumn("mean_latency", F.round("mean_latency", 6))


#: Samples of every hour: what came in waits, but for every third count; replicas go round.
LOADS = """h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL),
l AS (SELECT hour, epoch_us(hour) / 1000000.0 AS came, CASE WHEN n % 3 = 0 THEN 0 ELSE n END AS pending, coalesce(sum(n) OVER (ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS completed, n % 11 AS have, CASE WHEN n % 2 = 0 THEN 600 ELSE 0 END AS spare FROM h)"""


@query(f"""WITH {LOADS}, x AS (SELECT *, came - lag(came) OVER o AS span, greatest(0, (pending + completed - lag(pending + completed) OVER o) / (came - lag(came) OVER o)) AS arriving FROM l WINDOW o AS (ORDER BY hour)),
y AS (SELECT *, ceil(arriving * 1.25 / 0.01) AS traffic, ceil(pending * 1.25 / 20) AS backlog FROM x WHERE span IS NOT NULL),
z AS (SELECT *, CAST(least(8, greatest(1, traffic, backlog)) AS INTEGER) AS goal FROM y)
SELECT hour, CASE WHEN have > 8 THEN 8 WHEN goal >= have THEN goal WHEN pending > 0 OR spare < 300 THEN have ELSE greatest(goal, have - 1) END::INTEGER AS replicas_wanted,
CASE WHEN have > 8 THEN 'partition ceiling' WHEN goal > have THEN CASE WHEN traffic >= backlog THEN 'traffic' ELSE 'backlog' END WHEN goal = have THEN 'within target' WHEN pending > 0 OR spare < 300 THEN 'scale-down stabilization' ELSE 'sustained spare capacity' END AS reason FROM z""")
def scaling_decision(spark, d):
    hours = tables.table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    past = F.coalesce(F.sum("n").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    zero = F.lit(0).cast("long")
    samples = hours.select(
        "hour", (F.unix_micros(F.col("hour").cast("timestamp")) / 1_000_000).alias("at"), F.when(F.col("n") % 3 == 0, 0).otherwise(F.col("n")).cast("long").alias("pending"), zero.alias("running"), zero.alias("retrying"),
        past.alias("completed"), F.lit(None).cast("double").alias("oldest_age"), (F.col("n") % 11).cast("int").alias("replicas"), F.when(F.col("n") % 2 == 0, 600.0).otherwise(0.0).alias("spare_for"),
    )
    return scaling.recommend(samples, 8, scaling.Targets(minimum=1, maximum=10, rate_each=0.01, backlog_each=20.0)).select("hour", "replicas_wanted", "reason")


@query("SELECT source_partition, expected, found FROM (SELECT event_id % 4 AS source_partition, event_id AS found, coalesce(lag(event_id) OVER (PARTITION BY event_id % 4 ORDER BY event_id) + 1, 0) AS expected FROM events WHERE event_id % 5 <> 0) WHERE found <> expected")
def source_offset_gaps(spark, d):
    rows = tables.table(spark, d, "events").filter("event_id % 5 <> 0").select(F.lit("s").alias("source_id"), (F.col("event_id") % 4).alias("source_partition"), F.col("event_id").alias("source_offset"))
    return admission.offset_gaps(rows).select("source_partition", "expected", "found")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
