"""Queries over the event stream; closed windows only, as the stream emits them."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.plans.register import registrar
from litspark.sources.tables import table
from litspark.streaming import progress

REGISTERED: dict = {}
query = registrar(REGISTERED)
_MARK = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= {_MARK}""")
def stream_tumbling(spark, d):
    """Events of each hour and kind."""
    out = progress.run_available(progress.windowed(progress.event_stream(spark, d), "1 hour"))
    return out.withColumn("total", F.round("total", 4))


@query(f"""SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(45), time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(30),
  time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15), time_bucket(INTERVAL 15 MINUTE, ts)]) AS start FROM events) WHERE start + INTERVAL 1 HOUR <= {_MARK} GROUP BY 1, 2""")
def stream_sliding(spark, d):
    """Events of each hour and kind, every quarter of an hour."""
    out = progress.run_available(progress.windowed(progress.event_stream(spark, d), "1 hour", "15 minutes"))
    return out.withColumn("total", F.round("total", 4))


_SESSIONS = """SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
  (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""


@query(f"SELECT * FROM ({_SESSIONS}) WHERE last + INTERVAL 30 MINUTE <= {_MARK}")
def stream_session(spark, d):
    """Sessions of each user with gaps of half an hour."""
    return progress.run_available(progress.sessions(progress.event_stream(spark, d), "30 minutes"))


@query(f"SELECT user_id, count(*) AS sessions, max(last) AS last_seen FROM ({_SESSIONS}) WHERE last + INTERVAL 30 MINUTE <= {_MARK} GROUP BY 1")
def stream_liveness(spark, d):
    """How often each user went silent, and when last."""
    out = progress.run_available(progress.sessions(progress.event_stream(spark, d), "30 minutes"))
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("last").alias("last_seen"))


@query("SELECT event_id, user_id, ts FROM events")
def stream_dedup_ttl(spark, d):
    """Events, each id once."""
    return progress.run_available(progress.unique(progress.event_stream(spark, d), "event_id").select("event_id", "user_id", "ts"))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n FROM events GROUP BY 1")
def stream_latest(spark, d):
    """The last event of each user."""
    return progress.run_available(progress.latest(progress.event_stream(spark, d), "user_id"), keyed="user_id")


@query("""SELECT a.user_id, a.event_id AS asked, b.event_id AS answered FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 60 MINUTE""")
def stream_correlation(spark, d):
    """Clicks and the purchases that follow within an hour."""
    return progress.run_available(progress.answered(progress.event_stream(spark, d), "click", "purchase", "60 minutes"))


@query("""SELECT a.user_id, a.event_id AS asked, b.event_id AS answered FROM (SELECT * FROM events WHERE event_type = 'click') a JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 60 MINUTE
  UNION ALL SELECT user_id, event_id, NULL FROM events a WHERE event_type = 'click' AND ts < (SELECT max(ts) - INTERVAL 6 HOUR FROM events) AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 60 MINUTE)""")
def stream_unconfirmed(spark, d):
    """Clicks with the purchases that follow within an hour, and those of six hours before the end without one.

    When exactly a click is given up depends on the watermarks of both sides, so the newest are left out.
    """
    out = progress.run_available(progress.answered(progress.event_stream(spark, d), "click", "purchase", "60 minutes", True))
    events = table(spark, d, "events")
    old = events.crossJoin(F.broadcast(events.agg((F.max("ts") - F.expr("interval 6 hours")).alias("end")))).where("event_type = 'click' and ts < end").select(F.col("event_id").alias("asked"))
    return out.where("answered is not null").unionByName(out.where("answered is null").join(old, "asked", "left_semi").select(*out.columns))


@query("""WITH RECURSIVE k AS (SELECT concat_ws('/', user_id, event_type) AS key, event_id, ts FROM events), t AS (SELECT key, min(ts) AS ts FROM k GROUP BY 1
  UNION ALL SELECT t.key, (SELECT min(k.ts) FROM k WHERE k.key = t.key AND k.ts >= t.ts + INTERVAL 15 MINUTE) AS ts FROM t WHERE t.ts IS NOT NULL)
  SELECT t.key, t.ts, (SELECT min(event_id) FROM k WHERE k.key = t.key AND k.ts = t.ts) AS event_id FROM t WHERE ts IS NOT NULL""")
def stream_first_of_period(spark, d):
    """Events of a user and kind, none within a quarter of an hour after one that was taken."""
    events = progress.event_stream(spark, d).withColumn("key", F.concat_ws("/", "user_id", "event_type"))
    return progress.run_available(progress.first_of_period(events, "key", 900))


@query("""SELECT user_id, event_type, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS position FROM events""")
def run_log(spark, d):
    """The events of each user in order, numbered."""
    return progress.run_events(table(spark, d, "events"), "user_id")
