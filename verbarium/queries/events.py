"""Event-state and window queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbarium.sources.tables import table
from verbarium.streaming import events as E

Q: dict = {}
SQL: dict[str, str] = {}
UP = "WITH u AS (SELECT *, min(seq) OVER (PARTITION BY id) AS first_seen, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM agent_events) "


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _e(s, d):
    return table(s, d, "agent_events")


@query(UP + "SELECT id, first_seen, seq, status FROM u WHERE r = 1")
def event_upsert(s, d):
    return E.upsert_by_id(_e(s, d)).select("id", "first_seen", "seq", "status")


@query(UP + "SELECT id, first_seen, status FROM u WHERE r = 1 ORDER BY first_seen DESC LIMIT 200")
def ring_buffer(s, d):
    return E.ring_buffer(_e(s, d)).select("id", "first_seen", "status")


@query(UP + """SELECT count(*) FILTER (WHERE status = 'complete' AND action = 'crawl') AS crawled, coalesce(sum(CASE WHEN status = 'complete' AND agent = 'extraction' THEN coalesce(data.count, 0) ELSE 0 END), 0)::BIGINT AS extracted,
    count(*) FILTER (WHERE data.brightdata_unlocked) AS unlocked, count(*) FILTER (WHERE data.discovered_via IS NOT NULL) AS discovered, count(*) FILTER (WHERE status = 'error') AS errors FROM u WHERE r = 1""")
def event_counters(s, d):
    return E.counters(E.upsert_by_id(_e(s, d)))


@query(UP + ", p AS (SELECT agent, lower(status) AS status, CASE lower(status) WHEN 'cancelled' THEN 4 WHEN 'complete' THEN 3 WHEN 'error' THEN 2 WHEN 'running' THEN 1 ELSE 0 END AS k FROM u WHERE r = 1) SELECT agent, status FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY k DESC, status DESC NULLS LAST) AS q FROM p) WHERE q = 1")
def status_machine(s, d):
    return E.status_of(_e(s, d), "agent")


@query("SELECT time_bucket(INTERVAL 1 DAY, timestamp AT TIME ZONE 'UTC') AS start, lower(status) AS status, count(*) AS n FROM agent_events WHERE timestamp IS NOT NULL GROUP BY 1, 2")
def event_tumbling(s, d):
    return E.tumbling(_e(s, d).where("timestamp is not null"), "1 day")


@query("""WITH e AS (SELECT agent, timestamp AT TIME ZONE 'UTC' AS t FROM agent_events WHERE timestamp IS NOT NULL), l AS (SELECT *, lag(t) OVER (PARTITION BY agent ORDER BY t) AS p FROM e),
    s AS (SELECT agent, t, sum(CASE WHEN p IS NULL OR t - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY agent ORDER BY t RANGE UNBOUNDED PRECEDING) AS k FROM l)
    SELECT agent, min(t) AS start, max(t) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY agent, k""")
def event_session(s, d):
    return E.sessions(_e(s, d).where("timestamp is not null"), "6 hours", "agent")


@query("SELECT time_bucket(INTERVAL 1 HOUR, timestamp AT TIME ZONE 'UTC') AS start, agent, count(*) AS n FROM agent_events WHERE timestamp IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 2")
def rate_limit_breach(s, d):
    return E.rate_breaches(_e(s, d).where("timestamp is not null"), "1 hour", 2, "agent")


@query(UP + "SELECT seq, id, agent, action, status FROM u WHERE r = 1 ORDER BY seq DESC LIMIT 8")
def activity_feed(s, d):
    return E.activity_feed(_e(s, d))


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def events_by_user(s, d):
    return table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


QUERIES = Q
