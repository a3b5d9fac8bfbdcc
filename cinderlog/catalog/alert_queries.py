"""Alerts, notifications and retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from cinderlog.catalog import datasets as d
from cinderlog.catalog.query import Query, with_ctes
from cinderlog.functions.times import minute_to_time, time_type
from cinderlog.operators import alerts as a
from cinderlog.operators import notifications as n
from cinderlog.operators import replay as p
from cinderlog.operators import retention as r
from cinderlog.operators.rollup import rollup_kept

# The first event is from this day.
START = datetime(2024, 1, 1)
MID_MINUTE = datetime(2024, 1, 29, 18, 42, 17, 250_000)
MARK_ALL_AT = datetime(2024, 1, 10)
KEEP_DAYS = 7
CUTOFF_SQL = "TIMESTAMP '2024-01-24 00:00:00'"

RULE = "id, service, threshold, window_minutes, webhook_url, last_triggered_at"
COUNTS = f"""{d.LOGS}, {d.RULES},
counted AS (
  SELECT r.*, (SELECT count(*) FROM logs l WHERE l.level = 'error' AND (r.service IS NULL OR l.service = r.service)
               AND l.timestamp >= TIMESTAMP '2024-01-31 00:00:00' - r.window_minutes * INTERVAL 1 MINUTE) AS errors
  FROM valid_rules r),
firing AS (
  SELECT * FROM counted WHERE errors >= threshold
    AND (last_triggered_at IS NULL OR TIMESTAMP '2024-01-31 00:00:00' - last_triggered_at >= INTERVAL 10 MINUTE))"""

# Minute ticks as whole numbers since the epoch; a tick counts the minutes before it.
TICKS = f"""{d.LOGS}, {d.RULES},
minutes AS (
  SELECT CAST(floor(epoch(timestamp) / 60) AS BIGINT) AS minute, service, count(*) AS n
  FROM logs WHERE level = 'error' GROUP BY ALL),
scoped AS (SELECT * FROM minutes UNION ALL SELECT minute, NULL, sum(n) FROM minutes GROUP BY minute),
bounds AS (SELECT CAST(epoch(TIMESTAMP '2024-01-01 00:00:00') / 60 AS BIGINT) + 1 AS first_tick, CAST(epoch(TIMESTAMP '2024-01-31 00:00:00') / 60 AS BIGINT) AS last_tick),
pairs AS (SELECT DISTINCT service, CAST(window_minutes AS BIGINT) AS window_minutes FROM valid_rules WHERE window_minutes > 0),
dense AS (
  SELECT p.service, p.window_minutes, t.tick, coalesce(s.n, 0) AS n
  FROM pairs p, bounds b, unnest(range(b.first_tick - 1440, b.last_tick + 1)) AS t(tick)
  LEFT JOIN scoped s ON s.minute = t.tick - 1 AND s.service IS NOT DISTINCT FROM p.service),
sliding AS (
  SELECT service, window_minutes, tick,
         CAST(sum(n) OVER (PARTITION BY service, window_minutes ORDER BY tick RANGE BETWEEN window_minutes - 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS errors
  FROM dense)"""


def _rules(spark, sf):
    return a.valid_rules(d.rules(spark, sf))


def _counted(spark, sf):
    return a.alert_counts(d.logs(spark, sf), _rules(spark, sf), d.AS_OF, d.rollup(spark, sf))


def _firing(spark, sf):
    return a.alerts_firing(d.logs(spark, sf), _rules(spark, sf), d.AS_OF)


def _counted_mid_minute(spark, sf):
    """At an instant inside a minute: raw rows answer for the first part of each window's first minute."""
    return a.alert_counts(d.logs(spark, sf), _rules(spark, sf), MID_MINUTE, d.rollup(spark, sf)).select("id", "errors")


def _rules_after(spark, sf):
    return a.rules_after(_rules(spark, sf), _firing(spark, sf), d.AS_OF)


def _sliding(spark, sf):
    """The ticks at which the sliding count differs from the one before."""
    rollup = d.rollup(spark, sf)
    spans = p.sliding_counts(rollup, _rules(spark, sf), START, d.AS_OF)
    at = minute_to_time(F.col("tick_from"), time_type(rollup, "bucket_start"))
    until = minute_to_time(F.col("tick_to"), time_type(rollup, "bucket_start"))
    return spans.select("service", "window_minutes", at.alias("from_tick"), until.alias("to_tick"), "errors")


def _replay(spark, sf):
    return p.replay_alerts(d.rollup(spark, sf), _rules(spark, sf), START, d.AS_OF)


def _read_state(spark, sf):
    return n.with_read_state(d.notifications(spark, sf), d.receipts(spark, sf), MARK_ALL_AT)


def _cutoff():
    return r.cutoff(d.AS_OF, KEEP_DAYS)


def _notice(spark, sf):
    logs = d.logs(spark, sf)
    expired = r.expired_count(logs, _cutoff())
    return n.retention_notification(expired, KEEP_DAYS, d.AS_OF, time_type(logs, "timestamp"))


def _kept_rollup(spark, sf):
    return rollup_kept(d.rollup(spark, sf), _cutoff())


NOTICE = "type, title, message, service, level, is_read, created_at"

QUERIES = [
    Query("alert_rules_valid", _rules, with_ctes(d.RULES, f"SELECT {RULE} FROM valid_rules")),
    Query("alert_rules_list", lambda spark, sf: a.list_rules(d.rules(spark, sf)), with_ctes(d.RULES, f"SELECT {RULE} FROM rules ORDER BY id DESC")),
    Query("alert_counts", _counted, with_ctes(COUNTS, f"SELECT {RULE}, errors FROM counted")),
    Query(
        "alert_counts_mid_minute", _counted_mid_minute,
        with_ctes(d.LOGS + ", " + d.RULES, """SELECT r.id, (SELECT count(*) FROM logs l WHERE l.level = 'error' AND (r.service IS NULL OR l.service = r.service)
            AND l.timestamp >= TIMESTAMP '2024-01-29 18:42:17.25' - r.window_minutes * INTERVAL 1 MINUTE) AS errors FROM valid_rules r"""),
    ),
    Query("alerts_firing", _firing, with_ctes(COUNTS, f"SELECT {RULE}, errors FROM firing")),
    Query(
        "alert_payloads", lambda spark, sf: a.alert_payloads(_firing(spark, sf), d.AS_OF),
        with_ctes(COUNTS, """SELECT id AS rule_id, webhook_url, concat('{"alert":"error_threshold_exceeded","service":"', coalesce(service, 'all'),
            '","error_count":', errors, ',"threshold":', threshold, ',"window_minutes":', window_minutes, ',"triggered_at":"2024-01-31T00:00:00.000Z"}') AS payload FROM firing"""),
    ),
    Query(
        "alert_rules_after", _rules_after,
        with_ctes(COUNTS, """SELECT id, service, threshold, window_minutes, webhook_url,
            CASE WHEN id IN (SELECT id FROM firing) THEN TIMESTAMP '2024-01-31 00:00:00' ELSE last_triggered_at END AS last_triggered_at FROM valid_rules"""),
    ),
    Query(
        "notifications_from_alerts", lambda spark, sf: n.alert_notifications(_firing(spark, sf), d.AS_OF),
        with_ctes(COUNTS, """SELECT id AS rule_id, 'alert' AS type, concat('Alert: ', coalesce(service, 'all')) AS title,
            concat(errors, ' errors in ', window_minutes, ' min (threshold: ', threshold, ')') AS message, service, 'error' AS level,
            false AS is_read, TIMESTAMP '2024-01-31 00:00:00' AS created_at FROM firing"""),
    ),
    Query(
        "alert_sliding_counts", _sliding,
        with_ctes(TICKS + """,
            points AS (
              SELECT DISTINCT p.service, p.window_minutes, tick FROM pairs p, bounds b, unnest([b.first_tick]) AS x(tick)
              UNION SELECT p.service, p.window_minutes, t.tick FROM pairs p, bounds b, unnest(range(b.first_tick, b.last_tick + 1)) AS t(tick) WHERE t.tick % 1440 = 0
              UNION SELECT p.service, p.window_minutes, unnest([s.minute + 1, s.minute + 1 + p.window_minutes]) FROM pairs p JOIN scoped s ON s.service IS NOT DISTINCT FROM p.service),
            spans AS (
              SELECT pt.service, pt.window_minutes, pt.tick AS a, coalesce(lead(pt.tick) OVER (PARTITION BY pt.service, pt.window_minutes ORDER BY pt.tick), b.last_tick + 1) AS z
              FROM points pt, bounds b WHERE pt.tick BETWEEN b.first_tick AND b.last_tick)""", """
            SELECT s.service, s.window_minutes, TIMESTAMP '1970-01-01' + s.a * INTERVAL 1 MINUTE AS from_tick,
                   TIMESTAMP '1970-01-01' + s.z * INTERVAL 1 MINUTE AS to_tick, c.errors
            FROM spans s JOIN sliding c ON c.tick = s.a AND c.window_minutes = s.window_minutes AND c.service IS NOT DISTINCT FROM s.service"""),
    ),
    Query(
        "alert_replay", _replay,
        with_ctes("RECURSIVE " + TICKS + """,
            over AS (
              SELECT r.id AS rule_id, s.tick, s.errors FROM valid_rules r JOIN sliding s
              ON s.window_minutes = r.window_minutes AND s.service IS NOT DISTINCT FROM r.service, bounds b
              WHERE s.errors >= r.threshold AND s.tick BETWEEN b.first_tick AND b.last_tick),
            marked AS (SELECT *, tick - row_number() OVER (PARTITION BY rule_id ORDER BY tick) AS run FROM over),
            runs AS (SELECT rule_id, min(tick) AS a, max(tick) + 1 AS z, row_number() OVER (PARTITION BY rule_id ORDER BY min(tick)) AS k FROM marked GROUP BY rule_id, run),
            walk AS (
              SELECT rule_id, k, a AS begin_tick, z, a + CAST(ceil((z - a) / 10.0) AS BIGINT) * 10 AS free FROM runs WHERE k = 1
              UNION ALL
              SELECT rule_id, r.k, greatest(r.a, w.free), r.z,
                     CASE WHEN w.free >= r.z THEN w.free ELSE greatest(r.a, w.free) + CAST(ceil((r.z - greatest(r.a, w.free)) / 10.0) AS BIGINT) * 10 END
              FROM walk w JOIN runs r USING (rule_id) WHERE r.k = w.k + 1),
            fired AS (SELECT rule_id, unnest(range(begin_tick, z, 10)) AS tick FROM walk WHERE begin_tick < z)""", """
            SELECT f.rule_id, TIMESTAMP '1970-01-01' + f.tick * INTERVAL 1 MINUTE AS fired_at, o.errors
            FROM fired f JOIN over o USING (rule_id, tick)"""),
    ),
    Query(
        "notification_feed", lambda spark, sf: n.feed(d.notifications(spark, sf)),
        with_ctes(d.NOTIFICATIONS, f"SELECT id, {NOTICE} FROM notifications ORDER BY is_read, created_at DESC, id DESC LIMIT 50"),
    ),
    Query("unread_count", lambda spark, sf: n.unread_count(d.notifications(spark, sf)), with_ctes(d.NOTIFICATIONS, "SELECT count(*) AS count FROM notifications WHERE NOT is_read")),
    Query(
        "notifications_read_state", _read_state,
        with_ctes(d.NOTIFICATIONS, """SELECT id, type, title, message, service, level,
            is_read OR id IN (SELECT id FROM receipts) OR created_at <= TIMESTAMP '2024-01-10 00:00:00' AS is_read, created_at FROM notifications"""),
    ),
    Query(
        "retention_expired", lambda spark, sf: r.expired_count(d.logs(spark, sf), _cutoff()),
        with_ctes(d.LOGS, f"SELECT count(*) AS deleted FROM logs WHERE timestamp < {CUTOFF_SQL}"),
    ),
    Query(
        "retention_kept", lambda spark, sf: r.kept(d.logs(spark, sf), _cutoff()).select("id", "timestamp", "level", "service", "message"),
        with_ctes(d.LOGS, f"SELECT id, timestamp, level, service, message FROM logs WHERE timestamp >= {CUTOFF_SQL}"),
    ),
    Query(
        "retention_chunks", lambda spark, sf: r.chunks(d.rollup(spark, sf), _cutoff()),
        with_ctes(d.LOGS, f"""SELECT time_bucket(INTERVAL '7 DAYS', timestamp, TIMESTAMP '1970-01-01') AS chunk_start,
            chunk_start + INTERVAL '7 DAYS' AS chunk_end, count(*) AS count, chunk_end <= {CUTOFF_SQL} AS dropped FROM logs GROUP BY ALL"""),
    ),
    Query("retention_rollup", _kept_rollup, with_ctes(d.ROLLUP, f"SELECT * FROM rollup WHERE bucket_start >= {CUTOFF_SQL}")),
    Query(
        "retention_notice", _notice,
        with_ctes(d.LOGS, f"""SELECT 'retention' AS type, 'Retention Run Complete' AS title,
            concat('Deleted ', count(*), ' logs older than 7 days') AS message, CAST(NULL AS VARCHAR) AS service, CAST(NULL AS VARCHAR) AS level,
            false AS is_read, TIMESTAMP '2024-01-31 00:00:00' AS created_at FROM logs WHERE timestamp < {CUTOFF_SQL} HAVING count(*) > 0"""),
    ),
]
