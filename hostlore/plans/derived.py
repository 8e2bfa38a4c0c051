"""Telemetry tables derived from the ``events`` table, in SQL that Spark and DuckDB both read.

The fleet tables of this library are normally read from storage (``hostlore.sources.tables``). For checks at scale they are
derived from ``events``: each user is a service and a process, four hosts share the users, a day is a snapshot. What was
captured includes rows of failed collections; observations are those of usable ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = """
ev AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, props, 'host-' || CAST(user_id % 4 AS STRING) AS host_id,
         'svc-' || CAST(user_id AS STRING) || '.service' AS unit, CAST(ts AS DATE) AS d, CAST(round(value * 100) AS BIGINT) AS cents,
         'c-' || lpad(CAST(event_id AS STRING), 8, '0') AS cursor
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
days AS (SELECT DISTINCT host_id, d FROM ev),
numbered AS (SELECT host_id, d, CAST(row_number() OVER (PARTITION BY host_id ORDER BY d) AS BIGINT) AS snapshot_id FROM days),
snapshots AS (
  SELECT host_id, d, snapshot_id, CAST(substr(host_id, 6) AS BIGINT) AS h, CAST(d AS TIMESTAMP) + INTERVAL 1 DAY AS observed_at,
         CAST(86400 * CASE WHEN snapshot_id % 9 = 0 THEN snapshot_id - 1 ELSE snapshot_id END AS DOUBLE) AS monotonic_s FROM numbered),
collection_results AS (
  SELECT host_id, snapshot_id, 'services' AS collector_name, observed_at AS collected_at,
         CASE WHEN (snapshot_id + h) % 13 = 0 THEN 'transient_failure' WHEN (snapshot_id + h) % 11 = 0 THEN 'partial'
           ELSE 'success' END AS status FROM snapshots
  UNION ALL
  SELECT host_id, snapshot_id, 'processes', observed_at,
         CASE WHEN (snapshot_id + h) % 7 = 0 THEN 'transient_failure' WHEN (snapshot_id + h) % 5 = 0 THEN 'partial' ELSE 'success' END FROM snapshots
  UNION ALL
  SELECT host_id, snapshot_id, 'journal', observed_at, CASE WHEN snapshot_id % 10 = 0 THEN 'partial' ELSE 'success' END FROM snapshots),
cell AS (
  SELECT host_id, d, user_id, unit, max_by(event_type, event_id) AS last_type, max_by(cents, event_id) AS last_cents,
         CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS signups
  FROM ev GROUP BY host_id, d, user_id, unit),
cells AS (
  SELECT c.host_id, c.user_id, c.unit, c.last_type, c.last_cents, s.snapshot_id, s.observed_at,
         CAST(sum(c.cents) OVER (PARTITION BY c.host_id, c.user_id ORDER BY c.d) AS BIGINT) AS running_cents,
         CAST(sum(c.signups) OVER (PARTITION BY c.host_id, c.user_id ORDER BY c.d) AS BIGINT) AS running_signups
  FROM cell c JOIN snapshots s ON c.host_id = s.host_id AND c.d = s.d),
service_captured AS (
  SELECT host_id, snapshot_id, unit AS name, 'loaded' AS load_state,
         CASE last_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'activating' WHEN 'view' THEN 'inactive' ELSE 'active' END AS active_state,
         last_type AS sub_state
  FROM cells),
service_observations AS (
  SELECT c.* FROM service_captured c JOIN collection_results r ON c.host_id = r.host_id AND c.snapshot_id = r.snapshot_id AND r.collector_name = 'services'
  WHERE r.status IN ('success', 'partial')),
processes_raw AS (
  SELECT host_id, snapshot_id, CAST(1000 + user_id AS INT) AS pid, 1 AS ppid, last_type AS name, 'S' AS state, last_cents AS rss_bytes,
         CASE WHEN last_type = 'view' THEN NULL ELSE 4 * last_cents END AS virtual_memory_bytes, 1 AS threads,
         CASE WHEN user_id % 5 = 3 THEN running_cents % 20000 ELSE running_cents END AS cpu_time_ticks,
         CASE WHEN user_id % 50 = 7 THEN NULL ELSE 100 * running_signups END AS start_time_ticks, user_id
  FROM cells),
process_captured AS (SELECT *, CAST(pid AS STRING) || ':' || CAST(start_time_ticks AS STRING) AS lifetime_id FROM processes_raw),
process_observations AS (
  SELECT c.* FROM process_captured c JOIN collection_results r ON c.host_id = r.host_id AND c.snapshot_id = r.snapshot_id AND r.collector_name = 'processes'
  WHERE r.status IN ('success', 'partial')),
per_type AS (
  SELECT host_id, d, event_type, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n FROM ev GROUP BY host_id, d, event_type),
network_observations AS (
  SELECT p.host_id, s.snapshot_id, 'if-' || event_type AS interface,
         CAST(sum(cents) OVER (PARTITION BY p.host_id, event_type ORDER BY p.d) AS BIGINT) % 2000000 AS receive_bytes,
         CAST(sum(n) OVER (PARTITION BY p.host_id, event_type ORDER BY p.d) AS BIGINT) AS transmit_bytes
  FROM per_type p JOIN snapshots s ON p.host_id = s.host_id AND p.d = s.d),
daily AS (
  SELECT host_id, d, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS c1,
         CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS c2, CAST(sum(CASE WHEN event_type = 'error' THEN 1
           ELSE 0 END) AS BIGINT) AS c3,
         CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS c4, CAST(sum(CASE WHEN event_type = 'signup' THEN 1
           ELSE 0 END) AS BIGINT) AS c5
  FROM ev GROUP BY host_id, d),
running AS (
  SELECT y.host_id, s.snapshot_id, s.observed_at, CAST(sum(cents) OVER w AS BIGINT) AS cents, CAST(sum(c1) OVER w AS BIGINT) AS c1, CAST(sum(c2)
    OVER w AS BIGINT) AS c2,
         CAST(sum(c3) OVER w AS BIGINT) AS c3, CAST(sum(c4) OVER w AS BIGINT) AS c4, CAST(sum(c5) OVER w AS BIGINT) AS c5
  FROM daily y JOIN snapshots s ON y.host_id = s.host_id AND y.d = s.d WINDOW w AS (PARTITION BY y.host_id ORDER BY y.d)),
cpu_observations AS (
  SELECT host_id, snapshot_id, c1 AS user_ticks, c2 AS nice_ticks, c3 AS system_ticks, c4 AS idle_ticks, c5 AS iowait_ticks,
         CAST(0 AS BIGINT) AS irq_ticks, CAST(0 AS BIGINT) AS softirq_ticks, CAST(0 AS BIGINT) AS steal_ticks FROM running),
memory_observations AS (
  SELECT host_id, snapshot_id, CAST(64000000 AS BIGINT) AS total_kb, 64000000 - cents % 32000000 AS available_kb, cents % 16000000 AS free_kb,
         CASE WHEN snapshot_id % 2 = 1 THEN NULL ELSE c1 END AS buffers_kb FROM running),
disk_observations AS (
  SELECT host_id, snapshot_id, '/' AS path, CAST(10000000 AS BIGINT) AS blocks, CAST(4096 AS BIGINT) AS fragment_bytes, 10000000 - cents %
    5000000 AS available_blocks FROM running),
journal_events AS (
  SELECT e.host_id, s.snapshot_id, e.event_id, e.cursor, e.ts AS observed_at, 'journal' AS source,
         CASE event_type WHEN 'error' THEN 3 WHEN 'view' THEN NULL ELSE 5 END AS priority, e.unit, CAST(1000 + user_id AS INT) AS pid,
         event_type AS comm, event_type || ' token=' || CAST(event_id AS STRING) || ' ' || coalesce(props, '') AS message, 'boot-' || e.host_id AS boot_id
  FROM ev e JOIN snapshots s ON e.host_id = s.host_id AND e.d = s.d),
associations AS (
  SELECT DISTINCT host_id, 'svc-' || CAST(user_id AS STRING) || '.service' AS service_name, lifetime_id FROM process_observations
  WHERE user_id % 3 = 0 AND lifetime_id IS NOT NULL)
"""
#: Events of a unit are hours apart in these tables.
WINDOW_SECONDS = 6 * 3600


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables."""
    return spark.sql(f"WITH events AS (SELECT * FROM parquet.`{sf_dir}/events.parquet`), {VIEWS} SELECT * FROM {name}")
