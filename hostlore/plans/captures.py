"""Raw captures printed from the derived tables, in SQL that Spark and DuckDB both read; every 17th is malformed, in one of its lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hostlore.plans.derived import VIEWS

CAPTURES = """
raw_cpu AS (
  SELECT host_id, snapshot_id, CASE WHEN snapshot_id % 17 = 0 THEN 'cpu 1 x 2 3' ELSE
    'intr 5' || chr(10) || 'cpu  ' || CAST(user_ticks AS STRING) || ' ' || CAST(nice_ticks AS STRING) || ' ' || CAST(system_ticks AS STRING) ||
      ' ' || CAST(idle_ticks AS STRING) || ' ' ||
    CAST(iowait_ticks AS STRING) || chr(10) || 'cpu0 1 2 3 4' END AS payload FROM cpu_observations),
raw_memory AS (
  SELECT host_id, snapshot_id, 'MemTotal: ' || CAST(total_kb AS STRING) || ' kB' || chr(10) || 'MemFree: ' || CAST(free_kb AS STRING) || CASE
    WHEN snapshot_id % 17 = 0 THEN ' pages' ELSE ' kB' END || chr(10) ||
    'MemAvailable: ' || CAST(available_kb AS STRING) || ' kB' || chr(10) || coalesce('Buffers: ' || CAST(buffers_kb AS STRING) || ' kB' ||
      chr(10), '') || 'HugePages_Total: 0' AS payload FROM memory_observations),
raw_network AS (
  SELECT host_id, snapshot_id, 'Inter-| Receive' || chr(10) || ' face |bytes' || chr(10) || string_agg('  ' || interface || ': ' ||
    CAST(receive_bytes AS STRING) || CASE WHEN snapshot_id % 17 = 0 AND interface = 'if-view' THEN ' 1 2' ELSE ' 1 2 3 0 0 0 0 ' ||
    CAST(transmit_bytes AS STRING) || ' 4 5 6 0 0 0 0' END, chr(10)) AS payload FROM network_observations GROUP BY host_id, snapshot_id),
raw_processes AS (
  SELECT host_id, snapshot_id, pid, CAST(pid AS STRING) || ' (' || name || ' (x) y) S 1 ' || CASE WHEN pid % 17 = 0 THEN 'bad'
    ELSE '0' END || ' 0 0 0 0 0 0 0 0 ' || CAST(cpu_time_ticks AS STRING) || ' 5 0 0 20 0 1 0 ' ||
    CAST(coalesce(start_time_ticks, 0) AS STRING) || ' ' || CAST(4 * rss_bytes AS STRING) || ' ' || CASE WHEN pid % 17 = 1 THEN 'none'
      ELSE CAST(rss_bytes AS STRING) END || ' 0' AS stat,
    '/bin/' || name || ' --token abc' AS cmdline, CASE WHEN pid % 2 = 0 THEN '/bin/' || name END AS executable FROM process_observations),
service_line AS (
  SELECT host_id, snapshot_id, name, load_state, active_state, sub_state, row_number() OVER (PARTITION BY host_id, snapshot_id ORDER BY name) AS r
  FROM service_observations),
raw_services AS (
  SELECT host_id, snapshot_id, string_agg(name || ' ' || load_state || ' ' || active_state || CASE WHEN snapshot_id % 17 = 0 AND r = 1 THEN ''
    ELSE ' ' || sub_state || ' some description' END || CASE WHEN snapshot_id % 13 = 5 AND r = 2 THEN chr(10) || name || ' a b c' ELSE '' END, chr(10)) AS payload
  FROM service_line GROUP BY host_id, snapshot_id),
raw_uptime AS (SELECT host_id, snapshot_id, monotonic_s, CASE WHEN snapshot_id % 17 = 0 THEN '-1.5 2'
  ELSE CAST(snapshot_id AS STRING) || '.25 100.5' END AS payload FROM snapshots),
raw_journal AS (
  SELECT host_id, snapshot_id AS page, event_id AS pos,
    '{"__CURSOR":"' || cursor || '","__REALTIME_TIMESTAMP":"' || CAST(1700000000000000 + event_id AS STRING) || '","MESSAGE":"' || comm || ' token=' || CAST(event_id AS STRING) || ' end","PRIORITY":' ||
    CASE WHEN event_id % 17 = 0 THEN '9' WHEN priority IS NULL THEN '""' ELSE '"' || CAST(priority AS STRING) || '"' END || ',"_SYSTEMD_UNIT":"'
      || unit || '","_PID":"' || CAST(pid AS STRING) || '","_COMM":[' || CASE WHEN comm = 'view' THEN '118,105' ELSE '97,98' END || ']}' AS payload,
    event_id, cursor, unit, pid, comm, priority FROM journal_events),
page_own AS (
  SELECT host_id, page, pos, cursor, event_id, row_number() OVER (PARTITION BY host_id, page ORDER BY pos) AS r,
    count(*) OVER (PARTITION BY host_id, page) AS n, max(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY host_id, page) AS bad
  FROM raw_journal WHERE page % 7 <> 3),
page_end AS (SELECT host_id, page, cursor AS leaves FROM page_own WHERE r = least(n, 60) AND bad = 0 AND page % 6 <> 4),
page_start AS (
  SELECT p.host_id, p.page, max_by(e.leaves, e.page) AS starts FROM (SELECT DISTINCT host_id, page FROM page_own) p
  JOIN page_end e ON e.host_id = p.host_id AND e.page < p.page GROUP BY p.host_id, p.page),
raw_pages AS (
  SELECT host_id, page, pos, cursor, event_id % 97 <> 0 AS valid FROM page_own
  UNION ALL SELECT host_id, page, -1, CASE WHEN page % 6 = 4 THEN 'c-gone' ELSE starts END, true FROM page_start),
batch_own AS (SELECT host_id, snapshot_id, count(*) AS n, max_by(cursor, event_id) AS last_cursor FROM journal_events GROUP BY host_id, snapshot_id),
batch_before AS (
  SELECT b.host_id, b.snapshot_id, max_by(g.last_cursor, g.snapshot_id) AS good FROM batch_own b JOIN batch_own g ON g.host_id = b.host_id
    AND g.snapshot_id < b.snapshot_id AND g.snapshot_id % 3 <> 0 AND g.snapshot_id % 4 <> 0 AND g.snapshot_id % 5 <> 0 GROUP BY b.host_id, b.snapshot_id),
raw_batches AS (
  SELECT b.host_id, b.snapshot_id, CASE WHEN b.snapshot_id % 5 = 0 THEN CAST(0 AS BIGINT) ELSE n END AS n_events, last_cursor,
    CASE WHEN b.snapshot_id % 3 = 0 THEN 'c-other' WHEN b.snapshot_id % 5 = 0 THEN good ELSE last_cursor END AS next_cursor,
    CASE WHEN b.snapshot_id % 4 = 0 THEN 'c-stale' WHEN good IS NULL AND b.host_id IN ('host-1', 'host-3') THEN 'c-start' ELSE good END AS expected_cursor
  FROM batch_own b LEFT JOIN batch_before g ON g.host_id = b.host_id AND g.snapshot_id = b.snapshot_id)
"""


def capture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(f"WITH events AS (SELECT * FROM parquet.`{sf_dir}/events.parquet`), {VIEWS}, {CAPTURES} SELECT * FROM {name}")
