"""The streaming jobs as queries, each run over the events of a folder, and their batch forms in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlore.functions.scalars import iso_fixed
from hostlore.operators import correlate
from hostlore.operators.lifecycle import service_validity
from hostlore.plans.derived import WINDOW_SECONDS
from hostlore.plans.oracle import CORR, LIFE, corr, fixed, sql
from hostlore.plans.queries import Tables
from hostlore.sources.tables import shared_path
from hostlore.streaming import cycles, streams
from hostlore.streaming import lifecycles as lifecycles_state


def stream_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly-once ingest of a stream that has every event twice."""
    rows = streams.event_stream(spark, sf_dir)
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return streams.run_once(streams.deduplicated(twice), shared_path(spark, "stream-journal")).select("host_id", "unit", "cursor")


def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases near errors of the same unit."""
    errors = streams.event_stream(spark, sf_dir).where("event_type = 'error'").select(
        "host_id", "unit", F.col("cursor").alias("anchor_id"), F.col("observed_at").alias("anchor_at")
    )
    other = streams.event_stream(spark, sf_dir).where("event_type = 'purchase'")
    return streams.run_once(streams.interval_join(errors, other, WINDOW_SECONDS), shared_path(spark, "stream-join")).select(
        "host_id", "unit", "anchor_id", "cursor"
    )


def captures(x: Tables, events: DataFrame | None = None) -> DataFrame:
    """One row per host and snapshot with all that was captured, failed collections included; ``events``: those of the journal."""
    key = ["host_id", "snapshot_id"]
    out = x.snapshots.select(*key, "observed_at", "monotonic_s")
    tables = {
        "results": x.collection_results.select(*key, F.struct("collector_name", "status", "collected_at").alias("s")),
        "services": x.service_captured.select(*key, F.struct("name", "load_state", "active_state", "sub_state").alias("s")),
        "processes": x.process_captured.select(*key, F.struct("pid", "lifetime_id", "cpu_time_ticks", "rss_bytes", "virtual_memory_bytes").alias("s")),
        "events": (x.journal_events if events is None else events).select(*key, F.struct("cursor", "observed_at", "unit", "priority").alias("s")),
    }
    for name, rows in tables.items():
        lists = rows.groupBy(*key).agg(F.collect_list("s").alias(name)).hint("merge")  # few rows, but all of the table
        out = out.join(lists, key, "left").withColumn(name, F.col(name).cast(streams.PARTS[name]))
    return out


def arriving(rows: DataFrame, path: str, cuts: list[int]) -> None:
    """Captures as files that arrive one after another: snapshots up to each cut, then the rest."""
    for low, high in zip([0, *cuts], [*cuts, None], strict=True):
        part = rows.where(F.col("snapshot_id") > low)
        (part if high is None else part.where(F.col("snapshot_id") <= high)).write.mode("append").parquet(path)


def cycles_over(spark: SparkSession, x: Tables, name: str, arrivals: list[DataFrame], window: int = WINDOW_SECONDS) -> cycles.FleetCycles:
    """Whole cycles over captures that arrive one table after another, with a stop after each."""
    path = shared_path(spark, name)
    fleet = cycles.FleetCycles(spark, path, x.associations, window)
    for rows in arrivals:
        rows.write.mode("append").parquet(f"{path}/captures")
        fleet.go(spark.readStream.schema(streams.CAPTURE).parquet(f"{path}/captures"))
    return fleet


def counted_evidence(fleet: cycles.FleetCycles) -> DataFrame:
    return fleet.evidence().groupBy("host_id", "incident_id").agg(F.count("*").alias("n_evidence"))


def stream_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incidents after whole cycles. Between two halves of the captures come old ones again, and an arrival without rows."""
    x = Tables(spark, sf_dir)
    rows = captures(x)
    again = rows.where("snapshot_id in (7, 15)")  # 15 a second time, 7 out of order
    arrivals = [rows.where("snapshot_id <= 15").unionByName(again), again, rows.limit(0), rows.where("snapshot_id > 15")]
    fleet = cycles_over(spark, x, "stream-cycle", arrivals)
    out = fleet.incidents().join(counted_evidence(fleet), ["host_id", "incident_id"])
    return out.select(
        "host_id",
        "incident_id",
        "subject_id",
        "state",
        *(iso_fixed(F.col(c)).alias(c) for c in ("started_at", "last_observed_at", "resolved_at")),
        "n_evidence",
    )


#: Events that come after all snapshots: (event_id % 7 = 3). The stream sees the snapshots up to this one.
LATE, LAST_SNAPSHOT = "event_id % 7 = 3", 20
#: Longer than from one snapshot to the next, so that some late events come after a resolution.
LATE_WINDOW = 30 * 3600


def stream_late_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents, their evidence and refused merges where a seventh of the events arrives after all recoveries."""
    x = Tables(spark, sf_dir)
    early = captures(x, x.journal_events.where(f"not ({LATE})")).where(f"snapshot_id <= {LAST_SNAPSHOT}")
    late = captures(x, x.journal_events.where(LATE)).where(f"snapshot_id <= {LAST_SNAPSHOT}")
    fleet = cycles_over(spark, x, "stream-late", [early, late], LATE_WINDOW)
    refused = fleet.conflicts().where("problem = 'evidence_after_resolution'").groupBy("host_id", "incident_id").agg(F.max("batch").alias("refused_in"))
    out = fleet.incidents().join(counted_evidence(fleet), ["host_id", "incident_id"]).join(refused, ["host_id", "incident_id"], "left")
    times = (iso_fixed(F.col(c)).alias(c) for c in ("last_observed_at", "resolved_at"))
    return out.select("host_id", "incident_id", "state", *times, "n_evidence", "refused_in")


def stream_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that arrives in four parts, some of it twice and some with other content: the anchor and the two latest stay."""
    x, path = Tables(spark, sf_dir), shared_path(spark, "stream-evidence")
    rows = x.evidence(6).select("host_id", "incident_id", *correlate.EVIDENCE)
    part = F.pmod(F.xxhash64("evidence_id"), F.lit(3))
    other = rows.where("evidence_id like '%7'").withColumn("summary", F.lit("changed"))
    state = cycles.EvidenceState(spark, path, 3)
    for arrival in (rows.where(part == 0), rows.where(part <= 1), rows.where(part == 2), other):
        arrival.write.mode("append").parquet(f"{path}/rows")
        state.go(spark.readStream.schema(rows.schema).parquet(f"{path}/rows"))
    kept = state.evidence().select("host_id", "incident_id", "evidence_id", F.col("truncated").cast("string").alias("outcome"))
    return kept.unionByName(state.differing().select("host_id", "incident_id", "evidence_id", F.col("problem").alias("outcome")))


#: Items of a host and snapshot that a shard of ``lifecycles`` has on average, in the largest snapshot.
SHARD_ITEMS = 1000


def lifecycles(spark: SparkSession, x: Tables, rows: DataFrame, collector: str, fields: list[str], processor: type) -> DataFrame:
    """Snapshots of each host that arrive in three parts, the last of which has an old one again."""
    key, path = ["host_id", "snapshot_id"], shared_path(spark, f"{collector}-snapshots")
    items = rows.groupBy(*key).agg(F.collect_list(F.struct(*fields)).alias("items"))
    largest = rows.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    status = x.collection_results.where(F.col("collector_name") == collector).select(*key, F.col("collected_at").alias("observed_at"), "status")
    found = status.join(items, key, "left")
    arriving(found, path, [10, 20])
    found.where("snapshot_id in (9, 20)").write.mode("append").parquet(path)
    with lifecycles_state.rocksdb(spark):
        stream = spark.readStream.schema(found.schema).parquet(path)
        return streams.run_once(lifecycles_state.compared(stream, processor, shards=1 + largest // SHARD_ITEMS), shared_path(spark, f"stream-{collector}"))


def stream_service_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycles of services as the snapshots of each host arrive."""
    x = Tables(spark, sf_dir)
    fields = ["name", "load_state", "active_state", "sub_state", "valid"]
    return lifecycles(spark, x, service_validity(x.service_captured), "services", fields, lifecycles_state.Services)


def stream_process_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycles of processes as the snapshots of each host arrive."""
    x = Tables(spark, sf_dir)
    fields = ["pid", "lifetime_id", "rss_bytes", "virtual_memory_bytes"]
    return lifecycles(spark, x, x.process_captured, "processes", fields, lifecycles_state.Processes)


def queries() -> dict:
    return {f.__name__: f for f in (stream_journal, stream_interval_join, stream_cycle, stream_late_evidence, stream_evidence, stream_service_lifecycle, stream_process_lifecycle)}


def oracles() -> dict[str, str]:
    return {
        "stream_journal": sql("SELECT host_id, unit, cursor FROM ev"),
        "stream_interval_join": sql(
            f"SELECT a.host_id, a.unit, a.cursor AS anchor_id, e.cursor FROM ev a JOIN ev e ON a.host_id = e.host_id "
            f"AND a.unit = e.unit AND a.event_type = 'error' AND e.event_type = 'purchase' "
            f"AND abs(epoch_us(e.ts) - epoch_us(a.ts)) <= {WINDOW_SECONDS}000000"
        ),
        "stream_service_lifecycle": sql("SELECT host_id, snapshot_id, name, lifecycle FROM svc", LIFE),
        "stream_evidence": sql(
            "SELECT host_id, incident_id, evidence_id, CAST(n > 3 AS VARCHAR) AS outcome FROM stays UNION ALL "
            "SELECT host_id, incident_id, evidence_id, 'content_differs' FROM stays WHERE evidence_id LIKE '%7'",
            CORR,
            """
stays AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY host_id, incident_id) AS n, row_number() OVER (PARTITION BY host_id, incident_id,
    reason <> 'service_change_anchor' ORDER BY evidence_at DESC, kind DESC, evidence_id DESC) AS k FROM evidence)
  WHERE reason = 'service_change_anchor' OR k <= 2 OR n <= 3)""",
            most=6,
        ),
        "stream_process_lifecycle": sql(
            "SELECT host_id, snapshot_id, pid, lifetime_id, lifecycle, rss_delta, vm_delta FROM prc_now UNION ALL "
            "SELECT host_id, snapshot_id, pid, lifetime_id, lifecycle, NULL, NULL FROM prc_gone",
            LIFE,
        ),
        "stream_cycle": sql(
            f"""SELECT c.host_id, c.incident_id, c.subject_id, CASE WHEN back_at IS NULL THEN 'active'
              ELSE 'resolved' END AS state, {fixed('c.started_at', 'started_at')},
          {fixed('coalesce(back_at, last_observed_at)', 'last_observed_at')}, {fixed('back_at', 'resolved_at')}, n_evidence
          FROM candidates c LEFT JOIN ended e ON e.host_id = c.host_id AND e.incident_id = c.incident_id""",
            CORR,
            """
ended AS (
  SELECT c.host_id, c.incident_id, min(back_at) AS back_at FROM candidates c JOIN recovery b ON b.host_id = c.host_id AND b.subject_id = c.subject_id
    AND b.back_at >= c.started_at GROUP BY c.host_id, c.incident_id)""",
        ),
        "stream_late_evidence": sql(
            f"""SELECT host_id, incident_id, CASE WHEN resolved IS NULL THEN 'active' ELSE 'resolved' END AS state, {fixed('last', 'last_observed_at')},
              {fixed('resolved', 'resolved_at')}, n_evidence, CASE WHEN refused THEN CAST(1 AS BIGINT) END AS refused_in FROM (
              SELECT coalesce(o.host_id, n.host_id) AS host_id, coalesce(o.incident_id, n.incident_id) AS incident_id, resolved,
                coalesce(n.last_observed_at > resolved, false) AS refused,
                CASE WHEN o.host_id IS NULL OR resolved IS NULL AND n.last_observed_at > o.last THEN n.last_observed_at ELSE o.last END AS last,
                CASE WHEN coalesce(n.last_observed_at > resolved, false) OR n.host_id IS NULL THEN o.n_evidence ELSE (
                  SELECT count(*) FROM (SELECT kind, evidence_id FROM early_evidence e WHERE e.host_id = n.host_id AND e.incident_id = n.incident_id
                    UNION SELECT kind, evidence_id FROM late_evidence e WHERE e.host_id = n.host_id AND e.incident_id = n.incident_id)) END AS n_evidence
              FROM first_state o FULL JOIN second_offer n ON o.host_id = n.host_id AND o.incident_id = n.incident_id)""",
            f"""
snaps AS (SELECT * FROM snapshots WHERE snapshot_id <= {LAST_SNAPSHOT}),
early_all AS (SELECT * FROM journal_events WHERE NOT ({LATE}) AND snapshot_id <= {LAST_SNAPSHOT}),
both_all AS (SELECT * FROM journal_events WHERE snapshot_id <= {LAST_SNAPSHOT}),
early_evidence AS (WITH {corr('early_all', 'snaps', LATE_WINDOW)} SELECT * FROM evidence),
late_evidence AS (WITH {corr('both_all', 'snaps', LATE_WINDOW)} SELECT * FROM evidence WHERE (host_id, change_id) IN (SELECT (a.host_id, a.change_id)
  FROM anchors a JOIN both_all e ON e.host_id = a.host_id AND e.unit = a.name AND {LATE} AND abs(epoch_us(e.observed_at) - epoch_us(a.observed_at)) <= {LATE_WINDOW}000000)),
first_state AS (WITH {corr('early_all', 'snaps', LATE_WINDOW)},
  back_times AS (SELECT c.host_id, c.incident_id, min(back_at) AS back_at FROM candidates c JOIN recovery b ON b.host_id = c.host_id
    AND b.subject_id = c.subject_id AND b.back_at >= c.started_at GROUP BY c.host_id, c.incident_id)
  SELECT c.host_id, c.incident_id, CASE WHEN back_at >= last_observed_at THEN back_at END AS resolved, CASE WHEN back_at >= last_observed_at THEN back_at
    ELSE last_observed_at END AS last, n_evidence FROM candidates c LEFT JOIN back_times b ON b.host_id = c.host_id AND b.incident_id = c.incident_id),
second_offer AS (SELECT host_id, incident_id, max(evidence_at) AS last_observed_at FROM late_evidence GROUP BY host_id, incident_id)""",
        ),
    }
