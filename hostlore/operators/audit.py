"""Data-quality audits: each returns (rule, violations), with zero rows counted too."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses, and the facts and reasons of each kind of evidence.
STATUSES = ("success", "partial", "permission_denied", "unsupported", "transient_failure", "invalid_data")
FACTS = {
    "service_change": ["service_failed", "service_inactive", "service_deactivating", "service_removed", "unknown"],
    "journal_event": ["journal_unit_event", "unknown"],
    "process_change": ["process_exited", "process_started", "process_identity_changed", "unknown"],
}
REASONS = {"service_change": "service_change_anchor", "journal_event": "service_unit_match", "process_change": "explicit_process_association"}


def count_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All rules of one table in one pass."""
    counts = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(r) for r, c in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in rules))).alias("x")).select("x.*")


def table_rules(df: DataFrame, name: str, key: list[str], domains: dict[str, Column], parents: DataFrame | None = None) -> DataFrame:
    """Repeated keys, rows out of domain and, with ``parents``, rows without one: one pass of a table."""
    orphan = F.lit(False)
    if parents is not None:
        df = df.join(parents.select("host_id", "snapshot_id", F.lit(True).alias("_known")), ["host_id", "snapshot_id"], "left")
        orphan = F.col("_known").isNull()
    broken = {**domains, f"{name}_orphans": orphan} if parents is not None else domains
    per = df.groupBy(*key).agg(F.count("*").alias("_n"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(r) for r, c in broken.items()))
    counts = per.agg(F.count_if(F.col("_n") > 1).alias(f"{name}_key"), *(F.coalesce(F.sum(r), F.lit(0)).alias(r) for r in broken))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in counts.columns))).alias("x")).select("x.*")


def audit_constraints(snapshots: DataFrame, results: DataFrame, services: DataFrame, processes: DataFrame, network: DataFrame, events: DataFrame) -> DataFrame:
    """Keys, references and domains of the stored tables."""
    key, parents = ["host_id", "snapshot_id"], snapshots.select("host_id", "snapshot_id").distinct()
    tables = [
        table_rules(snapshots, "snapshot", key, {}),
        table_rules(results, "result", [*key, "collector_name"], {"status_domain": ~F.col("status").isin(*STATUSES)}, parents),
        table_rules(services, "service", [*key, "name"], {}, parents),
        table_rules(processes, "process", [*key, "pid"], {"process_domain": (F.col("pid") <= 0) | (F.col("threads") < 1)}, parents),
        table_rules(network, "network", [*key, "interface"], {"counter_domain": (F.col("receive_bytes") < 0) | (F.col("transmit_bytes") < 0)}, parents),
        table_rules(events, "event", ["host_id", "cursor"], {"priority_domain": (F.col("priority") < 0) | (F.col("priority") > 7)}),
    ]
    return reduce(DataFrame.unionByName, tables)


def audit_incidents(incidents: DataFrame, evidence: DataFrame, most: int = 128) -> DataFrame:
    """The contract of incidents and their evidence."""
    key = ["host_id", "incident_id"]
    anchor = F.col("reason") == "service_change_anchor"
    per = evidence.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.countDistinct("kind", "evidence_id").alias("distinct"),
        F.countDistinct("kind").alias("kinds"),
        F.count_if(anchor).alias("anchors"),
        F.max(F.when(anchor, F.col("evidence_at"))).alias("anchor_at"),
        F.max("evidence_at").alias("last"),
    )
    rows = incidents.join(per, key, "left")
    heads = count_rules(
        rows,
        {
            "one_anchor": ~F.col("anchors").eqNullSafe(F.lit(1)),
            "starts_at_anchor": F.col("anchor_at") != F.col("started_at"),
            "two_kinds": F.coalesce("kinds", F.lit(0)) < 2,
            "evidence_bound": F.col("n") > most,
            "unique_evidence": F.col("n") != F.col("distinct"),
            "no_later_evidence": F.col("last") > F.col("last_observed_at"),
            "resolved_in_order": F.col("resolved_at") < F.col("last_observed_at"),
            "resolved_state": (F.col("state") == "resolved") != F.col("resolved_at").isNotNull(),
            "id_shape": ~F.col("incident_id").rlike("^[0-9a-f]{64}$"),
            "limitations_sorted": ~F.col("limitations").eqNullSafe(F.array_sort(F.array_distinct("limitations"))),
            "limitations_bound": F.size("limitations") > 32,
        },
    )
    fits = reduce(lambda a, b: a | b, [(F.col("kind") == k) & (F.col("reason") == REASONS[k]) & F.col("fact").isin(*FACTS[k]) for k in FACTS])
    return heads.unionByName(count_rules(evidence, {"kind_reason_fact": ~fits, "summary_bound": F.length("summary") > 512}))


def audit_collections(results: DataFrame) -> DataFrame:
    """Status, time and duration of collection results."""
    return count_rules(
        results,
        {
            "status_known": ~F.col("status").isin(*STATUSES),
            "has_time": F.col("collected_at").isNull(),
            "duration_positive": ~F.coalesce(
                (F.col("duration_seconds") >= 0) & ~F.isnan("duration_seconds") & (F.col("duration_seconds") < float("inf")), F.lit(False)
            ),
        },
    )


def audit_reports(diagnoses: DataFrame, cycles: DataFrame) -> DataFrame:
    """Bounds and order of diagnoses and cycle summaries.

    Of a cycle's times, which may be null, the end mustn't be before the start, both must be finite, and where they are
    in order, ``duration_seconds`` (if there is such a column) must be what lies between them.
    """
    start, end = F.col("started_monotonic"), F.col("completed_monotonic")
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    duration = F.col("duration_seconds") if "duration_seconds" in cycles.columns else end - start
    ids = F.array("candidate_ids", "reconciled_ids", "resolved_ids")
    a = count_rules(
        diagnoses,
        {
            "history_bound": F.size("history") > 20,
            "history_unique": F.size("history") != F.size(F.array_distinct("history")),
            "provenance": F.size("evidence_ids") < 1,
            "facts": F.size("facts") < 1,
            "explanation": F.length("explanation") < 1,
            "limits_bound": F.size("limitations") > 32,
        },
    )
    return a.unionByName(
        count_rules(
            cycles,
            {
                "counts_positive": F.least("n_services", "n_processes", "n_network", "events_processed") < 0,
                "cycle_limits_sorted": ~F.col("limitations").eqNullSafe(F.array_sort(F.array_distinct("limitations"))),
                "cycle_limits_bound": (F.size("limitations") > 32) | F.exists("limitations", lambda x: (F.length(x) < 1) | (F.length(x) > 256)),
                "cycle_ids_unique": F.exists(ids, lambda x: F.size(x) != F.size(F.array_distinct(x))),
                "cycle_ids_shape": F.exists(F.flatten(ids), lambda x: ~x.rlike("^[0-9a-f]{64}$")),
                "cycle_number": F.col("snapshot_id") < 1,
                "cycle_time_finite": ~(finite(start) & finite(end) & finite(duration)),
                "cycle_time_order": (finite(start) & finite(end) & (end < start)) | (duration < 0),
                "cycle_duration": finite(start) & finite(end) & (end >= start) & (duration != end - start),
            },
        )
    )


def upgrade_history(events: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Older rows in today's form: fixed-precision times, a marker for unknown quality, and facts that default to unknown."""
    up = events.withColumns(
        {
            "observed_text": F.date_format(F.try_to_timestamp("observed_text"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"),
            "warnings": F.coalesce("warnings", F.array(F.lit("legacy_quality_unknown"))),
        }
    )
    return up, evidence.withColumn("fact", F.coalesce("fact", F.lit("unknown")))
