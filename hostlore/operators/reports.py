"""Versioned JSON documents, one row each, made by Spark. No message or summary text is in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlore.functions.scalars import bounded, iso

VERSION = "1"


def document(**parts: Column) -> Column:
    return F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), *(c.alias(n) for n, c in parts.items())), {"ignoreNullFields": "false"})


def incident_payload() -> Column:
    return F.struct(
        "incident_id",
        "state",
        F.struct(F.col("subject_type").alias("type"), F.col("subject_id").alias("id")).alias("subject"),
        "rule_id",
        iso(F.col("started_at")).alias("opened_at"),
        iso(F.col("last_observed_at")).alias("last_observed_at"),
        F.when(F.col("resolved_at").isNotNull(), iso(F.col("resolved_at"))).alias("resolved_at"),
    )


def diagnosis_payload() -> Column:
    return F.struct(
        F.col("incident_id"),
        "subject_id",
        F.col("d.state").alias("state"),
        F.col("d.rule").alias("rule"),
        F.col("d.explanation").alias("explanation"),
        F.col("d.facts").alias("supported_facts"),
        F.col("d.evidence_ids").alias("provenance_ids"),
        F.col("d.history").alias("historical_incident_ids"),
        F.col("d.limitations").alias("limitations"),
        F.array(F.lit("causal_direction"), F.lit("exact_root_cause")).alias("not_established"),
    )


def incident_list(listed: DataFrame, limit: int) -> DataFrame:
    """The list document of at most ``limit`` incidents; the list is as long as the limit allows and no longer."""
    key = F.struct(-F.unix_micros("last_observed_at"), "incident_id")
    rows = listed.agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), incident_payload().alias("p")))), lambda x: x["p"]).alias("incidents"))
    n = F.size("incidents")
    return rows.select(
        document(
            incidents=F.col("incidents"), count=n, query=F.struct(F.lit(limit).alias("limit"), (n == limit).alias("limit_reached"))
        ).alias("document")
    )


def nested(diagnoses: DataFrame) -> DataFrame:
    return diagnoses.select("host_id", "incident_id", F.struct("state", "rule", "explanation", "facts", "evidence_ids", "history", "limitations").alias("d"))


def diagnosis_documents(diagnoses: DataFrame) -> DataFrame:
    rows = nested(diagnoses).join(diagnoses.select("host_id", "incident_id", "subject_id"), ["host_id", "incident_id"])
    return rows.select("host_id", "incident_id", document(diagnosis=diagnosis_payload()).alias("document"))


def inspection_documents(details: DataFrame, facts: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """``details``: incidents with their evidence arrays."""
    rows = details.join(facts, ["host_id", "incident_id"]).join(nested(diagnoses), ["host_id", "incident_id"])
    evidence = F.transform(
        "evidence",
        lambda e: F.struct(
            e["evidence_id"].alias("evidence_id"),
            e["kind"].alias("kind"),
            e["fact"].alias("fact"),
            e["reason"].alias("relation"),
            iso(e["evidence_at"]).alias("observed_at"),
            e["evidence_limitations"].alias("quality_limitations"),
        ),
    )
    groups = F.struct(F.col("established"), F.col("unknown_ids").alias("unknown_evidence_ids"), F.col("not_established"))
    limits = F.struct(F.col("limitations").alias("incident"), F.col("d.limitations").alias("diagnosis"))
    return rows.select(
        "host_id",
        "incident_id",
        document(
            incident=incident_payload(),
            evidence=evidence,
            facts=groups,
            historical_related_incident_ids=F.col("d.history"),
            diagnosis=diagnosis_payload(),
            limitations=limits,
        ).alias("document"),
    )


RESULT = ("status", "collected_at", "duration_seconds", "error_code", "error_message", "warnings")


def optional(rows: DataFrame, name: str, kind: str = "string") -> Column:
    return (F.col(name) if name in rows.columns else F.lit(None).cast(kind)).alias(name)


def status_documents(snapshots: DataFrame, results: DataFrame, single: dict[str, DataFrame], many: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """The status of each snapshot: its observations, the statuses of its collectors, and how each collection went.

    ``single``: groups with one row a snapshot (system, memory, cpu); ``many``: groups with several, and the column by which
    they are ordered. A group's fields are its columns; one that a snapshot lacks is null, or an empty list.
    """
    key = ["host_id", "snapshot_id"]
    fields = lambda df: [c for c in df.columns if c not in key]
    out = snapshots.select(*key, "observed_at", optional(snapshots, "warnings", "array<string>"))
    for name, df in single.items():
        out = out.join(df.select(*key, F.struct(*fields(df)).alias(name)), key, "left")
    for name, (df, order) in many.items():
        rows = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_by"), F.struct(*fields(df)).alias("row")))).alias(name))
        out = out.join(rows.withColumn(name, F.col(f"{name}.row")), key, "left")
    result = results.select(*key, "collector_name", *(optional(results, c, "array<string>" if c == "warnings" else "string") for c in RESULT))
    result = result.withColumn("collected_at", iso(F.col("collected_at").cast("timestamp")))
    went = result.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("collector_name", F.struct(*RESULT).alias("r")))).alias("_went"))
    out = out.join(went, key, "left")
    statuses = F.transform("_went", lambda x: F.struct(x["collector_name"].alias("name"), x["r"]["status"].alias("status")))
    nothing = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    groups = [*(F.col(n) for n in single), *(nothing(F.col(n), out.schema[n].dataType) for n in many)]
    snapshot = F.struct(
        iso(F.col("observed_at")).alias("timestamp"),
        *(c.alias(n) for c, n in zip(groups, [*single, *many], strict=True)),
        statuses.alias("collector_statuses"),
        nothing(F.col("warnings"), "array<string>").alias("warnings"),
    )
    collectors = F.map_from_entries(F.transform("_went", lambda x: F.struct(x["collector_name"], x["r"])))
    return out.select(*key, document(snapshot=snapshot, collectors=collectors).alias("document"))


def cycle_summary(
    snapshots: DataFrame,
    results: DataFrame,
    counts: dict[str, DataFrame],
    events: DataFrame,
    candidates: DataFrame,
    resolved: DataFrame,
    correlated: DataFrame | None = None,
    refused: DataFrame | None = None,
) -> DataFrame:
    """One row per snapshot: quality, observation counts, events, candidate, reconciled and resolved ids, limitations.

    ``refused``: (host_id, incident_id) of candidates that could not be merged; they are not among the reconciled.

    ``correlated``: (host_id, observed_at) once for each event that was looked at for the anchors of a snapshot.
    """
    key = ["host_id", "snapshot_id"]
    word = F.when(
        F.col("status") != "success",
        F.concat(
            F.when(F.col("collector_name") == "journal", "journal_collection_").otherwise(
                F.concat(F.lit("collector_"), "collector_name", F.lit("_"))
            ),
            "status",
        ),
    )
    timing = [optional(snapshots, c, "double") for c in ("started_monotonic", "completed_monotonic")]
    quality = F.map_from_entries(
        F.array_sort(F.collect_list(F.when(F.col("collector_name") != "journal", F.struct("collector_name", "status"))))
    ).alias("collection_quality")
    journal = F.max(F.when(F.col("collector_name") == "journal", F.col("status"))).alias("journal_status")
    out = snapshots.select(*key, "observed_at", *timing).join(results.groupBy(*key).agg(quality, journal), key, "left").join(
        results.groupBy(*key).agg(bounded(F.collect_set(word), "runtime_limitations_truncated").alias("limitations")), key, "left"
    )
    for name, df in {**{f"n_{n}": d for n, d in counts.items()}, "events_processed": events}.items():
        out = out.join(df.groupBy(*key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    if correlated is None:
        out = out.withColumn("events_correlated", F.lit(0).cast("long"))
    else:
        out = out.join(
            correlated.groupBy("host_id", "observed_at").agg(F.count("*").alias("events_correlated")), ["host_id", "observed_at"], "left"
        ).withColumn("events_correlated", F.coalesce("events_correlated", F.lit(0)))
    merged = candidates if refused is None else candidates.join(refused, ["host_id", "incident_id"], "left_anti")
    for name, df in (("candidate_ids", candidates), ("reconciled_ids", merged), ("resolved_ids", resolved)):
        ids = df.groupBy("host_id", F.col("at").alias("observed_at")).agg(F.array_sort(F.collect_set("incident_id")).alias(name))
        out = out.join(ids, ["host_id", "observed_at"], "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def cycle_documents(cycles: DataFrame) -> DataFrame:
    """A cycle's number is that of its snapshot on the host; times are null where the snapshots have none."""
    counts = F.struct(*(F.col(c).alias(c[2:]) for c in sorted(cycles.columns) if c.startswith("n_")))
    cycle = F.struct(
        F.col("snapshot_id").alias("number"),
        iso(F.col("observed_at")).alias("observed_at"),
        "started_monotonic",
        "completed_monotonic",
        (F.col("completed_monotonic") - F.col("started_monotonic")).alias("duration_seconds"),
        "snapshot_id",
        "collection_quality",
        counts.alias("observation_counts"),
        "journal_status",
        "events_processed",
        "events_correlated",
        F.col("candidate_ids").alias("incident_candidate_ids"),
        F.col("reconciled_ids").alias("reconciled_candidate_ids"),
        F.col("resolved_ids").alias("resolved_incident_ids"),
        "limitations",
    )
    return cycles.select("host_id", "snapshot_id", document(cycle=cycle).alias("document"))
