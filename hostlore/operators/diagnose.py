"""Deterministic diagnoses of all incidents at once: rule, history, explanation, limitations, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostlore.functions.scalars import bounded

RECENT, HISTORY, MAX_LENGTH = 1000, 20, 256
INCOMPLETE = "partial|unavailable|denied|failure|unsupported|invalid|unknown"
NOT_ESTABLISHED = ["causal_direction", "current_system_state", "exact_root_cause"]
#: The texts of the explanations.
TEXTS = {
    "unsupported_service_condition": " has an incident candidate, but its opening condition is not established as a service failure by the available " "structured evidence.",
    "service_failure_journal_process_exit": " entered a failed state. An exact-unit journal event and an explicitly associated process lifetime termination " "occurred within the incident evidence interval.",
    "service_failure_journal": " entered a failed state and an exact-unit journal event occurred within the incident evidence interval.",
    "service_failure_process_exit": " entered a failed state and an explicitly associated process lifetime ended within the incident evidence interval.",
    "service_failure_insufficient": " entered a failed state, but the incident contains no exact-unit journal event or explicitly associated process " "termination.",
}
CLOSING = " These facts satisfy deterministic relationship rules. The exact root cause and causal direction are not established."
CONTEXT = " Evidence context is incomplete, so unobserved facts may change interpretation."


def history(incidents: DataFrame, recent: int = RECENT, most: int = HISTORY) -> DataFrame:
    """(host_id, incident_id, history): up to ``most`` latest earlier incidents of the subject, oldest first.

    Only the ``recent`` last observed incidents of a subject count. They are numbered by time, an incident knows how many
    of them are earlier, and asks for the last ``most`` numbers: so many pairs for each incident, whatever the subject.
    """
    key = ["host_id", "subject_type", "subject_id"]
    own = Window.partitionBy(*key).orderBy(F.desc("last_observed_at"), "incident_id")
    rows = incidents.select(*key, "incident_id", "started_at", (F.row_number().over(own) <= recent).alias("counts"))
    until = F.sum(F.col("counts").cast("int")).over(Window.partitionBy(*key).orderBy("started_at").rangeBetween(Window.unboundedPreceding, 0))
    at_once = F.sum(F.col("counts").cast("int")).over(Window.partitionBy(*key, "started_at"))
    asks = rows.withColumn("earlier", (until - at_once).cast("int")).where("earlier > 0")
    asks = asks.select(*key, "incident_id", F.explode(F.sequence(F.greatest(F.lit(1), F.col("earlier") - (most - 1)), F.col("earlier"))).alias("number"))
    by_time = Window.partitionBy(*key).orderBy("started_at", "incident_id")
    pool = rows.where("counts").select(*key, F.row_number().over(by_time).alias("number"), F.col("incident_id").alias("past_id"))
    found = asks.join(pool, [*key, "number"]).groupBy("host_id", "incident_id").agg(F.array_sort(F.collect_list(F.struct("number", "past_id"))).alias("past"))
    return found.select("host_id", "incident_id", F.col("past.past_id").alias("history"))


def diagnose(incidents: DataFrame, evidence: DataFrame) -> DataFrame:
    """One diagnosis per incident: state, rule, facts, explanation, selected evidence, history, limitations."""
    key = ["host_id", "incident_id"]
    has = lambda fact: F.max(F.coalesce(F.col("fact") == fact, F.lit(False)))
    item = F.struct("evidence_at", "kind", "evidence_id", "fact", "evidence_limitations")
    facts = evidence.groupBy(*key).agg(
        F.max(F.when(F.col("reason") == "service_change_anchor", F.col("fact"))).alias("anchor"),
        has("journal_unit_event").alias("journal"),
        has("process_exited").alias("exit"),
        F.array_sort(F.collect_set(F.when(F.col("reason") == "service_change_anchor", item))).alias("anchors"),
        F.array_sort(F.collect_set(F.when(F.col("fact").isin("journal_unit_event", "process_exited"), item))).alias("others"),
    )
    failed = F.col("anchor") == "service_failed"
    rows = incidents.join(facts, key).join(history(incidents), key, "left").withColumn("history", F.coalesce("history", F.array().cast("array<string>")))
    rule = (
        F.when(~failed, "unsupported_service_condition").when(
            F.col("journal") & F.col("exit"), "service_failure_journal_process_exit"
        ).when(F.col("journal"), "service_failure_journal").when(F.col("exit"), "service_failure_process_exit").otherwise(
            "service_failure_insufficient"
        )
    )
    rows = rows.withColumn("rule", rule)
    is_ = lambda *names: F.col("rule").isin(*[f"service_failure_{n}" for n in names])
    unsupported = F.col("rule") == "unsupported_service_condition"
    chosen = F.when(is_("journal_process_exit", "journal", "process_exit"), F.array_sort(F.array_union("anchors", "others"))).otherwise(F.col("anchors"))
    extra = (
        F.when(
            unsupported & (F.col("anchor") == "unknown"), "legacy_evidence_fact_unknown"
        ).when(
            unsupported, "service_condition_not_supported_by_diagnostic_rules"
        ).when(is_("journal"), "associated_process_termination_not_observed").when(
            is_("process_exit"), "exact_unit_journal_evidence_not_observed"
        ).when(is_("insufficient"), "insufficient_diagnostic_evidence")
    )
    named = F.array_compact(
        F.array(
            F.when(unsupported, F.col("anchor")).otherwise(F.lit("service_failed")),
            F.when(is_("journal", "journal_process_exit"), F.lit("exact_unit_journal_event")),
            F.when(is_("process_exit", "journal_process_exit"), F.lit("associated_process_lifetime_exited")),
            F.when(F.size("history") > 0, F.concat(F.lit("prior_incident_candidates:"), F.size("history").cast("string"))),
        )
    )
    rows = rows.withColumns({"selected": chosen, "facts": named})
    limits = F.array_distinct(
        F.concat(F.col("limitations"), F.array_compact(F.array(extra)), F.flatten(F.transform("selected", lambda x: x["evidence_limitations"])))
    )
    rows = rows.withColumn("all_limits", limits)
    n = F.size("history")
    past = F.when(
        n > 0,
        F.concat(
            F.lit(" "),
            n.cast("string"),
            F.lit(" earlier incident candidate"),
            F.when(n != 1, "s").otherwise(""),
            F.lit(" for the same service are recorded; this does not establish a recurring cause."),
        ),
    ).otherwise("")
    text = F.element_at(F.create_map(*(F.lit(x) for pair in TEXTS.items() for x in pair)), F.col("rule"))
    shaky = F.exists("all_limits", lambda x: x.rlike(INCOMPLETE))
    state = F.when(unsupported, "unknown").when(is_("insufficient"), "insufficient_evidence").otherwise("supported")
    return rows.select(
        *key,
        "subject_id",
        state.alias("state"),
        "rule",
        "facts",
        F.concat("subject_id", text, past, F.lit(CLOSING), F.when(shaky, CONTEXT).otherwise("")).alias("explanation"),
        F.transform("selected", lambda x: x["evidence_id"]).alias("evidence_ids"),
        "history",
        bounded(
            F.filter("all_limits", lambda x: (F.length(x) > 0) & (F.length(x) <= MAX_LENGTH)), "diagnosis_limitations_truncated"
        ).alias("limitations"),
    )


def fact_groups(evidence: DataFrame) -> DataFrame:
    """Established facts, evidence without a known fact, and what is never established."""
    known = F.col("fact") != "unknown"
    return evidence.groupBy("host_id", "incident_id").agg(
        F.array_sort(F.collect_set(F.when(known, F.col("fact")))).alias("established"),
        F.array_sort(F.collect_set(F.when(~known, F.col("evidence_id")))).alias("unknown_ids"),
    ).withColumn("not_established", F.array(*map(F.lit, NOT_ESTABLISHED)))
