"""Merging incoming candidates into stored incidents: a full overlay, computed before anything is written.

Stored and incoming tables have the columns of ``correlate.candidates`` and ``correlate.correlate``. Rows that cannot be
merged come back as conflicts with a reason; ``strict`` callers refuse the batch when there are any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlore.functions.scalars import MAX_LIMITATIONS, bounded

MAX_EVIDENCE = 128
EVIDENCE_LIMIT = "evidence_storage_limit_reached"
HEADER = ["rule_id", "subject_type", "subject_id", "state", "started_at", "last_observed_at", "resolved_at", "limitations"]


def unique_candidates(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates once per id, and the ids that come with different content."""
    whole = F.struct(*HEADER)
    rows = incoming.groupBy("host_id", "incident_id").agg(F.min(whole).alias("v"), F.max(whole).alias("w"))
    return rows.where("v <=> w").select("host_id", "incident_id", "v.*"), rows.where("not (v <=> w)").select(
        "host_id", "incident_id", F.lit("unequal_duplicates").alias("problem")
    )


def merge_limitations(a: Column | str, b: Column | str) -> Column:
    """Union, sorted, at most 32 with a marker."""
    union = F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))
    return bounded(union, "quality_limitations_storage_limit_reached", MAX_LIMITATIONS)


def upsert(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The overlay of incidents, and the refused: another identity under an id, or newer evidence for a resolved one.

    ``change`` is stored, inserted, extended or kept. A resolved incident never opens again. Where a merge is refused, the
    stored row stays as it was (kept), and the second table has (host_id, incident_id, problem, offered_at): the reason
    and the last time that the refused candidate had.
    """
    old, new = (df.select("host_id", "incident_id", F.struct(*HEADER).alias(side)) for df, side in ((stored, "o"), (incoming, "n")))
    both = old.join(new, ["host_id", "incident_id"], "full_outer")
    clash = F.col("o").isNotNull() & F.col("n").isNotNull() & (
        (F.col("o.rule_id") != F.col("n.rule_id")) | (
            F.col("o.subject_type") != F.col("n.subject_type")
        ) | (F.col("o.subject_id") != F.col("n.subject_id")) | (F.col("o.started_at") != F.col("n.started_at"))
    )
    late = (F.col("o.state") == "resolved") & (F.col("n.last_observed_at") > F.col("o.resolved_at"))
    problem = F.when(clash, "identity_reused").when(late, "evidence_after_resolution")
    both = both.withColumn("problem", problem)
    refused = F.col("problem").isNotNull()
    extended = ~refused & (F.col("o.state") == "active") & (F.col("n.last_observed_at") > F.col("o.last_observed_at"))
    change = F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "stored").when(extended, "extended").otherwise("kept")
    last = F.when(F.col("o").isNull(), F.col("n.last_observed_at")).when(
        F.coalesce(extended, F.lit(False)), F.col("n.last_observed_at")
    ).otherwise(F.col("o.last_observed_at"))
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}").alias(c)
    merged = both.select(
        "host_id",
        "incident_id",
        pick("rule_id"),
        pick("subject_type"),
        pick("subject_id"),
        pick("state"),
        pick("started_at"),
        last.alias("last_observed_at"),
        F.col("o.resolved_at").alias("resolved_at"),
        F.when(refused, F.col("o.limitations")).otherwise(merge_limitations("o.limitations", "n.limitations")).alias("limitations"),
        change.alias("change"),
    )
    return merged, both.where(refused).select("host_id", "incident_id", "problem", F.col("n.last_observed_at").alias("offered_at"))


def merge_evidence(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of evidence by kind and id. A known fact beats unknown; different content or facts are conflicts.

    A stored row that an incoming one differs from stays as it was; of incoming rows that differ among themselves, none
    is taken. The second table has each such key with its reason.
    """
    core = F.struct("evidence_at", "reason", "summary")
    known = F.when(F.col("fact") != "unknown", F.col("fact"))
    sides = stored.withColumn("is_stored", F.lit(True)).unionByName(incoming.withColumn("is_stored", F.lit(False)), allowMissingColumns=True)
    whole = F.struct(core.alias("c"), "fact", "evidence_limitations")
    rows = sides.groupBy("host_id", "incident_id", "kind", "evidence_id").agg(
        F.min(core).alias("c"),
        F.max(core).alias("d"),
        F.min(known).alias("low"),
        F.max(known).alias("high"),
        F.flatten(F.collect_set("evidence_limitations")).alias("all"),
        F.max(F.when(F.col("is_stored"), whole)).alias("was"),
    )
    problem = F.when(F.col("c") != F.col("d"), "content_differs").when(F.col("low") != F.col("high"), "facts_differ")
    rows = rows.withColumn("problem", problem)
    fine = F.col("problem").isNull()
    limits = bounded(F.col("all"), "evidence_quality_limitations_storage_limit_reached")
    clean = rows.where(fine | F.col("was").isNotNull()).withColumn("core", F.when(fine, F.col("c")).otherwise(F.col("was.c"))).select(
        "host_id",
        "incident_id",
        "kind",
        "evidence_id",
        "core.*",
        F.when(fine, F.coalesce("low", F.lit("unknown"))).otherwise(F.col("was.fact")).alias("fact"),
        F.when(fine, limits).otherwise(F.col("was.evidence_limitations")).alias("evidence_limitations"),
    )
    return clean, rows.where(~fine).select("host_id", "incident_id", "kind", "evidence_id", "problem")


def cap_evidence(evidence: DataFrame, most: int = MAX_EVIDENCE) -> DataFrame:
    """The anchor and the latest ``most`` - 1 others of each incident; ``truncated`` tells that some went, now or before."""
    other = F.col("reason") != "service_change_anchor"
    w = Window.partitionBy("host_id", "incident_id", other).orderBy(F.desc("evidence_at"), F.desc("kind"), F.desc("evidence_id"))
    whole = Window.partitionBy("host_id", "incident_id")
    over = F.count("*").over(whole) > most
    before = F.coalesce(F.max("truncated").over(whole), F.lit(False)) if "truncated" in evidence.columns else F.lit(False)
    return evidence.withColumns(
        {"place": F.row_number().over(w), "over": over, "truncated": over | before}
    ).where(~other | (F.col("place") <= most - 1) | ~F.col("over")).drop("place", "over")


def merge_stored_evidence(state: DataFrame, incoming: DataFrame, most: int = MAX_EVIDENCE) -> tuple[DataFrame, DataFrame]:
    """The next state of stored evidence: at most ``most`` rows of an incident, with ``truncated``, and the conflicts.

    The latest rows of two parts are among the latest of each, so merging batch by batch leaves what merging all at once
    does: what was dropped has ``most`` - 1 later rows before it for good. The state is all that a merge reads.
    """
    clean, conflicts = merge_evidence(state.drop("truncated"), incoming)
    before = state.where("truncated").select("host_id", "incident_id", F.lit(True).alias("truncated")).distinct()
    rows = clean.join(before, ["host_id", "incident_id"], "left")
    return cap_evidence(rows, most), conflicts


def with_limit_mark(limitations: Column, full: Column) -> Column:
    """The limitations of an incident, with the mark of dropped evidence where ``full``."""
    mark = F.when(F.coalesce(full, F.lit(False)), F.array(F.lit(EVIDENCE_LIMIT))).otherwise(F.array().cast("array<string>"))
    return merge_limitations(limitations, mark)


def settled(incidents: DataFrame, times: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Active incidents with a ``resolved_time`` in ``times`` become resolved; those with later evidence are conflicts."""
    rows = incidents.join(times, key, "left")
    hit = (F.col("state") == "active") & F.col("resolved_time").isNotNull()
    early = hit & (F.col("resolved_time") < F.col("last_observed_at"))
    out = rows.withColumns({"hit": hit & ~early, "early": early})
    keep = [F.col(c) for c in incidents.columns if c not in ("state", "last_observed_at", "resolved_at")]
    then = lambda new, name: F.when(F.col("hit"), new).otherwise(F.col(name)).alias(name)
    done = out.select(
        *keep,
        then(F.lit("resolved"), "state"),
        then(F.col("resolved_time"), "last_observed_at"),
        then(F.col("resolved_time"), "resolved_at"),
        F.coalesce("hit", F.lit(False)).alias("now_resolved"),
    )
    return done, out.where("early").select("host_id", "incident_id", F.lit("resolution_before_evidence").alias("problem"))


def resolve_over_time(incidents: DataFrame, recoveries: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``resolve`` does cycle by cycle, for all cycles at once.

    ``recoveries``: (host_id, subject_id, resolved_time), the time of a cycle's authoritative collection in which the
    subject is well again. One counts unless a candidate of the subject started in that cycle. An incident is
    resolved by the first that counts at or after its start.
    """
    key = ["host_id", "subject_id"]
    same = candidates.select(*key, F.col("started_at").alias("resolved_time")).distinct()
    counted = recoveries.join(same, [*key, "resolved_time"], "left_anti")
    line = incidents.select(*key, "incident_id", F.col("started_at").alias("at"), F.lit(1).alias("kind"))
    line = line.unionByName(counted.select(*key, F.lit(None).cast("string").alias("incident_id"), F.col("resolved_time").alias("at"), F.lit(0).alias("kind")))
    later = Window.partitionBy(*key).orderBy(F.desc("at"), "kind")
    first = F.last(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(later.rowsBetween(Window.unboundedPreceding, 0))
    times = line.withColumn("resolved_time", first).where("kind = 1").select("host_id", "incident_id", "resolved_time")
    return settled(incidents, times, ["host_id", "incident_id"])


def resolve(incidents: DataFrame, subjects: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active incidents of ``subjects`` (host_id, subject_id, resolved_time) become resolved, unless the batch has a candidate.

    A resolution earlier than the incident's last evidence is a conflict. Callers pass subjects of authoritative
    collections only.
    """
    times = subjects.join(
        candidates.select("host_id", "subject_id").distinct(), ["host_id", "subject_id"], "left_anti"
    ).groupBy("host_id", "subject_id").agg(F.max("resolved_time").alias("resolved_time"))
    return settled(incidents, times, ["host_id", "subject_id"])


def result(candidates: DataFrame, resolved: DataFrame) -> DataFrame:
    """(host_id, incident_id, outcome): the candidates that were reconciled and the incidents that were resolved, once each."""
    a = candidates.select("host_id", "incident_id").distinct().withColumn("outcome", F.lit("reconciled"))
    return a.unionByName(resolved.where("now_resolved").select("host_id", "incident_id").distinct().withColumn("outcome", F.lit("resolved")))
