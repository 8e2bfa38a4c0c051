"""Stored state: appending events, checkpoints, quality, snapshots in and out, listings, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostlore.operators import chain
from hostlore.sources.publish import publish

KEY = ["host_id", "snapshot_id"]


def new_events(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming events whose cursor is not stored, once each."""
    return incoming.dropDuplicates(["host_id", "cursor"]).join(stored.select("host_id", "cursor"), ["host_id", "cursor"], "left_anti")


def gate_batches(batches: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Accepts or refuses batches (host_id, n_events, last_cursor, next_cursor, expected_cursor).

    The saved cursor must be the expected one, a batch must end at its last event, an empty one may not move the cursor.
    """
    return judge(batches.join(checkpoints.select("host_id", F.col("cursor").alias("saved")), "host_id", "left")).drop("saved")


def judge(rows: DataFrame) -> DataFrame:
    """Batches with the ``saved`` cursor that they meet: accepted, or the reason why not."""
    reason = (
        F.when(~F.col("expected_cursor").eqNullSafe(F.col("saved")), "checkpoint_changed").when(
            (F.col("n_events") > 0) & ~F.col("next_cursor").eqNullSafe(F.col("last_cursor")), "checkpoint_not_last_event"
        ).when((F.col("n_events") == 0) & ~F.col("next_cursor").eqNullSafe(F.col("saved")), "empty_batch_moves_checkpoint")
    )
    return rows.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def gate_history(batches: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """``gate_batches`` for all batches of each host in the order of ``seq``, where an accepted one moves the saved cursor.

    ``checkpoints`` (host_id, cursor): what is saved at first; hosts that aren't there have nothing saved. Adds ``saved``, the
    cursor that a batch met, ``accepted`` and ``reason``. A refused batch leaves the cursor, so a later one that
    expects it is accepted. ``seq`` must be unique in a host.
    """
    start = batches.select("host_id").distinct().join(checkpoints.select("host_id", F.col("cursor").alias("state")), "host_id", "left")
    possible = F.when(F.col("n_events") > 0, F.col("next_cursor").eqNullSafe(F.col("last_cursor"))).otherwise(
        F.col("next_cursor").eqNullSafe(F.col("expected_cursor"))
    )
    steps = batches.where(possible).select("host_id", F.col("seq").alias("place"), F.col("expected_cursor").alias("enter"), F.col("next_cursor").alias("leave"))
    path = chain.taken(steps, start, ["host_id"])
    rows = batches.withColumns({"place": F.col("seq"), "leave": F.col("next_cursor")})
    met = chain.states(rows, path, start, ["host_id"])
    judged = judge(met.drop("place", "leave", "reached").withColumnRenamed("before", "saved"))
    return judged


def checkpoints(events: DataFrame) -> DataFrame:
    """The last accepted cursor of each host and source, by ``seq``."""
    return events.groupBy("host_id", "source").agg(F.max_by("cursor", "seq").alias("cursor"), F.max("observed_at").alias("updated_at"))


QUALITY = {"duration_seconds": "double", "error_code": "string", "error_message": "string", "warnings": "array<string>"}


def latest_quality(results: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """The newest collection result of each host and collector, failures included.

    ``accepted`` (host_id, snapshot_id, collector_name, event_count): how many facts a collection took in, which is not how
    many are still stored. A failure has none; a success that isn't there took in 0. Fields that ``results`` lacks are null.
    """
    keys = ["host_id", "snapshot_id", "collector_name"]
    rows = results.withColumns({c: F.lit(None).cast(kind) for c, kind in QUALITY.items() if c not in results.columns})
    if accepted is None:
        rows = rows.withColumn("event_count", F.lit(None).cast("long"))
    else:
        taken = F.when(F.col("status").isin("success", "partial"), F.coalesce("event_count", F.lit(0).cast("long")))
        rows = rows.join(accepted.select(*keys, "event_count"), keys, "left").withColumn("event_count", taken)
    fields = ["snapshot_id", "status", "collected_at", "event_count", *QUALITY]
    newest = rows.groupBy("host_id", "collector_name").agg(F.max_by(F.struct(*fields), F.struct("collected_at", "snapshot_id")).alias("r"))
    return newest.select("host_id", "collector_name", "r.*")


def valid_snapshots(snapshots: DataFrame, results: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], claimed: DataFrame | None = None) -> DataFrame:
    """Snapshots without repeated collectors or child keys; all or nothing.

    ``claimed`` (host_id, snapshot_id, collector_name, status): the statuses that the snapshots themselves name. A snapshot
    is refused when they aren't those of its collection results, each once.
    """
    bad = results.groupBy(*KEY, "collector_name").count().where("count > 1").select(*KEY)
    for df, key in children.values():
        bad = bad.unionByName(df.groupBy(*KEY, *key).count().where("count > 1").select(*KEY))
    if claimed is not None:
        one = lambda df, name: df.groupBy(*KEY, "collector_name").agg(F.min("status").alias(name), F.count("*").alias(f"n_{name}"))
        both = one(claimed, "said").join(one(results, "was"), [*KEY, "collector_name"], "full_outer")
        bad = bad.unionByName(both.where(~F.col("said").eqNullSafe(F.col("was")) | (F.col("n_said") > 1)).select(*KEY))
    return snapshots.join(bad.distinct(), KEY, "left_anti")


def fan_out(
    snapshots: DataFrame, results: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], claimed: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The child tables of the valid snapshots."""
    good = valid_snapshots(snapshots, results, children, claimed).select(*KEY)
    return {name: df.join(good, KEY, "left_semi") for name, (df, _) in children.items()}


def publish_snapshots(
    path: str,
    snapshots: DataFrame,
    results: DataFrame,
    children: dict[str, tuple[DataFrame, list[str]]],
    claimed: DataFrame | None = None,
    expected: int | None = None,
) -> int:
    """Writes the valid snapshots, their results and all their child tables as one version under ``path``; see ``publish``."""
    good = valid_snapshots(snapshots, results, children, claimed)
    kept = good.select(*KEY)
    tables = {"snapshots": good, "results": results.join(kept, KEY, "left_semi")}
    tables |= {name: df.join(kept, KEY, "left_semi") for name, (df, _) in children.items()}
    return publish(path, tables, expected)


def rebuild(snapshots: DataFrame, results: DataFrame, services: DataFrame, processes: DataFrame) -> DataFrame:
    """Snapshots with their children as sorted arrays."""
    gather = lambda df, name, *cols: df.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    out = snapshots.select(*KEY, "observed_at")
    for part in (
        gather(results, "results", "collector_name", "status"),
        gather(services, "services", "name", "load_state", "active_state", "sub_state"),
        gather(processes, "processes", "pid", "lifetime_id"),
    ):
        out = out.join(part, KEY, "left")
    return out


def recent_events(events: DataFrame, limit: int = 200, unit: str | None = None, before=None) -> DataFrame:
    """The newest events, of a unit and before a time if given."""
    if unit is not None:
        events = events.where(F.col("unit") == unit)
    if before is not None:
        events = events.where(F.col("observed_at") < before)
    return events.orderBy(F.desc("observed_at"), F.desc("cursor")).limit(limit)


def event_window(events: DataFrame, unit: str, start, end, limit: int) -> DataFrame:
    """Events of a unit from start to end, both included, oldest first; ``truncated`` tells that the limit cut some."""
    rows = events.where((F.col("unit") == unit) & F.col("observed_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    first = rows.orderBy("observed_at", "cursor").limit(limit + 1)  # a bounded number of rows from here on
    w = Window.partitionBy("unit")
    return first.withColumns(
        {"place": F.row_number().over(w.orderBy("observed_at", "cursor")), "truncated": F.count("*").over(w) > limit}
    ).where(F.col("place") <= limit)


def recent_incidents(incidents: DataFrame, limit: int = 100, state: str | None = None, subject_id: str | None = None) -> DataFrame:
    """The last observed incidents, of a state or subject if given."""
    if state is not None:
        incidents = incidents.where(F.col("state") == state)
    if subject_id is not None:
        incidents = incidents.where(F.col("subject_id") == subject_id)
    return incidents.orderBy(F.desc("last_observed_at"), "incident_id").limit(limit)


def incident_detail(incidents: DataFrame, evidence: DataFrame) -> DataFrame:
    """Incidents with their evidence in order of time, kind and id."""
    rows = evidence.groupBy("host_id", "incident_id").agg(
        F.array_sort(F.collect_list(F.struct("evidence_at", "kind", "evidence_id", "reason", "fact", "evidence_limitations"))).alias("evidence")
    )
    return incidents.join(rows, ["host_id", "incident_id"], "left")


def keep_events_from(events: DataFrame, cutoff) -> DataFrame:
    return events.where(F.col("observed_at") >= F.lit(cutoff).cast("timestamp"))


def newest_events(events: DataFrame, most: int, cell_seconds: int = 3600) -> DataFrame:
    """The newest ``most`` of each host, by time and cursor.

    A histogram of each host's times in cells of ``cell_seconds`` tells in which cell the last of them is. Newer cells stay
    whole and older ones go; only the events of that one cell are ranked.
    """
    cell = F.floor(F.unix_micros("observed_at") / (cell_seconds * 1_000_000))
    counts = events.groupBy("host_id", cell.alias("cell")).agg(F.count("*").alias("n"))
    newer = F.sum("n").over(Window.partitionBy("host_id").orderBy(F.desc("cell")))
    edge = counts.withColumn("upto", newer).where(F.col("upto") >= most).groupBy("host_id").agg(
        F.max("cell").alias("edge"), F.min(F.col("upto")).alias("reached"), F.max_by("n", "cell").alias("in_edge")
    )
    edge = edge.select("host_id", "edge", (most - (F.col("reached") - F.col("in_edge"))).alias("room"))  # none: the host has fewer
    placed = events.withColumn("cell", cell).join(edge, "host_id", "left")
    whole = placed.where("edge is null or cell > edge").select(events.columns)
    w = Window.partitionBy("host_id", "cell").orderBy(F.desc("observed_at"), F.desc("cursor"))
    part = placed.where("cell = edge").withColumn("place", F.row_number().over(w)).where("place <= room").select(events.columns)
    return whole.unionByName(part)


def newest_snapshots(snapshots: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("host_id").orderBy(F.desc("snapshot_id"))
    return snapshots.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place")


def children_of(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Child rows of the snapshots that are left."""
    return rows.join(snapshots.select(*KEY), KEY, "left_semi")


def keep_incidents(incidents: DataFrame, cutoff) -> DataFrame:
    """Drops incidents resolved before the cutoff; active ones stay."""
    return incidents.where((F.col("state") != "resolved") | (F.col("resolved_at") >= F.lit(cutoff).cast("timestamp")))
