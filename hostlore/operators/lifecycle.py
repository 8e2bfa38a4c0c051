"""What changed between consecutive snapshots of a host: collection completeness, services, processes.

"Previous" always means the host's snapshot before, never the last row of the same service or process: each window
checks that the row it looks at has the neighbouring snapshot number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlore.functions.scalars import counter, valid_service_name, valid_state

USABLE = ("success", "partial")


def service_validity(services: DataFrame) -> DataFrame:
    """Adds ``valid``: the name has the right shape and the states are plain words."""
    return services.withColumn(
        "valid",
        valid_service_name(F.col("name")) & valid_state(F.col("load_state")) & valid_state(F.col("active_state")) & valid_state(F.col("sub_state")),
    )


def completeness(results: DataFrame, services: DataFrame) -> DataFrame:
    """(host_id, snapshot_id, collector_name, usable, complete). Services are complete only with every row valid."""
    invalid = service_validity(services).where("not valid").select(
        "host_id", "snapshot_id", F.lit("services").alias("collector_name"), F.lit(True).alias("bad")
    ).distinct()
    joined = results.join(invalid, ["host_id", "snapshot_id", "collector_name"], "left")
    return joined.select(
        "host_id",
        "snapshot_id",
        "collector_name",
        F.col("status").isin(*USABLE).alias("usable"),
        ((F.col("status") == "success") & F.col("bad").isNull()).alias("complete"),
    )


def duplicate_identities(rows: DataFrame, identity: str) -> DataFrame:
    """Identities that a snapshot has more than once."""
    return rows.where(F.col(identity).isNotNull()).groupBy("host_id", "snapshot_id", identity).count().where("count > 1")


def with_history(rows: DataFrame, snapshots: DataFrame, complete: DataFrame, collector: str, few_snapshots: bool = False) -> DataFrame:
    """Adds the snapshot's time and the completeness of it, of the one before and of the one after.

    Rows of a failed, unsupported or missing collection go: they make no claims, now or as the rows before. With
    ``few_snapshots``, the line of snapshots is broadcast. Else Spark may broadcast the rows, if it takes them to be few, and
    what follows is dealt by host as that line is, a host in one task.
    """
    own = complete.where(F.col("collector_name") == collector).select("host_id", "snapshot_id", "usable", "complete")
    w = Window.partitionBy("host_id").orderBy("snapshot_id")
    line = snapshots.join(own, ["host_id", "snapshot_id"], "left").select(
        "host_id", "snapshot_id", "observed_at", F.coalesce("complete", F.lit(False)).alias("complete"), F.coalesce("usable", F.lit(False)).alias("usable"),
        F.lag("snapshot_id").over(w).isNotNull().alias("has_previous"), F.coalesce(F.lag("complete").over(w), F.lit(False)).alias("previous_complete"),
        (F.col("monotonic_s") - F.lag("monotonic_s").over(w)).alias("elapsed"), F.lead("snapshot_id").over(w).alias("next_id"),
        F.coalesce(F.lead("complete").over(w), F.lit(False)).alias("next_complete"), F.lead("observed_at").over(w).alias("next_at"),
    )
    line = line.where("usable")
    return rows.join(F.broadcast(line) if few_snapshots else line, ["host_id", "snapshot_id"])


def adjacent(value: Column, window, back: bool = True) -> Column:
    """The value of the neighbouring row if it is of the neighbouring snapshot."""
    step = F.lag if back else F.lead
    return F.when(step("snapshot_id").over(window) == F.col("snapshot_id") + (-1 if back else 1), step(value).over(window))


def service_lifecycle(services: DataFrame, snapshots: DataFrame, results: DataFrame, few_snapshots: bool = False) -> DataFrame:
    """(host_id, snapshot_id, observed_at, name, lifecycle, previous, current) for every service of every snapshot.

    invalid: the row now or before is malformed. new and removed need both collections complete; a first snapshot
    or an incomplete one gives insufficient_history. Else continuing or state_changed by the three states.
    """
    state = F.struct("load_state", "active_state", "sub_state", "valid")
    w = Window.partitionBy("host_id", "name").orderBy("snapshot_id")
    rows = with_history(service_validity(services), snapshots, completeness(results, services), "services", few_snapshots).withColumn("current", state)
    rows = rows.withColumns({"previous": adjacent(F.col("current"), w), "stays": adjacent(F.lit(True), w, back=False)})
    same = F.col("previous.load_state").eqNullSafe(F.col("load_state")) & F.col(
        "previous.active_state"
    ).eqNullSafe(F.col("active_state")) & F.col("previous.sub_state").eqNullSafe(F.col("sub_state"))
    lifecycle = (
        F.when(~F.col("valid") | ~F.coalesce("previous.valid", F.lit(True)), "invalid").when(
            F.col("previous").isNull(),
            F.when(F.col("has_previous") & F.col("previous_complete") & F.col("complete"), "new").otherwise("insufficient_history"),
        ).when(same, "continuing").otherwise("state_changed")
    )
    now = rows.select("host_id", "snapshot_id", "observed_at", "name", lifecycle.alias("lifecycle"), "previous", "current")
    gone = rows.where("stays is null and next_id is not null and complete and next_complete")
    return now.unionByName(
        gone.select(
            "host_id",
            F.col("next_id").alias("snapshot_id"),
            F.col("next_at").alias("observed_at"),
            "name",
            F.lit("removed").alias("lifecycle"),
            F.col("current").alias("previous"),
            F.lit(None).cast(now.schema["current"].dataType).alias("current"),
        )
    )


def process_lifecycle(
    processes: DataFrame, snapshots: DataFrame, results: DataFrame, services: DataFrame, few_snapshots: bool = False
) -> DataFrame:
    """(host_id, snapshot_id, observed_at, pid, lifetime_id, lifecycle, cpu, rss_delta, vm_delta).

    A lifetime is pid and start time. A row without one is invalid (in a first snapshot insufficient_history); the
    lifetime of the snapshot before continues; a known pid with another lifetime is identity_changed; else new if the
    snapshot before was complete. A pid that is gone between two complete snapshots has exited.
    """
    by_life = Window.partitionBy("host_id", "lifetime_id").orderBy("snapshot_id")
    by_pid = Window.partitionBy("host_id", "pid").orderBy("snapshot_id")
    rows = with_history(processes, snapshots, completeness(results, services), "processes", few_snapshots)
    reading = F.struct("cpu_time_ticks", "rss_bytes", "virtual_memory_bytes")
    rows = rows.withColumn("prior", F.when(F.col("lifetime_id").isNotNull(), adjacent(reading, by_life)))
    rows = rows.withColumns({"pid_before": adjacent(F.col("lifetime_id"), by_pid), "stays": adjacent(F.lit(True), by_pid, back=False)})
    lifecycle = (
        F.when(~F.col("has_previous"), "insufficient_history").when(F.col("lifetime_id").isNull(), "invalid").when(F.col("prior").isNotNull(), "continuing")
        .when(F.col("pid_before").isNotNull(), "identity_changed").when(F.col("previous_complete"), "new").otherwise("insufficient_history")
    )
    goes_on = F.col("lifecycle") == "continuing"
    now = rows.withColumn("lifecycle", lifecycle).select(
        "host_id",
        "snapshot_id",
        "observed_at",
        "pid",
        "lifetime_id",
        "lifecycle",
        F.when(goes_on, counter(F.col("prior.cpu_time_ticks"), F.col("cpu_time_ticks"), F.col("elapsed"))).alias("cpu"),
        F.when(goes_on, F.col("rss_bytes") - F.col("prior.rss_bytes")).alias("rss_delta"),
        F.when(goes_on, F.col("virtual_memory_bytes") - F.col("prior.virtual_memory_bytes")).alias("vm_delta"),
    )
    gone = rows.where("stays is null and next_id is not null and complete and next_complete and lifetime_id is not null")
    none = {c: F.lit(None).cast(now.schema[c].dataType).alias(c) for c in ("cpu", "rss_delta", "vm_delta")}
    return now.unionByName(
        gone.select(
            "host_id",
            F.col("next_id").alias("snapshot_id"),
            F.col("next_at").alias("observed_at"),
            "pid",
            "lifetime_id",
            F.lit("exited").alias("lifecycle"),
            *none.values(),
        )
    )
