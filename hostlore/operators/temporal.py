"""Counter rates between consecutive snapshots of a host."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostlore.functions.scalars import counter, valid_elapsed
from hostlore.operators.lifecycle import adjacent

TICKS = [f"{x}_ticks" for x in ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal")]


def intervals(snapshots: DataFrame) -> DataFrame:
    """(host_id, snapshot_id, has_previous, elapsed): monotonic seconds since the host's snapshot before."""
    w = Window.partitionBy("host_id").orderBy("snapshot_id")
    return snapshots.select(
        "host_id",
        "snapshot_id",
        F.lag("snapshot_id").over(w).isNotNull().alias("has_previous"),
        (F.col("monotonic_s") - F.lag("monotonic_s").over(w)).alias("elapsed"),
        F.lead("snapshot_id").over(w).alias("next_id"),
    )


def counter_rates(rows: DataFrame, snapshots: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Each counter of each resource as struct(state, delta, rate); new_resource where the snapshot before lacks it."""
    w = Window.partitionBy("host_id", *keys).orderBy("snapshot_id")
    joined = rows.join(intervals(snapshots), ["host_id", "snapshot_id"])
    return joined.select(
        "host_id",
        "snapshot_id",
        *keys,
        *(counter(adjacent(F.col(c), w), F.col(c), F.col("elapsed"), F.col("has_previous")).alias(c) for c in counters),
    )


def removed(rows: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """Resources of the snapshot before that a snapshot lacks."""
    w = Window.partitionBy("host_id", key).orderBy("snapshot_id")
    marked = rows.where(F.col(key).isNotNull()).join(intervals(snapshots), ["host_id", "snapshot_id"]).withColumn("stays", adjacent(F.lit(True), w, back=False))
    return marked.where("stays is null and next_id is not null").select("host_id", F.col("next_id").alias("snapshot_id"), key)


def cpu_utilisation(cpu: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(state, total, busy, utilisation, busy_rate): any falling counter is a reset; busy is all but idle and iowait."""
    w = Window.partitionBy("host_id").orderBy("snapshot_id")
    rows = cpu.join(intervals(snapshots), ["host_id", "snapshot_id"]).withColumn("before", adjacent(F.struct(*TICKS), w))
    delta = {t: F.col(t) - F.col(f"before.{t}") for t in TICKS}
    total = sum((delta[t] for t in TICKS[1:]), delta[TICKS[0]])
    busy = total - (delta["idle_ticks"] + delta["iowait_ticks"])
    some = lambda test: F.exists(F.array(*(test(F.col(t), F.col(f"before.{t}")) for t in TICKS)), lambda x: x)
    rows = rows.withColumns({"total": total, "busy": busy})
    state = (
        F.when(F.col("before").isNull(), "no_previous").when(
            ~valid_elapsed(F.col("elapsed")), "invalid_interval"
        ).when(some(lambda a, b: (a < 0) | (b < 0)), "invalid_data").when(some(lambda a, b: a < b), "counter_reset").when(
            (F.col("total") <= 0) | (F.col("busy") < 0) | (F.col("busy") > F.col("total")), "invalid_data"
        ).otherwise("valid")
    )
    ok = lambda c: F.when(F.col("state") == "valid", c)
    return rows.withColumn("state", state).select(
        "host_id",
        "snapshot_id",
        "state",
        ok(F.col("total")).alias("total"),
        ok(F.col("busy")).alias("busy"),
        ok(F.col("busy") / F.col("total")).alias("utilisation"),
        ok(F.col("busy") / F.col("elapsed")).alias("busy_rate"),
    )


def process_cpu_rates(processes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """CPU time of each lifetime. No lifetime, or a pid seen before under another, is identity_mismatch."""
    by_life = Window.partitionBy("host_id", "lifetime_id").orderBy("snapshot_id")
    by_pid = Window.partitionBy("host_id", "pid").orderBy("snapshot_id")
    rows = processes.join(intervals(snapshots), ["host_id", "snapshot_id"])
    reading = F.struct(F.col("cpu_time_ticks"))
    rows = rows.withColumns(
        {
            "prior": F.when(F.col("lifetime_id").isNotNull(), adjacent(reading, by_life)),
            "pid_seen": F.coalesce(adjacent(F.lit(True), by_pid), F.lit(False)),
        }
    )
    plain = counter(F.col("prior.cpu_time_ticks"), F.col("cpu_time_ticks"), F.col("elapsed"))
    state = F.when(~F.col("has_previous"), "no_previous").when(
        F.col("lifetime_id").isNull(), "identity_mismatch"
    ).when(F.col("prior").isNotNull(), plain["state"]).when(F.col("pid_seen"), "identity_mismatch").otherwise("new_resource")
    return rows.withColumns({"state": state, "plain": plain}).select(
        "host_id",
        "snapshot_id",
        "pid",
        "lifetime_id",
        "state",
        F.when(F.col("state") == "valid", F.col("plain.delta")).alias("delta"),
        F.when(F.col("state") == "valid", F.col("plain.rate")).alias("rate"),
    )


def snapshot_comparison(cpu: DataFrame, network: DataFrame, processes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row per snapshot: CPU, interfaces and lifetimes compared with the snapshot before, and what is gone."""
    rates = counter_rates(network, snapshots, ["interface"], ["receive_bytes", "transmit_bytes"])
    key = ["host_id", "snapshot_id"]
    gather = lambda df, name, *cols: df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    out = snapshots.select(*key).join(cpu_utilisation(cpu, snapshots).withColumnRenamed("state", "cpu_state"), key, "left")
    for df, name, cols in (
        (rates, "network", ("interface", "receive_bytes", "transmit_bytes")),
        (removed(network, snapshots, "interface"), "removed_interfaces", ("interface",)),
        (process_cpu_rates(processes, snapshots), "processes", ("pid", "lifetime_id", "state", "delta", "rate")),
        (removed(processes, snapshots, "lifetime_id"), "removed_lifetimes", ("lifetime_id",)),
    ):
        out = out.join(gather(df, name, *cols), key, "left")
    return out
