"""Whole cycles over a stream of captures, with state that no batch can lose.

*Versions.* Each batch stages its tables under its own number and then commits one manifest that names the version of every
state table. A batch reads what the last committed manifest names. What it doesn't change, it names again; so an empty batch
only repeats the names, and a batch that failed half way was never there. A batch that is played again after its commit does
nothing.

*Sequence.* ``baseline`` has the last snapshot of each host. Snapshots at or below it, and second copies within a batch, go to
``skipped`` with a reason and open, change and resolve nothing. Their events count all the same, as cursors tell which of
them are new.

*Late evidence.* Anchors near new events are correlated again, and their candidates merge under the same ids. Where a merge is
refused (evidence after a resolution, other content under an id), the stored incident and its evidence stay as they were,
and the refused candidate is listed in ``conflicts`` with its batch. Incidents that were archived are found again by
the day of their start.
"""

from __future__ import annotations

import threading
from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import DateType, LongType, StructField, StructType

from hostlore.operators import correlate, lifecycle, reconcile, reports
from hostlore.sources.publish import Manifests
from hostlore.streaming.streams import CAPTURE, INCIDENTS, PARTS

KEY = ["host_id", "snapshot_id"]
SUBJECT = ["host_id", "incident_id"]
EVIDENCE = (
    "host_id string, incident_id string, kind string, evidence_id string, evidence_at timestamp, reason string, summary string, fact string, "
    "evidence_limitations array<string>, truncated boolean"
)
CONFLICTS = "host_id string, incident_id string, problem string, offered_at timestamp"
SKIPPED = "host_id string, snapshot_id long, reason string"


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    """A table without rows that the optimiser knows to be one, so what is joined to it costs nothing."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields)).limit(0)


#: Spark judges what to broadcast by the size of files, and takes a list to have one item. Unpacked on the driver, the tables of
#: a cycle have many times that.
NO_GUESSED_BROADCASTS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def without_guessed_broadcasts(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark``, which stays as it is, in which only what the code names is broadcast."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in NO_GUESSED_BROADCASTS.items():
        own.conf.set(key, value)
    return own


class Folder:
    """State tables by version, and logs by day and batch, under one path.

    They are read in a session of its own, so of what is joined to them nothing goes through the driver but lines of snapshots.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.manifests = without_guessed_broadcasts(spark), path, Manifests(spark, path)

    def versions(self, before: int | None = None) -> dict[str, int]:
        found = self.manifests.last(before)
        return dict(found[1]["tables"]) if found else {}

    def store(self, rows: DataFrame, name: str, number: int) -> DataFrame:
        path = f"{self.path}/{name}/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def state(self, name: str, versions: dict[str, int], schema: str) -> DataFrame:
        """A state table as a manifest names it; empty before its first version."""
        if name not in versions:
            return empty(self.spark, schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/batch={versions[name]}")

    def every(self, name: str, schema: str, upto: int | None) -> DataFrame:
        """All committed batches of a table, with their ``batch``."""
        kind = StructType([*StructType.fromDDL(schema).fields, StructField("batch", LongType())])
        fs, place = self.there(name)
        if upto is None or not fs.exists(place):
            return empty(self.spark, kind)
        return self.spark.read.schema(kind).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}").where(F.col("batch") <= upto)

    def there(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def log(self, rows: DataFrame, name: str, number: int, time: str) -> None:
        """Appends rows under the day of ``time`` and the batch; a replay replaces its own."""
        dated = rows.withColumns({"day": F.to_date(time), "batch": F.lit(number).cast("long")})
        dated.write.partitionBy("day", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/{name}")

    def days(self, name: str, schema: StructType | str, number: int, days: Iterable[date]) -> DataFrame:
        """Logged rows of these days, of batches up to ``number``; only the folders of these days are listed."""
        own = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        kind = StructType([*own.fields, StructField("day", DateType()), StructField("batch", LongType())])
        found = []
        for day in sorted(set(days)):
            fs, place = self.there(f"{name}/day={day.isoformat()}")
            if fs.exists(place):
                found.append(f"{self.path}/{name}/day={day.isoformat()}")
        if not found:
            return empty(self.spark, kind)
        return self.spark.read.schema(kind).option("basePath", f"{self.path}/{name}").parquet(*found).where(F.col("batch") <= number)


class EvidenceState:
    """Stored evidence alone: each micro-batch of evidence rows merges into at most ``most`` rows of an incident.

    A batch reads the state and itself, nothing of earlier days. Conflicts are listed with their batch.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = reconcile.MAX_EVIDENCE):
        self.folder, self.most = Folder(spark, path), most

    def run(self, batch: DataFrame, number: int) -> None:
        folder = self.folder
        if folder.manifests.read(number) is not None:
            return
        versions = folder.versions(number)
        if not batch.isEmpty():
            merged, differing = reconcile.merge_stored_evidence(folder.state("evidence", versions, EVIDENCE), batch, self.most)
            folder.store(merged.select(StructType.fromDDL(EVIDENCE).fieldNames()), "evidence", number)
            folder.store(differing, "differing", number)
            versions["evidence"] = number
        folder.manifests.commit(number, {"tables": versions})

    def go(self, rows: DataFrame) -> None:
        """All that is there now; a later call goes on."""
        checkpoint = f"{self.folder.path}/checkpoint"
        rows.writeStream.foreachBatch(self.run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def evidence(self) -> DataFrame:
        return self.folder.state("evidence", self.folder.versions(), EVIDENCE)

    def differing(self) -> DataFrame:
        found = self.folder.manifests.last()
        return self.folder.every("differing", "host_id string, incident_id string, kind string, evidence_id string, problem string", found and found[0])


class Counted(StreamingQueryListener):
    """Tells when a query has committed ``most`` batches. A batch that failed reports progress too, so manifests are asked."""

    def __init__(self, most: int, manifests: Manifests):
        self.most, self.manifests, self.seen, self.run_id, self.reached = most, manifests, set(), None, threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if str(event.progress.runId) == self.run_id and self.manifests.read(event.progress.batchId) is not None:
            self.seen.add(event.progress.batchId)
            if len(self.seen) >= self.most:
                self.reached.set()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def in_sequence(batch: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures after each host's last snapshot, once each, and (host_id, snapshot_id, reason) of the others."""
    content = F.xxhash64(F.to_json(F.struct(*batch.columns)))
    copy = F.row_number().over(Window.partitionBy(*KEY).orderBy("observed_at", content))
    floor = baseline.select("host_id", F.col("snapshot_id").alias("floor"))  # one row a host
    rows = batch.withColumn("copy", copy).join(F.broadcast(floor), "host_id", "left")
    reason = F.when((F.col("copy") > 1) | (F.col("snapshot_id") == F.col("floor")), "repeated").when(F.col("snapshot_id") < F.col("floor"), "out_of_order")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").select(batch.columns), rows.where("reason is not null").select(*KEY, "reason")


def ends(events: DataFrame, window_us: int) -> DataFrame:
    """(host_id, name, t): the first and the last event of a unit in each slot as wide as the window.

    An anchor that has an event within the window has one of these there too, and they are few for a busy unit.
    """
    t = F.unix_micros("observed_at")
    slot = F.floor(t / max(window_us, 1)).alias("slot")
    found = events.groupBy("host_id", F.col("unit").alias("name"), slot).agg(F.min(t).alias("first"), F.max(t).alias("last"))
    return found.select("host_id", "name", F.explode(F.array("first", "last")).alias("t"))


class FleetCycles:
    """The whole cycle for each micro-batch of captures: append events, compare, correlate, reconcile, report.

    ``kept_days``: resolved incidents stay in the state that long, then they go to the archive. ``most``: evidence that a
    candidate has at most; a stored incident has ``reconcile.MAX_EVIDENCE``.
    """

    def __init__(self, spark: SparkSession, path: str, associations: DataFrame, window_seconds: int, most: int = 32, kept_days: int = 30):
        self.spark, self.path, self.associations = spark, path, associations
        self.window, self.most, self.kept_days = window_seconds, most, kept_days
        self.folder = Folder(spark, path)

    def run(self, batch: DataFrame, number: int) -> None:
        """One batch. ``number`` is the batch's in the stream; one that is committed is done."""
        folder = self.folder
        if folder.manifests.read(number) is not None:
            return
        versions = folder.versions(number)
        if not batch.isEmpty():
            versions |= dict.fromkeys(self.cycle(batch, number, versions), number)
        folder.manifests.commit(number, {"tables": versions})

    def cycle(self, batch: DataFrame, number: int, versions: dict[str, int]) -> list[str]:
        """Stages all tables of a batch and names those that have a new version."""
        folder, part = self.folder, lambda rows, name: rows.select(*KEY, F.inline(name))
        base = folder.state("baseline", versions, CAPTURE)
        fresh, skipped = in_sequence(batch, base)
        fresh = folder.store(fresh, "accepted", number)
        folder.store(skipped, "skipped", number)
        both = fresh.unionByName(base)
        last = Window.partitionBy("host_id").orderBy(F.desc("snapshot_id"))
        newest = both.withColumn("place", F.row_number().over(last)).where("place = 1").drop("place")
        folder.store(newest.withColumn("events", F.lit(None).cast(PARTS["events"])), "baseline", number)

        snapshots, results = both.select(*KEY, "observed_at", "monotonic_s"), part(both, "results")
        services, processes = part(both, "services"), part(both, "processes")
        mine = F.broadcast(fresh.select(*KEY))
        incoming = part(batch, "events").dropDuplicates(["host_id", "cursor"])
        touched = fresh.select("observed_at").unionByName(incoming.select("observed_at")).select(F.to_date("observed_at").alias("d")).distinct()
        reach = 1 + self.window // 86_400
        days = {r["d"] + timedelta(days=k) for r in touched.collect() if r["d"] for k in range(-reach, reach + 1)}

        known = folder.days("events", incoming.schema, number - 1, days).select("host_id", "cursor")
        # the batch is of the stream's session, so the hint says what the folder's session would
        news = folder.store(incoming.join(known.hint("merge"), ["host_id", "cursor"], "left_anti"), "news", number)
        folder.log(news, "events", number, "observed_at")

        changes = lifecycle.service_lifecycle(services, snapshots, results, few_snapshots=True).join(mine, KEY, "left_semi")
        changes = correlate.quality_aware(changes, F.broadcast(results), "services")
        changes = folder.store(changes, "changes", number)
        process_changes = lifecycle.process_lifecycle(processes, snapshots, results, services, few_snapshots=True).join(mine, KEY, "left_semi")
        process_changes = correlate.quality_aware(process_changes.select(*KEY, "observed_at", "pid", "lifetime_id", "lifecycle"), F.broadcast(results), "processes")
        folder.log(process_changes, "process_changes", number, "observed_at")
        anchors = correlate.incident_anchors(changes)
        folder.log(anchors, "anchors", number, "observed_at")
        journal = results.join(mine, KEY, "left_semi").where("collector_name = 'journal'").select("host_id", F.col("collected_at").alias("at"), "status")
        folder.log(journal, "journal", number, "at")

        window = self.window * 1_000_000
        near_anchors = folder.days("anchors", anchors.schema, number, days).select(anchors.columns)
        place = ["host_id", "name", "observed_at"]
        stored = folder.days("anchors", anchors.schema, number - 1, days).select(*place, F.unix_micros("observed_at").alias("t"))
        late = correlate.near(stored, ends(news, window), ["host_id", "name"], window)
        asked = near_anchors.join(late.select(*place).unionByName(anchors.select(*place)).distinct(), place, "left_semi")
        asked = folder.store(correlate.anchored(asked), "asked", number)
        evidence = correlate.correlate_anchors(
            asked,
            folder.days("process_changes", process_changes.schema, number, days).select(process_changes.columns),
            folder.days("events", incoming.schema, number, days).select(incoming.columns),
            self.associations,
            window,
            self.most,
        )
        evidence = folder.store(evidence, "offered", number)
        candidates = correlate.candidates(evidence, F.broadcast(folder.days("journal", journal.schema, number, days).select(journal.columns)))
        candidates = folder.store(candidates, "candidates", number)
        self.reconciled(number, versions, days, batch, fresh, both, changes, candidates, evidence)
        return ["baseline", "incidents", "evidence"]

    def archived(self, name: str, schema: str, number: int, days: Iterable[date], keys: list[str]) -> DataFrame:
        """The newest version of archived rows that started on these days."""
        rows = self.folder.days(name, schema, number, days)
        newest = rows.groupBy(*SUBJECT).agg(F.max("batch").alias("batch"))
        return rows.join(newest, [*SUBJECT, "batch"], "left_semi").dropDuplicates(keys).select([f.name for f in StructType.fromDDL(schema)])

    def reconciled(
        self,
        number: int,
        versions: dict[str, int],
        days: set[date],
        batch: DataFrame,
        fresh: DataFrame,
        both: DataFrame,
        changes: DataFrame,
        candidates: DataFrame,
        evidence: DataFrame,
    ) -> None:
        """Merges candidates and their evidence into the stored ones, resolves, archives, and reports the cycles."""
        folder, part = self.folder, lambda rows, name: rows.select(*KEY, F.inline(name))
        mine, results, snapshots = F.broadcast(fresh.select(*KEY)), part(both, "results"), both.select(*KEY, "observed_at", "monotonic_s")
        ids = candidates.select(*SUBJECT).distinct()
        old, old_evidence = folder.state("incidents", versions, INCIDENTS), folder.state("evidence", versions, EVIDENCE)
        back = self.archived("archive", INCIDENTS, number - 1, days, SUBJECT).join(ids, SUBJECT, "left_semi").join(old, SUBJECT, "left_anti")
        back_evidence = self.archived("archived_evidence", EVIDENCE, number - 1, days, [*SUBJECT, "kind", "evidence_id"]).join(back, SUBJECT, "left_semi")
        merged, refused = reconcile.upsert(old.unionByName(back), candidates)
        refused = folder.store(refused, "refused", number)
        taken = evidence.join(refused, SUBJECT, "left_anti").select(*SUBJECT, *correlate.EVIDENCE)
        stored, differing = reconcile.merge_stored_evidence(old_evidence.unionByName(back_evidence), taken)
        stored = folder.store(stored, "merged_evidence", number)
        full = stored.where("truncated").select(*SUBJECT, F.lit(True).alias("full")).distinct()
        merged = merged.join(full, SUBJECT, "left").withColumn("limitations", reconcile.with_limit_mark(F.col("limitations"), F.col("full"))).drop("full")

        ok = results.where("collector_name = 'services' and status = 'success'").select(*KEY, F.col("collected_at").alias("resolved_time"))
        recoveries = correlate.resolution_subjects(changes).join(F.broadcast(ok), KEY)
        starts = mine.join(snapshots, KEY).select("host_id", F.col("observed_at").alias("started_at"))
        own = candidates.join(F.broadcast(starts), ["host_id", "started_at"], "left_semi")
        done, early = reconcile.resolve_over_time(merged, recoveries, own)
        done = folder.store(done, "reconciled", number)
        columns = StructType.fromDDL(CONFLICTS).fieldNames()
        conflicts = refused.unionByName(early, allowMissingColumns=True).unionByName(differing, allowMissingColumns=True)
        folder.store(conflicts.select(columns), "conflicts", number)

        newest = batch.agg(F.max("observed_at")).first()[0]
        horizon = F.lit(newest - timedelta(days=self.kept_days)) if newest else F.lit(None).cast("timestamp")
        marked = done.withColumn("gone", F.coalesce(F.col("resolved_at") < horizon, F.lit(False)))
        columns = StructType.fromDDL(INCIDENTS).fieldNames()
        folder.store(marked.where("not gone").select(columns), "incidents", number)
        gone = marked.where("gone")
        folder.log(gone.select(columns), "archive", number, "started_at")
        with_start = stored.join(gone.select(*SUBJECT, "started_at"), SUBJECT)
        folder.log(with_start, "archived_evidence", number, "started_at")
        folder.store(stored.join(gone, SUBJECT, "left_anti"), "evidence", number)

        counts = {"services": part(fresh, "services"), "processes": part(fresh, "processes")}
        found = own.select(*SUBJECT, F.col("started_at").alias("at"))
        resolved = done.where("now_resolved").select(*SUBJECT, F.col("resolved_at").alias("at"))
        cycles = reports.cycle_summary(snapshots.join(mine, KEY, "left_semi"), results, counts, part(batch, "events"), found, resolved, refused=refused)
        folder.store(cycles, "cycles", number)

    def start(self, captures: DataFrame, **trigger: object) -> StreamingQuery:
        """Starts the cycles as a streaming query; ``availableNow`` unless a trigger is given."""
        writer = captures.writeStream.foreachBatch(self.run).option("checkpointLocation", f"{self.path}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def go(self, captures: DataFrame, batches: int | None = None) -> None:
        """All that is there now, or until ``batches`` micro-batches are committed. A later call goes on where this one ended.

        The query is stopped from outside once it has reported that many commits. A batch that has begun by then is ended,
        and is either committed too or comes again and is left alone, as its manifest is there.
        """
        if batches is None:
            self.start(captures).awaitTermination()
            return
        counted = Counted(batches, self.folder.manifests)
        self.spark.streams.addListener(counted)
        try:
            query = self.start(captures)
            counted.run_id = str(query.runId)
            while query.isActive and not counted.reached.wait(0.05):
                pass
            if counted.reached.is_set():
                query.stop()
            else:
                query.awaitTermination()  # all is done, or what went wrong is raised
        finally:
            self.spark.streams.removeListener(counted)

    def last(self) -> tuple[int | None, dict[str, int]]:
        found = self.folder.manifests.last()
        return (found[0], dict(found[1]["tables"])) if found else (None, {})

    def incidents(self) -> DataFrame:
        """Incidents after the last committed batch, those of the archive included."""
        number, versions = self.last()
        now = self.folder.state("incidents", versions, INCIDENTS)
        return now.unionByName(self.whole_archive("archive", INCIDENTS, number, SUBJECT).join(now, SUBJECT, "left_anti"))

    def evidence(self) -> DataFrame:
        """The stored evidence of these incidents."""
        number, versions = self.last()
        now = self.folder.state("evidence", versions, EVIDENCE)
        old = self.whole_archive("archived_evidence", EVIDENCE, number, [*SUBJECT, "kind", "evidence_id"])
        return now.unionByName(old.join(self.folder.state("incidents", versions, INCIDENTS), SUBJECT, "left_anti"))

    def whole_archive(self, name: str, schema: str, number: int | None, keys: list[str]) -> DataFrame:
        rows = self.folder.every(name, f"{schema}, day date", number)
        newest = rows.groupBy(*SUBJECT).agg(F.max("batch").alias("batch"))
        return rows.join(newest, [*SUBJECT, "batch"], "left_semi").dropDuplicates(keys).select([f.name for f in StructType.fromDDL(schema)])

    def conflicts(self) -> DataFrame:
        """Refused merges, each with its batch."""
        return self.folder.every("conflicts", CONFLICTS, self.last()[0])

    def skipped(self) -> DataFrame:
        """Snapshots that came again or too late, each with its batch."""
        return self.folder.every("skipped", SKIPPED, self.last()[0])

    def cycles(self) -> DataFrame:
        number, _ = self.last()
        return self.spark.read.parquet(f"{self.path}/cycles").where(F.col("batch") <= number).drop("batch")
