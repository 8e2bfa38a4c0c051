"""Whole cycles under awkward arrivals: late, repeated, out of order, empty, failed half way, and stopped."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hostlore.operators import lifecycle, reconcile
from hostlore.sources import publish
from hostlore.streaming import cycles, streams

T0 = datetime(2024, 1, 1)
WINDOW = 6 * 3600


def at(n, hours=0):
    return T0 + timedelta(days=n, hours=hours)


def capture(n, state, events=(), host="h", status="success"):
    """A snapshot with the one service a.service."""
    results = [("services", status, at(n)), ("processes", "success", at(n)), ("journal", "success", at(n))]
    return (host, n, at(n), 60.0 * n, results, [("a.service", "loaded", state, "x")], [], list(events))


def event(cursor, when):
    return (cursor, when, "a.service", 3)


class Fleet:
    """Batches run one after another by hand, as ``foreachBatch`` calls them."""

    def __init__(self, spark, path, **options):
        links = spark.createDataFrame([], "host_id string, service_name string, lifetime_id string")
        self.spark, self.fleet, self.number = spark, cycles.FleetCycles(spark, str(path), links, WINDOW, **options), 0

    def batch(self, *rows):
        self.fleet.run(self.spark.createDataFrame(list(rows), streams.CAPTURE), self.number)
        self.number += 1
        return self

    def seen(self):
        rows = self.fleet.incidents().orderBy("host_id", "started_at").collect()
        evidence = sorted(r.evidence_id for r in self.fleet.evidence().collect() if r.kind == "journal_event")
        return [(r.state, r.started_at, r.last_observed_at, r.resolved_at) for r in rows], evidence


def test_state_survives_awkward_arrivals(spark, tmp_path, monkeypatch):
    """Each step leaves the state as it should be; a step that should change nothing is held against what was before."""
    soon = lambda n, state, hours, events=(): (
        "h", n, at(2, hours), 60.0 * n, [(c, "success", at(2, hours)) for c in ("services", "processes", "journal")],
        [("a.service", "loaded", state, "x")], [], list(events),
    )
    fleet = Fleet(spark, tmp_path).batch()  # the first batch is empty
    assert fleet.seen() == ([], [])
    failed = soon(2, "failed", 0, [event("c1", at(2, -1))])
    fleet.batch(soon(1, "active", -2), failed, capture(5, "active", host="g"))
    assert fleet.seen() == ([("active", at(2), at(2), None)], ["journal:c1"])

    fleet.batch()  # nothing is written again, the names of the versions are carried over
    assert fleet.seen() == ([("active", at(2), at(2), None)], ["journal:c1"])
    assert fleet.fleet.last() == (2, {"baseline": 1, "incidents": 1, "evidence": 1})

    late = soon(1, "active", -2, [event("c2", at(2, 1)), event("c1", at(2, -1))])
    fleet.batch(failed, failed, late, capture(4, "failed", host="g"))  # repeated twice, out of order twice
    assert fleet.seen() == ([("active", at(2), at(2, 1), None)], ["journal:c1", "journal:c2"])  # its new event counts all the same
    skipped = sorted((r.host_id, r.snapshot_id, r.reason, r.batch) for r in fleet.fleet.skipped().collect())
    assert skipped == [("g", 4, "out_of_order", 3), ("h", 1, "out_of_order", 3), ("h", 2, "repeated", 3), ("h", 2, "repeated", 3)]

    fleet.batch(soon(3, "active", 2))
    settled = fleet.seen()
    assert settled == ([("resolved", at(2), at(2, 2), at(2, 2))], ["journal:c1", "journal:c2"])
    fleet.number -= 1
    assert fleet.batch(soon(3, "failed", 2)).seen() == settled  # a committed batch is not done twice

    after = soon(4, "active", 5, [event("c3", at(2, 3))])  # in the window of the incident, but after its resolution
    whole = cycles.Folder.store

    def breaks(self, rows, name, number):
        if name == "incidents":
            raise OSError("disk full")
        return whole(self, rows, name, number)

    monkeypatch.setattr(cycles.Folder, "store", breaks)
    with pytest.raises(OSError):
        fleet.batch(after)
    monkeypatch.undo()
    assert fleet.seen() == settled and fleet.fleet.conflicts().count() == 0  # what failed half way was never there
    assert fleet.batch(after).seen() == settled  # refused: the incident and its evidence stay as they were
    (conflict,) = fleet.fleet.conflicts().collect()
    assert (conflict.problem, conflict.offered_at, conflict.batch) == ("evidence_after_resolution", at(2, 3), 5)
    cycle = {(r.host_id, r.snapshot_id): (r.candidate_ids, r.reconciled_ids, len(r.resolved_ids)) for r in fleet.fleet.cycles().collect()}
    assert cycle["h", 4] == ([], [], 0) and cycle["h", 3] == ([], [], 1) and cycle["h", 2][0] == cycle["h", 2][1] != []


def test_late_evidence_of_an_archived_incident(spark, tmp_path):
    fleet = Fleet(spark, tmp_path, kept_days=5)
    fleet.batch(capture(1, "active"), capture(2, "failed", [event("c1", at(2, -1))]), capture(3, "active"), capture(20, "active"))
    archived = [("resolved", at(2), at(3), at(3))]
    assert fleet.fleet.folder.state("incidents", fleet.fleet.last()[1], streams.INCIDENTS).count() == 0
    assert fleet.seen() == (archived, ["journal:c1"])
    fleet.batch(capture(21, "active", [event("c2", at(2, 1))]))
    assert fleet.seen() == (archived, ["journal:c1", "journal:c2"])  # no second incident, none opens again


def streamed(spark, path):
    return spark.readStream.schema(streams.CAPTURE).option("maxFilesPerTrigger", 1).parquet(path)


def test_stops_after_some_batches_and_goes_on(spark, tmp_path, monkeypatch):
    source, ran = str(tmp_path / "in"), []
    monkeypatch.setattr(cycles.FleetCycles, "cycle", lambda self, batch, number, versions: ran.append(number) or ["baseline"])
    for n in range(6):
        spark.createDataFrame([capture(n, "active")], streams.CAPTURE).coalesce(1).write.mode("append").parquet(source)
    links = spark.createDataFrame([], "host_id string, service_name string, lifetime_id string")
    fleet = cycles.FleetCycles(spark, str(tmp_path / "out"), links, WINDOW)
    fleet.go(streamed(spark, source), batches=2)
    assert fleet.last()[0] in (1, 2, 3)  # the next may have begun
    fleet.go(streamed(spark, source))
    assert fleet.last() == (5, {"baseline": 5}) and ran == list(range(6))


def test_a_real_error_is_raised(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "in")
    spark.createDataFrame([capture(1, "active")], streams.CAPTURE).coalesce(1).write.parquet(source)
    links = spark.createDataFrame([], "host_id string, service_name string, lifetime_id string")
    monkeypatch.setattr(cycles, "in_sequence", lambda *_: 1 / 0)
    from pyspark.errors import StreamingQueryException

    with pytest.raises(StreamingQueryException, match="ZeroDivisionError"):
        cycles.FleetCycles(spark, str(tmp_path / "out"), links, WINDOW).go(streamed(spark, source), batches=1)


# publishing
def test_a_failure_between_two_tables_shows_neither(spark, tmp_path):
    path, frame = str(tmp_path), lambda *x: spark.createDataFrame([(v,) for v in x], "v long")
    assert publish.published(spark, path) == {}

    def fails(name):
        if name == "first":
            raise OSError("disk full")

    with pytest.raises(OSError):
        publish.publish(path, {"first": frame(1), "second": frame(2)}, staged=fails)
    assert publish.published(spark, path) == {}
    assert publish.publish(path, {"first": frame(1), "second": frame(2)}) == 0
    with pytest.raises(OSError):
        publish.publish(path, {"first": frame(3), "second": frame(4)}, expected=0, staged=fails)
    assert {n: [r.v for r in df.collect()] for n, df in publish.published(spark, path).items()} == {"first": [1], "second": [2]}


def test_versions_are_compared_and_set(spark, tmp_path):
    path, frame = str(tmp_path), spark.createDataFrame([(1,)], "v long")
    assert publish.publish(path, {"t": frame}) == 0
    for stale in (None, 3):
        with pytest.raises(publish.Conflict):
            publish.publish(path, {"t": frame}, expected=stale)
    assert publish.publish(path, {"t": frame.where("v > 1")}, expected=0) == 1
    assert publish.publish(path, {"t": frame}, expected=-1) == 2
    with pytest.raises(publish.Conflict):
        publish.Manifests(spark, path).commit(2, {})
    assert [publish.published(spark, path, v)["t"].count() for v in (0, 1, 2)] == [1, 0, 1]


# evidence as state
EVIDENCE = (
    "host_id string, incident_id string, kind string, evidence_id string, evidence_at timestamp, reason string, summary string, fact string, "
    "evidence_limitations array<string>"
)


def piece(i, n, fact="journal_unit_event", summary="s", limits=()):
    reason = "service_change_anchor" if n == 0 else "service_unit_match"
    return ("h", i, "service_change" if n == 0 else "journal_event", f"e{n:03}", T0 + timedelta(minutes=n % 50), reason, summary, fact, list(limits))


def test_merging_in_parts_equals_merging_at_once(spark):
    import random

    rng = random.Random(2)
    parts = [[piece(i, 0) for i in "ab"]]
    for _ in range(4):
        parts.append([piece(rng.choice("ab"), rng.randint(1, 90), rng.choice(["unknown", "journal_unit_event"]), limits=[rng.choice("xy")]) for _ in range(40)])
    frame = lambda rows: spark.createDataFrame(rows, EVIDENCE)
    state = spark.createDataFrame([], cycles.EVIDENCE)
    for part in parts:
        state, conflicts = reconcile.merge_stored_evidence(state, frame(part), most=9)
        state = spark.createDataFrame(state.collect(), state.schema)
        assert conflicts.count() == 0
    whole, _ = reconcile.merge_evidence(frame([]), frame([r for p in parts for r in p]))
    whole = reconcile.cap_evidence(whole, 9)
    names = ["incident_id", "evidence_id", "truncated"]
    assert sorted(map(tuple, state.select(names).collect())) == sorted(map(tuple, whole.select(names).collect()))
    assert state.where("reason = 'service_change_anchor'").count() == 2 and state.count() == 18


def test_differing_evidence_keeps_the_stored(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), EVIDENCE)
    old = frame(piece("a", 1, "unknown"), piece("a", 2, "x"))
    clean, bad = reconcile.merge_evidence(old, frame(piece("a", 1, "known"), piece("a", 2, "y"), piece("a", 3), piece("a", 3, summary="t"), piece("a", 4)))
    assert sorted((r.evidence_id, r.fact) for r in clean.collect()) == [("e001", "known"), ("e002", "x"), ("e004", "journal_unit_event")]
    assert sorted((r.evidence_id, r.problem) for r in bad.collect()) == [("e002", "facts_differ"), ("e003", "content_differs")]


def test_a_full_incident_says_so(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(["b"], True), (["b"], False), (None, None)], "limitations array<string>, full boolean")
    got = [r[0] for r in rows.select(reconcile.with_limit_mark(F.col("limitations"), F.col("full"))).collect()]
    assert got == [["b", "evidence_storage_limit_reached"], ["b"], []]


def test_services_of_a_host_are_compared_in_several_tasks(spark, tmp_path):
    """Captures are few rows with long lists, which Spark takes to be small enough to broadcast when they are taken apart."""
    result, service = (streams.PARTS[k] for k in ("results", "services"))
    rows = spark.range(4).selectExpr(
        "'h' AS host_id", "id AS snapshot_id", "timestamp_seconds(id) AS observed_at", "1D * id AS monotonic_s",
        f"CAST(array(named_struct('a', 'services', 'b', 'success', 'c', timestamp_seconds(id))) AS {result}) AS results",
        f"CAST(transform(sequence(1, 50), x -> named_struct('a', x || '.service', 'b', 'loaded', 'c', 'active', 'd', 'on')) AS {service}) AS services",
    )
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    part = {k: rows.select("host_id", "snapshot_id", F.inline(k)) for k in ("results", "services")}
    found = lifecycle.service_lifecycle(part["services"], rows.select("host_id", "snapshot_id", "observed_at", "monotonic_s"), part["results"], True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and re.search(r"hashpartitioning\(host_id#\d+, name#", plan)
    assert found.count() == 200


def test_a_cycle_broadcasts_lines_of_snapshots_alone(spark, tmp_path, monkeypatch):
    """The driver holds what is broadcast, so nothing that grows with services, processes, events, incidents or evidence is."""
    plans, store, log = [], cycles.Folder.store, cycles.Folder.log
    told = lambda rows: plans.append(rows._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(cycles.Folder, "store", lambda self, rows, *a: told(rows) or store(self, rows, *a))
    monkeypatch.setattr(cycles.Folder, "log", lambda self, rows, *a: told(rows) or log(self, rows, *a))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    fleet = Fleet(spark, tmp_path).batch(capture(1, "active"), capture(2, "failed", [event("c1", at(2, -1))]))
    fleet.batch(capture(3, "active", [event("c1", at(2, -1)), event("c2", at(2, 1))]))
    assert fleet.seen() == ([("resolved", at(2), at(3), at(3))], ["journal:c1", "journal:c2"])
    told(fleet.fleet.incidents().join(fleet.fleet.evidence(), cycles.SUBJECT))
    keys = {re.sub(r"#\d+L?", "", k) for p in plans for k in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", p)}
    lines = {"host_id", "host_id, snapshot_id", "host_id, next_id", "host_id, started_at", "host_id, observed_at"}
    assert "host_id, snapshot_id" in keys and keys <= lines and not any("BroadcastNestedLoopJoin" in p for p in plans)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert fleet.fleet.folder.spark.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")


def test_captures_are_joined_without_a_broadcast(spark):
    from hostlore.plans import queries, stream_queries

    plan = stream_queries.captures(queries.Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 4 and "Broadcast" not in plan


def test_the_ends_of_slots_find_every_anchor_that_has_an_event(spark):
    import random

    from hostlore.operators import correlate

    rng, width = random.Random(4), 10
    second = lambda n: T0 + timedelta(microseconds=n)
    events = spark.createDataFrame([(rng.choice("hg"), rng.choice("ab"), second(rng.randrange(900))) for _ in range(60)], "host_id string, unit string, observed_at timestamp")
    anchors = spark.createDataFrame([(h, n, 1704067200000000 + t) for h in "hg" for n in "ab" for t in range(900)], "host_id string, name string, t long")
    items = events.select("host_id", F.col("unit").alias("name"), F.unix_micros("observed_at").alias("t"))
    found = [
        {tuple(r) for r in correlate.near(anchors, rows, ["host_id", "name"], width).select("host_id", "name", "t").collect()}
        for rows in (items, cycles.ends(events, width))
    ]
    assert found[0] == found[1] and 0 < len(found[0]) < 3600
    busy = spark.range(1000).selectExpr("'h' AS host_id", "'a' AS unit", "timestamp_micros(id % 25) AS observed_at")
    assert cycles.ends(busy, width).count() == 6  # two for each of three slots
