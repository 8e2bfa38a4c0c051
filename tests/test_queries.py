"""Registered queries against DuckDB on the smallest tables, and batch against stream."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = [
    "service_lifecycle",
    "process_lifecycle",
    "incident_candidates",
    "evidence_rows",
    "diagnose",
    "reconcile_upsert",
    "cycle_summary",
    "network_rates",
    "ingest_journal",
    "stream_journal",
    "journal_batch_gate",
    "journal_page_accept",
    "ingest_services",
    "snapshot_fanout",
    "audit_reports",
]


def plain(x):
    return repr(round(x, 9)) if isinstance(x, float) else repr(x)


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_cycles_count_all_events(spark, monkeypatch):
    """As their SQL does, also where a snapshot has more than ``events_for_anchors`` lists."""
    from hostlore.plans import queries

    monkeypatch.setattr(queries, "ANCHOR_EVENTS", 1)
    test_equals_sql(spark, "report_cycle")


def test_service_states_stream(spark, tmp_path):
    """As the batch rules say: failed and partial collections, malformed names, and a gap between snapshots."""
    from datetime import datetime

    from hostlore.streaming import lifecycles, streams

    up, down, bad = ("loaded", "active", "x", True), ("loaded", "failed", "x", True), ("loaded", "two words", "x", False)
    rows = [
        ("h", 1, "success", {"a": up, "b": up}), ("h", 2, "success", {"a": down, "c": up}), ("h", 3, "transient_failure", {"a": up}),
        ("h", 4, "success", {"a": up}), ("h", 5, "partial", {"a": down, "d": up}), ("h", 6, "success", {"a": bad}),
        ("g", 5, "success", {"a": up}), ("g", 7, "success", {"a": up}),
    ]
    item = "array<struct<name:string,load_state:string,active_state:string,sub_state:string,valid:boolean>>"
    schema = f"host_id string, snapshot_id long, observed_at timestamp, status string, items {item}"
    frame = spark.createDataFrame([(h, n, datetime(2024, 1, n), s, [(k, *v) for k, v in items.items()]) for h, n, s, items in rows], schema)
    for low, high in ((0, 2), (2, 4), (4, 9)):
        frame.where(f"snapshot_id > {low} and snapshot_id <= {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with lifecycles.rocksdb(spark):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = streams.run_once(lifecycles.compared(stream, lifecycles.Services), str(tmp_path / "out")).collect()
    got = {(r.host_id, r.snapshot_id, r.name): r.lifecycle for r in out}
    first = "insufficient_history"
    assert got == {
        ("h", 1, "a"): first, ("h", 1, "b"): first, ("h", 2, "a"): "state_changed", ("h", 2, "b"): "removed", ("h", 2, "c"): "new", ("h", 4, "a"): first,
        ("h", 5, "a"): "state_changed", ("h", 5, "d"): first, ("h", 6, "a"): "invalid", ("g", 5, "a"): first, ("g", 7, "a"): first,
    }


@pytest.mark.parametrize("name", ["stream_service_lifecycle", "stream_process_lifecycle"])
def test_lifecycle_streams_in_shards_equal_sql(spark, monkeypatch, name):
    """A host's items dealt into several shards, none of which is held whole."""
    from hostlore.plans import stream_queries
    from hostlore.streaming import lifecycles

    seen, dealt = [], lifecycles.dealt
    monkeypatch.setattr(lifecycles, "dealt", lambda *a: seen.append(a[2]) or dealt(*a))
    monkeypatch.setattr(stream_queries, "SHARD_ITEMS", 1)
    test_equals_sql(spark, name)
    assert seen and seen[0] > 2


def test_fleet_cycles(spark, tmp_path):
    """Two arrivals: an incident opens; late evidence merges under its id and it is resolved. Stopped between, and gone on with."""
    from datetime import datetime, timedelta

    from hostlore.streaming import cycles, streams

    t0 = datetime(2024, 1, 1)
    at = lambda n: t0 + timedelta(days=n)
    ok = lambda n, status="success": [("services", status, at(n)), ("processes", "success", at(n)), ("journal", "success", at(n))]
    svc = lambda state: [("a.service", "loaded", state, "x")]
    near, late = ("c1", at(2) - timedelta(hours=1), "a.service", 3), ("c2", at(2) + timedelta(hours=2), "a.service", None)
    rows = [
        ("h", 1, at(1), 0.0, ok(1), svc("active"), [], []), ("h", 2, at(2), 60.0, ok(2), svc("failed"), [], [near, near]),
        ("h", 3, at(3), 120.0, ok(3), svc("failed"), [], [late, near]), ("h", 4, at(4), 180.0, ok(4), svc("active"), [], []),
    ]
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    links = spark.createDataFrame([], "host_id string, service_name string, lifetime_id string")
    fleet = cycles.FleetCycles(spark, path, links, 6 * 3600)
    seen = []
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, streams.CAPTURE).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(streams.CAPTURE).option("maxFilesPerTrigger", 1).parquet(source)
        cycles.FleetCycles(spark, path, links, 6 * 3600).go(stream, batches=1)
        (one,) = fleet.incidents().collect()
        seen.append(
            (
                one.incident_id,
                one.state,
                one.last_observed_at,
                one.resolved_at,
                sorted(r.evidence_id for r in fleet.evidence().collect() if r.kind == "journal_event"),
            )
        )
    assert len({s[0] for s in seen}) == 1
    assert [s[1:] for s in seen] == [
        ("active", at(2), None, ["journal:c1"]),
        ("resolved", at(4), at(4), ["journal:c1", "journal:c2"]),
    ]
    again = spark.read.schema(streams.CAPTURE).parquet(source).where("snapshot_id = 4")
    fleet.run(again, 1)  # a replayed batch that was committed does nothing
    assert [r.resolved_at for r in fleet.incidents().collect()] == [at(4)]
    assert sorted((r.snapshot_id, r.events_processed, len(r.candidate_ids), len(r.resolved_ids)) for r in fleet.cycles().collect()) == [
        (1, 0, 0, 0), (2, 2, 1, 0), (3, 2, 0, 0), (4, 0, 0, 1)
    ]


def test_every_query_has_a_unique_name():
    assert set(entry.oracle_sql()) <= set(entry.queries())
