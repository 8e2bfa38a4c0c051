"""Small cases of the telemetry operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hostlore.functions import scalars as s
from hostlore.operators import correlate, diagnose, ingest, lifecycle, reconcile, stored, temporal

T0 = datetime(2024, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("previous", "current", "elapsed", "state", "rate"),
    [
        (100, 160, 2.5, "valid", 24.0),
        (None, 1, 1.0, "no_previous", None),
        (1, None, 1.0, "invalid_data", None),
        (1, 2, 0.0, "invalid_interval", None),
        (1, 2, -1.0, "invalid_interval", None),
        (1, 2, float("nan"), "invalid_interval", None),
        (1, 2, float("inf"), "invalid_interval", None),
        (1, 2, None, "invalid_interval", None),
        (-1, 2, 1.0, "invalid_data", None),
        (5, 2, 1.0, "counter_reset", None),
    ],
)
def test_counter_states(spark, previous, current, elapsed, state, rate):
    got = one(spark, s.counter(F.lit(previous).cast("long"), F.lit(current).cast("long"), F.lit(elapsed).cast("double")))
    assert (got.state, got.rate) == (state, rate)


def test_redaction_and_cut(spark):
    text = "run --token abc password=hunter2 -p x url?api_key=q&z=1 Secret:yes fine"
    assert one(spark, s.redact(F.lit(text))) == "run --token [REDACTED] password=[REDACTED] -p [REDACTED] url?api_key=[REDACTED] Secret:[REDACTED] fine"
    for n in range(1, 9):
        assert one(spark, s.cut_utf8(F.lit("aé😀b"), n)) == "aé😀b".encode()[:n].decode(errors="ignore")


def test_iso_and_names(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 2, 3, 4, 5),), (datetime(2024, 1, 2, 3, 4, 5, 60),)], "t timestamp").select(s.iso(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.000060+00:00"]
    names = {"a.service": True, ".service": False, "a b.service": False, "a.servicex": False, "x" * 510 + ".service": False}
    for name, ok in names.items():
        assert one(spark, s.valid_service_name(F.lit(name))) is ok


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def history(spark, statuses, collector="services"):
    snapshots = frame(
        spark,
        [("h", i + 1, T0 + timedelta(days=i), 60.0 * i) for i in range(len(statuses))],
        "host_id string, snapshot_id long, observed_at timestamp, monotonic_s double",
    )
    results = frame(
        spark,
        [("h", i + 1, c, x) for i, x in enumerate(statuses) for c in (collector,)],
        "host_id string, snapshot_id long, collector_name string, status string",
    )
    return snapshots, results


SERVICES = "host_id string, snapshot_id long, name string, load_state string, active_state string, sub_state string"


def test_service_lifecycle(spark):
    snapshots, results = history(spark, ["success", "success", "partial", "success"])
    rows = frame(
        spark,
        [
            ("h", 1, "a.service", "loaded", "active", "running"),
            ("h", 2, "a.service", "loaded", "failed", "failed"),
            ("h", 2, "b.service", "loaded", "active", "running"),
            ("h", 3, "a.service", "loaded", "failed", "failed"),
            ("h", 4, "c.service", "loaded", "active", "running"),
        ],
        SERVICES,
    )
    got = {(r.snapshot_id, r.name): r.lifecycle for r in lifecycle.service_lifecycle(rows, snapshots, results).collect()}
    assert got == {
        (1, "a.service"): "insufficient_history",
        (2, "a.service"): "state_changed",
        (2, "b.service"): "new",
        (3, "a.service"): "continuing",
        (4, "c.service"): "insufficient_history",
    }


def test_removed_and_invalid(spark):
    snapshots, results = history(spark, ["success", "success"])
    rows = frame(spark, [("h", 1, "a.service", "loaded", "active", "running"), ("h", 2, "b.service", "loaded", "active", "running")], SERVICES)
    assert {(r.name, r.lifecycle) for r in lifecycle.service_lifecycle(rows, snapshots, results).collect() if r.snapshot_id == 2} == {
        ("a.service", "removed"), ("b.service", "new")
    }
    bad = rows.unionByName(frame(spark, [("h", 2, "a.service", "loaded", "two words", "x")], SERVICES))
    assert {(r.name, r.lifecycle) for r in lifecycle.service_lifecycle(bad, snapshots, results).collect() if r.snapshot_id == 2} == {
        ("a.service", "invalid"), ("b.service", "insufficient_history")
    }


def test_process_lifecycle(spark):
    snapshots, results = history(spark, ["success", "success"], "processes")
    schema = "host_id string, snapshot_id long, pid int, lifetime_id string, cpu_time_ticks long, rss_bytes long, virtual_memory_bytes long"
    rows = frame(
        spark,
        [
            ("h", 1, 1, "1:5", 10, 1, 1),
            ("h", 1, 2, "2:5", 10, 1, 1),
            ("h", 1, 3, "3:5", 10, 1, None),
            ("h", 2, 1, "1:5", 70, 4, 1),
            ("h", 2, 3, "3:6", 1, 1, 1),
            ("h", 2, 4, "4:1", 1, 1, 1),
            ("h", 2, 5, None, 1, 1, 1),
        ],
        schema,
    )
    got = {r.pid: r for r in lifecycle.process_lifecycle(rows, snapshots, results, frame(spark, [], SERVICES)).collect() if r.snapshot_id == 2}
    assert {p: r.lifecycle for p, r in got.items()} == {1: "continuing", 2: "exited", 3: "identity_changed", 4: "new", 5: "invalid"}
    assert (got[1].cpu.rate, got[1].rss_delta) == (1.0, 3)


def test_failed_collections_make_no_claims(spark):
    """Rows of a failed or unsupported collection are neither classified nor the rows before."""
    for status in ("transient_failure", "unsupported", "permission_denied", "invalid_data"):
        snapshots, results = history(spark, ["success", status, "success"])
        rows = frame(spark, [("h", n, "a.service", "loaded", "failed" if n == 2 else "active", "x") for n in (1, 2, 3)], SERVICES)
        got = {(r.snapshot_id, r.lifecycle) for r in lifecycle.service_lifecycle(rows, snapshots, results).collect()}
        assert got == {(1, "insufficient_history"), (3, "insufficient_history")}
        assert correlate.incident_anchors(lifecycle.service_lifecycle(rows, snapshots, results)).count() == 0
        snapshots, results = history(spark, ["success", status, "success"], "processes")
        schema = "host_id string, snapshot_id long, pid int, lifetime_id string, cpu_time_ticks long, rss_bytes long, virtual_memory_bytes long"
        rows = frame(spark, [("h", n, 1, "1:5", n, 1, 1) for n in (1, 2, 3)] + [("h", 1, 2, "2:5", 1, 1, 1)], schema)
        got = {(r.snapshot_id, r.pid, r.lifecycle) for r in lifecycle.process_lifecycle(rows, snapshots, results, frame(spark, [], SERVICES)).collect()}
        assert got == {(1, 1, "insufficient_history"), (1, 2, "insufficient_history"), (3, 1, "insufficient_history")}
    snapshots, results = history(spark, ["success", "partial"])
    rows = frame(
        spark,
        [
            ("h", 1, "a.service", "loaded", "active", "x"),
            ("h", 2, "a.service", "loaded", "failed", "x"),
            ("h", 1, "b.service", "loaded", "active", "x"),
        ],
        SERVICES,
    )
    assert {(r.name, r.lifecycle) for r in lifecycle.service_lifecycle(rows, snapshots, results).collect() if r.snapshot_id == 2} == {
        ("a.service", "state_changed")
    }


def test_cpu(spark):
    snapshots, _ = history(spark, ["success"] * 2)
    rows = frame(
        spark,
        [("h", 1, 10, 2, 3, 80, 1, 1, 1, 0), ("h", 2, 15, 2, 8, 90, 1, 1, 1, 0)],
        "host_id string, snapshot_id long, " + ", ".join(f"{t} long" for t in temporal.TICKS),
    )
    r = temporal.cpu_utilisation(rows, snapshots).where("snapshot_id = 2").first()
    assert (r.state, r.total, r.busy, r.utilisation) == ("valid", 20, 10, 0.5)


@pytest.mark.parametrize(("shift", "hit"), [(4_999_999, True), (5_000_000, True), (-5_000_000, True), (5_000_001, False), (-5_000_001, False)])
def test_window_edges(spark, shift, hit):
    anchors = frame(spark, [("h", "a", 1_000_000_000)], "host_id string, name string, t long")
    items = frame(spark, [("h", "a", 1_000_000_000 + shift), ("h", "b", 1_000_000_000)], "host_id string, name string, t long")
    assert (correlate.near(anchors, items, ["host_id", "name"], 5_000_000).count() == 1) is hit


def test_parsers(spark):
    def cap(text):
        return frame(spark, [("h", 1, text)], "host_id string, snapshot_id long, payload string")

    assert ingest.parse_cpu(cap("cpu  1 2 3 4\ncpu0 9")).first()[2:] == (True, 1, 2, 3, 4, 0, 0, 0, 0)
    assert not ingest.parse_cpu(cap("cpu 1 2 3")).first().valid and not ingest.parse_cpu(
        cap("cpu 1 2 3 -4")
    ).first().valid and not ingest.parse_cpu(cap("none")).first().valid
    r = ingest.parse_memory(cap("MemTotal: 4 kB\nMemFree: 1 kB\nMemAvailable: 2\nMemFree: 3 kB\nnothing")).first()
    assert (r.valid, r.total_bytes, r.free_bytes, r.available_bytes, r.buffers_bytes) == (True, 4096, 3072, 2, None)
    assert not ingest.parse_memory(cap("MemTotal: 4 MB")).first().valid
    assert [
        r.name for r in ingest.parse_services(cap("a.service loaded active running x y\nb.service loaded failed failed")).collect()
    ] == ["a.service", "b.service"]
    assert not ingest.parse_services(cap("a.service loaded active running\na.service loaded active running")).first().valid


def test_empty_captures_and_pages(spark):
    """A capture or page without rows is a success; a page without rows under a saved cursor has lost it."""
    captures = frame(spark, [("h", 1, "a.service loaded active running x"), ("h", 2, ""), ("h", 3, "broken"), ("h", 4, "")], "host_id string, snapshot_id long, payload string")
    failures = frame(spark, [("h", 4, "permission_denied"), ("h", 5, "vanished")], "host_id string, snapshot_id long, source_status string")
    got = {r.snapshot_id: r.status for r in ingest.collection_status(captures, ingest.parse_services(captures), failures).collect()}
    assert got == {1: "success", 2: "success", 3: "invalid_data", 4: "permission_denied", 5: "transient_failure"}
    records = frame(spark, [("h", 1, 0, "a", True, True), ("h", 2, 0, "b", True, False)], "host_id string, page long, pos long, cursor string, valid boolean, warned boolean")
    saved = frame(spark, [("h", 4, "z")], "host_id string, page long, saved string")
    pages = frame(spark, [("h", n) for n in (1, 2, 3, 4)], "host_id string, page long")
    got = {r.page: (r.outcome, r.accepted, r.next_cursor) for r in ingest.accept_pages(records, saved, 5, pages).collect()}
    assert got == {1: ("partial", 1, "a"), 2: ("success", 1, "b"), 3: ("success", 0, None), 4: ("journal_cursor_invalidated", 0, "z")}


def test_unreadable_processes(spark):
    parsed = frame(spark, [("h", 1, 1, True), ("h", 1, 2, False), ("h", 1, 9, True), ("g", 1, 1, True)], "host_id string, snapshot_id long, pid int, valid boolean")
    gone = frame(spark, [("h", 1, 3, "vanished"), ("h", 1, 4, "inaccessible")], "host_id string, snapshot_id long, pid int, problem string")
    got = {r.host_id: (r.n_valid, r.warnings, r.status) for r in ingest.process_status(parsed, gone, 4).collect()}
    said = ["process 2 returned malformed data", "process 3 disappeared during collection", "process 4 was inaccessible", "process observation limit reached (4)"]
    assert got == {"h": (1, said, "partial"), "g": (1, [], "success")}


def test_journal_page(spark):
    records = frame(
        spark,
        [("h", p, i, c, True) for p, cs in {1: "abc", 2: "abca", 3: "bcd", 4: "abcd"}.items() for i, c in enumerate(cs)],
        "host_id string, page long, pos long, cursor string, valid boolean",
    )
    saved = frame(spark, [("h", 3, "a"), ("h", 4, "a")], "host_id string, page long, saved string")
    got = {r.page: (r.outcome, r.accepted, r.next_cursor) for r in ingest.accept_pages(records, saved, 2).collect()}
    assert got == {1: ("partial", 2, "b"), 2: ("journal_duplicate_cursor", 0, None), 3: ("journal_cursor_invalidated", 0, "a"), 4: ("partial", 2, "c")}


HEAD = "host_id string, incident_id string, rule_id string, subject_type string, subject_id string, state string, " "started_at timestamp, last_observed_at timestamp, resolved_at timestamp, limitations array<string>"


def test_reconcile(spark):
    def row(i, last, state="active", resolved=None, rule="r"):
        return ("h", i, rule, "service", f"{i}.service", state, T0, T0 + timedelta(hours=last), resolved and T0 + timedelta(hours=resolved), ["x"])

    old = frame(spark, [row("a", 1), row("b", 1), row("c", 1, "resolved", 2), row("d", 1)], HEAD)
    new = frame(spark, [row("a", 3), row("c", 3), row("d", 1, rule="other"), row("e", 1)], HEAD)
    merged, bad = reconcile.upsert(old, new)
    assert {r.incident_id: r.change for r in merged.collect()} == {
        "a": "extended", "b": "stored", "c": "kept", "d": "kept", "e": "inserted"
    }
    assert {r.incident_id: r.problem for r in bad.collect()} == {"c": "evidence_after_resolution", "d": "identity_reused"}
    again, none = reconcile.upsert(merged.drop("change"), new.where("incident_id in ('a', 'e')"))
    assert {r.change for r in again.collect()} == {"kept", "stored"} and none.count() == 0
    subjects = frame(
        spark,
        [("h", "a.service", T0 + timedelta(hours=9)), ("h", "b.service", T0), ("h", "e.service", T0 + timedelta(hours=9))],
        "host_id string, subject_id string, resolved_time timestamp",
    )
    done, early = reconcile.resolve(merged, subjects, new.where("incident_id = 'e'"))
    assert {
        r.incident_id: r.state for r in done.collect()
    } == {"a": "resolved", "b": "active", "c": "resolved", "d": "active", "e": "active"} and [r.incident_id for r in early.collect()] == ["b"]


def test_resolution_over_time(spark):
    """The first recovery at or after the start counts, but none of a cycle in which the subject failed again."""
    at = lambda h: T0 + timedelta(hours=h)

    def row(i, subject, start, last, state="active"):
        return ("h", i, "r", "service", subject, state, at(start), at(last), at(last) if state == "resolved" else None, [])

    old = [row("a", "s", 1, 1), row("b", "s", 5, 5), row("c", "t", 1, 9), row("d", "u", 1, 1), row("e", "s", 1, 2, "resolved"), row("f", "s", 8, 8)]
    incidents = frame(spark, old, HEAD)
    recoveries = frame(
        spark,
        [("h", "s", at(3)), ("h", "s", at(5)), ("h", "s", at(7)), ("h", "t", at(4)), ("g", "u", at(4))],
        "host_id string, subject_id string, resolved_time timestamp",
    )
    done, early = reconcile.resolve_over_time(incidents, recoveries, incidents.where("incident_id = 'b'"))
    got = {r.incident_id: (r.state, r.resolved_at, r.now_resolved) for r in done.collect()}
    assert got == {
        "a": ("resolved", at(3), True),
        "b": ("resolved", at(7), True),
        "c": ("active", None, False),
        "d": ("active", None, False),
        "e": ("resolved", at(2), False),
        "f": ("active", None, False),
    }
    assert [(r.incident_id, r.problem) for r in early.collect()] == [("c", "resolution_before_evidence")]


def test_history_is_the_last_of_the_recent(spark):
    """Against all pairs, with ties in time and more incidents than count."""
    rows = [
        (
            "h", f"{i:02}", "r", "service", f"s{i % 2}", "active", T0 + timedelta(hours=i // 4), T0 + timedelta(hours=(i * 7) % 23), None, []
        ) for i in range(40)
    ]
    got = {r.incident_id: r.history for r in diagnose.history(frame(spark, rows, HEAD), recent=12, most=3).collect()}
    for r in rows:
        same = sorted((x for x in rows if x[4] == r[4]), key=lambda x: (-x[7].timestamp(), x[1]))[:12]
        past = sorted(((x[6], x[1]) for x in same if x[6] < r[6]))[-3:]
        assert got.get(r[1], []) == [i for _, i in past]


def test_event_window_is_cut(spark):
    rows = frame(
        spark,
        [("h", f"c{i:02}", "a", T0 + timedelta(minutes=i)) for i in range(10)],
        "host_id string, cursor string, unit string, observed_at timestamp",
    )
    for limit, cut in ((4, True), (10, False), (20, False)):
        got = stored.event_window(rows, "a", str(T0), str(T0 + timedelta(days=1)), limit).collect()
        assert [r.cursor for r in got] == [f"c{i:02}" for i in range(min(limit, 10))] and {r.truncated for r in got} == {cut}


def test_events_for_anchors_cut(spark):
    rows = frame(
        spark,
        [("h", T0, f"e{i}", T0 + timedelta(seconds=i)) for i in range(5)] * 2 + [("h", T0 + timedelta(days=1), "e0", T0)],
        "host_id string, observed_at timestamp, evidence_id string, evidence_at timestamp",
    )
    got = {(r.observed_at == T0, r.evidence_id, r.truncated) for r in correlate.events_for_anchors(rows, 3).collect()}
    assert got == {(True, "e0", True), (True, "e1", True), (True, "e2", True), (False, "e0", False)}


def test_diagnosis_rules(spark):
    cases = {
        "a": ["service_failed", "journal_unit_event", "process_exited"],
        "b": ["service_failed", "journal_unit_event"],
        "c": ["service_failed", "process_exited"],
        "d": ["service_failed", "process_started"],
        "e": ["service_inactive", "journal_unit_event"],
    }
    kind = {
        "j": ("journal_event", "service_unit_match"),
        "p": ("process_change", "explicit_process_association"),
        "s": ("service_change", "service_change_anchor"),
    }
    heads = frame(
        spark,
        [("h", i, "r", "service", "x.service", "active", T0 + timedelta(hours=k), T0 + timedelta(hours=k), None, []) for k, i in enumerate(cases)],
        HEAD,
    )
    rows = [("h", i, kind[f[0]][0], f"{i}{f}", T0, kind[f[0]][1], "", f, ["partial"] if i == "b" else []) for i, fs in cases.items() for f in fs]
    evidence = frame(
        spark,
        rows,
        "host_id string, incident_id string, kind string, evidence_id string, evidence_at timestamp, reason string, summary "
        "string, fact string, evidence_limitations array<string>",
    )
    got = {r.incident_id: r for r in diagnose.diagnose(heads, evidence).collect()}
    assert {i: r.rule.removeprefix("service_failure_") for i, r in got.items()} == {
        "a": "journal_process_exit", "b": "journal", "c": "process_exit", "d": "insufficient", "e": "unsupported_service_condition"
    }
    assert got["c"].history == ["a", "b"] and "2 earlier incident candidates" in got["c"].explanation and got["b"].explanation.endswith(
        diagnose.CONTEXT
    ) and not got["a"].explanation.endswith(diagnose.CONTEXT)


def test_append_and_gate(spark):
    schema = "host_id string, cursor string"
    old = frame(spark, [("h", "a"), ("h", "b")], schema)
    assert {r.cursor for r in stored.new_events(old, frame(spark, [("h", "b"), ("h", "c"), ("h", "c")], schema)).collect()} == {"c"}
    batches = frame(
        spark,
        [("h", 1, "z", "z", "b"), ("h", 1, "z", "y", "b"), ("h", 0, None, "q", "b"), ("h", 1, "z", "z", "a")],
        "host_id string, n_events int, last_cursor string, next_cursor string, expected_cursor string",
    )
    got = [r.reason for r in stored.gate_batches(batches, frame(spark, [("h", "b")], schema)).collect()]
    assert sorted(map(str, got)) == ["None", "checkpoint_changed", "checkpoint_not_last_event", "empty_batch_moves_checkpoint"]


def test_a_journal_record_is_taken_apart_once(spark):
    """Each field is looked up once and redacted once; an expression used in several places would be computed in each of them."""
    records = spark.range(10).select(
        F.lit("h").alias("host_id"), F.lit(1).alias("page"), F.col("id").alias("pos"), F.concat(F.lit('{"MESSAGE":"token=a'), "id", F.lit('"}')).alias("payload")
    )
    plan = ingest.parse_journal(records)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 4 * 3
    assert plan.count(", $.") <= len(ingest.JOURNAL_FIELDS)
