"""Chains, nearest items, histograms and keyed stream state against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hostlore.operators import chain, correlate, ingest, stored
from hostlore.sources import publish
from hostlore.streaming import lifecycles, streams

T0 = datetime(2024, 1, 1)
STEP = "host_id string, place long, enter string, leave string"
START = "host_id string, state string"


def walk(steps, start):
    """(host, place) of the steps taken, and the state that each met."""
    taken, met = set(), {}
    for host, state in start:
        for _, place, enter, leave in sorted(s for s in steps if s[0] == host):
            met[host, place] = state
            if enter == state:
                taken.add((host, place))
                state = leave
    return taken, met


def test_chain_equals_a_loop(spark):
    rng = random.Random(1)
    names = [None, *"abcdef"]
    steps = [(h, p, rng.choice(names), rng.choice(names)) for h in "xyz" for p in rng.sample(range(1000), 60)]
    steps += [("long", p, f"s{p}", f"s{p + 1}") for p in range(50)] + [("still", p, "a", "a") for p in range(20)]
    start = [("x", None), ("y", "a"), ("z", "nothing"), ("long", "s0"), ("still", "a"), ("idle", "a")]
    frame, begin = spark.createDataFrame([(s[0], s[1], s[2], s[3]) for s in steps], STEP), spark.createDataFrame(start, START)
    taken, met = walk([(s[0], s[1], s[2], s[3]) for s in steps], start)
    path = chain.taken(frame, begin, ["host_id"])
    assert {(r.host_id, r.place) for r in path.collect()} == taken
    got = chain.states(frame, path, begin, ["host_id"]).collect()
    assert {(r.host_id, r.place): r.before for r in got} == met


def test_no_steps_at_all(spark):
    assert chain.taken(spark.createDataFrame([], STEP), spark.createDataFrame([("h", None)], START), ["host_id"]).collect() == []


def test_batches_move_the_cursor(spark):
    rows = [
        ("h", 1, 2, "b", "b", "a"), ("h", 2, 1, "c", "x", "b"),  # accepted; doesn't end at its last event
        ("h", 3, 1, "d", "d", "a"), ("h", 4, 1, "e", "e", "b"),  # stale; the right cursor after two refusals
        ("h", 5, 0, None, "e", "e"), ("h", 6, 0, None, "q", "e"), ("h", 7, 1, "f", "f", "e"), ("g", 1, 1, "z", "z", None),
    ]
    schema = "host_id string, seq long, n_events long, last_cursor string, next_cursor string, expected_cursor string"
    out = stored.gate_history(spark.createDataFrame(rows, schema), spark.createDataFrame([("h", "a")], "host_id string, cursor string")).collect()
    assert {(r.host_id, r.seq): (r.saved, r.reason) for r in out} == {
        ("h", 1): ("a", None), ("h", 2): ("b", "checkpoint_not_last_event"), ("h", 3): ("b", "checkpoint_changed"), ("h", 4): ("b", None),
        ("h", 5): ("e", None), ("h", 6): ("e", "empty_batch_moves_checkpoint"), ("h", 7): ("e", None), ("g", 1): (None, None),
    }


def test_pages_follow_each_other(spark):
    page = lambda n, cursors, valid=True: [("h", n, i, c, valid) for i, c in enumerate(cursors)]
    rows = [*page(1, "abc"), *page(2, "cdefg"), *page(3, "xyz"), *page(5, "fgh", False), *page(6, "fghh"), *page(7, "f"), *page(8, "fz")]
    frame = spark.createDataFrame(rows, "host_id string, page long, pos long, cursor string, valid boolean")
    pages = spark.createDataFrame([("h", n) for n in range(1, 9)] + [("g", 1)], "host_id string, page long")
    got = {(r.host_id, r.page): (r.outcome, r.accepted, r.next_cursor) for r in ingest.accept_page_chain(frame, 3, pages=pages).collect()}
    assert got == {
        ("h", 1): ("success", 3, "c"), ("h", 2): ("partial", 3, "f"), ("h", 3): ("journal_cursor_invalidated", 0, "f"),
        ("h", 4): ("journal_cursor_invalidated", 0, "f"), ("h", 5): ("journal_invalid", 0, "f"), ("h", 6): ("journal_duplicate_cursor", 0, "f"),
        ("h", 7): ("success", 0, "f"), ("h", 8): ("success", 1, "z"), ("g", 1): ("success", 0, None),
    }
    saved = spark.createDataFrame([("h", "x")], "host_id string, saved string")
    later = {r.page: r.outcome for r in ingest.accept_page_chain(frame, 3, saved, pages).where("host_id = 'h'").collect()}
    assert [later[n] for n in (1, 2, 3)] == ["journal_cursor_invalidated"] * 2 + ["success"]


@pytest.mark.parametrize("window, most", [(10, 3), (7, 1), (50, 31), (0, 2)])
def test_nearest_equals_all_pairs(spark, window, most):
    rng = random.Random(window)
    items = [("h", rng.choice("ab"), rng.randint(0, 200), f"i{n:03}") for n in range(300)]
    anchors = [("h", rng.choice("abc"), rng.randint(-20, 220)) for _ in range(60)] + [("h", "a", 50)] * 2
    left = spark.createDataFrame([(*a, n) for n, a in enumerate(anchors)], "host_id string, name string, t long, a int")
    right = spark.createDataFrame(items, "host_id string, name string, t long, id string")
    found = correlate.nearest(left, right, ["host_id", "name"], window, most, F.col("id")).collect()
    got = {}
    for r in found:
        got.setdefault(r.a, []).append((abs(r.item_t - r.t), r.item_t, r.id))
    for n, (host, name, t) in enumerate(anchors):
        near = sorted((abs(i[2] - t), i[2], i[3]) for i in items if i[:2] == (host, name) and abs(i[2] - t) <= window)
        own = sorted(got.get(n, []))
        assert own[:most] == near[:most] and len(own) <= 2 * most and set(own) <= set(near)


def test_a_busy_window_asks_for_few_pairs(spark):
    rows = spark.range(20_000)
    items = rows.select(F.lit("h").alias("host_id"), F.lit("a").alias("name"), (F.col("id") % 1000).alias("t"), F.col("id").cast("string").alias("key"))
    anchors = spark.createDataFrame([("h", "a", 500), ("h", "a", 998)], "host_id string, name string, t long")
    assert correlate.nearest(anchors, items, ["host_id", "name"], 1000, 31, F.col("key")).count() <= 4 * 31


def test_an_anchor_asks_for_no_number_that_is_not_there(spark):
    asks = spark.createDataFrame([("h", "a", t, t // 10) for t in (1, 5, 9, 12)], "host_id string, name string, t long, slot long")
    items = spark.createDataFrame([("h", "a", 5, 0), ("h", "a", 14, 1)], "host_id string, name string, item_t long, slot long")
    got = sorted((r.t, r.slot, r.side, r.number) for r in correlate.lookups(asks, items, ["host_id", "name"], 31).collect())
    one = lambda t, *found: [(t, slot, side, 1) for slot, side in found]
    assert got == one(1, (0, "ahead"), (1, "ahead")) + one(5, (0, "back"), (1, "ahead")) + one(9, (0, "back"), (1, "ahead")) + one(12, (0, "back"), (1, "ahead"))


def test_newest_events_equal_a_sort(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), f"c{n:03}", T0 + timedelta(minutes=rng.randint(0, 600))) for n in range(200)] + [("few", "c", T0)]
    frame = spark.createDataFrame(rows, "host_id string, cursor string, observed_at timestamp")
    for most in (1, 37, 500):
        got = {(r.host_id, r.cursor) for r in stored.newest_events(frame, most).collect()}
        want = {(h, c) for host in ("a", "b", "few") for h, c, _ in sorted((r for r in rows if r[0] == host), key=lambda r: (r[2], r[1]))[-most:]}
        assert got == want


def test_snapshots_are_published_whole_or_refused(spark, tmp_path):
    key = "host_id string, snapshot_id long"
    snapshots = spark.createDataFrame([("h", n) for n in (1, 2, 3, 4)], key)
    results = spark.createDataFrame([("h", n, "services", "success") for n in (1, 2, 3, 4)], key + ", collector_name string, status string")
    services = spark.createDataFrame([("h", 1, "a"), ("h", 2, "a"), ("h", 2, "a"), ("h", 3, "a"), ("h", 4, "a")], key + ", name string")
    claimed = spark.createDataFrame([("h", n, "services", "partial" if n == 3 else "success") for n in (1, 2, 3)], results.schema)  # 4 names none
    assert stored.publish_snapshots(str(tmp_path), snapshots, results, {"services": (services, ["name"])}, claimed) == 0
    assert {n: [r.snapshot_id for r in df.collect()] for n, df in publish.published(spark, str(tmp_path)).items()} == {
        "snapshots": [1], "results": [1], "services": [1]
    }


def test_warnings_in_collector_order(spark):
    key = "host_id string, snapshot_id long"
    snapshots = spark.createDataFrame([("h", 1, T0), ("h", 2, T0)], key + ", observed_at timestamp")
    statuses = [("h", 1, c, "partial", w) for c, w in (("services", ["s1", "s0"]), ("journal", ["j"]), ("cpu", None), ("processes", ["p"]), ("custom", ["x"]))]
    out = ingest.assemble_snapshots(snapshots, spark.createDataFrame(statuses, key + ", collector_name string, status string, warnings array<string>"))
    assert {r.snapshot_id: r.warnings for r in out.collect()} == {1: ["p", "s1", "s0", "x", "j"], 2: None}


def test_quality_counts_what_was_accepted(spark):
    key = "host_id string, snapshot_id long, collector_name string"
    rows = [
        ("h", 1, "journal", "success", T0, None), ("h", 2, "journal", "partial", T0 + timedelta(1), None),
        ("g", 1, "journal", "permission_denied", T0, "denied"), ("f", 1, "journal", "success", T0, None),
    ]
    results = spark.createDataFrame(rows, key + ", status string, collected_at timestamp, error_code string")
    accepted = spark.createDataFrame([("h", 1, "journal", 5), ("h", 2, "journal", 3), ("g", 1, "journal", 9)], key + ", event_count long")
    got = {r.host_id: (r.snapshot_id, r.event_count, r.error_code, r.error_message) for r in stored.latest_quality(results, accepted).collect()}
    assert got == {"h": (2, 3, None, None), "g": (1, None, "denied", None), "f": (1, 0, None, None)}


PROCESS = (
    "host_id string, snapshot_id long, observed_at timestamp, status string, "
    "items array<struct<pid:int,lifetime_id:string,rss_bytes:bigint,virtual_memory_bytes:bigint>>"
)


def test_process_states_in_the_stream(spark, tmp_path):
    """Arrivals by snapshot, with one repeated and one late; a silent host is forgotten by event time."""
    row = lambda n, items, status="success", host="h": (host, n, T0 + timedelta(days=n), status, items)
    arrivals = [
        [row(1, [(1, "1:5", 10, 10), (2, None, 1, None), (9, "9:9", 1, 1)])],
        [row(2, [(1, "1:5", 15, None), (2, "2:1", 1, 1), (3, "3:1", 1, 1)]), row(1, [(7, "7:7", 1, 1)])],
        [row(2, [(8, "8:8", 1, 1)]), row(3, [(1, "1:6", 1, 1), (2, None, 1, 1)], "partial"), row(4, [(4, "4:4", 1, 1)], "transient_failure")],
        [row(5, [(4, "4:4", 1, 1)]), row(1, [(1, "1:1", 1, 1)], host="g")],
    ]
    source = str(tmp_path / "in")
    for part in arrivals:
        spark.createDataFrame(part, PROCESS).coalesce(1).write.mode("append").parquet(source)
    with lifecycles.rocksdb(spark):
        stream = spark.readStream.schema(PROCESS).option("maxFilesPerTrigger", 1).parquet(source)
        rows = streams.run_once(lifecycles.compared(stream, lifecycles.Processes), str(tmp_path / "out")).collect()
    got = {(r.host_id, r.snapshot_id, r.pid): (r.lifecycle, r.rss_delta, r.vm_delta) for r in rows}
    first, none = ("insufficient_history", None, None), (None, None)
    assert got == {
        ("h", 1, 1): first, ("h", 1, 2): first, ("h", 1, 9): first,
        ("h", 2, 1): ("continuing", 5, None), ("h", 2, 2): ("new", *none), ("h", 2, 3): ("new", *none), ("h", 2, 9): ("exited", *none),
        ("h", 3, 1): ("identity_changed", *none), ("h", 3, 2): ("invalid", *none), ("h", 5, 4): first, ("g", 1, 1): first,
    }
    assert len(rows) == len(got)


def test_a_silent_host_is_forgotten(spark, tmp_path):
    source = str(tmp_path / "in")
    days = [(1, "h"), (2, "h"), (60, "g"), (61, "g"), (62, "h")]
    for n, (day, host) in enumerate(days):
        items = [(1, "1:5", day, day)]
        number = {1: 1, 2: 2, 60: 1, 61: 2, 62: 3}[day]
        spark.createDataFrame([(host, number, T0 + timedelta(days=day), "success", items)], PROCESS).coalesce(1).write.mode("append").parquet(source)
    with lifecycles.rocksdb(spark):
        stream = spark.readStream.schema(PROCESS).option("maxFilesPerTrigger", 1).parquet(source)
        rows = streams.run_once(lifecycles.compared(stream, lifecycles.Processes, silent_days=30, delay="1 day"), str(tmp_path / "out")).collect()
    assert {(r.host_id, r.snapshot_id): r.lifecycle for r in rows} == {
        ("h", 1): "insufficient_history", ("h", 2): "continuing", ("g", 1): "insufficient_history", ("g", 2): "continuing", ("h", 3): "insufficient_history"
    }
