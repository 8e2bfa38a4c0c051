"""Lifecycles of services and processes as captures arrive, with keyed state of each host's snapshot before.

A host's services or processes are dealt into shards by name or id, and each shard has every snapshot, also if nothing in it
is the shard's; so no task or Python process holds a host. The state of a shard is a map from a service's name or a process's
id to the few fields that the next comparison reads, and one value for the snapshot itself. It lives in RocksDB, entry by
entry: it is read once for all snapshots of a batch, which change only the entries that changed. With ``silent_days``, a host that is silent that long in event time is forgotten by a timer, and its next snapshot
counts as its first.
Snapshots at or below the last are left out. A collection that failed, or a missing snapshot, breaks the history.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hostlore.operators.lifecycle import USABLE

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start here keep their state in RocksDB, which keyed maps need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class Compared(StatefulProcessor):
    """What both comparisons share: the order of snapshots, completeness, the state's entries, and forgetting."""

    KEY = FIELDS = ""

    def __init__(self, silent_days: float | None):
        self.silent_ms = None if silent_days is None else int(silent_days * DAY_MS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "snapshot_id long, complete boolean")
        self.entries = handle.getMapState("entries", self.KEY, self.FIELDS)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        captured: dict[tuple, tuple] = {}
        for r in rows:
            own = captured.setdefault((r.snapshot_id, r.copy), (r.observed_at, r.status, r.complete, {}))[3]
            if r.item is not None:
                own[self.name_of(r.item)] = self.state_of(r.item)
        last = self.last.get() if self.last.exists() else None
        stored = {k[0]: tuple(v) for k, v in self.entries.iterator()} if last is not None else {}
        old, newest = stored, None
        for number, copy in sorted(captured):
            if last is None or number > last[0]:
                newest, status, complete, items = captured[number, copy]
                usable = status in USABLE
                known = last is not None and last[0] == number - 1
                now = items if usable else {}
                if usable:
                    yield from self.words(key[0], number, old if known else {}, now, known, known and last[1], complete)
                old, last = now, (number, complete)
        if newest is None:
            return
        for name, value in old.items():
            if stored.get(name) != value:
                self.entries.updateValue((name,), value)
        for name in stored.keys() - old.keys():
            self.entries.removeKey((name,))
        self.last.update(last)
        if self.silent_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(newest.timestamp() * 1000) + self.silent_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.last.clear()
        self.entries.clear()
        return iter(())


class Services(Compared):
    """By the rules of ``lifecycle.service_lifecycle``."""

    KEY, FIELDS = "name string", "load_state string, active_state string, sub_state string, valid boolean"
    OUT = "host_id string, snapshot_id long, name string, lifecycle string"

    def name_of(self, r: dict) -> str:
        return r["name"]

    def state_of(self, r: dict) -> tuple:
        return r["load_state"], r["active_state"], r["sub_state"], r["valid"]

    @staticmethod
    def sound(item: Column) -> Column:
        return F.coalesce(item["valid"], F.lit(False))

    def words(self, host: str, number: int, old: dict, now: dict, known: bool, was_complete: bool, complete: bool) -> Iterator[Row]:
        both = was_complete and complete
        for name, state in now.items():
            before = old.get(name)
            if not state[3] or (before is not None and not before[3]):
                word = "invalid"
            elif before is None:
                word = "new" if both else "insufficient_history"
            else:
                word = "continuing" if before[:3] == state[:3] else "state_changed"
            yield Row(host_id=host, snapshot_id=number, name=name, lifecycle=word)
        if both:
            for name in old.keys() - now.keys():
                yield Row(host_id=host, snapshot_id=number, name=name, lifecycle="removed")


class Processes(Compared):
    """By the rules of ``lifecycle.process_lifecycle``; of a process only its lifetime and memory are kept."""

    KEY, FIELDS = "pid int", "lifetime_id string, rss_bytes long, virtual_memory_bytes long"
    OUT = "host_id string, snapshot_id long, pid int, lifetime_id string, lifecycle string, rss_delta long, vm_delta long"

    def name_of(self, r: dict) -> int:
        return r["pid"]

    def state_of(self, r: dict) -> tuple:
        return r["lifetime_id"], r["rss_bytes"], r["virtual_memory_bytes"]

    @staticmethod
    def sound(item: Column) -> Column:
        return F.lit(True)

    def words(self, host: str, number: int, old: dict, now: dict, known: bool, was_complete: bool, complete: bool) -> Iterator[Row]:
        def told(pid: int, life: str | None, word: str, deltas: tuple = (None, None)) -> Row:
            return Row(host_id=host, snapshot_id=number, pid=pid, lifetime_id=life, lifecycle=word, rss_delta=deltas[0], vm_delta=deltas[1])

        for pid, (life, *sizes) in now.items():
            before = old.get(pid)
            if not known:
                yield told(pid, life, "insufficient_history")
            elif life is None:
                yield told(pid, life, "invalid")
            elif before is not None and before[0] == life:
                deltas = tuple(None if a is None or b is None else b - a for a, b in zip(before[1:], sizes, strict=True))
                yield told(pid, life, "continuing", deltas)
            elif before is not None and before[0] is not None:
                yield told(pid, life, "identity_changed")
            else:
                yield told(pid, life, "new" if was_complete else "insufficient_history")
        if was_complete and complete:
            for pid in old.keys() - now.keys():
                if old[pid][0] is not None:
                    yield told(pid, old[pid][0], "exited")


def dealt(captures: DataFrame, processor: type[Compared], shards: int) -> DataFrame:
    """Each item of a capture in its shard, and one row without an item for every shard; ``complete`` is that of the whole capture.

    ``copy`` tells captures of one snapshot apart by content.
    """
    fields = ["snapshot_id", "observed_at", "status", "complete", "copy"]
    items = F.coalesce("items", F.array().cast(captures.schema["items"].dataType))
    whole = captures.withColumns(
        {
            "complete": (F.col("status") == "success") & F.forall(items, processor.sound),
            "copy": F.xxhash64("status", "observed_at", "items"),
        }
    )
    name = processor.KEY.split()[0]
    none = F.lit(None).cast(captures.schema["items"].dataType.elementType)
    marks = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.struct(k.cast("long").alias("shard"), none.alias("item")))
    each = F.transform(items, lambda r: F.struct(F.pmod(F.xxhash64(r[name]), F.lit(shards)).alias("shard"), r.alias("item")))
    return whole.select("host_id", *fields, F.inline(F.concat(marks, each)))


def compared(captures: DataFrame, processor: type[Compared], silent_days: float | None = None, delay: str = "40 days", shards: int = 1) -> DataFrame:
    """The lifecycle rows of a stream (host_id, snapshot_id, observed_at, status, items): one row a snapshot, its rows as an array.

    Items of services have name, load_state, active_state, sub_state and valid; those of processes pid, lifetime_id,
    rss_bytes and virtual_memory_bytes. ``delay``, with ``silent_days``, is how late a snapshot may come. ``shards``: into how
    many a host's items are dealt, the same as long as the state lives; a task holds one shard of a batch. Start the query
    inside of ``rocksdb``.
    """
    timed = captures if silent_days is None else captures.withWatermark("observed_at", delay)
    mode = "None" if silent_days is None else "EventTime"
    return dealt(timed, processor, shards).groupBy("host_id", "shard").transformWithState(processor(silent_days), processor.OUT, "Append", mode)
