"""From lifecycle changes and journal events to incident candidates with bounded evidence.

Rule id, states and bounds are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlore.functions.scalars import bounded, digest, iso, valid_service_name, valid_state

RULE_ID = "service-condition-v1"
BAD_STATES = ("failed", "inactive", "deactivating")
MAX_SUMMARY = 512


def no_limits() -> Column:
    return F.array().cast("array<string>")


def plain_state(state: str) -> Column:
    """load/active/sub of an observation, or absent."""
    return F.when(F.col(state).isNull(), "absent").otherwise(F.concat_ws("/", f"{state}.load_state", f"{state}.active_state", f"{state}.sub_state"))


def consistent(df: DataFrame) -> Column:
    """A valid name, at least one observation, and plain states in each."""
    fine = lambda s: F.col(s).isNull() | (
        valid_state(F.col(f"{s}.load_state")) & valid_state(F.col(f"{s}.active_state")) & valid_state(F.col(f"{s}.sub_state"))
    )
    return valid_service_name(F.col("name")) & (F.col("previous").isNotNull() | F.col("current").isNotNull()) & fine("previous") & fine("current")


def identified(changes: DataFrame) -> DataFrame:
    """Service changes with ``change_id`` and quality limitations (none where the column is missing)."""
    if "limitations" not in changes.columns:
        changes = changes.withColumn("limitations", no_limits())
    return changes.withColumn(
        "change_id",
        F.concat(
            F.lit("service:"),
            digest(
                "service-change-v1", F.col("name"), iso(F.col("observed_at")), F.col("lifecycle"), plain_state("previous"), plain_state("current")
            ),
        ),
    )


def process_change_id() -> Column:
    return F.concat(F.lit("process:"), digest("process-change-v1", F.col("lifetime_id"), iso(F.col("observed_at")), F.col("lifecycle")))


def split_conflicts(rows: DataFrame, keys: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows once for each key, and the keys that come with different values."""
    whole = F.struct(*values)
    counted = rows.groupBy(*keys).agg(F.min(whole).alias("v"), F.max(whole).alias("w"))
    clean = counted.where(F.col("v").eqNullSafe(F.col("w"))).select(*keys, "v.*")
    return clean, counted.where(~F.col("v").eqNullSafe(F.col("w"))).select(*keys)


def dedup_service_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_conflicts(identified(changes), ["host_id", "change_id"], ["name", "observed_at", "lifecycle", "previous", "current", "limitations"])


def dedup_process_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes without a lifetime are left out."""
    if "limitations" not in changes.columns:
        changes = changes.withColumn("limitations", no_limits())
    return split_conflicts(changes.where("lifetime_id is not null"), ["host_id", "lifetime_id", "observed_at", "lifecycle"], ["pid", "limitations"])


def dedup_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each cursor; only valid units and cursors that aren't blank."""
    if "warnings" not in events.columns:
        events = events.withColumn("warnings", no_limits())
    usable = events.where(valid_service_name(F.col("unit")) & (F.length("cursor") > 0))
    return split_conflicts(usable, ["host_id", "cursor"], ["observed_at", "source", "priority", "unit", "pid", "comm", "message", "boot_id", "warnings"])


def service_associations(associations: DataFrame) -> DataFrame:
    """Distinct, well-formed (service, lifetime) pairs."""
    return associations.where(
        valid_service_name(F.col("service_name")) & F.col("lifetime_id").rlike("^[1-9][0-9]*:[0-9]+$") & (F.length("lifetime_id") <= 64)
    ).select("host_id", "service_name", "lifetime_id").distinct()


def quality_aware(changes: DataFrame, results: DataFrame, collector: str) -> DataFrame:
    """Adds "<collector>_collection_<status>" to changes of a collection that wasn't a full success."""
    if "limitations" not in changes.columns:
        changes = changes.withColumn("limitations", no_limits())
    status = results.where(F.col("collector_name") == collector).select("host_id", "snapshot_id", "status")
    word = F.when(F.col("status") != "success", F.array(F.concat(F.lit(f"{collector}_collection_"), F.col("status")))).otherwise(no_limits())
    return changes.join(status, ["host_id", "snapshot_id"]).withColumn("limitations", F.array_sort(F.array_union("limitations", word)))


def incident_anchors(changes: DataFrame) -> DataFrame:
    """Consistent changes that open an incident: removals, and changes into a bad state."""
    opens = ((F.col("lifecycle") == "removed") & F.col("previous").isNotNull() & F.col("current").isNull()) | (
        (F.col("lifecycle") == "state_changed") & F.col("current.active_state").isin(*BAD_STATES)
    )
    return changes.where(F.coalesce(consistent(changes) & opens, F.lit(False)))


def resolution_subjects(changes: DataFrame) -> DataFrame:
    """Services that changed back to active, once each per snapshot."""
    back = (F.col("lifecycle") == "state_changed") & (F.col("current.active_state") == "active")
    return changes.where(F.coalesce(consistent(changes) & back, F.lit(False))).select("host_id", "snapshot_id", F.col("name").alias("subject_id")).distinct()


def near(anchors: DataFrame, items: DataFrame, keys: list[str], window_us: int) -> DataFrame:
    """Pairs of anchors and items with equal keys at most ``window_us`` apart, ends included.

    Time is cut into buckets as wide as the window and an anchor looks in three, so a busy key is spread over its
    buckets instead of meeting in one task. Both sides carry ``t`` in microseconds.
    """
    width = max(window_us, 1)
    slots = F.explode(F.array(*(F.floor(F.col("t") / width) + k for k in (-1, 0, 1))))
    left = anchors.withColumn("slot", slots)
    right = items.withColumnRenamed("t", "item_t").withColumn("slot", F.floor(F.col("item_t") / width))
    return left.join(right, [*keys, "slot"]).where(F.abs(F.col("item_t") - F.col("t")) <= window_us).drop("slot")


def numbered(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items with two numbers in their ``slot``: ``back`` counts so that walking down from a number meets equal times by
    rising ``tie``, ``ahead`` so that walking up does."""
    own = Window.partitionBy(*keys, "slot")
    return items.withColumns({"back": F.row_number().over(own.orderBy("item_t", F.desc("tie"))), "ahead": F.row_number().over(own.orderBy("item_t", "tie"))})


def lookups(asks: DataFrame, items: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, t, slot, side, number): the numbers of items that each of ``asks`` (keys, t, slot) needs, all of which are there."""
    # one sorted run of items and anchors in each slot; at equal times items come first
    run = items.select(*keys, "slot", F.col("item_t").alias("at"), F.lit(0).alias("is_ask"))
    run = run.unionByName(asks.select(*keys, "slot", F.col("t").alias("at"), F.lit(1).alias("is_ask")))
    own = Window.partitionBy(*keys, "slot")
    before = F.sum(1 - F.col("is_ask")).over(own.orderBy("at", "is_ask").rowsBetween(Window.unboundedPreceding, 0))
    n, none, names = F.col("n"), F.lit(0).cast("long"), ("size", "size_before", "size_after")
    told = lambda step, name: F.struct((F.col("slot") + step).alias("slot"), *((n if c == name else none).alias(c) for c in names))
    sizes = items.groupBy(*keys, "slot").agg(F.count("*").alias("n")).select(*keys, F.inline(F.array(*map(told, (0, 1, -1), names))))
    sizes = sizes.groupBy(*keys, "slot").agg(*(F.sum(c).alias(c) for c in names))
    counted = run.withColumn("passed", before).where("is_ask = 1").select(*keys, "slot", F.col("at").alias("t"), "passed")
    counted = counted.join(sizes, [*keys, "slot"], "left").withColumns({c: F.coalesce(c, none) for c in names})

    passed, size, prior, following = (F.col(c).cast("long") for c in ("passed", "size", "size_before", "size_after"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    numbers = lambda low, high: F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    wants = lambda side, step, found: F.transform(
        found, lambda n: F.struct(F.lit(side).alias("side"), (F.col("slot") + step).alias("in_slot"), n.alias("number"))
    )
    asked = F.concat(
        wants("back", 0, numbers(F.greatest(passed - most + 1, one), passed)),
        wants("back", -1, numbers(F.greatest(prior - F.greatest(most - passed, zero) + 1, one), prior)),
        wants("ahead", 0, numbers(passed + 1, F.least(passed + most, size))),
        wants("ahead", 1, numbers(one, F.least(F.greatest(most - (size - passed), zero), following))),
    )
    return counted.select(*keys, "t", F.inline(asked)).withColumnRenamed("in_slot", "slot")


def nearest(anchors: DataFrame, items: DataFrame, keys: list[str], window_us: int, most: int, tie: Column) -> DataFrame:
    """What ``near`` gives, but of each anchor only the ``most`` items before or at its time and the ``most`` after it.

    Items are numbered within their slots, which are as wide as the window. An anchor learns from a merge with its slot how
    many items stand before it and how many the slot has; that names the numbers that it needs there, and how many more it
    needs of the slots beside, whose sizes it knows too. So an anchor asks for 2 x ``most`` numbers at most and for none that
    isn't there, each an ordinary join key, however many items its window has. Items of slots that no anchor looks in
    are left out before they are sorted. ``tie``: text by which items of equal distance and time are ordered, unique in a key.
    """
    width = max(window_us, 1)
    left = anchors.select(*keys, "t").distinct().withColumn("slot", F.floor(F.col("t") / width))
    looked_in = left.select(*keys, F.explode(F.array(*(F.col("slot") + k for k in (-1, 0, 1)))).alias("slot")).distinct()
    slotted = items.withColumnRenamed("t", "item_t").withColumns({"tie": tie, "slot": F.floor(F.col("item_t") / width)})
    slotted = slotted.join(looked_in, [*keys, "slot"], "left_semi")
    right = numbered(slotted, keys)
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).cast("long").alias("number")) for s in ("back", "ahead"))))
    offered = right.withColumn("s", sides).select("*", "s.*").drop("s", "back", "ahead", "tie")
    found = lookups(left, slotted, keys, most).join(offered, [*keys, "slot", "side", "number"]).drop("slot", "side", "number")
    return anchors.join(found, [*keys, "t"]).where(F.abs(F.col("item_t") - F.col("t")) <= window_us)


EVIDENCE = ["kind", "evidence_id", "evidence_at", "reason", "summary", "fact", "evidence_limitations"]


def anchored(changes: DataFrame) -> DataFrame:
    return incident_anchors(identified(changes)).select(
        "host_id", "change_id", "name", "observed_at", "lifecycle", "previous", "current", "limitations", F.unix_micros("observed_at").alias("t")
    )


def event_evidence(anchors: DataFrame, events: DataFrame, window_us: int, most: int | None = None) -> DataFrame:
    """Journal events of exactly the anchor's unit within the window; with ``most``, the nearest so many on each side."""
    if "warnings" not in events.columns:
        events = events.withColumn("warnings", no_limits())
    items = events.select(
        "host_id",
        F.col("unit").alias("name"),
        "cursor",
        "priority",
        F.col("observed_at").alias("evidence_at"),
        "warnings",
        F.unix_micros("observed_at").alias("t"),
    )
    detail = F.concat(
        F.lit("journal event"), F.when(F.col("priority").isNotNull(), F.concat(F.lit(" priority "), F.col("priority").cast("string"))).otherwise("")
    )
    keys = ["host_id", "name"]
    found = near(anchors, items, keys, window_us) if most is None else nearest(anchors, items, keys, window_us, most, F.col("cursor"))
    return found.select(
        *anchors.columns,
        "item_t",
        F.lit("journal_event").alias("kind"),
        F.concat(F.lit("journal:"), "cursor").alias("evidence_id"),
        "evidence_at",
        F.lit("service_unit_match").alias("reason"),
        F.substring(detail, 1, MAX_SUMMARY).alias("summary"),
        F.lit("journal_unit_event").alias("fact"),
        bounded(F.col("warnings"), "quality_limitations_truncated").alias("evidence_limitations"),
    )


def events_for_anchors(found: DataFrame, limit: int = 1000) -> DataFrame:
    """(host_id, observed_at, evidence_id, evidence_at, truncated): the events in the windows of a snapshot's anchors, once.

    ``found``: rows of ``event_evidence``. Of each host and snapshot the earliest ``limit``; ``truncated`` tells that some went.
    """
    each = found.select("host_id", "observed_at", "evidence_id", "evidence_at").distinct()
    w = Window.partitionBy("host_id", "observed_at")
    placed = each.withColumns({"place": F.row_number().over(w.orderBy("evidence_at", "evidence_id")), "truncated": F.count("*").over(w) > limit})
    return placed.where(F.col("place") <= limit).drop("place")


def process_evidence(anchors: DataFrame, changes: DataFrame, associations: DataFrame, window_us: int, most: int | None = None) -> DataFrame:
    """New, exited and changed lifetimes that are explicitly associated with the anchor's service; ``most`` as for events, by lifetime."""
    if "limitations" not in changes.columns:
        changes = changes.withColumn("limitations", no_limits())
    usable = changes.where(F.col("lifecycle").isin("new", "exited", "identity_changed") & F.col("lifetime_id").isNotNull())
    items = usable.select(
        "host_id",
        "lifetime_id",
        F.col("lifecycle").alias("p_lifecycle"),
        process_change_id().alias("evidence_id"),
        F.col("observed_at").alias("evidence_at"),
        F.array_sort(F.array_distinct("limitations")).alias("evidence_limitations"),
        F.unix_micros("observed_at").alias("t"),
    )
    fact = F.when(
        F.col("p_lifecycle") == "exited", "process_exited"
    ).when(F.col("p_lifecycle") == "new", "process_started").otherwise("process_identity_changed")
    linked = anchors.join(service_associations(associations).withColumnRenamed("service_name", "name"), ["host_id", "name"])
    keys = ["host_id", "lifetime_id"]
    found = near(linked, items, keys, window_us) if most is None else nearest(linked, items, keys, window_us, most, F.col("evidence_id"))
    return found.select(
        *anchors.columns,
        "item_t",
        F.lit("process_change").alias("kind"),
        "evidence_id",
        "evidence_at",
        F.lit("explicit_process_association").alias("reason"),
        F.substring(F.concat(F.lit("associated process lifetime "), "lifetime_id", F.lit(" "), "p_lifecycle"), 1, MAX_SUMMARY).alias("summary"),
        fact.alias("fact"),
        "evidence_limitations",
    )


def ranked_evidence(related: DataFrame, most: int) -> DataFrame:
    """The ``most`` - 1 closest per anchor by distance, time, kind and id."""
    w = Window.partitionBy("host_id", "change_id").orderBy(F.abs(F.col("item_t") - F.col("t")), "item_t", "kind", "evidence_id")
    return related.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most - 1)


def anchor_evidence(anchors: DataFrame) -> DataFrame:
    """The anchors themselves as evidence."""
    fact = F.when(F.col("lifecycle") == "removed", "service_removed").otherwise(F.concat(F.lit("service_"), F.col("current.active_state")))
    summary = F.concat(F.lit("service "), "lifecycle", F.lit(": "), plain_state("previous"), F.lit(" -> "), plain_state("current"))
    return anchors.select(
        *anchors.columns,
        F.col("t").alias("item_t"),
        F.lit("service_change").alias("kind"),
        F.col("change_id").alias("evidence_id"),
        F.col("observed_at").alias("evidence_at"),
        F.lit("service_change_anchor").alias("reason"),
        F.substring(summary, 1, MAX_SUMMARY).alias("summary"),
        fact.alias("fact"),
        F.array_sort(F.array_distinct("limitations")).alias("evidence_limitations"),
    )


def anchors_and_ranked(anchors: DataFrame, related: DataFrame, most: int) -> DataFrame:
    """The anchors that have something related, as evidence, with the ``most`` - 1 closest by distance, time, kind and id."""
    rows = anchor_evidence(anchors).withColumn("related", F.lit(False)).unionByName(related.withColumn("related", F.lit(True)))
    with_any = F.max("related").over(Window.partitionBy("host_id", "change_id"))
    w = Window.partitionBy("host_id", "change_id", "related").orderBy(F.abs(F.col("item_t") - F.col("t")), "item_t", "kind", "evidence_id")
    placed = rows.withColumn("with_any", with_any).where("with_any").withColumn("place", F.row_number().over(w))
    return placed.where(~F.col("related") | (F.col("place") <= most - 1)).drop("related", "with_any", "place")


def incident_id() -> Column:
    return digest("incident-v1", RULE_ID, F.col("name"), F.col("change_id"))


def correlate(changes: DataFrame, process_changes: DataFrame, events: DataFrame, associations: DataFrame, window_us: int, most: int = 32) -> DataFrame:
    """Evidence rows of all candidates: (host_id, incident_id, name, started_at, limitations, evidence ...).

    A candidate needs one related item besides its anchor. Nearness in time alone never relates.
    """
    return correlate_anchors(anchored(changes), process_changes, events, associations, window_us, most)


def correlate_anchors(anchors: DataFrame, process_changes: DataFrame, events: DataFrame, associations: DataFrame, window_us: int, most: int = 32) -> DataFrame:
    """``correlate`` for rows of ``anchored``. They are read several times, so callers with many should have stored them."""
    found = event_evidence(anchors, events, window_us, most - 1)
    related = found.unionByName(process_evidence(anchors, process_changes, associations, window_us, most - 1))
    return anchors_and_ranked(anchors, related, most).select(
        "host_id",
        incident_id().alias("incident_id"),
        F.col("name").alias("subject_id"),
        F.col("observed_at").alias("started_at"),
        "limitations",
        *EVIDENCE,
    )


def candidates(evidence: DataFrame, journal_status: DataFrame | None = None) -> DataFrame:
    """One row per candidate; ``journal_status`` (host_id, at, status) adds its limitation where it wasn't a success."""
    keys = ["host_id", "incident_id", "subject_id", "started_at"]
    rows = evidence.groupBy(*keys).agg(
        F.max("evidence_at").alias("last_observed_at"),
        F.count("*").alias("n_evidence"),
        F.flatten(F.collect_set("evidence_limitations")).alias("e"),
        F.flatten(F.collect_set("limitations")).alias("own"),
    )
    extra = no_limits()
    if journal_status is not None:
        rows = rows.join(journal_status.select("host_id", F.col("at").alias("started_at"), "status"), ["host_id", "started_at"], "left")
        extra = F.when(F.coalesce(F.col("status") != "success", F.lit(False)), F.array(F.concat(F.lit("journal_collection_"), "status"))).otherwise(no_limits())
    return rows.select(
        "host_id",
        "incident_id",
        F.lit(RULE_ID).alias("rule_id"),
        F.lit("service").alias("subject_type"),
        "subject_id",
        F.lit("active").alias("state"),
        "started_at",
        "last_observed_at",
        F.lit(None).cast("timestamp").alias("resolved_at"),
        bounded(F.concat("own", "e", extra), "quality_limitations_truncated").alias("limitations"),
        "n_evidence",
    )
