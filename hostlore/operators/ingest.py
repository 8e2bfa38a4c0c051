"""Raw captures of many hosts parsed into observation tables.

Every parser takes captures (host_id, snapshot_id, payload) and returns the observation columns with ``valid``. A capture that
breaks its format is kept with valid = false and null values, for ``collection_status``; nothing unknown becomes zero.
Numbers are plain decimal digits with an optional minus sign; other spellings of whole numbers are malformed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlore.functions.scalars import MAX_MESSAGE_BYTES, MAX_PID, REDACTED, decode_bytes, from_epoch_micros, normalised, optional_int, redact, redact_to
from hostlore.operators import chain
from hostlore.operators.temporal import TICKS

KEY = ["host_id", "snapshot_id"]
#: The order of collectors in a snapshot.
COLLECTORS = ("system", "memory", "cpu", "processes", "disk", "network", "services")
MEMORY = {
    "MemTotal": "total_bytes",
    "MemAvailable": "available_bytes",
    "MemFree": "free_bytes",
    "Buffers": "buffers_bytes",
    "Cached": "cached_bytes",
    "SwapTotal": "swap_total_bytes",
    "SwapFree": "swap_free_bytes",
}
#: Columns of /proc/net/dev by field number.
NETWORK = {
    0: "receive_bytes",
    8: "transmit_bytes",
    1: "receive_packets",
    9: "transmit_packets",
    2: "receive_errors",
    10: "transmit_errors",
    3: "receive_drops",
    11: "transmit_drops",
}
COMMAND_CHARS = 1024
MAX_CURSOR_BYTES = 1024
PAGE_BYTES = 4096


def whole(text: Column) -> Column:
    return F.when(text.rlike("^-?[0-9]+$"), text.try_cast("bigint"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def lines(captures: DataFrame) -> DataFrame:
    return captures.select("*", F.posexplode(F.split("payload", "\r?\n")).alias("pos", "line"))


def only_valid(values: dict[str, Column]) -> list[Column]:
    return [F.when(F.col("valid"), c).alias(name) for name, c in values.items()]


def parse_cpu(captures: DataFrame) -> DataFrame:
    """The aggregate line: at least four counters, none negative; missing later ones are 0, further ones are ignored."""
    fields = words(F.regexp_extract("payload", r"(?m)^cpu (.*)$", 1))
    numbers = F.transform(fields, whole)
    rows = captures.withColumns({"n": numbers, "valid": (F.size(fields) >= 4) & F.forall(numbers, lambda x: F.coalesce(x >= 0, F.lit(False)))})
    return rows.select(*KEY, "valid", *only_valid({t: F.coalesce(F.get("n", F.lit(i)), F.lit(0)) for i, t in enumerate(TICKS)}))


def parse_memory(captures: DataFrame) -> DataFrame:
    """``Key: n [kB]``; the last of equal keys counts, total, available and free are needed, the others may be null."""
    parts = words(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    unit = F.lower(F.coalesce(F.get("parts", F.lit(1)), F.lit("b")))
    rows = lines(captures).withColumn("parts", parts).where((F.instr("line", ":") > 0) & (F.size("parts") > 0))
    rows = rows.withColumns({"key": F.regexp_extract("line", "^([^:]*):", 1), "unit": unit, "n": whole(F.get("parts", F.lit(0)))})
    rows = rows.withColumns(
        {"ok": F.col("n").isNotNull() & F.col("unit").isin("kb", "b"), "value": F.col("n") * F.when(F.col("unit") == "kb", 1024).otherwise(1)}
    )
    picked = rows.groupBy(*KEY).agg(
        F.every("ok").alias("ok"),
        *(F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("pos"))).alias(c) for k, c in MEMORY.items()),
    )
    needed = F.col("total_bytes").isNotNull() & F.col("available_bytes").isNotNull() & F.col("free_bytes").isNotNull()
    joined = captures.select(*KEY).join(picked, KEY, "left").withColumn("valid", F.coalesce(F.col("ok") & needed, F.lit(False)))
    return joined.select(*KEY, "valid", *only_valid({c: F.col(c) for c in MEMORY.values()}))


def parse_network(captures: DataFrame) -> DataFrame:
    """One row per interface; any malformed line makes the whole capture invalid, which then has one row without values."""
    fields = words(F.regexp_extract("line", r"(?s)^[^:]*:(.*)$", 1))
    rows = lines(captures.withColumn("payload", F.regexp_replace("payload", r"\n$", ""))).where("pos >= 2").withColumn("n", F.transform(fields, whole))
    rows = rows.withColumn("ok", (F.instr("line", ":") > 0) & (F.size("n") >= 16) & F.forall("n", lambda x: F.coalesce(x >= 0, F.lit(False))))
    rows = rows.withColumn("valid", F.every("ok").over(Window.partitionBy(*KEY)))
    good = rows.where("valid").select(
        *KEY,
        "valid",
        F.trim(F.regexp_extract("line", "^([^:]*):", 1)).alias("interface"),
        *(F.get("n", F.lit(i)).alias(c) for i, c in NETWORK.items()),
    )
    bad = rows.where("not valid").select(*KEY, "valid").distinct()
    return good.unionByName(bad, allowMissingColumns=True)


def parse_processes(captures: DataFrame, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """(pid, stat, cmdline, executable) of processes; the name is between the first and the last parenthesis."""
    f = words(F.regexp_extract("stat", r"(?s)^[^(]*\(.*\)(?:.?)(.*)$", 1))
    rows = captures.withColumns({"name": F.regexp_extract("stat", r"(?s)^[^(]*\((.*)\)", 1), "f": f})
    at = lambda i: whole(F.get("f", F.lit(i)))
    numbers = {"ppid": at(1), "utime": at(11), "stime": at(12), "threads": at(17), "start_time_ticks": at(19), "virtual_memory_bytes": at(20), "pages": at(21)}
    rows = rows.withColumns(numbers).withColumn(
        "valid", F.col("stat").rlike(r"(?s)\(.*\)") & (F.size("f") >= 22) & F.forall(F.array(*numbers), lambda x: x.isNotNull())
    )
    command = F.trim(F.translate("cmdline", "\0", " "))
    return rows.select(
        *KEY,
        "pid",
        "valid",
        *only_valid(
            {
                "ppid": F.col("ppid").cast("int"),
                "name": F.col("name"),
                "state": F.get("f", F.lit(0)),
                "rss_bytes": F.col("pages") * page_bytes,
                "virtual_memory_bytes": F.col("virtual_memory_bytes"),
                "threads": F.col("threads").cast("int"),
                "cpu_time_ticks": F.col("utime") + F.col("stime"),
                "start_time_ticks": F.col("start_time_ticks"),
                "command": F.when(command != "", redact_to(command, COMMAND_CHARS)),
                "executable": F.col("executable"),
                "lifetime_id": F.concat_ws(":", "pid", "start_time_ticks"),
            }
        ),
    )


def parse_services(captures: DataFrame) -> DataFrame:
    """name load active sub description; a short line, a bad name or a repeated one makes the whole capture invalid."""
    f = words(F.col("line"))
    rows = lines(captures).withColumn("f", f).where(F.size("f") > 0).withColumn("name", F.get("f", F.lit(0)))
    w = Window.partitionBy(*KEY)
    plain = F.forall(F.slice("f", 1, 4), lambda x: ~x.rlike(r"[\x00-\x1f]"))
    rows = rows.withColumn("same", F.count("*").over(Window.partitionBy(*KEY, "name"))).withColumn(
        "ok", (F.size("f") >= 4) & F.col("name").endswith(".service") & (F.col("name") != ".service") & (F.col("same") == 1) & plain
    )
    rows = rows.withColumn("valid", F.every("ok").over(w))
    good = rows.where("valid").select(
        *KEY,
        "valid",
        "name",
        F.get("f", F.lit(1)).alias("load_state"),
        F.get("f", F.lit(2)).alias("active_state"),
        F.get("f", F.lit(3)).alias("sub_state"),
    )
    return good.unionByName(rows.where("not valid").select(*KEY, "valid").distinct(), allowMissingColumns=True)


def parse_uptime(captures: DataFrame) -> DataFrame:
    """The first number, not negative."""
    value = F.get(words(F.col("payload")), F.lit(0)).try_cast("double")
    return captures.withColumn("uptime_seconds", value).withColumn("valid", F.coalesce(F.col("uptime_seconds") >= 0, F.lit(False))).select(
        *KEY, "valid", *only_valid({"uptime_seconds": F.col("uptime_seconds")})
    )


def disk_usage(disks: DataFrame) -> DataFrame:
    """Bytes from blocks: total, free, and what is between them."""
    total, free = F.col("blocks") * F.col("fragment_bytes"), F.col("available_blocks") * F.col("fragment_bytes")
    return disks.select(*KEY, "path", total.alias("total_bytes"), (total - free).alias("used_bytes"), free.alias("free_bytes"))


#: Fixed names: fields of a journal record; of some it must be known whether they are text.
JOURNAL_TEXTS = ("__CURSOR", "PRIORITY", "_PID")
JOURNAL_FIELDS = (
    *JOURNAL_TEXTS,
    "__REALTIME_TIMESTAMP",
    "MESSAGE",
    "SYSLOG_IDENTIFIER",
    "_SYSTEMD_UNIT",
    "_SYSTEMD_USER_UNIT",
    "_COMM",
    "_BOOT_ID",
)


def parse_journal(records: DataFrame) -> DataFrame:
    """Journal JSON (host_id, page, pos, payload) as events. Warnings tell what was redacted or cut.

    A record is valid with a text cursor of 1 to 1024 bytes, a time in epoch microseconds, and a priority and pid that are
    text in range or missing. Duplicate keys in a record are malformed here.
    """
    # a step for each kind of work, as an expression that is used in several places of one step is computed in each of them
    rows = records.withColumn("v", F.try_parse_json("payload"))
    rows = rows.withColumns({f"f_{name}": F.try_variant_get(F.col("v"), f"$.{name}", "variant") for name in JOURNAL_FIELDS})
    field = lambda name: F.col(f"f_{name}")
    rows = rows.withColumns({f"k_{name}": F.schema_of_variant(field(name)) for name in JOURNAL_TEXTS})
    is_text = lambda name: field(name).isNull() | F.is_variant_null(field(name)) | (F.col(f"k_{name}") == "STRING")
    text = lambda name: F.when(F.col(f"k_{name}") == "STRING", F.try_variant_get(field(name), "$", "string"))
    rows = rows.withColumns(
        {
            "cursor": text("__CURSOR"),
            "r_time": decode_bytes(field("__REALTIME_TIMESTAMP")),
            "r_message": decode_bytes(field("MESSAGE")),
            "r_source": F.when(field("SYSLOG_IDENTIFIER").isNull(), F.lit("journal")).otherwise(decode_bytes(field("SYSLOG_IDENTIFIER"))),
            "r_system": decode_bytes(field("_SYSTEMD_UNIT")),
            "r_comm": decode_bytes(field("_COMM")),
            "r_boot_id": decode_bytes(field("_BOOT_ID")),
            "t_priority": text("PRIORITY"),
            "t_pid": text("_PID"),
            "text_ok": is_text("PRIORITY") & is_text("_PID"),
        }
    )
    unit = F.when(F.coalesce("r_system", F.lit("")) != "", F.col("r_system")).otherwise(decode_bytes(field("_SYSTEMD_USER_UNIT")))
    rows = rows.withColumns({"r_unit": unit, "at": from_epoch_micros(F.col("r_time")), **{f"c_{n}": redact(F.col(f"r_{n}")) for n in REDACTED}})
    priority, priority_ok = optional_int(F.col("t_priority"), 7)
    pid, pid_ok = optional_int(F.col("t_pid"), MAX_PID)
    names = ("message", "source", "unit", "comm", "boot_id")
    valid = F.col("v").isNotNull() & F.coalesce(
        (F.octet_length("cursor").between(1, MAX_CURSOR_BYTES)) & (F.instr("cursor", "\0") == 0), F.lit(False)
    ) & F.col("at").isNotNull() & F.col("text_ok") & priority_ok & pid_ok
    for n in names:
        valid = valid & F.col(f"r_{n}").isNotNull()
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    clean = {
        n: normalised(n, F.col(f"r_{n}"), MAX_MESSAGE_BYTES if n == "message" else 512, F.col(f"c_{n}" if n in REDACTED else f"r_{n}")) for n in names
    }
    some = lambda n: F.when(clean[n][0] != "", clean[n][0])
    keep = [c for c in records.columns if c != "payload"]
    return rows.select(
        *keep,
        "valid",
        *only_valid(
            {
                "cursor": F.col("cursor"),
                "observed_at": F.col("at"),
                "source": clean["source"][0],
                "priority": priority.cast("int"),
                "unit": some("unit"),
                "pid": pid.cast("int"),
                "comm": some("comm"),
                "message": clean["message"][0],
                "boot_id": some("boot_id"),
                "warnings": F.concat(*(clean[n][1] for n in names)),
            }
        ),
    )


def collection_status(captures: DataFrame, parsed: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Status per snapshot of a parsed capture: success when every row is valid, also of a capture without rows; else invalid_data.

    ``captures`` (host_id, snapshot_id): all that were made. ``failures`` (host_id, snapshot_id, source_status) names those that
    couldn't be read: permission_denied stays, anything else is transient_failure.
    """
    rows = captures.select(*KEY).distinct().join(parsed.groupBy(*KEY).agg(F.every("valid").alias("ok")), KEY, "left")
    rows = rows.select(*KEY, F.when(F.coalesce("ok", F.lit(True)), "success").otherwise("invalid_data").alias("status"))
    if failures is None:
        return rows
    bad = failures.select(*KEY, F.when(F.col("source_status") == "permission_denied", "permission_denied").otherwise("transient_failure").alias("failed"))
    return rows.join(bad, KEY, "full_outer").select(*KEY, F.coalesce("failed", "status").alias("status"))


#: Why a process could not be read, and what the warning says; fixed values.
UNREADABLE = {"malformed": "returned malformed data", "vanished": "disappeared during collection", "inaccessible": "was inaccessible"}


def process_status(parsed: DataFrame, unreadable: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Processes are tolerant: a bad one is skipped with a warning and makes the collection partial.

    ``unreadable`` (host_id, snapshot_id, pid, problem): processes that vanished or were inaccessible. With ``limit``, only so
    many of the lowest pids are looked at, and one more makes the collection partial as well.
    """
    rows = parsed.select(*KEY, "pid", F.when(~F.col("valid"), "malformed").alias("problem"))
    if unreadable is not None:
        rows = rows.unionByName(unreadable.select(*KEY, "pid", "problem"))
    if limit is not None:
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy("pid")))
    place = F.col("place") if limit is not None else F.lit(0)
    seen = F.lit(True) if limit is None else place <= limit
    text = F.element_at(F.create_map(*(F.lit(x) for pair in UNREADABLE.items() for x in pair)), F.col("problem"))
    warning = F.when(seen & F.col("problem").isNotNull(), F.concat(F.lit("process "), F.col("pid").cast("string"), F.lit(" "), text))
    if limit is not None:
        warning = F.when(place == limit + 1, F.lit(f"process observation limit reached ({limit})")).otherwise(warning)
    out = rows.groupBy(*KEY).agg(F.count_if(seen & F.col("problem").isNull()).alias("n_valid"), F.array_sort(F.collect_list(warning)).alias("warnings"))
    return out.withColumn("status", F.when(F.size("warnings") > 0, "partial").otherwise("success"))


def lowest_pids(processes: DataFrame, most: int) -> DataFrame:
    """The ``most`` lowest pids of a snapshot; ``limited`` tells that there were more."""
    w = Window.partitionBy(*KEY)
    return processes.withColumns(
        {"place": F.row_number().over(w.orderBy("pid")), "limited": F.count("*").over(w) > most}
    ).where(F.col("place") <= most).drop("place")


def accept_pages(records: DataFrame, saved: DataFrame, limit: int, pages: DataFrame | None = None) -> DataFrame:
    """Per page (host_id, page): outcome, accepted records and next cursor. Records: (host_id, page, pos, cursor, valid).

    Where a cursor is saved (host_id, page, saved), the page must begin with it. A malformed record or a repeated cursor
    refuses the page; more than ``limit`` records, or one with ``warned`` (if there is such a column), make it partial.
    ``pages`` (host_id, page) names all that were read: one without records is a success, but not under a saved cursor.
    """
    key = ["host_id", "page"]
    w = Window.partitionBy(*key)
    if "warned" not in records.columns:
        records = records.withColumn("warned", F.lit(False))
    rows = records.join(saved, key, "left").withColumn("rank", F.row_number().over(w.orderBy("pos")))
    skipped = F.when(F.col("saved").isNotNull(), 1).otherwise(0)
    taken = (F.col("rank") > skipped) & (F.col("rank") <= skipped + limit)
    agg = rows.groupBy(*key).agg(
        F.max(F.when(F.col("rank") == 1, F.col("cursor"))).alias("first"),
        F.every("valid").alias("ok"),
        F.count("*").alias("n"),
        F.countDistinct("cursor").alias("distinct"),
        F.max(taken & F.col("warned")).alias("warned"),
        F.max(F.when(F.col("rank") == skipped + limit, F.col("cursor"))).alias("at_limit"),
        F.max_by("cursor", "rank").alias("last"),
    )
    every = (agg if pages is None else pages).select(*key).distinct()
    out = every.join(agg, key, "left").join(saved, key, "left").withColumns(
        {"n": F.coalesce("n", F.lit(0)), "distinct": F.coalesce("distinct", F.lit(0)), "ok": F.coalesce("ok", F.lit(True))}
    )
    more = F.col("n") - skipped > limit
    outcome = (
        F.when(~F.col("ok"), "journal_invalid").when(
            F.col("saved").isNotNull() & ~F.col("first").eqNullSafe(F.col("saved")), "journal_cursor_invalidated"
        ).when(
            F.col("distinct") < F.col("n"), "journal_duplicate_cursor"
        ).when(more | F.coalesce("warned", F.lit(False)), "partial").otherwise("success")
    )
    out = out.withColumn("outcome", outcome)
    fine = F.col("outcome").isin("partial", "success")
    end = F.coalesce(F.when(more, F.col("at_limit")).otherwise(F.col("last")), F.col("saved"))
    return out.select(
        *key,
        "outcome",
        F.when(fine, F.least(F.col("n") - skipped, F.lit(limit))).otherwise(0).alias("accepted"),
        F.when(fine, end).otherwise(F.col("saved")).alias("next_cursor"),
    )


def accept_page_chain(records: DataFrame, limit: int, saved: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """``accept_pages`` for all pages of each host in order: the cursor that a page meets is what the pages before it left.

    ``saved`` (host_id, saved): cursors that are stored before the first page; other hosts have none. A refused page
    leaves the cursor as it is, so a later page that begins with it is accepted.
    """
    key = ["host_id", "page"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("pos"))
    agg = records.withColumn("rank", rank).groupBy(*key).agg(
        F.min_by("cursor", "rank").alias("first"),
        F.every("valid").alias("ok"),
        F.count("*").alias("n"),
        F.countDistinct("cursor").alias("distinct"),
        F.max(F.when(F.col("rank") == limit, F.col("cursor"))).alias("at_limit"),
        F.max(F.when(F.col("rank") == limit + 1, F.col("cursor"))).alias("after_limit"),
        F.max_by("cursor", "rank").alias("last"),
    )
    fine = agg.where(F.col("ok") & (F.col("distinct") == F.col("n")))
    none = F.lit(None).cast("string")
    # a page has two ways in: from its first cursor, which isn't taken again, or with nothing saved yet
    known = fine.select("host_id", (F.col("page") * 2).alias("place"), F.col("first").alias("enter"), F.coalesce("after_limit", "last").alias("leave"))
    fresh = fine.select("host_id", (F.col("page") * 2 + 1).alias("place"), none.alias("enter"), F.coalesce("at_limit", "last").alias("leave"))
    every = (agg if pages is None else pages).select(*key).distinct()
    start = every.select("host_id").distinct()
    start = start.withColumn("state", none) if saved is None else start.join(saved.select("host_id", F.col("saved").alias("state")), "host_id", "left")
    steps = chain.stored(known.unionByName(fresh), "page-steps")
    on_path = steps.join(chain.taken(steps, start, ["host_id"]), ["host_id", "place"], "left_semi")
    on_path = on_path.select("host_id", F.floor(F.col("place") / 2).alias("place"), "leave")
    rows = every.select("host_id", F.col("page").cast("long").alias("place")).join(on_path, ["host_id", "place"], "left")
    met = chain.states(rows, on_path.select("host_id", "place"), start, ["host_id"])
    before = met.where("before is not null").select("host_id", F.col("place").alias("page"), F.col("before").alias("saved"))
    return accept_pages(records, before, limit, every)


def assemble_snapshots(snapshots: DataFrame, statuses: DataFrame, collectors: tuple[str, ...] = COLLECTORS, **tables: DataFrame) -> DataFrame:
    """One row per snapshot: a status map, its warnings, and the number of rows of each observation table.

    ``statuses`` may have ``warnings``, those of a collection in their order; a snapshot has them in the order of
    ``collectors``, then those of other collectors by name.
    """
    if "warnings" not in statuses.columns:
        statuses = statuses.withColumn("warnings", F.array().cast("array<string>"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(c) for c in collectors)), F.col("collector_name")), F.lit(0)), F.lit(len(collectors) + 1))
    own = F.struct(place.alias("place"), "collector_name", F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))
    status = statuses.groupBy(*KEY).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("collector_name", "status")))).alias("statuses"),
        F.flatten(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["warnings"])).alias("warnings"),
    )
    out = snapshots.select(*KEY, "observed_at").join(status, KEY, "left")
    for name, df in tables.items():
        out = out.join(df.groupBy(*KEY).agg(F.count("*").alias(f"n_{name}")), KEY, "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out
