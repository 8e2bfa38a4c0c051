"""Scalar rules as column expressions, all of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names that mark a credential, and the bounds of stored text.
SECRET_NAME = "token|password|passwd|secret|api[_-]?key|authorization"
MASK = "[REDACTED]"
MAX_LIMITATIONS = 32
MAX_NAME = 512
MAX_FIELD_BYTES = 512
MAX_MESSAGE_BYTES = 4096
MAX_PID = 2**31 - 1


def redact(text: Column) -> Column:
    """Masks inline credentials: assignments, long options, -p and -k options, query parameters, in this order."""
    for pattern, put in (
        (rf"(?iuU)({SECRET_NAME})(=|:)(\S+)", "$1$2"),
        (rf"(?iuU)(--?(?:{SECRET_NAME})\b)(\s+)(\S+)", "$1$2"),
        (r"(?iuU)(^|\s)(-[pk])(\s+)(\S+)", "$1$2$3"),
        (rf"(?iuU)([?&](?:{SECRET_NAME})=)([^&\s]+)", "$1"),
    ):
        text = F.regexp_replace(text, F.lit(pattern), F.lit(put + MASK))
    return text


def redact_to(text: Column, length: int) -> Column:
    return F.substring(redact(text), 1, length)


def cut_utf8(text: Column, size: int) -> Column:
    """At most ``size`` bytes, without splitting a character."""
    raw = text.cast("binary")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, size - k).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= size, text).otherwise(F.coalesce(*cuts))


#: Fields that may hold credentials.
REDACTED = ("message", "source", "comm")


def normalised(name: str, value: Column, size: int = MAX_FIELD_BYTES, clean: Column | None = None) -> tuple[Column, Column]:
    """A stored field and its warnings: redacted where the field may hold credentials, then cut by bytes.

    ``clean``: the redacted value where it is a column already, as each use of an expression is computed anew.
    """
    if clean is None:
        clean = redact(value) if name in REDACTED else value
    warnings = F.array_compact(F.array(F.when(clean != value, F.lit(f"{name}_redacted")), F.when(F.octet_length(clean) > size, F.lit(f"{name}_truncated"))))
    return cut_utf8(clean, size), warnings


def digest(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by NUL; a null part counts as empty."""
    columns = [F.coalesce(F.lit(p) if isinstance(p, str) else p, F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("\0", *columns).cast("binary"), 256)


def iso(ts: Column) -> Column:
    """ISO text with offset; microseconds only where there are some."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise("")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def iso_fixed(ts: Column) -> Column:
    """Stored form: always six digits."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def from_epoch_micros(text: Column) -> Column:
    """Timestamp of epoch microseconds in ASCII digits, at most 20; null where malformed."""
    return F.when(text.rlike("^[0-9]{1,20}$"), F.timestamp_micros(F.try_to_number(text, F.lit("9" * 20)).try_cast("bigint")))


def optional_int(text: Column, most: int) -> tuple[Column, Column]:
    """A bounded whole number in text, and whether the text is valid; null and '' are valid and give null."""
    blank = text.isNull() | (text == "")
    number = F.when(text.rlike("^[0-9]{1,10}$"), text.try_cast("bigint"))
    ok = blank | F.coalesce(number <= most, F.lit(False))
    return F.when(ok & ~blank, number), ok


def decode_bytes(value: Column) -> Column:
    """Text of a variant that is a string, or an array of bytes in UTF-8; '' for JSON null; null where malformed."""
    text = F.try_variant_get(value, "$", "string")
    numbers = F.try_variant_get(value, "$", "array<int>")
    right = F.forall(numbers, lambda x: x.isNotNull() & (x >= 0) & (x <= 255))
    bytes_ = F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    kind = F.schema_of_variant(value)
    return F.when(value.isNull() | F.is_variant_null(value), F.lit("")).when(kind == "STRING", text).when(
        kind.startswith("ARRAY") & right, F.try_validate_utf8(bytes_.cast("string"))
    )


def bounded(values: Column, marker: str, most: int = MAX_LIMITATIONS) -> Column:
    """Sorted distinct values; beyond ``most``, the first and a marker."""
    clean = F.array_sort(F.array_distinct(values))
    return F.when(F.size(clean) <= most, clean).otherwise(F.array_sort(F.array_distinct(F.concat(F.slice(clean, 1, most - 1), F.array(F.lit(marker))))))


def valid_service_name(name: Column) -> Column:
    """Ends in .service with something before it, at most 512 characters, no blanks or control characters."""
    return F.coalesce(name.rlike(r"(?U)^[^\s\x00-\x1f]+\.service$") & (F.length(name) <= MAX_NAME), F.lit(False))


def valid_state(state: Column) -> Column:
    return F.coalesce(state.rlike(r"(?U)^[^\s\x00-\x1f]{1,128}$"), F.lit(False))


def parse_utc(text: Column) -> Column:
    """Timestamp of stored text with a UTC offset; null otherwise."""
    return F.when(text.rlike(r"(\+00:00|Z)$"), F.try_to_timestamp(text))


def valid_elapsed(seconds: Column) -> Column:
    """Finite and positive."""
    return F.coalesce((seconds > 0) & ~F.isnan(seconds) & (seconds < float("inf")), F.lit(False))


def counter(previous: Column, current: Column, elapsed: Column, had_snapshot: Column | None = None) -> Column:
    """struct(state, delta, rate) of a counter between two readings; only ``valid`` has a delta and a rate.

    States in order of test: no_previous, invalid_data (no reading), invalid_interval, invalid_data (negative),
    counter_reset, valid. With ``had_snapshot``, a missing previous reading in an existing snapshot is new_resource.
    """
    missing = F.lit("no_previous") if had_snapshot is None else F.when(had_snapshot, F.lit("new_resource")).otherwise("no_previous")
    state = (
        F.when(previous.isNull(), missing).when(current.isNull(), "invalid_data").when(~valid_elapsed(elapsed), "invalid_interval")
        .when((previous < 0) | (current < 0), "invalid_data").when(current < previous, "counter_reset").otherwise("valid")
    )
    delta = F.when(state == "valid", current - previous)
    return F.struct(state.alias("state"), delta.alias("delta"), (delta / elapsed).alias("rate"))
