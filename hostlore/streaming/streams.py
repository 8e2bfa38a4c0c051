"""The incremental forms: Structured Streaming jobs whose results equal their batch twins.

Spark's checkpoint is the ingest cursor. Watermarks bound the state; give them at least the correlation window and the
lateness of the source.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """The ``events`` table of a folder as a stream, with host and unit."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return journal_rows(rows)


def journal_rows(events: DataFrame) -> DataFrame:
    """Events as journal rows: host, unit, cursor and time."""
    rows = events.where("user_id is not null and ts is not null")
    return rows.select(
        F.concat(F.lit("host-"), (F.col("user_id") % 4).cast("string")).alias("host_id"),
        F.concat(F.lit("svc-"), F.col("user_id").cast("string"), F.lit(".service")).alias("unit"),
        F.concat(F.lit("c-"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("cursor"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        "event_type",
        "event_id",
    )


def deduplicated(events: DataFrame, delay: str = "40 days") -> DataFrame:
    """Exactly one row per host and cursor; state is dropped behind the watermark."""
    return events.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["host_id", "cursor"])


def interval_join(anchors: DataFrame, events: DataFrame, window_seconds: int, delay: str = "40 days") -> DataFrame:
    """Events of the anchor's host and unit within the window, both ends included."""
    left = anchors.withWatermark("anchor_at", delay).alias("a")
    right = events.withWatermark("observed_at", delay).alias("e")
    near = F.expr(
        f"a.host_id = e.host_id AND a.unit = e.unit "
        f"AND e.observed_at BETWEEN a.anchor_at - INTERVAL {window_seconds} SECONDS "
        f"AND a.anchor_at + INTERVAL {window_seconds} SECONDS"
    )
    return left.join(right, near, "inner").select("a.host_id", "a.unit", "a.anchor_id", "anchor_at", "e.cursor", "observed_at")


def run_once(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over all that is there now, into Parquet under ``path``, and reads the result."""
    stream.writeStream.format("parquet").option(
        "checkpointLocation", f"{path}/checkpoint"
    ).option("path", f"{path}/rows").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


PARTS = {
    "results": "array<struct<collector_name:string,status:string,collected_at:timestamp>>",
    "services": "array<struct<name:string,load_state:string,active_state:string,sub_state:string>>",
    "processes": "array<struct<pid:int,lifetime_id:string,cpu_time_ticks:bigint,rss_bytes:bigint,virtual_memory_bytes:bigint>>",
    "events": "array<struct<cursor:string,observed_at:timestamp,unit:string,priority:int>>",
}
#: One row per host and snapshot, with all that was captured.
CAPTURE = "host_id string, snapshot_id long, observed_at timestamp, monotonic_s double, " + ", ".join(f"{k} {v}" for k, v in PARTS.items())


INCIDENTS = (
    "host_id string, incident_id string, rule_id string, subject_type string, subject_id string, state string, "
    "started_at timestamp, last_observed_at timestamp, resolved_at timestamp, limitations array<string>"
)
