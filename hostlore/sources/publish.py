"""Publishing of several tables at once: all are staged, then one manifest names what counts.

A manifest is a small JSON file in ``<path>/_manifests``, numbered, that tells which folder holds each table. It is written
beside its place and moved there, so readers see all tables of a version or none of them; a number that is taken refuses
the second writer. What was staged without a manifest is never read. The move must be atomic, as on HDFS and local disks;
on an object store, use a committer or a lock for that one file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_manifests"


class Conflict(ValueError):
    """Another writer has published that number."""


class Manifests:
    """The manifests of a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, f"{path.rstrip('/')}/{MANIFESTS}"

    def file(self, name: str) -> tuple[JavaObject, JavaObject]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def numbers(self) -> list[int]:
        fs, folder = self.file("x")
        if not fs.exists(folder.getParent()):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(folder.getParent()))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict | None:
        fs, file = self.file(f"{number:012d}.json")
        if not fs.exists(file):
            return None
        stream = fs.open(file)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def last(self, before: int | None = None) -> tuple[int, dict] | None:
        """The newest manifest, or the newest under a number."""
        numbers = [n for n in self.numbers() if before is None or n < before]
        return (numbers[-1], self.read(numbers[-1])) if numbers else None

    def commit(self, number: int, content: dict) -> None:
        fs, beside = self.file(f".{uuid.uuid4().hex}")
        _, place = self.file(f"{number:012d}.json")
        stream = fs.create(beside, False)
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        stream.close()
        if fs.exists(place) or not fs.rename(beside, place):
            fs.delete(beside, False)
            raise Conflict(f"version {number} is there already")


def publish(path: str, tables: dict[str, DataFrame], expected: int | None = None, staged: Callable[[str], None] | None = None) -> int:
    """Writes all ``tables`` under ``path`` and makes them its newest version, which is returned.

    ``expected``: the version that this one follows (None: none yet, -1: whichever is the newest); another one refuses
    the write. Should anything fail before the manifest is there, readers see what they saw before. ``staged`` is called
    with each name after its table was written.
    """
    spark = next(iter(tables.values())).sparkSession
    manifests = Manifests(spark, path)
    newest = manifests.last()
    number = newest[0] if newest else None
    if expected != -1 and expected != number:
        raise Conflict(f"expected version {expected}, found {number}")
    folders = {}
    for name, rows in tables.items():
        folders[name] = f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(folders[name])
        if staged:
            staged(name)
    after = 0 if number is None else number + 1
    manifests.commit(after, {"tables": folders, "schemas": {n: df.schema.json() for n, df in tables.items()}})
    return after


def published(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the newest if none is named; none before the first."""
    from pyspark.sql.types import StructType

    manifests = Manifests(spark, path)
    found = manifests.last() if version is None else (version, manifests.read(version))
    if not found or found[1] is None:
        return {}
    schemas = {n: StructType.fromJson(json.loads(s)) for n, s in found[1]["schemas"].items()}
    return {n: spark.read.schema(schemas[n]).parquet(folder) for n, folder in found[1]["tables"].items()}
