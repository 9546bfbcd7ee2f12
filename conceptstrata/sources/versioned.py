"""Keyed tables in versions: an upsert appends the rows it was given, readers merge by key.

A table is a folder with parts (one base, then a few deltas, each written once) and numbered manifests that name the
parts of a version. A commit is the appearance of the next manifest, so a reader sees one version or the next and never
half of an upsert, and a DataFrame made from a version stays whole while later ones are written.

All parts are bucketed by the key alike. A row counts unless a newer part holds its key: an anti join of parts that lie
in the same buckets, for which Spark shuffles neither side. An upsert therefore writes about the bytes of its rows.
Reading stays cheap because the number of deltas is bounded: beyond `max_deltas` they are merged into one, and once they
hold a share `compact_at` of the base's rows, everything is written anew.

One writer at a time: of two that commit the same version, the later one fails and repeats its upsert.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptstrata.operators.ranking import latest_by_key

SETTINGS, MANIFESTS, PARTS = "_table.json", "_versions", "parts"


@dataclass
class Part:
    """Rows written together, without a key twice."""

    name: str
    rows: int


@dataclass
class Version:
    number: int
    parts: list[Part] = field(default_factory=list)  # oldest first

    def text(self) -> str:
        return json.dumps({"parts": [[p.name, p.rows] for p in self.parts]})


class _Folder:
    """The few file operations that a commit needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.root = path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        place = self.at(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(place)] if self.fs.exists(place) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a file that then appears whole under its name, or fail if there is one already."""
        draft = self.at(f"{name}.{uuid.uuid4().hex}.draft")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(self.at(name)) or not self.fs.rename(draft, self.at(name)):
            self.fs.delete(draft, False)
            raise RuntimeError(f"{self.root}/{name} was written by another job: repeat the upsert")

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.at(name)).getLength()

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class VersionedTable:
    """A table replaced by key. `open_table` finds one, `create_table` makes it if there is none."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, _Folder(spark, path)
        settings = json.loads(self.folder.read(SETTINGS))
        self.schema = T.StructType.fromJson(settings["schema"])
        self.key, self.buckets, self.order = settings["key"], settings["buckets"], settings["order"]
        self.max_deltas, self.compact_at = settings["max_deltas"], settings["compact_at"]

    # Versions -----------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.folder.names(MANIFESTS) if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """A version, the newest one unless a number is given; 0 is the empty table."""
        numbers = self.versions()
        number = (numbers[-1] if numbers else 0) if number is None else number
        if number == 0:
            return Version(0)
        found = json.loads(self.folder.read(f"{MANIFESTS}/{number:020d}.json"))
        return Version(number, [Part(*p) for p in found["parts"]])

    def _commit(self, before: Version, parts: list[Part]) -> Version:
        after = Version(before.number + 1, parts)
        self.folder.put(f"{MANIFESTS}/{after.number:020d}.json", after.text())
        return after

    # Parts --------------------------------------------------------------------------------

    def _write(self, rows: DataFrame) -> Part:
        """One file per bucket, sorted; the buckets are those that Spark's own joins use."""
        name = uuid.uuid4().hex
        (
            rows.select(*self.schema.names)
            .repartition(self.buckets, self.key)
            .sortWithinPartitions(*self.order)
            .write.bucketBy(self.buckets, self.key)
            .sortBy(*self.order)
            .option("path", f"{self.folder.root}/{PARTS}/{name}")
            .saveAsTable(f"part_{name}")
        )
        return Part(name, self.spark.table(f"part_{name}").count())

    def _part(self, part: Part) -> DataFrame:
        """A part as a bucketed table, made known to this session's catalog if another one wrote it."""
        name = f"part_{part.name}"
        if not self.spark.catalog.tableExists(name):
            order = ", ".join(f"`{c}`" for c in self.order)
            self.spark.sql(
                f"CREATE TABLE {name} ({self.schema.toDDL()}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY ({order}) "
                f"INTO {self.buckets} BUCKETS LOCATION '{self.folder.root}/{PARTS}/{part.name}'"
            )
        return self.spark.table(name)

    def _merged(self, parts: Sequence[Part], narrow: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """The rows that no newer part replaces. `narrow` restricts each part's rows before they are compared."""
        tables = [self._part(p) for p in parts]
        merged: DataFrame | None = None
        for i, table in enumerate(tables):
            rows = narrow(table)
            for newer in tables[i + 1 :]:
                rows = rows.join(newer.select(self.key), self.key, "left_anti")
            rows = rows.select(*self.schema.names)
            merged = rows if merged is None else merged.unionByName(rows)
        return self.spark.createDataFrame([], self.schema) if merged is None else merged

    # Reading ------------------------------------------------------------------------------

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the newest one unless a number is given."""
        return self._merged(self.version(number).parts)

    def lookup(self, ids: DataFrame, number: int | None = None) -> DataFrame:
        """Rows whose key is in `ids` (a column named like the key). The table stays where it lies: only ids move."""
        # Dealt like the buckets, or Spark would deal the table like the ids.
        wanted = ids.select(self.key).where(F.col(self.key).isNotNull()).repartition(self.buckets, self.key).distinct()
        return self._merged(self.version(number).parts, lambda rows: rows.join(wanted, self.key, "left_semi"))

    def missing(self, candidates: DataFrame) -> DataFrame:
        """Candidates whose key no part holds; a null key is none that could be stored."""
        rows = candidates.where(F.col(self.key).isNotNull()).repartition(self.buckets, self.key)
        for part in self.version().parts:
            rows = rows.join(self._part(part).select(self.key), self.key, "left_anti")
        return rows

    def count(self) -> int:
        return self.read().count()

    # Writing ------------------------------------------------------------------------------

    def upsert(self, rows: DataFrame, latest: str | Sequence[str]) -> Version:
        """Insert or replace by key, as the next version.

        `latest` names the columns whose largest values win where `rows` holds a key twice; they need not be columns of
        the table. Rows without a key are refused. An upsert that is repeated leaves the same rows.
        """
        order = [F.desc_nulls_last(c) for c in ([latest] if isinstance(latest, str) else latest)]
        others = [F.desc_nulls_last(c) for c in ordered_columns(self.schema)]
        before = self.version()
        keyed = rows.where(F.col(self.key).isNotNull())
        delta = self._write(latest_by_key(keyed, self.key, [*order, *others]))
        if not delta.rows:
            self._forget(delta)
            return before
        return self._commit(before, self._compacted([*before.parts, delta]))

    def _compacted(self, parts: list[Part]) -> list[Part]:
        """The parts of the next version: as they are, the deltas in one, or all in one."""
        base, deltas = parts[0], parts[1:]
        if sum(p.rows for p in deltas) > self.compact_at * base.rows:
            return [self._write(self._merged(parts))]
        if len(deltas) > self.max_deltas:
            return [base, self._write(self._merged(deltas))]
        return parts

    def compact(self) -> Version:
        """Write all rows anew as one part."""
        before = self.version()
        return before if len(before.parts) < 2 else self._commit(before, [self._write(self._merged(before.parts))])

    def vacuum(self, keep: int = 1) -> None:
        """Delete the parts and manifests that the newest `keep` versions do not need. Not while older ones are read."""
        numbers = self.versions()
        kept = {p.name for n in numbers[-keep:] for p in self.version(n).parts}
        for n in numbers[:-keep]:
            self.folder.drop(f"{MANIFESTS}/{n:020d}.json")
        for name in set(self.folder.names(PARTS)) - kept:
            self._forget(Part(name, 0))

    def _forget(self, part: Part) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS part_{part.name}")
        self.folder.drop(f"{PARTS}/{part.name}")

    def part_bytes(self) -> list[int]:
        """Bytes of the parts of the newest version, oldest first."""
        return [self.folder.size(f"{PARTS}/{p.name}") for p in self.version().parts]


def _has_map(kind: T.DataType) -> bool:
    """Values with maps have no order."""
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


def ordered_columns(schema: T.StructType) -> list[str]:
    """The columns whose values can be compared."""
    return [f.name for f in schema.fields if not _has_map(f.dataType)]


def create_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    key: str,
    buckets: int = 64,
    order: Sequence[str] = (),
    max_deltas: int = 4,
    compact_at: float = 0.25,
) -> VersionedTable:
    """The table at `path`, made if there is none. Use enough buckets that one of them fits a task.

    `order` sorts the rows of a bucket (by the key unless given): a range of its first column, such as the publication
    year, then skips row groups by their statistics.
    """
    folder = _Folder(spark, path)
    if not folder.fs.exists(folder.at(SETTINGS)):
        plain = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
        settings = {"schema": plain.jsonValue(), "key": key, "buckets": buckets, "order": list(order) or [key]}
        folder.put(SETTINGS, json.dumps(settings | {"max_deltas": max_deltas, "compact_at": compact_at}))
    return VersionedTable(spark, path)


def open_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path)
