"""A library of Parquet tables. What belongs to recordings is written beside what is there and counts from one commit on.

A table's rows lie in folders by the commit that wrote them and by recording. A manifest tells, for each table and
recording, which commit's rows are valid; the manifests are numbered, and readers go by the newest whole one. A commit
writes all its rows, then its manifest (rows of a Parquet table, however many recordings there are), then one small
file by which readers find it. Until that file is there readers see what was there before, whatever was interrupted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("recordings", "rounds", "snapshots", "eliminations", "utility_events", "roster", "round_sides", "zone_votes", "errors")
#: What is derived from maps, partitioned by map.
MAPS = ("areas", "centres", "geo", "raster")
MANIFEST = "table string, recording_id long, commit string"


class Conflict(RuntimeError):
    """Another writer committed meanwhile."""


class Library:
    """Tables below root. Writing a recording again replaces it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, place: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{place}")

    def _fs(self, place: str):
        return self._path(place).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, place: str) -> bool:
        return self._fs(place).exists(self._path(place))

    def _pointers(self) -> list[tuple[int, int]]:
        """(number, bytes) of the files that name manifests, newest first."""
        if not self._exists("_current"):
            return []
        found = self._fs("_current").listStatus(self._path("_current"))
        return sorted(((int(f.getPath().getName()), int(f.getLen())) for f in found if f.getPath().getName().isdigit()), reverse=True)

    def version(self) -> int:
        """The number of the newest whole commit; 0 before the first."""
        return next((n for n, size in self._pointers() if size), 0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(table, recording_id, commit): what is valid, now or as of a commit."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        stream = self._fs("_current").open(self._path(f"_current/{version:012d}"))
        try:
            jvm = self.spark.sparkContext._jvm
            name = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream)).readLine()
        finally:
            stream.close()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/_manifest/{name}")

    def _commit(self, base: int, rows: DataFrame) -> int:
        """rows become the manifest after number base. Numbers are taken by making a file, so of two writers one is refused."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/_manifest/{name}")
        newest = next((n for n, _ in self._pointers()), 0)
        if self.version() != base:
            raise Conflict(f"commit {base} isn't the newest any more")
        jvm = self.spark.sparkContext._jvm
        try:
            out = self._fs("_current").create(self._path(f"_current/{newest + 1:012d}"), False)
        except Exception as e:
            raise Conflict(f"commit {newest + 1} was taken by another writer") from e
        text = jvm.java.io.OutputStreamWriter(out)
        text.write(name + "\n")
        text.close()
        return newest + 1

    def has(self, table: str) -> bool:
        """Whether the table has anything."""
        return self._exists(table) if table in MAPS else not self.manifest().where(F.col("table") == table).isEmpty()

    def _write(self, table: str, rows: DataFrame, commit: str) -> None:
        if table not in TABLES:
            raise ValueError(f"no table {table}")
        rows.withColumn("commit", F.lit(commit)).write.mode("append").partitionBy("commit", "recording_id").parquet(f"{self.root}/{table}")

    def _written(self, table: str, commit: str) -> DataFrame:
        """(table, recording_id, commit) of the folders that a commit has made: their rows aren't read again."""
        place = f"{table}/commit={commit}"
        names = [f.getPath().getName() for f in self._fs(place).listStatus(self._path(place))] if self._exists(place) else []
        ids = [(table, int(n.split("=")[1]), commit) for n in names if n.startswith("recording_id=") and not n.endswith("HIVE_DEFAULT_PARTITION__")]
        return self.spark.createDataFrame(ids, MANIFEST)

    def write(self, table: str, rows: DataFrame) -> None:
        """Replaces the recordings that rows holds in this table, and no others, as one commit. Rows without a recording are in none."""
        base, commit = self.version(), uuid.uuid4().hex
        self._write(table, rows, commit)
        new = self._written(table, commit)
        self._commit(base, self.manifest(base).join(new.select("table", "recording_id"), ["table", "recording_id"], "left_anti").unionByName(new))

    def write_all(self, tables: dict[str, DataFrame]) -> None:
        """Recordings with all their tables as one commit.

        A recording that any table holds is replaced whole: it loses its rows of tables that aren't given or don't hold it.
        """
        base, commit = self.version(), uuid.uuid4().hex
        new = self.spark.createDataFrame([], MANIFEST)
        for name, rows in tables.items():
            self._write(name, rows, commit)
            new = new.unionByName(self._written(name, commit))
        self._commit(base, self.manifest(base).join(new.select("recording_id").distinct(), "recording_id", "left_anti").unionByName(new))

    def write_map(self, made: dict[str, DataFrame]) -> None:
        """What navmesh.build_map makes; other maps stay."""
        for name, rows in made.items():
            if name not in MAPS:
                raise ValueError(f"no table {name}")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("map_name").parquet(f"{self.root}/{name}")

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The valid rows of a table, now or as of a commit: a frame stays with the commit that it was made of."""
        rows = self.spark.read.parquet(f"{self.root}/{table}")
        if table in MAPS:
            return rows
        valid = self.manifest(version).where(F.col("table") == table).select("recording_id", "commit")
        return rows.withColumn("recording_id", F.col("recording_id").cast("long")).join(valid, ["recording_id", "commit"]).drop("commit")

    def remove(self, *recording_ids: int) -> None:
        """The recordings and all that hangs on them."""
        base = self.version()
        self._commit(base, self.manifest(base).where(~F.col("recording_id").isin(*recording_ids)))

    def clear(self) -> None:
        """All recordings, and what they took on disk; definitions of cores live elsewhere and stay."""
        self._commit(self.version(), self.spark.createDataFrame([], MANIFEST))
        self.vacuum()

    def vacuum(self) -> int:
        """Deletes the folders of rows that aren't valid, of manifests but the newest, and gives how many. No writer may be at work."""
        valid = {(r["table"], r["commit"]) for r in self.manifest().select("table", "commit").distinct().collect()}
        gone = 0
        for table in (t for t in TABLES if self._exists(t)):
            for f in self._fs(table).listStatus(self._path(table)):
                name = f.getPath().getName()
                if name.startswith("commit=") and (table, name.split("=", 1)[1]) not in valid:
                    gone += bool(self._fs(table).delete(f.getPath(), True))
        version = self.version()
        for n, _ in self._pointers():
            if n < version:
                self._fs("_current").delete(self._path(f"_current/{n:012d}"), False)
        return gone

    def size(self) -> int:
        """Bytes on disk."""
        return sum(int(self._fs(t).getContentSummary(self._path(t)).getLength()) for t in TABLES if self._exists(t))


def quarantine(failed: DataFrame, known: DataFrame, width: int = 500) -> DataFrame:
    """Rows for failed files (path, content_key, message) whose key isn't known: status error, message cut to width."""
    return failed.join(known.select("content_key"), "content_key", "left_anti").dropDuplicates(["content_key"]).select("path", "content_key", F.lit("error").alias("status"), F.substring("message", 1, width).alias("error"))


def apply_metadata(recordings: DataFrame, overlay: DataFrame) -> DataFrame:
    """overlay (file_name, event, match_ref) for recordings with either missing; both are then taken from it."""
    joined = recordings.join(overlay.select("file_name", F.col("event").alias("_event"), F.col("match_ref").alias("_ref"), F.lit(True).alias("_there")), "file_name", "left")
    take = F.col("_there").isNotNull() & (F.col("event").isNull() | F.col("match_ref").isNull())
    new = {"event": F.when(take, F.col("_event")).otherwise(F.col("event")), "match_ref": F.when(take, F.col("_ref")).otherwise(F.col("match_ref"))}
    return joined.withColumns(new).select(*recordings.columns)
