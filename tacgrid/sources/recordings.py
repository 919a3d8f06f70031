"""Recordings as a data source that reads only the asked ticks and events.

`spark.read.format("recording")` plans a task for a share of a large file's blocks or for several small files. What is asked of `event`, `tick` and
`recording` (equal, in, less, greater) goes to the reader: blocks that can't hold it aren't read, and of the others only the asked
rows come up. A decoder knows a file's format; that of decoded recordings (Parquet
files, whose row groups are the blocks) is built in, parsers of raw recordings are given as a class with the same two
methods, which travels with the plan. Files are opened on the executors through Arrow's file systems.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from tacgrid.sources.files import arrow_uri, with_scheme

#: Bytes that one task reads, and what opening a file counts beside its own.
TASK_BYTES, OPEN_BYTES = 64 << 20, 4 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
ERRORS = "path string, message string"


@dataclass
class Asked:
    """Values that a column may have: of a list (None: any), from low to high, both included (None: open)."""

    values: frozenset | None = None
    low: object = None
    high: object = None

    def only(self, values) -> None:
        own = frozenset(v for v in values if v is not None)
        self.values = own if self.values is None else self.values & own

    def within(self, low=None, high=None) -> None:
        self.low = low if self.low is None else self.low if low is None else max(self.low, low)
        self.high = high if self.high is None else self.high if high is None else min(self.high, high)

    def may_hold(self, least, most) -> bool:
        """Whether a block between least and most (None: not known) may hold an asked value."""
        if least is None or most is None:
            return True
        if (self.low is not None and most < self.low) or (self.high is not None and least > self.high):
            return False
        return self.values is None or any(least <= v <= most for v in self.values)

    def mask(self, column: pa.ChunkedArray) -> pa.ChunkedArray | None:
        parts = []
        if self.values is not None:
            parts.append(pc.is_in(column, pa.array(sorted(self.values), column.type)))
        if self.low is not None:
            parts.append(pc.greater_equal(column, pa.scalar(self.low, column.type)))
        if self.high is not None:
            parts.append(pc.less_equal(column, pa.scalar(self.high, column.type)))
        out = None
        for p in parts:
            out = p if out is None else pc.and_(out, p)
        return out


@dataclass
class Block:
    """A stretch of a file: its place, rows and bytes, and the least and greatest value of each asked column, if known."""

    place: int
    rows: int
    size: int
    range: dict = field(default_factory=dict)


class ParquetDecoder:
    """Decoded recordings: Parquet files with columns recording, event, tick and more; blocks are row groups."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.file = pq.ParquetFile(fs.open_input_file(path))

    def blocks(self) -> list[Block]:
        out, names = [], self.file.schema_arrow.names
        for i in range(self.file.metadata.num_row_groups):
            group = self.file.metadata.row_group(i)
            stats = {c.path_in_schema: c.statistics for c in map(group.column, range(group.num_columns)) if c.path_in_schema in names}
            known = {n: (s.min, s.max) for n, s in stats.items() if s is not None and s.has_min_max and not isinstance(s.min, (bytes, datetime.datetime))}
            out.append(Block(i, group.num_rows, group.total_byte_size, known))
        return out

    def read(self, place: int, columns: list[str] | None) -> pa.Table:
        return self.file.read_row_group(place, columns)


class Share(InputPartition):
    """(path, k, of): the k-th of so many shares of each file's blocks."""

    def __init__(self, files: list[tuple[str, int, int]]) -> None:
        super().__init__(files)
        self.files = files


class RecordingReader(DataSourceReader):
    """Plans and reads the asked blocks. Options: see RecordingSource."""

    def __init__(self, schema, options, decoder=ParquetDecoder) -> None:
        self.names, self.types = list(schema.names), to_arrow_schema(schema)
        self.errors = options.get("read", "rows") == "errors"
        self.skip = options.get("bad", "fail") == "skip" or self.errors
        self.decoder, self.root, self.report = decoder, options["path"], options.get("report")
        self.suffix, self.files = options.get("suffix", ".parquet"), options.get("files")
        self.asked = {c: Asked() for c in ("recording", "event", "tick")}

    def pushFilters(self, filters):
        for f in filters:
            own = self.asked.get(f.attribute[0]) if getattr(f, "attribute", None) and len(f.attribute) == 1 and not self.errors else None
            whole = isinstance(getattr(f, "value", None), int) and not isinstance(f.value, bool)
            if own is None:
                yield f
            elif isinstance(f, EqualTo):
                own.only([f.value])
            elif isinstance(f, In):
                own.only(f.value)
            elif isinstance(f, GreaterThanOrEqual):
                own.within(low=f.value)
            elif isinstance(f, LessThanOrEqual):
                own.within(high=f.value)
            elif isinstance(f, GreaterThan) and whole:
                own.within(low=f.value + 1)
            elif isinstance(f, LessThan) and whole:
                own.within(high=f.value - 1)
            else:
                yield f

    def _files(self) -> list[tuple[str, int]]:
        """(URI, size) of all files below the path, or of those that the option names."""
        if self.files:
            return [(p, self._size(p)) for p in sorted(json.loads(self.files))]
        fs, base = pafs.FileSystem.from_uri(arrow_uri(self.root))
        found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
        root = with_scheme(self.root).rstrip("/")
        head = root[: len(root) - len(base)] if root.endswith(base) else root.split("://")[0] + "://"
        hidden = lambda p: any(x[:1] in "._" for x in p[len(base) :].strip("/").split("/"))
        return sorted((head + f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(self.suffix) and not hidden(f.path))

    def _size(self, path: str) -> int:
        fs, inner = pafs.FileSystem.from_uri(arrow_uri(path))
        return max(fs.get_file_info(inner).size or 0, 0)

    def _open(self, path: str):
        fs, inner = pafs.FileSystem.from_uri(arrow_uri(path))
        return self.decoder(fs, inner)

    def _wanted(self, block: Block) -> bool:
        return all(a.may_hold(*block.range.get(c, (None, None))) for c, a in self.asked.items())

    def partitions(self) -> list[InputPartition]:
        """Tasks of TASK_BYTES: shares of large files, several small ones together. Files are opened by the tasks."""
        out, held, size = [], [], 0
        for path, n in self._files():
            shares = max(1, -(-n // TASK_BYTES))
            if shares > 1:
                out += [Share([(path, k, shares)]) for k in range(shares)]
                continue
            if held and size + n + OPEN_BYTES > TASK_BYTES:
                out.append(Share(held))
                held, size = [], 0
            held, size = [*held, (path, 0, 1)], size + n + OPEN_BYTES
        return [*out, *([Share(held)] if held or not out else [])]

    def read(self, part: Share) -> Iterator[pa.RecordBatch]:
        for path, k, of in part.files:
            yield from self._read(path, k, of)

    def _read(self, path: str, k: int, of: int) -> Iterator[pa.RecordBatch]:
        seen = {"path": path, "blocks": 0, "blocks_read": 0, "rows_decoded": 0, "rows": 0}
        try:
            file = self._open(path)
            blocks = file.blocks()
            total, before, own = sum(b.size for b in blocks) or 1, 0, []
            for b in blocks:
                if min(before * of // total, of - 1) == k:
                    own.append(b)
                before += b.size
            seen["blocks"] = len(own)
            if self.errors:
                for b in own:
                    file.read(b.place, None)
            else:
                for b in own:
                    if self._wanted(b):
                        yield from self._rows(file, b, seen).to_batches()
        except Exception as e:
            if not self.skip:
                raise
            if self.errors:
                yield pa.RecordBatch.from_pydict({"path": [path], "message": [f"{type(e).__name__}: {e}"]})
        finally:
            if self.report:
                fs, base = pafs.FileSystem.from_uri(arrow_uri(self.report))
                fs.create_dir(base, recursive=True)
                with fs.open_output_stream(f"{base}/{uuid.uuid4().hex}.json") as out:
                    out.write(json.dumps(seen).encode())

    def _rows(self, file, block: Block, seen: dict) -> pa.Table:
        needed = list(dict.fromkeys([*self.names, *(c for c, a in self.asked.items() if a != Asked())]))
        table = file.read(block.place, needed)
        seen["blocks_read"] += 1
        seen["rows_decoded"] += len(table)
        for c, a in self.asked.items():
            if a != Asked() and (keep := a.mask(table.column(c))) is not None:
                table = table.filter(keep)
        seen["rows"] += len(table)
        return table.select(self.names).cast(self.types)


class RecordingSource(DataSource):
    """format("recording"). Options: path (a folder, with or without scheme), files (a JSON list of files instead of all below
    path, as discovery gives them), suffix, decoder (parquet, or module:Class), bad (fail, or skip: files that can't be decoded
    give no rows), read (rows, or errors: path and message of those files instead), report (a folder for a line about each file:
    blocks, blocks read, rows decoded, rows given)."""

    decoder = ParquetDecoder

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        if self.options.get("read", "rows") == "errors":
            return ERRORS
        raise ValueError("give a schema: recording, event, tick and what else the files hold")

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(schema, self.options, self.decoder)


def _source(spark: SparkSession, decoder) -> str:
    """The name of the source that uses a decoder, registered."""
    name = "recording" if decoder is ParquetDecoder else f"recording_{decoder.__name__.lower()}"
    spark.dataSource.register(type("Source", (RecordingSource,), {"decoder": decoder, "name": classmethod(lambda cls: name)}))
    spark.conf.set(PUSHDOWN, "true")
    return name


def recordings(spark: SparkSession, path: str, schema: str, decoder=ParquetDecoder, **options: str) -> DataFrame:
    """Rows of the recordings below path. Filters on event, tick and recording are pushed to the reader. options: see RecordingSource.

    Only the columns of schema are read. Spark keeps what is pushed down with the source that a frame was loaded from: a frame
    stands for one scan. A plan that reads recordings twice, under other filters, calls this twice.
    decoder: a class as ParquetDecoder, made from (file system, path), with blocks() and read(place, columns).
    """
    return spark.read.format(_source(spark, decoder)).schema(schema).options(path=path, **options).load()


def bad_recordings(spark: SparkSession, path: str, decoder=ParquetDecoder, **options: str) -> DataFrame:
    """(path, message) of the files below path that can't be decoded, for store.quarantine."""
    return spark.read.format(_source(spark, decoder)).options(path=path, read="errors", **options).load()


#: Ticks at which the teams' names are read where nothing else of a recording is.
HEADER_TICKS = (10_000, 40_000, 80_000, 120_000)


def header_teams(ticks: DataFrame, at: tuple[int, ...] = HEADER_TICKS) -> DataFrame:
    """ticks (recording, tick, team_num, team_name) -> recording, team_a, team_b: the first two names of the playing sides at a few ticks.

    Only these ticks are read from a source that takes filters. A recording without a row there has no row here.
    """
    from tacgrid.functions.scalar import first_teams
    from tacgrid.operators.filters import playable

    names = playable(ticks.where(F.col("tick").isin(*at))).groupBy("recording").agg(F.collect_set("team_name").alias("names"))
    a, b = first_teams(F.col("names"))
    return names.select("recording", a.alias("team_a"), b.alias("team_b"))


def win_reasons(events: DataFrame, name: str = "round_end") -> DataFrame:
    """events (recording, event, tick, reason) -> recording, tick, reason of the round ends whose reason is known; other events aren't read."""
    from tacgrid.functions.scalar import reason_of

    return events.where(F.col("event") == name).select("recording", "tick", reason_of(F.col("reason")).alias("reason")).where("reason IS NOT NULL")
