"""A catalogue of versioned Parquet shards as a Spark data source, for batches and streams.

A catalogue is a folder of versions, ``v1``, ``v2``, ..., each with Parquet
files at any depth; it lies on any file system that Arrow opens (``file``,
``s3``, ``gs``, ``hdfs``).  One task reads one shard.  ``register(spark)``, then::

    spark.read.format("corvane_shards").option("path", folder).load()

Options: ``version`` (``latest``, the default, a number, or ``all``), and
``unreadable``: ``row`` (the default) gives one row with the error for a shard that can't be read,
``skip`` leaves it out, ``fail`` ends the query.  Each row also has ``shard``,
``version`` and ``error``; equality and ``IN`` filters on the first two spare the
other shards.  A stream reads
each shard once, in order of version and name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructType

from corvane.runtime import ship

ADDED = ("shard", "version", "error")
#: Rows of a batch that a task hands on.
ROWS = 8192


@dataclass
class Shard(InputPartition):
    """A file of a version; ``name`` is its path below the version's folder."""

    path: str
    version: int
    name: str

    def __post_init__(self):
        super().__init__(f"v{self.version}/{self.name}")

    @property
    def key(self) -> list:
        return [self.version, self.name]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_shards(path: str, version: str = "latest") -> list[Shard]:
    """The shards of the asked version or versions, in order of version and name; empty files and hidden ones don't count."""
    system, root = _open(path)
    out = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
        found = re.fullmatch(r"v(\d+)/(.+\.parquet)", info.path[len(root.rstrip("/")) + 1 :])
        hidden = found and any(x.startswith((".", "_")) for x in found[2].split("/"))
        if info.type == fs.FileType.File and info.size and found and not hidden:
            out.append(Shard(info.path, int(found[1]), found[2]))
    if version != "all" and out:
        wanted = max(s.version for s in out) if version == "latest" else int(version)
        out = [s for s in out if s.version == wanted]
    return sorted(out, key=lambda s: s.key)


def _batches(system: fs.FileSystem, shard: Shard, schema: pa.Schema, unreadable: str) -> Iterator[pa.RecordBatch]:
    """A shard's rows in the asked columns; missing ones are null.

    A shard whose footer is broken has one row with the error; one that breaks
    off later has its rows up to there, then that row.
    """
    wanted = [f for f in schema if f.name not in ADDED]

    def frame(n, columns, error=None):
        added = {"shard": shard.name, "version": shard.version, "error": error}
        return pa.RecordBatch.from_arrays([pa.array([added[f.name]] * n, f.type) if f.name in added else columns[f.name] for f in schema], schema=schema)

    try:
        with system.open_input_file(shard.path) as opened:
            file = pq.ParquetFile(opened)
            held = [f.name for f in wanted if f.name in file.schema_arrow.names]
            for batch in file.iter_batches(ROWS, columns=held):
                yield frame(batch.num_rows, {f.name: batch.column(f.name).cast(f.type) if f.name in held else pa.nulls(batch.num_rows, f.type) for f in wanted})
    except (OSError, pa.ArrowException) as e:
        if unreadable == "fail":
            raise
        if unreadable == "row":
            yield frame(1, {f.name: pa.nulls(1, f.type) for f in wanted}, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")


class _Read:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.version = options["path"], options.get("version", "latest")
        self.unreadable, self.schema = options.get("unreadable", "row"), schema
        if self.unreadable not in ("row", "skip", "fail"):
            raise ValueError(f"unreadable: {self.unreadable}")

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        return _batches(_open(self.path)[0], partition, to_arrow_schema(self.schema), self.unreadable)


class ShardReader(_Read, DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        super().__init__(options, schema)
        self.allowed: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("shard",), ("version",)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                name = f.attribute[0]
                self.allowed[name] = self.allowed.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Shard]:
        return [s for s in list_shards(self.path, self.version) if s.name in self.allowed.get("shard", {s.name}) and s.version in self.allowed.get("version", {s.version})]


class ShardStreamReader(_Read, DataSourceStreamReader):
    """Offsets are the version and name of the last shard read; later versions and names are new."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": [-1, ""]}

    def latestOffset(self) -> dict:  # noqa: N802
        found = list_shards(self.path, "all")
        return {"after": found[-1].key if found else [-1, ""]}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return [s for s in list_shards(self.path, "all") if start["after"] < s.key <= end["after"]]

    def commit(self, end: dict) -> None:
        pass


class ShardCatalog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corvane_shards"

    def schema(self) -> StructType:
        """That of the first readable shard, and the added columns; a catalogue without one needs a given schema."""
        system, _ = _open(self.options["path"])
        for shard in list_shards(self.options["path"], self.options.get("version", "latest")):
            try:
                with system.open_input_file(shard.path) as opened:
                    found = from_arrow_schema(pq.read_schema(opened))
            except (OSError, pa.ArrowException):
                continue
            kept = StructType([f for f in found if f.name not in ADDED])
            return kept.add("shard", StringType()).add("version", IntegerType()).add("error", StringType())
        raise ValueError(f"no readable shard in {self.options['path']}")

    def reader(self, schema: StructType) -> ShardReader:
        return ShardReader(self.options, schema)

    def streamReader(self, schema: StructType) -> ShardStreamReader:  # noqa: N802
        return ShardStreamReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Names the source in this session, and lets Spark hand it filters."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShardCatalog)


def write_version(df: DataFrame, path: str, version: int, rows: int = 10_000) -> None:
    """Writes a version of a catalogue in shards of at most ``rows`` rows, without a shuffle, so no task's share grows with the table."""
    df.write.option("maxRecordsPerFile", rows).parquet(f"{path}/v{version}/data")


def put_broken(path: str, name: str) -> None:
    """Writes a file that isn't Parquet, to try how a catalogue is read with one."""
    system, root = _open(path)
    with system.open_output_stream(f"{root}/{name}") as f:
        f.write(b"broken")
