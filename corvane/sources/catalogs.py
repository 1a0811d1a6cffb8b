"""What lies in folders of datasets and runs: row counts, configurations, archives, and sources of several kinds."""

from __future__ import annotations

import gzip
import io
import posixpath
import tarfile
import time
import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions.sampling import choose
from corvane.functions.text import section_between
from corvane.sources.files import read_tree
from corvane.sources.remote import with_retry

#: Characters of a frame of texts, but for the last text.
FRAME_CHARS = 4 << 20
_FILES = "archive string, path string, text string, error string"


def footer_counts(spark: SparkSession, paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, rows, error): row counts of Parquet files from their footers, no data read; an unreadable file has an error."""

    def run(batches):
        for pdf in batches:
            out = []
            for p in pdf["path"]:
                try:
                    system, name = fs.FileSystem.from_uri(p) if "://" in p or p.startswith("file:") else (fs.LocalFileSystem(), p)
                    with system.open_input_file(name) as f:
                        out.append((p, pq.ParquetFile(f).metadata.num_rows, None))
                except Exception as e:  # noqa: BLE001  any damage of a file
                    out.append((p, None, str(e) or type(e).__name__))
            yield pd.DataFrame({"path": [x[0] for x in out], "rows": pd.array([x[1] for x in out], dtype="Int64"), "error": [x[2] for x in out]})

    return paths.select(F.regexp_replace(F.col(path), "^file:/(?=[^/])", "file:///").alias("path")).mapInPandas(run, "path string, rows long, error string")


def run_folders(spark: SparkSession, root: str, marker: str = "config.yaml") -> DataFrame:
    """(folder, config): each folder below ``root`` that holds the marker file, with its text."""
    files = read_tree(spark, root, (marker,))
    exact = files.where((F.col("path") == marker) | F.endswith(F.col("path"), F.lit("/" + marker)))
    return exact.select(F.regexp_replace("path", r"(^|/)[^/]*$", "").alias("folder"), F.col("text").alias("config"))


def with_config(datasets: DataFrame, configs: DataFrame, path: str = "path") -> DataFrame:
    """config and config_folder of each dataset path: of its own folder, else of the one above, else null.

    configs: (folder, config), as of ``run_folders``; paths are relative to one root.
    """
    up = lambda c: F.regexp_replace(c, r"(^|/)[^/]*$", "")
    rows = datasets.withColumn("__own", up(F.col(path))).withColumn("__above", F.when(F.col("__own") != "", up(F.col("__own"))))
    own, above = configs.select(F.col("folder").alias("__own"), F.col("config").alias("__c1")), configs.select(F.col("folder").alias("__above"), F.col("config").alias("__c2"))
    joined = rows.join(own, "__own", "left").join(above, "__above", "left")
    folder = F.when(F.col("__c1").isNotNull(), F.col("__own")).when(F.col("__c2").isNotNull(), F.col("__above"))
    return joined.withColumns({"config": F.coalesce("__c1", "__c2"), "config_folder": folder}).drop("__own", "__above", "__c1", "__c2")


def read_source(spark: SparkSession, source: dict, fetch: Callable[[str], bytes] | None = None, pdf_text: Callable[[bytes], str] | None = None) -> DataFrame:
    """(name, text, error) of one source by its kind: text, file, folder, url, pdf or section.

    url and pdf go through the caller's ``fetch`` and ``pdf_text`` in a task;
    what fails there is a row with its error. section is what stands between two
    marks, ends included, of another source ({of, start, end}).
    """
    kind = source["kind"]
    no_error = F.lit(None).cast("string").alias("error")
    name = F.lit(source.get("name", source.get("path", source.get("url", kind))))
    if kind == "text":
        return spark.createDataFrame([(source["text"],)], "text string").select(name.alias("name"), "text", no_error)
    if kind == "folder":
        return read_tree(spark, source["path"], tuple(source.get("extensions", ())), source.get("recursive", True)).select(F.col("path").alias("name"), "text", no_error)
    if kind == "file":
        return spark.read.text(source["path"], wholetext=True).select(name.alias("name"), F.col("value").alias("text"), no_error)
    if kind == "section":
        inner = read_source(spark, source["of"], fetch, pdf_text)
        return inner.select("name", section_between(F.col("text"), source["start"], source["end"]).alias("text"), "error")
    if kind not in ("url", "pdf"):
        raise ValueError(f"unknown kind of source: {kind}")
    if kind == "pdf" and pdf_text is None or "url" in source and fetch is None:
        raise ValueError(f"no function that reads a {kind}")
    if "url" in source:
        rows = spark.createDataFrame([(source["url"],)], "location string").withColumn("content", F.lit(None).cast("binary"))
    else:
        rows = spark.read.format("binaryFile").load(source["path"]).select(F.col("path").alias("location"), "content")

    def read(location, content):
        try:
            data = content if content is not None else fetch(location)
            return (pdf_text(data) if kind == "pdf" else data.decode("utf-8", "replace")), None
        except Exception as e:  # noqa: BLE001  a fetch or a parser may fail in any way
            return None, str(e) or type(e).__name__

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([read(*x) for x in zip(pdf["location"], pdf["content"])], columns=["text", "error"])

    return rows.mapInPandas(run, "text string, error string").select(name.alias("name"), "text", "error")


def read_sources(spark: SparkSession, sources: list[dict], **readers) -> DataFrame:
    """(name, text, error) of several sources."""
    out = None
    for source in sources:
        part = read_source(spark, source, **readers)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no sources")
    return out


def one_file(files: DataFrame, seed: int) -> DataFrame:
    """One file of a tree (path, text), drawn by a hash of its path."""
    return choose(files, seed, ["path"])


def _files(name: str, content: bytes | None, extensions: tuple[str, ...]) -> Iterator[tuple]:
    """(archive, path, text, error) of an archive's files, one after the other."""
    if content is None:
        yield name, None, None, "no content"
        return
    found = False
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as tar:
            for member in tar:
                found, path = True, posixpath.normpath(member.name)
                if member.isfile() and not path.startswith(("/", "..")) and (not extensions or path.endswith(extensions)):
                    yield name, path, tar.extractfile(member).read().decode("utf-8", "replace"), None
    except (tarfile.TarError, OSError, EOFError, zlib.error) as e:
        if found or not isinstance(e, tarfile.ReadError):
            yield name, None, None, str(e) or type(e).__name__
            return
        try:
            yield name, name, gzip.decompress(content).decode("utf-8", "replace"), None
        except (OSError, EOFError, zlib.error) as inner:
            yield name, None, None, str(inner) or type(inner).__name__


def _frames(rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
    """Frames of a bounded number of characters, but for the last text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2] or "")
        if size > FRAME_CHARS or len(held) >= 4096:
            yield pd.DataFrame(held, columns=["archive", "path", "text", "error"])
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=["archive", "path", "text", "error"])


def unpack_archives(archives: DataFrame, extensions: tuple[str, ...] = ()) -> DataFrame:
    """(archive, path, text, error) of the files in tar archives (archive, content).

    Members that lead outside, links and devices are never read; an archive that
    is a single compressed file is one text of its own name. One that can't be
    read, or breaks off, is a row with its error after the files before; null
    content is an error. A task holds one archive and some texts.
    """

    def run(batches):
        yield from _frames(row for pdf in batches for x in zip(pdf["archive"], pdf["content"]) for row in _files(*x, extensions))

    return archives.select("archive", "content").mapInPandas(run, _FILES)


def fetch_archives(locations: DataFrame, fetch: Callable[[str], bytes], extensions: tuple[str, ...] = (), attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(archive, path, text, error) of the files in the archives that ``fetch`` gives for each location (archive), fetched and unpacked in one pass.

    A location that can't be fetched after some attempts is a row with its error; a null one is left out.
    """

    def files(location):
        try:
            content = with_retry(lambda: fetch(location), attempts, sleep)
        except Exception as e:  # noqa: BLE001  a fetch may fail in any way
            yield location, None, None, str(e) or type(e).__name__
            return
        yield from _files(location, content, extensions)

    def run(batches):
        yield from _frames(row for pdf in batches for location in pdf["archive"] for row in files(location))

    return locations.where("archive IS NOT NULL").select("archive").mapInPandas(run, _FILES)


def write_json(rows: DataFrame, path: str, name: Column | None = None, folder: str = "config") -> None:
    """JSON lines; with ``name`` a folder ``folder=<name>`` for each name, such as a configuration's digest."""
    if name is None:
        rows.write.json(path)
    else:
        rows.withColumn(folder, name).write.partitionBy(folder).json(path)


def upload_folder(spark: SparkSession, root: str, put: Callable[[str, bytes], None], skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, error): every file below ``root`` through ``put`` in tasks, but for names that end in ``skip``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")

    def run(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                if path.endswith(skip) and skip:
                    continue
                relative = path.split(root.rstrip("/") + "/", 1)[-1]
                try:
                    put(relative, content)
                    out.append((relative, None))
                except Exception as e:  # noqa: BLE001
                    out.append((relative, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "error"])

    return files.mapInPandas(run, "path string, error string")
