"""What a session needs before tasks run code of this package, and tables in the folder that the whole cluster shares.

The folder is ``spark.checkpoint.dir``; only where that is unset, as in tests,
is one made.  A written table cuts lineage and outlives any executor.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once in a Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_corvane_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="corvane-")) / "corvane_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent).as_posix())
    sc.addPyFile(str(archive))
    sc._corvane_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as a URI; a cluster must name one, in local mode a temporary one is made where it is unset."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        found = sc._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
            found = sc._jsc.sc().getCheckpointDir()
        configured = found.get()
    return qualified(spark, configured)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder's URI: without a scheme it is on the cluster's default file system, for Spark and for tasks alike."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file:///") else whole


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a URI."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    system, hadoop = _hadoop(spark, path)
    return system.exists(hadoop)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, whether it is there or not."""
    system, hadoop = _hadoop(spark, path)
    system.delete(hadoop, True)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder; false where the target is there already."""
    system, hadoop = _hadoop(spark, source)
    goal = _hadoop(spark, target)[1]
    if system.exists(goal):
        return False
    system.mkdirs(goal.getParent())
    return system.rename(hadoop, goal)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where there is no folder."""
    system, hadoop = _hadoop(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(hadoop)) if system.exists(hadoop) else []


def version(spark: SparkSession, path: str) -> str:
    """A digest of a path's files: names, lengths and times of change; another one after any write."""
    system, hadoop = _hadoop(spark, path)
    files = sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in system.listStatus(hadoop))
    return hashlib.sha256(repr(files).encode()).hexdigest()[:32]


def kept_path(spark: SparkSession, name: str, *parts: str) -> str:
    """A path in the shared folder that the same name and parts lead to again, in this session and later ones."""
    return f"{shared_dir(spark)}/corvane-kept/{name}-{hashlib.sha256(repr(parts).encode()).hexdigest()[:32]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"
    system, hadoop = _hadoop(spark, path)
    system.deleteOnExit(hadoop)
    return path


def publish(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a published table that nothing will read again."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/corvane/" in parent:
            remove(df.sparkSession, parent)


def materialize(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return fresh_path(spark, name)
