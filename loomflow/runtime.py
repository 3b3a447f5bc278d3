"""Session set-up, shared-folder materialisation and null-safe join helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: AQE re-plans joins, merges small partitions and splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100MB",
    "spark.ui.enabled": "false",
}

_written: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives executors this package's code, once per application: their Python workers import it
    when they run an operator's functions, and needn't have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix=f"{package.name}-", suffix=".zip")  # the driver serves it
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(path)
    atexit.register(lambda: os.path.exists(path) and os.remove(path))


def session(app: str = "loomflow", master: str | None = None, conf: dict[str, str] | None = None, remote: str | None = None) -> SparkSession:
    """A session with the engine's defaults; ``conf`` wins over them. ``remote`` is the address of
    a Spark Connect server, on which operators that need the JVM or broadcast variables don't run."""
    builder = SparkSession.builder.appName(app)
    if remote:
        builder = builder.remote(remote)
    elif master:
        builder = builder.master(master)
    for name, value in (DEFAULT_CONF | (conf or {})).items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    if not remote:
        ship(spark)
    return spark


def prewarm(spark: SparkSession) -> int:
    """Starts executors and their Python workers before the first query; gives the tasks run."""
    tasks = spark.sparkContext.defaultParallelism
    warm = spark.range(0, tasks, 1, tasks).mapInPandas(lambda parts: parts, "id long")
    return warm.repartition(tasks).count()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's
    checkpoint folder, else (local runs only) a fresh temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="loomflow-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts lineage like ``checkpoint()`` but is columnar and compressed, so a
    later pass reads only its columns, and a lost executor loses nothing.
    Folders are deleted when the Python process ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``release`` deletes."""
    path = f"{shared_dir(spark)}/loomflow/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def files_of(spark: SparkSession, path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; one without a scheme is on the session's default."""
    return open_path(path, spark.conf.get("spark.hadoop.fs.defaultFS", None))


def open_path(path: str, default: str | None = None) -> tuple[fs.FileSystem, str]:
    """``files_of`` for tasks, which have no session."""
    if "://" not in path and not path.startswith("file:"):
        path = (default or "").rstrip("/") + os.path.abspath(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(path[5:]).lstrip("/")
    return fs.FileSystem.from_uri(path)


def exists(spark: SparkSession, path: str) -> bool:
    files, at = files_of(spark, path)
    return files.get_file_info(at).type != fs.FileType.NotFound


@atexit.register
def release() -> None:
    """Deletes all tables that ``materialize`` wrote. Long-lived sessions call it once results
    that read them are written; it also runs when Python ends."""
    while _written:
        spark, path = _written.pop()
        try:
            files, at = files_of(spark, path)
            if files.get_file_info(at).type != fs.FileType.NotFound:
                files.delete_dir(at)
        except Exception:  # the session may be gone already
            return


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality over column pairs; Catalyst still hashes or sorts on it."""
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return condition
