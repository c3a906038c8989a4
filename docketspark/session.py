"""Session helpers: defaults, shared scratch tables and shipping of the package to executors."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SHIPPED: set[str] = set()
_SCRATCH: list[tuple[SparkSession, str]] = []


def build_session(app_name: str = "docketspark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings that every operator assumes: UTC, adaptive execution, skew-join splitting."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a driver temp folder only where it is unset and the master is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names the folder that driver and executors share; it is not set")
        found = "file://" + tempfile.mkdtemp(prefix="docketspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and any executor can be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docketspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
_BEFORE: dict[str, str | None] = {}


_BY_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": str(2**31 - 1)}


def _set_batches(spark: SparkSession, settings: dict[str, str]) -> None:
    for key, value in settings.items():
        if spark.conf.get(key, None) != value:
            _BEFORE.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)


def small_batches(spark: SparkSession, few_rows: bool = True) -> None:
    """Arrow batches so small that batches of long texts, which both sides hold outside the heap, fit beside it; until ``usual_batches``.
    Without ``few_rows`` only their bytes are bounded."""
    _set_batches(spark, {key: value for key, value in _BATCHES.items() if few_rows or "Records" not in key})


def short_rows(spark: SparkSession) -> None:
    """Arrow batches by number of rows alone, until ``usual_batches``: for rows so short that to ask for a batch's bytes after each costs more
    than the row."""
    _set_batches(spark, _BY_ROWS)


def usual_batches(spark: SparkSession) -> None:
    """The session's own batches again, where ``small_batches`` has changed them."""
    for key, value in _BEFORE.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)
    _BEFORE.clear()


def lean(run: Callable) -> Callable:
    """A task's function that gives memory back when it ends: workers outlive tasks, and what they hold adds to the executor's."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, deleted with the scratch tables."""
    path = f"{shared_dir(spark)}/docketspark/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


_KEPT: dict[tuple, tuple[SparkSession, str, StructType]] = {}


def fingerprint(df: DataFrame) -> str:
    """Tells one state of a table's files from another, by their names, sizes and times; empty for rows that are in no files."""
    try:
        files = df.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("long")).alias("file"))
    except AnalysisException:
        return ""
    found = files.distinct().agg(F.count("*").alias("n"), F.bit_xor("file").alias("all")).first()
    return f"{found['n']}:{found['all']}"


def kept(spark: SparkSession, key: tuple, make: Callable[[], DataFrame], partition_by: str | None = None, path: str | None = None) -> DataFrame:
    """A table made once: for the application, in its shared folder; or under ``path``, where it stays and later applications find it.

    ``key`` says what it holds; where it has a fingerprint of the data, other data make another table.
    """
    name = hashlib.sha256(repr(key).encode()).hexdigest()[:32]
    own = (spark.sparkContext.applicationId, path, *key)
    if own not in _KEPT:
        at = f"{path.rstrip('/')}/{name}" if path else f"{shared_dir(spark)}/docketspark/kept-{uuid.uuid4().hex}"
        made = make()
        if not path or not exists(spark, f"{at}/_SUCCESS"):
            writer = made.write.mode("overwrite").option("compression", "zstd")
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(at)
        _KEPT[own] = (spark, at, made.schema)
    _, at, schema = _KEPT[own]
    return spark.read.schema(schema).parquet(at)


def _file_system(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    system, found = _file_system(spark, path)
    return system.exists(found)


def release(everything: bool = False) -> None:
    """Delete the scratch tables written so far, when the results that read them have been stored. Indexes stay, unless ``everything`` goes;
    those with a path of their own stay in any case."""
    gone = [*_SCRATCH, *(found[:2] for key, found in _KEPT.items() if everything and key[1] is None)]
    _SCRATCH.clear()
    for spark, path in gone:
        try:
            system, found = _file_system(spark, path)
            system.delete(found, True)
        except Exception:  # noqa: BLE001 - at exit the JVM may be gone already
            return


atexit.register(release, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that no executor needs it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="docketspark-zip-"), "docketspark-package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its input has fewer splits than that, as a small table in one file has; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores in any case: for rows of a few bytes that much is done with. They are so many a file that the file's
    splits, and its row groups still more, are fewer than the cores."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
