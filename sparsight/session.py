"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(app: str = "sparsight", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **{k.replace("__", "."): str(v) for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sparsight-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "sparsight.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local
    master may fall back to a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = _local_scratch.get(context.applicationId)
        if base is None:
            base = tempfile.mkdtemp(prefix="sparsight-")
            _local_scratch[context.applicationId] = base
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/sparsight/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the scratch folder.

    DataFrames that rest on it can no longer be read afterwards.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "x")).getParent()
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.delete(folder, True)


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting that holds for the jobs begun inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def released_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Jobs begun inside drop their shuffle files when they end, not when the driver collects its garbage.

    For jobs whose result is written, so that nothing reads their shuffles again.
    """
    return setting(spark, _RELEASE, "true")


def small_batches(spark: SparkSession, size: int = 8 << 20) -> AbstractContextManager[None]:
    """Python workers of jobs begun inside get Arrow batches of about ``size`` bytes, however long their rows are."""
    return setting(spark, _BATCH_BYTES, str(size))


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to shared storage and read it back.

    Cuts the lineage in a way that survives the loss of executors, and fixes
    values such as partition-derived ids that a recomputation could change.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with released_shuffles(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
