"""Session settings, size-checked broadcasts and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from marlstone.errors import ConfigError

# A query block kept in a Python worker (vectors, vocabularies) is at most this large.
BLOCK_ROWS = 4_096


SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Whole texts travel in Arrow batches, so bound them by rows and by bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 * 1024 * 1024),
}

# For tables whose rows have MBs. Parquet looks at sizes every 100 rows, so that a task's rows were one page, held as a whole
# (and several times over, beside the heap) by whoever writes or reads it. These make each row a page and a few rows a row group.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.row.count.limit": "1", "parquet.block.size": str(4 * 1024 * 1024)}


def build_session(app: str = "marlstone", master: str | None = None, **extra: str) -> SparkSession:
    """A session tuned for this workload; a cluster passes its own master and sizes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """Apply the settings to a session built elsewhere; all of them can change at runtime."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates, named by ``spark.checkpoint.dir``.

    Only a local master, whose tasks share one disk, may do without and gets a temporary
    folder. Elsewhere each executor would write to a disk that the others cannot read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ConfigError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a stage result as a table and read it back: cuts lineage, survives executor loss.

    ``options`` go to the writer. The table goes when the application ends.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").options(**options or {}).parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that a newer one replaces, so that rounds of a loop don't add up on disk."""
    context = df.sparkSession.sparkContext
    for folder in {os.path.dirname(name) for name in df.inputFiles()}:
        place = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for per-row work on an input with fewer splits than cores.

    Such an input is small (below cores x split size); larger ones are left as they are
    read. Rows move by a unique key, so a lost task is recomputed to the same rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def collect_if_small(df: DataFrame, rows: int = BLOCK_ROWS) -> list[Row] | None:
    """Rows of a small table, or None when it is larger than the bound."""
    taken = df.limit(rows + 1).collect()
    return taken if len(taken) <= rows else None


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Needed only where the package is not installed on the executors.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = Path(SparkFiles.getRootDirectory()) / "packages"
    folder.mkdir(exist_ok=True)
    archive = folder / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
