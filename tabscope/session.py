"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every operator relies on; all of them can be changed at run time.
# Shuffle width, executor memory and file split size belong to the cluster and
# are left as it sets them: adaptive execution merges small shuffle partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows may be long texts: a batch is held by the JVM, by Python and on the way between them.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}

# Parts of a table read by many short jobs, and the rows from which there are more of them.
SPREAD = 32
FULLEST = 250_000


def tune(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to a session that already exists."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests, the benchmark and small jobs."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tabscope")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all machines of a cluster share.

    Only a session without executors of its own, as in tests, may leave it
    unset: it gets a temporary folder that is removed when Python ends.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tabscope-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return (folder or context.getCheckpointDir()).rstrip("/")


def parts_for(n: int, wanted: int) -> int:
    """Number of parts for ``n`` rows that many short jobs read again and again.

    Every job pays for every part: a report to the driver, for forests the figures of all nodes too. So
    beyond ``SPREAD`` parts they grow in rows, and in number only once they are full. It follows from the
    rows alone, as draws by part are to be the same on every cluster.
    """
    return max(1, min(wanted, SPREAD), -(-n // FULLEST))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared folder, so that a lost executor cannot change it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
