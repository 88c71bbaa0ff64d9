"""Session settings and the places a query may write to."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
}


def session(name: str = "kgspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (UTC, AQE, last-win maps)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset, a folder of our own is taken, in local mode only: on a
    cluster a driver-local folder would be invisible to the executors.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        Path("/tmp/checkpoints").mkdir(exist_ok=True)
        at = tempfile.mkdtemp(prefix="kgspark-", dir="/tmp/checkpoints")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/kgspark-{name}-{uuid.uuid4().hex[:12]}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, path: str) -> DataFrame:
    """Write df and read it back. What it shuffled is deleted once it is written: a later reader needs the files only."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    return _written(df, scratch(df.sparkSession, name))


class Scratch:
    """Intermediates under the shared folder, deleted one by one or all at the end of a `with` block."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.names = spark, scratch(spark, name), 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """As materialise(), under this folder."""
        self.names += 1
        path = f"{self.path}/{self.names}-{name}"
        out = _written(df, path)
        out.kg_path = path
        return out

    def drop(self, *written: DataFrame) -> None:
        """Delete what write() gave, which nothing may read again."""
        for df in written:
            drop_path(self.spark, df.kg_path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        drop_path(self.spark, self.path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system (so it also works on remote stores)."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of rows in a batch that goes to a Python worker, about.
BATCH_BYTES = 4 << 20
#: Python workers stay for the next stages: what one stage freed goes back to the system, so that the executor has it.
WORKER_MEMORY = {"MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "131072", "MALLOC_MMAP_THRESHOLD_": "262144", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def workers_import_this(spark: SparkSession) -> None:
    """Let Python workers on a shared file system import this package from where the driver has it.

    On a cluster without one, ship the package with --py-files instead.
    """
    # whole texts: keep Arrow batches small, in rows and in bytes (a batch of long texts lies in the JVM and in its worker at once)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    for key, value in WORKER_MEMORY.items():
        env.setdefault(key, value)
    have = env.get("PYTHONPATH", "").split(":")
    if ROOT not in have:
        env["PYTHONPATH"] = ":".join([ROOT, *filter(None, have)])


def exact_ids(rows, name: str = "doc_id"):
    """rows whose ids went through Python as text, as numbers again: a pandas column of numbers with a null holds floats, which round large ids."""
    from pyspark.sql import functions as F

    return rows.withColumn(name, F.col(name).cast("long"))


def plain(batch):
    """A pandas batch whose string columns are plain objects: chunked Arrow strings can't be handed back to Spark."""
    strings = [c for c in batch.columns if str(batch[c].dtype).startswith(("str", "string"))]
    return batch.astype({c: object for c in strings}) if strings else batch


def unused(name: str, df: DataFrame) -> str:
    """The name, with so many _ after it that no column of df bears it (names are compared without regard to case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
