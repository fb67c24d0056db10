"""Session settings and durable intermediate tables.

Iterative plans cut their lineage by writing a table below the checkpoint
folder and reading it back. A written table survives the loss of executors,
is columnar (later steps read only the columns they use) and gives the
optimizer real sizes, which a checkpointed RDD does not.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .errors import ConfigurationError


def local_session(cpus: int | str = "*", app: str = "pressroom", **extra: str) -> SparkSession:
    """Session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    may fall back to a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    used = spark.sparkContext.getCheckpointDir()
    if used:
        return used
    if not spark.sparkContext.master.startswith("local"):
        raise ConfigurationError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pressroom-"))
    return spark.sparkContext.getCheckpointDir()


class Scratch:
    """One run's intermediate tables, all below a folder of its own.

    ``drop`` deletes the folder once results are published elsewhere; as a
    context manager it does so at the end of the block.
    """

    def __init__(self, spark: SparkSession, label: str = "run") -> None:
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._step = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def drop(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.root)
        folder.getFileSystem(conf).delete(folder, True)

    def path(self, name: str) -> str:
        self._step += 1
        return f"{self.root}/{self._step:04d}-{name}"

    def cut(self, df: DataFrame, name: str, sort_within: Iterable[str] = ()) -> DataFrame:
        """Write ``df`` once and return the written table."""
        where = self.path(name)
        keys = list(sort_within)
        (df.sortWithinPartitions(*keys) if keys else df).write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition only when the input has fewer files than half the cores.

    A small input often is one file with one row group, which one task reads
    alone. Large inputs already come in many splits and are left as they are,
    so at scale this adds no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) * 2 > cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)
