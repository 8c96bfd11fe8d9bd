"""Session, table loading and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "wrenfield", **conf: str) -> SparkSession:
    """A UTC session for one machine, as tests and the bench use it. On a cluster the caller's session is used."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WRENFIELD_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local master may fall back on a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = getattr(spark.sparkContext, "_wrenfield_dir", None)
    if path is None:
        path = spark.sparkContext._wrenfield_dir = "file://" + tempfile.mkdtemp(prefix="wrenfield-")
    return path


def spooled(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: cuts the lineage, survives lost executors,
    keeps columns prunable and is compressed, which ``checkpoint()`` is not. ``drop_spools`` deletes what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/spool-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _SPOOLS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a small table that are worth a shuffle partition of their own.
PARTITION_ROWS = 10_000


def partitions_for(spark: SparkSession, rows: int) -> int:
    """Shuffle partitions for tables of about so many rows: one for each ``PARTITION_ROWS``, two a core at least, and never
    more than the session has."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(2 * spark.sparkContext.defaultParallelism, -(-rows // PARTITION_ROWS)))


@contextmanager
def shuffled_in(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Shuffles that run within the block have so many partitions: the session's number follows the size of its input, and what
    the driver keeps of a shuffle (maps x partitions) shouldn't where tables are small. Only for what is run there, as
    ``spooled`` does; the session's number is set again after it. Queries of other threads of the session see it too."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


#: Spooled tables by application.
_SPOOLS: dict[str, list[str]] = {}


def drop_spools(spark: SparkSession) -> int:
    """Delete the spooled tables of this application; how many there were. To be called when results are written: tables that
    were made before it can't be read any more."""
    paths = _SPOOLS.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        there = jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(conf).delete(there, True)
    return len(paths)
