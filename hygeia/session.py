"""Session construction and small plan helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rule tables are broadcast only below both bounds; above them the join is a
# shuffle join and AQE (skew join enabled) re-plans it at run time.
BROADCAST_MAX_ROWS = 500_000
BROADCAST_MAX_BYTES = 256 * 1024 * 1024

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(master: str | None = None, app: str = "hygeia",
                shuffle_partitions: int | None = None, driver_memory: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        builder = builder.config("spark.driver.memory",
                                 driver_memory or os.environ.get("HYGEIA_DRIVER_MEMORY", "16g"))
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared (distributed) folder and is used
    as is.  Only when it is unset (local tests) a fresh folder is created.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="hygeia-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                    max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only when a measured size bound holds.

    Counts at most ``max_rows + 1`` rows and their JSON byte size (one small
    aggregate over the already small side); otherwise returns ``df`` so the
    planner uses a shuffle join.
    """
    probe = df.limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))),
                   F.lit(0)).alias("b"),
    ).first()
    if probe["n"] <= max_rows and probe["b"] <= max_bytes:
        return F.broadcast(df)
    return df


def measured(df: DataFrame) -> DataFrame:
    """``df``, a written table, for the right side of a join: by broadcast below the bounds of ``sized_broadcast``, else by
    sort-merge, whatever its file's size lets Spark think of it.  Its rows are counted from the file's footers first."""
    if df.count() > BROADCAST_MAX_ROWS:
        return df.hint("merge")
    small = sized_broadcast(df)
    return df.hint("merge") if small is df else small


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Remove a query's shuffle files once it has ended (its result is a written table by then)."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared checkpoint folder and read it back.

    Cuts the lineage (small logical plans downstream, no recomputation after an
    executor loss) while keeping parquet column pruning and statistics.  The
    shuffle files behind it go once it is written, so a chain of tables takes the
    disk of its largest step and not of all steps.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    with shuffle_cleanup(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that no later plan reads."""
    for df in tables:
        sc, files = df.sparkSession.sparkContext, df.inputFiles()
        if files:
            p = sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(files[0])).getParent()
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
