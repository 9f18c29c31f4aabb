"""Session settings and the small helpers every plan shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ZIP = "matchlake-package"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A side is broadcast only if it has at most this many rows, counted when the plan is built.
BROADCAST_ROWS = 10_000


def build_session(master: str = "local[*]", app: str = "matchlake", **conf: str) -> SparkSession:
    """A session with UTC timestamps, adaptive execution and Arrow; ``conf`` overrides or adds settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    spark = SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, wherever the driver was started; once a session."""
    context = spark.sparkContext
    if any(f.endswith(f"{_ZIP}.zip") for f in context.listFiles):
        return
    here, folder = Path(__file__).resolve().parent, tempfile.mkdtemp()  # the driver's own copy; Spark serves it to the executors
    atexit.register(shutil.rmtree, folder, True)
    context.addPyFile(shutil.make_archive(f"{folder}/{_ZIP}", "zip", here.parent, here.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast after counting that it has at most ``max_rows`` rows.

    The count stops at ``max_rows + 1`` rows, so the check is cheap for a table of any size. A larger side
    is returned as it is, and the planner takes a shuffle join, which adaptive execution splits where skewed.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all shuffle partitions: for few bytes that mean much work, which would else be gathered into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir.

    Only where all runs on this machine, as in tests, may it be unset; then a temporary folder is taken. On a cluster that
    would be a folder of each machine's own, so it raises.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="matchlake-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``, but as a compressed columnar table in the shared folder; for many or wide rows.

    The shuffle files of the rows are removed as soon as they are written, and the table when the driver's program ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    schema = df.schema
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    _TABLES.append((spark, path))
    return spark.read.schema(schema).parquet(path)


_TABLES: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_tables() -> None:
    for spark, path in _TABLES:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone: so is the means to remove anything
            return


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
