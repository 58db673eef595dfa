"""Session settings, shared storage and table loading."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "cueweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tuned for; ``conf`` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is read from ``spark.checkpoint.dir``. Only where that is unset, and the
    master is local, a temporary folder takes its place.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder shared by all executors")
    path = "file://" + tempfile.mkdtemp(prefix="cueweave-")
    spark.conf.set(CHECKPOINT_KEY, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Used where several branches need one expensive result: the table survives a
    lost executor and, unlike an RDD checkpoint, is columnar and compressed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` in as many partitions as shuffles have, by ``columns`` if any.

    For work that is heavy for its bytes: adaptive execution joins small
    partitions by their bytes, unless their number was asked for.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def clear_staged(spark: SparkSession) -> None:
    """Delete the staged tables of the shared folder, once no query that reads them is left."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/staged")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the executors, once per context.

    The driver serves it as an archive, so nothing has to be installed on the
    executors or on their path.
    """
    context = spark.sparkContext
    if getattr(context, "_cueweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="cueweave-package-"), "cueweave.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path(root.name, path.relative_to(root)))
    context.addPyFile(str(archive))
    context._cueweave_shipped = True
