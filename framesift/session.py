"""Session and shared storage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

# Hadoop's names of schemes and Arrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def get_spark(app: str = "framesift", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine expects; settings given on the command line win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_framesift_shipped", False):
        return
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(to := Path(tempfile.mkdtemp()) / "framesift.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(to))
    sc._framesift_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a fresh local folder is set on a local master, as in tests;
    a cluster's machines wouldn't share it, so a RuntimeError is raised there."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = getattr(sc, "_framesift_dir", None)
        if not at:
            if not sc.master.startswith("local"):
                raise RuntimeError(f"spark.checkpoint.dir must name a folder that the machines of {sc.master} share")
            at = "file://" + tempfile.mkdtemp(prefix="framesift-")
        sc._framesift_dir = at
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. What lies there is read lazily; `clear` deletes it once results are written."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    spark.sparkContext._framesift_paths = [*getattr(spark.sparkContext, "_framesift_paths", []), path]
    return path


def clear(spark: SparkSession) -> None:
    """Delete all that shared_path gave out. DataFrames that read it can't be used afterwards; checkpoints are the session's cleaner's."""
    for path in getattr(spark.sparkContext, "_framesift_paths", []):
        remove(spark, path)
    spark.sparkContext._framesift_paths = []
    spark.sparkContext._framesift_cleared = getattr(spark.sparkContext, "_framesift_cleared", 0) + 1


def shared_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system and path of a URI as Hadoop writes it.

    A URI without scheme is a local path; schemes that Arrow doesn't know raise its error."""
    scheme, found, rest = uri.partition(":")
    if not found:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: repartitioned only where it comes in fewer partitions than there are cores, as a table of one small file does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
