"""Session helpers: a local session for tests, and shipping of the package to executors that do not have it."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that Python workers can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="lexisift-")) / "lexisift_pkg.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*")):
                if p.is_file() and "__pycache__" not in p.parts and p.suffix in (".py", ".json", ".txt"):
                    z.write(p, Path(root.name) / p.relative_to(root))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark


def spec(df, keys: list[str]) -> str:
    """The keys with their types as a schema string, in the order of keys: Arrow batches are matched to it by place."""
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def spread(df, per_core: int = 2):
    """Balance the rows of a scan before CPU-heavy Python when it gives fewer splits than there are cores; larger scans pass unshuffled.

    Only for plans without a shuffle of their own: counting the partitions of an adaptive plan would run it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores * per_core)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir, else the one set on the context. A session on one machine without either gets
    a temporary one; on a cluster that would be a folder of one machine, so it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        sc = spark.sparkContext
        current = sc._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexisift-"))
            current = sc._jsc.sc().getCheckpointDir()
        named = current.get()
    return named.rstrip("/")


_kept: set[str] = set()


def durable(df):
    """The rows as a table written once to the shared folder and read again: lineage is cut, nothing is computed twice, and a lost
    executor loses nothing. (A reliable checkpoint computes its input a second time.) The table is written when this is called, so a
    query that uses it works already while it is built. The application's tables are deleted when it ends."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    folder = f"{shared_folder(spark)}/lexisift/{app}"
    if app not in _kept:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).deleteOnExit(path)
        _kept.add(app)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
