"""Session helpers: a default builder, the shared scratch folder, materialised tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tessella", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every plan here expects (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset a session on one machine gets a folder
    of our own; a cluster must name one, since its machines share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = getattr(sc, "_tessella_shared", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="tessella-")
        sc._tessella_shared = own
        sc.setCheckpointDir(own)
        atexit.register(_remove, sc, own)
    return f"file://{own}"


def _remove(sc, path: str) -> None:
    try:
        fs_path = sc._jvm.org.apache.hadoop.fs.Path(path)
        fs_path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(fs_path, True)
    except Exception:  # the JVM has gone: the folder stays for the cluster's own clean-up
        pass


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours; that it can't be deleted is no error."""
    _remove(spark.sparkContext, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's scratch folder, which is deleted when the driver exits."""
    root = f"{shared_dir(spark)}/tessella-{spark.sparkContext.applicationId}"
    if not getattr(spark.sparkContext, "_tessella_scratch", None):
        spark.sparkContext._tessella_scratch = root
        atexit.register(_remove, spark.sparkContext, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(spark: SparkSession, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends there and any
    executor can reread it."""
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._tessella_path = path
    return written


def release(*tables: DataFrame | None) -> None:
    """Delete materialised tables that no later result reads; anything else is left alone."""
    for df in tables:
        path = getattr(df, "_tessella_path", None)
        if path:
            _remove(df.sparkSession.sparkContext, path)
            df._tessella_path = None


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_tessella_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tessella-zip-")
    target = os.path.join(folder, "tessella_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(here):
            for n in names:
                if n.endswith((".py", ".json")):
                    full = os.path.join(base, n)
                    z.write(full, os.path.join("tessella", os.path.relpath(full, here)))
    sc.addPyFile(target)
    sc._tessella_shipped = True
