"""Writers: JSON lines, split fan-out, content pools and named files, snapshots with a legacy form, report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.curate import SPLITS
from tessella.sources import blobs, versions
from tessella.sources.ordering import write_ordered


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; null fields are left out, as optional keys are."""
    df.drop("_ord").write.mode("overwrite").json(path)


def write_splits(frozen: DataFrame, path: str) -> None:
    """One folder per split, empty ones too. A split's files hold consecutive ranges of fid, so that read
    by name they give all its rows in fid order."""
    columns = [c for c in ("audio", "fid", "text", "audio_sha256", "label", "text_source", "source_sha256", "provenance") if c in frozen.columns]
    kept = frozen.where(F.col("why").isNull()) if "why" in frozen.columns else frozen
    for split in SPLITS:
        write_ordered(kept.where(F.col("split") == split), f"{path}/{split}", ["fid"], columns)


def write_training(prepared: DataFrame, path: str) -> None:
    """Exactly the two columns a trainer reads."""
    write_jsonl(prepared.where("reason is null").select("audio", "text"), path)


def content_pool(rows: DataFrame) -> DataFrame:
    """One row per distinct content: its hash, the pool name and the bytes."""
    keyed = rows.withColumn("sha256", F.sha2("content", 256))
    return keyed.groupBy("sha256").agg(F.first("content").alias("content")).withColumn("name", F.concat("sha256", F.lit(".wav")))


def add_to_pool(spark: SparkSession, rows: DataFrame, path: str, suffix: str = ".wav") -> None:
    """Store contents in the pool at ``path``, a file each, under names that are their hashes; what the pool
    holds already stays as it is. ``rows`` has ``content``; equal contents are found where they lie."""
    blobs.register(spark)
    rows.where("content is not null").select("content").write.format("content_pool").mode("append").option("suffix", suffix).save(path)


def write_files(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """A file for each row of ``rows`` (name, content) below ``path``; of rows with one name one is kept."""
    blobs.register(spark)
    rows.select("name", F.col("content").cast("binary").alias("content")).write.format("content_pool").mode("append").save(path)


def read_snapshot(spark: SparkSession, path: str, legacy: DataFrame) -> DataFrame:
    """The newest version, or the legacy rows where no version was ever saved."""
    return versions.read(spark, path) if versions.current(spark, path) else legacy


def sidecars(cases: DataFrame) -> DataFrame:
    """(path, json) of the sidecar document of each output."""
    meta = [c for c in cases.columns if c != "output"]
    return cases.where("output is not null").select(F.regexp_replace("output", "\\.[^./]*$", ".json").alias("path"), F.to_json(F.struct(*meta)).alias("json"))


def safe_relative(path):
    """Whether a path stays below its root: relative and never above it at any point."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    depth = F.aggregate(
        F.split(p, "/"),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda a, s: F.transform(F.array(a["d"] + F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)), lambda d: F.struct(d.alias("d"), F.least(a["low"], d).alias("low")))[0],
    )
    return ~p.startswith("/") & ~F.regexp_like(p, F.lit("^[A-Za-z]:")) & (depth["low"] >= 0)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A report table; reports are small by nature and cut at ``limit`` rows."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows])
