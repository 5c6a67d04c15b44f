"""Readers with declared schemas and an explicit order column. All go through Spark's own sources, so
any store that Spark can read will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import text as tx
from tessella.operators.enrich import latest, slashed
from tessella.sources.ordering import numbered, with_order

AUDIO_SUFFIXES = (".wav", ".ogg", ".flac", ".mp3")

MANIFEST = "audio string, text string, label string, event string, wem_hash bigint, source_wem string, tool string"
PROVENANCE = "file string, text string, label string, event string, wem_hash bigint, source_wem string, tool string"
METRICS = "struct<ok:boolean,sample_rate:int,duration_s:double,peak:double,rms_dbfs:double,clipped_samples:bigint,silence_ratio:double,finite:boolean>"
INDEX = f"source string, label string, text string, metrics {METRICS}, flags array<string>, source_sha256 string, provenance map<string,string>, status string, reason string, audio_sha256 string, audio string, text_asr string"
SPLIT = "audio string, fid string, text string, audio_sha256 string, label string, text_source string, source_sha256 string, provenance map<string,string>"
DECISIONS = "drop array<string>, exclude array<string>, tags map<string,array<string>>, saved_at string"
REPORT = "results array<struct<source:string,case_id:string,speaker_cos:double,wav:string,cer:double,edit_distance:bigint,ref_chars:bigint,hypothesis:string>>"
CASES = "cases array<struct<case_id:string,status:string,text:string,seed:bigint,prompt_sha256:string,output:string,output_sha256:string,effective_args:map<string,string>>>, model map<string,string>"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines table with ``_ord``, its rows' places by file and line; blank lines are skipped."""
    return with_order(spark.read.schema(schema).json(path))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of text files, blank ones too, by ``_ord`` (from 0 over all files), ``_file`` and ``_line``
    (from 1 in each file)."""
    return numbered(spark, with_order(spark.read.text(path)))


def manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """Import rows in the order of their lines; a line that isn't an object, or has no ``audio`` key, fails
    the read with its file, number and text."""
    lines = numbered_lines(spark, path).where(F.regexp_replace("value", r"\s", "") != "")
    problem = F.when(~tx.is_json_object(F.col("value")), F.lit("not an object: ")).when(~F.array_contains(F.json_object_keys("value"), "audio"), F.lit("row without audio: "))
    told = F.concat(F.lit("manifest line "), F.col("_line").cast("string"), F.lit(" of "), F.col("_file"), F.lit(": "), problem, F.col("value"))
    row = F.when(problem.isNotNull(), F.raise_error(told).cast("string")).otherwise(F.col("value"))
    return lines.select(F.from_json(row, schema).alias("r"), "_ord", "_file", "_line").select("r.*", "_ord", "_file", "_line")


def ok_rows(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, INDEX).where("status = 'ok'")


def document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One nested JSON document per file as a row."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar rows by slash-normalised file; the last one of a file holds."""
    rows = jsonl(spark, path, PROVENANCE)
    return latest(rows.withColumn("file", slashed(F.col("file"))), "file", "_ord")


def report(spark: SparkSession, path: str) -> DataFrame:
    """Result rows keyed by source, else by case; the last one of a key holds."""
    rows = document(spark, path, REPORT).select(F.posexplode("results").alias("_ord", "r")).select("_ord", "r.*")
    return latest(rows.withColumn("key", slashed(F.coalesce("source", "case_id"))), "key", "_ord")


def prior_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of an earlier experiment; without a manifest the table is empty."""
    wanted = document(spark, path, CASES) if exists(spark, path) else spark.createDataFrame([], CASES)
    return wanted.select(F.explode("cases").alias("c"), F.try_element_at("model", F.lit("revision")).alias("model_revision")).select("c.*", "model_revision")


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_valid(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first document that is there and is valid JSON of the schema; without one an empty table."""
    wide = T._parse_datatype_string(schema + ", _bad string")
    for path in paths:
        if exists(spark, path):
            doc = spark.read.schema(wide).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
            broken = doc.select(F.col("_bad").isNotNull().alias("broken"), *(F.col(c).isNull() for c in doc.columns[:1])).first()  # one document
            if broken is None or not broken.broken:
                return doc.drop("_bad")
    return spark.createDataFrame([], schema)


def first_root(rows: DataFrame, listing: DataFrame, path: str, roots: list[str]) -> DataFrame:
    """The file of each row: its path below the first root that has it, null where none does. ``listing`` has
    rel."""
    tried = rows.select(path, F.posexplode(F.array(*(F.concat(F.lit(r), F.col(path)) for r in roots))).alias("rank", "rel"))
    hits = tried.join(listing.select("rel").distinct(), "rel").groupBy(path).agg(F.min_by("rel", "rank").alias("file"))
    return rows.join(hits, path, "left")


def files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = AUDIO_SUFFIXES, content: bool = False) -> DataFrame:
    """Files below ``root`` by suffix: path, relative path, size, and hash when ``content``."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.col("path"), "^.*?\\Q" + root.rstrip("/").split("://")[-1].lstrip("/") + "\\E/", "")
    rows = df.withColumn("rel", F.url_decode(F.replace(rel, F.lit("+"), F.lit("%2B"))))
    rows = rows.where(tx.path_parts(F.col("rel"))["suffix"].isin(*suffixes))
    return rows.select("path", "rel", "length", *([F.sha2("content", 256).alias("sha256"), "content"] if content else []))


def resolve_files(keys: DataFrame, listing: DataFrame) -> DataFrame:
    """The file of each key: the exact path, else, for keys without a suffix, the key with an audio suffix
    in order, else any file of that stem below. ``keys`` has key; ``listing`` has rel."""
    parts = tx.path_parts(F.col("key"))
    rank = F.array_position(F.array(*map(F.lit, AUDIO_SUFFIXES)), F.col("suffix"))
    f = tx.path_parts(F.col("rel"))
    have = listing.select("rel", f["suffix"].alias("suffix"), F.regexp_replace("rel", "\\.[^./]*$", "").alias("bare"), f["stem"].alias("stem")).withColumn("rank", rank)
    wanted = keys.select("key").distinct().withColumn("plain", parts["suffix"] == "").withColumn("leaf", parts["name"])
    pick = lambda df, tier: df.select("key", F.struct(F.lit(tier).alias("tier"), "rank", "rel").alias("hit"))
    hits = (
        pick(wanted.join(have, F.col("key") == F.col("rel")), 0)
        .unionByName(pick(wanted.where("plain").join(have, F.col("key") == F.col("bare")), 1))
        .unionByName(pick(wanted.where("plain").join(have, F.col("leaf") == F.col("stem")).withColumn("rank", F.lit(0)), 2))
    )
    best = hits.groupBy("key").agg(F.min("hit").alias("hit"))
    return keys.join(best, "key", "left").withColumn("rel", F.col("hit.rel")).drop("hit")


def import_rows(manifest_rows: DataFrame, listing: DataFrame, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(imported, missing): manifest rows with their file and target path, first row of a target wins."""
    found = resolve_files(manifest_rows.withColumnRenamed("audio", "key"), listing)
    lab = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit(label))
    p = tx.path_parts(F.col("rel"))
    target = F.concat_ws("/", lab, F.concat(p["stem"], p["suffix"]))
    rows = found.where("rel is not null").withColumn("label", lab).withColumn("target", target)
    best = rows.groupBy("target").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "target"]), F.col("_ord")).alias("b"))
    return best.select("target", "b.*"), found.where("rel is null").select("key")


def text_scripts(spark: SparkSession, root: str) -> DataFrame:
    """Whole text files below ``root`` except read-me files, by name."""
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    name = F.url_decode(F.element_at(F.split(F.input_file_name(), "/"), -1))
    return df.select(name.alias("name"), F.col("value").alias("text")).where(~F.lower("name").startswith("readme"))


def asr_targets(index: DataFrame, cases: DataFrame, pairs: DataFrame) -> DataFrame:
    """What to recognise: index rows, case outputs and ad-hoc pairs as (kind, key, audio, text)."""
    one = lambda df, kind, key, audio: df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col(audio).alias("audio"), tx.blank(F.col("text")).alias("text"))
    rows = one(index, "index", "source", "audio").unionByName(one(cases.where("status = 'ok'"), "case", "case_id", "output"))
    return rows.unionByName(one(pairs, "pair", "audio", "audio")).where("audio is not null")


def nested_config(column: Column, key: str) -> Column:
    """The inner configuration where there is one, else the column itself (maps of strings as JSON)."""
    return F.coalesce(F.get_json_object(column, f"$.{key}"), column)
