"""Queries of the sources and sinks: tables are written by a sink, read back by a reader, and compared with
the table they came from. Written files lie in the application's scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import signals as sg
from tessella.functions import text as tx
from tessella.functions import vectors as vx
from tessella.operators import enrich
from tessella.plans.catalogue import _FREEZE, _frozen, query, split_sql
from tessella.session import scratch_path, table
from tessella.sources import audio, config, ordering, readers, sinks, versions


def _index_file(spark: SparkSession, sf: str) -> str:
    """documents as an index in JSON lines; every fifth row isn't ok."""
    d = table(spark, sf, "documents")
    rows = d.select(F.concat(F.lit("f"), "doc_id", F.lit(".wav")).alias("source"), F.col("lang").alias("label"), "text", F.when(F.col("doc_id") % 5 == 0, "rejected").otherwise("ok").alias("status"))
    path = scratch_path(spark, "index")
    sinks.write_jsonl(rows, path)
    return path


@query("jsonl_scan", "SELECT 'f' || doc_id || '.wav' AS source, lang AS label, sha256(text) AS text_sha, CASE WHEN doc_id % 5 = 0 THEN 'rejected' ELSE 'ok' END AS status FROM documents")
def jsonl_scan(spark, sf):
    return readers.jsonl(spark, _index_file(spark, sf), readers.INDEX).select("source", "label", F.sha2("text", 256).alias("text_sha"), "status")


@query("ok_rows_scan", "SELECT 'f' || doc_id || '.wav' AS source, length(text)::INTEGER AS n FROM documents WHERE doc_id % 5 <> 0")
def ok_rows_scan(spark, sf):
    return readers.ok_rows(spark, _index_file(spark, sf)).select("source", F.length("text").alias("n"))


@query("manifest_scan", "SELECT url AS audio, 'p' || page_id AS label, page_id AS wem_hash, text FROM (SELECT *, CASE WHEN page_id % 3 <> 0 THEN html END AS text FROM pages)")
def manifest_scan(spark, sf):
    p = table(spark, sf, "pages")
    path = scratch_path(spark, "manifest")
    sinks.write_jsonl(p.select(F.col("url").alias("audio"), F.concat(F.lit("p"), "page_id").alias("label"), F.col("page_id").alias("wem_hash"), F.when(F.col("page_id") % 3 != 0, F.col("html")).alias("text")), path)
    return readers.manifest(spark, path).select("audio", "label", "wem_hash", "text")


@query(
    "file_listing",
    "SELECT 's_nationkey=' || s_nationkey AS folder, sum(strlen(s_name) + 1)::BIGINT AS length, sha256(string_agg(s_name || chr(10), '' ORDER BY s_suppkey)) AS sha256 FROM supplier GROUP BY s_nationkey",
)
def file_listing(spark, sf):
    """One text file for each nation, listed below its root with hashes of the contents."""
    root = scratch_path(spark, "files")
    s = table(spark, sf, "supplier")
    s.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey").select("s_name", "s_nationkey").write.partitionBy("s_nationkey").text(root)
    out = readers.files(spark, root, suffixes=(".txt",), content=True)
    return out.select(F.substring_index("rel", "/", 1).alias("folder"), "length", "sha256")


def _sidecar(spark, sf) -> str:
    c = table(spark, sf, "conversations").where("conv_id is not null")
    rows = c.orderBy("conv_id", "turn").select(F.concat(F.lit("c\\"), F.col("conv_id").cast("string"), F.lit(".wav")).alias("file"), "text", F.col("role").alias("label"), F.col("turn").alias("wem_hash"))
    path = scratch_path(spark, "provenance")
    sinks.write_jsonl(rows.coalesce(1), path)  # a sidecar is one file, whose order counts
    return path


@query("provenance_last_wins", "SELECT 'c/' || conv_id || '.wav' AS file, max(turn) AS wem_hash, arg_max(role, turn) AS label FROM conversations GROUP BY conv_id")
def provenance_last_wins(spark, sf):
    return readers.provenance(spark, _sidecar(spark, sf)).select("file", "wem_hash", "label")


_PROVENANCE = """p AS (SELECT conv_id, arg_max(role, turn) AS label, arg_max(coalesce(text, ''), turn) AS text FROM conversations GROUP BY conv_id)"""


@query(
    "provenance_join",
    f"""WITH {_PROVENANCE} SELECT doc_id, sha256(CASE WHEN p.text <> '' THEN p.text ELSE d.text END) AS text_sha, coalesce(p.label, d.lang) AS label FROM documents d LEFT JOIN p ON p.conv_id = d.doc_id""",
)
def provenance_join(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("c/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("source"), "text", F.col("lang").alias("label"))
    c = table(spark, sf, "conversations").select(F.col("turn").alias("_ord"), F.concat(F.lit("c\\"), F.col("conv_id").cast("string"), F.lit(".wav")).alias("file"), "text", F.col("role").alias("label"))
    return enrich.with_provenance(d, c).select("doc_id", F.sha2("text", 256).alias("text_sha"), "label")


_LISTING = "l AS (SELECT s_suppkey AS k, 'd' || s_nationkey || '/' || s_name || ['.wav', '.ogg', '.flac', '.mp3'][1 + s_suppkey % 4] AS rel, 'd' || s_nationkey || '/' || s_name AS bare, s_name AS stem FROM supplier)"


def _listing(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier")
    ext = F.get(F.array(*map(F.lit, (".wav", ".ogg", ".flac", ".mp3"))), F.pmod("s_suppkey", F.lit(4)).cast("int"))
    bare = F.concat(F.lit("d"), "s_nationkey", F.lit("/"), "s_name")
    return s.select(F.col("s_suppkey").alias("k"), F.concat(bare, ext).alias("rel"), bare.alias("bare"), F.col("s_name").alias("stem"))


def _keys(listing: DataFrame) -> DataFrame:
    key = F.when(F.col("k") % 4 == 0, F.col("rel")).when(F.col("k") % 4 == 1, F.col("bare")).when(F.col("k") % 4 == 2, F.col("stem")).otherwise(F.concat("bare", F.lit(".gone")))
    return listing.select("k", key.alias("key"))


@query("resolve_files", f"WITH {_LISTING} SELECT k, CASE k % 4 WHEN 0 THEN rel WHEN 1 THEN bare WHEN 2 THEN stem ELSE bare || '.gone' END AS key, CASE WHEN k % 4 < 3 THEN rel END AS rel FROM l")
def resolve_files(spark, sf):
    """Exact paths, paths without a suffix, bare stems, and keys whose own suffix isn't there."""
    listing = _listing(spark, sf)
    return readers.resolve_files(_keys(listing), listing.select("rel")).select("k", "key", "rel")


@query("import_rows", f"WITH {_LISTING} SELECT 'L' || k % 2 || '/' || stem || ['.wav', '.ogg', '.flac', '.mp3'][1 + k % 4] AS target, min(k) AS k, rel FROM l WHERE k % 4 < 3 GROUP BY ALL")
def import_rows(spark, sf):
    listing = _listing(spark, sf)
    rows = _keys(listing)
    rows = rows.unionByName(rows)  # every row twice: the first of a target holds
    manifest = rows.select("k", F.col("key").alias("audio"), F.when(F.col("k") % 2 == 1, "L1").otherwise("").alias("label"), F.col("k").alias("_ord"))
    imported, _ = readers.import_rows(manifest, listing.select("rel"), label="L0")
    return imported.select("target", "k", "rel")


@query("import_missing", f"WITH {_LISTING} SELECT bare || '.gone' AS key FROM l WHERE k % 4 = 3")
def import_missing(spark, sf):
    listing = _listing(spark, sf)
    manifest = _keys(listing).select(F.col("key").alias("audio"), F.lit("x").alias("label"), F.col("k").alias("_ord"))
    return readers.import_rows(manifest, listing.select("rel"))[1]


@query("first_root", f"WITH {_LISTING} SELECT k, CASE WHEN k % 3 = 0 THEN 'set/' || rel WHEN k % 3 = 1 THEN rel END AS file FROM l")
def first_root(spark, sf):
    """Files of a data set lie below its own folder first, else below the root; some are nowhere."""
    listing = _listing(spark, sf)
    there = listing.where("k % 3 = 0").select(F.concat(F.lit("set/"), "rel").alias("rel")).unionByName(listing.where("k % 3 < 2").select("rel"))
    return readers.first_root(listing.select("k", "rel").withColumnRenamed("rel", "audio"), there, "audio", ["set/", ""]).select("k", "file")


def _document(spark, rows: DataFrame, name: str) -> str:
    """A small table as one JSON document."""
    path = scratch_path(spark, name)
    rows.coalesce(1).write.json(path)
    return path


@query("report_last_wins", "SELECT 's/' || (item_id % 20) AS key, max(item_id) AS edit_distance, arg_max(text, item_id) AS hypothesis FROM benchmark GROUP BY item_id % 20")
def report_last_wins(spark, sf):
    b = table(spark, sf, "benchmark")
    key = F.concat(F.lit("s\\"), (F.col("item_id") % 20).cast("string"))
    even = F.col("item_id") % 20 % 2 == 0  # a key is a source in some rows and a case in others
    r = b.select("item_id", F.when(even, key).alias("source"), F.when(~even, key).alias("case_id"), F.col("item_id").alias("edit_distance"), F.col("text").alias("hypothesis"))
    doc = r.agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "source", "case_id", "edit_distance", "hypothesis"))), lambda x: x.dropFields("item_id")).alias("results"))
    return readers.report(spark, _document(spark, doc, "report")).select("key", "edit_distance", "hypothesis")


@query("prior_cases", "SELECT 'c' || n_nationkey AS case_id, CASE WHEN n_regionkey = 0 THEN 'error' ELSE 'ok' END AS status, n_nationkey::BIGINT AS seed, 'r1' AS model_revision FROM nation")
def prior_cases(spark, sf):
    """The cases of an earlier manifest, and of one that isn't there."""
    n = table(spark, sf, "nation")
    case = F.struct(F.concat(F.lit("c"), "n_nationkey").alias("case_id"), F.when(F.col("n_regionkey") == 0, "error").otherwise("ok").alias("status"), F.col("n_nationkey").alias("seed"))
    doc = n.agg(F.collect_list(case).alias("cases"), F.create_map(F.lit("revision"), F.lit("r1")).alias("model"))
    there = readers.prior_cases(spark, _document(spark, doc, "cases"))
    return there.unionByName(readers.prior_cases(spark, scratch_path(spark, "absent"))).select("case_id", "status", "seed", "model_revision")


@query("ratings_lookup", "SELECT r_name AS sample, (1 + r_regionkey)::VARCHAR AS clarity FROM region")
def ratings_lookup(spark, sf):
    """Of two candidate files the first is broken, so the second holds."""
    broken, good = scratch_path(spark, "ratings"), scratch_path(spark, "ratings")
    spark.createDataFrame([('{"ratings": {"x": ',)], "value string").coalesce(1).write.text(broken)
    r = table(spark, sf, "region").agg(F.map_from_entries(F.collect_list(F.struct("r_name", F.struct((F.col("r_regionkey") + 1).cast("string").alias("clarity"))))).alias("ratings"))
    r.coalesce(1).write.json(good)
    doc = readers.first_valid(spark, [scratch_path(spark, "absent"), broken, good], "ratings map<string,struct<clarity:string>>")
    return doc.select(F.explode("ratings").alias("sample", "r")).select("sample", "r.clarity")


_DECISIONS = "g AS (SELECT s_nationkey, list(s_name) AS names FROM supplier GROUP BY s_nationkey)"


def _decisions(spark, sf) -> DataFrame:
    """A decisions document for each nation; the even ones use the older list."""
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.collect_list("s_name").alias("names"))
    even = F.col("s_nationkey") % 2 == 0
    rows = s.select(F.when(even, F.array().cast("array<string>")).otherwise(F.col("names")).alias("drop"), F.when(even, F.col("names")).alias("exclude"), F.map_from_arrays("names", F.transform("names", lambda x: F.array(F.lit("noise"), F.right(x, F.lit(1))))).alias("tags"))
    path = scratch_path(spark, "decisions")
    rows.write.json(path)
    return spark.read.schema(readers.DECISIONS).json(path)


@query("decisions_drop", "SELECT DISTINCT s_name AS key FROM supplier")
def decisions_drop(spark, sf):
    return enrich.decisions(_decisions(spark, sf))


@query("decision_tags", "SELECT s_name AS key, unnest(['noise', right(s_name, 1)]) AS tag FROM supplier")
def decision_tags(spark, sf):
    return enrich.decision_tags(_decisions(spark, sf))


# ---------------------------------------------------------------- sound from bytes

_PCM = "pcm AS (SELECT vec_id, list_transform(embedding, lambda v: trunc(greatest(least(v::DOUBLE * 4, 1), -1) * 32767) / 32768) AS x FROM embeddings)"


def _sounds(spark, sf) -> DataFrame:
    """embeddings, four times as loud, as WAV bytes; every tenth file is broken."""
    e = table(spark, sf, "embeddings")
    content = audio.pcm16(F.transform("embedding", lambda v: v.cast("double") * 4), F.lit(8000))
    return e.select("vec_id", F.when(F.col("vec_id") % 10 == 9, F.lit("no sound").cast("binary")).otherwise(content).alias("content"))


@query("wav_info", "SELECT vec_id, CASE WHEN vec_id % 10 <> 9 THEN 8000 END::INTEGER AS sample_rate, CASE WHEN vec_id % 10 <> 9 THEN len(embedding) END::BIGINT AS frames, CASE WHEN vec_id % 10 <> 9 THEN len(embedding) / 8000.0 END AS duration_s, CASE WHEN vec_id % 10 <> 9 THEN 'PCM_16' END AS subtype, vec_id % 10 = 9 AS failed FROM embeddings")
def wav_info(spark, sf):
    i = _sounds(spark, sf).select("vec_id", audio.wav_info("content").alias("i"))
    return i.select("vec_id", "i.sample_rate", "i.frames", "i.duration_s", "i.subtype", F.col("i.error").isNotNull().alias("failed"))


@query("wav_decode", f"WITH {_PCM} SELECT vec_id, round(list_max(list_transform(x, lambda v: abs(v))), 9) AS peak, round(list_sum(x), 6) AS total FROM pcm WHERE vec_id % 10 <> 9")
def wav_decode(spark, sf):
    d = audio.decoded(spark, _sounds(spark, sf)).where("error is null")
    return d.select("vec_id", F.round(sg.peak(F.col("x")), 9).alias("peak"), F.round(sg.total(F.col("x")), 6).alias("total"))


@query("wav_resampled", "SELECT vec_id, 16000 AS sample_rate, (2 * len(embedding))::INTEGER AS n FROM embeddings WHERE vec_id % 10 <> 9")
def wav_resampled(spark, sf):
    d = audio.decoded(spark, _sounds(spark, sf), target=16000).where("error is null")
    return d.select("vec_id", "sample_rate", F.size("x").alias("n"))


@query("resample_tone", "SELECT s_suppkey, (1 + s_nationkey % 5) / 10.0 AS level, 480 AS n FROM supplier")
def resample_tone(spark, sf):
    """Steady tones keep their level, whatever the ratio of rates."""
    from tessella.functions import dsp

    level, hertz = (F.col("s_nationkey") % 5 + 1) / 10, (F.col("s_suppkey") % 8 + 1) * 100
    k = table(spark, sf, "supplier").select("s_suppkey", F.transform(F.sequence(F.lit(0), F.lit(239)), lambda i: level * F.cos(i * 2 * 3.141592653589793 * hertz / 8000)).alias("x"))
    y = dsp.resample_signal("x", F.lit(8000), F.lit(16000))
    # the middle, away from the ends
    return k.withColumn("y", y).select("s_suppkey", F.round(sg.peak(F.slice("y", 161, 160)), 2).alias("level"), F.size("y").alias("n"))


@query("metric_scan", f"WITH {_PCM} SELECT vec_id, CASE WHEN vec_id % 10 <> 9 THEN round(20 * log10(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x))), 6) END AS rms_dbfs, CASE WHEN vec_id % 10 = 9 THEN 'ValueError: not a WAV file' END AS error FROM pcm")
def metric_scan(spark, sf):
    """Measures of every file; what can't be read is a row with its error."""
    d = audio.decoded(spark, _sounds(spark, sf))
    return d.select("vec_id", F.when(F.col("error").isNull(), F.round(sg.db(sg.rms(F.col("x"))), 6)).alias("rms_dbfs"), "error")


def _tensor_files(spark, sf) -> DataFrame:
    """(name, content) of a tensor file for each part: its header, then what stands for tensor data. Every
    seventh is cut off within its header."""
    p = table(spark, sf, "part")
    meta = F.struct(F.lit("F32").alias("dtype"), F.array(F.col("p_size").cast("long"), F.lit(16).cast("long")).alias("shape"))
    head = F.to_json(F.map_from_entries(F.array(*(F.struct(F.concat(F.lit(f"t{k}."), "p_partkey", F.lit(end)), meta) for k, end in ((0, ".lora_A"), (1, ".lora_B"))))))
    size = F.lpad(F.hex(F.octet_length(head).cast("long")), 16, "0")
    little = F.concat(*(F.substring(size, 15 - 2 * i, 2) for i in range(8)))
    body = F.when(F.col("p_partkey") % 7 == 3, F.substring(head, 1, 20)).otherwise(F.concat(head, F.repeat(F.lit("tensor data"), 50)))
    name = F.concat(F.lit("m"), F.col("p_partkey") % 10, F.lit("/p"), "p_partkey", F.lit(".safetensors"))
    return p.select("p_partkey", name.alias("name"), F.concat(F.unhex(little), body.cast("binary")).alias("content"))


def _headers(spark, sf) -> DataFrame:
    root = scratch_path(spark, "tensors")
    sinks.write_files(spark, _tensor_files(spark, sf), root)
    return spark.read.format("tensor_header").load(root)


@query(
    "tensor_headers",
    """SELECT 'p' || p_partkey || '.safetensors' AS file, 't' || k || '.' || p_partkey || CASE k WHEN 0 THEN '.lora_A' ELSE '.lora_B' END AS key, 'F32' AS dtype, (p_size * 16)::BIGINT AS numel, p_size || ',16' AS shape, NULL AS error
FROM part, (SELECT unnest([0, 1]) AS k) WHERE p_partkey % 7 <> 3 UNION ALL SELECT 'p' || p_partkey || '.safetensors', NULL, NULL, NULL, NULL, 'ValueError' FROM part WHERE p_partkey % 7 = 3""",
)
def tensor_headers(spark, sf):
    """Tensor files in folders: only their headers are read; one that is cut off is a row with its error."""
    shape = F.array_join(F.transform("shape", lambda x: x.cast("string")), ",")
    return _headers(spark, sf).select(F.substring_index("path", "/", -1).alias("file"), "key", "dtype", "numel", F.when(F.col("key").isNotNull(), shape).alias("shape"), F.substring_index("error", ":", 1).alias("error"))


@query(
    "tensor_header_filters",
    "SELECT 't1.' || p_partkey || '.lora_B' AS key, (p_size * 16)::BIGINT AS numel FROM part WHERE p_partkey % 7 <> 3 AND (p_partkey % 10)::VARCHAR = right(p_partkey::VARCHAR, 1) AND right(p_partkey::VARCHAR, 1) = '4'",
)
def tensor_header_filters(spark, sf):
    """Filters on path and key reach the source: other files aren't opened, other keys make no rows."""
    rows = _headers(spark, sf)
    return rows.where(F.col("path").endswith("4.safetensors") & F.col("key").endswith(".lora_B")).select("key", "numel")


@query("metric_files", f"WITH {_PCM} SELECT vec_id, CASE WHEN vec_id % 10 <> 9 THEN round(20 * log10(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x))), 6) END AS rms_dbfs, CASE WHEN vec_id % 10 = 9 THEN 'ValueError: not a WAV file' END AS error FROM pcm")
def metric_files(spark, sf):
    """Measures of every sound file below a folder; what can't be read is a row with its error."""
    root = scratch_path(spark, "sounds")
    sinks.write_files(spark, _sounds(spark, sf).select(F.concat(F.lit("s"), F.col("vec_id") % 7, F.lit("/"), "vec_id", F.lit(".wav")).alias("name"), "content"), root)
    found = readers.files(spark, root, suffixes=(".wav",), content=True).select("rel", "content")
    d = audio.decoded(spark, found)
    return d.select(F.regexp_extract("rel", "/([0-9]+)", 1).cast("long").alias("vec_id"), F.when(F.col("error").isNull(), F.round(sg.db(sg.rms(F.col("x"))), 6)).alias("rms_dbfs"), "error")


@query("text_scripts", "SELECT lower(r_name) || '.txt' AS name, r_name || ' speaks' || chr(10) AS text FROM region")
def text_scripts(spark, sf):
    """Scripts by name; the read-me file is none."""
    root = scratch_path(spark, "inputs")
    name = F.lower("r_name")
    rows = table(spark, sf, "region").select(F.explode(F.array(
        F.struct(F.concat(name, F.lit(".txt")).alias("name"), F.concat("r_name", F.lit(" speaks\n")).alias("content")),
        F.struct(F.lit("README.txt").alias("name"), F.lit("about").alias("content")),
        F.struct(F.concat(name, F.lit(".md")).alias("name"), F.lit("no script").alias("content")),
    )).alias("f")).select("f.*")
    sinks.write_files(spark, rows, root)
    return readers.text_scripts(spark, root)


@query(
    "asr_targets",
    """SELECT 'index' AS kind, 'd' || doc_id AS key, 'd' || doc_id AS audio FROM documents UNION ALL SELECT 'case', 'o' || o_orderkey, 'out/' || o_orderkey FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'pair', url, url FROM pages""",
)
def asr_targets(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("source"), F.concat(F.lit("d"), "doc_id").alias("audio"), "text")
    o = table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("error").alias("status"), F.concat(F.lit("out/"), "o_orderkey").alias("output"), F.lit("t").alias("text"))
    p = table(spark, sf, "pages").select(F.col("url").alias("audio"), F.lit("t").alias("text"))
    return readers.asr_targets(d, o, p).select("kind", "key", "audio")


@query("config_expand", "SELECT r_regionkey, '/data/' || r_name || '/m-' || (CASE WHEN r_regionkey % 2 = 0 THEN 'x' ELSE 'fallback' END) AS path FROM region")
def config_expand(spark, sf):
    """Configuration files, one for each region, read with their references expanded."""
    env, root = config.read_env("# places\nROOT=/data\nMODEL='x'\n\n"), scratch_path(spark, "configs")
    r = table(spark, sf, "region")
    place = F.concat(F.lit("${ROOT}/"), "r_name", F.lit("/m-${"), F.when(F.col("r_regionkey") % 2 == 0, "MODEL").otherwise("OTHER"), F.lit(":fallback}"))
    raw = F.to_json(F.struct(F.col("r_regionkey").alias("region"), F.struct(place.alias("path_or_id")).alias("model"), F.lit("python3").alias("python"), F.lit("w.py").alias("script")))
    sinks.write_files(spark, r.select(F.concat("r_name", F.lit(".json")).alias("name"), raw.alias("content")), root)
    read = readers.document(spark, root, "region int, model struct<path_or_id:string>, python string, script string")
    return read.select(F.col("region").alias("r_regionkey"), tx.expand_env(F.col("model.path_or_id"), env).alias("path"))


@query("expand_columns", "SELECT p_partkey, p_name || '/A1/' || CASE WHEN p_partkey % 2 = 0 THEN 'A1' ELSE 'dflt' END AS path FROM part")
def expand_columns(spark, sf):
    p = table(spark, sf, "part")
    raw = F.concat("p_name", F.lit("/${A}/"), F.when(F.col("p_partkey") % 2 == 0, "${A}").otherwise("${B:dflt}"))
    return p.select("p_partkey", tx.expand_env(raw, {"A": "A1"}).alias("path"))


@query("nested_config", "SELECT p_partkey, p_size::VARCHAR AS rank FROM part")
def nested_config(spark, sf):
    p = table(spark, sf, "part")
    inner = F.concat(F.lit('{"r": '), F.col("p_size"), F.lit("}"))
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"lora_config": '), inner, F.lit("}"))).otherwise(inner)
    return p.select("p_partkey", F.get_json_object(readers.nested_config(raw, "lora_config"), "$.r").alias("rank"))


# ---------------------------------------------------------------- sinks


@query("split_fanout", _FREEZE + f"SELECT split, (SELECT count(*) FROM (SELECT {split_sql('fid')} AS s FROM done WHERE why IS NULL) WHERE s = split) AS n FROM (SELECT unnest(['train', 'validation', 'test']) AS split)")
def split_fanout(spark, sf):
    """Every split is a folder of its own, an empty one too."""
    path = scratch_path(spark, "splits")
    sinks.write_splits(_frozen(spark, sf), path)
    one = lambda s: spark.read.schema("fid string").json(f"{path}/{s}").agg(F.count("fid").alias("n")).select(F.lit(s).alias("split"), "n")
    return one("train").unionByName(one("validation")).unionByName(one("test"))


@query(
    "split_order",
    _FREEZE + f"SELECT split, fid, row_number() OVER (PARTITION BY split ORDER BY fid) - 1 AS place FROM (SELECT fid, {split_sql('fid')} AS split FROM done WHERE why IS NULL)",
)
def split_order(spark, sf):
    """The whole sequence of every split, as its files give it when they are read by name."""
    path = scratch_path(spark, "splits")
    sinks.write_splits(_frozen(spark, sf), path)
    one = lambda s: ordering.numbered(spark, readers.jsonl(spark, f"{path}/{s}", "fid string")).select(F.lit(s).alias("split"), "fid", F.col("_ord").alias("place"))
    return one("test").unionByName(one("train")).unionByName(one("validation"))


def _uneven(spark, sf: str, rows: DataFrame, key: str, order: str) -> str:
    """``rows`` as JSON lines in files of very different sizes, whose names follow ``order`` in ``key``: the
    first file holds a few rows, the second most, the rest a few each."""
    path, group = scratch_path(spark, "uneven"), F.when(F.col(key) < 3, 0).when(F.col(key) % 11 != 0, 1).otherwise(F.col(key) % 5 + 2)
    rows.withColumn("g", group).repartition("g").sortWithinPartitions("g", order).write.partitionBy("g").json(path)
    return path


@query(
    "file_order",
    """WITH r AS (SELECT event_id, CASE WHEN event_id < 3 THEN 0 WHEN event_id % 11 <> 0 THEN 1 ELSE event_id % 5 + 2 END AS g FROM events)
SELECT event_id, row_number() OVER (ORDER BY g, event_id) - 1 AS place, row_number() OVER (PARTITION BY g ORDER BY event_id) AS line FROM r""",
)
def file_order(spark, sf):
    """Rows of files of unequal sizes, numbered in file and line order."""
    path = _uneven(spark, sf, table(spark, sf, "events").select("event_id", "event_type"), "event_id", "event_id")
    rows = readers.jsonl(spark, path, "event_id bigint, event_type string")
    return ordering.numbered(spark, rows).select("event_id", F.col("_ord").alias("place"), F.col("_line").alias("line"))


@query(
    "file_order_first",
    """WITH r AS (SELECT *, CASE WHEN event_id < 3 THEN 0 WHEN event_id % 11 <> 0 THEN 1 ELSE event_id % 5 + 2 END AS g FROM events)
SELECT user_id, arg_min(event_id, g * 100000000 + event_id) AS first_event, arg_max(event_id, g * 100000000 + event_id) AS last_event FROM r GROUP BY user_id""",
)
def file_order_first(spark, sf):
    """First and last row of every key over files of unequal sizes."""
    from tessella.operators import curate

    path = _uneven(spark, sf, table(spark, sf, "events").select("event_id", "user_id"), "event_id", "event_id")
    rows = readers.jsonl(spark, path, "event_id bigint, user_id bigint")
    first = curate.first_wins(rows, "user_id", "_ord").select("user_id", F.col("event_id").alias("first_event"))
    return first.join(enrich.latest(rows, "user_id", "_ord").select("user_id", F.col("event_id").alias("last_event")), "user_id")


@query("manifest_lines", "SELECT 'c' || conv_id || '/' || turn AS audio, text, 2 * row_number() OVER (PARTITION BY turn % 3 ORDER BY conv_id, turn) - 1 AS line FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL")
def manifest_lines(spark, sf):
    """A manifest of three files with a blank line after every row: lines are counted in their own file."""
    path = scratch_path(spark, "manifest")
    c = table(spark, sf, "conversations").where("conv_id is not null and turn is not null")
    line = F.concat(F.to_json(F.struct(F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn").alias("audio"), "text")), F.lit("\n"))
    c.select("conv_id", "turn", (F.col("turn") % 3).alias("g"), line.alias("value")).repartition("g").sortWithinPartitions("g", "conv_id", "turn").select("g", "value").write.partitionBy("g").text(path)
    return readers.manifest(spark, path).select("audio", "text", F.col("_line").alias("line"))


@query("training_export", "SELECT 'a/' || doc_id AS audio, sha256(text) AS text_sha, 'audio,text' AS columns FROM documents WHERE doc_id % 4 <> 0 AND text IS NOT NULL")
def training_export(spark, sf):
    """Exactly two columns are written, of accepted rows only."""
    path = scratch_path(spark, "training")
    d = table(spark, sf, "documents").where("text is not null")
    sinks.write_training(d.select(F.concat(F.lit("a/"), "doc_id").alias("audio"), "text", "lang", F.when(F.col("doc_id") % 4 == 0, "bad_text").alias("reason")), path)
    back = spark.read.json(path)
    return back.select("audio", F.sha2("text", 256).alias("text_sha"), F.lit(",".join(sorted(back.columns))).alias("columns"))


@query("content_pool", "SELECT DISTINCT sha256(text) AS sha256, sha256(text) || '.wav' AS name, strlen(text)::BIGINT AS length FROM conversations WHERE text IS NOT NULL")
def content_pool(spark, sf):
    """Two batches of contents, the second holding the first again: each content is one file, named by its hash."""
    path = scratch_path(spark, "pool")
    c = table(spark, sf, "conversations").where("text is not null").select("turn", F.col("text").cast("binary").alias("content"))
    sinks.add_to_pool(spark, c.where("turn % 2 = 0"), path)
    sinks.add_to_pool(spark, c, path)
    return readers.files(spark, path, content=True).select("sha256", F.col("rel").alias("name"), "length")


@query("sidecars", "SELECT 'out/' || o_orderkey || '.json' AS path, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0")
def sidecars(spark, sf):
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("out/"), "o_orderkey", F.lit(".wav"))).alias("output"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    j = F.from_json("json", "status string, price double")
    return sinks.sidecars(o).select("path", j["status"].alias("status"), j["price"].alias("price"))


def _by_status(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(F.count("*").alias("n"))


def _versions(spark, sf) -> str:
    """Three versions of a snapshot: all orders by status, then two changed ones."""
    path = scratch_path(spark, "snapshot")
    o = _by_status(spark, sf)
    for add in (0, 100, 7):
        versions.commit(spark, o.withColumn("n", F.col("n") + add), path)
    return path


@query("snapshot_current", "SELECT o_orderstatus AS name, count(*) + 7 AS n FROM orders GROUP BY 1")
def snapshot_current(spark, sf):
    return versions.read(spark, _versions(spark, sf)).select("name", "n")


@query("snapshot_history", "SELECT v AS version, o_orderstatus AS name, count(*) + CASE v WHEN 1 THEN 0 WHEN 2 THEN 100 ELSE 7 END AS n FROM orders, (SELECT unnest([1, 2, 3])::BIGINT AS v) GROUP BY v, o_orderstatus")
def snapshot_history(spark, sf):
    """Earlier versions stay, under their numbers."""
    return versions.version_rows(spark, _versions(spark, sf)).select(F.col("_number").alias("version"), "name", "n")


@query("snapshot_conflict", "SELECT o_orderstatus AS name, count(*) + 100 AS n, 2::BIGINT AS version, 'second' AS refused FROM orders GROUP BY 1")
def snapshot_conflict(spark, sf):
    """Two writers start from one version: the first is saved, the second is refused and leaves nothing."""
    path, o, refused = scratch_path(spark, "snapshot"), _by_status(spark, sf), []
    base = versions.commit(spark, o, path, expected=None)
    for writer, add in (("first", 100), ("second", 7)):
        try:
            versions.commit(spark, o.withColumn("n", F.col("n") + add), path, expected=base.revision)
        except versions.VersionConflict:
            refused.append(writer)
    now = versions.current(spark, path)
    return versions.read(spark, path).select("name", "n", F.lit(now.number).cast("long").alias("version"), F.lit(",".join(refused)).alias("refused"))


@query("snapshot_legacy", "SELECT 'saved' AS origin, o_orderstatus AS name, count(*) + 7 AS n FROM orders GROUP BY 2 UNION ALL SELECT 'legacy', r_name, r_regionkey FROM region")
def snapshot_legacy(spark, sf):
    """A snapshot that was saved, and one that only its legacy file holds."""
    legacy = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("n"))
    saved = sinks.read_snapshot(spark, _versions(spark, sf), legacy).select(F.lit("saved").alias("origin"), "name", "n")
    return saved.unionByName(sinks.read_snapshot(spark, scratch_path(spark, "absent"), legacy).select(F.lit("legacy").alias("origin"), "name", "n"))


@query("spectrogram_png", "SELECT vec_id, 1 AS width, 33 AS height, true AS png FROM embeddings")
def spectrogram_png(spark, sf):
    """Signature and size of every picture: one frame of 64 samples, 33 frequencies."""
    from tessella.operators import reports

    e = table(spark, sf, "embeddings").select("vec_id", reports.spectrogram(vx.doubles(F.col("embedding")), F.lit(8000)).alias("p"))
    number = lambda at: F.conv(F.hex(F.substring("p", at, 4)), 16, 10).cast("int")
    return e.select("vec_id", number(17).alias("width"), number(21).alias("height"), (F.hex(F.substring("p", 1, 8)) == "89504E470D0A1A0A").alias("png"))
