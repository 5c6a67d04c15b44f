"""Every registered query of the reference's own operators with its DuckDB oracle.

The given tables stand in for the engine's own: documents are index rows (doc_id is the order, lang the
label), benchmark texts are evaluation assets, labels are review decisions, embeddings are both speaker
vectors and short signals, conversations are recognition results and rated cells, events are messages
and rating writes, orders are reports. All queries run over whole tables.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import signals as sg
from tessella.functions import text as tx
from tessella.functions import vectors as vx
from tessella.operators import curate, enrich, experiments, ratings, reports, verdicts
from tessella.session import materialize, ship_package, table
from tessella.streaming import events as stream

QUERIES: dict = {}
ORACLES: dict = {}

# DuckDB's \s is ASCII only; the classes below add what Unicode whitespace has beyond it.
_DUCK_SPACE = r"\s\p{Z}\x1c-\x1f\x{85}"
_DUCK_NORM = f"[{_DUCK_SPACE}{tx.PUNCTUATION}]".replace("'", "''")
_DUCK_ASR = f"[{_DUCK_SPACE}{tx.ASR_PUNCTUATION}]".replace("'", "''")


def norm_sql(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '{_DUCK_NORM}', '', 'g')"


def asr_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '<\\|[^|]+\\|>', '', 'g'), '\\p{{So}}', '', 'g'), '{_DUCK_ASR}', '', 'g')"


def fraction_sql(fid: str) -> str:
    return f"(('0x' || substr(sha256('split|' || {fid}), 1, 8))::BIGINT / 4294967295.0)"


def split_sql(fid: str) -> str:
    h = fraction_sql(fid)
    return f"CASE WHEN {h} < 0.1 THEN 'test' WHEN {h} < 0.2 THEN 'validation' ELSE 'train' END"


def query(name: str, sql: str | None = None):
    """Register a query; workers get the package before it runs, as they may not have it on their path."""

    def register(f):
        @wraps(f)
        def run(spark, sf):
            ship_package(spark)
            return f(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def _index(spark: SparkSession, sf: str) -> DataFrame:
    """documents as index rows."""
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("_ord"), "text", F.lit(None).cast("string").alias("text_asr"), F.lit(None).cast("string").alias("provenance_text"),
        tx.content_sha(tx.blank(F.col("text"))).alias("audio_sha256"), F.lit(True).alias("file_exists"), F.col("lang").alias("label"),
    )


_BASE = f"""
base AS (SELECT doc_id, lang, text, sha256(coalesce(text, '')) AS sha, {norm_sql('text')} AS nt FROM documents),
ided AS (SELECT *, sha256(nt || '|' || sha) AS fid FROM base)"""


# ---------------------------------------------------------------- text and hashing


@query("norm_text", f"SELECT doc_id, length({norm_sql('text')})::INTEGER AS n, sha256({norm_sql('text')}) AS h, sha256({asr_sql('text')}) AS asr_h FROM documents")
def norm_text(spark, sf):
    n, a = tx.norm_text(F.col("text")), tx.asr_norm(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(n).alias("n"), F.sha2(n, 256).alias("h"), F.sha2(a, 256).alias("asr_h"))


@query("fid", f"WITH {_BASE} SELECT doc_id, fid, {fraction_sql('fid')} AS fraction FROM ided")
def fid(spark, sf):
    d = table(spark, sf, "documents").withColumn("fid", tx.text_fid(F.col("text"), tx.content_sha(tx.blank(F.col("text")))))
    return d.select("doc_id", "fid", tx.split_fraction(F.col("fid")).alias("fraction"))


@query("hash_split_counts", f"WITH {_BASE} SELECT {split_sql('fid')} AS split, lang, count(*) AS n FROM ided GROUP BY ALL")
def hash_split_counts(spark, sf):
    d = table(spark, sf, "documents").withColumn("fid", tx.text_fid(F.col("text"), tx.content_sha(tx.blank(F.col("text")))))
    return d.groupBy(tx.split_bucket(F.col("fid")).alias("split"), "lang").agg(F.count("*").alias("n"))


@query(
    "parse_names",
    """SELECT page_id, name,
  CASE WHEN regexp_full_match(parent, 'inbox') THEN NULL ELSE parent END AS label,
  CASE WHEN regexp_full_match(stem, '[_\\-\\d]+') THEN '' ELSE stem END AS body
FROM (SELECT page_id, name, parent, regexp_replace(name, '(.)\\.[^.]*$', '\\1') AS stem
  FROM (SELECT page_id, list_extract(string_split(url, '/'), -1) AS name, list_extract(string_split(url, '/'), -2) AS parent FROM pages))""",
)
def parse_names(spark, sf):
    p = table(spark, sf, "pages")
    parsed = tx.parse_inbox_name(F.col("url"))
    return p.select("page_id", tx.path_parts(F.col("url"))["name"].alias("name"), parsed["label"].alias("label"), parsed["text"].alias("body"))


# ---------------------------------------------------------------- curation

_FREEZE = f"""WITH {_BASE},
marked AS (SELECT i.*, CASE WHEN l.doc_id IS NOT NULL THEN 'reviewed_out' WHEN nt = '' THEN 'no_text' END AS early
  FROM ided i LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0 OR toxic = 1) l ON i.doc_id = l.doc_id),
firsts AS (SELECT nt, arg_min(sha, doc_id) AS sha, min(doc_id) AS first_id FROM marked WHERE early IS NULL GROUP BY nt),
done AS (SELECT m.*, CASE WHEN early IS NOT NULL THEN early WHEN m.doc_id = f.first_id THEN NULL WHEN m.sha = f.sha THEN 'dup_audio' ELSE 'dup_text' END AS why
  FROM marked m LEFT JOIN firsts f ON m.early IS NULL AND m.nt = f.nt)
"""


def _frozen(spark, sf) -> DataFrame:
    """Which documents survive. The content hash decides the normal form, so one key's first row stands
    for both and no fixpoint is needed."""
    out = table(spark, sf, "labels").where("quality = 0 or toxic = 1").select("doc_id").distinct().withColumn("_out", F.lit(True))
    rows = _index(spark, sf).withColumn("fid", tx.text_fid(F.col("text"), F.col("audio_sha256"))).withColumn("norm", F.sha2(tx.norm_text(F.col("text")), 256))
    rows = rows.withColumn("blank", tx.norm_text(F.col("text")) == "").select("_ord", "fid", "norm", "blank", "audio_sha256", "label")
    rows = rows.join(out, F.col("_ord") == F.col("doc_id"), "left")
    rows = rows.withColumn("early", F.when(F.col("_out"), "reviewed_out").when(F.col("blank"), "no_text"))
    # ids and hashes only: the texts are read and normalised once, not once for each side of the join
    rows = materialize(spark, rows.drop("doc_id", "_out", "blank"), "frozen")
    first = rows.where("early is null").groupBy("norm").agg(F.min("_ord").alias("_first"), F.min_by("audio_sha256", "_ord").alias("_sha"))
    rows = rows.join(first, "norm", "left")
    why = F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("_ord") == F.col("_first"), None).when(F.col("audio_sha256") == F.col("_sha"), "dup_audio").otherwise("dup_text")
    return rows.select("_ord", "fid", "label", why.alias("why")).withColumn("split", F.when(F.col("why").isNull(), tx.split_bucket(F.col("fid"))))


@query("flagship_freeze", _FREEZE + f"SELECT coalesce(why, {split_sql('fid')}) AS outcome, lang, count(*) AS n FROM done GROUP BY ALL")
def flagship_freeze(spark, sf):
    return _frozen(spark, sf).groupBy(F.coalesce("why", "split").alias("outcome"), F.col("label").alias("lang")).agg(F.count("*").alias("n"))


@query("freeze_rows", _FREEZE + f"SELECT doc_id, fid, why, CASE WHEN why IS NULL THEN {split_sql('fid')} END AS split FROM done")
def freeze_rows(spark, sf):
    """The general operator with its fixpoint."""
    drops = table(spark, sf, "labels").where("quality = 0 or toxic = 1")
    keys = drops.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id").distinct()
    # reviewed ids name documents here, not content: excluded rows leave first
    index = _index(spark, sf).join(keys.select(F.col("doc_id").alias("_ord"), F.lit(True).alias("_drop")), "_ord", "left")
    kept = curate.freeze(spark, index.where("_drop is null").drop("_drop"))
    gone = index.where("_drop").withColumn("fid", tx.text_fid(F.col("text"), F.col("audio_sha256"))).select("_ord", "fid", F.lit("reviewed_out").alias("why"), F.lit(None).cast("string").alias("split"))
    return kept.select("_ord", "fid", "why", "split").unionByName(gone).withColumnRenamed("_ord", "doc_id")


@query("drop_reasons", _FREEZE + "SELECT why AS reason, count(*) AS n FROM done WHERE why IS NOT NULL GROUP BY why")
def drop_reasons(spark, sf):
    return _frozen(spark, sf).where("why is not null").groupBy(F.col("why").alias("reason")).agg(F.count("*").alias("n"))


@query(
    "leak_exact_anti",
    f"SELECT doc_id FROM (SELECT doc_id, {norm_sql('text')} AS nt FROM documents) WHERE nt <> '' AND nt NOT IN (SELECT {norm_sql('text')} FROM benchmark)",
)
def leak_exact_anti(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", tx.norm_text(F.col("text")).alias("norm")).where("norm <> ''")
    b = table(spark, sf, "benchmark").select(tx.norm_text(F.col("text")).alias("key"))
    return curate.exclude(d, b, ["norm"]).select("doc_id")


@query(
    "dedup_first_wins",
    f"WITH {_BASE} SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, sha256(nt) AS norm FROM ided WHERE nt <> '' GROUP BY nt",
)
def dedup_first_wins(spark, sf):
    d = table(spark, sf, "documents").withColumn("nt", tx.norm_text(F.col("text"))).where("nt <> ''").select("doc_id", "lang", F.sha2("nt", 256).alias("norm"))
    return curate.first_wins(d, "norm", "doc_id")


@query(
    "audit_cross_split",
    f"""WITH {_BASE}, a AS (SELECT nt, sha256(coalesce(lang, '') || (doc_id % 40)) AS sha FROM ided),
s AS (SELECT fid, sha, nt, {split_sql('fid')} AS split FROM (SELECT *, sha256(nt || '|' || sha) AS fid FROM a)),
k AS (SELECT fid, split, list_position(['train', 'validation', 'test'], split) AS rk, unnest([{{'kind': 'audio_leak', 'key': sha}}, {{'kind': 'text_leak', 'key': nt}}]) AS x FROM s),
o AS (SELECT x.kind AS kind, x.key AS key, min(rk) AS own FROM k WHERE x.key <> '' GROUP BY ALL)
SELECT k.x.kind AS kind, list_extract(['train', 'validation', 'test'], own) AS owner, split, count(*) AS n FROM k JOIN o ON k.x.kind = o.kind AND k.x.key = o.key WHERE rk > own GROUP BY ALL""",
)
def audit_cross_split(spark, sf):
    """Recordings are shared by every fortieth document of a language, so they, and equal texts under other
    recordings, cross the splits."""
    shared = table(spark, sf, "documents").select(F.col("doc_id").alias("_ord"), F.sha2(F.concat(F.coalesce("lang", F.lit("")), F.col("doc_id") % 40), 256).alias("audio_sha256"))
    rows = _index(spark, sf).drop("audio_sha256").join(shared, "_ord").withColumn("fid", tx.text_fid(F.col("text"), F.col("audio_sha256"))).withColumn("split", tx.split_bucket(F.col("fid")))
    return curate.audit_leaks(rows).groupBy("kind", "owner", "split").agg(F.count("*").alias("n"))


@query(
    "val_first_k",
    f"""WITH {_BASE}, v AS (SELECT nt, min(doc_id) AS doc_id FROM ided WHERE {split_sql('fid')} = 'validation' AND nt NOT IN (SELECT {norm_sql('text')} FROM benchmark) GROUP BY nt)
SELECT doc_id FROM v ORDER BY doc_id LIMIT 8""",
)
def val_first_k(spark, sf):
    rows = _index(spark, sf).withColumn("fid", tx.text_fid(F.col("text"), F.col("audio_sha256"))).where(tx.split_bucket(F.col("fid")) == "validation")
    rows = rows.select("_ord", "fid", "text", F.col("audio_sha256").alias("file_sha256"))
    none = spark.createDataFrame([], "key string")
    blocked = table(spark, sf, "benchmark").select(tx.norm_text(F.col("text")).alias("key"))
    return curate.validation_rows(rows, none, none, blocked).select(F.col("_ord").alias("doc_id"))


# embeddings as one-second signals of 64 samples, scaled so that every flag occurs

_SIGNAL = """sig AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 5)) AS x FROM embeddings),
m AS (SELECT vec_id, label, len(x) / 64.0 AS duration_s, list_max(list_transform(x, lambda v: abs(v))) AS peak,
  20 * log10(greatest(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 1e-12)) AS rms_dbfs,
  len(list_filter(x, lambda v: abs(v) > 0.999)) AS clipped, len(list_filter(x, lambda v: abs(v) < 0.0031622776601683794)) / len(x) AS silence FROM sig),
f AS (SELECT *, list_filter([CASE WHEN duration_s < 0.4 THEN 'too_short' END, CASE WHEN duration_s > 120 THEN 'too_long' END, CASE WHEN clipped > 0 THEN 'clipped' END,
  CASE WHEN silence > 0.6 THEN 'mostly_silent' END, CASE WHEN rms_dbfs < -45 THEN 'too_quiet' END, CASE WHEN rms_dbfs > -6 THEN 'too_hot' END], lambda v: v IS NOT NULL) AS flags FROM m)"""


def _signals(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double") * (F.col("vec_id") % 5))
    return e.select("vec_id", "label", x.alias("x")).withColumn("m", sg.measure(F.col("x"), F.lit(64)))


@query("signal_measure", f"WITH {_SIGNAL} SELECT vec_id, round(duration_s, 6) AS duration_s, round(peak, 6) AS peak, round(rms_dbfs, 4) AS rms_dbfs, clipped::INTEGER AS clipped, round(silence, 6) AS silence FROM m")
def signal_measure(spark, sf):
    m = F.col("m")
    return _signals(spark, sf).select("vec_id", F.round(m["duration_s"], 6).alias("duration_s"), F.round(m["peak"], 6).alias("peak"), F.round(m["rms_dbfs"], 4).alias("rms_dbfs"), m["clipped_samples"].alias("clipped"), F.round(m["silence_ratio"], 6).alias("silence"))


@query("quality_flags", f"WITH {_SIGNAL} SELECT vec_id, array_to_string(flags, ';') AS flags FROM f")
def quality_flags(spark, sf):
    return _signals(spark, sf).select("vec_id", F.array_join(curate.kinds(curate.flag_issues(F.col("m"))), ";").alias("flags"))


@query("flag_histogram", f"WITH {_SIGNAL} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM f) GROUP BY flag")
def flag_histogram(spark, sf):
    return _signals(spark, sf).select(F.explode(curate.kinds(curate.flag_issues(F.col("m")))).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("hard_reject", f"WITH {_SIGNAL} SELECT label, count(*) AS n, sum(CASE WHEN list_contains(flags, 'too_short') THEN 1 ELSE 0 END)::BIGINT AS rejected FROM f GROUP BY label")
def hard_reject(spark, sf):
    why = curate.hard_reject(curate.flag_issues(F.col("m")))
    return _signals(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.count_if(why.isNotNull()).alias("rejected"))


@query(
    "enrich_left_joins",
    """SELECT d.doc_id, l.quality IS NOT NULL AS has_speaker,
  array_to_string(list_filter([CASE WHEN l.quality IS NOT NULL THEN 'speaker_cos' END, CASE WHEN l.quality < 0.45 THEN 'speaker_mismatch' END,
    CASE WHEN e.label IS NOT NULL THEN 'asr_cer' END, CASE WHEN e.label / 10.0 > 0.3 THEN 'asr_mismatch' END], lambda v: v IS NOT NULL), ';') AS flags
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON d.doc_id = e.vec_id""",
)
def enrich_left_joins(spark, sf):
    index = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("source"), F.coalesce("text", F.lit("x")).alias("text"), F.lit("ok").alias("status"), F.array().cast("array<string>").alias("flags"))
    speaker = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("key"), F.col("quality").cast("double").alias("speaker_cos"))
    asr = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("key"), (F.col("label") / 10.0).alias("cer"), F.lit("").alias("hypothesis"))
    out = enrich.enrich(index, speaker, asr)
    return out.select("doc_id", F.exists("flags", lambda f: f.startswith("speaker_cos:")).alias("has_speaker"), F.array_join(curate.kinds(F.col("flags")), ";").alias("flags"))


# ---------------------------------------------------------------- vectors

_UNIT = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / nrm) AS v FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS nrm FROM embeddings)),
c AS (SELECT label, pos, avg(x) AS x, count(*) AS n FROM (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM u) GROUP BY ALL),
e AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM u)"""


@query("speaker_centroid_cosine", f"WITH {_UNIT} SELECT vec_id, e.label AS label, round(sum(e.x * c.x) / sqrt(sum(c.x * c.x)), 6) AS cos FROM e JOIN c ON e.label = c.label AND e.pos = c.pos GROUP BY ALL")
def speaker_centroid_cosine(spark, sf):
    return enrich.speaker_similarity(table(spark, sf, "embeddings"), "vec_id", "embedding", "label").select("vec_id", "label", F.round("speaker_cos", 6).alias("cos"))


@query(
    "speaker_loo_cosine",
    f"WITH {_UNIT} SELECT vec_id, round(sum(e.x * (c.x * n - e.x)) / sqrt(sum((c.x * n - e.x) * (c.x * n - e.x))), 6) AS cos FROM e JOIN c ON e.label = c.label AND e.pos = c.pos GROUP BY vec_id, n",
)
def speaker_loo_cosine(spark, sf):
    out = enrich.speaker_similarity(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", leave_one_out=True)
    return out.select("vec_id", F.round("speaker_cos", 6).alias("cos"))


@query(
    "topk_refpick",
    f"WITH {_UNIT}, s AS (SELECT vec_id, round(sum(e.x * c.x) / sqrt(sum(c.x * c.x)), 6) AS cos FROM e JOIN c ON e.label = c.label AND e.pos = c.pos GROUP BY vec_id) SELECT vec_id, cos FROM s ORDER BY cos DESC, vec_id LIMIT 40",
)
def topk_refpick(spark, sf):
    out = enrich.speaker_similarity(table(spark, sf, "embeddings"), "vec_id", "embedding", "label").select(F.col("vec_id").alias("_ord"), F.round("speaker_cos", 6).alias("speaker_cos"))
    return enrich.pick_references(out).select(F.col("_ord").alias("vec_id"), F.col("speaker_cos").alias("cos"))


# ---------------------------------------------------------------- counts and gates


@query("label_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def label_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query(
    "text_source_counts",
    f"""WITH t AS (SELECT {norm_sql("CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE d.text END")} AS nt, c.text AS asr, b.text AS prov FROM documents d
LEFT JOIN (SELECT conv_id, min(text) AS text FROM conversations GROUP BY conv_id) c ON c.conv_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id)
SELECT CASE WHEN nt = '' AND coalesce(asr, '') <> '' THEN 'asr' WHEN nt = '' AND coalesce(prov, '') <> '' THEN 'provenance' ELSE 'filename' END AS text_source, count(*) AS n FROM t GROUP BY 1""",
)
def text_source_counts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text")).alias("text"))
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.min("text").alias("asr"))
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("prov"))
    j = d.join(c, "doc_id", "left").join(b, "doc_id", "left")
    return j.groupBy(curate.resolve_text(F.col("text"), F.col("asr"), F.col("prov"))["text_source"].alias("text_source")).agg(F.count("*").alias("n"))


@query("duration_stats", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, round(sum(value) / greatest(1, count(*)), 4) AS mean, max(value) AS peak FROM events GROUP BY event_type")
def duration_stats(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.sum("value") / F.greatest(F.count("*"), F.lit(1)), 4).alias("mean"), F.max("value").alias("peak"))


@query(
    "decision_gate",
    """SELECT user_id, count(*) FILTER (WHERE value >= 1) AS accepted, CASE WHEN count(*) FILTER (WHERE value >= 1) < 30 OR coalesce(sum(value) FILTER (WHERE value >= 1), 0) < 120 THEN 'DATA_BLOCKED' ELSE 'ok' END AS decision FROM events GROUP BY user_id""",
)
def decision_gate(spark, sf):
    ok = F.col("value") >= 1
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(ok).alias("accepted"), F.coalesce(F.sum(F.when(ok, F.col("value"))), F.lit(0.0)).alias("s"))
    return g.select("user_id", "accepted", F.when((F.col("accepted") < curate.PREP_MIN_ROWS) | (F.col("s") < curate.PREP_MIN_SECONDS), "DATA_BLOCKED").otherwise("ok").alias("decision"))


# ---------------------------------------------------------------- experiments


@query(
    "case_matrix_cross",
    """SELECT n_name AS pair_group, seed, side AS prompt_id, n_name || '_s' || seed AS pair_id, n_name || '_s' || seed || '_' || side AS case_id
FROM nation, (SELECT unnest([42, 43, 44]) AS seed), (SELECT unnest(['P0', 'P2']) AS side)""",
)
def case_matrix_cross(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("pair_group"), F.array(F.lit(42), F.lit(43), F.lit(44)).alias("seeds"))
    return experiments.expand_matrix(n).select("pair_group", "seed", "prompt_id", "pair_id", "case_id")


_PAIRS = """pairs AS (SELECT n_name AS case_id, 'base' AS l, r FROM nation, (SELECT unnest(['ckpt50', 'ckpt100', 'ckpt150']) AS r)
UNION ALL SELECT n_name, 'ckpt50', 'ckpt150' FROM nation WHERE n_regionkey = 0),
ids AS (SELECT case_id || '__' || l || '__' || r AS pair_id, case_id, l || '/' || case_id AS a, r || '/' || case_id AS b FROM pairs)"""


def _nation_pairs(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_name").alias("case_id"), "n_regionkey")
    return experiments.checkpoint_pairs(n, F.col("n_regionkey") == 0)


@query("pair_build", f"WITH {_PAIRS} SELECT pair_id, case_id, a, b FROM ids")
def pair_build(spark, sf):
    return _nation_pairs(spark, sf).select("pair_id", "case_id", F.col("cells")[0].alias("a"), F.col("cells")[1].alias("b"))


@query("pack_except", f"WITH {_PAIRS} SELECT pair_id FROM ids WHERE a LIKE 'base/%' AND b NOT LIKE 'ckpt50/%' AND case_id NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 1)")
def pack_except(spark, sf):
    pairs = _nation_pairs(spark, sf)
    base = pairs.where(F.col("cells")[0].startswith("base/"))
    first = base.where(F.col("cells")[1].startswith("ckpt50/"))
    second = base.join(table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("case_id")), "case_id", "left_semi")
    return experiments.rest_pack(base, first, second).select("pair_id")


@query(
    "reuse_verify",
    """SELECT o.o_orderkey AS case_id, CASE WHEN p.o_orderkey IS NULL THEN 'missing_prior' WHEN p.o_orderstatus <> 'F' THEN 'prior_not_ok' WHEN p.o_orderkey % 7 = 0 THEN 'missing_file'
  WHEN p.o_orderkey % 11 = 0 THEN 'sha_mismatch' WHEN o.o_orderpriority <> p.o_orderpriority THEN 'prompt_mismatch' WHEN o.o_custkey % 10 <> p.o_custkey % 10 THEN 'seed_mismatch' END AS blocked_reason
FROM orders o LEFT JOIN orders p ON p.o_orderkey = o.o_orderkey - 1""",
)
def reuse_verify(spark, sf):
    o = table(spark, sf, "orders")
    wanted = o.select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderkey") - 1).alias("prior_id"), F.lit("t").alias("text"), (F.col("o_custkey") % 10).alias("seed"), F.col("o_orderpriority").alias("prompt_sha256"), F.lit("r").alias("model_revision"))
    sha = F.sha2(F.col("o_orderkey").cast("string"), 256)
    prior = o.select(
        F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("error").alias("status"), F.lit("t").alias("text"), (F.col("o_custkey") % 10).alias("seed"),
        F.col("o_orderpriority").alias("prompt_sha256"), F.col("o_orderkey").alias("output"), F.when(F.col("o_orderkey") % 11 == 0, "x").otherwise(sha).alias("output_sha256"), F.lit(None).cast("string").alias("model_revision"),
        F.create_map(F.lit("cfg_value"), F.lit("2.0")).alias("effective_args"),
    )
    files = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("path"), F.upper(sha).alias("sha256"))
    return experiments.verify_reuse(wanted, prior, files, {"cfg_value": "2.0"}).select("case_id", "blocked_reason")


@query(
    "screening_flags",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linestatus <> 'O' THEN 'F' ELSE array_to_string(list_filter([CASE WHEN l_discount > 0.05 THEN 'clipping' END,
  CASE WHEN l_tax > 0.07 THEN 'mostly_silent' END, CASE WHEN l_linenumber > 5 THEN 'retry_' || l_linenumber END], lambda v: v IS NOT NULL), ';') END AS flags FROM lineitem""",
)
def screening_flags(spark, sf):
    li = table(spark, sf, "lineitem")
    status = F.when(F.col("l_linestatus") == "O", "ok").otherwise(F.col("l_linestatus"))
    flags = experiments.screening_flags(status, F.lit(True), F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0), F.when(F.col("l_tax") > 0.07, 0.9).otherwise(0.1), F.when(F.col("l_linenumber") > 5, F.col("l_linenumber")).otherwise(0))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(flags, ";").alias("flags"))


@query(
    "report_upsert",
    """SELECT o_orderkey, o_orderstatus, o_totalprice, 'old' AS origin FROM orders WHERE o_orderkey % 3 <> 0 AND NOT (o_orderkey % 2 = 0)
UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice, 'new' FROM orders WHERE o_orderkey % 2 = 0""",
)
def report_upsert(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return experiments.upsert(o.where("o_orderkey % 3 <> 0").withColumn("origin", F.lit("old")), o.where("o_orderkey % 2 = 0").withColumn("origin", F.lit("new")), ["o_orderkey"])


@query(
    "backend_health_merge",
    """SELECT s_nationkey AS backend, max(CASE WHEN s_suppkey % 2 = 1 THEN s_name END) AS newer, coalesce(max(CASE WHEN s_suppkey % 2 = 1 THEN s_name END), max(CASE WHEN s_suppkey % 2 = 0 THEN s_name END)) AS health FROM supplier GROUP BY s_nationkey""",
)
def backend_health_merge(spark, sf):
    s = table(spark, sf, "supplier")
    side = lambda k: s.where(f"s_suppkey % 2 = {k}").groupBy(F.col("s_nationkey").alias("backend")).agg(F.max("s_name").alias("health"))
    merged = experiments.upsert(side(0), side(1), ["backend"])
    return merged.join(side(1).withColumnRenamed("health", "newer"), "backend", "left").select("backend", "newer", "health")


@query("attach_asr_last", "SELECT c_custkey, arg_max(o_orderpriority, o_orderkey) AS last_priority, count(o_orderkey) > 0 AS has_asr FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def attach_asr_last(spark, sf):
    cases = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"))
    asr = table(spark, sf, "orders").select(F.col("o_orderkey").alias("_ord"), F.col("o_custkey").alias("case_id"), "o_orderpriority")
    return experiments.attach_asr(cases, asr).select(F.col("case_id").alias("c_custkey"), F.col("asr_aux.o_orderpriority").alias("last_priority"), F.col("asr_aux").isNotNull().alias("has_asr"))


@query("dup_sha_window", "SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AND text IS NOT NULL AS duplicate_sha FROM documents")
def dup_sha_window(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("output_sha256"))
    return experiments.duplicate_sha(d).select("doc_id", "duplicate_sha")


@query(
    "quartile_picks",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents WHERE text IS NOT NULL) SELECT DISTINCT doc_id FROM r WHERE rn IN (n // 4, 2 * n // 4, 3 * n // 4)""",
)
def quartile_picks(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return experiments.quartile_picks(d.select("doc_id", F.length("text").alias("size")), F.col("size"), "doc_id").select("doc_id")


@query(
    "segment_gap_stitch",
    """SELECT event_id, user_id, coalesce(least(greatest(s - lag(e) OVER (PARTITION BY user_id ORDER BY s, e), 0), 300), 0) AS kept_gap_ms FROM (SELECT event_id, user_id, event_id * 100 AS s, event_id * 100 + cast(floor(value * 10) AS BIGINT) AS e FROM events)""",
)
def segment_gap_stitch(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("file"), (F.col("event_id") * 100).alias("start_ms"), (F.col("event_id") * 100 + F.floor(F.col("value") * 10)).alias("end_ms"))
    return experiments.stitch_gaps(e).select("event_id", F.col("file").alias("user_id"), F.col("kept_gap_ms").cast("long").alias("kept_gap_ms"))


@query("name_collisions", "SELECT p_partkey, CASE WHEN k = 0 THEN p_name ELSE p_name || '-' || k END AS unique_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k FROM part)")
def name_collisions(spark, sf):
    return experiments.collision_names(table(spark, sf, "part"), "p_name", "p_partkey").select("p_partkey", "unique_name")


@query(
    "log_failures",
    "SELECT item_id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), 'out of memory|oom') THEN 'oom' END, CASE WHEN regexp_matches(lower(text), 'nan|inf') THEN 'nan_or_inf' END, CASE WHEN regexp_matches(lower(text), 'traceback|error:') THEN 'exception' END], lambda v: v IS NOT NULL), ',') AS failures FROM benchmark",
)
def log_failures(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(experiments.log_failures(F.col("text")), ",").alias("failures"))


# ---------------------------------------------------------------- ratings

_CELLS = """cells AS (SELECT conv_id, turn, conv_id || '/' || (turn // 2) AS pair_id, CASE WHEN turn % 2 = 0 THEN 'P0' ELSE 'P2' END AS prompt_id, conv_id || '/' || turn AS case_id,
  CASE WHEN length(text) % 7 = 0 THEN ' ' ELSE (1 + length(text) % 5)::VARCHAR END AS clarity, (1 + length(text) % 4)::VARCHAR AS grit, (1 + turn % 5)::VARCHAR AS likeness, '' AS naturalness, sha256(text) AS sha FROM conversations WHERE text IS NOT NULL)"""


def _cells(spark, sf) -> DataFrame:
    c, n = table(spark, sf, "conversations").where("text is not null"), F.length("text")
    return c.select(
        "conv_id", "turn", F.concat_ws("/", "conv_id", F.expr("turn div 2")).alias("pair_id"), F.when(F.col("turn") % 2 == 0, "P0").otherwise("P2").alias("prompt_id"), F.concat_ws("/", "conv_id", "turn").alias("case_id"),
        F.when(n % 7 == 0, " ").otherwise((n % 5 + 1).cast("string")).alias("clarity"), (n % 4 + 1).cast("string").alias("grit"), (F.col("turn") % 5 + 1).cast("string").alias("likeness"), F.lit("").alias("naturalness"),
        F.sha2("text", 256).alias("output_sha256"),
    )


@query(
    "rating_sha_status",
    f"""WITH {_CELLS}, m AS (SELECT case_id, CASE WHEN turn % 3 = 1 THEN NULL ELSE sha END AS sha FROM cells WHERE conv_id % 4 <> 3)
SELECT CASE WHEN m.case_id IS NULL THEN 'unknown_case' WHEN m.sha = c.sha THEN 'verified' ELSE 'stale_sha' END AS sha_status, count(*) AS n FROM cells c LEFT JOIN m ON m.case_id = c.case_id GROUP BY 1""",
)
def rating_sha_status(spark, sf):
    cells = _cells(spark, sf)
    cases = cells.where("conv_id % 4 <> 3").select("case_id", F.when(F.col("turn") % 3 != 1, F.col("output_sha256")).alias("output_sha256"))
    return ratings.sha_status(cells, cases).groupBy("sha_status").agg(F.count("*").alias("n"))


@query(
    "pair_summary_delta",
    f"""WITH {_CELLS}, l AS (SELECT pair_id, prompt_id, unnest(['clarity', 'grit', 'likeness', 'naturalness']) AS dim, unnest([clarity, grit, likeness, naturalness]) AS s FROM cells),
m AS (SELECT pair_id, prompt_id, dim, format('{{:.2f}}', avg(TRY_CAST(nullif(trim(s), '') AS DOUBLE)))::DOUBLE AS m FROM l GROUP BY ALL),
s AS (SELECT pair_id, format('{{:.2f}}', avg(m) FILTER (WHERE prompt_id = 'P0'))::DOUBLE AS p0, format('{{:.2f}}', avg(m) FILTER (WHERE prompt_id = 'P2'))::DOUBLE AS p2 FROM m GROUP BY pair_id)
SELECT pair_id, p0 AS "P0_mean", p2 AS "P2_mean", format('{{:.2f}}', p2 - p0)::DOUBLE AS delta FROM s""",
)
def pair_summary_delta(spark, sf):
    return ratings.pair_summary(_cells(spark, sf))


@query("winner_tally", "SELECT split_part(w, '/', 1) AS winner, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'TIE' ELSE o_orderstatus || '/' || o_orderpriority END AS w FROM orders) GROUP BY 1")
def winner_tally(spark, sf):
    w = F.when(F.col("o_orderkey") % 10 == 0, "TIE").otherwise(F.concat_ws("/", "o_orderstatus", "o_orderpriority"))
    return ratings.winner_tally(table(spark, sf, "orders").select(w.alias("winner_condition")))


@query(
    "context_variance",
    f"""WITH {_CELLS}, g AS (SELECT sha256((conv_id % 30) || '/' || (turn % 2)) AS sha, count(*) AS n, list_sort(list(case_id)) AS ids, count(DISTINCT coalesce(nullif(trim(clarity), ''), '~')) AS a, count(DISTINCT grit) AS b, count(DISTINCT likeness) AS c FROM cells GROUP BY 1 HAVING count(*) > 1)
SELECT sha AS output_sha256, n, array_to_string(ids, ',') AS case_ids, array_to_string(list_filter([CASE WHEN a > 1 THEN 'clarity' END, CASE WHEN b > 1 THEN 'grit' END, CASE WHEN c > 1 THEN 'likeness' END], lambda v: v IS NOT NULL), ',') AS divergent FROM g""",
)
def context_variance(spark, sf):
    """Recordings that are rated in many conversations."""
    shared = F.sha2(F.concat(F.col("conv_id") % 30, F.lit("/"), F.col("turn") % 2), 256)
    v = ratings.context_variance(_cells(spark, sf).withColumn("output_sha256", shared))
    return v.select("output_sha256", "n", F.array_join("case_ids", ",").alias("case_ids"), F.array_join("divergent", ",").alias("divergent"))


@query(
    "review_status",
    """WITH s AS (SELECT user_id, count(*) AS n_total, count(*) FILTER (WHERE event_type <> 'error' OR value > 1) AS n_rated, bool_or(value > 45) AS fatigue, bool_and(value >= 0) AS assets_ok FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN NOT assets_ok THEN 'BLOCKED' WHEN n_rated < n_total THEN 'PENDING_USER_LISTENING' WHEN fatigue THEN 'UNCERTAIN_FATIGUE' ELSE 'RATED' END AS status FROM s""",
)
def review_status(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if((F.col("event_type") != "error") | (F.col("value") > 1)).alias("r"), F.bool_or(F.col("value") > 45).alias("f"), F.bool_and(F.col("value") >= 0).alias("a"))
    return s.select("user_id", ratings.review_status(F.col("a"), F.col("r"), F.col("n"), F.col("f")).alias("status"))


@query("blind_labels", "SELECT s_suppkey, printf('%d-%02d', s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)) AS label FROM supplier")
def blind_labels(spark, sf):
    return ratings.anonymous_labels(table(spark, sf, "supplier"), "s_nationkey", "s_suppkey").select("s_suppkey", "label")


# ---------------------------------------------------------------- audits

_KEYS = "k AS (SELECT p_partkey, p_type AS dtype, p_size AS numel, p_retailprice AS l2, CASE p_partkey % 4 WHEN 0 THEN 'base_lm.' WHEN 1 THEN 'feat_decoder.' WHEN 2 THEN 'enc_proj.' ELSE 'x.' END || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.lora_A' WHEN 1 THEN '.lora_B' ELSE '' END AS key FROM part)"
_GROUP = "CASE WHEN contains(key, 'base_lm.') OR contains(key, 'residual_lm.') THEN 'lm' WHEN contains(key, 'feat_decoder.') THEN 'dit' WHEN contains(key, '_proj') OR contains(key, 'fusion_concat') THEN 'proj' ELSE 'other' END"


def _keys(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    head = F.when(k % 4 == 0, "base_lm.").when(k % 4 == 1, "feat_decoder.").when(k % 4 == 2, "enc_proj.").otherwise("x.")
    tail = F.when(k % 3 == 0, ".lora_A").when(k % 3 == 1, ".lora_B").otherwise("")
    return table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("dtype"), F.col("p_size").cast("long").alias("numel"), F.concat(head, k.cast("string"), tail).alias("key"), F.col("p_retailprice").alias("l2"))


@query("weight_census", f"WITH {_KEYS} SELECT {_GROUP} AS grp, count(*) AS keys, sum(numel)::BIGINT AS numel, count(*) FILTER (WHERE contains(key, '.lora_A')) AS a, count(*) FILTER (WHERE contains(key, '.lora_B')) AS b, array_to_string(list_sort(list(DISTINCT dtype)), ',') AS dtypes, round(sqrt(sum(l2 * l2)), 4) AS l2 FROM k GROUP BY 1")
def weight_census(spark, sf):
    k = _keys(spark, sf)
    stats = k.select("key", "l2", F.lit(1.0).alias("nonzero"), F.lit(0).alias("nan"), F.lit(0).alias("inf"))
    c = verdicts.weights_census(k.select("key", "dtype", "numel"), stats)
    return c.select("grp", "keys", "numel", "a", "b", F.array_join("dtypes", ",").alias("dtypes"), F.round("l2", 4).alias("l2"))


@query(
    "weight_diff_grouping_sets",
    f"""WITH {_KEYS}, d AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN '50->100' ELSE '100->150' END AS transition, {_GROUP} AS grp, CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE l2 / 1e4 END AS rel FROM k)
SELECT transition, grp, count(*) FILTER (WHERE rel <> 0) AS changed, count(*) FILTER (WHERE rel = 0) AS unchanged, max(rel) AS max_rel_l2, bool_or(rel <> 0) AS trained FROM d GROUP BY GROUPING SETS ((transition), (transition, grp))""",
)
def weight_diff_grouping_sets(spark, sf):
    k = _keys(spark, sf)
    d = k.select(F.when(F.col("p_partkey") % 2 == 0, "50->100").otherwise("100->150").alias("transition"), "key", F.when(F.col("p_partkey") % 5 == 0, 0.0).otherwise(F.col("l2") / 1e4).alias("rel_l2"), F.lit(False).alias("identical"))
    return verdicts.weight_diffs(d)


@query(
    "set_integrity",
    f"""WITH {_KEYS}, s AS (SELECT dtype, list(DISTINCT key) AS ckpt, coalesce(list(DISTINCT key) FILTER (WHERE numel % 10 <> 0), []) AS loaded, coalesce(list(DISTINCT key) FILTER (WHERE numel % 20 = 0), []) AS skipped FROM k GROUP BY dtype)
SELECT dtype, len(list_filter(ckpt, lambda x: NOT list_contains(loaded, x) AND NOT list_contains(skipped, x)))::INTEGER AS missing, len(skipped)::INTEGER AS unexplained,
  CASE WHEN len(loaded) > 0 AND len(list_filter(ckpt, lambda x: NOT list_contains(loaded, x) AND NOT list_contains(skipped, x))) = 0 AND len(skipped) = 0 THEN 'LOAD_OK' ELSE 'ADAPTER_LOAD_FAILED' END AS verdict FROM s""",
)
def set_integrity(spark, sf):
    k = _keys(spark, sf).groupBy("dtype").agg(F.collect_set("key").alias("ckpt"), F.collect_set(F.when(F.col("numel") % 10 != 0, F.col("key"))).alias("loaded"), F.collect_set(F.when(F.col("numel") % 20 == 0, F.col("key"))).alias("skipped"))
    v = k.withColumn("v", verdicts.load_integrity(F.col("ckpt"), F.col("loaded"), F.col("skipped"), required=("lm",)))
    return v.select("dtype", F.size("v.missing_keys").alias("missing"), F.size("v.unexplained_skipped").alias("unexplained"), "v.verdict")


@query(
    "verdict_lattice",
    """WITH v AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS det, o_orderkey % 2 = 0 AS same, o_orderkey % 5 <> 0 AS differs, o_totalprice / 500000 AS corr FROM orders),
w AS (SELECT *, CASE WHEN NOT det THEN 'NONDETERMINISTIC_RUN' WHEN NOT same THEN CASE WHEN corr >= 0.9999 THEN 'DISABLED_NEAR_BASE_ONLY' ELSE 'DISABLED_NOT_EQ_BASE' END WHEN NOT differs THEN 'ADAPTER_NOT_EFFECTIVE' WHEN corr > 0.99999 THEN 'ADAPTER_NUMERIC_NOISE_ONLY' ELSE 'ADAPTER_EFFECTIVE' END AS onoff FROM v)
SELECT onoff, CASE WHEN onoff IN ('NONDETERMINISTIC_RUN', 'DISABLED_NOT_EQ_BASE') THEN 'COMPARABILITY_LIMITED' WHEN onoff = 'ADAPTER_EFFECTIVE' THEN CASE WHEN corr > 0.5 THEN 'ADAPTER_EFFECTIVE_NO_CLEAR_GAIN' ELSE 'COMPARABILITY_LIMITED' END
  WHEN onoff IN ('ADAPTER_NOT_EFFECTIVE', 'ADAPTER_NUMERIC_NOISE_ONLY') THEN 'ADAPTER_NOT_EFFECTIVE' ELSE 'INCONCLUSIVE' END AS final, count(*) AS n FROM w GROUP BY ALL""",
)
def verdict_lattice(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    corr = F.col("o_totalprice") / 500000
    pick = lambda cond, a, b: F.when(cond, a).otherwise(b)
    onoff = verdicts.onoff_verdict(F.lit("x"), pick(k % 2 == 0, "x", "y"), pick(k % 5 != 0, "c", pick(k % 2 == 0, "x", "y")), pick((k % 3 == 0), pick(k % 5 != 0, "c", pick(k % 2 == 0, "x", "y")), "other"), corr, corr)
    out = o.select(onoff.alias("onoff"), corr.alias("corr"))
    return out.groupBy("onoff", verdicts.final_verdict(F.lit(True), F.lit(True), F.col("onoff"), F.col("corr") > 0.5).alias("final")).agg(F.count("*").alias("n"))


@query(
    "argument_diffs",
    """SELECT a.o_orderkey, array_to_string(list_filter([CASE WHEN a.o_orderpriority <> b.o_orderpriority THEN 'text' END, CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'prompt_wav_path' END], lambda v: v IS NOT NULL), ',') AS differing
FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1""",
)
def argument_diffs(spark, sf):
    args = F.create_map(F.lit("text"), F.col("o_orderpriority"), F.lit("prompt_wav_path"), F.concat(F.lit("d\\"), F.col("o_orderkey").cast("string"), F.lit("/"), F.col("o_orderstatus")))
    o = table(spark, sf, "orders").select("o_orderkey", args.alias("a"))
    b = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("a").alias("b"))
    return o.join(b, "o_orderkey").select("o_orderkey", F.array_join(F.map_keys(verdicts.argument_diffs(F.col("a"), F.col("b"))), ",").alias("differing"))


@query("outputs_rehash", "SELECT count(*) FILTER (WHERE item_id % 5 <> 0) AS verified, count(*) AS total, bool_and(item_id % 5 <> 0) AS all_match FROM benchmark")
def outputs_rehash(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), F.col("item_id").alias("output"), F.sha2("text", 256).alias("output_sha256"))
    files = b.where("case_id % 5 <> 0").select(F.col("output").alias("path"), F.col("output_sha256").alias("sha256"))
    return verdicts.verify_outputs(b, files).agg(F.count_if("match").alias("verified"), F.count("*").alias("total"), F.bool_and("match").alias("all_match"))


# ---------------------------------------------------------------- signals


@query("frame_rms_silence", """SELECT vec_id, count(*) AS frames, count(*) FILTER (WHERE r < 0.05) AS quiet FROM (SELECT vec_id, i, sqrt(list_sum(list_transform(list_slice(embedding, i * 8 + 1, i * 8 + 16), lambda x: x::DOUBLE * x::DOUBLE)) / 16) AS r FROM embeddings, (SELECT unnest(range(0, 7)) AS i)) GROUP BY vec_id""")
def frame_rms_silence(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", vx.doubles(F.col("embedding")).alias("x"))
    f = F.transform(sg.frames(F.col("x"), F.lit(16), F.lit(8)), sg.rms)
    return e.select("vec_id", f.alias("f")).select("vec_id", F.size("f").cast("long").alias("frames"), F.size(F.filter("f", lambda r: r < 0.05)).cast("long").alias("quiet"))


@query("wave_difference", """SELECT a.vec_id AS vec_id, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def wave_difference(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").select("vec_id", F.round(sg.wave_diff(F.col("embedding"), F.col("other"))["cosine"], 6).alias("cosine"))


def _long_signals(spark, sf) -> DataFrame:
    """Each user's values in event order, as a signal of 24 kHz."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("v"))
    return e.select("user_id", F.transform("v", lambda s: s["value"] / 100 - 0.25).alias("x"))


@query("events_json_extract", "SELECT event_type, sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0))::BIGINT AS total, count(*) AS n FROM events GROUP BY event_type")
def events_json_extract(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(F.coalesce(k, F.lit(0))).alias("total"), F.count("*").alias("n"))


# ---------------------------------------------------------------- reports


@query(
    "path_roles",
    "SELECT page_id, CASE WHEN len(p) > 1 THEN p[1] ELSE CASE WHEN nm LIKE 'original%' THEN 'original' ELSE split_part(nm, '_', 1) END END AS backend, CASE WHEN contains(nm, 'codec') THEN 'codec_roundtrip' WHEN contains(nm, 'zero_shot') THEN 'zero_shot' WHEN nm LIKE 'original%' THEN 'original' ELSE 'generate' END AS kind FROM (SELECT page_id, p, regexp_replace(p[-1], '\\.[^.]*$', '') AS nm FROM (SELECT page_id, string_split(url, '/') AS p FROM pages))",
)
def path_roles(spark, sf):
    return table(spark, sf, "pages").select("page_id", reports.path_role(F.col("url")).alias("r")).select("page_id", "r.*")


@query("backend_order", "SELECT event_type, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 END::INTEGER AS rank FROM (SELECT DISTINCT event_type FROM events)")
def backend_order(spark, sf):
    out = reports.display_order(table(spark, sf, "events"), "event_type", ("view", "click"))
    return out.select("event_type", F.col("rank").cast("int").alias("rank"))


@query("page_contracts", """SELECT s_nationkey AS name, count(*) AS assets, array_to_string(list_sort(list(s_suppkey::VARCHAR)), ',') AS review_ids, bool_and(s_suppkey % 9 <> 0) AS complete FROM supplier GROUP BY s_nationkey""")
def page_contracts(spark, sf):
    s = table(spark, sf, "supplier")
    pages = s.select(F.col("s_nationkey").alias("name"), F.col("s_suppkey").cast("string").alias("review_id"), F.array("s_name").alias("cells"), F.array(F.lit("A"), F.lit("B")).alias("order"))
    assets = s.where("s_suppkey % 9 <> 0").select(F.col("s_name").alias("asset"), F.col("s_name").alias("path"), F.sha2("s_name", 256).alias("sha256"))
    c = reports.build_contracts(pages, assets)
    return c.select("name", F.size("review_ids").cast("long").alias("assets"), F.array_join("review_ids", ",").alias("review_ids"), "complete")


@query("logical_ids", "SELECT c.c_custkey AS c_custkey, coalesce(n.n_name, c.c_mktsegment) AS id, n.n_name IS NOT NULL AS known FROM customer c LEFT JOIN nation n ON c.c_mktsegment = n.n_name")
def logical_ids(spark, sf):
    samples = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("path"))
    return reports.logical_ids(samples, table(spark, sf, "nation").select(F.col("n_name").alias("path"), F.col("n_name").alias("id"))).select("c_custkey", "id", "known")


@query("session_states", "SELECT user_id AS session, arg_max(event_type, event_id) AS state, count(*) AS n, arg_max(event_type, event_id) IN ('completed', 'failed') AS ended FROM events GROUP BY user_id")
def session_states(spark, sf):
    return reports.session_states(table(spark, sf, "events").select(F.col("event_id").alias("_ord"), F.col("user_id").alias("session"), F.col("event_type").alias("state")))


@query(
    "message_correlation",
    """WITH q AS (SELECT user_id AS id, arg_min(event_type, event_id) AS method FROM events WHERE event_id % 3 = 0 GROUP BY user_id), r AS (SELECT user_id AS id, arg_min(value > 1, event_id) AS ok FROM events WHERE event_id % 3 = 1 GROUP BY user_id)
SELECT q.id, method, ok FROM q LEFT JOIN r ON q.id = r.id""",
)
def message_correlation(spark, sf):
    e = table(spark, sf, "events")
    m = e.select(F.col("event_id").alias("_ord"), F.col("user_id").alias("id"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("method"), F.when(F.col("event_id") % 3 == 2, "x").alias("event"), (F.col("value") > 1).alias("ok"), F.lit("").alias("result"), F.lit("").alias("error"))
    return reports.correlate_messages(m).select("id", "method", "ok")


# ---------------------------------------------------------------- streaming (an extension)


@query("stream_latest_state", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, count(*) AS n FROM events GROUP BY user_id")
def stream_latest_state(spark, sf):
    return stream.latest_of(stream.run_to_end(spark, stream.latest_state(stream.read_events(spark, sf))), "user_id")
