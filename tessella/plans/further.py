"""Queries of curation, experiments, ratings, reports and streams beyond the catalogue's first part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import canonical, dsp
from tessella.functions import signals as sg
from tessella.functions import text as tx
from tessella.functions import vectors as vx
from tessella.operators import curate, enrich, experiments, ratings, reports, verdicts
from tessella.plans.catalogue import _BASE, _cells, _CELLS, _index, _long_signals, norm_sql, query, split_sql
from tessella.session import materialize, table
from tessella.sources import ordering, sinks
from tessella.streaming import events as stream

# ---------------------------------------------------------------- text

_SPLIT = "'[^。！？!?；;…]*[。！？!?；;…]|[^。！？!?；;…]+'"
_CLAUSE = "'[^，,、：:]*[，,、：:]|[^，,、：:]+'"


def chunks_sql(x: str, limit: int, hard: bool, keep_blank: bool) -> str:
    """The packing of ``x`` as one fold over its clauses."""
    strip = lambda xs: f"list_filter(list_transform({xs}, lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"
    clauses = f"flatten(list_transform({strip(f'regexp_extract_all({x}, {_SPLIT})')}, lambda s: CASE WHEN length(s) > {limit} THEN {strip(f'regexp_extract_all(s, {_CLAUSE})')} ELSE [s] END))"
    cuts = f"(CASE WHEN {str(hard).lower()} AND length(e.cur) > {limit} THEN (length(e.cur) - 1) // {limit} ELSE 0 END)"
    rest = f"substr(e.cur, {cuts} * {limit} + 1)"
    closing = f"(acc.cur <> '' AND ({cuts} > 0 OR length(acc.cur) + length({rest}) > {limit}))"
    done = f"acc.done || CASE WHEN {closing} THEN [acc.cur] ELSE []::VARCHAR[] END || list_transform(range({cuts}), lambda i: substr(e.cur, i * {limit} + 1, {limit}))"
    empty = "{'done': []::VARCHAR[], 'cur': ''}"
    fold = f"list_reduce(list_prepend({empty}, list_transform({clauses}, lambda c: {{'done': []::VARCHAR[], 'cur': c}})), lambda acc, e: {{'done': {done}, 'cur': CASE WHEN {closing} THEN '' ELSE acc.cur END || {rest}}})"
    packed = f"(SELECT p.done || CASE WHEN p.cur <> '' THEN [p.cur] ELSE []::VARCHAR[] END FROM (SELECT {fold} AS p))"
    return f"(SELECT CASE WHEN len(k) = 0 AND {str(keep_blank).lower()} THEN [{x}] ELSE k END FROM (SELECT {packed} AS k))"


_LINE = r"regexp_replace(text, '\s+', ' ', 'g')"


@query("sentence_chunks", f"WITH c AS (SELECT conv_id, turn, {_LINE} AS t FROM conversations WHERE text IS NOT NULL), k AS (SELECT conv_id, turn, {chunks_sql('t', 100, True, True)} AS k FROM c) SELECT conv_id, turn, i - 1 AS pos, k[i] AS chunk FROM (SELECT *, unnest(range(1, len(k) + 1)) AS i FROM k)")
def sentence_chunks(spark, sf):
    c = table(spark, sf, "conversations").where("text is not null")
    return c.select("conv_id", "turn", F.posexplode(tx.split_sentences(tx.collapse_space(F.col("text")), 100)).alias("pos", "chunk")).withColumn("pos", F.col("pos").cast("long"))


@query("sentence_chunks_soft", f"WITH c AS (SELECT conv_id, turn, {_LINE} AS t FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, len(k) AS n, sha256(array_to_string(k, '|')) AS joined FROM (SELECT conv_id, turn, {chunks_sql('t', 60, False, False)} AS k FROM c)")
def sentence_chunks_soft(spark, sf):
    """The variant that never cuts inside a clause and has nothing for a blank text."""
    c = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", tx.split_sentences(tx.collapse_space(F.col("text")), 60, hard_cut=False, keep_blank=False).alias("k"))
    return c.select("conv_id", "turn", F.size("k").cast("long").alias("n"), F.sha2(F.array_join("k", "|"), 256).alias("joined"))


@query("collapse_space", f"SELECT doc_id, sha256({_LINE}) AS h FROM documents")
def collapse_space(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.collapse_space(F.col("text")), 256).alias("h"))


@query("chunk_seeds", f"WITH c AS (SELECT conv_id || '/' || turn AS key, turn, {_LINE} AS t FROM conversations WHERE text IS NOT NULL), k AS (SELECT key, turn, {chunks_sql('t', 100, True, True)} AS k FROM c) SELECT key, i - 1 AS pos, k[i] AS chunk, 42 + turn + i - 1 AS seed, (CASE WHEN i > 1 THEN 0.2 ELSE 0.0 END)::DOUBLE AS gap_s FROM (SELECT *, unnest(range(1, len(k) + 1)) AS i FROM k)")
def chunk_seeds(spark, sf):
    c = table(spark, sf, "conversations").where("text is not null").select(F.concat_ws("/", "conv_id", "turn").alias("key"), tx.split_sentences(tx.collapse_space(F.col("text")), 100).alias("chunks"), F.col("turn"))
    return reports.chunk_plan(c, "key", "chunks", 42 + F.col("turn")).withColumn("pos", F.col("pos").cast("long"))


@query("retry_counts", "SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents")
def retry_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.count_of(F.col("text"), "the").cast("long").alias("n"))


@query("name_guards", r"SELECT s_suppkey, regexp_full_match(id, '[a-z0-9_]+') AS id_ok, regexp_full_match(name, 'listen-ratings[\w-]*\.json') AS name_ok FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'hero_' || s_suppkey WHEN 1 THEN s_name WHEN 2 THEN '' ELSE '../x' END AS id, CASE s_suppkey % 3 WHEN 0 THEN 'listen-ratings-' || s_suppkey || '.json' WHEN 1 THEN 'listen-ratings.json.bak' ELSE 'x/listen-ratings.json' END AS name FROM supplier)")
def name_guards(spark, sf):
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    id_ = F.when(k % 4 == 0, F.concat(F.lit("hero_"), k)).when(k % 4 == 1, F.col("s_name")).when(k % 4 == 2, "").otherwise("../x")
    name = F.when(k % 3 == 0, F.concat(F.lit("listen-ratings-"), k, F.lit(".json"))).when(k % 3 == 1, "listen-ratings.json.bak").otherwise("x/listen-ratings.json")
    return s.select("s_suppkey", tx.valid_id(id_).alias("id_ok"), tx.valid_ratings_name(name).alias("name_ok"))


@query("json_guard", "SELECT event_id, event_id % 4 = 0 AS ok FROM events")
def json_guard(spark, sf):
    k = F.col("event_id")
    raw = F.when(k % 4 == 0, F.col("props")).when(k % 4 == 1, F.concat(F.lit("["), "props", F.lit("]"))).when(k % 4 == 2, "{broken").otherwise(F.lit(""))
    return table(spark, sf, "events").select("event_id", tx.is_json_object(raw).alias("ok"))


_PAIR_TEXT = "replace(regexp_replace(regexp_replace(coalesce({}, ''), '<\\|[^|]+\\|>', '', 'g'), '\\p{{So}}', '', 'g'), chr(1), '')"


# ---------------------------------------------------------------- curation


@query(
    "freeze_excludes",
    f"""WITH {_BASE}, gone AS (SELECT DISTINCT sha FROM ided JOIN labels USING (doc_id) WHERE quality = 0 OR toxic = 1),
marked AS (SELECT i.*, CASE WHEN sha IN (SELECT sha FROM gone) THEN 'reviewed_out' WHEN nt = '' THEN 'no_text' END AS early FROM ided i),
firsts AS (SELECT nt, arg_min(sha, doc_id) AS sha, min(doc_id) AS first_id FROM marked WHERE early IS NULL GROUP BY nt)
SELECT m.doc_id AS doc_id, fid, CASE WHEN early IS NOT NULL THEN early WHEN m.doc_id = f.first_id THEN NULL WHEN m.sha = f.sha THEN 'dup_audio' ELSE 'dup_text' END AS why,
  CASE WHEN early IS NULL AND m.doc_id = f.first_id THEN {split_sql('fid')} END AS split FROM marked m LEFT JOIN firsts f ON m.early IS NULL AND m.nt = f.nt""",
)
def freeze_excludes(spark, sf):
    """The general freeze with its exclusions: half of them named by id, half by content."""
    rows = table(spark, sf, "labels").where("quality = 0 or toxic = 1").select("doc_id").distinct().join(_index(spark, sf).withColumnRenamed("_ord", "doc_id"), "doc_id")
    fid = tx.text_fid(F.col("text"), F.col("audio_sha256"))
    out = rows.select(F.when(F.col("doc_id") % 2 == 0, fid).otherwise(F.col("audio_sha256")).alias("key"))
    return curate.freeze(spark, _index(spark, sf), out).select(F.col("_ord").alias("doc_id"), "fid", "why", "split")


@query("no_text_flag", "SELECT doc_id, CASE WHEN coalesce(text, '') = '' OR doc_id % 3 = 0 THEN 'too_hot;no_text' ELSE 'too_hot' END AS flags FROM documents")
def no_text_flag(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(curate.with_no_text(F.array(F.lit("too_hot")), F.when(F.col("doc_id") % 3 != 0, F.col("text"))), ";").alias("flags"))


@query("cos_of_flags", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label / 10.0 END AS cos FROM embeddings")
def cos_of_flags(spark, sf):
    e, k = table(spark, sf, "embeddings"), F.col("vec_id")
    flags = F.when(k % 3 == 0, F.array(F.lit("too_hot:1"), F.concat(F.lit("speaker_cos:"), F.col("label") / 10), F.lit("speaker_cos:9"))).when(k % 3 == 1, F.array(F.lit("speaker_cos:none"))).otherwise(F.array().cast("array<string>"))
    return e.select("vec_id", enrich.cos_of(flags).alias("cos"))


@query(
    "asr_backfill",
    """SELECT doc_id, CASE WHEN ok AND empty AND hyp <> '' THEN hyp END AS text_asr, CASE WHEN NOT ok THEN 'old' WHEN empty AND hyp <> '' THEN 'old;text_from_asr' WHEN empty THEN 'old'
  WHEN cer > 0.3 THEN 'old;asr_cer;asr_mismatch' ELSE 'old;asr_cer' END AS flags
FROM (SELECT doc_id, doc_id % 7 <> 0 AS ok, doc_id % 4 = 0 OR coalesce(text, '') = '' AS empty, CASE WHEN doc_id % 8 = 0 THEN '' ELSE lang || ' heard' END AS hyp, (doc_id % 10) / 10.0 AS cer FROM documents)""",
)
def asr_backfill(spark, sf):
    """Empty texts take what was recognised; flags of earlier runs are replaced."""
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    index = d.select("doc_id", k.cast("string").alias("source"), F.when(k % 4 == 0, "").otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.when(k % 7 == 0, "rejected").otherwise("ok").alias("status"), F.when(k % 7 == 0, F.array(F.lit("old"))).otherwise(F.array(F.lit("old"), F.lit("asr_cer:9.9"))).alias("flags"))
    asr = d.select(k.cast("string").alias("key"), ((k % 10) / 10).alias("cer"), F.when(k % 8 == 0, "").otherwise(F.concat("lang", F.lit(" heard"))).alias("hypothesis"))
    out = enrich.enrich(index, spark.createDataFrame([], "key string, speaker_cos double"), asr)
    return out.select("doc_id", "text_asr", F.array_join(curate.kinds(F.col("flags")), ";").alias("flags"))


_PREPARE = f"""c AS (SELECT conv_id * 1000 + turn AS ord, 'f' || conv_id || '_' || turn AS fid, CASE WHEN turn % 13 = 3 THEN 'ASIA' WHEN turn % 13 = 4 THEN 'EUROPEx' WHEN turn % 13 = 5 THEN 'x' ELSE coalesce(text, '') END AS text,
  CASE WHEN conv_id % 9 <> 1 THEN sha256(coalesce(text, '') || (conv_id % 2)) END AS sha, (conv_id % 50) / 10.0 AS dur, conv_id % 11 <> 2 AS readable, CASE WHEN conv_id % 17 = 3 THEN -60.0 ELSE -20.0 END AS rms, conv_id FROM conversations),
n AS (SELECT *, {norm_sql('text')} AS nt FROM c),
e AS (SELECT *, CASE WHEN conv_id % 20 = 4 THEN 'leak_fid' WHEN sha IS NULL THEN 'missing_file' WHEN conv_id % 23 = 5 THEN 'leak_audio_sha' WHEN length(nt) < 2 THEN 'bad_text' WHEN nt = 'ASIA' THEN 'leak_text_exact' WHEN nt = 'EUROPEx' THEN 'leak_text_similar' END AS early,
  CASE WHEN NOT readable THEN 'bad_audio' WHEN dur < 0.4 OR dur > 90 THEN 'bad_duration' WHEN rms < -50 THEN 'silent' END AS late FROM n)"""


def _prepared(spark, sf) -> DataFrame:
    """conversations as training rows; some texts are, or nearly are, names of regions, which are blocked."""
    c, k, t = table(spark, sf, "conversations"), F.col("conv_id"), F.col("turn")
    text = F.when(t % 13 == 3, "ASIA").when(t % 13 == 4, "EUROPEx").when(t % 13 == 5, "x").otherwise(F.coalesce("text", F.lit("")))
    sha = F.sha2(F.concat(F.coalesce("text", F.lit("")), k % 2), 256)
    rows = c.select(
        (k * 1000 + t).alias("_ord"), F.concat(F.lit("f"), k, F.lit("_"), t).alias("fid"), text.alias("text"), F.when(k % 9 != 1, F.when(k % 2 == 0, F.upper(sha)).otherwise(sha)).alias("file_sha256"),
        (k % 11 != 2).alias("readable"), ((k % 50) / 10).alias("duration_s"), F.when(k % 17 == 3, -60.0).otherwise(-20.0).alias("rms_dbfs"),
    )
    fids = c.where("conv_id % 20 = 4").select(F.concat(F.lit("f"), k, F.lit("_"), t).alias("key"))
    shas = c.where("conv_id % 23 = 5 and conv_id % 9 <> 1").select(sha.alias("key"))
    texts = table(spark, sf, "region").select(tx.norm_text(F.col("r_name")).alias("key"))
    return curate.prepare_training(spark, rows, fids, shas, texts)


def _prepare_sql(rows: str) -> str:
    """The cascade with sequential acceptance as one fold over the undecided rows, in order."""
    item = "{'sha': [lower(sha)], 'nt': [nt], 'ord': ord, 'late': late, 'out': []::STRUCT(ord BIGINT, reason VARCHAR)[]}"
    sha, nt = "list_contains(acc.sha, x.sha[1])", "list_contains(acc.nt, x.nt[1])"
    why = f"CASE WHEN {sha} THEN 'duplicate_audio' WHEN {nt} THEN 'duplicate_text' ELSE x.late END"
    fold = f"list_reduce(list_prepend({{'sha': []::VARCHAR[], 'nt': []::VARCHAR[], 'ord': 0::BIGINT, 'late': NULL::VARCHAR, 'out': []::STRUCT(ord BIGINT, reason VARCHAR)[]}}, list({item} ORDER BY ord)), lambda acc, x: {{'sha': CASE WHEN {why} IS NULL THEN acc.sha || x.sha ELSE acc.sha END, 'nt': CASE WHEN {why} IS NULL THEN acc.nt || x.nt ELSE acc.nt END, 'ord': x.ord, 'late': x.late, 'out': acc.out || [{{'ord': x.ord, 'reason': {why}}}]}})"
    return f"WITH {_PREPARE}, leaked AS (SELECT DISTINCT lower(sha) AS s FROM c WHERE conv_id % 23 = 5 AND sha IS NOT NULL), e2 AS (SELECT * REPLACE (CASE WHEN early = 'leak_fid' OR early = 'missing_file' THEN early WHEN lower(sha) IN (SELECT s FROM leaked) THEN 'leak_audio_sha' ELSE early END AS early) FROM e), folded AS (SELECT {fold}.out AS o FROM e2 WHERE early IS NULL), d AS (SELECT unnest(o) AS x FROM folded) {rows}"


@query("reject_cascade", _prepare_sql("SELECT ord, early AS reason FROM e2 WHERE early IS NOT NULL UNION ALL SELECT x.ord, x.reason FROM d"))
def reject_cascade(spark, sf):
    return _prepared(spark, sf).select(F.col("_ord").alias("ord"), "reason")


@query(
    "prepare_stats",
    _prepare_sql("""SELECT count(*) FILTER (WHERE r IS NULL) AS accepted, count(*) FILTER (WHERE r IS NOT NULL) AS rejected, round(coalesce(sum(dur) FILTER (WHERE r IS NULL), 0), 6) AS total_seconds,
  CASE WHEN count(*) FILTER (WHERE r IS NULL) < 30 OR coalesce(sum(dur) FILTER (WHERE r IS NULL), 0) < 120 THEN 'DATA_BLOCKED' ELSE 'ok' END AS decision,
  count(*) FILTER (WHERE r = 'duplicate_text') AS duplicate_text FROM (SELECT ord, early AS r FROM e2 WHERE early IS NOT NULL UNION ALL SELECT x.ord, x.reason FROM d) JOIN (SELECT ord, dur FROM c) USING (ord)"""),
)
def prepare_stats(spark, sf):
    s = curate.prepare_stats(_prepared(spark, sf))
    return s.select("accepted", "rejected", F.round("total_seconds", 6).alias("total_seconds"), "decision", F.coalesce(F.try_element_at("reject_reasons", F.lit("duplicate_text")), F.lit(0)).alias("duplicate_text"))


@query(
    "audit_violations",
    f"""WITH {_BASE}, s AS (SELECT doc_id, fid AS own, CASE WHEN doc_id % 13 = 0 THEN 'wrong' || doc_id ELSE fid END AS fid, CASE WHEN doc_id % 7 <> 0 THEN CASE WHEN doc_id % 11 = 0 THEN 'zz' ELSE sha END END AS file_sha, CASE WHEN doc_id % 5 <> 0 THEN sha ELSE '' END AS sha, nt, {split_sql('fid')} AS split FROM ided),
k AS (SELECT fid, split, list_position(['train', 'validation', 'test'], split) AS rk, unnest([{{'kind': 'audio_leak', 'key': sha}}, {{'kind': 'text_leak', 'key': nt}}]) AS x FROM s),
o AS (SELECT x.kind AS kind, x.key AS key, min(rk) AS own FROM k WHERE x.key <> '' GROUP BY ALL)
SELECT kind, split, count(*) AS n FROM (SELECT 'missing_audio' AS kind, split FROM s WHERE file_sha IS NULL UNION ALL SELECT 'fid_mismatch', split FROM s WHERE file_sha IS NOT NULL AND sha <> '' AND fid <> own
UNION ALL SELECT 'sha_mismatch', split FROM s WHERE file_sha IS NOT NULL AND sha <> '' AND file_sha <> sha UNION ALL SELECT k.x.kind, split FROM k JOIN o ON k.x.kind = o.kind AND k.x.key = o.key WHERE rk > own) GROUP BY ALL""",
)
def audit_violations(spark, sf):
    k = F.col("_ord")
    rows = _index(spark, sf).withColumn("own", tx.text_fid(F.col("text"), F.col("audio_sha256"))).withColumn("split", tx.split_bucket(F.col("own")))
    rows = rows.withColumn("fid", F.when(k % 13 == 0, F.concat(F.lit("wrong"), k)).otherwise(F.col("own")))
    rows = rows.withColumn("file_sha256", F.when(k % 7 != 0, F.when(k % 11 == 0, "zz").otherwise(F.col("audio_sha256")))).withColumn("audio_sha256", F.when(k % 5 != 0, F.col("audio_sha256")).otherwise(""))
    return curate.audit(rows).groupBy("kind", "split").agg(F.count("*").alias("n"))


@query(
    "freeze_manifest",
    f"""WITH {_BASE}, f AS (SELECT nt, min(doc_id) AS first_id FROM ided WHERE nt <> '' GROUP BY nt), a AS (SELECT i.*, {split_sql('fid')} AS split FROM ided i JOIN f ON i.doc_id = f.first_id)
SELECT count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'validation') AS validation, count(*) FILTER (WHERE split = 'test') AS test, (SELECT count(*) FROM documents) - count(*) AS dropped, count(*) FILTER (WHERE lang = 'en') AS en, count(*) AS filename FROM a""",
)
def freeze_manifest(spark, sf):
    m = curate.freeze_manifest(curate.freeze(spark, _index(spark, sf)))
    at = lambda c, k: F.coalesce(F.try_element_at(c, F.lit(k)), F.lit(0))
    return m.select("train", "validation", "test", "dropped", at("labels", "en").alias("en"), at("text_sources", "filename").alias("filename"))


@query(
    "blocklist_union",
    f"""WITH a AS (SELECT item_id, sha256(text) AS sha, text, 'f' || item_id % 10 AS fid FROM benchmark UNION ALL SELECT r_regionkey, upper(sha256(r_name)), r_name, NULL FROM region)
SELECT (SELECT sha256(string_agg(s, ',' ORDER BY s)) FROM (SELECT DISTINCT lower(sha) AS s FROM a)) AS shas, (SELECT sha256(string_agg(t, ',' ORDER BY t)) FROM (SELECT DISTINCT {norm_sql('text')} AS t FROM a WHERE coalesce(text, '') <> '')) AS texts,
  (SELECT string_agg(f, ',' ORDER BY f) FROM (SELECT DISTINCT fid AS f FROM a WHERE fid IS NOT NULL)) AS fids, (SELECT count(*) FROM a) AS n_entries""",
)
def blocklist_union(spark, sf):
    b = table(spark, sf, "benchmark").select(F.lit("eval").alias("label"), F.sha2("text", 256).alias("sha"), "text", F.concat(F.lit("f"), F.col("item_id") % 10).alias("fid"))
    r = table(spark, sf, "region").select(F.lit("anchor").alias("label"), F.upper(F.sha2("r_name", 256)).alias("sha"), F.col("r_name").alias("text"), F.lit(None).cast("string").alias("fid"))
    one = curate.build_blocklist([b, r])
    digest = lambda c: F.sha2(F.array_join(c, ","), 256)
    return one.select(digest("audio_sha256").alias("shas"), digest("norm_texts").alias("texts"), F.array_join("fids", ",").alias("fids"), "n_entries")


@query("leak_fuzzy")
def leak_fuzzy(spark, sf):
    """Conversation turns, and benchmark texts with a changed middle, against the benchmark."""
    c = table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("key"), tx.norm_text(F.col("text")).alias("norm"))
    b = table(spark, sf, "benchmark").select("item_id", tx.norm_text(F.col("text")).alias("norm"))
    half = F.floor(F.length("norm") / 2).cast("int")
    near = b.select(F.concat(F.lit("near/"), "item_id").alias("key"), F.concat(F.substr("norm", F.lit(3), half), F.lit("Q#"), F.substr("norm", half + 5)).alias("norm"))
    return curate.similar_to_blocklist(c.unionByName(near), b.select("norm"))


_GREEDY = """WITH e AS (SELECT event_id, user_id, floor(value * 100)::BIGINT AS cents FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
f AS (SELECT list_reduce(list_prepend({'u': []::BIGINT[], 'c': []::BIGINT[], 'i': []::BIGINT[]}, list({'u': [user_id], 'c': [cents], 'i': [event_id]} ORDER BY event_id)),
  lambda acc, x: CASE WHEN list_contains(acc.u, x.u[1]) OR list_contains(acc.c, x.c[1]) THEN acc ELSE {'u': acc.u || x.u, 'c': acc.c || x.c, 'i': acc.i || x.i} END) AS a FROM e)
SELECT user_id, cents, event_id FROM e WHERE event_id IN (SELECT unnest(a.i) FROM f)"""


@query("dedup_two_key_greedy", _GREEDY)
def dedup_two_key_greedy(spark, sf):
    """Events by (user, value in hundredths), accepted one after another."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.floor(F.col("value") * 100).alias("cents"))
    return curate.greedy_two_key(spark, e.where("user_id is not null and cents is not null"), "user_id", "cents", "event_id")


@query(
    "dedup_chains",
    """WITH e AS (SELECT event_id, sum(CASE WHEN user_id % 31 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS chain FROM events WHERE event_id IS NOT NULL),
r AS (SELECT event_id, chain, row_number() OVER (PARTITION BY chain ORDER BY event_id) - 1 AS i FROM e)
SELECT event_id, chain::BIGINT AS chain, i::BIGINT AS place FROM r WHERE i % 2 = 0""",
)
def dedup_chains(spark, sf):
    """Chains of rows that share a key with the next, by turns the first and the second: every other row
    of a chain is accepted, however long it is."""
    e = table(spark, sf, "events").where("event_id is not null").select("event_id", F.when(F.col("user_id") % 31 == 0, 1).otherwise(0).cast("long").alias("starts"))
    chained = ordering.running_total(spark, e, ["event_id"], "starts", "before").withColumn("chain", F.col("before") + F.col("starts"))
    ranked = chained.select("event_id", "chain", F.lit(1).cast("long").alias("one"))
    ranked = ordering.running_total(spark, ranked, ["event_id"], "one", "at")
    first = ranked.groupBy("chain").agg(F.min("at").alias("first"))
    placed = materialize(spark, ranked.join(first, "chain").select("event_id", "chain", (F.col("at") - F.col("first")).alias("place")), "chains")
    key = lambda p: F.concat_ws("/", "chain", p)
    rows = placed.select("event_id", key(F.expr("(place + 1) div 2")).alias("a"), key(F.expr("place div 2")).alias("b"))
    kept = curate.greedy_two_key(spark, rows, "a", "b", "event_id").select("event_id")
    return placed.join(kept, "event_id")


@query(
    "cer_unicode",
    f"""WITH t AS (SELECT conv_id, turn, {_PAIR_TEXT.format('text')} AS y FROM conversations), u AS (SELECT conv_id, turn, regexp_replace(y, '[\\s\\p{{Z}}\\x1c-\\x1f\\x{{85}}' || '，。！？、；：「」『』（）…—,.!?;:"''' || ']', '', 'g') AS x FROM t),
p AS (SELECT a.conv_id, a.turn, a.x AS r, b.x AS h, array_to_string(list_sort(list_distinct(string_split(a.x || b.x, ''))), '') AS own FROM u a JOIN u b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
m AS (SELECT conv_id, turn, r, h, levenshtein(translate(r, own, codes), translate(h, own, codes)) AS d FROM (SELECT *, array_to_string(list_transform(range(1, length(own) + 1), lambda i: chr(i::INTEGER)), '') AS codes FROM p))
SELECT conv_id, turn, CASE WHEN r = '' AND h = '' THEN 0.0 WHEN r = '' THEN 1.0 ELSE d / length(r) END AS cer, (CASE WHEN r = '' THEN 0 ELSE d END)::INTEGER AS distance, (CASE WHEN r = '' THEN length(h) ELSE length(r) END)::INTEGER AS n FROM m""",
)
def cer_unicode(spark, sf):
    """Each turn as the reference, the next one as what was recognised. The oracle's distance counts bytes,
    so each pair's own characters are given one-byte codes first."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", tx.asr_norm(F.col("text")).alias("x"))
    h = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("h"))
    return t.join(h, ["conv_id", "turn"]).withColumn("c", tx.cer(F.col("x"), F.col("h"))).select("conv_id", "turn", "c.*")


# ---------------------------------------------------------------- signals


@query(
    "sanity_status",
    """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 5) * 4) AS x FROM embeddings), m AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) AS r FROM s)
SELECT vec_id, CASE WHEN r < 1e-5 THEN 'silent' ELSE 'ok' END AS status, round(r, 9) AS rms, len(list_filter(x, lambda v: abs(v) >= 0.999)) / len(x) AS clip_ratio, len(list_filter(x, lambda v: abs(v) < 1e-3)) / len(x) AS silence_ratio FROM m""",
)
def sanity_status(spark, sf):
    e = table(spark, sf, "embeddings")
    s = e.select("vec_id", sg.sanity(F.transform("embedding", lambda v: v.cast("double") * (F.col("vec_id") % 5) * 4), F.lit(64)).alias("s"))
    return s.select("vec_id", "s.status", F.round("s.rms", 9).alias("rms"), "s.clip_ratio", "s.silence_ratio")


_FADED = """w AS (SELECT vec_id, list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * CASE WHEN i <= 6 OR i > 54 THEN 1e-4 ELSE 1 END) AS x FROM embeddings),
l AS (SELECT vec_id, x, list_filter(range(0, 32), lambda f: 20 * log10(greatest(sqrt((x[2 * f + 1] * x[2 * f + 1] + x[2 * f + 2] * x[2 * f + 2]) / 2), 1e-9)) > -45) AS loud FROM w),
t AS (SELECT vec_id, CASE WHEN len(loud) = 0 THEN x ELSE x[greatest(2 * loud[1] - 2, 0) + 1 : least(2 * loud[-1] + 4, 64)] END AS x FROM l),
f AS (SELECT vec_id, list_transform(range(1, len(x) + 1), lambda i: x[i] * CASE WHEN i <= 4 THEN pow(sin(pi() / 2 * (i - 1) / 3), 2) ELSE 1 END * CASE WHEN i > len(x) - 4 THEN pow(sin(pi() / 2 * (len(x) - i) / 3), 2) ELSE 1 END) AS x FROM t),
g AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) AS r, list_max(list_transform(x, lambda v: abs(v))) AS p FROM f)"""


@query("trim_and_level", f"WITH {_FADED} SELECT vec_id, len(x)::INTEGER AS n, round(p * least(pow(10, (-25 - 20 * log10(r)) / 20), 0.98 / p), 6) AS peak, round(r * least(pow(10, (-25 - 20 * log10(r)) / 20), 0.98 / p), 6) AS rms FROM g")
def trim_and_level(spark, sf):
    """Signals with quiet ends, trimmed, faded and levelled."""
    quiet = F.transform("embedding", lambda v, i: v.cast("double") * F.when((i < 6) | (i >= 54), 1e-4).otherwise(1.0))
    t = sg.normalize_loudness(sg.fade_edges(sg.trim_silence(quiet, F.lit(1000), pad_ms=2, win_ms=2), F.lit(1000), 4))
    e = table(spark, sf, "embeddings").select("vec_id", t.alias("t"))
    return e.select("vec_id", F.size("t").alias("n"), F.round(sg.peak(F.col("t")), 6).alias("peak"), F.round(sg.rms(F.col("t")), 6).alias("rms"))


@query("energy_delta", "SELECT vec_id, round(list_sum(list_transform(range(1, 64), lambda i: abs(log10(e[i + 1] + 1e-12) - log10(e[i] + 1e-12)))) / 63, 9) AS delta FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE) AS e FROM embeddings)")
def energy_delta(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * v.cast("double")).alias("e"))
    return e.select("vec_id", F.round(sg.energy_delta(F.col("e")), 9).alias("delta"))


_DFT = """s AS (SELECT user_id, list_transform(list(value ORDER BY event_id), lambda v: v / 100 - 0.25) AS x FROM events GROUP BY user_id),
n AS (SELECT user_id, x, least(len(x), 2048) AS n, CASE WHEN len(x) > 2048 THEN 1 + (len(x) - 2048) // 512 ELSE 1 END AS frames FROM s),
fr AS (SELECT user_id, n, frames, f, list_transform(range(0, n), lambda i: (0.5 - 0.5 * cos(2 * pi() * i / n)) * x[f * 512 + i + 1]) AS y, sqrt(list_sum(list_transform(x[f * 512 + 1 : f * 512 + n], lambda v: v * v))) AS r FROM (SELECT *, unnest(range(0, frames)) AS f FROM n)),
b AS (SELECT user_id, n, frames, f, y, r, unnest(range(0, n // 2 + 1)) AS k FROM fr),
m AS (SELECT user_id, n, frames, f, r, k, k * 24000.0 / n AS hz, sqrt(pow(list_sum(list_transform(range(0, n), lambda i: y[i + 1] * cos(2 * pi() * k * i / n))), 2) + pow(list_sum(list_transform(range(0, n), lambda i: y[i + 1] * sin(2 * pi() * k * i / n))), 2)) / (n / 2.0) AS m FROM b)"""


@query("band_energy", f"WITH {_DFT} SELECT user_id, CASE WHEN any_value(n) < 64 THEN 0.0 ELSE round(coalesce(sum(m * m) FILTER (WHERE hz >= 4000 AND hz < 8000), 0) / greatest(sum(m * m), 1e-12), 6) END AS band_energy_4k_8k, CASE WHEN any_value(n) < 64 THEN 0.0 ELSE round(coalesce(sum(m * m) FILTER (WHERE hz >= 8000 AND hz < 12000), 0) / greatest(sum(m * m), 1e-12), 6) END AS band_energy_8k_12k FROM m GROUP BY user_id")
def band_energy(spark, sf):
    s = _long_signals(spark, sf).select("user_id", dsp.analyze_signal("x", F.lit(24000)).alias("a"))
    return s.select("user_id", F.round("a.band_energy_4k_8k", 6).alias("band_energy_4k_8k"), F.round("a.band_energy_8k_12k", 6).alias("band_energy_8k_12k"))


@query(
    "spectral_stats",
    f"""WITH {_DFT}, q AS (SELECT user_id, f, any_value(n) AS n, any_value(r) AS r, any_value(frames) AS frames, exp(avg(ln(m + 1e-12))) / avg(m + 1e-12) AS flat, max(m + 1e-12) / avg(m + 1e-12) AS crest, list(m + 1e-12) AS ms FROM m GROUP BY user_id, f),
z AS (SELECT *, -list_sum(list_transform(ms, lambda v: v / list_sum(ms) * log2(v / list_sum(ms)))) / log2(len(ms)) AS ent, max(r) OVER (PARTITION BY user_id) AS top FROM q),
d AS (SELECT user_id, len(x) / 24000.0 AS duration, 20 * log10(greatest(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 1e-12)) AS db FROM s)
SELECT d.user_id AS user_id, round(any_value(duration), 9) AS duration, round(any_value(db), 6) AS rms_dbfs, round(avg(flat), 6) AS spectral_flatness, round(avg(crest), 5) AS spectral_crest, round(avg(ent), 6) AS spectral_entropy FROM d JOIN z ON d.user_id = z.user_id WHERE r >= top * 0.01 GROUP BY d.user_id""",
)
def spectral_stats(spark, sf):
    a = _long_signals(spark, sf).select("user_id", dsp.analyze_signal("x", F.lit(24000)).alias("a")).select("user_id", "a.*")
    return a.select("user_id", F.round("duration", 9).alias("duration"), F.round("rms_dbfs", 6).alias("rms_dbfs"), F.round("spectral_flatness", 6).alias("spectral_flatness"), F.round("spectral_crest", 5).alias("spectral_crest"), F.round("spectral_entropy", 6).alias("spectral_entropy"))


@query(
    "xcorr_lag",
    """SELECT user_id, (user_id % 7)::INTEGER AS lag, 1.0::DOUBLE AS xcorr, CASE WHEN count(*) >= 256 THEN 1.0 + user_id % 3 END AS gain, CASE WHEN count(*) >= 256 THEN 0.0::DOUBLE END AS nmse,
  CASE WHEN count(*) >= 256 THEN 3 ELSE 0 END::INTEGER AS bands, CASE WHEN count(*) >= 256 THEN round(10 * log10(1.0 + user_id % 3), 2) END AS quieter_db FROM events GROUP BY user_id""",
)
def xcorr_lag(spark, sf):
    """Every signal against itself, delayed and made quieter by its user."""
    u = F.col("user_id")
    s = _long_signals(spark, sf).withColumn("y", F.concat(F.array_repeat(F.lit(0.0), (u % 7).cast("int")), F.transform("x", lambda v: v / (1 + u % 3))))
    c = s.select("user_id", dsp.compare_signals("x", "y", F.lit(24000)).alias("c"))
    quieter = F.round(F.abs(F.get(F.col("c.bands"), F.lit(0))["mean_diff_db"]), 2)
    return c.select("user_id", "c.lag", F.round("c.xcorr", 6).alias("xcorr"), F.round("c.gain", 6).alias("gain"), F.round(F.abs("c.nmse"), 6).alias("nmse"), F.size("c.bands").alias("bands"), quieter.alias("quieter_db"))


@query("codec_chain", "SELECT vec_id::VARCHAR AS case_id, (vec_id % 4)::INTEGER AS lag_in, 2.0 + vec_id % 3 AS gain_in, -(vec_id % 4)::INTEGER AS lag_out, round(1 / (2.0 + vec_id % 3), 6) AS gain_out, 0.0::DOUBLE AS nmse FROM embeddings")
def codec_chain(spark, sf):
    """A signal, itself later and quieter by its id, and as it was again: lags, gains and errors along the chain."""
    k = F.col("vec_id")
    e = table(spark, sf, "embeddings").select("vec_id", k.cast("string").alias("case_id"), F.lit(8000).alias("sr"), F.flatten(F.array_repeat(vx.doubles(F.col("embedding")), 5)).alias("x"))
    e = e.withColumn("x", F.transform("x", lambda v, i: v * F.exp(-i / 200)))  # fading, so that one lag is best
    quiet = e.withColumn("x", F.concat(F.array_repeat(F.lit(0.0), (k % 4).cast("int")), F.transform("x", lambda v: v / (2 + k % 3))))
    c = reports.codec_chain(e, quiet, e)
    a, b, whole = "original_vs_input", "input_vs_roundtrip", "original_vs_roundtrip"
    return c.select("case_id", F.col(f"{a}.lag").alias("lag_in"), F.round(f"{a}.gain", 6).alias("gain_in"), F.col(f"{b}.lag").alias("lag_out"), F.round(f"{b}.gain", 6).alias("gain_out"), F.round(F.abs(f"{whole}.nmse"), 6).alias("nmse"))


@query("highpass_level", "SELECT vec_id, (label % 5 + 1) / 5.0 AS peak, 800 AS n FROM embeddings")
def highpass_level(spark, sf):
    """A tone above the cut-off on a steady level below it: the tone stays, the level goes."""
    k = F.col("label")
    tone = F.transform(F.sequence(F.lit(0), F.lit(799)), lambda i: k / 10 + (k % 5 + 1) / 5 * F.cos(i * 2 * 3.141592653589793 / 8))
    y = table(spark, sf, "embeddings").select("vec_id", dsp.highpass_signal(tone, F.lit(8000)).alias("y"))
    return y.select("vec_id", F.round(sg.peak(F.slice("y", 301, 200)), 1).alias("peak"), F.size("y").alias("n"))


_CUT = "s AS (SELECT vec_id, label AS k, embedding FROM embeddings), g AS (SELECT vec_id, k, embedding, CASE WHEN k > 3 THEN 300 ELSE k * 100 END AS gap FROM s)"


@query("cut_segments", f"WITH {_CUT} SELECT vec_id, 3 AS segments_in, 2 AS segments_kept, 400 + gap AS n, false AS all_dropped, round(embedding[200 % 64 + 1]::DOUBLE, 6) AS early, round(embedding[(400 + k * 100) % 64 + 1]::DOUBLE, 6) AS late FROM g")
def cut_segments(spark, sf):
    """Two segments of 200 ms with a gap that depends on the row, and one that is too short, at 1 kHz."""
    k = F.col("label")
    at = lambda a, b: F.array(F.lit(a).cast("int") if isinstance(a, int) else a, F.lit(b).cast("int") if isinstance(b, int) else b)
    segments = F.array(at(100, 300), at(300 + k * 100, 500 + k * 100), at(1900, 1950))
    e = table(spark, sf, "embeddings").select("vec_id", F.flatten(F.array_repeat(vx.doubles(F.col("embedding")), 32)).alias("x"), segments.alias("s"))
    c = e.select("vec_id", dsp.cut_signal("x", F.lit(1000), "s").alias("c"))
    return c.select("vec_id", "c.segments_in", "c.segments_kept", F.size("c.x").alias("n"), "c.all_dropped", F.round(F.get("c.x", F.lit(100)), 6).alias("early"), F.round(F.get("c.x", F.size("c.x") - 100), 6).alias("late"))


@query("preprocess_level", "SELECT vec_id, 2048 AS n, -25.0::DOUBLE AS rms_dbfs, 400 AS n_cut FROM embeddings")
def preprocess_level(spark, sf):
    """The whole chain, with trimming and with cutting: lengths, and the level it ends at."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(2047)), lambda i: F.sin(i * (F.col("label") + 3) * 0.1) * 0.2).alias("x"))
    segments = F.array(F.array(F.lit(100), F.lit(300)), F.array(F.lit(300), F.lit(500)))
    y = e.select("vec_id", sg.preprocess(F.col("x"), F.lit(1000)).alias("y"), sg.preprocess(F.col("x"), F.lit(1000), segments).alias("z"))
    return y.select("vec_id", F.size("y").alias("n"), F.round(sg.db(sg.rms(F.col("y"))), 6).alias("rms_dbfs"), F.size("z").alias("n_cut"))


# ---------------------------------------------------------------- experiments and audits


@query("pair_sides", "SELECT a.n_nationkey || '__' || b.n_nationkey AS pair_id, a.n_name || coalesce('|' || CASE WHEN b.n_regionkey <> 0 THEN b.n_name END, '') AS sides FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 WHERE a.n_regionkey <> 0 UNION ALL SELECT a.n_nationkey || '__' || b.n_nationkey, CASE WHEN b.n_regionkey <> 0 THEN b.n_name END FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 WHERE a.n_regionkey = 0")
def pair_sides(spark, sf):
    """Two-way lookups; cells whose case is missing are left out."""
    n = table(spark, sf, "nation")
    nxt = n.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_nationkey").alias("other"))
    pairs = n.join(nxt, "n_nationkey").select(F.concat_ws("__", "n_nationkey", "other").alias("pair_id"), F.array("n_nationkey", "other").alias("cells"))
    cases = n.where("n_regionkey <> 0").select(F.col("n_nationkey").alias("case_id"), "n_name")
    return experiments.pair_sides(pairs, cases).select("pair_id", F.array_join(F.transform("sides", lambda s: s["n_name"]), "|").alias("sides"))


@query("pack_pairs", "SELECT 'P' || s_nationkey AS pack_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos, 's' || s_suppkey AS pair_id FROM supplier QUALIFY s_suppkey % 4 <> 1")
def pack_pairs(spark, sf):
    """Pairs of packs in order; unknown ids are skipped but keep their place."""
    s = table(spark, sf, "supplier").select(F.concat(F.lit("P"), "s_nationkey").alias("pack_id"), "s_suppkey", F.concat(F.lit("s"), "s_suppkey").alias("pair_id"))
    packs = s.groupBy("pack_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "pair_id"))), lambda x: x["pair_id"]).alias("pairs"))
    return experiments.pack_pairs(packs, s.where("s_suppkey % 4 <> 1").select("pair_id")).select("pack_id", F.col("pos").cast("long").alias("pos"), "pair_id")


@query("status_counts", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS ok, count(*) AS total, false AS all_ok FROM orders")
def status_counts(spark, sf):
    return experiments.status_counts(table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "ok").otherwise("error").alias("status")))


@query("parameter_summary", "SELECT p_partkey, 'size=' || p_size || ', type=' || p_type || CASE WHEN p_partkey % 2 = 0 THEN ', brand=' || p_brand ELSE '' END AS params FROM part")
def parameter_summary(spark, sf):
    item = lambda k, c: F.concat(F.lit(f"{k}="), c)
    brand = F.when(F.col("p_partkey") % 2 == 0, item("brand", "p_brand"))
    return table(spark, sf, "part").select("p_partkey", experiments.parameter_summary(F.array(item("size", "p_size"), item("type", "p_type"), item("size", "p_size"), brand, F.lit(""))).alias("params"))


@query("hash_gate", "SELECT s_suppkey, sha256(s_name) AS actual FROM supplier")
def hash_gate(spark, sf):
    """All hashes are as expected, in either letter case, so all rows pass the gate."""
    h = F.sha2("s_name", 256)
    s = table(spark, sf, "supplier").select("s_suppkey", h.alias("actual"), F.when(F.col("s_suppkey") % 2 == 0, F.upper(h)).otherwise(h).alias("expected"))
    return experiments.require_sha(s, "actual", "expected", "s_suppkey").select("s_suppkey", "actual")


_STEPS = "v AS (SELECT l_linenumber AS step, l_partkey % 200 AS key, sum(l_quantity) AS value FROM lineitem GROUP BY ALL), st AS (SELECT step, lead(step) OVER (ORDER BY step) AS nxt FROM (SELECT DISTINCT step FROM v))"


@query("checkpoint_transitions", f"WITH {_STEPS}, a AS (SELECT st.step, st.nxt, key, value AS x, NULL AS y FROM v JOIN st USING (step) WHERE nxt IS NOT NULL UNION ALL SELECT st.step, st.nxt, key, NULL, value FROM v JOIN st ON st.nxt = v.step), b AS (SELECT step, nxt, key, max(x) AS x, max(y) AS y FROM a GROUP BY ALL) SELECT step || '->' || nxt AS transition, key, round(CASE WHEN x <> 0 THEN abs(y - x) / abs(x) END, 9) AS rel_l2, x = y AS identical FROM b")
def checkpoint_transitions(spark, sf):
    v = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("step"), (F.col("l_partkey") % 200).alias("key")).agg(F.sum("l_quantity").alias("value"))
    return verdicts.transitions(v).withColumn("rel_l2", F.round("rel_l2", 9))


@query("config_identical", "SELECT count(DISTINCT p_partkey % 2) <= 2 AS same, count(DISTINCT p_type) = 1 AS mixed FROM part")
def config_identical(spark, sf):
    """The same settings in another order of keys are one configuration."""
    p = table(spark, sf, "part")
    a, b = (F.lit("r"), F.lit("16")), (F.lit("alpha"), F.lit("32"))
    c = F.when(F.col("p_partkey") % 2 == 0, F.create_map(*a, *b)).otherwise(F.create_map(*b, *a))
    same = verdicts.config_identical(p.select(c.alias("c")), "c").select(F.col("identical").alias("same"))
    return same.join(verdicts.config_identical(p.select(F.create_map(F.lit("r"), "p_type").alias("c")), "c").select(F.col("identical").alias("mixed")))


@query("asset_check", "SELECT s_nationkey::VARCHAR AS name, s_name AS asset, s_suppkey % 6 NOT IN (0, 1) AS ok FROM supplier")
def asset_check(spark, sf):
    """Hashes of a contract against those of the files; some files are gone, some have changed."""
    s = table(spark, sf, "supplier")
    contract = s.groupBy(F.col("s_nationkey").cast("string").alias("name")).agg(F.map_from_entries(F.collect_list(F.struct("s_name", F.upper(F.sha2("s_name", 256))))).alias("asset_hashes"))
    files = s.where("s_suppkey % 6 <> 0").select(F.col("s_name").alias("path"), F.when(F.col("s_suppkey") % 6 == 1, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("s_name", 256)).alias("sha256"))
    return ratings.verify_assets(contract, files).select("name", "asset", "ok")


# ---------------------------------------------------------------- ratings


@query("rating_presence", "SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN turn % 2 = 0 ELSE length(text) % 3 = 0 END AS rated FROM conversations WHERE text IS NOT NULL")
def rating_presence(spark, sf):
    c = table(spark, sf, "conversations").where("text is not null")
    r = F.struct(F.when(F.col("turn") % 2 == 0, "left").otherwise("").alias("choice"), *(F.when((F.length("text") % 3 == 0) & F.lit(f == "notes"), " n ").otherwise(F.lit(" ")).alias(f) for f in ratings.FIELDS))
    return c.select("conv_id", "turn", ratings.rated(r, F.when(F.col("turn") % 5 == 0, "pairs").otherwise("samples")).alias("rated"))


@query("score_cells", f"WITH {_CELLS} SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '-' ELSE 'c/g/l/n ' || CASE WHEN trim(clarity) = '' THEN '-' ELSE clarity END || '/' || grit || '/' || likeness || '/-' END AS cell, CASE turn % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE '?' END AS complete FROM cells")
def score_cells(spark, sf):
    c, blank = _cells(spark, sf), F.col("turn") % 4 == 3
    dims = [F.when(blank, " ").otherwise(F.col(d)) for d in ratings.DIMENSIONS]
    return c.select("conv_id", "turn", ratings.score_cell(*dims).alias("cell"), reports.yes_no(F.when(F.col("turn") % 3 == 0, True).when(F.col("turn") % 3 == 1, False)).alias("complete"))


@query("truth_check", "SELECT count(*) FILTER (WHERE o_orderkey % 10 = 0) AS unknown, count(*) FILTER (WHERE o_orderkey % 10 <> 0 AND o_orderkey % 7 = 0) AS sha_mismatch, count(*) FILTER (WHERE o_orderkey % 10 <> 0 AND o_orderstatus = 'P') AS condition_mismatch, false AS ok FROM orders")
def truth_check(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    truth = o.select(k.alias("case_id"), F.when(k % 7 == 0, "x").otherwise(F.sha2(k.cast("string"), 256)).alias("output_sha256"), F.col("o_orderstatus").alias("condition"))
    cases = o.where("o_orderkey % 10 <> 0").select(k.alias("case_id"), F.sha2(k.cast("string"), 256).alias("output_sha256"), F.when(F.col("o_orderstatus") == "P", "other").otherwise(F.col("o_orderstatus")).alias("condition"))
    return ratings.check_truth(truth, cases)


@query("legacy_verified", "SELECT s_suppkey AS review_id FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0")
def legacy_verified(spark, sf):
    """Old ratings count where id, blind order and hashes are all as the contract has them."""
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    rows = s.select(k.alias("review_id"), F.array(F.lit("A"), F.lit("B")).alias("order"), F.array(F.sha2("s_name", 256)).alias("hashes"))
    contract = rows.where("review_id % 2 = 0").withColumn("order", F.when(F.col("review_id") % 3 == 0, F.reverse("order")).otherwise(F.col("order"))).withColumn("hashes", F.when(F.col("review_id") % 5 == 0, F.array(F.lit("x"))).otherwise(F.col("hashes")))
    return ratings.verified_legacy(rows, contract).select("review_id")


@query("rating_progress", "SELECT (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 3 = 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)) AS verified, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0)) AS pending, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 3 = 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)) AS unknown")
def rating_progress(spark, sf):
    wanted = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    return ratings.progress(wanted, table(spark, sf, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("id")), "id")


_FOLD = """WITH e AS (SELECT user_id::VARCHAR AS name, list({'rev': substr(sha256(user_id || '|' || event_id), 1, 16), 'want': CASE WHEN event_id % 3 = 0 THEN 'stale' END, 'payload': event_type, 'a': 1, 'r': 0} ORDER BY event_id) AS log FROM events GROUP BY user_id),
f AS (SELECT name, list_reduce(list_prepend({'rev': NULL::VARCHAR, 'want': NULL::VARCHAR, 'payload': NULL::VARCHAR, 'a': 0, 'r': 0}, log), lambda acc, x: CASE WHEN x.want IS NOT NULL AND x.want IS DISTINCT FROM acc.rev THEN {'rev': acc.rev, 'want': x.want, 'payload': acc.payload, 'a': acc.a, 'r': acc.r + 1} ELSE {'rev': x.rev, 'want': x.want, 'payload': x.payload, 'a': acc.a + 1, 'r': acc.r} END) AS s FROM e)
SELECT name, s.rev AS revision, s.payload AS payload, s.a AS accepted, s.r AS rejected FROM f"""


@query("rating_cas_fold", _FOLD)
def rating_cas_fold(spark, sf):
    """Events of a user as writes to one snapshot; every third expects a revision that can't be current."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("_ord"), F.col("user_id").cast("string").alias("name"), F.when(F.col("event_id") % 3 == 0, "stale").alias("expected_revision"), F.col("event_type").alias("payload"))
    return ratings.fold_snapshots(e)


@query("blind_order", "SELECT s_suppkey, array_to_string(list_transform(list_sort(list_transform(['a', 'b', 'c'], lambda c: sha256('20261008|' || s_name || '|' || c) || c)), lambda h: right(h, 1)), ',') AS cells FROM supplier")
def blind_order(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(ratings.blind_order(F.col("s_name"), F.array(*map(F.lit, "abc"))), ",").alias("cells"))


@query("seeded_order", "SELECT s_suppkey, 3 AS n, 'a,b,c' AS cells FROM supplier")
def seeded_order(spark, sf):
    """The published shuffle keeps every cell; the tests hold its order against the generator."""
    s = table(spark, sf, "supplier").select("s_suppkey", ratings.seeded_shuffle(F.concat(F.lit("20261008:"), "s_name"), F.array(*map(F.lit, "abc"))).alias("c"))
    return s.select("s_suppkey", F.size("c").alias("n"), F.array_join(F.array_sort("c"), ",").alias("cells"))


# ---------------------------------------------------------------- reports


@query("first_anchor", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS audio FROM customer")
def first_anchor(spark, sf):
    k = F.col("c_custkey")
    anchor = lambda a: F.struct(a.alias("audio"), F.lit("t").alias("text"))
    anchors = F.array(anchor(F.when(k % 3 == 0, F.col("c_name")).otherwise("")), anchor(F.when(k % 3 < 2, F.col("c_mktsegment"))))
    return table(spark, sf, "customer").select("c_custkey", reports.anchor_audio(anchors)["audio"].alias("audio"))


_PATHS = "['a/../b', '../x', '/abs', 'C:\\x', 'a/b/../../..', 'a\\b.wav', 'a//b', '..\\..\\x']"


@query("safe_paths", f"SELECT page_id, page_id % 8 IN (0, 5, 6) AS safe FROM (SELECT page_id, {_PATHS}[1 + page_id % 8] AS p FROM pages)")
def safe_paths(spark, sf):
    paths = F.array(*map(F.lit, ("a/../b", "../x", "/abs", "C:\\x", "a/b/../../..", "a\\b.wav", "a//b", "..\\..\\x")))
    return table(spark, sf, "pages").select("page_id", sinks.safe_relative(F.get(paths, (F.col("page_id") % 8).cast("int"))).alias("safe"))


@query("codec_hashes", "SELECT 'codec/' || n_name || ':' || tag AS path, sha256(n_name || tag) AS sha256 FROM nation, (SELECT unnest(['in', 'out']) AS tag)")
def codec_hashes(spark, sf):
    n = table(spark, sf, "nation")
    tags = F.map_from_arrays(F.array(F.lit("in"), F.lit("out")), F.array(*(F.sha2(F.concat("n_name", F.lit(t)), 256) for t in ("in", "out"))))
    return reports.codec_hashes(n.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", tags.alias("t")))).alias("codec")))


@query("originals_first", "SELECT page_id, row_number() OVER (ORDER BY length(u) - length(replace(u, '/', '')) > 0, u, page_id) AS place FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'p' || page_id || '.wav' ELSE 'd' || page_id % 7 || '/p' || page_id || '.wav' END AS u FROM pages)")
def originals_first(spark, sf):
    p, k = table(spark, sf, "pages"), F.col("page_id")
    u = p.select("page_id", F.when(k % 3 == 0, F.concat(F.lit("p"), k, F.lit(".wav"))).otherwise(F.concat(F.lit("d"), k % 7, F.lit("/p"), k, F.lit(".wav"))).alias("u"))
    return _placed(reports.originals_first(u, "u"), "page_id")


@query("rated_order", "SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, event_id) AS place FROM events")
def rated_order(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_id").alias("_ord"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("rated_at"))
    return _placed(reports.rated_order(e), "event_id")


def _placed(rows: DataFrame, key: str) -> DataFrame:
    """The place of each row in an ordered result: its rank in its partition after those before it. Ranges are
    sampled anew whenever a plan is run, so rows are dealt once and written with their partition."""
    at = materialize(rows.sparkSession, rows.select(key, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")), "placed")
    sizes = at.groupBy("p").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    before = sizes.alias("a").join(sizes.select(F.col("p").alias("q"), F.col("n").alias("k")), F.col("q") < F.col("p"), "left").groupBy("p", "first").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("before"))
    return at.join(before, "p").select(key, (F.col("before") + F.col("m") - F.col("first") + 1).alias("place"))


@query("html_escape", "SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped, sha256(replace(html, '<', '\\u003c')) AS script FROM pages")
def html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(reports.html_escape(F.col("html")), 256).alias("escaped"), F.sha2(reports.script_json(F.col("html")), 256).alias("script"))


@query("page_bundle", "SELECT s_nationkey, '<ul>' || string_agg('<li>' || s_name || ' &amp; co</li>', '' ORDER BY s_suppkey) || '</ul>' AS html FROM supplier GROUP BY s_nationkey")
def page_bundle(spark, sf):
    s = table(spark, sf, "supplier").withColumn("v", F.concat("s_name", F.lit(" & co")))
    return reports.html_list(s, "s_nationkey", "s_suppkey", "v")


@query(
    "gate_report",
    """SELECT 1 AS section, (s_suppkey + 4)::BIGINT AS place, '| b' || s_nationkey || ' | ' || CASE WHEN s_suppkey % 2 = 0 THEN 'clone' ELSE 'zero' END || ' | `o/' || s_suppkey || '.wav` | ' || CASE WHEN s_suppkey % 3 = 0 THEN 'failed' ELSE 'ok' END || ' | ' || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE format('{:.1f}', s_suppkey / 20.0) END || ' | ' || CASE WHEN s_suppkey % 3 = 0 THEN 'out of \\| memory' ELSE '' END || ' |' AS line FROM supplier
UNION ALL SELECT 2, p_partkey + 4, '| `' || p_partkey || '.wav` | ' || CASE WHEN p_partkey % 7 = 3 THEN 'error: ' || p_size || ' |  |  |  |  |  |  |  |  |  | ' ELSE p_size * 1000 || ' | ' || format('{:.2f}', p_retailprice::DOUBLE) || ' | ' || format('{:.2f}', -p_size / 8.0) || ' |  |  | ' || format('{:.3f}', (p_size + 0.5) / 1000) || ' |  |  |  |  | ' END || ' |' FROM part
UNION ALL SELECT 0, unnest([0, 1, 2, 3]), unnest(['# Gate report — nightly', '', '- parts: ' || (SELECT count(*) FROM part), ''])
UNION ALL SELECT 1, unnest([0, 1, 2, 3, 4611686018427387904]), unnest(['## Case results', '', '| Backend | Case | Output | Status | Wall (s) | Notes |', '|---|---|---|---|---|---|', ''])
UNION ALL SELECT 2, unnest([0, 1, 2, 3, 4611686018427387904]), unnest(['## Objective metrics', '', '| Sample | SR | dur (s) | RMS dBFS | LUFS | TP dBTP | E4-8k% | E8-12k% | flatness | crest | entropy | Δ2-9k |', '|---|---|---|---|---|---|---|---|---|---|---|---|', ''])""",
)
def gate_report(spark, sf):
    """A report of cases and measures, each line with its place; numbers as they are printed."""
    from tessella.operators import documents

    k, key, size = F.col("s_suppkey"), F.col("p_partkey"), F.col("p_size")
    failed = k % 3 == 0
    cases = table(spark, sf, "supplier").select(
        k.alias("_ord"), F.concat(F.lit("b"), "s_nationkey").alias("backend"), F.when(k % 2 == 0, "clone").otherwise("zero").alias("kind"), F.concat(F.lit("o/"), k, F.lit(".wav")).alias("output"),
        F.when(failed, "failed").otherwise("ok").alias("status"), F.when(~failed, k / 20).alias("wall_seconds"), F.when(failed, "out of | memory").alias("error"), F.lit(None).cast("string").alias("reason"),
    )
    parts = table(spark, sf, "part")
    known = {"sample_rate": size * 1000, "duration": F.col("p_retailprice").cast("double"), "rms_dbfs": -size / 8, "band_energy_4k_8k": (size + 0.5) / 1000}
    measures = parts.select(key.alias("_ord"), F.concat(key, F.lit(".wav")).alias("sample"), F.when(key % 7 == 3, size.cast("string")).alias("error"), *(known.get(c, F.lit(None)).cast("double").alias(c) for _, c, _ in documents.MEASURES))
    return documents.gate_report(spark, "nightly", [("parts", str(parts.count()))], cases, measures)


@query("loudness_tone", "SELECT n_nationkey, round(-3.01 + 20 * log10((1 + n_nationkey % 5) / 10.0), 1) AS lufs FROM nation")
def loudness_tone(spark, sf):
    """A tone of 997 Hz at full scale on one channel has -3.01 LUFS; quieter ones have as much less."""
    level = (F.col("n_nationkey") % 5 + 1) / 10
    tone = F.transform(F.sequence(F.lit(0), F.lit(23999)), lambda i: level * F.sin(i * 2 * 3.141592653589793 * 997 / 48000))
    a = table(spark, sf, "nation").repartition(4).select("n_nationkey", dsp.analyze_signal(tone, F.lit(48000)).alias("a"))
    return a.select("n_nationkey", F.round("a.lufs", 1).alias("lufs"))


@query("report_rows", "SELECT s_suppkey AS _ord, '| ' || s_name || ' | a\\|b | ' || CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey::VARCHAR ELSE '' END || ' |' AS line FROM supplier")
def report_rows(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.lit("a|b").alias("b"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("n"))
    return reports.table_rows(s, "s_suppkey")


@query("page_identity", "SELECT s_suppkey, sha256('{\"id\": \"' || s_suppkey || '\", \"title\": \"' || s_name || '\"}') AS identity FROM supplier")
def page_identity(spark, sf):
    """The order in which a payload's keys were set doesn't matter."""
    a, b = (F.lit("title"), F.col("s_name")), (F.lit("id"), F.col("s_suppkey").cast("string"))
    payload = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(*a, *b)).otherwise(F.create_map(*b, *a))
    return table(spark, sf, "supplier").select("s_suppkey", reports.page_identity(payload).alias("identity"))


@query(
    "page_identity_nested",
    """SELECT p_partkey, sha256('{"absent": null, "cells": [{"id": ' || p_partkey || ', "weight": ' || p_retailprice::VARCHAR || '}, {"id": ' || (p_partkey + 1) || ', "weight": ' || (p_size / 8)::VARCHAR || '}], "flags": {"even": ' || (p_partkey % 2 = 0)::VARCHAR || ', "large": ' || (p_size > 25)::VARCHAR || '}, "orders": {"'
  || 'a' || p_size || '": ["x", "y"], "b": []}, "title": "' || replace(p_name, ' ', '\\n') || ' \\"é\\" \\\\ ' || p_size || '"}') AS identity FROM part""",
)
def page_identity_nested(spark, sf):
    """A payload of lists, maps and structs, with numbers and with characters that JSON escapes."""
    p = table(spark, sf, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    cell = lambda id_, weight: F.struct(weight.cast("double").alias("weight"), id_.cast("long").alias("id"))
    orders = F.map_from_arrays(F.array(F.lit("b"), F.concat(F.lit("a"), size)), F.array(F.array().cast("array<string>"), F.array(F.lit("x"), F.lit("y"))))
    title = F.concat(F.replace("p_name", F.lit(" "), F.lit("\n")), F.lit(' "é" \\ '), size)
    page = p.select("p_partkey", F.struct(
        title.alias("title"), F.array(cell(key, F.col("p_retailprice")), cell(key + 1, size / 8)).alias("cells"), orders.alias("orders"),
        F.struct((size > 25).alias("large"), (key % 2 == 0).alias("even")).alias("flags"), F.lit(None).cast("string").alias("absent"),
    ).alias("page"))
    return page.select("p_partkey", reports.page_identity(F.col("page"), page.schema["page"].dataType).alias("identity"))


_GRID = "SELECT l_orderkey, l_linenumber, unnest([l_extendedprice::DOUBLE * l_discount::DOUBLE, (2 * l_linenumber + 1) / 8.0, -l_suppkey / 1000.0 - 0.0005, l_quantity::DOUBLE * 100 + 0.675, l_partkey / 64.0]) AS x, unnest(range(5)) AS k FROM lineitem"


@query(
    "binary_rounding",
    f"SELECT l_orderkey, l_linenumber, k, format('{{:.1f}}', x)::DOUBLE AS one, format('{{:.2f}}', x)::DOUBLE AS two, format('{{:.3f}}', x)::DOUBLE AS three FROM (SELECT l_orderkey, l_linenumber, k, x::DOUBLE AS x FROM ({_GRID}))",
)
def binary_rounding(spark, sf):
    """Products, exact halves and decimals that look like halves, rounded to one, two and three places."""
    d = lambda c: F.col(c).cast("double")
    values = F.array(d("l_extendedprice") * d("l_discount"), (2 * d("l_linenumber") + 1) / 8, -d("l_suppkey") / 1000 - 0.0005, d("l_quantity") * 100 + 0.675, d("l_partkey") / 64)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(values).alias("k", "x"))
    return rows.select("l_orderkey", "l_linenumber", F.col("k").cast("long").alias("k"), *(canonical.round_half_even(F.col("x"), n).alias(name) for n, name in ((1, "one"), (2, "two"), (3, "three"))))


@query("time_stamps", "SELECT r_regionkey, true AS seconds_ok, true AS ms_ok FROM region")
def time_stamps(spark, sf):
    form = lambda c, f: F.regexp_like(c, F.lit(f))
    day = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d"
    return table(spark, sf, "region").select("r_regionkey", form(reports.utc_stamp(), day + r"(Z|[+-]\d\d:\d\d)$").alias("seconds_ok"), form(reports.utc_stamp(True), day + r"\.\d{3}(Z|[+-]\d\d:\d\d)$").alias("ms_ok"))


@query("status_polls", "WITH t AS (SELECT DISTINCT user_id, unnest([100, 2500, 9000])::BIGINT AS tick FROM events) SELECT t.user_id AS session, tick, arg_max(event_type, event_id) AS state FROM t LEFT JOIN events e ON e.user_id = t.user_id AND e.event_id <= tick GROUP BY ALL")
def status_polls(spark, sf):
    """What three polls see of every session."""
    e = table(spark, sf, "events")
    moves = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("at"), F.col("event_id").alias("_ord"), F.col("event_type").alias("state"))
    ticks = e.select(F.col("user_id").alias("session")).distinct().select("session", F.explode(F.array(*(F.lit(t).cast("long") for t in (100, 2500, 9000)))).alias("tick"))
    return reports.status_at(moves, ticks)


@query("stream_peaks", "SELECT date_trunc('minute', ts) AS start, max(value) AS peak, count(*) AS n FROM events GROUP BY 1")
def stream_peaks(spark, sf):
    """Peaks of a sampled series per minute of event time, as a stream that is drained."""
    return stream.latest_of(stream.run_to_end(spark, stream.sampled_peaks(stream.read_events(spark, sf))), "start")


@query("stream_rating_store", _FOLD)
def stream_rating_store(spark, sf):
    """The compare-and-set store as a stream: the same snapshots as the batch fold."""
    w = stream.read_events(spark, sf).select(F.col("event_id").alias("_ord"), F.col("user_id").cast("string").alias("name"), F.when(F.col("event_id") % 3 == 0, "stale").alias("expected_revision"), F.col("event_type").alias("payload"))
    out = stream.latest_of(stream.run_to_end(spark, stream.rating_store(w)), "name")
    return out.withColumn("accepted", F.col("accepted").cast("int")).withColumn("rejected", F.col("rejected").cast("int"))


_REQUESTS = """WITH m AS (SELECT user_id % 5 AS worker, event_id // 3 AS id, ts AS t, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'request' WHEN 1 THEN 'response' END AS kind, event_type AS method, value > 5 AS ok, user_id AS u FROM events),
q AS (SELECT id, t, seq, method, worker, t + INTERVAL 600 SECOND AS deadline FROM m WHERE kind = 'request' AND u % 7 <> 0),
r AS (SELECT m.id, m.t, m.seq, m.ok, coalesce(q0.worker, m.worker) AS worker FROM m LEFT JOIN (SELECT id, worker FROM m WHERE kind = 'request') q0 ON q0.id = m.id WHERE kind = 'response' AND u % 6 <> 0),
e AS (SELECT worker, max(t) AS fin FROM (SELECT worker, t FROM q UNION ALL SELECT worker, t FROM r) GROUP BY worker)"""


@query(
    "request_outcomes",
    _REQUESTS
    + """ SELECT q.worker::VARCHAR AS worker, q.id::VARCHAR AS id, CASE WHEN r.t <= q.deadline THEN r.seq ELSE q.seq END AS seq, q.method,
  CASE WHEN r.t <= q.deadline THEN CASE WHEN r.ok THEN 'answered' ELSE 'failed' END WHEN q.deadline <= e.fin THEN 'timed_out' ELSE 'closed' END AS outcome,
  CASE WHEN r.t <= q.deadline THEN r.t WHEN q.deadline <= e.fin THEN q.deadline ELSE e.fin END AS "at"
FROM q LEFT JOIN r ON r.id = q.id JOIN e ON e.worker = q.worker
UNION ALL SELECT r.worker::VARCHAR, r.id::VARCHAR, r.seq, q.method, CASE WHEN q.id IS NULL THEN 'stray' ELSE 'late' END, r.t FROM r LEFT JOIN q ON q.id = r.id WHERE q.id IS NULL OR r.t > q.deadline""",
)
def request_outcomes(spark, sf):
    """Requests of five workers, some of which get no answer, a late one, or an answer without a request."""
    from tessella.streaming import requests

    k = F.col("event_id")
    side = lambda df, kind: df.select((F.col("user_id") % 5).cast("string").alias("worker"), F.expr("event_id div 3").cast("string").alias("id"), F.col("ts").alias("at"), k.alias("seq"), F.lit(kind).alias("kind"), F.col("event_type").alias("method"), (F.col("value") > 5).alias("ok"))
    asked = lambda df: side(df.where((k % 3 == 0) & (F.col("user_id") % 7 != 0)), "request")
    events = table(spark, sf, "events")
    owner = events.where(k % 3 == 0).select(F.expr("event_id div 3").cast("string").alias("id"), (F.col("user_id") % 5).cast("string").alias("owner"))
    # an answer comes from the worker that was asked
    answered = lambda df: side(df.where((k % 3 == 1) & (F.col("user_id") % 6 != 0)), "response").join(owner, "id", "left").withColumn("worker", F.coalesce("owner", "worker")).drop("owner")
    both = lambda df: asked(df).unionByName(answered(df))
    told = stream.run_to_end(spark, requests.track(both(stream.read_events(spark, sf)), 600), "append")
    ends = both(events).groupBy("worker").agg(F.max("at").alias("end"))
    return requests.settle(told.drop("_batch"), ends).select("worker", "id", "seq", "method", "outcome", "at")
