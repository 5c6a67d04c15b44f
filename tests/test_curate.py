import difflib
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import curate, enrich, graph


def sequential(rows):
    """First-wins over two keys, one row after another."""
    a, b, why = set(), set(), {}
    for o, x, y, late in sorted(rows):
        if x in a:
            why[o] = "dup_audio"
        elif y in b:
            why[o] = "dup_text"
        elif late:
            why[o] = "missing_audio"
        else:
            why[o] = None
            a.add(x)
            b.add(y)
    return why


@pytest.mark.parametrize("seed", range(4))
def test_greedy_two_key_equals_sequential(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"s{rng.randrange(12)}", f"t{rng.randrange(12)}", rng.random() < 0.15) for i in range(60)]
    df = spark.createDataFrame(rows, "_ord long, audio_sha256 string, norm string, late boolean").repartition(5)
    accepted = curate.greedy_two_key(spark, df.where("not late"), "audio_sha256", "norm", "_ord")
    out = curate.decide(df, accepted, "audio_sha256", "norm", "_ord", F.when(F.col("late"), "missing_audio"))
    assert {r._ord: r.why for r in out.collect()} == sequential(rows)


def test_greedy_chain_ends_in_few_rounds(spark, monkeypatch):
    """A chain of 10,000 rows, each sharing a key with the next: by fixpoint alone 5,000 rounds."""
    written = []
    keep = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda s, df, name, **k: (written.append(name), keep(s, df, name, **k))[1])
    rows = [(i, f"a{(i + 1) // 2}", f"b{i // 2}") for i in range(10_000)]
    df = spark.createDataFrame(rows, "_ord long, a string, b string").repartition(4)
    got = sorted(r._ord for r in curate.greedy_two_key(spark, df, "a", "b", "_ord").collect())
    want = sequential([(*r, False) for r in rows])
    assert got == [o for o, w in want.items() if w is None] and written.count("large") <= 24


@pytest.mark.parametrize("seed", range(3))
def test_folded_components_equal_sequential(spark, seed):
    """Rows with null keys, too: a null key blocks nothing."""
    rng = random.Random(seed)
    pick = lambda p, n: None if rng.random() < 0.1 else f"{p}{rng.randrange(n)}"
    rows = [(i, pick("k", 40), pick("k", 25)) for i in range(160)] + [(500, None, None), (501, None, None)]
    df = spark.createDataFrame(rows, "_ord long, a string, b string").repartition(5)
    a, b, want = set(), set(), []
    for o, x, y in rows:
        if (x is None or x not in a) and (y is None or y not in b):
            a.add(x)
            b.add(y)
            want.append(o)
    assert sorted(r._ord for r in curate.greedy_two_key(spark, df, "a", "b", "_ord", rounds=0).collect()) == want
    assert sorted(r._ord for r in curate.greedy_two_key(spark, df, "a", "b", "_ord", rounds=1).collect()) == want
    assert sorted(r._ord for r in curate.greedy_two_key(spark, df, "a", "b", "_ord").collect()) == want


def test_greedy_counter_example(spark):
    df = spark.createDataFrame([(1, "s1", "t1"), (2, "s2", "t1"), (3, "s2", "t3")], "_ord long, a string, b string")
    assert sorted(r._ord for r in curate.greedy_two_key(spark, df, "a", "b", "_ord").collect()) == [1, 3]


def test_freeze_precedence_and_manifest(spark):
    rows = [(1, "你好", None, None, "a", True, "x"), (2, "你好！", None, None, "b", True, "x"), (3, "", "hi", None, "c", True, None), (4, "", None, None, "d", True, "x"), (5, "new", None, None, "a", True, "x"), (6, "gone", None, None, "e", False, "x"), (7, "out", None, None, "f", True, "x"), (8, "", None, "prov", "g", True, "x")]
    idx = spark.createDataFrame(rows, "_ord long, text string, text_asr string, provenance_text string, audio_sha256 string, file_exists boolean, label string")
    frozen = curate.freeze(spark, idx, spark.createDataFrame([("f",)], "key string"))
    got = {r._ord: (r.why, r.text_source) for r in frozen.collect()}
    assert got == {1: (None, "filename"), 2: ("dup_text", "filename"), 3: (None, "asr"), 4: ("no_text", "filename"), 5: ("dup_audio", "filename"), 6: ("missing_audio", "filename"), 7: ("reviewed_out", "filename"), 8: (None, "provenance")}
    assert all((r.split is not None) == (r.why is None) for r in frozen.collect())
    m = curate.freeze_manifest(frozen).first()
    assert m.train + m.validation + m.test == 3 and m.dropped == 5 and m.labels == {"null": 1, "x": 2} and m.text_sources == {"asr": 1, "filename": 1, "provenance": 1}


def test_audit(spark):
    fid = lambda t, s: hashlib.sha256(f"{t}|{s}".encode()).hexdigest()
    rows = [("train", fid("a", "1"), "a", "1", "1"), ("test", fid("b", "1"), "b", "1", "1"), ("validation", fid("a", "2"), "a", "2", None), ("train", "bad", "c", "3", "9")]
    df = spark.createDataFrame(rows, "split string, fid string, text string, audio_sha256 string, file_sha256 string")
    got = sorted((r.kind, r.split) for r in curate.audit(df).collect())
    assert got == [("audio_leak", "test"), ("fid_mismatch", "train"), ("missing_audio", "validation"), ("sha_mismatch", "train"), ("text_leak", "validation")]


def prep_rows(spark):
    ok = (True, 2.0, -20.0)
    rows = [(1, "f1", "good text", "s1", *ok), (2, "blocked", "x y z", "s2", *ok), (3, "f3", "gone", None, *ok), (4, "f4", "loud text", "LEAK", *ok), (5, "f5", ".", "s5", *ok), (6, "f6", "evaluation sentence", "s6", *ok), (7, "f7", "evaluation sentences", "s7", *ok), (8, "f8", "other", "s1", *ok), (9, "f9", "good, text!", "s9", *ok), (10, "f10", "short", "s10", True, 0.1, -20.0), (11, "f11", "quiet", "s11", True, 2.0, -60.0), (12, "f12", "broken", "s12", False, None, None), (13, "f13", "short", "s13", *ok)]
    return spark.createDataFrame(rows, "_ord long, fid string, text string, file_sha256 string, readable boolean, duration_s double, rms_dbfs double")


def key(spark, *v):
    return spark.createDataFrame([(x,) for x in v], "key string")


def test_reject_cascade(spark):
    out = curate.prepare_training(spark, prep_rows(spark), key(spark, "blocked"), key(spark, "leak"), key(spark, "evaluationsentence"))
    got = {r._ord: r.reason for r in out.collect()}
    assert got == {1: None, 2: "leak_fid", 3: "missing_file", 4: "leak_audio_sha", 5: "bad_text", 6: "leak_text_exact", 7: "leak_text_similar", 8: "duplicate_audio", 9: "duplicate_text", 10: "bad_duration", 11: "silent", 12: "bad_audio", 13: None}
    st = curate.prepare_stats(out).first()
    assert st.accepted == 2 and st.rejected == 11 and st.decision == "DATA_BLOCKED" and st.mean_seconds == 2.0
    assert curate.prepare_stats(out, 2, 3.0).first().decision == "ok"
    val = curate.validation_rows(prep_rows(spark).select("_ord", "fid", "text", "file_sha256"), key(spark, "blocked"), key(spark, "leak"), key(spark, "evaluationsentence"), limit=3)
    assert [r._ord for r in val.collect()] == [1, 5, 7]


def test_fuzzy_join_equals_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 40))) for _ in range(40)]
    rows = [(str(i), (b if rng.random() < 0.3 else b[:-1] + "z" if rng.random() < 0.5 else b[::-1])) for i, b in enumerate(base)]
    got = {r.key: r.similarity for r in curate.similar_to_blocklist(spark.createDataFrame(rows, "key string, norm string"), spark.createDataFrame([(b,) for b in base], "norm string")).collect()}
    want = {k: max(difflib.SequenceMatcher(None, n, b).ratio() for b in base) for k, n in rows}
    assert got == {k: v for k, v in want.items() if v >= 0.85}


def test_blocklist_and_exclusion(spark):
    parts = [spark.createDataFrame([("gt", "AB", "你好！", None)], "label string, sha string, text string, fid string"), spark.createDataFrame([("p", "ab", None, "f1")], "label string, sha string, text string, fid string")]
    b = curate.build_blocklist(parts).first()
    assert (b.audio_sha256, b.norm_texts, b.fids, b.n_entries) == (["ab"], ["你好"], ["f1"], 2)
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "fid string, sha string")
    assert [r.fid for r in curate.exclude(rows, key(spark, "a", "z"), ["fid", "sha"]).collect()] == ["b"]


def test_enrich_is_idempotent(spark):
    idx = spark.createDataFrame([("a\\b.wav", "text", "ok", ["clipped:1"]), ("c.wav", "", "ok", []), ("d.wav", "t", "reject", [])], "source string, text string, status string, flags array<string>")
    sp = spark.createDataFrame([("a/b.wav", 0.3), ("d.wav", 0.1)], "key string, speaker_cos double")
    asr = spark.createDataFrame([("a/b.wav", 0.5, "h"), ("c.wav", 0.9, " found ")], "key string, cer double, hypothesis string")
    one = enrich.enrich(idx, sp, asr)
    got = {r.source: (r.flags, r.text_asr) for r in one.collect()}
    assert got == {"a\\b.wav": (["clipped:1", "speaker_cos:0.3", "speaker_mismatch:0.3", "asr_cer:0.5", "asr_mismatch:0.5"], None), "c.wav": (["text_from_asr"], " found "), "d.wav": ([], None)}
    assert {r.source: r.flags for r in enrich.enrich(one.drop("text_asr"), sp, asr).collect()} == {k: v[0] for k, v in got.items()}
    assert one.select(enrich.cos_of(F.col("flags")).alias("c")).where("c is not null").first().c == 0.3


def test_top_k(spark):
    rows = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.95), (4, None)], "_ord long, speaker_cos double")
    assert [r._ord for r in enrich.pick_references(rows, 2).collect()] == [3, 1]
    assert [r._ord for r in enrich.pick_references(rows, 0).collect()] == [3, 1, 2, 4]
    assert [r._ord for r in enrich.pick_references(rows, 0, 0.0).collect()] == [3, 1, 2]


def test_provenance_and_decisions(spark):
    idx = spark.createDataFrame([("x\\a.wav", "old", "l")], "source string, text string, label string")
    prov = spark.createDataFrame([(1, "x/a.wav", "first", "m"), (2, "x\\a.wav", "second", "")], "_ord long, file string, text string, label string")
    r = enrich.with_provenance(idx, prov).first()
    assert (r.text, r.label, r.provenance_text) == ("second", "l", "second")
    doc = spark.createDataFrame([(None, ["a"], {"a": ["t1", "t2"]})], "drop array<string>, exclude array<string>, tags map<string,array<string>>")
    assert [r.key for r in enrich.decisions(doc).collect()] == ["a"] and enrich.decision_tags(doc).count() == 2
