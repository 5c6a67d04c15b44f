import random

from pyspark.sql import functions as F

from tessella.operators import experiments, ratings, verdicts


def test_matrices_pairs_packs(spark):
    groups = spark.createDataFrame([("A", "t", [42, 43, 44]), ("B", "u", [42, 43]), ("C", "v", [42, 43])], "pair_group string, text string, seeds array<int>")
    cells = experiments.expand_matrix(groups)
    assert cells.count() == 14 and cells.select("pair_id").distinct().count() == 7
    cases = spark.createDataFrame([(f"c{i}",) for i in range(6)], "case_id string")
    assert experiments.checkpoint_cells(cases).count() == 24
    pairs = experiments.checkpoint_pairs(cases, F.col("case_id").isin("c0", "c1"))
    assert pairs.count() == 20
    base = pairs.where(F.col("cells")[0].startswith("base/"))
    first = base.where("case_id in ('c0', 'c1') and cells[1] like 'ckpt50/%'")
    assert experiments.rest_pack(base, first).count() == 16


def test_reuse_cascade(spark):
    frozen = {"cfg_value": "2.0", "inference_timesteps": "10", "normalize": "true", "denoise": "false", "retry_badcase": "true"}
    prior = [(i, "ok", "t", 1, "p", f"o{i}", "AA", "r", frozen) for i in range(9)]
    prior[1] = (1, "error", *prior[1][2:])
    prior[4] = (4, "ok", "t", 1, "other", "o4", "AA", "r", frozen)
    prior[7] = (7, "ok", "t", 1, "p", "o7", "AA", "r", frozen | {"cfg_value": "3.0"})
    prior[8] = (8, "ok", "t", 1, "p", "o8", "AA", "q", frozen)
    p = spark.createDataFrame(prior, "case_id int, status string, text string, seed int, prompt_sha256 string, output string, output_sha256 string, model_revision string, effective_args map<string,string>")
    files = spark.createDataFrame([(f"o{i}", "bb" if i == 3 else "aa") for i in range(9) if i != 2], "path string, sha256 string")
    wanted = spark.createDataFrame([(i, i, "x" if i == 6 else "t", 2 if i == 5 else 1, "p", "r") for i in range(10)], "case_id int, prior_id int, text string, seed int, prompt_sha256 string, model_revision string")
    got = {r.case_id: r.blocked_reason for r in experiments.verify_reuse(wanted, p, files, frozen).collect()}
    assert got == {0: None, 1: "prior_not_ok", 2: "missing_file", 3: "sha_mismatch", 4: "prompt_mismatch", 5: "seed_mismatch", 6: "text_mismatch", 7: "args_mismatch", 8: "revision_mismatch", 9: "missing_prior"}


def test_screening_upsert_status(spark):
    rows = spark.createDataFrame([("ok", False, 0.1, 0.9, 2), ("blocked", True, 0.0, 0.0, 0), ("ok", True, 0.0, 0.0, 0)], "s string, f boolean, c double, q double, r int")
    got = [r[0] for r in rows.select(experiments.screening_flags(F.col("s"), F.col("f"), F.col("c"), F.col("q"), F.col("r"))).collect()]
    assert got == [["non_finite", "clipping", "mostly_silent", "retry_2"], ["blocked"], []]
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, experiments.upsert(old, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    one = experiments.status_counts(rows.select(F.col("s").alias("status"))).first()
    assert (one.ok, one.total, one.all_ok) == (2, 3, False)
    assert experiments.status_counts(rows.where("false").select(F.col("s").alias("status"))).first().all_ok is False


def test_asr_pairs_duplicates(spark):
    cases = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", None), ("d", None)], "case_id string, output_sha256 string")
    asr = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.1)], "_ord int, case_id string, cer double")
    assert {r.case_id: r.asr_aux and r.asr_aux.cer for r in experiments.attach_asr(cases, asr).collect()} == {"a": 0.1, "b": None, "c": None, "d": None}
    assert {r.case_id: r.duplicate_sha for r in experiments.duplicate_sha(cases).collect()} == {"a": True, "b": True, "c": False, "d": False}
    pairs = spark.createDataFrame([("p", ["b", "zz", "a"])], "pair_id string, cells array<string>")
    r = experiments.pair_sides(pairs, cases).first()
    assert [s.case_id for s in r.sides] == ["b", "a"]
    packs = spark.createDataFrame([("k", ["q", "p"])], "pack_id string, pairs array<string>")
    assert experiments.pack_pairs(packs, pairs).select("pos").first().pos == 1


def test_small_helpers(spark):
    log = spark.createDataFrame([("CUDA out of memory",), ("info only",), ("clean",)], "l string")
    assert [r[0] for r in log.select(experiments.log_failures(F.col("l"))).collect()] == [["oom"], ["nan_or_inf"], []]
    assert log.select(experiments.parameter_summary(F.array(F.lit("a=1"), F.lit(""), F.lit("b=2"), F.lit("a=1")))).first()[0] == "a=1, b=2"
    segs = spark.createDataFrame([("f", 0, 100), ("f", 150, 200), ("f", 900, 1000), ("g", 5, 9)], "file string, start_ms int, end_ms int")
    assert sorted(r.kept_gap_ms for r in experiments.stitch_gaps(segs).collect()) == [0, 0, 50, 300]
    names = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "s string, o int")
    assert sorted(r.unique_name for r in experiments.collision_names(names, "s", "o").collect()) == ["x", "x-1", "y"]
    rng = random.Random(1)
    rows = [(i, rng.randrange(6)) for i in range(41)]
    want = sorted(rows, key=lambda r: (r[1], r[0]))
    got = experiments.quartile_picks(spark.createDataFrame(rows, "i int, n int"), F.col("n"), "i").collect()
    assert sorted(r.i for r in got) == sorted(want[k * 41 // 4][0] for k in (1, 2, 3))


def test_ratings(spark):
    cases = spark.createDataFrame([("a", "h"), ("b", None)], "case_id string, output_sha256 string")
    r = spark.createDataFrame([("a", "h"), ("a", "x"), ("b", None), ("z", "h")], "case_id string, output_sha256 string")
    assert [x.sha_status for x in ratings.sha_status(r, cases).orderBy("case_id", "output_sha256").collect()] == ["verified", "stale_sha", "stale_sha", "unknown_case"]
    s = spark.createDataFrame([("p", "P0", "4", "3", "3", ""), ("p", "P2", "5", "4", "3", "2")], "pair_id string, prompt_id string, clarity string, grit string, likeness string, naturalness string")
    assert tuple(ratings.pair_summary(s).first()) == ("p", 3.33, 3.5, 0.17)
    v = spark.createDataFrame([("1", "h", "4", "3", "3", ""), ("2", "h", "5", "3", "3", "2"), ("3", "i", "1", "1", "1", "1")], "case_id string, output_sha256 string, clarity string, grit string, likeness string, naturalness string")
    got = ratings.context_variance(v).collect()
    assert len(got) == 1 and got[0].divergent == ["clarity", "naturalness"] and got[0].case_ids == ["1", "2"]
    w = spark.createDataFrame([("base/x",), ("base/y",), ("TIE",)], "winner_condition string")
    assert {x.winner: x.n for x in ratings.winner_tally(w).collect()} == {"base": 2, "TIE": 1}
    assert spark.range(1).select(ratings.score_cell(F.lit("1"), F.lit(" "), F.lit("3"), F.lit(None)), ratings.score_cell(F.lit(""), F.lit(None))).first() == ("c/g/l/n 1/-/3/-", "-")


def fold(events):
    import hashlib

    state = {}
    for o, name, expected, payload in sorted(events):
        rev, body, ok, no = state.get(name, (None, None, 0, 0))
        if expected is not None and expected != rev:
            no += 1
        else:
            rev, body, ok = hashlib.sha256(f"{name}|{o}".encode()).hexdigest()[:16], payload, ok + 1
        state[name] = (rev, body, ok, no)
    return state


def test_snapshot_fold(spark):
    import hashlib

    rng = random.Random(2)
    revs = [hashlib.sha256(f"n{k}|{o}".encode()).hexdigest()[:16] for k in range(3) for o in range(40)]
    events = [(o, f"n{rng.randrange(3)}", rng.choice([None, "stale", rng.choice(revs)]), f"b{o}") for o in range(40)]
    events.append((40, "n0", fold(events)["n0"][0], "last"))
    df = spark.createDataFrame(events, "_ord int, name string, expected_revision string, payload string").repartition(3)
    assert {r.name: tuple(r)[1:] for r in ratings.fold_snapshots(df).collect()} == fold(events)


def test_review_states(spark):
    rows = spark.createDataFrame([(False, 2, 2, True), (True, 1, 2, True), (True, 2, 2, True), (True, 2, 2, None), (None, 2, 2, False), (True, 0, 0, False)], "a boolean, r int, t int, f boolean")
    got = [x[0] for x in rows.select(ratings.review_status(F.col("a"), F.col("r"), F.col("t"), F.col("f"))).collect()]
    assert got == ["BLOCKED", "PENDING_USER_LISTENING", "UNCERTAIN_FATIGUE", "RATED", "BLOCKED", "PENDING_USER_LISTENING"]
    c = spark.createDataFrame([("n", {"a": "AA", "b": "bb"})], "name string, asset_hashes map<string,string>")
    f = spark.createDataFrame([("a", "aa"), ("b", "cc")], "path string, sha256 string")
    assert {x.asset: x.ok for x in ratings.verify_assets(c, f).collect()} == {"a": True, "b": False}
    t = spark.createDataFrame([("a", "h", "base"), ("b", "x", "base"), ("z", "h", "base")], "case_id string, output_sha256 string, condition string")
    k = spark.createDataFrame([("a", "h", "ckpt"), ("b", "h", "base")], "case_id string, output_sha256 string, condition string")
    assert tuple(ratings.check_truth(t, k).first()) == (1, 1, 1, False)
    shuffled = spark.createDataFrame([("20261008:p", ["a", "b", "c"])], "s string, c array<string>").select(ratings.seeded_shuffle("s", "c")).first()[0]
    want = ["a", "b", "c"]
    random.Random("20261008:p").shuffle(want)
    assert shuffled == want
    assert sorted(spark.range(1).select(ratings.blind_order(F.lit("p"), F.array(F.lit("a"), F.lit("b")))).first()[0]) == ["a", "b"]


def test_census_and_diffs(spark):
    h = spark.createDataFrame([("base_lm.x.lora_A", "F16", 10), ("base_lm.x.lora_B", "F32", 20), ("feat_decoder.q_proj", "F32", 5), ("enc_proj", "F32", 1)], "key string, dtype string, numel long")
    st = spark.createDataFrame([("base_lm.x.lora_A", 3.0, 0.5, 0, 0), ("base_lm.x.lora_B", 4.0, 1.0, 0, 0), ("enc_proj", 0.0, 0.0, 1, 0)], "key string, l2 double, nonzero double, nan int, inf int")
    got = {r.grp: r for r in verdicts.weights_census(h, st).collect()}
    assert got["lm"].l2 == 5.0 and (got["lm"].a, got["lm"].b, got["lm"].numel, got["lm"].dtypes) == (1, 1, 30, ["F16", "F32"]) and got["lm"].nonzero_mean == 0.75
    assert got["proj"].anomalies == ["enc_proj:all_zero", "enc_proj:not_finite"] and got["dit"].keys == 1
    d = spark.createDataFrame([("t", "base_lm.a", 0.5, None), ("t", "x", 0.0, None), ("t", "y", None, True)], "transition string, key string, rel_l2 double, identical boolean")
    out = {(r.transition, r.grp): (r.changed, r.unchanged, r.max_rel_l2, r.trained) for r in verdicts.weight_diffs(d).collect()}
    assert out == {("t", None): (1, 2, 0.5, True), ("t", "lm"): (1, 0, 0.5, True), ("t", "other"): (0, 2, 0.0, False)}


def test_verdicts(spark):
    def v(*args):
        return spark.range(1).select(verdicts.onoff_verdict(*[F.lit(a) for a in args])).first()[0]

    assert v("a", "a", "c", "d", None, None) == "NONDETERMINISTIC_RUN"
    assert v("a", "b", "c", "c", 0.5, None) == "DISABLED_NOT_EQ_BASE" and v("a", "b", "c", "c", 0.99995, None) == "DISABLED_NEAR_BASE_ONLY"
    assert v("a", "a", "a", "a", None, None) == "ADAPTER_NOT_EFFECTIVE" and v("a", "a", "c", "c", None, 0.999999) == "ADAPTER_NUMERIC_NOISE_ONLY"
    assert v("a", "a", "c", "c", None, 0.2) == "ADAPTER_EFFECTIVE"
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    ok = spark.range(1).select(verdicts.load_integrity(arr("base_lm.a", "feat_decoder.b"), arr("base_lm.a", "feat_decoder.b"), arr("q")).alias("r")).first().r
    assert ok.verdict == "LOAD_OK" and ok.unexpected_skipped == ["q"]
    bad = spark.range(1).select(verdicts.load_integrity(arr("base_lm.a", "z"), arr("base_lm.a"), arr("z")).alias("r")).first().r
    assert bad.verdict == "ADAPTER_LOAD_FAILED" and bad.unexplained_skipped == ["z"] and bad.missing_required_groups == ["dit"]
    fin = lambda *a: spark.range(1).select(verdicts.final_verdict(*[F.lit(x) for x in a])).first()[0]
    assert fin(False, True, "ADAPTER_EFFECTIVE", True) == "ADAPTER_NOT_EFFECTIVE" and fin(True, True, "ADAPTER_EFFECTIVE", True) == "ADAPTER_EFFECTIVE_NO_CLEAR_GAIN"
    assert fin(True, True, "ADAPTER_EFFECTIVE", False) == "COMPARABILITY_LIMITED" and fin(True, True, None, True) == "INCONCLUSIVE"
    m = spark.createDataFrame([({"text": "a", "prompt_wav_path": "x/p.wav", "cfg_value": "2"}, {"text": "a", "prompt_wav_path": "y\\p.wav", "cfg_value": "3"})], "a map<string,string>, b map<string,string>")
    assert list(m.select(verdicts.argument_diffs(F.col("a"), F.col("b"))).first()[0]) == ["cfg_value"]
    c = spark.createDataFrame([({"a": "1", "b": "2"},), ({"b": "2", "a": "1"},)], "m map<string,string>")
    assert verdicts.config_identical(c, "m").first().identical
