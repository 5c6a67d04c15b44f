"""Every operator against a brute-force restatement, and its defined results for odd rows."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import decontaminate, jaccard_join, line_dedup, packing, pii, quality_classifier, quality_rules, secrets, sharding, suffix_dedup
from tests.llm import brute, held_out

EMPTY = hashlib.sha256(b"").hexdigest()
LABELLED = "/root/testdata/sf0.1"


def by_id(df, *cols):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", *cols).collect()}


def test_secrets(spark, corpus, frames, odd, none):
    rows, _ = corpus
    cols = ("n_assign", "n_access", "n_hex", "base_sha256")
    assert by_id(secrets.secrets(spark, frames[0]), *cols) == {d: brute.brute1(t) for d, t, _ in rows}
    assert secrets.secrets(spark, odd).count() == len(rows) + 4 and secrets.secrets(spark, none).count() == 0
    token = "k8sJ3xQ9vBn2LpR7tYw4Zq0D"
    texts = [(1, f"é {token} end"), (2, "word0 " + "xyz1" * 9), (3, None), (4, "deadbeefdeadbeef," * 700)]
    out = by_id(secrets.secrets(spark, spark.createDataFrame(texts, "doc_id long, text string")), "spans", "n_hex")
    assert out[1][0] == f"random:2:{2 + len(token)}" and out[2][0] == "" and out[3] == ("", 0) and out[4][1] == 700


def test_random_tokens_within_longer_runs(spark):
    """A random value behind NAME=, or glued to a prefix of other characters, is a token of its own."""
    token, padded = "k8sJ3xQ9vBn2LpR7tYw4Zq0D", "k8sJ3xQ9vBn2LpR7tY=="
    b64, b64u = "k8sJ3x+Q9vBn2LpR/7tYw4Zq0DhM", "k8sJ3x-Q9vBn2LpR_7tYw4Zq0DhM"
    texts = [f"AUTH={token}", f"https://a.example/x?sig={token}&n=1", f"AWS_KEY={token}==", f"my-app_{b64}", f"etc/app/{b64u}", f"A={padded} B={token}", "n1" + "=" * 40, f"a/b_c={token}"]
    out = by_id(secrets.secrets(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "spans")
    at = lambda i, t: f"random:{texts[i].index(t)}:{texts[i].index(t) + len(t)}"
    want = [at(0, token), at(1, token), at(2, token + "=="), at(3, b64), at(4, b64u), f"{at(5, padded)},{at(5, token)}", "", at(7, token)]
    assert [out[i][0] for i in range(len(texts))] == want


def test_discovery_control_by_class(spark):
    """Planted random values of three encodings leave as spans; structured tokens in the same classes stay
    out, in classes of a few tokens as in classes of hundreds."""
    rng = np.random.default_rng(21)
    hexes, full = list("0123456789ABCDEF"), list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    for n in (6, 300):
        rows, planted = [], {}
        for i in range(n):
            value = "".join(rng.choice(hexes if i % 2 else full, 40))
            rows += [(3 * i, f"the value {value} was set"), (3 * i + 1, f"see SectionOverview{i % 7}OfTheLongDocument{i % 5}Part here"), (3 * i + 2, f"id {'A1B2' * 10} and {'0' * 20}XBCDEF{i % 10} again")]
            planted[3 * i] = f"random:10:{10 + len(value)}"
        got = by_id(secrets.secrets(spark, spark.createDataFrame(rows, "doc_id long, text string")), "spans", "n_secrets")
        caught = sum(got[d][0] == s for d, s in planted.items())
        false = sum("random" in got[d][0] for d in got if d % 3)
        assert caught >= 0.9 * n and false <= 0.1 * caught and got[2] == (f"hex:{8 + 40}:{8 + 60}", 1)


#: Names and titles run together, with digits, separators and capitals: none is random.
RUN_TOGETHER = """nineteen84georgeorwell catch22josephheller slaughterhouse5vonnegut 2001aspaceodysseykubrick apollo13missionreport
IMG_20230415_123456_edited my-awesome-project-v2-final usr/local/lib/python3/site-packages error_log_2024-01-15_backup fahrenheit451raybradbury
the100yearoldmanwhoclimbed area51declassifiedfiles route66roadtripguide2019 windows10updateassistant iphone12promaxreview blade2runner2049soundtrack
formula1worldchampionship2021 covid19vaccinationcenter section8housingassistance boeing747maintenance customer_support_ticket_4821
ReadOnlyMemoryStreamFactory2 chapter12thefinalcountdown year2000bugpreparedness world-health-organization-report TheQuickBrownFox2JumpsOver
ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz aaaaaaaaaaaaaaaaaaaaaaaaaaaa 00000000000000000000000000 20240115093000202401150931 xyzxyzxyzxyzxyzxyzxyzxyz
einlichheitenverbraucherschutz donaudampfschifffahrtskapitaen internationalisation antidisestablishmentarianism""".split()


@pytest.mark.parametrize("n", [1, 12])
def test_words_run_together_are_no_discoveries(spark, n):
    """In classes of few tokens: words run together stay out, random values of five encodings leave."""
    rng, small = np.random.default_rng(17 + n), "abcdefghijklmnopqrstuvwxyz"
    alphabets = ["0123456789" + small, small, small.upper() + small + "0123456789", small.upper() + small + "0123456789-_", "0123456789ABCDEF"]
    planted = ["".join(rng.choice(list(a), size)) for a in alphabets for size in (24, 32, 48) for _ in range(n)]
    rows = [(i, f"see {t} there") for i, t in enumerate(RUN_TOGETHER + planted)]
    got = by_id(secrets.secrets(spark, spark.createDataFrame(rows, "doc_id long, text string")), "spans")
    found = [got[i][0] == f"random:4:{4 + len(t)}" for i, t in enumerate(RUN_TOGETHER + planted)]
    assert not any("random" in got[i][0] for i in range(len(RUN_TOGETHER))) and sum(found) >= 0.9 * len(planted)
    alone = secrets.secrets(spark, spark.createDataFrame(rows[: len(RUN_TOGETHER)], "doc_id long, text string"))
    assert alone.where("spans like '%random%'").count() == 0


def plain_evidence(token, letters):
    """The same ratio by plain probabilities."""
    sort = lambda c: {k: v for k, v in secrets.LETTERS.items() if (k in secrets.VOWELS) == (c in secrets.VOWELS)}
    group = lambda c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
    mixed = alone = 1.0
    for last, c in zip([None, *token], token):
        low, s = c.lower(), sort(c.lower())
        own = (1 - secrets.ANY) * s[low] / sum(s.values()) + secrets.ANY / len(s) if low in s else 1 / (10 if c.isdigit() else 4)
        vowel = secrets.AFTER_VOWEL if last and last.lower() in secrets.VOWELS else secrets.AFTER_CONSONANT
        turn = (vowel if low in secrets.VOWELS else 1 - vowel) if low in s else 1.0
        mixed *= secrets.FOLLOWS[4 if last is None else group(last)][group(c)] * turn * own
        alone *= turn * own
    single = len({group(c) for c in token}) == 1 and not token[0] in "+/_-"
    return -np.log2(max(mixed, alone) / 2 if single else mixed / 2) - len(token) * np.log2(len(letters))


def plain_battery(token, letters):
    """The four tests by their textbook formulas."""
    from math import erfc, exp, log, sqrt

    x, n, k = np.array([letters.index(c) for c in token], float), len(token), len(letters)
    counts = np.bincount(x.astype(int), minlength=k)
    z = (((counts - n / k) ** 2 / (n / k)).sum() - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n)
    up = x * 2 >= k
    high, runs = up.sum(), 1 + (up[1:] != up[:-1]).sum()
    expected = 1 + 2 * high * (n - high) / n
    by_runs = 37.0 if high in (0, n) else (runs - expected) / sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))
    serial = ((x * np.roll(x, -1)).mean() - x.mean() ** 2) / max(x.var(), 1e-9)
    two = lambda v: max(min(erfc(min(abs(v), 37) / sqrt(2)), 1), 1e-300)
    ps = [max(erfc(min(z, 37) / sqrt(2)) / 2, 1e-300), two((2 * high - n) / sqrt(n)), two(by_runs), two((serial + 1 / (n - 1)) * sqrt(n))]
    s = -sum(map(log, ps))
    return exp(-s) * (1 + s + s * s / 2 + s**3 / 6)


def test_evidence_and_battery_equal_plain_formulas(spark):
    rng, rows = np.random.default_rng(8), []
    for _, letters, _ in secrets.ENCODINGS:
        rows += [("".join(rng.choice(list(letters), size)), letters) for size in (20, 33, 90)]
    rows += [(t, next(a for _, a, p in secrets.ENCODINGS if re.search(p, t))) for t in RUN_TOGETHER if any(re.search(p, t) for _, _, p in secrets.ENCODINGS)]
    df = spark.createDataFrame(rows, "t string, a string")
    for r in df.select("t", "a", secrets.evidence(F.col("t"), F.col("a")).alias("e"), secrets.battery(F.col("t"), F.col("a")).alias("p")).collect():
        assert abs(r.e - plain_evidence(r.t, r.a)) < 1e-6
        assert abs(r.p - plain_battery(r.t, r.a)) < 1e-5


def test_chances_add_up():
    """The word model is a distribution, so its ratio to the uniform one is a valid measure."""
    kinds, costs, turns = secrets._word_model()
    for kind in range(secrets._KINDS + 1):
        total = sum(2.0 ** -(turns[kind * secrets._KINDS + k] + c) for k, c in zip(kinds, costs))
        assert abs(total - 1) < 1e-9


def test_step_up_rule(spark):
    """Cuts equal the rule over whole-bit levels, class by class; equal tokens count once."""
    rng = np.random.default_rng(3)
    found = [(c, int(t), int(v)) for c in range(6) for t, v in enumerate(np.minimum(rng.geometric(0.1 + c / 8, 8 * c + 1) - 1, 64))]
    df = spark.createDataFrame([([{"class": c, "token": t, "level": v}] * 2,) for c, t, v in found], "found array<struct<class:int,token:bigint,level:int>>")
    want = {}
    for c in range(6):
        levels = [v for k, _, v in found if k == c]
        fits = [v for v in set(levels) if v and len(levels) * 2.0**-v <= 0.1 * sum(x >= v for x in levels)]
        if fits:
            want[c] = min(fits)
    assert secrets.cuts(df, 0.1).first().cuts == want and want


def test_randomness_battery(spark):
    rng = np.random.default_rng(4)
    tokens = ["".join(rng.choice(list("0123456789abcdef"), 64)) for _ in range(200)] + ["0123456789abcdef" * 4, "a1" * 32, "00000000ffffffff" * 4]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    p = [r[0] for r in df.select(secrets.battery(F.col("t"), F.lit("0123456789abcdef"))).collect()]
    assert 0.35 < np.mean(p[:200]) < 0.65 and np.mean(np.array(p[:200]) < 0.05) < 0.12 and max(p[200:]) < 1e-3


def test_line_dedup(spark, corpus, frames, odd, none):
    rows, _ = corpus
    digest = lambda df: sorted((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in line_dedup.dedup_lines(spark, df).collect())
    want = brute.brute2([(d, t) for d, t, _ in rows])
    assert digest(frames[0]) == want and sum(w[2] for w in want) > 5
    assert line_dedup.dedup_lines(spark, odd).count() == len(rows) + 4 and line_dedup.dedup_lines(spark, none).count() == 0
    line = "y" * 45
    many = [(i, "\n".join([line] * 200 + ["z"])) for i in range(5)]
    got = by_id(line_dedup.dedup_lines(spark, spark.createDataFrame(many, "doc_id long, text string")), "n_dropped", "kept")
    assert [got[i][0] for i in range(5)] == [200] * 4 + [0] and got[0][1] == "z"


def test_line_dedup_streams_sorted_ranges(spark):
    """First occurrences come from ranges sorted by hash, document and position: the sort stays in the plan,
    right above the range exchange, and only their counts are shuffled by hash."""
    hashed = spark.range(3000).selectExpr("id % 7 as h1", "id % 7 as h2", "id % 90 as doc_id", "cast(id as int) as pos")
    first = line_dedup.first_occurrences(hashed, 5)
    counts = first.groupBy("h1", "h2").agg(F.count("*"), F.max("doc_id"))
    assert counts.count() == 7
    steps = [x.strip(" +-:*()0123456789") for x in counts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()]
    names = [re.match(r"\w*", x)[0] for x in steps]
    window, sort = names.index("Window"), names.index("Sort")
    assert re.search(r"Sort \[h1\S* ASC[^,]*, h2\S* ASC[^,]*, doc_id\S* ASC[^,]*, pos\S* ASC", steps[sort]) and "rangepartitioning(h1" in steps[sort + 1]
    assert names[window:sort].count("Exchange") == names[window:sort].count("HashAggregate") == 0 and names[:window].count("Exchange") == 1
    want = {}
    for i in range(3000):
        want.setdefault((i % 7, i % 90), i)
    assert {(r.h1, r.doc_id): r.pos for r in first.collect()} == want


def test_jaccard_join(spark, corpus, frames, odd, none):
    rows, _ = corpus
    want = brute.brute3([(d, t) for d, t, _ in rows])
    cols = ("n_shingles", "component_id")
    assert by_id(jaccard_join.jaccard_join(spark, frames[0]), *cols) == want
    assert max(Counter(v[1] for v in want.values()).values()) > 2
    assert by_id(jaccard_join.jaccard_join(spark, frames[0], region_limit=600, pivots=3), *cols) == want
    out = jaccard_join.jaccard_join(spark, odd)
    assert out.count() == len(rows) + 4 and by_id(out.where("doc_id is not null"), *cols) == want
    assert jaccard_join.jaccard_join(spark, none).count() == 0


def test_jaccard_many_near_copies(spark):
    """A hot group: one text in many variants, some copies of copies, split by pivot rounds."""
    import random

    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    rows, cur = [], base
    for i in range(90):
        v = list(cur if i % 5 == 0 else base)
        for _ in range(r.randint(0, 4)):
            v[r.randrange(len(v))] = f"n{r.randrange(9999)}"
        rows.append((i, " ".join(v)))
        cur = v
    want = brute.brute3(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (4 << 20, 5000):
        assert by_id(jaccard_join.jaccard_join(spark, df, region_limit=limit, pivots=4), "n_shingles", "component_id") == want


def test_sharding(spark, corpus, frames, odd, none):
    rows, _ = corpus
    out = sharding.shard(spark, frames[0], 4096).collect()
    shards = Counter()
    for r in out:
        shards[r.shard_depth, r.shard_prefix, r.shard_part] += r.n_bytes
    assert sorted(r.doc_id for r in out) == sorted(d for d, _, _ in rows)
    for r in out:
        own = shards[r.shard_depth, r.shard_prefix, r.shard_part]
        assert own == r.shard_bytes and (own <= 4096) != r.oversize and (not r.oversize or own == r.n_bytes)
    # only oversized buckets split: a shard's sibling and it don't fit together
    held = Counter()
    for r in out:
        for d in range(r.shard_depth + 1):
            held[d, r.shard_prefix >> (r.shard_depth - d)] += r.n_bytes
    assert all(held[r.shard_depth - 1, r.shard_prefix >> 1] > 4096 for r in out if r.shard_depth)
    copies = spark.createDataFrame([(1, "x" * 1000)] * 25 + [(2, None)], "doc_id long, text string")
    parts = Counter((r.shard_prefix, r.shard_part) for r in sharding.shard(spark, copies, 4096).where("doc_id = 1").collect())
    assert sorted(parts.values()) == [1, 4, 4, 4, 4, 4, 4]
    assert sharding.shard(spark, odd, 4096).count() == len(rows) + 4 and sharding.shard(spark, none).count() == 0


def test_suffix_dedup(spark, corpus, frames, odd, none):
    rows, _ = corpus
    cols = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    for span, gram in ((400, 200), (60, 30)):
        want = brute.brute5([(d, t) for d, t, _ in rows], span)
        assert by_id(suffix_dedup.suffix_dedup(spark, frames[0], span, gram), *cols) == want
        assert by_id(suffix_dedup.suffix_dedup(spark, frames[0], span, gram, places=1), *cols) == want
    out = suffix_dedup.suffix_dedup(spark, odd)
    assert out.count() == len(rows) + 4 and suffix_dedup.suffix_dedup(spark, none).count() == 0
    assert all(r.n_removed == (r.n_bytes if r.n_bytes >= 400 else 0) for r in out.where(F.col("doc_id") == rows[3][0]).collect())


def test_suffix_dedup_of_hot_passages(spark):
    """Passages in many documents, around the length that counts, with other surroundings each; texts of
    several bytes a character; one anchor at many places is lengthened without a change."""
    rng = np.random.default_rng(12)
    prose = lambda n: "".join(rng.choice(list("abcdefg hé"), n))
    common = prose(900)
    rows = [(i, prose(60) + common[: int(rng.integers(380, 900))] + prose(40)) for i in range(60)]
    rows += [(100 + i, prose(50) + common[300 - i : 700] + prose(50)) for i in range(30)] + [(200, "xy" * 700), (201, "z" + "xy" * 650), (202, prose(399)), (203, None)]
    want = brute.brute5(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for places in (1024, 8, 1):
        out = suffix_dedup.suffix_dedup(spark, df, places=places)
        assert by_id(out, "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert all(r.n_kept == r.n_bytes - r.n_removed and r.repeated == (r.n_removed > 0) for r in out.collect())
    assert {r.doc_id: r.n_kept_chars for r in out.collect()}[202] == 399


def test_one_periodic_text_leaves_an_anchor_split(spark):
    """A passage in many texts and one text that repeats pieces of it: the passage's anchors stay lengthened
    everywhere, those of the periodic text stand for themselves besides, and no repeat is lost."""
    rng = np.random.default_rng(31)
    prose = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    common = prose(500)
    rows = [(i, prose(120) + common + prose(120)) for i in range(60)]
    odd = [(1000, prose(30) + common[150:350] * 5 + prose(30)), (1001, common[150:350] * 4 + common[350:] + prose(40)), (1002, prose(80) + common[100:350] + common[150:500] + prose(9)), (1003, common[:420] + common[150:350] * 3)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string")
    want = brute.brute5(rows + odd)
    for places in (4, 1, 1024):
        assert by_id(suffix_dedup.suffix_dedup(spark, df, places=places), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    texts = spark.createDataFrame([(i, t) for i, t in rows + odd], "tid long, text string")
    found = suffix_dedup.repeated_anchors(suffix_dedup.anchor_blobs(texts, 3, 400, 200), 3, 201, 4).collect()
    levels = {r.tid: np.frombuffer(r.blob, suffix_dedup._FOUND)["level"] for r in found}
    assert all((levels[i] % suffix_dedup.BOTH).max() == suffix_dedup.LEVELS and not (levels[i] & suffix_dedup.BOTH).any() for i in range(60))
    assert any((levels[i] & suffix_dedup.BOTH).any() for i in levels if i >= 1000)


@pytest.mark.parametrize("seed", range(6))
def test_periodic_texts_at_any_number_of_places(spark, seed):
    """Short windows over texts of few letters and repeated blocks, each anchor lengthened from two places on."""
    rng = np.random.default_rng(seed)
    block = "".join(rng.choice(list("ab"), int(rng.integers(5, 40))))
    rows = []
    for i in range(40):
        t = "".join(rng.choice(list("abc"), int(rng.integers(0, 60))))
        for _ in range(int(rng.integers(1, 8))):
            t += block[int(rng.integers(0, 4)) :] * int(rng.integers(1, 4)) + "".join(rng.choice(list("abc"), int(rng.integers(0, 12))))
        rows.append((i, t))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.brute5(rows, 40)
    for places in (1, 3):
        assert by_id(suffix_dedup.suffix_dedup(spark, df, span=40, gram=20, places=places), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


@pytest.mark.parametrize("seed", range(3))
def test_two_stage_sort(seed):
    rng = np.random.default_rng(seed)
    bodies = [bytes(rng.choice(list(b"ab\x00c"), rng.integers(1, 60))) for _ in range(30)]
    text, sizes = b"".join(bodies), np.array([len(b) for b in bodies])
    ends = np.repeat(np.cumsum(sizes), sizes)
    wanted = np.flatnonzero(rng.random(len(text)) < 0.5)
    order = suffix_dedup.two_stage_sort(text, ends, wanted, 8)
    keys = [text[i : min(i + 8, ends[i])] for i in order]
    assert set(wanted.tolist()) <= set(order.tolist()) and len(set(order.tolist())) == len(order) and keys == sorted(keys)


def test_window_minima():
    x = np.random.default_rng(0).integers(0, 99, 57).astype(np.uint64)
    assert suffix_dedup.window_minima(x, 10).tolist() == [x[i : i + 10].min() for i in range(48)]


def test_packing(spark, corpus, frames, odd, none):
    from tokenizers import Tokenizer

    import public_tokenizers as public

    rows, _ = corpus
    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    out = packing.pack(spark, frames[0]).toPandas()
    own = dict(list(out.groupby("doc_id")))
    for d, t, _ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        p = own[d].sort_values("start")
        assert p["start"].tolist() == (p["length"].cumsum() - p["length"]).tolist() and p["length"].sum() == len(ids) and set(p["doc_tokens"]) == {len(ids)}
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(p["start"], p["length"], p["ids_crc32"]))
    q = out.sort_values(["sequence_id", "offset"])
    assert (q["offset"] == q.groupby("sequence_id")["length"].cumsum() - q["length"]).all()
    used = out.groupby("sequence_id")["length"].sum()
    assert used.max() <= 2048 and sum(2048 - n for n in used if n & (n - 1)) < 0.05 * used.sum() + 2048
    assert packing.pack(spark, odd).select("doc_id", "doc_tokens").where("doc_id is null").count() >= 2 and packing.pack(spark, none).count() == 0


def test_packed_sequences_hold_the_ids(spark, corpus, frames):
    """Sequences put together from the packed pieces give every text's ids back."""
    from tokenizers import Tokenizer

    import public_tokenizers as public

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    found, filled = {}, {}
    for p in packing.pack(spark, frames[0]).orderBy("sequence_id", "offset").collect():
        own = filled.setdefault(p.sequence_id, bytearray())
        assert len(own) == 4 * p.offset and len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32
        own += p.ids
        found.setdefault(p.doc_id, []).append((p.start, p.sequence_id, p.offset, p.length))
    for d, t, _ in corpus[0]:
        got = b"".join(bytes(filled[s][4 * o : 4 * (o + n)]) for _, s, o, n in sorted(found[d]))
        assert np.frombuffer(got, "<u4").tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, packing.END_ID]


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    import public_tokenizers as public

    e = packing.Encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(5)
    alphabet = list("ab é\n\t 1²½'s<|>中😀́\x1c\x85　.,-") + ["<|endoftext|>", "  ", "'ll"]
    for t in ["", "a" * 5000, "\n" * 1_000_000, *("".join(rng.choice(alphabet, 80)) for _ in range(300))]:
        assert e.ids(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_cuts():
    for n in range(2049):
        c = packing.cuts(n)
        assert sum(c) == n and len(c) <= 6


def test_decontaminate(spark, corpus, frames, odd, none):
    rows, bench = corpus
    cols = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute.brute7([(d, t) for d, t, _ in rows], bench)
    assert by_id(decontaminate.decontaminate(spark, frames[0], frames[1]), *cols) == want and sum(v[4] for v in want.values()) > 5
    assert by_id(decontaminate.decontaminate(spark, frames[0], frames[1], block_words=20), *cols) == want
    assert decontaminate.decontaminate(spark, odd, frames[1]).count() == len(rows) + 4
    assert decontaminate.decontaminate(spark, odd, frames[1], block_words=20).count() == len(rows) + 4
    assert decontaminate.decontaminate(spark, none, frames[1]).count() == 0
    clean = decontaminate.decontaminate(spark, frames[0], frames[1].where("false"))
    assert clean.where("contaminated or n_items > 0").count() == 0 and clean.first().items_sha256 == EMPTY


def test_longest_matches(spark, corpus, frames):
    """Every maximal run of equal words of ten or more (or a whole short item), with its places."""
    rows, bench = corpus
    words = lambda t: brute.W7.findall(brute.low(t))
    want = {}
    for d, t in ((r[0], r[1]) for r in rows):
        w, own = words(t), []
        for item, b in bench:
            v = words(b)
            k = min(10, len(v))
            if not k:
                continue
            for i in range(len(w) - k + 1):
                for j in range(len(v) - k + 1 if len(v) >= 10 else 1):
                    if w[i : i + k] == v[j : j + k] and not (len(v) >= 10 and i and j and w[i - 1] == v[j - 1]):
                        n = k
                        while len(v) >= 10 and i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                            n += 1
                        own.append((i, n, None if item is None else str(item), j))
        want[d] = sorted(own, key=str)
    for block in (decontaminate.BLOCK_WORDS, 40):
        got = decontaminate.decontaminate(spark, frames[0], frames[1], block_words=block).collect()
        assert {r.doc_id: sorted((tuple(m) for m in r.matches), key=str) for r in got} == want
        assert all(r.longest_match == max((m.length for m in r.matches), default=0) for r in got)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    for _ in range(30):
        per = rng.integers(0, 40, 6)
        row = np.repeat(np.arange(6), per)
        code = rng.integers(1, 4, len(row)).astype(np.uint64)
        shard = decontaminate.Shard(code, row, 6, 10)
        ends = shard.ends
        keys = [tuple(code[i : min(i + 10, ends[i])].tolist()) for i in shard.array]
        assert sorted(shard.array.tolist()) == list(range(len(row))) and keys == sorted(keys)


def test_quality_rules(spark, corpus, frames, odd, none):
    rows, _ = corpus
    out = quality_rules.quality_rules(spark, frames[0])
    assert by_id(out, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == {d: brute.brute8(t) for d, t, _ in rows}
    assert out.where("kept and base_failed").count() == 0
    assert quality_rules.quality_rules(spark, odd).count() == len(rows) + 4 and quality_rules.quality_rules(spark, none).count() == 0


def test_fertility_bands(spark):
    """Prose stays; text in an unknown script and a single repeated syllable leave."""
    import random

    r = random.Random(1)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows = [(i, " ".join(r.choice(words) for _ in range(120)), "en") for i in range(60)]
    rows += [(100, " ".join(chr(0x1300 + r.randrange(60)) * 5 for _ in range(100)), "en"), (101, " ".join("aa bb".split()[r.randrange(2)] for _ in range(3)) + " " + " ".join(r.choice("ab") for _ in range(120)), "en")]
    got = by_id(quality_rules.quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")), "kept", "byte_share")
    assert all(got[i][0] for i in range(60)) and not got[100][0] and got[100][1] > 0.5


def test_rare_languages_use_the_pooled_band(spark):
    """Junk of a language, or a script without a language, too rare for a band of its own leaves; its prose stays."""
    import random

    r = random.Random(2)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    junk = lambda: " ".join(chr(0x1300 + r.randrange(60)) * 5 for _ in range(100))
    rows = [(i, prose(120), "en") for i in range(60)] + [(100, prose(120), "xx"), (101, junk(), "xx"), (102, junk(), None), (103, prose(120), None)]
    got = by_id(quality_rules.quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")), "base_failed", "kept")
    assert [got[i] for i in range(100, 104)] == [(False, True), (False, False), (False, False), (False, True)]
    assert all(got[i][1] for i in range(60))


@pytest.mark.skipif(not os.path.isdir(LABELLED), reason="the tables aren't here")
def test_fertility_bands_on_labels(spark):
    """Of labelled documents that pass the base rule, those of odd id: junk leaves, good ones stay."""
    docs, labels = (spark.read.parquet(f"{LABELLED}/{t}.parquet") for t in ("documents", "labels"))
    held = quality_rules.quality_rules(spark, docs).where("not base_failed and doc_id % 2 = 1").join(labels, "doc_id")
    junk, junk_kept, good, good_kept = held.selectExpr(*(x for q in (0, 1) for x in (f"count_if(quality = {q})", f"count_if(quality = {q} and kept)"))).first()
    assert junk > 100 and junk_kept <= 0.15 * junk and good > 1000 and good - good_kept <= 0.01 * good


def test_script():
    assert [quality_rules.script_of(t) for t in ("abc", "где", "中文", "123", "")] == ["script:latin", "script:cyrillic", "script:cjk", "none", "none"]


def test_pii(spark, corpus, frames, odd, none):
    rows, _ = corpus
    out = pii.pii(spark, frames[0])
    assert by_id(out, "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == {d: brute.brute9(t) for d, t, _ in rows}
    assert "crf_phone" in "".join(r.spans for r in out.collect())
    assert pii.pii(spark, odd).count() == len(rows) + 4 and pii.pii(spark, none).count() == 0


def test_pii_patterns_are_exact():
    rng = np.random.default_rng(8)
    parts = ["a", "b1", "@", ".", "-", "_", " ", "+", "1", "25", "256", "(", ")", "4111111111111111", "%", "é", "\n"]
    for _ in range(3000):
        t = "".join(rng.choice(parts, 24))
        want = brute.brute9(t)
        spans = pii.base_spans(t)
        assert tuple(sum(x[1] == k for x in spans) for k in range(4)) == want[:4] and hashlib.sha256(pii._joined(spans).encode()).hexdigest() == want[4]


def labelled(line):
    """The text of a labelled row and its (start, kind, end) spans."""
    text, spans, at = "", [], 0
    for m in re.finditer(r"\[(\w+)\|([^\]]+)\]", line):
        text += line[at : m.start()]
        spans.append((len(text), len(pii.KINDS) + pii.FIELD_KINDS.index(m[1]), len(text) + len(m[2])))
        text, at = text + m[2], m.end()
    return text + line[at:], spans


def test_field_on_held_out_rows():
    """Precision and recall on rows the field hasn't seen, alone and inside long prose."""
    field = pii.train()
    rows = [labelled(x) for x in held_out.ROWS.splitlines()]
    trained = {text for text, _ in map(labelled, pii.TABLE.splitlines())}
    assert not trained & {t for t, _ in rows}
    prose = "Thane oner reth inger. Onthat eres ndthe, sthe of the inthan ereat. "
    for before, after in (("", ""), (prose, " " + prose)):
        found = pii.field_spans(field, [before + t + after for t, _ in rows])
        got = {(i, a - len(before), k, b - len(before)) for i, f in enumerate(found) for a, k, b in f}
        want = {(i, *s) for i, (_, spans) in enumerate(rows) for s in spans}
        assert len(got & want) >= 0.85 * len(want) and len(got & want) >= 0.85 * len(got)
    assert pii.field_spans(field, ["", prose * 50]) == [[], []]


@pytest.mark.skipif(not os.path.isdir(LABELLED), reason="the tables aren't here")
def test_field_leaves_invented_prose_alone(spark):
    """The tables hold none of the field's kinds but for a phone number whose base match fell."""
    docs = spark.read.parquet(f"{LABELLED}/documents.parquet")
    added = pii.pii(spark, docs).where("n_pii > n_email + n_ip + n_card + n_phone")
    more = [x for r in added.collect() for x in r.spans.split(",") if x.startswith("crf_")]
    assert len(more) <= 1 or (len(more) - sum(x.startswith("crf_phone") for x in more)) <= 1


def test_no_span_runs_over_a_sentence():
    """Capitalised words on either side of a full stop or a line end, beside digits and cues, are no name."""
    field = pii.train()
    for text in ("he sold 14 Corn. Orsh mills", "see 3 Elm. As ever", "12 Erer.\nEreresat went", "mr. 5 Queja. Un dia", 'key = "9f3a77" Rest Here', "the x### 12 b%%% Main&&& c*** end"):
        assert pii.field_spans(field, [text]) == [[]], text
    assert pii.field_spans(field, ["prof. J. Holloway spoke"])[0] == [(6, len(pii.KINDS) + pii.FIELD_KINDS.index("crf_name"), 17)]


def test_marks_are_whole_words():
    marked = lambda text: [text[a:b] for a, b in pii.marked_tokens(text)]
    assert marked("İMr. items drum _geb_ geb. x7 Straße strassen İ phone") == ["geb.", "x7", "Straße", "phone"]
    assert marked("a mr.x@y iban:12 (ssn) names") == ["mr.x@y", "iban:12", "(ssn)"]


def test_field_in_long_and_odd_texts():
    field = pii.train()
    ssn = "her ssn is 321-54-9876 here"
    for text in ("7 " * 40000 + ssn, "x" * 300000 + " " + ssn, ssn + "\n" * 1000 + ssn, "@" * 5000 + " " + ssn, "mr. " * 3000 + ssn):
        found = [text[a:b] for a, k, b in pii.field_spans(field, [text])[0] if pii.FIELD_KINDS[k - len(pii.KINDS)] == "crf_id"]
        assert found[-1:] == ["321-54-9876"]


def test_viterbi_equals_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    n = len(pii.LABELS)
    field = pii.ShapeField({}, np.zeros((0, n)), rng.normal(size=(n, n)))
    emits = [rng.normal(size=(t, n)) for t in (1, 3, 2, 4)]
    for e, path in zip(emits, field.viterbi(emits)):
        best = max(itertools.product(range(n), repeat=len(e)), key=lambda p: sum(e[i, y] for i, y in enumerate(p)) + sum(field.trans[a, b] for a, b in zip((0, *p), (*p, 0))))
        assert tuple(path) == best


def test_classifier(spark, none):
    import random

    r = random.Random(9)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        t = [r.choice(words) for _ in range(60)]
        kind = i % 4
        if kind == 0:
            t[r.randrange(60)] = "vile"
            t[r.randrange(60)] = "scum"
        if kind == 1:
            t = [w + "$$$" for w in t]
        rows.append((i, " ".join(t)))
        if i < 400:
            labels.append((i, int(kind != 1), int(kind == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1, 0), (2, None, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    got = by_id(quality_classifier.classify(spark, docs, lab), "expected_grade", "tail_probability", "kept")
    held = [(i % 4, got[i]) for i in range(400, 600)]
    assert np.mean([g[2] == (k > 1) for k, g in held]) > 0.97
    means = [np.mean([g[0] for k, g in held if k == q]) for q in (0, 1, 2)]
    assert means[0] < means[1] < means[2] and all(0 <= g[1] <= 1 for _, g in held)
    assert quality_classifier.classify(spark, none, lab).count() == 0
    unlabelled = quality_classifier.classify(spark, docs, lab.where("false"))
    assert unlabelled.where("kept").count() == 600
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "vile scum")], "doc_id long, text string")
    assert quality_classifier.classify(spark, odd, lab).count() == 4


def test_classifier_on_odd_rows(spark, corpus, odd):
    labels = spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(corpus[0])], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(spark, odd, labels)
    assert out.count() == odd.count() and out.where("tail_probability is null").count() == 0


def test_features_that_tell():
    """The strongest features come first where there are too many; a feature spread like the grades tells nothing."""
    seen = np.array([[100, 0, 0], [0, 0, 100], [34, 33, 33], [3, 0, 0], [60, 20, 20]], float)
    assert quality_classifier.telling(seen, np.array([1000, 1000, 1000])).tolist() == [0, 1, 4]


def test_texts_of_several_slices(spark):
    """One text of more than 4 MB beside short ones, against the same brute force."""
    import random

    r = random.Random(5)
    words = ["".join(r.choice("etaoinsé") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    sentence = lambda n: " ".join(r.choice(words) for _ in range(n))
    line, item = "A line that many documents hold, " + sentence(8), sentence(14)
    long = "\n".join([sentence(40) for _ in range(19000)] + [line, item, "mail jo@mail.example.org or AUTH=k8sJ3xQ9vBn2LpR7tYw4Zq0D password=abcdefgh12345 1.2.3.4"])
    assert len(long.encode()) > 4 << 20
    rows = [(1, long), *((i, sentence(50) + "\n" + line) for i in range(2, 8)), (9, sentence(30) + " " + item)]
    df = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string")
    assert by_id(secrets.secrets(spark, df), "n_assign", "n_access", "n_hex", "base_sha256") == {d: brute.brute1(t) for d, t in rows}
    assert "random" in by_id(secrets.secrets(spark, df), "spans")[1][0]
    kept = sorted((x.doc_id, x.n_lines, x.n_dropped, hashlib.sha256(x.kept.encode()).hexdigest()) for x in line_dedup.dedup_lines(spark, df).collect())
    assert kept == brute.brute2(rows)
    bench = [(1, item)]
    got = by_id(decontaminate.decontaminate(spark, df, spark.createDataFrame(bench, "item_id long, text string")), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.brute7(rows, bench)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert by_id(quality_rules.quality_rules(spark, df), *counts) == {d: brute.brute8(t) for d, t in rows}
    assert by_id(pii.pii(spark, df), "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == {d: brute.brute9(t) for d, t in rows}
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in rows], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(spark, df, labels).count() == len(rows)


def test_ordinal_fit():
    """Ordered thresholds and one direction recover three grades of a single feature."""
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, 3000)
    has = rng.random(3000) < np.array([0.9, 0.5, 0.1])[grade]
    row = np.flatnonzero(has)
    m = quality_classifier.fit(row, np.full(len(row), 7), grade)
    assert m.weights[7] < -1 and m.thresholds[0] < m.thresholds[1]
    p = m.probabilities(np.array([0.0, m.weights[7]]))
    assert np.allclose(p.sum(1), 1) and p[0, 2] > p[1, 2] and p[1, 0] > p[0, 0]


@pytest.mark.parametrize("segment", [2 << 20, 150])
def test_every_window_holds_an_anchor_of_its_own(monkeypatch, segment):
    """Each window lies around an anchor, and equal windows hold an equal one, in periodic text too."""
    import pyarrow as pa

    from tessella.llm import wordcodes as wc

    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    rng = np.random.default_rng(3)
    prose = "".join(rng.choice(list("abcd "), 120))
    texts = [prose, "x" + prose[:90] + "yz", "ab" * 200, "q" + "ab" * 90 + "r", "a" * 333, "short", "", prose * 3]
    data, off = wc.column_bytes(pa.array(texts))
    span, gram = 40, 20
    found: dict[int, dict] = {}
    for rows, starts, part, at in suffix_dedup._segments(data, off, span):
        pos, h = suffix_dedup.anchors(part, at, span, gram)
        row = np.searchsorted(at, pos, side="right") - 1
        for r, p, x in zip(rows[row], pos - at[row] + starts[row], h):
            found.setdefault(int(r), {})[int(p)] = int(x)
    held: dict[str, list] = {}
    for r, t in enumerate(texts):
        for i in range(len(t) - span + 1):
            own = {h for p, h in found[r].items() if i <= p <= i + span - gram}
            assert own
            held.setdefault(t[i : i + span], []).append(own)
    assert all(set.intersection(*v) for v in held.values())
    assert len(found[4]) < 60 and len(found[2]) < 80


def test_regions_of_one_task_equal_all_pairs():
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(25):
        core = rng.integers(0, 4000, 60)
        for _ in range(rng.integers(1, 5)):
            s = core.copy()
            s[rng.integers(0, 60, rng.integers(0, 14))] = rng.integers(0, 4000)
            sets.append(np.unique(s).astype(np.uint64))
    label = list(range(len(sets)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    want = list(range(len(sets)))
    for a, b in jaccard_join.Region(sets, pivots=3).join():
        label[top(a)] = top(b)
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                old, new = want[i], want[j]
                want = [new if w == old else w for w in want]
    groups = lambda v: sorted(sorted(i for i, w in enumerate(v) if w == x) for x in set(v))
    assert groups([top(i) for i in range(len(sets))]) == groups(want)


def test_unlinked_sets_of_one_passage_take_linear_time():
    """Sets that share a passage but are not linked: comparisons grow with their number, not its square, and
    links among them are found."""
    rng = np.random.default_rng(14)

    def region(n, shared):
        common = np.arange(shared)
        sets = [np.sort(np.r_[common, shared + rng.choice(1 << 40, 100 - shared, replace=False)]).astype(np.uint64) for _ in range(n)]
        for i in range(0, n - 1, 50):  # some near copies
            sets[i + 1] = np.sort(np.r_[sets[i][:-6], rng.choice(1 << 40, 6, replace=False).astype(np.uint64) + np.uint64(1 << 41)])
        return jaccard_join.Region(sets)

    for shared in (40, 60):
        work = []
        for n in (400, 800, 1600):
            r, seen, distances = region(n, shared), [], jaccard_join.Region.distances
            r.distances = lambda q, members, flat, at: (seen.append(len(members)), distances(r, q, members, flat, at))[1]  # noqa: B023
            edges = r.join()
            linked = {frozenset(e) for e in edges}
            assert linked == {frozenset((i, i + 1)) for i in range(0, n - 1, 50)}
            work.append(sum(seen))
        assert work[1] < 3 * work[0] and work[2] < 3 * work[1], work


@pytest.mark.parametrize("seed", range(4))
def test_rare_elements_hold_every_link(seed):
    """Sets at every distance around the threshold, in one region: the same components as all pairs."""
    rng = np.random.default_rng(seed)
    base = rng.choice(10**6, 60, replace=False)
    sets = []
    for _ in range(120):
        keep = base[rng.random(60) < rng.choice([0.55, 0.7, 0.85, 0.95])]
        sets.append(np.unique(np.r_[keep, rng.choice(10**6, int(rng.integers(1, 15)))]).astype(np.uint64))
    region = jaccard_join.Region(sets)
    root = list(range(len(sets)))

    def find(root, x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(root, a)] = find(root, b)
    for force in (False, True):
        region = jaccard_join.Region(sets)
        if force:
            todo, edges = region.by_rare_elements(np.arange(len(sets))), []
            for members in todo:
                own = jaccard_join.Region([sets[m] for m in members])
                edges += [(members[a], members[b]) for a, b in own.join()]
        else:
            edges = region.join()
        got = list(range(len(sets)))
        for a, b in edges:
            got[find(got, a)] = find(got, b)
        same = lambda r: {frozenset(i for i in range(len(sets)) if find(r, i) == k) for k in {find(r, j) for j in range(len(sets))}}
        assert same(got) == same(root)


def plain_fit(x, grade, decay=2e-3):
    """The same likelihood maximised by Newton steps over a dense matrix, with thresholds as free numbers."""
    n, k = x.shape
    theta = np.r_[np.zeros(k), -1.0, 0.0]  # weights, first threshold, log of the gap

    def gradient(theta):
        w, cuts = theta[:k], np.array([-np.inf, theta[k], theta[k] + np.exp(theta[k + 1]), np.inf])
        cdf = lambda v: 1 / (1 + np.exp(-np.clip(v, -500, 500)))
        high, low = cdf(cuts[grade + 1] - x @ w), cdf(cuts[grade] - x @ w)
        dh, dl = high * (1 - high) / (high - low), low * (1 - low) / (high - low)
        first = dh * (grade == 0) - dl * (grade == 1)
        second = dh * (grade == 1) - dl * (grade == 2)
        return np.r_[x.T @ (dl - dh) / n - decay * w, (first + second).mean(), second.mean() * np.exp(theta[k + 1])]

    for _ in range(60):
        g = gradient(theta)
        h = np.stack([(gradient(theta + 1e-5 * e) - gradient(theta - 1e-5 * e)) / 2e-5 for e in np.eye(k + 2)])
        step = np.linalg.solve(h, -g)
        theta = theta + step * min(1, 1 / np.abs(step).max())
        if np.abs(g).max() < 1e-10:
            break
    return theta[:k], np.array([theta[k], theta[k] + np.exp(theta[k + 1])])


@pytest.mark.parametrize("seed", [1, 2])
def test_ordinal_fit_equals_dense_newton(seed):
    rng = np.random.default_rng(seed)
    k, n = 12, 3000
    x = (rng.random((n, k)) < rng.uniform(0.1, 0.6, k)).astype(float)
    score = x @ rng.normal(0, 1.5, k) + rng.logistic(0, 1, n)
    grade = np.searchsorted(np.quantile(score, [0.25, 0.55]), score)
    row, feature = np.nonzero(x)
    used = quality_classifier.telling(np.stack([x[grade == g].sum(0) for g in range(3)], axis=1), np.bincount(grade))
    model = quality_classifier.fit(row, feature, grade, steps=1500)
    w, cuts = plain_fit(x[:, used], grade)
    assert np.abs(model.weights[used] - w).max() < 0.01 and np.abs(model.thresholds - cuts).max() < 0.01 and not np.delete(model.weights[:k], used).any()
    quick = quality_classifier.fit(row, feature, grade)
    p = lambda m: m.probabilities(x @ m.weights[:k])
    assert np.abs(p(quick) - p(model)).max() < 0.03


def test_scores_equal_plain_sums(spark, corpus):
    """Every output of the classifier from one document's own features and scalar formulas."""
    import math

    from tessella.llm import wordcodes as wc

    rows, _ = corpus
    rng = np.random.default_rng(5)
    model = quality_classifier.OrdinalModel(rng.normal(0, 0.3, 1 << quality_classifier.BITS), np.array([-1.2, 0.4]))
    docs = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = by_id(quality_classifier.classify(spark, docs, None, model=model), "score", "expected_grade", "tail_probability", "kept")
    for i, (_, text, _) in enumerate(rows):
        data = np.frombuffer((text or "").encode(), np.uint8)
        _, features = quality_classifier.hashed(data, np.array([0, len(data)]))
        assert len(set(features.tolist())) == len(features)
        words = {w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(brute.LOW))}
        assert len(features) <= len(words) + len(set(re.findall(r"[!-/:-@\[-`{-~\x00-\x08\x0e-\x1f\x7f]+", text or ""))) + 4
        score = sum(model.weights[f] for f in features)
        below = [1 / (1 + math.exp(score - t)) for t in (-1.2, 0.4)]
        want = (score, below[1] - below[0] + 2 * (1 - below[1]), 1 - below[1])
        assert np.allclose(got[i][:3], want) and got[i][3] == (got[i][2] >= 0.5)
    assert wc.ALNUM[ord("a")]
