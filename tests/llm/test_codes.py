"""Vector codes, fill-in-middle and byte pairs against plain restatements, and their results for odd rows."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import byte_pairs, fill_in_middle, vector_codes

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def lloyd(vectors, parts, entries, rounds, scale=256):
    """Plain rounds over every pair of part and entry: codes, errors and codebooks."""
    x = np.floor(np.array(vectors, float) * scale).astype(np.int64)
    cuts = [x.shape[1] * p // parts for p in range(parts + 1)]
    codes, errors, books = [], np.zeros(len(x), np.int64), []
    for a, b in zip(cuts, cuts[1:]):
        own, book = x[:, a:b], x[:entries, a:b].copy()
        for _ in range(rounds + 1):
            d = ((own[:, None] - book[None]) ** 2).sum(axis=2)
            near, last = d.argmin(axis=1), book.copy()
            book = np.array([own[near == e].sum(axis=0) // (near == e).sum() if (near == e).any() else book[e] for e in range(len(book))])
        codes.append(near)
        errors += d.min(axis=1)
        books.append(last)
    return ["".join(f"{c:02x}" for c in row) for row in np.array(codes).T], errors.tolist(), books


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("parts,entries,rounds", [(4, 8, 2), (3, 5, 6), (1, 1, 2), (8, 64, 3)])
def test_heaps_equal_plain_rounds(spark, monkeypatch, parts, entries, rounds):
    monkeypatch.setattr(vector_codes, "BLOCK", 64)
    r = np.random.default_rng(5)
    vectors = np.concatenate([r.normal(m, 0.2, (90, 10)) for m in (-1, 0, 2)] + [np.zeros((30, 10)), np.repeat(r.normal(0, 1, (1, 10)), 20, axis=0)])
    r.shuffle(vectors)
    out, books = vector_codes.compress(spark, frame(spark, [(i, v.tolist(), None) for i, v in enumerate(vectors)]).repartition(3), parts=parts, entries=entries, rounds=rounds)
    codes, errors, want = lloyd(vectors, parts, entries, rounds)
    got = {x.vec_id: (x.code, x.error) for x in out.collect()}
    assert got == dict(enumerate(zip(codes, errors)))
    assert all((a == b).all() for a, b in zip(books.entries, want))


def test_repair_measures_only_violated_parts():
    """Parts far nearer to their entry than to any other are left alone, and the heaps stay exact."""
    r = np.random.default_rng(2)
    centres = r.integers(-4000, 4000, (16, 8))
    rows = np.concatenate([centres, *(centres + r.integers(-20, 20, (16, 8)) for _ in range(40))])
    books = vector_codes.Codebooks(rows[:16].copy(), 2)
    block = vector_codes.Block(rows, books.cuts, 16)
    block.start(books)
    for _ in range(4):
        books.move(block.sums, block.counts)
        block = vector_codes.Block.unpacked(dict(zip(["vectors", "width", "owner", "parts", "keys", "ends", "sums"], block.packed())), books.cuts, 16)
        assert block.repair(books) < len(rows) // 4
        for p in range(2):
            d = vector_codes.distances(rows[:, block._at(p)], books.entries[p])
            assert (block.owner[p] == d.argmin(axis=1)).all()
            for e in range(16):
                keys, members = block.keys[p * 16 + e], block.parts[p * 16 + e]
                assert (np.diff(keys) >= 0).all() and sorted(members) == np.flatnonzero(block.owner[p] == e).tolist()
                assert (block.sums[e, block._at(p)] == rows[block.owner[p] == e][:, block._at(p)].sum(axis=0)).all()


def test_large_components_are_exact():
    rows = np.array([[1 << 24, -(1 << 24)], [(1 << 24) - 1, 5]])
    assert vector_codes.distances(rows, rows)[0].tolist() == [0, 1 + ((1 << 24) + 5) ** 2]


def test_vectors_with_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(i, [i / 10, -i / 7, 1e9, 0.0], i % 2) for i in range(6)]
    rows = [*fine, fine[2], (None, [1.0, 2.0, 3.0, 4.0], None), (None, [1.0, 2.0, 3.0, 4.0], 1), (20, None, 1), (21, [], 1), (22, [1.0, None, 1.0, 1.0], 1), (23, [nan, 0.0, 0.0, 0.0], 1), (24, [0.0, -inf, 0.0, 0.0], 0), (25, [1.0], 1)]
    df = frame(spark, rows)
    for c in ("code", "error", "ids", "of", "sums"):
        df = df.withColumn(c, F.lit("clash"))
    codes, books = vector_codes.compress(spark, df, parts=3)
    out = vector_codes.with_label_errors(spark, codes).collect()
    assert sorted((x.vec_id is None, x.vec_id) for x in out if x.vec_id is not None) == [(False, i) for i in (0, 1, 2, 2, 3, 4, 5)] and len(out) == 9
    assert [len(b) for b in books.entries] == [7] * 3 and all(x.error == 0 for x in out)
    assert {x.label: x.label_error for x in out} == {0: 0, 1: 0, None: 0}
    codes, books = vector_codes.compress(spark, df.where("vec_id > 19"))
    assert books is not None and codes.count() == 1
    codes, books = vector_codes.compress(spark, df.where("vec_id in (20, 21, 22, 23)"))
    assert books is None and vector_codes.with_label_errors(spark, codes).count() == 0


def test_first_vectors_skip_repeated_ids(spark):
    rows = [(0, [2.0, 2.0], 0)] * 9 + [(0, [1.0, 1.0], 0), (1, [3.0, 3.0], 0), (2, [4.0, 4.0], 0)]
    assert vector_codes.first_vectors(vector_codes.kept(frame(spark, rows)), 3) == [[1.0, 1.0], [3.0, 3.0], [4.0, 4.0]]


def middle(doc_id, text):
    """The contract's words in plain Python."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, corpus, odd, none):
    texts = ["<", "<<P", "P>S>M>", "<P", "a<P>b", "<S><M>", "🙂é漢x🙂", "a\r\n\tb\x00c", "S><M", "> <P", "<M" * 40]
    rows = [(d, t) for d, t, _ in corpus[0]] + [(1000 + 50 * i + j, t) for i, t in enumerate(texts) for j in range(50)] + [(None, "null id stays"), (None, None)]
    out = fill_in_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    out = out.select("doc_id", "n", "form", F.length("prefix"), F.length("middle"), "output", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()
    order = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, out), key=order) == sorted(((d, *middle(d, t), t or "") for d, t in rows), key=order)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(odd).count() == len(corpus[0]) + 4 and fill_in_middle.fill_in_middle(none).count() == 0


def test_fill_in_middle_shares(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    count = {r.form: r["count"] for r in fill_in_middle.fill_in_middle(rows, seed=7, arranged=50, suffix_first=50).groupBy("form").count().collect()}
    assert 900 < count["plain"] < 1100 and abs(count["psm"] - count["spm"]) < 150


def test_fill_in_middle_runs_no_python(spark, frames):
    plan = fill_in_middle.fill_in_middle(frames[0])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan.replace("ExistingRDD", ""))


PATH = public.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return byte_pairs.Encoder(PATH, public.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aaeeinorst ' \n\t=<>|"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_equal_the_library(text):
    encoder = byte_pairs._encoder(PATH, public.PATTERN)
    assert encoder.ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_ids_of_joined_tokens(encoder):
    """Texts glued from tokens, where the longest match is often not the right one."""
    r, words = random.Random(4), [t for t in LIBRARY.get_vocab() if t.isalpha() and t.isascii()]
    wrong = 0
    for _ in range(3000):
        text = "".join(r.choice(words) for _ in range(r.randint(1, 6)))
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        wrong += encoder.vocabulary.encode(text) != [t for _, t in encoder.vocabulary.find.iter_long(text)]
        assert encoder.ids(text).tolist() == want
    assert wrong > 100


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 90_000, "=" * 70_001, "ab" * 90_000, "theing" * 30_000, "漢" * 40_000, "<|endoftext|>" * 5000, "x <|endoftext|> y<|endo", "՘࢏ a", "\x1c\x85　"])
def test_ids_of_long_and_odd_texts(encoder, text):
    assert encoder.ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_pieces_of_every_character(encoder):
    """The pattern splits as the file's own splitter does around every code point."""
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    own = LIBRARY.pre_tokenizer.pre_tokenize_str
    for lo in range(0, len(points), 40_000):
        text = "".join(f"a{chr(c)}1{chr(c)}! " for c in points[lo : lo + 40_000] if not encoder.newer[c])
        assert encoder.split(text) == [text[x:y] for _, (x, y) in own(text)]


def test_byte_pairs(spark, corpus, odd, none, monkeypatch):
    monkeypatch.setattr(byte_pairs.wc, "SLICE_BYTES", 2000)
    docs = spark.createDataFrame([(d, t) for d, t, _ in corpus[0]], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.ids, r.text) for r in byte_pairs.decode(spark, byte_pairs.encode(spark, docs)).collect()}
    assert got == {d: (LIBRARY.encode(t or "", add_special_tokens=False).ids, t or "") for d, t, _ in corpus[0]}
    out = byte_pairs.decode(spark, byte_pairs.encode(spark, odd))
    assert out.count() == len(corpus[0]) + 4 and out.where("doc_id is null").count() == 2
    assert byte_pairs.decode(spark, byte_pairs.encode(spark, none)).count() == 0


def test_decoding_of_any_ids(spark):
    r = random.Random(9)
    lists = [[r.randrange(50257) for _ in range(r.randint(0, 30))] for _ in range(200)] + [[50256, 0, 50256], [128, 200], None, [60000, -3, 64]]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")
    got = {x.doc_id: x.text for x in byte_pairs.decode(spark, df).collect()}
    assert got == {i: LIBRARY.decode([t for t in x or [] if 0 <= t < 50257], skip_special_tokens=False) for i, x in enumerate(lists)}


def test_known_tables_stay_bounded(monkeypatch):
    monkeypatch.setattr(byte_pairs, "MAX_KNOWN", 10)
    small = byte_pairs.Encoder(PATH, public.PATTERN)
    text = " ".join(f"wor{i}thing{i}s" for i in range(200))
    assert small.ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert len(small.known) <= 10 and len(small.known.old) <= 10 and len(small.vocabulary.pairs) <= 10
