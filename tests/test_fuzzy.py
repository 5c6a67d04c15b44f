"""The leak search against all pairs, and properties of chunks, cuts and guards."""

import difflib
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import dsp
from tessella.functions import text as tx
from tessella.operators import curate, experiments, fuzzy
from tests import oracle


def _prose(r, n):
    return "".join(r.choice(["the", "an", "er", "on", "re", "ou", "Wh", "st", "Qu", "k", "ß"]) for _ in range(n))


def test_similar_equals_all_pairs(spark):
    r = random.Random(4)
    texts = [_prose(r, n) for n in (3, 20, 40, 60, 90, 120, 150, 300, 300)] + ["", "aaaa" * 70]
    rows = []
    for i, t in enumerate(texts):
        for j, share in enumerate((0, 1, 3, 8, 16, 30)):
            v = list(t)
            for _ in range(len(v) * share // 100):
                v[r.randrange(len(v))] = r.choice("xyzT")
            rows.append((f"{i}/{j}", "".join(v)))
            rows.append((f"{i}/{j}m", "".join(v[len(v) * share // 200 :] + list(_prose(r, 2)))))
    rows += [(f"p{k}", _prose(r, k * 9)) for k in range(1, 30)]
    want = {}
    for k, a in rows:
        best = max((difflib.SequenceMatcher(None, a, b).ratio() for b in set(texts) if a and b), default=0)
        if best >= curate.SIMILAR:
            want[k] = best
    got = curate.similar_to_blocklist(spark.createDataFrame(rows, "key string, norm string"), spark.createDataFrame([(t,) for t in texts], "norm string"))
    assert {x.key: x.similarity for x in got.collect()} == want and 20 < len(want) < len(rows)


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.75, 0.95, 1.0])
def test_filters_lose_no_pair(threshold):
    """Every pair that reaches the threshold is a candidate, at lengths where runs must be shared and where
    single characters must, and where the second text is long enough to have its common characters ignored."""
    r = random.Random(int(100 * threshold))
    texts = [_prose(r, n) for n in (1, 2, 4, 9, 20, 70, 110, 240)] + ["ab" * 120, "🙂x" * 30]
    blocked, found, pairs = fuzzy.Blocked(texts, threshold), 0, 0
    for t in texts:
        for _ in range(25):
            v = list(t)
            for _ in range(r.randrange(len(v) + 1)):
                at = r.randrange(len(v) + 1)
                v[at : at + r.randrange(3)] = r.choice(["", "x", "th", t[:5]])
            row = "".join(v) or "q"
            near = {b for b, other in enumerate(texts) if difflib.SequenceMatcher(None, row, other).ratio() >= threshold}
            got = set(blocked.candidates(row).tolist())
            assert near <= got
            found, pairs = found + len(near), pairs + len(got)
            assert blocked.best(row) == max((difflib.SequenceMatcher(None, row, texts[b]).ratio() for b in near), default=0)
    assert found > 10


def test_blocks_of_texts(spark):
    """The same result whatever the texts are cut into."""
    r = random.Random(8)
    texts = [_prose(r, 30) for _ in range(40)]
    rows = spark.createDataFrame([(i, t[:-3] + "zz") for i, t in enumerate(texts)] + [(0, texts[5]), (99, ""), (98, None)], "key int, norm string").repartition(3)
    blocks = spark.createDataFrame([(t,) for t in [*texts, texts[0], "", None]], "norm string")
    one = {x.key: x.similarity for x in fuzzy.similar_to_blocklist(rows, blocks).collect()}
    assert one == {x.key: x.similarity for x in fuzzy.similar_to_blocklist(rows, blocks, block_chars=500).collect()} and one[0] == 1.0 and len(one) == 40
    assert fuzzy.similar_to_blocklist(rows, blocks.where("norm = ''")).count() == 0
    assert fuzzy.similar_to_blocklist(rows.where("key > 200"), blocks).count() == 0


@pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="the tables aren't here")
def test_leak_query_equals_all_pairs(spark):
    from tessella.plans import catalogue, further  # noqa: F401

    norm = lambda t: spark.read.parquet(f"{oracle.DATA}/{t}.parquet").withColumn("norm", tx.norm_text(F.col("text")))
    texts = {r.item_id: r.norm for r in norm("benchmark").collect()}
    rows = {f"{r.conv_id}/{r.turn}": r.norm for r in norm("conversations").collect()}
    rows |= {f"near/{i}": t[2 : 2 + len(t) // 2] + "Q#" + t[len(t) // 2 + 4 :] for i, t in texts.items()}
    want = {}
    for key, a in rows.items():
        for b in set(texts.values()) - {""}:
            m = difflib.SequenceMatcher(None, a, b)
            if a and m.real_quick_ratio() >= 0.85 and m.quick_ratio() >= 0.85 and m.ratio() >= 0.85:
                want[key] = max(want.get(key, 0), m.ratio())
    assert {r.key: r.similarity for r in catalogue.QUERIES["leak_fuzzy"](spark, oracle.DATA).collect()} == want and len(want) > 20


def values(spark, column, rows, types="t string"):
    return [x[0] for x in spark.createDataFrame(rows, types).select(column.alias("v")).collect()]


LIMIT = 10


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("甲乙丙。，！ ab?"), max_size=60), min_size=1, max_size=25))
def test_chunk_properties(spark, texts):
    """Nothing but blanks at the edges of sentences and clauses is lost, no chunk is longer than the limit, none
    is empty, and no two neighbours would fit one chunk unless a cut lies between them."""
    for text, chunks in zip(texts, values(spark, tx.split_sentences(F.col("t"), LIMIT), [(t,) for t in texts])):
        solid = lambda s: s.replace(" ", "")
        assert solid("".join(chunks)) == solid(text)
        if chunks != [text]:
            assert all(c and len(c) <= LIMIT for c in chunks)
            for a, b in zip(chunks, chunks[1:]):
                full = len(a) == LIMIT or len(b) == LIMIT  # a hard cut may border on either side
                assert full or len(a) + len(b) > LIMIT or a[-1] not in "。！？!?，"


def test_chunk_edges(spark):
    cases = {"": [""], "  ": ["  "], "one.": ["one."], "甲。乙！": ["甲。乙！"], "a" * 25: ["a" * 10, "a" * 10, "a" * 5], "甲甲甲甲，乙乙乙乙乙乙，丙": ["甲甲甲甲，", "乙乙乙乙乙乙，丙"]}
    assert values(spark, tx.split_sentences(F.col("t"), LIMIT), [(t,) for t in cases]) == list(cases.values())
    soft = values(spark, tx.split_sentences(F.col("t"), LIMIT, hard_cut=False, keep_blank=False), [("",), ("b" * 25,)])
    assert soft == [[], ["b" * 25]]


def test_cut_bounds():
    """At 1 kHz: kept segments, short gaps between them, and what is dropped."""
    x = np.linspace(0.1, 0.5, 3000)
    y, stats = dsp.cut_segments(x, 1000, [[0, 200], [260, 300], [900, 1200], [5000, 6000]])
    assert len(y) == 200 + 300 + 300 and stats["segments_in"] == 3 and stats["segments_kept"] == 2 and not stats["all_dropped"]
    assert [d["reason"] for d in stats["dropped"]] == ["too_short"] and stats["removed_s"] == 2.2
    assert y[0] == 0 and abs(y[100] - x[100]) < 1e-12 and y[199] < 1e-12 and abs(y[350] - x[350]) < 1e-12  # the gap keeps what was dropped in it
    whole, stats = dsp.cut_segments(x, 1000, [[10, 20]])
    assert stats["all_dropped"] and (whole == x).all() and dsp.cut_segments(x, 1000, None)[1]["segments_in"] == 0
    loud = np.where(np.arange(1000) % 10 == 0, 0.99, 0.1)
    assert dsp.cut_segments(loud, 1000, [[0, 500]])[1]["dropped"][0]["reason"] == "clipped"


def test_hash_gate_names_the_row(spark):
    rows = spark.createDataFrame([("a", "AB", "ab"), ("b", "cd", "ce")], "id string, actual string, expected string")
    assert experiments.require_sha(rows.where("id = 'a'"), "actual", "expected", "id").count() == 1
    with pytest.raises(Exception, match="hash mismatch: b"):
        experiments.require_sha(rows, "actual", "expected", "id").collect()


def test_json_guard(spark):
    got = values(spark, tx.is_json_object(F.col("t")), [('{"a": 1}',), ("[1]",), ("3",), ("{x",), ("",), (None,)])
    assert got == [True, False, False, False, False, False]
