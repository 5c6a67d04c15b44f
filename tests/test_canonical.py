"""Rounding, number text and canonical JSON against the standard library."""

import hashlib
import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import canonical
from tessella.operators import reports

EDGES = [0.0, -0.0, 1.0, -1.5, 2.675, 1.005, 0.125, 0.375, 2.5, -0.5, 1e15, 1e16, 123456789012345680.0, 1e-4, 1e-5, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 8.41e21, 2e23, 2.0**-44, 999999999999999.9, 9007199254740993.0, -0.001]


def doubles(seed, n=1500):
    r = random.Random(seed)
    bits = [struct.unpack("d", struct.pack("Q", r.getrandbits(64)))[0] for _ in range(n)]
    return EDGES + [x for x in bits if math.isfinite(x)] + [r.uniform(-1e4, 1e4) for _ in range(n)] + [r.randint(-99999, 99999) / 10 ** r.randint(0, 6) for _ in range(n)] + [(2 * k + 1) / 16 for k in range(n)]


def test_shortest_text_of_doubles(spark):
    values = [*doubles(1), float("inf"), -float("inf"), float("nan")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    got = {r.i: r.s for r in df.select("i", canonical.shortest(F.col("x")).alias("s")).collect()}
    assert got == {i: json.dumps(x) for i, x in enumerate(values)}


@pytest.mark.parametrize("digits", [0, 1, 2, 3, 6])
def test_rounding_on_the_binary_value(spark, digits):
    values = doubles(2 + digits)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)] + [(-1, None)], "i int, x double")
    got = {r.i: r.y for r in df.select("i", canonical.round_half_even(F.col("x"), digits).alias("y")).collect()}
    assert got.pop(-1) is None
    for i, x in enumerate(values):
        assert got[i] == round(x, digits) and math.copysign(1, got[i]) == math.copysign(1, round(x, digits)), x


DDL = "title string, n bigint, score double, ok boolean, tags array<string>, cells array<struct<id:bigint,w:double,note:string>>, orders map<string,array<string>>, empty array<int>, nested map<string,map<string,double>>"


def page(r):
    text = lambda: "".join(r.choice(["a", "Z", "é", "漢", "🙂", "\"", "\\", "/", "\n", "\t", "\x00", "\x1f", "\x7f", "\u2028", "<", " "]) for _ in range(r.randint(0, 8)))
    some = lambda f: [f() for _ in range(r.randint(0, 3))]
    maybe = lambda f: None if r.random() < 0.2 else f()
    number = lambda: r.choice([0.1, 1e22, -2.5e-7, 3.0, r.random()])
    return {
        "title": maybe(text), "n": maybe(lambda: r.randint(-(10**18), 10**18)), "score": maybe(number), "ok": maybe(lambda: r.random() < 0.5), "tags": maybe(lambda: some(lambda: maybe(text))),
        "cells": maybe(lambda: some(lambda: {"id": r.randint(0, 9), "w": maybe(number), "note": maybe(text)})), "orders": maybe(lambda: {text(): maybe(lambda: some(text)) for _ in range(3)}),
        "empty": [], "nested": maybe(lambda: {text(): {text(): number()} for _ in range(2)}),
    }


def test_canonical_json_of_nested_pages(spark):
    r = random.Random(6)
    pages, PAGE = [page(r) for _ in range(150)], T.StructType.fromDDL(DDL)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("p", PAGE)]))
    out = df.select("i", canonical.canonical_json(F.col("p"), PAGE).alias("j"), reports.page_identity(F.col("p"), PAGE).alias("h")).collect()
    for x in out:
        want = json.dumps(pages[x.i], ensure_ascii=False, sort_keys=True)
        assert x.j == want and x.h == hashlib.sha256(want.encode()).hexdigest()


def test_absent_fields_and_odd_kinds(spark):
    kind = T.StructType.fromDDL("b int, a string, c struct<x:int>")
    df = spark.createDataFrame([((1, None, (None,)),), (None,)], T.StructType([T.StructField("p", kind)]))
    both = [tuple(r) for r in df.select(canonical.canonical_json(F.col("p"), kind), canonical.canonical_json(F.col("p"), kind, absent=True)).collect()]
    assert both == [('{"a": null, "b": 1, "c": {"x": null}}', '{"b": 1, "c": {}}'), ("null", "null")]
    with pytest.raises(TypeError, match="binary"):
        canonical.canonical_json(F.col("p"), T.BinaryType())
    with pytest.raises(ValueError):
        canonical.round_half_even(F.col("x"), 16)
