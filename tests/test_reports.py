import numpy as np
from pyspark.sql import functions as F

from tessella.operators import reports


def test_roles_orders_hashes(spark):
    p = spark.createDataFrame([("first/zero_shot_1.wav",), ("original_rain.wav",), ("third_codec.wav",)], "p string")
    assert [tuple(r[0]) for r in p.select(reports.path_role(F.col("p"))).collect()] == [("first", "zero_shot"), ("original", "original"), ("third", "codec_roundtrip")]
    assert [r.p for r in reports.originals_first(p, "p").collect()][-1] == "first/zero_shot_1.wav"
    b = spark.createDataFrame([("z",), ("second",), ("a",), ("third",)], "b string")
    assert [r.b for r in reports.display_order(b, "b", ("third", "second")).collect()] == ["third", "second", "a", "z"]
    c = spark.createDataFrame([({"in": {"t": "h"}},)], "codec map<string,map<string,string>>")
    assert [tuple(r) for r in reports.codec_hashes(c).collect()] == [("codec/in:t", "h")]
    r = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "_ord int, rated_at string")
    assert [x._ord for x in reports.rated_order(r).collect()] == [2, 3, 1]


def test_identity_and_contract(spark):
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "2", "a": "1"}, {"a": "1", "b": "3"})], "x map<string,string>, y map<string,string>, z map<string,string>")
    x, y, z = m.select(*(reports.page_identity(F.col(c)) for c in "xyz")).first()
    assert x == y != z
    pages = spark.createDataFrame([("n", "p1", ["a", "b"], ["B", "A"]), ("n", "p2", ["a"], ["A", "B"]), ("k", "p3", ["zz"], ["A"])], "name string, review_id string, cells array<string>, order array<string>")
    assets = spark.createDataFrame([("a", "x/a.wav", "ha"), ("b", "x/b.wav", "hb")], "asset string, path string, sha256 string")
    got = {r.name: r for r in reports.build_contracts(pages, assets).collect()}
    assert got["n"].complete and got["n"].asset_hashes == {"a": "ha", "b": "hb"} and got["n"].review_ids == ["p1", "p2"] and got["n"].blind_orders["p1"] == "B|A"
    assert not got["k"].complete and got["k"].asset_hashes == {}


def test_helpers(spark):
    d = spark.createDataFrame([("k", ["x", "y"])], "k string, c array<string>")
    assert [(r.pos, r.seed, r.gap_s) for r in reports.chunk_plan(d, "k", "c", F.lit(42)).collect()] == [(0, 42, 0.0), (1, 43, 0.2)]
    one = spark.range(1).select(reports.html_escape(F.lit("<a&'\">")), reports.script_json(F.lit("</s>")), reports.yes_no(F.lit(None).cast("boolean")), reports.yes_no(F.lit(True))).first()
    assert tuple(one) == ("&lt;a&amp;&#x27;&quot;&gt;", "\\u003c/s>", "?", "yes")
    a = spark.createDataFrame([([("", 1), ("f", 2)],)], "a array<struct<audio:string,i:int>>")
    assert a.select(reports.anchor_audio(F.col("a"))["i"]).first()[0] == 2
    s = reports.logical_ids(spark.createDataFrame([("p",), ("q",)], "path string"), spark.createDataFrame([("p", "P")], "path string, id string"))
    assert {(r.id, r.known) for r in s.collect()} == {("P", True), ("q", False)}
    assert spark.range(1).select(reports.utc_stamp(True)).first()[0].endswith("Z")


def test_png_chain_scorer(spark):
    x = np.sin(np.arange(4000) / 3)
    raw = reports.spectrogram_png(x, 8000)
    assert raw[:4] == b"\x89PNG" and int.from_bytes(raw[20:24], "big") == 513
    side = lambda v, r: spark.createDataFrame([("c", r, list(map(float, v)))], "case_id string, sr int, x array<double>")
    noise = np.random.default_rng(0).normal(size=4000)
    out = reports.codec_chain(side(noise, 8000), side(0.5 * noise, 8000), side(noise, 8000)).first()
    assert abs(out.original_vs_input.gain - 2) < 1e-6 and out.original_vs_roundtrip.corr > 0.999

    def length(frames):
        for pdf in frames:
            yield pdf.assign(n=pdf["t"].str.len())

    reports.register_scorer("length", length)
    assert reports.score(spark.createDataFrame([("abc",)], "t string"), "length", "t string, n long").first().n == 3


def test_messages(spark):
    rows = [(1, "a", "generate", None, None, None, None), (2, None, None, "progress", None, None, None), (3, "b", "health", None, None, None, None), (4, "a", None, None, True, "r", None), (5, "zz", None, None, True, "stray", None)]
    m = spark.createDataFrame(rows, "_ord int, id string, method string, event string, ok boolean, result string, error string")
    assert {r.id: (r.method, r.ok) for r in reports.correlate_messages(m).collect()} == {"a": ("generate", True), "b": ("health", None)}
    t = spark.createDataFrame([(1, "s", "idle"), (2, "s", "failed"), (1, "u", "idle")], "_ord int, session string, state string")
    assert {r.session: r.ended for r in reports.session_states(t).collect()} == {"s": True, "u": False}


def test_report_lines_in_order(spark, tmp_path):
    from tessella.operators import documents as d

    rows = spark.createDataFrame([(i, f"a|{i}\nb", i / 8, None if i % 2 else "x") for i in range(200)], "_ord long, name string, v double, bad string").repartition(5)
    table = d.Table("Rows", rows, "_ord", {"name": d.code(F.col("name")), "value": d.fixed(F.col("v"), 2), "none": d.plain(F.lit(None), "-")}, when_bad=F.when(F.col("bad").isNotNull(), F.concat(F.lit("error: "), "bad")))
    lines = d.render(spark, [d.Text("# T", ""), table, d.Bullets("More", rows, "_ord", F.col("name").substr(1, 1)), d.Text("end")])
    d.write(lines, str(tmp_path / "r"), 4)
    got = [x for n in sorted((tmp_path / "r").glob("part-*")) for x in n.read_text().split("\n")[:-1]]
    body = [f"| `a\\|{i} b` | {round(i / 8, 2):.2f} | - |" if i % 2 else f"| `a\\|{i} b` | error: x |  |" for i in range(200)]
    assert got == ["# T", "", "## Rows", "", "| name | value | none |", "|---|---|---|", *body, "", "## More", "", *["- a"] * 200, "", "end"]
    numbers = spark.createDataFrame([(2.675,), (-0.125,), (1e9,), (None,), (float("nan"),), (float("inf"),)], "x double").select(d.fixed(F.col("x"), 2), d.fixed(F.col("x"), 0)).collect()
    assert [tuple(r) for r in numbers] == [("2.67", "3"), ("-0.12", "0"), ("1000000000.00", "1000000000"), ("", ""), ("", ""), ("", "")]


def test_gate_and_pairs_reports(spark):
    from tessella.operators import documents as d

    cases = spark.createDataFrame([(0, "a", "clone", "o/a.wav", "ok", 1.25, None, None), (1, "b", "zero", None, None, None, "", "no model")], "_ord int, backend string, kind string, output string, status string, wall_seconds double, error string, reason string")
    names = [c for _, c, _ in d.MEASURES]
    measures = spark.createDataFrame([(0, "a.wav", None, *[24000.0, *[0.0625] * 10]), (1, "b.wav", "ValueError: bad", *[None] * 11)], "_ord int, sample string, error string, " + ", ".join(f"{n} double" for n in names))
    text = [r.line for r in d.gate_report(spark, "e1", [("seed", "7")], cases, measures).orderBy("section", "place").collect()]
    assert text[:4] == ["# Gate report — e1", "", "- seed: 7", ""] and "| a | clone | `o/a.wav` | ok | 1.2 |  |" in text and "| b | zero | `` | ? |  | no model |" in text
    assert "| `a.wav` | 24000 | 0.06 | 0.06 | 0.1 | 0.1 | 0.062 | 0.062 | 0.062 | 0.1 | 0.062 | 0.062 |" in text and "| `b.wav` | error: ValueError: bad |  |  |  |  |  |  |  |  |  |  |" in text
    pairs = spark.createDataFrame([(0, "p", "t", 3, "x", "y"), (1, "q", "t", 3, "x", "gone")], "_ord int, pair_id string, text_id string, seed int, left string, right string")
    runs = spark.createDataFrame([(0, "x", "P0", 3, "ok", None, 1.5, "abcdef012345", None), (1, "y", "P2", 3, "failed", 2, None, None, None)], "_ord int, case_id string, prompt_id string, seed int, status string, retry_count int, duration_s double, output_sha256 string, reused_from string")
    var = spark.createDataFrame([(0, "abcdef0123456789", ["x", "z"], ["grit"])], "_ord int, output_sha256 string, case_ids array<string>, divergent array<string>")
    text = [r.line for r in d.pairs_report(spark, "Paired", [], pairs, runs, var).orderBy("section", "place").collect()]
    assert "| p | t | 3 | new `abcdef0123` 1.5s | failed |" in text and "| q | t | 3 | new `abcdef0123` 1.5s | None |" in text
    assert "| y | P2 | 3 | failed | 2 | - | `` |" in text and "- `abcdef012345`: x, z differ in grit" in text


def test_places_of_dealt_rows(spark):
    """Ranges that are sampled twice differ: places must come from one dealing of the rows."""
    from tessella.plans.further import _placed

    n = 400_000
    rows = spark.range(n, numPartitions=4).select("id", ((F.col("id") * 7919) % n).alias("v"), F.repeat(F.lit("x"), 40).alias("w"))
    placed = _placed(rows.orderBy("v", "w"), "id")
    assert placed.count() == n
    assert placed.where(F.col("place") != (F.col("id") * 7919) % n + 1).count() == 0
