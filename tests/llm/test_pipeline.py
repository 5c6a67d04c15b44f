"""The pipeline's stages against brute force, and on odd rows."""

import hashlib

import corpus_pipeline as cp
from tessella.llm import quality_rules
from tessella.session import materialize
from tests.llm import brute


def test_stages_equal_brute_force(spark, corpus, frames, tmp_path):
    rows, bench = corpus
    frames[1].write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frames[0].selectExpr("*", "'s' as source", "cast(length(text) as long) as n_chars")
    held = {}
    for name, stage in cp.STAGES[:-1]:
        before = docs
        docs = materialize(spark, stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == before.columns
        held[name] = {r.doc_id: r for r in docs.collect()}
    text = {name: {d: r.text for d, r in rs.items()} for name, rs in held.items()}
    assert set(text["quality_rules"]) == {r.doc_id for r in quality_rules.quality_rules(spark, frames[0]).where("kept").collect()}
    lines = {d: h for d, _, _, h in brute.brute2(list(text["quality_rules"].items()))}
    assert {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in text["line_dedup"].items()} == lines
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in held["line_dedup"].values())
    near = brute.brute3(list(text["line_dedup"].items()))
    assert set(text["jaccard_join"]) == {d for d, v in near.items() if v[1] == d}
    hits = brute.brute7(list(text["jaccard_join"].items()), bench)
    assert set(text["decontaminate"]) == {d for d, v in hits.items() if not v[4]}
    assert {r.doc_id for r in cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == set(text["decontaminate"])


def test_run_on_odd_and_empty_tables(spark, frames, odd, none, tmp_path):
    for name, table in (("odd", odd), ("none", none)):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        frames[1].write.parquet(str(tmp_path / name / "benchmark.parquet"))
        out = cp.run(spark, str(tmp_path / name))
        assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        assert (out.count() == 0) == (name == "none")
    docs = spark.read.parquet(str(tmp_path / "odd/documents.parquet"))
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path / "odd")).columns == docs.columns


def test_unlike_texts_with_one_id_are_kept_apart(spark):
    """Only near copies go: rows that share an id, or have none, are joined by their texts."""
    prose = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(5, prose("a")), (5, prose("b")), (5, prose("b")), (3, prose("c")), (7, prose("b") + " more"), (None, prose("d")), (None, prose("a")), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as source")
    out = cp.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    assert got == sorted((str(d), str(t)) for d, t in (rows[0], rows[1], rows[3], rows[5], rows[7]))


def test_stages_without_optional_columns(spark, frames, tmp_path):
    """Tables of only an id and a text pass through."""
    frames[1].write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frames[0].select("doc_id", "text")
    for name, stage in cp.STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text"] and docs.count() > 0


def test_stage_list():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontaminate", "packing"] and cp.ORACLE_SQL is None
