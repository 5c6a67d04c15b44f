import os

import pytest

import __spark_entry__ as entry
from tessella.llm import registry
from tests import oracle
from tests.llm import brute

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="the tables aren't here")

OPERATORS = sorted(n for n in registry.QUERIES if n.startswith("op"))
COLUMNS = {
    1: ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    2: ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    3: ["doc_id", "n_shingles", "component_id"],
    5: ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    6: ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    7: ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    8: ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    9: ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    11: ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    12: ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    13: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in OPERATORS) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_and_rows(spark, name):
    n = int(name[2:].split("_")[0])
    df = registry.QUERIES[name](spark, oracle.DATA)
    docs = spark.read.parquet(f"{oracle.DATA}/{'embeddings' if n == 11 else 'documents'}.parquet").count()
    assert set(COLUMNS.get(n, ["doc_id"])) <= set(df.columns)
    kinds = dict(df.dtypes)
    assert all(kinds[c] in ("bigint", "string", "boolean") for c in COLUMNS.get(n, ["doc_id"]))
    assert df.count() == docs if n != 6 else df.select("doc_id").distinct().count() == docs


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    oracle.same(spark, oracle.connect(), registry.QUERIES[name], registry.ORACLES[name])


def test_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{oracle.DATA}/documents.parquet").collect()}
    rows = lambda n: {r.doc_id: tuple(r[c] for c in COLUMNS[int(n[2:].split('_')[0])][1:]) for r in registry.QUERIES[n](spark, oracle.DATA).collect()}
    assert {d: v[:4] for d, v in rows("op1_secret_scans").items()} == {d: brute.brute1(t) for d, t in docs.items()}
    assert rows("op5_suffix_dedup") == brute.brute5(list(docs.items()))
    assert {d: v[:6] for d, v in rows("op8_quality_rules").items()} == {d: brute.brute8(t) for d, t in docs.items()}
    assert {d: v[:5] for d, v in rows("op9_pii").items()} == {d: brute.brute9(t) for d, t in docs.items()}


def test_byte_pairs_equal_the_library(spark):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{oracle.DATA}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.QUERIES["op13_byte_pairs"](spark, oracle.DATA).collect()} == want
