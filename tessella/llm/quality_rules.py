"""Quality rules: tokeniser fertility with rejection bands per language or script.

Every whole text is encoded with a public piece vocabulary. Three measures per document (characters
per token, share of byte-fallback tokens, entropy of its token distribution) must lie within the
band of the document's language and length class (half octaves of tokens: entropy grows with length).
Bands come from statistics over all documents of the language that pass the base rule.

Every document that passes the base rule is judged, whatever its length and however rare its language:
where fewer than ``min_docs`` documents share its language and length class, the band is that of the next
wider choice that has so many: the language's octave, all languages' half octave and octave, the
language's and all languages' two octaves, and at last all documents.

Cases: a null or empty text has no words and fails the base rule; a null language is replaced by the
dominant script, of scripts with equally many letters by the first in the order of their code points;
a measure on the edge of its band is inside; texts of any length are encoded whole;
repeated rows are judged row by row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import wordcodes as wc
from tessella.session import materialize

#: Documents that a band rests on; only the last choice of band may rest on fewer.
MIN_DOCS = 30
#: Languages whose bands are sent to all workers; where there are more, the bands are joined by shuffle.
MAX_SENT = 10_000
#: A band reaches this many robust deviations from the median, below and above (characters per token,
#: byte share, bits). Set from the labelled documents of sf0.1 and check_s: junk has low entropy, while
#: good texts of mixed languages lie up to a bit above their language's median.
WIDTH = ((8.0, 8.0), (12.0, 12.0), (5.0, 12.0))
#: No band is narrower than these half-widths; labelled good documents lie within 0.05 in byte share.
FLOOR = ((0.1, 0.1), (0.05, 0.05), (0.3, 1.0))

SCHEMA = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: First code points of the scripts told apart when no language is given.
_SCRIPTS = ((0x0370, "latin"), (0x0400, "greek"), (0x0530, "cyrillic"), (0x0E00, "other"), (0x3040, "thai"), (0x3100, "kana"), (0x10000000, "cjk"))


def script_of(text: str) -> str:
    """The script of most letters; 'none' without letters."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    points = points[(points >= 0xC0) | ((points | 32) >= 97) & ((points | 32) <= 122)]
    if not len(points):
        return "none"
    at = np.searchsorted([x[0] for x in _SCRIPTS], points, side="right")
    return "script:" + _SCRIPTS[int(np.bincount(at, minlength=len(_SCRIPTS)).argmax())][1]


def base_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the base rule for the rows of one slice."""
    rows = len(off) - 1
    start, end, row, code = wc.words(data, off, wc.SPACED, fold=False)
    per = np.bincount(row, minlength=rows)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = np.zeros(rows, np.int64)
    np.add.at(chars, row, lead[end] - lead[start])
    sym = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    win, at = wc.windows(code, row, 8)
    repeat = np.zeros(rows, np.int64)
    if len(win):
        keyed = wc.mix(win ^ (row[at].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
        order = np.argsort(keyed, kind="stable")
        same = keyed[order][1:] == keyed[order][:-1]
        twice = np.zeros(len(win), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(code) + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + 8, -1)
        repeat = np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=rows)
    dup = np.zeros(rows, np.int64)
    blob = data.tobytes()
    for i in range(rows):
        lines = [x for x in blob[off[i] : off[i + 1]].split(b"\n") if x.strip()]
        dup[i] = len(lines) - len(set(lines))
    return {"n_words": per, "word_chars": chars, "n_symbols": sym[off[1:]] - sym[off[:-1]], "n_dup_lines": dup, "n_repeat_words": repeat}


def _fertility(model: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    fallback = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])

    def measure(texts: list[str]):
        out = np.zeros((len(texts), 4))
        for i, ids in enumerate(sp.encode(texts, num_threads=1)):
            n = len(ids)
            if n:
                ids = np.asarray(ids)
                counts = np.unique(ids, return_counts=True)[1] / n
                out[i] = n, len(texts[i]) / n, fallback[ids].mean(), -(counts * np.log2(counts)).sum()
        return out

    return measure


def measures(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row of counts and fertility measures per document row."""
    wc.prepare(spark)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def run(batches):
        measure = _fertility(vocabulary)
        for batch in batches:
            data, off = wc.column_bytes(batch.column(1))
            for lo, hi in wc.slices(off):
                counts = base_counts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                texts = pc.fill_null(batch.column(1).slice(lo, hi - lo), "").to_pylist()
                m = measure(texts)
                langs = [x if x else script_of(t) for x, t in zip(batch.column(2).slice(lo, hi - lo).to_pylist(), texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(langs, pa.string()), *(pa.array(v.astype(np.int64)) for v in counts.values()), pa.array(m[:, 0].astype(np.int64)), *(pa.array(m[:, j]) for j in (1, 2, 3))],
                    names=_NAMES,
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang")).mapInArrow(run, SCHEMA)


_NAMES = [x.split()[0] for x in SCHEMA.split(",")]
_MEASURES = ("chars_per_token", "byte_share", "token_entropy")


_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"
#: Choices of band from narrow to wide: whether of the own language, and how many half octaves it spans
#: (none: all lengths).
_CHOICES = ((True, 1), (True, 2), (False, 1), (False, 2), (True, 4), (False, 4), (False, None))


def _class(span: int | None) -> Column:
    """The length class among those of ``span`` half octaves, told apart from the classes of other spans."""
    return F.lit(0) if span is None else F.lit(1000 * span) + F.floor(F.log2(F.greatest("n_tokens", F.lit(1))) * 2 / span).cast("int")


def bands(measured: DataFrame, min_docs: int) -> DataFrame:
    """Per language a map from length class to the quartiles of each measure, over all documents of the
    language that pass the base rule; languages are rows, never collected. The row without a language is
    the pool of all of them, whose class of all lengths has no least number of documents."""
    judged = measured.where(f"not ({_FAILED})")
    spans = sorted({s or 0 for _, s in _CHOICES})
    each = judged.select(F.explode(F.array("lang", F.lit(None).cast("string"))).alias("lang"), F.array(*(_class(s or None) for s in spans)).alias("classes"), *_MEASURES)
    each = each.select("lang", F.explode("classes").alias("class"), *_MEASURES)
    quartiles = F.struct(*(F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(m) for m in _MEASURES))
    classes = each.groupBy("lang", "class").agg(F.count("*").alias("n_docs"), quartiles.alias("q")).where(f"n_docs >= {min_docs} or lang is null and class = 0")
    return classes.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("class", "q"))).alias("own"))


def quality_rules(
    spark: SparkSession,
    docs: DataFrame,
    vocabulary: str | None = None,
    min_docs: int = MIN_DOCS,
    width: tuple[tuple[float, float], ...] = WIDTH,
) -> DataFrame:
    """Counts, measures, ``base_failed`` and ``kept`` per document row."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    measured = materialize(spark, measures(spark, docs, vocabulary), "quality")
    band = materialize(spark, bands(measured, min_docs), "bands")
    pool = band.where("lang is null").select(F.col("own").alias("pool")).scalar()
    joined = measured.join(F.broadcast(band) if band.count() <= MAX_SENT else band, "lang", "left").withColumn("pool", pool)
    choice = lambda own, span: F.try_element_at(F.col("own" if own else "pool"), _class(span))
    joined = joined.withColumn("q", F.coalesce(*(choice(*c) for c in _CHOICES)))
    inside = F.lit(True)
    for m, widths, floors in zip(_MEASURES, width, FLOOR):
        q = F.col("q")[m]
        below, above = (F.greatest((q[2] - q[0]) / 2 * w, F.lit(f)) for w, f in zip(widths, floors))
        inside = inside & F.col(m).between(q[1] - below, q[1] + above)
    failed = F.expr(_FAILED)
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.coalesce(inside, F.lit(False))).alias("kept"),
        "n_tokens", "chars_per_token", "byte_share", "token_entropy",
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
