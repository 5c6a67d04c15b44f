"""Harmonic packing: pieces fall into reciprocal-capacity classes and bins of a class hold a fixed
number of pieces, so bins are filled independently wherever the pieces lie.

A document is cut into whole sequences, then greedily into the largest sizes ``capacity // j`` that
still fit (the remainder shrinks quadratically, so few pieces result) and one last crumb. Every class
holds pieces of one exact length and its bins take ``capacity // length`` of them. Pieces are numbered
within (class, bucket) pairs, a bucket being what one task tokenised, and shifted by the counts of the
earlier buckets; no task sees a class whole, and the ids stay where they were written. The pieces left over, fewer than one bin per class and so bounded by the capacity alone, are
packed best-fit decreasing.

Cases: a null or empty text is the end id alone; a text of any length is encoded whole and cut; repeated
rows are packed each; pieces of one length and bucket are numbered in the order they were cut, and of bins
with equal room the one opened first takes the piece; a null ``doc_id`` stays null; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import wordcodes as wc
from tessella.session import materialize

CAPACITY = 2048
END_ID = 1
#: Classes 1..CLASSES have size capacity // j; a shorter remainder is a crumb in a class of its length.
CLASSES = 32

#: Rows of piece counts that are sent to all workers; where there are more, they are joined by shuffle.
MAX_SENT = 500_000

_PIECES = "doc_id long, start long, length long, doc_tokens long, bucket long, rank long, ids binary"


def cuts(length: int, capacity: int = CAPACITY, classes: int = CLASSES) -> list[int]:
    """Lengths of the pieces of a document of ``length`` ids, in order."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    sizes = sorted({capacity // j for j in range(1, classes + 1)} - {0}, reverse=True)
    while rest:
        fit = next((s for s in sizes if s <= rest), rest)
        out.append(fit)
        rest -= fit
    return out


#: White space on which the rank encoder's pattern may overflow its stack.
_LONG_BLANK = re.compile(r"\s{1000}")


class Encoder:
    """Ids of whole texts. Texts without a special token's string or very long white space go through the
    rank file of the same vocabulary, which gives the same ids several times faster; the rest through the
    tokenizer file."""

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.vocabulary, self.full = vocabulary, None

    def ids(self, text: str) -> np.ndarray:
        if "<|" not in text and not _LONG_BLANK.search(text):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.vocabulary)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")


def pieces(spark: SparkSession, docs: DataFrame, vocabulary: str, ranks: str, pattern: str, capacity: int, end_id: int) -> DataFrame:
    """Tokenise every whole text and cut it; one row per piece with its ids (32-bit, little-endian) and its
    rank among the pieces of its length in its task."""
    wc.prepare(spark)

    def run(batches):
        encoder, known, seen = Encoder(vocabulary, ranks, pattern), {}, {}
        bucket = TaskContext.get().partitionId()
        tail = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            _, off = wc.column_bytes(batch.column(1))
            for lo, hi in wc.slices(off):
                out: list[list] = [[] for _ in range(7)]
                for doc, text in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), pc.fill_null(batch.column(1).slice(lo, hi - lo), "").to_pylist()):
                    raw = encoder.ids(text).tobytes() + tail
                    n, start = len(raw) // 4, 0
                    rest = known.get(n % capacity)
                    if rest is None:
                        rest = known[n % capacity] = cuts(n % capacity, capacity)
                    for size in [capacity] * (n // capacity) + rest:
                        rank = seen.get(size, 0)
                        seen[size] = rank + 1
                        for c, v in zip(out, (doc, start, size, n, bucket, rank, raw[4 * start : 4 * (start + size)])):
                            c.append(v)
                        start += size
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:-1]), pa.array(out[-1], pa.binary())], names=[x.split()[0] for x in _PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES)


def best_fit(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pack the left-over pieces; adds ``bin`` and ``offset``."""
    rows = rows.sort_values(["length", "doc_id", "start", "ids"], ascending=[False, True, True, True], kind="stable")
    free: list[tuple[int, int]] = []
    bins, offsets, used = [], [], 0
    for size in rows["length"]:
        at = bisect.bisect_left(free, (size, -1))
        if at == len(free):
            room, b = capacity, used
            used += 1
        else:
            room, b = free.pop(at)
        bins.append(b)
        offsets.append(capacity - room)
        if room > size:
            bisect.insort(free, (room - size, b))
    return rows.assign(bin=bins, offset=offsets)


def pack(
    spark: SparkSession,
    docs: DataFrame,
    vocabulary: str | None = None,
    ranks: str | None = None,
    pattern: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece with its sequence and offset, its ids and their checksum."""
    if vocabulary is None or ranks is None or pattern is None:
        import public_tokenizers as public

        vocabulary = vocabulary or public.path("byte_bpe_50k.json")
        ranks = ranks or public.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public.PATTERN
    cut = materialize(spark, pieces(spark, docs, vocabulary, ranks, pattern, capacity, end_id), "pieces")
    counts = materialize(spark, cut.groupBy("length", "bucket").agg(F.count("*").alias("n")), "counts")
    of_class = Window.partitionBy("length").orderBy("bucket")
    shifts = counts.select(
        "length", "bucket",
        (F.sum("n").over(of_class) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy("length")).alias("total"),
    )
    per_bin = F.floor(F.lit(capacity) / F.col("length")).cast("long")
    classes = counts.groupBy("length").agg(F.sum("n").alias("total"))
    classes = classes.select("length", F.expr(f"total div ({capacity} div length)").alias("bins"))
    # one row per distinct length: bounded by the capacity
    bases = classes.select("length", (F.sum("bins").over(Window.orderBy(F.desc("length"))) - F.col("bins")).alias("base"), F.sum("bins").over(Window.partitionBy()).alias("all_bins"))
    places = materialize(spark, shifts.join(bases, "length"), "places")
    numbered = (
        cut.join(F.broadcast(places) if places.count() <= MAX_SENT else places, ["length", "bucket"])
        .withColumn("at", F.col("before") + F.col("rank"))
        .withColumn("full", F.col("at") < F.expr(f"(total div ({capacity} div length)) * ({capacity} div length)"))
    )
    columns = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
    full = numbered.where("full").withColumn("sequence_id", F.col("base") + F.floor(F.col("at") / per_bin)).withColumn("offset", F.pmod(F.col("at"), per_bin) * F.col("length"))

    def left_over(pdf: pd.DataFrame) -> pd.DataFrame:
        out = best_fit(pdf, capacity)
        out["sequence_id"] = out["all_bins"] + out["bin"]
        return out[[*columns, "ids"]]

    # ids travel as text: pandas would turn nullable longs into floats
    loose = numbered.where("not full").withColumn("doc_id", F.col("doc_id").cast("string"))
    rest = loose.groupBy(F.lit(0).alias("one")).applyInPandas(left_over, "doc_id string, " + ", ".join(f"{c} long" for c in columns[1:]) + ", ids binary")
    rest = rest.withColumn("doc_id", F.col("doc_id").cast("long"))
    packed = full.select(*(F.col(c).cast("long").alias(c) for c in columns), "ids").unionByName(rest)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
