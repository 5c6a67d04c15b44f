"""Small relational pieces of reports and listening pages: roles, orders, identities, contracts, artifact
hashes, chunk plans, and the registry through which models plug in as scorers."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import dsp
from tessella.functions.canonical import canonical_json


def anchor_audio(anchors: Column) -> Column:
    """The first anchor (struct with ``audio``) that has audio."""
    return F.get(F.filter(anchors, lambda a: F.coalesce(a["audio"], F.lit("")) != ""), F.lit(0))


def yes_no(value: Column) -> Column:
    return F.when(value.isNull(), "?").when(value, "yes").otherwise("no")


def path_role(path: Column) -> Column:
    """struct(backend, kind): a nested path belongs to its first folder; a file at the top is told by its
    name, originals by their prefix."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    name = F.regexp_replace(F.element_at(parts, -1), "\\.[^.]*$", "")
    nested = F.size(parts) > 1
    kind = F.when(name.contains("codec"), "codec_roundtrip").when(name.contains("zero_shot"), "zero_shot").when(name.startswith("original"), "original").otherwise("generate")
    return F.struct(F.when(nested, parts[0]).otherwise(F.when(name.startswith("original"), "original").otherwise(F.substring_index(name, "_", 1))).alias("backend"), kind.alias("kind"))


def originals_first(rows: DataFrame, path: str) -> DataFrame:
    """Top-level files before nested ones, by path within each."""
    return rows.orderBy(F.size(F.split(F.col(path), "/")) > 1, path)


def display_order(names: DataFrame, column: str, known: tuple[str, ...]) -> DataFrame:
    """Known names in their order, then the rest by name, with a position."""
    rank = F.array_position(F.array(*map(F.lit, known)), F.col(column))
    return names.select(column).distinct().withColumn("rank", F.when(rank > 0, rank)).orderBy(F.col("rank").isNull(), "rank", column)


def rated_order(rows: DataFrame) -> DataFrame:
    """By the time of rating as text, missing first, ties by order."""
    return rows.orderBy(F.coalesce("rated_at", F.lit("")), "_ord")


def codec_hashes(artifacts: DataFrame) -> DataFrame:
    """(path, sha256) rows of a nested map input -> tag -> hash."""
    one = artifacts.select(F.explode("codec").alias("input", "tags")).select("input", F.explode("tags").alias("tag", "sha256"))
    return one.select(F.concat(F.lit("codec/"), "input", F.lit(":"), "tag").alias("path"), "sha256")


def chunk_plan(chunks: DataFrame, key: str, text_chunks: str, seed: Column, gap_s: float = 0.2) -> DataFrame:
    """One row per chunk: its seed is the base plus its position, and a gap precedes all but the first."""
    rows = chunks.select(key, seed.alias("_seed"), F.posexplode(text_chunks).alias("pos", "chunk"))
    return rows.select(key, "pos", "chunk", (F.col("_seed") + F.col("pos")).alias("seed"), F.when(F.col("pos") > 0, gap_s).otherwise(0.0).alias("gap_s"))


_STRINGS = T.MapType(T.StringType(), T.StringType())


def page_identity(payload: Column, kind: T.DataType = _STRINGS) -> Column:
    """Hash of the whole payload, nested as it may be: any change, orders and titles included, changes it,
    the order in which keys were set does not. Payloads that were published before keep their identity."""
    return F.sha2(canonical_json(payload, kind), 256)


def build_contracts(pages: DataFrame, assets: DataFrame) -> DataFrame:
    """One row per page: identity, asset hashes and paths, blind orders and the ids to review.

    ``pages`` has name, review_id, cells (array of asset ids), order (array); ``assets`` asset, path,
    sha256. Assets that aren't there leave the page incomplete."""
    cells = pages.select("name", "review_id", F.explode("cells").alias("asset")).join(assets, "asset", "left")
    hashes = cells.groupBy("name").agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("sha256").isNotNull(), F.struct("asset", "sha256"))))).alias("asset_hashes"),
        F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("path").isNotNull(), F.struct("asset", "path"))))).alias("audio_paths"),
        F.bool_and(F.col("sha256").isNotNull()).alias("complete"),
    )
    orders = pages.groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("review_id", F.array_join("order", "|").alias("o"))))).alias("blind_orders"), F.sort_array(F.collect_set("review_id")).alias("review_ids"))
    both = hashes.join(orders, "name")
    return both.withColumn("identity", page_identity(F.map_concat("asset_hashes", F.transform_keys("blind_orders", lambda k, _: F.concat(F.lit("order:"), k)))))


def logical_ids(samples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relative paths as their ids; an unknown path keeps itself and is marked."""
    m = mapping.select(F.col("path").alias("_p"), F.col("id").alias("_i"))
    j = samples.join(m, F.col("path") == F.col("_p"), "left")
    return j.withColumn("id", F.coalesce("_i", "path")).withColumn("known", F.col("_i").isNotNull()).drop("_p", "_i")


def html_escape(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def script_json(value: Column) -> Column:
    """JSON text that can't close a script element."""
    return F.replace(value, F.lit("<"), F.lit("\\u003c"))


def utc_stamp(milliseconds: bool = False) -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss" + (".SSS" if milliseconds else "") + "XXX")


def spectrogram_png(x: np.ndarray, rate: int, floor_db: float = -80.0) -> bytes:
    """A grey spectrogram, low frequencies at the bottom."""
    _, m = dsp.spectrum(np.asarray(x, float), rate, 1024, 256)
    level = 20 * np.log10(m / max(m.max(), dsp.EPS) + dsp.EPS)
    grey = (np.clip((level - floor_db) / -floor_db, 0, 1) * 255).astype(np.uint8)[::-1]
    raw = b"".join(b"\0" + row.tobytes() for row in grey)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


@F.pandas_udf(T.BinaryType())
def spectrogram(x: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([spectrogram_png(np.asarray(a), int(r)) for a, r in zip(x, rate)])


def codec_chain(original: DataFrame, encoded: DataFrame, decoded: DataFrame) -> DataFrame:
    """Comparisons along original, codec input and round trip, by case. Each side has case_id, sr, x."""
    sides = [d.select("case_id", F.col("sr").alias(f"sr{i}"), F.col("x").alias(f"x{i}")) for i, d in enumerate((original, encoded, decoded))]
    j = sides[0].join(sides[1], "case_id", "left").join(sides[2], "case_id", "left")
    rate = lambda a, b: F.least(f"sr{a}", f"sr{b}")
    level = lambda i, r: F.when(F.col(f"sr{i}") == r, F.col(f"x{i}")).otherwise(dsp.resample_signal(f"x{i}", f"sr{i}", r))
    empty = F.array().cast("array<double>")
    pair = lambda a, b, name: dsp.compare_signals(F.coalesce(level(a, rate(a, b)), empty), F.coalesce(level(b, rate(a, b)), empty), F.coalesce(rate(a, b), F.lit(1))).alias(name)
    return j.select("case_id", pair(0, 1, "original_vs_input"), pair(1, 2, "input_vs_roundtrip"), pair(0, 2, "original_vs_roundtrip"))


_SCORERS: dict = {}


def register_scorer(name: str, scorer) -> None:
    """Plug in a model as a function from an iterator of pandas frames to an iterator of pandas frames
    with the columns of its schema; one instance lives in each Python worker."""
    _SCORERS[name] = scorer


def score(rows: DataFrame, name: str, schema: str) -> DataFrame:
    if name not in _SCORERS:
        raise KeyError(f"no scorer {name!r}; have {sorted(_SCORERS)}")
    return rows.mapInPandas(_SCORERS[name], schema)


def correlate_messages(messages: DataFrame) -> DataFrame:
    """Batch form of request and response matching over one message table: per id the first request with
    its first response, null where none came; events and stray responses are left out."""
    q = messages.where("method is not null and id is not null").groupBy("id").agg(F.min_by(F.struct("_ord", "method"), F.col("_ord")).alias("q"))
    r = messages.where("method is null and event is null and id is not null").groupBy("id").agg(F.min_by(F.struct("_ord", "ok", "result", "error"), F.col("_ord")).alias("r"))
    return q.join(r, "id", "left").select("id", "q.method", "r.ok", "r.result", "r.error")


def session_states(transitions: DataFrame) -> DataFrame:
    """The last state of each session, and whether it ended."""
    last = transitions.groupBy("session").agg(F.max_by("state", "_ord").alias("state"), F.count("*").alias("n"))
    return last.withColumn("ended", F.col("state").isin("completed", "failed"))


def status_at(transitions: DataFrame, ticks: DataFrame) -> DataFrame:
    """What a poll sees: per session and tick the state it had last reached, null before its first one.
    ``transitions`` has session, at, _ord, state; ``ticks`` session, tick."""
    sides = transitions.select("session", F.col("at").alias("t"), F.lit(0).alias("poll"), F.col("_ord"), "state").unionByName(
        ticks.select("session", F.col("tick").alias("t"), F.lit(1).alias("poll"), F.lit(None).cast("long").alias("_ord"), F.lit(None).cast("string").alias("state"))
    )
    seen = F.last("state", ignorenulls=True).over(Window.partitionBy("session").orderBy("t", "poll", "_ord").rowsBetween(Window.unboundedPreceding, 0))
    return sides.withColumn("state", seen).where("poll = 1").select("session", F.col("t").alias("tick"), "state")


def html_list(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """One list per group, items escaped and in order: the bundle behind a page."""
    item = F.concat(F.lit("<li>"), html_escape(F.col(value)), F.lit("</li>"))
    items = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i")))).alias("items"))
    return items.select(group, F.concat(F.lit("<ul>"), F.array_join(F.transform("items", lambda x: x["i"]), ""), F.lit("</ul>")).alias("html"))


def table_rows(rows: DataFrame, order: str) -> DataFrame:
    """(_ord, line): the lines of a report table, made where the rows are; the header is line null."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    names = [c for c in rows.columns if c != order]
    return rows.select(F.col(order).alias("_ord"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, names)), F.lit(" |")).alias("line"))
