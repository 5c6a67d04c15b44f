"""Benchmark decontamination with suffix arrays over the training words.

The training texts are cut into shards of whole rows. A shard's suffix array holds all its words' suffixes,
ordered by their first ``window`` words: prefix ranks are doubled until the window is covered. Every
window-long beginning of a test suffix is binary-searched in it, word by word; the ranges found are the
places of the verbatim matches, and matches that go on, in the same item and the same document, are joined
to the longest ones.

The test items are read in blocks of bounded size. Where they fit one block each shard's array is searched
where it is built; where they don't the arrays are written once as a table of shards and every block is
sent in turn, searched in that table, and its matches are gathered by shard and row. Neither side must fit
anywhere whole, and texts are tokenised and sorted once.

Cases: null or empty texts have no words and match nothing; items without words are ignored; an item
shorter than a window is one window; an item with a null id still hits words but isn't listed; items
that share an id count once; of matches at one place, those of every item are kept, in order of place,
item and length; a text longer than a shard is a shard of its own; repeated document rows each get a row;
extra columns are ignored; an empty table on either side gives no hits or no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import wordcodes as wc
from tessella.session import materialize, release

WINDOW = 10
#: Words of test items in one block; a block sent to the workers takes about 40 bytes a word.
BLOCK_WORDS = 1 << 20
#: Bytes of text in one shard; its array takes about 60 bytes a word while it is built.
SHARD = 4 << 20


class Shard:
    """The words of some rows and their suffix array."""

    def __init__(self, code: np.ndarray, row: np.ndarray, rows: int, window: int):
        """``code`` are word hashes in text order, ``row`` the row of each."""
        self.per = np.bincount(row, minlength=rows)
        self.vocabulary, rank = np.unique(code, return_inverse=True)
        self.rank = rank.astype(np.int32) + 1  # zero stands for the end of a row
        self.array = self._sorted(window)

    @classmethod
    def of_blobs(cls, per: np.ndarray, vocabulary: np.ndarray, rank: np.ndarray, array: np.ndarray) -> Shard:
        out = cls.__new__(cls)
        out.per, out.vocabulary, out.rank, out.array = per, vocabulary, rank, array
        return out

    @property
    def ends(self) -> np.ndarray:
        """Where the row of every word ends."""
        return np.repeat(np.cumsum(self.per), self.per)

    def _sorted(self, window: int) -> np.ndarray:
        n, depth = len(self.rank), 1
        at, ends = np.arange(n), self.ends
        known = self.rank.astype(np.int64)
        order = np.argsort(known)
        while depth < window and n:
            step = min(depth, window - depth)  # the ranks of ``depth`` words, ``step`` words on, cover the rest
            after = np.where(at + step < ends, known[np.minimum(at + step, n - 1)], 0)
            key = known * (int(known.max()) + 1) + after
            order = np.argsort(key)
            ranked = key[order]
            known[order] = np.cumsum(np.r_[True, ranked[1:] != ranked[:-1]])
            depth += step
        return order.astype(np.int32)

    def search(self, words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [lo, hi) of the array whose suffixes begin with the words of each query. ``words`` is
        [query, place] of ranks, -1 where the shard lacks the word; ``size`` is how many count."""
        n, ends = len(self.rank), self.ends
        starts = np.searchsorted(self.rank[self.array], np.arange(len(self.vocabulary) + 2))
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), n)
        live = np.flatnonzero(((words >= 0) | (np.arange(words.shape[1]) >= size[:, None])).all(1))
        gone = np.ones(len(words), bool)
        gone[live] = False
        lo[gone] = hi[gone] = 0
        if n:
            lo[live], hi[live] = starts[words[live, 0]], starts[words[live, 0] + 1]
        for place in range(1, words.shape[1]):
            live = live[(size[live] > place) & (lo[live] < hi[live])]
            if not len(live):
                break
            wanted = words[live, place]
            lo[live], hi[live] = (self._bound(lo[live], hi[live], wanted + more, place, ends) for more in (0, 1))
        return lo, hi

    def _bound(self, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, place: int, ends: np.ndarray) -> np.ndarray:
        """The first place in each range whose suffix has a word of rank ``wanted`` or more at ``place``."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ranges = np.flatnonzero(lo < hi)
            if not len(open_ranges):
                return lo
            mid = (lo[open_ranges] + hi[open_ranges]) // 2
            at = self.array[mid].astype(np.int64) + place
            inside = at < ends[at - place]
            found = np.where(inside, self.rank[np.minimum(at, len(self.rank) - 1)], 0)
            less = found < wanted[open_ranges]
            lo[open_ranges[less]] = mid[less] + 1
            hi[open_ranges[~less]] = mid[~less]


class TestBlock:
    """A block of test items: the window-long beginnings of their suffixes, each once, and where they are."""

    __test__ = False

    def __init__(self, ids: list, texts: pa.Array, window: int = WINDOW):
        self.ids = [None if x is None else str(x) for x in ids]
        data, off = wc.column_bytes(texts)
        _, _, row, code = wc.words(data, off, wc.ALNUM)
        count = np.bincount(row, minlength=len(ids))
        base = np.cumsum(count) - count
        place = np.arange(len(row)) - base[row]
        at = np.flatnonzero((count[row] - place >= window) | (place == 0))
        size = np.minimum(count[row[at]], window)
        self.vocabulary, word = np.unique(code, return_inverse=True)
        width = int(size.max()) if len(at) else 1
        words = np.full((len(at), width), -1, np.int32)
        for j in range(width):
            have = size > j
            words[have, j] = word[at[have] + j]
        # equal beginnings are searched once; ``row_of`` and ``place_of`` list where each stands
        _, first, same = np.unique(words.view([("", np.int32)] * width).ravel(), return_index=True, return_inverse=True) if len(at) else (None, at, at)
        self.words, self.size = words[first], size[first]
        order = np.argsort(same, kind="stable")
        self.start = np.searchsorted(same[order], np.arange(len(first) + 1))
        self.row_of, self.place_of = row[at][order], place[at][order]

    def matches(self, shard: Shard):
        """(row, start, length, item, item start) arrays of the longest verbatim matches in a shard, places
        counted in words from the beginning of the row or item."""
        none = tuple(np.zeros(0, np.int64) for _ in range(5))
        if not len(self.size) or not len(shard.rank):
            return none
        at = np.searchsorted(shard.vocabulary, self.vocabulary)
        have = shard.vocabulary[np.minimum(at, len(shard.vocabulary) - 1)] == self.vocabulary
        known = np.append(np.where(have, at + 1, -1), -1)  # the last one serves the empty places
        lo, hi = shard.search(known[self.words], self.size)
        hit = np.flatnonzero(lo < hi)
        if not len(hit):
            return none
        query, place = _spread(lo[hit], hi[hit])
        query, place = hit[query], shard.array[place].astype(np.int64)
        each, where = _spread(self.start[query], self.start[query + 1])
        query, place = query[each], place[each]
        item, inner, size = self.row_of[where], self.place_of[where], self.size[query]
        order = np.lexsort((place, place - inner, item))
        item, inner, place, size = item[order], inner[order], place[order], size[order]
        fresh = np.r_[True, (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (inner[1:] != inner[:-1] + 1)]
        cut = np.flatnonzero(fresh)
        last = np.append(cut[1:], len(item)) - 1
        base = np.cumsum(shard.per) - shard.per
        row = np.searchsorted(base, place[cut], side="right") - 1
        return row, place[cut] - base[row], place[last] - place[cut] + size[last], item[cut], inner[cut]


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of all ranges, with the number of the range of each."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]


def read_blocks(benchmark: DataFrame, block_words: int, window: int):
    """The items as blocks; the driver holds one block's texts at a time. A single item larger than a block
    is a block."""
    ids: list = []
    texts: list = []
    held = 0
    rows = benchmark.select(F.col("item_id"), F.col("text").cast("string")).where("text is not null")
    for item, text in rows.toLocalIterator():
        words = len(text) // 2 + 1  # at most
        if held + words > block_words and ids:
            yield TestBlock(ids, pa.array(texts, pa.string()), window)
            ids, texts, held = [], [], 0
        ids.append(item)
        texts.append(text)
        held += words
    yield TestBlock(ids, pa.array(texts, pa.string()), window)


def _shards(batches, window: int):
    """(rows of the batch, shard) over all rows."""
    for batch in batches:
        data, off = wc.column_bytes(batch.column(1))
        for lo, hi in wc.slices(off, SHARD):
            part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            _, _, row, code = wc.words(part, at, wc.ALNUM)
            yield batch.slice(lo, hi - lo), Shard(code, row, hi - lo, window)


_MATCHES = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64())]))
_MATCHES_TYPE = "array<struct<start:bigint,length:bigint,item_id:string,item_start:bigint>>"
_SHARD_TYPE = "shard long, doc_ids array<long>, per binary, vocabulary binary, ranks binary, array binary"


def _found(block: TestBlock, shard: Shard) -> dict[int, list[dict]]:
    """Matches by row."""
    out: dict[int, list[dict]] = {}
    for row, start, length, item, inner in zip(*(x.tolist() for x in block.matches(shard))):
        out.setdefault(row, []).append({"start": start, "length": length, "item_id": block.ids[item], "item_start": inner})
    return out


def _matched(source: DataFrame, block, window: int) -> DataFrame:
    """(doc_id, n_words, matches) of every row, each shard's array searched where it is built."""

    def run(batches):
        for rows, shard in _shards(batches, window):
            found = _found(block.value, shard)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(shard.per.astype(np.int64)), pa.array([found.get(r, []) for r in range(len(shard.per))], _MATCHES)], names=["doc_id", "n_words", "matches"])

    return source.mapInArrow(run, f"doc_id long, n_words long, matches {_MATCHES_TYPE}")


def _matched_in_turn(spark: SparkSession, source: DataFrame, blocks, window: int) -> DataFrame:
    """The same by one pass over written arrays for each block."""

    def build(batches):
        task = TaskContext.get().partitionId() << 32
        for i, (rows, shard) in enumerate(_shards(batches, window)):
            blobs = [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((shard.per, "<i8"), (shard.vocabulary, "<u8"), (shard.rank, "<i4"), (shard.array, "<i4"))]
            yield pa.RecordBatch.from_arrays([pa.array([task + i], pa.int64()), pa.array([rows.column(0).to_pylist()], pa.list_(pa.int64())), *blobs], names=["shard", "doc_ids", "per", "vocabulary", "ranks", "array"])

    shards = materialize(spark, source.mapInArrow(build, _SHARD_TYPE), "shards")
    passes = []
    for block in blocks:
        sent = spark.sparkContext.broadcast(block)  # BLOCK_WORDS or one item

        def look(batches, sent=sent):
            for batch in batches:
                for i in range(batch.num_rows):
                    per, vocabulary, ranks, array = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in zip(range(1, 5), ("<i8", "<u8", "<i4", "<i4")))
                    found = _found(sent.value, Shard.of_blobs(per, vocabulary, ranks, array))
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * n, pa.int64()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), _MATCHES)], names=["shard", "row", "matches"])

        hits = shards.select("shard", "per", "vocabulary", "ranks", "array").mapInArrow(look, f"shard long, row long, matches {_MATCHES_TYPE}")
        passes.append(materialize(spark, hits, "matches"))
        sent.destroy()
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    gathered = every.groupBy("shard", "row").agg(F.flatten(F.collect_list("matches")).alias("matches"))

    def counts(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                per = np.frombuffer(batch.column(2)[i].as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(per), pa.int64()), pa.array(np.arange(len(per))), batch.column(1)[i].values, pa.array(per)], names=["shard", "row", "doc_id", "n_words"])

    rows = materialize(spark, shards.select("shard", "doc_ids", "per").mapInArrow(counts, "shard long, row long, doc_id long, n_words long"), "words")
    release(shards)
    return rows.join(gathered, ["shard", "row"], "left").select("doc_id", "n_words", F.coalesce("matches", F.array().cast(_MATCHES_TYPE)).alias("matches"))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document row: its words, hit words, items, whether it is contaminated, and its longest
    verbatim matches (start, length, item, start in the item; in words), by place."""
    wc.prepare(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = read_blocks(benchmark, block_words, window)
    ahead = [b for _, b in zip(range(2), blocks)]
    if len(ahead) == 1:
        matched = _matched(source, spark.sparkContext.broadcast(ahead[0]), window)
    else:
        matched = _matched_in_turn(spark, source, _chained(ahead, blocks), window)
    matched = matched.withColumn("matches", F.array_sort("matches"))
    # words under any match: matches come by start, so each adds what lies behind the end so far
    cover = lambda a, m: F.struct((a["n"] + F.greatest(m["start"] + m["length"] - F.greatest(m["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], m["start"] + m["length"]).alias("end"))
    zero = F.lit(0).cast("long")
    hit = F.aggregate("matches", F.struct(zero.alias("n"), zero.alias("end")), cover, lambda a: a["n"])
    items = F.sort_array(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"]), lambda x: x.isNotNull())))
    return matched.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("matches") > 0).alias("contaminated"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["length"])), zero).alias("longest_match"), "matches",
    )


def _chained(ahead: list, rest):
    yield from ahead
    yield from rest


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.drop("longest_match", "matches")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM bi),
di AS (SELECT doc_id, w, s.n AS n, unnest(range(1, len(w) - s.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) s WHERE len(w) >= s.n),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM di),
hits AS (SELECT doc_id, dw.n AS n, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
cov AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
