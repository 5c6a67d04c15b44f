"""Texts that resemble a blocked one: the matching-blocks ratio, behind filters that lose no pair.

A pair that reaches the threshold has matching blocks of ``least`` characters together, so only a known
number of characters lies between them. That bounds how many blocks there are, hence how many runs of
three characters both texts share, and how far apart a shared run's two positions can be. Runs are looked
up from the rarest on: the commonest, one fewer than must be shared, are left out, and come back only for
texts whose rarer runs suffice. The ratio itself is computed for what is left.

The blocked texts are a stated set: they are sent in blocks of bounded size and every row is held
against every block where it lies, so rows are never shuffled or paired.
"""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import materialize, release, ship_package
from tessella.sources.ordering import running_total

#: The ratio from which a text counts as leaked.
SIMILAR = 0.85
#: Characters of blocked texts that one block holds.
BLOCK_CHARS = 2_000_000
#: Length of the shared runs, and of those for pairs too short or too unlike to need one.
_RUN, _SHORT = 3, 1


def _codes(text: str, run: int) -> np.ndarray:
    """Every run of ``run`` characters as a number: 21 bits hold a code point, so nothing collides."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c) - run + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(run):
        out = (out << np.uint64(21)) | c[k : k + n]
    return out


class Bounds:
    """What a pair of these lengths must share to reach the threshold."""

    def __init__(self, n: int, m: np.ndarray, threshold: float):
        total = n + m
        # 2 * matched / total >= threshold; a little is left for rounding
        self.least = np.ceil(threshold * total / 2 - 1e-9).astype(np.int64)
        self.possible = self.least <= np.minimum(n, m)
        self.apart = np.maximum(n, m) - self.least
        self.blocks = total - 2 * self.least + 1

    def shared(self, run: int) -> np.ndarray:
        return self.least - self.blocks * (run - 1)


class Blocked:
    """A block of texts with the places of their runs."""

    def __init__(self, texts: list[str], threshold: float):
        self.texts, self.threshold = texts, threshold
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.places = {run: self._places(run) for run in (_RUN, _SHORT)}
        self.matchers: dict[int, difflib.SequenceMatcher] = {}

    def _places(self, run: int):
        codes = [_codes(t, run) for t in self.texts]
        text = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        at = np.concatenate([np.arange(len(c)) for c in codes])
        codes = np.concatenate(codes)
        order = np.argsort(codes, kind="stable")
        known, first = np.unique(codes[order], return_index=True)
        return known, np.append(first, len(codes)), text[order], at[order]

    def _counts(self, run: int, codes: np.ndarray, positions: np.ndarray, apart: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """For each text, at how many of ``positions`` it has the same run near by."""
        known, first, text, at = self.places[run]
        k = np.searchsorted(known, codes[positions])
        k[k == len(known)] = 0
        hit = known[k] == codes[positions]
        k, positions = k[hit], positions[hit]
        sizes = first[k + 1] - first[k]
        stops = np.cumsum(sizes)
        slot = np.arange(stops[-1] if len(stops) else 0) + np.repeat(first[k] - (stops - sizes), sizes)
        i, b = np.repeat(positions, sizes), text[slot]
        near = wanted[b] & (np.abs(i - at[slot]) <= apart[b])
        pairs = np.unique(b[near] * len(codes) + i[near])
        return np.bincount(pairs // max(len(codes), 1), minlength=len(self.texts))

    def candidates(self, row: str) -> np.ndarray:
        """The texts that may reach the threshold with ``row``."""
        bounds = Bounds(len(row), self.lengths, self.threshold)
        runs = bounds.shared(_RUN) >= 1
        found = []
        for run, wanted in ((_RUN, bounds.possible & runs), (_SHORT, bounds.possible & ~runs)):
            if not wanted.any():
                continue
            shared, codes = bounds.shared(run), _codes(row, run)
            known, first, _, _ = self.places[run]
            k = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            often = np.where(known[k] == codes, first[k + 1] - first[k], 0)
            order = np.argsort(often, kind="stable")
            spared = max(0, min(int(shared[wanted].min()) - 1, len(codes)))
            rare, common = order[: len(order) - spared], order[len(order) - spared :]
            count = self._counts(run, codes, rare, bounds.apart, wanted)
            wanted = wanted & (count >= shared - spared)
            if wanted.any():
                count = count + self._counts(run, codes, common, bounds.apart, wanted)
                found.append(np.flatnonzero(wanted & (count >= shared)))
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def best(self, row: str) -> float:
        """The largest ratio of ``row`` with a text, 0 where none reaches the threshold."""
        top = 0.0
        for b in self.candidates(row):
            matcher = self.matchers.get(b)
            if matcher is None:  # the second text's index is kept
                matcher = self.matchers[b] = difflib.SequenceMatcher(None, "", self.texts[b])
            matcher.set_seq1(row)
            if matcher.quick_ratio() >= max(self.threshold, top):
                top = max(top, matcher.ratio())
        return top if top >= self.threshold else 0.0


def similar_to_blocklist(rows: DataFrame, texts: DataFrame, threshold: float = SIMILAR, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per ``key`` of ``rows`` (key, norm) the best ratio against ``texts.norm``, where it reaches the
    threshold. Empty texts resemble nothing; a key's rows count together. A block is left when it holds
    ``block_chars``, so it exceeds that by its last text at most."""
    spark = rows.sparkSession
    ship_package(spark)
    wanted = materialize(spark, texts.where("norm <> ''").select("norm").distinct().withColumn("n", F.length("norm").cast("long")), "blocked")
    total = wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = -(-total // block_chars)
    kind = rows.schema["key"].dataType.simpleString()
    rows, tasks = rows.where("norm <> ''").select("key", "norm"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if blocks > 1:
        summed = materialize(spark, running_total(spark, wanted, ["norm"], "n", "before"), "blocked")
        release(wanted)
        wanted = summed.withColumn("block", F.expr(f"before div {block_chars}"))
        rows = materialize(spark, rows, "fuzzy-rows")  # read once for each block
    elif rows.rdd.getNumPartitions() < tasks:  # few bytes, much work a row
        rows = rows.repartition(tasks)
    found = None
    for k in range(blocks):
        part = (wanted.where(F.col("block") == k) if blocks > 1 else wanted).select("norm").collect()  # a block's size is bounded
        sent = spark.sparkContext.broadcast([r.norm for r in part])

        def score(batches, sent=sent):
            blocked = Blocked(sent.value, threshold) if sent.value else None
            for batch in batches if blocked else ():
                best = [blocked.best(t.as_py()) for t in batch.column(1)]
                hit = pa.array([b > 0 for b in best], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.float64())], names=["key", "similarity"]).filter(hit)

        one = rows.mapInArrow(score, f"key {kind}, similarity double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], f"key {kind}, similarity double")
    return found.groupBy("key").agg(F.max("similarity").alias("similarity"))
