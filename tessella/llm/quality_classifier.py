"""Quality classifier: ordinal cumulative-link regression over hashed text features.

A document's grade is 0 (toxic), 1 (low quality) or 2 (good). One weight vector over hashed features
is shared by all grades and ordered thresholds cut its score: P(grade <= k) = sigmoid(t_k - score).
The result carries the expected grade and the tail probability P(grade = 2), by which is selected.

The model is fitted on a bounded sample: the ``max_train`` labelled documents with the smallest hash
of ``doc_id``, and of their hashed features the ``MAX_FEATURES`` that tell the grades apart best; both
bound what the driver gathers, whatever the texts' lengths. Everything else covers all documents.

Cases: a null or empty text has only its shape features; labels with a null id or a null quality are
ignored and a null toxic counts as 0; of several labels of a document the lowest grade holds; without
any label every weight is zero and both thresholds put the mass on grade 2; a tail probability of just
``select`` is kept; texts of any length are hashed whole, and each feature counts once; repeated rows are
scored row by row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import wordcodes as wc
from tessella.session import materialize

BITS = 18
MAX_TRAIN = 8000
GRADES = 3
#: Features in fewer training documents than this carry no weight, nor do those whose rate among the
#: documents up to some grade lies within this many standard errors of all documents' rate.
MIN_SEEN = 8
MIN_Z = 4.5
MAX_FEATURES = 4096
SELECT = 0.5

_MARKS = ~(wc.ALNUM | wc.BLANK)
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True


def hashed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of one slice: words, runs of marks, and four shape buckets."""
    rows = len(off) - 1
    shift = np.uint64(64 - BITS)
    _, _, row, code = wc.words(data, off, wc.ALNUM)
    _, _, mark_row, mark = wc.words(data, off, _MARKS)
    feats = [(row, code >> shift), (mark_row, wc.mix(mark + np.uint64(11)) >> shift)]
    n = np.bincount(row, minlength=rows)
    pairs = np.unique(row.astype(np.uint64) << np.uint64(32) | (code >> np.uint64(32)))
    kinds = np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=rows)
    share = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[off])
    size = np.maximum(np.diff(off), 1)
    shapes = (
        (8 * kinds // np.maximum(n, 1)) * 8 + np.minimum(np.log2(n + 1).astype(np.int64) // 2, 7),
        64 + 16 * share(_UPPER) // size,
        128 + 16 * share(_MARKS) // size,
        192 + np.minimum(np.log2(n + 1).astype(np.int64), 15),
    )
    every = np.arange(rows)
    feats += [(every, wc.mix(s.astype(np.uint64) + np.uint64(1 << 40)) >> shift) for s in shapes]
    key = np.unique(np.concatenate([r.astype(np.uint64) << np.uint64(BITS) | f for r, f in feats]))
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


class OrdinalModel:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        below = _sigmoid(self.thresholds[None] - score[:, None])
        return np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1), axis=1)

    def score(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        return np.bincount(row, weights=self.weights[feature], minlength=rows)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def telling(seen: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The features that tell the grades apart: ``seen`` [feature, grade] counts documents, ``sizes`` all
    documents of each grade. At most MAX_FEATURES, the strongest; of equally strong ones the first."""
    total, share = seen.sum(1), np.cumsum(sizes)[:-1] / max(sizes.sum(), 1)
    have = np.cumsum(seen, axis=1)[:, :-1]
    z = (np.abs(have - total[:, None] * share) / np.sqrt(np.maximum(total[:, None] * share * (1 - share), 1e-9))).max(1)
    good = np.flatnonzero((total >= MIN_SEEN) & (z > MIN_Z))
    return np.sort(good[np.argsort(-z[good], kind="stable")[:MAX_FEATURES]])


def fit(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, steps: int = 200, rate: float = 0.05, decay: float = 2e-3) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty by full-batch Adam steps."""
    weights = np.zeros(1 << BITS)
    if not len(grade):
        return OrdinalModel(weights, np.array([-20.0, -10.0]))
    seen = np.zeros((1 << BITS, GRADES))
    np.add.at(seen, (feature, grade[row]), 1)
    used = telling(seen, np.bincount(grade, minlength=GRADES))
    keep = np.isin(feature, used)
    row, local = row[keep], np.searchsorted(used, feature[keep])
    n = len(grade)
    free = np.array([-1.0, 0.0])  # the first threshold and the log of the gap
    w = np.zeros(len(used))
    state = [np.zeros(len(used)), np.zeros(len(used)), np.zeros(2), np.zeros(2)]
    for step in range(1, steps + 1):
        t = np.array([free[0], free[0] + np.exp(free[1])])
        s = np.bincount(row, weights=w[local], minlength=n)
        hi = np.where(grade < GRADES - 1, _sigmoid(np.append(t, 0)[grade] - s), 1.0)
        lo = np.where(grade > 0, _sigmoid(np.append(t, 0)[grade - 1] - s), 0.0)
        p = np.maximum(hi - lo, 1e-12)
        dh, dl = hi * (1 - hi) / p, lo * (1 - lo) / p
        gs = (dl - dh) / n  # derivative of the mean log likelihood by the score
        gt = np.array([dh[grade == 0].sum() - dl[grade == 1].sum(), dh[grade == 1].sum() - dl[grade == 2].sum()]) / n
        gw = np.bincount(local, weights=gs[row], minlength=len(used)) - decay * w
        gf = np.array([gt.sum(), gt[1] * np.exp(free[1])])
        for x, g, m, v in ((w, gw, state[0], state[1]), (free, gf, state[2], state[3])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weights[used] = w
    return OrdinalModel(weights, np.array([free[0], free[0] + np.exp(free[1])]))


def grades(labels: DataFrame) -> DataFrame:
    """One grade per labelled document."""
    g = F.when(F.coalesce(F.col("toxic"), F.lit(0)) > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(g).cast("int").alias("grade"))


def training_rows(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_train: int):
    """(row, feature, grade) arrays of the bounded sample."""
    wc.prepare(spark)
    picked = grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "grade")

    def run(batches):
        for batch in batches:
            data, off = wc.column_bytes(batch.column(1))
            for lo, hi in wc.slices(off):
                row, feature = hashed(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                f = feature.astype("<i4")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([f[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["doc_id", "grade", "features"])

    # a document that occurs in several rows is used once
    sample = rows.mapInArrow(run, "doc_id long, grade int, features binary").groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("features").alias("features"))
    sample = materialize(spark, sample, "sample")

    def count(batches):
        seen = np.zeros((1 << BITS, GRADES), np.int64)
        for batch in batches:
            for g, f in zip(batch.column(1).to_pylist(), batch.column(2)):
                seen[np.frombuffer(f.as_buffer(), "<i4"), g] += 1
        at = np.flatnonzero(seen.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(seen[at, g]) for g in range(GRADES))], names=["feature", "g0", "g1", "g2"])

    sums = [F.sum(f"g{g}").alias(f"g{g}") for g in range(GRADES)]
    counted = sample.mapInArrow(count, "feature long, g0 long, g1 long, g2 long").groupBy("feature").agg(*sums).where(f"g0 + g1 + g2 >= {MIN_SEEN}").toPandas()  # 2**BITS rows at most
    sizes = np.zeros(GRADES, np.int64)
    for g, n in sample.groupBy("grade").count().collect():
        sizes[g] = n
    seen = np.zeros((1 << BITS, GRADES))
    seen[counted["feature"].to_numpy(np.int64)] = counted[["g0", "g1", "g2"]].to_numpy(float)
    used = telling(seen, sizes)
    sent = spark.sparkContext.broadcast(used.astype("<i4"))

    def pick(batches):
        for batch in batches:
            kept = [np.intersect1d(np.frombuffer(f.as_buffer(), "<i4"), sent.value, assume_unique=True).tobytes() for f in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary())], names=["doc_id", "grade", "features"])

    chosen = sample.mapInArrow(pick, "doc_id long, grade int, features binary").orderBy("doc_id").collect()  # max_train x MAX_FEATURES at most
    feats = [np.frombuffer(r.features, "<i4").astype(np.int64) for r in chosen]
    row = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    return row, np.concatenate(feats) if feats else np.zeros(0, np.int64), np.array([r.grade for r in chosen], dtype=np.int64)


_OUT = "doc_id long, score double, expected_grade double, tail_probability double, kept boolean"


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, select: float = SELECT, model: OrdinalModel | None = None) -> DataFrame:
    """Score, expected grade and selection of every document row."""
    wc.prepare(spark)
    if model is None:
        model = fit(*training_rows(spark, docs, labels, max_train))
    sent = spark.sparkContext.broadcast(model)  # 2**BITS weights, whatever the input

    def run(batches):
        m = sent.value
        for batch in batches:
            data, off = wc.column_bytes(batch.column(1))
            for lo, hi in wc.slices(off):
                row, feature = hashed(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                s = m.score(row, feature, hi - lo)
                p = m.probabilities(s)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s), pa.array(p @ np.arange(GRADES)), pa.array(p[:, -1]), pa.array(p[:, -1] >= select)], names=[x.split()[0] for x in _OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
