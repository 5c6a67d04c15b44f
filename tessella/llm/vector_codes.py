"""Vector code compression: product quantisation whose codebooks come from Lloyd's rounds with heaps.

Vectors become integers, are cut into equal parts, and every part position has a codebook. A block of
vectors keeps for each entry of each codebook a heap of the parts assigned to it, keyed by slack: the
distance to the second nearest entry minus that to its own, plus what the bounds had drifted when it was
measured. When entries move, a heap's drift grows by its entry's step and the longest step of any other;
only the parts at the heap's top whose key the drift has reached can have another nearest entry. They are
popped, measured exactly in integers and pushed anew; no other part is looked at. A heap is a sorted run,
so that its top is a slice found by bisection and pushing is a merge.

Blocks of at most BLOCK vectors are rows of a written table: a lost executor costs its tasks, and a task
holds one block at a time. Blocks carry the sums of their entries, which Spark adds up; the driver holds
codebooks and sums only, whose size the parameters fix. The table of a round is deleted after the next.

Cases: rows whose vector is null or empty, or holds null or non-finite components, are dropped, and so
are vectors longer or shorter than the first kept one; a dimension that the number of parts doesn't divide
is cut as evenly as can be; components beyond +-2^24 after scaling count as that; of rows that share an id
the smallest vector is the entry, and all are encoded; null ids come last; with fewer vectors than entries
codebooks are smaller; entries at equal distance give the lower index; null labels are one label; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import wordcodes as wc
from tessella.session import materialize, release

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Vectors of a block, and the number up to which label totals are sent to all workers.
BLOCK, MAX_SENT = 4096, 10_000
_BOUND = 1 << 24
#: Slack that rounding may have cost: a part so close to its bound is measured again.
_ROUNDING = 1e-3

_STATE = "ids binary, labels binary, vectors binary, width int, owner binary, parts binary, keys binary, ends binary, sums array<bigint>"


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the embedding as doubles, of rows with finite components only."""
    x = F.col("embedding").cast("array<double>")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("embedding"))


def _whole(rows: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(rows * scale), -_BOUND, _BOUND).astype(np.int64)


def first_vectors(rows: DataFrame, n: int) -> list[list[float]]:
    """The vectors of the ``n`` smallest ids; a row each, bounded by ``n``."""
    found: list[list[float]] = []
    rest, order = rows, [F.col("vec_id").asc_nulls_last(), "embedding"]
    while len(found) < n:
        top = rest.orderBy(*order).limit(n).collect()
        ids = []
        for r in top:
            if r.vec_id not in ids and len(found) < n and (not found or len(r.embedding) == len(found[0])):
                ids.append(r.vec_id)
                found.append(r.embedding)
        if len(top) < n or top[-1].vec_id is None:
            break
        rest = rows.where((F.col("vec_id") > top[-1].vec_id) | F.col("vec_id").isNull())
    return found


class Codebooks:
    """Entries of every part position, and how far each heap's bounds have drifted."""

    def __init__(self, first: np.ndarray, parts: int):
        self.cuts = [len(first[0]) * p // parts for p in range(parts + 1)]
        self.entries = [first[:, a:b].copy() for a, b in zip(self.cuts, self.cuts[1:])]
        self.drift = np.zeros((parts, len(first)))

    def move(self, sums: np.ndarray, counts: np.ndarray) -> None:
        """Replace used entries by the floor of their parts' means. ``sums`` lies by entry over the whole width."""
        for p, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            old, used = self.entries[p], counts[p] > 0
            new = np.where(used[:, None], sums[:, a:b] // np.maximum(counts[p], 1)[:, None], old)
            step = np.sqrt(((new - old).astype(float) ** 2).sum(axis=1))
            if len(step) > 1:
                far = int(step.argmax())
                others = np.full(len(step), step[far])
                others[far] = np.delete(step, far).max()
                self.drift[p] += step + others
            else:
                self.drift[p] -= np.inf  # a single entry never loses a part
            self.entries[p] = new

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.entries for entry in book for x in entry).encode()).hexdigest()


def distances(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every entry."""
    largest = max(int(np.abs(rows).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * largest * largest * rows.shape[1] < 1 << 52:  # whole numbers that doubles hold exactly
        a, b = rows.astype(float), book.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((rows - e) ** 2).sum(axis=1) for e in book], axis=1)


def _measure(rows: np.ndarray, book: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every row, and its key in that entry's heap."""
    d = distances(rows, book)
    near = d.argmin(axis=1)
    at = np.arange(len(rows))
    best = np.sqrt(d[at, near].astype(float))
    d[at, near] = np.iinfo(np.int64).max
    slack = np.sqrt(d.min(axis=1).astype(float)) - best
    key = (slack + drift[near]).astype(np.float32) if len(book) > 1 else np.zeros(len(rows), np.float32)
    return near, np.nextafter(key, np.float32(-np.inf))  # never above the true slack


class Block:
    """Some vectors with their heaps: ``parts`` and ``keys`` are the runs of all heaps one behind the other,
    by position and entry, and ``ends`` says where each ends."""

    def __init__(self, vectors: np.ndarray, cuts: list[int], entries: int):
        self.vectors, self.cuts, self.entries, self.n = vectors, cuts, entries, len(vectors)
        self.owner = np.zeros((len(cuts) - 1, self.n), np.uint16)
        self.parts = [np.zeros(0, np.int32)] * ((len(cuts) - 1) * entries)
        self.keys = [np.zeros(0, np.float32)] * ((len(cuts) - 1) * entries)
        self.sums = np.zeros((entries, cuts[-1]), np.int64)
        self.counts = np.zeros((len(cuts) - 1, entries), np.int64)

    def _at(self, p: int) -> slice:
        return slice(self.cuts[p], self.cuts[p + 1])

    def _push(self, p: int, rows: np.ndarray, books: Codebooks) -> None:
        near, key = _measure(self.vectors[rows, self._at(p)], books.entries[p], books.drift[p])
        self.owner[p, rows] = near
        order = np.lexsort((key, near))
        stops = np.searchsorted(near[order], np.arange(self.entries + 1))
        for e in np.unique(near):
            own, h = order[stops[e] : stops[e + 1]], p * self.entries + e
            where = np.searchsorted(self.keys[h], key[own])
            self.keys[h] = np.insert(self.keys[h], where, key[own])
            self.parts[h] = np.insert(self.parts[h], where, rows[own])
        np.add.at(self.sums[:, self._at(p)], near, self.vectors[rows, self._at(p)])
        self.counts[p] += np.bincount(near, minlength=self.entries)

    def _pop(self, p: int, e: int, drift: float) -> np.ndarray:
        h = p * self.entries + e
        stop = int(np.searchsorted(self.keys[h], drift + _ROUNDING, side="right"))
        rows, self.keys[h], self.parts[h] = self.parts[h][:stop], self.keys[h][stop:], self.parts[h][stop:]
        if stop:
            self.sums[e, self._at(p)] -= self.vectors[rows, self._at(p)].sum(axis=0)
            self.counts[p, e] -= stop
        return rows

    def start(self, books: Codebooks) -> None:
        for p in range(len(self.cuts) - 1):
            self._push(p, np.arange(self.n, dtype=np.int32), books)

    def repair(self, books: Codebooks) -> int:
        """Bring the heaps up to the entries' present places; returns how many parts had to be measured."""
        measured = 0
        for p in range(len(self.cuts) - 1):
            rows = np.concatenate([self._pop(p, e, books.drift[p, e]) for e in range(self.entries)])
            if len(rows):
                self._push(p, rows, books)
                measured += len(rows)
        return measured

    def errors(self, books: Codebooks) -> np.ndarray:
        """Squared distances of all vectors to their entries, summed over parts."""
        total = np.zeros(self.n, np.int64)
        for p in range(len(self.cuts) - 1):
            gap = self.vectors[:, self._at(p)] - books.entries[p][self.owner[p]]
            total += (gap * gap).sum(axis=1)
        return total

    def packed(self) -> tuple:
        largest = int(np.abs(self.vectors).max(initial=0))
        width = 2 if largest < 1 << 15 else 4
        ends = np.cumsum([len(x) for x in self.parts], dtype=np.int64)
        kind = np.uint16 if self.n <= 1 << 16 else np.int32
        return (
            self.vectors.astype(f"<i{width}").tobytes(), width, self.owner.astype(np.uint8 if self.entries <= 256 else np.uint16).tobytes(),
            np.concatenate(self.parts).astype(kind).tobytes(), np.concatenate(self.keys).tobytes(), ends.tobytes(),
            np.concatenate([self.sums.ravel(), self.counts.ravel()]),
        )

    @classmethod
    def unpacked(cls, row: dict, cuts: list[int], entries: int) -> Block:
        vectors = np.frombuffer(row["vectors"], f"<i{row['width']}").astype(np.int64).reshape(-1, cuts[-1])
        block = cls(vectors, cuts, entries)
        block.owner = np.frombuffer(row["owner"], np.uint8 if entries <= 256 else np.uint16).astype(np.uint16).reshape(block.owner.shape)
        ends = np.frombuffer(row["ends"], np.int64)[:-1]
        block.parts = np.split(np.frombuffer(row["parts"], np.uint16 if block.n <= 1 << 16 else np.int32).astype(np.int32), ends)
        block.keys = np.split(np.frombuffer(row["keys"], np.float32), ends)
        sums = np.array(row["sums"], np.int64)
        block.sums, block.counts = sums[: block.sums.size].reshape(block.sums.shape), sums[block.sums.size :].reshape(block.counts.shape)
        return block


def _longs(values: list, kind=pa.int64()) -> bytes:
    """Nullable integers as an Arrow stream."""
    batch = pa.record_batch([pa.array(values, kind)], names=["x"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _values(raw: bytes) -> pa.Array:
    return pa.ipc.open_stream(raw).read_all().column(0).combine_chunks()


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(len(kinds))], names=[x.split()[0] for x in _STATE.split(", ")])


def _start(spark: SparkSession, rows: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    """Blocks with their heaps under the first codebooks."""
    shared = spark.sparkContext.broadcast(books)
    width, entries = books.cuts[-1], len(books.entries[0])

    def run(batches):
        books = shared.value
        ids, labels, held, n = [], [], [], 0

        def flush():
            block = Block(np.concatenate(held), books.cuts, entries)
            block.start(books)
            return _table([(_longs(ids), _longs(labels), *block.packed())])

        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                if n + part.num_rows > BLOCK and n:
                    yield flush()
                    ids, labels, held, n = [], [], [], 0
                ids += part.column(0).to_pylist()
                labels += part.column(1).to_pylist()
                held.append(_whole(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale))
                n += part.num_rows
        if n:
            yield flush()

    return rows.where(F.size("embedding") == width).mapInArrow(run, _STATE)


def _next(state: DataFrame, books: Codebooks) -> DataFrame:
    """The blocks with their heaps repaired for codebooks that have moved."""
    shared = state.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        books = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block.unpacked(row, books.cuts, len(books.entries[0]))
                block.repair(books)
                yield _table([(row["ids"], row["labels"], *block.packed())])

    return state.mapInArrow(run, _STATE)


def _encoded(state: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code and error of every vector after a last repair."""
    shared = state.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        books = shared.value
        digits = 2 * len(books.entries)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block.unpacked(row, books.cuts, len(books.entries[0]))
                block.repair(books)
                text = block.owner.T.astype(np.uint8).tobytes().hex()
                codes = [text[k : k + digits] for k in range(0, len(text), digits)]
                yield pa.RecordBatch.from_arrays([_values(row["ids"]), _values(row["labels"]), pa.array(codes), pa.array(block.errors(books))], names=["vec_id", "label", "code", "error"])

    return state.mapInArrow(run, "vec_id long, label long, code string, error long")


def _moved(state: DataFrame, books: Codebooks) -> None:
    """Add up the blocks' sums, whose number of positions the codebooks fix, and move the entries."""
    entries, parts, width = len(books.entries[0]), len(books.entries), books.cuts[-1]
    found = state.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    sums = np.zeros(entries * (width + parts), np.int64)
    for r in found:
        sums[r["at"]] = r["x"]
    books.move(sums[: entries * width].reshape(entries, width), sums[entries * width :].reshape(parts, entries))


def compress(spark: SparkSession, vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, code and error of every kept vector, as a written table, and the codebooks. At most
    256 entries, so that a part's code is a byte."""
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("1 to 256 entries and at least one part")
    wc.prepare(spark)
    rows = kept(vectors)
    first = first_vectors(rows, entries)
    if not first:
        return spark.createDataFrame([], "vec_id long, label long, code string, error long"), None
    books = Codebooks(_whole(np.array(first), scale), parts)
    state = materialize(spark, _start(spark, rows, books, scale), "blocks")
    for k in range(rounds):
        _moved(state, books)
        if k + 1 < rounds:
            old, state = state, materialize(spark, _next(state, books), "blocks")
            release(old)
    out = materialize(spark, _encoded(state, books), "codes")
    release(state)
    return out, books


def with_label_errors(spark: SparkSession, codes: DataFrame) -> DataFrame:
    """``label_error``: the errors summed over equal labels. Labels are added up before they are joined
    back, so that a frequent one costs one row a task."""
    totals = materialize(spark, codes.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "of")
    side = F.broadcast(totals) if totals.count() <= MAX_SENT else totals
    return codes.join(side, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = with_label_errors(spark, codes).withColumn("codebooks_sha256", F.lit(books.digest() if books else None).cast("string"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    """Lloyd's rounds written out: every part meets every entry."""
    near = "SELECT vec_id, part, any_value(x) AS x, min(d * 64 + entry) % 64 AS entry, min(d * 64 + entry) // 64 AS d FROM (SELECT p.vec_id, p.part, p.x, b.entry, list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{k} b ON p.part = b.part) GROUP BY vec_id, part"
    mean = "SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{j} b LEFT JOIN (SELECT part, entry, list(v ORDER BY pos) AS c FROM (SELECT part, entry, pos, ((sum(x[pos]) - ((sum(x[pos]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v FROM a{j}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS pos) GROUP BY part, entry, pos) GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry"
    steps = ["b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64))"]
    for k in range(ROUNDS):
        steps += [f"a{k} AS MATERIALIZED ({near.format(k=k)})", f"b{k + 1} AS MATERIALIZED ({mean.format(j=k)})"]
    steps.append(f"a{ROUNDS} AS MATERIALIZED ({near.format(k=ROUNDS)})")
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, part, x[part * len(x) // 16 + 1:(part + 1) * len(x) // 16] AS x FROM v, (SELECT unnest(range(16)) AS part)
), {", ".join(steps)},
c AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
t AS (SELECT label, sum(error)::BIGINT AS label_error FROM c JOIN v USING (vec_id) GROUP BY label),
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT c.vec_id, code, error, label_error, codebooks_sha256 FROM c JOIN v USING (vec_id) JOIN t ON v.label IS NOT DISTINCT FROM t.label, s
"""


ORACLE = _oracle()
