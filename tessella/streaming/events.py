"""Structured Streaming forms: latest state per key, compare-and-set ratings, request and response
matching, sampled peaks. The reference has no dataflow streaming; these are Spark-native extensions of
its message handling and its versioned store."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.session import remove_path, scratch_path, ship_package

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
LATEST = "user_id long, event_id long, event_type string, value double, n long"
SNAPSHOT = "name string, revision string, payload string, accepted long, rejected long"
#: Writes of one name and trigger that a task holds; more are sorted in runs in its temp folder.
RUN = 500_000


def read_events(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).parquet(folder)


def _latest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, kind, value, n = state.get if state.exists else (-1, None, None, 0)
    for pdf in batches:
        n += len(pdf)
        row = pdf.loc[pdf["event_id"].idxmax()]
        if int(row["event_id"]) > last:
            last, kind, value = int(row["event_id"]), row["event_type"], float(row["value"])
    state.update((last, kind, value, n))
    yield pd.DataFrame([(key[0], last, kind, value, n)], columns=["user_id", "event_id", "event_type", "value", "n"])


def latest_state(events: DataFrame) -> DataFrame:
    """The newest event and the number of events of each user; one update per user and trigger."""
    return events.groupBy("user_id").applyInPandasWithState(_latest, LATEST, "event_id long, event_type string, value double, n long", "update", GroupStateTimeout.NoTimeout)


def _set_aside(rows: list[tuple]) -> Iterator[tuple]:
    file = tempfile.TemporaryFile()
    for k in range(0, len(rows), 10_000):
        pickle.dump(rows[k : k + 10_000], file)
    file.seek(0)

    def read():
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    return read()


def in_order(batches: Iterator[pd.DataFrame], columns: list[str], run: int = RUN) -> Iterator[tuple]:
    """Rows of a group by their first column. A group comes in batches as they were fetched, each in an
    order of its own, so all of them are sorted together; at most ``run`` rows and a batch are held."""
    runs, held = [], []
    for pdf in batches:
        held += pdf[columns].itertuples(index=False, name=None)
        if len(held) >= run:
            held.sort(key=itemgetter(0))
            runs.append(_set_aside(held))
            held = []
    held.sort(key=itemgetter(0))
    return heapq.merge(*runs, held, key=itemgetter(0)) if runs else iter(held)


def _write(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    import hashlib

    revision, payload, accepted, rejected = state.get if state.exists else (None, None, 0, 0)
    for order, expected, body in in_order(batches, ["_ord", "expected_revision", "payload"]):
        if expected is not None and expected == expected and expected != revision:
            rejected += 1
        else:
            revision, payload, accepted = hashlib.sha256(f"{key[0]}|{order}".encode()).hexdigest()[:16], body, accepted + 1
    state.update((revision, payload, accepted, rejected))
    yield pd.DataFrame([(key[0], revision, payload, accepted, rejected)], columns=["name", "revision", "payload", "accepted", "rejected"])


def rating_store(writes: DataFrame) -> DataFrame:
    """The streaming form of the snapshot fold; within a trigger writes apply in order."""
    return writes.groupBy("name").applyInPandasWithState(_write, SNAPSHOT, "revision string, payload string, accepted long, rejected long", "update", GroupStateTimeout.NoTimeout)


def match_responses(requests: DataFrame, responses: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Responses with their requests by id, within the time allowed; stray ids drop out and state is
    bounded by the watermarks."""
    q = requests.withWatermark("sent_at", delay).alias("q")
    r = responses.withWatermark("got_at", delay).alias("r")
    return q.join(r, F.expr(f"q.id = r.id and r.got_at >= q.sent_at and r.got_at <= q.sent_at + interval {delay}")).select("q.id", "q.method", "sent_at", "got_at", "r.ok")


def sampled_peaks(samples: DataFrame, width: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """Peak and count of a polled value per window of event time."""
    return samples.withWatermark("ts", delay).groupBy(F.window("ts", width)).agg(F.max("value").alias("peak"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "peak", "n")


def run_to_end(spark: SparkSession, stream: DataFrame, mode: str = "update") -> DataFrame:
    """Drain what is there now, write every update as Parquet in the application's scratch folder and read
    it back. The stream's own checkpoint goes when it has ended, the updates when the driver exits."""
    ship_package(spark)
    root = scratch_path(spark, "stream")
    out = f"{root}/out"

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/_b={batch_id}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
    q.awaitTermination()
    remove_path(spark, f"{root}/checkpoint")
    return spark.read.schema(stream.schema.add("_batch", "integer")).parquet(out)


def latest_of(updates: DataFrame, key: str) -> DataFrame:
    """The last update of each key."""
    rest = [c for c in updates.columns if c not in (key, "_batch", "_b")]
    best = updates.groupBy(key).agg(F.max_by(F.struct(*rest), F.col("_batch")).alias("s"))
    return best.select(key, "s.*")
