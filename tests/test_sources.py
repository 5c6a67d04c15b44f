import json
import struct
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import curate
from tessella.sources import audio, blobs, config, ordering, readers, sinks, versions
from tessella.streaming import events


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) if isinstance(r, dict) else r for r in rows), encoding="utf-8")
    return str(path)


def test_jsonl_and_manifest(spark, tmp_path):
    p = lines(tmp_path / "m.jsonl", [{"audio": "a", "text": "é"}, "", {"audio": "b"}])
    assert [(r.audio, r.text) for r in readers.jsonl(spark, p, readers.MANIFEST).orderBy("_ord").collect()] == [("a", "é"), ("b", None)]
    with pytest.raises(Exception, match="row without audio"):
        readers.manifest(spark, lines(tmp_path / "x.jsonl", [{"text": "q"}])).collect()
    with pytest.raises(Exception, match="not an object"):
        readers.manifest(spark, lines(tmp_path / "y.jsonl", ["[1"])).collect()
    ok = lines(tmp_path / "i.jsonl", [{"source": "s", "status": "ok"}, {"source": "t", "status": "reject"}])
    assert readers.ok_rows(spark, ok).count() == 1
    pv = lines(tmp_path / "p.jsonl", [{"file": "a\\b.wav", "text": "1"}, {"file": "a/b.wav", "text": "2"}])
    assert [(r.file, r.text) for r in readers.provenance(spark, pv).collect()] == [("a/b.wav", "2")]


def test_order_over_files_of_unequal_sizes(spark, tmp_path):
    """Spark packs files by size: the small first file is read after the large second one."""
    (tmp_path / "d").mkdir()
    lines(tmp_path / "d/part-0.json", [{"file": "x", "text": "first"}])
    lines(tmp_path / "d/part-1.json", [{"file": f"f{i % 400}", "text": str(i)} for i in range(3000)])
    lines(tmp_path / "d/part-2.json", [{"file": "x", "text": "last"}, {"file": "f0", "text": "end"}])
    rows = readers.jsonl(spark, str(tmp_path / "d"), "file string, text string")
    got = ordering.numbered(spark, rows).orderBy("_ord").collect()
    assert [r._ord for r in got] == list(range(3003)) and [r.text for r in got] == ["first", *map(str, range(3000)), "last", "end"]
    assert [r._line for r in got] == [1, *range(1, 3001), 1, 2]
    assert curate.first_wins(rows, "file", "_ord").where("file = 'x'").first().text == "first"
    assert {r.file: r.text for r in readers.provenance(spark, str(tmp_path / "d")).where("file in ('x', 'f0')").collect()} == {"x": "last", "f0": "end"}


def test_order_within_blocks_of_a_file(spark, tmp_path):
    """A file that is cut into blocks, read together with small ones, keeps its line numbers."""
    (tmp_path / "d").mkdir()
    lines(tmp_path / "d/a.json", [{"file": "a" * 50, "text": str(i)} for i in range(4000)])
    lines(tmp_path / "d/b.json", [{"file": "b", "text": "b"}])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = ordering.numbered(spark, readers.jsonl(spark, str(tmp_path / "d"), "file string, text string"))
        got = rows.orderBy("_ord").collect()
        assert len({r._file for r in got}) == 2 and [r.text for r in got] == [*map(str, range(4000)), "b"] and got[-1]._line == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_running_total(spark):
    rows = spark.range(500).selectExpr("id", "id % 7 as v").repartition(5)
    got = {r.id: r.s for r in ordering.running_total(spark, rows, ["id"], "v", "s").collect()}
    assert got == {i: sum(j % 7 for j in range(i)) for i in range(500)}
    assert ordering.running_total(spark, rows.where("id < 0"), ["id"], "v", "s").count() == 0


def test_manifest_names_the_line(spark, tmp_path):
    (tmp_path / "d").mkdir()
    lines(tmp_path / "d/a.jsonl", [{"audio": "a"}, "", "  ", {"audio": "", "text": None}])
    good = readers.manifest(spark, str(tmp_path / "d")).orderBy("_ord").collect()
    assert [(r.audio, r._line) for r in good] == [("a", 1), ("", 4)]
    lines(tmp_path / "d/b.jsonl", [{"audio": "b"}, "", {"text": "no key"}])
    with pytest.raises(Exception, match=r"manifest line 3 of \S*b.jsonl: row without audio: .*no key"):
        readers.manifest(spark, str(tmp_path / "d")).collect()
    lines(tmp_path / "d/b.jsonl", ["", "[{\"audio\": 1}]"])
    with pytest.raises(Exception, match="manifest line 2 of .*not an object"):
        readers.manifest(spark, str(tmp_path / "d")).collect()


def test_splits_are_sorted_across_files(spark, tmp_path):
    rows = spark.range(900).selectExpr("sha2(cast(id as string), 256) as fid", "'train' as split", "cast(null as string) as why").repartition(6)
    sinks.write_splits(rows, str(tmp_path / "s"))
    names = sorted((tmp_path / "s/train").glob("part-*.json"))
    got = [json.loads(x)["fid"] for n in names for x in n.read_text().splitlines()]
    assert len(names) > 1 and len(got) == 900 and got == sorted(got) and (tmp_path / "s/test").is_dir()


def test_reports_and_cases(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"results": [{"source": "a\\b", "speaker_cos": 0.1}, {"case_id": "c", "cer": 0.2}, {"source": "a/b", "speaker_cos": 0.3}]}, indent=2))
    assert {r.key: (r.speaker_cos, r.cer) for r in readers.report(spark, str(tmp_path / "r.json")).collect()} == {"a/b": (0.3, None), "c": (None, 0.2)}
    assert readers.prior_cases(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "c.json").write_text(json.dumps({"cases": [{"case_id": "x", "status": "ok"}], "model": {"revision": "r"}}))
    assert readers.prior_cases(spark, str(tmp_path / "c.json")).first().model_revision == "r"
    assert readers.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "c.json")]).endswith("c.json")


def test_files_and_import(spark, tmp_path):
    for name in ("in/x.wav", "in/sub/y.ogg", "in/z.mp3", "in/readme.txt"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(name.encode())
    listing = readers.files(spark, str(tmp_path / "in"), content=True)
    assert sorted(r.rel for r in listing.collect()) == ["sub/y.ogg", "x.wav", "z.mp3"]
    keys = spark.createDataFrame([(1, "x"), (2, "y"), (3, "q.wav"), (4, "z.mp3"), (5, "z.wav")], "_ord int, key string")
    assert {r.key: r.rel for r in readers.resolve_files(keys, listing).collect()} == {"x": "x.wav", "y": "sub/y.ogg", "q.wav": None, "z.mp3": "z.mp3", "z.wav": None}
    m = spark.createDataFrame([(1, "x", None), (2, "x.wav", "L"), (3, "x", "L"), (4, "none", None)], "_ord int, audio string, label string")
    got, missing = readers.import_rows(m, listing, "D")
    assert {r.target: r._ord for r in got.collect()} == {"D/x.wav": 1, "L/x.wav": 2} and [r.key for r in missing.collect()] == ["none"]
    (tmp_path / "in/a.txt").write_text("body\nmore")
    assert [(r.name, r.text) for r in readers.text_scripts(spark, str(tmp_path / "in")).collect()] == [("a.txt", "body\nmore")]


def test_wav_round_trip(spark, tmp_path):
    x = 0.5 * np.sin(np.arange(2400) / 10)
    (tmp_path / "a.wav").write_bytes(audio.encode_pcm16(x, 24000))
    (tmp_path / "bad.wav").write_bytes(b"nonsense")
    with wave.open(str(tmp_path / "s.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(3)
        w.setframerate(8000)
        w.writeframes(b"".join(int(v).to_bytes(3, "little", signed=True) for v in (4194304, 0) * 10))
    rows = readers.files(spark, str(tmp_path), content=True)
    got = {r.rel: r for r in audio.decoded(spark, rows.select("rel", "content")).collect()}
    assert np.abs(np.array(got["a.wav"].x) - x).max() < 1e-4 and got["a.wav"].subtype == "PCM_16"
    assert got["s.wav"].channels == 2 and got["s.wav"].x == [0.25] * 10
    assert got["bad.wav"].error and got["bad.wav"].x is None
    assert {r.rel: r.i.frames for r in rows.select("rel", audio.wav_info("content").alias("i")).collect()}["a.wav"] == 2400
    r = spark.createDataFrame([([2.0, -2.0, 0.5], 8000)], "x array<double>, sr int").select(audio.pcm16("x", "sr").alias("b")).first().b
    assert audio.decode_wav(bytes(r))[4].tolist() == [32767 / 32768, -32767 / 32768, 16383 / 32768]


def test_tensor_headers(spark, tmp_path):
    head = json.dumps({"__metadata__": {"a": "b"}, "k": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, "s": {"dtype": "F16", "shape": [], "data_offsets": [24, 26]}}).encode()
    (tmp_path / "t.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + b"\0" * 26)
    want = {("k", "F32", (2, 3), 6), ("s", "F16", (), 1)}
    raw = spark.read.format("binaryFile").load(str(tmp_path / "t.safetensors"))
    assert {(r.key, r.dtype, tuple(r.shape), r.numel) for r in raw.select(F.inline(audio.tensor_header("content"))).collect()} == want
    blobs.register(spark)
    assert {(r.key, r.dtype, tuple(r.shape), r.numel) for r in spark.read.format("tensor_header").load(str(tmp_path)).collect()} == want


def test_config(tmp_path):
    env = config.read_env("# c\nA=1\nB='two'\n\n")
    assert config.expand({"x": ["${A}", "${Z:d}"], "y": 3}, env) == {"x": ["1", "d"], "y": 3}
    with pytest.raises(config.ConfigError):
        config.expand("${Z}", env)
    (tmp_path / "b.json").write_text('{"python": "${A}"}')
    assert config.load(str(tmp_path / "b.json"), env) == {"python": "1"} and config.catalog(str(tmp_path)) == ["b"]
    with pytest.raises(config.ConfigError):
        config.check_backend({"python": "p", "script": "s"})
    with pytest.raises(config.ConfigError):
        config.check_cases([{"kind": "odd"}])


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", "train", None), ("a", "train", None), ("c", "test", None), ("d", None, "dup_text")], "fid string, split string, why string")
    sinks.write_splits(rows, str(tmp_path / "s"))
    assert spark.read.schema("fid string").json(str(tmp_path / "s/train")).count() == 2 and spark.read.schema("fid string").json(str(tmp_path / "s/validation")).count() == 0
    assert sinks.read_snapshot(spark, str(tmp_path / "v"), rows.limit(1)).count() == 1
    versions.commit(spark, rows.limit(3), str(tmp_path / "v"))
    assert sinks.read_snapshot(spark, str(tmp_path / "v"), rows.limit(1)).count() == 3
    pool = sinks.content_pool(spark.createDataFrame([(b"x",), (b"x",), (b"y",)], "content binary"))
    assert pool.count() == 2
    paths = spark.createDataFrame([("a/b.wav",), ("../x",), ("a/../../x",), ("/abs",), ("C:\\x",), ("a/../b",)], "p string")
    assert [r[0] for r in paths.select(sinks.safe_relative(F.col("p"))).collect()] == [True, False, False, False, False, True]
    side = sinks.sidecars(spark.createDataFrame([("c1", "d/o.wav"), ("c2", None)], "case_id string, output string")).collect()
    assert [(r.path, json.loads(r.json)) for r in side] == [("d/o.json", {"case_id": "c1"})]
    assert sinks.markdown(rows.select("fid").limit(1)).startswith("| fid |")


def test_streams_equal_batch(spark, tmp_path):
    e = spark.createDataFrame([(i, i % 4, f"t{i % 3}", float(i)) for i in range(50)], "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id") + 1000000)).withColumn("props", F.lit("{}"))
    e.select("event_id", "ts", "user_id", "event_type", "value", "props").repartition(3).write.parquet(str(tmp_path / "in/events.parquet"))
    src = events.read_events(spark, str(tmp_path / "in/events.parquet"), "*.parquet")
    got = {r.user_id: (r.event_id, r.n) for r in events.latest_of(events.run_to_end(spark, events.latest_state(src)), "user_id").collect()}
    assert got == {0: (48, 13), 1: (49, 13), 2: (46, 12), 3: (47, 12)}
    from tessella.operators.ratings import fold_snapshots

    writes = lambda d: d.select(F.col("event_id").alias("_ord"), F.col("user_id").cast("string").alias("name"), F.when(F.col("event_id") % 3 == 0, "stale").alias("expected_revision"), F.col("event_type").alias("payload"))
    stream = events.latest_of(events.run_to_end(spark, events.rating_store(writes(src))), "name")
    key = lambda r: (r.name, r.revision, r.payload, r.accepted, r.rejected)
    assert sorted(map(key, stream.collect())) == sorted(map(key, fold_snapshots(writes(e)).collect()))
    peaks = events.run_to_end(spark, events.sampled_peaks(src, "10 seconds", "5 seconds"), "append").orderBy("start").collect()
    assert [r.peak for r in peaks][:3] == [9.0, 19.0, 29.0]
    q = src.where("event_type = 't0'").select(F.col("event_id").alias("id"), F.lit("generate").alias("method"), F.col("ts").alias("sent_at"))
    a = src.where("event_type <> 't1'").select(F.col("event_id").alias("id"), F.col("ts").alias("got_at"), F.lit(True).alias("ok"))
    assert events.run_to_end(spark, events.match_responses(q, a), "append").count() == 17


def test_store_applies_shuffled_writes_in_order(spark, tmp_path):
    """A name's writes come in many batches whose rows are mixed."""
    from tessella.operators.ratings import fold_snapshots

    w = spark.range(3000).select(F.col("id").alias("_ord"), (F.col("id") % 2).cast("string").alias("name"), F.when(F.col("id") % 3 == 0, "stale").alias("expected_revision"), F.concat(F.lit("p"), "id").alias("payload"))
    w.repartition(3, F.hash("_ord")).sortWithinPartitions(F.xxhash64("_ord")).write.parquet(str(tmp_path / "in"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        out = events.run_to_end(spark, events.rating_store(spark.readStream.schema(w.schema).parquet(str(tmp_path / "in"))))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    key = lambda r: (r.name, r.revision, r.payload, r.accepted, r.rejected)
    assert sorted(map(key, events.latest_of(out, "name").collect())) == sorted(map(key, fold_snapshots(w).collect()))
    frames = [pd.DataFrame({"a": a, "b": [str(v) for v in a]}) for a in ([5, 1, 9], [4, 8], [2, 7, 0], [3, 6])]
    for run in (1, 4, 100):
        assert list(events.in_order(iter(frames), ["a", "b"], run)) == [(k, str(k)) for k in range(10)]


def test_versions(spark, tmp_path):
    path, rows = str(tmp_path / "v"), spark.range(6)
    assert versions.current(spark, path) is None
    first = versions.commit(spark, rows.limit(1), path, expected=None)
    second = versions.commit(spark, rows.limit(2), path, expected=first.revision)
    assert (first.number, second.number, second.parent) == (1, 2, first.revision)
    for stale in (first.revision, None, "other"):
        with pytest.raises(versions.VersionConflict, match=second.revision):
            versions.commit(spark, rows, path, expected=stale)
    third = versions.commit(spark, rows.limit(3), path)  # without an expectation the newest is replaced
    assert versions.read(spark, path).count() == 3 and versions.read(spark, path, 1).count() == 1
    assert [(r.number, r.parent) for r in versions.history(spark, path).collect()] == [(1, None), (2, first.revision), (3, second.revision)]
    assert {r._number: r.n for r in versions.version_rows(spark, path).groupBy("_number").agg(F.count("*").alias("n")).collect()} == {1: 1, 2: 2, 3: 3}
    (tmp_path / "v/data/left-by-a-failed-writer").mkdir()
    assert versions.vacuum(spark, path, keep=2) == [1] and sorted(p.name for p in (tmp_path / "v/data").iterdir()) == sorted([second.revision, third.revision])
    assert versions.read(spark, path).count() == 3 and versions.history(spark, path).count() == 3


def test_version_read_opens_one_folder(spark, tmp_path):
    path = str(tmp_path / "v")
    for n in (1, 2, 3):
        last = versions.commit(spark, spark.range(n), path)
    files = versions.read(spark, path).inputFiles()
    assert files and all(last.revision in f for f in files)


def test_concurrent_writers_of_a_version(spark, tmp_path, monkeypatch):
    """Both writers have passed the first check and written their rows when the first publishes."""
    path = str(tmp_path / "v")
    base = versions.commit(spark, spark.range(1), path)
    publish, seen = versions._Store.publish, []

    def late(store, text, folder, name):
        if not seen:
            seen.append(True)
            assert versions.commit(spark, spark.range(7), path, expected=base.revision).number == 2
        return publish(store, text, folder, name)

    monkeypatch.setattr(versions._Store, "publish", late)
    with pytest.raises(versions.VersionConflict):
        versions.commit(spark, spark.range(5), path, expected=base.revision)
    assert versions.read(spark, path).count() == 7 and len(list((tmp_path / "v/data").iterdir())) == 2
    seen.clear()
    monkeypatch.setattr(versions._Store, "publish", lambda s, t, f, n: (seen.append(n), publish(s, t, f, n))[1] if seen else (seen.append(n), False)[1])
    assert versions.commit(spark, spark.range(4), path).number == 3 and len(seen) == 2  # without an expectation the writer tries again
    assert [p.name for p in sorted((tmp_path / "v/log").iterdir()) if not p.name.endswith(".crc")] == [f"{n:020d}.json" for n in (1, 2, 3)]


def test_publishing_is_create_if_absent(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    stores = [versions._Store(spark, str(tmp_path)) for _ in range(8)]
    for k in range(5):
        with ThreadPoolExecutor(8) as pool:
            won = list(pool.map(lambda x: x[1].publish(f"writer {x[0]}", "log", f"{k}.json"), enumerate(stores)))
        assert sum(won) == 1 and (tmp_path / f"log/{k}.json").read_text() == f"writer {won.index(True)}"
    assert len([p for p in (tmp_path / "log").iterdir() if not p.name.endswith(".crc")]) == 5


def test_content_pool_files(spark, tmp_path):
    pool = str(tmp_path / "pool")
    rows = spark.createDataFrame([(b"x",), (b"x",), (b"y",), (b"",), (None,)], "content binary").repartition(3)
    sinks.add_to_pool(spark, rows, pool)
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "pool").iterdir()}
    sinks.add_to_pool(spark, spark.createDataFrame([(b"y",), (b"z",)], "content binary"), pool)
    import hashlib

    names = lambda *v: {hashlib.sha256(x).hexdigest() + ".wav" for x in v}
    found = {p.name for p in (tmp_path / "pool").iterdir() if p.is_file()}
    assert found == names(b"x", b"y", b"z", b"") and not list((tmp_path / "pool/_staging").iterdir())
    assert all((tmp_path / "pool" / n).stat().st_mtime_ns == before[n] for n in names(b"x", b"y", b""))


def test_failed_task_leaves_no_name(spark, tmp_path):
    pool = str(tmp_path / "pool")
    blobs.register(spark)
    fails = F.when(F.col("id") == 37, F.raise_error(F.lit("broken row")).cast("binary")).otherwise(F.col("id").cast("string").cast("binary"))
    with pytest.raises(Exception, match="broken row"):
        spark.range(0, 40, 1, 1).select(fails.alias("content")).write.format("content_pool").mode("append").save(pool)
    assert not [p for p in (tmp_path / "pool").rglob("*") if p.is_file()] and not list((tmp_path / "pool/_staging").iterdir())
    with pytest.raises(Exception, match="only grows"):
        spark.range(1).select(F.lit(b"a").alias("content")).write.format("content_pool").mode("overwrite").save(pool)


def test_headers_by_range(spark, tmp_path, monkeypatch):
    """Only headers are read; broken files are rows; filters decide which files are opened."""
    blobs.register(spark)
    head = lambda **keys: (lambda h: struct.pack("<Q", len(h)) + h)(json.dumps({k: {"dtype": "F16", "shape": v, "data_offsets": [0, 0]} for k, v in keys.items()}).encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.safetensors").write_bytes(head(x=[2, 3], y=[]) + b"\0" * 5000)
    (tmp_path / "sub/b.safetensors").write_bytes(head(x=[4]))
    (tmp_path / "c.safetensors").write_bytes(struct.pack("<Q", 1 << 40) + b"{}")
    (tmp_path / "d.safetensors").write_bytes(b"abc")
    (tmp_path / "e.safetensors").write_bytes(struct.pack("<Q", 4) + b"{bad")
    (tmp_path / "f.bin").write_bytes(b"no")
    rows = spark.read.format("tensor_header").option("files", 2).load(str(tmp_path))
    got = {(r.path.split("/")[-1][0], r.key, r.numel, (r.error or "").split(":")[0]) for r in rows.collect()}
    assert got == {("a", "x", 6, ""), ("a", "y", 1, ""), ("b", "x", 4, ""), ("c", None, None, "ValueError"), ("d", None, None, "ValueError"), ("e", None, None, "JSONDecodeError")}
    assert rows.rdd.getNumPartitions() == 3
    reader = blobs.TensorHeaderReader(str(tmp_path), ".safetensors", 1)
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringEndsWith

    other = GreaterThan(("numel",), 2)
    assert list(reader.pushFilters([StringEndsWith(("path",), "a.safetensors"), EqualTo(("key",), "y"), other])) == [other]
    parts = reader.partitions()
    assert len(parts) == 1 and [r[2] for r in reader.read(parts[0])] == ["y"]
    read = []

    class Opened:
        def read_at(self, n, at):
            read.append(n)
            return (head(x=[2]) + b"\0" * 999)[at : at + n]

    assert blobs.parse_header(blobs.header_bytes(Opened(), 10**9)) == [("x", "F16", [2], 2)] and sum(read) < 100


def test_headers_of_many_files_stay_out_of_the_driver(tmp_path):
    """What passes the driver doesn't grow with the files; every file is in exactly one share."""
    import pickle

    head = json.dumps({"x": {"dtype": "F16", "shape": [2], "data_offsets": [0, 4]}}).encode()
    for folder, n in (("m0", 3000), ("m1", 30), ("m1/deep", 20), ("none", 0)):
        (tmp_path / folder).mkdir()
        for k in range(n):
            (tmp_path / folder / f"{k}.safetensors").write_bytes(struct.pack("<Q", len(head)) + head)
    for files in (256, 10, 1):
        reader = blobs.TensorHeaderReader(str(tmp_path), ".safetensors", files)
        parts = reader.partitions()
        assert len(pickle.dumps(parts)) < 20_000
        paths = [r[0].removeprefix(f"{tmp_path}/") for p in parts for r in reader.read(p)]
        assert sorted(paths) == sorted(f"{folder}/{k}.safetensors" for folder, n in (("m0", 3000), ("m1", 30), ("m1/deep", 20)) for k in range(n))
    one = blobs.TensorHeaderReader(str(tmp_path / "m1/7.safetensors"), ".safetensors", 256)
    assert [r[:4] for p in one.partitions() for r in one.read(p)] == [(str(tmp_path / "m1/7.safetensors"), 8 + len(head), "x", "F16")]
    assert blobs.TensorHeaderReader(str(tmp_path / "absent"), ".safetensors", 256).partitions() == []


def test_header_filters_stay_out_of_the_driver(tmp_path):
    """A filter on the path counts and deals only the files that pass it; one on the key leaves no other row."""
    import pickle

    from pyspark.sql.datasource import EqualTo, StringEndsWith

    head = json.dumps({k: {"dtype": "F16", "shape": [2], "data_offsets": [0, 4]} for k in "xy"}).encode()
    for k in range(3000):
        (tmp_path / f"{k}.safetensors").write_bytes(struct.pack("<Q", len(head)) + head)
    reader = blobs.TensorHeaderReader(str(tmp_path), ".safetensors", 256)
    assert not list(reader.pushFilters([StringEndsWith(("path",), "4.safetensors"), EqualTo(("key",), "y")]))
    parts = reader.partitions()
    assert len(parts) == 2 and len(pickle.dumps(parts)) < 2000
    assert sorted((r[0], r[2]) for p in parts for r in reader.read(p)) == sorted((f"{tmp_path}/{k}.safetensors", "y") for k in range(4, 3000, 10))


def test_request_state_with_timers(spark, tmp_path):
    """Deadlines fire when the watermark passes them, in triggers of their own; answers afterwards are late
    and, once the request is forgotten, stray."""
    from datetime import datetime, timedelta

    from tessella.streaming import requests

    t0 = datetime(2024, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    files = [
        [("w", "a", at(0), 0, "request", "m", None), ("w", "b", at(1), 1, "request", "m", None), ("v", "a", at(2), 2, "request", "n", None), ("w", "x", at(3), 3, "response", None, True)],
        [("w", "a", at(5), 4, "response", None, True), ("w", "a", at(6), 5, "response", None, True), ("w", "b", at(7), 6, "request", "m", None), ("v", "a", at(40), 7, "response", None, False), (None, "q", at(41), 8, "request", "m", None), ("w", "q", at(41), 8, "note", "m", None)],
        [("w", "z", at(200), 9, "request", "m", None)],
        [("w", "b", at(201), 10, "response", None, True), ("v", "c", at(202), 11, "request", "n", None), ("v", "c", at(203), 12, "response", None, False)],
        [("w", "y", at(9000), 13, "request", "m", None)],
        [("w", "b", at(9001), 14, "response", None, True)],
    ]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, requests.MESSAGES).coalesce(1).write.parquet(str(tmp_path / f"in/{k}.parquet"))
    source = spark.readStream.schema(requests.MESSAGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
    told = events.run_to_end(spark, requests.track(source, 30, delay="1 second", keep_s=600), "append")
    got = {(r.worker, r.id, r.seq, r.outcome, (r.at - t0).total_seconds()) for r in told.collect()}
    assert got == {
        ("w", "a", 0, "pending", 0), ("w", "b", 1, "pending", 1), ("v", "a", 2, "pending", 2), ("w", "x", 3, "stray", 3),
        ("w", "a", 4, "answered", 5), ("w", "a", 5, "stray", 6), ("w", "b", 6, "repeated", 7), ("v", "a", 2, "timed_out", 32), ("v", "a", 7, "late", 40),
        ("w", "z", 9, "pending", 200), ("w", "b", 1, "timed_out", 31), ("w", "b", 10, "late", 201), ("v", "c", 11, "pending", 202), ("v", "c", 12, "failed", 203),
        ("w", "z", 9, "timed_out", 230), ("w", "y", 13, "pending", 9000), ("w", "b", 14, "stray", 9001),
    }
    ends = spark.createDataFrame([("w", at(9002)), ("v", at(203))], "worker string, end timestamp")
    last = {(r.worker, r.id): (r.outcome, (r.at - t0).total_seconds()) for r in requests.settle(told.drop("_batch"), ends).where("outcome in ('answered', 'failed', 'timed_out', 'closed')").collect()}
    assert last == {("w", "a"): ("answered", 5), ("w", "b"): ("timed_out", 31), ("v", "a"): ("timed_out", 32), ("w", "z"): ("timed_out", 230), ("v", "c"): ("failed", 203), ("w", "y"): ("closed", 9002)}


def test_requests_share_state_groups(spark, tmp_path):
    """Many requests of one worker are few groups of state, and each keeps its own outcome."""
    from tessella.streaming import requests

    n = 20_000
    row = lambda shift, kind: (F.lit("w").alias("worker"), F.col("id").cast("string").alias("id"), F.timestamp_seconds(F.lit(1_700_000_000 + shift) + F.col("id") % 100).alias("at"), (2 * F.col("id") + int(kind == "response")).alias("seq"), F.lit(kind).alias("kind"), F.lit("m").alias("method"), (F.col("id") % 2 == 0).alias("ok"))
    asked, answered = spark.range(n).select(*row(0, "request")), spark.range(n).where("id % 4 <> 3").select(*row(20, "response"))
    asked.unionByName(answered).repartition(3).write.parquet(str(tmp_path / "in"))
    source = requests.track(spark.readStream.schema(requests.MESSAGES).parquet(str(tmp_path / "in")), 30)
    query = source.writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 4096
    got = {r.outcome: r["count"] for r in spark.table("told").groupBy("outcome").count().collect()}
    assert got == {"pending": n, "answered": n // 2, "failed": n // 4}


def test_answer_of_an_earlier_clock(spark, tmp_path):
    """An answer sent after its request ends it, whatever its clock says."""
    from datetime import datetime

    from tessella.streaming import requests

    rows = [("w", "a", datetime(2024, 1, 2), 0, "request", "m", None), ("w", "a", datetime(2024, 1, 1), 1, "response", None, True)]
    spark.createDataFrame(rows, requests.MESSAGES).coalesce(1).write.parquet(str(tmp_path / "in"))
    told = events.run_to_end(spark, requests.track(spark.readStream.schema(requests.MESSAGES).parquet(str(tmp_path / "in")), 30), "append")
    assert "answered" in {r.outcome for r in told.collect()} and told.where("outcome = 'stray'").count() == 0


def test_streams_leave_no_checkpoint(spark, tmp_path):
    import glob

    spark.createDataFrame([("w", "a")], "worker string, id string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("worker string, id string").parquet(str(tmp_path / "in"))
    updates = events.run_to_end(spark, source, "append")
    assert updates.count() == 1
    root = spark.sparkContext._tessella_scratch.removeprefix("file://").removeprefix("file:")
    assert glob.glob(f"{root}/stream-*/out") and not glob.glob(f"{root}/stream-*/checkpoint")
