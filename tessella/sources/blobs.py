"""Data sources over many files of a shared store: headers read by range, and contents stored by hash.

Tasks open files through ``pyarrow.fs``, so a path may be a shared folder (``file:///...``) or any store that
it knows by URI. Nothing is read or written on a machine's own disk unless the path says so.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage

from tessella.session import ship_package

HEADER = T.StructType([T.StructField("key", T.StringType()), T.StructField("dtype", T.StringType()), T.StructField("shape", T.ArrayType(T.LongType())), T.StructField("numel", T.LongType())])
#: Files that one task opens, and the longest header that is read.
FILES, MAX_HEADER = 256, 100_000_000
#: Tasks among which the files of one folder are dealt at most: each lists the folder, which this keeps below
#: the cost of opening the files.
SHARES = 32


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def entries(store: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """(path, whether it is a folder) of the files and folders in ``folder``: on mounted disks one at a time;
    other stores give the listing of a folder whole."""
    if isinstance(store, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            for x in found:
                if x.is_dir() or x.is_file():
                    yield f"{folder.rstrip('/')}/{x.name}", x.is_dir()
    else:
        for x in store.get_file_info(pafs.FileSelector(folder)):
            if x.type in (pafs.FileType.Directory, pafs.FileType.File):
                yield x.path, x.type == pafs.FileType.Directory


def parse_header(raw: bytes) -> list[tuple]:
    """(key, dtype, shape, numel) of a tensor file's header; no tensor data is looked at."""
    rows = []
    for key, meta in json.loads(raw).items():
        if key != "__metadata__":
            shape = [int(d) for d in meta["shape"]]
            rows.append((key, meta["dtype"], shape, int(np.prod(shape, dtype=np.int64)) if shape else 1))
    return rows


def header_bytes(file, length: int) -> bytes:
    """The header of an open tensor file: eight bytes that tell its length, and as many as that."""
    if length < 8:
        raise ValueError("shorter than its length field")
    size = struct.unpack("<Q", file.read_at(8, 0))[0]
    if size > min(length - 8, MAX_HEADER):
        raise ValueError(f"header of {size} bytes in a file of {length}")
    return file.read_at(size, 8)


class TensorHeaderSource(DataSource):
    """``spark.read.format("tensor_header").load(path)``: a row for each tensor of each file below ``path``
    (path, length, key, dtype, shape, numel), read from the header alone; a file that can't be read is a
    row with its ``error``. Filters on path and key are applied before files are opened and rows are made.
    The driver walks the folders and counts their files; tasks list their own share of a folder, so what
    passes the driver grows with the folders, not with the files."""

    @classmethod
    def name(cls) -> str:
        return "tensor_header"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), *HEADER.fields, T.StructField("error", T.StringType())])

    def reader(self, schema) -> TensorHeaderReader:
        return TensorHeaderReader(self.options["path"], self.options.get("suffix", ".safetensors"), int(self.options.get("files", FILES)))


class TensorHeaderReader(DataSourceReader):
    def __init__(self, root: str, suffix: str, files: int):
        self.root, self.suffix, self.files = root, suffix, files
        self.tests: dict[str, list[tuple[str, object]]] = {"path": [], "key": []}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = {EqualTo: "equal", In: "in", StringStartsWith: "starts", StringEndsWith: "ends"}.get(type(f))
            if name in self.tests and kind:
                self.tests[name].append((kind, f.value))
            else:
                yield f

    def _passes(self, column: str, value: str | None) -> bool:
        checks = {"equal": lambda v, x: v == x, "in": lambda v, x: v in x, "starts": lambda v, x: v.startswith(x), "ends": lambda v, x: v.endswith(x)}
        return all(value is not None and checks[kind](value, x) for kind, x in self.tests[column])

    def _wanted(self, path: str) -> bool:
        return path.endswith(self.suffix) and self._passes("path", path)

    def partitions(self):
        """Shares of folders, each a list of (folder, share, shares); small folders go together."""
        store, root = open_store(self.root)
        kind = store.get_file_info(root).type
        if kind != pafs.FileType.Directory:
            return [InputPartition([(root, 0, 0)])] if kind == pafs.FileType.File and self._wanted(root) else []
        parts, small, held, waiting = [], [], 0, [root]
        while waiting:
            folder, n = waiting.pop(), 0
            for path, nested in entries(store, folder):
                if nested:
                    waiting.append(path)
                elif self._wanted(path):
                    n += 1
            shares = min(-(-n // self.files), SHARES)
            if shares > 1:
                parts += [InputPartition([(folder, k, shares)]) for k in range(shares)]
            elif n:
                if held + n > self.files:
                    parts.append(InputPartition(small))
                    small, held = [], 0
                small.append((folder, 0, 1))
                held += n
        return parts + ([InputPartition(small)] if small else [])

    def _files(self, store: pafs.FileSystem, folder: str, share: int, shares: int) -> Iterator[str]:
        if not shares:  # a file of its own
            yield folder
            return
        for path, nested in entries(store, folder):
            if not nested and self._wanted(path) and zlib.crc32(path.encode()) % shares == share:
                yield path

    def read(self, partition):
        store, _ = open_store(self.root)
        for path in (p for part in partition.value for p in self._files(store, *part)):
            length = None
            try:
                with store.open_input_file(path) as file:
                    length = file.size()
                    rows, error = parse_header(header_bytes(file, length)), None
            except Exception as e:  # a broken file is a row
                rows, error = [(None, None, None, None)], f"{type(e).__name__}: {e}"
                length = store.get_file_info(path).size if length is None else length
            for row in rows:
                if self._passes("key", row[0]):
                    yield (path, length, *row, error)


class Stored(WriterCommitMessage):
    def __init__(self, new: int, known: int):
        self.new, self.known = new, known


class ContentPool(DataSource):
    """``df.write.format("content_pool").mode("append").save(path)``: a file for each distinct ``content``, named
    by its hash and the option ``suffix``, or by the column ``name`` where there is one.

    A task writes to names of its own below ``_staging`` and hashes what it writes; only when all its rows
    are there do they get their final names, each by one rename. A task that fails removes what it staged,
    the end of the job, good or bad, what is left. A name is taken once: contents that the pool has, from
    an earlier batch or another task, are not stored again."""

    @classmethod
    def name(cls) -> str:
        return "content_pool"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("content", T.BinaryType())])

    def writer(self, schema, overwrite: bool) -> ContentPoolWriter:
        if overwrite:
            raise ValueError("a pool only grows: use mode append")
        return ContentPoolWriter(self.options["path"], self.options.get("suffix", ""), "name" in schema.names)


class ContentPoolWriter(DataSourceWriter):
    def __init__(self, root: str, suffix: str, named: bool):
        self.root, self.suffix, self.named, self.job = root, suffix, named, uuid.uuid4().hex

    def _staging(self) -> tuple[pafs.FileSystem, str, str]:
        store, root = open_store(self.root)
        return store, root.rstrip("/"), f"{root.rstrip('/')}/_staging/{self.job}"

    def write(self, iterator) -> Stored:
        store, root, staging = self._staging()
        own, staged, known = f"{staging}/{uuid.uuid4().hex}", {}, 0
        store.create_dir(own, recursive=True)
        try:
            for row in iterator:
                if row["content"] is None:
                    continue
                content = bytes(row["content"])
                digest = hashlib.sha256(content).hexdigest()
                name = (row["name"] if self.named else None) or digest + self.suffix
                if name in staged or store.get_file_info(f"{root}/{name}").type == pafs.FileType.File:
                    known += 1
                    continue
                aside = f"{own}/{len(staged)}"
                with store.open_output_stream(aside) as out:
                    out.write(content)
                staged[name] = aside
            for name, aside in staged.items():
                if "/" in name:
                    store.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                store.move(aside, f"{root}/{name}")
        finally:
            store.delete_dir(own)
        return Stored(len(staged), known)

    def _clear(self) -> None:
        store, _, staging = self._staging()
        if store.get_file_info(staging).type == pafs.FileType.Directory:
            store.delete_dir(staging)

    def commit(self, messages) -> None:
        self._clear()

    def abort(self, messages) -> None:
        self._clear()


def register(spark) -> None:
    """Make both formats known to the session and its workers, and let filters reach Python sources."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TensorHeaderSource, ContentPool):
        spark.dataSource.register(source)
