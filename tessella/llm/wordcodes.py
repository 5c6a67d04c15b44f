"""Vectorised word hashing over whole Arrow text columns.

Words are found with byte masks and hashed with a wrapping 64-bit polynomial over a cumulative sum,
so a batch needs no Python object per word. Texts stay whole: slices end at row boundaries only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessella.session import ship_package

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

#: Bytes that end a word: [\x20\x09-\x0D].
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SPACED = ~BLANK
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_FOLDED, _PLAIN = _TABLE[LOWER], _TABLE

_powers = {"n": 0, "up": np.ones(0, np.uint64), "down": np.ones(0, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        m = max(n, SLICE_BYTES + 4096)
        up, down = np.full(m, _BASE), np.full(m, _INVERSE)
        up[0] = down[0] = 1
        _powers.update(n=m, up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end and the n + 1 row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column, b"")
    n = len(column)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES, rows: int = 1 << 30):
    """Row ranges [lo, hi) of about ``limit`` bytes; one row at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(n, lo + rows, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray, fold: bool = True):
    """(start, end, row, hash) of every word in ``data``; rows end words. ``off`` starts at 0."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    m = inside[data]
    first = np.zeros(n, bool)
    first[off[:-1][off[:-1] < n]] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, m[:-1]
    start = np.flatnonzero(m & (~before | first))
    last = np.zeros(n, bool)
    ends = off[1:][off[1:] > 0] - 1
    last[ends] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, m[1:]
    end = np.flatnonzero(m & (~after | last)) + 1
    up, down = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((_FOLDED if fold else _PLAIN)[data] * up[:n], dtype=np.uint64, out=total[1:])
    code = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    row = np.searchsorted(off, start, side="right") - 1
    return start, end, row, code


def windows(code: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of one row, and the index of the first word of each."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(n, np.uint64)
    for t in range(k):
        acc = (acc + code[t : t + n]) * np.uint64(0xA0761D6478BD642F)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(acc[at]), at


#: Bytes of records that one Python task holds at once.
PART_BYTES = 8 << 20


def parts_for(spark, total_bytes: int | None) -> int:
    """Partitions for so many bytes of records: as many as keep a part within PART_BYTES, whatever the
    session's number of shuffle partitions, and no more than eight where less would do."""
    conf = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-int(total_bytes or 0) // PART_BYTES), min(conf, 8), 1)


def prepare(spark) -> None:
    """Ship the package and, where the session still has Spark's default, let Arrow batches hold 512 rows: a
    default batch of long texts would not fit a Python worker. A size that was set is left alone. The
    setting is the session's and must hold until the lazy results are read, so it isn't taken back."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) in (None, "10000"):
        spark.conf.set(key, "512")
