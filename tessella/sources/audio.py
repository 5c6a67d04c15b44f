"""WAV decoding and encoding, and tensor-file headers, from bytes that Spark has read."""

from __future__ import annotations

import io
import struct
import wave

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import dsp
from tessella.sources.blobs import HEADER, header_bytes, parse_header

_INFO = [("sample_rate", T.IntegerType()), ("channels", T.IntegerType()), ("frames", T.LongType()), ("duration_s", T.DoubleType()), ("format", T.StringType()), ("subtype", T.StringType()), ("error", T.StringType())]
INFO = T.StructType([T.StructField(n, t) for n, t in _INFO])
SOUND = T.StructType([*INFO.fields, T.StructField("x", T.ArrayType(T.DoubleType()))])


def decode_wav(raw: bytes) -> tuple[int, int, int, str, np.ndarray]:
    """(rate, channels, frames, subtype, mono samples) of PCM or float WAV bytes."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt, data = 12, None, b""
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
        if name == b"fmt ":
            fmt = struct.unpack("<HHIIHH", raw[at + 8 : at + 24])
            kind = struct.unpack("<H", raw[at + 32 : at + 34])[0] if fmt[0] == 0xFFFE and size >= 26 else fmt[0]
        elif name == b"data":
            data = raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if fmt is None:
        raise ValueError("WAV without a format chunk")
    channels, rate, bits = fmt[1], fmt[2], fmt[5]
    n = len(data) // (channels * bits // 8)
    data = data[: n * channels * bits // 8]
    if kind == 3:
        x = np.frombuffer(data, "<f4" if bits == 32 else "<f8").astype(float)
    elif bits == 24:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 8388608.0
    elif bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    else:
        x = np.frombuffer(data, f"<i{bits // 8}") / float(1 << (bits - 1))
    return rate, channels, n, "FLOAT" if kind == 3 else f"PCM_{bits}", x.reshape(-1, channels).mean(axis=1) if n else np.zeros(0)


def encode_pcm16(x, rate: int) -> bytes:
    """Mono 16-bit WAV bytes: clipped to one, scaled by 32767, truncated."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(int(rate))
        w.writeframes((np.clip(np.asarray(x, float), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def _row(raw: bytes, target: int | None, samples: bool) -> dict:
    out: dict = dict.fromkeys([n for n, _ in _INFO])
    try:
        rate, channels, n, subtype, x = decode_wav(bytes(raw))
        out.update(sample_rate=target or rate, channels=channels, frames=n, duration_s=n / rate if rate else 0.0, format="WAV", subtype=subtype)
        if samples:
            out["x"] = dsp.resample(x, rate, target).tolist() if target else x.tolist()
    except Exception as e:  # one bad file is a row with an error, never a failed job
        out["error"] = f"{type(e).__name__}: {e}"
    return out


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    """Whole numbers stay whole beside nulls."""
    return pd.DataFrame(rows, columns=names).astype({n: "Int64" for n in ("sample_rate", "channels", "frames")})


@F.pandas_udf(INFO)
def wav_info(content: pd.Series) -> pd.DataFrame:
    return _frame([_row(c, None, False) for c in content], INFO.names)


def decoded(spark: SparkSession, rows: DataFrame, target: int | None = None) -> DataFrame:
    """``rows`` (path, content, ...) with the decoded mono signal, resampled to ``target``."""
    keep = [c for c in rows.columns if c != "content"]
    schema = T.StructType([*[rows.schema[c] for c in keep], *SOUND.fields])

    def run(frames):
        for pdf in frames:
            more = _frame([_row(c, target, True) for c in pdf["content"]], SOUND.names)
            more["x"] = [None if not isinstance(v, list) else v for v in more["x"]]
            yield pd.concat([pdf[keep].reset_index(drop=True), more], axis=1)

    return rows.mapInPandas(run, schema)


@F.pandas_udf(T.BinaryType())
def pcm16(x: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([encode_pcm16(a, r) for a, r in zip(x, rate)])


@F.pandas_udf(T.ArrayType(HEADER))
def tensor_header(content: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(HEADER.names, r)) for r in parse_header(header_bytes(pa.BufferReader(c), len(c)))] for c in content])
