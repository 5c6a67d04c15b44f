"""Byte-pair encoding by longest matches and backtracking, and decoding by an offset table.

A piece of text is encoded from left to right. An Aho-Corasick automaton gives the longest token at every
place; a token may follow the one before it if byte-pair merging would leave just these two of their
bytes, which is looked up in a table of pairs. Where a token may not follow, the next shorter one is tried,
and a place that no token leaves is never entered again, so the work is linear in the piece. The first
sequence that reaches the end is the one that merging by rank gives. Token ids become text through one
array of all token bytes and one of offsets.

The vocabulary file's own pieces are kept: merging never crosses them. They are found by its published
pattern; texts with characters that the pattern's Unicode version knows and Python's doesn't go through
the file's own splitter, which may know neither. The strings of added tokens are tokens of their own.

Cases: a null or empty text has no ids, and no ids decode to the empty text; a text of any length is
encoded whole; rows that share an id or are equal in all are each encoded; a null id stays null; of tokens that
match at one place the longest that may follow wins, so nothing is left to a tie; ids outside the vocabulary decode to
nothing, and bytes that are no UTF-8 to the replacement character; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import wordcodes as wc

#: Entries that a worker remembers of pieces (twice as many) and of pairs; forgetting costs time only.
MAX_KNOWN = 1 << 19
_NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabulary files: printable bytes stand for
    themselves, the rest follow from code point 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level vocabulary file with its merges, ready to encode pieces. Tokens are held as strings of
    code points below 256, one for each byte."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        alphabet, ids = byte_alphabet(), file["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.tokens = {i: "".join(chr(alphabet[c]) for c in t) for t, i in ids.items()}
        self.length = {i: len(t) for i, t in self.tokens.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        self.rank = {(ids[a], ids[b]): k for k, (a, b) in enumerate(pairs)}
        self.ends = {i: (((i, _NEVER),), ((i, _NEVER),)) for i, t in self.tokens.items() if len(t) == 1}
        for (a, b), k in self.rank.items():
            whole = ids[pairs[k][0] + pairs[k][1]]
            # a token that its own bytes would not be merged to never occurs in a result
            if a in self.ends and b in self.ends and whole not in self.ends and not self._crossed(a, b, k):
                fall = lambda edge: ((edge[0][0], k), *edge[1:])  # noqa: B023, E731
                self.ends[whole] = ((((whole, _NEVER), *fall(self.ends[a][0]))), (((whole, _NEVER), *fall(self.ends[b][1]))))
        self.find = ahocorasick.Automaton()
        by_text = {self.tokens[i]: i for i in self.ends}
        for t, i in by_text.items():
            self.find.add_word(t, i)
        self.find.make_automaton()
        self.by_text = by_text
        self.shorter = {i: next((by_text[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_text), None) for t, i in by_text.items()}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _crossed(self, a: int, b: int, limit: int = _NEVER) -> bool:
        """Would a merge join the end of ``a`` with the beginning of ``b`` before rank ``limit``? ``ends`` has
        for each token the parts that stood at its left and at its right edge while it was merged, each with
        the rank at which it was taken up. Of equal pairs the left one is merged first."""
        for x, gone in self.ends[a][1]:
            for y, taken in self.ends[b][0]:
                k = self.rank.get((x, y), _NEVER)
                if k < min(gone, limit) and k <= taken:
                    return True
        return False

    def follows(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MAX_KNOWN:
                self.pairs.clear()
            known = self.pairs[a, b] = not self._crossed(a, b)
        return known

    def encode(self, piece: str) -> list[int]:
        """Ids of a piece, given as one code point below 256 for each byte."""
        whole = self.by_text.get(piece)
        if whole is not None:
            return [whole]
        out, pairs, n = [token for _, token in self.find.iter_long(piece)], self.pairs, len(piece)
        for good, pair in enumerate(zip(out, out[1:]), 1):
            known = pairs.get(pair)
            if not (self.follows(*pair) if known is None else known):
                break
        else:
            return out
        # the first ``good`` longest matches stand; from here shorter ones are tried
        length, shorter, token = self.length, self.shorter, out[good]
        del out[good:]
        at, last = sum([length[t] for t in out]), out[-1]
        longest = [-1] * n
        for stop, match in self.find.iter(piece):  # of tokens that begin at one place the longest ends last
            longest[stop + 1 - length[match]] = match
        dead = bytearray(n + 1)
        while at < n:
            while token is not None:
                end = at + length[token]
                if not dead[end]:
                    if last is None:
                        break
                    known = pairs.get((last, token))
                    if known or (known is None and self.follows(last, token)):
                        break
                token = shorter[token]
            if token is None:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else None
            else:
                out.append(token)
                at, last = end, token
                token = longest[at] if at < n else None
        return out


def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of every token of a vocabulary file, added ones too."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    alphabet = byte_alphabet()
    out = {i: bytes(alphabet[c] for c in t) for t, i in file["model"]["vocab"].items()}
    return out | {t["id"]: t["content"].encode() for t in file.get("added_tokens", [])}


class _Pieces(dict):
    """Ids by piece as 32-bit integers, encoded when first asked for. A full table becomes the old one, from which
    pieces that are asked for again come back, so frequent ones stay."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MAX_KNOWN:
            self.old = dict(self)
            self.clear()
        found = self.old.get(piece)
        if found is None:
            found = array("i", self.vocabulary.encode(piece.encode().decode("latin-1"))).tobytes()
        self[piece] = found
        return found


class Encoder:
    """Ids of whole texts."""

    def __init__(self, path: str, pattern: str):
        self.path, self.vocabulary = path, Vocabulary(path)
        self.split = regex.compile(pattern).findall
        unknown = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
        self.newer = np.zeros(0x110000, bool)
        self.newer[[ord(c) for c in regex.findall(r"[\p{L}\p{N}\s]", unknown)]] = True
        self.known, self.slow = _Pieces(self.vocabulary), None
        added = sorted(self.vocabulary.added, key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def pieces(self, text: str) -> list[str]:
        if not self._newer(text):
            return self.split(text)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.slow.pre_tokenize_str(text)]

    def _newer(self, text: str) -> bool:
        return not text.isascii() and bool(self.newer[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())

    def ids(self, text: str) -> np.ndarray:
        parts = self.added.split(text) if self.added else [text]
        out = [self._plain(parts[0])]
        for name, part in zip(parts[1::2], parts[2::2]):
            out += [array("i", [self.vocabulary.added[name]]).tobytes(), self._plain(part)]
        return np.frombuffer(b"".join(out), np.int32)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.pieces(text)))


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@lru_cache(maxsize=2)
def _table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All token bytes end to end by id, and where each id's begin; the last id stands for unknown ones."""
    tokens = token_bytes(path)
    words = [tokens.get(i, b"") for i in range(max(tokens) + 2)]
    return np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])])


def encode(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the ``ids`` of every whole text."""
    wc.prepare(spark)
    path, pattern = _public(vocabulary, pattern)

    def run(batches):
        encoder = _encoder(path, pattern)
        for batch in batches:
            _, off = wc.column_bytes(batch.column(1))
            for lo, hi in wc.slices(off):
                texts = pc.fill_null(batch.column(1).slice(lo, hi - lo), "").to_pylist()
                found = [encoder.ids(t) for t in texts]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                flat = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(spark: SparkSession, encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The rows of ``encoded`` (doc_id, ids) with the ``text`` that their ids stand for."""
    wc.prepare(spark)
    path, _ = _public(vocabulary, "")

    def run(batches):
        data, begins = _table(path)
        top = len(begins) - 2
        for batch in batches:
            lists = pc.fill_null(batch.column(1), pa.scalar([], batch.column(1).type))
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            for lo, hi in wc.slices(ends, wc.SLICE_BYTES // 4):
                ids = pc.fill_null(lists.slice(lo, hi - lo).flatten(), -1).to_numpy(zero_copy_only=False)
                ids = np.where((ids < 0) | (ids > top), top, ids)
                sizes = begins[ids + 1] - begins[ids]
                stops = np.concatenate([[0], np.cumsum(sizes)])
                raw = data[np.repeat(begins[ids] - stops[:-1], sizes) + np.arange(stops[-1])]
                offsets = stops[ends[lo : hi + 1] - ends[lo]]
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists.slice(lo, hi - lo), _as_text(texts)], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def _as_text(column: pa.Array) -> pa.Array:
    try:
        return column.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in column.to_pylist()], pa.string())


def _public(vocabulary: str | None, pattern: str | None) -> tuple[str, str]:
    if vocabulary is not None and pattern is not None:
        return vocabulary, pattern
    import public_tokenizers as public

    return vocabulary or public.path("byte_bpe_50k.json"), public.PATTERN if pattern is None else pattern


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(spark, encode(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
