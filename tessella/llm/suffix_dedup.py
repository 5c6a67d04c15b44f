"""Exact substring deduplication with suffix arrays.

Every byte covered by a ``span``-byte string that also starts elsewhere is removed. Sorting all
suffixes of a large corpus at once is out of reach, so anchors come first: of the ``gram``-byte
strings inside any ``span``-byte window the one with the smallest hash is an anchor, and two equal
windows hold equal anchors. Anchors found at one place only rule out all windows around them. The
others bring their surroundings (all windows that hold them) to the partition of their hash; an anchor
at very many places is lengthened to both sides first, each lengthening standing for some of the
windows around it, so its surroundings spread over many partitions. There a two-stage suffix sort (suffixes smaller than their successor are sorted directly, the rest induced by
bucket scans) and common prefixes of neighbours find the repeated strings, byte by byte.

Texts that are equal are one text to all this: copies of at least ``span`` bytes vanish whole, and
only one of them takes part for the sake of the others.

Cases: a null or empty text has no bytes and one empty digest; repeated rows are copies of one another
and each get a row; a null ``doc_id`` stays null; extra columns are ignored; an empty table gives no
rows. Texts are identified by 64 bits of their SHA-256 while anchors travel, copies by all of it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import wordcodes as wc
from tessella.session import materialize, release

SPAN = 400
GRAM = 200
#: Longer texts are searched for anchors in segments that overlap by ``span - 1`` bytes.
SEGMENT = 2 << 20
_LOW = np.uint64((1 << 24) - 1)


# ---------------------------------------------------------------- anchors


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, from block-wise running minima in both directions."""
    n = len(x)
    pad = -n % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, off: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors of the rows of one slice; positions count from the slice."""
    n = len(data)
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    long = np.diff(off) >= span
    if not long.any():
        return none
    up, down = wc.powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(wc._PLAIN[data] * up[:n], dtype=np.uint64, out=total[1:])
    grams = wc.mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    keyed = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    least = window_minima(keyed, span - gram + 1)
    # windows that lie in one row
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, off[:-1][long], 1)
    np.add.at(edge, off[1:][long] - span + 1, -1)
    least = least[np.cumsum(edge)[: len(least)] > 0]
    if not len(least):
        return none
    at = np.unique((least[np.r_[True, least[1:] != least[:-1]]] & _LOW).astype(np.int64))
    at = at[thinned(at, grams[at], np.searchsorted(off, at, side="right"), span - gram + 1)]
    return at, grams[at]


def thinned(at: np.ndarray, h: np.ndarray, row: np.ndarray, w: int) -> np.ndarray:
    """Which anchors to keep: in periodic text every period offers an equal one, of which some at most w
    apart suffice for every window to hold one. Equal windows then still hold equal anchors, if not at
    the same place, and the surroundings of either hold the window whole."""
    keep = np.ones(len(at), bool)
    if len(at) < 3:
        return keep
    same = (h[1:] == h[:-1]) & (row[1:] == row[:-1]) & (np.diff(at) <= w)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    for lo, hi in zip(edge[::2], edge[1::2]):  # a run is at[lo .. hi]
        if hi - lo > 1:
            keep[lo + 1 : hi] = False
            i = lo
            while i < hi:
                i = max(i + 1, int(np.searchsorted(at[lo : hi + 1], at[i] + w, side="right")) - 1 + lo)
                keep[min(i, hi)] = True
    return keep


def _segments(data: np.ndarray, off: np.ndarray, span: int):
    """Slices of rows; a long row alone, in overlapping segments. Yields (rows, starts, bytes, offsets)
    where starts are the positions in their texts of what follows."""
    for lo, hi in wc.slices(off, SEGMENT // 2):
        if off[hi] - off[lo] <= SEGMENT:
            yield np.arange(lo, hi), np.zeros(hi - lo, np.int64), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        else:
            for a in range(off[lo], off[hi] - span + 1, SEGMENT - span + 1):
                part = data[a : min(a + SEGMENT, off[hi])]
                yield np.array([lo]), np.array([a - off[lo]]), part, np.array([0, len(part)])


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2("text", 256)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", digest.alias("digest"))


def _tid(digest: str) -> F.Column:
    """64 bits of a hex digest as a long."""
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("long")


class _Out:
    """Collects arrays by part and turns them into (part, blob) batches."""

    def __init__(self, parts: int, limit: int = 8 << 20):
        self.parts, self.limit, self.held, self.size = parts, limit, {}, 0

    def add(self, part: np.ndarray, blobs: list[bytes]):
        for p, b in zip(part, blobs):
            self.held.setdefault(int(p), []).append(b)
            self.size += len(b)

    def flush(self, last: bool = False):
        if self.held and (last or self.size > self.limit):
            keys = list(self.held)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([b"".join(self.held[k]) for k in keys], pa.binary())], names=["part", "blob"])
            self.held, self.size = {}, 0


_ANCHOR = np.dtype([("hash", "<u8"), ("tid", "<i8"), ("pos", "<u4")])
#: An anchor found at several places; it is lengthened in 2**level ways, and stands for itself besides
#: where level has the bit BOTH.
_FOUND = np.dtype([("hash", "<u8"), ("tid", "<i8"), ("pos", "<u4"), ("level", "u1")])
#: Places up to which an anchor stays as it is, and how often the ways are doubled at most.
PLACES, LEVELS, BOTH = 1024, 4, 128


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Anchors are minima, so their hashes crowd at zero and are mixed again before they deal parts."""
    h = wc.mix(h + np.uint64(1))
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def anchor_blobs(texts: DataFrame, parts: int, span: int, gram: int) -> DataFrame:
    """(part, blob) rows of anchor records; a text met again in the same task is left out."""

    def run(batches):
        out, seen = _Out(parts), set()
        for batch in batches:
            data, off = wc.column_bytes(batch.column(1))
            tids = batch.column(0).to_numpy(zero_copy_only=False)
            fresh = np.zeros(len(tids), bool)
            for i, t in enumerate(tids.tolist()):
                if t not in seen:
                    seen.add(t)
                    fresh[i] = True
            for rows, starts, part, at in _segments(data, off, span):
                pos, h = anchors(part, at, span, gram)
                row = np.searchsorted(at, pos, side="right") - 1
                ok = fresh[rows[row]]
                pos, h, row = pos[ok], h[ok], row[ok]
                rec = np.empty(len(pos), _ANCHOR)
                rec["hash"], rec["tid"], rec["pos"] = h, tids[rows[row]], pos - at[row] + starts[row]
                p = _part_of(h, parts)
                order = np.argsort(p, kind="stable")
                cut = np.flatnonzero(np.r_[True, np.diff(p[order]) > 0]) if len(p) else np.zeros(0, np.int64)
                raw = rec[order]
                out.add(p[order][cut], [raw[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(p)])])
                yield from out.flush()
        yield from out.flush(last=True)

    return texts.mapInArrow(run, "part int, blob binary")


def _by_part(batches):
    """The blobs of a partition sorted by part: one array of bytes objects per part."""
    held, part = [], None
    for batch in batches:
        for p, b in zip(batch.column(0).to_pylist(), batch.column(1)):
            if p != part and held:
                yield held
                held = []
            part = p
            held.append(b.as_buffer())
    if held:
        yield held


def repeated_anchors(blobs: DataFrame, parts: int, near: int, places: int) -> DataFrame:
    """(tid, blob) rows of the anchors found at two places at least, gathered per text. A window that holds
    an anchor's string twice need not be anchored at the same one as an equal window elsewhere; its two
    places are at most ``near`` apart in both texts. Such places stand for themselves too, which joins
    those windows; windows around one of them alone are joined by its lengthenings, as everywhere."""

    def run(batches):
        for held in _by_part(batches):
            rec = np.concatenate([np.frombuffer(b, _ANCHOR) for b in held])
            rec = rec[np.lexsort((rec["pos"], rec["tid"], rec["hash"]))]
            new_hash = np.r_[True, rec["hash"][1:] != rec["hash"][:-1]]
            place = new_hash | np.r_[True, (rec["tid"][1:] != rec["tid"][:-1]) | (rec["pos"][1:] != rec["pos"][:-1])]
            rec, new_hash = rec[place], new_hash[place]
            group = np.cumsum(new_hash) - 1
            count = np.bincount(group)
            level = np.clip(np.ceil(np.log2(count / places)), 0, LEVELS).astype(np.uint8)
            close = (rec["tid"][1:] == rec["tid"][:-1]) & ~new_hash[1:] & (np.diff(rec["pos"].astype(np.int64)) <= near)
            found = np.empty(len(rec), _FOUND)
            for c in _ANCHOR.names:
                found[c] = rec[c]
            found["level"] = level[group]
            twice = np.r_[False, close] | np.r_[close, False]
            found["level"][twice & (found["level"] > 0)] |= BOTH
            rec = found[count[group] > 1]
            rec = rec[np.argsort(rec["tid"], kind="stable")]
            if len(rec):
                cut = np.flatnonzero(np.r_[True, rec["tid"][1:] != rec["tid"][:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(rec["tid"][cut]), pa.array([rec[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(rec)])], pa.binary())], names=["tid", "blob"])

    return blobs.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(run, "tid long, blob binary")


# ---------------------------------------------------------------- suffix sorting


def two_stage_sort(text: bytes, ends: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at ``wanted`` in the order of their first ``depth`` bytes.

    ``text`` is a row of contexts; ``ends[i]`` is where the context of byte i ends and with it the
    suffix. Suffixes smaller than their successor (type B) are sorted directly, bucket by bucket. A
    suffix larger than its successor (type A) is its first byte before a suffix of a smaller bucket or
    of its own: scanning the buckets upwards induces all of them in order. ``wanted`` is widened to the
    right until every suffix in it is B, or has its successor in it, or is the last of its context.
    """
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    where = np.arange(n, dtype=np.int32)
    final = where == ends - 1
    step = np.full(n, -1, np.int8)
    step[:-1] = (t[1:] > t[:-1]).view(np.int8) - (t[1:] < t[:-1]).view(np.int8)
    step[final] = -1
    # equal neighbours take the type of the first unequal one to their right
    b_type = step[np.minimum.accumulate(np.where(step != 0, where, np.int32(n - 1))[::-1])[::-1]] > 0
    # widen: the successors of A suffixes, up to the next B
    stop = np.minimum.accumulate(np.where(b_type | final, where, np.int32(n - 1))[::-1])[::-1]
    del where, step
    reach = np.zeros(n + 1, np.int32)
    np.add.at(reach, wanted, 1)
    np.add.at(reach, stop[wanted] + 1, -1)
    need = np.cumsum(reach[:-1], dtype=np.int32) > 0
    del reach, stop
    direct = np.flatnonzero(need & b_type)
    stops = np.minimum(direct + depth, ends[direct])
    # buckets of two leading bytes hold few enough keys to cut them out of the text
    pair = t[direct].astype(np.int32) * 256 + t[np.minimum(direct + 1, n - 1)]
    order = np.argsort(pair, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(pair[order]) > 0]) if len(order) else np.zeros(0, np.int64)
    pieces: list[list] = [[] for _ in range(256)]
    for lo, hi in zip(cut, [*cut[1:], len(order)]):
        own = direct[order[lo:hi]]
        keys = [text[a:b] for a, b in zip(own.tolist(), stops[order[lo:hi]].tolist())]
        pieces[int(t[own[0]])].append(own[np.array(sorted(range(len(keys)), key=keys.__getitem__))])
    sorted_b = [np.concatenate(x) if x else None for x in pieces]
    induced: list[list] = [[] for _ in range(256)]
    need_a = need & ~b_type

    def spread(source: np.ndarray, least: int):
        """The A predecessors of sorted suffixes go to the ends of their buckets, in order."""
        prev = source - 1
        prev = prev[(prev >= 0)]
        prev = prev[need_a[prev] & ~final[prev] & (t[prev] > least)]
        if len(prev):
            by = np.argsort(t[prev], kind="stable")
            prev = prev[by]
            at = np.flatnonzero(np.r_[True, np.diff(t[prev]) > 0])
            for a, b in zip(at, [*at[1:], len(prev)]):
                induced[t[prev[a]]].append(prev[a:b])

    lasts = np.flatnonzero(final & need_a)
    if len(lasts):
        by = lasts[np.argsort(t[lasts], kind="stable")]
        at = np.flatnonzero(np.r_[True, np.diff(t[by]) > 0])
        for a, b in zip(at, [*at[1:], len(by)]):
            induced[t[by[a]]].append(by[a:b])
    result = []
    for c in range(256):
        own = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        runs = [own]
        while len(own):  # equal bytes before an A suffix stay in its bucket
            prev = own - 1
            prev = prev[prev >= 0]
            own = prev[need_a[prev] & ~final[prev] & (t[prev] == c)]
            runs.append(own)
        bucket = np.concatenate([*runs, sorted_b[c]] if sorted_b[c] is not None else runs)
        if len(bucket):
            result.append(bucket)
            spread(bucket, c)
    return np.concatenate(result) if result else np.zeros(0, np.int64)


def common_prefixes(text: bytes, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether the suffixes at a and b share their first ``depth`` bytes; both are long enough."""
    padded = text + b"\0" * 8
    words = np.ndarray((len(text),), "<u8", padded, 0, (1,))  # the eight bytes from every position on
    same = np.ones(len(a), bool)
    live = np.arange(len(a))
    steps = [*range(0, depth - 7, 8)]
    if depth % 8:
        steps.append(max(depth - 8, 0))
    for d in steps:
        eq = words[a[live] + d] == words[b[live] + d]
        same[live[~eq]] = False
        live = live[eq]
    return same


def repeated_starts(text: bytes, ends: np.ndarray, place, span: int) -> np.ndarray:
    """Which bytes of ``text`` start a ``span``-byte string that starts at two places at least; ``place``
    numbers the places of positions, since contexts of one text may overlap."""
    n = len(text)
    wanted = np.flatnonzero(np.arange(n, dtype=np.int32) + span <= ends)
    out = np.zeros(n, bool)
    if len(wanted) < 2:
        return out
    order = two_stage_sort(text, ends, wanted, span)
    order = order[order + span <= ends[order]]
    same = common_prefixes(text, order[:-1], order[1:], span)
    group = np.concatenate([[0], np.cumsum(~same)])
    cut = np.flatnonzero(np.r_[True, np.diff(group) > 0])
    at = place(order)
    low, high = np.minimum.reduceat(at, cut), np.maximum.reduceat(at, cut)
    out[order[(low < high)[group]]] = True
    return out


# ---------------------------------------------------------------- surroundings and spans

_CONTEXT = np.dtype([("hash", "<u8"), ("tid", "<i8"), ("start", "<u4"), ("size", "<u4")])
#: Bytes of surroundings sorted at once. Those of one lengthened anchor stay together, those of different
#: ones need not; sorting takes about 30 bytes of memory a byte.
CHUNK = 1 << 20
#: Marks the size of surroundings that repeat whole and travel without their bytes.
_WHOLE = 1 << 31


def lengthened(data: bytes, h: int, pos: int, level: int, span: int, gram: int):
    """(key, start, end) of the surroundings of one anchor: the windows in which it stands at ``lo`` to
    ``hi`` share what lies from ``lo`` before it to ``hi`` short of the window's end."""
    n, slack, ways = len(data), span - gram, 1 << (level & ~BOTH)
    if not level or level & BOTH:
        yield h, max(0, pos - slack), min(n, pos + span)
    if not level:
        return
    for i in range(ways):
        lo, hi = slack * i // ways, slack * (i + 1) // ways
        if pos >= lo and pos - hi + span <= n:
            shared = hashlib.blake2b(data[pos - lo : pos - hi + span], digest_size=8, salt=bytes([i])).digest()
            yield int.from_bytes(shared, "little"), max(0, pos - hi), min(n, pos - lo + span)


def context_blobs(found: DataFrame, parts: int, span: int, gram: int) -> DataFrame:
    """(part, blob) rows of the surroundings of repeated anchors: records, then their bytes. Surroundings of
    lengthened anchors that are equal to earlier ones of the task repeat whole and leave their bytes out."""

    def run(batches):
        out, first = _Out(parts), {}

        def add(key: int, tid: int, a: int, b: int, body: bytes | None):
            size = b - a if body is not None else (b - a) | _WHOLE
            part = _part_of(np.array([key], np.uint64), parts)
            out.add(part, [np.array([(key, tid, a, size)], _CONTEXT).tobytes() + (body or b"")])

        for batch in batches:
            for tid, blobs, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                raw = text.as_buffer()
                data = raw.to_pybytes()
                for blob in blobs.values:
                    rec = np.frombuffer(blob.as_buffer(), _FOUND)
                    for h, pos, level in zip(rec["hash"].tolist(), rec["pos"].tolist(), rec["level"].tolist()):
                        for key, a, b in lengthened(data, h, pos, level, span, gram):
                            body = data[a:b]
                            known = first.setdefault((key, hashlib.blake2b(body, digest_size=16).digest()), [tid, a, False]) if level else None
                            if known is None or known[:2] == [tid, a]:
                                add(key, tid, a, b, body)
                            elif b - a >= span:
                                add(key, tid, a, b, None)
                                if not known[2]:
                                    add(key, known[0], known[1], known[1] + b - a, None)
                                    known[2] = True
                yield from out.flush()
        yield from out.flush(last=True)

    return found.select("tid", "blobs", F.col("text").cast("binary").alias("text")).mapInArrow(run, "part int, blob binary")


def _contexts(held):
    for buf in held:
        raw, at = memoryview(buf), 0
        while at < len(raw):
            h, tid, start, size = np.frombuffer(raw, _CONTEXT, 1, at)[0].tolist()
            at += _CONTEXT.itemsize
            if size & _WHOLE:
                yield h, tid, start, None, size ^ _WHOLE
            else:
                yield h, tid, start, bytes(raw[at : at + size]), size
                at += size


def _solve(contexts: list, span: int, whole: dict[int, list]) -> None:
    """Add the repeated spans of some (tid, start, bytes) contexts to ``whole``."""
    tids, starts, bodies = [], [], []
    first: dict[bytes, tuple[int, int]] = {}
    for tid, start, body in contexts:
        # equal surroundings at two places repeat in full; one of them stands for all
        known = first.setdefault(body, (tid, start))
        if known == (tid, start):
            tids.append(tid)
            starts.append(start)
            bodies.append(body)
        elif len(body) >= span:
            whole.setdefault(tid, []).append((start, start + len(body)))
            whole.setdefault(known[0], []).append((known[1], known[1] + len(body)))
    sizes = np.array([len(b) for b in bodies], np.int64)
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(bodies), dtype=np.int32), sizes)
    _, number = np.unique(np.array(tids, np.int64), return_inverse=True)
    shift = (number.astype(np.int64) << 32) + np.array(starts, np.int64) - base
    mark = np.flatnonzero(repeated_starts(b"".join(bodies), (base + sizes).astype(np.int32)[owner], lambda at: shift[owner[at]] + at, span))
    if len(mark):
        # runs of marked starts in one context make one span
        own = owner[mark]
        cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (np.diff(mark) > 1)])
        for a, b in zip(cut, [*cut[1:], len(mark)]):
            i = own[a]
            from_start = starts[i] - base[i]
            whole.setdefault(tids[i], []).append((int(mark[a] + from_start), int(mark[b - 1] + from_start) + span))


def repeated_spans(blobs: DataFrame, parts: int, span: int) -> DataFrame:
    """(tid, starts, ends) rows: spans to remove, merged within one part."""

    def run(batches):
        for held in _by_part(batches):
            whole: dict[int, list] = {}
            chunk: list = []
            size, last = 0, None
            for h, tid, start, body, n in sorted(_contexts(held), key=lambda x: x[0]):
                if body is None:
                    whole.setdefault(tid, []).append((start, start + n))
                    continue
                if h != last and size >= CHUNK:
                    _solve(chunk, span, whole)
                    chunk, size = [], 0
                last = h
                chunk.append((tid, start, body))
                size += n
            _solve(chunk, span, whole)
            if whole:
                keys = list(whole)
                merged = [_merge(whole[k]) for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([[x[0] for x in m] for m in merged], pa.list_(pa.int64())), pa.array([[x[1] for x in m] for m in merged], pa.list_(pa.int64()))], names=["tid", "starts", "ends"])

    return blobs.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(run, "tid long, starts array<long>, ends array<long>")


def _merge(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def suffix_dedup(spark: SparkSession, docs: DataFrame, span: int = SPAN, gram: int = GRAM, places: int = PLACES) -> DataFrame:
    """One row per document row: bytes, removed bytes, maximal removed runs (also as offsets), what remains
    as its digest, bytes and code points (counted by their first bytes), and whether anything repeats."""
    wc.prepare(spark)
    texts = _texts(docs)
    small = materialize(spark, texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.length("text").cast("long").alias("n_chars")), "digests")
    # one anchor in about half a window of the gram positions
    parts = wc.parts_for(spark, 2 * _ANCHOR.itemsize * (small.agg(F.sum("n_bytes")).first()[0] or 0) // (span - gram + 1))
    copies = small.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"))
    long = texts.where(F.octet_length("text") >= span).select(_tid("digest").alias("tid"), "text")
    found = repeated_anchors(anchor_blobs(long, parts, span, gram), parts, span - gram + 1, places).groupBy("tid").agg(F.collect_list("blob").alias("blobs"))
    # one document of each text brings its bytes
    chosen = copies.where(F.col("n_bytes") >= span).select("digest", "copies", F.col("doc_id").alias("d"), _tid("digest").alias("tid"))
    wanted = found.join(chosen, "tid").withColumnRenamed("digest", "g")
    with_text = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")))
    with_text = materialize(spark, with_text.select("tid", "blobs", "text", "copies", "doc_id", "digest"), "repeated")
    held = with_text.agg(F.sum(F.aggregate("blobs", F.lit(0).cast("long"), lambda a, b: a + F.octet_length(b)))).first()[0]
    parts = wc.parts_for(spark, (held or 0) // _FOUND.itemsize * (2 * span - gram))
    spans = repeated_spans(context_blobs(with_text, parts, span, gram), parts, span)
    spans = spans.groupBy("tid").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))

    def cut(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for digest, text, a, b in zip(*(batch.column(i) for i in range(4))):
                data = text.as_buffer().to_pybytes()
                merged = _merge(zip(a.as_py(), b.as_py()))
                kept, at = [], 0
                for x, y in merged:
                    kept.append(data[at:x])
                    at = y
                kept.append(data[at:])
                rest = b"".join(kept)
                chars = int(((np.frombuffer(rest, np.uint8) & 0xC0) != 0x80).sum())
                for c, v in zip(out, (digest.as_py(), sum(y - x for x, y in merged), hashlib.sha256(rest).hexdigest(), chars, [x for x, _ in merged], [y for _, y in merged])):
                    c.append(v)
            spans = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64(), spans, spans))], names=["g", "cut_bytes", "kept", "kept_chars", "starts", "ends"])

    alone = with_text.where("copies = 1").join(spans, "tid").select("digest", F.col("text").cast("binary").alias("text"), "starts", "ends")
    done = materialize(spark, alone.mapInArrow(cut, "g string, cut_bytes long, kept string, kept_chars long, starts array<long>, ends array<long>"), "cut")
    release(with_text)
    many = copies.where(f"copies > 1 and n_bytes >= {span}").select(F.col("digest").alias("g"), F.col("n_bytes").alias("cut_bytes"), F.sha2(F.lit(""), 256).alias("kept"), F.lit(0).cast("long").alias("kept_chars"), F.array(F.lit(0).cast("long")).alias("starts"), F.array("n_bytes").alias("ends"))
    result = small.join(done.unionByName(many), F.col("digest") == F.col("g"), "left")
    none = F.array().cast("array<long>")
    return result.select(
        "doc_id", "n_bytes",
        F.coalesce("cut_bytes", F.lit(0).cast("long")).alias("n_removed"),
        F.when(F.col("starts").isNull(), 0).otherwise(F.size("starts")).cast("long").alias("n_spans"),
        F.coalesce("kept", "digest").alias("kept_sha256"),
        (F.col("n_bytes") - F.coalesce("cut_bytes", F.lit(0))).alias("n_kept"),
        F.coalesce("kept_chars", "n_chars").alias("n_kept_chars"),
        F.col("cut_bytes").isNotNull().alias("repeated"),
        F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("starts", "ends")


#: Every window as hex digits, cut out of blocks so that no cut has to count far into a text.
ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
b AS (SELECT doc_id, n, b, substr(h, 2048 * b + 1, 2048 + {2 * SPAN}) AS part FROM (SELECT doc_id, h, n, unnest(range(0, n // 1024 + 1)) AS b FROM d WHERE n >= {SPAN})),
w AS (SELECT doc_id, 1024 * b + j AS i, md5_number(substr(part, 2 * j + 1, {2 * SPAN})) AS k FROM (SELECT doc_id, n, b, part, unnest(range(0, 1024)) AS j FROM b) WHERE 1024 * b + j + {SPAN} <= n),
s AS (SELECT doc_id, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
f AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {SPAN} THEN 0 ELSE 1 END AS fresh FROM s),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + {SPAN} AS z FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f) GROUP BY doc_id, run),
g AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM r),
k AS (SELECT doc_id, any_value(n) AS n, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept
  FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256,
  d.n - coalesce(n_removed, 0) AS n_kept, (length(regexp_replace(coalesce(kept, h), '([0-7C-F][0-9A-F])|[89AB][0-9A-F]', '\\1', 'g')) // 2)::BIGINT AS n_kept_chars, k.doc_id IS NOT NULL AS repeated
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
