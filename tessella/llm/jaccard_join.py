"""Exact n-gram Jaccard join in the metric space of shingle sets (distance 1 - similarity).

Almost all documents lie at distance 1 from any pivot, so document pivots alone would replicate every
document into every region. Candidates are therefore regionalised first, exactly. Of each set the
smallest hashes are its signature, long enough that linked sets share at least ``l`` signature
elements; sets sharing fewer with all others drop out. The sets left exchange all their elements to
learn in how many sets each occurs. A set with fewer than ``percent`` of its elements in others drops
out; the others are candidates of each other where they share one of their rarest elements (as many as
a linked set can lack, and one more), which keeps passages common to many documents out of it.
Components of the candidates are the first regions.

Every region is joined by pivots, recursively. Pivots lie far from one another; each is compared with
all members, which settles it. The others belong to the Voronoi region of their nearest pivot and are
replicated, as boundary sets, into regions whose windows they meet by the triangle inequality: a linked
partner differs by at most the radius in its distance to every pivot. Regions whose members are all
connected already are done, so thousands of near copies cost a few passes and never all pairs. Where
windows would replicate too much a region stays whole, less its pivots. Regions that one task can hold
are joined there; larger ones take rounds over the cluster, in chunks that each get a copy of the pivots.
A large region that windows don't split is dealt in blocks, and every pair of blocks is joined in a task.

Sets that are equal are one node from the start.

Cases: a null or empty text, or one without words, has the empty set and is linked with nothing; fewer
words than ``n`` form one shingle; rows that share a ``doc_id`` have one component, the one reached by
any of them; a null ``doc_id`` is never the smallest; of sets at one distance to two pivots the earlier
pivot's region takes them; texts of any length are cut into shingles whole; extra columns are ignored;
an empty table gives no rows. Shingles are compared by 52 bits, sets by 64 bits of hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import wordcodes as wc
from tessella.operators.graph import connected_components
from tessella.session import materialize, release

N = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Share of a set's elements by which signatures are longer than one common element would need.
SURPLUS = 0.1
#: Elements of one region that a single task joins; larger regions are measured in chunks of the second
#: number of elements, each with a copy of pivots that hold the third together (a single larger set alone).
REGION_LIMIT = 1 << 21
CHUNK_ELEMENTS = 1 << 18
PIVOT_ELEMENTS = 1 << 17
#: Pivots chosen in one round.
PIVOTS = 8
#: Copies of members that a Voronoi split may make of one, on average.
REPLICAS = 1.5
#: What it costs to look at a region at all, in compared elements.
REGION_WORK = 100_000
_CODE = 52
_CODE_MASK = np.uint64((1 << _CODE) - 1)


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle codes of the rows of one slice, sorted by (row, code), and the row bounds."""
    rows = len(off) - 1
    _, _, row, code = wc.words(data, off, wc.SPACED)
    per = np.bincount(row, minlength=rows)
    h, at = wc.windows(code, row, n)
    keys = [row[at].astype(np.uint64) << np.uint64(_CODE) | h >> np.uint64(64 - _CODE)]
    first = np.cumsum(per) - per
    for k in range(1, n):
        short = np.flatnonzero(per == k)
        if len(short):
            acc = np.full(len(short), k, np.uint64)
            for t in range(k):
                acc = (acc + code[first[short] + t]) * np.uint64(0xA0761D6478BD642F)
            keys.append(short.astype(np.uint64) << np.uint64(_CODE) | wc.mix(acc) >> np.uint64(64 - _CODE))
    key = np.unique(np.concatenate(keys))
    return key & _CODE_MASK, np.searchsorted(key, np.arange(rows + 1, dtype=np.uint64) << np.uint64(_CODE))


def node_ids(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash per set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wc.mix(codes + np.uint64(1)), dtype=np.uint64)])
    size = np.diff(bounds).astype(np.uint64)
    return wc.mix((total[bounds[1:]] - total[bounds[:-1]]) ^ (size * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


def common_needed(n: np.ndarray, surplus: float) -> np.ndarray:
    """l: signature elements shared with a linked set of the same size."""
    return np.maximum(1, np.floor(surplus * n)).astype(np.int64)


def signature_length(n: np.ndarray, percent: int, surplus: float) -> np.ndarray:
    return np.minimum(n, n - (-(-percent * n // 100)) + common_needed(n, surplus))


# ---------------------------------------------------------------- signatures by part

_SIG = np.dtype([("sig", "<u8"), ("node", "<i8")])


class _Parts:
    """Signature records by hash part: 6 bytes of signature within the part, then the nodes."""

    def __init__(self, parts: int, limit: int = 12 << 20):
        self.parts, self.limit, self.sigs, self.nodes, self.size = parts, limit, [], [], 0

    def add(self, sig: np.ndarray, node: np.ndarray):
        self.sigs.append(sig)
        self.nodes.append(node)
        self.size += 16 * len(sig)

    def flush(self, last: bool = False):
        if not self.sigs or not (last or self.size > self.limit):
            return
        sig, node = np.concatenate(self.sigs), np.concatenate(self.nodes)
        sig = wc.mix(sig + np.uint64(1))  # signatures are small codes; mixed, parts take equal ranges
        scaled = sig * np.uint64(self.parts)
        part = (sig >> np.uint64(33)) * np.uint64(self.parts) >> np.uint64(31)
        order = np.argsort(part, kind="stable")
        part, low, node = part[order], (scaled[order] & np.uint64((1 << 48) - 1)), node[order]
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        blobs = []
        for a, b in zip(cut, [*cut[1:], len(part)]):
            six = low[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            blobs.append(six.tobytes() + node[a:b].tobytes())
        if blobs:
            yield pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])
        self.sigs, self.nodes, self.size = [], [], 0


def _unpack(held) -> tuple[np.ndarray, np.ndarray]:
    sigs, nodes = [], []
    for buf in held:
        n = buf.size // 14
        raw = np.frombuffer(buf, np.uint8)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :6] = raw[: 6 * n].reshape(n, 6)
        sigs.append(wide.reshape(-1).view("<u8"))
        nodes.append(np.frombuffer(raw[6 * n :].tobytes(), "<i8"))
    return np.concatenate(sigs), np.concatenate(nodes)


def _by_part(batches):
    held, part = [], None
    for batch in batches:
        for p, b in zip(batch.column(0).to_pylist(), batch.column(1)):
            if p != part and held:
                yield part, held
                held = []
            part = p
            held.append(b.as_buffer())
    if held:
        yield part, held


def _groups(held):
    """Distinct (sig, node) pairs sorted by both, and the size of each pair's signature group."""
    sig, node = _unpack(held)
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    fresh = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
    sig, node = sig[fresh], node[fresh]
    group = np.cumsum(np.r_[True, sig[1:] != sig[:-1]]) - 1
    return sig, node, group, np.bincount(group)[group]


def _measured(docs: DataFrame, n: int, percent: int, surplus: float) -> DataFrame:
    """(doc_id, n, node, sig): the size, hash and signature of each row's set. Of equal sets met in one task
    only the first carries its signature."""

    def run(batches):
        seen = set()
        for batch in batches:
            data, off = wc.column_bytes(batch.column(1))
            for lo, hi in wc.slices(off, rows=4096):
                codes, bounds = shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)
                size = np.diff(bounds)
                node = node_ids(codes, bounds)
                take = signature_length(size, percent, surplus).tolist()
                sig = []
                for x, a, k in zip(node.tolist(), bounds.tolist(), take):
                    sig.append(codes[a : a + k].tobytes() if k and x not in seen else None)
                    seen.add(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size.astype(np.int64)), pa.array(node), pa.array(sig, pa.binary())], names=["doc_id", "n", "node", "sig"])

    return docs.mapInArrow(run, "doc_id long, n long, node long, sig binary")


def _signatures(sized: DataFrame, parts: int) -> DataFrame:
    """(part, blob) of the signature elements."""

    def run(batches):
        out, seen = _Parts(parts), set()
        for batch in batches:
            for node, sig in zip(batch.column(0).to_pylist(), batch.column(1)):
                if node not in seen:
                    seen.add(node)
                    own = np.frombuffer(sig.as_buffer(), np.uint64)
                    out.add(own, np.full(len(own), node, np.int64))
            yield from out.flush()
        yield from out.flush(last=True)

    return sized.where("sig is not null").select("node", "sig").mapInArrow(run, "part int, blob binary")


_COUNT = np.dtype([("node", "<i8"), ("shared", "<u4")])


def _node_part(node: np.ndarray, parts: int) -> np.ndarray:
    return (wc.mix(node.astype(np.int64).view(np.uint64)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def _deal(rec: np.ndarray, parts: int, tag: int):
    """Records by the part of their nodes, as one batch of (part, tag, blob)."""
    part = _node_part(rec["node"], parts)
    order = np.argsort(part, kind="stable")
    rec, part = rec[order], part[order]
    cut = np.append(np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)) if len(part) else np.zeros(1, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int32)), pa.array(np.full(len(cut) - 1, tag, np.int32)), pa.array([rec[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())], names=["part", "tag", "blob"])


_DEALT = "part int, tag int, blob binary"


def _by_node(dealt: DataFrame, parts: int, solve, schema: str) -> DataFrame:
    """``solve`` of the blobs of each node part, by tag."""

    def run(batches):
        held, part = {}, None
        for batch in batches:
            for p, t, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if p != part and held:
                    yield from solve(held)
                    held = {}
                part = p
                held.setdefault(t, []).append(b.as_buffer())
        if held:
            yield from solve(held)

    return dealt.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(run, schema)


def _counts(blobs: DataFrame, parts: int) -> DataFrame:
    """(node, shared): how many signature elements of a set occur in another set."""

    def count(batches):
        for _, held in _by_part(batches):
            _, node, _, size = _groups(held)
            ids, n = np.unique(node[size > 1], return_counts=True)
            rec = np.empty(len(ids), _COUNT)
            rec["node"], rec["shared"] = ids, n
            yield _deal(rec, parts, 0)

    def total(held):
        rec = np.concatenate([np.frombuffer(b, _COUNT) for b in held[0]])
        ids, inverse = np.unique(rec["node"], return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(inverse, weights=rec["shared"]).astype(np.int64))], names=["node", "shared"])

    counted = blobs.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(count, _DEALT)
    return _by_node(counted, parts, total, "node long, shared long")


def _elements(sets: DataFrame, parts: int) -> DataFrame:
    """(part, blob) of all elements of the sets."""

    def run(batches):
        out = _Parts(parts)
        for batch in batches:
            for node, codes in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(codes.as_buffer(), np.uint64)
                out.add(own, np.full(len(own), node, np.int64))
                yield from out.flush()
        yield from out.flush(last=True)

    return sets.select("node", "codes").mapInArrow(run, "part int, blob binary")


_SHARED = np.dtype([("node", "<i8"), ("part", "<u4"), ("sig", "<u8"), ("size", "<u4")])
_SIZE = np.dtype([("node", "<i8"), ("n", "<u4")])


def _shared(blobs: DataFrame, parts: int) -> DataFrame:
    """The elements that sets share, with the number of sets of each, dealt by node."""

    def run(batches):
        for part, held in _by_part(batches):
            sig, node, _, size = _groups(held)
            many = size > 1
            rec = np.empty(int(many.sum()), _SHARED)
            rec["node"], rec["part"], rec["sig"], rec["size"] = node[many], part, sig[many], size[many]
            yield _deal(rec, parts, 0)

    return blobs.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(run, _DEALT)


def _sizes(sets: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            rec = np.empty(batch.num_rows, _SIZE)
            rec["node"], rec["n"] = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            yield _deal(rec, parts, 1)

    return sets.select("node", "n").mapInArrow(run, _DEALT)


def _rarest(shared: DataFrame, sizes: DataFrame, parts: int, percent: int) -> DataFrame:
    """(part, blob) of the shared elements among the rarest of each set. Elements of no other set are
    rarer than all shared ones; ties are ordered alike for every set."""

    def solve(held):
        if 0 not in held or 1 not in held:
            return
        rec = np.concatenate([np.frombuffer(b, _SHARED) for b in held[0]])
        known = np.unique(np.concatenate([np.frombuffer(b, _SIZE) for b in held[1]]))
        rec = rec[np.lexsort((rec["sig"], rec["part"], rec["size"], rec["node"]))]
        first = np.flatnonzero(np.r_[True, rec["node"][1:] != rec["node"][:-1]])
        count = np.diff(np.append(first, len(rec)))
        size = known["n"][np.searchsorted(known["node"], rec["node"][first])].astype(np.int64)
        take = np.clip(count - (-(-percent * size // 100)) + 1, 0, count)
        rec = rec[np.arange(len(rec)) - np.repeat(first, count) < np.repeat(take, count)]
        rec = rec[np.argsort(rec["part"], kind="stable")]
        cut = np.append(np.flatnonzero(np.r_[True, rec["part"][1:] != rec["part"][:-1]]), len(rec)) if len(rec) else np.zeros(1, np.int64)
        blobs = []
        for a, b in zip(cut, cut[1:]):
            six = np.ascontiguousarray(rec["sig"][a:b]).view(np.uint8).reshape(-1, 8)[:, :6]
            blobs.append(six.tobytes() + rec["node"][a:b].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rec["part"][cut[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])

    return _by_node(shared.unionByName(sizes), parts, solve, "part int, blob binary")


def _stars(blobs: DataFrame, parts: int) -> DataFrame:
    """(a, b): every member of a signature group with the group's smallest member."""

    def run(batches):
        for _, held in _by_part(batches):
            _, node, group, size = _groups(held)
            first = node[np.searchsorted(group, group)]
            ok = (size > 1) & (first != node)
            pair = np.unique(np.stack([first[ok], node[ok]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))], names=["a", "b"])

    return blobs.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- the join inside one region


class Region:
    """Sets (sorted distinct codes) that one task joins, with labels of what is connected already."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray | None = None, percent: int = PERCENT, pivots: int = PIVOTS):
        self.percent, self.pivots = percent, pivots
        self.radius = 1 - percent / 100 + 1e-9
        self.size = np.array([len(s) for s in sets], np.int64)
        _, ids = np.unique(np.concatenate(sets), return_inverse=True) if sets else (None, np.zeros(0, np.int64))
        self.sets = np.split(ids.astype(np.int32), np.cumsum(self.size)[:-1]) if sets else []
        self.mark = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
        self.label = np.unique(labels, return_inverse=True)[1] if labels is not None else np.arange(len(sets))
        self.edges: list[tuple[int, int]] = []

    def distances(self, q: int, members: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the members to set ``q``; links found on the way are kept."""
        self.mark[self.sets[q]] = True
        common = np.add.reduceat(self.mark[flat], at, dtype=np.int64)
        self.mark[self.sets[q]] = False
        union = self.size[members] + self.size[q] - common
        for z in members[100 * common >= self.percent * union].tolist():
            if self.label[z] != self.label[q]:
                self.edges.append((q, z))
                self.label[self.label == self.label[z]] = self.label[q]
        return 1 - common / union

    def settled(self, members: np.ndarray) -> bool:
        own = self.label[members]
        return len(own) < 2 or bool((own == own[0]).all())

    def join(self) -> list[tuple[int, int]]:
        """Links that span the components of the link graph, as index pairs."""
        todo = [(np.arange(len(self.sets)), len(self.sets))]
        while todo:
            members, limit = todo.pop()
            if self.settled(members):
                continue
            sizes = self.size[members]
            flat, at = np.concatenate([self.sets[m] for m in members]), np.cumsum(sizes) - sizes
            far = np.full(len(members), 2.0)
            rows = []
            while len(rows) < min(self.pivots, len(members)) and not self.settled(members):
                q = int(far.argmax())
                rows.append(self.distances(int(members[q]), members, flat, at))
                far = np.minimum(far, rows[-1])
                far[q] = -1
            del flat
            left = far >= 0
            members, d = members[left], np.stack(rows)[:, left]
            if not self.settled(members):
                regions = [members[r] for r in voronoi(d, self.radius)]
                if len(regions) == 1 and len(members) <= limit:
                    regions = self.by_rare_elements(members)
                    if len(regions) == 1 and len(regions[0]) == len(members):
                        limit = len(members) // 4  # not again, here or in parts, before most are compared
                todo += [(r, min(limit, len(r))) for r in regions]
        return self.edges

    def by_rare_elements(self, members: np.ndarray) -> list[np.ndarray]:
        """Regions for members that no window parts, as sets that share a passage and little else are at
        one distance from all pivots. Linked sets share one of the rarest elements of each, as many as it may lack
        in common with the other and one more; so a region for each element that is shared among those
        holds every link. The members stay together where that would not save half of the work."""
        sizes = self.size[members]
        row = np.repeat(np.arange(len(members), dtype=np.int32), sizes)
        flat = np.concatenate([self.sets[m] for m in members])
        order = np.lexsort((flat, np.bincount(flat).astype(np.int32)[flat], row))
        rank = np.arange(len(flat), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
        prefix = sizes - -(-sizes * self.percent // 100) + 1
        rare = order[rank < prefix[row]]
        del order, rank
        element, owner = flat[rare], row[rare]
        order = np.lexsort((owner, element))
        element, owner = element[order], owner[order]
        cut = np.flatnonzero(np.r_[True, element[1:] != element[:-1]])
        ends = np.r_[cut[1:], len(element)]
        shared = ends - cut > 1
        each = float(sizes.mean())
        if (((ends - cut)[shared].astype(float) ** 2) * each + REGION_WORK).sum() * 2 > float(len(members)) ** 2 * each:
            return [members]
        found = {owner[a:b].tobytes(): members[owner[a:b]] for a, b in zip(cut[shared], ends[shared])}
        return list(found.values())


def voronoi(d: np.ndarray, radius: float, replicas: float = REPLICAS) -> list[np.ndarray]:
    """Member masks of the regions of pivots at distances ``d`` [pivot, member]: the members nearest to a
    pivot, and those of later regions that the windows admit. Every linked pair is in one region at least.
    A split that would copy members more than ``replicas`` times leaves one region."""
    home = d.argmin(0)
    nearest = d.min(0)
    out, held = [], 0
    for i in range(len(d)):
        own = home == i
        if own.any():
            box = ((d >= d[:, own].min(1, keepdims=True) - radius) & (d <= d[:, own].max(1, keepdims=True) + radius)).all(0)
            region = own | (home > i) & box & (d[i] <= nearest + 2 * radius)
            out.append(region)
            held += int(region.sum())
    return out if held <= replicas * d.shape[1] else [np.ones(d.shape[1], bool)]


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """(node, n, codes) of (node, text) rows; rows whose text isn't the node's are left out."""

    def run(batches):
        for batch in batches:
            data, off = wc.column_bytes(batch.column(1))
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in wc.slices(off, rows=4096):
                codes, bounds = shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)
                ok = np.flatnonzero(node_ids(codes, bounds) == nodes[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[lo:hi][ok]), pa.array(np.diff(bounds)[ok].astype(np.int32)), pa.array([codes[bounds[i] : bounds[i + 1]].tobytes() for i in ok], pa.binary())], names=["node", "n", "codes"])

    return texts.mapInArrow(run, "node long, n int, codes binary")


_LINKS = "a long, b long"


def _join_small(sets: DataFrame, parts: int, percent: int) -> DataFrame:
    """Links within the regions that one task can hold."""

    def solve(rows: list):
        known = {node: (label, codes) for node, label, codes in rows}  # repeated rows of one set
        ids = sorted(known, key=lambda k: (-len(known[k][1]), k))
        if len(ids) < 2:
            return []
        region = Region([np.frombuffer(known[k][1], np.uint64) for k in ids], np.array([known[k][0] for k in ids]), percent)
        return [(ids[a], ids[b]) for a, b in region.join()]

    def run(batches):
        region, rows, links = None, [], []
        for batch in batches:
            for r, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if r != region:
                    links += solve(rows)
                    region, rows = r, []
                rows.append(row)
            if len(links) > 4096:
                yield _link_batch(links)
                links = []
        yield _link_batch(links + solve(rows))

    dealt = sets.select("region", "node", "label", "codes").repartition(parts, "region").sortWithinPartitions("region")
    return dealt.mapInArrow(run, _LINKS)


def _link_batch(links: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _pivots(spark: SparkSession, sets: DataFrame, pivots: int, elements: int) -> DataFrame:
    """(region, rank, node): at most ``pivots`` sets of each region that hold ``elements`` together, one at
    least. Each rank takes the smallest of a hash of its own, so regions of any size only need minima; sets
    connected with nothing yet come first, larger sets than the limit last."""
    order = lambda i: F.struct(F.col("n") > elements, F.col("label") != F.col("node"), F.xxhash64("node", F.lit(i)))
    least = sets.groupBy("region").agg(*(F.min_by(F.struct("node", "n"), order(i)).alias(f"p{i}") for i in range(pivots)))
    every = F.array_distinct(F.array(*(f"p{i}" for i in range(pivots))))
    taken = F.aggregate(
        every,
        F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<bigint>").alias("nodes")),
        lambda a, p: F.when((F.size(a["nodes"]) == 0) | (a["held"] + p["n"] <= elements), F.struct((a["held"] + p["n"]).cast("long").alias("held"), F.array_append(a["nodes"], p["node"]).alias("nodes"))).otherwise(a),
        lambda a: a["nodes"],
    )
    return materialize(spark, least.select("region", F.posexplode(taken).alias("rank", "node")), "pivots")


def _measured_by_pivots(spark: SparkSession, sets: DataFrame, chosen: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Every member with its distances to the pivots of its region, in order, and the pivots it is linked
    with. Regions are dealt in chunks, so a large one has many tasks."""
    weights = sets.groupBy("region").agg(F.sum("n").alias("weight"))
    chunks = materialize(spark, weights.select("region", F.ceil(F.col("weight") / chunk).cast("int").alias("chunks")), "chunks")
    held = sets.join(chunks, "region")
    members = held.select("region", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), F.lit(-1).alias("rank"), "node", "label", "n", "codes")
    copies = chosen.join(sets.select("region", "node", "label", "n", "codes"), ["region", "node"]).join(chunks, "region")
    copies = copies.select("region", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "rank", "node", "label", "n", "codes")

    def measure(batches):
        key, known = None, []
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(4)), (c.as_buffer() for c in batch.column(6))))
            at, dist, linked, own = [], [], [], []
            for i, (region, part, rank, node, codes) in enumerate(rows):
                if key != (region, part):
                    key, known = (region, part), []
                x = np.frombuffer(codes, np.uint64)
                if rank >= 0:  # pivots come before members
                    known.append((node, x.copy()))
                    continue
                d, hit = [], []
                for p, s in known:
                    common = int((s[np.minimum(np.searchsorted(s, x), len(s) - 1)] == x).sum())
                    union = len(x) + len(s) - common
                    d.append(1 - common / union)
                    if 100 * common >= percent * union:
                        hit.append(p)
                at.append(i)
                dist.append(d)
                linked.append(hit)
                own.append(any(p == node for p, _ in known))
            some = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in (0, 3, 4, 5, 6)), pa.array(dist, pa.list_(pa.float64())), pa.array(linked, pa.list_(pa.int64())), pa.array(own, pa.bool_())], names=["region", "node", "label", "n", "codes", "d", "linked", "pivot"])

    dealt = members.unionByName(copies)
    total = int(chunks.agg(F.sum("chunks")).first()[0] or 0)
    tasks = max(1, min(total, max(64, wc.parts_for(spark, 8 * chunk * total))))
    dealt = dealt.repartition(tasks, "region", "chunk").sortWithinPartitions("region", "chunk", F.desc("rank"), "node")
    seen = dealt.mapInArrow(measure, "region long, node long, label long, n int, codes binary, d array<double>, linked array<long>, pivot boolean")
    out = materialize(spark, seen, "pivot-round")
    release(chunks)
    return out


def _pivot_round(spark: SparkSession, sets: DataFrame, percent: int, pivots: int, elements: int, chunk: int):
    """One round over large regions: (links, members of the next regions, members of regions that windows
    don't split). Only sums, minima and maxima per region and pivot are gathered, and those in tables."""
    radius = 1 - percent / 100 + 1e-9
    chosen = _pivots(spark, sets, pivots, elements)
    seen = _measured_by_pivots(spark, sets, chosen, percent, chunk)
    links = materialize(spark, seen.select(F.explode("linked").alias("a"), F.col("node").alias("b")).where("a <> b"), "links")
    # what this round connects: labels that share a pivot, or lie at two pivots that share a member
    ties = seen.where("size(linked) > 0").select(F.col("linked")[0].alias("one"), F.explode(F.array_append(F.slice("linked", 2, pivots), F.col("label"))).alias("other"))
    roots = connected_components(spark, ties.select(F.col("one").alias("a"), F.col("other").alias("b")).distinct())
    first = F.coalesce(F.get("linked", F.lit(0)), F.col("label"))
    rest = seen.where("not pivot").withColumn("at", first).join(roots.select(F.col("node").alias("at"), "root"), "at", "left")
    rest = rest.withColumn("label", F.coalesce("root", "at")).drop("root", "at", "linked", "pivot")
    nearest = F.array_min("d")
    rest = materialize(spark, rest.withColumn("home", F.array_position("d", nearest).cast("int") - 1), "labelled")
    release(seen, chosen)
    # the box of pivot distances of every Voronoi region; labels only matter where a region has several
    sides = [F.struct(F.min(F.get("d", F.lit(i))).alias("lo"), F.max(F.get("d", F.lit(i))).alias("hi")) for i in range(pivots)]
    boxes = rest.groupBy("region", "home").agg(F.array(*sides).alias("box"), F.min("label").alias("low"), F.max("label").alias("high"))
    boxes = materialize(spark, boxes.groupBy("region").agg(F.collect_list(F.struct("home", "box", "low", "high")).alias("boxes")), "boxes")  # at most ``pivots`` each
    meets = lambda b: F.forall(F.zip_with("d", F.slice(b["box"], F.lit(1), F.size("d")), lambda x, y: (x >= y["lo"] - radius) & (x <= y["hi"] + radius)), lambda ok: ok)
    near = lambda b: F.get("d", b["home"]) <= nearest + 2 * radius
    partner = lambda b: ((b["low"] != F.col("label")) | (b["high"] != F.col("label"))) & meets(b) & ((b["home"] >= F.col("home")) | near(b))
    open_rows = rest.join(boxes, "region").where(F.exists("boxes", partner))
    into = F.transform(F.filter("boxes", lambda b: (b["home"] == F.col("home")) | ((b["home"] < F.col("home")) & meets(b) & near(b))), lambda b: b["home"])
    open_rows = materialize(spark, open_rows.withColumn("into", into).drop("boxes"), "open")
    kept = materialize(spark, open_rows.groupBy("region").agg(((F.sum(F.size("into")) <= REPLICAS * F.count("*")) & (F.count_distinct("home") > 1)).alias("split")), "splits")
    told = open_rows.join(kept, "region").select("region", "split", "into", "node", "label", "n", "codes")
    moved = told.where("split").withColumn("cell", F.explode("into")).withColumn("region", F.xxhash64("region", "cell"))
    after, stuck = (materialize(spark, df.select("region", "node", "label", "n", "codes"), "regions") for df in (moved, told.where("not split")))
    release(rest, boxes, open_rows, kept)
    return links, after, stuck


def _by_blocks(spark: SparkSession, sets: DataFrame, parts: int, percent: int, limit: int) -> DataFrame:
    """Links within large regions by pairs of blocks, each pair a region of at most about ``limit``."""
    weights = materialize(spark, sets.groupBy("region").agg(F.greatest(F.ceil(2 * F.sum("n") / limit), F.lit(2)).cast("int").alias("blocks")), "weights")
    dealt = sets.join(weights, "region").withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: other != F.col("own"))
    pairs = dealt.withColumn("other", F.explode(others)).withColumn("region", F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")))
    return _join_small(pairs, parts, percent)


def region_links(spark: SparkSession, sets: DataFrame, parts: int, percent: int, limit: int, pivots: int, elements: int = PIVOT_ELEMENTS, chunk: int = CHUNK_ELEMENTS) -> DataFrame:
    """Links (a, b) that span the components of every region of ``sets`` (region, node, n, codes)."""
    found, current = None, sets.withColumn("label", F.col("node"))
    while True:
        weights = materialize(spark, current.groupBy("region").agg(F.sum("n").alias("weight")).where(f"weight > {limit}"), "weights")
        if weights.isEmpty():
            links = _join_small(current, parts, percent)
            return links if found is None else found.unionByName(links)
        links = materialize(spark, _join_small(current.join(weights, "region", "left_anti"), parts, percent), "links")
        found = links if found is None else found.unionByName(links)
        large = materialize(spark, current.join(weights, "region", "left_semi"), "large-regions")
        links, after, stuck = _pivot_round(spark, large, percent, pivots, elements, min(chunk, limit))
        found = found.unionByName(links).unionByName(materialize(spark, _by_blocks(spark, stuck, parts, percent, limit), "links"))
        release(weights, large, current, stuck)
        current = after


def jaccard_join(
    spark: SparkSession,
    docs: DataFrame,
    n: int = N,
    percent: int = PERCENT,
    surplus: float = SURPLUS,
    region_limit: int = REGION_LIMIT,
    pivots: int = PIVOTS,
) -> DataFrame:
    """One row per document row: its number of shingles and its component."""
    wc.prepare(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(spark, _measured(source, n, percent, surplus), "signed")
    sized = materialize(spark, signed.select("doc_id", "n", "node"), "sets")
    nodes = sized.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").cast("int").alias("n"))
    elements = nodes.agg(F.sum("n")).first()[0] or 0
    parts = wc.parts_for(spark, 14 * elements * (100 - percent + 100 * surplus) // 100)
    counted = _counts(_signatures(signed, parts), parts)
    least = F.greatest(F.floor(surplus * F.ceil(F.col("n") * percent / 100)), F.lit(1))
    chosen = nodes.join(counted, "node").where(F.col("shared") >= least).select("node", F.col("doc_id").alias("d"))
    texts = source.join(chosen, F.col("doc_id").eqNullSafe(F.col("d"))).select("node", "text")
    candidates = materialize(spark, _sets(texts, n), "candidate-sets")
    release(signed)
    parts = wc.parts_for(spark, _SHARED.itemsize * (candidates.agg(F.sum("n")).first()[0] or 0))
    rare = _rarest(_shared(_elements(candidates, parts), parts), _sizes(candidates, parts), parts, percent)
    regions = connected_components(spark, _stars(rare, parts)).withColumnRenamed("root", "region")
    sets = materialize(spark, candidates.join(regions, "node").select("region", "node", "n", "codes"), "region-sets")
    release(candidates, regions)
    linked = connected_components(spark, region_links(spark, sets, parts, percent, region_limit, pivots))
    release(sets)
    # rows that share a doc_id tie their sets together
    tied = sized.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.collect_set("node").alias("all")).where("a <> z")
    ties = tied.select("a", F.explode("all").alias("b")).where("a <> b")
    if not ties.isEmpty():
        linked = connected_components(spark, linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(ties))
    # the minima are taken over distinct sets; written first, so that joins with hot sets or components
    # can be split at run time
    roots = nodes.join(linked, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = materialize(spark, roots.where("root <> node").select("root").distinct().join(roots, "root").groupBy("root").agg(F.min("doc_id").alias("component_id")), "components")
    named = roots.join(least, "root", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = sized.join(materialize(spark, named, "named"), "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {N - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {N - 1}), ' ') AS sh FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {PERCENT} * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x),
m AS (SELECT x, min(root) AS root FROM r GROUP BY x)
SELECT d.doc_id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.x = d.doc_id
"""
