"""Near-duplicate classes by a prefix-tree join on word n-gram sets.

Four steps. (1) One global order of all n-grams: a sketch of counters over every set says how frequent an n-gram is, a
hash breaks ties. (2) Sets that link share so many of their rarest n-grams (see `depth`); each set sends only those,
packed, to the part of the n-gram. An n-gram's sets, sorted by size and cut where two neighbours differ too much in size
to link, are a list; the one of least digest leads it. A set with too few n-grams in lists of several sets links with
none. Any other goes once to each of its leaders: whoever shares a rare n-gram meets at the leader of that n-gram's
list, and sets that share none never meet.
(3) The sets of a leader form a prefix tree in the global order, most frequent n-gram first. Probes descend from the
root: the overlap of a path is counted once for all sets below it, and a subtree is left as soon as the overlap so far
and the n-grams that remain on either side cannot reach what its smallest set needs, or all its sets are linked to the
probe already. (4) Links make components.

A leader of more than CHUNK n-grams or CHUNK_SETS sets is cut: its sets meet in chunks, each beside the leader. If links have not joined
them all, the sets outside the largest component (only those) visit every chunk.

Sets are compared by 64-bit hashes of their n-grams; equal sets are one class from the start (128-bit digest).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from oddlog.llm.common import shuffle_parts
from oddlog.llm.words import Words, mix, runs, slices
from oddlog.operators.components import components, local_components
from oddlog.session import broadcast_if_small, freeze

NGRAM, NUM, DEN = 3, 90, 100
SLOTS, STRIPE = 1 << 21, 1 << 10  # counters of the frequency sketch, counters of one of its rows
TENTH = 10  # linked sets share a tenth of their size among their rarest n-grams
SLICE = 2 << 20  # bytes of text whose sets are packed together
CHUNK, CHUNK_SETS = 1 << 19, 512  # n-grams and sets of one tree
PART_BYTES = 32 << 20  # packed n-grams that one task sorts
_LOW = np.uint64(0xFFFFFFFF)


def ngram_sets(words: Words, data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one after another, and n + 1 offsets into them.

    A text of fewer words has one member, its whole sequence; a text without words has none.
    """
    hashes, ends = words.hashes(data, offsets)
    grams = runs(hashes, n)
    out = []
    for low, high in zip(ends[:-1], ends[1:]):
        if high - low >= n:
            out.append(np.unique(grams[low : high - n + 1]))
        elif high > low:
            out.append(runs(hashes[low:high], int(high - low)) + np.uint64(high - low))
        else:
            out.append(np.zeros(0, np.uint64))
    sizes = np.array([len(s) for s in out], np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def _sums(key: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values by key, modulo 2**64 (exact up to 2**21 values a key)."""
    low = np.bincount(key, (values & _LOW).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(key, (values >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
    return low + (high << np.uint64(32))


def slot(grams: np.ndarray) -> np.ndarray:
    """The counter of each n-gram."""
    return (mix(grams) >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)


def order_key(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Place of each n-gram in the global order, rare ones first."""
    return (counts[slot(grams)].astype(np.uint64) << np.uint64(32)) | (mix(grams) >> np.uint64(32))


def gram_counts(docs: DataFrame, n: int) -> np.ndarray:
    """Counts of all n-grams of all sets, by slot; SLOTS counters of 32 bits at the end, whatever the table's size.

    A task sends its counters once (16 bits each, full at 65,535) in stripes; a stripe is summed as it streams by.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = Words(lower=True), np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0), SLICE):
                at, met = np.unique(slot(ngram_sets(words, data, offsets, n)[0]), return_counts=True)
                own[at] += met.astype(np.uint32)
        striped = np.minimum(own, 65_535).astype(np.uint16).reshape(-1, STRIPE)
        held = np.flatnonzero(striped.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([striped[k].tobytes() for k in held], pa.binary())], ["stripe", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for stripe, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[stripe] = total.get(stripe, np.zeros(STRIPE, np.int64)) + np.frombuffer(counts, np.uint16)
        held = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([np.minimum(total[k], 2**32 - 1).astype(np.uint32).tobytes() for k in held], pa.binary())], ["stripe", "counts"])

    kind = "stripe int, counts binary"
    parts = min(SLOTS // STRIPE, shuffle_parts(docs.sparkSession))
    out = np.zeros((SLOTS // STRIPE, STRIPE), np.uint32)
    for row in docs.select("text").mapInArrow(count, kind).repartition(parts, "stripe").mapInArrow(add, kind).collect():
        out[row.stripe] = np.frombuffer(row.counts, np.uint32)
    return out.reshape(-1)


def depth(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many of their rarest n-grams linked sets share at least: a tenth of the size, one or more."""
    return np.maximum(1, np.minimum(-(-num * sizes // den), sizes // TENTH))


def rarest(members: np.ndarray, ends: np.ndarray, counts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(set number, n-gram) of each set's rarest n-grams: all but the last `needed overlap - depth`.

    The first n-grams that two linked sets share, as many as the smaller of their depths, are among these in both: any
    set's needed overlap is at most what they share, and the rest of either set lies behind.
    """
    sizes = np.diff(ends)
    of = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((order_key(members, counts), of))
    place = np.arange(len(members)) - np.repeat(ends[:-1], sizes)
    sent = place < np.repeat(sizes - -(-num * sizes // den) + depth(sizes, num, den), sizes)
    return of[sent], members[order][sent]


def asked(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Depth of the smallest set that can link with a set of each size."""
    return depth(-(-num * sizes // den), num, den)


SENT = "doc_id bigint, n bigint, k1 bigint, k2 bigint, part int, gram binary, class binary, size binary"


def _digests(members: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(ends)
    of = np.repeat(np.arange(len(sizes)), sizes)
    one = mix(_sums(of, mix(members), len(sizes)) + sizes.astype(np.uint64))
    two = mix(_sums(of, mix(members ^ np.uint64(0xD1B54A32D192ED03)), len(sizes)) + sizes.astype(np.uint64))
    return one.view(np.int64), two.view(np.int64)


def _scan(docs: DataFrame, n: int, num: int, den: int, parts: int, counts: np.ndarray) -> DataFrame:
    """A row of size and digest for each document, and packed rare n-grams for each slice and part of their space."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lower=True)
        names = [c.split()[0] for c in SENT.split(", ")]
        none = lambda kind, m: pa.nulls(m, kind)
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1), SLICE):
                members, ends = ngram_sets(words, data, offsets, n)
                k1, k2 = _digests(members, ends)
                rows, sizes = high - low, np.diff(ends)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high].cast(pa.int64()), pa.array(sizes), pa.array(k1), pa.array(k2), none(pa.int32(), rows), *[none(pa.binary(), rows)] * 3], names
                )
                once = np.unique(k1, return_index=True)[1]  # equal sets of the slice send their n-grams once
                sets, grams = rarest(
                    np.concatenate([members[ends[i] : ends[i + 1]] for i in once]), np.concatenate([[0], np.cumsum(sizes[once])]), counts, num, den
                )
                if not len(grams):
                    continue
                of = ((grams >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((sets, of))
                of, at, grams = of[order], once[sets[order]], grams[order]
                cuts = np.flatnonzero(np.diff(of, prepend=-1))
                m = len(cuts)
                packed = lambda values: pa.array([values[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(of)])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*[none(pa.int64(), m)] * 4, pa.array(of[cuts], pa.int32()), packed(grams), packed(k1[at]), packed(sizes[at].astype(np.int32))], names
                )

    return docs.mapInArrow(read, SENT)


PACKED_LED = "bin int, led binary"
LED = "lead bigint, k1 bigint, n bigint"


def _leaders(num: int, den: int, bins: int):
    def run(table: pa.Table) -> pa.Table:
        """(lead, k1, n, lists): each class beside the leaders of its lists of two classes or more, and how many those
        are; packed by the class's bin."""
        gram, of, size = (np.concatenate([np.frombuffer(b, kind) for b in table[c].to_pylist()]) for c, kind in (("gram", np.uint64), ("class", np.int64), ("size", np.int32)))
        order = np.lexsort((of, size, gram))
        gram, of, size = gram[order], of[order], size[order].astype(np.int64)
        own = np.ones(len(gram), bool)  # a class that several slices sent
        own[1:] = (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])
        gram, of, size = gram[own], of[own], size[own]
        start = np.ones(len(gram), bool)
        start[1:] = (gram[1:] != gram[:-1]) | (den * size[:-1] < num * size[1:])
        at = np.flatnonzero(start)
        count = np.diff(np.append(at, len(gram)))
        lead, several = np.repeat(np.minimum.reduceat(of, at), count), np.repeat(count, count) > 1
        led, lists = np.unique(np.stack([lead[several], of[several], size[several]], 1), axis=0, return_counts=True)
        rows = np.concatenate([led, lists[:, None]], 1)
        bin_ = ((rows[:, 1].view(np.uint64) if len(rows) else np.zeros(0, np.uint64)) >> np.uint64(20)) % np.uint64(bins)
        held = np.unique(bin_)
        return pa.table({"bin": pa.array(held.astype(np.int32)), "led": pa.array([np.ascontiguousarray(rows[bin_ == k]).tobytes() for k in held], pa.binary())})

    return run


def _with_enough(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        """Leaders of the classes of a bin that have n-grams enough in lists of several sets."""
        rows = np.frombuffer(b"".join(table["led"].to_pylist()), np.int64).reshape(-1, 4)
        rows = rows[np.lexsort((rows[:, 0], rows[:, 1]))]
        of = np.flatnonzero(np.concatenate([[True], rows[1:, 1] != rows[:-1, 1]]))
        total = np.repeat(np.add.reduceat(rows[:, 3], of), np.diff(np.append(of, len(rows))))
        once = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])
        kept = rows[once & (total >= asked(rows[:, 2], num, den))]
        return pa.table({name: pa.array(np.ascontiguousarray(kept[:, k]), pa.int64()) for k, name in enumerate(("lead", "k1", "n"))})

    return run


class Tree:
    """Prefix tree of sets of ranks, each ascending: sorted sets with shared prefixes stored once.

    Nodes are in depth-first order; a node covers the sets low .. high - 1 and holds the ranks from depth to end of
    any of them.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        m = len(sets)
        shared = np.zeros(m + 1, np.int64)
        for k in range(1, m):
            a, b = sets[k - 1], sets[k]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            shared[k] = differ[0] if len(differ) else n
        low, high, depth, end, parent, child = [], [], [], [], [], []
        work = [(0, m, 0, -1)]
        while work:
            lo, hi, at, up = work.pop()
            node = len(low)
            inner = shared[lo + 1 : hi]
            stop = int(inner.min()) if hi - lo > 1 else len(sets[lo])
            low.append(lo)
            high.append(hi)
            depth.append(at)
            end.append(stop)
            parent.append(up)
            if hi - lo > 1:
                cuts = [lo, *(np.flatnonzero(inner == stop) + lo + 1).tolist(), hi]
                work.extend((a, b, stop, node) for a, b in zip(cuts[:-1], cuts[1:]))
        self.low, self.high, self.depth, self.end = map(np.array, (low, high, depth, end))
        order = np.argsort(parent, kind="stable")
        ups = np.array(parent)[order]
        self.child_from = np.searchsorted(ups, np.arange(len(low)))
        self.child_to = np.searchsorted(ups, np.arange(len(low)), "right")
        self.children = order
        sizes = np.array([len(s) for s in sets])
        self.smallest = np.array([sizes[a:b].min() for a, b in zip(low, high)])
        self.largest = np.array([sizes[a:b].max() for a, b in zip(low, high)])
        lengths = self.end - self.depth
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        self.ranks = np.concatenate([sets[a][d:e] for a, d, e in zip(low, depth, end)] or [np.zeros(0, np.int64)])

    def links(self, probes: list[np.ndarray], group: np.ndarray, own: np.ndarray, num: int, den: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(probe, set) numbers of linked pairs, some probes at a time.

        `group` says which component each set is in (the caller updates it between steps), `own` which each probe is.
        """
        step = max(1, min(64, (1 << 24) // max(width, 1), (1 << 19) // max(len(self.ranks), 1)))
        for base in range(0, len(probes), step):
            some = probes[base : base + step]
            has = np.zeros((len(some), width), bool)
            for k, p in enumerate(some):
                has[k, p] = True
            size = np.array([len(p) for p in some])
            turns = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])]) if len(group) else group
            one = turns[self.high - 1] == turns[self.low]  # all sets below are in one component
            probe = np.arange(len(some))
            node = np.zeros(len(some), np.int64)
            overlap = np.zeros(len(some), np.int64)
            found_p, found_s = [], []
            while len(node):
                new = ~(one[node] & (group[self.low[node]] == own[base + probe]))
                new &= overlap + np.minimum(size[probe] - overlap, self.largest[node] - self.depth[node]) >= _needs(size[probe], self.smallest[node], num, den)
                probe, node, overlap = probe[new], node[new], overlap[new]
                lengths = self.end[node] - self.depth[node]
                ends = np.cumsum(lengths)
                if len(ends) and ends[-1]:
                    place = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + np.repeat(self.at[node], lengths)
                    hit = np.concatenate([[0], np.cumsum(has[np.repeat(probe, lengths), self.ranks[place]])])
                    overlap = overlap + hit[ends] - hit[ends - lengths]
                below = self.child_to[node] - self.child_from[node]
                leaf = below == 0
                there = np.flatnonzero(leaf)[overlap[leaf] >= _needs(size[probe[leaf]], self.end[node[leaf]], num, den)]
                copies = self.high[node[there]] - self.low[node[there]]
                found_p.append(np.repeat(base + probe[there], copies))
                found_s.append(np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies) + np.repeat(self.low[node[there]], copies))
                stops = np.cumsum(below)
                place = np.arange(stops[-1] if len(stops) else 0) - np.repeat(stops - below, below) + np.repeat(self.child_from[node], below)
                probe, overlap, node = np.repeat(probe, below), np.repeat(overlap, below), self.children[place]
            yield np.concatenate(found_p), np.concatenate(found_s)


def _needs(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Overlap that links sets of these sizes: the least o with den o >= num (a + b - o)."""
    return -(-num * (a + b) // (den + num))


def join_block(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, known: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """Component number of each set by links between `left` and `right` sets (numbers into `sets`).

    `known` numbers the components that earlier links made.
    """
    flat = np.concatenate(sets)
    values, place = np.unique(flat, return_inverse=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(order_key(values, counts), kind="stable")[::-1]] = np.arange(len(values))  # most frequent first
    ranks = rank[place]
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    ordered = [np.sort(ranks[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    right = np.array(sorted(right, key=lambda k: ordered[k].astype(">u4").tobytes()), np.int64)
    tree = Tree([ordered[k] for k in right])
    root = np.unique(known, return_index=True, return_inverse=True)[1:]
    root = root[0][root[1]]
    group, own = root[right].copy(), root[left].copy()
    for probes, found in tree.links([ordered[k] for k in left], group, own, num, den, len(values)):
        root = local_components(len(sets), root[left[probes]], root[right[found]])[root]
        group[:], own[:] = root[right], root[left]
    return root


EDGES = "a bigint, b bigint"


def _joined(num: int, den: int, counts: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        """Links of all leaders (or of one chunk of a leader) dealt to a bin."""
        node, lead, side, known = (table[c].to_numpy() for c in ("node", "lead", "side", "known"))
        members = [np.frombuffer(b, np.uint64) for b in table["members"].to_pylist()]
        out: list[np.ndarray] = []
        order = np.lexsort((node, lead))
        for at in np.split(order, np.flatnonzero(np.diff(lead[order])) + 1):
            sides = side[at]
            left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
            if len(at) < 2 or not len(left) or not len(right):
                continue
            root = join_block([members[k] for k in at], left, right, known[at], counts, num, den)
            linked = np.flatnonzero(root != np.arange(len(at)))
            out.append(np.stack([node[at[root[linked]]], node[at[linked]]], 1))
        edges = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(edges[:, 0], pa.int64()), "b": pa.array(edges[:, 1], pa.int64())})

    return run


def _sets_of(docs: DataFrame, n: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lower=True)
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(0), SLICE):
                members, ends = ngram_sets(words, data, offsets, n)
                packed = pa.array([members[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
                found = pa.RecordBatch.from_arrays([*[c[low:high] for c in batch.columns[1:]], packed], ["node", "goes", "members"])
                # An id that has several texts has met its class by id alone.
                yield found.filter(pa.array(_digests(members, ends)[0] == found.column(0).to_numpy()))

    return docs.mapInArrow(read, f"node bigint, goes array<struct<{GOES}>>, members binary")


# Where a set goes: the leader, the chunk (null: the leader is whole), the bin, whom it meets there, its component.
GOES = "lead:bigint,chunk:bigint,bin:bigint,side:int,known:bigint"


def _meet(rows: DataFrame, ids: DataFrame, goes: DataFrame, n: int, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """Links among the sets that `goes` (k1 and the fields of GOES) brings together."""
    targets = F.collect_list(F.struct(*[F.col(c.split(":")[0]).cast(c.split(":")[1]) for c in GOES.split(",")])).alias("goes")
    chosen = freeze(goes.groupBy("k1").agg(targets).join(ids, "k1").select("doc_id", F.col("k1").alias("node"), "goes").filter("doc_id IS NOT NULL"))
    few = broadcast_if_small(chosen, chosen.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("goes")), F.lit(0))).first()[0], BROADCAST)
    sets = _sets_of(rows.join(few, "doc_id").select("text", "node", "goes"), n)
    dealt = sets.select("node", "members", F.explode("goes").alias("go")).select("node", "members", "go.*")
    return dealt.groupBy("chunk", "bin").applyInArrow(_joined(num, den, counts), EDGES)


BROADCAST = 250_000  # narrow rows of 40 bytes or less


def _chunk(chunks: Column) -> Column:
    return F.pmod(F.xxhash64("k1", F.lit(1)), chunks)


def _met_in_chunks(led: DataFrame, hot: DataFrame, n_hot: int, linked: DataFrame) -> DataFrame | None:
    """Where the sets of cut leaders go once more, if links have not joined all of a leader's sets."""
    member = led.join(broadcast_if_small(hot, n_hot, BROADCAST), "lead").join(linked.select(F.col("node").alias("k1"), "root"), "k1", "left")
    member = freeze(member.select("lead", "chunks", "k1", F.coalesce("root", "k1").alias("known")))
    parts = member.groupBy("lead", "chunks", "known").agg(F.count(F.lit(1)).alias("m"))
    split = freeze(
        parts.groupBy("lead").agg(F.max(F.struct("m", "known")).alias("largest"), F.count(F.lit(1)).alias("kinds"))
        .filter("kinds > 1").select("lead", F.col("largest.known").alias("major"))
    )
    if split.isEmpty():
        return None
    own = _chunk(F.col("chunks"))
    minor = F.col("known") != F.col("major")
    at = F.explode(F.when(minor, F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(own))).alias("chunk")
    visits = member.join(broadcast_if_small(split, n_hot, BROADCAST), "lead").select("k1", "lead", own.alias("own"), minor.alias("minor"), "known", at)
    side = F.when(~F.col("minor"), 1).when(F.col("chunk") == F.col("own"), 2).otherwise(0)
    return visits.select("k1", "lead", "chunk", F.col("lead").alias("bin"), side.alias("side"), "known")


def near_classes(docs: DataFrame, n: int = NGRAM, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row given.

    Words are runs of anything but ASCII white space, A-Z lower-cased; documents link when den * intersection >= num *
    union of their sets of n words. component_id is the least doc_id that links reach, itself included; null and empty
    texts link with nothing and have their own id. Rows that repeat a doc_id are rows of their own; rows without a
    doc_id link with rows of equal sets only. doc_id is a whole number. Other columns are not looked at. An empty
    table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = gram_counts(rows, n)
    # A packed n-gram is 20 bytes, a few times that while sorted.
    sent = int(counts.sum(dtype=np.int64)) * (1 - num / den + 1 / TENTH)
    parts = max(shuffle_parts(rows.sparkSession), int(20 * sent) // PART_BYTES + 1)
    scan = freeze(_scan(rows, n, num, den, parts, counts))
    seen = scan.filter("part IS NULL").select("doc_id", "n", "k1", "k2")
    packed = scan.filter("part IS NOT NULL").select("part", "gram", "class", "size")
    found = packed.groupBy("part").applyInArrow(_leaders(num, den, parts), PACKED_LED)
    kept = freeze(found.groupBy("bin").applyInArrow(_with_enough(num, den), LED))
    several = kept.groupBy("lead").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("lead")
    led = freeze(kept.join(broadcast_if_small(several, kept.count(), BROADCAST), "lead"))
    ids = freeze(seen.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")))
    links = _links(rows, ids, led, n, num, den, counts)
    return _classes(seen, ids, links)


def _links(rows: DataFrame, ids: DataFrame, led: DataFrame, n: int, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """(node, root) of the classes that links join."""
    grams = led.agg(F.sum("n")).first()[0] or 0
    bins = max(shuffle_parts(rows.sparkSession), 8 * grams // PART_BYTES + 1)
    chunks = F.greatest(F.ceil(F.sum("n") / CHUNK), F.ceil(F.count(F.lit(1)) / CHUNK_SETS)).alias("chunks")
    hot = freeze(led.groupBy("lead").agg(chunks).filter("chunks > 1"))
    n_hot = hot.count()
    cut = F.col("chunks").isNotNull()
    spread = led.join(broadcast_if_small(hot, n_hot, BROADCAST), "lead", "left")
    # A leader is in each of its chunks, so that sets like it meet across chunks.
    every = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    at = F.when(~cut, F.array(F.lit(None).cast("long"))).when(F.col("k1") == F.col("lead"), every).otherwise(F.array(_chunk(F.col("chunks"))))
    goes = spread.select(
        "k1", "lead", F.explode(at).alias("chunk"), F.when(cut, F.col("lead")).otherwise(F.pmod(F.xxhash64("lead"), F.lit(bins))).alias("bin"),
        F.lit(2).alias("side"), F.col("k1").alias("known"),
    )
    first = freeze(_meet(rows, ids, goes, n, num, den, counts))
    linked = components(first)
    again = _met_in_chunks(led, hot, n_hot, linked) if n_hot else None
    return linked if again is None else components(first.unionByName(_meet(rows, ids, again, n, num, den, counts)))


def _classes(seen: DataFrame, ids: DataFrame, linked: DataFrame) -> DataFrame:
    least = freeze(linked.join(ids.select(F.col("k1").alias("node"), "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("least")))
    named = linked.join(broadcast_if_small(least, least.count(), BROADCAST), "root").select(F.col("node").alias("k1"), "least")
    # Only a class of several rows or with links has another id than its row.
    of_class = freeze(
        ids.join(named, "k1", "left").filter("copies > 1 OR least IS NOT NULL").select("k1", "k2", F.coalesce("least", "doc_id").alias("component_id"))
    )
    out = seen.join(broadcast_if_small(of_class, of_class.count(), BROADCAST), ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
