"""SimHash near-duplicates over a Gray-order hierarchical index.

A fingerprint has a bit where over half of a text's shingle hashes have it.
Equal fingerprints are one class from the start. Fingerprints at most RADIUS
bits apart agree on one of RADIUS + 1 equal segments, so each class is sent
once per segment to the partition of that segment's value; no class is ever
compared with all others. There, the fingerprints, turned so that the segment
comes first, are sorted by Gray rank, in which neighbours differ in few bits.
Runs of neighbours form nodes: a node keeps the bits that all its members
share, and an upper node takes over what its children share, so that each
shared pattern is compared once. A search descends level by level, adds up the
differences to the masked patterns, and drops a whole node when the sum passes
the radius, or when the searcher is already connected with all its members,
which keeps large groups of near copies from being compared pair by pair.

A segment value that holds over `crowd` classes is parted again by the
segments of its remaining bits, by the same argument.

Nulls: a null text counts as empty; a text without words has fingerprint zero,
which links like any other. Null ids never become a component's name unless
all ids in it are null. Extra columns are ignored; repeated rows are kept. A
text longer than a block is a block of its own; some 200 bytes of arrays are held
for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, discard, lookup, map_blocks, slices, written
from .graph import components, unite

RADIUS = 3
FANOUT = 8
#: Rows of a search's frontier that are held at once.
FRONTIER = 400_000
#: Classes in one segment value beyond which it is parted again.
CROWD = 200_000
#: Classes that one search partition holds on average, at most.
PARTITION_CLASSES = 400_000

#: Which bits each byte value has, and where each of a hash's 8 bytes is counted.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
PLACES = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of all shingles of the A-Z-lowered words of UTF-8 bytes, repeats included."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], 42) for a, b in zip(starts, ends)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    places = hashes.view(np.uint8).reshape(-1, 8) + PLACES
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ BYTE_BITS).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(data: bytes, width: int) -> int:
    """SimHash of a text in shingles of `width` words; zero for no words."""
    return majority(shingle_hashes(data, width))


def fingerprints(docs: DataFrame, width: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a signed long."""
    kind = docs.schema[id_column].dataType.simpleString()

    def block(batch: pa.RecordBatch) -> list:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        found = np.array([fingerprint(t or b"", width) for t in texts], np.uint64)
        return [batch.column(0), found.view(np.int64)]

    return map_blocks(docs.select(F.col(id_column), F.col(text_column)), 1, f"doc_id {kind}, fp long", block)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of masked patterns over fingerprints sorted by Gray rank.

    Level 0 has the fingerprints; node k of level n covers nodes
    k*FANOUT..k*FANOUT+FANOUT-1 of level n - 1. `masks[n]` has the bits that a
    node shares and its parent doesn't, `patterns[n]` their values.
    """

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        shared, values = [np.full(len(codes), ~np.uint64(0))], [self.codes]
        while len(values[-1]) > 64:
            cuts = np.arange(0, len(values[-1]), FANOUT)
            every = np.bitwise_and.reduceat(values[-1], cuts)
            some = np.bitwise_or.reduceat(values[-1] & shared[-1], cuts)
            mask = np.bitwise_and.reduceat(shared[-1], cuts) & ~(every ^ some)
            shared.append(mask)
            values.append(every & mask)
        self.masks, self.patterns = [], []
        for n, (mask, value) in enumerate(zip(shared, values)):
            above = shared[n + 1][np.arange(len(mask)) // FANOUT] if n + 1 < len(shared) else np.uint64(0)
            self.masks.append(mask & ~above)
            self.patterns.append(value)

    def bounds(self, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Least and greatest label below every node."""
        out = [(labels, labels)]
        for values in self.patterns[1:]:
            cuts = np.arange(0, len(out[-1][0]), FANOUT)
            out.append((np.minimum.reduceat(out[-1][0], cuts), np.maximum.reduceat(out[-1][1], cuts)))
        return out

    def search(self, queries: np.ndarray, radius: int, must: int = 0, labels: np.ndarray | None = None, own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, sorted place) within the radius; the bits of `must` have to agree.

        With labels of the places and the queries' own labels, nodes wholly of
        the query's own label are left out.
        """
        top = len(self.patterns) - 1
        limits = self.bounds(labels) if labels is not None else None
        must = np.uint64(must)
        step = max(1, FRONTIER // max(1, len(self.patterns[top])))
        stack = []
        for at in range(0, len(queries), step):
            some = np.arange(at, min(len(queries), at + step))
            stack.append((top, np.repeat(some, len(self.patterns[top])), np.tile(np.arange(len(self.patterns[top])), len(some)), None))
        while stack:
            level, query, node, differ = stack.pop()
            apart = (queries[query] ^ self.patterns[level][node]) & self.masks[level][node]
            total = np.bitwise_count(apart).astype(np.int16)
            total += differ if differ is not None else 0
            keep = (total <= radius) & ((apart & must) == 0)
            if limits is not None:
                low, high = limits[level]
                keep &= (low[node] != own[query]) | (high[node] != own[query])
            query, node, total = query[keep], node[keep], total[keep]
            if not level:
                yield query, node
                continue
            below = len(self.patterns[level - 1])
            for at in range(0, len(query), FRONTIER // FANOUT):
                part = slice(at, at + FRONTIER // FANOUT)
                child = (node[part, None] * FANOUT + np.arange(FANOUT)).ravel()
                real = child < below
                stack.append((level - 1, np.repeat(query[part], FANOUT)[real], child[real], np.repeat(total[part], FANOUT)[real]))


def local_roots(codes: np.ndarray, radius: int = RADIUS, must: int = 0) -> np.ndarray:
    """For distinct codes, the place of the first member of each one's group of links."""
    index = GrayIndex(codes)
    parent = np.arange(len(codes))
    at, size = 0, 32
    while at < len(codes):
        some = np.arange(at, min(at + size, len(codes)))
        for query, place in index.search(index.codes[some], radius, must, parent.copy(), parent[some]):
            unite(parent, some[query], place)
        at, size = at + size, min(2 * size, 1 << 15)
    out = np.empty(len(codes), np.int64)
    out[index.order] = index.order[parent]
    return out


def _turned(codes: np.ndarray, shift: int) -> np.ndarray:
    if not shift:
        return codes
    return (codes << np.uint64(shift)) | (codes >> np.uint64(64 - shift))


def _segments(bits: list[int], parts: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(np.array(bits), parts)]


def links(classes: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(fp, other): a forest whose trees are the groups found in each partition; classes has distinct `fp`."""
    spark = classes.sparkSession
    parts = radius + 1
    size = 64 // parts
    edges = [(k * size, (64 if k == radius else (k + 1) * size)) for k in range(parts)]
    fp = F.col("fp")

    def value(first: int, last: int):
        return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << (last - first)) - 1))

    keyed = classes.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("seg"), value(*e).alias("val")) for k, e in enumerate(edges)])).alias("s")).select("fp", "s.seg", "s.val")
    crowded = keyed.groupBy("seg", "val").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("seg", "val", F.lit(True).alias("crowded"))
    marked = keyed.join(crowded, ["seg", "val"], "left")
    finer = []
    for k, (first, last) in enumerate(edges):
        rest = [b for b in range(64) if not first <= b < last]
        for j, own in enumerate(_segments(rest, parts)):
            mask = sum(1 << b for b in own)
            mask -= (mask >> 63) << 64
            finer.append(F.when(F.col("seg") == k, F.struct(F.lit(j).alias("sub"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("subval"))))
    dealt = marked.select("fp", "seg", "val", F.explode(F.when(F.col("crowded"), F.filter(F.array(*finer), lambda x: x.isNotNull())).otherwise(F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subval"))))).alias("f")).select("fp", "seg", "val", "f.sub", "f.subval")
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parts * classes.count() // PARTITION_CLASSES))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        codes = np.concatenate([c for c, _ in held]).view(np.uint64)
        segs = np.concatenate([s for _, s in held])
        del held
        for k in np.unique(segs):
            own = np.unique(codes[segs == k])
            first, last = edges[k]
            # The segment comes first, and nodes that differ in it are dropped at once.
            shift = (64 - last) % 64
            must = ((1 << (last - first)) - 1) << (64 - (last - first))
            root = local_roots(_turned(own, shift), radius, must)
            tied = np.flatnonzero(root != np.arange(len(own)))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(own[tied].view(np.int64)), pa.array(own[root[tied]].view(np.int64))], names=["fp", "other"])

    return dealt.repartition(wanted, "seg", "val", "sub", "subval").select("fp", "seg").mapInArrow(find, "fp long, other long").distinct()


#: A long signature: the fingerprint and three more of the same shingles, hashed on with these odd numbers.
MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
SIGNS = 4
SIMILAR = 0.8
#: Bits of 256 by which the signatures of a pair that bands propose differ at most; others are left to the prefixes. At a similarity of 0.8 they differ in about 39.
LOOSE = 60
#: Share of a signature's bits that agree at that similarity, and the e-folds by which a pair's chance to share no band falls.
AGREE, FOLDS = 0.848, 4.0
#: Classes in a band's bucket, on average, and at most: a fuller one is parted by more bits of its band.
BUCKET, FULL = 128, 20_000
#: Rows of bands that a partition holds on average, at most.
PARTITION_ROWS = 1_000_000
#: Texts, and shingles, of one candidate group that are verified in one block.
SETS, SHINGLES = 2_000, 2_000_000


def signature(data: bytes, width: int) -> tuple[list[int], np.ndarray]:
    """Four fingerprints of the distinct shingles with independent bits, the plain one first, and these shingles' hashes."""
    hashes = np.unique(shingle_hashes(data, width))
    out = [majority(hashes)]
    for m in MIXERS:
        mixed = (hashes ^ (hashes >> np.uint64(29))) * m
        out.append(majority(np.ascontiguousarray(mixed ^ (mixed >> np.uint64(32)))))
    return out, hashes


class Bands:
    """Which bits of a signature each band reads: `bits` at first, twice as many at every further level.

    With few bits a bucket holds many classes, and with many a pair needs more
    bands to share one; the number of bits follows from that of classes.
    """

    def __init__(self, classes: int, seed: int = 31):
        self.bits = min(32, max(4, int(np.ceil(np.log2(max(2, classes) / BUCKET)))))
        self.count = int(np.ceil(FOLDS / AGREE**self.bits))
        rng = np.random.default_rng(seed)
        self.orders = [rng.permutation(64 * SIGNS) for _ in range(self.count)]
        self.levels = int(np.ceil(np.log2(64 * SIGNS / self.bits))) + 1

    def keys(self, signs: np.ndarray, band: int, level: int) -> np.ndarray:
        """A hash of the bits that the band reads of each signature at this level."""
        order = self.orders[band][: self.bits << level]
        out = np.full(len(signs), (band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64) + np.uint64(level)
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            word = np.zeros(len(signs), np.uint64)
            for k, bit in enumerate(some.tolist()):
                word |= ((signs[:, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1)) << np.uint64(k)
            out = (out ^ word) * np.uint64(0xC2B2AE3D27D4EB4F)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)


def bucket_pairs(key: np.ndarray, signs: np.ndarray, size: np.ndarray, similar: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in equal buckets (key is sorted) whose signatures and sizes allow the similarity."""
    last = np.searchsorted(key, key, side="right") - 1
    for shift in range(1, int((last - np.arange(len(key))).max(initial=0)) + 1):
        left = np.flatnonzero(last - np.arange(len(key)) >= shift)
        for at in range(0, len(left), 1 << 18):
            a = left[at : at + (1 << 18)]
            b = a + shift
            a = a[np.minimum(size[a], size[b]) >= similar * np.maximum(size[a], size[b])]
            apart = np.zeros(len(a), np.uint16)
            for w in range(SIGNS):
                apart += np.bitwise_count(signs[a, w] ^ signs[a + shift, w])
            a = a[apart <= LOOSE]
            if len(a):
                yield a, a + shift


def proposals(classes: DataFrame, similar: float) -> DataFrame:
    """(node, other): a forest whose trees are the candidates found in each partition; classes has `node`, s0 to s3 and `shingles`."""
    spark = classes.sparkSession
    n = classes.count()
    bands = Bands(n)
    names = [f"s{w}" for w in range(SIGNS)]

    def dealt(full: list[np.ndarray], bare: bool = False) -> DataFrame:
        """Every class in a bucket of each band; those in a full one in one of the next level. Bare: the keys alone."""

        def run(batches):
            for batch in batches:
                signs = np.stack([batch.column(c).to_numpy() for c in names], 1).view(np.uint64)
                for band in range(bands.count):
                    key = bands.keys(signs, band, 0)
                    for level, crowded in enumerate(full):
                        again = np.flatnonzero(np.isin(key, crowded))
                        key[again] = bands.keys(signs[again], band, level + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(key), *(() if bare else batch.columns)], names=["key", *(() if bare else ("node", *names, "shingles"))])

        return classes.select("node", *names, "shingles").mapInArrow(run, "key long" + ", node long, s0 long, s1 long, s2 long, s3 long, shingles long" * (not bare))

    full: list[np.ndarray] = []
    while n > FULL and len(full) < bands.levels - 1:
        # There are n * bands / FULL full buckets at most.
        crowded = dealt(full, True).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > FULL).select("key").toArrow().column("key").to_numpy()
        if not len(crowded):
            break
        full.append(np.sort(crowded))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        key, node, size = (table.column(c).to_numpy() for c in ("key", "node", "shingles"))
        signs = np.stack([table.column(c).to_numpy() for c in names], 1).view(np.uint64)
        order = np.argsort(key, kind="stable")
        nodes, place = np.unique(node[order], return_inverse=True)
        parent = np.arange(len(nodes))
        for a, b in bucket_pairs(key[order], signs[order], size[order], similar):
            unite(parent, place[a], place[b])
        tied = np.flatnonzero(parent != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[parent[tied]])], names=["node", "other"])

    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * bands.count // PARTITION_ROWS))
    return dealt(full).repartition(wanted, "key").mapInArrow(find, "node long, other long").distinct()


def most_apart(first, second, similar: float):
    """In how many shingles two texts with so many may differ at the similarity."""
    return (first + second) * (1 - similar) / (1 + similar) + 1e-6


def parities(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Of each set a bit for each remainder of `bits` (a power of two): whether an odd number of its hashes has it.

    A hash that only one of two sets has turns one bit, so they differ in as
    many hashes as bits, at least.
    """
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for k, x in enumerate(sets):
        odd = np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out[k] = np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")
    return out


def parity_bits(size: int) -> int:
    """Bits of parity that tell sets of this size apart."""
    return 1 << max(8, min(16, int(size).bit_length()))


def verified(sets: list[np.ndarray], parent: np.ndarray, first: np.ndarray, second: np.ndarray, similar: float = SIMILAR) -> np.ndarray:
    """Roots after uniting the pairs of `first` and `second` whose Jaccard similarity is `similar` or more; united ones are not compared again."""
    size = np.array([len(x) for x in sets], np.int64)
    odd = parities(sets, parity_bits(size.max(initial=0)))
    same, whole = np.array_equal(first, second), second
    for k, i in enumerate(first):
        second = whole[k + 1 :] if same else whole
        near = second[(np.minimum(size[second], size[i]) >= similar * np.maximum(size[second], size[i])) & (parent[second] != parent[i])]
        near = near[np.bitwise_count(odd[near] ^ odd[i]).sum(1, dtype=np.int64) <= most_apart(size[near], size[i], similar)]
        for j in near:
            if parent[i] != parent[j]:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common >= similar * (size[i] + size[j] - common):
                    unite(parent, np.array([i]), np.array([j]))
    return parent


#: A shingle in over so many prefixes goes behind all rarer ones; one in over so many is compared in blocks of about so many.
COMMON, BLOCK = 200, 4_000
#: Pairs that are looked at together.
MET = 1 << 20


class Order:
    """One order of all shingles, those that were common last; any order finds the same texts, this one with fewer pairs.

    Two sets whose similarity is `similar` share a shingle among the first
    `n - ceil(similar * n) + 1` of each: without one of these either set
    has too few left. So shared prefixes propose every such pair.
    """

    def __init__(self, common: np.ndarray, counts: np.ndarray, similar: float):
        order = np.argsort(common)
        self.common, self.counts, self.similar = common[order], counts[order], similar

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        """The first hashes of a set (sorted by value), in order."""
        size = len(hashes) - int(np.ceil(self.similar * len(hashes) - 1e-9)) + 1
        if not len(hashes) or not len(self.common):
            return hashes[:size]
        at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
        weight = np.where(self.common[at] == hashes, self.counts[at], 0)
        return hashes[np.lexsort((hashes, weight))[:size]]


def cross_pairs(key: np.ndarray, group: np.ndarray, size: np.ndarray, place: np.ndarray, similar: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of equal key and different group (rows are sorted by both) whose sizes and places in the prefixes allow the similarity."""
    rows = np.arange(len(key))
    last = np.searchsorted(key, key, side="right")
    new = np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]), True]
    start = np.append(np.flatnonzero(new[:-1]), len(key))[np.cumsum(new[:-1])] if len(key) else rows
    count = last - start
    total = np.cumsum(count)
    at = 0
    while at < len(key):
        # A row alone may have more partners than are looked at together; they are few enough for its block.
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + MET, side="right")))
        n = count[at:end]
        a = np.repeat(rows[at:end], n)
        b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[at:end], n)
        keep = np.minimum(size[a], size[b]) >= similar * np.maximum(size[a], size[b])
        # The first shared shingle leaves so many that may be shared.
        keep &= np.minimum(size[a] - place[a], size[b] - place[b]) >= (size[a] + size[b]) * similar / (1 + similar) - 1e-6
        if keep.any():
            yield a[keep], b[keep]
        at = end


def folded(odd: np.ndarray, bits: int) -> np.ndarray:
    """Parities in fewer bits: the halves' add up to those of half as many."""
    while odd.shape[1] * 64 > bits:
        odd = odd[:, : odd.shape[1] // 2] ^ odd[:, odd.shape[1] // 2 :]
    return odd


class Odd:
    """Parities of texts of many sizes, by their width."""

    def __init__(self, binary: list[bytes], size: np.ndarray):
        width = np.array([8 * len(x) for x in binary], np.int64)
        self.width, self.size, self.rows = width, size, {}
        for bits in np.unique(width).tolist():
            # Texts of twice the width may meet these, too.
            own, wide = np.flatnonzero(width == bits), np.flatnonzero(width == 2 * bits)
            read = lambda some: np.frombuffer(b"".join([binary[k] for k in some]), np.uint64)
            odd = np.concatenate([read(own).reshape(len(own), -1), folded(read(wide).reshape(len(wide), bits // 32), bits)])
            place = np.zeros(len(width), np.int64)
            place[own], place[wide] = np.arange(len(own)), np.arange(len(wide)) + len(own)
            self.rows[bits] = odd, place

    def near(self, a: np.ndarray, b: np.ndarray, similar: float) -> np.ndarray:
        """Which pairs may have the similarity; their sizes allow it, so that widths differ by a factor of two at most."""
        keep = np.zeros(len(a), bool)
        bits = np.minimum(self.width[a], self.width[b])
        for n in np.unique(bits).tolist():
            odd, place = self.rows[n]
            some = np.flatnonzero(bits == n)
            for at in range(0, len(some), MET * 64 // n):
                k = some[at : at + MET * 64 // n]
                apart = np.bitwise_count(odd[place[a[k]]] ^ odd[place[b[k]]]).sum(1, dtype=np.int64)
                keep[k] = apart <= most_apart(self.size[a[k]], self.size[b[k]], similar)
        return keep


def missed(texts: DataFrame, width: int, similar: float) -> DataFrame:
    """(grp, other): forests of the groups that have a pair of texts which may have the similarity; texts has `node`, `text` and `grp`.

    Nothing here goes by chance: prefixes in one order of all shingles meet,
    and pairs whose parities differ in too many bits go. No table has a row for
    each pair: the rows of prefixes that meet another group's are kept, get
    their texts' parities, and meet again.
    """
    spark = texts.sparkSession

    def prefixes(order: Order, hot: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
        """Rows of all prefixes; without `hot`, which has the keys to be parted and their pieces, the hashes alone."""
        shared = spark.sparkContext.broadcast((order, hot))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, parted = shared.value
            for batch in batches:
                for part in slices(batch, 1):
                    sets = [np.unique(shingle_hashes(t or b"", width)) for t in part.column(1).to_pylist()]
                    first = [own.prefix(x) for x in sets]
                    many = np.array([len(x) for x in first], np.int64)
                    key = np.concatenate([np.zeros(0, np.uint64), *first])
                    if parted is None:
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])
                        continue
                    row = np.repeat(np.arange(len(many)), many)
                    place = np.arange(len(key)) - np.repeat(np.cumsum(many) - many, many)
                    node, grp = (part.column(c).to_numpy() for c in (0, 2))
                    if len(parted[0]) and len(key):
                        # A key over a block meets itself block by block.
                        at = np.minimum(np.searchsorted(parted[0], key), len(parted[0]) - 1)
                        pieces = np.where(parted[0][at] == key, parted[1][at], 1)
                        piece = (node[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % pieces.astype(np.uint64)
                        again = np.repeat(np.arange(len(key)), pieces)
                        other = np.arange(len(again)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                        low, high = np.minimum(piece[again], other.astype(np.uint64)), np.maximum(piece[again], other.astype(np.uint64))
                        key = key[again] + (low * np.uint64(1 << 20) + high) * np.uint64(0xC2B2AE3D27D4EB4F)
                        row, place = row[again], place[again]
                    size = np.array([len(x) for x in sets], np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[row]), pa.array(grp[row]), pa.array(size[row]), pa.array(place.astype(np.int32))], names=["key", "node", "grp", "size", "place"])
                pa.default_memory_pool().release_unused()

        return texts.select("node", "text", "grp").mapInArrow(run, "key long" if hot is None else "key long, node long, grp long, size int, place int")

    def counted(order: Order, least: int) -> tuple[np.ndarray, np.ndarray]:
        found = prefixes(order).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > least).toArrow()
        return found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()

    order = Order(np.zeros(0, np.uint64), np.zeros(0, np.int64), similar)
    order = Order(*counted(order, COMMON), similar)
    key, n = counted(order, BLOCK)
    by_key = np.argsort(key)

    def sorted_rows(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
        """The rows of a partition by key and group; keys of one text alone have no pair."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return None
        table = pa.Table.from_batches(held)
        key, grp = (table.column(c).to_numpy() for c in ("key", "grp"))
        order = np.lexsort((grp, key))
        same = key[order][1:] == key[order][:-1]
        return table.take(pa.array(order[np.r_[False, same] | np.r_[same, False]] if len(order) > 1 else order[:0]))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sorted_rows(batches)
        if table is None:
            return
        some = np.zeros(table.num_rows, bool)
        for a, b in cross_pairs(*(table.column(c).to_numpy() for c in ("key", "grp", "size", "place")), similar):
            some[a] = some[b] = True
        yield from table.select(["key", "node", "place"]).filter(pa.array(some)).combine_chunks().to_batches()

    dealt = prefixes(order, (key[by_key], -(-n[by_key] // BLOCK)))
    signed = written(dealt, "prefixes")

    def by_key_of(table: DataFrame) -> DataFrame:
        return table.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // PARTITION_ROWS)), "key")

    live = written(by_key_of(signed).mapInArrow(met, "key long, node long, place int"), "met")
    discard(signed)
    asked = texts.join(live.groupBy("node").agg(F.collect_list(F.struct("key", "place")).alias("keys")), "node").select("node", "text", "grp", "keys")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, total = [], 0
            for node, text, grp, keys in zip(*(batch.column(c) for c in range(4))):
                own = np.unique(shingle_hashes(text.as_py() or b"", width))
                odd = parities([own], parity_bits(len(own)))[0].tobytes()
                step = max(1, BLOCK_BYTES // len(odd))
                for at in range(0, len(keys.values), step):
                    part = keys.values.slice(at, step)
                    n = len(part)
                    held.append(pa.RecordBatch.from_arrays([part.field("key"), pa.array(np.full(n, grp.as_py())), pa.array(np.full(n, len(own), np.int32)), part.field("place"), pa.array([odd] * n, pa.binary())], names=["key", "grp", "size", "place", "odd"]))
                    total += n * len(odd)
                    if total >= BLOCK_BYTES:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held, total = [], 0
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            pa.default_memory_pool().release_unused()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sorted_rows(batches)
        if table is None:
            return
        key, grp, size, place = (table.column(c).to_numpy() for c in ("key", "grp", "size", "place"))
        odd = Odd(table.column("odd").to_pylist(), size)
        groups, own = np.unique(grp, return_inverse=True)
        parent = np.arange(len(groups))
        for a, b in cross_pairs(key, grp, size, place, similar):
            apart = parent[own[a]] != parent[own[b]]
            a, b = a[apart], b[apart]
            keep = odd.near(a, b, similar)
            unite(parent, own[a[keep]], own[b[keep]])
        tied = np.flatnonzero(parent != np.arange(len(groups)))
        yield pa.RecordBatch.from_arrays([pa.array(groups[tied]), pa.array(groups[parent[tied]])], names=["grp", "other"])

    signed = written(asked.mapInArrow(marked, "key long, grp long, size int, place int, odd binary"), "parities")
    found = written(by_key_of(signed).mapInArrow(near, "grp long, other long").distinct(), "missed")
    discard(live, signed)
    return found


def _grouped(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): every node with the name of its component."""
    return nodes.join(components(edges).select("node", F.col("component").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _checked(members: DataFrame, texts: DataFrame, width: int, similar: float) -> DataFrame:
    """(node, other): forests of the links that the shingles themselves confirm within each block.

    members has `node`, the text's place among `a` and `b`, the block's two
    sides, `side`, and `root`, what it is already united with.
    """

    def shingled(batch: pa.RecordBatch) -> list:
        return [batch.column(0), [np.unique(shingle_hashes(t or b"", width)).view(np.int64) for t in batch.column(1).to_pylist()]]

    # A text's shingles are made once, however many blocks it is in.
    asked = texts.join(members.select("node").distinct(), "node")
    sets = map_blocks(asked.select("node", "text"), 1, "node long, hashes array<long>", shingled)

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        nodes, side = table.column("node").to_numpy(), table.column("side").to_numpy()
        hashes = [x.values.to_numpy().view(np.uint64) for x in table.column("hashes")]
        _, root = np.unique(table.column("root").to_numpy(), return_inverse=True)
        first = np.full(len(nodes), len(nodes))
        np.minimum.at(first, root, np.arange(len(nodes)))
        parent = verified(hashes, first[root], *(np.flatnonzero(side == x) for x in (side.min(), side.max())), similar)
        tied = np.flatnonzero(parent != np.arange(len(nodes)))
        return pa.table([pa.array(nodes[tied]), pa.array(nodes[parent[tied]])], names=["node", "other"])

    met = members.join(sets, "node").select("node", "hashes", "loose", "a", "b", "side", "root")
    return written(met.groupBy("loose", "a", "b").applyInArrow(verify, "node long, other long"), "verified")


def similar_groups(docs: DataFrame, width: int = 5, similar: float = SIMILAR, id_column: str = "doc_id", text_column: str = "text", row_column: str = "row") -> DataFrame:
    """(doc_id, row, representative): groups of texts linked by a Jaccard similarity of `similar` or more of their distinct shingles.

    The Gray-order index proposes fingerprints at RADIUS or fewer differing
    bits. At the similarity no segment of 64 bits need agree, so signatures four
    times as long are indexed, too: each of many bands reads some of the 256
    bits, and texts that agree on a band's bits are proposed if LOOSE bits differ
    at most. Both go by chance, so all prefixes of the shingles (see Order)
    propose what they have missed: every pair with the similarity, by
    necessity. Proposals make candidate groups; in these the shingles themselves
    are compared, and only texts with the similarity are linked. Groups larger
    than a block are cut: the blocks are compared within, then a text of each
    united part with those of the others, and only what then is still apart is
    compared block by block. Texts with equal shingles are one class from the
    start; null, empty and wordless texts have equal (no) shingles, so one row of
    them all stays. `row` names the rows of docs, `representative` is the row
    that stays: the smallest of its group by id, then row.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def block(batch: pa.RecordBatch) -> list:
        found = [signature(t or b"", width) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        bits = np.array([f[0] for f in found], np.uint64).reshape(-1, SIGNS).view(np.int64)
        return [batch.column(0), batch.column(2), *bits.T, np.array([len(f[1]) for f in found], np.int64), [xxhash.xxh3_128_digest(f[1].tobytes()) for f in found]]

    signed = written(map_blocks(docs.select(id_column, text_column, F.col(row_column).alias("row")), 1, f"doc_id {kind}, row long, s0 long, s1 long, s2 long, s3 long, shingles long, key binary", block), "signatures")
    key = ["s0", "s1", "s2", "s3", "shingles"]
    classes = signed.groupBy("key", *key).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.count("*").alias("n")).withColumn("node", F.col("first.row"))
    classes = written(classes, "signed-classes")
    edges = written(proposals(classes, similar), "proposals")
    first = written(classes.groupBy("s0").agg(F.min("node").alias("other"), F.count("*").alias("n")), "by-fingerprint")
    equal = lookup(classes.select("node", "s0"), first, "s0", "n").where("node != other").select("node", "other")
    tied = links(first.select(F.col("s0").alias("fp"))).select(F.col("fp").alias("s0"), F.col("other").alias("s1"))
    ends = tied.join(first.select("s0", F.col("other").alias("a")), "s0").join(first.select(F.col("s0").alias("s1"), F.col("other").alias("b")), "s1")
    proposed = components(edges.unionByName(equal).unionByName(ends.select(F.col("a").alias("node"), F.col("b").alias("other"))))
    proposed = written(proposed, "proposed")
    # What the signatures have missed.
    texts = docs.select(F.col(row_column).alias("node"), F.col(text_column).cast("binary").alias("text"))
    whole = classes.select("node", "shingles").join(proposed, "node", "left").select("node", "shingles", F.coalesce("component", "node").alias("grp"), F.col("component").isNotNull().alias("linked"))
    whole = written(whole, "grouped")
    held = written(texts.join(whole.select("node", "grp"), "node"), "texts")
    more = missed(held, width, similar)
    discard(held)
    loose = whole.withColumnRenamed("grp", "loose")
    if not more.isEmpty():
        # Groups are joined as such, so that their members are not gone through again.
        sizes = whole.groupBy("grp").agg(F.count("*").alias("members"))
        up = written(components(more).select(F.col("node").alias("grp"), F.col("component").alias("up")).join(sizes, "grp"), "joined-groups")
        loose = lookup(whole, up, "grp", "members").select("node", "shingles", F.coalesce("up", "grp").alias("loose"), (F.col("linked") | F.col("up").isNotNull()).alias("linked"))
    loose = written(loose.where("linked").drop("linked"), "candidates")
    wide = loose.groupBy("loose").agg(F.count("*").alias("members"), F.ceil(F.greatest(F.count("*") / SETS, F.sum("shingles") / SHINGLES)).cast("int").alias("pieces"))
    wide = written(wide, "candidate-groups")
    members = written(lookup(loose.select("node", "loose"), wide, "loose", "members").withColumn("piece", F.pmod(F.xxhash64("node"), F.greatest("pieces", F.lit(1))).cast("int")), "members")
    once = members.select("node", "loose", F.col("piece").alias("a"), F.col("piece").alias("b"), F.col("piece").alias("side"), F.col("node").alias("root"))
    joined = _checked(once, texts, width, similar)
    named = members.select("node", "loose", "piece", "pieces")
    if not wide.where("pieces > 1").isEmpty():
        # One text of every united part meets those of the other parts.
        named = written(_grouped(joined, named), "parts")
        parts = named.where("pieces > 1 AND node = root").withColumn("side", F.lit(0))
        few = parts.withColumn("n", F.count("*").over(Window.partitionBy("loose"))).where(F.col("n") <= SETS)
        again = _checked(few.select("node", "loose", F.lit(0).alias("a"), F.lit(0).alias("b"), "side", "root"), texts, width, similar)
        joined = joined.unionByName(again)
        named = written(_grouped(joined, named.drop("root")), "united")
        # What is still apart is compared block by block.
        apart = named.where("pieces > 1").groupBy("loose").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("loose")
        apart = named.join(apart, "loose", "left_semi")
        if not apart.isEmpty():
            met = apart.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).where("other != piece")
            met = met.select("node", "loose", F.least("piece", "other").alias("a"), F.greatest("piece", "other").alias("b"), F.col("piece").alias("side"), "root")
            joined = joined.unionByName(_checked(met, texts, width, similar))
        joined = components(joined)
    else:
        # Where every group is one block, its roots are final.
        joined = joined.withColumnRenamed("other", "component")
    named = classes.select("key", "first", "n", "node").join(joined, "node", "left").withColumn("root", F.coalesce("component", "node"))
    sizes = named.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("members"))
    labels = written(lookup(named.select("root", "node", "n", "key"), sizes, "root", "members").select("key", F.col("least.row").alias("representative"), "n"), "representatives")
    return lookup(signed.select("doc_id", "row", "key"), labels, "key", "n").select("doc_id", "row", "representative")


def near_duplicates(docs: DataFrame, width: int, radius: int = RADIUS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id that links reach."""
    found = written(fingerprints(docs, width, id_column, text_column), "fingerprints")
    return grouped(found, radius)


def grouped(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Adds component_id to a stored table of (doc_id, fp)."""
    classes = written(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    joined = components(links(classes.select("fp"), radius)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    named = classes.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    sizes = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    labels = written(lookup(named, sizes, "root", "members").select("fp", "component_id", "n"), "labels")
    return lookup(found, labels, "fp", "n").select("doc_id", "fp", "component_id")
