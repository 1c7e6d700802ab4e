"""Near-duplicate vectors over a robust-pruned flat graph.

Equal vectors of a label are one class from the start. A label's classes are
split into cells of bounded size (one, for most labels) around the nearest
centres, and the classes of a cell into cluster shards, each class going to its
two nearest ones. In a shard, every class gets a pool of near and some random others and
keeps those that robust pruning leaves: a neighbour drops out when a nearer one
is closer to it by ALPHA. Adjacency lists of the shards are united, links added
backwards, and each class is searched in its home cell: greedily from the shards'
medoids and its own list, then, without a cap, on through all classes within the
range and a margin around it. Every pair found is verified in double precision.
A sample of each cell, of any classes and of linked ones, is audited against
brute force, a class's link with itself left out; where recall falls short of
AUDIT the graph is built and searched again with more neighbours, a larger pool
and a wider beam. Should the widest step of LADDER fall short, too, the cell is
compared in full, block by block.

No link across a border is lost: a class visits every cell whose side of the
bisector with its own cell lies within the range, and the visitors of two cells
to each other are compared in full. A cell over the bound is cut at random, and
its pieces visit each other.

Vectors that are null, zero, hold null or non-finite components or have no
label link with nothing: no links, a component of their own, kept. Vectors of
different lengths don't link. A null id can't name a component. Extra columns
are ignored; repeated rows are links of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, written
from .graph import components, unite
from .vectors import kmeans, matrix, usable

THRESHOLD = 0.93
#: Cosine below the range through which the search still goes on.
MARGIN = 0.05
ALPHA = 1.2
RANDOM = 8
#: Neighbours kept, pool that they are pruned from, and beam of the search, from narrow to wide.
LADDER = ((16, 40, 12), (32, 80, 32), (64, 200, 96))
SHARD = 2_000
CELL = 20_000
#: Vectors that cell centres are fitted on, for all labels together.
SAMPLE = 20_000
AUDIT = 0.99
AUDITED = 64


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors**2).sum(1, keepdims=True))


def shards(points: np.ndarray, rng: np.random.Generator, size: int = SHARD) -> list[np.ndarray]:
    """Overlapping clusters: every point lies in its two nearest ones, a large one cut at random."""
    k = -(-2 * len(points) // size)
    if k <= 2:
        return [np.arange(len(points))]
    centres = kmeans(points[rng.choice(len(points), min(len(points), 64 * k), replace=False)], k, 6, rng)
    near = np.argsort(((centres**2).sum(1) - 2 * points @ centres.T), axis=1)[:, :2]
    out = []
    for c in range(k):
        own = np.flatnonzero((near == c).any(1))
        rng.shuffle(own)
        out += [x for x in np.array_split(own, max(1, -(-len(own) // (2 * size)))) if len(x)]
    return out


def pruned(points: np.ndarray, rng: np.random.Generator, degree: int = LADDER[0][0], pool: int = LADDER[0][1]) -> np.ndarray:
    """Robust-pruned out-neighbours of each point, -1 where there are fewer."""
    n = len(points)
    out = np.full((n, degree), -1, np.int64)
    if n < 2:
        return out
    pool = min(pool, n - 1)
    for at in range(0, n, 256):
        some = np.arange(at, min(n, at + 256))
        near = points[some] @ points.T
        near[np.arange(len(some)), some] = -2
        ids = np.argpartition(near, n - pool, axis=1)[:, n - pool :]
        ids = np.concatenate([ids, rng.integers(0, n, (len(some), RANDOM))], 1)
        far = 2 - 2 * np.take_along_axis(near, ids, 1)
        alive = ids != some[:, None]
        members = points[ids]
        between = 2 - 2 * members @ members.transpose(0, 2, 1)
        row = np.arange(len(some))
        for r in range(degree):
            left = np.where(alive, far, np.inf)
            pick = left.argmin(1)
            real = np.isfinite(left[row, pick])
            if not real.any():
                break
            out[some[real], r] = ids[row, pick][real]
            alive &= (ALPHA**2 * between[row, pick] > far) & (ids != ids[row, pick][:, None])
    return out


def united(points: np.ndarray, rng: np.random.Generator, size: int = SHARD, degree: int = LADDER[0][0], pool: int = LADDER[0][1]) -> tuple[np.ndarray, np.ndarray]:
    """The united adjacency of all shards as (starts, ends by start), and the shards' medoids."""
    tails, heads, medoids = [], [], []
    for own in shards(points, rng, size):
        links = pruned(points[own], rng, degree, pool)
        a, r = np.nonzero(links >= 0)
        b = links[a, r]
        tails += [own[a], own[b]]
        heads += [own[b], own[a]]
        medoids.append(own[(points[own] @ points[own].mean(0)).argmax()])
    n = len(points)
    both = np.unique(np.concatenate(tails) * n + np.concatenate(heads)) if tails else np.zeros(0, np.int64)
    starts = np.searchsorted(both // n, np.arange(n + 1)) if n else np.zeros(1, np.int64)
    return starts, both % n, np.unique(medoids)


def _neighbours(starts: np.ndarray, ends: np.ndarray, query: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (query, neighbour) of (query, node)."""
    count = starts[node + 1] - starts[node]
    first = np.cumsum(count) - count
    place = np.arange(count.sum()) - np.repeat(first - starts[node], count)
    return np.repeat(query, count), ends[place]


def range_search(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, medoids: np.ndarray, some: np.ndarray, least: float, beam: int = LADDER[0][2]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in some, node) with a cosine of `least` or more that the graph leads to."""
    n, q = len(points), len(some)
    seen = np.zeros((q, n), bool)
    own = points[some]
    reach = least - MARGIN

    def fresh(query: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        new = ~seen[query, node]
        key = np.unique(query[new] * n + node[new])
        query, node = key // n, key % n
        seen[query, node] = True
        near = np.concatenate([(own[query[i : i + 65536]] * points[node[i : i + 65536]]).sum(1) for i in range(0, len(query), 65536)] or [np.zeros(0)])
        return query, node, near

    everyone = np.arange(q)
    query = np.concatenate([everyone, np.repeat(everyone, len(medoids))])
    node = np.concatenate([some, np.tile(medoids, q)])
    found_q, found_n, found_s = [], [], []
    beam_n, beam_s = np.full((q, beam), -1, np.int64), np.full((q, beam), -np.inf)
    done = np.ones((q, beam), bool)
    while len(query):
        query, node, near = fresh(query, node)
        hit = near >= reach
        found_q.append(query[hit]), found_n.append(node[hit]), found_s.append(near[hit])
        # The best of what each query has had and has got.
        order = np.lexsort((-near, query))
        query, node, near = query[order], node[order], near[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        cut = place < beam
        more_n, more_s = np.full((q, beam), -1, np.int64), np.full((q, beam), -np.inf)
        more_n[query[cut], place[cut]], more_s[query[cut], place[cut]] = node[cut], near[cut]
        all_n, all_s = np.concatenate([beam_n, more_n], 1), np.concatenate([beam_s, more_s], 1)
        all_d = np.concatenate([done, more_n < 0], 1)
        top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        beam_n, beam_s, done = (np.take_along_axis(x, top, 1) for x in (all_n, all_s, all_d))
        nxt = np.where(done, np.inf, -beam_s).argmin(1)
        open_ = ~done[everyone, nxt]
        done[everyone, nxt] = True
        query, node = _neighbours(starts, ends, everyone[open_], beam_n[everyone, nxt][open_])
    query, node, near = (np.concatenate(x) for x in (found_q, found_n, found_s))
    pairs = [(query[near >= least], node[near >= least])]
    while len(query):
        query, node, near = fresh(*_neighbours(starts, ends, query, node))
        pairs.append((query[near >= least], node[near >= least]))
        query, node = query[near >= reach], node[near >= reach]
    return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


def _full(points: np.ndarray, some: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(points[some] @ points.T >= least)


def cell_links(vectors: np.ndarray, copies: np.ndarray, threshold: float = THRESHOLD, seed: int = 5, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, float]:
    """For each point the other rows of the cell it links with, its root in the cell, and the audited recall."""
    points = unit(vectors)
    rng = np.random.default_rng(seed)
    least = threshold - 1e-9
    if len(points) < 2:
        return copies - 1, np.arange(len(points)), 1.0

    def sweep(find) -> tuple[np.ndarray, np.ndarray]:
        """Links and roots of all points, block by block."""
        parent, links = np.arange(len(points)), copies - 1
        at, step = 0, 64
        while at < len(points):
            some = np.arange(at, min(len(points), at + step))
            query, node = find(some)
            query = some[query]
            other = query != node
            query, node = query[other], node[other]
            exact = (points[query] * points[node]).sum(1) >= threshold
            query, node = query[exact], node[exact]
            np.add.at(links, query, copies[node])
            unite(parent, query, node)
            at, step = at + len(some), 256 if len(query) < 500_000 else 64
        return links, parent

    def hits(found: tuple[np.ndarray, np.ndarray], some: np.ndarray) -> np.ndarray:
        out = np.zeros((len(some), len(points)), bool)
        out[found] = True
        out[np.arange(len(some)), some] = False
        return out

    recall = 0.0
    for degree, pool, beam in LADDER:
        graph = united(points, rng, shard, degree, pool)
        search = lambda some: range_search(points, *graph, some, least, beam)  # noqa: B023, E731
        links, parent = sweep(search)
        linked = np.flatnonzero(links >= copies)
        checked = np.unique(np.r_[rng.choice(len(points), min(AUDITED, len(points)), replace=False), rng.choice(linked, min(AUDITED, len(linked)), replace=False)])
        true, got = hits(_full(points, checked, least), checked), hits(search(checked), checked)
        recall = float((true & got).sum() / max(1, true.sum())) if true.any() else 1.0
        if recall >= AUDIT:
            return links, parent, recall
    return *sweep(lambda some: _full(points, some, least)), recall


def border_links(vectors: np.ndarray, copies: np.ndarray, lower: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """For each point the rows of the other side (`lower` or not) it links with, and its root; all pairs are compared."""
    points = unit(vectors)
    parent, links = np.arange(len(points)), np.zeros(len(points), np.int64)
    left, right = np.flatnonzero(lower), np.flatnonzero(~lower)
    for at in range(0, len(left) if len(right) else 0, 128):
        some = left[at : at + 128]
        near = points[some] @ points[right].T
        hit = near >= threshold
        a, b = np.nonzero(np.abs(near - threshold) <= 1e-9)
        hit[a, b] = (points[some[a]] * points[right[b]]).sum(1) >= threshold
        links[some] += hit @ copies[right]
        links[right] += copies[some] @ hit
        a, b = np.nonzero(hit)
        unite(parent, some[a], right[b])
    return links, parent


def visited(points: np.ndarray, own: int, centres: np.ndarray, threshold: float) -> np.ndarray:
    """Which cells (row by row) may hold links of points that lie in the cell `own`.

    A partner in another cell lies beyond the bisector of the two centres, so
    that no point farther from it than the range has one.
    """
    far = np.sqrt(((centres - centres[own]) ** 2).sum(1))
    to = (centres**2).sum(1) - 2 * points @ centres.T
    return to - to[:, own, None] <= 2 * far * (np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6) + 1e-9


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    fine = F.col("label").isNotNull() & usable(F.col("v"))
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    rows = rows.withColumn("key", F.when(fine, F.sha2(F.concat_ws(":", F.col("label").cast("string"), F.concat_ws(",", F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")))), 256)))
    rows = written(rows, "rows")
    own = rows.where(F.col("key").isNotNull())
    classes = written(own.groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v")).withColumn("node", F.xxhash64("key")), "classes")
    groups = classes.groupBy("label", F.size("v").alias("d")).agg(F.count("*").alias("classes"))
    large = {(r.label, r.d): r.classes for r in groups.where(F.col("classes") > cell).collect()}
    cells = classes.select("*", F.size("v").alias("d"))
    if large:
        rng = np.random.default_rng(11)
        share = min(1.0, SAMPLE / sum(large.values()))
        # The vectors under a share of all hashes, SAMPLE or so for all labels together, and 64 of each at least.
        limits = [(label, d, (1 << 63) - 1 if max(share, 64 / n) >= 1 else int(max(share, 64 / n) * 2.0**64) - (1 << 63)) for (label, d), n in large.items()]
        limits = spark.createDataFrame(limits, f"label {classes.schema['label'].dataType.simpleString()}, d int, most long")
        part = cells.join(F.broadcast(limits), ["label", "d"]).withColumn("o", F.xxhash64("node")).where("o <= most").orderBy("o").select("label", "d", "v").toArrow()
        labels, ds = part.column("label").to_pylist(), part.column("d").to_numpy()
        centres = {}
        for (label, d), n in large.items():
            own = unit(matrix(part.column("v").take(pa.array(np.flatnonzero([a == label and b == d for a, b in zip(labels, ds)])))))
            # No more centres than the sample can place; larger cells are cut at random.
            centres[label, d] = kmeans(own, max(1, min(-(-2 * n // cell), len(own) // 4)), 6, rng)
        known = spark.sparkContext.broadcast(centres)

        def assign(batches):
            for batch in batches:
                ds, labels = batch.column("d").to_numpy(), batch.column("label").to_pylist()
                first = np.zeros(len(ds), np.int32)
                for (label, d), own_centres in known.value.items():
                    here = np.flatnonzero([a == label and b == d for a, b in zip(labels, ds)])
                    if len(here):
                        points = unit(matrix(batch.column("v").take(pa.array(here))))
                        first[here] = ((own_centres**2).sum(1) - 2 * points @ own_centres.T).argmin(1)
                yield batch.append_column("cell", pa.array(first))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema)
        placed = written(cells.mapInArrow(assign, schema + ", cell int"), "cells")
        sizes = {(r.label, r.d, r.cell): r["count"] for r in placed.groupBy("label", "d", "cell").count().collect() if (r.label, r.d) in centres}
        #: Pieces of every cell, and where they start among those of their label.
        pieces = {k: np.array([-(-sizes.get((*k, c), 0) // cell) for c in range(len(own))]) for k, own in centres.items()}
        layout = spark.sparkContext.broadcast({k: (n, np.cumsum(n) - n) for k, n in pieces.items()})

        def deal(batches):
            for batch in batches:
                ds, labels, cell_of = batch.column("d").to_numpy(), batch.column("label").to_pylist(), batch.column("cell").to_numpy()
                node = batch.column("node").to_numpy()
                home, visits = np.zeros(len(ds), np.int32), [[]] * len(ds)
                for (label, d), own_centres in known.value.items():
                    count, start = layout.value[label, d]
                    of_label = np.array([a == label and b == d for a, b in zip(labels, ds)], bool)
                    for c in np.unique(cell_of[of_label]):
                        here = np.flatnonzero(of_label & (cell_of == c))
                        home[here] = start[c] + (node[here].view(np.uint64) >> np.uint64(20)) % np.uint64(count[c])
                        near = visited(unit(matrix(batch.column("v").take(pa.array(here)))), c, own_centres, threshold)
                        for row, cells_near in zip(here, np.repeat(near, count, axis=1)):
                            units = np.flatnonzero(cells_near)
                            visits[row] = units[units != home[row]].tolist()
                columns = [*(batch.column(k) for k in ("node", "n", "label", "d", "v")), pa.array(home), pa.array(visits, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "label", "d", "v", "cell", "visits"])

        kinds = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in ("node", "n", "label", "d", "v"))
        cells = written(placed.mapInArrow(deal, kinds + ", cell int, visits array<int>"), "dealt")
        meeting = cells.select("node", "n", "label", "d", "v", "cell", F.explode("visits").alias("other"))
        meeting = meeting.select("node", "n", "label", "d", "v", (F.col("cell") < F.col("other")).alias("lower"), F.least("cell", "other").alias("a"), F.greatest("cell", "other").alias("b"))
    else:
        cells = cells.select("node", "n", "label", "d", "v", F.lit(0).alias("cell"))

    def find(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node = table.column("node").to_numpy()
        links, root, _ = cell_links(matrix(table.column("v")), table.column("n").to_numpy(), threshold)
        return pa.table([pa.array(node), pa.array(node[root]), pa.array(links)], names=["node", "root", "links"])

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node = table.column("node").to_numpy()
        links, root = border_links(matrix(table.column("v")), table.column("n").to_numpy(), table.column("lower").to_numpy(), threshold)
        some = np.flatnonzero(links)
        return pa.table([pa.array(node[some]), pa.array(node[root[some]]), pa.array(links[some])], names=["node", "root", "links"])

    found = written(cells.select("node", "n", "label", "d", "v", "cell").groupBy("label", "d", "cell").applyInArrow(find, "node long, root long, links long"), "found")
    if large:
        across = written(meeting.groupBy("label", "d", "a", "b").applyInArrow(meet, "node long, root long, links long"), "across")
        found = found.unionByName(across)
    joined = components(found.where("node != root").select("node", "root"))
    named = classes.select("node", "key", "least", "n").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node").join(joined, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    labels = written(lookup(named.select("root", "key", "links", "n"), least, "root", "members").select("key", "links", "component_id", "n"), "labels")
    result = lookup(rows.select("vec_id", "key"), labels, "key", "n")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return result.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
