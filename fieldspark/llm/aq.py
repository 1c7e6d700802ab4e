"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one word from each of BOOKS full-dimensional codebooks,
learned on residuals; a beam of partial sums finds a good choice of words. The
index has a code and the norm of the reconstruction for every row. A search
adds up looked-up products of the query with the chosen words, keeps the best
SHORTLIST rows of each shard, and ranks these by the exact measure.

The codebooks are fitted on a bounded sample (SAMPLE rows with the smallest
hashes); every row is indexed. Rows and queries are both cut into blocks of
bounded size, and each task meets one block of rows with one block of queries.
Equal vectors are scored once; of them only as many as can be answers are listed.

Vectors that are null, zero, hold null or non-finite components, or differ in
length from most, take no part; neither do rows without an id. Rows that share
the query's id are its own. Ties go to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sampled, written
from .vectors import kmeans, main_size, matrix, usable

BOOKS = 32
WORDS = 256
BEAM = 4
SAMPLE = 8192
SHORTLIST = 400
ROWS = 32_768
QUERIES = 4_096


class Codebooks:
    """Full-dimensional codebooks and the beam search that encodes with them."""

    def __init__(self, sample: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 3):
        rng = np.random.default_rng(seed)
        rest = sample.astype(np.float32).copy()
        self.books = np.zeros((books, words, sample.shape[1]), np.float32)
        for m in range(books):
            self.books[m] = kmeans(rest, words, 10, rng) if len(rest) else 0
            if len(rest):
                near = ((self.books[m] ** 2).sum(1) - 2 * rest @ self.books[m].T).argmin(1)
                rest -= self.books[m][near]
        self.norms = (self.books**2).sum(2)

    def encode(self, vectors: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and squared norms of what they stand for."""
        codes = np.zeros((len(vectors), len(self.books)), np.uint8)
        norms = np.zeros(len(vectors), np.float32)
        for at in range(0, len(vectors), 1024):
            own = vectors[at : at + 1024].astype(np.float32)
            n = len(own)
            rest, cost = own[:, None, :], (own**2).sum(1)[:, None]
            chosen = np.zeros((n, 1, 0), np.uint8)
            for m, book in enumerate(self.books):
                grown = (cost[:, :, None] + self.norms[m] - 2 * (rest.reshape(-1, rest.shape[2]) @ book.T).reshape(n, rest.shape[1], -1)).reshape(n, -1)
                width = min(beam, grown.shape[1])
                best = np.argpartition(grown, width - 1, axis=1)[:, :width]
                parent, word = best // len(book), best % len(book)
                rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[word]
                cost = np.take_along_axis(grown, best, 1)
                chosen = np.concatenate([np.take_along_axis(chosen, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
            first = cost.argmin(1)
            codes[at : at + n] = chosen[np.arange(n), first]
            norms[at : at + n] = ((own - rest[np.arange(n), first]) ** 2).sum(1)
        return codes, norms

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of each query with every word."""
        return np.einsum("qd,mwd->mqw", queries.astype(np.float32), self.books, optimize=True)


def _exact(query: np.ndarray, rows: np.ndarray, measure: str) -> np.ndarray:
    """The measure in double precision; the same for the same two vectors wherever they stand."""
    if measure == "dot":
        return (rows * query).sum(-1)
    return -((rows - query) ** 2).sum(-1)


def search_block(books: Codebooks, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norms: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, shortlist: int = SHORTLIST, measure: str = "dot") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of each query's best k rows in one block."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    keys = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    _, first, member = np.unique(keys, return_index=True, return_inverse=True)
    by_class = np.argsort(member, kind="stable")  # the members of each class, smaller ids first
    starts = np.searchsorted(member[by_class], np.arange(len(first) + 1))
    points, codes, norms = vectors[first], codes[order][first], norms[order][first]
    out_q, out_v, out_s = [], [], []
    wanted = min(shortlist, len(first))
    for at in range(0, len(queries), 64):
        some = queries[at : at + 64]
        tables = books.tables(some)
        near = np.zeros((len(some), len(first)), np.float32)
        for m in range(codes.shape[1]):
            near += tables[m].take(codes[:, m], axis=1)
        if measure != "dot":
            near = 2 * near - norms
        best = np.argpartition(near, len(first) - wanted, axis=1)[:, len(first) - wanted :]
        for i, row in enumerate(best):
            score = _exact(some[i], points[row], measure)
            # One more than k of each class, for the query's own row.
            places = np.concatenate([by_class[starts[c] : min(starts[c + 1], starts[c] + k + 1)] for c in row]) if len(first) < len(ids) else by_class[starts[row]]
            scores = np.repeat(score, np.minimum(starts[row + 1] - starts[row], k + 1)) if len(first) < len(ids) else score
            other = ids[places] != query_ids[at + i]
            found, scores = ids[places][other], scores[other]
            top = np.lexsort((found, -scores))[:k]
            out_q.append(np.full(len(top), query_ids[at + i])), out_v.append(found[top]), out_s.append(scores[top])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def index(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, v, code, norm) of every row of (vec_id, v)."""
    model = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                codes, norms = model.value.encode(matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float64))], names=["vec_id", "v", "code", "norm"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, code binary, norm double")


def nearest(vectors: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding", measure: str = "dot", rows_block: int = ROWS, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest, nearest first."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_column).isNotNull() & usable(F.col(vector_column))).select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"), is_query.alias("query"))
    size = main_size(rows, "v")
    rows = rows.where(F.size("v") == (size or 0))
    sample = sampled(rows.select("v", F.xxhash64("vec_id", "v").alias("o")), SAMPLE, vectors.count(), "o", "v").orderBy("o", "v").select("v").toArrow()
    books = Codebooks(matrix(sample.column("v")) if sample.num_rows else np.zeros((0, 1)))
    stored = written(index(rows, books), "codes")
    queries = written(rows.where("query").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "queries")
    shards = max(1, -(-stored.count() // rows_block))
    blocks = max(1, -(-queries.count() // query_block))

    def every(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    left = stored.select("*", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), every(blocks, "block"))
    right = queries.select("*", F.pmod(F.xxhash64("query_id", "q"), F.lit(blocks)).cast("int").alias("block"), every(shards, "shard"))
    model = spark.sparkContext.broadcast(books)

    def meet(own: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not own.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        codes = np.frombuffer(b"".join(own.column("code").to_pylist()), np.uint8).reshape(own.num_rows, -1)
        found = search_block(model.value, own.column("vec_id").to_numpy(), matrix(own.column("v")), codes, own.column("norm").to_numpy(), asked.column("query_id").to_numpy(), matrix(asked.column("q")), k, measure=measure)
        return pa.table([pa.array(x) for x in found], names=names)

    near = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, "query_id long, vec_id long, score double")
    # A query row that stands twice finds each of its neighbours twice, with the same score.
    near = near.distinct() if not _unique(queries) else near
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unique(queries: DataFrame) -> bool:
    return queries.groupBy("query_id").count().where("count > 1").isEmpty()
