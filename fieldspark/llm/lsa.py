"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of hashed words, of runs of byte shapes and of words said
again shortly after, weighted by log(1 + tf) and idf, and is projected on the singular vectors of a labelled
sample. The sample's vectors are broadcast; every document's cosine with each
of them is computed exactly, block by block, and the nearest NEIGHBOURS vote
with their labels, weighted by a power of their similarity.

The labelled sample is bounded: SAMPLE rows at most, those with the smallest
hashes of id and text, of up to SAMPLE_BYTES bytes each. With TERMS terms it is
the only thing that is sent to the driver. Every whole text is scored; of
equally near labelled texts, those that come first in the sample vote. The arrays
of a block take some 40 bytes for each byte of its texts, so a text far longer
than a block needs as much.

Nulls: a null text is an empty one, which has no terms and gets the sample's
base rate, as does every text when there are no labels (then 0.5). Rows whose
label or id is null teach nothing; an id with several labels teaches each of
them. Extra columns are ignored; repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_blocks, map_blocks

WORDS = 1536
SHAPES = 512
#: A term for each distance back, up to this, at which a word repeats.
REPEATS = 6
TERMS = WORDS + SHAPES + REPEATS
SAMPLE = 3000
SAMPLE_BYTES = 65_536
RANK = 48
NEIGHBOURS = 15
#: Steps to which a cosine is rounded, as its last bits depend on what it is computed with.
STEPS = 1 << 16
#: Votes count as the similarity to this power.
SHARPNESS = 6
#: Weight of the base rate beside the votes.
PRIOR = 1e-3

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Classes of bytes by shape: space, line end, lower, upper, digit, beyond ASCII, and each sign.
_SHAPE = np.zeros(256, np.uint32)
_SHAPE[10] = 1
for _k in range(33, 127):
    _SHAPE[_k] = 2 if chr(_k).islower() else 3 if chr(_k).isupper() else 4 if chr(_k).isdigit() else 6 + _k
_SHAPE[128:] = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multipliers of the polynomial word hash, by place in the word.
_POWERS = np.cumprod(np.full(64, 0x9E3779B1, np.uint32), dtype=np.uint32)


def _mix(keys: np.ndarray, size: int) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    keys ^= keys >> np.uint32(12)
    return (keys * np.uint32(0x297A2D39) >> np.uint32(8)) % np.uint32(size)


def term_counts(texts: list[bytes]) -> np.ndarray:
    """A row of TERMS counts for each text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    if not len(texts):
        return out
    data = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends, prepend=0))
    space = _SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    first = np.flatnonzero(start)
    if not len(first):
        return out
    number = np.cumsum(start, dtype=np.int32) - 1
    place = np.arange(len(data), dtype=np.int32) - first.astype(np.int32)[np.maximum(number, 0)]
    mixed = (_LOWER[data] + np.uint32(1)) * _POWERS[place & 63]
    mixed[space] = 0
    words = np.add.reduceat(mixed, first, dtype=np.uint32)
    flat = owner[first].astype(np.int64) * TERMS + _mix(words, WORDS)
    shape = _SHAPE[data]
    runs = (shape[:-2] * np.uint32(257) + shape[1:-1]) * np.uint32(257) + shape[2:]
    inside = owner[:-2] == owner[2:]
    more = owner[:-2][inside].astype(np.int64) * TERMS + WORDS + _mix(runs[inside], SHAPES)
    counts = np.bincount(flat, minlength=out.size) + np.bincount(more, minlength=out.size)
    out = counts.reshape(out.shape).astype(np.float32)
    speaker = owner[first]
    for back in range(1, REPEATS + 1):
        again = (words[back:] == words[:-back]) & (speaker[back:] == speaker[:-back])
        out[:, WORDS + SHAPES + back - 1] = np.bincount(speaker[back:][again], minlength=len(out))
    return out


class Voters:
    """idf, the projection, and the unit vectors and labels of the sample."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int = RANK, seed: int = 7):
        self.labels = labels.astype(np.float32)
        self.base = float(labels.mean()) if len(labels) else 0.5
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
        weighted = self.weigh(counts)
        rank = min(rank, *weighted.shape) if len(counts) else 0
        if rank:
            rng = np.random.default_rng(seed)
            basis = np.linalg.qr(weighted.T @ (weighted @ rng.standard_normal((weighted.shape[1], rank + 16)).astype(np.float32)))[0]
            for _ in range(4):
                basis = np.linalg.qr(weighted.T @ (weighted @ basis))[0]
            _, _, turn = np.linalg.svd(weighted @ basis, full_matrices=False)
            self.axes = np.ascontiguousarray((basis @ turn.T)[:, :rank]).astype(np.float32)
        else:
            self.axes = np.zeros((TERMS, 1), np.float32)
        self.vectors = self.unit(weighted @ self.axes)

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        return np.log1p(counts) * self.idf

    @staticmethod
    def unit(vectors: np.ndarray) -> np.ndarray:
        length = np.sqrt((vectors**2).sum(1, keepdims=True))
        return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)

    def scores(self, texts: list[bytes], rows: int = 256) -> np.ndarray:
        out = np.full(len(texts), self.base)
        if not len(self.vectors):
            return out
        for at in range(0, len(texts), rows):
            own = self.unit(self.weigh(term_counts(texts[at : at + rows])) @ self.axes)
            # Whole steps of the cosine, then the place in the sample: equal ones are told apart alike in any batch.
            steps = np.rint((own @ self.vectors.T) * np.float32(STEPS)).astype(np.int64)
            key = steps * self.vectors.shape[0] - np.arange(self.vectors.shape[0])
            k = min(NEIGHBOURS, key.shape[1])
            top = np.argpartition(key, key.shape[1] - k, axis=1)[:, key.shape[1] - k :]
            top.sort(axis=1)
            weight = np.maximum(np.take_along_axis(steps, top, 1) / STEPS, 0) ** SHARPNESS
            out[at : at + rows] = ((weight * self.labels[top]).sum(1) + PRIOR * self.base) / (weight.sum(1) + PRIOR)
        return np.clip(out, 0.0, 1.0)


def learn(docs: DataFrame, labels: DataFrame, usable: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Voters:
    """Voters from the bounded sample of labelled rows where `usable` (on the id) holds."""
    marked = labels.where(usable & F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
    # Twice as many ids as are needed, for those without a text; their number is bounded.
    picked = marked.select(F.col(id_column).alias("_id"), F.col(label_column).cast("double").alias("_label")).orderBy(F.xxhash64("_id"), "_id", "_label").limit(2 * SAMPLE)
    text = F.col(text_column)
    short = docs.where(text.isNotNull() & (F.octet_length(text) <= SAMPLE_BYTES)).select(F.col(id_column).alias("_id"), text.alias("_text"))
    chosen = short.join(F.broadcast(picked), "_id").select("_label", "_text", F.xxhash64("_id", "_text").alias("_o")).orderBy("_o", "_label").limit(SAMPLE)

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                counts = np.minimum(term_counts(part.column(1).cast(pa.binary()).to_pylist()), 65535).astype("<u2")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in counts], pa.binary())], names=["label", "counts"])

    table = chosen.select("_label", "_text").mapInArrow(count, "label double, counts binary").toArrow()
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u2").reshape(-1, TERMS).astype(np.float32)
    return Voters(counts, table.column("label").to_numpy())


def score(docs: DataFrame, voters: Voters, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, score): the weighted vote for each whole text."""
    model = docs.sparkSession.sparkContext.broadcast(voters)
    schema = ", ".join([f"doc_id {docs.schema[id_column].dataType.simpleString()}", *(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "score double"])

    def block(batch: pa.RecordBatch) -> list:
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        return [batch.column(0), *(batch.column(2 + k) for k in range(len(keep))), model.value.scores(texts)]

    return map_blocks(docs.select(id_column, text_column, *keep), 1, schema, block)


def accepted(docs: DataFrame, voters: Voters, least: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows of docs whose whole texts score `least` or more, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(voters)
    return filter_blocks(docs, text_column, lambda texts: model.value.scores([t or b"" for t in texts]) >= least)
