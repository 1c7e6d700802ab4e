"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts with the counts of what followed
them. A byte's code length is that of its count under the longest known
context; where it never followed that context, an escape (as likely as the
context had different followers) leads to the next shorter one, at last to
all bytes alike. The statistics are frozen, so a code length depends on the
last ORDER + 1 bytes alone: the trees of all languages are merged into tables
that give every language's code length for a byte string at once, and a text's
code length is a sum of table entries.

The trees are learned from a bounded sample: SAMPLE_DOCS documents of each of
the LANGUAGES most frequent languages at most, those with the smallest hashes
among documents of up to SAMPLE_BYTES bytes. Every whole text is scored; a text
longer than a block is a block of its own, cut where its tables are looked up.

A null text or one without letters gets `und` and score 0; so does every text
when no row has a language to learn from. Equal code lengths go to the
language that sorts first. Repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import filter_blocks, map_blocks

ORDER = 4
SAMPLE_DOCS = 400
#: Languages that are learned, at most: the most frequent ones.
LANGUAGES = 200
SAMPLE_BYTES = 16_384
#: What stands before a text, so that its first bytes have contexts, too.
START = b"\n" * ORDER
#: Bytes whose code lengths are held at once.
PIECE = 1 << 20
LETTER = re.compile(r"[^\W\d_]")
#: A text is in no learned language if its best code length is over so many times what that language's texts take, and so many bits.
FOREIGN_TIMES, FOREIGN_BITS = 2.0, 512.0
#: Bits by which a doubling of the odds is softened in the score.
SOFT_BITS = 8.0
#: Texts of a language by which its own code lengths are measured.
TYPICAL = 50


def fold(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


class ContextTrees:
    """Code-length tables of all languages, by levels of a common tree of byte strings.

    `maps[n]` leads from a string of n bytes and the next symbol to the string
    of n + 1 bytes; one past the last string stands for an unknown one.
    `costs[n]` has a row per string of n + 1 bytes, `escapes[n]` of n.
    """

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        joined = [b"".join(START + t for t in samples[k]) for k in self.languages]
        used = np.unique(np.frombuffer(b"".join(joined) or START, np.uint8))
        self.symbols = np.full(256, len(used), np.int32)
        self.symbols[used] = np.arange(len(used))
        self.width = len(used) + 1
        codes = [self.symbols[np.frombuffer(x, np.uint8)].astype(np.int64) for x in joined]
        lengths = [[len(t) for t in samples[k]] for k in self.languages]
        real = [np.concatenate([np.r_[np.zeros(len(START), bool), np.ones(n, bool)] for n in own] or [np.zeros(0, bool)]) for own in lengths]
        many = len(self.languages)
        self.maps, self.costs, self.escapes = [], [], []
        at = [np.zeros(len(c), np.int64) for c in codes]  # the string that ends before each byte
        nodes, shorter, suffix_of = 1, np.full((1, many), 8.0), np.zeros(1, np.int64)
        for n in range(ORDER + 1):
            keys = [a * self.width + c for a, c in zip(at, codes)]
            found = np.unique(np.concatenate(keys)) if many else np.zeros(0, np.int64)
            unknown = len(found)
            table = np.full((nodes + 1) * self.width, unknown, np.int32)
            table[found] = np.arange(unknown)
            counts = np.stack([np.bincount(table[k[r]], minlength=unknown) for k, r in zip(keys, real)], 1) if many else np.zeros((0, 0))
            context = found // self.width
            total, kinds = np.zeros((nodes, many)), np.zeros((nodes, many))
            np.add.at(total, context, counts)
            np.add.at(kinds, context, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
                own = np.log2((total + kinds)[context] / counts)
            below = self.maps[-1][suffix_of[context] * self.width + found % self.width] if n else np.zeros(unknown, np.int64)
            cost = np.where(counts > 0, own, shorter[below] + escape[context])
            self.maps.append(table)
            self.escapes.append(escape.astype(np.float32))
            self.costs.append(cost.astype(np.float32))
            suffix_of, shorter, nodes = below, cost, unknown
            at = [np.r_[np.zeros(1, np.int64), table[k[:-1]]] if len(k) else k for k in keys]
        #: Bits a byte that some of each language's texts take.
        self.typical = np.zeros(many)
        for i, k in enumerate(self.languages):
            texts = [t for t in samples[k][:TYPICAL] if t]
            self.typical[i] = self.code_lengths(texts)[:, i].sum() / max(1, sum(map(len, texts)))

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Every language's code length of every byte of `data`, each with its ORDER bytes before it."""
        codes = self.symbols[data]
        known = [np.zeros(len(codes), np.int32)]  # by length, the string that ends at each byte
        for n, table in enumerate(self.maps):
            keys = np.empty_like(codes)
            keys[0], keys[1:] = (len(self.escapes[n]) if n else 0), known[-1][:-1]
            keys *= np.int32(self.width)
            keys += codes
            known.append(table.take(keys))
        ids = known[-1]
        out = self.costs[-1].take(ids, axis=0, mode="clip")
        rest = np.flatnonzero(ids == len(self.costs[-1]))
        out[rest] = 0
        for n in range(len(self.maps) - 1, -1, -1):
            if n < len(self.maps) - 1:
                ids = known[n + 1][rest]
                hit = ids < len(self.costs[n])
                out[rest[hit]] += self.costs[n][ids[hit]]
                rest = rest[~hit]
            context = known[n][np.maximum(rest - 1, 0)] if n else np.zeros(len(rest), np.int32)
            seen = context < len(self.escapes[n])
            out[rest[seen]] += self.escapes[n][context[seen]]
        out[rest] += 8.0
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text under each language."""
        data = np.frombuffer(b"".join(START + t for t in texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + len(START))
        total = np.zeros((len(texts), len(self.languages)))
        if not len(texts) or not len(self.languages):
            return total
        full = np.flatnonzero(sizes)
        # The start bytes of a text cost nothing: a cut after them begins each sum.
        cuts = np.stack([ends[full] - sizes[full], ends[full]], 1).ravel()
        for at in range(0, len(data), PIECE):
            # A code length depends on ORDER bytes before a byte, so pieces overlap by them.
            first, last = max(0, at - ORDER), min(len(data), at + PIECE)
            bits = self.bits(data[first:last])[at - first :]
            inner = np.clip(cuts, at, last) - at
            here = np.flatnonzero(inner[1::2] > inner[::2])
            pair = np.stack([inner[2 * here], inner[2 * here + 1]], 1).ravel()
            if len(here):
                total[full[here]] += np.add.reduceat(np.concatenate([bits, np.zeros((1, bits.shape[1]), np.float32)]), pair, axis=0, dtype=np.float64)[::2]
        return total


def learn(docs: DataFrame, usable: Column, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id") -> ContextTrees:
    """Trees from the bounded sample of the rows where `usable` holds.

    Only texts whose hash lies under their language's share are read together:
    about 2 * SAMPLE_DOCS of each language, for any number of rows and tasks.
    """
    spark = docs.sparkSession
    text, lang = F.col(text_column), F.col(lang_column)
    known = docs.where(usable & lang.isNotNull())
    most = known.groupBy(lang.alias("l")).count().orderBy(F.desc("count"), "l").limit(LANGUAGES).collect()
    shares = {r.l: 2 * SAMPLE_DOCS / r["count"] for r in most}
    pool = known.where((F.octet_length(text) > 0) & (F.octet_length(text) <= SAMPLE_BYTES)).select(lang.alias("l"), text.alias("t"), F.xxhash64(F.col(id_column), text).alias("o"))
    first = Window.partitionBy("l").orderBy("o", "t")
    samples: dict[str, list[bytes]] = {}
    while shares:
        limits = spark.createDataFrame([(k, (1 << 63) - 1 if v >= 1 else int(v * 2.0**64) - (1 << 63)) for k, v in shares.items()], "l string, most long")
        some = pool.join(F.broadcast(limits), "l").where(F.col("o") <= F.col("most")).drop("most")
        found: dict[str, list[bytes]] = {}
        for row in some.withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_DOCS).orderBy("l", "n").select("l", "t").toLocalIterator():
            found.setdefault(row.l, []).append(fold(row.t))
        done = [k for k, v in shares.items() if v >= 1 or len(found.get(k, ())) >= SAMPLE_DOCS]
        samples |= {k: found[k] for k in done if k in found}
        shares = {k: 4 * v for k, v in shares.items() if k not in done}
    return ContextTrees(samples)


def judge(trees: ContextTrees, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits a byte of each text."""
    lettered = np.array([bool(t) and LETTER.search(t) is not None for t in texts], bool)
    names, scores, rate = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    if trees.languages and lettered.any():
        rows = np.flatnonzero(lettered)
        data = [fold(texts[i]) for i in rows]
        bits = trees.code_lengths(data)
        rate[rows] = bits.min(1) / [len(d) for d in data]
        best = bits.argmin(1)
        odds = np.exp2((bits.min(1, keepdims=True) - bits) / SOFT_BITS)
        scores[rows] = 1.0 / odds.sum(1)
        for i, k in zip(rows, best):
            names[i] = trees.languages[k]
    return names, scores, rate


def predict(docs: DataFrame, trees: ContextTrees, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(trees)
    kind = docs.schema[id_column].dataType.simpleString()

    def block(batch: pa.RecordBatch) -> list:
        return [batch.column(0), *judge(model.value, batch.column(1).to_pylist())[:2]]

    return map_blocks(docs.select(id_column, text_column), 1, f"doc_id {kind}, lang_pred string, score double", block)


def accepted(docs: DataFrame, trees: ContextTrees, text_column: str = "text", languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of docs in one of `languages` (all learned ones, if None), with all their columns.

    Texts without letters go, and texts that even the best language needs more
    than FOREIGN_TIMES its own texts' bits a byte for, and FOREIGN_BITS besides:
    so a few foreign bytes, as of a key or an address, don't condemn a text, and
    a short one needs to be far off. Without anything to learn from, all go.
    """
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def keep(texts: list) -> list[bool]:
        own = model.value
        names, _, rate = judge(own, [t.decode() if t else None for t in texts])
        most = {k: FOREIGN_TIMES * own.typical[i] for i, k in enumerate(own.languages) if languages is None or k in languages}
        return [name in most and r * len(t) <= most[name] * len(t) + FOREIGN_BITS for name, r, t in zip(names, rate, (t or b"" for t in texts))]

    return filter_blocks(docs, text_column, keep)
