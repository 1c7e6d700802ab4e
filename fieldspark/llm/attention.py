"""Language-model scores from causal self-attention over subword ids.

A text is its A-Z-lowered words and one end. Each word is a few subword ids of
a public byte-level vocabulary. A small causal self-attention model, trained
here with Adam in numpy, reads the ids before a position and gives the class
of the next id; within its class the id has the probability that counts over
all training documents give it after the id before it in its word. Texts longer
than a window are read in overlapping windows, each id being scored once, with
the context that the overlap leaves; windows of many texts run as one batch
under a causal mask.

Word counts over all training documents are gathered in Spark. The most frequent
words, HEAVY at most, and pairs of ids, PAIRS at most, are broadcast. Words are
also a second expert: a word's probability is a mixture, fitted by EM on all
training words, of what
the ids give and of its smoothed share of the corpus. The exact counts of the
other words, and of the pairs of ids that are not broadcast, come by joins on
the word and on the pair, which none can skew; both scores have the counts of all.

Every id has a vector of its own. Classes and first vectors follow from the
counts of all training documents: which ids stand before and after an id in its
words. First weights are fitted on SAMPLE documents (those with the smallest
hashes, of up to SAMPLE_BYTES bytes). Then all training documents, dealt by a hash
into groups of about GROUP, train the weights further apart from each other, and
their weights are averaged, so the model has seen the whole corpus and doesn't
depend on how the rows are partitioned.

A null text is an empty one: only its end. With no training documents all
counts are zero. Repeated rows are scored each; extra columns are ignored. A
text longer than a block is scored as a block of its own, in batches of windows.
"""

from __future__ import annotations

import base64
import copy
import itertools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_blocks, sampled, slices, written
from .vectors import kmeans

HEAVY = 150_000
PAIRS = 400_000
SAMPLE = 300
SAMPLE_BYTES = 32_768
CLASSES = 64
WIDTH = 24
WINDOW = 32
STRIDE = 26
STEPS = 500
BATCH = 64
#: Weights are trained further on one of so many training documents (1: all), in groups of so many, at this rate, and so many weights are averaged at once.
SHARE, GROUP, RATE, FAN_IN = 1, 200, 0.002, 16
#: Neighbours by which ids are told apart, on either side.
CONTEXTS = 128
#: Weight of the class's own distribution beside the counts after an id.
BACKOFF = 8.0
END = b""
KNOWN_WORDS = 300_000


class Subwords:
    """Ids of single words, each with a space before it; the free id is the end."""

    def __init__(self, rank_path: str, pattern: str):
        import tiktoken

        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)
        self.size = self.end + 1
        self.opens = np.zeros(self.size, bool)
        self.opens[[i for token, i in ranks.items() if token[:1] == b" "]] = True

    def ids(self, word: bytes) -> list[int]:
        return self.encoding.encode_ordinary(" " + word.decode("utf-8", "replace")) if word else [self.end]


    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has.

        Words hold no space, so in their joined text the ids that begin with one
        are the words' first.
        """
        real = np.array([bool(w) for w in words], bool)
        ids = np.array(self.encoding.encode_ordinary("".join(" " + w.decode("utf-8", "replace") for w in words if w)), np.int32)
        first = np.flatnonzero(self.opens[ids])
        if len(first) != real.sum():
            raise ValueError("a word's ids can't be told apart")
        size = np.ones(len(words), np.int64)
        size[real] = np.diff(first, append=len(ids))
        out = np.full(int(size.sum()), self.end, np.int32)
        out[np.repeat(real, size)] = ids
        return out, size


_subwords: dict = {}


def subwords(rank_path: str, pattern: str) -> Subwords:
    if (rank_path, pattern) not in _subwords:
        _subwords[rank_path, pattern] = Subwords(rank_path, pattern)
    return _subwords[rank_path, pattern]


def words_of(text: bytes | None) -> list[bytes]:
    """Lowered words and the end."""
    return [*(text or b"").lower().split(), END]


def block_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of all texts, the end last; which of them stands where, and how many each text has."""
    texts = (texts.view(pa.string()) if pa.types.is_binary(texts.type) else texts).fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    # Space at a text's ends leaves empty words.
    real = pc.greater(pc.binary_length(words), 0)
    before = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))]
    ends = before[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()]
    found = words.filter(real).dictionary_encode()
    distinct = pa.concat_arrays([found.dictionary.view(pa.binary()), pa.array([END], pa.binary())])
    return distinct, np.insert(found.indices.to_numpy(), ends, len(distinct) - 1), np.diff(ends, prepend=0) + 1


def word_counts(docs: DataFrame, text_column: str = "text", held: int = 400_000) -> DataFrame:
    """(word, n): occurrences in all texts, summed in each task before the shuffle."""

    def run(batches):
        parts, rows = [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            for part in slices(batch, 0):
                words, place, _ = block_words(part.column(0))
                parts.append(pa.table({"word": words, "n": np.bincount(place, minlength=len(words))}))
                rows += len(words)
                if rows > 2 * held:
                    parts = [summed()]
                    rows = parts[0].num_rows
                if rows > held and len(parts) == 1:
                    yield from parts[0].to_batches()
                    parts, rows = [], 0
            pa.default_memory_pool().release_unused()
        if parts:
            yield from summed().to_batches()

    return docs.select(text_column).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def before_in_word(ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The id before each id in its word, -1 at a word's start."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[np.cumsum(size) - size] = -1
    return out


def transitions(counts: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(before, id, n): ids after ids within all words; before is -1 at a word's start."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, size = subwords(rank_path, pattern).many(batch.column(0).to_pylist())
            keys, place = np.unique((before_in_word(ids, size).astype(np.int64) + 1) << 20 | ids, return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, place, np.repeat(batch.column(1).to_numpy(), size))
            yield pa.RecordBatch.from_arrays([pa.array(((keys >> 20) - 1).astype(np.int32)), pa.array((keys & 0xFFFFF).astype(np.int32)), pa.array(n)], names=["before", "id", "n"])

    return counts.select("word", "n").mapInArrow(run, "before int, id int, n long").groupBy("before", "id").agg(F.sum("n").alias("n"))


def powers(scores: np.ndarray, most: float = 60) -> float:
    """Takes scores to their powers of e in place; greater ones than `most`, which it returns, count as that."""
    if scores.size and scores.max() > most:
        np.minimum(scores, most, out=scores)
    np.exp(scores, out=scores)
    return most


class Attention:
    """One block of single-head causal attention with a residual, and class scores."""

    NAMES = ("embed", "place", "query", "key", "value", "out", "score", "bias")

    def __init__(self, embed: np.ndarray, classes: int, rng: np.random.Generator, window: int = WINDOW):
        d = embed.shape[1]
        draw = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
        self.embed = embed.astype(np.float32)
        self.place = (0.05 * rng.standard_normal((window, d))).astype(np.float32)
        self.query, self.key, self.value, self.out = draw(d, d), draw(d, d), draw(d, d), draw(d, d)
        self.score, self.bias = draw(d, classes), np.zeros(classes, np.float32)
        self.seen = np.tril(np.ones((window, window), np.float32))
        self.settle()

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        """What turns a vector into its query for vectors as they are, and what mixed vectors as they are add to one: fewer products than by keys and values."""
        return (self.query @ self.key.T) * np.float32(1 / math.sqrt(self.query.shape[0])), self.value @ self.out

    def settle(self) -> None:
        """Prepares what scoring uses: one product of a vector, what was mixed for it, and 1 gives the scores."""
        self.near, far = self.folded()
        self.head = np.concatenate([self.score, far @ self.score, self.bias[None]])

    def vectors(self, x: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of all positions, and of those from `skip` on in each window, one after another."""
        h = self.embed.take(x, axis=0)
        h += self.place
        return h, h[:, skip:].reshape(-1, h.shape[2])

    def attended(self, h: np.ndarray, queries: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Each position's weights of those up to it, and their sums."""
        a = queries.reshape(len(h), -1, h.shape[2]) @ h.transpose(0, 2, 1)
        powers(a)
        a *= self.seen[skip:]
        return a, a.reshape(-1, a.shape[2]) @ np.ones(a.shape[2], np.float32)

    def log_probs(self, x: np.ndarray, target: np.ndarray, skip: int = 0) -> np.ndarray:
        """Natural log probability of the target class of each position from `skip` on in each window."""
        d = self.query.shape[0]
        h, own = self.vectors(x, skip)
        a, total = self.attended(h, own @ self.near, skip)
        both = np.ones((len(own), 2 * d + 1), np.float32)
        both[:, :d] = own
        np.divide((a @ h).reshape(-1, d), total[:, None], out=both[:, d : 2 * d])
        scores = both @ self.head
        own = scores[np.arange(len(scores)), target.ravel()]
        most = powers(scores)
        return (np.minimum(own, most) - np.log(scores @ np.ones(scores.shape[1], np.float32))).reshape(target.shape)

    def gradients(self, x: np.ndarray, target: np.ndarray, real: np.ndarray) -> tuple[float, dict]:
        """Mean loss over the real positions and its gradients."""
        logs, g = self.passes(x, target, real)
        return float(-logs[real].mean()), g

    def passes(self, x: np.ndarray, target: np.ndarray, real: np.ndarray, vectors: bool = True, skip: int = 0, count: int = 0) -> tuple[np.ndarray, dict]:
        """Natural log probability of the class of each position from `skip` on, and the gradients of the mean loss over the real ones, or of their part in the mean of `count`.

        Those of the vectors, if wanted, come as (rows, values).
        """
        d, width = self.query.shape[0], x.shape[1]
        near, far = self.folded()
        h, own = self.vectors(x, skip)
        q = own @ near
        a, total = self.attended(h, q, skip)
        flat = a.reshape(-1, width)
        flat *= (1 / total)[:, None]
        mixed = (a @ h).reshape(-1, d)
        top = np.ones((len(own), d + 1), np.float32)
        np.add(own, mixed @ far, out=top[:, :d])
        p = top @ np.concatenate([self.score, self.bias[None]])
        rows, wanted, weight = np.arange(len(p)), target.ravel(), real.ravel().astype(np.float32) / np.float32(max(1, count or real.sum()))
        mine = p[rows, wanted]
        mine = np.minimum(mine, powers(p))
        total = p @ np.ones(p.shape[1], np.float32)
        p *= (weight / total)[:, None]
        p[rows, wanted] -= weight
        g_top = top.T @ p
        g = {"score": g_top[:d], "bias": g_top[d]}
        d_top = p @ self.score.T
        d_mixed, g_far = d_top @ far.T, mixed.T @ d_top
        d_s = d_mixed.reshape(len(x), -1, d) @ h.transpose(0, 2, 1)
        # A row of weights times its gradients sums up to what it mixes times the gradients of that.
        d_s -= np.einsum("ij,ij->i", d_mixed, mixed).reshape(len(x), -1, 1)
        d_s *= a
        d_q = (d_s @ h).reshape(-1, d)
        g_near = (own.T @ d_q) * np.float32(1 / math.sqrt(d))
        g["query"], g["key"], g["value"], g["out"] = g_near @ self.key, g_near.T @ self.query, g_far @ self.out.T, self.value.T @ g_far
        if vectors:
            d_h = d_s.transpose(0, 2, 1) @ q.reshape(len(x), -1, d) + a.transpose(0, 2, 1) @ d_mixed.reshape(len(x), -1, d)
            d_h[:, skip:] += (d_top + d_q @ near.T).reshape(len(x), -1, d)
            g["place"] = d_h.sum(0)
            rows, at = np.unique(x.ravel(), return_inverse=True)
            sums = np.zeros((len(rows), d), np.float32)
            np.add.at(sums, at, d_h.reshape(-1, d))
            g["embed"] = rows, sums
        else:
            # Only sums over the windows are needed: single products instead of one for each window.
            g["place"] = d_s.reshape(-1, width).T @ q + flat.T @ d_mixed
            g["place"][skip:] += d_top.reshape(len(x), -1, d).sum(0) + d_q.reshape(len(x), -1, d).sum(0) @ near.T
        return (mine - np.log(total)).reshape(target.shape), g

    def train(self, x: np.ndarray, target: np.ndarray, real: np.ndarray, rng: np.random.Generator, steps: int = STEPS, batch: int = BATCH, rate: float = 0.01) -> list[float]:
        """Adam with a falling rate; returns the losses."""
        adam, losses = Adam(self), []
        for step in range(steps):
            some = rng.integers(0, len(x), batch)
            logs = adam.step([(0, x[some], target[some], real[some])], rate * (1 - step / steps))
            losses.append(float(-logs[0][real[some]].mean()))
        self.settle()
        return losses

    def pack(self) -> bytes:
        """All weights but the vectors."""
        return b"".join(getattr(self, n).tobytes() for n in self.NAMES[1:])

    def unpack(self, data: np.ndarray) -> None:
        at = 0
        for n in self.NAMES[1:]:
            own = getattr(self, n)
            own[...] = data[at : at + own.size].reshape(own.shape)
            at += own.size
        self.settle()


class Adam:
    """The optimizer's moments for one model; vectors only move when they are met."""

    def __init__(self, net: Attention, names: tuple[str, ...] = Attention.NAMES):
        self.net, self.names, self.steps = net, names, 0
        # All weights but the vectors become parts of one array, so that a step is one update of it.
        self.rest, at = np.frombuffer(bytearray(net.pack()), np.float32), 0
        for n in net.NAMES[1:]:
            own = getattr(net, n)
            setattr(net, n, self.rest[at : at + own.size].reshape(own.shape))
            at += own.size
        values = {"rest": self.rest} | ({"embed": net.embed} if "embed" in names else {})
        self.first, self.second = ({n: np.zeros_like(v) for n, v in values.items()} for _ in range(2))

    def step(self, parts: list[tuple], rate: float) -> list[np.ndarray]:
        """Log probabilities of the classes before the step, by parts of (skip, symbols, target classes, which are real); vectors only move by a single part."""
        count = sum(int(real.sum()) for *_, real in parts)
        logs, found = zip(*(self.net.passes(x, target, real, "embed" in self.names, skip, count) for skip, x, target, real in parts))
        g = found[0] if len(found) == 1 else {n: sum(own[n] for own in found) for n in self.net.NAMES[1:]}
        self.steps += 1
        for n in self.first:
            values, at, own = (self.net.embed, *g[n]) if n == "embed" else (self.rest, slice(None), np.concatenate([g[k].ravel() for k in self.net.NAMES[1:]]))
            first, second = 0.9 * self.first[n][at] + 0.1 * own, 0.99 * self.second[n][at] + 0.01 * own**2
            self.first[n][at], self.second[n][at] = first, second
            values[at] -= rate * (first / (1 - 0.9**self.steps)) / (np.sqrt(second / (1 - 0.99**self.steps)) + 1e-8)
        return logs


def trained_further(table: WordTable, parts, rate: float) -> tuple | None:
    """Windows seen, the weights after one pass over some texts, and what the mixture's weight needs of them.

    That is a histogram of the heavy words' odds (see `odds_place`), and the
    other words with what their ids give. Each word's share of it was predicted
    before the weights met the word.
    """
    model, net = table.model, copy.copy(table.model.net)
    adam, seen, odds, rare = Adam(net, net.NAMES[1:]), 0, np.zeros(ODDS_BINS, np.int64), []
    for texts in parts:
        rows, sizes = table.rows(texts)
        ids, starts, lengths = table.ids_of(rows, sizes)
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[np.cumsum(lengths) - lengths] = model.end
        logs = np.zeros(len(ids), np.float32)
        for step in model.window_parts(before, ids, lengths, mixed=True):
            for (*_, real, place), got in zip(step, adam.step([own[:-1] for own in step], rate)):
                logs[place[real]] = got[real]
                seen += len(real)
        by_ids = np.add.reduceat(logs, starts, dtype=np.float64) + table.static[rows]
        heavy = ~np.isnan(table.base[rows])
        odds += np.bincount(odds_place(by_ids[heavy] - table.share[rows[heavy]]), minlength=ODDS_BINS)
        rare.append(table.rare(rows, by_ids, ~heavy))
    return (seen, net.pack(), odds, rare) if seen else None


def averaged(rows: list[tuple[int, bytes]]) -> tuple[int, bytes]:
    """Mean weights of several groups, by the windows that each has seen."""
    total = sum(n for n, _ in rows)
    mean = sum(np.frombuffer(w, np.float32) * np.float32(n / total) for n, w in rows)
    return total, mean.astype(np.float32).tobytes()


def refine(model: Model, train: DataFrame, counts: DataFrame, rows: int, id_column: str, text_column: str) -> None:
    """Trains the weights on in groups of all training documents, averages them in rounds of FAN_IN, and fits the mixture's weight on all words.

    Rows are dealt into groups by their hashes; SHARE of 1 leaves none out.
    """
    text = F.col(text_column)
    hashed = train.where(F.octet_length(text) > 0).select(text.cast("binary").alias("t"), F.xxhash64(F.col(id_column), text).alias("o"))
    some = hashed.where(F.pmod("o", F.lit(SHARE)) == 0).withColumn("g", F.pmod(F.xxhash64("o"), F.lit(-(-rows // (SHARE * GROUP)) or 1)))
    shared = train.sparkSession.sparkContext.broadcast(model)
    words = pa.list_(pa.struct([("word", pa.binary()), ("b", pa.float32()), ("open", pa.bool_())]))

    def run(table: pa.Table) -> pa.Table:
        group = table.column("g")[0].as_py()
        if _tables.get("trained") is not shared.value:
            _tables.update(trained=shared.value, learned=WordTable(shared.value))
        texts = table.sort_by([("o", "ascending"), ("t", "ascending")]).select(["t"]).combine_chunks().to_batches()
        n, weights, odds, rare = trained_further(_tables["learned"], (part.column(0) for batch in texts for part in slices(batch, 0)), RATE)
        rare = pa.ListArray.from_arrays(pa.array([0, sum(map(len, rare))], pa.int32()), pa.concat_arrays(rare)).cast(words)
        pa.default_memory_pool().release_unused()
        return pa.table([pa.array([group], pa.int64()), pa.array([n], pa.int64()), pa.array([weights], pa.binary()), pa.array([odds.tolist()], pa.list_(pa.int64())), rare], names=["g", "n", "weights", "odds", "rare"])

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("g")
        n, weights = averaged(list(zip(table.column("n").to_pylist(), table.column("weights").to_pylist())))
        return pa.table([pa.array([table.column("g")[0].as_py() // FAN_IN], pa.int64()), pa.array([n], pa.int64()), pa.array([weights], pa.binary())], names=["g", "n", "weights"])

    schema = "g long, n long, weights binary"
    first = written(some.groupBy("g").applyInArrow(run, schema + ", odds array<long>, rare array<struct<word:binary,b:float,open:boolean>>"), "weights")
    found = first.select("g", "n", "weights")
    while found.count() > FAN_IN:
        found = written(found.groupBy(F.floor(F.col("g") / FAN_IN).alias("up")).applyInArrow(merge, schema), "weights")
    rows = [(r.n, bytes(r.weights)) for r in found.orderBy("g").collect()]
    if rows:
        model.net.unpack(np.frombuffer(averaged(rows)[1], np.float32))
        heavy = first.select(F.posexplode("odds").alias("place", "n")).groupBy("place").agg(F.sum("n").alias("n"))
        rare = first.select(F.explode("rare").alias("r")).select("r.word", "r.b", "r.open")
        met = with_counts(rare, counts, model)
        by_ids, n = F.col("b") + F.coalesce("more", F.lit(0.0)), F.coalesce("n", F.lit(0)) + 0.5
        odds = by_ids - F.log(n) + math.log(model.total + 0.5 * (model.distinct + 1))
        place = F.least(F.greatest(F.floor((odds + ODDS_MOST) * (ODDS_BINS / (2 * ODDS_MOST))), F.lit(0)), F.lit(ODDS_BINS - 1)).cast("int")
        light = met.groupBy(place.alias("place")).agg(F.count("*").alias("n"))
        histogram = np.zeros(ODDS_BINS)
        for r in heavy.unionByName(light).collect():
            histogram[r.place] += r.n
        model.mix = mixture(histogram)


#: Log odds of the two experts are counted in so many bins between these bounds.
ODDS_BINS, ODDS_MOST = 4096, 64


def odds_place(odds: np.ndarray) -> np.ndarray:
    """The bin of each log odds."""
    return np.clip(np.floor((odds + ODDS_MOST) * (ODDS_BINS / (2 * ODDS_MOST))), 0, ODDS_BINS - 1).astype(np.int64)


def mixture(histogram: np.ndarray, rounds: int = 20) -> float:
    """EM for the weight of the first of two experts, by the histogram of their log odds."""
    odds, mix = (np.arange(ODDS_BINS) + 0.5) * (2 * ODDS_MOST / ODDS_BINS) - ODDS_MOST, 0.5
    for _ in range(rounds if histogram.sum() else 0):
        mix = float(np.clip((histogram / (1 + np.exp(-odds - math.log(mix / (1 - mix))))).sum() / histogram.sum(), 0.02, 0.98))
    return mix


def windows(lengths: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, scored from) of the windows that score every position of every text once."""
    count = 1 + np.maximum(0, -(-(lengths - window) // stride))
    count[lengths == 0] = 0
    text = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = number * stride
    return text, first, np.where(number > 0, first + window - stride, 0)


class Model:
    """Everything that scoring needs; made on the driver, used by every task."""

    def __init__(self, rank_path: str, pattern: str, heavy: dict[bytes, int], total: int, distinct: int, unigrams: np.ndarray, near: tuple[np.ndarray, ...], pairs: tuple[np.ndarray, np.ndarray, np.ndarray], sums_of: Callable[[np.ndarray], tuple], sample: list[bytes], seed: int = 17):
        self.rank_path, self.pattern, self.heavy, self.total, self.distinct = rank_path, pattern, heavy, total, distinct
        own, rng = subwords(rank_path, pattern), np.random.default_rng(seed)
        self.end = own.end
        self.classes, points = self._classes(unigrams, near, rng)
        self._probabilities(unigrams, pairs, sums_of(self.classes))
        self.net = Attention(points, CLASSES, rng)
        texts = [own.many(words_of(t))[0].astype(np.int64) for t in sample]
        self.losses = []
        if texts:
            x, target, real, _ = self._batched([np.r_[own.end, t[:-1]] for t in texts], texts)
            self.losses = self.net.train(x, target, real, rng)
        self.mix = 0.5

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "light"}

    @staticmethod
    def _classes(unigrams: np.ndarray, near: tuple[np.ndarray, ...], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Classes of ids by what stands before and after them in words, and their first vectors; the last class is for ids never seen.

        near has (id, column, n): how often each of the 2 * CONTEXTS neighbours was met.
        """
        size = len(unigrams)
        counts = np.zeros((size, 2 * CONTEXTS), np.float32)
        ids, column, n = near
        counts[ids, column] = n
        own, others = counts.sum(1, keepdims=True), counts.sum(0, keepdims=True) / max(1.0, counts.sum(dtype=np.float64))
        # In place and by parts: the table is the largest that the driver holds.
        for at in range(0, size, 2048):
            part = counts[at : at + 2048]
            expected = own[at : at + 2048] * others
            np.divide(part, expected, out=part, where=expected > 0)
            np.log1p(part, out=part)
        info = counts
        basis = np.linalg.qr(info.T @ (info @ rng.standard_normal((2 * CONTEXTS, WIDTH)).astype(np.float32)))[0]
        points = info @ np.linalg.qr(info.T @ (info @ basis))[0]
        points /= np.sqrt((points**2).sum(1, keepdims=True)) + 1e-6
        classes = np.full(size, CLASSES - 1, np.int32)
        seen = np.flatnonzero(unigrams > 0)
        if len(seen):
            # Centres of the ids as often as they occur, so that frequent ones get classes of their own.
            drawn = rng.choice(seen, min(20_000, 4 * len(seen)), p=unigrams[seen] / unigrams[seen].sum())
            centres = kmeans(points[drawn], CLASSES - 1, 12, rng)
            classes[seen] = ((centres**2).sum(1) - 2 * points[seen] @ centres.T).argmin(1)
        return classes, points + 0.05 * rng.standard_normal(points.shape)

    def _probabilities(self, unigrams: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Log probabilities of ids in their classes, alone and after an id; sums are those of all pairs, by (before, class)."""
        smooth = unigrams + 0.5
        alone = smooth / np.bincount(self.classes, smooth, CLASSES)[self.classes]
        self.alone = np.log(alone)
        before, ids, n = (np.asarray(p) for p in pairs)
        first, group, all_n = (np.asarray(p) for p in sums)
        group = (first.astype(np.int64) + 1) * CLASSES + group
        order = np.argsort(group)
        self.groups, all_n = group[order], all_n[order]
        self.unseen = np.log(BACKOFF / (all_n + BACKOFF))
        keys = (before.astype(np.int64) + 1) << 20 | ids
        order = np.argsort(keys)
        self.keys = keys[order]
        member = np.searchsorted(self.groups, (before.astype(np.int64) + 1) * CLASSES + self.classes[ids])
        self.after = np.log((n + BACKOFF * alone[ids]) / (all_n[member] + BACKOFF))[order] if len(n) else np.zeros(0)

    def light_pairs(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which pairs are not among the broadcast ones."""
        keys = (before.astype(np.int64) + 1) << 20 | ids
        if not len(self.keys):
            return np.ones(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys

    def within(self, before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each id given its class and the id before it in its word (-1: none), and which pairs are light; these count as unseen."""
        out = self.alone[ids].copy()
        group = (before.astype(np.int64) + 1) * CLASSES + self.classes[ids]
        at = np.minimum(np.searchsorted(self.groups, group), max(0, len(self.groups) - 1))
        if len(self.groups):
            hit = self.groups[at] == group
            out[hit] += self.unseen[at[hit]]
        keys = (before.astype(np.int64) + 1) << 20 | ids
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        if not len(self.keys):
            return out, np.ones(len(keys), bool)
        hit = self.keys[at] == keys
        out[hit] = self.after[at[hit]]
        return out, ~hit

    def _batched(self, inputs: list[np.ndarray], targets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(x) for x in inputs], np.int64)
        return self.window_rows(np.concatenate(inputs), np.concatenate(targets), lengths)

    def window_rows(self, inputs: np.ndarray, targets: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, target classes, which positions are scored, and their places in the joined texts."""
        text, first, scored = windows(lengths)
        starts = np.cumsum(lengths) - lengths
        within = first[:, None] + np.arange(WINDOW)
        real = (within < lengths[text][:, None]) & (within >= scored[:, None])
        place = starts[text][:, None] + np.minimum(within, lengths[text][:, None] - 1)
        return inputs[place], self.classes[targets][place], real, place

    def window_parts(self, inputs: np.ndarray, targets: np.ndarray, lengths: np.ndarray, rows: int = BATCH, mixed: bool = False):
        """`window_rows` of so many windows at a time, without what only gives context, as a list of one part or two.

        Windows that open a text skip nothing, the others what the overlap leaves.
        Mixed, they come in their order; otherwise each kind comes by itself.
        """
        text, first, _ = windows(lengths)
        starts, classes, opens = np.cumsum(lengths) - lengths, self.classes[targets], first == 0

        def part(skip: int, some: np.ndarray) -> tuple:
            t, f = text[some], first[some]
            within, size = f[:, None] + np.arange(WINDOW), lengths[t][:, None]
            place = starts[t][:, None] + np.minimum(within, size - 1)
            scored = place[:, skip:]
            return skip, inputs[place], classes[scored], within[:, skip:] < size, scored

        for own in [np.arange(len(text))] if mixed else [np.flatnonzero(opens), np.flatnonzero(~opens)]:
            for at in range(0, len(own), rows):
                some = own[at : at + rows]
                kinds = (0, some[opens[some]]), (WINDOW - STRIDE, some[~opens[some]])
                yield [part(skip, kind) for skip, kind in kinds if len(kind)]

    def class_log_probs(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log probability of every id's class, by the ids before it in its text.

        Batches of 64 windows keep the arrays small enough for the allocator to
        use them again; larger ones take twice the time.
        """
        symbols = np.empty_like(ids)
        symbols[1:] = ids[:-1]
        symbols[np.cumsum(lengths) - lengths] = self.end
        out = np.zeros(len(ids), np.float32)
        for [(skip, x, target, real, place)] in self.window_parts(symbols, ids, lengths):
            got = self.net.log_probs(x, target, skip)
            if real.all():
                out[place] = got
            else:
                out[place[real]] = got[real]
        return out


class WordTable:
    """What is known of each word that a worker has met, row by row, in bounded space."""

    def __init__(self, model: Model, bound: int = KNOWN_WORDS):
        self.model, self.bound = model, bound
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.static, self.share, self.base = (np.zeros(0) for _ in range(3))
        self.open = np.zeros(0, bool)
        self.words: list[bytes] = []

    def forget(self) -> None:
        """Keeps the broadcast words only, or none where these are over half of the bound."""
        kept = np.flatnonzero(~np.isnan(self.base))
        if 2 * len(kept) > self.bound:
            kept = kept[:0]
        size = self.size[kept]
        start = np.cumsum(size) - size
        self.ids = self.ids[np.arange(size.sum()) + np.repeat(self.start[kept] - start, size)]
        self.start, self.size = start, size
        self.static, self.open, self.share, self.base = (x[kept] for x in (self.static, self.open, self.share, self.base))
        self.words = [self.words[k] for k in kept.tolist()]
        self.row = dict(zip(self.words, range(len(self.words))))

    def learn(self, new: list[bytes]) -> None:
        model, own = self.model, subwords(self.model.rank_path, self.model.pattern)
        ids, size = own.many(new)
        starts = np.cumsum(size) - size
        before = before_in_word(ids, size)
        count = np.array([model.heavy.get(w, 0) for w in new], np.float64)
        self.row.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        self.words += new
        self.start = np.r_[self.start, starts + len(self.ids)]
        self.size = np.r_[self.size, size]
        self.ids = np.r_[self.ids, ids]
        static, light = model.within(before, ids)
        self.static = np.r_[self.static, np.add.reduceat(static, starts)]
        self.open = np.r_[self.open, np.logical_or.reduceat(light, starts)]
        self.share = np.r_[self.share, np.log((count + 0.5) / (model.total + 0.5 * (model.distinct + 1)))]
        self.base = np.r_[self.base, np.where(count > 0, np.log10(count + 0.5), np.nan)]

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The row of every word of the texts, and the number of words of each."""
        if len(self.words) > self.bound:
            self.forget()
        distinct, place, sizes = block_words(texts)
        words = distinct.to_pylist()
        own = np.fromiter(map(self.row.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(own < 0)
        if len(new):
            own[new] = len(self.words) + np.arange(len(new))
            self.learn([words[k] for k in new.tolist()])
        return own.take(place), sizes

    def ids_of(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words, where each word's begin, and how many each text has."""
        count = self.size[rows]
        starts = np.cumsum(count) - count
        place = np.arange(count.sum()) + np.repeat(self.start[rows] - starts, count)
        return self.ids[place], starts, np.add.reduceat(count, np.cumsum(sizes) - sizes)

    def by_ids(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log probability of every word by its ids."""
        ids, starts, lengths = self.ids_of(rows, sizes)
        return np.add.reduceat(self.model.class_log_probs(ids, lengths), starts, dtype=np.float64) + self.static[rows]

    def rare(self, rows: np.ndarray, by_ids: np.ndarray, some: np.ndarray) -> pa.StructArray:
        """Some words, with what their ids give."""
        words = [self.words[k] for k in rows[some].tolist()]
        return pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(by_ids[some].astype(np.float32)), pa.array(self.open[rows[some]])], names=["word", "b", "open"])

    def scores(self, texts: pa.Array) -> tuple:
        """Of each text: words, heavy words, log10 sums of base and model over these, and its other words with what their ids give."""
        rows, sizes = self.rows(texts)
        starts = np.cumsum(sizes) - sizes
        mix = self.model.mix
        by_ids = self.by_ids(rows, sizes)
        each = np.logaddexp(by_ids + math.log(mix), self.share[rows] + math.log(1 - mix)) / math.log(10)
        base = self.base[rows]
        heavy = ~np.isnan(base)
        rare = np.flatnonzero(~heavy)
        cuts = np.searchsorted(rare, np.r_[starts, len(rows)])
        other = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), self.rare(rows, by_ids, rare))
        return sizes, np.add.reduceat(heavy.astype(np.int64), starts), np.add.reduceat(np.where(heavy, base, 0.0), starts), np.add.reduceat(np.where(heavy, each, 0.0), starts), other


_tables: dict = {}


def light_shares(words: DataFrame, model: Model) -> DataFrame:
    """(word, more): what light pairs add to the log probability of a word's ids; words are distinct."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, held = shared.value, batch.column(0).to_pylist()
            ids, size = subwords(own.rank_path, own.pattern).many(held)
            before = before_in_word(ids, size)
            some = np.flatnonzero(own.light_pairs(before, ids))
            word = batch.column(0).take(pa.array(np.repeat(np.arange(len(held)), size)[some]))
            yield pa.RecordBatch.from_arrays([word.cast(pa.binary()), pa.array(before[some].astype(np.int32)), pa.array(ids[some].astype(np.int32)), pa.array(np.exp(own.alone[ids[some]]))], names=["word", "before", "id", "alone"])

    # A light pair is in few training words, so that the join is even.
    pairs = words.select("word").mapInArrow(run, "word binary, before int, id int, alone double")
    return pairs.join(model.light, ["before", "id"]).groupBy("word").agg(F.sum(F.log1p(F.col("n") / (BACKOFF * F.col("alone")))).alias("more"))


def with_counts(rare: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """Adds to words that aren't broadcast their counts, `n`, and what light pairs add, `more`."""
    # There are many words as frequent as any on either side, so that the join is even.
    few = counts.where(frequency_level() < model.level)
    more = light_shares(rare.where("open").select("word").distinct(), model)
    return rare.drop("open").join(few.join(more, "word", "full"), "word", "left")


def frequency_level() -> Column:
    """Eighths of doublings of a count."""
    return F.floor(F.log2(F.col("n").cast("double")) * 8)


def level_for(counts: DataFrame, bound: int) -> int:
    """The lowest level of which, with all above it, `bound` rows or fewer are."""
    kept, least = 0, 1 << 20
    for row in counts.groupBy(frequency_level().alias("level")).count().orderBy(F.desc("level")).collect():
        kept += row["count"]
        if kept > bound:
            break
        least = row.level
    return least


def neighbours(after: DataFrame, unigrams: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, column, n): how often the CONTEXTS most frequent ids (or a word's start) stand before and after each id; bounded by the vocabulary."""
    most = [int(k) for k in np.argsort(-unigrams, kind="stable")[:CONTEXTS]]
    before = after.where(F.col("before").isin([-1, *most[:-1]])).select("id", F.col("before").alias("other"), F.lit(0).alias("side"), "n")
    behind = after.where((F.col("before") >= 0) & F.col("id").isin(most)).select(F.col("before").alias("id"), F.col("id").alias("other"), F.lit(1).alias("side"), "n")
    found = before.unionByName(behind).toArrow()
    ids, other, side, n = (found.column(c).to_numpy() for c in ("id", "other", "side", "n"))
    columns = np.zeros((2, len(unigrams) + 1), np.int64)
    columns[0, [0, *(k + 1 for k in most[:-1])]] = np.arange(CONTEXTS)
    columns[1, [k + 1 for k in most]] = CONTEXTS + np.arange(CONTEXTS)
    return ids, columns[side, other + 1], n


def fit(docs: DataFrame, training: Column, rank_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the stored counts of all words of the training documents."""
    train = docs.where(training)
    counts = written(word_counts(train, text_column), "words")
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    after = written(transitions(counts, rank_path, pattern), "transitions")
    size = subwords(rank_path, pattern).size
    unigrams = np.zeros(size)
    singles = after.groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    unigrams[singles.column("id").to_numpy()] = singles.column("n").to_numpy()
    # A broadcast word is no more frequent than its pairs, which are therefore broadcast, too.
    pair_level = level_for(after, PAIRS)
    level = max(pair_level, level_for(counts, HEAVY))
    heavy = counts.where(frequency_level() >= level).toArrow()
    pairs = after.where(frequency_level() >= pair_level).orderBy("before", "id").toArrow()

    def sums_of(classes: np.ndarray) -> tuple:
        named = train.sparkSession.createDataFrame(pa.table({"id": pa.array(np.arange(size, dtype=np.int32)), "group": pa.array(classes)}))
        found = after.join(F.broadcast(named), "id").groupBy("before", "group").agg(F.sum("n").alias("n")).toArrow()
        return tuple(found.column(c).to_numpy() for c in ("before", "group", "n"))

    text = F.col(text_column)
    rows = docs.count()
    short = train.where((F.octet_length(text) > 0) & (F.octet_length(text) <= SAMPLE_BYTES)).select(text.cast("binary").alias("t"), F.xxhash64(F.col(id_column), text).alias("o"))
    held = sampled(short, SAMPLE, rows, "o", "t").orderBy("o", "t").select("t").toArrow().column("t").to_pylist()
    known = dict(zip(heavy.column("word").to_pylist(), heavy.column("n").to_pylist()))
    model = Model(rank_path, pattern, known, total, distinct, unigrams, neighbours(after, unigrams), tuple(pairs.column(c).to_numpy() for c in ("before", "id", "n")), sums_of, held)
    model.light, model.level = after.where(frequency_level() < pair_level), level
    refine(model, train, counts, rows, id_column, text_column)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def block(batch: pa.RecordBatch) -> list:
        own = shared.value
        if _tables.get("model") is not own:
            _tables.update(model=own, table=WordTable(own))
        return [batch.column(0), *_tables["table"].scores(batch.column(1))]

    schema = f"doc_id {kind}, n_tokens long, heavy long, base double, score double, rare array<struct<word:binary,b:float,open:boolean>>"
    scored = map_blocks(docs.select(id_column, text_column), 1, schema, block).withColumn("row", F.monotonically_increasing_id())
    stored = written(scored, "scored")
    rare = stored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.b", "r.open")
    found = with_counts(rare, counts, model)
    n = F.coalesce("n", F.lit(0)) + 0.5
    mixed = model.mix * F.exp(F.col("b") + F.coalesce("more", F.lit(0.0))) + (1 - model.mix) / (model.total + 0.5 * (model.distinct + 1)) * n
    sums = found.groupBy("row").agg(F.count("n").alias("known"), F.sum(F.log10(n)).alias("more"), F.sum(F.log10(mixed)).alias("mixed"))
    all_words = F.lit(math.log10(model.total + 0.5 * (model.distinct + 1)))
    joined = stored.drop("rare").join(sums, "row", "left")
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("heavy") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * all_words).alias("base_score"),
        (F.col("score") + F.coalesce("mixed", F.lit(0.0))).alias("score"),
    )
