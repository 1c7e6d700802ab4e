"""Secrets by patterns and by character Markov models, on SQL functions alone.

The patterns give the base spans. The method adds runs of code characters that
a model of random strings explains better than a model of ordinary
identifiers: each is a first-order Markov chain over characters, and the sum of
the log-likelihood ratios of a run's character pairs decides.

Both models are trained from labelled samples. The random strings are made by
hashing integers, in hexadecimal, base 64 and base 36 notation. The ordinary
identifiers are the runs of SAMPLE documents (those with the smallest hashes of
up to SAMPLE_BYTES bytes), but for those inside base spans. The weights are
whole thousandths of a nat, so sums don't depend on their order.

A null text counts as empty and has no spans. Spans are in code points, end
exclusive. Rows are handled alone, with no shuffle; repeated rows are kept and
other columns don't matter. The time for a text grows with its length, and by
the power of 1.5 with its number of spans; a long run is scored like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sampled

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The runs of 20 and of 24 characters or more; a shorter run holds no longer one.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "markov")
RUN = r"[A-Za-z0-9+/_=-]{16,}"
TRAIN_RUN = r"[A-Za-z0-9+/_=-]{4,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SAMPLE = 1000
SAMPLE_BYTES = 16_384
RANDOM_STRINGS = 3000
#: Weight of a character's own share beside the counts after another.
BACKOFF = 4.0
#: Mean thousandths of a nat for each pair of a run, from which it is a secret.
LEAST_MEAN = 2500
MASK = "[SECRET]"
#: Characters of a piece, within which single characters are counted out.
PIECE = 256

_SPAN = "array<struct<start:int,kind:int,stop:int>>"


def _with(value: Column, use) -> Column:
    """`use` on the value of an expression, which is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _folded(items: Column, state: dict[str, Column], step, last=None) -> Column:
    """Folds an array into another one; `step` gives the next state and what it adds.

    Adding to an array copies it. So the items are folded in blocks of about
    the root of their number, and only whole blocks' results are added up.
    """
    names = list(state)

    def kept(s: Column) -> list[Column]:
        return [s[n].alias(n) for n in names]

    def run(a: Column, block: Column) -> Column:
        empty = F.array().cast(_SPAN)

        def inner(s: Column, item: Column) -> Column:
            after, more = step(s, item)
            return F.struct(*[after[n].alias(n) for n in names], F.when(more.isNotNull(), F.concat(s["found"], F.array(more))).otherwise(s["found"]).alias("found"))

        def outer(s: Column, k: Column) -> Column:
            own = F.aggregate(F.slice(a, k * block + 1, block), F.struct(*kept(s), empty.alias("found")), inner)
            return _with(own, lambda o: F.struct(*kept(o), F.concat(s["found"], o["found"]).alias("found")))

        start = F.struct(*[state[n].alias(n) for n in names], empty.alias("found"))
        end = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), start, outer)
        return _with(end, lambda s: F.concat(s["found"], F.filter(F.array(last(s)), lambda x: x.isNotNull()))) if last else end["found"]

    size = lambda a: F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(a))).cast("int"))
    return _with(items, lambda a: F.when(F.size(a) > 0, _with(size(a), lambda block: run(a, block))).otherwise(F.array().cast(_SPAN)))


def _span(start: Column, kind: int, stop: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"))


def _spans(text: Column, pattern: str, kind: int, keep=None, value_group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches whose value `keep` likes.

    They follow from the lengths of the matches and of what lies between, so the
    text is read a fixed number of times, whatever the number of matches.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))  # the last gap has no match after it
    parts = [hits.alias("hit"), gaps.alias("gap")]
    if value_group:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("value"))
    liked = (lambda p: keep(p["value" if value_group else "hit"])) if keep else (lambda p: F.lit(True))
    sizes = F.transform(F.arrays_zip(*parts), lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["hit"]).alias("size"), liked(p).alias("kept")))

    def step(s: Column, part: Column) -> tuple[dict[str, Column], Column]:
        first = s["at"] + part["gap"]
        stop = first + part["size"]
        return {"at": stop}, F.when(part["kept"], _span(first, kind, stop))

    return F.when(text.rlike(pattern), _folded(sizes, {"at": F.lit(0)}, step)).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """The patterns' spans by start, then kind."""
    access = F.when(F.instr(text, "AKIA") > 0, _spans(text, ACCESS, 1)).otherwise(F.array().cast(_SPAN))
    return F.array_sort(F.concat(_spans(text, ASSIGN, 0, lambda v: F.length(v) >= ASSIGN_LEAST, 2), access, _spans(text, HEX, 2)))


def _pairs(runs: DataFrame, column: str) -> dict[tuple[str, str], int]:
    """Counts of neighbouring characters; at most the alphabet's square of rows reach the driver."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length(column) - 1), lambda i: F.substr(F.col(column), i, F.lit(2))))
    rows = runs.where(F.length(column) >= 2).select(pair.alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).collect()
    return {(r.pair[0], r.pair[1]): r.n for r in rows}


def _chain(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    """Log probabilities of the second character after the first, smoothed by those of characters alone."""
    after, alone = dict.fromkeys(ALPHABET, 0), dict.fromkeys(ALPHABET, 0)
    for (a, b), n in counts.items():
        after[a] += n
        alone[b] += n
    total = sum(alone.values())
    share = {b: (n + 0.5) / (total + 0.5 * len(ALPHABET)) for b, n in alone.items()}
    return {(a, b): math.log((counts.get((a, b), 0) + BACKOFF * share[b]) / (after[a] + BACKOFF)) for a in ALPHABET for b in ALPHABET}


def learn(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> list[int]:
    """Log-likelihood ratios of all pairs of the alphabet, in thousandths of a nat."""
    spark: SparkSession = docs.sparkSession
    text = F.col(text_column)
    short = docs.where(text.isNotNull() & (F.octet_length(text) <= SAMPLE_BYTES)).select(text.alias("t"), F.xxhash64(F.col(id_column), text).alias("o"))
    sample = sampled(short, SAMPLE, docs.count(), "o", "t")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = _pairs(sample.select(F.explode(F.regexp_extract_all(clean, F.lit(TRAIN_RUN), F.lit(0))).alias("run")), "run")
    digest = F.sha2(F.col("id").cast("string"), 256)
    forms = F.array(digest, F.regexp_replace(F.base64(F.unhex(digest)), "=", ""), F.lower(F.conv(F.substr(digest, F.lit(1), F.lit(15)), 16, 36)))
    random = _pairs(spark.range(RANDOM_STRINGS).select(F.explode(forms).alias("run")), "run")
    for pair in list(random):
        if pair[0] not in ALPHABET or pair[1] not in ALPHABET:
            del random[pair]
    strange, usual = _chain(random), _chain(ordinary)
    return [round(1000 * (strange[a, b] - usual[a, b])) for a in ALPHABET for b in ALPHABET]


def markov_score(run: Column, weights: list[int]) -> Column:
    """Sum of the weights of a run's pairs; the weights are one folded literal.

    A run is cut into pieces of PIECE characters, so that a character is reached
    in bounded time, however long the run.
    """
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")

    def step(s: Column, c: Column) -> Column:
        place = F.instr(F.lit(ALPHABET), c) - 1
        return _with(place, lambda p: F.struct(p.alias("before"), (s["total"] + F.when(s["before"] >= 0, F.get(table, s["before"] * len(ALPHABET) + p)).otherwise(0)).cast("bigint").alias("total")))

    start = F.struct(F.lit(-1).alias("before"), F.lit(0).cast("bigint").alias("total"))
    pieces = F.when(F.length(run) <= PIECE, F.array(run)).otherwise(F.regexp_extract_all(run, F.lit(f".{{1,{PIECE}}}"), F.lit(0)))
    return F.aggregate(pieces, start, lambda s, piece: F.aggregate(F.split(piece, ""), s, step))["total"]


def _apart(base: Column, runs: Column) -> Column:
    """The runs that overlap no base span, in one pass over all spans by start."""
    none = F.lit(None).cast("struct<start:int,kind:int,stop:int>")

    def step(s: Column, span: Column) -> tuple[dict[str, Column], Column]:
        run = span["kind"] == 3
        held = s["held"]
        clear = held.isNotNull() & (run | (held["stop"] <= span["start"]))
        after = F.when(run, F.when(span["start"] >= s["until"], span)).otherwise(F.when(held["stop"] > span["start"], none).when(clear, none).otherwise(held))
        return {"until": F.when(run, s["until"]).otherwise(F.greatest(s["until"], span["stop"])), "held": after}, F.when(clear, held)

    both = F.array_sort(F.concat(base, runs))
    return F.when((F.size(base) == 0) | (F.size(runs) == 0), runs).otherwise(_folded(both, {"until": F.lit(0), "held": none}, step, lambda s: s["held"]))


def all_spans(text: Column, base: Column, weights: list[int]) -> Column:
    """Base spans and the method's, which never overlap a base span."""

    def secret(run: Column) -> Column:
        return run.rlike("[A-Za-z]") & (markov_score(run, weights) >= F.lit(LEAST_MEAN).cast("bigint") * (F.length(run) - 1))

    runs = _spans(text, RUN, 3, secret)
    return _with(base, lambda b: _with(runs, lambda r: F.array_sort(F.concat(b, _apart(b, r)))))


def scan(docs: DataFrame, weights: list[int], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind, stop); kinds as in KINDS."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    rows = rows.withColumn("base", base_spans(F.col("_text")))
    return rows.withColumn("spans", all_spans(F.col("_text"), F.col("base"), weights)).drop("_text")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones together, replaced by MASK."""

    def between(pieces: Column, first: Column, stop: Column) -> Column:
        """Characters first..stop from the pieces that hold them."""
        piece = lambda k: F.substr(F.get(pieces, k), F.greatest(first - k * PIECE, F.lit(0)) + 1, F.least(stop - k * PIECE, F.lit(PIECE)) - F.greatest(first - k * PIECE, F.lit(0)))
        whole = F.array_join(F.transform(F.sequence(F.floor(first / PIECE).cast("int"), F.floor((stop - 1) / PIECE).cast("int")), piece), "")
        return F.when(stop > first, whole).otherwise("")

    def step(s: Column, span: Column) -> tuple[dict[str, Column], Column]:
        fresh = span["start"] >= s["until"]
        return {"until": F.greatest(s["until"], span["stop"])}, F.when(fresh, _span(s["until"], 0, span["start"]))

    def joined(pieces: Column) -> Column:
        gaps = _folded(spans, {"until": F.lit(0)}, step, lambda s: _span(s["until"], 0, F.length(text)))
        return F.array_join(F.transform(gaps, lambda g: between(pieces, g["start"], g["stop"])), MASK)

    return F.when(F.size(spans) > 0, _with(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), joined)).otherwise(text)
