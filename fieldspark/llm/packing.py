"""Best-two-fit packing of tokenized documents into fixed-length sequences.

A document becomes its token ids and one end id; only longer ones than a
sequence are cut. The pieces are dealt by a hash to shards of bounded size,
and each shard is packed on its own: a bin takes the largest piece that fits
until none does, then its smallest piece gives way to the two unpacked pieces
that fill the widened gap best, if they fill it better. A shard leaves one bin
part-empty at most, whatever the number of rows.

Nulls: a null text is an empty one, which is the end id alone. Null or
repeated document ids are packed like any other. An empty table gives no rows.
A text longer than a block is a block of its own, so a task holds one such text
at a time. Equal lengths are packed in the order of the rows. A literal special
token in a text is that token's id, as the library has it.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Generations, map_blocks, written

SEQUENCE = 2048
END_ID = 0
#: Pieces in a shard, at most about this many.
SHARD_PIECES = 60_000
#: Punctuation that a chunk may end in: none of it starts a contraction or joins a letter.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space.

    Such a tokenizer never joins what a space parts, so spaces cut a text into
    chunks. Arrow finds the distinct chunks of a block and cuts each into a
    lowered word and the punctuation after it, where a plain letter stands
    between. Only words that are not known yet are encoded: those of plain
    letters, which are one unit each, together, the others with a special token
    between them. Chunks that hold a special token's first signs are encoded
    alone. What is known is kept within a bound of bytes; a block's ids are
    gathered from its words' ids at once.
    """

    def __init__(self, path: str, bound: int = 48 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.separator = max(special)
        self.between, self.marks = special[self.separator], tuple({t[:2] for t in special.values()})
        self.words = Generations(bound)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _cut(self, units: list[str], plain: bool) -> None:
        """Encodes units together; plain ones end where a word's end is, the others at the separator."""
        for at in range(0, len(units), 1000):
            some = units[at : at + 1000]
            ids = self._ids((" " if plain else self.between).join(some))
            data = ids.tobytes()
            if plain:
                stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                starts = [0, *stops]
            else:
                stops = [*(4 * np.flatnonzero(ids == self.separator)).tolist(), len(data)]
                starts = [0, *(k + 4 for k in stops)]
            self.words.put(some, [data[i:j] for i, j in zip(starts, stops)])

    def _known(self, words: list[str], special: bool) -> list[bytes]:
        """The ids of each word; new ones are encoded."""
        wanted = self.words.missing(set(words))
        alone = [w for w in wanted if any(m in w for m in self.marks)] if special else []
        wanted.difference_update(alone)
        self.words.put(alone, [self._ids(w).tobytes() for w in alone])
        plain = [w for w in wanted if w.isalpha() and max(w) <= "\xff"]
        self._cut(plain, True)
        self._cut(list(wanted.difference(plain)), False)
        return list(map(self.words.current.__getitem__, words))

    def _parts(self, chunks: pa.StringArray, special: bool) -> tuple[pa.Array, np.ndarray, list[str]]:
        """Of each chunk its lowered word and the place of its punctuation among the distinct ones."""
        cores = pc.utf8_rtrim(chunks, characters=TAIL)
        size, whole = (pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (cores, chunks))
        data = np.r_[np.zeros(2, np.uint8), np.frombuffer(cores.buffers()[2] or b"", np.uint8)]
        end = np.frombuffer(cores.buffers()[1], np.int32)[cores.offset + 1 : cores.offset + len(cores) + 1] + 1
        last, before = data[end], data[end - 1]
        # A to Z in either case, or a letter of U+00C0 to U+00FF: lowered, none of them joins what follows.
        letter = (last & 0xDF) - np.uint8(65) < 26
        letter |= (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
        letter &= size > 0
        for m in self.marks if special else ():
            letter &= ~pc.match_substring(chunks, m).to_numpy(zero_copy_only=False)
        tails, place = [""], np.zeros(len(chunks), np.int32)
        rows = np.flatnonzero(letter & (size < whole))
        if len(rows):
            found = pa.array([c[-n:] for c, n in zip(chunks.take(pa.array(rows)).to_pylist(), (whole - size)[rows].tolist())], pa.string()).dictionary_encode()
            tails += found.dictionary.to_pylist()
            place[rows] = found.indices.to_numpy() + 1
        return pc.if_else(pa.array(letter), pc.ascii_lower(cores), chunks), place, tails

    def encode_all(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's end."""
        self.words.turn()
        texts = pc.fill_null(texts, "")
        special = any(pc.any(pc.match_substring(texts, m)).as_py() for m in self.marks)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        found = lists.flatten().dictionary_encode()
        cores, tail, tails = self._parts(found.dictionary, special)
        cores = cores.dictionary_encode()
        known = self._known([*cores.dictionary.to_pylist(), *tails], special)
        size = np.fromiter(map(len, known), np.int32, len(known)) // 4
        start, pool = np.cumsum(size, dtype=np.int32) - size, np.frombuffer(b"".join(known), "<u4")
        chunk = found.indices.to_numpy()
        units = np.empty(2 * len(chunk), np.int32)
        units[::2] = cores.indices.to_numpy().take(chunk)
        units[1::2] = (np.int32(len(cores.dictionary)) + tail).take(chunk)
        count = size.take(units)
        stop = np.cumsum(count, dtype=np.int32)
        place = np.repeat(start.take(units) - stop + count, count)
        place += np.arange(len(place), dtype=np.int32)
        ids = pool.take(place)
        stops = np.r_[0, stop][2 * (lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py())]
        return ids, stops

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0].tolist()


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32[, ids])."""
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def block(batch: pa.RecordBatch) -> list:
        found, stops = word_encoder(tokenizer_path).encode_all(batch.column(1))
        found = np.insert(found, stops, END_ID)
        owner, number, start, length, crc, ids = [], [], [], [], [], []
        first = 0
        for i, stop in enumerate((stops + np.arange(1, len(stops) + 1)).tolist()):
            for k, at in enumerate(range(first, stop, sequence)):
                cut = found[at : min(at + sequence, stop)]
                owner.append(i), number.append(k), start.append(at - first), length.append(len(cut))
                crc.append(zlib.crc32(cut))
                if with_ids:
                    ids.append(cut.astype("i4"))
            first = stop
        return [batch.column(0).take(pa.array(owner, pa.int32())), number, start, length, crc, *([ids] if with_ids else [])]

    return map_blocks(docs.select(F.col(id_column), F.col(text_column)), 1, schema, block)


def best_two_fit(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; equal lengths are taken in their order."""
    order = np.argsort(lengths, kind="stable")
    ends = np.cumsum(np.bincount(lengths, minlength=sequence + 1))
    left = np.diff(ends, prepend=0).tolist()
    taken = (ends - np.diff(ends, prepend=0)).tolist()
    free = sum(1 << n for n in range(1, sequence + 1) if left[n])
    mirror = sum(1 << (sequence - n) for n in range(1, sequence + 1) if left[n])
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(n: int) -> None:
        nonlocal free, mirror
        left[n] -= 1
        if not left[n]:
            free ^= 1 << n
            mirror ^= 1 << (sequence - n)

    number = 0
    while free:
        bin_, gap = [], sequence
        while gap and (n := (free & ((1 << (gap + 1)) - 1)).bit_length() - 1) > 0:
            take(n)
            bin_.append(n)
            gap -= n
        if gap and free and bin_:
            small = bin_[-1]
            for total in range(gap + small, small, -1):
                both = free & (mirror >> (sequence - total))
                if both and not total % 2 and left[total // 2] < 2:
                    both &= ~(1 << (total // 2))
                if both:
                    a = both.bit_length() - 1
                    take(a), take(total - a)
                    if not left[small]:
                        free |= 1 << small
                        mirror |= 1 << (sequence - small)
                    left[small] += 1
                    bin_[-1:] = [a, total - a]
                    break
        at = 0
        for n in bin_:
            row = order[taken[n]]
            taken[n] += 1
            bins[row], offsets[row] = number, at
            at += n
        number += 1
    return bins, offsets


def pack(found: DataFrame, sequence: int = SEQUENCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows that have a `length`; keeps their other columns."""
    stored = written(found.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-stored.count() // shard_pieces))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        number = table.column("_shard")[0].as_py()
        bins, offsets = best_two_fit(table.column("length").to_numpy(), sequence)
        kept = table.drop_columns(["_row", "_shard"])
        return kept.append_column("sequence_id", pa.array((number << 40) + bins)).append_column("offset", pa.array(offsets))

    dealt = stored.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
    return dealt.groupBy("_shard").applyInArrow(shard, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Whole documents to packed pieces; with_ids adds each piece's token ids."""
    return pack(pieces(docs, tokenizer_path, sequence, id_column, text_column, with_ids), sequence)
