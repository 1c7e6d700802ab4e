"""Byte-level BPE by prefix dynamic programming, with decoding and edits.

The encoding of a byte string under ranked merges is unique, and so is the
encoding of each of its prefixes. Each prefix ends in exactly one valid token:
the one whose pair with the last token of the shorter prefix is a pair that
merging would leave as it is. Storing that token for every prefix gives the
whole encoding by walking back, appends without re-encoding, and edits that
re-encode only until the stored tokens agree again.

Nulls: a null text is an empty one: no ids and no bytes. Columns other than
the id and the text are ignored; null or repeated ids give rows of their own. A
text longer than a block is a block of its own; the time for a text grows with its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Generations, Memo, map_blocks


class Merges:
    """A rank table, the two halves that made each token, and the pair test."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.known = Memo(lambda pair: self.stable(pair >> 20, pair & 0xFFFFF), 400_000)
        by_end: dict[bytes, set[int]] = {}
        for token in ranks:
            by_end.setdefault(token[-3:], set()).add(len(token))
        #: Lengths of the tokens that end like three bytes (fewer at a string's start), longest first.
        self.lengths = Memo(lambda end: tuple(sorted(set().union(*(by_end.get(end[k:], ()) for k in range(len(end)))), reverse=True)), 400_000)
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                continue
            for cut in range(1, len(token)):
                pair = ranks.get(token[:cut], rank), ranks.get(token[cut:], rank)
                if max(pair) < rank and self.stable(*pair):
                    self.halves[rank] = pair
                    self.merged[pair] = rank
                    break

    @classmethod
    def read(cls, path: str) -> Merges:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def stable(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens ends in just these two.

        Undo the later of the two tokens' merges, again and again, and look at
        the pair that then meets at the border: had it a merge that came before
        the one undone, merging would have crossed the border. Of equal merges
        the left one comes first.
        """
        halves, merged = self.halves, self.merged
        before = len(self.tokens)
        while merged.get((left, right), before) >= before:
            split_left, split_right = halves.get(left), halves.get(right)
            if split_left is None and split_right is None:
                return True
            if split_right is None or split_left is not None and left > right:
                before, left = left, split_left[1]
            else:
                before, right = right + 1, split_right[0]
        return False


class PrefixEncoder:
    """The last token of every prefix of a growing byte string."""

    def __init__(self, merges: Merges, data: bytes = b""):
        self.merges, self.data, self.last = merges, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Adds bytes; what was stored before stays valid."""
        self.data += data
        self._extend()

    def _extend(self, stop: int | None = None) -> None:
        data, find, stable, last, lengths = self.data, self.merges.ranks.get, self.merges.known, self.last, self.merges.lengths
        for end in range(len(last) + 1, (len(data) if stop is None else stop) + 1):
            for n in lengths[data[end - 3 if end > 3 else 0 : end]]:
                if n < end:
                    token = find(data[end - n : end])
                    if token is not None and stable[last[end - n - 1] << 20 | token]:
                        break
                elif n == end:
                    token = find(data[:end])
                    if token is not None:
                        break
            else:
                raise ValueError("the ranks lack a byte")
            last.append(token)

    def edit(self, start: int, stop: int, data: bytes) -> int:
        """Replaces bytes start..stop; returns how many prefixes were encoded anew.

        Behind the edit a prefix's token is final once a whole token's length
        of stored tokens came out as before: the later ones depend on no more.
        """
        old, tail = self.last[stop:], bytes(self.data[stop:])
        del self.last[start:]
        self.data = self.data[:start]
        self.append(data)
        self.data += tail
        same = work = 0
        for k in range(len(tail)):
            if same >= self.merges.longest:
                self.last += old[k:]
                break
            self._extend(len(self.last) + 1)
            same = same + 1 if self.last[-1] == old[k] else 0
            work += 1
        return len(data) + work

    def ids(self) -> list[int]:
        found, end = [], len(self.data)
        while end:
            found.append(self.last[end - 1])
            end -= len(self.merges.tokens[found[-1]])
        return found[::-1]


class Codec:
    """Texts to ids and back, each match of the pattern on its own.

    Cutting a text before each space and around each line end gives units that
    the pattern would never join, if no two white-space characters meet and all
    are of these two kinds; a pattern of units does the same for other texts. A
    unit's ids don't depend on its neighbours: Arrow finds the distinct units of
    a block, new ones are encoded, the others are known within a bound of bytes,
    and the block's ids are gathered from its units' ids at once.
    """

    UNEVEN = r"^[ \n]|[ \n]$|[ \n][ \n]|[\t\v\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

    def __init__(self, rank_path: str, pattern: str, bound: int = 64 << 20):
        self.merges = Merges.read(rank_path)
        self.words = regex.compile(pattern)
        self.units = regex.compile(r" ?\S+|\s+(?!\S)|\s+")
        self.known, self.parts = Generations(bound), Generations(bound)
        size = max(self.merges.tokens) + 1
        self.bytes = pa.array([self.merges.tokens.get(i, b"") for i in range(size)], pa.large_binary())
        self.decimal = pa.array([b"%d " % i for i in range(size)], pa.large_binary())

    def _word(self, word: str) -> bytes:
        data = word.encode()
        whole = self.merges.ranks.get(data)
        return np.array([whole] if whole is not None else PrefixEncoder(self.merges, data).ids(), "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        cut = list(map(self.words.findall, new))
        parts = list(self.parts.missing({p for own in cut for p in own}))
        self.parts.put(parts, list(map(self._word, parts)))
        known = self.parts.current
        self.known.put(new, [known[own[0]] if len(own) == 1 else b"".join(map(known.__getitem__, own)) for own in cut])

    def _gathered(self, units: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts whose units lie between offsets, and where each text's ids end."""
        self.parts.turn(), self.known.turn()
        found = units.dictionary_encode()
        names = found.dictionary.to_pylist()
        self._learn(list(self.known.missing(set(names))))
        known = list(map(self.known.current.__getitem__, names))
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        start, pool = np.cumsum(size) - size, np.frombuffer(b"".join(known), "<u4")
        place = found.indices.to_numpy()
        count = size.take(place)
        stop = np.cumsum(count)
        rows = np.repeat(start.take(place) - stop + count, count)
        rows += np.arange(len(rows))
        return pool.take(rows), np.r_[0, stop][offsets[1:]]

    def groups(self, texts: pa.StringArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, ids, stops) of the texts that are cut alike; null texts are empty."""
        texts = pc.fill_null(texts, "")
        uneven = pc.match_substring_regex(texts, self.UNEVEN)
        full = pc.greater(pc.binary_length(texts), 0)
        rows = np.flatnonzero(pc.and_not(full, uneven).to_numpy(zero_copy_only=False))
        if len(rows):
            marked = pc.replace_substring(pc.replace_substring(texts.take(pa.array(rows)), " ", "\x1f "), "\n", "\x1f\n\x1f")
            lists = pc.split_pattern(marked, "\x1f")
            yield rows, *self._gathered(lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py())
        rows = np.flatnonzero(pc.or_(pc.invert(full), uneven).to_numpy(zero_copy_only=False))
        if len(rows):
            cut = [self.units.findall(t) for t in texts.take(pa.array(rows)).to_pylist()]
            yield rows, *self._gathered(pa.array([u for own in cut for u in own], pa.string()), np.cumsum([0, *map(len, cut)]))

    def encode(self, text: str) -> list[int]:
        return next(self.groups(pa.array([text], pa.string())))[1].tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.merges.tokens.__getitem__, ids))


def _joined(table: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The table's entries of all ids, one after another, and where each begins; the last offset is the end."""
    found = table.take(pa.array(ids))
    return memoryview(found.buffers()[2] or b""), np.frombuffer(found.buffers()[1], np.int64)[: len(ids) + 1]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(rank_path: str, pattern: str) -> Codec:
    """The worker's own codec for these ranks."""
    key = rank_path, pattern
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def encode(docs: DataFrame, rank_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text."""
    kind = docs.schema[id_column].dataType.simpleString()

    def block(batch: pa.RecordBatch) -> list:
        out: list = [None] * batch.num_rows
        for rows, ids, stops in codec(rank_path, pattern).groups(batch.column(1)):
            for row, own in zip(rows.tolist(), np.split(ids.astype(np.int32), stops[:-1])):
                out[row] = own
        return [batch.column(0), out]

    return map_blocks(docs.select(id_column, text_column), 1, f"doc_id {kind}, ids array<int>", block)


def decode(encoded: DataFrame, rank_path: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(doc_id, data): the bytes that the ids stand for."""
    kind = encoded.schema[id_column].dataType.simpleString()

    def run(batches):
        own = codec(rank_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "data"])

    return encoded.select(id_column, ids_column).mapInArrow(run, f"doc_id {kind}, data binary")


def digests(docs: DataFrame, rank_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): a round trip without moving the ids."""
    kind = docs.schema[id_column].dataType.simpleString()

    def block(batch: pa.RecordBatch) -> list:
        own = codec(rank_path, pattern)
        counts, ids_hex, data_hex = ([None] * batch.num_rows for _ in range(3))
        for rows, ids, stops in own.groups(batch.column(1)):
            starts = np.r_[0, stops[:-1]]
            decimal, data = _joined(own.decimal, ids), _joined(own.bytes, ids)
            for row, a, b in zip(rows.tolist(), starts.tolist(), stops.tolist()):
                counts[row] = b - a
                # The last id's space is left out.
                ids_hex[row] = hashlib.sha256(decimal[0][decimal[1][a] : max(decimal[1][a], decimal[1][b] - 1)]).hexdigest()
                data_hex[row] = hashlib.sha256(data[0][data[1][a] : data[1][b]]).hexdigest()
        return [batch.column(0), counts, ids_hex, data_hex]

    return map_blocks(docs.select(F.col(id_column), F.col(text_column)), 1, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", block)
