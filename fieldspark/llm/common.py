"""What the corpus operators share: Arrow blocks, shared tables, skew-safe lookups."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Bytes of text that one block holds, so that numpy temporaries stay small.
BLOCK_BYTES = 2 << 20


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and that nothing will read again."""
    for table in tables:
        jvm, context = table.sparkSession._jvm, table.sparkSession._jsc
        path = jvm.org.apache.hadoop.fs.Path(table._stored)
        path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def sampled(rows: DataFrame, n: int, total: int, order: str, *then: str) -> DataFrame:
    """The n rows with the smallest values of `order`, a 64-bit hash; a stored table.

    `total` is about the number of rows. Only rows under a share of all hashes
    are sorted, about 2n of them for any number of rows and tasks; the share is
    raised where too few are left.
    """
    share = 2 * n / max(1, total)
    while True:
        part = rows if share >= 1 else rows.where(F.col(order) < F.lit(int(share * 2.0**64) - (1 << 63)))
        found = written(part.orderBy(order, *then).limit(n), "sample")
        if share >= 1 or found.count() >= n:
            return found
        share *= 4


def remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def slices(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose texts add up to about `limit` bytes; a longer text is a piece of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total + n > limit and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def map_blocks(df: DataFrame, text_column: int, schema: str, block: Callable[[pa.RecordBatch], list], setup: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow over blocks; `block` returns the output columns of one block."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    want = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_column):
                columns = block(part)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, want)], schema=want)
            # A worker lives on from stage to stage; what Arrow keeps in store would add up.
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def filter_blocks(df: DataFrame, text_column: str, keep: Callable[[list], object]) -> DataFrame:
    """The rows for whose texts (a list of bytes or None) `keep` returns true; all columns stay."""
    place = df.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, place):
                yield part.filter(pa.array(keep(part.column(place).cast(pa.binary()).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


class Generations:
    """What a worker knows of short strings, in two generations of `bound` bytes each.

    When the younger one is over its bound at a turn it becomes the older one,
    and what the older one knew is forgotten but for what was asked for since.
    """

    #: Bytes that an entry takes besides its key's and value's own.
    ENTRY = 200

    def __init__(self, bound: int):
        self.bound, self.used = bound, 0
        self.current: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def turn(self) -> None:
        if self.used > self.bound:
            self.before, self.current, self.used = self.current, {}, 0

    def put(self, keys: list[str], values: list[bytes]) -> None:
        self.current.update(zip(keys, values, strict=True))
        self.used += sum(map(len, keys)) + sum(map(len, values)) + self.ENTRY * len(keys)

    def missing(self, keys: set[str]) -> set[str]:
        """The keys that neither generation knows; those of the older one are moved to the younger."""
        asked = keys.difference(self.current)
        held = [k for k in asked if k in self.before]
        self.put(held, list(map(self.before.__getitem__, held)))
        asked.difference_update(held)
        return asked


class Memo(dict):
    """A bounded cache: filled by `make`, emptied when full."""

    def __init__(self, make: Callable, bound: int):
        super().__init__()
        self.make, self.bound = make, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        self[key] = value = self.make(key)
        return value


#: At most this many keys can each hold more than 1/HOT_KEYS of the rows.
HOT_KEYS = 1000


def lookup(big: DataFrame, small: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join of `big` with `small` (unique, non-null `key`) without a hot task.

    `weight` is a column of `small`: how many rows of `big` carry the key. Keys
    that carry over 1/HOT_KEYS of all rows number HOT_KEYS at most; they are
    broadcast. The others are joined by a shuffle, which no key of theirs can skew.
    """
    total = small.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > total / HOT_KEYS
    heavy = small.where(hot).drop(weight)
    marked = big.where(F.col(key).isNotNull()).join(F.broadcast(heavy.select(key, F.lit(True).alias("_hot"))), key, "left")
    left = marked.where(F.col("_hot").isNull()).drop("_hot").join(small.where(~hot).drop(weight), key, "left")
    right = marked.where(F.col("_hot")).drop("_hot").join(F.broadcast(heavy), key)
    # Rows without a key find nothing and are not shuffled, as they would all meet in one task.
    alone = big.where(F.col(key).isNull()).select(*[F.col(f"`{c}`") for c in big.columns], *[F.lit(None).cast(small.schema[c].dataType).alias(c) for c in small.columns if c not in (key, weight)])
    return left.unionByName(right.select(*left.columns)).unionByName(alone.select(*left.columns))
