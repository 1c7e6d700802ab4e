"""Image, configuration and flag sources, and the matching sinks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_netpbm(data: bytes) -> np.ndarray:
    """(height, width, channels) of a binary PGM or PPM image of 8 bits."""
    fields, at = [], 0
    while len(fields) < 4:
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        word = data[at:end]
        if word.startswith(b"#"):
            at = data.index(b"\n", at) + 1
            continue
        if word:
            fields.append(word)
        at = end + 1
    channels = {b"P5": 1, b"P6": 3}[fields[0]]
    width, height = int(fields[1]), int(fields[2])
    return np.frombuffer(data, np.uint8, width * height * channels, at).reshape(height, width, channels)


#: Pixels that one batch of rows holds, about; a larger image is a batch of its own.
BATCH_PIXELS = 1 << 19


def decoded(images: DataFrame) -> DataFrame:
    """(img, x, y, c, v) of images (path, content); an image is one task's row, never the driver's."""

    def rows(names: list[str], found: list[np.ndarray], places: dict) -> pa.RecordBatch:
        for image in found:
            if image.shape not in places:
                y, x, c = np.indices(image.shape, np.int32)
                places[image.shape] = x.ravel(), y.ravel(), c.ravel()
        x, y, c = (np.concatenate([places[image.shape][k] for image in found]) for k in range(3))
        img = pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(found)), [image.size for image in found])))
        v = np.concatenate([image.ravel() for image in found]).astype(np.int32)
        return pa.RecordBatch.from_arrays([img, *map(pa.array, (x, y, c, v))], names=["img", "x", "y", "c", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found, held, places = [], [], 0, {}
            for name, data in zip(batch.column(0), batch.column(1)):
                data = data.as_py()
                image = decode_png(data) if data[:4] == b"\x89PNG" else decode_netpbm(data)
                if held and held + image.size > BATCH_PIXELS:
                    yield rows(names, found, places)
                    names, found, held, places = [], [], 0, {}
                names.append(name.as_py().rsplit("/", 1)[-1])
                found.append(image)
                held += image.size
            if found:
                yield rows(names, found, places)

    return images.select("path", "content").mapInArrow(run, "img string, x int, y int, c int, v int")


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """The pixels of all images under a path."""
    return decoded(spark.read.format("binaryFile").load(path))


def read_back(frame: DataFrame, most: int) -> list:
    """All rows on the driver, of which there may be `most`; one more is an error, so a table is never gathered by mistake."""
    rows = frame.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows to read back")
    return rows


def encode_png(image: np.ndarray) -> bytes:
    """A PNG file of (height, width) or (height, width, 3) bytes."""
    image = image if image.ndim == 3 else image[:, :, None]
    height, width, channels = image.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, width * channels).astype(np.uint8)], 1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels) of an unfiltered, not interlaced 8-bit PNG file of grey or RGB."""
    at, packed, head = 8, b"", ()
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        packed += body if kind == b"IDAT" else b""
        at += 12 + size
    channels = {0: 1, 2: 3}[head[3]]
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(head[1], 1 + head[0] * channels)
    if head[2] != 8 or head[6] or lines[:, 0].any():
        raise ValueError("only unfiltered 8-bit images are read")
    return lines[:, 1:].reshape(head[1], head[0], channels)


def png_files(pixels_: DataFrame) -> DataFrame:
    """(path, content) of images given by their pixels (img, x, y, c, v); an image is one task's, and its rows stand together."""

    def images(table: pa.Table) -> pa.RecordBatch:
        x, y, c, v = (table.column(k).to_numpy() for k in ("x", "y", "c", "v"))
        name = table.column("img").combine_chunks()
        cuts = np.r_[np.flatnonzero(np.r_[True, changes(name)]), len(name)]
        files_ = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            image = np.zeros((y[a:b].max() + 1, x[a:b].max() + 1, c[a:b].max() + 1), np.uint8)
            image[y[a:b], x[a:b], c[a:b]] = v[a:b]
            files_.append(encode_png(image))
        return pa.RecordBatch.from_arrays([name.take(pa.array(cuts[:-1])), pa.array(files_, pa.binary())], names=["path", "content"])

    def changes(name: pa.Array) -> np.ndarray:
        """Where a row's name is another than that before, from the second row on."""
        return pc.fill_null(pc.not_equal(name[1:], name[:-1]), True).to_numpy(zero_copy_only=False) if name.null_count == 0 else np.array([a != b for a, b in zip(name[1:].to_pylist(), name[:-1].to_pylist())], bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last image may go on in the next batch.
            name = batch.column(0)
            new = np.flatnonzero(changes(name)) + 1
            if held and held[-1].column(0)[-1].as_py() != name[0].as_py():
                yield images(pa.Table.from_batches(held))
                held = []
            if len(new):
                yield images(pa.Table.from_batches([*held, batch.slice(0, int(new[-1]))]))
                held = [batch.slice(int(new[-1]))]
            else:
                held.append(batch)
        if held:
            yield images(pa.Table.from_batches(held))

    return pixels_.select("img", "x", "y", "c", "v").repartition("img").sortWithinPartitions("img").mapInArrow(run, "path string, content binary")


def side_by_side(left: DataFrame, right: DataFrame, width: int, gutter: int = 12) -> DataFrame:
    """Two images of one name as one, the second beyond a gutter."""
    return left.unionByName(right.withColumn("x", F.col("x") + width + gutter))


def heat(left: DataFrame, right: DataFrame) -> DataFrame:
    """How far apart two images of one name are, pixel by pixel; a pixel that one lacks is left out."""
    keys = ["img", "x", "y", "c"]
    one = left.select(*keys, F.col("v").alias("a"), F.lit(None).cast("int").alias("b"))
    two = right.select(*keys, F.lit(None).cast("int").alias("a"), F.col("v").alias("b"))
    # Dealt by image, so that what follows finds an image's rows in one task.
    both = one.unionByName(two).repartition("img").groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.where("a IS NOT NULL AND b IS NOT NULL").select(*keys, F.abs(F.col("a") - F.col("b")).alias("v"))


def flipped(frame: DataFrame, height: int) -> DataFrame:
    """Rows counted from the other end."""
    return frame.withColumn("y", F.lit(height - 1) - F.col("y"))


def flags(words: Sequence[str]) -> dict[str, str]:
    """`--key value` and bare `--key` (which means "1")."""
    out, k = {}, 0
    while k < len(words):
        if words[k].startswith("--"):
            valued = k + 1 < len(words) and not words[k + 1].startswith("--")
            out[words[k][2:]] = words[k + 1] if valued else "1"
            k += valued
        k += 1
    return out


def run_parameters(spark: SparkSession, given: dict[str, str]) -> DataFrame:
    """One row of typed run parameters with their defaults; the hour is clamped, a shot is 1..9 or null."""
    row = spark.createDataFrame([(given,)], "m map<string,string>")
    return row.select(*parameters(F.col("m")))


def query_map(text: Column) -> Column:
    """The keys and values of `?a=1&b=2`; a bare key means "1"."""
    pairs = F.filter(F.split(F.regexp_replace(text, "^[?]", ""), "&"), lambda p: p != "")
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.element_at(F.split(p, "="), 1).alias("k"), F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("1").alias("v"))))


def parameters(given: Column) -> list[Column]:
    """Typed run parameters out of a map, with their defaults; the hour is clamped, a shot is 1..9 or null."""
    at = lambda key: F.get(F.map_values(F.map_filter(given, lambda k, v: k == key)), F.lit(0))
    shot = at("shot").try_cast("int")
    return [
        F.coalesce(at("seed").try_cast("bigint"), F.lit(1)).alias("seed"),
        F.coalesce(at("scene"), F.lit("terrain")).alias("scene"),
        F.least(F.greatest(F.coalesce(at("T").try_cast("double"), F.lit(11.0)), F.lit(0.0)), F.lit(24.0)).alias("time_of_day"),
        F.coalesce(at("preset"), F.lit("high")).alias("preset"),
        F.when(shot.between(1, 9), shot).alias("shot"),
        (F.coalesce(at("freeze"), F.lit("0")) == "1").alias("freeze"),
    ]


def write_stats(frame: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    frame.write.mode("overwrite").json(path)


def read_stats(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_raster(frame: DataFrame, path: str, tile: int = 256) -> None:
    """A raster by tiles, so that a region's scan reads its own folders only."""
    keyed = frame.withColumns({"tx": F.floor(F.col("x") / tile).cast("int"), "ty": F.floor(F.col("y") / tile).cast("int")})
    keyed.repartition("tx", "ty").write.mode("overwrite").partitionBy("tx", "ty").parquet(path)


def half(value):
    """Rounded to the steps of an 11-bit significand, as 16-bit floats store it (normal range)."""
    exponent = F.floor(F.log2(F.abs(value)))
    step = F.pow(F.lit(2.0), exponent - 10)
    return F.when(value == 0, 0.0).otherwise(F.rint(value / step) * step)


def unorm8(value):
    """Rounded to 255ths."""
    return F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5) / 255
