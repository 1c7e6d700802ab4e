"""File sources and sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators.grid import grid
from fieldspark.plans import registry
from fieldspark.sources import files


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, (3, 5, 3), dtype=np.uint8), rng.integers(0, 256, (2, 4, 1), dtype=np.uint8)
    (tmp_path / "a.ppm").write_bytes(b"P6\n# made\n5 3\n255\n" + a.tobytes())
    (tmp_path / "b.pgm").write_bytes(b"P5 4 2 255\n" + b.tobytes())
    rows = files.pixels(spark, str(tmp_path)).collect()
    assert {(r.img, r.x, r.y, r.c): r.v for r in rows} == {(n, x, y, c): int(i[y, x, c]) for n, i in (("a.ppm", a), ("b.pgm", b)) for y in range(i.shape[0]) for x in range(i.shape[1]) for c in range(i.shape[2])}
    assert files.flipped(files.pixels(spark, str(tmp_path / "b.pgm")), 2).where("y = 0").first().v == int(b[1, 0, 0])


def test_png_round_trip():
    rng = np.random.default_rng(3)
    for shape in ((4, 7, 1), (5, 3, 3)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (files.decode_png(files.encode_png(image)) == image).all()


def test_read_back_is_bounded(spark):
    assert len(files.read_back(spark.range(5), 5)) == 5
    with pytest.raises(ValueError, match="more than 4"):
        files.read_back(spark.range(5), 4)


def test_flags_and_parameters(spark):
    given = files.flags(["--seed", "7", "--freeze", "--T", "31", "--shot", "12"])
    assert given == {"seed": "7", "freeze": "1", "T": "31", "shot": "12"}
    row = files.run_parameters(spark, given).first()
    assert (row.seed, row.scene, row.time_of_day, row.shot, row.freeze) == (7, "terrain", 24.0, None, True)
    row = files.run_parameters(spark, {}).first()
    assert (row.seed, row.time_of_day, row.preset) == (1, 11.0, "high")


def test_sinks(spark, tmp_path):
    cells = grid(spark, 8).withColumn("h", F.col("x") * 1.5)
    files.write_raster(cells, str(tmp_path / "raster"), 4)
    back = spark.read.parquet(str(tmp_path / "raster"))
    assert back.where("tx = 1 and ty = 0").count() == 16 and back.count() == 64
    files.write_stats(cells, str(tmp_path / "stats"))
    assert files.read_stats(spark, str(tmp_path / "stats"), "x int, y int, h double").exceptAll(cells).isEmpty()


def test_stored_precision(spark):
    values = [0.0, 1.0, 271.13, -0.3333, 1234.5678, 6e-5]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", files.half(F.col("v")).alias("h")).collect()
    assert all(r.h == float(np.float16(r.v)) for r in rows if abs(r.v) > 6.2e-5 or r.v == 0)


def test_unknown_query_lists_known_ones():
    with pytest.raises(KeyError, match="q_quadtree"):
        registry.find("q_nothing")


def test_images_of_many_sizes_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(files, "BATCH_PIXELS", 50)
    rng = np.random.default_rng(9)
    images = {f"i{k}": rng.integers(0, 256, (int(rng.integers(1, 30)), int(rng.integers(1, 30)), (1, 3)[k % 2]), dtype=np.uint8) for k in range(60)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = spark.createDataFrame([(f"a/{n}", bytearray(files.encode_png(i))) for n, i in images.items()], "path string, content binary")
        again = files.png_files(files.decoded(rows)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(again) == 60 and all((files.decode_png(bytes(r.content)) == images[r.path]).all() for r in again)


def test_images_need_no_join_and_no_call_by_image(spark):
    """Seconds grew by some milliseconds an image, and pixels were sorted for a join."""
    image = files.decoded(spark.createDataFrame([("a", bytearray(b"P5 2 1 255\n" + bytes([3, 9])))], "path string, content binary"))
    far = files.heat(image, image.withColumn("x", 1 - F.col("x")).where("x = 0"))
    assert [tuple(r) for r in far.collect()] == [("a", 0, 0, 0, 6)]
    plan = files.png_files(far)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroups" not in plan
