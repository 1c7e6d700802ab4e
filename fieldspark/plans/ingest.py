"""Parameters, images, stored buffers, statistics and lookups by name."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.grid import grid
from ..session import shared_dir, stored, table
from ..sources import files
from . import registry
from .registry import query

_TEXT = "'?seed=' || (event_id % 50) || CASE WHEN event_id % 3 = 0 THEN '&T=' || (event_id % 40) ELSE '' END || CASE WHEN event_id % 2 = 0 THEN '&shot=' || (event_id % 13) ELSE '' END || CASE WHEN event_id % 7 = 0 THEN '&freeze' ELSE '' END"


@query(
    "q_run_parameters",
    f"""WITH t AS (SELECT event_id, {_TEXT} AS q FROM events), p AS (SELECT event_id, try_cast(regexp_extract(q, 'seed=([0-9]+)', 1) AS BIGINT) AS seed, try_cast(regexp_extract(q, 'T=([0-9]+)', 1) AS DOUBLE) AS t, try_cast(regexp_extract(q, 'shot=([0-9]+)', 1) AS INTEGER) AS shot, contains(q, 'freeze') AS frozen FROM t)
SELECT event_id, coalesce(seed, 1) AS seed, 'terrain' AS scene, least(greatest(coalesce(t, 11.0), 0), 24) AS time_of_day, 'high' AS preset, CASE WHEN shot BETWEEN 1 AND 9 THEN shot END AS shot, frozen AS "freeze" FROM p""",
)
def run_parameters(spark, sf_dir):
    """SRC-1: typed parameters with defaults out of a search string, for every row."""
    e = F.col("event_id")
    part = lambda by, text: F.when(e % by == 0, text).otherwise("")
    text = F.concat(F.lit("?seed="), e % 50, part(3, F.concat(F.lit("&T="), e % 40)), part(2, F.concat(F.lit("&shot="), e % 13)), part(7, F.lit("&freeze")))
    return table(spark, sf_dir, "events").select("event_id", files.query_map(text).alias("m")).select("event_id", *files.parameters(F.col("m")))


def digests(spark, sf_dir):
    """An image of 8 x 4 pixels for each document, made of its digest."""
    header = F.encode(F.lit("P5\n8 4\n255\n"), "utf-8")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(header, F.encode(F.md5(F.col("text").cast("binary")), "utf-8")).alias("content"))


@query(
    "q_image_pixels",
    "SELECT doc_id::VARCHAR AS img, (k % 8)::INTEGER AS x, (3 - k // 8)::INTEGER AS y, ascii(substr(md5(text), (k + 1)::INTEGER, 1)) AS v FROM documents, range(32) t(k)",
)
def image_pixels(spark, sf_dir):
    """SRC-8, SNK-3: images of 8 x 4 pixels, one made of each document's digest, decoded and with their rows flipped."""
    return files.flipped(files.decoded(digests(spark, sf_dir)), 4).select("img", "x", "y", "v")


_CODE = "ascii(substr(md5(text), (8 * {row} + {column} + 1)::INTEGER, 1))"


@query(
    "q_image_heat",
    f"""WITH k AS (SELECT doc_id::VARCHAR AS img, (k % 8)::INTEGER AS x, (k // 8)::INTEGER AS y, text FROM documents, range(32) t(k))
SELECT img, x, y, {_CODE.format(row="y", column="x")} AS v FROM k UNION ALL SELECT img, x + 20 AS x, y, abs({_CODE.format(row="y", column="x")} - {_CODE.format(row="(3 - y)", column="x")}) AS v FROM k UNION ALL SELECT DISTINCT img, x + 8 AS x, y, 0 AS v FROM k UNION ALL SELECT DISTINCT img, x + 16 AS x, y, 0 AS v FROM k WHERE x < 4""",
)
def image_heat(spark, sf_dir):
    """SNK-5, U-5: each image beside how far it is from its flipped self, written as PNG files and read again."""
    image = stored(files.decoded(digests(spark, sf_dir)), "pixels")
    both = files.side_by_side(image, files.heat(image, files.flipped(image, 4)), 8)
    written = stored(files.png_files(both), "png")
    return files.decoded(written).select("img", "x", "y", "v")


@query("q_stats_round_trip", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stats_round_trip(spark, sf_dir):
    """SRC-9, SNK-4: statistics written as JSON, probed and read again."""
    path = f"{shared_dir(spark)}/stats-{uuid.uuid4().hex}"
    files.write_stats(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")), path)
    return files.read_stats(spark, path, "event_type string, n long, total double")


@query("q_stored_buffer", "SELECT user_id, n, total FROM (SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id) ORDER BY n DESC, user_id LIMIT 10")
def stored_buffer(spark, sf_dir):
    """SRC-6, SNK-2: an intermediate table in the shared folder, of which a bounded part is read back."""
    buffer = stored(table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")), "buffer")
    rows = files.read_back(buffer.orderBy(F.desc("n"), "user_id").limit(10), 10)
    return spark.createDataFrame(rows, buffer.schema)


WORDS = ("--scene", "forest", "--freeze", "--T", "17.5", "ignored", "--out", "shot.png", "--dry")


@query("q_flag_rows", "SELECT * FROM (VALUES ('scene', 'forest'), ('freeze', '1'), ('T', '17.5'), ('out', 'shot.png'), ('dry', '1')) t(flag, value)")
def flag_rows(spark, sf_dir):
    """SRC-10: `--key value` and bare `--key`."""
    return spark.createDataFrame(list(files.flags(WORDS).items()), "flag string, value string")


#: Sources by name, each of which makes a small table.
SCENES = {"flat": lambda spark: grid(spark, 4).withColumn("h", F.lit(0)), "ramp": lambda spark: grid(spark, 4).withColumn("h", F.col("x"))}


@query("q_registry_lookup", "SELECT * FROM (VALUES ('flat', 16, 0, NULL), ('ramp', 16, 24, NULL), ('cave', NULL, NULL, 'no scene ''cave''; known: flat, ramp')) t(name, cells, total, message)")
def registry_lookup(spark, sf_dir):
    """J-19, X-3: scenes by name; a miss lists the known ones."""
    rows = []
    for name in ("flat", "ramp", "cave"):
        try:
            found = registry.choose(SCENES, name, "scene")(spark).agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
            rows.append((name, found.n, found.s, None))
        except KeyError as error:
            rows.append((name, None, None, error.args[0]))
    return spark.createDataFrame(rows, "name string, cells int, total int, message string")
