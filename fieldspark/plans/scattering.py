"""Hashing, gated and weighted sampling, capped groups, splats and noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, noise
from ..functions.scalar import parse_pose, pick
from ..operators import scatter, spatial
from ..operators.grid import grid
from ..session import table
from . import sqltext as sql
from .registry import query

#: Salts of the gate and of the weighted pick, and the share of each biome that passes.
GATE, PICK = 0x1234F, 0x77E1
ACCEPT = (0.2, 0.8, 0.85, 0.3, 0.5, 0.65)
CAP = 150


def _case(column: str, values) -> str:
    return "CASE " + " ".join(f"WHEN {column} = {k} THEN {v}" for k, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"


_GATED = f"SELECT * FROM ({sql.pcg('SELECT *, user_id % 6 AS biome, event_id % 4096 AS cx, user_id % 4096 AS cy FROM events', 'cx', 'cy', GATE)}) WHERE u < {_case('biome', ACCEPT)} * 16777216"
_PICKED = sql.pcg(f"SELECT * EXCLUDE (u, v) FROM ({_GATED})", "cx", "cy", PICK)
_CLASSED = f"SELECT *, CASE WHEN u <= 6 * 1048576 THEN 0 WHEN u <= 6 * 1048576 + 5 * 1048576 THEN 1 WHEN u <= 14 * 1048576 THEN 2 ELSE 3 END AS cls FROM ({_PICKED})"


def scattered(events):
    """Events that pass their biome's gate, with a weighted class."""
    rows = events.withColumns({"biome": F.col("user_id") % 6, "cx": F.col("event_id") % 4096, "cy": F.col("user_id") % 4096})
    kept = scatter.gate(rows, F.col("cx"), F.col("cy"), GATE, pick(F.col("biome"), list(ACCEPT[:-1]), ACCEPT[-1]))
    draw = hashing.pcg2d(F.col("cx"), F.col("cy"), PICK)["u"]
    return kept.withColumn("cls", scatter.weighted_pick(draw, [F.lit(k * 1048576) for k in (6, 5, 3, 2)]))


@query(
    "q_scatter_capped_counts",
    f"""WITH placed AS (SELECT *, row_number() OVER (PARTITION BY biome, cls ORDER BY event_id) AS place FROM ({_CLASSED}))
SELECT biome, cls, count(*) AS drawn, least(count(*), {CAP}) AS reported, count(*) FILTER (place <= {CAP}) AS kept, sum(event_id) FILTER (place <= {CAP})::BIGINT AS id_sum FROM placed GROUP BY ALL""",
)
def scatter_capped_counts(spark, sf_dir):
    """SRC, H-5, P-5, W-6, A-1..A-3: gate, weighted class, cap per group, counts."""
    rows = scattered(table(spark, sf_dir, "events"))
    counts = rows.groupBy("biome", "cls").agg(F.count("*").alias("drawn"))
    kept = scatter.capped(rows.select("biome", "cls", "event_id"), ["biome", "cls"], ["event_id"], CAP).groupBy("biome", "cls").agg(F.count("*").alias("kept"), F.sum("event_id").alias("id_sum"))
    return counts.join(kept, ["biome", "cls"]).select("biome", "cls", "drawn", F.least("drawn", F.lit(CAP)).cast("long").alias("reported"), "kept", "id_sum")


@query("q_hash_lattice", sql.pcg("SELECT x - 128 AS x, y - 128 AS y FROM (" + sql.cells(256) + ")", "x", "y", 0x51F3))
def hash_lattice(spark, sf_dir):
    """SRC-3, H-5."""
    cells = grid(spark, 256).select((F.col("x") - 128).alias("x"), (F.col("y") - 128).alias("y"))
    return cells.withColumn("h", hashing.pcg2d(F.col("x"), F.col("y"), 0x51F3)).select("x", "y", "h.u", "h.v")


_FNV = f"list_reduce(list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT), lambda h, c: {sql.mul('xor(h, c)', 0x01000193)}, 2166136261::BIGINT)"
_PARTS = f"SELECT p_partkey, {_FNV} AS name_hash, p_partkey & {sql.MASK} AS mixed FROM part"


@query(
    "q_hash_fnv_fmix",
    sql.fmix(f"SELECT p_partkey, name_hash, mixed, xor({sql.mul('mixed0', 0x9E3779B1)}, {sql.mul('name_hash', 0x85EBCA77)}) AS sub_seed FROM (SELECT *, p_partkey & {sql.MASK} AS mixed0 FROM ({sql.fmix(_PARTS, 'mixed')}))", "sub_seed"),
)
def hash_fnv_fmix(spark, sf_dir):
    """H-1..H-3, SRC-5."""
    return table(spark, sf_dir, "part").select("p_partkey", hashing.fnv1a(F.col("p_name")).alias("name_hash"), hashing.fmix32(F.col("p_partkey")).alias("mixed"), hashing.sub_seed(F.col("p_partkey"), F.col("p_name")).alias("sub_seed"))


@query(
    "q_hash_streams",
    f"""WITH RECURSIVE l AS (SELECT n_nationkey, 0 AS k, n_nationkey::BIGINT AS s FROM nation UNION ALL SELECT n_nationkey, k + 1, (s * 1664525 + 1013904223) & {sql.MASK} FROM l WHERE k < 8)
SELECT n_nationkey, k - 1 AS k, s AS draw FROM l WHERE k > 0""",
)
def hash_streams(spark, sf_dir):
    """H-9: a sequential generator per key."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(hashing.lcg(F.col("n_nationkey"), 8)).alias("k", "draw"))


def _sfc_sql() -> str:
    """The generator's state step by step, for each nation's stream."""
    fnv = _FNV.replace("p_name", "n_name")
    seeded = sql.fmix(f"SELECT n_nationkey, xor({sql.mul('1', 0x9E3779B1)}, {sql.mul(fnv, 0x85EBCA77)}) AS seed FROM nation", "seed")
    state = f"SELECT n_nationkey, {', '.join(f'(seed + {k * 0x9E3779B9 & sql.MASK}) & {sql.MASK} AS {c}' for k, c in enumerate('abcd', 1))} FROM ({seeded})"
    for c in "abcd":
        state = sql.fmix(state, c)
    t = f"((a + b + d) & {sql.MASK})"
    step = f"xor(b, b >> 9), (c + (c << 3)) & {sql.MASK}, ((((c & 2047) << 21) | (c >> 11)) + {t}) & {sql.MASK}, (d + 1) & {sql.MASK}, {t}, k + 1"
    return f"""WITH RECURSIVE start AS ({state}), r AS (SELECT n_nationkey, a, b, c, d, 0::BIGINT AS t, 0 AS k FROM start UNION ALL SELECT n_nationkey, {step} FROM r WHERE k < 16),
l AS (SELECT n_nationkey, list(t ORDER BY k) FILTER (k > 8) AS l FROM r GROUP BY n_nationkey)
SELECT n_nationkey, array_to_string(l, ',') AS draws, round(sqrt(-2 * ln((l[1] + 0.5) / 4294967296.0)) * cos(2 * pi() * ((l[2] + 0.5) / 4294967296.0)), 6) AS normal FROM l"""


@query("q_rng_draws", _sfc_sql())
def rng_draws(spark, sf_dir):
    """H-4: eight draws of the seeded generator for every nation's named stream, and normal draws from pairs."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", hashing.sfc32(hashing.sub_seed(F.lit(1), F.col("n_name")), 8).alias("d"))
    unit = lambda k: (F.get("d", F.lit(k)) + 0.5) / 4294967296.0
    return rows.select("n_nationkey", F.array_join("d", ",").alias("draws"), F.round(hashing.gauss(unit(0), unit(1)), 6).alias("normal"))


def _noise_sql() -> str:
    """Value noise of two octaves, corner by corner, in CTE steps."""
    seeds = [5 + i * 0x9E37 for i in range(2)]
    ctes = [f"p AS (SELECT i, (i % 40) * 0.37 AS px, (i // 40) * 0.29 - 3.1 AS py, (i % 7) * 0.53 AS pz FROM range(1600) t(i))"]
    ctes.append("o AS (SELECT i, k, px * f AS x, py * f AS y, pz * f AS z, s FROM p, (VALUES " + ", ".join(f"({k}, {2.02 ** k!r}, {s}::BIGINT)" for k, s in enumerate(seeds)) + ") v(k, f, s))")
    ctes.append("c AS (SELECT i, k, s AS h, floor(x)::BIGINT + dx AS cx, floor(y)::BIGINT + dy AS cy, floor(z)::BIGINT + dz AS cz, x - floor(x) AS fx, y - floor(y) AS fy, z - floor(z) AS fz, dx, dy, dz FROM o, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy), (VALUES (0), (1)) d(dz))")
    source = sql.fmix("SELECT * FROM c", "h")
    for axis, k in (("cx", 0x27D4EB2F), ("cy", 0x165667B1), ("cz", 0x9E3779B1)):
        masked = f"({axis} & {sql.MASK})"
        source = sql.fmix(f"SELECT * REPLACE (xor(h, {sql.mul(masked, k)}) AS h) FROM ({source})", "h")
    w = " * ".join(f"CASE WHEN d{a} = 1 THEN f{a} * f{a} * (3 - 2 * f{a}) ELSE 1 - f{a} * f{a} * (3 - 2 * f{a}) END" for a in "xyz")
    return f"WITH {', '.join(ctes)}, n AS (SELECT i, k, sum(h / 4294967296.0 * {w}) * 2 - 1 AS v FROM ({source}) GROUP BY i, k) SELECT i, round(sum(v * CASE k WHEN 0 THEN 0.5 ELSE 0.25 END) / 0.75, 5) AS fbm FROM n GROUP BY i"


@query("q_noise_value_fbm", _noise_sql())
def noise_value_fbm(spark, sf_dir):
    """N-1, N-2, N-5, H-8."""
    i = F.col("id")
    p = spark.range(1600).select(i.alias("i"), ((i % 40) * 0.37).alias("x"), (F.floor(i / 40) * 0.29 - 3.1).alias("y"), ((i % 7) * 0.53).alias("z"))
    return p.select("i", F.round(noise.fbm3(F.col("x"), F.col("y"), F.col("z"), 5, octaves=2), 5).alias("fbm"))


_PLACES = "SELECT i, (i % 20) * 0.31::DOUBLE AS x, (i // 20) * 0.27::DOUBLE AS y, 0.5::DOUBLE AS z FROM range(400) t(i)"
_RIDGE = sql.value_noise("SELECT * FROM (" + sql.fmix(f"SELECT *, 3::BIGINT AS s FROM ({_PLACES})", "s") + ")", "i")
_MOVES = sql.value_noise(f"SELECT i, k, x + k * 31 AS x, y, z + (1 - k) * 17 AS z, 9::BIGINT AS s FROM ({_PLACES}), range(2) t(k)", "i, k")
_WARP = f"SELECT i, x + 0.4 * max(v) FILTER (k = 0) AS x, y + 0.4 * max(v) FILTER (k = 1) AS y, z, 9::BIGINT AS s FROM ({_PLACES}) JOIN ({_MOVES}) USING (i) GROUP BY i, x, y, z"


@query("q_noise_ridged_warp", f"SELECT i, round((1 - abs(r.v)) * (1 - abs(r.v)), 5) AS ridged, round(w.v, 5) AS warped FROM ({_RIDGE}) r JOIN ({sql.value_noise(_WARP, 'i')}) w USING (i)")
def noise_ridged_warp(spark, sf_dir):
    """N-3, N-4: ridged noise and a warped place, on a lattice."""
    i = F.col("id")
    p = spark.range(400).select(i.alias("i"), ((i % 20) * 0.31).alias("x"), (F.floor(i / 20) * 0.27).alias("y"), F.lit(0.5).alias("z"))
    base = lambda x, y, z: noise.value_noise3(x, y, z, F.lit(9))
    found = noise.warped(p, base, "x", "y", "z", 0.4, "warped")
    return found.select("i", F.round(noise.ridged3(F.col("x"), F.col("y"), F.col("z"), 3, octaves=1), 5).alias("ridged"), F.round("warped", 5).alias("warped"))


@query(
    "q_parse_pose",
    """WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat_ws(',', user_id, event_id, 3.5, 1) WHEN 1 THEN concat_ws(',', user_id, 'x', 3, 4, 5) ELSE concat_ws(',', user_id, event_id % 100, -2.5, event_id % 7, 0.25, 60) END AS pose FROM events),
p AS (SELECT event_id, list_transform(string_split(pose, ','), lambda s: try_cast(trim(s) AS DOUBLE)) AS v FROM t)
SELECT event_id, len(v) >= 5 AND len(list_filter(v, lambda x: x IS NULL)) = 0 AS valid, CASE WHEN len(v) >= 5 AND len(list_filter(v, lambda x: x IS NULL)) = 0 THEN v[1] END AS px, CASE WHEN len(v) >= 5 AND len(list_filter(v, lambda x: x IS NULL)) = 0 THEN v[6] END AS fov FROM p""",
)
def parse_pose_rows(spark, sf_dir):
    """SRC-2: pose strings, null where they are short or not numbers."""
    e, n = F.col("event_id"), F.col("user_id")
    text = F.when(e % 5 == 0, F.concat_ws(",", n, e, F.lit("3.5"), F.lit("1"))).when(e % 5 == 1, F.concat_ws(",", n, F.lit("x,3,4,5"))).otherwise(F.concat_ws(",", n, e % 100, F.lit("-2.5"), e % 7, F.lit("0.25,60")))
    rows = table(spark, sf_dir, "events").select("event_id", parse_pose(text).alias("v"))
    return rows.select("event_id", F.col("v").isNotNull().alias("valid"), F.get("v", F.lit(0)).alias("px"), F.get("v", F.lit(5)).alias("fov"))


@query(
    "q_case_biome",
    f"""WITH b AS (SELECT p_partkey, CASE WHEN p_retailprice > 1800 THEN 0 WHEN p_retailprice > 1650 THEN 1 WHEN p_size > 36 AND p_retailprice < 1300 THEN 5 WHEN p_partkey % 7 > 3 THEN 3 WHEN p_size < 20 THEN 4 ELSE 2 END AS biome FROM part)
SELECT p_partkey, biome, ({_case('biome', (0.0, 0.22, 0.8, 0.85, 0.06, 0.26))})::DOUBLE AS density FROM b""",
)
def case_biome(spark, sf_dir):
    """P-6, P-7: a decision tree in priority order, then a lookup by a small id."""
    price, size = F.col("p_retailprice"), F.col("p_size")
    tree = F.when(price > 1800, 0).when(price > 1650, 1).when((size > 36) & (price < 1300), 5).when(F.col("p_partkey") % 7 > 3, 3).when(size < 20, 4).otherwise(2)
    return table(spark, sf_dir, "part").select("p_partkey", tree.alias("biome")).withColumn("density", pick(F.col("biome"), [0.0, 0.22, 0.8, 0.85, 0.06], 0.26))


EDGES = ((0.0, 30.0), (26.0, 70.0), (60.0, 141.5))


@query(
    "q_bands_overlap",
    """WITH d AS (SELECT c_custkey, sqrt((c_custkey % 101) * (c_custkey % 101) + (c_nationkey * 4) * (c_nationkey * 4)) AS d FROM customer),
b AS (SELECT c_custkey, d, band FROM d JOIN (VALUES (0, 0.0, 30.0), (1, 26.0, 70.0), (2, 60.0, 141.5)) v(band, lo, hi) ON d >= lo AND d < hi)
SELECT band, count(*) AS n, count(DISTINCT c_custkey) AS customers, sum(c_custkey)::BIGINT AS id_sum, count(*) FILTER (d BETWEEN 10 AND 40) AS annulus FROM b GROUP BY band""",
)
def bands_overlap(spark, sf_dir):
    """P-8, P-11: one row may enter two bands."""
    a, b = F.col("c_custkey") % 101, F.col("c_nationkey") * 4
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.sqrt((a * a + b * b).cast("double")).alias("d"))
    hit = rows.select("c_custkey", "d", F.explode(scatter.bands(F.col("d"), EDGES)).alias("band"))
    return hit.groupBy("band").agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("customers"), F.sum("c_custkey").alias("id_sum"), F.count_if(F.col("d").between(10, 40)).alias("annulus"))


PLANES = ((1.0, 0.0, 0.0, -5.0), (-1.0, 0.0, 0.0, 40.0), (0.0, 1.0, 0.0, -0.02), (0.0, -1.0, 0.0, 0.08), (0.0, 0.0, 1.0, -0.01), (0.0, 0.0, -1.0, 0.07))


@query(
    "q_halfspace_filter",
    "SELECT l_returnflag, count(*) AS n, sum(l_orderkey)::BIGINT AS id_sum FROM lineitem WHERE "
    + " AND ".join(f"({d} + l_quantity * {a} + l_discount * {b} + l_tax * {c}) > -0.005" for a, b, c, d in PLANES)
    + " GROUP BY l_returnflag",
)
def halfspace_filter(spark, sf_dir):
    """P-9: all six planes; column pruning leaves four columns of the scan."""
    rows = table(spark, sf_dir, "lineitem")
    inside = spatial.halfspaces([F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")], PLANES, F.lit(0.005))
    return rows.where(inside).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("id_sum"))


@query(
    "q_complement_partition",
    f"""WITH h AS ({sql.pcg('SELECT doc_id, n_chars FROM documents', 'doc_id % 8192', 'doc_id // 8192', 0x5EED)}), f AS (SELECT *, least(greatest(n_chars / 4000.0, 0), 1) AS fade FROM h)
SELECT count(*) AS n, count(*) FILTER (u < fade * 16777216) AS outer_ring, count(*) FILTER (u >= 16777216 - (1 - fade) * 16777216) AS inner_ring FROM f""",
)
def complement_partition(spark, sf_dir):
    """P-13: a dithered fade splits rows exactly in two."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.least(F.greatest(F.col("n_chars") / 4000.0, F.lit(0.0)), F.lit(1.0)).alias("fade"))
    u = hashing.pcg2d(F.col("doc_id") % 8192, F.floor(F.col("doc_id") / 8192), 0x5EED)["u"]
    held = rows.withColumn("u", u)
    return held.agg(F.count("*").alias("n"), F.count_if(F.col("u") < F.col("fade") * 16777216).alias("outer_ring"), F.count_if(F.col("u") >= 16777216 - (1 - F.col("fade")) * 16777216).alias("inner_ring"))


@query(
    "q_pack_unpack",
    "SELECT packed, (packed >> 16) & 65535 AS hi, packed & 65535 AS lo, cls // 8 AS cls, cls % 8 AS variant, n FROM (SELECT ((l_partkey % 65536) << 16) | (l_suppkey % 65536) AS packed, (l_linenumber * 8 + l_orderkey % 8) AS cls, count(*) AS n FROM lineitem GROUP BY ALL)",
)
def pack_unpack(spark, sf_dir):
    """P-18: packed keys and back."""
    packed = F.shiftleft(F.col("l_partkey") % 65536, 16).bitwiseOR(F.col("l_suppkey") % 65536)
    rows = table(spark, sf_dir, "lineitem").select(packed.alias("packed"), (F.col("l_linenumber") * 8 + F.col("l_orderkey") % 8).alias("c")).groupBy("packed", "c").agg(F.count("*").alias("n"))
    return rows.select("packed", F.shiftright("packed", 16).bitwiseAND(F.lit(65535)).alias("hi"), F.col("packed").bitwiseAND(F.lit(65535)).alias("lo"), F.floor(F.col("c") / 8).alias("cls"), (F.col("c") % 8).alias("variant"), "n")


@query(
    "q_splat_fixed_point",
    """WITH p AS (SELECT p_partkey % 64 AS px, (p_partkey * 7) % 64 AS py, p_size / 64.0 AS s FROM part),
c AS (SELECT px + dx AS x, py + dy AS y, floor(s * 255 * greatest(0.0::DOUBLE, 1.0::DOUBLE - (dx * dx + dy * dy) / 16.0))::BIGINT AS share FROM p, range(-3, 4) a(dx), range(-3, 4) b(dy))
SELECT x, y, sum(share)::BIGINT AS amount FROM c WHERE share > 1 AND x BETWEEN 0 AND 63 AND y BETWEEN 0 AND 63 GROUP BY x, y""",
)
def splat_fixed_point(spark, sf_dir):
    """A-4, A-5: 7 x 7 fixed-point splats, summed per cell."""
    points = table(spark, sf_dir, "part").select((F.col("p_partkey") % 64).alias("a"), (F.col("p_partkey") * 7 % 64).alias("b"), (F.col("p_size") / 64.0).alias("s"))
    return scatter.splat(points, F.col("a"), F.col("b"), F.col("s"), 3, 64)
