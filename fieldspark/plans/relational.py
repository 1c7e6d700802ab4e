"""Joins, aggregates, top-k and set operators over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics, scatter
from ..session import table
from .registry import query


@query(
    "q_dim_join",
    """WITH g AS (SELECT p_brand AS brand, s_nationkey AS nation, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
SELECT brand, nation, n, least(n, 40) AS capped, round(qty, 2) AS qty FROM g""",
)
def dim_join(spark, sf_dir):
    """J-5..J-7: fact to dimensions, then counts clamped by a cap; sides are broadcast by their size or else shuffled."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    joined = rows.join(part, rows.l_partkey == part.p_partkey).join(supplier, rows.l_suppkey == supplier.s_suppkey)
    return joined.groupBy("brand", "nation").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")).withColumn("capped", F.least("n", F.lit(40)).cast("long"))


@query(
    "q_pixel_diff",
    """WITH a AS (SELECT l_orderkey, l_linenumber, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey, l_linenumber, avg(l_quantity + l_linenumber * 4 - 10) AS v FROM lineitem GROUP BY ALL)
SELECT count(*) AS cells, count(*) FILTER (abs(a.v - b.v) > 9) AS changed, round(avg(abs(a.v - b.v)), 6) AS mean_delta FROM a JOIN b USING (l_orderkey, l_linenumber)""",
)
def pixel_diff(spark, sf_dir):
    """J-14, A-24: two images joined by position; both sides share one partitioning."""
    rows = table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    a = rows.groupBy(*keys).agg(F.avg("l_quantity").alias("v"))
    b = rows.groupBy(*keys).agg(F.avg(F.col("l_quantity") + F.col("l_linenumber") * 4 - 10).alias("v"))
    return metrics.pixel_difference(a, b, keys, "v", 9.0).withColumn("mean_delta", F.round("mean_delta", 6))


@query(
    "q_label_fallback",
    "SELECT event_id, coalesce(c_mktsegment, 'event ' || regexp_replace(event_id::VARCHAR, '0+$', '')) AS label FROM events LEFT JOIN customer ON c_custkey = event_id",
)
def label_fallback(spark, sf_dir):
    """J-16: a left join with a label made from the key where no customer has the event's number."""
    events = table(spark, sf_dir, "events").select("event_id")
    labels = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    other = F.concat(F.lit("event "), F.regexp_replace(F.col("event_id").cast("string"), "0+$", ""))
    return events.join(labels, events.event_id == labels.c_custkey, "left").select("event_id", F.coalesce("c_mktsegment", other).alias("label"))


@query("q_anti_keys", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def anti_keys(spark, sf_dir):
    """J-21, J-22, U-4."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    fresh = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return customers.join(fresh, "c_custkey", "left_anti")


@query(
    "q_embedding_bilinear_blend",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e, len(embedding) // 4 AS n, (vec_id % 10) / 10.0::DOUBLE AS fx, (label % 4) / 4.0::DOUBLE AS fy FROM embeddings),
t AS (SELECT vec_id, k, (1 - fx) * (1 - fy) * e[4 * k + 1] + fx * (1 - fy) * e[4 * k + 2] + (1 - fx) * fy * e[4 * k + 3] + fx * fy * e[4 * k + 4] AS b FROM e, LATERAL (SELECT unnest(range(n)) AS k))
SELECT vec_id, round(sum(b), 4) AS blended, round(max(b), 5) AS top FROM t GROUP BY vec_id""",
)
def embedding_blend(spark, sf_dir):
    """J-20: a four-tile blend of every four components of the whole vector."""
    fx, fy = (F.col("vec_id") % 10) / 10.0, (F.col("label") % 4) / 4.0
    wide = F.col("embedding").cast("array<double>")
    weights = (1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy
    blend = lambda k: sum((w * F.get(wide, (4 * k + j).cast("int")) for j, w in enumerate(weights)), F.lit(0.0))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 4) - 1), blend).alias("b"))
    return rows.select("vec_id", F.round(F.aggregate("b", F.lit(0.0), lambda a, x: a + x), 4).alias("blended"), F.round(F.array_max("b"), 5).alias("top"))


@query("q_log_average", "SELECT l_returnflag, round(exp(sum((8 - l_linenumber) * ln(greatest(l_extendedprice, 1e-4))) / sum(8 - l_linenumber)), 2) AS log_mean FROM lineitem GROUP BY l_returnflag")
def log_average(spark, sf_dir):
    """A-12: a weighted geometric mean."""
    weight = 8 - F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_returnflag").agg(F.round(F.exp(F.sum(weight * F.log(F.greatest("l_extendedprice", F.lit(1e-4)))) / F.sum(weight)), 2).alias("log_mean"))


@query(
    "q_bucket_sums",
    "SELECT l_linestatus, count(*) FILTER (l_quantity < 10) AS small, count(*) FILTER (l_quantity BETWEEN 10 AND 30) AS medium, count(*) FILTER (l_quantity > 30) AS large, round(sum(l_quantity * l_linenumber), 2) AS weighted, min(l_extendedprice) AS low, max(l_extendedprice) AS high, max(l_extendedprice) FILTER (l_orderkey % 7 = 0) AS strided_high, round(max(sqrt(l_quantity * l_quantity + l_tax * l_tax)), 6) AS reach FROM lineitem GROUP BY l_linestatus",
)
def bucket_sums(spark, sf_dir):
    """A-13..A-16, A-31."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        F.count_if(q < 10).alias("small"),
        F.count_if(q.between(10, 30)).alias("medium"),
        F.count_if(q > 30).alias("large"),
        F.round(F.sum(q * F.col("l_linenumber")), 2).alias("weighted"),
        F.min("l_extendedprice").alias("low"),
        F.max("l_extendedprice").alias("high"),
        F.max(F.when(F.col("l_orderkey") % 7 == 0, F.col("l_extendedprice"))).alias("strided_high"),
        F.round(F.max(F.sqrt(q * q + F.col("l_tax") * F.col("l_tax"))), 6).alias("reach"),
    )


@query(
    "q_newest_partition_sum",
    """WITH o AS (SELECT *, max(month(o_orderdate)) OVER (PARTITION BY o_orderstatus) AS newest FROM orders), r AS (SELECT * FROM o WHERE month(o_orderdate) = newest)
SELECT o_orderstatus, coalesce(o_orderpriority, 'total') AS label, round(sum(o_totalprice), 2) AS total FROM r GROUP BY ROLLUP (o_orderstatus, o_orderpriority) HAVING o_orderstatus IS NOT NULL""",
)
def newest_partition_sum(spark, sf_dir):
    """A-17: only the newest version of each kind, with its total."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.month("o_orderdate").alias("version"), F.col("o_orderpriority").alias("label"), "o_totalprice")
    return metrics.newest_partition_sum(rows, "o_orderstatus", "version", "label", F.col("o_totalprice"), "total").withColumn("total", F.round("total", 2))


@query(
    "q_transmittance",
    "SELECT l_orderkey, l_linenumber, l_partkey, round(exp(-coalesce(sum(l_discount * l_quantity / 20) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 5) AS clear FROM lineitem",
)
def transmittance(spark, sf_dir):
    """A-26, W-10: front-to-back accumulation."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_quantity")
    found = metrics.ordered_transmittance(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], F.col("l_discount") * F.col("l_quantity") / 20, "clear")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", F.round("clear", 5).alias("clear"))


@query(
    "q_conditional_mean",
    "SELECT l_suppkey, round(avg(l_quantity) FILTER (l_discount < 0.05), 5) AS near_mean, round(CASE WHEN sum(exp(-abs(l_tax - 0.04) * 40)) > 12 THEN sum(l_quantity * exp(-abs(l_tax - 0.04) * 40)) / sum(exp(-abs(l_tax - 0.04) * 40)) ELSE avg(l_quantity) END, 5) AS guided FROM lineitem GROUP BY l_suppkey",
)
def conditional_mean(spark, sf_dir):
    """A-27, A-28: a filtered mean, and a weighted one that falls back to the plain mean."""
    weight, q = F.exp(-F.abs(F.col("l_tax") - 0.04) * 40), F.col("l_quantity")
    guided = F.when(F.sum(weight) > 12, F.sum(q * weight) / F.sum(weight)).otherwise(F.avg(q))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(F.when(F.col("l_discount") < 0.05, q)), 5).alias("near_mean"), F.round(guided, 5).alias("guided"))


@query(
    "q_direction_moments",
    "WITH d AS (SELECT k, 1 - (2 * k + 1) / 16.0::DOUBLE AS y, sqrt(1 - power(1 - (2 * k + 1) / 16.0::DOUBLE, 2)) AS r, k * pi() * (3 - sqrt(5::DOUBLE)) AS t FROM range(16) t(k)) SELECT s_suppkey, round(sum(greatest(y, 0) * s_acctbal), 2) AS c0, round(sum(greatest(y, 0) * s_acctbal * r * cos(t)), 2) AS cx, round(sum(greatest(y, 0) * s_acctbal * y), 2) AS cy FROM supplier, d GROUP BY s_suppkey",
)
def direction_moments(spark, sf_dir):
    """A-25, H-10: moments over 16 golden-angle directions, exploded from a literal."""
    from ..functions.hashing import sphere_direction

    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    lit = rows.withColumn("d", sphere_direction(F.col("k"), 16)).withColumn("v", F.greatest(F.col("d.y"), F.lit(0.0)) * F.col("s_acctbal"))
    return lit.groupBy("s_suppkey").agg(F.round(F.sum("v"), 2).alias("c0"), F.round(F.sum(F.col("v") * F.col("d.x")), 2).alias("cx"), F.round(F.sum(F.col("v") * F.col("d.y")), 2).alias("cy"))


@query(
    "q_prefix_offsets",
    "WITH g AS (SELECT l_shipdate::DATE AS day, count(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT strftime(day, '%Y-%m') AS grp, sum(n)::BIGINT AS cap FROM g GROUP BY 1) SELECT grp, cap, coalesce(sum(cap) OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM m",
)
def prefix_offsets(spark, sf_dir):
    """W-5: exclusive prefix sums over a small dimension of groups."""
    groups = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("grp")).agg(F.count("*").alias("cap"))
    return scatter.exclusive_offsets(groups, "grp", "cap", "first")


@query(
    "q_topk_passes",
    "SELECT l_partkey, round(sum(l_extendedprice), 2) AS ms FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey HAVING sum(l_extendedprice) > 1000 ORDER BY ms DESC, l_partkey LIMIT 16",
)
def topk_passes(spark, sf_dir):
    """O-1, O-5, P-19."""
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("s"))
    return rows.where("s > 1000").select("l_partkey", F.round("s", 2).alias("ms")).orderBy(F.desc("ms"), "l_partkey").limit(16)


@query("q_stride_keep", "WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders) SELECT o_orderkey, round(o_totalprice * sqrt(3::DOUBLE), 4) AS size FROM r WHERE k % 3 = 0")
def stride_keep(spark, sf_dir):
    """P-17, P-21: every third row, with its size raised to keep the coverage."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey").withColumn("k", place)
    return rows.where("k % 3 = 0").select("o_orderkey", F.round(F.col("o_totalprice") * F.sqrt(F.lit(3.0)), 4).alias("size"))


@query(
    "q_union_offset",
    "WITH u AS (SELECT 0 AS mesh, r_regionkey AS v, r_name AS name FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation), s AS (SELECT mesh, count(*) AS n FROM u GROUP BY mesh), o AS (SELECT mesh, coalesce(sum(n) OVER (ORDER BY mesh ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM s) SELECT mesh, v + first AS vertex, name FROM u JOIN o USING (mesh)",
)
def union_offset(spark, sf_dir):
    """U-1, U-2, U-5: concatenated meshes with shifted indices."""
    a = table(spark, sf_dir, "region").select(F.lit(0).alias("mesh"), F.col("r_regionkey").alias("v"), F.col("r_name").alias("name"))
    both = a.unionByName(table(spark, sf_dir, "nation").select(F.lit(1).alias("mesh"), F.col("n_nationkey").alias("v"), F.col("n_name").alias("name")))
    sizes = scatter.exclusive_offsets(both.groupBy("mesh").agg(F.count("*").alias("n")), "mesh", "n", "first")
    return both.join(F.broadcast(sizes), "mesh").select("mesh", (F.col("v") + F.col("first")).alias("vertex"), "name")


@query("q_distinct_layers", "SELECT DISTINCT event_type, floor(value / 20)::BIGINT AS layer FROM events")
def distinct_layers(spark, sf_dir):
    """U-3."""
    return table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") / 20).alias("layer")).distinct()


@query(
    "q_map_metrics",
    "SELECT user_id, count(*) AS n, max((json_extract_string(props, '$.k'))::INTEGER) AS top, count(*) FILTER ((json_extract_string(props, '$.k'))::INTEGER > 50) AS above FROM events GROUP BY user_id",
)
def map_metrics(spark, sf_dir):
    """P-19: values out of JSON documents."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max(k).alias("top"), F.count_if(k > 50).alias("above"))


#: Distance bands of the level-of-detail classes, the slack of the outer region and the cap of a group.
LODS = ((0.0, 40.0), (34.0, 90.0), (80.0, 400.0))
GROUP_CAP = 60
REGION = ((0.8, 0.0, 0.6, 30.0), (-0.6, 0.0, 0.8, 45.0), (0.0, 1.0, 0.0, 2.5), (0.0, -1.0, 0.0, 3.0), (-0.8, 0.6, 0.0, 38.0), (0.0, 0.0, -1.0, 47.0))


@query(
    "q_cull_classify",
    f"""WITH c AS (SELECT c_custkey, c_nationkey % 6 AS cls, (c_custkey % 101) - 50 AS x, (c_custkey // 7) % 101 - 50 AS z, c_custkey % 13 - 6 AS y FROM customer), d AS (SELECT *, sqrt(x * x + y * y + z * z) AS d FROM c WHERE x * 0.8 + z * 0.6 + 30 > -2 AND x * -0.6 + z * 0.8 + 45 > -2 AND y + 2.5 > -2 AND 3.0 - y > -2 AND x * -0.8 + y * 0.6 + 38 > -2 AND z * -1 + 47 > -2),
b AS (SELECT *, cls * 3 + lod AS grp FROM d JOIN (VALUES (0, 0.0, 40.0), (1, 34.0, 90.0), (2, 80.0, 400.0)) v(lod, lo, hi) ON d >= lo AND d < hi), p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY c_custkey) AS k FROM b)
SELECT grp, count(*) AS found, least(count(*), {GROUP_CAP}) AS drawn, sum(c_custkey) FILTER (k <= {GROUP_CAP})::BIGINT AS id_sum FROM p GROUP BY grp""",
)
def cull_classify(spark, sf_dir):
    """G-22, P-8..P-11, J-5..J-7: region test by six planes, overlapping bands, capped groups, counts."""
    from ..operators.spatial import halfspaces

    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 6).alias("cls"), (key % 101 - 50).alias("x"), (key % 13 - 6).alias("y"), (F.floor(key / 7) % 101 - 50).alias("z"))
    inside = rows.where(halfspaces([F.col(c) for c in "xyz"], REGION, F.lit(2.0)))
    far = inside.withColumn("d", F.sqrt((F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")).cast("double")))
    hit = far.select("c_custkey", "cls", F.explode(scatter.bands(F.col("d"), LODS)).alias("lod")).select("c_custkey", (F.col("cls") * 3 + F.col("lod")).alias("grp"))
    counts = hit.groupBy("grp").agg(F.count("*").alias("found"))
    kept = scatter.capped(hit, ["grp"], ["c_custkey"], GROUP_CAP).groupBy("grp").agg(F.sum("c_custkey").alias("id_sum"))
    return counts.join(kept, "grp").select("grp", "found", F.least("found", F.lit(GROUP_CAP)).cast("long").alias("drawn"), "id_sum")


@query(
    "q_report_lines",
    "SELECT n_name || lpad(printf('%.2f', round(sum(s_acctbal), 2)), 12, ' ') AS line FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name",
)
def report_lines(spark, sf_dir):
    """SNK-6: padded report lines."""
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum("s_acctbal"), 2).alias("s")).select(F.concat("n_name", F.lpad(F.format_string("%.2f", "s"), 12, " ")).alias("line"))
