"""Relational completeness on the star schema: every kind of join, grouping, window and set operation."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.queries._registry import family
from quernstone.sources.tables import table

QUERIES, ORACLES, query = family()


def t(spark, sf_dir, *names):
    out = [table(spark, sf_dir, n) for n in names]
    return out[0] if len(out) == 1 else out


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    """Filter, then a small grouping: filters and columns reach the scan."""
    return t(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("""SELECT r_name, n_name, count(DISTINCT o_custkey) AS n_customers, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def inner_join_chain(spark, sf_dir):
    """Two large joins on their keys, small dimensions broadcast by size."""
    l, o, c, n, r = t(spark, sf_dir, "lineitem", "orders", "customer", "nation", "region")
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count_distinct("o_custkey").alias("n_customers"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("""SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def left_join_counts(spark, sf_dir):
    """Customers with and without orders: orders are aggregated before the join."""
    c, o = t(spark, sf_dir, "customer", "orders")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return c.select("c_custkey").join(per, "c_custkey", "left").fillna(0)


@query("""SELECT coalesce(s, c) AS nationkey, n_s, n_c FROM (SELECT s_nationkey AS s, count(*) AS n_s FROM supplier WHERE s_acctbal > 0 GROUP BY 1) FULL JOIN (SELECT c_nationkey AS c, count(*) AS n_c FROM customer WHERE c_acctbal < 0 GROUP BY 1) ON s = c""")
def full_join_counts(spark, sf_dir):
    """Suppliers in credit and customers in debt per nation."""
    s = t(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n_s"))
    c = t(spark, sf_dir, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n_c"))
    return s.join(c, "nationkey", "full")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')""")
def semi_join(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer", "orders")
    return c.join(o.where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("""SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)""")
def anti_join(spark, sf_dir):
    p, l = t(spark, sf_dir, "part", "lineitem")
    return p.select("p_partkey").join(l.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("""SELECT e.event_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id = e.user_id AND b.event_type = 'view' AND (b.ts, b.event_id) < (e.ts, e.event_id) AND b.ts = (SELECT max(c.ts) FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'view' AND (c.ts, c.event_id) < (e.ts, e.event_id))) AS last_view FROM events e WHERE e.event_type = 'purchase'""")
def as_of_join(spark, sf_dir):
    """The last view before each purchase: one window over both, no join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = t(spark, sf_dir, "events").where("event_type IN ('view', 'purchase')")
    return e.withColumn("last_view", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), True).over(w)).where("event_type = 'purchase'").select("event_id", "last_view")


@query("""SELECT a.l_orderkey, a.l_linenumber AS line_a, b.l_linenumber AS line_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND abs(date_diff('day', a.l_shipdate, b.l_shipdate)) <= 3""")
def band_join(spark, sf_dir):
    """Lines of an order shipped within three days of each other."""
    l = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    a, b = l.select("l_orderkey", F.col("l_linenumber").alias("line_a"), F.col("l_shipdate").alias("da")), l.select("l_orderkey", F.col("l_linenumber").alias("line_b"), F.col("l_shipdate").alias("db"))
    return a.join(b, "l_orderkey").where((F.col("line_a") < F.col("line_b")) & (F.abs(F.datediff("da", "db")) <= 3)).select("l_orderkey", "line_a", "line_b")


@query("""SELECT p_brand, p_type, count(*) AS n, round(avg(p_retailprice), 4) AS price, grouping(p_brand, p_type)::BIGINT AS level FROM part GROUP BY CUBE (p_brand, p_type)""")
def cube_parts(spark, sf_dir):
    return t(spark, sf_dir, "part").cube("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price"), F.grouping_id().cast("bigint").alias("level"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus, o_orderpriority)::BIGINT AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def rollup_orders(spark, sf_dir):
    return t(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))


@query("""SELECT o_orderkey, o_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def top3_per_customer(spark, sf_dir):
    """A top-k report: the window's limit is pushed below its shuffle."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 3").select("o_orderkey", "o_custkey", "rank")


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving, ntile(4) OVER w AS quarter, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS priority_rank FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_frames(spark, sf_dir):
    """Running and moving frames, tiles and dense ranks: windows of one partitioning share a shuffle."""
    p = Window.partitionBy("o_custkey")
    w = p.orderBy("o_orderdate", "o_orderkey")
    return t(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"), F.round(F.avg("o_totalprice").over(w.rowsBetween(-2, 0)), 4).alias("moving"), F.ntile(4).over(w).cast("bigint").alias("quarter"), F.dense_rank().over(p.orderBy("o_orderpriority")).cast("bigint").alias("priority_rank"))


@query("""SELECT k, 'both' AS side FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'customers' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def set_operations(spark, sf_dir):
    c, s = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), t(spark, sf_dir, "supplier").select("s_nationkey")
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.subtract(s).withColumn("side", F.lit("customers")))


@query("""SELECT event_type, count(*) FILTER (h < 6)::BIGINT AS night, count(*) FILTER (h BETWEEN 6 AND 11)::BIGINT AS morning, count(*) FILTER (h >= 12)::BIGINT AS later FROM (SELECT event_type, hour(ts) AS h FROM events) GROUP BY event_type""")
def pivot_hours(spark, sf_dir):
    h = F.hour("ts")
    part = F.when(h < 6, "night").when(h < 12, "morning").otherwise("later")
    return t(spark, sf_dir, "events").withColumn("part", part).groupBy("event_type").pivot("part", ["night", "morning", "later"]).count().fillna(0)


@query("""SELECT s_suppkey, median(l_quantity)::DOUBLE AS median_qty, count(DISTINCT l_partkey) AS n_parts, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) AS dearest_order, round(stddev_samp(l_extendedprice), 4) AS spread FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey""")
def distinct_and_order_aggregates(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.percentile("l_quantity", F.lit(0.5)).alias("median_qty"), F.count_distinct("l_partkey").alias("n_parts"), F.max(F.struct("l_extendedprice", "l_orderkey"))["l_orderkey"].alias("dearest_order"), F.round(F.stddev_samp("l_extendedprice"), 4).alias("spread"))
    return t(spark, sf_dir, "supplier").select("s_suppkey").join(l, "s_suppkey")
