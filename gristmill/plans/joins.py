"""Joins. None names a strategy: Spark broadcasts a side whose size it knows to be small, and splits skewed keys at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import natural_key
from gristmill.operators import rows as r
from gristmill.plans.registry import Tables, plan


@plan("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def joi_01_inner(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@plan("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def joi_02_left(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@plan("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus IN ('P') AND o_totalprice > 300000")
def joi_03_left_filtered(t: Tables) -> DataFrame:
    few = t.orders.where("o_orderstatus IN ('P') AND o_totalprice > 300000")
    return t.customer.join(few, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@plan("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1) ON o_custkey = c_custkey""")
def joi_04_latest_row(t: Tables) -> DataFrame:
    newest = r.first_per(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return t.customer.join(newest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@plan("""SELECT s_suppkey, n, total FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
def joi_05_left_aggregate(t: Tables) -> DataFrame:
    return r.left_aggregate(t.supplier, t.lineitem, {"s_suppkey": "l_suppkey"}, n=F.count(F.lit(1)), total=F.round(F.sum("l_extendedprice"), 2)).select("s_suppkey", "n", "total")


@plan("""WITH p AS (SELECT user_id, avg(value) AS a FROM events GROUP BY 1), s AS (SELECT quantile_cont(a, 0.5) AS m FROM p)
SELECT user_id, round(a, 4) AS mean, round(m, 4) AS median FROM p CROSS JOIN s WHERE a > 1.1 * m""")
def joi_06_07_outliers(t: Tables) -> DataFrame:
    p = t.events.groupBy("user_id").agg(F.avg("value").alias("a"))
    s = p.agg(F.percentile("a", F.lit(0.5)).alias("m"))  # one row
    return p.crossJoin(F.broadcast(s)).where("a > 1.1 * m").select("user_id", F.round("a", 4).alias("mean"), F.round("m", 4).alias("median"))


@plan("SELECT o_custkey, o_orderkey FROM orders o WHERE o_orderdate = (SELECT max(i.o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def joi_08_latest_ties(t: Tables) -> DataFrame:
    return r.first_per(t.orders, ["o_custkey"], [F.desc("o_orderdate")], ties=True).select("o_custkey", "o_orderkey")


@plan("""SELECT c_nationkey, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)) AS large FROM customer GROUP BY 1""")
def joi_09_semi_in_aggregate(t: Tables) -> DataFrame:
    large = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("k")).distinct()
    flagged = t.customer.join(large, F.col("c_custkey") == F.col("k"), "left")
    return flagged.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("large"))


@plan("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def joi_10_anti(t: Tables) -> DataFrame:
    return t.part.join(t.lineitem.where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@plan("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49)")
def joi_11_semi(t: Tables) -> DataFrame:
    return t.part.join(t.lineitem.where("l_quantity > 49"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@plan("""SELECT a.p_partkey, min(b.p_partkey) AS keep FROM part a JOIN part b ON a.p_name = b.p_name AND nullif(a.p_size, 7) IS NOT DISTINCT FROM nullif(b.p_size, 7) GROUP BY 1 HAVING a.p_partkey <> min(b.p_partkey)""")
def joi_12_null_safe_duplicates(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    keep = F.min("p_partkey").over(Window.partitionBy("p_name", F.nullif("p_size", F.lit(7))))
    return t.part.select("p_partkey", keep.alias("keep")).where("p_partkey <> keep")


@plan("""WITH d AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS at FROM lineitem GROUP BY 1, 2)
SELECT a.l_orderkey, least(a.l_returnflag, b.l_returnflag) AS value_a, greatest(a.l_returnflag, b.l_returnflag) AS value_b FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag < b.l_returnflag""")
def joi_13_pairs(t: Tables) -> DataFrame:
    d = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.min("l_linenumber").alias("at"))
    pairs = d.join(d.select("l_orderkey", F.col("l_returnflag").alias("other")), "l_orderkey").where("l_returnflag < other")
    return pairs.select("l_orderkey", F.col("l_returnflag").alias("value_a"), F.col("other").alias("value_b"))


def changed_orders(t: Tables) -> DataFrame:
    """orders a day later: every seventh key is gone, the next one's price has changed, the next one's key is new."""
    k = F.col("o_orderkey") % 7
    return t.orders.where(k != 0).select(F.when(k == 2, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("o_orderkey"), (F.col("o_totalprice") + F.when(k == 1, 1.0).otherwise(0.0)).alias("o_totalprice"), F.when(k == 3, F.lit(None).cast("string")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))


_DIFF = """WITH a AS (SELECT CASE WHEN o_orderkey % 7 = 2 THEN -o_orderkey ELSE o_orderkey END AS k, o_totalprice + CASE WHEN o_orderkey % 7 = 1 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 <> 0),
d AS (SELECT coalesce(b.o_orderkey, a.k) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN b.o_totalprice IS DISTINCT FROM a.p OR b.o_orderstatus IS DISTINCT FROM a.s THEN 'changed' ELSE 'same' END AS status,
CASE WHEN b.o_orderkey IS NULL OR a.k IS NULL THEN '' ELSE concat_ws(',', CASE WHEN b.o_totalprice IS DISTINCT FROM a.p THEN 'o_totalprice' END, CASE WHEN b.o_orderstatus IS DISTINCT FROM a.s THEN 'o_orderstatus' END) END AS changed FROM orders b FULL JOIN a ON b.o_orderkey = a.k) """


@plan(_DIFF + "SELECT * FROM d")
def joi_14_diff(t: Tables) -> DataFrame:
    found = r.diff(t.orders, changed_orders(t), ["o_orderkey"], ["o_totalprice", "o_orderstatus"])
    return found.withColumn("changed", F.array_join("changed", ","))


@plan("""SELECT c.c_custkey, coalesce(nullif(c.c_mktsegment, 'MACHINERY'), s.m) AS segment FROM customer c LEFT JOIN (SELECT c_custkey - 1 AS k, c_mktsegment AS m FROM customer) s ON s.k = c.c_custkey""")
def joi_15_update_from(t: Tables) -> DataFrame:
    base = t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"))
    return r.fill_blanks(base, t.customer.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_mktsegment").alias("segment")), ["c_custkey"], ["segment"])


@plan("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def joi_16_delete_using(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@plan("SELECT a.p_partkey, count(*) AS n FROM part a JOIN part b ON lower(trim(a.p_name)) = lower(trim(' ' || upper(b.p_name))) GROUP BY 1")
def joi_17_natural_key(t: Tables) -> DataFrame:
    counted = t.part.groupBy(natural_key(F.concat(F.lit(" "), F.upper("p_name"))).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return t.part.withColumn("k", natural_key("p_name")).join(counted, "k").select("p_partkey", "n")


@plan("""SELECT a.l_orderkey, a.l_linenumber, count(*) AS near FROM lineitem a JOIN (SELECT DISTINCT l_tax AS x FROM lineitem) b ON abs(a.l_discount - b.x) < 0.015 GROUP BY ALL""")
def joi_20_tolerance(t: Tables) -> DataFrame:
    # A row can only be near keys of its own or a neighbouring cell, so the range becomes an equality.
    cell = lambda c: F.floor(F.col(c) / 0.015).cast("int")
    keys = t.lineitem.select(F.col("l_tax").alias("x")).distinct().select("x", F.explode(F.array(cell("x") - 1, cell("x"), cell("x") + 1)).alias("cell"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", cell("l_discount").alias("cell"))
    return rows.join(keys, "cell").where("abs(l_discount - x) < 0.015").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("near"))
