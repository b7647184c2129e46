"""Aggregations. Spark adds up within partitions before it shuffles, so a hot key costs one row a partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import values as v
from gristmill.operators import rows as r
from gristmill.plans.registry import Tables, plan


@plan("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_totalprice > 300000) AS large FROM orders")
def agg_01_counts(t: Tables) -> DataFrame:
    return t.orders.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_totalprice") > 300000).alias("large"))


@plan("SELECT coalesce(g, 'Unknown') AS g, n FROM (SELECT nullif(o_orderpriority, '5-LOW') AS g, count(*) AS n FROM orders GROUP BY 1)")
def agg_02_null_group(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("g")).agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("g", F.lit("Unknown")).alias("g"), "n")


@plan("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def agg_03_distinct(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@plan("""SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS open, round(avg(l_tax) FILTER (WHERE l_discount > 0.05), 4) AS tax FROM lineitem GROUP BY 1""")
def agg_04_filtered(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.round(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))), 2).alias("open"), F.round(F.avg(F.when(F.col("l_discount") > 0.05, F.col("l_tax"))), 4).alias("tax")
    )


@plan("SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done FROM orders GROUP BY 1")
def agg_05_conditional_sum(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("done"))


@plan("SELECT l_partkey, round(avg(l_quantity), 2) AS mean, min(l_quantity) AS low, max(l_quantity) AS high, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def agg_06_rounded(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 2).alias("mean"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@plan("SELECT l_suppkey, round(avg(CASE WHEN l_discount > 0 THEN l_tax / l_discount END), 4) AS ratio FROM lineitem GROUP BY 1")
def agg_07_guarded_ratio(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.avg(F.when(F.col("l_discount") > 0, F.col("l_tax") / F.nullif("l_discount", F.lit(0.0)))), 4).alias("ratio"))


@plan("SELECT l_orderkey, round(100.0 * count(*) FILTER (WHERE l_returnflag = 'R') / nullif(count(*) FILTER (WHERE l_returnflag <> 'N'), 0), 2) AS pct FROM lineitem GROUP BY 1")
def agg_08_safe_ratio(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(v.percentage(F.count_if(F.col("l_returnflag") == "R"), F.count_if(F.col("l_returnflag") != "N")).alias("pct"))


@plan("SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.5), 4) AS median FROM customer GROUP BY 1")
def agg_09_median(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(F.round(F.percentile("c_acctbal", F.lit(0.5)), 4).alias("median"))


@plan("SELECT o_custkey, bool_or(o_totalprice > 400000) AS any_large FROM orders GROUP BY 1")
def agg_10_bool_or(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_totalprice") > 400000).alias("any_large"))


@plan("SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FILTER (WHERE l_returnflag <> 'N') AS flags FROM lineitem GROUP BY 1")
def agg_11_distinct_array(t: Tables) -> DataFrame:
    flags = v.nonempty_or_null(F.array_sort(F.collect_set(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(flags, ",").alias("flags"))


@plan("""SELECT user_id, array_to_string(list_slice(list_sort(list(event_id)), 1, 20), ',') AS first_events FROM events GROUP BY 1""")
def agg_12_sliced_array(t: Tables) -> DataFrame:
    # Only the twenty first of a user are gathered, so no array grows with the data.
    first = r.ranked(t.events, ["user_id"], [F.asc("event_id")]).where("rn <= 20")
    return first.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("event_id")).cast("array<string>"), ",").alias("first_events"))


@plan("SELECT user_id, round(sum(value), 4) AS spent FROM events GROUP BY 1 HAVING sum(value) > (SELECT 1.05 * sum(value) / count(DISTINCT user_id) FROM events)")
def agg_13_having(t: Tables) -> DataFrame:
    per = t.events.groupBy("user_id").agg(F.sum("value").alias("s"))
    mean = per.agg((F.sum("s") / F.count(F.lit(1)) * 1.05).alias("m"))  # one row
    return per.crossJoin(F.broadcast(mean)).where("s > m").select("user_id", F.round("s", 4).alias("spent"))


@plan("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS cost FROM events GROUP BY 1, 2")
def agg_14_daily(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("cost"))


_MODAL = """WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS f FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT c_nationkey, c_mktsegment, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1"""


@plan(_MODAL)
def agg_16_modal(t: Tables) -> DataFrame:
    known = t.customer.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("MACHINERY")))
    return r.modal(known, ["c_nationkey"], "c_mktsegment", "c_custkey", 2)


@plan("SELECT c_nationkey, list_sort(list(c_acctbal))[greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT))] AS low FROM customer GROUP BY 1")
def agg_17_low_quantile(t: Tables) -> DataFrame:
    return r.low_quantile(t.customer, ["c_nationkey"], "c_acctbal")


@plan("SELECT c_nationkey, c_mktsegment, round(quantile_cont(c_acctbal, 0.5), 2) AS median FROM customer GROUP BY 1, 2")
def agg_18_group_median(t: Tables) -> DataFrame:
    # The mean of two amounts may end in half a cent: as in the SQL, the product in binary decides which way it goes.
    return t.customer.groupBy("c_nationkey", "c_mktsegment").agg((F.round(F.percentile("c_acctbal", F.lit(0.5)) * 100) / 100).alias("median"))


@plan("""WITH c AS (SELECT o_orderpriority, coalesce(nullif(o_orderstatus, 'P'), 'null') AS s, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, '{' || string_agg('"' || s || '":' || n, ',' ORDER BY s) || '}' AS methods FROM c GROUP BY 1""")
def agg_19_map(t: Tables) -> DataFrame:
    return r.counts_map(t.orders.withColumn("s", F.nullif("o_orderstatus", F.lit("P"))), ["o_orderpriority"], "s", "methods")


@plan("SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def agg_21_subquery_count(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'P'").select("o_custkey").distinct().agg(F.count(F.lit(1)).alias("n"))


@plan("SELECT event_type, round(avg(value) * 80, 4) AS run, round(avg(value) * 80 * 4, 4) AS month, round(avg(value) * 80 * 52, 4) AS year FROM events GROUP BY 1")
def agg_22_projection(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(*[F.round(F.avg("value") * 80 * k, 4).alias(n) for n, k in (("run", 1), ("month", 4), ("year", 52))])


@plan("SELECT o_custkey, CASE WHEN count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) = count(*) THEN max(o_orderdate) END AS completed FROM orders GROUP BY 1")
def agg_23_all_done(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.when(F.count_if(F.col("o_orderstatus") != "P") == F.count(F.lit(1)), F.max("o_orderdate")).alias("completed"))


@plan("""SELECT o_custkey, '[' || string_agg('{"k":' || o_orderkey || ',"s":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']' AS orders FROM orders GROUP BY 1""")
def agg_24_embedded(t: Tables) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))))
    return t.orders.groupBy("o_custkey").agg(F.to_json(rows).alias("orders"))


@plan("SELECT p_name, p_size, count(*) AS n, CASE WHEN count(*) >= 5 THEN 'suspicious' ELSE 'plausible' END AS assessment FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def agg_25_duplicates(t: Tables) -> DataFrame:
    g = t.part.groupBy("p_name", "p_size").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.withColumn("assessment", F.when(F.col("n") >= 5, "suspicious").otherwise("plausible"))
