"""Scans, projections, filters, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.functions import values as v
from gristmill.operators import rows as r
from gristmill.plans import search as _search  # noqa: F401
from gristmill.plans.registry import Tables, plan


@plan("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def src_01_scan(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@plan("SELECT * FROM customer WHERE c_custkey = 42")
def src_02_lookup(t: Tables) -> DataFrame:
    return t.customer.where("c_custkey = 42").limit(1)


@plan("SELECT c_custkey, c_custkey AS custKey, c_name, c_name AS custName FROM customer")
def prj_01_aliases(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.col("c_custkey").alias("custKey"), "c_name", F.col("c_name").alias("custName"))


@plan("SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS priority, 'AUD' AS currency, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END, 0) AS fee FROM orders")
def prj_02_defaults(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("none")).alias("priority"), F.lit("AUD").alias("currency"), F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")), F.lit(0.0)).alias("fee"))


@plan("""SELECT s_suppkey, '{"id":' || n_nationkey || ',"name":"' || n_name || '"}' AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def prj_03_nested(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("nation"))


@plan("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind FROM events")
def prj_04_spread_json(t: Tables) -> DataFrame:
    spread = t.events.withColumn("m", v.spread_json("props", {"kind": F.col("event_type")}))
    return spread.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["kind"].alias("kind"))


@plan("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity - 1 > 0 THEN l_extendedprice / (l_quantity - 1) ELSE 0 END AS per_item FROM lineitem")
def prj_05_generated(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") - 1 > 0, F.col("l_extendedprice") / F.nullif(F.col("l_quantity") - 1, F.lit(0.0))).otherwise(0.0).alias("per_item"))


@plan("""SELECT event_id, CAST(epoch(date_trunc('second', coalesce(CASE WHEN event_type <> 'error' THEN ts END, TIMESTAMP '2024-02-01'))) - epoch(TIMESTAMP '2024-01-01') AS BIGINT) * 1000 AS ms FROM events""")
def prj_06_duration(t: Tables) -> DataFrame:
    end = F.coalesce(F.when(F.col("event_type") != "error", F.col("ts")), F.lit("2024-02-01").cast("timestamp"))
    return t.events.select("event_id", (v.seconds_between(F.lit("2024-01-01").cast("timestamp"), end) * 1000).alias("ms"))


@plan("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' ' || l_returnflag AS label FROM lineitem")
def prj_07_label(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", v.amount_label("l_quantity", "l_returnflag").alias("label"))


@plan("SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value END AS value FROM events")
def prj_08_finite(t: Tables) -> DataFrame:
    odd = F.when(F.col("event_type") == "error", F.lit(float("nan"))).when(F.col("event_type") == "view", F.lit(float("inf"))).otherwise(F.col("value"))
    return t.events.select("event_id", v.finite(odd).alias("value"))


@plan("SELECT coalesce(nullif(c_mktsegment, 'MACHINERY'), 'Unknown') AS segment, count(*) AS n FROM customer GROUP BY 1")
def prj_09_unknown_label(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("s", F.lit("Unknown")).alias("segment"), "n")


@plan("""SELECT user_id, round(max(CASE WHEN event_type = 'click' THEN value END), 4) AS click, round(max(CASE WHEN event_type = 'view' THEN value END), 4) AS "view" FROM events GROUP BY 1""")
def prj_10_pivot(t: Tables) -> DataFrame:
    wide = t.events.groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.max("value"))
    return wide.select("user_id", F.round("click", 4).alias("click"), F.round("view", 4).alias("view"))


@plan("""SELECT l_orderkey, l_linenumber, 'DISC' AS test_type, nullif(l_discount, 0) AS overall FROM lineitem WHERE nullif(l_discount, 0) IS NOT NULL
UNION ALL SELECT l_orderkey, l_linenumber, 'TAX', nullif(l_tax, 0) FROM lineitem WHERE nullif(l_tax, 0) IS NOT NULL""")
def prj_11_unpivot(t: Tables) -> DataFrame:
    wide = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("d"), F.nullif("l_tax", F.lit(0.0)).alias("x"))
    return r.unpivot_scores(wide, ["l_orderkey", "l_linenumber"], {"d": "DISC", "x": "TAX"})


@plan("""WITH f AS (SELECT l_orderkey, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY (CASE WHEN l_quantity > 25 THEN 0 ELSE 1 END), l_linenumber, l_extendedprice) AS rn, l_quantity FROM lineitem)
SELECT l_orderkey, string_agg(l_returnflag || '=' || (CASE WHEN l_quantity > 25 THEN l_linestatus ELSE 'null' END), ',' ORDER BY l_returnflag) AS provenance FROM f WHERE rn = 1 GROUP BY 1""")
def prj_12_provenance(t: Tables) -> DataFrame:
    ok = F.col("l_quantity") > 25
    first = r.first_per(t.lineitem, ["l_orderkey", "l_returnflag"], [F.when(ok, 0).otherwise(1).asc(), F.asc("l_linenumber"), F.asc("l_extendedprice")])
    entry = F.struct("l_returnflag", F.when(ok, F.col("l_linestatus")).otherwise("null").alias("m"))
    return first.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat(e["l_returnflag"], F.lit("="), e["m"])), ",").alias("provenance"))


@plan("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = lower('Building')")
def fil_01_case_insensitive(t: Tables) -> DataFrame:
    return t.customer.where(F.lower("c_mktsegment") == "Building".lower()).select("c_custkey")


@plan("SELECT p_partkey FROM part WHERE p_name ILIKE '%RED%' OR p_type ILIKE '%promo%'")
def fil_02_substring(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").ilike("%RED%") | F.col("p_type").ilike("%promo%")).select("p_partkey")


@plan("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'bolt')")
def fil_04_membership(t: Tables) -> DataFrame:
    return t.part.where(F.array_contains(F.split("p_name", " "), "bolt")).select("p_partkey")


@plan("SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['gear', 'ring'])")
def fil_05_overlap(t: Tables) -> DataFrame:
    return t.part.where(r.overlaps(F.split("p_name", " "), ["gear", "", "ring"])).select("p_partkey")


@plan("""SELECT p_partkey FROM (SELECT p_partkey, nullif(p_size, 7) AS s, CASE WHEN p_brand <> 'Brand#2' THEN p_retailprice END AS price FROM part)
WHERE (s IS NULL OR s <= 20) AND price IS NOT NULL AND price >= 950""")
def fil_06_ranges(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", F.nullif("p_size", F.lit(7)).alias("s"), F.when(F.col("p_brand") != "Brand#2", F.col("p_retailprice")).alias("price"))
    return p.where(r.all_of([r.at_most_or_null("s", 20), r.at_least("price", 950), r.at_most_or_null("price", 0)])).select("p_partkey")


@plan("SELECT p_partkey FROM part WHERE p_size <= 5")
def fil_07_chosen_column(t: Tables) -> DataFrame:
    column = {"SIZE": "p_size", "PRICE": "p_retailprice"}.get("SIZE")
    return t.part.where(F.col(column) <= 5 if column else F.lit(True)).select("p_partkey")


@plan("SELECT count(*) AS n FROM part")
def fil_08_no_condition(t: Tables) -> DataFrame:
    return t.part.where(r.all_of([])).agg(F.count(F.lit(1)).alias("n"))


@plan("SELECT o_orderkey FROM orders WHERE nullif(o_orderpriority, '5-LOW') IS NULL OR nullif(o_orderpriority, '5-LOW') NOT IN ('1-URGENT', '2-HIGH')")
def fil_09_not_in(t: Tables) -> DataFrame:
    return t.orders.where(r.not_in(F.nullif("o_orderpriority", F.lit("5-LOW")), ["1-URGENT", "2-HIGH"])).select("o_orderkey")


@plan("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def fil_10_id_set(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@plan("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 14 DAY")
def fil_11_window(t: Tables) -> DataFrame:
    newest = t.events.agg(F.max("ts").alias("as_of"))
    return t.events.crossJoin(F.broadcast(newest)).where(r.within("ts", F.col("as_of"), "14 days")).select("event_id")


@plan("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^(RED|BLUE) ', 'i') AND NOT regexp_matches(p_type, 'PROMO')")
def fil_12_regex(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").rlike("(?i)^(red|blue) ") & ~F.col("p_type").rlike("PROMO")).select("p_partkey")


@plan("SELECT p_partkey, CASE WHEN p_name LIKE 'red%' OR length(p_name) > 11 THEN NULL ELSE p_name END AS name FROM part")
def fil_13_null_out(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.when(~(F.col("p_name").like("red%") | (F.length("p_name") > 11)), F.col("p_name")).alias("name"))


@plan("SELECT count(*) AS n FROM part WHERE nullif(p_name, 'red widget') IS NULL OR trim(replace(p_name, 'blue bolt', '  ')) = ''")
def fil_14_blank(t: Tables) -> DataFrame:
    return t.part.where(tx.is_blank(F.nullif("p_name", F.lit("red widget"))) | tx.is_blank(F.regexp_replace("p_name", "blue bolt", "  "))).agg(F.count(F.lit(1)).alias("n"))


@plan("""SELECT event_id FROM events WHERE event_type IN ('click', 'view', 'error')""")
def fil_15_json_empty(t: Tables) -> DataFrame:
    lists = F.when(F.col("event_type") == "click", "[]").when(F.col("event_type") == "view", "null").when(F.col("event_type") != "error", "[1]")
    return t.events.where(v.json_is_empty(lists)).select("event_id")


@plan("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '42'")
def fil_16_json_path(t: Tables) -> DataFrame:
    return t.events.where(F.get_json_object("props", "$.k") == "42").select("event_id")


@plan("""SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')
AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""")
def fil_17_exists(t: Tables) -> DataFrame:
    on = F.col("o_custkey") == F.col("c_custkey")
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), on, "left_semi").join(t.orders.where("o_orderpriority = '1-URGENT'"), on, "left_anti").select("c_custkey")


@plan("SELECT c_custkey FROM customer c WHERE (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) = 0")
def fil_18_no_children(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@plan("SELECT event_id, event_type FROM events WHERE event_id > 9000")
def fil_19_tail(t: Tables) -> DataFrame:
    return t.events.where("event_id > 9000").select("event_id", "event_type")


@plan("SELECT o_orderkey, o_totalprice, nullif(o_orderpriority, '5-LOW') AS p FROM orders ORDER BY p DESC NULLS LAST, o_totalprice, o_orderkey LIMIT 100")
def srt_01_nulls_last(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p")).orderBy(F.col("p").desc_nulls_last(), "o_totalprice", "o_orderkey").limit(100)


@plan("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey LIMIT 50")
def srt_02_ranked(t: Tables) -> DataFrame:
    rank = tx.first_match([(F.col("o_orderstatus") == "P", 0), (F.col("o_orderstatus") == "O", 1)], 2)
    return t.orders.orderBy(rank, "o_orderkey").limit(50).select("o_orderkey", "o_orderstatus")


@plan("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment DESC, c_acctbal DESC NULLS LAST, c_custkey LIMIT 60")
def srt_03_mixed(t: Tables) -> DataFrame:
    return t.customer.orderBy(F.desc("c_mktsegment"), F.col("c_acctbal").desc_nulls_last(), "c_custkey").limit(60).select("c_custkey", "c_mktsegment", "c_acctbal")


@plan("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def srt_04_page(t: Tables) -> DataFrame:
    return r.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 20)


@plan("SELECT user_id, round(sum(value), 4) AS spent FROM events GROUP BY 1 ORDER BY spent DESC, user_id LIMIT 10")
def srt_05_top_k(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("spent")).orderBy(F.desc("spent"), "user_id").limit(10)


@plan("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def srt_06_ordered_limit(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").orderBy("o_orderkey").limit(25)


@plan()
def srt_07_sample(t: Tables) -> DataFrame:
    return t.part.orderBy(F.rand(7)).limit(5).select("p_partkey")


@plan("""SELECT event_id AS id, ts AS at, 'event' AS kind FROM events UNION ALL SELECT o_orderkey, o_orderdate, 'order' FROM orders""")
def srt_08_merge(t: Tables) -> DataFrame:
    a = t.events.select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.lit("event").alias("kind"))
    b = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.lit("order").alias("kind"))
    return a.unionByName(b)


@plan("SELECT p_partkey, CASE WHEN p_name LIKE '%widget%' THEN 1 WHEN p_name LIKE '%gear%' THEN 2 ELSE 999 END AS rank FROM part")
def srt_09_keyword_rank(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.first_match([(F.col("p_name").contains("widget"), 1), (F.col("p_name").contains("gear"), 2)], 999).alias("rank"))


@plan("""SELECT o_custkey, string_agg(m, ',' ORDER BY k) AS months FROM (SELECT DISTINCT o_custkey, monthname(o_orderdate) AS m, month(o_orderdate) AS k FROM orders) GROUP BY 1""")
def srt_10_calendar(t: Tables) -> DataFrame:
    months = t.orders.groupBy("o_custkey").agg(F.collect_set(F.date_format("o_orderdate", "MMMM")).alias("m"))
    return months.select("o_custkey", F.array_join(tx.calendar_order("m"), ",").alias("months"))


@plan("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_01_union(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).unionByName(t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))).dropDuplicates()


@plan("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_02_difference(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.select(F.col("o_custkey").alias("k")))


@plan("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_03_intersection(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).intersect(t.orders.select(F.col("o_custkey").alias("k")))
