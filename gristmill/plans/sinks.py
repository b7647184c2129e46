"""Imports, upserts and exports as the rows that they would leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import first_match
from gristmill.operators import rows as r
from gristmill.sources import readers, writers
from gristmill.plans.registry import Tables, plan


@plan("""SELECT min(lower(trim(p_name))) AS name FROM part WHERE lower(trim(p_name)) NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey < 10) GROUP BY lower(trim(p_name))""")
def src_05_new_names(t: Tables) -> DataFrame:
    new = readers.new_by_name(t.part.select(F.col("p_name").alias("name")), t.part.where("p_partkey < 10").select(F.upper("p_name").alias("name")))
    return new.select(F.lower(F.trim("name")).alias("name"))


@plan("""SELECT page_id, unnest(regexp_extract_all('<url><loc> ' || url || ' </loc></url><loc>https://a.org/sitemap-2.xml</loc>', '<loc>\\s*([^<\\s]+)\\s*</loc>', 1)) AS loc FROM pages""".replace("\\\\", "\\"))
def src_09_sitemap(t: Tables) -> DataFrame:
    xml = F.concat(F.lit("<url><loc> "), "url", F.lit(" </loc></url><loc>https://a.org/sitemap-2.xml</loc>"))
    return readers.sitemap_locations(t.pages.select("page_id", xml.alias("xml"))).select("page_id", "loc")


@plan("SELECT event_id FROM events WHERE ts + INTERVAL 7 DAY > (SELECT max(ts) FROM events)")
def src_11_cache_hits(t: Tables) -> DataFrame:
    newest = t.events.agg(F.max("ts").alias("as_of"))
    cache = t.events.withColumn("expires_at", F.col("ts") + F.expr("interval 7 days")).crossJoin(F.broadcast(newest))
    return readers.cache_hits(cache, F.col("as_of")).select("event_id")


@plan("SELECT p_partkey, replace(p_name, ' ', ';') AS words FROM part")
def snk_01_csv_rows(t: Tables) -> DataFrame:
    return writers.flat_for_csv(t.part.select("p_partkey", F.split("p_name", " ").alias("words")))


@plan("""SELECT '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}' AS j FROM events""")
def snk_02_json_rows(t: Tables) -> DataFrame:
    return writers.json_rows(t.events.select("event_id", "ts"))


@plan("""SELECT c_custkey, 'old' AS v FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0""")
def snk_03_upsert(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return r.upsert(t.customer.where(k % 2 == 0).select("c_custkey", F.lit("old").alias("v")), t.customer.where(k % 3 == 0).select("c_custkey", F.lit("new").alias("v")), ["c_custkey"])


@plan("""SELECT c_custkey, 'old' AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0""")
def snk_04_insert_ignore(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return r.upsert(t.customer.where(k % 2 == 0).select("c_custkey", F.lit("old").alias("v")), t.customer.where(k % 3 == 0).select("c_custkey", F.lit("new").alias("v")), ["c_custkey"], insert_only=True)


@plan("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders")
def snk_05_replace(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("p"))
    new = rows.where("o_orderstatus = 'F'").withColumn("p", F.col("p") + 1)
    return writers.bulk_replace(rows, new, ["o_orderstatus"]).select("o_orderkey", "p")


@plan("SELECT r_regionkey, r_name, TIMESTAMP '2024-01-01' AS backed_up_at FROM region")
def snk_06_snapshot(t: Tables) -> DataFrame:
    return writers.stamped(t.region, F.lit("2024-01-01")).select("r_regionkey", "r_name", "backed_up_at")


@plan("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + (SELECT count(*) FROM events e WHERE e.user_id = events.user_id AND event_type = 'click') AS sequence FROM events")
def snk_09_sequence(t: Tables) -> DataFrame:
    last = t.events.where("event_type = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("sequence"))
    return readers.with_sequence(t.events, "user_id", [F.asc("ts"), F.asc("event_id")], last).select("event_id", "sequence")


@plan("SELECT c_custkey, v AS country FROM customer CROSS JOIN (VALUES ('AU'), ('NZ')) x(v) WHERE c_custkey < 100")
def snk_10_bulk_apply(t: Tables) -> DataFrame:
    existing = t.customer.where("c_custkey >= 100").select("c_custkey", F.lit("AU").alias("country"))
    return writers.bulk_apply(t.customer.where("c_custkey < 100"), [{"country": "AU"}, {"country": "NZ"}], existing, "c_custkey", ["country"])


@plan("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'PTE' ELSE c_mktsegment END AS m FROM customer")
def snk_11_bulk_replace(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("m"))
    return writers.bulk_replace(rows, rows.where("c_custkey % 4 = 0").withColumn("m", first_match([(F.col("c_custkey") >= 0, "PTE")], "")), ["c_custkey"])
