"""Window functions. Every window has a partition key; running totals over a whole table are not needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import urls
from gristmill.operators import rows as r
from gristmill.plans.registry import Tables, plan


@plan("SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(lower(split_part(url, '#', 1)), '/+$', '') ORDER BY page_id DESC) AS rn FROM pages) WHERE rn = 1")
def win_01_latest_url(t: Tables) -> DataFrame:
    return r.first_per(t.pages.select("page_id", "url"), [urls.url_key("url")], [F.desc("page_id")])


_MONTHLY = "SELECT o_orderpriority AS field, date_trunc('month', o_orderdate) AS run, count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS rate FROM orders GROUP BY 1, 2"


def monthly_rates(t: Tables) -> DataFrame:
    """A run a month, a field a priority, and the share of finished orders as its fill rate."""
    month = F.date_trunc("month", "o_orderdate").alias("run")
    return t.orders.groupBy(F.col("o_orderpriority").alias("field"), month).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("rate"))


@plan(f"""WITH m AS ({_MONTHLY}), x AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY run DESC) AS rn FROM m),
y AS (SELECT field, avg(rate) FILTER (WHERE rn <= 5) AS a, avg(rate) FILTER (WHERE rn BETWEEN 6 AND 10) AS b FROM x GROUP BY 1)
SELECT field, round(a, 6) AS recent, round(b, 6) AS previous, round(a - b, 6) AS delta FROM y WHERE b IS NOT NULL""")
def win_02_trend(t: Tables) -> DataFrame:
    found = r.bucket_trend(monthly_rates(t), ["field"], [F.desc("run")], "rate")
    return found.select("field", *[F.round(c, 6).alias(c) for c in ("recent", "previous", "delta")])


@plan("SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, lower(c_mktsegment)) AS keep FROM customer")
def win_03_keep_id(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.min("c_custkey").over(Window.partitionBy("c_nationkey", F.lower("c_mktsegment"))).alias("keep"))


@plan("SELECT o_orderkey, rn FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'P') DESC NULLS LAST, o_orderkey DESC) AS rn FROM orders)")
def win_04_nulls_last(t: Tables) -> DataFrame:
    found = r.ranked(t.orders, ["o_custkey"], [F.nullif("o_orderstatus", F.lit("P")).desc_nulls_last(), F.desc("o_orderkey")])
    return found.select("o_orderkey", F.col("rn").cast("long").alias("rn"))


@plan("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def win_05_distinct_on(t: Tables) -> DataFrame:
    return r.first_per(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@plan("SELECT user_id, min(event_id) AS first_event FROM events GROUP BY 1")
def win_06_first(t: Tables) -> DataFrame:
    return r.first_per(t.events, ["user_id"], [F.asc("event_id")]).select("user_id", F.col("event_id").alias("first_event"))


@plan(f"""WITH m AS ({_MONTHLY}) SELECT field, run, n, round(mean, 6) AS mean FROM (SELECT field, run, count(*) OVER w AS n, avg(rate) OVER w AS mean FROM m WINDOW w AS (PARTITION BY field ORDER BY run ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) WHERE n >= 3""")
def win_07_trailing_mean(t: Tables) -> DataFrame:
    w = Window.partitionBy("field").orderBy("run").rowsBetween(-5, -1)
    return monthly_rates(t).select("field", "run", F.count("rate").over(w).alias("n"), F.round(F.avg("rate").over(w), 6).alias("mean")).where("n >= 3")


@plan("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def win_08_max_by(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@plan("SELECT event_id, round(s, 4) AS spent, s >= 500 AS halted FROM (SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events)")
def win_09_ceiling(t: Tables) -> DataFrame:
    return r.running_halt(t.events, ["user_id"], [F.asc("ts"), F.asc("event_id")], "value", 500.0).select("event_id", F.round("spent", 4).alias("spent"), "halted")


@plan("SELECT event_id, n AS recent, n >= 3 AS tripped FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error')")
def win_10_rolling(t: Tables) -> DataFrame:
    return r.rolling_count(t.events.where("event_type = 'error'"), ["user_id"], "ts", 86_400, 3).select("event_id", "recent", "tripped")
