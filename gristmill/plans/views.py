"""Views and diagnostics over events (calls), orders (runs, metrics) and nations (universities)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import quality as q
from gristmill.operators import views
from gristmill.plans.registry import Tables, plan

_METRICS = """m AS (SELECT o_custkey % 25 AS university_id, o_orderpriority AS field_key, o_orderstatus AS method, date_trunc('month', o_orderdate) AS computed_at, avg(CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0.0 END) AS fill_rate FROM orders GROUP BY ALL)"""


def metrics(t: Tables) -> DataFrame:
    keys = [(F.col("o_custkey") % 25).cast("long").alias("university_id"), F.col("o_orderpriority").alias("field_key"), F.col("o_orderstatus").alias("method"), F.date_trunc("month", "o_orderdate").alias("computed_at")]
    return t.orders.groupBy(*keys).agg(F.avg(F.when(F.col("o_totalprice") > 250000, 1.0).otherwise(0.0)).alias("fill_rate"))


def universities(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").cast("long").alias("university_id"), F.col("n_name").alias("name"))


def calls(t: Tables) -> DataFrame:
    return t.events.select("user_id", F.col("event_type").alias("call_type"), "ts", (F.col("event_type") != "error").alias("success"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("value").alias("cost"), F.col("event_id").alias("course_id"))


_CALLS = "c AS (SELECT user_id, event_type AS call_type, ts, event_type <> 'error' AS success, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, value AS cost, event_id AS course_id FROM events)"
_COST = "count(*) AS calls, count(*) FILTER (WHERE NOT success) AS failures, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost"


@plan(f"""WITH {_METRICS}, l AS (SELECT * FROM m a WHERE computed_at = (SELECT max(computed_at) FROM m b WHERE b.university_id = a.university_id)),
g AS (SELECT university_id, count(DISTINCT field_key) AS fields, round(avg(fill_rate), 4) AS mean_rate, string_agg(DISTINCT field_key, ',' ORDER BY field_key) FILTER (WHERE fill_rate < 0.5) AS failing FROM l GROUP BY 1)
SELECT n_name AS name, fields, mean_rate, failing FROM nation LEFT JOIN g ON university_id = n_nationkey""")
def v_university_run_health(t: Tables) -> DataFrame:
    found = views.run_health(universities(t), metrics(t))
    return found.select("name", "fields", F.round("mean_rate", 4).alias("mean_rate"), F.array_join("failing", ",").alias("failing"))


@plan(f"""WITH {_METRICS}, x AS (SELECT *, row_number() OVER (PARTITION BY university_id, field_key ORDER BY computed_at DESC, method) AS rn FROM m),
y AS (SELECT university_id, field_key, avg(fill_rate) FILTER (WHERE rn <= 5) AS a, avg(fill_rate) FILTER (WHERE rn BETWEEN 6 AND 10) AS b FROM x GROUP BY 1, 2)
SELECT CAST(university_id AS BIGINT) AS university_id, field_key, round(a - b, 4) AS delta FROM y WHERE b IS NOT NULL""")
def v_field_health_trend(t: Tables) -> DataFrame:
    return views.field_trend(metrics(t)).select("university_id", "field_key", F.round("delta", 4).alias("delta"))


@plan(f"WITH {_CALLS} SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, {_COST} FROM c GROUP BY 1, 2")
def v_cost_by_university(t: Tables) -> DataFrame:
    return views.cost_by(calls(t), "user_id", F.date_trunc("day", "ts").alias("day"))


@plan(f"WITH {_CALLS} SELECT call_type, date_trunc('day', ts)::TIMESTAMP AS day, {_COST} FROM c GROUP BY 1, 2")
def v_cost_by_call_type(t: Tables) -> DataFrame:
    return views.cost_by(calls(t), "call_type", F.date_trunc("day", "ts").alias("day"))


@plan(f"""WITH {_CALLS} SELECT user_id, round(sum(cost), 4) AS cost, count(*) AS calls, round(100.0 * count(*) FILTER (WHERE success) / count(*), 2) AS success_pct FROM c WHERE ts > (SELECT max(ts) FROM c) - INTERVAL 20 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def v_top_spenders(t: Tables) -> DataFrame:
    return views.top_spenders(calls(t), "user_id", t.events.agg(F.max("ts")), 20)


@plan("""SELECT user_id AS university_id, count(DISTINCT event_id) AS courses, count(DISTINCT CASE WHEN event_type IN ('click', 'error') THEN event_id END) AS called,
round(100.0 * (count(DISTINCT event_id) - count(DISTINCT CASE WHEN event_type IN ('click', 'error') THEN event_id END)) / count(DISTINCT event_id), 2) AS skipped_pct FROM events GROUP BY 1""")
def v_skip_efficiency(t: Tables) -> DataFrame:
    courses = t.events.select(F.col("user_id").alias("university_id"), F.col("event_id").alias("course_id"))
    return views.skip_efficiency(courses, calls(t), ("click", "error"))


def alerts(t: Tables) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "signup", "warning").otherwise("info")
    return t.events.where("event_type IN ('error', 'signup', 'view')").select(F.concat_ws(":", F.lit("drop"), F.when(F.col("event_type") != "view", F.col("event_type"))).alias("rule_id"), severity.alias("severity"), (F.col("value") > 20).alias("acknowledged"), F.col("ts").alias("created_at"), (F.col("user_id") % 25).cast("long").alias("university_id"), "event_id")


@plan("""SELECT event_id, 'drop' AS rule, CASE WHEN event_type <> 'view' THEN event_type END AS field, CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS severity_rank,
CAST(epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('second', ts)) AS BIGINT) AS age_seconds FROM events WHERE event_type IN ('error', 'signup', 'view') AND value <= 20""")
def v_active_alerts(t: Tables) -> DataFrame:
    return views.active_alerts(alerts(t), F.lit("2024-02-01").cast("timestamp")).select("event_id", "rule", "field", "severity_rank", "age_seconds")


@plan("""WITH j AS (SELECT * FROM (SELECT o_custkey % 25 AS u, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_custkey % 25 < 20) WHERE rn = 1),
a AS (SELECT user_id % 25 AS u, count(*) FILTER (WHERE event_type = 'error') AS c, count(*) FILTER (WHERE event_type = 'signup') AS w FROM events WHERE event_type IN ('error', 'signup', 'view') AND value <= 20 GROUP BY 1)
SELECT n_name AS name, o_orderkey AS job_id, coalesce(c, 0) AS critical, coalesce(w, 0) AS warning, CASE WHEN o_orderkey IS NULL THEN 'never_run' WHEN coalesce(c, 0) > 0 THEN 'critical' WHEN coalesce(w, 0) > 0 THEN 'warning' ELSE 'healthy' END AS health
FROM nation LEFT JOIN j ON j.u = n_nationkey LEFT JOIN a ON a.u = n_nationkey""")
def v_university_health(t: Tables) -> DataFrame:
    jobs = t.orders.where("o_custkey % 25 < 20").select((F.col("o_custkey") % 25).cast("long").alias("university_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("status"))
    return views.university_health(universities(t), jobs, alerts(t)).select("name", "job_id", "critical", "warning", "health")


@plan("""SELECT c_nationkey, count(*) AS total, count(*) FILTER (WHERE c_acctbal > 0) AS having, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')) AS proven, round(100.0 * count(*) FILTER (WHERE c_acctbal > 0) / count(*), 2) AS pct FROM customer GROUP BY 1""")
def v_code_coverage(t: Tables) -> DataFrame:
    proof = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return views.coverage(t.customer, proof, "c_custkey", "c_nationkey", F.col("c_acctbal") > 0)


@plan(f"""WITH {_METRICS}, x AS (SELECT DISTINCT ON (university_id, field_key) * FROM m ORDER BY university_id, field_key, computed_at DESC, method)
SELECT field_key, count(*) AS n, round(avg(fill_rate), 4) AS mean, round(min(fill_rate), 4) AS low, round(max(fill_rate), 4) AS high FROM x GROUP BY 1""")
def fleet_d1_distribution(t: Tables) -> DataFrame:
    return views.distribution(metrics(t), ["university_id", "field_key"], [F.desc("computed_at"), F.asc("method")], "field_key", "fill_rate")


@plan(f"""WITH {_METRICS}, l AS (SELECT * FROM m a WHERE computed_at = (SELECT max(computed_at) FROM m b WHERE b.university_id = a.university_id))
SELECT method, count(DISTINCT university_id) AS universities, count(DISTINCT field_key) AS fields FROM l GROUP BY 1""")
def fleet_d2_methods(t: Tables) -> DataFrame:
    return q.latest_run(metrics(t), ["university_id"], "computed_at").groupBy("method").agg(F.count_distinct("university_id").alias("universities"), F.count_distinct("field_key").alias("fields"))


@plan("SELECT user_id, count(*) AS n FROM events WHERE regexp_matches(event_type, '^(CLICK|VIEW)$', 'i') GROUP BY 1 HAVING count(*) > 12")
def fleet_d2b_overuse(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type").rlike("(?i)^(click|view)$")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n > 12")


@plan("""WITH p AS (SELECT o_custkey, avg(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 10 END) AS mean FROM orders GROUP BY 1) SELECT o_custkey, round(mean, 4) AS mean FROM p WHERE mean > 1.6 * (SELECT quantile_cont(mean, 0.5) FROM p)""")
def fleet_d3_cost_outliers(t: Tables) -> DataFrame:
    runs = t.orders.select("o_custkey", "o_totalprice", F.when(F.col("o_orderstatus") == "P", 0).otherwise(10).alias("courses"))
    return views.cost_outliers(runs, "o_custkey", "o_totalprice", "courses", 1.6).select("o_custkey", F.round("mean", 4).alias("mean"))


@plan("SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS proven, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'R') < 0.3 * count(*)")
def fleet_d4_provenance(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("proven"), F.count(F.lit(1)).alias("n")).where("proven < 0.3 * n")


@plan("""SELECT user_id, count(*) AS calls, round(sum(value) / count(*), 6) AS per_call, round(sum(value) / count(*) * 80 * 4, 4) AS monthly, bool_or(event_type = 'error') AS any_error FROM events GROUP BY 1""")
def cost_per_university(t: Tables) -> DataFrame:
    per = F.sum("value") / F.count(F.lit(1))
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.round(per, 6).alias("per_call"), F.round(per * 80 * 4, 4).alias("monthly"), F.bool_or(F.col("event_type") == "error").alias("any_error"))


@plan("SELECT user_id, round(avg(value), 6) AS mean FROM events GROUP BY 1 HAVING avg(value) < 0.9 * (SELECT avg(value) FROM events)")
def cost_low(t: Tables) -> DataFrame:
    mean = t.events.agg(F.avg("value").alias("m"))  # one row
    return t.events.groupBy("user_id").agg(F.avg("value").alias("a")).crossJoin(F.broadcast(mean)).where("a < 0.9 * m").select("user_id", F.round("a", 6).alias("mean"))


@plan("SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'MACHINERY') IS NULL AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def null_score_audit(t: Tables) -> DataFrame:
    return t.customer.where(F.nullif("c_mktsegment", F.lit("MACHINERY")).isNull()).join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@plan("SELECT n_regionkey AS region, count(*) AS universities, count(*) FILTER (WHERE n_nationkey > 5) AS featured FROM nation GROUP BY 1")
def dashboard_summary(t: Tables) -> DataFrame:
    return t.nation.groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias("universities"), F.count_if(F.col("n_nationkey") > 5).alias("featured"))


@plan("SELECT o_orderkey, c_name, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def dashboard_recent(t: Tables) -> DataFrame:
    newest = t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10)
    return newest.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name", "o_orderdate")
