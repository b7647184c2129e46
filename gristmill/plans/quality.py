"""Quality operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import first_match
from gristmill.operators import quality as q
from gristmill.operators import reports
from gristmill.operators import rows as r
from gristmill.plans.joins import _DIFF, changed_orders
from gristmill.plans.registry import Tables, plan
from gristmill.plans.windows import _MONTHLY, monthly_rates


def _evidence(t: Tables) -> DataFrame:
    # Dealt by the key of the join, which is also the entity: the join and the distinct entities after it need no shuffle of their own, and their tasks hold bounded tables.
    return r.spread_by_rows(t.lineitem.select("l_orderkey", "l_returnflag", "l_linestatus"), "l_orderkey").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("run"), F.col("l_orderkey").alias("entity"), F.col("l_returnflag").alias("field"), F.nullif("l_linestatus", F.lit("O")).alias("method"))


_EVIDENCE = "e AS (SELECT o_orderpriority AS run, l_orderkey AS entity, l_returnflag AS field, nullif(l_linestatus, 'O') AS method FROM lineitem JOIN orders ON l_orderkey = o_orderkey), s AS (SELECT o_orderpriority AS run, o_orderkey AS entity FROM orders WHERE o_orderstatus <> 'P'), "
_RATES = _EVIDENCE + "tt AS (SELECT run, count(DISTINCT entity) AS total FROM s GROUP BY 1), rates AS (SELECT e.run, field, method, count(DISTINCT entity) AS n, any_value(total) AS total FROM e JOIN tt ON e.run = tt.run GROUP BY e.run, field, method)"


def _rates(t: Tables, strict: bool = False) -> DataFrame:
    staged = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("entity"))
    return q.fill_rates(_evidence(t), staged, "run", "entity", "field", "method", strict=strict)


@plan(f"WITH {_RATES} SELECT run, field, method, n, total, CAST(round_even(n / total, 4) AS DOUBLE) AS fill_rate FROM rates")
def qa_01_fill_rates(t: Tables) -> DataFrame:
    return _rates(t)


@plan(f"WITH {_EVIDENCE} x AS (SELECT run, field, coalesce(method, 'null') AS m, count(*) AS n FROM e GROUP BY ALL) SELECT run, field, '{{' || string_agg('\"' || m || '\":' || n, ',' ORDER BY m) || '}}' AS methods FROM x GROUP BY ALL")
def qa_02_method_maps(t: Tables) -> DataFrame:
    return q.method_maps(_evidence(t), "run", "field", "method")


@plan(f"""WITH {_RATES}, f AS (SELECT run, field, least(1.0, sum(n) / max(total)) AS rate FROM rates GROUP BY ALL)
SELECT run, round(max(CASE WHEN field = 'A' THEN rate END), 3) AS a, round(max(CASE WHEN field = 'N' THEN rate END), 3) AS n, round(max(CASE WHEN field = 'R' THEN rate END), 3) AS r FROM f GROUP BY 1""")
def qa_02_wide_summary(t: Tables) -> DataFrame:
    f = _rates(t).groupBy("run", "field").agg(F.least(F.lit(1.0), F.sum("n") / F.max("total")).alias("rate"))
    wide = f.groupBy("run").pivot("field", ["A", "N", "R"]).agg(F.max("rate"))
    return wide.select("run", *[F.round(c, 3).alias(c.lower()) for c in ("A", "N", "R")])


def _staged(t: Tables) -> DataFrame:
    """Parts as staged rows, with values missing by rule."""
    k = F.col("p_partkey")
    null = F.lit(None)
    return t.part.select(
        k.alias("id"), F.when(k % 11 == 0, "").when(k % 7 == 0, F.lit("courses")).otherwise(F.concat(F.lit("Bachelor of "), "p_name")).alias("course_name"), F.when(k % 5 != 0, F.col("p_type")).alias("degree_level"),
        F.when(k % 3 != 0, F.col("p_retailprice")).alias("international_fee"), (k % 2 == 0).alias("has_central_fee_page"),
        F.when(k % 4 != 0, F.lit(6.0)).alias("ielts_overall"), F.when(k % 8 == 1, F.lit(85.0)).alias("toefl_overall"), *[F.lit(None).cast("double").alias(c) for c in ("pte_overall", "cambridge_overall", "duolingo_overall")],
        (k % 8 != 1).alias("toefl_accepted"), *[F.lit(None).cast("boolean").alias(c) for c in ("pte_accepted", "cambridge_accepted", "duolingo_accepted")],
        F.when(k % 6 != 0, F.col("p_size").cast("double")).alias("duration"), F.lit("Years").alias("duration_term"), F.when(k % 9 != 0, F.array(F.when(k % 10 == 0, "Sometime").otherwise("February"))).alias("intake_months"),
        F.when(k % 13 != 0, F.lit("City")).alias("course_location"), F.when(k % 14 != 0, F.lit("On Campus")).alias("study_mode"), F.lit("x").alias("category"), F.lit("text").alias("description"), null.cast("string").alias("academic_level"),
    )


_POINTS = """CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 <> 0 THEN 25 ELSE 0 END + CASE WHEN p_partkey % 4 <> 0 OR p_partkey % 8 = 1 THEN 25 ELSE 0 END + CASE WHEN p_partkey % 6 <> 0 AND p_size > 0 THEN 20 ELSE 0 END
+ CASE WHEN p_partkey % 9 <> 0 THEN 20 ELSE 0 END + CASE WHEN p_partkey % 14 <> 0 THEN 10 ELSE 0 END"""
_SLOTS = """(CASE WHEN p_partkey % 11 <> 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 5 <> 0 THEN 1 ELSE 0 END + 2 + CASE WHEN p_partkey % 14 <> 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 13 <> 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 6 <> 0 AND p_size <> 0 THEN 1 ELSE 0 END
+ CASE WHEN p_partkey % 9 <> 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 4 <> 0 OR p_partkey % 8 = 1 THEN 1 ELSE 0 END)"""


@plan(f"SELECT p_partkey AS id, {_POINTS} AS score, CASE WHEN {_POINTS} >= 80 THEN 'pass' WHEN {_POINTS} >= 60 THEN 'warn' ELSE 'low' END AS level FROM part")
def qa_03_confidence(t: Tables) -> DataFrame:
    return _staged(t).select("id", q.confidence().alias("score"), q.confidence_level(q.confidence()).alias("level"))


@plan(f"SELECT p_partkey AS id, CAST(round_even({_SLOTS} / 13 * 100, 0) AS INTEGER) AS completeness, 13 - {_SLOTS} AS lacking FROM part")
def qa_04_completeness(t: Tables) -> DataFrame:
    return q.completeness(_staged(t)).select("id", "completeness", F.size("missing").alias("lacking"))


@plan(f"""WITH r AS (SELECT p_partkey AS id, list_filter([CASE WHEN p_partkey % 11 = 0 THEN 'course_name' END, CASE WHEN p_partkey % 5 = 0 THEN 'degree_level' END, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 8 <> 1 THEN 'english_test' END], lambda x: x IS NOT NULL) AS b,
round_even({_SLOTS} / 13 * 100, 0) AS c FROM part) SELECT id, CASE WHEN len(b) > 0 OR c < 75 THEN 'review' ELSE 'ready' END AS status, array_to_string(b, ', ') AS blockers,
CASE WHEN len(b) > 0 THEN 'Publish blocked: ' || array_to_string(b, ', ') WHEN c < 75 THEN 'review' ELSE 'ok' END AS told FROM r""")
def qa_05_eligibility(t: Tables) -> DataFrame:
    rows = q.eligibility(q.completeness(_staged(t)), 75).select("id", "verdict.status", F.array_join("blockers", ", ").alias("blockers"), "verdict.reason")
    told = F.when(F.col("reason").startswith("Publish blocked: "), F.split_part("reason", F.lit(" | "), F.lit(1))).when(F.col("status") == "review", "review").otherwise(F.col("reason"))
    return rows.select("id", "status", "blockers", told.alias("told"))


@plan(f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'name_too_short' WHEN p_partkey % 5 = 0 THEN 'missing_degree_level' WHEN p_partkey % 4 = 0 AND p_partkey % 8 <> 1 THEN 'missing_english'
WHEN round_even({_SLOTS} / 13 * 100, 0) < 75 THEN 'low_completeness' WHEN {_POINTS} < 85 THEN 'low_confidence' END AS reason FROM part""")
def qa_06_publish(t: Tables) -> DataFrame:
    rows = q.completeness(_staged(t)).withColumn("confidence", q.confidence())
    return rows.select("id", q.publish_reason(least=75).alias("reason"))


@plan("""WITH i AS (SELECT p_partkey AS id, unnest(list_filter([CASE WHEN p_partkey % 11 = 0 THEN 'missing_course_name' END, CASE WHEN p_partkey % 7 = 0 AND p_partkey % 11 <> 0 THEN 'generic_course_title' END,
CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 1 THEN 'missing_international_fee' END, CASE WHEN p_partkey % 6 = 0 THEN 'missing_international_fee_central_page' END,
CASE WHEN p_partkey % 4 = 0 THEN 'missing_english_requirement' END, CASE WHEN p_partkey % 8 = 1 THEN 'test_not_accepted_but_scored_toefl' END, CASE WHEN p_partkey % 8 = 1 THEN 'english_coherence_toefl' END,
CASE WHEN p_partkey % 6 = 0 THEN 'missing_duration' END, CASE WHEN p_partkey % 6 <> 0 AND (p_size <= 0 OR p_size > 10) THEN 'suspicious_duration' END, CASE WHEN p_partkey % 9 = 0 THEN 'missing_intake_months' END,
CASE WHEN p_partkey % 9 <> 0 AND p_partkey % 10 = 0 THEN 'invalid_intake_months' END, CASE WHEN p_partkey % 13 = 0 THEN 'missing_location' END, CASE WHEN p_partkey % 14 = 0 THEN 'missing_study_mode' END,
CASE WHEN p_partkey % 5 = 0 THEN 'missing_degree_level' END], lambda x: x IS NOT NULL)) AS code FROM part) SELECT code, count(*) AS n FROM i GROUP BY 1""")
def qa_07_08_11_issues(t: Tables) -> DataFrame:
    issues = _staged(t).select("id", F.explode(q.course_issues()).alias("i"))
    return issues.groupBy("i.code").agg(F.count(F.lit(1)).alias("n"))


@plan("SELECT lower(trim(p_name)) AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def qa_09_duplicate_names(t: Tables) -> DataFrame:
    return t.part.groupBy(F.lower(F.trim("p_name")).alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@plan("""WITH c AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE 'X' END AS s, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderpriority, s, n, known FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS known FROM c) WHERE known >= 5 AND n / known >= 0.75""")
def qa_10_dominant(t: Tables) -> DataFrame:
    return q.dominant(t.orders.withColumn("s", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).otherwise("X")), ["o_orderpriority"], "s")


@plan(f"WITH m AS ({_MONTHLY}) SELECT field, run, round(rate, 6) AS rate, 0.5 AS floor, CASE WHEN round(0.5 - rate, 9) >= 0.2 THEN 'critical' ELSE 'warning' END AS severity FROM m WHERE rate < 0.5")
def qa_12_fill_alerts(t: Tables) -> DataFrame:
    found = q.fill_alerts(monthly_rates(t), None, ["run"], "field", "rate")
    return found.withColumn("rate", F.round("rate", 6)).withColumn("floor", F.col("floor").cast("decimal(2,1)"))


@plan("""WITH c AS (SELECT o_custkey, o_orderpriority AS field, CASE o_orderstatus WHEN 'F' THEN 'ai_fallback' WHEN 'O' THEN 'sibling_cache:x' ELSE 'regex' END AS method, count(*) AS n FROM orders GROUP BY ALL),
g AS (SELECT o_custkey, field, sum(n) FILTER (WHERE method = 'ai_fallback') / sum(n) AS a, sum(n) FILTER (WHERE method = 'sibling_cache:x') / sum(n) AS s FROM c GROUP BY ALL)
SELECT o_custkey, field, 'ai_fallback_dominance' AS rule, round(a, 6) AS share FROM g WHERE a > 0.25 UNION ALL SELECT o_custkey, field, 'sibling_cache_dominance', round(s, 6) FROM g WHERE s > 0.30""")
def qa_13_method_alerts(t: Tables) -> DataFrame:
    method = first_match([(F.col("o_orderstatus") == "F", "ai_fallback"), (F.col("o_orderstatus") == "O", "sibling_cache:x")], "regex")
    metrics = t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("field"), method.alias("method")).agg(F.count(F.lit(1)).alias("n"))
    return q.method_alerts(metrics, ["o_custkey"], "field", "method", "n").select("o_custkey", "field", "rule", F.round("share", 6).alias("share"))


@plan("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def qa_14_bad_sources(t: Tables) -> DataFrame:
    url = F.when(F.col("l_returnflag") == "R", "https://Facebook.com/x").otherwise("https://uni.edu/course")
    return q.bad_sources(t.lineitem.withColumn("url", url), ["l_orderkey"], "url")


@plan("""WITH r AS (SELECT date_trunc('month', o_orderdate) AS run, 'https://uni.edu/s' || (o_orderkey % 97) || '/d' AS prefix FROM orders), n AS (SELECT max(run) AS m FROM r),
p AS (SELECT DISTINCT run FROM r WHERE run < (SELECT m FROM n) ORDER BY run DESC LIMIT 4)
SELECT prefix, count(*) AS n FROM r WHERE run = (SELECT m FROM n) AND prefix NOT IN (SELECT prefix FROM r WHERE run IN (SELECT run FROM p)) GROUP BY 1 HAVING count(*) > 0""")
def qa_15_new_prefixes(t: Tables) -> DataFrame:
    rows = t.orders.select(F.date_trunc("month", "o_orderdate").alias("run"), F.concat(F.lit("https://uni.edu/s"), (F.col("o_orderkey") % 97).cast("string"), F.lit("/d/c")).alias("url"))
    return q.new_prefixes(rows, "run", "run", "url", most=0)


@plan(f"""WITH m AS ({_MONTHLY}), w AS (SELECT *, avg(rate) OVER w AS mean, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY field ORDER BY run ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT field, run, round(rate, 6) AS rate, round(mean, 6) AS mean FROM w WHERE n >= 3 AND round(mean - rate, 9) >= 0.15""")
def qa_16_trend_drop(t: Tables) -> DataFrame:
    found = r.trailing_drop(monthly_rates(t), ["field"], [F.asc("run")], "rate")
    return found.select("field", "run", F.round("rate", 6).alias("rate"), F.round("trailing_mean", 6).alias("mean"))


@plan(f"""WITH m AS ({_MONTHLY}), g AS (SELECT field, count(DISTINCT run) AS runs, quantile_cont(rate, 0.5) AS e, list_sort(list(rate))[greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT))] AS low FROM m GROUP BY 1)
SELECT field, runs, CAST(round_even(e, 4) AS DOUBLE) AS expected, round(greatest(0.5, low - 0.05), 4) AS floor FROM g WHERE runs >= 3""")
def qa_17_baselines(t: Tables) -> DataFrame:
    return q.baselines(monthly_rates(t), ["field"], "run", "rate")


@plan("""SELECT c_nationkey, CASE WHEN 100.0 * count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') / count(*) > 40 OR 100.0 * count(*) FILTER (WHERE c_acctbal < 0) / count(*) > 40 THEN 'FAIL'
WHEN 100.0 * count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') / count(*) > 15 OR 100.0 * count(*) FILTER (WHERE c_acctbal < 0) / count(*) > 15 THEN 'WARN' ELSE 'PASS' END AS status FROM customer GROUP BY 1""")
def qa_18_health(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    pct = lambda c: 100.0 * F.count_if(c) / n
    status = q.health_status(n, pct(F.col("c_mktsegment") == "MACHINERY"), pct(F.col("c_acctbal") < 0), F.lit(0), n, F.count_distinct("c_acctbal"))
    return t.customer.groupBy("c_nationkey").agg(status.alias("status"))


@plan(_DIFF + "SELECT status, count(*) AS n FROM d GROUP BY 1")
def qa_19_20_run_diff(t: Tables) -> DataFrame:
    return r.diff(t.orders, changed_orders(t), ["o_orderkey"], ["o_totalprice", "o_orderstatus"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@plan("""SELECT p_partkey AS id, CASE WHEN p_size > (CASE p_type WHEN 'SMALL' THEN 4 WHEN 'LARGE' THEN 12 ELSE 7 END) THEN 'duration_too_long' WHEN p_size < 0.25 THEN 'duration_too_short' WHEN p_type NOT IN ('SMALL', 'LARGE') AND p_size < 2 THEN 'bachelor_too_short' END AS warning FROM part""")
def qa_21_warnings(t: Tables) -> DataFrame:
    level = F.when(F.col("p_type") == "SMALL", "Master's").when(F.col("p_type") == "LARGE", "Doctorate").otherwise("Bachelor's")
    rows = t.part.select(F.col("p_partkey").alias("id"), level.alias("degree_level"), F.col("p_size").cast("double").alias("duration_years"))
    return q.warnings_and_limits(rows).select("id", "warning")


@plan("SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def qa_22_proof(t: Tables) -> DataFrame:
    evidence = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.lit("c_mktsegment").alias("field_key"), F.lit("https://x").alias("source_url"), F.when(F.col("o_orderstatus") == "F", "said").otherwise(" ").alias("snippet"))
    return q.without_unproven(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), evidence, "c_custkey", ["c_mktsegment"])


@plan("""WITH e AS (SELECT o_custkey AS k, left(o_orderpriority, 1) AS f, max(o_totalprice) AS m FROM orders GROUP BY ALL),
g AS (SELECT c_custkey, c_custkey % 3 <> 0 AS classed, count(*) FILTER (WHERE m >= 100000 AND (f = '1' AND c_custkey % 7 <> 0 OR f = '2' AND c_custkey % 11 <> 0 OR f = '3' OR f = '4')) AS n FROM customer LEFT JOIN e ON k = c_custkey GROUP BY ALL)
SELECT c_custkey, CASE WHEN n / 4 >= 0.75 AND classed THEN 'skip' WHEN n / 4 >= 0.75 THEN 'classification_only' ELSE 'full' END AS decision FROM g""")
def qa_23_gate(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    courses = t.customer.select("c_custkey", F.when(k % 7 != 0, "v").alias("f1"), F.when(k % 11 != 0, "v").alias("f2"), F.lit("v").alias("f3"), F.lit(4.0).alias("f4"), F.when(k % 3 != 0, "c").otherwise(" ").alias("category"))
    evidence = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("f"), F.left("o_orderpriority", F.lit(1))).alias("field_key"), F.col("o_totalprice").alias("confidence"))
    return q.extraction_gate(courses, evidence, "c_custkey", ("f1", "f2", "f3", "f4"), 100_000.0, 0.75, ("category",))


@plan("""SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'non_page_url' WHEN p_partkey % 13 = 0 THEN 'online_slug' WHEN p_type = 'SMALL' THEN 'no_degree_word' WHEN p_partkey % 11 = 0 THEN 'domestic_only' WHEN p_type = 'LARGE' THEN 'online_only' WHEN p_partkey % 3 = 0 THEN 'no_international_fee' END AS reason FROM part""")
def qa_24_staging(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    rows = t.part.select(
        "p_partkey", F.when(F.col("p_type") == "SMALL", "About").otherwise("Bachelor of Arts").alias("course_name"), F.when(k % 17 == 0, "https://a.org/x.PDF").when(k % 13 == 0, "https://a.org/arts-online/").otherwise("https://a.org/arts").alias("url"), (k % 11 == 0).alias("domestic_only"),
        F.when(F.col("p_type") == "LARGE", "Online").otherwise("On Campus").alias("study_mode"), F.when(F.col("p_type") != "LARGE", "City").alias("course_location"), F.when(k % 3 != 0, F.col("p_retailprice")).alias("international_fee"),
    )
    return rows.select("p_partkey", q.staging_gate(F.lit(False)).alias("reason"))


@plan("SELECT count(*) AS approved, count(*) FILTER (WHERE nullif(o_custkey % 10, 0) IS NULL) AS gap FROM orders WHERE o_orderstatus = 'F'")
def qa_25_promotion_gap(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'F'").agg(F.count(F.lit(1)).alias("approved"), F.count_if(F.nullif(F.col("o_custkey") % 10, F.lit(0)).isNull()).alias("gap"))


@plan("""SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 5 MINUTE THEN 'stale' WHEN event_type = 'signup' AND ts < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 10 MINUTE THEN 'stuck' ELSE 'ok' END AS state FROM events""")
def qa_26_liveness(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "signup", "queued").otherwise("completed")
    jobs = t.events.select("event_id", status.alias("status"), F.lit(None).cast("timestamp").alias("heartbeat_at"), F.col("ts").alias("started_at"), F.col("ts").alias("created_at"))
    return q.liveness(jobs, F.lit("2024-01-30 12:00:00").cast("timestamp")).select("event_id", "state")


@plan("""WITH e AS (SELECT date_trunc('month', o_orderdate) AS run, * FROM orders), s AS (SELECT run, count(*) AS total FROM e WHERE o_orderstatus IN ('F', 'O') GROUP BY 1),
f AS (SELECT run, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'a' WHEN '2-HIGH' THEN 'b' END AS field FROM e WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 100000),
k AS (SELECT run, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS dom, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS http, count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')) AS other FROM e WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT e.run, CAST(count(*) AS BIGINT) AS discovered, coalesce(any_value(k.dom), 0) AS skipped_domestic_only, greatest(coalesce(any_value(k.http), 0), count(*) FILTER (WHERE o_totalprice < 5000)) AS skipped_fetch_failed, coalesce(any_value(k.other), 0) AS skipped_other,
round(CASE WHEN any_value(s.total) > 0 THEN least(1.0, (SELECT count(*) FROM f WHERE f.run = e.run AND field = 'a')::DOUBLE / any_value(s.total)) END, 3) AS fill_a, round(CASE WHEN any_value(s.total) > 0 THEN least(1.0, (SELECT count(*) FROM f WHERE f.run = e.run AND field = 'b')::DOUBLE / any_value(s.total)) END, 3) AS fill_b,
CAST(count(*) AS BIGINT) AS calls, round(sum(o_custkey) / 64.0, 6) AS cost FROM e LEFT JOIN s ON s.run = e.run LEFT JOIN k ON k.run = e.run GROUP BY e.run""")
def qa_02_run_summary(t: Tables) -> DataFrame:
    """A month of orders as a run: its orders are courses, their priorities fields and reasons."""
    e = t.orders.withColumn("run", F.date_trunc("month", "o_orderdate"))
    jobs = e.groupBy("run").agg(F.count(F.lit(1)).alias("discovered"), F.lit(0).alias("staged"), F.lit(0).alias("skipped"), F.count_if(F.col("o_totalprice") < 5000).alias("fetch_errors"))
    reason = F.when(F.col("o_orderpriority") == "1-URGENT", "domestic").when(F.col("o_orderpriority") == "5-LOW", "HTTP 500").otherwise(F.col("o_orderpriority"))
    skips = e.where("o_orderstatus = 'P'").groupBy("run", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    courses = e.select("run", F.col("o_orderkey").alias("course"), F.when(F.col("o_orderstatus") == "F", "pending").when(F.col("o_orderstatus") == "O", "review_ready").otherwise("rejected").alias("status"))
    field = F.when(F.col("o_orderpriority") == "1-URGENT", "a").when(F.col("o_orderpriority") == "2-HIGH", "b")
    evidence = e.select(F.col("o_orderkey").alias("course"), field.alias("field"), F.col("o_orderstatus").alias("method"), (F.col("o_totalprice") > 100000).alias("selected"))
    out = reports.run_summary(jobs, skips, courses, evidence, e.select("run", (F.col("o_custkey") / 64).alias("cost")), ["a", "b"])
    return out.select("run", "discovered", "skipped_domestic_only", "skipped_fetch_failed", "skipped_other", "fill_a", "fill_b", "calls", "cost")


_FOUND = """i AS (SELECT p_partkey AS id, unnest(list_filter([CASE WHEN p_partkey % 11 = 0 THEN 'critical' END, CASE WHEN p_partkey % 7 = 0 AND p_partkey % 11 <> 0 THEN 'critical' END, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 1 THEN 'critical' END], lambda x: x IS NOT NULL)) AS severity FROM part WHERE p_size <= 40)"""


@plan(f"WITH {_FOUND} SELECT count(*) AS critical FROM i")
def qa_11_report(t: Tables) -> DataFrame:
    """Critical issues of staged rows; those that only take domestic students do not count."""
    rows = _staged(t).join(t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") > 40).alias("domestic_only")), "id")
    return reports.issue_counts(reports.quality_issues(rows, "id")).select("critical")
