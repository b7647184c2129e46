"""The named views and diagnostics as functions of their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import first_match
from gristmill.functions.values import nonempty_or_null, percentage
from gristmill.operators.rows import bucket_trend, first_per, left_aggregate


def run_health(universities: DataFrame, metrics: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Each university's latest computation: fields, mean rate, and the fields below the threshold (null for none)."""
    newest = first_per(metrics, ["university_id"], [F.col("computed_at").desc_nulls_last()], ties=True)
    below = nonempty_or_null(F.array_sort(F.collect_set(F.when(F.col("fill_rate") < threshold, F.col("field_key")))))
    found = newest.groupBy("university_id").agg(F.max("computed_at").alias("last_run"), F.count_distinct("field_key").alias("fields"), F.avg("fill_rate").alias("mean_rate"), below.alias("failing"))
    return universities.join(found, "university_id", "left")


def field_trend(metrics: DataFrame) -> DataFrame:
    """For each university and field, the mean of the five newest rows against the five before. Ranks count metric rows, several of which may belong to a run."""
    return bucket_trend(metrics, ["university_id", "field_key"], [F.desc("computed_at"), F.asc("method")], "fill_rate")


def cost_by(calls: DataFrame, *keys: Column | str) -> DataFrame:
    """Calls, failures, tokens and cost of each group."""
    return calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("success")).alias("failures"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"))


def top_spenders(calls: DataFrame, key: str, as_of: DataFrame, days: int = 30, k: int = 10) -> DataFrame:
    """The k keys that spent the most in the last days before as_of (one row)."""
    recent = calls.crossJoin(F.broadcast(as_of.select(F.col(as_of.columns[0]).alias("__as_of")))).where(F.col("ts") > F.col("__as_of") - F.expr(f"interval {days} days"))
    spent = recent.groupBy(key).agg(F.round(F.sum("cost"), 4).alias("cost"), F.count(F.lit(1)).alias("calls"), percentage(F.count_if("success"), F.count(F.lit(1))).alias("success_pct"))
    return spent.orderBy(F.desc("cost"), key).limit(k)


def skip_efficiency(courses: DataFrame, calls: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """For each university, courses, those with a call of the kinds, and the share without any."""
    called = calls.where(F.col("call_type").isin(list(kinds))).select("course_id").distinct().withColumn("called", F.lit(True))
    per = courses.join(called, "course_id", "left").groupBy("university_id").agg(F.count_distinct("course_id").alias("courses"), F.count_distinct(F.when(F.col("called"), F.col("course_id"))).alias("called"))
    return per.withColumn("skipped_pct", percentage(F.col("courses") - F.col("called"), F.col("courses")))


def active_alerts(alerts: DataFrame, as_of: Column) -> DataFrame:
    """Alerts that nobody has acknowledged, the most severe first, with rule and field apart and their age in seconds."""
    rank = first_match([(F.col("severity") == "critical", 1), (F.col("severity") == "warning", 2)], 3)
    rows = alerts.where("NOT acknowledged").select("*", F.split_part("rule_id", F.lit(":"), F.lit(1)).alias("rule"), F.nullif(F.split_part("rule_id", F.lit(":"), F.lit(2)), F.lit("")).alias("field"), (F.unix_timestamp(as_of) - F.unix_timestamp("created_at")).alias("age_seconds"), rank.alias("severity_rank"))
    return rows.orderBy("severity_rank", F.desc("created_at"), "rule_id")


def university_health(universities: DataFrame, jobs: DataFrame, alerts: DataFrame) -> DataFrame:
    """Each university with its last job, its open alerts by severity and a status."""
    last = first_per(jobs, ["university_id"], [F.col("started_at").desc_nulls_last(), F.desc("job_id")]).select("university_id", "job_id", "started_at", "status")
    counted = left_aggregate(universities.join(last, "university_id", "left"), alerts.where("NOT acknowledged"), {"university_id": "university_id"}, critical=F.count_if(F.col("severity") == "critical"), warning=F.count_if(F.col("severity") == "warning"))
    c, w = F.coalesce("critical", F.lit(0)), F.coalesce("warning", F.lit(0))
    health = first_match([(F.col("job_id").isNull(), "never_run"), (c > 0, "critical"), (w > 0, "warning")], "healthy")
    return counted.withColumn("critical", c).withColumn("warning", w).withColumn("health", health)


def coverage(rows: DataFrame, evidence: DataFrame, key: str, group: str, has: Column) -> DataFrame:
    """For each group, rows, those that have a value, those with evidence of one, and the share in percent."""
    proven = evidence.select(key).distinct().withColumn("__proven", F.lit(True))
    return rows.join(proven, key, "left").groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.count_if(has).alias("having"), F.count("__proven").alias("proven"), percentage(F.count_if(has), F.count(F.lit(1))).alias("pct"))


def distribution(metrics: DataFrame, keys: list[str], order: list[Column], by: str, rate: str) -> DataFrame:
    """Of each key's newest row, the count, mean, least and largest rate by field."""
    return first_per(metrics, keys, order).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(rate), 4).alias("mean"), F.round(F.min(rate), 4).alias("low"), F.round(F.max(rate), 4).alias("high"))


def cost_outliers(runs: DataFrame, key: str, cost: str, courses: str, times: float = 5.0) -> DataFrame:
    """Keys whose mean cost a course is over so many times the median of all; runs without courses have none."""
    per = runs.groupBy(key).agg(F.avg(F.when(F.col(courses) > 0, F.col(cost) / F.nullif(courses, F.lit(0)))).alias("mean"))
    stats = per.agg(F.percentile("mean", F.lit(0.5)).alias("median"))  # one row
    return per.crossJoin(F.broadcast(stats)).where(F.col("mean") > times * F.col("median"))
