"""Whole reports of a run: its summary row, and its quality issues with their counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import first_match
from gristmill.operators import quality

#: Buckets of skipped pages and the words of a reason that tell them; the first one counts, other reasons are "other".
SKIPS = (
    ("domestic_only", ("domestic",)), ("online_only", ("online",)), ("no_international_fee", ("international_fee", "intl_fee", "no_international")), ("category_landing_page", ("category_landing", "landing_page")),
    ("generic_category_page", ("generic_category", "category_page")), ("fetch_failed", ("fetch", "timeout", "http")),
)
#: Fields of a summary, statuses of rows that count as staged, and severities in their order.
SUMMARY_FIELDS = ("international_fee", "ielts_overall", "pte_overall", "toefl_overall", "duration", "intake_months", "study_mode", "degree_level")
STAGED = ("pending", "review_ready")
SEVERITIES = ("critical", "warning", "info")


def skip_bucket(reason: Column) -> Column:
    """The bucket of a free reason; null and empty ones are "other"."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    any_of = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return first_match([(any_of(words), bucket) for bucket, words in SKIPS], "other")


def run_summary(jobs: DataFrame, skips: DataFrame, courses: DataFrame, evidence: DataFrame, calls: DataFrame, fields: Sequence[str] = SUMMARY_FIELDS, staged: Sequence[str] = STAGED) -> DataFrame:
    """A row for each job of jobs (run, discovered, staged, skipped, fetch_errors): its counts, buckets of skips, fill rates, methods and cost.

    skips (run, reason, n): reasons counted by bucket; skipped_fetch_failed is the larger of its bucket and the job's own count. fill_<field> is the number of staged courses
    (run, course, status) with selected evidence (course, field, method, selected), summed over methods, by all staged ones, one at most; null without any.
    methods is JSON of field, method (null as "unknown") and count, with "null" for staged courses that lack the field. calls (run, cost) give their number and sum.
    Each table is brought to a row a run before it is joined, so nothing is multiplied.
    """
    buckets = [b for b, _ in SKIPS] + ["other"]
    skipped = skips.groupBy("run", skip_bucket(F.col("reason")).alias("bucket")).agg(F.sum("n").alias("n")).groupBy("run").pivot("bucket", buckets).agg(F.first("n"))
    skipped = skipped.select("run", *[F.coalesce(F.col(b), F.lit(0)).cast("long").alias(f"skipped_{b}") for b in buckets])
    held = courses.where(F.col("status").isin(*staged)).select("run", "course").distinct()
    totals = held.groupBy("run").agg(F.count(F.lit(1)).alias("__total"))
    named = evidence.where("selected").select("course", F.coalesce("field", F.lit("")).alias("field"), F.coalesce("method", F.lit("unknown")).alias("method"))
    counts = held.join(named, "course").groupBy("run", "field", "method").agg(F.count_distinct("course").alias("n"))
    lacking = totals.join(counts.groupBy("run", "field").agg(F.sum("n").alias("got")), "run")
    every = totals.select("run", "__total", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field")).join(lacking.select("run", "field", "got"), ["run", "field"], "left")
    short = F.greatest(F.col("__total") - F.coalesce("got", F.lit(0)), F.lit(0))
    nulls = every.where(short > 0).select("run", "field", F.lit("null").alias("method"), short.alias("n"))
    told = counts.unionByName(nulls).groupBy("run").agg(F.to_json(F.array_sort(F.collect_list(F.struct("field", "method", "n")))).alias("methods"))
    rate = F.round(F.least(F.coalesce("got", F.lit(0)) / F.col("__total"), F.lit(1.0)), 3)
    rates = every.groupBy("run").pivot("field", list(fields)).agg(F.first(rate)).select("run", *[F.col(f).alias(f"fill_{f}") for f in fields])
    cost = calls.groupBy("run").agg(F.count(F.lit(1)).alias("calls"), F.round(F.coalesce(F.sum("cost"), F.lit(0)), 6).alias("cost"))
    whole = jobs
    for part in (skipped, totals, rates, told, cost):
        whole = whole.join(part, "run", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    failed = F.greatest(F.coalesce("skipped_fetch_failed", F.lit(0)), F.coalesce("fetch_errors", F.lit(0))).cast("long").alias("skipped_fetch_failed")
    counted = [failed if b == "fetch_failed" else zero(f"skipped_{b}") for b in buckets]
    return whole.select("run", *[zero(c) for c in ("discovered", "staged", "skipped")], *counted, *[f"fill_{f}" for f in fields], "methods", zero("calls"), F.coalesce("cost", F.lit(0.0)).cast("double").alias("cost"))


def quality_issues(courses: DataFrame, key: str, ruled_out: Sequence[str] = ("domestic_only", "parser_error"), more: DataFrame | None = None) -> DataFrame:
    """Rows (key, severity, code) of all that is wrong with courses, but for those ruled out; more has issues of the same form that are found across courses."""
    out = F.lit(False)
    for c in ruled_out:
        if c in courses.columns:
            out = out | F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    issues = courses.where(~out).select(key, F.explode(quality.course_issues()).alias("i")).select(key, "i.severity", "i.code")
    return issues if more is None else issues.unionByName(more.select(key, "severity", "code"))


def in_report_order(issues: DataFrame, key: str) -> DataFrame:
    """Issues by severity, code and key."""
    rank = first_match(((F.col("severity") == s, i) for i, s in enumerate(SEVERITIES)), 9)
    return issues.orderBy(rank, "code", key)


def issue_counts(issues: DataFrame) -> DataFrame:
    """One row: issues in all and by severity."""
    counts = issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_issues"), *[F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).alias(s) for s in SEVERITIES])
