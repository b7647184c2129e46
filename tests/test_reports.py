"""A run's summary and issues by small cases."""

import json

from pyspark.sql import functions as F

from gristmill.operators import quality, reports


def test_skip_buckets(spark):
    reasons = ["Domestic students only", "online_only", "missing international_fee", "category_landing", "landing_page: x", "generic_category", "HTTP 500", "timeout", "odd", "", None, "domestic http"]
    df = spark.createDataFrame(list(enumerate(reasons)), "i int, reason string")
    got = [r.b for r in df.select("i", reports.skip_bucket(F.col("reason")).alias("b")).orderBy("i").collect()]
    assert got == ["domestic_only", "online_only", "no_international_fee", "category_landing_page", "category_landing_page", "generic_category_page", "fetch_failed", "fetch_failed", "other", "other", "other", "domestic_only"]


def test_run_summary(spark):
    jobs = spark.createDataFrame([("a", 9, 3, 4, 2), ("b", 1, None, None, 7), ("c", 0, 0, 0, None)], "run string, discovered int, staged int, skipped int, fetch_errors int")
    skips = spark.createDataFrame([("a", "domestic only", 2), ("a", "Domestic", 1), ("a", "timeout", 5), ("b", "http", 3), ("b", None, 1)], "run string, reason string, n int")
    courses = spark.createDataFrame([("a", 1, "pending"), ("a", 2, "review_ready"), ("a", 3, "rejected"), ("a", 4, "pending"), ("b", 5, "rejected")], "run string, course int, status string")
    ev = [(1, "duration", "regex", True), (1, "duration", "ai", True), (2, "duration", "regex", True), (3, "duration", "regex", True), (4, "study_mode", None, True), (1, "study_mode", "regex", False), (2, None, "x", True)]
    evidence = spark.createDataFrame(ev, "course int, field string, method string, selected boolean")
    calls = spark.createDataFrame([("a", 0.25), ("a", 0.5), ("b", None)], "run string, cost double")
    got = {r.run: r for r in reports.run_summary(jobs, skips, courses, evidence, calls, ["duration", "study_mode"]).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.discovered, a.staged, a.skipped, a.skipped_domestic_only, a.skipped_fetch_failed, a.skipped_other) == (9, 3, 4, 3, 5, 0)
    assert (a.fill_duration, a.fill_study_mode, a.calls, a.cost) == (1.0, 0.333, 2, 0.75)
    assert [tuple(x.values()) for x in json.loads(a.methods)] == [("", "x", 1), ("duration", "ai", 1), ("duration", "regex", 2), ("study_mode", "null", 2), ("study_mode", "unknown", 1)]
    assert (b.staged, b.skipped_fetch_failed, b.skipped_other, b.fill_duration, b.methods, b.calls, b.cost) == (0, 7, 1, None, None, 1, 0.0)
    assert (c.discovered, c.skipped_fetch_failed, c.calls, c.cost, c.fill_study_mode) == (0, 0, 0, 0.0, None)


def test_quality_report(spark):
    schema = "id int, course_name string, degree_level string, international_fee double, has_central_fee_page boolean, ielts_overall double, pte_overall double, toefl_overall double, cambridge_overall double, duolingo_overall double, duolingo_accepted boolean, cambridge_accepted boolean, pte_accepted boolean, toefl_accepted boolean, duration double, duration_term string, intake_months array<string>, course_location string, study_mode string, domestic_only boolean"
    bad = (None,) * 18
    df = spark.createDataFrame([(1, *bad, None), (2, *bad, True), (3, *bad, False)], schema)
    more = spark.createDataFrame([(1, "info", "duplicate_name")], "id int, severity string, code string")
    issues = reports.quality_issues(df, "id", more=more)
    each = df.where("id = 1").select(F.explode(quality.course_issues()).alias("i")).select("i.*").collect()
    assert {r.id for r in issues.collect()} == {1, 3}
    counts = reports.issue_counts(issues).first()
    by = lambda s: sum(r.severity == s for r in each)
    assert tuple(counts) == (2 * len(each) + 1, 2 * by("critical"), 2 * by("warning"), 2 * by("info") + 1)
    order = [(reports.SEVERITIES.index(r.severity), r.code, r.id) for r in reports.in_report_order(issues, "id").collect()]
    assert order == sorted(order)
    assert tuple(reports.issue_counts(issues.limit(0)).first()) == (0, 0, 0, 0)
