"""Fill rates, baselines, alerts, scores and gates over staged rows and their evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import MONTHS, col, first_match, is_blank
from gristmill.functions.urls import coarse_prefix
from gristmill.operators.rows import counts_map, first_per, low_quantile

ENGLISH = ("ielts_overall", "pte_overall", "toefl_overall", "cambridge_overall", "duolingo_overall")
#: Floors of fill rates where a field has no baseline; any other field has 0.5.
FLOORS = {
    "ielts_overall": 0.85, "toefl_overall": 0.70, "pte_overall": 0.70, "cambridge_overall": 0.60, "duolingo_overall": 0.60, "international_fee": 0.70, "domestic_fee": 0.50, "fee_term": 0.65,
    "duration": 0.90, "intake_months": 0.85, "degree_level": 0.90, "category": 0.80,
}
#: Fixed values: (rule, fields or none for all, method's beginning, share above which it tells, severity).
METHOD_RULES = (("vision_dominance", ENGLISH, "per_course_vision", 0.40, "warning"), ("sibling_cache_dominance", None, "sibling_cache:", 0.30, "warning"), ("ai_fallback_dominance", None, "ai_fallback", 0.25, "critical"))
BAD_URL = r"(facebook|instagram|icon[-_]|^link\.|logo)"
#: Fields of a complete row besides the English score.
REVIEWED = ("course_name", "degree_level", "category", "study_mode", "course_location", "duration", "intake_months", "international_fee", "description", "academic_level", "academic_score", "other_requirement")
#: Test, low and high scores that no IELTS of 6 at most, or of the last number at least, goes with.
COHERENCE = (("toefl", 85, 75, 7.0), ("pte", 65, 45, 7.0), ("duolingo", 115, 95, 7.5), ("cambridge", 176, 162, 7.0))


def fill_rates(evidence: DataFrame, staged: DataFrame, run: str, entity: str, field: str, method: str, digits: int = 4, strict: bool = False) -> DataFrame:
    """Rows (run, field, method, n, total, fill_rate): of a run's staged entities, the share with evidence of a field by a method; halves go to even.

    As defined, evidence of entities that are not staged counts too; strict leaves it out. A run without staged entities has no rows.
    """
    totals = staged.groupBy(run).agg(F.count_distinct(entity).alias("total"))
    rows = evidence.join(staged.select(run, entity).distinct(), [run, entity], "left_semi") if strict else evidence
    counted = rows.groupBy(run, field, method).agg(F.count_distinct(entity).alias("n"))
    return counted.join(totals, run).withColumn("fill_rate", F.bround(F.col("n") / F.col("total"), digits))


def method_maps(evidence: DataFrame, run: str, field: str, method: str) -> DataFrame:
    """Rows (run, field, methods): a JSON map of methods to counts."""
    return counts_map(evidence, [run, field], method, "methods")


def fill_alerts(rates: DataFrame, baselines: DataFrame | None, keys: Sequence[str], field: str, rate: str, floors: Mapping[str, float] = FLOORS, default: float = 0.5) -> DataFrame:
    """Rows (keys, field, rate, floor, severity) of rates below their floor; critical if by 0.2 or more. baselines: (field, floor_threshold)."""
    known = first_match(((F.col(field) == f, v) for f, v in floors.items()), default)
    rows = rates if baselines is None else rates.join(baselines.select(field, "floor_threshold"), field, "left")
    floor = known if baselines is None else F.coalesce("floor_threshold", known)
    out = rows.select(*keys, field, F.col(rate).alias("rate"), floor.alias("floor")).where("rate < floor")
    return out.withColumn("severity", F.when(F.round(F.col("floor") - F.col("rate"), 9) >= 0.2, "critical").otherwise("warning"))


def method_alerts(metrics: DataFrame, keys: Sequence[str], field: str, method: str, count: str, rules: Sequence[tuple] = METHOD_RULES) -> DataFrame:
    """Rows (keys, field, rule, severity, share) where a method's share of a field's values is above its rule's threshold. One pass, whatever the number of rules."""
    share = lambda prefix: F.sum(F.when(F.startswith(F.col(method), F.lit(prefix)), F.col(count)).otherwise(0)) / F.nullif(F.sum(count), F.lit(0))
    told = metrics.groupBy(*keys, field).agg(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), share(p).alias("share"), F.lit(float(t)).alias("threshold"), F.lit(None if fs is None else list(fs)).cast("array<string>").alias("fields")) for r, fs, p, t, s in rules]).alias("told"))
    rows = told.select(*keys, field, F.explode("told").alias("t")).where((F.col("t.share") > F.col("t.threshold")) & (F.col("t.fields").isNull() | F.array_contains("t.fields", F.col(field))))
    return rows.select(*keys, field, "t.rule", "t.severity", "t.share")


def bad_sources(evidence: DataFrame, keys: Sequence[str], url: str, pattern: str = BAD_URL) -> DataFrame:
    """Rows (keys, n): evidence whose source is no page; any is critical."""
    return evidence.where(F.lower(F.col(url)).rlike(pattern)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def new_prefixes(rows: DataFrame, run: str, run_order: str, url: str, current: object = None, lookback: int = 4, most: int = 5) -> DataFrame:
    """Rows (prefix, n): prefixes with more than most rows in the current run (the largest one, if none is named) and none in the last lookback runs; none without earlier runs."""
    if current is None:
        latest = rows.agg(F.max(run).alias("__current"))
    else:
        latest = rows.sparkSession.range(1).select(F.lit(current).alias("__current"))
    rows = rows.join(F.broadcast(latest))
    at = rows.withColumn("prefix", coarse_prefix(url))
    now = at.where(F.col(run) == F.col("__current"))
    start = now.agg(F.min(run_order).alias("__start"))
    past_runs = rows.where(F.col(run) != F.col("__current")).groupBy(run).agg(F.min(run_order).alias("__at")).join(start, F.col("__at") < F.col("__start")).orderBy(F.desc("__at")).limit(lookback).select(run)
    past = at.join(past_runs, run, "left_semi").select("prefix").distinct()
    found = now.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).join(past, "prefix", "left_anti")
    return found.join(past_runs.limit(1).select(F.lit(True).alias("__any")), F.lit(True), "left_semi")


def baselines(rates: DataFrame, keys: Sequence[str], run: str, rate: str, least: int = 3, least_floor: float = 0.5, slack: float = 0.05) -> DataFrame:
    """Rows (keys, runs, expected, floor): the median of at least so many runs, and a floor a little below their low tenth."""
    grouped = rates.groupBy(*keys).agg(F.count_distinct(run).alias("runs"), F.bround(F.percentile(rate, F.lit(0.5)), 4).alias("expected")).where(F.col("runs") >= least)
    low = low_quantile(rates, keys, rate, 0.1)
    return grouped.join(low, list(keys)).select(*keys, "runs", "expected", F.round(F.greatest(F.lit(least_floor), F.col("low") - slack), 4).alias("floor"))


def _known(c: str) -> Column:
    return F.col(c).isNotNull()


def confidence(central_fee: str = "has_central_fee_page") -> Column:
    """0 to 100 points for a fee (25), an English score (25), a duration (20), intakes (20) and a mode (10)."""
    points = [
        (F.coalesce(F.col(central_fee), F.lit(False)) | F.coalesce(F.col("international_fee") > 0, F.lit(False)), 25),
        (F.coalesce(*[F.col(c) for c in ENGLISH]).isNotNull(), 25),
        (F.coalesce(F.col("duration") > 0, F.lit(False)), 20),
        (F.coalesce(F.size("intake_months") > 0, F.lit(False)), 20),
        (~is_blank("study_mode"), 10),
    ]
    return sum((F.when(ok, n).otherwise(0) for ok, n in points), F.lit(0))


def confidence_level(score: Column) -> Column:
    return F.when(score >= 80, "pass").when(score >= 60, "warn").otherwise("low")


def filled(df: DataFrame, fields: Sequence[str] = REVIEWED) -> list[tuple[str, Column]]:
    """(field, whether it has a value): blank texts, empty lists and zero are none."""
    kinds = dict(df.dtypes)
    test = lambda f: F.lit(False) if f not in kinds else F.coalesce(F.size(f) > 0, F.lit(False)) if kinds[f].startswith("array") else ~is_blank(f) if kinds[f] == "string" else F.coalesce(F.col(f) != 0, F.lit(False))
    return [(f, test(f)) for f in fields]


def completeness(df: DataFrame) -> DataFrame:
    """df with completeness, the share of 13 slots in percent (halves to even), and missing, the slots without a value."""
    slots = [*filled(df), ("english_test", F.coalesce(F.greatest(*[F.col(c) for c in ENGLISH]) > 0, F.lit(False)))]
    n = sum((F.when(ok, 1).otherwise(0) for _, ok in slots), F.lit(0))
    missing = F.filter(F.array(*[F.when(~ok, F.lit(f)) for f, ok in slots]), lambda x: x.isNotNull())
    return df.withColumn("completeness", F.bround(n / len(slots) * 100).cast("int")).withColumn("missing", missing)


def publish_reason(name: str = "course_name", level: str = "degree_level", score: str = "completeness", sure: str = "confidence", least: int = 85) -> Column:
    """The first reason against publishing a row, null for none."""
    return first_match(
        [
            (F.length(F.trim(F.coalesce(F.col(name), F.lit("")))) < 3, "name_too_short"),
            (is_blank(level), "missing_degree_level"),
            (F.coalesce(*[F.col(c) for c in ENGLISH]).isNull(), "missing_english"),
            (F.coalesce(F.col(score), F.lit(0)) < least, "low_completeness"),
            (F.col(sure) < 85, "low_confidence"),
        ]
    )


def eligibility(df: DataFrame, least: int = 75) -> DataFrame:
    """Rows of completeness() with blockers, warnings and struct verdict(status, reason).

    Name, level and English alone block. A row without a blocker goes to review only if its completeness is below least; else it is
    ready, and its reason ok. The reason lists what blocks, what else is missing and the warnings, each part only where it has any.
    """
    has = lambda c: ~is_blank(c) if c in df.columns else F.lit(False)
    no_english = F.array_contains("missing", "english_test")
    listed = lambda pairs: F.filter(F.array(*[F.when(test, F.lit(said) if isinstance(said, str) else said) for test, said in pairs]), lambda x: x.isNotNull())
    blockers = listed([(F.length(F.trim(F.coalesce(F.col("course_name"), F.lit("")))) < 3, "course_name"), (~has("degree_level"), "degree_level"), (no_english, "english_test")])
    low = F.col("completeness") < least
    warnings = listed(
        [
            (~has("academic_level") & ~has("academic_score"), "missing academic requirement"),
            (~has("category"), "missing category"),
            (~has("study_mode"), "missing study_mode"),
            (low, F.concat(F.lit("completeness "), F.col("completeness").cast("string"), F.lit(f"% < {least}%"))),
        ]
    )
    rows = df.withColumn("blockers", blockers).withColumn("warnings", warnings)
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    told = F.concat_ws(" | ", part("Publish blocked: ", F.col("blockers")), part("Missing: ", F.array_except("missing", "blockers")), part("Warnings: ", F.col("warnings")))
    review = (F.size("blockers") > 0) | low
    return rows.withColumn("verdict", F.struct(F.when(review, "review").otherwise("ready").alias("status"), F.when(review, told).otherwise("ok").alias("reason")))


def _issue(condition: Column, severity: str, code: str) -> Column:
    return F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))


def coherence_issues() -> list[Column]:
    """Scores that no IELTS score beside them goes with."""
    out = []
    for test, high, low, from_ielts in COHERENCE:
        score, ielts = F.col(f"{test}_overall"), F.col("ielts_overall")
        out.append(_issue(((ielts <= 6.0) & (score >= high)) | ((ielts >= from_ielts) & (score <= low)), "warning", f"english_coherence_{test}"))
    return out


def course_issues(fee_range: tuple[float, float] = (500, 250_000), longest: Mapping[str, float] | None = None, generic: str = r"(?i)^(courses?|programs?|undergraduate|postgraduate|study areas?)$", junk: str = r"(?i)(privacy|copyright|abn |contact us|all rights)") -> Column:
    """An array of (severity, code): what is wrong with a staged row."""
    name, fee, term = F.coalesce(F.col("course_name"), F.lit("")), F.col("international_fee"), F.regexp_replace(F.lower(F.coalesce(F.col("duration_term"), F.lit(""))), "s$", "")
    central = F.coalesce(F.col("has_central_fee_page"), F.lit(False))
    limits = longest or {"year": 10, "month": 120, "week": 500}
    odd = first_match(((term == t, (F.col("duration") <= 0) | (F.col("duration") > most)) for t, most in limits.items()), False)
    months, valid = F.col("intake_months"), F.array(*[F.lit(m) for m in MONTHS])
    none = F.coalesce(F.size(months), F.lit(0)) <= 0
    tests = [_issue((F.col(f"{t}_accepted") == F.lit(False)) & _known(f"{t}_overall"), "warning", f"test_not_accepted_but_scored_{t}") for t in ("duolingo", "cambridge", "pte", "toefl")]
    checks = [
        _issue(name == "", "critical", "missing_course_name"), _issue((name != "") & name.rlike(generic), "critical", "generic_course_title"), _issue((name != "") & ~name.rlike(generic) & (F.length(name) < 8), "warning", "suspiciously_short_title"),
        _issue(fee.isNull() & ~central, "critical", "missing_international_fee"), _issue(fee.isNull() & central, "warning", "missing_international_fee_central_page"),
        _issue(fee < fee_range[0], "critical", "fee_too_low"), _issue(fee > fee_range[1], "critical", "fee_too_high"),
        _issue(F.coalesce(*[F.col(c) for c in ENGLISH[:4]]).isNull(), "warning", "missing_english_requirement"), *tests, *coherence_issues(),
        _issue(F.col("duration").isNull(), "warning", "missing_duration"), _issue(F.col("duration").isNotNull() & odd, "warning", "suspicious_duration"),
        _issue(none, "info", "missing_intake_months"), _issue(~none & F.exists(months, lambda m: ~F.array_contains(valid, m)), "warning", "invalid_intake_months"), _issue(F.size(months) > 12, "warning", "too_many_intake_months"),
        _issue(is_blank("course_location"), "info", "missing_location"), _issue(~is_blank("course_location") & F.col("course_location").rlike(junk), "warning", "suspicious_location"),
        _issue(is_blank("study_mode"), "info", "missing_study_mode"), _issue(is_blank("degree_level"), "warning", "missing_degree_level"),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def dominant(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.75, least: int = 5) -> DataFrame:
    """Rows (keys, value, n, known): a value that so large a share of at least so many known ones have."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    totals = n.groupBy(*keys).agg(F.sum("n").alias("known")) if keys else n.agg(F.sum("n").alias("known"))
    joined = n.join(totals, list(keys)) if keys else n.crossJoin(totals)  # one row of totals
    return joined.where((F.col("known") >= least) & (F.col("n") / F.col("known") >= share))


def health_status(total: Column, missing_fee: Column, missing_english: Column, anomalies: Column, with_fee: Column, fees: Column) -> Column:
    """NO_DATA, FAIL, WARN or PASS from a university's shares (in percent) and counts."""
    same_fee = (with_fee >= 5) & (fees == 1)
    return F.when(total == 0, "NO_DATA").when((missing_fee > 40) | (missing_english > 40) | (anomalies > 0) | same_fee, "FAIL").when((missing_fee > 15) | (missing_english > 15), "WARN").otherwise("PASS")


def warnings_and_limits(df: DataFrame) -> DataFrame:
    """df with durations that no award has set to null and a warning of each; limits in years by level."""
    level = F.lower(F.coalesce(F.col("degree_level"), F.lit("")))
    years = F.col("duration_years")
    top = F.when(level.contains("doctor"), 12.0).when(level.contains("master") | level.contains("graduate"), 4.0).otherwise(7.0)
    odd = F.when(years > top, "duration_too_long").when(years < 0.25, "duration_too_short").when(level.contains("bachelor") & (years < 2), "bachelor_too_short")
    return df.withColumn("warning", odd).withColumn("duration_years", F.when(odd.isNull(), years))


def without_unproven(df: DataFrame, evidence: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """df with fields set to null for which no evidence has both a source and a snippet."""
    ok = evidence.where(~is_blank("source_url") & ~is_blank("snippet")).groupBy(key).agg(F.collect_set("field_key").alias("__proven"))
    joined = df.join(ok, key, "left")
    return joined.select(*[F.when(F.array_contains("__proven", c), F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns])


def extraction_gate(courses: DataFrame, evidence: DataFrame, key: str, fields: Sequence[str] = ("international_fee", "ielts_overall", "duration", "intake_months", "course_name", "study_mode"), least: float = 0.7, coverage: float = 0.9, classes: Sequence[str] = ("category", "sub_category")) -> DataFrame:
    """Rows (key, decision), one for each course: skip, classification_only or full.

    A field counts if the course has a value for it and its best evidence is sure enough; a course without evidence is full. With
    enough fields, what decides is whether the course has its classes.
    """
    best = evidence.where(F.col("field_key").isin(list(fields))).groupBy(key).agg(*[F.max(F.when(F.col("field_key") == f, F.col("confidence"))).alias(f"__{i}") for i, f in enumerate(fields)])
    has = dict(filled(courses, [*fields, *classes]))
    counted = courses.select(key, *[has[f].alias(f"__h{i}") for i, f in enumerate(fields)], *[has[c].alias(f"__c{i}") for i, c in enumerate(classes)]).join(best, key, "left")
    n = sum((F.when(F.col(f"__h{i}") & (F.col(f"__{i}") >= least), 1).otherwise(0) for i in range(len(fields))), F.lit(0))
    classed = F.lit(True)
    for i in range(len(classes)):
        classed = classed & F.col(f"__c{i}")
    enough = n / len(fields) >= coverage
    return counted.select(key, F.when(enough & classed, "skip").when(enough, "classification_only").otherwise("full").alias("decision"))


def staging_gate(central_fee: Column, hosts_without_place: Sequence[str] = (), endings: str = r"(?i)\.(pdf|docx?|jpg|png)$") -> Column:
    """The first reason to turn a row away, null for none."""
    name, url, mode = F.coalesce(F.col("course_name"), F.lit("")), F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("study_mode"), F.lit(""))
    award = r"(?i)\b(bachelor|master|doctor|diploma|certificate|associate|graduate|phd|mba|honours|juris)\b"
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1))
    return first_match(
        [
            (url.rlike(endings), "non_page_url"), (F.lower(url).rlike("-online/?$"), "online_slug"), (~name.rlike(award), "no_degree_word"), (F.coalesce(F.col("domestic_only"), F.lit(False)), "domestic_only"),
            ((mode == "Online") & is_blank("course_location"), "online_only"), (host.isin(list(hosts_without_place)) & is_blank("course_location"), "blank_location"),
            (F.col("international_fee").isNull() & ~central_fee, "no_international_fee"),
        ]
    )


def liveness(jobs: DataFrame, as_of: Column, heartbeat_minutes: int = 5, queued_minutes: int = 10) -> DataFrame:
    """jobs with state: stale (running without a heartbeat), stuck (queued too long) or ok."""
    stale = (F.col("status") == "running") & (F.coalesce("heartbeat_at", "started_at") < as_of - F.expr(f"interval {heartbeat_minutes} minutes"))
    stuck = (F.col("status") == "queued") & (F.col("created_at") < as_of - F.expr(f"interval {queued_minutes} minutes"))
    return jobs.withColumn("state", F.when(stale, "stale").when(stuck, "stuck").otherwise("ok"))


def latest_run(metrics: DataFrame, keys: Sequence[str], computed: str) -> DataFrame:
    """All metric rows of each key's latest computation, ties included."""
    return first_per(metrics, keys, [F.col(computed).desc_nulls_last()], ties=True)
