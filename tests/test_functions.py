"""Functions and operators on small rows of the catalogue's own shape."""

import datetime as dt

from pyspark.sql import functions as F

from gristmill.functions import domain, html, text, urls, values
from gristmill.operators import quality, resolution, rows


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_numbers_and_months(spark):
    assert one(spark, text.parse_number(F.lit("A$-32,000.5")), text.parse_number(F.lit("none")), text.parse_number(F.lit("-7"), False), text.parse_whole(F.lit("x1y2"))) == (-32000.5, None, 7.0, 12)
    assert one(spark, text.month_list(F.lit("Feb; Jul/xyz, february")))[0] == ["February", "July", "xyz"]
    assert one(spark, text.month_list(F.lit("Marketing; sept./" + "q" * 40)))[0] == ["Marketing", "September", "q" * 32]
    assert one(spark, text.is_slug(F.lit("part-time")), text.is_slug(F.lit("master-of-arts"))) == (False, True)
    assert one(spark, text.calendar_order(F.array(F.lit("July"), F.lit("x"), F.lit("February"))))[0] == ["February", "July", "x"]


def test_names(spark):
    assert one(spark, text.smart_title(F.lit("master of  it and the arts")), text.clean_name(F.lit("AB12 - Arts | Uni")), text.clean_name(F.lit("ab"))) == ("Master of IT and the Arts", "Arts", None)
    assert one(spark, text.log_level(F.lit("[Stage] Skipped x")), text.log_level(F.lit(None).cast("string")), text.skip_bucket(F.lit("NO_INTERNATIONAL_fee")), text.skip_bucket(F.lit(None).cast("string"))) == ("warn", "info", "no_international_fee", "other")
    assert one(spark, text.value_in_text(F.lit(32000.0), F.lit("costs 32,000 a year")), text.value_in_text(F.lit("x"), F.lit("y"))) == (True, False)
    assert one(spark, text.text_match(F.lit("Bolts and gears"), "the bolt"), text.text_match(F.lit("Gears"), "the")) == (True, False)


def test_urls(spark):
    assert one(spark, urls.without_fragment(F.lit("https://a.org/x/#y")), urls.without_fragment(F.lit("https://a.org/")), urls.without_params(F.lit("https://a.org/x?utm_source=1"))) == ("https://a.org/x", "https://a.org/", "https://a.org/x")
    assert one(spark, urls.classify(F.lit("https://a.org/courses")), urls.classify(F.lit("https://a.org/study/courses/law")), urls.classify(F.lit("https://a.org/news/x")), urls.classify(F.lit("https://a.org"))) == ("landing", "landing", "blocked", "other")
    kinds = {"/courses/design": "landing", "/courses/bachelor-of-design": "course", "/study/areas/arts/dance": "landing", "/courses/a/b/c": "course", "/x/courses/design": "course"}
    assert {u: one(spark, urls.classify(F.lit(f"https://a.org{u}")))[0] for u in kinds} == kinds
    assert one(spark, urls.coarse_prefix(F.lit("https://a.org")), urls.coarse_prefix(F.lit("https://a.org/x/y/z"))) == ("https://a.org", "https://a.org/x/y")
    rows_ = ["/c-2023/x", "/c-2024/x", "/handbook/handbook-2025/course/y", "/course/y", "/handbook/handbook-2021/course/z", "/handbook/handbook-2022/course/z", "/plain"]
    got = urls.latest_variants(spark.createDataFrame([(i, f"https://a.org{u}") for i, u in enumerate(rows_)], "id int, url string")).collect()
    assert sorted((r.id, r.url[13:]) for r in got) == [(1, "/c-2024/x"), (3, "/course/y"), (5, "/course/z"), (6, "/plain")]


def test_values(spark):
    assert one(spark, values.amount_label(F.lit(3.0), F.lit("year")), values.amount_label(F.lit(1.5), F.lit("year"))) == ("3 year", "1.5 year")
    assert one(spark, values.to_years(F.lit(18.0), F.lit("Months")), values.to_years(F.lit(1.0), F.lit("day")), values.to_years(F.lit(2.0), F.lit(None).cast("string")), values.to_years(F.lit(3.0), F.lit("per trimester"))) == (1.5, 1.0, 2.0, 1.0)
    assert [tuple(one(spark, values.weeks_as_term(F.lit(w)))[0]) for w in (10, 26, 104, 80)] == [(10.0, "Week"), (6.0, "Month"), (2.0, "Year"), (1.5, "Year")]
    total = lambda said, price: one(spark, values.yearly_total(F.lit(said), F.lit(price)))[0]
    assert total("192 credit points", 3000.0) == 72000.0 and total("144 credit points, 12 credit points each", 2000.0) == 24000.0
    assert total("4 units per trimester, 24 units in all", 1500.0) == 36000.0 and total("90 units", 1500.0) is None and total("24 units", 100.0) is None
    assert one(spark, values.is_empty_value(F.lit(0)), values.is_empty_value(F.lit("")), values.is_empty_value(F.lit("x"))) == (True, True, False)
    assert values.deep_merge({"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"b": 3}, "d": [2]}) == {"a": {"b": 3, "c": 2}, "d": [2]}
    assert one(spark, values.spread_json(F.lit('{"a": 1, "b": 2}'), {"b": F.lit("own")}))[0] == {"a": "1", "b": "own"}
    assert one(spark, values.expand_codes(F.lit("SYD | XXX"), {"SYD": "Sydney"}), values.json_is_empty(F.lit("[]")), values.json_is_empty(F.lit('{"a":1}')))[0:3] == (["Sydney", "XXX"], True, False)


def test_classifiers(spark):
    assert one(spark, domain.degree_level(F.lit("Graduate Certificate of Law"))["level"], domain.degree_level(F.lit("Law"), F.lit("AQF Level 7"))["level"], domain.degree_level(F.lit("Law"), F.lit("none"))["level"]) == ("Graduate Certificate", "Bachelor's", None)
    assert one(spark, domain.degree_bucket(F.lit("Undergraduate Certificate"), F.lit("")), domain.degree_bucket(F.lit(None).cast("string"), F.lit("Doctor of X")), domain.degree_bucket(F.lit(""), F.lit("x"))) == ("postgraduate", "research", "unknown")
    assert one(spark, domain.is_pathway(F.lit("Diploma of English")), domain.is_pathway(F.lit("Diploma of Bridging")), domain.is_pathway(F.lit("Law"), F.lit(" ELICOS "))) == (True, False, True)
    assert one(spark, domain.best_category(F.lit("Master of cyber security law"), [("Law", ("law",)), ("IT", ("cyber security",))]), domain.best_category(F.lit("x"), [("Law", ("law",))])) == ("IT", None)
    assert one(spark, domain.category(F.lit("Master of IT (Nursing)"), [("IT", "IT", ("it",)), ("Health", "Nursing", ("nursing",))])["category"])[0] == "Health"


PAGE = """<html><head><title>Bachelor of Law - Uni</title><meta name="description" content="A long description of a law degree that is at least forty characters."><script>var fee = "$99,999";</script></head>
<body><h1>Law</h1><p>IELTS overall 6.5 with no band below 6.0. TOEFL iBT 79.</p><dl><dt>Duration:</dt><dd>3 years full-time</dd><dt>Intake</dt><dd>Feb and July</dd></dl>
<table><tr><th>Tuition fee</th><td>$32,000 per year</td></tr><tr><th>Campus</th><td>Sydney</td></tr></table><strong>Study mode</strong><div>x</div> CRICOS Code: 084932E. <a href="/course/a">a</a><a href="https://other.org/b">b</a></body></html>"""


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "https://a.org/course/law", PAGE), (2, None, None)], "page_id long, url string, html string")
    found = html.extract(pages)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.page_id, r.pos)):
        got.setdefault((r.page_id, r.field_key), (r.value, r.method))
    assert got[1, "course_name"] == ("Bachelor of Law", "course_name.title")
    assert got[1, "international_fee"] == ("32000.0", "fee.structural") and got[1, "fee_term"][0] == "Annual"
    assert got[1, "ielts_overall"][0] == "6.5" and got[1, "ielts_reading"][0] == "6.0" and got[1, "toefl_overall"][0] == "79.0"
    assert got[1, "duration"][0].startswith("3 year") and got[1, "intake_months"][0] == "February;July"
    assert got[1, "cricos_code"][0] == "084932E" and got[1, "course_location"][0] == "Sydney"
    parsed = html.parse(pages).where("page_id = 1").select("page.*").first()
    assert "99,999" not in parsed.text and parsed.links == ["https://a.org/course/a"]


def test_text_windows(spark):
    assert one(spark, html.near_keyword(F.lit("score 6.5 in IELTS"), "6.5", "ielts", 10), html.near_keyword(F.lit("6.5" + "x" * 200 + "ielts"), "6.5", "ielts")) == (True, False)
    assert one(spark, F.to_json(html.tolerant_json(F.lit('```json\n{"a":1}\n```'))), html.tolerant_json(F.lit('{"a"')).isNull()) == ('{"a":1}', True)


def test_evidence(spark):
    ledger = spark.createDataFrame([(1, "f", "5", "central_page:x", 0.9, 1), (1, "f", "6", "regex", 0.5, 2), (1, "f", "6.0", "regex", 0.5, 3), (2, "f", None, "pre_seed", None, 4)], "course_id int, field_key string, value string, method string, confidence double, pos int")
    assert {(r.course_id, r.pos) for r in resolution.evidence_winner(ledger).collect()} == {(1, 2), (2, 4)}
    final = spark.createDataFrame([(1, "f", "5.0")], "course_id int, field_key string, final_value string")
    assert [r.pos for r in resolution.evidence_winner(ledger, final).collect()] == [1]


def test_conflicts_once_over_tiers(spark):
    ledger = spark.createDataFrame([(1, "f", "a", "p", 0.9, 1), (1, "f", " A ", "p", 0.8, 2), (1, "f", "b", "p", 0.7, 3), (1, "f", "b", "q", 0.9, 4), (1, "f", "a", "q", 0.9, 5), (1, "f", "c", "r", 0.9, 6), (1, None, "x", "r", 0.9, 7)], "c int, f string, v string, tier string, confidence double, pos int")
    found = resolution.conflict_pairs(ledger, ["c", "f"], "tier", "v", "pos", "confidence", "pos").collect()
    assert [(r.value_a, r.value_b, r.tier, r.id_a, r.id_b) for r in found] == [("a", "b", "p", 1, 3)]


def test_backfill_needs_a_quorum(spark):
    schema = "run int, id int, slot double, degree_level string, course_name string, method string, confidence double, ok boolean, pos int"
    results = spark.createDataFrame([(1, 1, 6.5, "Bachelor", "", "regex:a", 0.7, None, 1), (1, 2, 6.5, "Bachelor", "", "study_mode", 0.9, None, 2), (1, 3, 7.0, "Master", "", "regex", 0.9, None, 3), (1, 4, 6.0, "Bachelor", "", "vision_ocr:x", 0.9, None, 4), (1, 5, 0.0, "Bachelor", "", "regex", 0.9, None, 5), (1, 6, None, "Bachelor", "", "regex", 0.9, False, 6), (1, 7, None, "Master", "", "regex", 0.9, None, 7)], schema)
    got = {r.id: (r.slot, r.filled_by) for r in resolution.sibling_backfill(results, results, "run", "slot", "method", "confidence", "pos", "ok").collect()}
    assert got[5] == (6.5, "sibling_cache:undergraduate") and got[6] == (None, None) and got[7] == (None, None) and got[4] == (6.0, None)


def test_duplicates_and_gaps(spark):
    d = spark.createDataFrame([(1, 9, "Law", None, None, 5), (2, 9, "LAW", "x", None, 7), (3, 9, "law", "y", "z", 6), (4, 9, None, "q", "q", 1)], "id int, u int, name string, a string, b string, updated int")
    mapping = resolution.duplicate_map(d, ["u"], "name", "id")
    assert sorted(map(tuple, mapping.collect())) == [(2, 1), (3, 1)]
    got = {r.id: (r.a, r.b, r.updated) for r in resolution.gap_fill(d, mapping, "id", ["a", "b"], "updated").collect()}
    assert got == {1: ("x", None, 7), 4: ("q", "q", 1)}
    children = spark.createDataFrame([(1, "own"), (2, "dup"), (4, "other")], "id int, v string")
    assert sorted(map(tuple, resolution.repoint(children, mapping, "id", single=True).collect())) == [(1, "own"), (4, "other")]


def test_issues_and_coherence(spark):
    schema = "course_name string, degree_level string, international_fee double, has_central_fee_page boolean, ielts_overall double, pte_overall double, toefl_overall double, cambridge_overall double, duolingo_overall double, duolingo_accepted boolean, cambridge_accepted boolean, pte_accepted boolean, toefl_accepted boolean, duration double, duration_term string, intake_months array<string>, course_location string, study_mode string"
    row = ("Bachelor of Law", "Bachelor's", 499.0, False, 6.0, 65.0, 85.0, 176.0, 115.0, False, None, None, None, 10.1, "year", ["Smarch"], "City", "Online")
    codes = {i.code for i in spark.createDataFrame([row], schema).select(quality.course_issues()).first()[0]}
    assert codes == {"fee_too_low", "test_not_accepted_but_scored_duolingo", "english_coherence_toefl", "english_coherence_pte", "english_coherence_duolingo", "english_coherence_cambridge", "suspicious_duration", "invalid_intake_months"}
    empty = spark.createDataFrame([(None,) * 18], schema).select(quality.confidence(), quality.course_issues()).first()
    assert empty[0] == 0 and {"missing_course_name", "missing_international_fee", "missing_duration"} <= {i.code for i in empty[1]}


def test_alert_bounds(spark):
    rates = spark.createDataFrame([("r", "duration", 0.70), ("r", "x", 0.49), ("r", "known", 0.6)], "run string, field string, rate double")
    floors = spark.createDataFrame([("known", 0.61)], "field string, floor_threshold double")
    got = {r.field: r.severity for r in quality.fill_alerts(rates, floors, ["run"], "field", "rate").collect()}
    assert got == {"duration": "critical", "x": "warning", "known": "warning"}
    shares = spark.createDataFrame([("r", "ielts_overall", "per_course_vision", 4), ("r", "ielts_overall", "regex", 6), ("r", "fee", "sibling_cache:x", 31), ("r", "fee", "regex", 69)], "run string, field string, method string, n int")
    assert [(r.field, r.rule) for r in quality.method_alerts(shares, ["run"], "field", "method", "n").collect()] == [("fee", "sibling_cache_dominance")]


def test_rows_keep_their_null_rules(spark):
    d = spark.createDataFrame([(1, None), (2, 5.0), (3, 50.0)], "id int, v double")
    ids = lambda c: [r.id for r in d.where(c).orderBy("id").collect()]
    assert ids(rows.at_most_or_null("v", 10)) == [1, 2] and ids(rows.at_least("v", 5)) == [2, 3] and ids(rows.at_most_or_null("v", 0)) == [1, 2, 3]
    assert ids(rows.not_in("v", [5.0])) == [1, 3]
    assert [r.id for r in rows.in_request_order(d, "id", ["3", "x", 1, "3"]).collect()] == [3, 1]


def test_breaker_batch(spark):
    base = dt.datetime(2024, 1, 1)
    d = spark.createDataFrame([(1, base + dt.timedelta(seconds=s)) for s in (0, 30, 60, 61, 200)], "k int, ts timestamp")
    assert [r.recent for r in rows.rolling_count(d, ["k"], "ts", 60, 3).orderBy("ts").collect()] == [1, 2, 3, 3, 1]


def test_eligibility(spark):
    """Name, level and English block; a complete row is ready; a thin one without a blocker goes to review."""
    full = {"course_name": "Master of Arts", "degree_level": "Master", "ielts_overall": 6.5, "category": "Arts", "study_mode": "On campus", "academic_level": "Bachelor"}
    cases = [({}, 90, []), ({"course_name": "Ab"}, 90, []), ({"degree_level": " "}, 90, ["degree_level"]), ({"ielts_overall": None}, 90, ["english_test"]), ({"category": None}, 90, ["category"]), ({}, 50, ["duration"])]
    schema = "course_name string, degree_level string, ielts_overall double, category string, study_mode string, academic_level string, completeness int, missing array<string>"
    df = spark.createDataFrame([(*{**full, **changed}.values(), score, missing) for changed, score, missing in cases], schema).coalesce(1)
    got = [tuple(r.verdict) for r in quality.eligibility(df).select("verdict").collect()]
    assert got == [
        ("ready", "ok"),
        ("review", "Publish blocked: course_name"),
        ("review", "Publish blocked: degree_level"),
        ("review", "Publish blocked: english_test"),
        ("ready", "ok"),
        ("review", "Missing: duration | Warnings: completeness 50% < 75%"),
    ]


def test_extraction_gate(spark):
    """A course without evidence is full; a sure value that the course lacks does not count; classes come from the course."""
    courses = spark.createDataFrame([(1, "x", 5.0, "c"), (2, "x", 5.0, None), (3, None, 5.0, "c"), (4, "x", 5.0, "c")], "id int, a string, b double, k string")
    evidence = spark.createDataFrame([(i, f, 0.9) for i in (1, 2, 3) for f in "ab"] + [(1, "a", 0.1)], "id int, field_key string, confidence double")
    got = {r.id: r.decision for r in quality.extraction_gate(courses, evidence, "id", ("a", "b"), classes=("k",)).collect()}
    assert got == {1: "skip", 2: "classification_only", 3: "full", 4: "full"}
