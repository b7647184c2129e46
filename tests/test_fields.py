"""Fixtures of the page extractors: what each rule reads, and which of two rules wins."""

from __future__ import annotations

import pytest

from gristmill.functions import html

DETAIL = "https://a.org/courses/bachelor-of-law"


def read(body: str) -> dict[str, tuple[str, str]]:
    """The first result of each field."""
    parts, _ = html._read(DETAIL, f"<html><body>{body}</body></html>")
    found: dict[str, tuple[str, str]] = {}
    for key, value, _, method in html.fields.fields(parts)[0]:
        found.setdefault(key, (value, method))
    return found


@pytest.mark.parametrize(
    ("said", "expected"),
    [
        ("IELTS overall 6.5 with no band below 6.0", {"ielts_overall": "6.5", "ielts_reading": "6.0"}),
        ("Minimum IELTS 7.0 with 7.0 in speaking and 6.5 in listening, reading and writing", {"ielts_overall": "7.0", "ielts_speaking": "7.0", "ielts_writing": "6.5", "ielts_listening": "6.5"}),
        ("IELTS Academic: 6.5 overall, 6.0 in each band", {"ielts_overall": "6.5", "ielts_speaking": "6.0"}),
        ("IELTS overall 6.5 (Listening 6.0, Reading 6.5, Writing 5.5, Speaking 6.0)", {"ielts_overall": "6.5", "ielts_reading": "6.5", "ielts_writing": "5.5"}),
        ("a score of 6.5 in IELTS", {"ielts_overall": "6.5"}),
        ("PTE Academic 50 36", {"pte_overall": "50.0", "pte_listening": "36.0"}),
        ("PTE 50 ... 80", {"pte_overall": "50.0", "pte_listening": None}),
        ("PTE Academic 58 with no communicative skill below 50", {"pte_overall": "58.0", "pte_writing": "50.0"}),
        ("TOEFL iBT 79, Cambridge 176, Duolingo English Test 105", {"toefl_overall": "79.0", "cambridge_overall": "176.0", "duolingo_overall": "105.0"}),
        ("TOEFL of 12 and IELTS of 95", {"toefl_overall": None, "ielts_overall": None}),
    ],
)
def test_english(said, expected):
    found = read(f"<p>{said}</p>")
    assert {k: found.get(k, (None,))[0] for k in expected} == expected


def test_english_tables():
    levels = "<table><tr><th>Test</th><th>Foundation</th><th>Bachelor</th><th>Master</th></tr><tr><td>IELTS</td><td>5.0</td><td>6.0</td><td>6.5</td></tr><tr><td>PTE</td><td>36</td><td>50</td><td>58</td></tr></table>"
    found = read(levels)
    assert found["ielts_overall"] == ("6.5", "english.program_table") and found["pte_overall"] == ("58.0", "english.program_table")
    equal = "<p>IELTS 6.5 is needed.</p><table><tr><th>IELTS</th><th>PTE</th><th>Duolingo</th></tr><tr><td>6.0</td><td>50</td><td>95</td></tr><tr><td>6.5</td><td>58</td><td>110</td></tr></table>"
    assert read(equal)["duolingo_overall"][0] == "110.0"


@pytest.mark.parametrize(
    ("body", "amount", "method"),
    [
        ("<dl><dt>Tuition fee</dt><dd>$32,000 per year</dd></dl> <p>Graduates have a salary of $90,000.</p>", "32000.0", "fee.structural"),
        ("<p>International tuition is $30,000. Domestic students pay $9,000 fees.</p>", "30000.0", "fee.scored"),
        ("<p>The salary of a graduate is $85,000.</p>", None, None),
        ("<p>Tuition: $20,000 first year. Total tuition for the full course: $61,000.</p>", "61000.0", "fee.scored"),
        ("<p>A prize of $999,999 for tuition.</p>", None, None),
    ],
)
def test_fee(body, amount, method):
    assert read(body).get("international_fee", (None, None)) == (amount, method)


@pytest.mark.parametrize(
    ("body", "said"),
    [
        ("<strong>Duration</strong><span>2 years</span><p>Students need 12 years of schooling.</p>", "2 years"),
        ("<p>The course takes 3 years full-time or 6 years part-time.</p>", "3 years"),
        ("<p>A course of 8 years, that is 8 months full time.</p>", "8 months"),
        ("<p>Students need 12 years of schooling.</p>", None),
    ],
)
def test_duration(body, said):
    assert read(body).get("duration", (None,))[0] == said


@pytest.mark.parametrize(
    ("body", "months", "method"),
    [
        ("<table><tr><th>Intake</th><td>Feb 2026</td><td>July 2026</td></tr></table>", "February;July", "intake.pivot"),
        ("<dl><dt>Intakes</dt><dd>March, Sept</dd></dl>", "March;September", "intake.structural"),
        ("<p>You may apply now. Start dates are 3 March and 14 July</p>", "March;July", "intake.day_month"),
        ("<p>Offered in Semester 1 and Semester 2. You may march on.</p>", "February;July", "intake.semester"),
        ("<p>You may apply.</p>", None, None),
    ],
)
def test_intake(body, months, method):
    assert read(body).get("intake_months", (None, None)) == (months, method)


@pytest.mark.parametrize(
    ("body", "mode"),
    [
        ("<span class='study-mode'>Online</span><p>Our campus is large.</p>", ("Online", "study_mode:span")),
        ("<div data-study-mode='On campus'>x</div>", ("On Campus", "study_mode:data")),
        ("<strong>Study mode</strong><span>Blended</span>", ("Blended", "study_mode:strong")),
        ("<p>Study 50% online and visit the campus.</p>", ("Blended", "study_mode:share")),
        ("<p>Nothing.</p>", (None, None)),
    ],
)
def test_study_mode(body, mode):
    assert read(body).get("study_mode", (None, None)) == mode


def test_location_and_description():
    assert read("<table><tr><th>Campus</th><td>Perth</td></tr></table><strong>Location:</strong><span>Sydney</span>")["course_location"] == ("Sydney", "location.strong")
    assert read("<p>It is taught in person at Sydney South.</p>")["course_location"] == ("Sydney South", "location.in_person")
    long = "words " * 10
    assert read(f"<p>{long}first</p><h2>Course overview</h2><p>{long}second</p>")["description"] == (f"{long}second", "description.heading")
    assert read(f"<p>{long}first</p><main><p>{long}third</p></main>")["description"] == (f"{long}third", "description.main")


def test_fee_tables(spark):
    two = "<table><tr><th>International tuition fees</th></tr><tr><th>Course</th><th>Subject fee</th><th>Course fee</th></tr><tr><td>Master of IT</td><td>$3,000</td><td>$36,000</td></tr></table>"
    one = "<table><tr><th>Program</th><th>Domestic</th><th>International per semester</th></tr><tr><td>Law</td><td>$9,000</td><td>$15,000</td></tr><tr><td>Art</td><td>$9,000</td><td>n/a</td></tr></table>"
    pages = spark.createDataFrame([(1, "https://a.org/f", two), (2, None, one), (3, None, None), (4, "x", "")], "page_id long, url string, html string")
    assert {(r.page_id, r.program, r.amount, r.term) for r in html.fee_tables(pages).collect()} == {(1, "Master of IT", 36000.0, "Full Course"), (2, "Law", 15000.0, "Semester")}


def test_coded_rows(spark):
    text = "Fees 2026\nUndergraduate\nBachelor of Law\n(Honours) 081234K 24 $1,500 $12,000 $36,000\nMaster of IT 099999B 16 1,800 14,400 14,400\n"
    found = html.coded_rows(spark.createDataFrame([(1, text), (2, "Bachelor of Art 081234K 24 1,500 12,000 36,000"), (3, None)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.code, r.program, r.amount, r.term) for r in found} == {(1, "081234K", "Bachelor of Law (Honours)", 36000.0, "Full Course"), (1, "099999B", "Master of IT", 14400.0, "Annual")}


def test_page_type(spark):
    links = "".join(f"<a href='/courses/c{i}'>Course {i}</a>" for i in range(8))
    rows = [(1, DETAIL, "<h1>Bachelor of Law</h1>"), (2, "https://a.org/courses", f"<h1>All bachelor degrees</h1>{links}"), (3, "https://a.org/", "<h1>News</h1>"), (4, "https://a.org/x", "<p>This course has a fee.</p>"), (5, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.kind for r in html.parse(pages).select("page_id", html.page_type().alias("kind")).collect()}
    assert got == {1: "detail", 2: "listing", 3: "unknown", 4: "detail", 5: "unknown"}


def test_other_columns_pass(spark):
    pages = spark.createDataFrame([(1, DETAIL, "<h1>Law</h1>", None, [1]), (2, DETAIL, "<h1>Law</h1>", 5, None)], "page_id long, url string, html string, `a.b` int, text array<int>")
    got = {(r["page_id"], r["a.b"], tuple(r["text"] or ())) for r in html.extract(pages).where("field_key = 'course_name'").collect()}
    assert got == {(1, None, (1,)), (2, 5, ())}
    assert html.extract(pages.limit(0)).count() == 0 and html.parse(pages.limit(0)).count() == 0


def test_fee_lines(spark):
    text = (
        "Fees 2026\nMaster of Law\nCampus: City\n\n$32,000 per year\nBachelor of Arts\nfull time\n3 years\nA$28,500\n"
        "Diploma of Music — $9,900 per trimester\nabcd\n$1,500\nUSD 500 and AUD 41,000 per semester\nShort - A$12,000"
    )
    tail = "Diploma of Web: A$20,000 p.a."
    df = spark.createDataFrame([(1, text, "x"), (2, tail, "y"), (3, None, "z"), (4, "$9,000\n$8,000", "w")], "doc_id long, text string, program string")
    got = html.fee_lines(df.drop("program")).collect()
    assert [(r.doc_id, r.program, r.amount, r.term) for r in got] == [
        (1, "Campus: City", 32000.0, "Annual"), (1, "3 years", 28500.0, None), (1, "3 years", 9900.0, "Trimester"), (1, "$1,500", 41000.0, "Semester"), (1, "$1,500", 12000.0, "Semester"),
        (2, "Diploma of Web", 20000.0, "Annual"),
    ]
    # One to three lines between a name and its price are looked back over, four are not.
    for n, want in ((0, "Master of Law"), (1, "Master of Law"), (2, "Master of Law"), (3, None)):
        one = spark.createDataFrame([(1, "\n".join(["Master of Law", *["$ab"] * n, "$30,000"]))], "doc_id long, text string")
        assert [r.program for r in html.fee_lines(one).collect()] == ([want] if want else []), n


def test_english_by_level(spark):
    page = (
        "<table><tr><th>Fees</th><th>x</th></tr><tr><td>a</td><td>b</td></tr></table><table><tr><th>Test</th><th>EAP 2</th><th>Bachelor and Postgraduate</th><th>Advanced Diploma</th></tr>"
        "<tr><td>IELTS Academic</td><td>Overall 5.0</td><td>Overall 6.5, no band under 6</td><td>overall 5.5</td></tr><tr><td>PTE Academic</td><td>score of 36</td><td>Academic score of 58</td></tr>"
        "<tr><td>TOEFL iBT</td><td>-</td><td>Total score of 79</td><td>score of 60</td></tr><tr><td>Other</td><td>score of 10</td><td>score of 11</td><td>score of 12</td></tr></table>"
    )
    no_levels = "<table><tr><th>Test</th><th>Score</th><th>Note</th></tr><tr><td>IELTS</td><td>Overall 6</td><td></td></tr></table>"
    df = spark.createDataFrame([(1, "https://a.org/x", page), (2, "https://a.org/y", no_levels), (3, None, None)], "id int, url string, html string")
    got = {(r.id, r.level, r.test): r.score for r in html.english_by_level(df).collect()}
    want = {("ielts", 6.5), ("pte", 58.0), ("toefl", 79.0)}
    assert got == {**{(1, level, t): s for level in (None, "postgraduate", "undergraduate") for t, s in want}, (1, "diploma", "ielts"): 5.5, (1, "diploma", "toefl"): 60.0}


def test_coded_rows_year(spark):
    row = "Master of Law 012345A $1,000 $20,000 $40,000\nMaster of Art 012345B $1,000 $20,000 $20,000\n"
    texts = ["Tuition fees 2026\n" + row, "2027 international fees\n" + row, "Fees\n2026\n" + row, row]
    got = html.coded_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.year) for r in got} == {(0, 2026), (1, 2027), (2, None), (3, None)}


def test_bounds_of_fees(spark):
    """The library believes fees up to 200,000; a caller's own bounds take their place."""
    page = "<table><tr><th>Course</th><th>International fee per year</th></tr><tr><td>Master of Law</td><td>$1,209,999</td></tr></table>"
    pages = spark.createDataFrame([(1, "https://a.org/fees", page)], "page_id long, url string, html string")
    texts = spark.createDataFrame([(1, "Tuition fees 2026\nMaster of Law 900000A $1,200 $209,999 $219,999\nMaster of Art 120000K $1,200 $209,999 $219,999\n")], "doc_id long, text string")
    assert html.fee_tables(pages).count() == 0 and html.coded_rows(texts).count() == 0
    assert [r.amount for r in html.fee_tables(pages, bounds=(2000, 2e6)).collect()] == [1_209_999.0]
    assert sorted((r.code, r.amount) for r in html.coded_rows(texts, bounds=(2000, 2e6)).collect()) == [("120000K", 219_999.0), ("900000A", 219_999.0)]
