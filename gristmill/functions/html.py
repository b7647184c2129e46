"""Pages to typed fields. A page is parsed and its parts are searched once per row, in Arrow batches; what a found text means is told by column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import fields
from gristmill.functions.domain import FEE_TERMS, currency, degree_level, eligibility, fee_term, matches, registration_code
from gristmill.functions.text import col

_SILENT = {"script", "style", "noscript", "template"}
_READ = {"title", "p", "dt", "dd", "strong", "th", "td", "h1", "h2", "h3", "h4", "div", "span", "li"}
_HEADINGS = {"h1", "h2", "h3", "h4"}
_TEXTS = pa.list_(pa.string())
_ROWS = pa.list_(_TEXTS)
_PARTS = {
    "text": ("string", pa.string()), "title": ("string", pa.string()), "h1": ("string", pa.string()), "meta": ("string", pa.string()), "paragraphs": ("array<string>", _TEXTS),
    "labels": ("array<struct<label: string, value: string>>", pa.list_(pa.struct([("label", pa.string()), ("value", pa.string())]))), "rows": ("array<array<string>>", _ROWS), "links": ("array<string>", _TEXTS),
}
_FOUND = pa.list_(pa.struct([("field_key", pa.string()), ("value", pa.string()), ("confidence", pa.float64()), ("method", pa.string())]))
_FEES = pa.list_(pa.struct([("program", pa.string()), ("amount", pa.float64()), ("kind", pa.string()), ("said", pa.string()), ("head", pa.string())]))


class _Page(HTMLParser):
    """Text of a page and the parts that fields are read from."""

    def __init__(self, url: str) -> None:
        super().__init__(convert_charrefs=True)
        self.url, self.silent, self.main, self.text = url, 0, 0, []
        self.open: dict[str, list[str]] = {}
        self.title = self.h1 = self.meta = self.heading = ""
        self.paragraphs: list[tuple[str, str, bool]] = []
        self.labels: list[tuple[str, str, str]] = []
        self.tables: list[list[list[str]]] = [[]]
        self.links: list[str] = []
        self.modes: list[tuple[str, str]] = []
        #: A label that waits for its value: the element's kind and the words.
        self.label: tuple[str, str] | None = None
        self.mode_span = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in self.open and tag not in ("div", "span"):
            self.handle_endtag(tag)
        if tag in _SILENT:
            self.silent += 1
        elif tag in _READ:
            self.open[tag] = []
        elif tag in ("main", "article"):
            self.main += 1
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr":
            self.tables[-1].append([])
            self.label = None
        elif tag == "meta" and (a.get("name") or a.get("property")) in ("description", "og:description"):
            self.meta = self.meta or (a.get("content") or "").strip()
        elif tag == "a" and a.get("href"):
            try:
                full = urljoin(self.url, a["href"])
                if urlsplit(full).netloc.lower() == urlsplit(self.url).netloc.lower():
                    self.links.append(full)
            except ValueError:
                pass
        if tag == "span":
            self.mode_span = bool(re.search(r"study-?mode|delivery", a.get("class") or ""))
        for name, said in attrs:
            if said and name in ("data-study-mode", "data-mode", "data-delivery"):
                self.modes.append(("data", said))
            elif said and name in ("data-location", "data-campus"):
                self.labels.append(("data", "location", said))

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in ("main", "article"):
            self.main = max(0, self.main - 1)
        elif tag == "table":
            self.tables.append([])
        if tag not in self.open:
            return
        said = " ".join("".join(self.open.pop(tag)).split())
        if tag == "title":
            self.title = self.title or said
        elif tag == "h1":
            self.h1 = self.h1 or said
        elif tag == "p":
            self.paragraphs.append((said, self.heading, self.main > 0))
        elif tag == "span" and self.mode_span:
            self.modes.append(("span", said))
        if tag in ("th", "td"):
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append(said)
        if tag in _HEADINGS or tag in ("dt", "strong", "th"):
            self.heading = said if tag in _HEADINGS else self.heading
            self.label = ("heading" if tag in _HEADINGS else tag, said.rstrip(":").lower())
        elif tag in ("dd", "td", "div", "span", "p", "li") and self.label and said and said.rstrip(":").lower() != self.label[1]:
            self.labels.append((*self.label, re.sub(rf"^{re.escape(self.label[1])}\s*:?\s*", "", said, flags=re.I)))
            self.label = None

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        self.text.append(data)
        for said in self.open.values():
            said.append(data)

    def parts(self) -> fields.Parts:
        tables = [rows for table in self.tables if (rows := [r for r in table if r])]
        return fields.Parts(" ".join(" ".join(self.text).split()), self.title, self.h1, self.meta, self.paragraphs, self.labels, tables, self.modes)


def _read(url: str | None, html: str | None) -> tuple[fields.Parts, list[str]]:
    page = _Page(url or "")
    page.feed(html or "")
    page.close()
    for tag in list(page.open):
        page.handle_endtag(tag)
    return page.parts(), list(dict.fromkeys(page.links))


def _each_page(pages: DataFrame, url: str, html: str, columns: dict[str, tuple[str, pa.DataType]], make: Callable[[fields.Parts, list[str]], tuple]) -> DataFrame:
    """pages without html, and with columns that make gives for each page. The other columns pass as they are."""
    kept = [c for c in pages.columns if c != html]
    # Plain names on the way to Python and back: those of pages may hold dots.
    plain = [f"__c{i}" for i in range(len(kept))]
    schema = T.StructType([T.StructField(n, pages.schema[c].dataType) for n, c in zip(plain, kept, strict=True)] + [T.StructField(n, T.DataType.fromDDL(t)) for n, (t, _) in columns.items()])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 200):
                some = b.slice(start, 200)
                made = [make(*_read(u, h)) for u, h in zip(some.column(some.num_columns - 2).to_pylist(), some.column(some.num_columns - 1).to_pylist(), strict=True)]
                arrays = [pa.array([m[i] for m in made], t) for i, (_, t) in enumerate(columns.values())]
                yield pa.RecordBatch.from_arrays(some.columns[: len(kept)] + arrays, [*plain, *columns])

    sent = pages.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(plain, kept, strict=True)], F.col(f"`{url}`").alias("__url"), F.col(f"`{html}`").alias("__html"))
    return sent.mapInArrow(run, schema).select(*[F.col(n).alias(c) for n, c in zip(plain, kept, strict=True)], *columns)


def parse(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with a struct page: text on one line without scripts and styles, title, first heading, description, paragraphs, labelled values, table rows and links of the same host."""

    def make(p: fields.Parts, links: list[str]) -> tuple:
        return p.text, p.title, p.h1, p.meta, [q[0] for q in p.paragraphs], [{"label": k, "value": v} for _, k, v in p.labels], [r for t in p.tables for r in t], links

    # One struct made in Python would be read whole; flat columns let Spark drop what nobody reads.
    flat = _each_page(pages, url, html, {f"__{n}": t for n, t in _PARTS.items()}, make)
    return flat.select(*[F.col(f"`{c}`") for c in pages.columns if c != html], F.struct(*[F.col(f"__{n}").alias(n) for n in _PARTS]).alias("page"))


DEGREE_WORD = fields.DEGREE.pattern
TERM_WORDS = "|".join(words for words, _ in FEE_TERMS)


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """A row for each field that a page has: pages' columns but html, field_key, value, confidence, method and pos, its place among the page's results. The first of a field is the one to take.

    A page is parsed and searched once, in an Arrow batch; currency, fee term, level, eligibility and code are then told by column expressions.
    """
    columns = {"__name": ("string", pa.string()), "__text": ("string", pa.string()), "__fee": ("string", pa.string()), "__found": ("array<struct<field_key: string, value: string, confidence: double, method: string>>", _FOUND)}

    def make(p: fields.Parts, links: list[str]) -> tuple:
        found, context = fields.fields(p)
        return p.h1 or p.title, p.text, context, [dict(zip(("field_key", "value", "confidence", "method"), f, strict=True)) for f in found]

    level, told, code, context = F.col("__level"), F.col("__told"), F.col("__code"), F.col("__fee")
    told_of = [("currency", F.when(context.isNotNull(), currency(context)), F.lit(0.7), "fee.currency"), ("fee_term", F.when(context.isNotNull(), fee_term(context)), F.lit(0.7), "fee.term")]
    told_of += [("degree_level", level["level"], level["confidence"], "degree_level"), ("international_eligible", told["eligible"].cast("string"), told["confidence"], "eligibility"), ("cricos_code", code, F.lit(0.9), "regex:cricos")]
    more = F.array(*[F.struct(F.lit(k).alias("field_key"), v.alias("value"), sure.cast("double").alias("confidence"), F.lit(m).alias("method")) for k, v, sure, m in told_of])
    others = [F.col(f"`{c}`") for c in pages.columns if c != html]
    # What is told by a whole text is told once, in a step of its own.
    read = _each_page(pages, url, html, columns, make).select(*others, "__found", "__fee", degree_level("__name", "__text").alias("__level"), eligibility("__text").alias("__told"), registration_code("__text").alias("__code"))
    listed = read.select(*others, "__found", more.alias("__more"))
    results = F.concat("__found", F.filter("__more", lambda x: x["value"].isNotNull()))
    return listed.select(*others, F.posexplode(results).alias("pos", "__r")).select(*others, "pos", "__r.*")


def page_type(url: Column | str = "url") -> Column:
    """detail, listing or unknown.

    detail: a degree word in the heading and in the last of two or more parts of the address, and under six links to courses; or a text about
    a course and its conditions with under three such links. listing: any links to courses. The rest is unknown.
    """
    path = F.split(F.trim(F.regexp_replace(F.regexp_extract(F.lower(col(url)), r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/+", " ")), " ")
    last, links = F.element_at(path, -1), F.size(F.filter("page.links", lambda x: matches(x, r"/(course|degree|program|stud)[^/]*/[^/?#]+") | matches(x, DEGREE_WORD)))
    by_name = matches("page.h1", DEGREE_WORD) & (F.size(path) >= 2) & matches(last, DEGREE_WORD) & (links < 6)
    by_text = matches("page.text", r"\b(course|degree|program)") & matches("page.text", r"\b(fee|tuition|ielts|duration|intake|entry requirement)") & (links < 3)
    return F.when(by_name | by_text, "detail").when(links > 0, "listing").otherwise("unknown")


def fee_tables(pages: DataFrame, url: str = "url", html: str = "html", bounds: tuple[float, float] = fields.FEE_BOUNDS) -> DataFrame:
    """pages' columns but html, program, amount and term, a row for each row of a fee table with an amount within bounds. The term is told by the row, else by the head, else by the kind of its fee column."""
    flat = _each_page(pages, url, html, {"__fees": ("array<struct<program: string, amount: double, kind: string, said: string, head: string>>", _FEES)}, lambda p, links: ([r for t in p.tables for r in fields.fee_rows(t, bounds)],))
    others = [F.col(f"`{c}`") for c in pages.columns if c != html]
    rows = flat.select(*others, F.explode("__fees").alias("__r"))
    row, head, kind = F.col("__r.said"), F.col("__r.head"), F.col("__r.kind")
    term = F.when(matches(row, TERM_WORDS), fee_term(row)).when(matches(head, TERM_WORDS), fee_term(head)).when(kind == "total", "Full Course").when(kind == "unit", "Per Unit").otherwise("Annual")
    return rows.select(*others, F.col("__r.program").alias("program"), F.col("__r.amount").alias("amount"), term.alias("term"))


def coded_rows(documents: DataFrame, text: str = "text", bounds: tuple[float, float] = (1_000.0, 200_000.0)) -> DataFrame:
    """documents' columns but text, code, program, amount, term and year, for the rows of a fee table in a plain text that carry a registration code and its unit, annual and total fees, the last one between bounds.

    A row's program begins at the last degree word before its code, brackets that follow included. A code's last row counts. A total that is above
    the annual fee is the whole course's. Texts with under two such rows give none.
    """
    number = r"(?:\$\s?[0-9][0-9,]*|[0-9]{1,3}(?:,[0-9]{3})+|[0-9]{4,6})"
    start = r"(?:Bachelor|Master|Doctor|Graduate|Diploma|Associate|Certificate|Advanced)\b"
    row = rf"({start}(?:(?!{start})[^$]){{2,200}}?)\s+([0-9]{{6,7}}[A-Z])\b[^$]{{0,80}}?({number})\s+({number})\s+({number})(?![0-9,])"
    pattern = F.lit(f"(?s){row}")
    each = F.arrays_zip(*[F.regexp_extract_all(F.col(f"`{text}`"), pattern, F.lit(i)).alias(n) for i, n in enumerate(("program", "code", "per_unit", "annual", "total"), 1)])
    others = [c for c in documents.columns if c != text]
    value = lambda c: F.regexp_replace(c, r"[^0-9]", "").try_cast("double")
    year = F.nullif(F.regexp_extract(F.col(f"`{text}`"), r"(?i)(?:\b20[0-9]{2}\b[^.\n]{0,40}(?:fee|tuition)|(?:fee|tuition)[^.\n]{0,40}\b20[0-9]{2}\b)", 0), F.lit(""))
    year = F.regexp_extract(year, r"\b(20[0-9]{2})\b", 1).try_cast("int")
    rows = F.transform(each, lambda r: F.struct(r["code"].alias("code"), F.regexp_replace(F.trim(r["program"]), r"\s+", " ").alias("program"), value(r["total"]).alias("amount"), F.when(value(r["total"]) > value(r["annual"]), "Full Course").otherwise("Annual").alias("term")))
    last = F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda x: x["code"] == r["code"]))
    found = documents.where(F.size(F.regexp_extract_all(F.col(f"`{text}`"), pattern, F.lit(2))) >= 2).select(*[F.col(f"`{c}`") for c in others], year.alias("__year"), F.explode(last).alias("__r"))
    return found.where((F.col("__r.amount") > bounds[0]) & (F.col("__r.amount") < bounds[1])).select(*[F.col(f"`{c}`") for c in others], "__r.*", F.col("__year").alias("year"))


def fee_lines(documents: DataFrame, text: str = "text", back: int = 3) -> DataFrame:
    """documents' columns but text, program, amount and term, a row for each line with an amount of 2,000 to 200,000 whose program is known.

    The program is the nearest of the back lines before it that has no such amount and more than four characters; else, what stands before a dash or colon in front of the
    amount. The term is the line's, else that of the lines from there on, else null. For texts of pages that have no fee table; blank lines do not count.
    """
    lines = F.filter(F.transform(F.split(F.col(f"`{text}`"), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    money = F.lit(r"(?i)(?:A\$|AUD\s*|NZ\$|CA\$|US\$|\$)\s*([0-9,]+(?:\.[0-9]+)?)")
    amounts = lambda x: F.filter(F.transform(F.regexp_extract_all(x, money, 1), lambda v: F.regexp_replace(v, ",", "").try_cast("double")), lambda v: v.between(2_000, 200_000))
    read = F.transform(lines, lambda x: F.struct(x.alias("line"), F.get(amounts(x), F.lit(0)).alias("amount")))
    others = [F.col(f"`{c}`") for c in documents.columns if c != text]
    rows = documents.select(*others, read.alias("__read")).select(*others, "__read", F.posexplode("__read").alias("__at", "__l")).where("__l.amount IS NOT NULL")
    first = F.greatest(F.col("__at") - back, F.lit(0))
    before = F.slice("__read", first + 1, F.col("__at") - first)
    names = F.filter(before, lambda x: x["amount"].isNull() & (F.length(x["line"]) > 4))
    ahead = F.trim(F.regexp_extract("__l.line", r"(?i)^(.+?)\s*[-—–:]\s*(?=A?\$|USD\s|\bAUD\s)", 1))
    program = F.coalesce(F.try_element_at(names, F.lit(-1))["line"], F.when((F.length(ahead) > 4) & (F.size(amounts(ahead)) == 0), ahead))
    term = lambda c: F.when(matches(c, r"\bper\s*tri(mester)?\b"), "Trimester").when(matches(c, r"\bper\s*sem(ester)?\b"), "Semester").when(matches(c, r"\b(per\s*year|per\s*annum|p\.?a\.?|annual)\b"), "Annual")
    context = F.array_join(F.concat(before["line"], F.array("__l.line")), " ")
    return rows.select(*others, program.alias("program"), F.col("__l.amount").alias("amount"), F.coalesce(term(F.col("__l.line")), term(context)).alias("term")).where("program IS NOT NULL")


_SCORES = pa.list_(pa.struct([("level", pa.string()), ("test", pa.string()), ("score", pa.float64())]))


def english_by_level(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages' columns but html, level, test and score from the first table whose columns are levels and whose rows are tests; level null stands for the page as a whole."""
    kind = "array<struct<level: string, test: string, score: double>>"
    flat = _each_page(pages, url, html, {"__scores": (kind, _SCORES)}, lambda p, links: (next((r for t in p.tables if (r := fields.english_columns(t))), []),))
    others = [F.col(f"`{c}`") for c in pages.columns if c != html]
    return flat.select(*others, F.explode("__scores").alias("__s")).select(*others, "__s.*")


def near_keyword(text: Column | str, value: str, keyword: str, span: int = 100) -> Column:
    """Whether value occurs within span characters of keyword. Both are plain words."""
    a, b = re.escape(value), re.escape(keyword)
    return matches(text, rf"(?s)({a}.{{0,{span}}}{b}|{b}.{{0,{span}}}{a})")


def windows(text: Column | str, keyword: str, span: int = 160) -> Column:
    """The text around each place of keyword."""
    return F.regexp_extract_all(col(text), F.lit(rf"(?is)(.{{0,{span}}}{re.escape(keyword)}.{{0,{span}}})"), 1)


def tolerant_json(c: Column | str) -> Column:
    """JSON from a text that may be fenced; null if it cannot be read."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.try_parse_json(F.when(inner != "", inner))
