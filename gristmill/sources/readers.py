"""Readers: imports with checks, snapshots, sitemaps, settings and cached pages."""

from __future__ import annotations

import zipfile
from collections.abc import Mapping, Sequence
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions.text import header_key, is_blank, month_list, natural_key
from gristmill.functions.values import deep_merge
from gristmill.operators.rows import first_per

#: Limits of a spreadsheet that is read: its size, the size of what it unpacks to, and the ratio of both.
LARGEST, LARGEST_UNPACKED, LARGEST_RATIO = 10_000_000, 100_000_000, 100


def renamed(df: DataFrame, synonyms: Mapping[str, str]) -> DataFrame:
    """df with headers that are known under another name; unknown ones go. Names are compared by their letters and digits; the first of equals counts."""
    simple = lambda s: "".join(ch for ch in s.lower() if ch.isascii() and ch.isalnum())
    taken: dict[str, str] = {}
    for c in df.columns:
        if (name := synonyms.get(simple(c))) and name not in taken:
            taken[name] = c
    return df.select([F.col(f"`{c}`").alias(n) for n, c in taken.items()])


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a CSV file with a header: columns that it lacks are null; a row without a required value is an error with its reason."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip().lower() for c in raw.columns])
    if lacking := [c for c in required if c not in raw.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    rows = raw.select(*[F.trim(F.col(c)).alias(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns])
    lacks = F.concat_ws(", ", *[F.when(is_blank(c), F.lit(f"{c} is blank")) for c in required])
    checked = rows.withColumn("error", lacks)
    return checked.where("error = ''").drop("error"), checked.where("error <> ''")


#: Headers of an import by their letters and digits, and the columns that they stand for.
IMPORT_COLUMNS = {
    "coursename": "course_name", "name": "course_name", "category": "category", "subcategory": "sub_category", "degreelevel": "degree_level", "level": "degree_level", "duration": "duration",
    "durationterm": "duration_term", "studymode": "study_mode", "mode": "study_mode", "studyload": "study_load", "intakemonth": "intake_months", "intakemonths": "intake_months", "intake": "intake_months",
    "internationalfee": "international_fee", "fee": "international_fee", "feeterm": "fee_term", "feeyear": "fee_year", "currency": "currency", "ieltsoverall": "ielts_overall",
    "ieltslistening": "ielts_listening", "ieltsspeaking": "ielts_speaking", "ieltswriting": "ielts_writing", "ieltsreading": "ielts_reading", "pteoverall": "pte_overall",
    "ptelistening": "pte_listening", "ptespeaking": "pte_speaking", "ptewriting": "pte_writing", "ptereading": "pte_reading", "toefloverall": "toefl_overall",
    "academiclevel": "academic_level", "academicscore": "academic_score", "academiccountry": "academic_country", "scholarship": "scholarship", "coursewebsite": "course_website",
    "website": "course_website", "url": "course_website", "courseurl": "course_website", "courselocation": "course_location", "location": "course_location", "campus": "course_location",
    "description": "description", "otherrequirement": "other_requirement", "language": "language", "cricoscode": "cricos_code", "cricos": "cricos_code",
}
#: Columns of an import that hold numbers, whole numbers and lists of months; all others hold texts.
IMPORT_NUMBERS = ("duration", "international_fee", "academic_score", *(f"{t}_{p}" for t in ("ielts", "pte") for p in ("overall", "listening", "speaking", "writing", "reading")), "toefl_overall")
IMPORT_WHOLE, IMPORT_MONTHS = ("fee_year",), ("intake_months",)


def typed_import(raw: DataFrame, synonyms: Mapping[str, str] = IMPORT_COLUMNS) -> DataFrame:
    """raw's known columns under their names and with their types. Numbers are read from among other signs and null where none is left; months by whole or short names, unknown ones as they are; blank texts are null."""
    rows = renamed(raw, synonyms)

    def typed(name: str) -> Column:
        text = F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))
        number = F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")
        if name in IMPORT_NUMBERS:
            return number
        if name in IMPORT_WHOLE:
            return number.try_cast("int")
        if name in IMPORT_MONTHS:
            months = month_list(text)
            return F.when(F.size(months) > 0, months)
        return text

    return rows.select(*[typed(c).alias(c) for c in rows.columns])


def import_rows(raw: DataFrame, existing: DataFrame, owner: Column, order: Column, owner_col: str = "university_id", name: str = "course_name") -> tuple[DataFrame, DataFrame]:
    """(rows, skipped) of an import for the owners that owner gives: rows are typed and new; skipped ones carry a reason.

    A row without a name is skipped ("missing_name"), so is one whose name, in any case, its owner has already ("exists") or has in an earlier row by order ("repeated").
    """
    placed = typed_import(raw.withColumn("__owner", owner).withColumn("__order", order), {**IMPORT_COLUMNS, "owner": owner_col, "order": "__order"})
    keyed = placed.withColumn("__key", natural_key(name))
    kept = existing.select(owner_col, natural_key(name).alias("__key"), F.lit(True).alias("__held")).distinct()
    place = F.row_number().over(Window.partitionBy(owner_col, "__key").orderBy(F.col("__order").cast("double")))
    told = keyed.join(kept, [owner_col, "__key"], "left").withColumn("__place", place)
    reason = F.when(F.coalesce(F.col("__key"), F.lit("")) == "", "missing_name").when(F.col("__held"), "exists").when(F.col("__place") > 1, "repeated")
    told = told.withColumn("reason", reason).drop("__key", "__held", "__place", "__order")
    return told.where("reason IS NULL").drop("reason"), told.where("reason IS NOT NULL")


def new_by_name(rows: DataFrame, existing: DataFrame, name: str = "name") -> DataFrame:
    """rows whose name, in any case, neither exists nor occurs before among them."""
    keyed = rows.withColumn("__key", natural_key(name)).join(existing.select(natural_key(name).alias("__key")).distinct(), "__key", "left_anti")
    return first_per(keyed, ["__key"], [F.asc(name)]).drop("__key")


def check_workbook(path: str, largest: int = LARGEST, unpacked: int = LARGEST_UNPACKED, ratio: int = LARGEST_RATIO) -> None:
    """Raises ValueError for a spreadsheet that is too large, unpacks to too much, or is none. The driver's work: one small file."""
    size = Path(path).stat().st_size
    if size > largest:
        raise ValueError("file too large")
    if not zipfile.is_zipfile(path):
        raise ValueError("not a workbook")
    with zipfile.ZipFile(path) as z:
        total = sum(i.file_size for i in z.infolist())
        if total > unpacked or total > ratio * max(size, 1):
            raise ValueError("workbook unpacks to too much")
        if "xl/workbook.xml" not in z.namelist():
            raise ValueError("not a workbook")


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a checked workbook as a DataFrame of texts; its first row is the header, rows without a value go."""
    check_workbook(path)
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)] if "xl/sharedStrings.xml" in z.namelist() else []
        sheet = ElementTree.fromstring(z.read(min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))))
    table: list[dict[int, str]] = []
    for row in sheet.iter(f"{{{ns['m']}}}row"):
        cells: dict[int, str] = {}
        for c in row.findall("m:c", ns):
            letters = "".join(ch for ch in c.get("r", "") if ch.isalpha())
            at = 0
            for ch in letters:
                at = at * 26 + ord(ch) - 64
            v = c.find("m:v", ns)
            text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else shared[int(v.text)] if c.get("t") == "s" and v is not None else (v.text if v is not None else "")
            cells[at - 1] = (text or "").strip()
        if any(cells.values()):
            table.append(cells)
    if not table:
        raise ValueError("empty workbook")
    header = [table[0].get(i) or f"column{i}" for i in range(max(table[0]) + 1)]
    rows = [tuple(r.get(i) or None for i in range(len(header))) for r in table[1:]]
    return spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in header))


def read_snapshots(spark: SparkSession, path: str, schema: str, key: Sequence[str] = ("slug", "university_id")) -> DataFrame:
    """JSON snapshots of a folder; of those with the same key the last file by name counts."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).withColumn("__file", F.col("_metadata.file_name"))
    return first_per(rows, list(key), [F.desc("__file")]).drop("__file")


def sitemap_locations(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """pages with a row for each <loc>: loc, and nested, whether it is a sitemap itself."""
    locs = F.regexp_extract_all(F.col(xml), F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)
    return pages.select(*[c for c in pages.columns if c != xml], F.explode(locs).alias("loc")).withColumn("nested", F.lower("loc").rlike(r"sitemap[^/]*\.xml"))


def cache_hits(cache: DataFrame, as_of: Column, expires: str = "expires_at") -> DataFrame:
    """Cached rows that are not expired."""
    return cache.where(F.col(expires) > as_of)


def settings(*layers: Mapping) -> dict:
    """Settings of all layers, later ones winning key by key."""
    out: dict = {}
    for layer in layers:
        out = deep_merge(out, layer)
    return out


def schema_difference(expected: DataFrame, actual: DataFrame) -> dict[str, list[str]]:
    """Columns that are missing, extra, or of another type."""
    a, b = dict(expected.dtypes), dict(actual.dtypes)
    return {"missing": sorted(a.keys() - b.keys()), "extra": sorted(b.keys() - a.keys()), "changed": sorted(c for c in a.keys() & b.keys() if a[c] != b[c])}


def header_keys(df: DataFrame) -> list[str]:
    """The headers' letters and digits."""
    one = df.sparkSession.range(1).select(*[header_key(F.lit(c)).alias(str(i)) for i, c in enumerate(df.columns)])
    return list(one.first())


def with_sequence(events: DataFrame, job: str, order: Sequence[Column], last: DataFrame | None = None) -> DataFrame:
    """events numbered within their job, after the job's last number if last (job, sequence) knows one."""
    numbered = events.withColumn("sequence", F.row_number().over(Window.partitionBy(job).orderBy(*order)).cast("long"))
    if last is None:
        return numbered
    top = last.groupBy(job).agg(F.max("sequence").alias("__top"))
    return numbered.join(top, job, "left").withColumn("sequence", F.col("sequence") + F.coalesce("__top", F.lit(0))).drop("__top")
