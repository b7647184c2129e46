"""Readers, writers and streams on files."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gristmill.sources import readers, writers
from gristmill.streaming import jobs


def test_csv_import(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("﻿Name,Country,City\nUni A,AU,X\n,AU,Y\nuni a,AU,Z\n".encode())
    good, bad = readers.read_csv(spark, str(tmp_path / "u.csv"), ["name", "country", "city", "website"], ["name", "country", "city"])
    assert [r.error for r in bad.collect()] == ["name is blank"]
    existing = spark.createDataFrame([("other",)], "name string")
    assert [r.city for r in readers.new_by_name(good, existing).collect()] == ["X"]
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "u.csv"), ["name"], ["fee"])


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda ref, s: f'<c r="{ref}" t="inlineStr"><is><t>{s}</t></is></c>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook/>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row>{cell("A1", "Course Name")}{cell("C1", "Fee $")}</row><row>{cell("A2", "Law")}{cell("C2", "A$32,000")}</row><row></row></sheetData></worksheet>')
    df = readers.renamed(readers.read_workbook(spark, path), {"coursename": "course_name", "fee": "fee"})
    assert [tuple(r) for r in df.collect()] == [("Law", "A$32,000")]
    (tmp_path / "no.xlsx").write_text("x")
    with pytest.raises(ValueError):
        readers.check_workbook(str(tmp_path / "no.xlsx"))


def test_snapshots(spark, tmp_path):
    for name, v in (("a.json", 1), ("b.json", 2)):
        (tmp_path / name).write_text(json.dumps({"slug": "x", "university_id": 1, "v": v}, indent=1))
    assert [r.v for r in readers.read_snapshots(spark, str(tmp_path), "slug string, university_id int, v int").collect()] == [2]


def test_view_refresh(spark, tmp_path):
    made = lambda *rows: spark.createDataFrame(rows, "k int, v string")
    spark.sql("DROP VIEW IF EXISTS held_rows")
    first = writers.upsert_view(made((1, "a"), (2, "b")), "held_rows", str(tmp_path / "t"), ["k"])
    reader = spark.table("held_rows")
    assert sorted(map(tuple, reader.collect())) == [(1, "a"), (2, "b")]
    writers.upsert_view(made((2, "c"), (3, "d")), "held_rows", str(tmp_path / "t"), ["k"])
    # Who has begun on the view before reads what it was; who begins now, what it is.
    assert sorted(map(tuple, reader.collect())) == sorted(map(tuple, spark.read.parquet(first).collect())) == [(1, "a"), (2, "b")]
    writers.upsert_view(made((3, "e"), (4, "f")), "held_rows", str(tmp_path / "t"), ["k"], insert_only=True)
    want = [(1, "a"), (2, "c"), (3, "d"), (4, "f")]
    assert sorted(map(tuple, spark.table("held_rows").collect())) == want
    with pytest.raises(Exception):
        writers.refresh_view(made((1, "a")).selectExpr("k", "raise_error('no') AS v"), "held_rows", str(tmp_path / "t"))
    assert sorted(map(tuple, spark.table("held_rows").collect())) == want
    spark.sql("DROP VIEW held_rows")


def test_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    for rows in ([(1, "a"), (2, "b")], [(2, "c")], [(2, "c")]):
        writers.replace_partitions(spark.createDataFrame(rows, "run int, v string"), path, ["run"])
    assert sorted((r.run, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    for _ in range(2):
        writers.snapshot(spark.range(3), str(tmp_path / "s"), F.lit("2024-01-01"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 6


def test_exports(spark, tmp_path):
    d = spark.createDataFrame([(1, ["a", "b"], 'say "x"', None)], "id int, l array<string>, s string, n string").withColumn("d", F.lit("1.50").cast("decimal(5,2)")).coalesce(1)
    writers.export_csv(d, str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("part-*.csv")).read_text()
    assert text.splitlines() == ["id,l,s,n,d", '1,a;b,"say ""x""",,1.50']
    writers.export_json(d, str(tmp_path / "j"))
    assert json.loads(next((tmp_path / "j").glob("part-*.json")).read_text())["d"] == 1.5


def test_bulk_apply_refuses_repeats(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id int")
    existing = spark.createDataFrame([(2, "NZ")], "id int, country string")
    with pytest.raises(ValueError):
        writers.bulk_apply(ids, [{"country": "AU"}, {"country": "NZ"}], existing, "id", ["country"])
    assert writers.bulk_apply(ids, [{"country": "AU"}], existing, "id", ["country"]).count() == 2
    assert writers.empty_like(ids, backed_up_at="timestamp").dtypes == [("id", "int"), ("backed_up_at", "timestamp")]


def test_schema_difference(spark):
    a, b = spark.range(1), spark.range(1).select(F.col("id").cast("string"), F.lit(1).alias("x"))
    assert readers.schema_difference(a, b) == {"missing": [], "extra": ["x"], "changed": ["id"]}
    assert readers.settings({"a": 1}, {"a": {"b": 1}}, {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}}


def test_tail_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n in range(2):
        (src / f"{n}.json").write_text(json.dumps({"sequence": n, "message": "[ERROR] x"}) + "\n")
        jobs.append_new(jobs.tail(spark, str(src), "sequence long, message string"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.sequence, r.level) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, "error"), (1, "error")]


def _stream(spark, tmp_path, rows):
    spark.createDataFrame(rows, "user_id int, event_type string, ts timestamp, cost double").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("user_id int, event_type string, ts timestamp, cost double").parquet(str(tmp_path / "in"))


def _all(stream, spark, tmp_path, name, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_breaker_stream(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    stream = _stream(spark, tmp_path, [(1, "error", base + dt.timedelta(seconds=s), 1.0) for s in range(0, 12)] + [(2, "error", base, 1.0), (1, "view", base, 1.0)])
    got = _all(jobs.breaker(stream, "user_id"), spark, tmp_path, "breaker")
    assert [(r.user_id, r.opened_at) for r in got] == [(1, base + dt.timedelta(seconds=7))]


def test_failure_windows(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    stream = _stream(spark, tmp_path, [(1, "error", base + dt.timedelta(seconds=s), 1.0) for s in (0, 10, 70)])
    got = _all(jobs.failure_counts(stream), spark, tmp_path, "failures", "complete")
    assert sorted((r.start, r.failures) for r in got) == [(base, 2), (base + dt.timedelta(minutes=1), 1)]


def test_typed_import(spark):
    header = "`Course Name` string, `Duration (x)` string, Duration string, `INTL` string, `Fee` string, `Fee Year` string, `Intake Months` string, `IELTS Overall` string, Campus string, University string, Line int"
    rows = [
        ("Law", "x", "3 years", "x", "A$32,000", "2026", "Feb; Jul/xyz | feb", "6.5", " City ", "u1", 3),
        (" LAW ", None, "-", None, "n/a", "2026.0", "", "", "", "u1", 5),
        ("law", None, "1.5", None, "", None, None, None, None, "u1", 1),
        ("law", None, "1", None, "1", None, ", ;", None, None, "u2", 2),
        ("Old", None, None, None, None, None, None, None, None, "u1", 4),
        ("  ", None, None, None, None, None, None, None, None, "u1", 6),
        ("1.2.3", None, "1.2.3", None, "$", None, "Sept", None, None, "u1", 7),
    ]
    raw = spark.createDataFrame(rows, header)
    existing = spark.createDataFrame([("u1", "OLD "), ("u2", None)], "university_id string, course_name string")
    good, bad = readers.import_rows(raw, existing, F.col("University"), F.col("Line"))
    assert dict(good.dtypes)["duration"] == "double" and dict(good.dtypes)["fee_year"] == "int" and dict(good.dtypes)["intake_months"] == "array<string>"
    got = {(r.university_id, r.course_name): (r.duration, r.international_fee, r.fee_year, r.intake_months, r.ielts_overall, r.course_location) for r in good.collect()}
    assert got == {("u1", "law"): (1.5, None, None, None, None, None), ("u2", "law"): (1.0, 1.0, None, None, None, None), ("u1", "1.2.3"): (None, None, None, ["September"], None, None)}
    assert sorted((r.reason, r.course_name or "") for r in bad.collect()) == [("exists", "Old"), ("missing_name", ""), ("repeated", "LAW"), ("repeated", "Law")]
    law = readers.typed_import(raw).where("course_name = 'Law'").first()
    assert (law.duration, law.international_fee, law.fee_year, law.intake_months, law.course_location) == (3.0, 32000.0, 2026, ["February", "July", "xyz"], "City")


def test_cached_reads_expire_over_a_restart(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    at = lambda m: base + dt.timedelta(minutes=m)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "url string, body string, ts timestamp"
    steps = [[("a", "one", at(0)), ("a", "two", at(20)), ("b", None, at(1)), ("b", "x", at(2))], [("a", "three", at(50)), ("c", "late", at(95))], [("a", "four", at(100)), ("a", "five", at(101)), ("b", "y", at(200))]]
    try:
        for n, rows in enumerate(steps):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
            # Each step is a query of its own that goes on from the checkpoint.
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
            out = jobs.cached_reads(stream, "url", "body")
            out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {(r.key, r.ts): (r.hit, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {
        ("a", at(0)): (False, "one"), ("a", at(20)): (True, "one"), ("b", at(1)): (False, ""), ("b", at(2)): (False, "x"), ("a", at(50)): (True, "one"), ("c", at(95)): (False, "late"),
        ("a", at(100)): (False, "four"), ("a", at(101)): (True, "four"), ("b", at(200)): (False, "y"),
    }


def test_quiet_jobs_and_daily_spend(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, "beat", base + dt.timedelta(minutes=m), 1.5) for m in (0, 2, 4, 30)] + [(1, "beat", base + dt.timedelta(days=3), 2.0)]
    stream = _stream(spark, tmp_path, rows)
    got = _all(jobs.quiet_jobs(stream, "user_id"), spark, tmp_path, "quiet")
    assert sorted((r.first_beat, r.silent_at, r.beats) for r in got) == [(base, base + dt.timedelta(minutes=9), 3), (base + dt.timedelta(minutes=30), base + dt.timedelta(minutes=35), 1)]


def test_daily_spend_and_unique_events(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    stream = _stream(spark, tmp_path, [(1, "a", base, 1.5), (1, "b", base + dt.timedelta(hours=5), 2.0), (2, "a", base + dt.timedelta(days=1), 4.0)])
    got = _all(jobs.daily_spend(stream), spark, tmp_path, "spend", "complete")
    assert sorted((r.day, r.spent) for r in got) == [(base.date(), 3.5), (base.date() + dt.timedelta(days=1), 4.0)]
    once = spark.readStream.schema(stream.schema).parquet(str(tmp_path / "in"))
    once.transform(lambda d: jobs.unique_events(d, "user_id")).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.user_id for r in spark.table("once").collect()) == [1, 2]
