"""Run differences, snapshot sweeps and staging by small cases."""

import pytest
from pyspark.sql import functions as F

from gristmill.operators import changes
from gristmill.sources import writers


def test_run_diff_has_every_class(spark):
    schema = "url string, name string, error string, domestic_only boolean, intake_months array<string>, tags array<string>, by map<string,string>, cost_usd double, pos int"
    before = [
        ("same", "A", None, None, ["Jul", "Feb"], ["x", "y"], {"a": "1", "b": "2"}, 1.0, 0),
        ("list", "A", None, None, ["Jul"], ["x", "y"], None, 1.0, 0),
        ("error-same", "A", "timeout: 30 s", None, None, None, None, 1.0, 0),
        ("error-other", "A", "timeout: 30 s", None, None, None, None, 1.0, 0),
        ("staging", "A", None, False, None, None, None, 1.0, 0),
        ("gone", "A", None, None, None, None, None, 1.0, 0),
        ("twice", "old", None, None, None, None, None, 1.0, 0),
        ("twice", "new", None, None, None, None, None, 1.0, 1),
        ("", "A", None, None, None, None, None, 1.0, 0),
        ("both-out", "A", None, True, None, None, None, 1.0, 0),
    ]
    after = [
        ("same", "A", None, None, ["Feb", "Jul"], ["x", "y"], {"b": "2", "a": "1"}, 9.0, 0),
        ("list", "B", None, None, ["Jul"], ["y", "x"], None, 1.0, 0),
        ("error-same", "B", "timeout: 60 s", None, None, None, None, 1.0, 0),
        ("error-other", "A", "http: 500", None, None, None, None, 1.0, 0),
        ("staging", "A", None, True, None, None, None, 1.0, 0),
        ("fresh", "A", None, None, None, None, None, 1.0, 0),
        ("twice", "new", None, None, None, None, None, 1.0, 0),
        (None, "A", None, None, None, None, None, 1.0, 0),
        ("both-out", "B", None, True, None, None, None, 1.0, 0),
    ]
    a, b = spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)
    found = changes.run_diff(a, b, position="pos")
    got = {r.url: (r.status, [(d.field, d.before, d.after) for d in r.diffs]) for r in found.collect()}
    assert got == {
        "same": ("matched", []),
        "list": ("regression", [("name", "A", "B"), ("tags", '["x","y"]', '["y","x"]')]),
        "error-same": ("matched", []),
        "error-other": ("regression", [("error", "timeout: 30 s", "http: 500")]),
        "staging": ("staging", []),
        "gone": ("old_only", []),
        "fresh": ("new_only", []),
        "twice": ("matched", []),
        "both-out": ("regression", [("name", "A", "B")]),
    }
    assert tuple(changes.diff_report(found).first()) == (3, 1, 1, 1, 3, False)
    assert changes.diff_report(changes.run_diff(a, a, position="pos")).first().clean
    # A column that only one run has is null in the other.
    assert changes.run_diff(a.drop("tags"), a, position="pos").where("status = 'regression'").count() == 2


def test_snapshot_sweep(spark):
    schema = "slug string, id int, name string, fee double, intakes array<string>, method map<string,string>"
    before = [("u", 1, "A", 1.0, ["Feb"], {"fee": "regex", "name": "css"}), ("u", 2, "B", 2.0, None, {"fee": "regex"}), ("u", 3, "C", None, None, None), ("v", 1, "D", 1.0, None, None), ("w", 1, "E", 1.0, None, None)]
    after = [("u", 1, "A", 5.0, ["Feb"], {"fee": "ai", "name": "h1"}), ("u", 2, "B", 2.0, None, {"fee": "ai", "level": "x"}), ("u", 4, "C", None, None, None), ("v", 1, "D", 1.5, None, None), ("x", 1, "E", 1.0, None, None)]
    got = changes.snapshot_sweep(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), "slug", "id", ["name", "fee", "intakes"], "method", expected=["v"])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(
        map(
            str,
            [
                ("u", 1, "value", "fee", "1.0", "5.0", False), ("u", 1, "method", "name", "css", "h1", False), ("u", 2, "method", "fee", "regex", "ai", False), ("u", 2, "method", "level", None, "x", False),
                ("u", 3, "removed", None, None, None, False), ("u", 4, "added", None, None, None, False), ("v", 1, "value", "fee", "1.0", "1.5", True),
            ],
        )
    )


def test_stage_rows_and_partitions(spark, tmp_path):
    schema = "job int, uni int, url string, status string, pos int"
    staged = spark.createDataFrame([(1, 1, "a", "pending", 0), (1, 1, "b", "approved", 1), (1, 2, "a", "pending", 2), (2, 1, "d", "pending", 3), (1, 1, None, "pending", 4), (1, 1, "c", None, 5)], schema)
    new = spark.createDataFrame([(2, 1, "a", "pending", 10), (2, 1, "a", "pending", 11), (2, 1, "b", "pending", 12), (2, 1, "d", "again", 13), (2, 1, "", "pending", 14), (2, 1, "c", "pending", 15)], schema)
    after = changes.stage_rows(staged, new, "job", "uni", "url", "status", "pos")
    assert sorted(r.pos for r in after.collect()) == [1, 2, 3, 4, 10, 12, 14, 15]
    path = str(tmp_path / "t")
    staged.write.partitionBy("uni").parquet(path)
    untouched = sorted(p.name for p in (tmp_path / "t" / "uni=2").glob("*.parquet"))
    moved = changes.replaced_partitions(spark.read.parquet(path).select(*staged.columns), after, "uni")
    assert {r.uni for r in moved.select("uni").distinct().collect()} == {1}
    held = spark.createDataFrame(moved.collect(), moved.schema)
    writers.replace_partitions(held, path, ["uni"])
    assert sorted(r.pos for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 10, 12, 14, 15]
    assert sorted(p.name for p in (tmp_path / "t" / "uni=2").glob("*.parquet")) == untouched


@pytest.mark.parametrize("kind, value, want", [("array<int>", [3, 1], "[3,1]"), ("map<string,int>", {"b": 1, "a": 2}, '[{"key":"a","value":2},{"key":"b","value":1}]'), ("struct<a:int>", (1,), '{"a":1}'), ("double", 1.5, "1.5")])
def test_cells(spark, kind, value, want):
    df = spark.createDataFrame([(value,), (None,)], f"`a.b` {kind}")
    assert [r[0] for r in df.select(changes.cell("a.b", df.schema[0].dataType)).collect()] == [want, None]
    assert df.select(F.lit(1)).count() == 2
