"""What changed between two runs, cell by cell, and which staged rows a new run replaces."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from gristmill.operators.rows import first_per

#: Columns that differ from run to run and tell nothing, and lists whose order tells nothing.
IGNORED = ("id", "scrape_job_id", "course_id", "run_id", "scraped_at", "staged_at", "created_at", "updated_at", "gemini_tokens", "elapsed_ms", "cost_usd", "raw_html", "raw_text")
UNORDERED = ("intake_months", "location")
#: Statuses that an operator has confirmed.
CONFIRMED = ("approved", "published")


def cell(name: str, kind: DataType, unordered: Sequence[str] = UNORDERED) -> Column:
    """A value as text for comparing: null stays null; lists that are unordered are sorted as texts, maps by their keys; other nested values are JSON."""
    c = F.col(f"`{name}`")
    if isinstance(kind, ArrayType) and name in unordered:
        return F.to_json(F.array_sort(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("None")))))
    if isinstance(kind, MapType):
        return F.to_json(F.array_sort(F.map_entries(c)))
    if isinstance(kind, ArrayType | StructType):
        return F.to_json(c)
    return c.cast("string")


def _cells(df: DataFrame, fields: Sequence[str], unordered: Sequence[str]) -> Column:
    kinds = {f.name: f.dataType for f in df.schema}
    absent = F.lit(None).cast("string")
    return F.array(*[F.struct(F.lit(f).alias("field"), (cell(f, kinds[f], unordered) if f in kinds else absent).alias("value")) for f in fields])


def run_diff(
    before: DataFrame, after: DataFrame, key: str = "url", error: str = "error", ruled_out: str | None = "domestic_only", position: str | None = None,
    ignored: Sequence[str] = IGNORED, unordered: Sequence[str] = UNORDERED,
) -> DataFrame:
    """Rows (key, status, diffs) of two runs' rows: diffs is array<struct<field, before, after>>.

    status: "new_only", "old_only"; "staging" where only one run stages the row (it has no error and is not ruled out); "regression" where errors
    differ before the first colon, or fields that are not ignored do; else "matched". Rows without a key go; of several with a key the last by position counts.
    Columns that one run lacks are null there.
    """
    skip = {key, error, *ignored, *([position] if position else [])}
    fields = sorted({*before.columns, *after.columns} - skip)

    def side(df: DataFrame, name: str) -> DataFrame:
        kept = df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
        kept = first_per(kept, [key], [F.desc(position)]) if position else kept
        said = F.nullif(F.col(error).cast("string"), F.lit("")) if error in df.columns else F.lit(None).cast("string")
        out = F.coalesce(F.col(ruled_out).cast("boolean"), F.lit(False)) if ruled_out and ruled_out in df.columns else F.lit(False)
        return kept.select(F.col(key).alias("key"), F.struct(said.alias("error"), (said.isNull() & ~out).alias("staged"), _cells(df, fields, unordered).alias("cells")).alias(name))

    both = side(before, "b").join(side(after, "a"), "key", "full_outer")
    pairs = F.zip_with("b.cells", "a.cells", lambda x, y: F.struct(x["field"].alias("field"), x["value"].alias("before"), y["value"].alias("after")))
    unlike = F.filter(pairs, lambda p: ~p["before"].eqNullSafe(p["after"]))
    errors, code = F.col("b.error").isNotNull() & F.col("a.error").isNotNull(), lambda c: F.substring_index(c, ":", 1)
    other_error = F.array(F.struct(F.lit("error").alias("field"), F.col("b.error").alias("before"), F.col("a.error").alias("after")))
    none = F.array().cast("array<struct<field: string, before: string, after: string>>")
    one_sided, unstaged = F.col("a").isNull() | F.col("b").isNull(), F.col("a.staged") != F.col("b.staged")
    diffs = F.when(one_sided | unstaged, none).when(errors, F.when(code("b.error") == code("a.error"), none).otherwise(other_error)).otherwise(unlike)
    told = both.withColumn("diffs", diffs)
    status = (
        F.when(F.col("b").isNull(), "new_only").when(F.col("a").isNull(), "old_only").when(unstaged, "staging").when(F.size("diffs") > 0, "regression").otherwise("matched")
    )
    return told.select(F.col("key").alias(key), status.alias("status"), "diffs")


def diff_report(diffs: DataFrame) -> DataFrame:
    """One row of run_diff's counts, with clean: nothing but matches."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    kinds = ("matched", "old_only", "new_only", "staging", "regression")
    return diffs.agg(*[n(k) for k in kinds]).withColumn("clean", F.expr(" + ".join(kinds[1:])) == 0)


def snapshot_sweep(before: DataFrame, after: DataFrame, group: str, key: str, fields: Sequence[str], methods: str | None = None, expected: Iterable[str] = ()) -> DataFrame:
    """Rows (group, key, kind, field, before, after, expected) for what two snapshots of groups of rows do not share.

    kind: "added" or "removed" rows (field null); "value" for a field that changed; "method" for a field of the map methods whose way changed though its value, if it
    is among fields, did not. Only groups that both snapshots have are compared. expected: the group is among those that were meant to change.
    """
    strings = "array<struct<field: string, value: string>>"

    def side(df: DataFrame, name: str) -> DataFrame:
        ways = F.transform(F.map_entries(methods), lambda e: F.struct(e["key"].cast("string").alias("field"), e["value"].cast("string").alias("value"))) if methods else F.array()
        return df.select(F.col(group).alias("group"), F.col(key).alias("key"), F.struct(_cells(df, fields, ()).alias("cells"), F.coalesce(ways.cast(strings), F.array().cast(strings)).alias("ways")).alias(name))

    shared = before.select(F.col(group).alias("group")).distinct().join(after.select(F.col(group).alias("group")).distinct(), "group")
    both = side(before, "b").join(side(after, "a"), ["group", "key"], "full_outer").join(shared, "group", "left_semi")
    change = "array<struct<kind: string, field: string, before: string, after: string>>"
    row = lambda kind, field, x, y: F.struct(F.lit(kind).alias("kind"), field.alias("field"), x.alias("before"), y.alias("after"))
    none = F.lit(None).cast("string")
    values = F.filter(F.zip_with("b.cells", "a.cells", lambda x, y: row("value", x["field"], x["value"], y["value"])), lambda p: ~p["before"].eqNullSafe(p["after"]))
    way = lambda side, f: F.get(F.filter(f"{side}.ways", lambda e: e["field"] == f), F.lit(0))["value"]
    names = F.array_sort(F.array_union(F.col("b.ways.field"), F.col("a.ways.field")))
    told = F.filter(F.transform(names, lambda f: row("method", f, way("b", f), way("a", f))), lambda p: ~p["before"].eqNullSafe(p["after"]))
    only_ways = F.filter(told, lambda p: ~F.array_contains(F.transform(F.col("values"), lambda v: v["field"]), p["field"]))
    found = both.withColumn("values", values.cast(change))
    found = found.withColumn(
        "changes",
        F.when(F.col("b").isNull(), F.array(row("added", none, none, none))).when(F.col("a").isNull(), F.array(row("removed", none, none, none))).otherwise(F.concat("values", only_ways)).cast(change),
    )
    meant = list(expected)
    flagged = F.col("group").isin(meant) if meant else F.lit(False)
    return found.select(F.col("group").alias(group), F.col("key").alias(key), F.explode("changes").alias("c"), flagged.alias("expected")).select(group, key, "c.*", "expected")


def stage_rows(staged: DataFrame, new: DataFrame, job: str, owner: str, url: str, status: str, position: str, confirmed: Sequence[str] = CONFIRMED) -> DataFrame:
    """staged with new rows put in: of a job's rows with the same owner and url only the first stays, and rows of other jobs that they replace go, unless confirmed.

    A new row whose job has staged its url before is refused. Rows without a url are all kept and replace nothing.
    """
    keys = [job, owner, url]
    named = F.coalesce(F.col(url).cast("string"), F.lit("")) != ""
    fresh = first_per(new.where(named), keys, [F.asc(position)]).join(staged.select(*keys), keys, "left_anti")
    # Of jobs that come together the last one that stages a url is left beside the confirmed rows.
    latest = first_per(fresh.select(owner, url, F.col(job).alias("__job"), F.col(position).alias("__at")), [owner, url], [F.desc("__at")]).drop("__at")
    fresh = fresh.join(latest, [owner, url]).where((F.col(job) == F.col("__job")) | F.col(status).isin(*confirmed)).select(*staged.columns)
    held = staged.join(latest, [owner, url], "left")
    kept = held.where(F.col("__job").isNull() | (F.col(job) == F.col("__job")) | F.coalesce(F.col(status).isin(*confirmed), F.lit(False))).select(*staged.columns)
    return kept.unionByName(fresh).unionByName(new.where(~named).select(*staged.columns))


def replaced_partitions(staged: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Of after the rows of the partitions that differ from staged: what a dynamic overwrite must write; the others are left alone.

    A partition that loses all its rows is not among them: a dynamic overwrite cannot empty one, so its name is to be dropped by the caller.
    """
    count = lambda df, name: df.groupBy(by).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.sum(F.xxhash64(*staged.columns).cast("decimal(38,0)")).alias(f"h_{name}"))
    both = count(staged, "b").join(count(after.select(*staged.columns), "a"), by, "full_outer")
    moved = both.where("NOT (n_a <=> n_b AND h_a <=> h_b)").select(by)
    return after.join(moved, by, "left_semi")
