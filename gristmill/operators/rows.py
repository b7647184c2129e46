"""Row operators with column names as parameters: filters, latest rows, joins, differences, upserts, paging and aggregates."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import col, first_match


def all_of(conditions: Sequence[Column]) -> Column:
    """All conditions hold; true for none."""
    return functools.reduce(operator.and_, conditions, F.lit(True))


def at_most_or_null(c: Column | str, bound: float | None) -> Column:
    """c is null or not above the bound; a bound that is null or not above zero is ignored."""
    return F.lit(True) if not bound or bound <= 0 else col(c).isNull() | (col(c) <= bound)


def at_least(c: Column | str, bound: float | None) -> Column:
    """c is known and not below the bound; a bound that is null or not above zero is ignored."""
    return F.lit(True) if not bound or bound <= 0 else col(c).isNotNull() & (col(c) >= bound)


def overlaps(c: Column | str, wanted: Sequence[str]) -> Column:
    """The array has one of the wanted elements; blank ones do not count, and none at all is no filter."""
    words = [w.strip() for w in wanted if w and w.strip()]
    return F.arrays_overlap(col(c), F.array(*[F.lit(w) for w in words])) if words else F.lit(True)


def not_in(c: Column | str, values: Sequence) -> Column:
    """c is null or none of the values."""
    return col(c).isNull() | ~col(c).isin(list(values))


def within(ts: Column | str, as_of: Column, interval: str) -> Column:
    """After as_of less an interval such as '14 days'."""
    return col(ts) > as_of - F.expr(f"interval {interval}")


def ranked(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], name: str = "rn", ties: bool = False) -> DataFrame:
    """df with a row's number in its group; with ties, equal rows share it."""
    number = (F.rank() if ties else F.row_number()).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, number)


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """df dealt by keys over as many tasks as a shuffle has: for work that costs far more than reading a row, since a small file of many rows is one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows of a task that holds distinct keys; this changes no result.
TASK_ROWS = 1_000_000


def spread_by_rows(df: DataFrame, *keys: str | Column, rows: int = TASK_ROWS) -> DataFrame:
    """df dealt by keys over so many tasks that each has about so many rows, and no fewer than a shuffle has: what one task holds does not grow with the table.

    The rows are counted at once, which a Parquet table's footers tell.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), *keys)


def first_per(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], ties: bool = False) -> DataFrame:
    """The first row of each group. Spark keeps each partition's first rows before it shuffles (a group limit)."""
    return ranked(df, keys, order, "__rn", ties).where("__rn = 1").drop("__rn")


def left_aggregate(df: DataFrame, other: DataFrame, on: Mapping[str, str], **aggregates: Column) -> DataFrame:
    """df with aggregates of the rows of other that it matches; df's rows are never multiplied."""
    grouped = other.groupBy(*[F.col(o).alias(d) for d, o in on.items()]).agg(*[v.alias(k) for k, v in aggregates.items()])
    return df.join(grouped, list(on), "left")


def diff(before: DataFrame, after: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows (keys, status, changed): added, removed, changed or same; changed: names of the fields that differ, nulls being equal."""
    b = before.select(*keys, F.struct(*fields).alias("b"))
    a = after.select(*keys, F.struct(*fields).alias("a"))
    changed = F.filter(F.array(*[F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    status = first_match([(F.col("b").isNull(), "added"), (F.col("a").isNull(), "removed"), (F.size("changed") > 0, "changed")], "same")
    both = b.join(a, list(keys), "full_outer").withColumn("changed", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), changed).otherwise(F.array().cast("array<string>")))
    return both.select(*keys, status.alias("status"), "changed")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], insert_only: bool = False, order: Sequence[Column] = ()) -> DataFrame:
    """old with new's rows put in by key: they replace old ones, or with insert_only give way to them. Of new rows of a key the first by order counts."""
    if order:
        new = first_per(new, keys, order)
    if insert_only:
        return old.unionByName(new.join(old, list(keys), "left_anti"))
    return old.join(new, list(keys), "left_anti").unionByName(new)


def fill_blanks(df: DataFrame, source: DataFrame, keys: Sequence[str], fields: Sequence[str], force: bool = False) -> DataFrame:
    """df with null fields taken from source by key (unique there); with force, source's known values win."""
    s = source.select(*keys, *[F.col(f).alias(f"__{f}") for f in fields])
    pick = (lambda f: F.coalesce(F.col(f"__{f}"), F.col(f))) if force else (lambda f: F.coalesce(F.col(f), F.col(f"__{f}")))
    return df.join(s, list(keys), "left").select(*[pick(c).alias(c) if c in fields else F.col(c) for c in df.columns])


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page number (from 1) of df; order should end in a unique column."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def in_request_order(df: DataFrame, key: str, ids: Sequence, most: int | None = None, position: str | None = None) -> DataFrame:
    """df's rows for the ids, in their order, with their place from 0 as position if that is named; ids that are no numbers are passed over."""
    good = [int(x) for x in ids if str(x).strip().lstrip("-").isdigit()][:most]
    wanted = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(dict.fromkeys(good))], "__pos int, __wanted long")
    found = df.join(wanted, F.col(key) == F.col("__wanted")).orderBy("__pos").drop("__wanted")
    return found.withColumnRenamed("__pos", position) if position else found.drop("__pos")


def facet(df: DataFrame, array: str) -> DataFrame:
    """Rows (value, n): how many rows of df have each element."""
    return df.select(F.explode(array).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def modal(df: DataFrame, keys: Sequence[str], value: str, position: str, quorum: int = 2) -> DataFrame:
    """Rows (keys, value, n): each group's most frequent value, of equals the one that was first; only values with a quorum."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("__first"))
    return first_per(counted.where(F.col("n") >= quorum), keys, [F.desc("n"), F.asc("__first")]).drop("__first")


def low_quantile(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.1, name: str = "low") -> DataFrame:
    """Rows (keys, name): the value at place max(1, floor(n * share)) of a group's known values in order."""
    known = df.where(F.col(value).isNotNull())
    w = Window.partitionBy(*keys)
    placed = known.select(*keys, F.col(value).alias(name), F.row_number().over(w.orderBy(value)).alias("__at"), F.count(F.lit(1)).over(w).alias("__n"))
    return placed.where(F.col("__at") == F.greatest(F.lit(1), F.floor(F.col("__n") * share))).drop("__at", "__n")


def counts_map(df: DataFrame, keys: Sequence[str], value: str, name: str, missing: str = "null") -> DataFrame:
    """Rows (keys, name): a JSON map of values to counts in order of values; nulls count under missing."""
    counted = df.groupBy(*keys, F.coalesce(F.col(value), F.lit(missing)).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    return counted.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__v", "__n"))))).alias(name))


def unpivot_scores(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], kind: str = "test_type", value: str = "overall") -> DataFrame:
    """A row for each known score: columns maps a column to its kind."""
    long = df.unpivot(list(keys), list(columns), "__c", value).where(F.col(value).isNotNull())
    return long.withColumn(kind, first_match((F.col("__c") == c, k) for c, k in columns.items())).drop("__c")


def running_halt(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cost: str, budget: float) -> DataFrame:
    """df with spent, the sum of costs so far, and halted: the budget is used up."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("spent", F.sum(cost).over(w)).withColumn("halted", F.col("spent") >= budget)


def rolling_count(df: DataFrame, keys: Sequence[str], ts: str, seconds: int = 60, threshold: int = 8) -> DataFrame:
    """df with recent, rows of a key in the last seconds (this one too), and tripped."""
    w = Window.partitionBy(*keys).orderBy(F.unix_micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("recent", F.count(F.lit(1)).over(w)).withColumn("tripped", F.col("recent") >= threshold)


def bucket_trend(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, size: int = 5) -> DataFrame:
    """Rows (keys, recent, previous, delta): the means of the last size rows and of the size before; only where there are previous ones."""
    at = ranked(df, keys, order, "__rn").where(F.col("__rn") <= 2 * size)
    means = at.groupBy(*keys).agg(F.avg(F.when(F.col("__rn") <= size, F.col(value))).alias("recent"), F.avg(F.when(F.col("__rn") > size, F.col(value))).alias("previous"))
    return means.where("previous IS NOT NULL").withColumn("delta", F.col("recent") - F.col("previous"))


def trailing_drop(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, runs: int = 5, least: int = 3, drop: float = 0.15) -> DataFrame:
    """Rows of df whose value is at least drop below the mean of the runs before (least of them at least); with trailing_mean."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-runs, -1)
    out = df.withColumn("trailing_mean", F.avg(value).over(w)).withColumn("__n", F.count(value).over(w))
    return out.where((F.col("__n") >= least) & (F.round(F.col("trailing_mean") - F.col(value), 9) >= drop)).drop("__n")
