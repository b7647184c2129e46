"""How rows are dealt over tasks."""

import re

from pyspark.sql import functions as F

from gristmill.operators.rows import spread_by_rows
from gristmill.plans import quality
from gristmill.plans.registry import Tables


def test_tasks_grow_with_rows(spark, sf_dir):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(10_000).coalesce(1)
    assert [spread_by_rows(df, "id", rows=n).rdd.getNumPartitions() for n in (100, 10**6)] == [100, least]
    assert spread_by_rows(df, "id", rows=100).agg(F.sum("id")).first()[0] == sum(range(10_000))
    # Each order is in one task: the join and the count of distinct orders use the deal, and shuffle the line items no more.
    plan = quality._rates(Tables(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and not re.search(r"hashpartitioning\(run#\d+, field#\d+, method#\d+, entity", plan)
