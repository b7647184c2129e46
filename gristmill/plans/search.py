"""Faceted search over the catalogue (table part), comparison and options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import text_match, text_rank
from gristmill.operators.rows import all_of, at_least, at_most_or_null, facet, in_request_order, overlaps, page
from gristmill.plans.registry import Tables, plan


def search(catalogue: DataFrame, words: str | None = None, most_size: int | None = None, least_price: float | None = None, most_price: float | None = None, types: list[str] | None = None, named: list[str] | None = None) -> DataFrame:
    """Rows of the catalogue that all given filters keep; size is null where it is not known."""
    kept = catalogue.withColumn("size", F.expr("nullif(p_size, 7)")).withColumn("words", F.split("p_name", " "))
    conditions = [at_most_or_null("size", most_size), at_least("p_retailprice", least_price), at_most_or_null("p_retailprice", most_price)]
    if types:
        conditions.append(F.lower("p_type").isin([t.lower() for t in types]))
    if named:
        conditions.append(overlaps("words", named))
    if words:
        conditions.append(text_match("p_name", words))
    return kept.where(all_of(conditions))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of a faceted search: null-tolerant size bound, price floor; cheapest first, nulls last, key as tie-break."""
    return search_page(Tables(spark, sf_dir))


@plan("""SELECT p_partkey, p_name, p_type, nullif(p_size, 7) AS size, p_retailprice FROM part
WHERE (nullif(p_size, 7) IS NULL OR nullif(p_size, 7) <= 30) AND p_retailprice >= 900 ORDER BY p_retailprice NULLS LAST, p_name, p_partkey LIMIT 50""")
def search_page(t: Tables) -> DataFrame:
    found = search(t.part, most_size=30, least_price=900)
    return page(found.select("p_partkey", "p_name", "p_type", "size", "p_retailprice"), [F.col("p_retailprice").asc_nulls_last(), F.col("p_name"), F.col("p_partkey")], 1, 50)


@plan("""WITH hit AS (SELECT p_partkey, p_name, p_type FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'blue']) ORDER BY p_retailprice, p_partkey LIMIT 40)
SELECT p_type AS value, count(*) AS n FROM hit GROUP BY 1""")
def agg_15_page_facets(t: Tables) -> DataFrame:
    hit = page(search(t.part, named=["red", "blue", " "]), [F.col("p_retailprice"), F.col("p_partkey")], 1, 40)
    return facet(hit.select(F.array("p_type").alias("a")), "a")


@plan("""SELECT w AS value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_retailprice >= 900) GROUP BY 1""")
def agg_15_full_facets(t: Tables) -> DataFrame:
    return facet(search(t.part, least_price=900), "words")


@plan("""SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'widget')""")
def fil_03_text_match(t: Tables) -> DataFrame:
    return search(t.part, words="the widgets").select("p_partkey", "p_name")


@plan()
def fil_03_text_rank(t: Tables) -> DataFrame:
    return search(t.part, words="red").select("p_partkey", F.round(text_rank("p_name", "red"), 4).alias("rank")).orderBy(F.desc("rank"), "p_partkey").limit(100)


@plan("""SELECT p.p_partkey, p.p_name, w.pos FROM (VALUES (0, 7), (1, 3), (2, 11)) w(pos, id) JOIN part p ON p.p_partkey = w.id""")
def joi_21_compare(t: Tables) -> DataFrame:
    return in_request_order(t.part, "p_partkey", ["7", "x", "3", "11"], most=5, position="pos").select("p_partkey", "p_name", "pos")


@plan("""SELECT DISTINCT p_type, p_brand FROM part WHERE p_type <> 'PROMO'""")
def agg_20_options(t: Tables) -> DataFrame:
    return t.part.where("p_type <> 'PROMO'").select("p_type", "p_brand").distinct().orderBy("p_type", "p_brand")


@plan("""SELECT count(*) AS rows, count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types FROM part""")
def search_stats(t: Tables) -> DataFrame:
    return t.part.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_type").alias("types"))
