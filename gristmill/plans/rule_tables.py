"""Rule tables over the driver's tables; the rules are made from the tables too, some three hundred of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators import rules
from gristmill.plans.registry import Tables, plan

_RULES = """p AS (SELECT DISTINCT p_name AS phrase FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part
UNION SELECT DISTINCT split_part(p_name, ' ', 2) || ' ' || p_brand FROM part), r AS (SELECT phrase, 'c' || len(phrase) % 5 AS category, 's' || len(phrase) AS sub_category, row_number() OVER (ORDER BY phrase DESC) AS pos FROM p),
t AS (SELECT p_partkey AS id, p_name || ' (' || p_type || ' ' || split_part(p_name, ' ', 2) || ' ' || p_brand || ')' AS name FROM part)"""
_FITS = "(' ' || replace(replace(lower({}), '(', ' '), ')', ' ') || ' ') LIKE ('% ' || lower(phrase) || ' %')"


def rule_table(t: Tables) -> DataFrame:
    """Rules (category, sub_category, phrase, pos): a part's name either way round, its first word, and its last one with a brand."""
    first, last = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    phrases = [F.col("p_name"), F.concat_ws(" ", last, first), first, F.concat_ws(" ", last, "p_brand")]
    made = t.part.select("p_name", "p_brand").distinct().select(F.explode(F.array(*phrases)).alias("phrase")).distinct()
    # The rules are few; one task may number them.
    place = F.row_number().over(Window.orderBy(F.desc("phrase")))
    length = F.length("phrase")
    return made.select(F.concat(F.lit("c"), (length % 5).cast("string")).alias("category"), F.concat(F.lit("s"), length.cast("string")).alias("sub_category"), "phrase", place.alias("pos"))


def _named(t: Tables) -> DataFrame:
    last = F.split_part("p_name", F.lit(" "), F.lit(2))
    return t.part.select(F.col("p_partkey").alias("id"), F.concat(F.col("p_name"), F.lit(" ("), F.concat_ws(" ", "p_type", last, "p_brand"), F.lit(")")).alias("name"))


@plan(f"""WITH {_RULES}, h AS (SELECT id, category, sub_category, pos, 0 AS part FROM t JOIN r ON {_FITS.format("regexp_extract(name, '[(](.*)[)]', 1)")} UNION ALL SELECT id, category, sub_category, pos, 1 FROM t JOIN r ON {_FITS.format("name")})
SELECT DISTINCT ON (id) id, category, sub_category FROM h ORDER BY part, pos""")
def ex_15_first_category(t: Tables) -> DataFrame:
    return rules.first_category(_named(t), rule_table(t), "id", "name")


@plan(f"""WITH {_RULES}, h AS (SELECT id, category, sum(len(string_split(phrase, ' '))) AS score FROM t JOIN r ON {_FITS.format("name")} GROUP BY ALL), o AS (SELECT category, min(pos) AS first FROM r GROUP BY 1)
SELECT DISTINCT ON (id) id, category, CAST(score AS BIGINT) AS score FROM h JOIN o USING (category) ORDER BY score DESC, first""")
def ex_15_best_category(t: Tables) -> DataFrame:
    return rules.best_category(_named(t), rule_table(t), "id", "name")


@plan("""WITH s AS (SELECT DISTINCT lower(p_type) || '.edu' AS host_ending, split_part(p_name, ' ', 1) AS phrase, 1 + len(p_name) % 12 AS n FROM part WHERE p_brand < 'Brand#15'),
p AS (SELECT p_partkey AS id, 'www.' || lower(p_type) || CASE WHEN p_size > 40 THEN '.org' ELSE '.edu' END AS host, 'Starts: ' || upper(p_name) AS said FROM part)
SELECT id, array_to_string(list_sort(list(DISTINCT n)), ',') AS months FROM p JOIN s ON ('.' || host) LIKE ('%.' || host_ending) AND (' ' || lower(said) || ' ') LIKE ('% ' || phrase || ' %') GROUP BY id""")
def ex_10_sessions(t: Tables) -> DataFrame:
    number = (1 + F.length("p_name") % 12).cast("int")
    table = t.part.where("p_brand < 'Brand#15'").select(F.concat(F.lower("p_type"), F.lit(".edu")).alias("host_ending"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("phrase"), number.alias("month_number"), number.cast("string").alias("month")).distinct()
    host = F.concat(F.lit("www."), F.lower("p_type"), F.when(F.col("p_size") > 40, ".org").otherwise(".edu"))
    pages = t.part.select(F.col("p_partkey").alias("id"), host.alias("host"), F.concat(F.lit("Starts: "), F.upper("p_name")).alias("said"))
    return rules.session_months(pages, table, "id", "host", "said").select("id", F.array_join("months", ",").alias("months"))


@plan("""WITH p AS (SELECT page_id, lower(url) AS u FROM pages), s AS (SELECT page_id, list_filter(string_split(regexp_replace(u, '^[a-z]+://[^/?#]*|[?#].*$', '', 'g'), '/'), lambda x: x <> '') AS path FROM p)
SELECT page_id, path[1] AS folder FROM s WHERE len(path) > 0 AND path[1] IN (SELECT path[1] FROM s WHERE len(path) > 0 GROUP BY 1 HAVING count(*) >= 2)""")
def url_08_blocked(t: Tables) -> DataFrame:
    """Pages beneath a first folder that two pages or more have, by rules made of these folders."""
    path = F.filter(F.split(F.regexp_replace(F.lower("url"), r"^[a-z]+://[^/?#]*|[?#].*$", ""), "/"), lambda x: x != "")
    first = t.pages.select("page_id", F.get(path, F.lit(0)).alias("value")).where("value IS NOT NULL")
    table = first.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(F.lit("path").alias("kind"), "value", F.xxhash64("value").alias("pos"))
    found = rules.blocked(t.pages, table, "page_id", "url", "url").join(first.withColumnRenamed("value", "folder"), "page_id")
    return found.select("page_id", "folder")
