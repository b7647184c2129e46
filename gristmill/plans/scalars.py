"""Scalar functions over the driver's texts, URLs, dates and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import html, text, urls
from gristmill.functions import values as v
from gristmill.plans.registry import Tables, plan


@plan(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents")
def str_01_collapse(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.collapse_spaces("text").alias("s"))


@plan("SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS s FROM pages")
def str_02_normalize(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.normalize("url").alias("s"))


@plan("SELECT c_custkey, nullif(split_part(c_name, '#', 2), '') AS a, nullif(split_part(c_name, '#', 3), '') AS b FROM customer")
def str_03_split_part(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.nullif(F.split_part("c_name", F.lit("#"), F.lit(2)), F.lit("")).alias("a"), F.nullif(F.split_part("c_name", F.lit("#"), F.lit(3)), F.lit("")).alias("b"))


@plan(r"SELECT p_partkey, regexp_replace(p_name, '^([a-z]+) ([a-z]+)$', '\2 of \1') AS s FROM part")
def str_04_groups(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.regexp_replace("p_name", "^([a-z]+) ([a-z]+)$", "$2 of $1").alias("s"))


@plan("SELECT c_custkey, TRY_CAST(regexp_replace('A$ ' || c_acctbal || ' p.a', '[^0-9-]', '', 'g') AS DOUBLE) AS signed, TRY_CAST(regexp_replace(c_name, '[^0-9]', '', 'g') AS BIGINT) AS whole FROM customer")
def str_05_parse(t: Tables) -> DataFrame:
    signed = F.regexp_replace(F.concat(F.lit("A$ "), F.col("c_acctbal").cast("string"), F.lit(" p.a")), r"\.", "")
    return t.customer.select("c_custkey", text.parse_number(signed).alias("signed"), text.parse_whole("c_name").alias("whole"))


@plan("SELECT DISTINCT regexp_replace(lower(o_orderpriority), '[^a-z0-9]', '', 'g') AS k FROM orders")
def str_06_header(t: Tables) -> DataFrame:
    return t.orders.select(text.header_key("o_orderpriority").alias("k")).distinct()


@plan("""SELECT o_orderkey, monthname(o_orderdate) || ',xyz' AS months FROM orders""")
def str_07_month_list(t: Tables) -> DataFrame:
    raw = F.concat(F.lower(F.date_format("o_orderdate", "MMM")), F.lit("; "), F.date_format("o_orderdate", "MMMM"), F.lit("/xyz"))
    return t.orders.select("o_orderkey", F.array_join(text.month_list(raw), ",").alias("months"))


@plan("SELECT o_orderkey, monthname(o_orderdate) AS m FROM orders")
def str_08_month(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", text.month_name(F.upper(F.date_format("o_orderdate", "MMM"))).alias("m"))


@plan()
def str_09_title(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.smart_title(F.concat("p_name", F.lit(" of it"))).alias("s"))


@plan("SELECT p_partkey, replace(p_name, ' ', '-') AS slug, regexp_matches(replace(p_name, ' ', '-'), '^[a-z0-9]+(-[a-z0-9]+){2,}$') AS is_slug FROM part")
def str_10_slug(t: Tables) -> DataFrame:
    slug = text.to_slug("p_name")
    return t.part.select("p_partkey", slug.alias("slug"), text.is_slug(slug).alias("is_slug"))


@plan()
def str_11_clean_name(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.clean_name(F.concat(F.lit("AB123 - "), "p_name", F.lit(" | Site"))).alias("s"))


@plan("""SELECT item_id, len(list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '' AND NOT list_contains(['a','an','and','at','by','for','from','in','of','on','or','the','to','with'], x)))) AS n FROM benchmark""")
def str_12_tokens(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.size(text.tokens("text")).cast("long").alias("n"))


@plan()
def str_13_windows(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(html.windows("text", "license", 40)).alias("n"))


@plan()
def str_14_near(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", html.near_keyword("text", "email", "contact").alias("near"))


@plan("SELECT c_custkey, contains(lower(c_name), CAST(c_custkey AS VARCHAR)) AS found FROM customer")
def str_15_value_in_text(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", text.value_in_text("c_custkey", "c_name").alias("found"))


_LINE = "'[' || upper(event_type) || '] row ' || event_id"


@plan(f"SELECT event_id, CASE WHEN contains(lower({_LINE}), '[error]') THEN 'error' ELSE 'info' END AS level FROM events")
def str_16_log_level(t: Tables) -> DataFrame:
    line = F.concat(F.lit("["), F.upper("event_type"), F.lit("] row "), F.col("event_id").cast("string"))
    return t.events.select("event_id", text.log_level(line).alias("level"))


@plan("SELECT CASE event_type WHEN 'click' THEN 'domestic_only' WHEN 'view' THEN 'fetch_failed' ELSE 'other' END AS bucket, count(*) AS n FROM events GROUP BY 1")
def str_17_skip_buckets(t: Tables) -> DataFrame:
    reason = F.when(F.col("event_type") == "click", "Domestic students").when(F.col("event_type") == "view", "HTTP 404").when(F.col("event_type") != "error", F.col("event_type"))
    return t.events.groupBy(text.skip_bucket(reason).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@plan("SELECT event_id, props AS j FROM events")
def str_19_tolerant_json(t: Tables) -> DataFrame:
    read = html.tolerant_json(F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    return t.events.select("event_id", F.regexp_replace(F.to_json(read), ":", ": ").alias("j"))


@plan("SELECT page_id, regexp_replace(lower(split_part(url, '#', 1)), '/+$', '') AS u FROM pages")
def url_01_strip(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.url_key(F.concat("url", F.lit("/#top"))).alias("u"))


@plan("""SELECT page_id, rtrim(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || '/' || array_to_string(list_slice(list_filter(string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> ''), 1, 2), '/'), '/') AS p FROM pages""")
def url_02_prefix(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.coarse_prefix("url").alias("p"))


@plan("SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) || '?id=1' AS u FROM pages")
def url_03_params(t: Tables) -> DataFrame:
    bare = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    return t.pages.select("page_id", urls.without_params(F.concat(bare, F.lit("?utm_source=x&id=1&GCLID=2"))).alias("u"))


@plan("""SELECT page_id, array_to_string(string_split(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '.')[-2:], '.') AS site FROM pages""")
def url_04_site(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.registrable(urls.host("url")).alias("site"))


@plan("SELECT max(page_id) AS page_id FROM pages GROUP BY page_id // 3")
def url_05_year_variants(t: Tables) -> DataFrame:
    third = F.floor(F.col("page_id") / 3)
    variants = t.pages.select("page_id", F.concat(F.lit("https://a.org/course-"), (F.col("page_id") % 3 + 2020).cast("string"), F.lit("/p"), third.cast("string")).alias("u"))
    return urls.latest_variants(variants, "u").select("page_id")


@plan()
def url_06_classify(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.classify("url").alias("kind"))


@plan()
def url_07_links(t: Tables) -> DataFrame:
    return html.parse(t.pages).select("page_id", F.explode("page.links").alias("link"))


@plan("SELECT page_id, contains(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)), 'login') AS blocked FROM pages")
def url_08_blocked(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.blocked_page("url", F.lit("Home"), parts=["login"], titles=["not found"]).alias("blocked"))


@plan("SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', ''), '[^a-z0-9]+', '-', 'g'), '(^-)|(-$)', '', 'g') AS slug FROM pages".replace("\\\\", "\\"))
def url_09_slug(t: Tables) -> DataFrame:
    return t.pages.select(urls.host_slug("url").alias("slug")).distinct()


@plan("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS m, count(*) AS n FROM orders GROUP BY 1")
def dat_01_month(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"))


@plan("SELECT user_id, CAST(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS BIGINT) AS seconds FROM events GROUP BY 1")
def dat_02_03_age(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("user_id", v.seconds_between("a", "b").alias("seconds"))


@plan("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def dat_04_iso(t: Tables) -> DataFrame:
    return t.events.select("event_id", v.iso_z("ts").alias("iso"))


@plan("""SELECT p_partkey, CAST(CASE WHEN p_size * 3 >= 52 THEN round_even(p_size * 3 / 52.0 * 2, 0) / 2 WHEN p_size * 3 >= 12 THEN round_even(p_size * 3 / 4.348, 0) ELSE p_size * 3 END AS DOUBLE) AS amount,
CASE WHEN p_size * 3 >= 52 THEN 'Year' WHEN p_size * 3 >= 12 THEN 'Month' ELSE 'Week' END AS term FROM part""")
def mat_01_nearest_half(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", v.weeks_as_term(F.col("p_size") * 3).alias("r")).select("p_partkey", "r.*")


@plan("SELECT p_partkey, round(p_size / CASE p_type WHEN 'SMALL' THEN 12.0 WHEN 'LARGE' THEN 52.0 WHEN 'MEDIUM' THEN 2.0 ELSE 1.0 END, 6) AS years FROM part")
def mat_02_years(t: Tables) -> DataFrame:
    term = F.when(F.col("p_type") == "SMALL", "Months").when(F.col("p_type") == "LARGE", "week").when(F.col("p_type") == "MEDIUM", "2 Semesters")
    return t.part.select("p_partkey", F.round(v.to_years(F.col("p_size").cast("double"), term), 6).alias("years"))


@plan("SELECT p_partkey, CASE WHEN p_size * 8 BETWEEN 48 AND 480 AND p_size * p_retailprice BETWEEN 15000 AND 500000 THEN round(p_size * p_retailprice, 2) END AS total FROM part")
def mat_03_units(t: Tables) -> DataFrame:
    said = F.concat(F.lit("3 units a term, "), (F.col("p_size") * 8).cast("string"), F.lit(" credit points in all"))
    return t.part.select("p_partkey", F.round(v.yearly_total(said, "p_retailprice"), 2).alias("total"))


@plan("SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS tokens, round((floor(length(text) / 4) * 0.075 + 100 * 0.30) / 1e6, 10) AS cost FROM documents")
def mat_04_cost(t: Tables) -> DataFrame:
    n = v.tokens_estimate("text")
    return t.documents.select("doc_id", n.alias("tokens"), F.round(v.call_cost(n, F.lit(100)), 10).alias("cost"))


@plan("SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN p_size BETWEEN 1 AND 10 WHEN 'LARGE' THEN p_size BETWEEN 20 AND 50 ELSE true END AS ok FROM part")
def mat_05_bounds(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", v.in_bounds("p_size", "p_type", {"SMALL": (1, 10), "LARGE": (20, 50)}).alias("ok"))


@plan("SELECT p_type, count(*) FILTER (WHERE p_size < 5) AS below FROM part GROUP BY 1")
def mat_06_below_floor(t: Tables) -> DataFrame:
    return t.part.groupBy("p_type").agg(F.count_if(F.col("p_size") < 5).alias("below"))


@plan("SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) = 'red' THEN p_name ELSE p_name || ' red' END AS words FROM part WHERE split_part(p_name, ' ', 2) <> 'red'")
def arr_01_append(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    return t.part.where(F.get(words, F.lit(1)) != "red").select("p_partkey", F.array_join(v.append_distinct(words, F.array(F.lit("red"))), " ").alias("words"))


@plan("""SELECT event_id, '[' || props || ',{"k": 0}]' AS j FROM events""")
def arr_02_append_struct(t: Tables) -> DataFrame:
    grown = F.array_append(F.from_json(F.concat(F.lit("["), "props", F.lit("]")), "array<struct<k: long>>"), F.struct(F.lit(0).cast("long").alias("k")))
    return t.events.select("event_id", F.regexp_replace(F.to_json(grown), ":", ": ").alias("j"))


@plan("SELECT p_partkey, array_to_string(list_sort(string_split(p_name || ' b a', ' ')), ' ') AS s FROM part")
def arr_03_sorted(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(F.array_sort(F.split(F.concat("p_name", F.lit(" b a")), " ")), " ").alias("s"))


@plan("SELECT p_partkey, split_part(p_name, ' ', 1) IN ('red', 'blue') AND split_part(p_name, ' ', 2) IN ('red', 'blue', 'bolt') AS known FROM part")
def arr_04_all_known(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    return t.part.select("p_partkey", (v.all_in(F.slice(words, 1, 1), ["red", "blue"]) & v.all_in(F.slice(words, 2, 1), ["red", "blue", "bolt"])).alias("known"))


@plan("SELECT p_partkey, p_name AS kept FROM part")
def arr_05_places(t: Tables) -> DataFrame:
    places = F.array(F.lit("Online"), F.col("p_name"), F.upper("p_name"), F.lit("Virtual Campus"))
    return t.part.select("p_partkey", F.array_join(v.distinct_ignoring_case(v.without_virtual(places)), ",").alias("kept"))


@plan("SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'Tiny' ELSE p_type END || ',' || p_brand AS names FROM part")
def arr_06_codes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(v.expand_codes(F.concat("p_type", F.lit(" | "), "p_brand"), {"SMALL": "Tiny"}), ",").alias("names"))


@plan("""SELECT event_id, json_extract_string(props, '$.k') AS k, '{"id":' || event_id || '}' AS j FROM events""")
def jsn_01_access(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"))).alias("j"))
