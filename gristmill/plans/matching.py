"""Fuzzy matches, matching in passes, run differences and staging over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators import cascade, changes, fuzzy
from gristmill.operators.rows import spread
from gristmill.plans.registry import Tables, plan

_CLEAN = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
_SORTED = "array_to_string(list_sort(list_filter(string_split({}, ' '), lambda w: w <> '')), ' ')"
_OTHER = "CASE WHEN p_size < 12 THEN upper(p_name) || '  ' || p_type WHEN p_size < 25 THEN p_type || ' ' || p_name || 's' WHEN p_size < 40 THEN translate(p_name, 'aeou', 'ia') || ' ' || p_type ELSE 'only ' || p_brand END"
#: The longest common subsequence of a and b (of less than 64 letters): a bit of one number for each letter of a.
_COMMON = """len(a) - bit_count(list_reduce(list_prepend((1::UBIGINT << len(a)) - 1, list_transform(string_split(b, ''), lambda c: list_sum(list_transform(range(len(a)), lambda i: CASE WHEN a[i + 1] = c THEN 1::UBIGINT << i ELSE 0::UBIGINT END))::UBIGINT)),
lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::UBIGINT << len(a)) - 1)))"""
_FUZZY = f"""WITH l AS (SELECT p_partkey AS l, p_brand AS g, {_CLEAN.format("p_name || ' ' || p_type")} AS n, nullif(p_type, 'SMALL') AS bucket FROM part), r AS (SELECT p_partkey AS r, p_brand AS g, {_CLEAN.format(_OTHER)} AS n, p_type AS bucket FROM part),
e AS (SELECT g, n, min(r) AS exact FROM r GROUP BY g, n), k AS (SELECT g, bucket, min(r) AS in_bucket FROM r GROUP BY g, bucket),
o AS (SELECT DISTINCT g, n, {_SORTED.format("n")} AS a FROM l WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.g = l.g AND e.n = l.n)), d AS (SELECT g, {_SORTED.format("n")} AS b, min(r) AS r FROM r GROUP BY ALL),
s AS (SELECT g, a, b, 200.0 * ({_COMMON}) / (len(a) + len(b)) AS score FROM (SELECT DISTINCT o.g, a, b FROM o JOIN d ON o.g = d.g)),
f AS (SELECT DISTINCT ON (s.g, a) s.g, a, d.r AS fuzzy, score FROM s JOIN d ON s.g = d.g AND s.b = d.b WHERE score >= 80 ORDER BY score DESC, d.r),
j AS (SELECT l.*, exact, fuzzy, score, in_bucket FROM l LEFT JOIN e ON l.g = e.g AND l.n = e.n LEFT JOIN o ON o.g = l.g AND o.n = l.n LEFT JOIN f ON f.g = o.g AND f.a = o.a LEFT JOIN k ON k.g = l.g AND k.bucket = l.bucket)
"""


def _fuzzy(t: Tables) -> DataFrame:
    size, name = F.col("p_size"), F.col("p_name")
    other = F.when(size < 12, F.concat(F.upper(name), F.lit("  "), "p_type")).when(size < 25, F.concat("p_type", F.lit(" "), name, F.lit("s")))
    other = other.when(size < 40, F.concat(F.translate(name, "aeou", "ia"), F.lit(" "), "p_type")).otherwise(F.concat(F.lit("only "), "p_brand"))
    left = t.part.select("p_brand", F.col("p_partkey").alias("l"), F.concat_ws(" ", name, "p_type").alias("name"), F.nullif("p_type", F.lit("SMALL")).alias("bucket"))
    right = t.part.select("p_brand", F.col("p_partkey").alias("r"), other.alias("name"), F.col("p_type").alias("bucket"))
    return fuzzy.match_names(left, right, "l", "name", "r", "name", ["p_brand"], left_bucket="bucket", right_bucket="bucket")


@plan(_FUZZY + """SELECT g AS p_brand, l, coalesce(exact, fuzzy, in_bucket) AS r, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN score >= 85 THEN 'high' WHEN score IS NOT NULL THEN 'medium' WHEN in_bucket IS NOT NULL THEN 'bucket' ELSE 'none' END AS quality,
CASE WHEN exact IS NOT NULL THEN 100.0 ELSE round(score, 6) END AS score FROM j""")  # fmt: skip
def er_09_fuzzy(t: Tables) -> DataFrame:
    return _fuzzy(t).withColumn("score", F.round("score", 6))


@plan(_FUZZY + """SELECT g AS p_brand, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN score >= 85 THEN 'high' WHEN score IS NOT NULL THEN 'medium' WHEN in_bucket IS NOT NULL THEN 'bucket' ELSE 'none' END AS quality, count(*) AS n FROM j GROUP BY ALL""")
def joi_18_fuzzy(t: Tables) -> DataFrame:
    """How the join decides a brand's names."""
    return _fuzzy(t).groupBy("p_brand", "quality").agg(F.count(F.lit(1)).alias("n"))


@plan(f"""WITH a AS (SELECT DISTINCT p_brand, {_SORTED.format("p_name || ' ' || p_type")} AS a FROM part), b AS (SELECT DISTINCT p_brand, {_SORTED.format("translate(p_name, 'aeou', 'ia') || ' ' || p_type")} AS b FROM part),
s AS (SELECT p_brand, a, b, 200.0 * ({_COMMON}) / (len(a) + len(b)) AS score FROM a JOIN b USING (p_brand)) SELECT p_brand, a, b, round(score, 6) AS score FROM s WHERE score >= 80""")
def joi_18_pairs(t: Tables) -> DataFrame:
    """All pairs of likeness 80 of a brand, not only the best of each name."""
    left = t.part.select("p_brand", fuzzy.sorted_words(F.concat_ws(" ", "p_name", "p_type")).alias("a"))
    right = t.part.select("p_brand", fuzzy.sorted_words(F.concat_ws(" ", F.translate("p_name", "aeou", "ia"), "p_type")).alias("b"))
    return fuzzy.similar_pairs(left, right, "a", "b", ["p_brand"], 80.0).withColumn("score", F.round("score", 6))


@plan()
def str_18_likeness(t: Tables) -> DataFrame:
    """Weighted likeness of each part's name to the next one's of its brand, and whether they count as the same."""
    # Distinct names meet, not parts, whose pairs grow with the square of a brand's. Dealt without keys: by its own keys the distinct step's shuffle would serve, which Spark coalesces to one task.
    one, other = t.part.select("p_brand", "p_size", F.col("p_name").alias("a")).distinct(), t.part.select("p_brand", (F.col("p_size") - 1).alias("p_size"), F.concat_ws(" ", "p_name", "p_type").alias("b")).distinct()
    names = spread(one.join(other, ["p_brand", "p_size"]).select("a", "b").distinct())
    return names.select("a", "b", fuzzy.weighted_likeness("a", "b").alias("score"), fuzzy.same_name("a", "b").alias("same"))


def _award(size: Column) -> Column:
    return F.when(size < 15, "Master of ").when(size < 30, "Diploma of ").otherwise("")


_AWARD = "CASE WHEN {0} < 15 THEN 'Master of ' WHEN {0} < 30 THEN 'Diploma of ' ELSE '' END"
_TELLING = "list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('', 'of', 'master', 'diploma'))))"
_FIRST = "split_part({}, ' ', 1)"


@plan(f"""WITH a0 AS (SELECT p_partkey AS l, p_type AS g, {_AWARD.format("p_size")} || CASE WHEN p_size BETWEEN 8 AND 20 THEN {_FIRST.format("p_name")} ELSE p_name END AS name, CASE WHEN p_size > 45 THEN p_name END AS code FROM part),
b0 AS (SELECT min(p_partkey) AS r, p_type AS g, {_AWARD.format("min(p_size)")} || {_FIRST.format("p_name")} AS name, p_brand || ' ' || p_name AS more, CASE WHEN min(p_size) > 20 THEN p_name END AS code FROM part GROUP BY p_type, p_name, p_brand),
a AS (SELECT *, {_TELLING.format("name")} AS w, {_FIRST.format("name")} AS aw FROM a0), b AS (SELECT *, {_TELLING.format("name")} AS m, {_TELLING.format("name || ' ' || more")} AS v, {_FIRST.format("name")} AS bw FROM b0),
c AS (SELECT l, a.g, min(r) AS coded FROM a JOIN b ON a.g = b.g AND a.code = b.code WHERE len(w) > 0 GROUP BY ALL),
s AS (SELECT l, r, len(list_intersect(w, v)) AS n, greatest(len(list_intersect(w, v)) / len(w), len(list_intersect(w, v)) / len(v)) AS score, abs(len(m) - len(w)) AS far, w = m AS same FROM a JOIN b ON a.g = b.g
 WHERE (aw NOT IN ('Master', 'Diploma') OR bw NOT IN ('Master', 'Diploma') OR aw = bw) AND l NOT IN (SELECT l FROM c)),
f AS (SELECT DISTINCT ON (l) l, r, score FROM s WHERE score >= 0.5 AND n > 0 AND (n >= 2 OR same) ORDER BY score DESC, far, r)
SELECT a.g AS p_type, a.l, coalesce(coded, f.r) AS r, CASE WHEN coded IS NOT NULL THEN 'cricos_match' WHEN f.r IS NOT NULL THEN 'name_match' ELSE 'no_match' END AS method, round(score, 6) AS score FROM a LEFT JOIN c ON a.l = c.l LEFT JOIN f ON f.l = a.l""")
def er_10_passes(t: Tables) -> DataFrame:
    first, size = F.split("p_name", " ")[0], F.col("p_size")
    left = t.part.select(F.col("p_partkey").alias("l"), "p_type", F.concat(_award(size), F.when(size.between(8, 20), first).otherwise(F.col("p_name"))).alias("name"), F.when(size > 45, F.col("p_name")).alias("code"))
    rows = t.part.groupBy("p_type", "p_name", "p_brand").agg(F.min("p_partkey").alias("r"), F.min("p_size").alias("p_size"))
    right = rows.select("r", "p_type", F.concat(_award(size), first).alias("name"), F.concat_ws(" ", "p_brand", "p_name").alias("more"), F.when(size > 20, F.col("p_name")).alias("code"))
    return cascade.match_in_passes(left, right, "l", "name", "r", "name", ["p_type"], "code", "code", "more").withColumn("score", F.round("score", 6))


@plan("""WITH b AS (SELECT o_orderkey AS url, o_totalprice AS price, o_orderpriority AS priority, CASE WHEN o_orderstatus = 'P' THEN 'timeout: ' || o_orderdate END AS error, false AS ruled FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_totalprice > 50000),
a AS (SELECT o_orderkey AS url, CASE WHEN o_totalprice > 250000 THEN o_totalprice + 1 ELSE o_totalprice END AS price, CASE WHEN o_orderpriority = '3-MEDIUM' THEN '4-NOT SPECIFIED' ELSE o_orderpriority END AS priority,
 CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderpriority = '5-LOW' THEN 'http: x' ELSE 'timeout: y' END END AS error, o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' AS ruled FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_totalprice <= 150000),
j AS (SELECT coalesce(b.url, a.url) AS url, b.url AS bu, a.url AS au, b.price AS bp, a.price AS ap, b.priority AS bq, a.priority AS aq, b.error AS be, a.error AS ae, b.error IS NULL AND NOT coalesce(b.ruled, false) AS bs, a.error IS NULL AND NOT coalesce(a.ruled, false) AS sa FROM b FULL JOIN a ON a.url = b.url)
SELECT url, CASE WHEN bu IS NULL THEN 'new_only' WHEN au IS NULL THEN 'old_only' WHEN bs <> sa THEN 'staging' WHEN be IS NOT NULL AND ae IS NOT NULL THEN CASE WHEN split_part(be, ':', 1) = split_part(ae, ':', 1) THEN 'matched' ELSE 'regression' END
 WHEN bp <> ap OR bq <> aq THEN 'regression' ELSE 'matched' END AS status,
CASE WHEN bu IS NULL OR au IS NULL OR bs <> sa THEN '' WHEN be IS NOT NULL AND ae IS NOT NULL THEN CASE WHEN split_part(be, ':', 1) = split_part(ae, ':', 1) THEN '' ELSE 'error' END ELSE concat_ws(',', CASE WHEN bp <> ap THEN 'price' END, CASE WHEN bq <> aq THEN 'priority' END) END AS fields FROM j""")
def qa_19_run_diff(t: Tables) -> DataFrame:
    price, priority, status = F.col("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderstatus")
    before = t.orders.where((priority != "1-URGENT") | (price > 50000)).select(
        F.col("o_orderkey").alias("url"), price.alias("price"), priority.alias("priority"), F.when(status == "P", F.concat(F.lit("timeout: "), "o_orderdate")).alias("error"), F.lit(False).alias("domestic_only"), F.lit("b").alias("run_id")
    )
    after = t.orders.where((priority != "1-URGENT") | (price <= 150000)).select(
        F.col("o_orderkey").alias("url"), F.when(price > 250000, price + 1).otherwise(price).alias("price"), F.when(priority == "3-MEDIUM", "4-NOT SPECIFIED").otherwise(priority).alias("priority"),
        F.when(status == "P", F.when(priority == "5-LOW", "http: x").otherwise("timeout: y")).alias("error"), ((priority == "2-HIGH") & (status == "O")).alias("domestic_only"), F.lit("a").alias("run_id"),
    )
    return changes.run_diff(before, after).select("url", "status", F.array_join("diffs.field", ",").alias("fields"))


@plan("""WITH b AS (SELECT c_nationkey AS g, c_custkey AS k, c_mktsegment AS segment, CASE WHEN c_acctbal > 0 THEN 'rule' ELSE 'ai' END AS way FROM customer WHERE c_acctbal > -900 AND c_nationkey <> 3),
a AS (SELECT c_nationkey AS g, c_custkey AS k, CASE WHEN c_acctbal > 9000 THEN 'OTHER' ELSE c_mktsegment END AS segment, CASE WHEN c_acctbal > 7000 THEN 'ai' WHEN c_acctbal > 0 THEN 'rule' ELSE 'ai' END AS way FROM customer WHERE c_acctbal < 9800 AND c_nationkey <> 4),
j AS (SELECT coalesce(b.g, a.g) AS g, coalesce(b.k, a.k) AS k, b.k AS bk, a.k AS ak, b.segment AS bs, a.segment AS sa, b.way AS bw, a.way AS aw FROM b FULL JOIN a ON a.g = b.g AND a.k = b.k WHERE coalesce(b.g, a.g) NOT IN (3, 4))
SELECT g AS c_nationkey, k AS c_custkey, kind, field, before, after, g = 7 AS expected FROM (
SELECT g, k, 'added' AS kind, NULL AS field, NULL AS before, NULL AS after FROM j WHERE bk IS NULL UNION ALL SELECT g, k, 'removed', NULL, NULL, NULL FROM j WHERE ak IS NULL
UNION ALL SELECT g, k, 'value', 'segment', bs, sa FROM j WHERE bs <> sa UNION ALL SELECT g, k, 'method', 'segment', bw, aw FROM j WHERE bw <> aw AND bs = sa)""")
def qa_20_sweep(t: Tables) -> DataFrame:
    balance, nation = F.col("c_acctbal"), F.col("c_nationkey")
    rule = F.when(balance > 0, "rule").otherwise("ai")
    before = t.customer.where((balance > -900) & (nation != 3)).select("c_nationkey", "c_custkey", F.col("c_mktsegment").alias("segment"), F.create_map(F.lit("segment"), rule).alias("ways"))
    after = t.customer.where((balance < 9800) & (nation != 4)).select(
        "c_nationkey", "c_custkey", F.when(balance > 9000, "OTHER").otherwise(F.col("c_mktsegment")).alias("segment"), F.create_map(F.lit("segment"), F.when(balance > 7000, "ai").otherwise(rule)).alias("ways")
    )
    return changes.snapshot_sweep(before, after, "c_nationkey", "c_custkey", ["segment"], "ways", expected=[7])


@plan("""WITH s AS (SELECT o_orderkey AS pos, 1 AS job, o_custkey AS uni, o_orderpriority AS url, CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'pending' END AS status FROM orders WHERE o_orderdate < DATE '1995-06-01'),
n AS (SELECT o_orderkey AS pos, 2 AS job, o_custkey AS uni, nullif(o_orderpriority, '5-LOW') AS url, 'pending' AS status FROM orders WHERE o_orderdate >= DATE '1995-06-01'),
f AS (SELECT DISTINCT ON (uni, url) * FROM n WHERE url IS NOT NULL ORDER BY pos)
SELECT * FROM s WHERE status = 'approved' OR NOT EXISTS (SELECT 1 FROM f WHERE f.uni = s.uni AND f.url = s.url) UNION ALL SELECT * FROM f UNION ALL SELECT * FROM n WHERE url IS NULL""")
def er_12_stage(t: Tables) -> DataFrame:
    old, of = F.col("o_orderdate") < F.lit("1995-06-01").cast("date"), lambda df, job, url, status: df.select(F.col("o_orderkey").alias("pos"), F.lit(job).alias("job"), F.col("o_custkey").alias("uni"), url.alias("url"), status.alias("status"))
    staged = of(t.orders.where(old), 1, F.col("o_orderpriority"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending"))
    new = of(t.orders.where(~old), 2, F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("pending"))
    return changes.stage_rows(staged, new, "job", "uni", "url", "status", "pos")
