"""Entity resolution over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators import resolution as er
from gristmill.operators import rows as r
from gristmill.plans.registry import Tables, plan


def _docs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(F.lower(F.trim("text")).cast("binary")).alias("name"), F.nullif("lang", F.lit("en")).alias("lang"), F.nullif(F.col("n_chars") % 5, F.lit(0)).alias("x"), F.col("n_chars").alias("updated"))


_DOCS = "docs AS (SELECT doc_id, md5(lower(trim(text))) AS name, nullif(lang, 'en') AS lang, nullif(n_chars % 5, 0) AS x, n_chars AS updated FROM documents)"
_MAP = f"WITH {_DOCS}, m AS (SELECT doc_id AS dup_id, min(doc_id) OVER (PARTITION BY name) AS keep_id FROM docs), map AS (SELECT * FROM m WHERE dup_id <> keep_id)"


@plan(f"{_MAP} SELECT * FROM map")
def er_01_duplicate_map(t: Tables) -> DataFrame:
    return er.duplicate_map(_docs(t), [], "name", "doc_id")


@plan(f"""{_MAP}, n AS (SELECT * FROM (SELECT keep_id, d.*, row_number() OVER (PARTITION BY keep_id ORDER BY updated DESC NULLS LAST, doc_id DESC) AS rn FROM map JOIN docs d ON d.doc_id = dup_id) WHERE rn = 1)
SELECT d.doc_id, d.name, coalesce(d.lang, n.lang) AS lang, coalesce(d.x, n.x) AS x, greatest(d.updated, n.updated) AS updated FROM docs d LEFT JOIN n ON n.keep_id = d.doc_id WHERE d.doc_id NOT IN (SELECT dup_id FROM map)""")
def er_02_gap_fill(t: Tables) -> DataFrame:
    docs = _docs(t)
    return er.gap_fill(docs, er.duplicate_map(docs, [], "name", "doc_id"), "doc_id", ["lang", "x"], "updated")


@plan(f"""{_MAP}, c AS (SELECT l.doc_id, l.toxic, map.keep_id FROM labels l LEFT JOIN map ON map.dup_id = l.doc_id)
SELECT coalesce(keep_id, doc_id) AS doc_id, toxic FROM c WHERE keep_id IS NULL OR keep_id NOT IN (SELECT doc_id FROM c WHERE keep_id IS NULL)""")
def er_03_repoint(t: Tables) -> DataFrame:
    return er.repoint(t.labels.select("doc_id", "toxic"), er.duplicate_map(_docs(t), [], "name", "doc_id"), "doc_id", single=True)


def _evidence(t: Tables) -> DataFrame:
    """Lines of an order as evidence: the flag is the field, the price the confidence."""
    method = text.first_match([(F.col("l_linestatus") == "O", "central_page:english"), (F.col("l_tax") > 0.05, "per_course_vision"), (F.col("l_discount") > 0.05, "uni_pdf:cricos_match:fees")], "new_extractor")
    return t.lineitem.select(F.col("l_orderkey").alias("course_id"), F.col("l_returnflag").alias("field_key"), F.col("l_quantity").cast("string").alias("value"), method.alias("method"), F.col("l_extendedprice").alias("confidence"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("pos"))


_EVIDENCE = """e AS (SELECT l_orderkey AS course_id, l_returnflag AS field_key, l_quantity, CASE WHEN l_linestatus = 'O' THEN 1.0 WHEN l_tax > 0.05 THEN 4.0 WHEN l_discount > 0.05 THEN 2.5 ELSE 3.0 END AS auth, l_extendedprice AS confidence, l_linenumber * 1000000 + l_partkey AS pos FROM lineitem)"""


@plan(f"WITH {_EVIDENCE} SELECT course_id, field_key, pos FROM (SELECT *, row_number() OVER (PARTITION BY course_id, field_key ORDER BY auth DESC, confidence DESC NULLS LAST, pos) AS rn FROM e) WHERE rn = 1")
def er_04_winner(t: Tables) -> DataFrame:
    return er.evidence_winner(_evidence(t)).select("course_id", "field_key", "pos")


@plan("""WITH d AS (SELECT *, lower(trim(l_returnflag)) AS v FROM lineitem), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linestatus, v ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS rn FROM d) WHERE rn = 1),
p AS (SELECT a.l_orderkey, a.l_linestatus, least(a.v, b.v) AS value_a, greatest(a.v, b.v) AS value_b FROM f a JOIN f b ON a.l_orderkey = b.l_orderkey AND a.l_linestatus = b.l_linestatus AND a.v < b.v)
SELECT l_orderkey, min(l_linestatus) AS l_linestatus, value_a, value_b FROM p GROUP BY 1, 3, 4""")
def er_05_conflicts(t: Tables) -> DataFrame:
    return er.conflict_pairs(t.lineitem, ["l_orderkey"], "l_linestatus", "l_returnflag", "l_partkey", "l_extendedprice", "l_linenumber").select("l_orderkey", "l_linestatus", "value_a", "value_b")


@plan("SELECT event_type, CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 2.5 WHEN 'error' THEN 4.0 ELSE 3.0 END AS authority FROM (SELECT DISTINCT event_type FROM events)")
def er_06_authority(t: Tables) -> DataFrame:
    kinds = t.events.select("event_type").distinct()
    method = F.when(F.col("event_type") == "click", "central_page:english").when(F.col("event_type") == "view", "uni_pdf:cricos_match:fees").when(F.col("event_type") == "error", "per_course_vision:x").otherwise("anything")
    return kinds.select("event_type", er.authority(method).alias("authority"))


@plan("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'research' WHEN 'O' THEN 'postgraduate' ELSE 'undergraduate' END AS bucket FROM orders")
def er_07_bucket(t: Tables) -> DataFrame:
    level = F.when(F.col("o_orderstatus") == "F", "Master of Philosophy").when(F.col("o_orderstatus") == "O", "Undergraduate Certificate")
    return t.orders.select("o_orderkey", er.degree_bucket(level, F.lit("Bachelor of Arts")).alias("bucket"))


@plan("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS f FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_acctbal > 0 GROUP BY 1, 2 HAVING count(*) >= 2),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1)
SELECT c_custkey, coalesce(nullif(t.c_mktsegment, 'MACHINERY'), m.c_mktsegment) AS slot, CASE WHEN t.c_mktsegment = 'MACHINERY' AND m.rn = 1 THEN 'sibling_cache:undergraduate' END AS filled_by FROM customer t LEFT JOIN m USING (c_nationkey)""")
def er_08_backfill(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_nationkey", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("slot"), F.lit("Bachelor").alias("degree_level"), F.lit("").alias("course_name"))
    results = t.customer.select("c_custkey", "c_nationkey", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("slot"), F.lit("Bachelor").alias("degree_level"), F.lit("").alias("course_name"), F.lit("regex:x").alias("method"), F.when(F.col("c_acctbal") > 0, 0.9).otherwise(0.5).alias("confidence"))
    return er.sibling_backfill(rows, results, "c_nationkey", "slot", "method", "confidence", "c_custkey").select("c_custkey", "slot", "filled_by")


_WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '' AND NOT list_contains(['a','an','and','at','by','for','from','in','of','on','or','the','to','with'], x)))"


@plan(f"""WITH l AS (SELECT p_partkey AS l, {_WORDS.format("p_name || ' ' || p_type")} AS w FROM part), r AS (SELECT min(p_partkey) AS r, {_WORDS.format("p_type || ' ' || p_name || ' extra'")} AS v FROM part GROUP BY p_name, p_type),
s AS (SELECT l, r, len(list_intersect(w, v)) AS shared, len(w) AS a, len(v) AS b FROM l CROSS JOIN r WHERE len(list_intersect(w, v)) >= 3),
g AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY shared DESC, abs(a - b), r) AS rn FROM s WHERE greatest(shared / a, shared / b) >= 0.5) SELECT l, r, shared FROM g WHERE rn = 1""")
def er_10_token_overlap(t: Tables) -> DataFrame:
    left = t.part.select(F.col("p_partkey").alias("l"), F.concat_ws(" ", "p_name", "p_type").alias("lt"))
    right = t.part.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("r")).select("r", F.concat_ws(" ", "p_type", "p_name", F.lit("extra")).alias("rt"))
    return er.token_overlap_match(left, right, "l", "lt", "r", "rt", shared=3)


@plan("SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name), p_type ORDER BY p_size DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def er_11_name_dedupe(t: Tables) -> DataFrame:
    return r.first_per(t.part, [F.lower("p_name"), "p_type"], [F.desc("p_size"), F.asc("p_partkey")]).select("p_partkey")


@plan("SELECT event_id FROM events e WHERE event_type = 'click' AND ts < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE AND NOT EXISTS (SELECT 1 FROM events j WHERE j.event_type = 'error' AND j.user_id = e.user_id)")
def er_12_13_stale(t: Tables) -> DataFrame:
    newest = t.events.agg(F.max("ts").alias("as_of"))
    pending = t.events.where("event_type = 'click'").crossJoin(F.broadcast(newest))
    jobs = t.events.where("event_type = 'error'").select("user_id", F.lit("running").alias("status")).distinct()
    return er.stale_rows(pending, jobs, "user_id", "ts", F.col("as_of")).select("event_id")


@plan("""WITH a AS (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' ORDER BY o_custkey, o_totalprice DESC)
SELECT o_orderkey, coalesce(nullif(o.o_orderpriority, '5-LOW'), a.o_orderpriority) AS o_orderpriority, o.o_orderpriority = '5-LOW' AND a.o_orderpriority IS NOT NULL AS inherited FROM orders o LEFT JOIN a USING (o_custkey) WHERE o_orderstatus = 'O'""")
def er_14_carry_forward(t: Tables) -> DataFrame:
    rows = t.orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"))
    out = er.carry_forward(rows, t.orders.where("o_orderstatus = 'F'"), ["o_custkey"], ["o_orderpriority"], "o_totalprice")
    return out.select("o_orderkey", "o_orderpriority", (F.size("inherited") > 0).alias("inherited"))


@plan("SELECT c_custkey, coalesce(s.c_mktsegment, nullif(c.c_mktsegment, 'MACHINERY')) AS m FROM customer c LEFT JOIN (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0) s USING (c_custkey)")
def er_15_17_merge(t: Tables) -> DataFrame:
    base = t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("m"))
    return r.fill_blanks(base, t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.col("c_mktsegment").alias("m")), ["c_custkey"], ["m"], force=True)


@plan("""WITH s AS (SELECT lower(c_name) AS c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS c_acctbal, 'new' AS note FROM customer WHERE c_custkey % 3 <> 1), w AS (SELECT lower(c_name) AS c_name, c_acctbal + 1 AS c_acctbal, 'old' AS note FROM customer WHERE c_custkey % 3 <> 2)
SELECT coalesce(s.c_name, w.c_name) AS c_name, coalesce(s.c_acctbal, w.c_acctbal) AS c_acctbal, coalesce(s.note, w.note) AS note FROM s FULL JOIN w ON s.c_name = w.c_name""")
def er_16_promote(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    staged = t.customer.where(k % 3 != 1).select("c_name", F.when(k % 2 == 0, F.col("c_acctbal")).alias("c_acctbal"), F.lit("new").alias("note"))
    live = t.customer.where(k % 3 != 2).select(F.upper("c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("old").alias("note"))
    return er.promote(staged, live, ["c_name"], ["c_acctbal", "note"])


@plan("""SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (CASE WHEN l_discount > 0 THEN 1 ELSE 0 END) + (CASE WHEN l_tax > 0 THEN 1 ELSE 0 END) DESC, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1""")
def er_18_richest(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("a"), F.nullif("l_tax", F.lit(0.0)).alias("b"), F.struct("l_linenumber", "l_partkey").alias("pos"))
    return er.richest(rows, ["l_orderkey"], ["a", "b"], "pos").select("l_orderkey", "l_linenumber")


@plan("""SELECT l_orderkey, l_returnflag, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY (l_discount > 0.08) DESC, CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END, l_linenumber, l_partkey) AS rn FROM lineitem WHERE l_quantity > 10 OR l_discount > 0.08) WHERE rn = 1""")
def er_19_first_writer(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_returnflag", "l_linenumber", F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("value"), (F.col("l_discount") > 0.08).alias("pre_seed"), F.col("l_linestatus").alias("extractor"), F.struct("l_linenumber", "l_partkey").alias("pos"))
    return er.merge_extracted(rows, ["l_orderkey", "l_returnflag"], ["O", "F"]).select("l_orderkey", "l_returnflag", "l_linenumber")


@plan("""SELECT c_custkey, CASE WHEN c_acctbal > 5000 AND c_nationkey > 10 THEN 'On Campus' WHEN c_acctbal <= 5000 AND c_nationkey <= 10 THEN 'Online' WHEN c_acctbal > 5000 THEN 'Online' ELSE 'On Campus' END AS mode FROM customer""")
def er_20_mode(t: Tables) -> DataFrame:
    mode = F.when(F.col("c_acctbal") > 5000, "Online").otherwise("On Campus")
    place = F.when(F.col("c_nationkey") > 10, "City")
    return t.customer.select("c_custkey", er.reconcile_mode(mode, place, F.lit(True), F.lit(0.9), F.lit(False)).alias("mode"))
