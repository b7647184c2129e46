"""Rules as tables: phrases meet texts through an index of word runs, hosts through their endings; a plan does not grow with the rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.rows import first_per, spread


def _runs(words: Column, longest: int) -> Column:
    """The distinct runs of one to longest words, joined by spaces."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)))
    at = lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(i + n - 1 <= F.size(words), F.array_join(F.slice(words, i, n), " ")))
    return F.array_distinct(F.filter(F.flatten(F.transform(starts, at)), lambda x: x.isNotNull() & (x != "")))


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != "")


def phrase_hits(texts: DataFrame, rules: DataFrame, text: str, phrase: str, longest: int = 6, on: Sequence[str] = ()) -> DataFrame:
    """Rows of texts joined with the rules whose phrase occurs in the text as whole words, in any case; on names further columns that must be equal.

    A phrase and a text meet under the phrase's words, so the join is one of equal keys whatever the number of rules; then the phrase must stand there letter for
    letter. Phrases of more than longest words meet under their first ones. Blank phrases and texts without words meet nothing. Both tables' column names must differ, but for on.
    """
    # A text's words are found once, not once a run; an outer explode has no filter that would make the runs a second time.
    runs = F.explode_outer(_runs(F.col("__words"), longest)).alias("__run")
    wanted = rules.withColumn("__run", F.array_join(F.slice(_words(F.col(phrase)), 1, longest), " ")).where("__run <> ''")
    met = texts.withColumn("__words", _words(F.col(text))).select("*", runs).drop("__words").join(wanted, ["__run", *on])
    # Word borders as they are for a regular expression: a phrase that ends in a sign needs a word sign after it.
    literal = F.concat(F.lit("(?i)\\b\\Q"), F.trim(F.col(phrase)), F.lit("\\E\\b"))
    return met.where(F.regexp_like(F.col(text), literal)).drop("__run")


def first_category(rows: DataFrame, rules: DataFrame, id_col: str, name: str, longest: int = 6) -> DataFrame:
    """Rows (id_col, category, sub_category) for names in which a rule of rules (category, sub_category, phrase, pos) occurs.

    The first bracket that any rule fits decides, else the whole name; of the rules that fit there the first by pos counts. id_col is unique.
    """
    inside = F.transform(F.regexp_extract_all(F.col(name), F.lit(r"\(([^)]+)\)"), 1), lambda x, i: F.struct(i.alias("part"), x.alias("text")))
    whole = F.array(F.struct(F.lit(1 << 30).alias("part"), F.col(name).alias("text")))
    parts = spread(rows, id_col).select(F.col(id_col).alias("__id"), F.explode(F.concat(inside, whole)).alias("p")).select("__id", F.col("p.part").alias("__part"), F.col("p.text").alias("__text"))
    hits = phrase_hits(parts, rules.select("category", "sub_category", "phrase", "pos"), "__text", "phrase", longest)
    best = first_per(hits, ["__id"], [F.asc("__part"), F.asc("pos")])
    return best.select(F.col("__id").alias(id_col), "category", "sub_category")


def best_category(rows: DataFrame, rules: DataFrame, id_col: str, name: str, longest: int = 6) -> DataFrame:
    """Rows (id_col, category, score) for names in which a rule of rules (category, phrase, pos) occurs: the phrases found count their words; the largest sum wins, then the category that comes first by pos."""
    order = rules.groupBy("category").agg(F.min("pos").alias("__first"))
    texts = spread(rows, id_col).select(F.col(id_col).alias("__id"), F.col(name).alias("__text"))
    hits = phrase_hits(texts, rules.select("category", "phrase").distinct(), "__text", "phrase", longest)
    sums = hits.groupBy("__id", "category").agg(F.sum(F.size(F.split(F.trim("phrase"), r"\s+"))).cast("long").alias("score")).join(order, "category")
    best = first_per(sums, ["__id"], [F.desc("score"), F.asc("__first"), F.asc("category")])
    return best.select(F.col("__id").alias(id_col), "category", "score")


def host_endings(host: Column) -> Column:
    """A host and what is left of it without its first labels."""
    labels = F.split(F.lower(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


def host_phrases(pages: DataFrame, rules: DataFrame, host: str, text: str, longest: int = 6) -> DataFrame:
    """pages joined with the rules (host_ending, phrase, ...) whose host ending is the page's and whose phrase occurs in its text."""
    ended = pages.withColumn("host_ending", F.explode(host_endings(F.col(host))))
    known = ended.join(rules.select("host_ending").distinct(), "host_ending", "left_semi")
    return phrase_hits(known, rules, text, "phrase", longest, ["host_ending"])


def session_months(pages: DataFrame, rules: DataFrame, id_col: str, host: str, text: str) -> DataFrame:
    """Rows (id_col, months) of pages on which their host's names of sessions occur: the months of rules (host_ending, phrase, month, month_number) in calendar order."""
    hits = host_phrases(spread(pages, id_col).select(F.col(id_col).alias("__id"), F.col(host).alias("__host"), F.col(text).alias("__text")), rules, "__host", "__text")
    months = F.array_sort(F.collect_set(F.struct("month_number", "month")))["month"]
    return hits.groupBy("__id").agg(months.alias("months")).select(F.col("__id").alias(id_col), "months")


def blocked(pages: DataFrame, rules: DataFrame, id_col: str, url: str, title: str) -> DataFrame:
    """Rows (id_col, reason) of pages that a rule (kind, value, pos) of rules blocks; of several the first by pos.

    kind: "path", whose value is a run of whole parts of the path; "last", the last part; "query", a query name; "title", the whole title; "title_start", the words that it begins with.
    Each page is looked up under its own values, so the join has equal keys, whatever the number of rules. Case does not count.
    """
    low, said = F.lower(F.coalesce(F.col(url), F.lit(""))), F.lower(F.trim(F.coalesce(F.col(title), F.lit(""))))
    path = F.filter(F.split(F.regexp_extract(low, r"^(?:[a-z]+://)?[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    names = F.transform(F.split(F.regexp_extract(low, r"\?([^#]*)", 1), "&"), lambda x: F.substring_index(x, "=", 1))
    words = F.filter(F.split(said, r"\s+"), lambda w: w != "")
    count = F.size(path)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.greatest(count - i + 1, F.lit(1))), lambda n: F.array_join(F.slice(path, i, n), "/"))))
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda n: F.array_join(F.slice(words, 1, n), " "))
    of = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    keys = F.concat(of("path", spans), of("last", F.array(F.element_at(F.concat(F.array(F.lit("")), path), -1))), of("query", names), of("title", F.array(F.array_join(words, " "))), of("title_start", starts))
    asked = pages.select(F.col(id_col).alias("__id"), F.explode(F.array_distinct(F.filter(keys, lambda k: k["value"] != ""))).alias("k")).select("__id", "k.*")
    wanted = rules.select("kind", F.lower(F.trim(F.regexp_replace("value", "^/+|/+$", ""))).alias("value"), "pos")
    best = first_per(asked.join(wanted, ["kind", "value"]), ["__id"], [F.asc("pos")])
    return best.select(F.col("__id").alias(id_col), F.concat_ws(": ", "kind", "value").alias("reason"))
