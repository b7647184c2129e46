"""Entity resolution: duplicates, gap filling, evidence and conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.domain import degree_bucket
from gristmill.functions.text import col, first_match, natural_key, tokens
from gristmill.functions.values import is_empty_value
from gristmill.operators.rows import first_per, modal, ranked

#: How much a method counts, tried exactly and then as a prefix in this order.
AUTHORITY = {
    "central_page": 1.0, "central_page:english": 1.0, "central_page:fees:exact": 1.0, "central_page:fees:high": 1.0, "central_page:fees:medium": 1.0, "sibling_cache": 1.0,
    "uni_pdf:fee": 2.0, "uni_pdf:fees": 2.0, "uni_pdf:fees:per_course": 2.0, "uni_pdf:requirements": 2.0, "uni_pdf:english": 2.0, "uni_pdf:cricos_match:fees": 2.5, "uni_pdf:cricos_match:requirements": 2.5,
    "gemini_primary": 3.0, "rule:fee": 3.0, "rule:english": 3.0, "rule:duration": 3.0, "rule:intake": 3.0, "rule:study_mode": 3.0, "rule:cricos": 3.0, "per_course_browser": 3.0, "ai_fallback": 3.0, "regex": 3.0,
    "vit_static_fallback": 3.0, "per_course_vision": 4.0, "per_course_vision_cached": 4.0, "pre_seed": 5.0, "csu_static_extract": 5.0, "bond_pre_seed": 5.0, "ecu_pre_seed": 5.0,
}
#: Methods that may not and may vote on a sibling's value, by their beginnings.
NO_SEEDS = ("vision_ocr", "sibling_cache", "ai_fallback", "approved_row:inherited")
SEEDS = (
    "regex", "css_selector", "gemini_primary", "bond_static", "csu_static", "ecu_static", "vit_static_fallback", "per_course_browser", "per_course_modal", "central_page:english_level",
    "uni_pdf:requirements", "program_level_table", "equivalence_table", "study_mode", "category",
)


def authority(method: Column | str) -> Column:
    """How much a method counts: by its name, else by the first known name that it extends, else 3."""
    m = col(method)
    exact = [(m == k, v) for k, v in AUTHORITY.items()]
    prefix = [(m.startswith(k + ":") | m.startswith(k + "_"), v) for k, v in AUTHORITY.items()]
    return first_match(exact + prefix, 3.0)


def can_override(old: Column | str, new: Column | str) -> Column:
    return authority(new) > authority(old)


def can_seed(method: Column | str, confidence: Column | str, least: float = 0.7) -> Column:
    m = F.coalesce(col(method), F.lit(""))
    starts = lambda names: F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.startswith(m, n))
    return ~starts(NO_SEEDS) & starts(SEEDS) & F.coalesce(col(confidence) >= least, F.lit(False))


def duplicate_map(df: DataFrame, group: Sequence[str], name: str, id_col: str) -> DataFrame:
    """Rows (dup_id, keep_id): rows of a group whose names are equal but for case, by the smallest id."""
    keep = F.min(id_col).over(Window.partitionBy(*group, F.lower(name)))
    return df.where(F.col(name).isNotNull()).select(F.col(id_col).alias("dup_id"), keep.alias("keep_id")).where("dup_id <> keep_id")


def gap_fill(df: DataFrame, mapping: DataFrame, id_col: str, fields: Sequence[str], updated: str) -> DataFrame:
    """df without duplicates; the rows kept have null fields from their newest duplicate alone and the latest of both times."""
    dups = df.join(mapping, df[id_col] == mapping["dup_id"]).select("keep_id", F.col(id_col).alias("__id"), *[F.col(c).alias(f"__{c}") for c in (*fields, updated)])
    newest = first_per(dups, ["keep_id"], [F.col(f"__{updated}").desc_nulls_last(), F.desc("__id")]).drop("__id")
    kept = df.join(mapping.select(F.col("dup_id").alias(id_col)), id_col, "left_anti").join(newest, F.col(id_col) == F.col("keep_id"), "left")
    values = {f: F.coalesce(F.col(f), F.col(f"__{f}")) for f in fields} | {updated: F.greatest(updated, f"__{updated}")}
    return kept.select(*[values[c].alias(c) if c in values else F.col(c) for c in df.columns])


def repoint(children: DataFrame, mapping: DataFrame, key: str, single: bool = False) -> DataFrame:
    """children with keys of duplicates changed to the kept ones; with single, a kept row's own child comes before."""
    joined = children.join(mapping, children[key] == mapping["dup_id"], "left")
    moved = joined.select(*[F.coalesce("keep_id", key).alias(c) if c == key else F.col(c) for c in children.columns], F.col("dup_id").isNotNull().alias("__moved"))
    if single:
        own = moved.where("NOT __moved").select(key).distinct().withColumn("__own", F.lit(True))
        moved = moved.join(own, key, "left").where("NOT __moved OR __own IS NULL").select(*children.columns, "__moved")
    return moved.select(*children.columns)


def evidence_winner(evidence: DataFrame, final: DataFrame | None = None, keys: Sequence[str] = ("course_id", "field_key"), value: str = "value", method: str = "method", confidence: str = "confidence", position: str = "pos") -> DataFrame:
    """Each field's evidence of the most authority, then confidence, then the first; with final (keys, final_value) only such as agree with it, as numbers where both are."""
    rows = evidence
    if final is not None:
        a, b = F.col(value), F.col("final_value")
        numbers = a.try_cast("double") == b.try_cast("double")
        rows = rows.join(final, list(keys)).where(F.coalesce(numbers, F.lower(F.trim(a)) == F.lower(F.trim(b)))).drop("final_value")
    return first_per(rows, keys, [authority(method).desc(), F.col(confidence).desc_nulls_last(), F.asc(position)])


def conflict_pairs(evidence: DataFrame, keys: Sequence[str], tier: str, value: str, id_col: str, confidence: str, position: str) -> DataFrame:
    """Rows (keys, tier, value_a, value_b, id_a, id_b): each pair of different values of a field and tier, once over all tiers.

    Of rows with equal values the one of the highest confidence, then the first, stands for them, so a group's rows never meet
    as pairs: only its distinct values do.
    """
    rows = evidence.where(F.col(value).isNotNull()).withColumn("__v", natural_key(value))
    order = [F.col(confidence).desc_nulls_last(), F.asc(position), F.asc(id_col)]
    reps = ranked(first_per(rows, [*keys, tier, "__v"], order), [*keys, tier], order, "__at").select(*keys, tier, "__v", "__at", F.col(id_col).alias("__id"))
    a, b = reps.select(*keys, tier, *[F.col(c).alias(c + "a") for c in ("__v", "__at", "__id")]), reps.select(*keys, tier, *[F.col(c).alias(c + "b") for c in ("__v", "__at", "__id")])
    pairs = a.join(b, [*keys, tier]).where("__ata < __atb")
    pairs = pairs.select(*keys, tier, F.least("__va", "__vb").alias("value_a"), F.greatest("__va", "__vb").alias("value_b"), F.col("__ida").alias("id_a"), F.col("__idb").alias("id_b"))
    return first_per(pairs, [*keys, "value_a", "value_b"], [F.asc(tier), F.asc("id_a"), F.asc("id_b")])


def sibling_backfill(courses: DataFrame, results: DataFrame, run: str, slot: str, method: str, confidence: str, position: str, accepted: str | None = None, quorum: int = 2, level: str = "degree_level", name: str = "course_name") -> DataFrame:
    """courses with empty slots filled by the most frequent value among its run's and degree bucket's trusted results; with filled_by and filled_confidence.

    results has the columns of courses that are used and method and confidence; a course with accepted = false is left alone.
    """
    bucket = degree_bucket(level, name)
    seeds = results.where(can_seed(method, confidence) & ~is_empty_value(slot)).withColumn("__bucket", bucket)
    votes = modal(seeds, [run, "__bucket"], slot, position, quorum).select(run, "__bucket", F.col(slot).alias("__modal"))
    joined = courses.withColumn("__bucket", bucket).join(votes, [run, "__bucket"], "left")
    allowed = F.lit(True) if accepted is None else F.coalesce(F.col(accepted), F.lit(True))
    fill = is_empty_value(slot) & F.col("__modal").isNotNull() & allowed
    return joined.select(
        *[F.when(fill, F.col("__modal")).otherwise(F.col(slot)).alias(slot) if c == slot else F.col(c) for c in courses.columns],
        F.when(fill, F.concat(F.lit("sibling_cache:"), F.col("__bucket"))).alias("filled_by"), F.when(fill, F.lit(0.55)).alias("filled_confidence"),
    )


def carry_forward(rows: DataFrame, approved: DataFrame, keys: Sequence[str], fields: Sequence[str], updated: str) -> DataFrame:
    """rows with null fields from the newest approved row of the same key; with inherited, the names of those fields."""
    newest = first_per(approved, keys, [F.col(updated).desc_nulls_last()]).select(*keys, *[F.col(f).alias(f"__{f}") for f in fields])
    inherited = F.filter(F.array(*[F.when(F.col(f).isNull() & F.col(f"__{f}").isNotNull(), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    joined = rows.join(newest, list(keys), "left").withColumn("inherited", inherited)
    return joined.select(*[F.coalesce(c, f"__{c}").alias(c) if c in fields else F.col(c) for c in rows.columns], "inherited")


def stale_rows(pending: DataFrame, jobs: DataFrame, job: str, created: str, as_of: Column, minutes: int = 10) -> DataFrame:
    """Pending rows older than so many minutes whose job is not running."""
    running = jobs.where(F.col("status") == "running").select(job)
    return pending.where(F.col(created) < as_of - F.expr(f"interval {minutes} minutes")).join(running, job, "left_anti")


def promote(staged: DataFrame, live: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """live with staged rows put in by case-insensitive name key: known values are copied, others stay; new names are added. Returns (keys, fields)."""
    lowered = lambda df: df.select(*[natural_key(k).alias(k) if t == "string" else F.col(k) for k, t in ((k, dict(df.dtypes)[k]) for k in keys)], *fields)
    s, w = lowered(staged).select(*keys, F.struct(*fields).alias("s")), lowered(live).select(*keys, F.struct(*fields).alias("w"))
    return s.join(w, list(keys), "full_outer").select(*keys, *[F.coalesce(F.col(f"s.{f}"), F.col(f"w.{f}")).alias(f) for f in fields])


def richest(df: DataFrame, keys: Sequence[str], fields: Sequence[str], position: str) -> DataFrame:
    """Of each key the row with the most known fields, the first of equals."""
    known = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in fields), F.lit(0))
    return first_per(df, keys, [known.desc(), F.asc(position)])


def merge_extracted(results: DataFrame, keys: Sequence[str], registry: Sequence[str], extractor: str = "extractor", seeded: str = "pre_seed", position: str = "pos") -> DataFrame:
    """Each field's first writer: pre-seeds, then by the extractors' order in the registry; a pre-seed's null blocks later ones."""
    place = first_match(((F.col(extractor) == e, i) for i, e in enumerate(registry)), len(registry))
    rows = results.where(F.col("value").isNotNull() | F.col(seeded))
    return first_per(rows, keys, [F.col(seeded).desc(), place.asc(), F.asc(position)])


def reconcile_mode(mode: Column | str, location: Column | str, by_rule: Column | str, confidence: Column | str, place_seen: Column | str, low: float = 0.6) -> Column:
    """A weakly found Online with a place is On Campus; an On Campus by rule alone without any place is Online."""
    m, here = col(mode), F.coalesce(F.trim(col(location)), F.lit("")) != ""
    return F.when((m == "Online") & here & (col(by_rule) | (col(confidence) < low)), F.lit("On Campus")).when((m == "On Campus") & col(by_rule) & ~here & ~col(place_seen), F.lit("Online")).otherwise(m)


def token_overlap_match(left: DataFrame, right: DataFrame, left_id: str, left_text: str, right_id: str, right_text: str, shared: int = 2, coverage: float = 0.5, most: int = 25) -> DataFrame:
    """Rows (left_id, right_id, shared): of the right rows with at least so many words in common and so much of either covered, the one with the most, then of the nearest size.

    The smaller of two sets has coverage of its words in common at least, and one of those is among its rarest. So rows meet
    under the rare words of the smaller one, never under all, and each pair that meets is counted by its sets. Right rows of more
    than most words are passed over.
    """
    a = left.select(F.col(left_id).alias("id"), F.array_distinct(tokens(left_text)).alias("t"), F.lit(True).alias("is_left"))
    b = right.select(F.col(right_id).alias("id"), F.array_distinct(tokens(right_text)).alias("t"), F.lit(False).alias("is_left")).where(F.size("t") <= most)
    words = a.unionByName(b).select("id", "is_left", F.explode("t").alias("w"))
    often = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    rows = words.join(often, "w").groupBy("id", "is_left").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("s")).select("id", "is_left", F.col("s.w").alias("t")).where(F.size("t") >= shared)
    n = F.size("t")
    least = F.greatest(F.lit(shared), F.ceil(n * F.lit(coverage)).cast("int"))
    rare, wide = F.explode(F.slice("t", F.lit(1), n - least + 1)), F.explode(F.slice("t", F.lit(1), n - shared + 1))
    ls, rs = (rows.where("is_left").select(F.col("id").alias("l"), F.col("t").alias("lt")), rows.where("NOT is_left").select(F.col("id").alias("r"), F.col("t").alias("rt")))
    of = lambda side, words: rows.where("is_left" if side == "l" else "NOT is_left").select(F.col("id").alias(side), n.alias(f"{side}n"), words.alias("w"))
    met = of("l", rare).join(of("r", wide), "w").where("ln <= rn").unionByName(of("l", wide).join(of("r", rare), "w").where("ln > rn"))
    counted = met.select("l", "r").distinct().join(ls, "l").join(rs, "r").select("l", "r", F.size("lt").alias("ln"), F.size("rt").alias("rn"), F.size(F.array_intersect("lt", "rt")).cast("long").alias("shared"))
    good = counted.where((F.col("shared") >= shared) & (F.greatest(F.col("shared") / F.col("ln"), F.col("shared") / F.col("rn")) >= coverage))
    best = first_per(good, ["l"], [F.desc("shared"), F.abs(F.col("ln") - F.col("rn")).asc(), F.asc("r")])
    return best.select(F.col("l").alias(left_id), F.col("r").alias(right_id), "shared")
