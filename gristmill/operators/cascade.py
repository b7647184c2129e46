"""Matching rows in passes: by code, then by shared words within the same award; what one pass decides leaves the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import col, first_match
from gristmill.operators.rows import first_per

#: Words that tell no program from another.
STOP_WORDS = (
    "of", "the", "and", "in", "for", "to", "a", "an", "with", "bachelor", "master", "graduate", "postgraduate", "undergraduate",
    "certificate", "diploma", "associate", "doctor", "doctorate", "honours", "honors", "degree",
)
#: Beginnings of names and their awards; the first one counts.
AWARDS = (
    ("graduate certificate", "graduate-certificate"), ("graduate diploma", "graduate-diploma"), ("postgraduate certificate", "graduate-certificate"), ("postgraduate diploma", "graduate-diploma"),
    ("advanced diploma", "advanced-diploma"), ("associate degree", "associate"), ("associate diploma", "associate"), ("associate", "associate"), ("master", "master"), ("bachelor", "bachelor"),
    ("honours", "bachelor"), ("honors", "bachelor"), ("doctorate", "doctor"), ("doctor", "doctor"), ("diploma", "diploma"), ("certificate", "certificate"),
)


def name_words(c: Column | str, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """The distinct telling words of a name in order; anything but a-z and 0-9 parts them. Null has none."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[^a-z0-9\s]+", " "), r"\s+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*stop_words))))


def award(c: Column | str) -> Column:
    """The award that a name begins with, else null."""
    low = F.lower(F.trim(col(c)))
    return first_match(((low.startswith(begin), a) for begin, a in AWARDS), F.lit(None).cast("string"))


def overlapping_sets(left: DataFrame, right: DataFrame, keys: Sequence[str], shared: int, coverage: float) -> DataFrame:
    """Rows (*keys, a, b, shared) of distinct (*keys, s), s being words between spaces: pairs with at least so many words in common, and so much of the smaller set covered.

    A pair with o words in common has one among the smaller set's n - o + 1 rarest and among the larger one's. The smaller set's o is bounded by its own size, so
    it meets under few, rare words, and the larger one under all but shared - 1. Pairs of a group's hot words are split by adaptive skew joins.
    """
    k = list(keys)
    sides = left.select(*k, "s", F.lit(True).alias("is_left")).unionByName(right.select(*k, "s", F.lit(False).alias("is_left")))
    words = sides.withColumn("w", F.explode(F.split("s", " "))).where("w <> ''")
    often = words.groupBy(*k, "w").agg(F.count(F.lit(1)).alias("df"))
    sets = words.join(often, [*k, "w"]).groupBy(*k, "s", "is_left").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("t")).select(*k, "s", "is_left", F.col("t.w").alias("t"))
    n = F.size("t")
    sets = sets.where(n >= shared)
    least = F.greatest(F.lit(shared), F.ceil(n * F.lit(coverage)).cast("int"))

    def of(is_left: bool, length: Column) -> DataFrame:
        name = "a" if is_left else "b"
        return sets.where(F.col("is_left") == is_left).select(*k, F.col("s").alias(name), n.alias(f"{name}n"), F.explode(F.slice("t", F.lit(1), length)).alias("w"))

    rare, wide = n - least + 1, n - shared + 1
    small_left = of(True, rare).join(of(False, wide), [*k, "w"]).where("an <= bn")
    small_right = of(True, wide).join(of(False, rare), [*k, "w"]).where("an > bn")
    met = small_left.unionByName(small_right).select(*k, "a", "b").distinct()
    a, b = F.split("a", " "), F.split("b", " ")
    counted = met.withColumn("shared", F.size(F.array_intersect(a, b)))
    return counted.where((F.col("shared") >= shared) & (F.col("shared") >= coverage * F.least(F.size(a), F.size(b))))


def match_in_passes(
    left: DataFrame, right: DataFrame, left_id: str, left_name: str, right_id: str, right_name: str, within: Sequence[str] = (), left_code: str | None = None,
    right_code: str | None = None, right_more: str | None = None, shared: int = 2, coverage: float = 0.5, most_more: int = 25,
) -> DataFrame:
    """Rows (*within, left_id, right_id, method, score), one for each left row; right_id is null and method "no_match" where no pass decides.

    First by equal code ("cricos_match", score null). What is left, by words ("name_match"): the right row's name and its further words, unless these are more than
    most_more; awards that both names tell must agree; at least so many words shared, or the left name's words being those of the right name alone; and coverage of one
    side at least. The largest coverage wins, then the nearest number of words in the names, then the smallest right id.
    A left name without telling words matches nothing, by code neither. Equal names are compared once, however many rows have them.
    """
    own = [f"_key{i}" for i in range(len(within))]
    given = [F.col(k).alias(o) for k, o in zip(within, own, strict=True)]
    optional = lambda c: F.lit(None).cast("string") if c is None else F.col(c).cast("string")
    joined = lambda words: F.array_join(words, " ")
    a = left.select(*given, F.col(left_id).alias("l"), joined(name_words(left_name)).alias("words"), award(left_name).alias("award"), optional(left_code).alias("code"))
    more = F.array() if right_more is None else name_words(right_more)
    more = F.when(F.size(more) <= most_more, more).otherwise(F.array().cast("array<string>"))
    names = right.select(*given, F.col(right_id).alias("r"), name_words(right_name).alias("p"), more.alias("m"), award(right_name).alias("award"), optional(right_code).alias("code"))
    b = names.select(*own, "r", joined("p").alias("main"), joined(F.array_sort(F.array_union("p", "m"))).alias("words"), "award", "code")

    by_code = b.where("code <> ''").groupBy(*own, "code").agg(F.min("r").alias("coded"))
    coded = a.join(by_code, [*own, "code"], "left").withColumn("coded", F.when(F.col("words") != "", F.col("coded")))
    open_sets = coded.where("coded IS NULL AND words <> ''").select(*own, "words", "award").distinct()
    rows = b.where("words <> ''").groupBy(*own, "main", "words", "award").agg(F.min("r").alias("r"))

    sets = lambda df: df.select(*own, F.col("words").alias("s")).distinct()
    met = overlapping_sets(sets(open_sets), sets(rows), own, shared, coverage).select(*own, F.col("a").alias("words"), F.col("b").alias("theirs"))
    x, y = open_sets.withColumnRenamed("award", "mine"), rows.withColumnRenamed("words", "theirs")
    alike = x.join(met, [*own, "words"]).join(y, [*own, "theirs"])
    equal = x.join(y.where("main <> ''"), [*[x[k] == y[k] for k in own], x["words"] == y["main"]]).select(*[x[k] for k in own], "theirs", "words", "mine", "main", "award", "r")
    n = lambda c: F.size(F.split(c, " "))
    common = F.size(F.array_intersect(F.split("words", " "), F.split("theirs", " ")))
    both = alike.select(*own, "words", "theirs", "mine", "main", "award", "r").unionByName(equal).where("mine IS NULL OR award IS NULL OR mine = award")
    scored = both.withColumn("score", F.greatest(common / n("words"), common / n("theirs"))).where(F.col("score") >= coverage)
    nearer = F.abs(F.when(F.col("main") == "", 0).otherwise(n("main")) - n("words"))
    best = first_per(scored, [*own, "words", F.coalesce("mine", F.lit(""))], [F.desc("score"), nearer.asc(), F.asc("r")])
    named = best.select(*[F.col(k).alias(f"{k}_") for k in own], F.col("words").alias("w_"), F.col("mine").alias("mine"), F.col("r").alias("named"), "score")
    on = [F.col(k) == F.col(f"{k}_") for k in own] + [F.col("words") == F.col("w_"), F.col("award").eqNullSafe(F.col("mine")), F.col("coded").isNull()]
    found = coded.join(named, on, "left")
    method = F.when(F.col("coded").isNotNull(), "cricos_match").when(F.col("named").isNotNull(), "name_match").otherwise("no_match")
    back = [F.col(o).alias(k) for k, o in zip(within, own, strict=True)]
    return found.select(*back, F.col("l").alias(left_id), F.coalesce("coded", "named").alias(right_id), method.alias("method"), "score")
