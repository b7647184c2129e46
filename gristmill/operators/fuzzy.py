"""Fuzzy matching of names: ratios of likeness, and joins that lose no pair above a ratio.

The ratio of two texts is 100 less the share of insertions and deletions that turn one into the other. A pair of at least a given
ratio keeps so many pairs of neighbouring letters in order that a rare one of each side's is among them, at nearly the same place.
So the index holds each name's rare letter pairs with their places, and names meet there, never all with all.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from gristmill.functions.text import col, collapse_spaces
from gristmill.operators.rows import first_per

#: Names of at most so many letters are indexed by letters too: two of them may be alike and share no pair of letters.
SHORT = 6


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence; a bit of one whole number stands for a letter of a."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    free = every
    for c in b:
        met = free & places.get(c, 0)
        free = (free + met | free - met) & every
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> float:
    """Likeness of two texts, 0 to 100: twice their longest common subsequence by both lengths; two empty ones are alike."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The largest ratio of the shorter text to a window of its length that slides over the longer one, past both ends too; of equally long texts each slides over the other."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    n, m, best = len(a), len(b), 0.0
    for start in range(1 - n, m):
        part = b[max(start, 0) : start + n]
        # No more than the shorter text's letters can be in common.
        if 200.0 * len(part) / (n + len(part)) > best:
            best = max(best, ratio(a, part))
    return max(best, *(ratio(b, a[max(s, 0) : s + n]) for s in range(1 - n, n))) if n == m and best < 100.0 else best


def _sorted_words(text: str) -> str:
    return " ".join(sorted(text.split()))


def _token_ratios(a: str, b: str) -> tuple[float, float]:
    """The likeness by words: of whole texts (sorted, or as sets with the common words ahead), and of a part."""
    x, y = set(a.split()), set(b.split())
    ordered = _sorted_words(a), _sorted_words(b)
    only_a, only_b = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    common = " ".join(sorted(x & y))
    whole = ratio(*ordered)
    if x and y:
        if common and not (only_a and only_b):
            whole = 100.0
        else:
            gap = 1 if common else 0
            p, q = len(common) + gap + len(only_a), len(common) + gap + len(only_b)
            apart = len(only_a) + len(only_b) - 2 * common_length(only_a, only_b)
            as_sets = [100.0 - 100.0 * apart / (p + q)]
            if common:
                as_sets += [100.0 - 100.0 * (gap + len(rest)) / (len(common) + size) for rest, size in ((only_a, p), (only_b, q))]
            whole = max(whole, *as_sets)
    part = 100.0 if common else max(partial_ratio(*ordered), partial_ratio(only_a, only_b))
    return whole, part


def weighted_ratio(a: str, b: str) -> float:
    """The best of several ratios, each with its weight: whole texts; by words at 0.95; parts, where one text is half as long again, at 0.9, or 0.6 beyond eight times."""
    if not a or not b:
        return 0.0
    lengths, best = max(len(a), len(b)) / min(len(a), len(b)), ratio(a, b)
    whole, part = _token_ratios(a, b)
    if lengths < 1.5:
        return max(best, 0.95 * whole)
    scale = 0.9 if lengths <= 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * part)


def _of_pairs(measure: object, name: str) -> object:
    @pandas_udf(DoubleType())
    def measured(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([measure(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    measured.__name__ = name
    # Spark moves no filter on it below an aggregate, where it would measure each repeat, and measures nothing twice.
    return measured.asNondeterministic()


_ratio, _weighted = _of_pairs(ratio, "ratio"), _of_pairs(weighted_ratio, "weighted_ratio")


def sorted_words(c: Column | str) -> Column:
    """The words of c in order, between single spaces."""
    return F.array_join(F.array_sort(F.filter(F.split(col(c), r"\s+"), lambda w: w != "")), " ")


def letters_in_common(a: Column, b: Column) -> Column:
    """How many letters two texts have in common, repeats counted: no less than their longest common subsequence."""
    count = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(count(a, c), count(b, c))))


def letter_bits(c: Column) -> Column:
    """64 bits of a text: for each letter and how often it has come before, one bit is turned. Two texts differ in no more bits than letters put in or left out."""
    turned = lambda x, bit: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")))
    times = lambda x: F.sequence(F.lit(1), F.length(c) - F.length(F.replace(c, x, F.lit(""))))
    bits = F.flatten(F.transform(F.filter(F.array_distinct(F.split(c, "")), lambda x: x != ""), lambda x: F.transform(times(x), lambda k: F.xxhash64(x, k))))
    return F.aggregate(bits, F.lit(0).cast("long"), turned)


def token_sort_ratio(a: Column | str, b: Column | str, least: float = 0.0) -> Column:
    """The ratio of two texts with their words sorted; null where letters alone tell that it is below least. Null texts count as empty."""
    x, y = (sorted_words(F.coalesce(col(c), F.lit(""))) for c in (a, b))
    hopeless = 200 * letters_in_common(x, y) < least * (F.length(x) + F.length(y))
    return F.when(~hopeless, _ratio(F.when(~hopeless, x), F.when(~hopeless, y)))


def weighted_likeness(a: Column | str, b: Column | str) -> Column:
    """weighted_ratio of two columns; null or empty texts have 0."""
    return F.when((F.length(col(a)) > 0) & (F.length(col(b)) > 0), _weighted(col(a), col(b))).otherwise(0.0)


def same_name(a: Column | str, b: Column | str, least: float = 92.0) -> Column:
    """Whether two names are equal but for case and outer spaces, or as likely one as least; false for null or empty ones."""
    x, y = col(a), col(b)
    known = (F.length(x) > 0) & (F.length(y) > 0)
    equal = F.lower(F.trim(x)) == F.lower(F.trim(y))
    # Beyond half the length again all weights are below 92, and letters bound the rest.
    longer, shorter = F.greatest(F.length(x), F.length(y)), F.least(F.length(x), F.length(y))
    reach = F.when(longer < 1.5 * shorter, 100.0).when(longer <= 8 * shorter, 90.0).otherwise(60.0)
    ask = known & ~equal & (F.greatest(reach, 200.0 * shorter / (longer + shorter)) >= least)
    return F.coalesce(known & (equal | (F.coalesce(_weighted(F.when(ask, x), F.when(ask, y)), F.lit(0.0)) >= least)), F.lit(False))


def _keys(within: Sequence[str]) -> tuple[list[Column], list[str], list[Column]]:
    """A group's columns under names of our own, these names, and the columns under theirs again: no name of a caller's clashes with ours."""
    own = [f"_key{i}" for i in range(len(within))]
    return [F.col(k).alias(o) for k, o in zip(within, own, strict=True)], own, [F.col(o).alias(k) for k, o in zip(within, own, strict=True)]


def best_match(left: DataFrame, right: DataFrame, left_name: str, right_name: str, within: Sequence[str], position: str, least: float = 85.0) -> DataFrame:
    """Rows (*within, left_name, right_name, score): for each distinct left name the likeliest right name of the same group, of equals the first by position.

    The measure lets a single common word decide, so each name is held against all distinct ones of its group; within must bound groups
    (a provider, a page). Names below least, null or empty ones have no row.
    """
    given, keys, back = _keys(within)
    a = left.select(*given, F.col(left_name).alias("__a")).where("__a <> ''").distinct()
    b = right.select(*given, F.col(right_name).alias("__b"), F.col(position).alias("__at")).where("__b <> ''").groupBy(*keys, "__b").agg(F.min("__at").alias("__at"))
    scored = a.join(b, keys).withColumn("score", weighted_likeness("__a", "__b")).where(F.col("score") >= least)
    best = first_per(scored, [*keys, "__a"], [F.desc("score"), F.asc("__at")])
    return best.select(*back, F.col("__a").alias(left_name), F.col("__b").alias(right_name), "score")


def similar_pairs(left: DataFrame, right: DataFrame, left_text: str, right_text: str, within: Sequence[str] = (), least: float = 80.0) -> DataFrame:
    """Rows (*within, a, b, score): all pairs of distinct texts of the same group whose ratio is at least so high; least is over 67.

    With L the longest common subsequence of a pair of that ratio, 2 L >= least / 100 * (la + lb). Each letter left out breaks two pairs of
    neighbours at most and each put in one, so 3 L - la - lb - 1 pairs of neighbours stay, in order, moved by lb - L to the right or la - L to the
    left at most. Hence one of them is among the rarest pairs of both sides, all but that number less one.
    Null and empty texts meet nothing. A group's hot letter pairs are split by adaptive skew joins; pairs are ruled out by length, place and letters while they are joined, before a row is made of them.
    """
    (given, keys, back), t = _keys(within), least / 100
    if t <= 2 / 3:
        raise ValueError("letter pairs are certain only for ratios over 67")

    def grams(df: DataFrame, text: str) -> DataFrame:
        s, n = F.col("s"), F.length("s")
        places = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.substring(s, i, F.lit(2)).alias("g"), i.alias("p")))
        letters = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(F.lit("\0"), F.substring(s, i, F.lit(1))).alias("g"), i.alias("p")))
        known = df.select(*given, F.col(text).alias("s")).where("s <> ''").distinct().withColumn("bits", letter_bits(s))
        return known.select(*keys, "s", n.alias("n"), "bits", F.explode(F.when(n == 1, letters).when(n <= SHORT, F.concat(places, letters)).otherwise(places)).alias("e")).select(*keys, "s", "n", "bits", "e.g", "e.p")

    a, b = grams(left, left_text), grams(right, right_text)
    often = a.select(*keys, "g").unionByName(b.select(*keys, "g")).groupBy(*keys, "g").agg(F.count(F.lit(1)).alias("df"))

    def rare(df: DataFrame) -> DataFrame:
        # The least number of neighbours kept, over all lengths that the other text may have, is that of the shortest one.
        shortest = F.ceil(F.col("n") * t / (2 - t))
        kept = F.greatest(F.lit(1), F.ceil((F.col("n") + shortest) * (1.5 * t - 1) - 1.000001))
        order = F.row_number().over(Window.partitionBy(*keys, "s").orderBy("df", "g", "p"))
        first = df.join(often, [*keys, "g"]).withColumn("rn", order).where((F.col("n") <= SHORT) | (F.col("rn") <= F.col("n") - 1 - kept + 1))
        return first.select(*keys, "g", "s", "n", "bits", "p")

    x, y = rare(a).alias("x"), rare(b).alias("y")
    la, lb = F.col("x.n"), F.col("y.n")
    common = F.ceil((la + lb) * (t / 2) - 1e-9)
    shift = F.col("y.p") - F.col("x.p")
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in [*keys, "g"]]
    near = [common <= F.least(la, lb), shift <= lb - common, shift >= common - la, F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits"))) <= la + lb - 2 * common]
    met = x.join(y, [*same, *near]).select(*[F.col(f"x.{k}").alias(k) for k in keys], F.col("x.s").alias("a"), F.col("y.s").alias("b")).distinct()
    return met.withColumn("score", _ratio("a", "b")).where(F.col("score") >= least).select(*back, "a", "b", "score")


def match_names(
    left: DataFrame, right: DataFrame, left_id: str, left_name: str, right_id: str, right_name: str, within: Sequence[str] = (), least: float = 80.0, high: float = 85.0,
    left_bucket: str | None = None, right_bucket: str | None = None, unknown: str = "unknown",
) -> DataFrame:
    """Rows (*within, left_id, right_id, quality, score), one for each left row; right_id is null where nothing fits.

    quality is "exact" for names equal but for case and spaces; "high" or "medium" for the right name of the largest token-sort ratio,
    from high or least on; "bucket" (score null) for the first right row of the same bucket; else "none". Of several right rows the smallest id is
    taken. Distinct names are compared, so a name that very many rows have costs no more than another. Names in any script count.
    """
    given, keys, back = _keys(within)
    name = lambda c: F.lower(collapse_spaces(F.coalesce(F.col(c), F.lit(""))))
    a = left.select(*given, F.col(left_id).alias("l"), name(left_name).alias("n"), (F.col(left_bucket) if left_bucket else F.lit(None).cast("string")).alias("bucket"))
    b = right.select(*given, F.col(right_id).alias("r"), name(right_name).alias("n"), (F.col(right_bucket) if right_bucket else F.lit(None).cast("string")).alias("bucket"))
    firsts = b.where("n <> ''").groupBy(*keys, "n").agg(F.min("r").alias("exact"))
    sets = lambda df: df.where("n <> ''").select(*keys, "n", sorted_words("n").alias("s")).distinct()
    of_set = firsts.select(*keys, sorted_words("n").alias("b"), F.col("exact").alias("r")).groupBy(*keys, "b").agg(F.min("r").alias("r"))
    # A name that has an equal one is decided, and meets nobody else.
    open_names = sets(a).join(firsts, [*keys, "n"], "left_anti")
    pairs = similar_pairs(open_names, sets(b), "s", "s", keys, least).join(of_set, [*keys, "b"])
    likeliest = first_per(pairs, [*keys, "a"], [F.desc("score"), F.asc("r")]).select(*keys, F.col("a").alias("s"), F.col("r").alias("fuzzy"), "score")
    fuzzy = open_names.join(likeliest, [*keys, "s"]).select(*keys, "n", "fuzzy", "score")
    of_bucket = b.where(F.col("bucket") != unknown).groupBy(*keys, "bucket").agg(F.min("r").alias("in_bucket"))
    found = a.join(firsts, [*keys, "n"], "left").join(fuzzy, [*keys, "n"], "left")
    found = found.join(of_bucket, [*keys, "bucket"], "left").withColumn("in_bucket", F.when(F.col("n") != "", F.col("in_bucket")))
    quality = (
        F.when(F.col("exact").isNotNull(), "exact").when(F.col("score") >= high, "high").when(F.col("score").isNotNull(), "medium")
        .when(F.col("in_bucket").isNotNull(), "bucket").otherwise("none")
    )
    score = F.when(F.col("exact").isNotNull(), 100.0).otherwise(F.col("score"))
    return found.select(*back, F.col("l").alias(left_id), F.coalesce("exact", "fuzzy", "in_bucket").alias(right_id), quality.alias("quality"), score.alias("score"))
