"""String functions as column expressions; none leaves generated code for Python."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names in calendar order.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
STOP_WORDS = ("a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_match(rules: Iterable[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first rule (condition, value) that holds; a condition that is null does not hold."""
    out: Column | None = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    last = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return last if out is None else out.otherwise(last)


def contains_any(c: Column | str, needles: Sequence[str]) -> Column:
    """Whether lower-cased c holds one of the needles; false for null."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    out = F.lit(False)
    for x in needles:
        out = out | low.contains(x.lower())
    return out


def is_blank(c: Column | str) -> Column:
    return col(c).isNull() | (F.trim(col(c)) == "")


def collapse_spaces(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def normalize(c: Column | str) -> Column:
    """Lower case, anything but letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def natural_key(c: Column | str) -> Column:
    return F.lower(F.trim(col(c)))


def header_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


def parse_number(c: Column | str, keep_sign: bool = True) -> Column:
    """The number among other signs, null where none is left."""
    return F.regexp_replace(col(c), "[^0-9.-]" if keep_sign else "[^0-9.]", "").try_cast("double")


def parse_whole(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[^0-9]", "").try_cast("long")


def month_name(c: Column | str) -> Column:
    """The month that begins with the first three letters of c, else null."""
    short = F.substring(F.lower(F.trim(col(c))), 1, 3)
    return first_match((short == m[:3].lower(), m) for m in MONTHS)


def month_list(c: Column | str, longest: int = 32) -> Column:
    """Months of a list in one text, by their whole or three-letter names; what is no month is kept, cut to longest characters; repeats go, the order stays."""
    parts = F.filter(F.transform(F.split(col(c), r"[,;/|]+"), lambda x: F.trim(x)), lambda x: x != "")
    letters = lambda x: F.regexp_replace(F.lower(x), "[^a-z]", "")
    whole = lambda x: first_match((letters(x).isin(m.lower(), m[:3].lower(), *(("sept",) if m == "September" else ())), m) for m in MONTHS)
    read = F.transform(F.filter(parts, lambda x: letters(x) != ""), lambda x: F.coalesce(whole(x), F.substring(x, 1, longest)))
    return F.array_distinct(read)


def calendar_order(months: Column | str) -> Column:
    """An array of month names in calendar order; others come last, by name."""
    known = F.array(*[F.lit(m) for m in MONTHS])
    place = lambda m: F.when(F.array_position(known, m) == 0, F.lit(99)).otherwise(F.array_position(known, m))
    return F.transform(F.array_sort(F.transform(col(months), lambda m: F.struct(place(m).alias("p"), m.alias("m")))), lambda s: s["m"])


def tokens(c: Column | str, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct normalised words that are no stop words, in order of their first place."""
    stops = F.array(*[F.lit(w) for w in stop_words])
    return F.array_distinct(F.filter(F.split(normalize(c), " "), lambda x: (x != "") & ~F.array_contains(stops, x)))


def stems(c: Column | str) -> Column:
    """Tokens without common English endings: an approximation of a dictionary's stems for text match."""
    return F.array_distinct(F.transform(tokens(c), lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, "(ings|ing|ies|ed|es|s)$", "")).otherwise(w)))


def text_match(text: Column | str, query: str) -> Column:
    """All stems of the query occur in the text; false for a query without any."""
    wanted = stems(F.lit(query))
    return (F.size(wanted) > 0) & F.forall(wanted, lambda w: F.array_contains(stems(text), w))


def text_rank(text: Column | str, query: str) -> Column:
    """How many words of the text have a stem of the query, by the text's number of words."""
    words = F.filter(F.split(normalize(text), " "), lambda w: w != "")
    stemmed = F.transform(words, lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, "(ings|ing|ies|ed|es|s)$", "")).otherwise(w))
    return F.size(F.filter(stemmed, lambda w: F.array_contains(stems(F.lit(query)), w))) / F.greatest(F.size(words), F.lit(1))


def smart_title(c: Column | str, acronyms: Sequence[str] = ("it", "mba", "phd", "uk", "usa", "ict", "ai"), small: Sequence[str] = STOP_WORDS) -> Column:
    """Words capitalised; acronyms in capitals, small words in lower case unless first."""
    up, low = F.array(*[F.lit(x) for x in acronyms]), F.array(*[F.lit(x) for x in small])
    words = F.split(collapse_spaces(F.lower(col(c))), " ")
    titled = F.transform(words, lambda w, i: F.when(F.array_contains(up, w), F.upper(w)).when((i > 0) & F.array_contains(low, w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))))
    return F.array_join(titled, " ")


def is_slug(c: Column | str) -> Column:
    return col(c).rlike("^[a-z0-9]+(-[a-z0-9]+){2,}$")


def unslug(c: Column | str) -> Column:
    return F.initcap(F.replace(col(c), F.lit("-"), F.lit(" ")))


def to_slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "(^-)|(-$)", "")


def clean_name(c: Column | str) -> Column:
    """A name without a leading code such as "AB123 - " and what follows a bar; null unless it has 3 to 200 characters."""
    bare = F.regexp_replace(collapse_spaces(c), r"^[A-Z]{2,4}[0-9]{2,5}\s*[-:]\s*", "")
    bare = F.trim(F.regexp_replace(bare, r"\s*\|.*$", ""))
    return F.when(F.length(bare).between(3, 200), bare)


def value_in_text(value: Column | str, text: Column | str) -> Column:
    """Whether a value occurs in the text; numbers with thousands signs count, whole numbers without decimals."""
    v, t = col(value), F.lower(col(text))
    plain = F.regexp_replace(t, "(?<=[0-9]),(?=[0-9]{3})", "")
    number = F.regexp_replace(v.cast("string"), r"\.0+$", "")
    return t.contains(F.lower(v.cast("string"))) | plain.contains(F.lower(number))


def mapped(c: Column, table: Mapping[str, str], otherwise: Column | None = None) -> Column:
    """c looked up in a small fixed table."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.element_at(pairs, c)
    return found if otherwise is None else F.coalesce(found, otherwise)


#: Substrings of log messages and their levels, the first one counts.
LOG_LEVELS = (
    ("[error]", "error"), ("[stage] error", "error"), ("[stage] exception", "error"), ("[stage] failed", "error"), ("[stage] skipped", "warn"), ("[stage] dedup", "warn"),
    ("[stage] saved", "success"), ("[stage] staged", "success"), ("[sample✓]", "success"), ("[sample]", "info"), ("[discover]", "discover"), ("[classify]", "discover"),
    ("[extract]", "extract"), ("[fallback]", "fallback"), ("[stage]", "stage"),
)
#: Buckets of skip reasons and what tells them, the first one counts.
SKIP_BUCKETS = (
    ("domestic_only", ("domestic",)), ("online_only", ("online",)), ("no_international_fee", ("international_fee", "intl_fee", "no_international")),
    ("category_landing_page", ("category_landing", "landing_page")), ("generic_category_page", ("generic_category", "category_page")), ("fetch_failed", ("fetch", "timeout", "http")),
)


def log_level(message: Column | str, rules: Sequence[tuple[str, str]] = LOG_LEVELS) -> Column:
    return first_match(((contains_any(message, [needle]), level) for needle, level in rules), "info")


def skip_bucket(reason: Column | str, rules: Sequence[tuple[str, Sequence[str]]] = SKIP_BUCKETS) -> Column:
    return first_match(((contains_any(reason, needles), bucket) for bucket, needles in rules), "other")
