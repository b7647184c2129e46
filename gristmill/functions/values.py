"""Numbers, dates, arrays, JSON and defaults as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import col, first_match


def finite(c: Column | str) -> Column:
    """c, or null for NaN and the infinities."""
    return F.when(~F.isnan(col(c)) & (F.abs(col(c)) < float("inf")), col(c))


def is_empty_value(c: Column | str) -> Column:
    """Null, the empty text and zero are all empty."""
    return col(c).isNull() | col(c).cast("string").isin("", "0", "0.0")


def safe_ratio(a: Column, b: Column, digits: int | None = None) -> Column:
    out = a / F.nullif(b, F.lit(0))
    return out if digits is None else F.round(out, digits)


def percentage(a: Column, b: Column, digits: int = 2) -> Column:
    return F.round(100.0 * a / F.nullif(b, F.lit(0)), digits)


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return F.unix_timestamp(col(end)) - F.unix_timestamp(col(start))


def iso_z(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def amount_label(amount: Column | str, unit: Column | str) -> Column:
    """Amount and unit; whole amounts without decimals."""
    a = col(amount)
    return F.concat_ws(" ", F.when(a == F.floor(a), a.cast("long").cast("string")).otherwise(a.cast("string")), col(unit))


def weeks_to(c: Column | str, unit: str) -> Column:
    """Weeks as months (4.345 weeks each) or years (52), to the nearest half, halves to even."""
    return F.bround(col(c) / F.lit({"month": 4.345, "year": 52.0}[unit]) * 2) / 2


def weeks_as_term(c: Column | str) -> Column:
    """struct(amount, term): weeks from 52 on as years to the nearest half, from 12 on as whole months of 4.348 weeks, fewer as they are."""
    w = col(c).cast("double")
    told = lambda amount, term: F.struct(amount.alias("amount"), F.lit(term).alias("term"))
    return F.when(w >= 52, told(weeks_to(w, "year"), "Year")).when(w >= 12, told(F.bround(w / 4.348), "Month")).when(w.isNotNull(), told(w, "Week"))


#: Parts of a year.
TERM_YEARS = {"year": 1.0, "month": 12.0, "semester": 2.0, "trimester": 3.0, "week": 52.0}


def to_years(amount: Column | str, term: Column | str) -> Column:
    """The amount in years by the unit that the term names; a term that is null or names none counts as years."""
    low = F.coalesce(F.lower(col(term)), F.lit(""))
    return first_match(((low.contains(unit), col(amount) / parts) for unit, parts in TERM_YEARS.items() if unit != "year"), col(amount).cast("double"))


def yearly_total(text: Column | str, per_unit: Column | str, low: float = 15_000, high: float = 500_000) -> Column:
    """The largest likely number of units in the text times the price of one, if between the bounds.

    4 to 60 units are likely. 48 to 480 credit points count as units of 8 points, or of as many as the text says a unit has.
    """
    low_text = F.lower(col(text))
    numbers = lambda pattern: F.transform(F.regexp_extract_all(low_text, F.lit(pattern), 1), lambda x: x.cast("int"))
    each = F.filter(numbers(r"\b([0-9]{1,2})\s*(?:credit\s*)?points?\s*(?:each|per\s+(?:unit|subject|course))"), lambda x: x.between(4, 24))
    points = F.filter(numbers(r"\b([0-9]{2,3})\s*(?:credit\s*points?|cps?)\b"), lambda x: x.between(48, 480))
    derived = F.transform(points, lambda x: F.floor(x / F.coalesce(F.get(each, F.lit(0)), F.lit(8))).cast("int"))
    units = F.array_max(F.filter(F.concat(numbers(r"\b([0-9]{1,2})\s*(?:units|subjects)\b"), derived), lambda x: x.between(4, 60)))
    total = units * col(per_unit)
    return F.when(total.between(low, high), total)


def call_cost(tokens_in: Column | str, tokens_out: Column | str, per_million_in: float = 0.075, per_million_out: float = 0.30) -> Column:
    return (col(tokens_in) * per_million_in + col(tokens_out) * per_million_out) / 1e6


def tokens_estimate(text: Column | str) -> Column:
    return F.floor(F.length(col(text)) / 4)


def in_bounds(value: Column | str, key: Column | str, bounds: Mapping[str, tuple[float, float]]) -> Column:
    """Whether a value is between its key's bounds; keys without bounds are."""
    return first_match(((col(key) == k, col(value).between(lo, hi)) for k, (lo, hi) in bounds.items()), True)


def append_distinct(a: Column | str, b: Column | str) -> Column:
    return F.array_distinct(F.concat(F.coalesce(col(a), F.array()), F.coalesce(col(b), F.array())))


def distinct_ignoring_case(c: Column | str) -> Column:
    """The first spelling of each element, in order."""
    return F.aggregate(col(c), F.array().cast("array<string>"), lambda seen, x: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(x)), seen).otherwise(F.array_append(seen, x)))


def without_virtual(c: Column | str, words: Sequence[str] = ("online", "virtual", "distance")) -> Column:
    return F.filter(col(c), lambda x: ~F.lower(x).rlike("|".join(words)))


def all_in(c: Column | str, known: Sequence[str]) -> Column:
    return F.forall(col(c), lambda x: x.isin(list(known)))


def expand_codes(c: Column | str, names: Mapping[str, str]) -> Column:
    """Codes of a list such as "SYD | MEL" by name; unknown ones stay."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.transform(F.split(col(c), r"\s*[|,]\s*"), lambda x: F.coalesce(F.try_element_at(table, x), x))


def nonempty_or_null(c: Column) -> Column:
    """An array aggregate over no rows is null, not an empty array."""
    return F.when(F.size(c) > 0, c)


def json_is_empty(c: Column | str) -> Column:
    """Null, JSON null, or a list without elements."""
    return col(c).isNull() | (F.trim(col(c)) == "null") | (F.coalesce(F.json_array_length(col(c)), F.lit(1)) == 0)


def spread_json(payload: Column | str, existing: Mapping[str, Column]) -> Column:
    """The keys of a JSON object as a map of texts; existing columns win over keys of their name."""
    own = F.create_map(*[x for k, v in existing.items() for x in (F.lit(k), v.cast("string"))])
    read = F.coalesce(F.from_json(col(payload), "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(read, lambda k, _: ~k.isin(list(existing))), own)


def deep_merge(base: Mapping, over: Mapping) -> dict:
    """Settings merged key by key; over wins, and only mappings are merged."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out
