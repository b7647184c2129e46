"""URL functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import col, first_match, to_slug

TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "audience", "studenttype")


def without_fragment(url: Column | str) -> Column:
    """No fragment, no slash at the end but the root's."""
    bare = F.substring_index(col(url), "#", 1)
    return F.when(bare.rlike("^[a-zA-Z]+://[^/]+/$"), bare).otherwise(F.regexp_replace(bare, "/+$", ""))


def url_key(url: Column | str) -> Column:
    """The key that rows of a URL are compared by: lower case, no fragment, no slash at the end."""
    return F.regexp_replace(F.lower(F.substring_index(col(url), "#", 1)), "/+$", "")


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^[a-zA-Z]+://([^/?#:]+)", 1))


def path(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)


def segments(url: Column | str) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def coarse_prefix(url: Column | str, depth: int = 2) -> Column:
    """Scheme, host and the first segments."""
    return F.array_join(F.concat(F.array(F.regexp_extract(col(url), r"^([a-zA-Z]+://[^/?#]+)", 1)), F.slice(segments(url), 1, depth)), "/")


def without_params(url: Column | str, names: Sequence[str] = TRACKING) -> Column:
    """No tracking parameters; the question mark goes with the last one."""
    gone = F.array(*[F.lit(n) for n in names])
    base, query = F.substring_index(col(url), "?", 1), F.when(F.instr(col(url), "?") > 0, F.regexp_replace(col(url), r"^[^?]*\?", ""))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~F.array_contains(gone, F.lower(F.substring_index(p, "=", 1)))), "&")
    return F.when(query.isNull() | (kept == ""), base).otherwise(F.concat(base, F.lit("?"), kept))


def registrable(host_name: Column | str) -> Column:
    """The last two labels of a host; hosts below a public suffix of two labels are not told apart."""
    return F.substring_index(col(host_name), ".", -2)


def same_site(a: Column | str, b: Column | str) -> Column:
    return registrable(host(a)) == registrable(host(b))


def classify(url: Column | str, blocked: Sequence[str] = ("/news", "/events", "/blog", "/contact", "/login"), course: Sequence[str] = ("course", "degree", "program", "study"), degree: Sequence[str] = ("bachelor", "master", "diploma", "certificate", "doctor", "phd", "mba", "associate", "honours", "graduate")) -> Column:
    """blocked, landing, course or other, by rules in this order.

    landing: a catalogue's word first, and no word of a degree in the last of two or three segments (four below study); or that word alone.
    """
    low, parts = F.lower(path(url)), segments(url)
    any_of = lambda words: "|".join(words)
    first, last = F.lower(F.try_element_at(parts, F.lit(1))), F.regexp_replace(F.lower(F.try_element_at(parts, F.lit(-1))), "[-_]", " ")
    deep = F.size(parts).between(2, 3) | (F.size(parts) == 4) & (first == "study")
    is_landing = first.rlike(f"^({any_of(course)})s?$") & ((F.size(parts) == 1) | deep & ~last.rlike(rf"\b({any_of(degree)})"))
    return first_match(
        [
            (low.rlike(f"({any_of(blocked)})(/|$)"), "blocked"),
            (is_landing, "landing"),
            (low.rlike(any_of(course)), "course"),
        ],
        "other",
    )


def blocked_page(url: Column | str, title: Column | str, parts: Sequence[str] = (), last: Sequence[str] = (), titles: Sequence[str] = ()) -> Column:
    """Whether a part of the path, its last segment or the title is on a list."""
    low = F.lower(path(url))
    out = F.lit(False)
    for p in parts:
        out = out | low.contains(p)
    return out | F.coalesce(F.lower(F.try_element_at(segments(url), F.lit(-1))).isin(list(last)), F.lit(False)) | F.coalesce(F.lower(F.trim(col(title))).isin(list(titles)), F.lit(False))


def host_slug(url: Column | str) -> Column:
    return to_slug(F.regexp_replace(host(url), r"^www\.", ""))


def year_key(url: Column | str) -> Column:
    """The URL without a year in its path: variants of a page share it."""
    return F.regexp_replace(url_key(url), "[-/_]20[0-9]{2}", "")


HANDBOOK = r"(?i)/handbook/handbook-(20[0-9]{2})/"


def latest_variants(df: DataFrame, url: str = "url", tie: str | None = None) -> DataFrame:
    """One row for each page. A live page beats a handbook's copy of it, and a newer copy an older one; a copy without a live page gets the live page's URL. Then the highest year in the path wins, then tie or the URL."""
    name = f"`{url}`"
    copied = F.regexp_extract(F.col(name), HANDBOOK, 1)
    rows = df.withColumn("__live", F.regexp_replace(F.col(name), HANDBOOK, "/"))
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__live").orderBy(F.coalesce(copied.try_cast("int"), F.lit(9999)).desc(), F.col(tie or name)))).where("__rank = 1").withColumn(url, F.col("__live"))
    year = F.coalesce(F.regexp_extract(F.col(name), "20[0-9]{2}", 0).try_cast("int"), F.lit(0))
    order = Window.partitionBy(year_key(F.col(name))).orderBy(year.desc(), F.col(tie or name))
    return rows.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank", "__live")
