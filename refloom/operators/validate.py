"""Deterministic checks of entries: required fields, pages, authors, years, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.text import blank, first_match, strip

#: Fixed: required fields by entry type, in reporting order.
REQUIRED = {
    "book": "authors title publisher year", "article": "authors title journal year pages", "proceedings": "authors title booktitle year pages", "inproceedings": "authors title booktitle year pages",
    "website": "title url urldate", "misc": "title year", "unknown": "authors title year",
}
KEY_SHAPE = r"^([A-Za-z]+)(\d{2})([a-z])?$"


def missing_fields() -> Column:
    """Names of required fields that are null or empty; a null or foreign type counts as unknown."""
    kind = F.when(F.col("entry_type").isin(list(REQUIRED)), F.col("entry_type")).otherwise("unknown")
    out = F.array().cast("array<string>")
    for k, fields in REQUIRED.items():
        out = F.when(kind == k, F.filter(F.array(*[F.when(blank(F.col(f)), F.lit(f)) for f in fields.split()]), lambda x: x.isNotNull())).otherwise(out)
    return out


def key_error() -> Column:
    letters = F.length(F.regexp_extract("key", KEY_SHAPE, 1))
    return F.when(~F.col("key").rlike(KEY_SHAPE), "format").when((letters < 2) | (letters > 6), "initials")


def single_dash() -> Column:
    return F.coalesce(F.col("pages").rlike(r"\d-\d") & ~F.contains("pages", F.lit("--")), F.lit(False))


def first_name_first() -> Column:
    """The first author written as two capitalised words without a comma."""
    return F.get(F.filter(F.transform(F.split("authors", ";"), strip), lambda a: a.rlike(r"^[A-ZÄÖÜ][a-zäöüß]{2,}\s+[A-ZÄÖÜ][a-zäöüß]{2,}$")), F.lit(0))


def page_span() -> Column:
    p = r"(\d+)\s*[-–—]+\s*(\d+)"
    return first_match(F.col("pages"), p, 2).try_cast("bigint") - first_match(F.col("pages"), p, 1).try_cast("bigint")


def key_year_ok() -> Column:
    return F.when(~blank(F.col("year")), F.right("year", F.lit(2)) == F.regexp_extract("key", KEY_SHAPE, 2))


def key_initials_ok() -> Column:
    """Key letters against the first two of the first surname, or the initials of up to three; one may be the start of the other."""
    names = F.filter(F.transform(F.split("authors", ";"), lambda a: F.lower(strip(F.substring_index(strip(a), ",", 1)))), lambda s: s != "")
    key = F.lower(F.regexp_extract("key", KEY_SHAPE, 1))
    two, firsts = F.substring(F.get(names, F.lit(0)), 1, 2), F.array_join(F.transform(F.slice(names, 1, 3), lambda s: F.substring(s, 1, 1)), "")
    fits = lambda f: key.startswith(f) | f.startswith(key)
    return F.when(~blank(F.col("authors")) & (F.size(names) > 0), fits(two) | ((F.size(names) >= 2) & fits(firsts)))


def key_consistent() -> Column:
    """True, false, or null where neither year nor authors can be compared."""
    y, i = key_year_ok(), key_initials_ok()
    both = F.when(y.isNull() & i.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(y, F.lit(True)) & F.coalesce(i, F.lit(True)))
    return F.when(F.col("key").rlike(KEY_SHAPE), both)


def issues(entries: DataFrame, this_year: int) -> DataFrame:
    """Adds ``issues`` in reporting order and ``key_ok``. ``this_year`` is a parameter, so that results repeat."""
    e = entries.withColumn("key_ok", key_consistent())
    tags = F.concat(
        F.array(F.concat(F.lit("key:"), key_error())), F.transform(missing_fields(), lambda f: F.concat(F.lit("missing:"), f)),
        F.array(
            F.when(single_dash(), "pages:dash"), F.when(first_name_first().isNotNull(), "authors:order"), F.when(F.col("year").try_cast("int") > this_year + 1, "year:future"),
            F.when(page_span() > 200, "pages:span"), F.when(~F.col("key_ok"), "key:inconsistent"),
        ),
    )
    return e.withColumn("issues", F.filter(tags, lambda x: x.isNotNull()))
