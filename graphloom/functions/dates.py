"""Partial dates (YYYY, YYYY-MM, YYYY-MM-DD) and the two time axes, as column expressions.

Validity is when a fact held, belief when the graph held it. Partial dates compare as strings after padding; dates before the
year 0 are kept but not ordered.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import NULL_WORDS, bound, trimmed

_DATE = r"^(-?[0-9]{1,4})(?:-([0-9]{1,2}))?(?:-([0-9]{1,2}))?$"


def clean_date(c: Column) -> Column:
    """A stated date with parts zero-padded; null for words that mean none and for anything vaguer than a year."""

    def clean(t: Column) -> Column:
        year, month, day = (F.regexp_extract(t, _DATE, k) for k in (1, 2, 3))
        padded = F.when(year.startswith("-"), F.concat(F.lit("-"), F.lpad(F.regexp_replace(F.substring(year, 2, 4), "^0+(?=.)", ""), 3, "0"))).otherwise(F.lpad(year, 4, "0"))
        out = F.concat(padded, F.when(month != "", F.concat(F.lit("-"), F.lpad(month, 2, "0"))).otherwise(""), F.when((month != "") & (day != ""), F.concat(F.lit("-"), F.lpad(day, 2, "0"))).otherwise(""))
        return F.when(~F.lower(t).isin(*NULL_WORDS) & t.rlike(_DATE), out)

    return bound(trimmed(c.cast("string")), clean)


def date_key(c: Column) -> Column:
    """A partial date padded to a full one, so that strings compare in time; empty for null."""
    parts = F.split(F.coalesce(c, F.lit("")), "-")
    at = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit("01"))
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.concat_ws("-", at(0), at(1), at(2)))


def valid_at(valid_from: Column, valid_to: Column, as_of: Column | str) -> Column:
    """Whether a fact holds on a date: both ends count, and an end not stated is open."""
    at = date_key(F.lit(as_of) if isinstance(as_of, str) else as_of)
    after = F.coalesce(date_key(valid_from) <= at, F.lit(True)) | (F.coalesce(valid_from, F.lit("")) == "")
    before = (date_key(valid_to) >= at) | (F.coalesce(valid_to, F.lit("")) == "")
    return after & before


def known_at(t_created: Column, t_expired: Column, instant: Column | str) -> Column:
    """Whether the graph held a relation at an instant (ISO 8601, UTC): created by then, or always; not expired by then."""
    at = F.lit(instant) if isinstance(instant, str) else instant
    created = (F.coalesce(t_created, F.lit("")) == "") | (t_created <= at)
    expired = (F.coalesce(t_expired, F.lit("")) == "") | (t_expired > at)
    return created & expired


def session_date(c: Column) -> Column:
    """YYYY/MM/DD at the beginning as an ISO date; null otherwise."""
    d = F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([0-9]{4})/([0-9]{2})/([0-9]{2})", 0)
    return F.nullif(F.replace(F.trim(d), F.lit("/"), F.lit("-")), F.lit(""))


def utc_instant(c: Column) -> Column:
    """A timestamp without zone as an ISO instant in UTC, comparable as a string."""
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
