"""Dates and time expressions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import vocabulary as V

_MONTH = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"
MONTH_RE = rf"(?i)\b(?:in|on|during|from|since)\s+({_MONTH})(?:\.?)\s*(\d{{1,2}})?(?:st|nd|rd|th)?(?:,?\s*(\d{{4}}))?\b"
ISO_RE, US_RE = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
#: Pattern, days before the anchor as n times unit, give and take.
RELATIVE = [(r"(?i)\byesterday\b", 0, 2, None), (r"(?i)\blast week\b", 6, 8, None), (r"(?i)\blast month\b", 28, 33, None), (r"(?i)\blast year\b", 360, 370, None), (r"(?i)\b(\d+)\s+days?\s+ago\b", 1, 1, 1), (r"(?i)\b(\d+)\s+weeks?\s+ago\b", 7, 3, 1), (r"(?i)\b(\d+)\s+months?\s+ago\b", 30, 5, 1)]
KIND = "struct<month:int,day:int,year:int,lo:int,hi:int>"


def _expr(month=None, day=None, year=None, lo=None, hi=None) -> Column:
    null = F.lit(None).cast("int")
    return F.struct(*[(x if x is not None else null).alias(n) for n, x in (("month", month), ("day", day), ("year", year), ("lo", lo), ("hi", hi))])


def expressions(text: Column) -> Column:
    """The time expressions of a text: relative ones as windows of days, months and dates as parts of a date."""
    rel = []
    for pattern, a, b, grouped in RELATIVE:
        if grouped:
            n = F.regexp_extract(text, pattern, 1).try_cast("int")
            rel.append(F.when(n.isNotNull(), _expr(lo=F.greatest(F.lit(0), n * a - b), hi=n * a + b)))
        else:
            rel.append(F.when(text.rlike(pattern), _expr(lo=F.lit(a), hi=F.lit(b))))
    month = F.create_map(*[x for k, v in V.MONTHS.items() for x in (F.lit(k), F.lit(v))])
    part = lambda c, p, i: F.regexp_extract(c, p, i).try_cast("int")
    named = F.transform(F.regexp_extract_all(text, F.lit(MONTH_RE), 0), lambda m: _expr(month=F.try_element_at(month, F.lower(F.regexp_extract(m, MONTH_RE, 1))), day=F.when(part(m, MONTH_RE, 2) > 0, part(m, MONTH_RE, 2)), year=part(m, MONTH_RE, 3)))
    iso = F.transform(F.regexp_extract_all(text, F.lit(ISO_RE), 0), lambda m: _expr(year=part(m, ISO_RE, 1), month=part(m, ISO_RE, 2), day=part(m, ISO_RE, 3)))
    us = F.transform(F.regexp_extract_all(text, F.lit(US_RE), 0), lambda m: _expr(month=part(m, US_RE, 1), day=part(m, US_RE, 2), year=part(m, US_RE, 3)))
    return F.array_distinct(F.concat(F.filter(F.array(*rel), lambda x: x.isNotNull()), named, iso, us))


def record_date(text: Column) -> Column:
    """The first `YYYY-M-D` in a record's date; days that don't exist give null."""
    return F.try_to_timestamp(F.regexp_extract(text, r"(\d{4}-\d{1,2}-\d{1,2})", 1), F.lit("yyyy-M-d")).cast("date")


def question_date(text: Column) -> Column:
    """A question's own date, `YYYY/M/D`; other shapes count as none."""
    return F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4}/\d{1,2}/\d{1,2})", 1), F.lit("yyyy/M/d")).cast("date")


def date_key(text: Column) -> Column:
    return F.nullif(F.replace(F.regexp_extract(text, r"^(\d{4}[-/]\d{2}[-/]\d{2})", 1), F.lit("/"), F.lit("-")), F.lit(""))


def epoch_date(ts: Column) -> Column:
    """UTC date of seconds, or of milliseconds if the number is above 1e12."""
    days = F.floor(F.when(ts > 1_000_000_000_000, ts / 1000).otherwise(ts) / 86400).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")


def matches(exprs: Column, date: Column, anchor: Column) -> Column:
    """Whether any expression holds for a record's date, seen from the anchor."""
    far = F.datediff(anchor, date)
    same = lambda want, have: want.isNull() | (want == have)
    one = lambda e: F.when(e["lo"].isNotNull(), far.between(e["lo"], e["hi"])).otherwise((e["month"] == F.month(date)) & same(e["day"], F.dayofmonth(date)) & same(e["year"], F.year(date)))
    return F.coalesce(F.exists(exprs, one), F.lit(False))


def boost(exprs: Column, date: Column, anchor: Column) -> Column:
    return F.when(date.isNotNull() & anchor.isNotNull() & matches(exprs, date, anchor), V.TEMPORAL_BOOST).otherwise(1.0)


def query_anchor(query: Column) -> Column:
    """The date a question asks as of: `as of <Mon> D, YYYY`, `on <Mon> D, YYYY`, an ISO date, or the Chinese form."""
    month = F.create_map(*[x for k, v in V.MONTHS.items() for x in (F.lit(k), F.lit(v))])
    out = []
    for p in (r"(?i)\bas of\s+([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s*(\d{4})", r"(?i)\bon\s+([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s*(\d{4})"):
        y, m, d = F.regexp_extract(query, p, 3).try_cast("int"), F.try_element_at(month, F.lower(F.regexp_extract(query, p, 1))), F.regexp_extract(query, p, 2).try_cast("int")
        out.append(F.try_make_date(y, m, d) if hasattr(F, "try_make_date") else F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-M-d")).cast("date"))
    zh = r"截至\s*(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
    chinese = F.try_to_timestamp(F.concat_ws("-", *[F.regexp_extract(query, zh, i) for i in (1, 2, 3)]), F.lit("yyyy-M-d")).cast("date")
    return F.coalesce(out[0], chinese, out[1], record_date(query))
