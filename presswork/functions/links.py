"""Links, identities and time windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import iso_utc, squeeze, strip

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def normalize_link(link: Column) -> Column:
    """Scheme and host in lower case, no last slash, no fragment, no tracking keys, the query encoded anew; "" for a blank link."""
    own = strip(F.coalesce(link, F.lit("")))
    part = lambda i: F.regexp_extract(own, _URL, i)
    scheme, host, path, query = F.lower(part(1)), F.lower(part(2)), part(3), part(4)
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)
    encode = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    items = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.struct(decode(F.regexp_extract(x, "^([^=]*)", 1)).alias("k"), decode(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.filter(items, lambda i: ~F.lower(i["k"]).isin("fbclid", "gclid") & ~F.startswith(F.lower(i["k"]), F.lit("utm_")))
    asked = F.array_join(F.transform(kept, lambda i: F.concat(encode(i["k"]), F.lit("="), encode(i["v"]))), "&")
    short = F.regexp_replace(path, "/+$", "")
    return F.when(own == "", "").otherwise(
        F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), F.when(short == "", path).otherwise(short), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))
    )


def article_id(normalized_link: Column, source: Column, title: Column, at: Column) -> Column:
    basis = F.when(normalized_link != "", F.concat(F.lit("link:"), normalized_link)).otherwise(F.concat(F.lit("fallback:"), F.lower(strip(source)), F.lit(":"), squeeze(F.lower(F.coalesce(title, F.lit("")))), F.lit(":"), F.coalesce(iso_utc(at), F.lit(""))))
    return F.concat(F.lit("art_"), F.substring(F.sha2(basis, 256), 1, 24))


def dedupe_key(normalized_link: Column, own_id: Column) -> Column:
    return F.coalesce(F.nullif(normalized_link, F.lit("")), own_id)


_Y, _TWO, _END = r"/(\d{4})", r"(\d{2})", "(?:/|$)"
_DATES = [f"{_Y}{first}{_TWO}{second}{_TWO}{_END}" for first, second in ("-/", "/-", "//", "--")]


def url_date(url: Column) -> Column:
    """The date of the first pattern that matches; null where that isn't a date, whatever later patterns find."""
    out = None
    for pattern in _DATES:
        text = F.concat_ws("-", *[F.regexp_extract(url, pattern, i) for i in (1, 2, 3)])
        found = F.regexp_extract(url, pattern, 0) != ""
        out = F.when(found, text) if out is None else out.when(found, text)
    return F.try_to_date(out, "yyyy-MM-dd")


def stale_by_url(url: Column, as_of: Column, lookback_hours: int, tolerance_days: int) -> Column:
    """Whether the URL's date is before the window's first day, less the tolerance; as_of stands for the clock."""
    first = F.date_sub(F.to_date(as_of - F.expr(f"INTERVAL {lookback_hours} HOURS")), tolerance_days)
    return F.coalesce(url_date(url) < first, F.lit(False))


def within_lookback(at: Column, as_of: Column, hours: int) -> Column:
    """In [as_of - hours, as_of], or without a time."""
    return at.isNull() | at.between(as_of - F.expr(f"INTERVAL {hours} HOURS"), as_of)


def within_days(at: Column, report_date: Column, days: int) -> Column:
    """In the days before the end of report_date (UTC), the end excluded, or without a time."""
    end = F.date_add(report_date, 1).cast("timestamp_ntz")
    return at.isNull() | ((at >= end - F.expr(f"INTERVAL {days} DAYS")) & (at < end))


def security_id(code: Column, market: Column) -> Column:
    """1. for Shanghai and 0. for Shenzhen, by the market's name, else by the code's first digit."""
    own, place = strip(code), F.lower(strip(market))
    return F.concat(F.when(place.isin("sh", "上海", "上交所"), "1.").when(place.isin("sz", "深圳", "深交所"), "0.").when(F.substring(own, 1, 1).isin("5", "6", "9"), "1.").otherwise("0."), own)


def to_float(value: Column) -> Column:
    """Null for "", "-" and what isn't a number."""
    return F.when(~value.isin("", "-"), value.try_cast("double"))
