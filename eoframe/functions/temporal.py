"""Time helpers: ranges, ISO keys, representative times, dates found in text."""

from __future__ import annotations

import calendar
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Timestamp text formats.
ISO_KEY_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"   # F24: ISO key without zone
CAPTION_DATE_FORMAT = "dd MMM yyyy"        # F13 frame captions


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_time_range(year: int | None = None, month: int | None = None,
                  day: int | None = None) -> tuple[datetime, datetime] | None:
    """Calendar period -> half-open [begin, end). Day without month = whole year."""
    if year is None:
        return None
    if month is None:
        return datetime(year, 1, 1), datetime(year + 1, 1, 1)
    if day is None:
        last = calendar.monthrange(year, month)[1]
        b = datetime(year, month, 1)
        return b, b + timedelta(days=last)
    b = datetime(year, month, day)
    return b, b + timedelta(days=1)


def day_range(begin: str, end: str) -> tuple[datetime, datetime]:
    """Inclusive calendar days ``(begin, end)`` -> half-open timestamp range."""
    b = datetime.fromisoformat(begin)
    e = datetime.fromisoformat(end) + timedelta(days=1)
    return b, e


def ntz(dt: datetime) -> Column:
    """Wall-clock timestamp literal, independent of the Python and session time zones."""
    return F.lit(dt.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def in_range(t, rng) -> Column:
    """``begin <= t < end``; no range = no filter."""
    if rng is None:
        return F.lit(True)
    b, e = rng
    tc = _c(t)
    return (tc >= ntz(b)) & (tc < ntz(e))


def iso_key(t) -> Column:
    """timestamp -> ``yyyy-MM-ddTHH:mm:ss`` (no zone)."""
    return F.date_format(_c(t), ISO_KEY_FORMAT)


def epoch_micros(t) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp, independent of session zone."""
    return F.timestamp_diff("MICROSECOND", ntz(datetime(1970, 1, 1)),
                            _c(t).cast("timestamp_ntz"))


def representative_time(dt, start, end, range_only=None) -> Column:
    """``datetime``, else the range start; rows that are ``range_only`` (the older
    layout) get the middle of [start, end], a start alone where there is no end."""
    half = F.floor(F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / 2)
    mid = F.coalesce(F.timestamp_add("MICROSECOND", half, _c(start)), _c(start))
    plain = F.coalesce(_c(dt), _c(start))
    return plain if range_only is None else F.when(_c(range_only), mid).otherwise(plain)


def creation_time(created, creation_dt, indexed) -> Column:
    """``created``, else ``creation_dt`` (text, or null where it did not parse), else
    the index time."""
    return F.coalesce(_c(created), _c(creation_dt).try_cast("timestamp_ntz"), _c(indexed))


def year_of(t) -> Column:
    """F38."""
    return F.year(_c(t))


# Fixed values (F18): date shapes recognised in free text, as one alternation
# scanned left to right, and the layouts tried on each match (year-first, then
# month-first, then day-first; '/' and '_' become '-', '.' is kept).
DATE_IN_TEXT_PATTERN = (r"(?i)(\d{4}[-/._]\d{1,2}[-/._]\d{1,2})|"
                        r"(\d{1,2}[-/._]\d{1,2}[-/._]\d{2,4})|"
                        r"([a-zA-Z]{3,9}\s?\d{1,2},?\s?\d{4})|"
                        r"(\d{1,2}\s?[a-zA-Z]{3,9}\s?\d{4})")
DATE_TEXT_FORMATS = ["yyyy-M-d", "yyyy.M.d", "M-d-yyyy", "M.d.yyyy", "d-M-yyyy", "d.M.yyyy",
                     "M-d-yy", "d-M-yy", "MMM d, yyyy", "MMM d yyyy", "MMMM d, yyyy", "MMMM d yyyy",
                     "MMMd, yyyy", "MMMd yyyy", "d MMM yyyy", "d MMMM yyyy", "dMMM yyyy", "dMMMM yyyy"]
DATE_OUT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _parse_date_text(m) -> Column:
    norm = F.regexp_replace(m, "[/_]", "-")
    return F.coalesce(*[F.try_to_timestamp(norm, F.lit(f)) for f in DATE_TEXT_FORMATS])


def date_in_text(s, out_format: str = DATE_OUT_FORMAT) -> Column:
    """first date in free text that parses, re-formatted; null when none.

    The leftmost match is parsed directly; only when it does not parse are
    the later matches tried (``coalesce`` evaluates that branch lazily).
    """
    first = F.regexp_extract(_c(s), DATE_IN_TEXT_PATTERN, 0)
    found = F.regexp_extract_all(_c(s), F.lit(DATE_IN_TEXT_PATTERN), 0)
    later = F.try_element_at(F.filter(F.transform(found, _parse_date_text), lambda x: x.isNotNull()), F.lit(1))
    return F.date_format(F.coalesce(F.when(first != "", _parse_date_text(first)), later), out_format)
