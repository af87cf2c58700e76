"""String functions over URLs, paths, labels and sizes (all JVM-side Columns)."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and unit ladders results depend on.
URL_PATTERN = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
PATH_PATTERN = r"(?:/?[\w\-\.]+(?:/[\w\-\.]+)+)"
TIER_SEPARATOR = r"_T\d_"
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_url(s) -> Column:
    """first http(s) URL in a string, null when none."""
    return F.nullif(F.regexp_extract(_c(s), URL_PATTERN, 0), F.lit(""))


def first_path(s) -> Column:
    """first path-like token (at least one separator), null when none."""
    return F.nullif(F.regexp_extract(_c(s), PATH_PATTERN, 0), F.lit(""))


def url_path(url) -> Column:
    """F16: path part of a URL without the leading slash and without the query."""
    return F.regexp_replace(F.try_parse_url(_c(url), F.lit("PATH")), "^/", "")


def dirname(path) -> Column:
    """F16: everything before the last '/', '' when there is none."""
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def basename(path) -> Column:
    """F16: text after the last '/'."""
    return F.substring_index(_c(path), "/", -1)


def parent_name(path) -> Column:
    """F16: name of the directory holding ``path``."""
    return basename(dirname(path))


def extension(path) -> Column:
    """F16: lower-case text after the last '.' of the file name ('' when none)."""
    b = basename(path)
    return F.lower(F.when(b.contains("."), F.substring_index(b, ".", -1)).otherwise(F.lit("")))


def unquote(s) -> Column:
    """F16: percent-decoding that keeps '+' (``url_decode`` alone maps '+' to space)."""
    return F.url_decode(F.replace(_c(s), F.lit("+"), F.lit("%2B")))


def after_last_match(s, pattern: str = TIER_SEPARATOR) -> Column:
    """text after the last match of ``pattern``; the whole string when none matches."""
    m = F.regexp_extract(_c(s), f"^.*{pattern}(.*)$", 1)
    return F.when(_c(s).rlike(pattern), m).otherwise(_c(s))


def fnmatch_regex(glob: str) -> str:
    """shell glob -> Java regex (``*`` also spans '/')."""
    rx = fnmatch.translate(glob)
    # Python's translate wraps as (?s:...)\Z; Java understands (?s:...) but not \Z the same way.
    return "^" + rx.replace("\\Z", "$")


def matches_glob(s, glob: str) -> Column:
    return _c(s).rlike(fnmatch_regex(glob))


def _pow1024(k: int) -> int:
    return 1024 ** k


def _unit_index(b: Column, top: int) -> Column:
    idx = F.lit(top)
    for k in range(top - 1, -1, -1):
        idx = F.when(b < F.lit(_pow1024(k + 1)), F.lit(k)).otherwise(idx)
    return idx


def _fixed_decimals(b: Column, k: Column, decimals: int) -> Column:
    """b / 1024^k rounded half-to-even at ``decimals`` places, formatted, using exact
    integer arithmetic (the value is an exact binary fraction)."""
    scale = 10 ** decimals
    dec = "decimal(38,0)"
    d = F.pow(F.lit(2.0), k * 10).cast(dec)  # exact: powers of two below 2**53
    num = b.cast(dec) * F.lit(scale).cast(dec)
    q = F.floor(num / d).cast(dec)
    r = (num - q * d).cast(dec)
    up = (r * 2 > d) | ((r * 2 == d) & (F.pmod(q, F.lit(2).cast(dec)) == 1))
    q = (q + up.cast(dec)).cast(dec)
    whole = F.floor(q / F.lit(scale).cast(dec)).cast(dec)
    frac = (q - whole * F.lit(scale).cast(dec)).cast("long")
    return F.format_string(f"%s.%0{decimals}d", whole.cast("string"), frac)


def human_bytes(n) -> Column:
    """F14 (listing variant): '0 B', whole bytes, else one decimal up to PB."""
    b = _c(n).cast("long")
    k = _unit_index(b, 5)
    units = F.try_element_at(F.array(*[F.lit(u) for u in SIZE_UNITS]), k + 1)
    return (F.when(b == 0, F.lit("0 B"))
             .when(k == 0, F.concat(b.cast("string"), F.lit(" B")))
             .otherwise(F.concat(_fixed_decimals(b, k, 1), F.lit(" "), units)))


def human_bytes_2(n) -> Column:
    """F14 (tree variant): always two decimals, B .. PB."""
    b = _c(n).cast("long")
    k = _unit_index(b, 5)
    units = F.try_element_at(F.array(*[F.lit(u) for u in SIZE_UNITS]), k + 1)
    return F.concat(_fixed_decimals(b, k, 2), F.lit(" "), units)


def slug(s) -> Column:
    """F32: runs of non-alphanumerics -> '-', lower case."""
    return F.lower(F.regexp_replace(_c(s), "[^0-9a-zA-Z]+", "-"))


def common_prefix_dir(lo, hi) -> Column:
    """A18 helper: longest common directory of the smallest and largest URI.

    Equal URIs give the URI itself; otherwise the common prefix is cut at its
    last '/' (kept), which also covers one URI being a prefix of the other.
    """
    lo, hi = _c(lo), _c(hi)
    n = F.least(F.length(lo), F.length(hi))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                    lambda i: F.substring(lo, i, 1) != F.substring(hi, i, 1))
    first_diff = F.coalesce(F.try_element_at(same, F.lit(1)), n + 1)
    common = F.substring(lo, 1, first_diff - 1)
    cut = F.regexp_extract(common, r"^(.*/)[^/]*$", 1)
    return (F.when(lo.isNull(), F.lit(""))
             .when(lo == hi, lo)
             .otherwise(cut))
