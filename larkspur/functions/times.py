"""RFC 3339 times with nanoseconds, as text: parsing, UTC form, and column expressions.

Spark's TIMESTAMP keeps microseconds, so nanoseconds never pass through it.
"""

from __future__ import annotations

import calendar
import re
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = r"^(\d{4})-(\d{2})-(\d{2})[Tt](\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?([Zz]|[+-]\d{2}:\d{2})$"
_RFC3339 = re.compile(_SHAPE, re.ASCII)


def parse(text: str) -> tuple[int, int]:
    """Seconds since 1970 and nanoseconds; ValueError for anything that is no such time."""
    m = _RFC3339.match(text)
    if not m:
        raise ValueError(f"invalid time: {text}")
    year, month, day, hour, minute, second = (int(m[i]) for i in range(1, 7))
    if not 1 <= month <= 12 or not 1 <= day <= calendar.monthrange(max(year, 1), month)[1] or hour > 23 or minute > 59 or second > 59:
        raise ValueError(f"invalid time: {text}")
    shift = 0
    if m[8] not in "Zz":
        ahead, more = int(m[8][1:3]), int(m[8][4:6])
        if ahead > 23 or more > 59:
            raise ValueError(f"invalid time: {text}")
        shift = (ahead * 3600 + more * 60) * (1 if m[8][0] == "+" else -1)
    return calendar.timegm((year, month, day, hour, minute, second)) - shift, int((m[7] or "").ljust(9, "0"))


def utc(seconds: int, nanos: int) -> str:
    """Seconds, nanoseconds without trailing zeros, and ``Z``."""
    t = time.gmtime(seconds)
    fraction = f".{nanos:09d}".rstrip("0") if nanos else ""
    return f"{t.tm_year:04d}-{t.tm_mon:02d}-{t.tm_mday:02d}T{t.tm_hour:02d}:{t.tm_min:02d}:{t.tm_sec:02d}{fraction}Z"


def utc_column(text: Column) -> Column:
    """The UTC form of a time column; null where it is no RFC 3339 time."""
    whole = F.try_to_timestamp(F.regexp_replace(F.upper(text), r"\.\d{1,9}", ""), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    nanos = F.rtrim(F.regexp_extract(text, r"\.(\d{1,9})", 1), F.lit("0"))
    made = F.concat(F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss"), F.when(nanos == "", "").otherwise(F.concat(F.lit("."), nanos)), F.lit("Z"))
    return F.when(text.rlike(_SHAPE), made)
