"""Column expressions shared by the queries: money, text match, date ranges.

All are built-in Spark expressions, so they stay inside whole-stage codegen
and literal arguments are constant-folded into pushed scan filters.
"""

from __future__ import annotations

import datetime as _dt
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,2)"
_INT_TEXT = re.compile(r"^[+-]?\d+$")

DateLike = "str | _dt.date | _dt.datetime | Column | None"


def line_revenue(quantity: str = "quantity", price: str = "price") -> Column:
    """quantity x current list price, exact decimal arithmetic."""
    return F.col(quantity).cast("decimal(19,0)") * F.col(price)


def money(c: Column) -> Column:
    """Money sums are reported as DECIMAL(38,2)."""
    return c.cast(MONEY)


def like_pattern(key: str) -> str:
    """``%key%``: the key's own ``%`` and ``_`` stay wildcards; a backslash is itself."""
    return "%" + key.replace("\\", "\\\\") + "%"


#: Names, unique texts and ENUM labels compare without regard to case and accents.
COLLATION = "UNICODE_CI_AI"


def collated(c: Column) -> Column:
    """``c`` for grouping, joining and membership tests under COLLATION."""
    return F.collate(c, COLLATION)


def _accents() -> tuple[str, str]:
    """Latin letters with marks and the letters that they are built on, then the combining marks alone."""
    marked, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(x) for x in parts[1:]):
            marked.append(chr(code))
            plain.append(parts[0])
    return "".join(marked) + "".join(map(chr, range(0x300, 0x370))), "".join(plain)


_MARKED, _PLAIN = _accents()


def without_accents(c: Column) -> Column:
    """``c`` in lower case, letters without their marks; combining marks go."""
    return F.lower(F.translate(c, _MARKED, _PLAIN))


def key_without_accents(key: str) -> str:
    table = {ord(m): (_PLAIN[i] if i < len(_PLAIN) else None) for i, m in enumerate(_MARKED)}
    return key.translate(table).lower()


def text_match(column: str, key: str, literal: bool = False,
               accent_insensitive: bool = False) -> Column:
    """Case-insensitive substring match, as a ``LIKE '%key%'`` test.

    ``accent_insensitive`` also ignores accents (``'caf_'`` finds ``'Café'``): collated strings refuse
    ``LIKE``, so text and key are compared without their marks.
    """
    if accent_insensitive:
        text, key = without_accents(F.col(column)), key_without_accents(key)
        return text.contains(key) if literal else text.like(like_pattern(key))
    if literal:
        return F.lower(F.col(column)).contains(key.lower())
    return F.col(column).ilike(like_pattern(key))


def key_as_bigint(key: str) -> int | None:
    """Parse a search key the way a text-to-BIGINT cast does (NULL if not numeric)."""
    s = key.strip()
    if not _INT_TEXT.match(s):
        return None
    v = int(s)
    return v if -(2 ** 63) <= v < 2 ** 63 else None


def as_date(as_of) -> Column:
    """The query date; ``None`` means today (``current_date()``)."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of.cast("date")
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.date()
    if isinstance(as_of, _dt.date):
        return F.lit(as_of)
    return F.lit(_dt.date.fromisoformat(str(as_of)))


def month_back(as_of) -> Column:
    """``as_of - INTERVAL 1 MONTH`` at midnight (month-end clamped)."""
    return F.add_months(as_date(as_of), -1).cast("timestamp_ntz")


def quarter_range(as_of) -> tuple[Column, Column]:
    """Half-open [start, end) of the calendar quarter holding ``as_of``.

    A plain range keeps the predicate on the raw column, so it reaches the
    Parquet scan; ``quarter(ts) = quarter(d) AND year(ts) = year(d)`` would not.
    """
    start = F.date_trunc("quarter", as_date(as_of).cast("timestamp_ntz")).cast("timestamp_ntz")
    end = F.add_months(start.cast("date"), 3).cast("timestamp_ntz")
    return start, end


def always_open(open_s: str = "open_s", close_s: str = "close_s") -> Column:
    """24-hour store flag: open time equals close time; NULL if either is NULL."""
    return F.col(open_s) == F.col(close_s)


def seconds_of_day(text: str) -> Column:
    """``'HH:MM[:SS]'`` as seconds of the day; ``'24:00'`` is 86400.

    Text outside 00:00..24:00 gives NULL, so a width/type check can catch it.
    A time type cannot hold ``24:00``, hence seconds.
    """
    parts = F.split(F.trim(F.col(text)), ":")
    h = F.try_element_at(parts, F.lit(1)).try_cast("int")
    m = F.try_element_at(parts, F.lit(2)).try_cast("int")
    sec = F.coalesce(F.try_element_at(parts, F.lit(3)).try_cast("int"), F.lit(0))
    total = h * 3600 + m * 60 + sec
    ok = (F.size(parts).between(2, 3) & m.between(0, 59) & sec.between(0, 59)
          & total.between(0, 86400))
    return F.when(ok, total)
