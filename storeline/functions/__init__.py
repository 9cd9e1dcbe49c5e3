"""Column expressions and sizing helpers."""

from storeline.functions.expressions import (  # noqa: F401
    always_open, as_date, key_as_bigint, like_pattern, line_revenue, money,
    month_back, quarter_range, seconds_of_day, text_match,
)
from storeline.functions.sizing import bounded_broadcast, one_row  # noqa: F401
