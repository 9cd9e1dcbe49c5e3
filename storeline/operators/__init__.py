"""Integrity checks and change operators (distributed joins/aggregations)."""

from storeline.operators.changes import (  # noqa: F401
    cascade_delete, cascade_update, guard_delete_items, guard_update_items, restrict_delete,
)
from storeline.operators.checks import (  # noqa: F401
    check_all, check_domain, check_foreign_key, check_not_null, check_primary_key,
    check_range, check_sale_has_items, check_unique, check_width,
)
from storeline.operators.deduction import deduct_stock_atomic, deduct_stock_rows  # noqa: F401
