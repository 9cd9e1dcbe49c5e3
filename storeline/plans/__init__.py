"""Business queries as DataFrame plans."""

from storeline.plans.queries import (  # noqa: F401
    best_store_this_quarter, loyalty_bundle, product_availability, reorder_alert,
    sale_member_flag, store_always_open, table_counts, top_selling_past_month,
    variety_by_ownership, vendor_stats,
)
