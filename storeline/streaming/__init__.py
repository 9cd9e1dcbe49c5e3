"""Structured Streaming jobs."""

from storeline.streaming.stock_stream import (  # noqa: F401
    StockKeeper, deduct_stock_stream, replay, run_to_completion,
)
