"""Scalar expressions; all of them are plain Catalyst columns (no Python UDFs)."""

from .scalars import am_or_pm, cents_half_up, hhmm_pretty, parse_double, parse_long, strip_quotes, two_decimals

__all__ = ["am_or_pm", "cents_half_up", "hhmm_pretty", "parse_double", "parse_long", "strip_quotes", "two_decimals"]
