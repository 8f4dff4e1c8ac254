"""Column expressions (built-ins only, so they stay in whole-stage codegen)."""

from caseloom.functions.dates import export_date, in_month, month_start, parse_case_date
from caseloom.functions.numbers import half_up_percent, half_up_share
from caseloom.functions.text import (all_digits, display_label, not_placeholder, present, py_strip,
                                     truncate_text)

__all__ = [
    "all_digits", "display_label", "export_date", "half_up_percent", "half_up_share", "in_month",
    "month_start", "not_placeholder", "parse_case_date", "present", "py_strip", "truncate_text",
]
