"""Reusable physical-plan building blocks (row numbers, max-plus scans,
distributed numbering, lineage cuts)."""

from caseloom.plans.lineage import checkpoint_dir, cut_lineage
from caseloom.plans.numbering import global_row_number

__all__ = ["checkpoint_dir", "cut_lineage", "global_row_number"]
