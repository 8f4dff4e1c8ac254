"""Scans and sinks (S1-S8) and the adapter from the driver tables."""

from caseloom.sources.cases import read_grants, read_locations, read_users, scan_cases, union_sites
from caseloom.sources.importer import read_import, select_import_columns

__all__ = ["read_grants", "read_import", "read_locations", "read_users", "scan_cases",
           "select_import_columns", "union_sites"]
