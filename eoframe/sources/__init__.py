"""Scans: driver tables, derived fixture views, landed documents."""
