"""Operators for preparing training text: archives, scans, filters, deduplication, mixing and token files."""
