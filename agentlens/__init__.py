"""Spark jobs for measuring and steering coding agents from append-only records."""
