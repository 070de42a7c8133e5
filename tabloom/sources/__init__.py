"""Readers and writers: delimited tables, array bundles, run logs, reports."""
