"""Queries over related tables, nested results, copy-on-write changes and change synchronisation, on Spark."""
