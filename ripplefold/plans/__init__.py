"""Catalogue of runnable queries over the test tables, each with the SQL that states the same result."""
