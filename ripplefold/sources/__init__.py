"""Readers and parsers that turn raw inputs into DataFrames, and the writers that persist results."""
