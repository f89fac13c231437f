"""Lantern: finding, scoring and redacting sensitive data in text, on Spark DataFrames."""
