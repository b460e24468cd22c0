"""Corpus preparation on Spark: from files, stored pages and PDF text to prompts."""
