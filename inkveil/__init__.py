"""Finding and redacting personal data in tables of text blocks, on Spark."""
