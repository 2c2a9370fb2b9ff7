"""Readers of delimited text and writers of result tables."""
