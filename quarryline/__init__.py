"""Curation, de-duplication, splitting and evaluation of record tables on Spark."""
