"""Whole pipelines, registered queries and their SQL."""
