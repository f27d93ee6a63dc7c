"""Composed pipelines, derived inputs and the query catalogue."""
