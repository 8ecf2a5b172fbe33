"""Pipelines, configuration, model stages and the query catalogue."""
