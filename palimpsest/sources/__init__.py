"""Scans, samplers, label imports and sinks."""
