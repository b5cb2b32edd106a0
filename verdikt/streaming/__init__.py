"""Structured Streaming forms of the trailing-rate and rating jobs."""
