"""Readers that turn payloads, grids and pages into typed DataFrames."""
