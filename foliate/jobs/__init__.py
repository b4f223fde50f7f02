"""Batch jobs and the registry of queries."""
