"""Spark jobs for API traffic and contract analytics."""
