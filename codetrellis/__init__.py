"""Dependency analytics for source code and other graphs, as Spark jobs."""
