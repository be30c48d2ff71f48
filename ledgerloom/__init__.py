"""Payment analytics as Spark jobs: routing, rollups, semantic queries, quality checks, history and retention."""

__version__ = "0.1.0"
